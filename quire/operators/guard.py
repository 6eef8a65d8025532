"""Sensitive data, consent, and the routing of questions."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.strings import any_word, squeeze

#: Patterns by category of sensitive data.
PATTERNS = {
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    "phone": r"\b(?:\+?\d{1,3}[\s-]?)?(?:\d{3}[\s-]?){2}\d{4}\b",
    "credit_card": r"\b(?:\d[ -]?){13,19}\b",
    "pan": r"\b[A-Z]{5}\d{4}[A-Z]\b",
    "aadhaar": r"\b\d{4}[\s-]?\d{4}[\s-]?\d{4}\b",
    "ssn_like": r"\b\d{3}-\d{2}-\d{4}\b",
}
#: Greetings, small talk, wishes.
GREETINGS = ["hi", "hello", "hey", "yo", "hola", "namaste", "good morning", "good afternoon", "good evening", "gm", "ge", "gn"]
CHATTER = ["how are you", "what's up", "sup", "howdy", "have a nice day", "good day", "good night"]
#: Phrases of an answer that wasn't found in the document.
OUT_OF_DOCUMENT = ["not in the context", "context provided does not contain", "provided context does not contain", "does not contain information", "doesn't contain information", "i couldn't find", "i could not find", "couldn't find in your document", "could not find in your document", "not found in your document", "not found in the document", "no relevant information", "not available in the document", "outside the document", "outside of the document", "not present in the document"]
LINK = r"(?i)(https?://\S+|www\.\S+|ftp://\S+|mailto:\S+|t\.me/\S+|discord\.gg/\S+)"


def sensitive_counts(text: Column) -> dict[str, Column]:
    return {k: F.regexp_count(F.coalesce(text, F.lit("")), F.lit(p)).cast("long") for k, p in PATTERNS.items()}


def is_sensitive(text: Column) -> Column:
    """Whether any category is found."""
    found = [F.coalesce(text, F.lit("")).rlike(p) for p in PATTERNS.values()]
    return reduce(lambda a, b: a | b, found)


def scan_sensitive(docs: DataFrame) -> DataFrame:
    """doc_id, found, matches: hits by category, those above zero; categories are counted on their own."""
    counts = F.create_map(*[x for k, c in sensitive_counts(F.col("text")).items() for x in (F.lit(k), c)])
    return docs.select("doc_id", F.map_filter(counts, lambda k, v: v > 0).alias("matches")).select("doc_id", (F.size("matches") > 0).alias("found"), "matches")


def pii_summary(docs: DataFrame) -> DataFrame:
    """category, documents, hits over all documents; a row for each category that occurs."""
    return scan_sensitive(docs).select(F.explode("matches").alias("category", "n")).groupBy("category").agg(F.count("*").alias("documents"), F.sum("n").alias("hits"))


def has_link(text: Column) -> Column:
    return F.coalesce(text.rlike(LINK), F.lit(False))


def has_profanity(rows: DataFrame, words: DataFrame, key: str, text: str) -> DataFrame:
    """Keys of rows with a word of the caller's table (word)."""
    said = rows.select(key, F.explode(F.array_distinct(F.split(F.lower(text), "[^\\p{L}\\p{N}_']+"))).alias("word"))
    return said.join(words.select(F.lower("word").alias("word")).distinct(), "word", "left_semi").select(key).distinct()


def is_greeting(text: Column) -> Column:
    s = squeeze(text)
    short = (F.length(s) <= 40) & ~s.contains("?")
    return (s != "") & ((short & s.rlike(any_word([*GREETINGS, *CHATTER]))) | s.rlike(any_word(GREETINGS)))


def is_out_of_document(answer: Column) -> Column:
    low = squeeze(answer)
    return F.exists(F.array(*map(F.lit, OUT_OF_DOCUMENT)), lambda p: low.contains(p))


def consent_gate(scans: DataFrame, consents: DataFrame) -> DataFrame:
    """doc_id, sensitive, confirmed, allowed: sensitive documents are withheld until some consent confirms them."""
    given = consents.groupBy("doc_id").agg(F.bool_or("confirmed").alias("confirmed"))
    sure = F.coalesce("confirmed", F.lit(False))
    return scans.join(given, "doc_id", "left").select("doc_id", F.col("found").alias("sensitive"), sure.alias("confirmed"), (~F.col("found") | sure).alias("allowed"))


#: What an event does to a document's state, besides what depends on it: kinds of scans, answers and questions in the chat, and the consent form.
KINDS = ("scan_hit", "scan_clear", "yes", "no", "ask", "agree", "refuse")


def stepped(state: tuple[bool, bool, bool], kind: str) -> tuple[bool, bool, bool]:
    """(sensitive, confirmed, awaiting) after an event of a kind; other kinds change nothing."""
    sensitive, confirmed, awaiting = state
    gated = sensitive and not confirmed
    if kind in ("scan_hit", "scan_clear"):
        return kind == "scan_hit", confirmed, False
    if kind in ("agree", "refuse"):
        return sensitive, kind == "agree", False
    if gated and kind in ("yes", "no", "ask"):
        return sensitive, kind == "yes", kind == "ask"
    return state


def state_bits(number: int) -> tuple[bool, bool, bool]:
    return bool(number & 4), bool(number & 2), bool(number & 1)


def composed(steps: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row of `steps` takes the states 0 to 7 to others; rows of equal `group` lie together and are composed in order, in pairs of pairs."""
    while True:
        place = np.arange(len(group)) - np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1])[np.cumsum(np.concatenate([[0], group[1:] != group[:-1]]))]
        if not place.any():
            return steps, group
        left = np.flatnonzero(place % 2 == 0)
        pair = left[(left + 1 < len(group)) & (place[np.minimum(left + 1, len(group) - 1)] % 2 == 1)]
        steps[pair] = np.take_along_axis(steps[pair + 1], steps[pair], axis=1)
        steps, group = steps[left], group[left]


def composer(ordered: bool):
    """A range of rows in order (doc_id, and a kind or a composed step): a row for each document with what the rows do to each state."""
    of_kind = np.array([[sum(b << (2 - i) for i, b in enumerate(stepped(state_bits(s), k))) for s in range(8)] for k in (*KINDS, "other")], dtype=np.int8)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, held = TaskContext.get().partitionId(), None
        for pdf in batches:
            if not len(pdf):
                continue
            if ordered:
                steps = of_kind[pd.Categorical(pdf["kind"], [*KINDS]).codes]  # others and nulls are -1: the last row
            else:
                steps = np.array(pdf["step"].tolist(), dtype=np.int8)
            docs = pdf["doc_id"].to_numpy()
            if held is not None:
                steps, docs = np.concatenate([held[0], steps]), np.concatenate([held[1], docs])
            steps, docs = composed(steps, docs)
            if len(docs) > 1:  # a batch may hold one document alone, and a column of lists without rows has no type
                yield pd.DataFrame({"doc_id": docs[:-1], "part": part, "step": list(steps[:-1].astype(np.int32))})
            held = steps[-1:], docs[-1:]  # the last document may go on in the next batch
        if held is not None:
            yield pd.DataFrame({"doc_id": held[1], "part": part, "step": list(held[0].astype(np.int32))})

    return run


def consent_state(events: DataFrame) -> DataFrame:
    """doc_id, sensitive, confirmed, awaiting after all events (doc_id, ts, seq, kind), in order.

    A scan (scan_hit, scan_clear) says whether the document is sensitive and ends any waiting; the consent form (agree, refuse) says whether
    it is confirmed. In the chat a sensitive document that isn't confirmed is gated: `yes` confirms it, any other question (ask) waits for
    an answer, `no` ends the waiting; a chat about any other document changes nothing. Rows without a doc_id are left out, other kinds do nothing.

    An event is a function of eight states, and such functions compose: ranges of events are composed on their own, however many
    of them one document has, and a document's ranges after that, a row for each.
    """
    rows = events.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "ts", "seq", "kind")
    order = ["doc_id", "ts", "seq"]
    ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "kind").mapInPandas(composer(True), "doc_id long, part int, step array<int>")
    last = ranges.repartition("doc_id").sortWithinPartitions("doc_id", "part").mapInPandas(composer(False), "doc_id long, part int, step array<int>")
    bit = lambda n: F.col("step")[0].bitwiseAND(n) > 0
    return last.select("doc_id", bit(4).alias("sensitive"), bit(2).alias("confirmed"), bit(1).alias("awaiting"))


def processing_status(results: DataFrame) -> DataFrame:
    """Adds status: failed if indexing failed, awaiting-consent if it needs confirmation, else done."""
    return results.withColumn("status", F.when(~F.col("ok"), "failed").when(F.col("needs_confirmation"), "awaiting-consent").otherwise("done")).withColumn("error", F.when(~F.col("ok"), F.coalesce("error", F.lit("indexing failed"))))


def route_question(questions: DataFrame, consents: DataFrame, pending: DataFrame, indexed: DataFrame, profane: DataFrame) -> DataFrame:
    """question_id, route: the first that holds, from empty to retrieve.

    A document that `consents` (doc_id, sensitive, confirmed) calls sensitive and not confirmed is gated, whether or not it was asked for
    before; one in `pending` (doc_id) waits for an answer about a question that the document didn't answer.
    """
    gated = consents.filter("sensitive and not confirmed").select("doc_id", F.lit(True).alias("_wait")).distinct()
    q = questions.join(gated, "doc_id", "left").join(pending.select("doc_id", F.lit(True).alias("_pend")).distinct(), "doc_id", "left")
    q = q.join(indexed.select("doc_id", F.lit(True).alias("_have")).distinct(), "doc_id", "left").join(profane.select("question_id", F.lit(True).alias("_rude")).distinct(), "question_id", "left")
    s, yes, no = squeeze(F.col("question")), ["y", "yes"], ["n", "no"]
    handled = lambda name: F.when(s.isin(yes), f"{name}-yes").when(s.isin(no), f"{name}-no").otherwise(f"{name}-pending")
    route = F.when(s == "", "empty").when(is_greeting(F.col("question")), "greeting").when(has_link(F.col("question")), "link")
    route = route.when(F.col("_rude"), "profanity").when(F.col("doc_id").isNull(), "no-document")
    route = route.when(F.col("_wait"), handled("consent")).when(F.col("_pend"), handled("fallback"))
    return q.select("question_id", route.when(F.col("_have").isNull(), "not-indexed").otherwise("retrieve").alias("route"))


def fallback_state(events: DataFrame) -> DataFrame:
    """doc_id, pending: the question that waits for y or n after an empty retrieval or an answer from outside the document."""
    last = events.filter(F.col("kind").isin("empty", "outside", "yes", "no")).groupBy("doc_id").agg(F.max_by(F.struct("kind", "question"), F.struct("ts", "seq")).alias("x"))
    return last.select("doc_id", F.when(F.col("x.kind").isin("empty", "outside"), F.col("x.question")).alias("pending")).filter("pending is not null")
