"""Language identification by multinomial naive Bayes over hashed character n-grams (1 to 3 code points).

Counts are added up by Spark; the log-probability matrix (languages times 2^bits buckets of doubles) is broadcast; a batch of texts is
scored in numpy as sparse rows of bucket numbers. Languages whose matrix would pass a size are dealt to shards of it, which
score one after the other: each keeps the best language so far and the sum of likelihoods, so the number of languages changes no prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import free_name, materialise, pack, remainder, slices, unpack

#: Characters whose n-grams are held at once; one takes about 150 bytes, and a worker keeps what it once took.
SLICE = 1 << 18
ORDERS = (1, 2, 3)
#: Bytes of a broadcast matrix at most; more languages make more shards.
MOST_BYTES = 64 << 20
BEST = "lang string, top double, total double, fit double"


def buckets(texts: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of the n-grams of each lower-cased text between two spaces, text after text, and how many each has."""
    points = [np.frombuffer(f" {t.lower()} ".encode("utf-32-le", "replace"), dtype=np.uint32) for t in texts]
    sizes = np.array([len(p) for p in points], dtype=np.int64)
    data = np.concatenate([*points, np.zeros(2, dtype=np.uint32)]).astype(np.uint32)
    ends = np.cumsum(sizes)
    out, keep = [], []
    last = np.zeros(len(data) - 2, dtype=np.int64)
    last[:] = np.repeat(ends, sizes)
    place = np.arange(len(data) - 2)
    code = np.zeros(len(data) - 2, dtype=np.uint32)
    for n in range(max(ORDERS)):
        code = (code + data[n : len(data) - 2 + n] + np.uint32(1)) * np.uint32(0x9E3779B1)
        code ^= code >> np.uint32(15)
        if n + 1 in ORDERS:
            out.append(code >> np.uint32(32 - bits))
            keep.append(place + n < last)
    order = np.concatenate([np.repeat(np.arange(len(texts)), sizes)] * len(out))
    return order, np.concatenate(out), np.concatenate(keep)


def language_counts(bits: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for pdf in batches:
            for lang, group in pdf.groupby("lang", sort=False):
                texts = list(group["text"])
                mine = total.setdefault(lang, np.zeros(1 << bits, dtype=np.int64))
                for a, b in slices([len(t) for t in texts], SLICE):
                    _, code, keep = buckets(texts[a:b], bits)
                    mine += np.bincount(code[keep], minlength=1 << bits)
        for lang, n in total.items():
            at = np.flatnonzero(n)
            yield pd.DataFrame({"lang": lang, "bucket": at, "n": n[at]})

    return run


class LanguageModel:
    """Languages, their log probabilities by bucket, and what an n-gram of a text in the language has on average."""

    def __init__(self, langs: list[str], logs: np.ndarray, bits: int):
        self.langs, self.logs, self.bits = langs, logs, bits
        self.level = (np.exp(logs) * logs).sum(axis=1)


def packed_counts(bits: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros(1 << bits, dtype="<i8")
        counts[pdf["bucket"].to_numpy(dtype=np.int64)] = pdf["n"].to_numpy(dtype=np.int64)
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "counts": [pack(counts)]})

    return run


@dataclass
class Learnt:
    """Counts (lang, bucket, n) of all languages, and the languages of each shard, in order of their names."""

    counts: DataFrame
    shards: list[list[str]]
    bits: int
    smoothing: float

    def model(self, k: int) -> LanguageModel:
        """The matrix of a shard; the driver gets a packed row of 2^bits counts for each of its languages."""
        mine = self.counts if len(self.shards) == 1 else self.counts.filter(F.col("lang").isin(self.shards[k]))
        rows = sorted(mine.groupBy("lang").applyInPandas(packed_counts(self.bits), "lang string, counts binary").collect())
        logs = np.array([unpack(r["counts"], "<i8") + self.smoothing for r in rows]).reshape(len(rows), 1 << self.bits)
        if len(rows):
            logs = np.log(logs / logs.sum(axis=1, keepdims=True))
        return LanguageModel([r["lang"] for r in rows], logs, self.bits)


def learn_languages(docs: DataFrame, bits: int = 16, smoothing: float = 0.5, most_bytes: int = MOST_BYTES) -> Learnt:
    """Learns from every row with text and lang. Classes are equally likely beforehand.

    The driver gets the names of the languages; shards have as many as fit `most_bytes`, one at least.
    """
    known = docs.filter("text is not null and lang is not null").select("text", "lang")
    names = sorted(r["lang"] for r in known.select("lang").distinct().collect())
    each = max(1, most_bytes // (8 << bits))
    shards = [names[k : k + each] for k in range(0, max(1, len(names)), each)]
    found = known.mapInPandas(language_counts(bits), "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    return Learnt(materialise(found, "language-counts") if len(shards) > 1 else found, shards, bits, float(smoothing))


def score_batch(model: LanguageModel, texts: list[str]) -> np.ndarray:
    """Log likelihood of each text under each language."""
    out = np.zeros((len(texts), len(model.langs)))
    for a, b in slices([len(t) for t in texts], SLICE):
        row, code, keep = buckets(texts[a:b], model.bits)
        row, code = row[keep], code[keep]
        for k, table in enumerate(model.logs):
            out[a:b, k] = np.bincount(row, weights=table[code], minlength=b - a)
    return out


def gram_counts(texts: list[str]) -> np.ndarray:
    """Number of n-grams of each text between two spaces."""
    n = np.array([len(t.lower()) + 2 for t in texts], dtype=np.int64)
    return sum(n - k + 1 for k in ORDERS)


def scorer(shared):
    """Of a shard's languages the best for each text, its log likelihood, the sum of all likelihoods against it, and its fit."""

    def run(series: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for texts, usable in series:
            ok = usable.to_numpy(dtype=bool) & bool(model.langs)
            lang, fit = np.full(len(texts), "und", dtype=object), np.full(len(texts), np.nan)
            top, total = np.zeros(len(texts)), np.zeros(len(texts))
            if ok.any():
                mine = list(texts[ok])
                logs = score_batch(model, mine)
                best = logs.argmax(axis=1)  # the first of equals: languages are in order
                top[ok] = logs.max(axis=1)
                total[ok] = np.exp(logs - top[ok][:, None]).sum(axis=1)
                lang[ok] = np.array(model.langs, dtype=object)[best]
                fit[ok] = top[ok] / gram_counts(mine) - model.level[best]
            yield pd.DataFrame({"lang": lang, "top": top, "total": total, "fit": fit})

    return run


def better(a: Column, b: Column) -> Column:
    """The best of two shards' answers, with the likelihoods of both; of equals the first."""

    def won(x: Column, y: Column) -> Column:
        return F.struct(x["lang"].alias("lang"), x["top"].alias("top"), (x["total"] + y["total"] * F.exp(y["top"] - x["top"])).alias("total"), x["fit"].alias("fit"))

    return F.when(b["top"] > a["top"], won(b, a)).otherwise(won(a, b))


def with_language(docs: DataFrame, learnt: Learnt, text: Column, name: str) -> DataFrame:
    """`docs` with a struct `name` of lang_pred, score (the winner's posterior probability) and fit; `und`, 0 and no fit for a text that is
    null or has no letter, and where nothing was learnt. Of equal languages the first by name wins.

    Fit is the mean log probability of the text's n-grams less what they have on average in the winner's own texts: about 0 there, and far below
    in a language that was not learnt, whose posterior says nothing, as one of the learnt ones always wins by much.

    With more than one shard the rows are written after each, so that driver and tasks hold one matrix at a time.
    """
    spark, many = docs.sparkSession, len(learnt.shards) > 1
    usable = F.coalesce(text.rlike("\\p{L}"), F.lit(False))
    held, mine = free_name(docs, f"{name}_held"), free_name(docs, f"{name}_mine")
    rows = docs
    for k in range(len(learnt.shards)):
        shared = spark.sparkContext.broadcast(learnt.model(k))
        told = F.pandas_udf(scorer(shared), BEST).asNondeterministic()(text, usable)
        if k:
            rows = rows.withColumn(mine, told).withColumn(held, better(F.col(held), F.col(mine))).drop(mine)
        else:
            rows = rows.withColumn(held, told)
        if many:
            rows = materialise(rows, "languages")
            shared.destroy()
    got = F.col(held)
    score = F.when(got["total"] > 0, 1 / got["total"]).otherwise(F.lit(0.0))
    return rows.withColumn(name, F.struct(got["lang"].alias("lang_pred"), score.alias("score"), got["fit"].alias("fit"))).drop(held)


def language_predictions(docs: DataFrame, modulus: int = 5, held: int = 0, bits: int = 16, most_bytes: int = MOST_BYTES) -> DataFrame:
    """doc_id, held_out, lang_pred, score, fit; learns from rows whose crc32(doc_id) mod `modulus` isn't `held`.

    A null doc_id has no remainder: learnt from, not held out. Repeated rows count as often as they occur; an empty
    table gives no rows; other columns are ignored, whatever their names.
    """
    left = remainder(F.col("doc_id"), modulus)
    learnt = learn_languages(docs.filter(F.coalesce(left != held, F.lit(True))), bits, most_bytes=most_bytes)
    rows = docs.select("doc_id", "text", F.coalesce(left == held, F.lit(False)).alias("held_out"))
    return with_language(rows, learnt, F.col("text"), "told").select("doc_id", "held_out", "told.lang_pred", "told.score", "told.fit")
