"""Collocations from an FM-index over word ids in each shard.

Texts of one language in a block of documents are a shard. Its words are numbered, its suffixes are sorted (by doubling, as deep as the longest phrase) and
only the Burrows-Wheeler transform is kept: the word before each suffix. All phrases of one length are intervals of the index that tile it. Going back one
word (the stable order of the transform) takes the intervals of phrases P to those of c·P, for all P and c at once; the extensions of a phrase to the
right are the intervals that lie in its own. So each step has a shard's counts of all phrases one word longer.

Counts are summed across shards between the steps, over a tree of requests, and what comes back are the numbers of the phrases that occur often enough in the whole
language: no other phrase can be a part of a longer one that does, so only those are extended, to the left and within frequent
intervals to the right. Words rarer than that stand as a break.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.asking import climb, descend, split_tokens, token_shard
from quire.llm.byte_bpe import ranges
from quire.llm.common import Index, batched, block_count, materialise, pack, pack_sorted, shuffle_partitions, unpack, unpack_sorted, zip_bytes
from quire.llm.replies import descend_longs

SLICE, SHARDS = 8 << 20, 4096
#: Requests that meet in a node of the tree: those of a shard are short, and each level of the tree ships them all once more.
FAN = 512
#: A-Z in lower case; what ends a piece as a line feed, which no word holds; tabs as spaces.
MARKS, BREAK = b".,;:!?\n\x0b\x0c\r", b"\n"
TABLE = bytes(c + 32 if 65 <= c <= 90 else 10 if c in MARKS else 32 if c == 9 else c for c in range(256))
WORDS = "kind string, node long, shard int, keys binary, counts binary, lang string, n long, seq binary"
INDEX = "kind string, node long, shard int, keys binary, counts binary, bwt binary, ids binary, starts binary, sizes binary"
TOP = "kind string, shard int, node long, keys binary, counts binary, vals binary"


def words_of(texts: list[str]) -> list[bytes]:
    """Words of all texts with a BREAK between pieces."""
    raw = b"\n".join(t.encode("utf-8", "replace") for t in texts).translate(TABLE)
    return list(filter(None, raw.replace(b"\n", b" \n ").split(b" ")))


def named(lang: str, word: bytes) -> bytes:
    """A word with its language, as tokens of the tree: without blanks."""
    return lang.replace("%", "%25").replace(" ", "%20").replace("\n", "%0A").encode("utf-8", "replace") + BREAK + word


def unnamed(token: bytes) -> tuple[str, str]:
    lang, word = token.split(BREAK, 1)
    return lang.decode().replace("%0A", "\n").replace("%20", " ").replace("%25", "%"), word.decode()


def numbered(shards: int):
    """Packs the texts of each language of a block: a row with the word numbers in order (0 is a break), and rows that ask shards for
    the block's words. Words are numbered from 1 in the order of the shards and, in one, of their bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batched(batches, SLICE):
            for lang, own in pdf.groupby(pdf["lang"].fillna("und")):
                index = Index()
                index[BREAK]  # is number 0
                found = words_of([t for t in own["text"] if isinstance(t, str)])
                seq = np.fromiter(map(index.__getitem__, found), dtype=np.int32, count=len(found))
                words, node = [named(lang, w) for w in list(index)[1:]], uuid.uuid4().int >> 65
                of = token_shard(words, shards).astype(np.int64)
                order = sorted(range(len(words)), key=lambda i: (of[i], words[i]))
                place = np.zeros(len(words) + 1, dtype=np.int32)
                place[np.array(order, dtype=np.int64) + 1] = np.arange(1, len(words) + 1)
                seq = place[seq]
                counts = np.bincount(seq, minlength=len(words) + 1)[1:]
                rows = [("docs", node, 0, None, None, lang, int((seq > 0).sum()), pack(seq))]
                edges = np.searchsorted(of[order], np.arange(shards + 1))
                for s in np.unique(of):
                    a, b = edges[s], edges[s + 1]
                    rows.append(("token", node, int(s), zip_bytes(b" ".join([words[i] for i in order[a:b]])), pack(counts[a:b].astype("<i8")), None, None, None))
                yield pd.DataFrame(rows, columns=["kind", "node", "shard", "keys", "counts", "lang", "n", "seq"])

    return run


def often(least: int, shards: int):
    """Of a shard: numbers from 1 on for the keys that occur `least` times, unlike those of any other shard; 0 for others."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for kind, shard, keys, counts in zip(pdf["kind"], pdf["shard"], pdf["keys"], pdf["counts"]):
                much = unpack(counts, "<i8") >= least
                vals = np.where(much, 1 + shard + shards * (np.cumsum(much) - 1), 0)
                if len(vals) and vals.max() >= 1 << 32:
                    raise ValueError("more frequent phrases of one length than 32 bits can number")
                yield pd.DataFrame([(kind, int(shard), 0, keys, counts, pack(vals.astype("<i8")))], columns=["kind", "shard", "node", "keys", "counts", "vals"])

    return run


def suffix_order(seq: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes by their first `depth` numbers at least, by doubling the length that is sorted."""
    rank, done = seq.astype(np.int64), 1
    while True:
        key = rank << 32 | np.concatenate([rank[done:], np.zeros(min(done, len(rank)), dtype=np.int64)])[: len(rank)]
        order, done = np.argsort(key, kind="stable"), 2 * done
        if done >= depth:
            return order
        rank = np.empty(len(seq), dtype=np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], (np.diff(key[order]) != 0).astype(np.int64)])) if len(seq) else 0


def intervals(label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First row and length of each run of equal labels that aren't 0."""
    if not len(label):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    first = np.flatnonzero(np.concatenate([[True], label[1:] != label[:-1]]))
    size = np.diff(np.append(first, len(label)))
    held = label[first] != 0
    return first[held], size[held]


def extended(bwt: np.ndarray, ids: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys (word before, phrase), first rows and counts of all phrases one word longer. `label` has the number of the phrase at
    each row, or 0; a longer phrase counts only where it begins with a frequent one too."""
    order = np.argsort(bwt, kind="stable")
    word, rest = ids[bwt[order]], label[order]
    key = np.where((word > 0) & (rest > 0) & (label > 0), word.astype(np.uint64) << np.uint64(32) | rest.astype(np.uint64), np.uint64(0))
    first, size = intervals(key)
    return key[first], first, size


def asked(node: int, keys: np.ndarray, first: np.ndarray, size: np.ndarray, shards: int, bwt: bytes | None, ids: bytes | None) -> pd.DataFrame:
    """The row of a shard's intervals, in the order of the shards of their keys, and the rows that ask for them."""
    shard = ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(shards)
    order = np.lexsort((keys, shard))
    keys, shard = keys[order], shard[order].astype(np.int64)
    rows = [("runs", node, 0, None, None, None, None, pack(first[order].astype("<i4")), pack(size[order].astype("<i4")))]
    if bwt is not None:
        rows.append(("index", node, 0, None, None, bwt, ids, None, None))
    edges = np.searchsorted(shard, np.arange(shards + 1))
    for s in np.unique(shard):
        a, b = edges[s], edges[s + 1]
        rows.append(("gram", node, int(s), pack_sorted(keys[a:b]), pack(size[order][a:b].astype("<i8")), None, None, None, None))
    return pd.DataFrame(rows, columns=["kind", "node", "shard", "keys", "counts", "bwt", "ids", "starts", "sizes"])


def answered(told: pd.DataFrame) -> np.ndarray:
    return np.concatenate([np.empty(0, dtype=np.int64), *[unpack(v, "<i8") for v in told.sort_values("shard")["vals"]]])


def indexed(depth: int, shards: int):
    """Builds the index of each shard from its words' numbers, and asks for its pairs of words."""

    def run(own: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        one = own.iloc[0]
        all_ = np.concatenate([[0], answered(told)])  # number in the language of each word of the shard; rare words are breaks
        ids, seq = np.unique(np.append(all_, 0), return_inverse=True)
        seq = seq[unpack(one["seq"], "<i4")]
        seq = np.append(seq[np.concatenate([[True], (seq[1:] > 0) | (seq[:-1] > 0)])] if len(seq) else seq, 0)  # a break once, and one at the end
        order = suffix_order(seq, depth)
        bwt = seq[order - 1].astype(np.int32)
        keys, first, size = extended(bwt, ids, ids[seq[order]])
        return asked(int(one["node"]), keys, first, size, shards, pack(bwt), pack(ids.astype("<i8")))

    return run


def longer(shards: int):
    """Extends the frequent phrases of each shard by a word."""

    def run(own: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        index, runs = (own[own["kind"] == k].iloc[0] for k in ("index", "runs"))
        bwt, ids = unpack(index["bwt"], "<i4"), unpack(index["ids"], "<i8")
        starts, sizes = unpack(runs["starts"], "<i4").astype(np.int64), unpack(runs["sizes"], "<i4").astype(np.int64)
        label = np.zeros(len(bwt), dtype=np.int64)
        label[ranges(starts, sizes)] = np.repeat(answered(told), sizes)
        keys, first, size = extended(bwt, ids, label)
        return asked(int(index["node"]), keys, first, size, shards, None, None)

    return run


def frequent_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for keys, counts, vals in zip(pdf["keys"], pdf["counts"], pdf["vals"]):
            ids = unpack(vals, "<i8")
            rows = [(i, *unnamed(t), n) for t, i, n in zip(split_tokens(keys), ids.tolist(), unpack(counts, "<i8").tolist()) if i]
            yield pd.DataFrame(rows, columns=["id", "lang", "word", "f"])


def frequent_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for keys, counts, vals in zip(pdf["keys"], pdf["counts"], pdf["vals"]):
            k, n, ids = unpack_sorted(keys), unpack(counts, "<i8"), unpack(vals, "<i8")
            much = ids > 0
            yield pd.DataFrame({"id": ids[much], "first": (k[much] >> np.uint64(32)).astype(np.int64), "rest": (k[much] & np.uint64(0xFFFFFFFF)).astype(np.int64), "f": n[much]})


def frequent_phrases(texts: DataFrame, most: int, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of texts (lang, text): frequent words (id, lang, word, f), frequent phrases of 1 to `most` words (ids, f), and words by language (lang, n)."""
    shards = min(block_count(texts, SLICE), SHARDS)
    blocks = materialise(texts.select(F.col("lang").cast("string").alias("lang"), "text").mapInPandas(numbered(shards), WORDS), "words", "kind")
    own, asks = blocks.filter("kind = 'docs'"), blocks.filter("kind = 'token'").select("kind", "shard", "node", "keys", "counts")
    n_blocks = own.count()
    distinct, levels = climb(asks, n_blocks, FAN)
    top = materialise(distinct.mapInPandas(often(least, shards), TOP), "often")
    told = descend(top.drop("counts"), levels).select("node", "shard", "vals")
    words = materialise(top.mapInPandas(frequent_words, "id long, lang string, word string, f long"), "dictionary")
    phrases = words.select(F.array("id").alias("ids"), "f")
    out, known = [phrases], words.select(F.col("id").alias("rest"), F.array("id").alias("tail"))
    index = None
    for n in range(2, most + 1):
        if index is None:
            step = materialise(own.select("node", "seq").groupBy("node").cogroup(told.groupBy("node")).applyInPandas(indexed(most, shards), INDEX), "index", "kind")
            index = step.filter("kind = 'index'")
        else:
            before = step.filter("kind = 'runs'").union(index).select("kind", "node", "bwt", "ids", "starts", "sizes")
            step = materialise(before.groupBy("node").cogroup(told.groupBy("node")).applyInPandas(longer(shards), INDEX), "longer", "kind")
        distinct, levels = climb(step.filter("kind = 'gram'").select("kind", "shard", "node", "keys", "counts"), n_blocks, FAN)
        top = materialise(distinct.mapInPandas(often(least, shards), TOP), "often")
        if n < most:
            told = descend_longs(top.drop("counts"), levels).select("node", "shard", "vals")
        grams = top.mapInPandas(frequent_grams, "id long, first long, rest long, f long")
        grams = materialise(grams.join(known, "rest").select("id", F.concat(F.array("first"), F.col("tail")).alias("ids"), "f"), "phrases")
        known = grams.select(F.col("id").alias("rest"), F.col("ids").alias("tail"))
        out.append(grams.select("ids", "f"))
    return words, reduce(DataFrame.union, out), own.groupBy("lang").agg(F.sum("n").alias("n"))


def wide(c: str) -> Column:
    return F.col(c).cast("decimal(20,0)")


def collocations(docs: DataFrame, most: int = 4, least: int = 30, top: int = 2000, scale: int = 2_000_000, cover: tuple[int, int] = (100, 80)) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the `top` phrases of 2 to `most` words of each language that occur `least` times.

    A phrase scores by its weakest cut: scale * a / (l + r), rounded down, with the counts of the phrase (a) and of what lies before and after the cut. A
    phrase within a longer one (of up to `most` words) that has cover[1] of its cover[0] occurrences is left out. n has all words of the language. Null
    texts are empty, a null lang is `und`; repeated rows count as often as they occur; an empty table gives no row; other columns are
    ignored, whatever their names.
    """
    if not 2 <= most <= 8:
        raise ValueError("phrases have 2 to 8 words")
    words, phrases, totals = frequent_phrases(docs.select("lang", "text"), most, least)
    phrases = materialise(phrases, "all-phrases")
    candidates = phrases.filter(F.size("ids") > 1).select("ids", F.col("f").alias("a"))
    part = F.expr("transform(sequence(1, size(ids) - 1), k -> struct(k, slice(ids, 1, k) AS head, slice(ids, k + 1, size(ids) - k) AS tail))")
    cuts = candidates.select("ids", "a", F.explode(part).alias("c")).select("ids", "a", "c.*")
    heads, tails = (phrases.select(F.col("ids").alias(c), F.col("f").alias(f)) for c, f in (("head", "l"), ("tail", "r")))
    both = cuts.join(heads, "head").join(tails, "tail")
    cut_score = F.expr(f"CAST(CAST({scale} AS DECIMAL(18,0)) * CAST(a AS DECIMAL(19,0)) AS DECIMAL(38,0)) div (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))")
    scored = both.withColumn("score", cut_score).groupBy("ids", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("x"))
    inner = F.expr("flatten(transform(sequence(2, size(ids) - 1), n -> transform(sequence(1, size(ids) - n + 1), i -> slice(ids, i, n))))")
    covered = candidates.filter(F.size("ids") > 2).select("a", F.explode(inner).alias("ids")).groupBy("ids").agg(F.max("a").alias("in_longer"))
    kept = scored.join(covered, "ids", "left").filter(F.col("in_longer").isNull() | (cover[0] * wide("in_longer") < cover[1] * wide("a")))
    spelled = kept.select("ids", "a", "x.*", F.posexplode("ids").alias("at", "id")).join(words.select("id", "lang", "word"), "id")
    each = spelled.groupBy("ids", "a", "l", "r", "score").agg(F.first("lang").alias("lang"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda w: w["word"]), " ").alias("phrase"))
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    salted = each.withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(shuffle_partitions(docs.sparkSession))))
    few = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    best = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
