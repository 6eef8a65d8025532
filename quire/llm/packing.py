"""Best-fit packing of documents into sequences, in bulk-synchronous supersteps.

A superstep range-sorts documents and gaps (what sequences have left) together, largest first, and sweeps over them: a document takes the
smallest gap that is large enough and free, which is the last one seen, as a closing bracket takes the last open one. Each range is swept on its
own; documents that its gaps don't serve take the free gaps of the ranges before it, the nearest first, by their ranks: the driver carries two
numbers a range. Gaps are brought up to date, and so on until nothing fits; then the largest documents open sequences.

Supersteps go by bands of sizes, largest first, since what is left after a large document is best filled with smaller ones. A gap that holds
several documents of a band whatever their sizes offers that many places at once.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import materialise, slices
from quire.llm.units import shared_encoder

LENGTH, SLICE = 2048, 4 << 20
#: Documents and gaps of a range (a range is held by one task), and places that its gaps offer beyond one each (others wait for the next superstep).
RANGE_ROWS, MORE_PLACES = 500_000, 4_000_000
PIECE = "pid long, doc_id string, piece int, start long, length int, ids_crc32 long"
SWEPT = "kind string, pid long, size int, bin long, room int, part int, rank long"


def cut(n: int, length: int) -> list[int]:
    """Lengths of the pieces of `n` tokens: whole ones, and before them what is left over."""
    return [n % length] * (n % length > 0) + [length] * (n // length)


def pieces(tokenizer: str, end_id: int, length: int, with_ids: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, next_ = shared_encoder(tokenizer), TaskContext.get().partitionId() << 33
        for pdf in batches:
            texts = [t if isinstance(t, str) else "" for t in pdf["text"]]
            for i, j in slices([len(t) for t in texts], SLICE):
                flat, sizes = encode(texts[i:j])
                ids = np.insert(flat, np.cumsum(sizes), end_id).astype("<u4")
                view, at, rows = memoryview(ids).cast("B"), 0, []
                for doc, n in zip(pdf["doc_id"].iloc[i:j], (sizes + 1).tolist()):
                    start = 0
                    for k, m in enumerate(cut(n, length)):
                        rows.append((next_, doc, k, start, m, zlib.crc32(view[4 * at : 4 * (at + m)]), *([ids[at : at + m].astype(np.int32)] * with_ids)))
                        start, at, next_ = start + m, at + m, next_ + 1
                yield pd.DataFrame(rows, columns=["pid", "doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)

    return run


def bands(length: int) -> list[tuple[int, int]]:
    """Size bands (over, up to), largest first: by how many fit a sequence at least while that is few, then halving."""
    ends = [length - 1] + [length // k for k in (2, 3, 4, 6)]
    while ends[-1] > 8:
        ends.append(ends[-1] // 3)
    ends = sorted({e for e in ends if e > 0}, reverse=True)
    return list(zip([*ends[1:], 0], ends))


def matched(is_gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For places (true) and documents (false) in order: places and documents that meet, each document the last place still free."""
    depth = np.cumsum(np.where(is_gap, 1, -1))
    level = depth + ~is_gap
    order = np.argsort(level, kind="stable")
    here, there = order[:-1], order[1:]
    meet = is_gap[here] & ~is_gap[there] & (level[here] == level[there])
    return here[meet], there[meet]


def places(is_gap: np.ndarray, v: np.ndarray, most: int, n_docs: int) -> np.ndarray:
    """How often each row counts: a gap as often as it holds documents up to `most` for sure (no more than are needed), a document once."""
    sure = np.where(is_gap, v // most, 1)
    wide = max(1, int((sure[is_gap] > 0).sum()))
    return np.clip(sure, 1, math.ceil(min(2 * n_docs, MORE_PLACES) / wide) + 1)


def swept(most: int, n_docs: int):
    """One range: pairs found in it, then the documents and the free places that are left, numbered in order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = list(batches)
        if not frames:
            return
        pdf, part = pd.concat(frames), TaskContext.get().partitionId()
        gap_rows = pdf["kind"].to_numpy() == 0
        row = np.repeat(np.arange(len(pdf)), places(gap_rows, pdf["v"].to_numpy(), most, n_docs))
        ids, sizes, is_gap = pdf["id"].to_numpy()[row], pdf["v"].to_numpy()[row], gap_rows[row]
        gap, doc = matched(is_gap)
        free = np.ones(len(row), dtype=bool)
        free[gap] = free[doc] = False
        docs, gaps = np.flatnonzero(free & ~is_gap), np.flatnonzero(free & is_gap)
        for kind, d, g in (("pair", doc, gap), ("doc", docs, None), ("gap", None, gaps)):
            n = len(g if d is None else d)
            take = lambda values, at: [None] * n if at is None else values[at]  # noqa: B023, E731
            own = {"pid": take(ids, d), "size": take(sizes, d), "bin": take(ids, g), "room": take(sizes, g)}
            yield pd.DataFrame({"kind": kind, **own, "part": part, "rank": np.arange(n)}).astype({c: "Int64" for c in own})

    return run


def carried(counts: dict[int, tuple[int, int]]) -> tuple[list[tuple[int, int, int, int, int]], dict[int, int]]:
    """Which free places of earlier ranges the documents left in each range (part: documents, places) take, the last first, as runs
    (part, first rank, last rank, part of the places, shift of the rank), and how many documents of each range that serves."""
    runs, served, free = [], {}, []
    for part in sorted(counts):
        docs, places = counts[part]
        done = 0
        while done < docs and free:
            of, n = free.pop()
            take = min(n, docs - done)
            runs.append((part, done, done + take - 1, of, n - 1 + done))  # rank r gets place n - 1 - (r - done)
            done += take
            if n > take:
                free.append((of, n - take))
        served[part] = done
        if places:
            free.append((part, places))
    return runs, served


def driver_rows(spark: SparkSession, rows: list[tuple], **columns: pa.DataType) -> DataFrame:
    """A few rows of the driver (some for each range) as a broadcast table."""
    values = list(zip(*rows)) or [()] * len(columns)
    return F.broadcast(spark.createDataFrame(pa.table({n: pa.array(v, t) for v, (n, t) in zip(values, columns.items())})))


def sweep(docs: DataFrame, gaps: DataFrame, most: int, n_docs: int, n_gaps: int):
    """One superstep for `docs` (pid, size up to `most`) and `gaps` (bin, room): pairs and free places (pid or null, size, bin, room) as
    a table, the documents left (pid, size, part, rank), how many of each range come before them, and counts by range."""
    spark = docs.sparkSession
    rows = docs.select(F.col("size").alias("v"), F.lit(1).alias("kind"), F.col("pid").alias("id")).union(gaps.select("room", F.lit(0), "bin"))
    order = [F.desc("v"), F.col("kind"), F.col("id")]
    ranges = max(1, math.ceil((n_docs + n_gaps) / RANGE_ROWS))
    told = materialise(rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order).mapInPandas(swept(most, n_docs), SWEPT), "swept", "kind")
    counts: dict[int, list[int]] = {}
    for r in told.filter("kind <> 'pair'").groupBy("part", "kind").count().collect():  # two rows a range
        counts.setdefault(r["part"], [0, 0])[r["kind"] == "gap"] = r["count"]
    runs, served = carried({k: tuple(v) for k, v in counts.items()})
    table = driver_rows(spark, runs, part=pa.int32(), first=pa.int64(), last=pa.int64(), of=pa.int32(), shift=pa.int64())
    left = told.filter("kind = 'doc'").select("pid", "size", "part", "rank")
    on = (left["part"] == table["part"]) & left["rank"].between(table["first"], table["last"])
    sent = left.join(table, on).select("pid", "size", F.col("of").alias("part"), (F.col("shift") - F.col("rank")).alias("rank"))
    places_left = told.filter("kind = 'gap'").select("bin", "room", "part", "rank").join(sent, ["part", "rank"], "left")
    done = materialise(told.filter("kind = 'pair'").select("pid", "size", "bin", "room").union(places_left.select("pid", "size", "bin", "room")), "pairs")
    return done, left, served, {k: v[0] - served[k] for k, v in sorted(counts.items()) if v[0] > served[k]}


def ranked_after(left: DataFrame, bound: dict[int, int], upto: dict[int, int] | None = None) -> DataFrame:
    """Rows of each range from a rank on, and below another if given; ranges that aren't named have none."""
    rows = [(p, n, (upto or {}).get(p, 1 << 62)) for p, n in bound.items()]
    table = driver_rows(left.sparkSession, rows, part=pa.int32(), first=pa.int64(), end=pa.int64())
    return left.join(table, "part").filter("rank >= first and rank < end")


def packed(sizes: DataFrame, length: int = LENGTH) -> DataFrame:
    """pid, bin, turn for each (pid, size) with size under `length`: the sequence it lies in, named by the pid that opened it, and the superstep."""
    spark, log, turn = sizes.sparkSession, [], 0
    gaps, n_gaps = spark.createDataFrame([], "bin long, room int"), 0
    present = {r["size"]: r["count"] for r in sizes.groupBy("size").count().collect()}  # fewer than `length` rows
    note = lambda df, bin_: log.append(df.select("pid", "size", F.col(bin_).alias("bin"), F.lit(turn).alias("turn")))
    for low, most in bands(length):
        left_n = sum(n for s, n in present.items() if low < s <= most)
        docs, opened = sizes.filter(F.col("size").between(low + 1, most)), 0
        fit = length // most
        while left_n:
            turn += 1
            if fit == 1:  # no two of this band share a sequence, and no gap is that large: they come first
                note(docs, "pid")
                gaps, n_gaps, left_n = docs.select(F.col("pid").alias("bin"), (length - F.col("size")).alias("room")).filter("room > 0"), left_n, 0
                continue
            done, left, served, by_part = sweep(docs, gaps, most, left_n, n_gaps)
            note(done.filter("pid is not null"), "bin")
            gaps = done.groupBy("bin").agg((F.max("room") - F.coalesce(F.sum("size"), F.lit(0))).cast("int").alias("room")).filter("room > 0")
            before, left_n = left_n, sum(by_part.values())
            docs = ranked_after(left, {p: served[p] for p in by_part}).select("pid", "size")
            if left_n and (fit <= 4 or (before - left_n) * 10 < before):  # few fit a gap that has taken one of this band
                turn += 1
                weight = docs.agg(F.sum("size")).first()[0]
                some = math.ceil(left_n / fit) if fit <= 4 else math.ceil(weight / (length if not opened else length - most))
                opened, first, rest, end = opened + 1, {}, {}, min(some, left_n)
                for p, n in by_part.items():
                    take = min(n, end)
                    first[p], rest[p], end = served[p] + take, served[p] + take, end - take
                openers = ranked_after(left, {p: served[p] for p in by_part}, first).select("pid", "size")
                note(openers, "pid")
                gaps = gaps.union(openers.select("pid", (length - F.col("size")).alias("room")))
                docs, n_gaps, left_n = ranked_after(left, rest).select("pid", "size"), n_gaps + min(some, left_n), left_n - min(some, left_n)
    return reduce(DataFrame.union, log) if log else spark.createDataFrame([], "pid long, size int, bin long, turn int")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every row of `docs`; the ids too if asked for.

    Each text gets `end_id` after its ids and is cut only if it is longer than `length`, then into whole pieces but for the first. Null and
    empty texts are one end id. Repeated rows and null ids give their own pieces; an empty table gives none; other columns are
    ignored, whatever their names.
    """
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    cut_up = materialise(rows.mapInPandas(pieces(tokenizer, end_id, length, with_ids), PIECE + ", ids array<int>" * with_ids), "pieces")
    small = packed(cut_up.filter(F.col("length") < length).select("pid", F.col("length").alias("size")), length)
    before = Window.partitionBy("bin").orderBy("turn", F.desc("size"), "pid").rowsBetween(Window.unboundedPreceding, -1)
    placed = small.withColumn("offset", F.coalesce(F.sum("size").over(before), F.lit(0))).select("pid", F.col("bin").alias("sequence_id"), "offset")
    whole = cut_up.filter(F.col("length") == length).withColumn("sequence_id", F.col("pid")).withColumn("offset", F.lit(0).cast("long"))
    out = cut_up.filter(F.col("length") < length).join(placed, "pid").unionByName(whole)
    named = out.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType)).withColumn("length", F.col("length").cast("long"))
    return named.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * with_ids)


def sequences(placed: DataFrame) -> DataFrame:
    """sequence_id, ids, ends (offset at which each piece of it ends) from packed pieces with ids; a sequence is at most `length` ids."""
    each = placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "length", "ids"))).alias("x"))
    return each.select("sequence_id", F.flatten("x.ids").alias("ids"), F.transform("x", lambda p: p["offset"] + p["length"]).alias("ends"))
