"""Search in stored indexes: terms with block bounds for ranked search, character trigrams for substrings.

Chunks are numbered in the order of user, document and chunk, so a number also says which of two equal hits comes first. Postings are rows of one term (or
trigram) of one user in one block: a run of at most BLOCK chunks that lie together, named by the number of its first chunk. They hold places in the block
(and counts). Every block is posted by the task that reads its chunks, so no occurrence is shuffled. A hot user's or a common term's postings are many rows,
none of them large.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions.joins import few
from quire.functions.strings import strip
from quire.sources.scratch import shared_folder

#: Most chunks of a block and about how many characters of text are posted at once; blocks looked at first for a query, trigrams that narrow a query (its rarest).
BLOCK, BLOCK_CHARS, FIRST_BLOCKS, RAREST = 4096, 8_000_000, 2, 3
#: Candidates of a query that are looked for and held against the texts first: most queries find their hits among them.
FIRST_LOOK, FIRST_HELD = 1000, 200
#: Follows each text, so that every run of one or two characters begins a trigram.
PAD = "\x00\x00"


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), lambda t: t != "")


def trigrams(text: Column) -> Column:
    """Distinct runs of three characters."""
    runs = lambda c: F.transform(F.sequence(F.lit(0), F.size(c) - 3), lambda i: F.concat(c[i], c[i + 1], c[i + 2]))
    return F.transform(F.array(F.split(text, "")), lambda c: F.when(F.size(c) >= 3, F.array_distinct(runs(c))).otherwise(F.array().cast("array<string>")))[0]


def word_numbers(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Row and word number of every word of texts that are words with blanks between, and the words in order."""
    each = [t.split(" ") if t else [] for t in texts]
    ids, found = pd.factorize(np.array([w for ws in each for w in ws], dtype=object))
    order = np.argsort(found)
    return np.repeat(np.arange(len(texts)), [len(ws) for ws in each]), np.argsort(order)[ids], list(found[order])


def trigram_numbers(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Row and trigram number of every run of three characters, and the trigrams in order."""
    each = [np.frombuffer(t.encode("utf-32-le"), dtype="<u4") for t in texts]
    row, c = np.repeat(np.arange(len(texts)), [len(x) for x in each]), np.concatenate(each).astype(np.int64)
    inside = row[:-2] == row[2:]
    ids, found = pd.factorize((c[:-2] << 42 | c[1:-1] << 21 | c[2:])[inside])
    order = np.argsort(found)
    sorted_ = found[order]
    chars = np.stack([sorted_ >> 42, sorted_ >> 21 & 0x1FFFFF, sorted_ & 0x1FFFFF], axis=1).astype("<u4").tobytes().decode("utf-32-le")
    return row[:-2][inside], np.argsort(order)[ids], [chars[i : i + 3] for i in range(0, len(chars), 3)]


def poster(numbers):
    """Postings of rows (user_id, num, text) in order of num; `numbers` gives the terms of texts."""

    def posted(users: list, nums: list[int], texts: list[str], kind: pa.DataType) -> pa.RecordBatch | None:
        rows, ids, terms = numbers(texts)
        if not len(ids):
            return None
        at = np.array(nums, dtype=np.int64)
        # a block is one user's chunks, and their numbers follow each other
        new = np.array([i > 0 and (users[i] != users[i - 1] or nums[i] != nums[i - 1] + 1) for i in range(len(users))])
        group = np.cumsum(new)
        first = np.flatnonzero(np.concatenate([[True], new[1:]]))
        key, tf = np.unique((group[rows] * len(terms) + ids) * len(texts) + rows, return_counts=True)
        of, row = key // len(texts), key % len(texts)
        start = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        ends, block = np.append(start, len(key)).astype(np.int32), first[of[start] // len(terms)]
        lists = lambda v: pa.ListArray.from_arrays(pa.array(ends), pa.array(v.astype(np.int32)))
        return pa.RecordBatch.from_arrays(
            [pa.array([users[i] for i in block], kind), pa.array([terms[i] for i in of[start] % len(terms)]), pa.array(at[block]), pa.array(np.diff(ends)), pa.array(np.maximum.reduceat(tf, start).astype(np.int32)), lists(at[row] - at[first[group[row]]]), lists(tf)],
            ["user_id", "term", "block", "n", "most", "at", "tfs"],
        )

    def run(batches):
        held, size, kind = ([], [], []), 0, None
        for batch in batches:
            kind = batch.column(0).type
            for row in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if held[0] and (len(held[0]) >= BLOCK or size + len(row[2]) > BLOCK_CHARS):
                    out = posted(*held, kind)
                    if out is not None:
                        yield out
                    held, size = ([], [], []), 0
                for column, value in zip(held, row):
                    column.append(value)
                size += len(row[2])
        if held[0]:
            out = posted(*held, kind)
            if out is not None:
                yield out

    return run


class SearchIndex:
    """The index in a folder: chunks (num, user_id, doc_id, chunk, text), terms and grams (postings), totals by user, and gram_totals by user and trigram."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def build(self, chunks: DataFrame, terms: bool = True, grams: bool = True) -> SearchIndex:
        """Writes the index of chunks (user_id, doc_id, chunk, text), with terms for ranked search and grams for substrings as wanted. Null texts are
        empty; other columns aren't kept."""
        order, parts = ["user_id", "doc_id", "chunk"], int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        text = F.coalesce("text", F.lit("")).alias("text")
        chunks.select(*order, text).repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("num", F.monotonically_increasing_id()).write.parquet(f"{self.folder}/chunks")
        rows = self.table("chunks").filter("user_id is not null")
        if terms:
            rows.groupBy("user_id").agg(F.count("*").alias("total")).write.parquet(f"{self.folder}/totals")
            self._postings(rows, F.array_join(words(F.col("text")), " "), word_numbers, ["user_id", "term", "block", "n", "most", "at", "tfs"], "terms")
        if grams:
            self._postings(rows, F.concat(F.lower("text"), F.lit(PAD)), trigram_numbers, ["user_id", "term", "block", "n", "at"], "grams")
            self.table("grams").groupBy("user_id", "term").agg(F.sum("n").alias("df")).write.parquet(f"{self.folder}/gram_totals")
        return self

    def _postings(self, rows: DataFrame, text: Column, numbers, columns: list[str], name: str) -> None:
        schema = f"user_id {rows.schema['user_id'].dataType.simpleString()}, term string, block long, n int, most int, at array<int>, tfs array<int>"
        rows.select("user_id", "num", text.alias("text")).mapInArrow(poster(numbers), schema).select(columns).write.parquet(f"{self.folder}/{name}")

    def postings(self, name: str, asked: DataFrame) -> DataFrame:
        """Postings of the terms asked for (query_id, user_id, term): a user's blocks lie together, and only those of the users asked for are read."""
        users = asked.agg(F.min("user_id").alias("a"), F.max("user_id").alias("b")).first()
        return self.table(name).filter(F.col("user_id").between(users["a"], users["b"])).join(few(asked), ["user_id", "term"])


def ranked(hits: DataFrame, order: list, limit: int) -> DataFrame:
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).filter(F.col("rank") <= min(50, limit))


def weighted_postings(index: SearchIndex, queries: DataFrame) -> DataFrame:
    """query_id, block, term, at, tfs, weight, bound of the postings of each query; a term weighs ln(1 + chunks of the user / chunks with it)."""
    asked = queries.select("query_id", "user_id", F.explode(F.array_distinct(words(F.col("q")))).alias("term"))
    df = index.postings("terms", asked).groupBy("query_id", "user_id", "term").agg(F.sum("n").alias("df"))
    weights = df.join(index.table("totals"), "user_id").select("query_id", "user_id", "term", F.log(1 + F.col("total") / F.col("df")).alias("weight"))
    path = shared_folder(index.spark, "weights")
    weights.write.parquet(path)
    return index.postings("terms", index.spark.read.schema(weights.schema).parquet(path)).withColumn("bound", F.col("most") * F.col("weight"))


def scores(postings: DataFrame, limit: int) -> DataFrame:
    """query_id, num, score: in each block of a query the best `limit` chunks at least, and those that rounding could make equal to them."""
    best = max(1, min(50, limit))

    def run(batches):
        def added(key, rows):
            size = max(int(at[-1]) for at, _, _ in rows) + 1
            total, hit = np.zeros(size), np.zeros(size, dtype=bool)
            for at, tfs, weight in rows:
                total[at] += tfs * weight
                hit[at] = True
            if hit.sum() > best:
                hit &= total >= np.partition(total[hit], -best)[-best] - 2e-6
            at = np.flatnonzero(hit)
            return pd.DataFrame({"query_id": key[0], "num": key[1] + at, "score": total[at]})

        last, rows = None, []
        for pdf in batches:
            out = []
            for query, block, at, tfs, weight in zip(pdf["query_id"], pdf["block"], pdf["at"], pdf["tfs"], pdf["weight"]):
                if (query, block) != last:
                    if rows:
                        out.append(added(last, rows))
                    last, rows = (query, block), []
                rows.append((at, tfs, weight))
            if out:
                yield pd.concat(out)
        if rows:
            yield added(last, rows)

    kind = postings.schema["query_id"].dataType.simpleString()
    each = postings.select("query_id", "block", "at", "tfs", "weight").repartition("query_id", "block").sortWithinPartitions("query_id", "block")
    return each.mapInPandas(run, f"query_id {kind}, num long, score double").withColumn("score", F.round("score", 6))


def reachable_blocks(postings: DataFrame, limit: int) -> DataFrame:
    """query_id, block of the blocks that can still hold one of the best `limit` hits: those whose bound (the highest counts of all terms) reaches the
    last score among the best of the few blocks with the highest bounds."""
    bounds = postings.groupBy("query_id", "block").agg(F.sum("bound").alias("bound"))
    top = bounds.withColumn("k", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "block"))).filter(F.col("k") <= FIRST_BLOCKS)
    sure = ranked(scores(postings.join(top.select("query_id", "block"), ["query_id", "block"], "left_semi"), limit), [F.desc("score")], limit)
    floor = sure.filter(F.col("rank") == min(50, limit)).select("query_id", F.col("score").alias("floor"))
    return bounds.join(floor, "query_id", "left").filter(F.col("floor").isNull() | (F.col("bound") >= F.col("floor") - 1e-6)).select("query_id", "block")


def keyword_search(queries: DataFrame, index: SearchIndex, limit: int = 20) -> DataFrame:
    """query_id, doc_id, chunk, score, rank: a user's chunks with any term of a query (query_id, user_id, q); score = sum of tf * weight."""
    postings = weighted_postings(index, queries)
    best = ranked(scores(postings.join(reachable_blocks(postings, limit), ["query_id", "block"], "left_semi"), limit), [F.desc("score"), F.col("num")], limit)
    return index.table("chunks").select("num", "doc_id", "chunk").join(few(best), "num").select("query_id", "doc_id", "chunk", "score", "rank")


def asked_needles(queries: DataFrame) -> DataFrame:
    """query_id, user_id, needle of the queries that aren't blank."""
    return queries.select("query_id", "user_id", F.lower(strip(F.col("q"))).alias("needle")).filter("needle <> ''")


def asked_grams(asked: DataFrame, index: SearchIndex) -> DataFrame:
    """query_id, user_id, term, need: the rarest trigrams of a needle, `need` of which a chunk must have all; or, with a need of 0, those that begin
    with a needle of one or two characters, any of which will do."""
    totals = index.table("gram_totals")
    grams = asked.filter(F.length("needle") >= 3).select("query_id", "user_id", F.explode(trigrams(F.col("needle"))).alias("term"))
    # a trigram that occurs nowhere rules its query out
    sizes = totals.join(few(grams), ["user_id", "term"], "right").withColumn("df", F.coalesce("df", F.lit(0)))
    rarest = sizes.withColumn("k", F.row_number().over(Window.partitionBy("query_id").orderBy("df", "term"))).filter(F.col("k") <= RAREST)
    long_ = rarest.select("query_id", "user_id", "term", F.count("*").over(Window.partitionBy("query_id")).cast("int").alias("need"))
    short = few(asked.filter(F.length("needle") < 3))
    any_ = totals.join(short, "user_id").filter(F.col("term").startswith(F.col("needle"))).select("query_id", "user_id", "term", F.lit(0).alias("need"))
    wanted, path = long_.union(any_), shared_folder(index.spark, "asked")
    wanted.write.parquet(path)
    return index.spark.read.schema(wanted.schema).parquet(path)


def candidates_in(postings: DataFrame) -> DataFrame:
    """query_id, num of the chunks that have what the grams of their queries ask for."""
    held = postings.groupBy("query_id", "block").agg(F.first("need").alias("need"), F.collect_list("at").alias("lists")).filter("need = 0 or size(lists) = need")
    both = reduce(lambda a, k: F.when(F.col("need") > k, F.array_intersect(a, F.get("lists", F.lit(k)))).otherwise(a), range(1, RAREST), F.col("lists")[0])
    at = F.when(F.col("need") == 0, F.array_distinct(F.flatten("lists"))).otherwise(both)
    return held.select("query_id", "block", F.explode(at).alias("at")).select("query_id", (F.col("block") + F.col("at")).alias("num"))


def substring_candidates(queries: DataFrame, index: SearchIndex) -> DataFrame:
    """query_id, num, needle: chunks that have the rarest trigrams of a query, or for fewer than three characters any trigram that begins with it. Blank
    queries have none."""
    asked = asked_needles(queries)
    found = candidates_in(index.postings("grams", asked_grams(asked, index)))
    return found.join(few(asked.select("query_id", "needle")), "query_id")


def containing(candidates: DataFrame, asked: DataFrame, index: SearchIndex) -> DataFrame:
    """query_id, num, doc_id, chunk of the candidates (query_id, num), once written, whose chunks contain the needle."""
    path = shared_folder(index.spark, "held")
    candidates.write.parquet(path)
    rows = index.spark.read.schema(candidates.schema).parquet(path)
    texts = index.table("chunks").select("num", "doc_id", "chunk", F.lower("text").alias("text"))
    return texts.join(few(rows), "num").join(few(asked.select("query_id", "needle")), "query_id").filter(F.col("text").contains(F.col("needle"))).select("query_id", "num", "doc_id", "chunk")


def substring_search(queries: DataFrame, index: SearchIndex, limit: int = 20) -> DataFrame:
    """query_id, doc_id, chunk, score (null), rank: a user's chunks that contain the trimmed query whatever its case, by document and chunk.

    The first candidates of each query are held against the texts first; queries that don't find `limit` hits among them go through all of theirs.
    """
    asked = asked_needles(queries)
    grams = asked_grams(asked, index)
    postings = index.postings("grams", grams)
    # at least (short needles) or at most (long ones) so many candidates are in a block
    guess = F.when(F.first("need") == 0, F.max("n")).otherwise(F.min("n"))
    blocks = postings.groupBy("query_id", "block").agg(guess.alias("guess"), F.first("need").alias("need"), F.count("*").alias("have")).filter("need = 0 or have = need")
    before = F.sum("guess").over(Window.partitionBy("query_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    near = blocks.withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") < FIRST_LOOK).select("query_id", "block")
    nearest = candidates_in(postings.join(few(near), ["query_id", "block"], "left_semi"))
    held = nearest.withColumn("k", F.row_number().over(Window.partitionBy("query_id").orderBy("num"))).filter(F.col("k") <= FIRST_HELD).drop("k")
    hits, path = ranked(containing(held, asked, index), [F.col("num")], limit), shared_folder(index.spark, "hits")
    hits.write.parquet(path)
    hits = index.spark.read.schema(hits.schema).parquet(path)
    done = hits.groupBy("query_id").agg(F.count("*").alias("n")).filter(F.col("n") >= min(50, limit))
    left = few(grams.join(F.broadcast(done), "query_id", "left_anti"))
    others = containing(candidates_in(index.postings("grams", left)), asked, index)
    best = hits.join(F.broadcast(done), "query_id", "left_semi").select("query_id", "doc_id", "chunk", "rank").union(ranked(others, [F.col("num")], limit).select("query_id", "doc_id", "chunk", "rank"))
    return best.select("query_id", "doc_id", "chunk", F.lit(None).cast("double").alias("score"), "rank")
