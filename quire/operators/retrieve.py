"""Retrieval of passages within a question's own document, and keyword search."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from quire.functions.strings import keywords, ordered_join, strip

#: Vectors of a tile, and questions that meet a tile at a time.
TILE, BLOCK = 1024, 256
#: Terms asked for (with their users) that are broadcast; more are joined by a shuffle.
BROADCAST_TERMS = 200_000


@lru_cache(maxsize=4)
def loaded(load: Callable[[], Callable]) -> Callable:
    """A model, loaded once in each worker process."""
    return load()


def with_embeddings(chunks: DataFrame, load: Callable[[], Callable[[list[str]], list]], batch: int = 64, text: str = "text") -> DataFrame:
    """Adds embedding (array<float>): `load`, a function of a module, gives a function from up to `batch` texts to as many vectors, or None where one failed;
    rows without a vector are dropped, and so is a batch for which the function raises. Null texts are asked for as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(load)
        for rows in batches:
            for at in range(0, rows.num_rows, batch):
                part = rows.slice(at, batch)
                try:
                    vectors = model([t or "" for t in part.column(text).to_pylist()])
                except Exception as error:  # the batch is lost, as the rows of a failed call are
                    warnings.warn(f"a batch of {part.num_rows} texts could not be embedded: {error}", stacklevel=2)
                    continue
                held = part.append_column("embedding", pa.array(vectors, pa.list_(pa.float32())))
                yield held.filter(pc.is_valid(held.column("embedding")))

    fields = [f for f in chunks.schema if f.name != "embedding"]
    return chunks.select(*[f"`{f.name}`" for f in fields]).mapInArrow(run, StructType([*fields, StructField("embedding", ArrayType(FloatType()))]))


def has_index(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    return docs.join(chunks.select("doc_id"), "doc_id", "left_semi")


def nearest_in_tile(k: int, metric: str):
    """Of one tile of a document: the nearest `k` of its chunks for each question, by distances of a whole block at once."""

    def run(asked: pd.DataFrame, tile: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(tile):
            return pd.DataFrame(columns=["question_id", "doc_id", "chunk", "distance"])
        tile = tile.sort_values("chunk", kind="stable")
        c = np.array(tile["c"].tolist(), dtype=np.float64)
        chunk, out = tile["chunk"].to_numpy(), []
        for at in range(0, len(asked), BLOCK):
            part = asked.iloc[at : at + BLOCK]
            q = np.array(part["q"].tolist(), dtype=np.float64)
            if metric == "cosine":
                with np.errstate(invalid="ignore", divide="ignore"):
                    far = 1 - (q @ c.T) / (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(c, axis=1)[None, :])
            else:
                far = np.stack([((c - x) ** 2).sum(axis=1) for x in q])
            far = np.round(far, 6) + 0.0  # no negative zero
            order = np.argsort(np.where(np.isnan(far), np.inf, far), axis=1, kind="stable")[:, :k]  # equal ones by chunk
            rows = np.repeat(np.arange(len(part)), order.shape[1])
            out.append(pd.DataFrame({"question_id": part["question_id"].to_numpy()[rows], "doc_id": part["doc_id"].to_numpy()[rows], "chunk": chunk[order.ravel()], "distance": far[rows, order.ravel()]}))
        return pd.concat(out)

    return run


def knn(questions: DataFrame, chunks: DataFrame, k: int = 12, metric: str = "cosine", tile: int = TILE) -> DataFrame:
    """question_id, doc_id, chunk, distance, rank: the nearest chunks of the question's document, equal ones by chunk; metric is cosine or l2sq.

    A document's chunks are dealt over tiles of about `tile` vectors by their number, so one with a large share of all chunks is many tiles, and each
    question goes to the tiles of its document. A tile gives `k` for a question; these meet in the end. Rows without an embedding take no part; a
    vector of length zero has no cosine: its distance is null and comes last.
    """
    if metric not in ("cosine", "l2sq"):
        raise ValueError("metric is cosine or l2sq")
    held = chunks.select("doc_id", "chunk", F.col("embedding").alias("c")).filter("doc_id is not null and c is not null")
    tiles = held.groupBy("doc_id").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    dealt = held.join(tiles, "doc_id").select("doc_id", "chunk", "c", F.pmod(F.xxhash64("chunk"), "tiles").cast("int").alias("tile"))
    asked = questions.select("question_id", "doc_id", F.col("embedding").alias("q")).filter("q is not null").join(tiles, "doc_id")
    sent = asked.select("question_id", "doc_id", "q", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"))
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    told = f"question_id {kind(questions, 'question_id')}, doc_id {kind(questions, 'doc_id')}, chunk {kind(chunks, 'chunk')}, distance double"
    near = sent.groupBy("doc_id", "tile").cogroup(dealt.groupBy("doc_id", "tile")).applyInPandas(nearest_in_tile(k, metric), told)
    near = near.withColumn("distance", F.nanvl("distance", F.lit(None).cast("double")))
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy(F.asc_nulls_last("distance"), "chunk"))).filter(F.col("rank") <= k)


def rerank(hits: DataFrame, questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Adds overlap (shared keywords), score = 0.7 similarity + 0.3 overlap share, and score_rank; blank chunks are skipped."""
    q = questions.select("question_id", keywords(F.col("question")).alias("_terms"))
    full = hits.join(q, "question_id").join(chunks.select("doc_id", "chunk", "text"), ["doc_id", "chunk"]).filter(strip(F.coalesce("text", F.lit(""))) != "")
    similar = F.coalesce(1 - F.least(F.greatest("distance", F.lit(0.0)), F.lit(1.0)), F.lit(0.5))
    both = F.size(F.array_intersect("_terms", keywords(F.col("text"))))
    scored = full.withColumn("overlap", both).withColumn("score", F.round(0.7 * similar + 0.3 * both / F.greatest(F.lit(1), F.size("_terms")), 9))
    return scored.withColumn("score_rank", F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("score"), "rank"))).drop("_terms")


def select_context(ranked: DataFrame, top: int = 5, gate: float = 0.9, near: float = 0.6) -> DataFrame:
    """question_id, doc_id, chunk, position, source: the top by score that lie under `gate`, or where none does all hits under `near`."""
    w = Window.partitionBy("question_id")
    best = (F.col("score_rank") <= top) & (F.coalesce("distance", F.lit(0.5)) < gate)
    marked = ranked.withColumn("_best", best).withColumn("_any", F.max(best.cast("int")).over(w) == 1)
    kept = marked.filter(F.when(F.col("_any"), F.col("_best")).otherwise(F.col("distance").isNull() | (F.col("distance") < near)))
    order = F.when(F.col("_any"), F.col("score_rank")).otherwise(F.col("rank"))
    return kept.select("question_id", "doc_id", "chunk", F.row_number().over(w.orderBy(order)).alias("position"), F.when(F.col("_any"), "reranked").otherwise("distance").alias("source"))


def context_text(selected: DataFrame, chunks: DataFrame) -> DataFrame:
    """question_id, context: selected chunks in order, a blank line between."""
    return selected.join(chunks.select("doc_id", "chunk", "text"), ["doc_id", "chunk"]).groupBy("question_id").agg(ordered_join(["position"], "text", "\n\n").alias("context"))


def document_context(docs: DataFrame, chunks: DataFrame, most_chunks: int = 500, most_chars: int = 12_000) -> DataFrame:
    """doc_id, context: the first chunks joined and cut, or the raw text of a document without any."""
    first = chunks.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk"))).filter(F.col("_n") <= most_chunks)
    joined = first.groupBy("doc_id").agg(ordered_join(["chunk"], "text", "\n\n").alias("_t"))
    return docs.join(joined, "doc_id", "left").select("doc_id", F.substring(strip(F.coalesce("_t", "text", F.lit(""))), 1, most_chars).alias("context"))


def keyword_search(queries: DataFrame, chunks: DataFrame, limit: int = 20) -> DataFrame:
    """query_id, doc_id, chunk, score, rank: a user's chunks with any query term; score = sum of tf * ln(1 + N / df)."""
    terms = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^\\p{L}\\p{N}]+"), lambda t: t != "")
    total = chunks.groupBy("user_id").agg(F.count("*").alias("total"))
    asked = queries.select("query_id", "user_id", F.explode(F.array_distinct(F.filter(F.split(F.lower("q"), "[^\\p{L}\\p{N}]+"), lambda t: t != ""))).alias("term"))
    sought = asked.select("user_id", "term").distinct()
    few = sought.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS  # the terms asked for go to the chunks, not the chunks' terms to them
    each = chunks.select("user_id", "doc_id", "chunk", F.explode(terms).alias("term")).join(F.broadcast(sought) if few else sought, ["user_id", "term"], "left_semi")
    wanted = each.groupBy("user_id", "doc_id", "chunk", "term").agg(F.count("*").alias("tf"))
    df = wanted.groupBy("user_id", "term").agg(F.count("*").alias("df"))
    hits = asked.join(wanted, ["user_id", "term"]).join(df, ["user_id", "term"]).join(total, "user_id")
    scored = hits.groupBy("query_id", "doc_id", "chunk").agg(F.round(F.sum(F.col("tf") * F.log(1 + F.col("total") / F.col("df"))), 6).alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id", "chunk"))).filter(F.col("rank") <= min(50, limit))


def substring_search(queries: DataFrame, chunks: DataFrame, limit: int = 20) -> DataFrame:
    """query_id, doc_id, chunk, score (null), rank: a user's chunks that contain the trimmed query whatever its case, by document and chunk; a
    blank query finds nothing. Meets each query with all chunks of its user; `search` has a stored form."""
    asked = queries.select("query_id", "user_id", strip(F.col("q")).alias("q")).filter("q <> ''")
    hits = asked.join(chunks.select("user_id", "doc_id", "chunk", "text"), "user_id").filter(F.lower("text").contains(F.lower("q")))
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id", "chunk"))).filter(F.col("rank") <= min(50, limit)).select("query_id", "doc_id", "chunk", F.lit(None).cast("double").alias("score"), "rank")


def snippet(text, query, width: int = 180, lead: int = 60):
    """`width` characters from `lead` before the first hit, or from the start."""
    hit = F.position(F.lower(query), F.lower(text))
    return F.substring(text, F.greatest(F.lit(1), hit - lead), F.lit(width))


def documents_from_chunks(chunks: DataFrame) -> DataFrame:
    """doc_id, filename (of the first chunk), type (ending, or text), size 0."""
    first = chunks.filter("doc_id is not null").groupBy("doc_id").agg(F.min_by("filename", "chunk").alias("filename"))
    ending = F.regexp_extract(F.coalesce("filename", F.lit("")), "\\.([^.]+)$", 1)
    return first.select("doc_id", "filename", F.coalesce(F.nullif(F.lower(ending), F.lit("")), F.lit("text")).alias("type"), F.lit(0).alias("size"))


def answer_questions(questions: DataFrame, chunks: DataFrame, routes: DataFrame) -> DataFrame:
    """question_id, route, context, chunks (in order): context only where the route is retrieve; no-answer where none was found."""
    asked = questions.join(routes, "question_id")
    mine = asked.filter("route = 'retrieve'")
    picked = select_context(rerank(knn(mine, chunks), mine, chunks))
    told = context_text(picked, chunks).join(picked.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "chunk"))), lambda x: x["chunk"]).alias("chunks")), "question_id")
    return asked.select("question_id", "route").join(told, "question_id", "left").select("question_id", F.when((F.col("route") == "retrieve") & F.col("context").isNull(), "no-answer").otherwise(F.col("route")).alias("route"), "context", "chunks")
