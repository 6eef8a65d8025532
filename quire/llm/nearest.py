"""Exact nearest vectors by a block matrix join with quantised tiles.

Candidates and queries are packed into blocks; query blocks are copied to the slots among which candidate blocks are dealt out, and
meet them by (block, slot). A tile of int8 products gives each cosine within a bound from the rounding that was
measured; only pairs whose upper bound reaches the k-th lower bound are recomputed in double. Slots keep k per query; the lists of a
query are merged by a heap.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import block_count

QUERY_BLOCK = 2048
TILE = 4096
EXACT = 1 << 16
BLOCK = "block int, slot int, dim int, ids binary, vectors binary"
FOUND = "query_id long, vec_id long, score double"


def usable(vector: Column) -> Column:
    """Not null, without null or non-finite components, not zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def packer(blocks: int, slots: int, copies: bool, width: str):
    """Rows (vec_id, embedding) of a batch as matrices of the width they came in, one for each dimension and block.

    A query block is copied to all slots; a candidate block gets one slot, for all query blocks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = TaskContext.get().partitionId() % slots
        for pdf in batches:
            size = pdf["embedding"].map(len)
            for dim, part in pdf.groupby(size):
                for a in range(0, len(part), TILE):
                    some = part.iloc[a : a + TILE]
                    ids, m = some["vec_id"].to_numpy(dtype="<i8"), np.array(some["embedding"].tolist(), dtype=width)
                    n = (n + 1) % slots
                    if copies:
                        of = (ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % blocks
                        rows = [(int(b), s, int(dim), ids[of == b].tobytes(), m[of == b].tobytes()) for b in np.unique(of) for s in range(slots)]
                    else:
                        rows = [(b, n, int(dim), ids.tobytes(), m.tobytes()) for b in range(blocks)]
                    yield pd.DataFrame(rows, columns=["block", "slot", "dim", "ids", "vectors"])

    return run


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes of -127 to 127, scales, lengths of the coded vectors, lengths of what rounding left."""
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    coded = codes * scale[:, None]
    return codes, scale, np.sqrt((coded**2).sum(axis=1)), np.sqrt(((unit - coded) ** 2).sum(axis=1))


def matrix(blobs, dim: int, width: str) -> np.ndarray:
    """Rows in double, each taken by the power of two that brings its largest component under one, which leaves cosines as they are
    and squares in range."""
    m = np.concatenate([np.frombuffer(x, dtype=width).reshape(-1, dim) for x in blobs]).astype(np.float64)
    return np.ldexp(m, -np.frexp(np.abs(m).max(axis=1))[1][:, None])


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, components added from first to last, so that equal vectors get equal scores wherever they stand."""
    dot = np.add.accumulate(a * b, axis=1)[:, -1]
    return np.clip(dot / np.sqrt(np.add.accumulate(a * a, axis=1)[:, -1] * np.add.accumulate(b * b, axis=1)[:, -1]), -1, 1)


def best(query: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query: highest score, then smallest id."""
    at = np.lexsort((vec, -score, query))
    q = query[at]
    first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.empty(0, dtype=np.int64)
    place = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    at = at[place < k]
    return query[at], vec[at], score[at]


def slot_search(k: int, width: str):
    def run(candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        got = []
        for dim in sorted(set(candidates["dim"]) & set(queries["dim"])):
            asked = queries[queries["dim"] == dim]
            qid, q = np.concatenate([np.frombuffer(x, dtype="<i8") for x in asked["ids"]]), matrix(asked["vectors"], dim, width)
            unit = q / np.sqrt((q**2).sum(axis=1))[:, None]
            code, scale, length, rest = quantise(unit)
            wide = np.float32 if dim * 127 * 127 < 1 << 24 else np.float64  # sums of products stay whole numbers
            floor = np.full((len(qid), k), -np.inf)
            have = (np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0))
            for _, block in candidates[candidates["dim"] == dim].iterrows():
                cid, c = np.frombuffer(block["ids"], dtype="<i8"), matrix([block["vectors"]], dim, width)
                ccode, cscale, _, crest = quantise(c / np.sqrt((c**2).sum(axis=1))[:, None])
                near = (code.astype(wide) @ ccode.astype(wide).T) * (scale[:, None] * cscale[None, :])
                bound = length[:, None] * crest[None, :] + rest[:, None] + 1e-9
                own = qid[:, None] == cid[None, :]
                low = np.where(own, -np.inf, near - bound)
                take = min(k, len(cid))
                floor = -np.sort(-np.concatenate([floor, -np.partition(-low, take - 1, axis=1)[:, :take]], axis=1), axis=1)[:, :k]
                a, b = np.nonzero((near + bound >= floor[:, -1:]) & ~own)
                for i in range(0, len(a), EXACT):
                    x, y = a[i : i + EXACT], b[i : i + EXACT]
                    new = (x, cid[y], cosines(q[x], c[y]))
                    have = best(*[np.concatenate(z) for z in zip(have, new)], k)
            got.append(pd.DataFrame({"query_id": qid[have[0]], "vec_id": have[1], "score": have[2]}))
        return pd.concat(got) if got else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    return run


def heap_merge(k: int):
    """Rows come sorted by query_id; a heap of k holds the best of the query at hand."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        query, heap = None, []

        def ranked():
            return [(query, n + 1, -v, s) for n, (s, v) in enumerate(sorted(heap, key=lambda x: (-x[0], -x[1])))]

        for pdf in batches:
            out = []
            for q, v, s in zip(pdf["query_id"].tolist(), pdf["vec_id"].tolist(), pdf["score"].tolist()):
                if q != query:
                    out += ranked()
                    query, heap = q, []
                (heapq.heappush if len(heap) < k else heapq.heappushpop)(heap, (s, -v))
            yield pd.DataFrame(out, columns=["query_id", "rank", "vec_id", "score"])
        yield pd.DataFrame(ranked(), columns=["query_id", "rank", "vec_id", "score"])

    return run


def nearest_vectors(vectors: DataFrame, every: int = 50, k: int = 5, slot_bytes: int = 4 << 20) -> DataFrame:
    """The k nearest by cosine for each row whose vec_id is divisible by `every`: query_id, rank, vec_id, score.

    All other rows are candidates; ties go to the smaller vec_id. Rows with a null vec_id and vectors that are null,
    zero, or hold null or non-finite components take no part; vectors of other dimensions are no candidates of a
    query. A repeated row is a candidate as often as it occurs; a query id that repeats is asked once, with the least of its vectors
    in the order of components. Queries with no candidate and empty tables give no rows; other columns are ignored.
    """
    float_ = vectors.schema["embedding"].dataType.elementType.typeName() == "float"
    kind, width = ("array<float>", "<f4") if float_ else ("array<double>", "<f8")
    fine = vectors.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"))
    asked = fine.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    slots, blocks = block_count(vectors, slot_bytes), max(1, math.ceil(asked.count() / QUERY_BLOCK))
    queries = asked.mapInPandas(packer(blocks, slots, True, width), BLOCK)
    candidates = fine.mapInPandas(packer(blocks, slots, False, width), BLOCK)
    found = candidates.groupBy("block", "slot").cogroup(queries.groupBy("block", "slot")).applyInPandas(slot_search(k, width), FOUND)
    return found.repartition("query_id").sortWithinPartitions("query_id").mapInPandas(heap_merge(k), "query_id long, rank int, vec_id long, score double")
