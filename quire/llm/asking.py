"""Requests of blocks for the values of their keys, without a join of single rows.

A block asks for the distinct keys that it holds, packed in a row for each shard. Requests go up a tree, FAN to a node, each node adding up
what its children ask for; at the top a shard has each of its keys once. Answers come down the same way, each child getting the values of
its own keys only, in their order. So a task holds FAN requests of one shard, and what is shipped grows with the blocks.

Columns: kind (gram: sorted unsigned 64-bit keys, or token: bytes without blanks), shard, node (of the row), salt (of its parent).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import materialise, pack, pack_sorted, unpack, unpack_sorted, unzip, zip_bytes

#: Requests that meet in a node of the tree (expected number).
FAN = 128
SUMS = "kind string, shard int, node long, keys binary, counts binary"
ANSWER = "kind string, shard int, node long, keys binary, vals binary"


def add_up(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with the sums of their counts."""
    if not len(keys):
        return keys, counts.astype(np.int64)
    at = np.argsort(keys, kind="stable")
    keys, counts = keys[at], counts[at].astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def token_shard(tokens: list[bytes], shards: int) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(t) for t in tokens), dtype=np.uint64, count=len(tokens)) % np.uint64(shards)


def split_tokens(blob: bytes) -> list[bytes]:
    """Tokens hold no space; the end token is a line feed."""
    return unzip(blob).split(b" ")


def merged(kind: str, keys: pd.Series, counts: pd.Series) -> tuple[bytes, bytes]:
    if kind == "gram":
        k, c = add_up(np.concatenate([unpack_sorted(x) for x in keys]), np.concatenate([unpack(x, "<i8") for x in counts]))
        return pack_sorted(k), pack(c)
    total: dict[bytes, int] = {}
    for k, c in zip(keys, counts):
        for t, n in zip(split_tokens(k), unpack(c, "<i8").tolist()):
            total[t] = total.get(t, 0) + n
    names = sorted(total)
    return zip_bytes(b" ".join(names)), pack(np.array([total[t] for t in names], dtype=np.int64))


def merge(pdf: pd.DataFrame) -> pd.DataFrame:
    """What the children of a node ask for, added up."""
    one = pdf.iloc[0]
    k, c = merged(one["kind"], pdf["keys"], pdf["counts"])
    return pd.DataFrame([(one["kind"], int(one["shard"]), int(one["salt"]), k, c)], columns=["kind", "shard", "node", "keys", "counts"])


def answers(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """For each child of a node the values of its own keys, from those of the node."""
    rows = []
    if len(left) and len(right):
        kind, shard, keys, vals = (right[c].iloc[0] for c in ("kind", "shard", "keys", "vals"))
        if kind == "gram":
            table, vals = unpack_sorted(keys), unpack(vals, "<f4")
            for node, k in zip(left["node"], left["keys"]):
                rows.append((kind, int(shard), node, k, pack(vals[np.searchsorted(table, unpack_sorted(k))])))
        else:
            table = dict(zip(split_tokens(keys), unpack(vals, "<i8").tolist()))
            for node, k in zip(left["node"], left["keys"]):
                rows.append((kind, int(shard), node, k, pack(np.array([table[t] for t in split_tokens(k)], dtype=np.int64))))
    return pd.DataFrame(rows, columns=["kind", "shard", "node", "keys", "vals"])


def climb(asked: DataFrame, blocks: int, fan: int = FAN) -> tuple[DataFrame, list[DataFrame]]:
    """The keys of all requests (kind, shard, node, keys, counts) with the sums of their counts, a row for each kind and shard, and
    the levels of the tree below."""
    width, levels = blocks, [asked]
    while True:
        width = max(1, math.ceil(width / fan))
        levels[-1] = levels[-1].withColumn("salt", F.pmod("node", F.lit(width)))
        levels.append(materialise(levels[-1].groupBy("kind", "shard", "salt").applyInPandas(merge, SUMS), "sums"))
        if width == 1:
            return levels.pop(), levels


def descend(told: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """For each request of the lowest level the values of its keys, from those (kind, shard, node, keys, vals) of the top."""
    for asked in reversed(levels):
        told = asked.groupBy("kind", "shard", "salt").cogroup(told.withColumnRenamed("node", "salt").groupBy("kind", "shard", "salt")).applyInPandas(answers, ANSWER)
    return told
