"""Answers of whole numbers down the tree of requests that `asking.climb` builds over sorted 64-bit keys."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from quire.llm.asking import ANSWER
from quire.llm.common import pack, unpack, unpack_sorted


def answers(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """For each child of a node the values of its own keys, from those of the node."""
    rows = []
    if len(left) and len(right):
        one = right.iloc[0]
        table, vals = unpack_sorted(one["keys"]), unpack(one["vals"], "<i8")
        for node, k in zip(left["node"], left["keys"]):
            rows.append((one["kind"], int(one["shard"]), node, k, pack(vals[np.searchsorted(table, unpack_sorted(k))])))
    return pd.DataFrame(rows, columns=["kind", "shard", "node", "keys", "vals"])


def descend_longs(told: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """For each request of the lowest level the values of its keys, from those (kind, shard, node, keys, vals) of the top."""
    for asked in reversed(levels):
        told = asked.groupBy("kind", "shard", "salt").cogroup(told.withColumnRenamed("node", "salt").groupBy("kind", "shard", "salt")).applyInPandas(answers, ANSWER)
    return told
