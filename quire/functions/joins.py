"""Helpers for joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a side that is broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000


def few(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast if it has been counted and is small."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
