"""Helpers shared by the training-data operators: scratch tables, block sizes, packed arrays."""

from __future__ import annotations

import math
import re
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as in `[\x20\x09-\x0D]`.
WHITE = "\\x20\\x09-\\x0D"
#: Estimates from here on (an exabyte) say that Catalyst doesn't know.
UNKNOWN = 1 << 60
#: Maps A-Z to a-z and leaves every other byte.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a temporary one only where it is unset and Spark runs in one process (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='quire-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base


#: Folders made in this process, for remove_scratch.
MADE: list[str] = []
#: Folders made in the innermost passing_scratch of this thread.
PASSING: ContextVar[list[str] | None] = ContextVar("PASSING", default=None)
#: Whether a query's shuffle files are deleted when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def new_folder(spark: SparkSession, tag: str, lasting: bool = False) -> str:
    name = f"{scratch_dir(spark)}/quire-{uuid.uuid4().hex}"
    MADE.append(name)
    if not lasting and PASSING.get() is not None:
        PASSING.get().append(name)
    return f"{name}/{tag}"


def materialise(df: DataFrame, tag: str, by: str | None = None, lasting: bool = False) -> DataFrame:
    """Writes `df` to the shared folder (in folders for the values of a string column `by`) and reads it back, which cuts the
    lineage and survives lost executors. A `lasting` table outlives passing_scratch."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, tag, lasting)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, names: list[str]) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for name in names:
        path = hadoop.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that `materialise` returned, once nothing reads them any more."""
    for df in tables:
        folder = re.search("quire-[0-9a-f]{32}", df.inputFiles()[0])[0]
        names = [name for name in MADE if name.endswith(folder)]
        delete(df.sparkSession, names)
        MADE[:] = [name for name in MADE if name not in names]


@contextmanager
def passing_scratch(spark: SparkSession):
    """Deletes the intermediate tables made inside when it ends, but for lasting ones: for steps whose results read only these.

    The shuffle files of a query inside go when it ends; else they stay until the driver happens to collect its garbage.
    """
    names: list[str] = []
    token, before = PASSING.set(names), spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
        PASSING.reset(token)
        delete(spark, names)
        MADE[:] = [name for name in MADE if name not in names]


def remove_scratch(spark: SparkSession) -> int:
    """Deletes the intermediate tables of this process, for callers who have written their results; returns how many."""
    delete(spark, MADE)
    n = len(MADE)
    MADE.clear()
    return n


def input_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the size of `df` (the size of the files under a scan).

    Rows that come from no file have no estimate but the session's default of 2^63 - 1; only these are measured by a job.
    """
    guess = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if guess < UNKNOWN:
        return guess
    widths = {"string": F.octet_length, "binary": F.octet_length, "array": lambda c: 8 * F.size(c)}
    each = [widths.get(f.dataType.typeName(), lambda c: F.lit(8))(F.col(f"`{f.name}`")) for f in df.schema]
    return int(df.agg(*[F.sum(c.cast("long")).alias(f"c{i}") for i, c in enumerate(each)]).select(sum((F.coalesce(f"c{i}", F.lit(0)) for i in range(len(each))), F.lit(0))).first()[0])


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def block_count(df: DataFrame, block_bytes: int) -> int:
    """Blocks so that each holds about `block_bytes` of the input, and at least one for each shuffle partition."""
    return max(shuffle_partitions(df.sparkSession), math.ceil(input_bytes(df) / block_bytes))


def batched(batches, most: int):
    """Pandas frames with a column text, cut and put together to about `most` characters each; a longer text is one of its own."""
    held, size = [], 0
    for pdf in batches:
        for a, b in slices([len(t) if isinstance(t, str) else 0 for t in pdf["text"]], most):
            part = pdf.iloc[a:b]
            n = sum(len(t) for t in part["text"] if isinstance(t, str))
            if held and size + n > most:
                yield pd.concat(held)
                held, size = [], 0
            held.append(part)
            size += n
    if held:
        yield pd.concat(held)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that `df` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def remainder(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % n


def let(value: Column, body) -> Column:
    """`body(value)` with `value` evaluated once for each row, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted unsigned 64-bit keys as compressed differences."""
    return zstandard.ZstdCompressor(level=1).compress(np.diff(keys, prepend=np.uint64(0)).astype("<u8").tobytes())


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(unzip(blob), dtype="<u8"), dtype=np.uint64)


def pack(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).tobytes())


def pack_bytes(values: np.ndarray) -> bytes:
    """Numbers as compressed planes of bytes: first the lowest byte of each."""
    return zip_bytes(values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes())


def unpack_bytes(blob: bytes, dtype: str) -> np.ndarray:
    return np.frombuffer(unzip(blob), dtype=np.uint8).reshape(np.dtype(dtype).itemsize, -1).T.copy().view(dtype).reshape(-1)


def unpack(blob: bytes, dtype: str) -> np.ndarray:
    return np.frombuffer(unzip(blob), dtype=dtype)


def zip_bytes(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unzip(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


def words_of(text: str | None) -> list[bytes]:
    """White-space separated words of a text, A-Z lower-cased; none for null."""
    return [] if text is None else text.encode("utf-8", "replace").translate(LOWER).split()


def slices(sizes, most: int):
    """Index ranges of consecutive rows whose sizes add up to about `most`."""
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


class Index(dict):
    """Numbers its keys in the order in which they are first asked for."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n
