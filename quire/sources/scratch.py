"""Folders for intermediate results, shared by driver and executors."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow.fs
from pyspark.sql import SparkSession

#: Folders made in this process, for remove_folders.
MADE: list[str] = []


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A new folder in the one that spark.checkpoint.dir names; a temporary one only where that is unset and Spark runs in one process (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='quire-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    MADE.append(f"{base}/quire-{uuid.uuid4().hex}")
    return f"{MADE[-1]}/{tag}"


def remove_folders() -> int:
    """Deletes the folders of this process, for callers who have written their results; returns how many there were."""
    n = 0
    while MADE:
        fs, path = pyarrow.fs.FileSystem.from_uri(MADE.pop())
        if fs.get_file_info(path).type == pyarrow.fs.FileType.Directory:
            fs.delete_dir(path)
            n += 1
    return n
