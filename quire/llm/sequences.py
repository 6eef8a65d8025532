"""Token ids as equal-length sequences in Arrow files with fixed-size-list batches.

A file holds the ids of consecutive documents, each ended by `end_id`, cut into rows of `length` ids with a mask that is
false on the filling of the last row. Ids take 16 bits where the vocabulary allows. Rows are read in place: a batch's
buffers are the mapped file. Beside each file lies an index with the documents' ids and token counts. Range
partitions by doc_id become one file each. Every attempt of a task writes files of its own, and only the manifest, which Spark commits
once, says which of them count; so a lost or repeated attempt leaves files behind that nobody reads, and harms none.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import Index, block_count, materialise, new_folder, slices
from quire.llm.pretokens import SLICE, frequencies, load_tokenizer, segment_sums
from quire.llm.byte_bpe import ranges

LENGTH = 2048
ROWS = 64
#: Parts whose ids an encoder keeps.
CARRY = 1_000_000


class Encoder:
    """Ids of texts from the ids of their white-space separated parts, each encoded once while the table lasts.

    Only for tokenizers that drop white space (see pretokens)."""

    def __init__(self, path: str):
        self.tokenizer = load_tokenizer(path)
        self.clear()

    def clear(self) -> None:
        self.index, self.ids, self.sizes, self.starts = Index(), np.empty(0, dtype=np.uint32), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each has."""
        if len(self.index) > CARRY:
            self.clear()
        flat, parts = frequencies(texts, self.index)
        if len(self.index) > len(self.sizes):
            new = [x.ids for x in self.tokenizer.encode_batch_fast([w.decode() for w in list(self.index)[len(self.sizes) :]], add_special_tokens=False)]
            sizes = np.fromiter(map(len, new), dtype=np.int64, count=len(new))
            self.ids = np.concatenate([self.ids, np.fromiter((i for x in new for i in x), dtype=np.uint32, count=int(sizes.sum()))])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.starts = np.cumsum(self.sizes) - self.sizes
        each = self.sizes[flat]
        return self.ids[ranges(self.starts[flat], each)], segment_sums(each, parts)


@lru_cache(maxsize=1)
def shared_encoder(path: str) -> Encoder:
    """One for each worker process, so that what a task has encoded serves the next."""
    return Encoder(path)


def sequence_schema(width: str, length: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(np.dtype(width)), length)), ("mask", pa.list_(pa.bool_(), length))])


class SequenceWriter:
    """Cuts a stream of ids into rows and writes them in batches of ROWS."""

    def __init__(self, sink, width: str, length: int):
        self.width, self.length, self.held, self.left = width, length, [], 0
        self.out = pa.ipc.new_file(sink, sequence_schema(width, length))

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids.astype(self.width))
        self.left += len(ids)
        if self.left >= self.length * ROWS:
            flat = np.concatenate(self.held)
            whole = len(flat) // (self.length * ROWS) * self.length * ROWS
            for a in range(0, whole, self.length * ROWS):
                self._batch(flat[a : a + self.length * ROWS], self.length * ROWS)
            self.held, self.left = [flat[whole:]], len(flat) - whole

    def _batch(self, flat: np.ndarray, real: int) -> None:
        values = pa.FixedSizeListArray.from_arrays(pa.array(flat), self.length)
        mask = pa.FixedSizeListArray.from_arrays(pa.array(np.arange(len(flat)) < real), self.length)
        self.out.write_batch(pa.record_batch([values, mask], schema=self.out_schema))

    @property
    def out_schema(self) -> pa.Schema:
        return sequence_schema(self.width, self.length)

    def close(self) -> None:
        if self.left:
            flat = np.concatenate(self.held)
            self._batch(np.concatenate([flat, np.zeros(-len(flat) % self.length, dtype=self.width)]), len(flat))
        self.out.close()


def open_file(uri: str):
    """An Arrow file by its address; mapped where the file system is local, so that its batches aren't copied."""
    fs, path = pa.fs.FileSystem.from_uri(uri)
    return pa.ipc.open_file(pa.memory_map(path) if isinstance(fs, pa.fs.LocalFileSystem) else fs.open_input_file(path))


def sequence_at(reader, row: int) -> tuple[np.ndarray, pa.BooleanArray]:
    """Ids and mask of one row of a file, both views of it: a numpy array and an Arrow array of bits."""
    batch = reader.get_batch(row // ROWS)
    ids, mask = batch.column(0), batch.column(1)
    n, at = ids.type.list_size, row % ROWS
    return ids.values.slice(at * n, n).to_numpy(), mask.values.slice(at * n, n)


def writer(folder: str, tokenizer: str, end_id: int, width: str, length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        fs, base = pa.fs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        name, encode = f"part-{part:06d}-{uuid.uuid4().hex}", shared_encoder(tokenizer)
        docs = ids = 0
        index_schema = pa.schema([("doc_id", pa.string()), ("n_tokens", pa.int64())])
        with fs.open_output_stream(f"{base}/{name}.arrow") as a, fs.open_output_stream(f"{base}/{name}.docs.arrow") as b:
            sink, index = SequenceWriter(a, width, length), pa.ipc.new_file(b, index_schema)
            for pdf in batches:
                texts = [t if isinstance(t, str) else None for t in pdf["text"]]
                for i, j in slices([len(t or "") for t in texts], SLICE):
                    flat, sizes = encode(texts[i:j])
                    ends = np.cumsum(sizes)
                    sink.add(np.insert(flat, ends, end_id))
                    index.write_batch(pa.record_batch([pa.array(list(pdf["doc_id"].iloc[i:j]), pa.string()), pa.array(sizes + 1)], schema=index_schema))
                    docs, ids = docs + j - i, ids + int(sizes.sum()) + j - i
            sink.close()
            index.close()
        yield pd.DataFrame({"part": [part], "file": [f"{folder}/{name}"], "docs": [docs], "ids": [ids]})

    return run


def write_sequences(docs: DataFrame, tokenizer: str, end_id: int, folder: str, length: int = LENGTH, part_bytes: int = 16 << 20) -> DataFrame:
    """Encodes every text, in order of doc_id (nulls first, rows of one id by a hash of the text), into files in `folder`.

    Returns the manifest: part, file (without its endings), docs, ids. Null and empty texts are one end id.
    """
    width = "<u2" if max(load_tokenizer(tokenizer).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
    n = block_count(docs, part_bytes)
    placed = docs.select("doc_id", "text").repartitionByRange(n, F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id"), F.xxhash64("text")).select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    manifest = materialise(placed.mapInPandas(writer(folder, tokenizer, end_id, width, length), "part int, file string, docs long, ids long"), "manifest")
    return manifest.withColumn("base", F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each file


def reader(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for file, start in zip(pdf["file"], pdf["base"]):
            rows, flat, next_ = open_file(file + ".arrow"), np.empty(0, dtype=np.uint32), 0
            index = open_file(file + ".docs.arrow")
            for k in range(index.num_record_batches):
                batch = index.get_batch(k)
                sizes = batch.column(1).to_numpy()
                starts, crcs = start + np.cumsum(sizes) - sizes, np.empty(len(sizes), dtype=np.int64)
                for d, n in enumerate(sizes.tolist()):
                    crc = 0
                    while n:
                        if not len(flat):
                            got = rows.get_batch(next_)
                            flat, next_ = got.column(0).values.to_numpy()[got.column(1).values.to_numpy(zero_copy_only=False)], next_ + 1
                        take = min(n, len(flat))
                        crc = zlib.crc32(flat[:take].astype("<u4").tobytes(), crc)
                        flat, n = flat[take:], n - take
                    crcs[d] = crc
                yield pd.DataFrame({"doc_id": batch.column(0).to_pylist(), "start": starts, "n_tokens": sizes, "ids_crc32": crcs})
                start += int(sizes.sum())


def sequence_digests(docs: DataFrame, tokenizer: str, end_id: int = 1, folder: str | None = None, length: int = LENGTH) -> DataFrame:
    """Writes the files, reads them back, and returns doc_id, start, n_tokens (with the end id) and ids_crc32.

    A row for every row of `docs`; an empty table gives none; other columns are ignored, whatever their names.
    `folder` is one that driver and executors share; by default a new one in spark.checkpoint.dir.
    """
    manifest = write_sequences(docs, tokenizer, end_id, folder or new_folder(docs.sparkSession, "sequences"), length)
    got = manifest.repartition(block_count(docs, 16 << 20), "part").mapInPandas(reader, "doc_id string, start long, n_tokens long, ids_crc32 long")
    return got.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
