"""The stored side of chunk upserts: a table in buckets of doc_id, whose changes are seen whole or not at all.

Every commit writes the touched buckets to a folder of its own and then one small manifest that names, for each bucket, the folder that counts, and for each
stream the last batch that it holds. A manifest is a single file, so a reader sees all of a commit or none of it; a writer
that dies before leaves files that no manifest names; and a batch that comes again finds itself in the manifest and changes nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources.tables import SCHEMAS, upsert_chunks

#: Rows of a manifest: kind bucket has the commit whose folder holds it, kind stream the last batch.
MANIFEST = "kind STRING, name STRING, value STRING"


class ChunkStore:
    """Chunks (doc_id, chunk, user_id, filename, sheet, text, embedding) in a folder that driver and executors share.

    `buckets` is fixed by the first commit: a few for each task that a full rewrite should have. One writer commits at a time; of two
    that race for the same manifest the second fails and may try again.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        self.spark, self.folder, self.buckets = spark, folder, buckets

    def _manifest(self) -> tuple[int, dict[str, str], dict[str, int]]:
        """Number of the last commit (0: none), folder of each bucket, last batch of each stream: a row for each, however many chunks there are."""
        try:
            all_ = self.spark.read.schema(f"{MANIFEST}, n LONG").parquet(f"{self.folder}/manifest")
        except AnalysisException:
            return 0, {}, {}
        last = all_.agg(F.max("n")).first()[0] or 0
        rows = all_.filter(F.col("n") == last).collect()
        held = lambda kind: {r["name"]: r["value"] for r in rows if r["kind"] == kind}
        self.buckets = int(held("store").get("buckets", self.buckets))
        return last, held("bucket"), {k: int(v) for k, v in held("stream").items()}

    def version(self) -> int:
        return self._manifest()[0]

    def bucket(self, doc_id: Column) -> Column:
        return F.pmod(F.xxhash64(doc_id.cast("long")), F.lit(self.buckets)).cast("int")

    def _read(self, places: dict[str, str]) -> DataFrame:
        if not places:
            return self.spark.createDataFrame([], SCHEMAS["chunks"])
        return self.spark.read.schema(SCHEMAS["chunks"]).parquet(*[f"{self.folder}/{v}/bucket={k}" for k, v in sorted(places.items())])

    def read(self) -> DataFrame:
        """All chunks as of the last commit."""
        return self._read(self._manifest()[1])

    def read_documents(self, doc_ids: list[int]) -> DataFrame:
        """Chunks of some documents: only their buckets are read."""
        _, places, _ = self._manifest()
        ids = self.spark.createDataFrame([(i,) for i in doc_ids], "doc_id long")
        wanted = {str(r[0]) for r in ids.select(self.bucket(F.col("doc_id"))).distinct().collect()}
        return self._read({k: v for k, v in places.items() if k in wanted}).filter(F.col("doc_id").isin(doc_ids))

    def upsert(self, new: DataFrame, documents: DataFrame, stream: str | None = None, batch: int = 0) -> list[int]:
        """Replaces all chunks of the documents that `new` brings (see tables.upsert_chunks) and returns the buckets that were written.

        With a `stream`, a batch that the store holds already is left out.
        """
        last, places, batches = self._manifest()
        if stream is not None and batch <= batches.get(stream, -1):
            return []
        level, batches = new.storageLevel, batches | ({stream: batch} if stream is not None else {})
        if level.useMemory or level.useDisk:
            return self._replace(new, documents, last, places, batches)
        held = new.persist()  # read several times: which documents, which buckets, and the rows
        try:
            return self._replace(held, documents, last, places, batches)
        finally:
            held.unpersist()

    def _replace(self, new: DataFrame, documents: DataFrame, last: int, places: dict[str, str], batches: dict[str, int]) -> list[int]:
        touched = new.join(documents.select("doc_id"), "doc_id", "left_semi").select(self.bucket(F.col("doc_id"))).distinct()
        wanted = sorted(r[0] for r in touched.collect())  # no more than there are buckets
        if wanted:
            old = self._read({str(b): places[str(b)] for b in wanted if str(b) in places})
            rows = upsert_chunks(new, old, documents).withColumn("bucket", self.bucket(F.col("doc_id")))
            folder = f"data/{uuid.uuid4().hex}"
            # rebalancing splits a bucket with a hot document over several files
            rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "doc_id", "chunk").write.partitionBy("bucket").parquet(f"{self.folder}/{folder}")
            there = {str(r[0]) for r in self.spark.read.parquet(f"{self.folder}/{folder}").select("bucket").distinct().collect()} if self._any(folder) else set()
            places = {k: v for k, v in places.items() if int(k) not in wanted} | {k: folder for k in there}
        self._commit(last + 1, places, batches)
        return wanted

    def _any(self, folder: str) -> bool:
        """Whether a write left rows: one of none has no buckets, and so no schema."""
        return not self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(f"{self.folder}/{folder}").select("path").isEmpty()

    def _commit(self, n: int, places: dict[str, str], batches: dict[str, int]) -> None:
        rows = [("store", "buckets", str(self.buckets)), *(("bucket", k, v) for k, v in places.items()), *(("stream", k, str(v)) for k, v in batches.items())]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("errorifexists").parquet(f"{self.folder}/manifest/n={n}")

    def sink(self, documents: DataFrame, stream: str) -> Callable[[DataFrame, int], None]:
        """What a stream's foreachBatch calls with chunks (doc_id, chunk, text, and filename, sheet, embedding, seq if there are) and the batch's number."""

        def write(rows: DataFrame, batch: int) -> None:
            given = {"filename": "string", "sheet": "string", "embedding": "array<float>", "seq": "long"}
            full = rows.withColumns({c: F.lit(None).cast(t) for c, t in given.items() if c not in rows.columns})
            self.upsert(full.withColumn("seq", F.coalesce("seq", F.lit(0))), documents, stream, batch)

        return write
