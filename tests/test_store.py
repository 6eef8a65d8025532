"""The chunk store, and live indexing into it."""

import pytest
from pyspark.errors import AnalysisException, StreamingQueryException
from pyspark.sql import functions as F

from quire.plans.gates import length_model
from quire.operators import assets, intake, retrieve, text
from quire.sources import scratch, tables
from quire.sources.scratch import shared_folder
from quire.sources.store import ChunkStore
from quire.streaming import streams

CHUNK = "doc_id long, chunk string, filename string, sheet string, text string, embedding array<float>, seq long"


def known(spark, n):
    return spark.range(n).select(F.col("id").alias("doc_id"), (F.col("id") % 5).alias("user_id"), F.lit("n").alias("name"))


def given(spark, n):
    return spark.range(n).select(F.col("id").alias("doc_id"), F.explode(F.array(F.lit("0"), F.lit("1"))).alias("chunk"), F.concat(F.lit("t"), "id").alias("text"))


def test_one_document_in_a_hundred_rewrites_its_buckets(spark):
    store, docs, new = ChunkStore(spark, shared_folder(spark, "t"), 16), known(spark, 200), given(spark, 200)
    sink = store.sink(docs, "s")
    sink(new, 0)
    _, before, _ = store._manifest()
    sink(new.filter("doc_id % 100 = 3").withColumn("text", F.lit("z")), 1)
    _, after, batches = store._manifest()
    buckets = {str(r[0]) for r in docs.filter("doc_id % 100 = 3").select(store.bucket(F.col("doc_id"))).collect()}
    assert {k for k in after if after[k] != before[k]} == buckets and batches == {"s": 1}
    assert sorted(r.doc_id for r in store.read().filter("text = 'z'").collect()) == [3, 3, 103, 103] and store.read().count() == 400
    assert {r.text for r in store.read_documents([3, 4]).collect()} == {"z", "t4"}


def test_a_batch_that_comes_again_and_documents_that_lose_all(spark):
    store, docs = ChunkStore(spark, shared_folder(spark, "t"), 4), known(spark, 10)
    sink = store.sink(docs, "s")
    sink(given(spark, 10), 3)
    version = store.version()
    sink(given(spark, 10).withColumn("text", F.lit("again")), 3)
    assert store.version() == version and store.read().filter("text = 'again'").isEmpty()
    assert store.upsert(spark.createDataFrame([(1, "x", None, None, "t", None, 1)], CHUNK), docs) and store.read().count() == 18
    assert store.upsert(spark.createDataFrame([(77, "0", None, None, "t", None, 1)], CHUNK), docs) == [] and store.read().count() == 18
    store.upsert(spark.createDataFrame([(i, "x", None, None, "t", None, 1) for i in range(10)], CHUNK), docs)
    assert store.read().count() == 0


def test_no_manifest_no_commit(spark):
    """Files of a writer that ended before its manifest are never read."""
    store = ChunkStore(spark, shared_folder(spark, "t"), 4)
    assert store.read().count() == 0 and store.version() == 0
    store.upsert(spark.createDataFrame([(1, "0", None, None, "kept", None, 1)], CHUNK), known(spark, 5))
    spark.createDataFrame([(1, 0, 1, "f", None, "lost", None)], "doc_id long, chunk int, user_id long, filename string, sheet string, text string, embedding array<float>").withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(f"{store.folder}/data/orphan")
    assert [r.text for r in store.read().collect()] == ["kept"]


def test_a_stream_that_dies_after_its_commit(spark):
    """The batch is played again when the stream starts anew, and finds itself in the store."""
    folder = shared_folder(spark, "t")
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.lit(True).alias("confirmed"), F.timestamp_seconds(F.col("id") + 1_000_000).alias("ts"))
    docs.repartitionByRange(8, "doc_id").write.parquet(f"{folder}/in")
    store = ChunkStore(spark, f"{folder}/store", 4)
    sink, seen = store.sink(known(spark, 40), "uploads"), []

    def dies_once(rows, epoch):
        sink(rows, epoch)
        seen.append(epoch)
        if seen.count(epoch) == 1 and epoch == 1:
            raise RuntimeError("lost after the commit")

    source = lambda: spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
    with pytest.raises(StreamingQueryException):
        streams.index_uploads(source(), dies_once, f"{folder}/checkpoint", late="1 hour").awaitTermination()
    version = store.version()
    streams.index_uploads(source(), dies_once, f"{folder}/checkpoint", late="1 hour").awaitTermination()
    assert seen.count(1) == 2 and version >= 2
    assert sorted((r.doc_id, r.text) for r in store.read().collect()) == sorted((r.doc_id, r.text) for r in docs.collect())


def test_embedding_in_batches(spark, tmp_path):
    """300 rows in one partition: batches of 64, one of which fails, and rows without a vector. Calls leave files, since they are made in another process."""
    folder = str(tmp_path)

    def load():
        import tempfile

        tempfile.mkstemp(prefix="load-", dir=folder)

        def model(texts):
            tempfile.mkstemp(prefix=f"call-{len(texts)}-", dir=folder)
            if texts[0] == "bad":
                raise ValueError("no answer")
            return [None if t == "none" else [float(len(t))] for t in texts]

        return model

    text_ = F.when(F.col("id") == 64, "bad").when(F.col("id") % 10 == 1, "none").when(F.col("id") % 10 == 2, None).otherwise("word")
    rows = spark.range(0, 300, 1, 1).select("id", text_.alias("text"), F.lit("clash").alias("embedding"))
    got = retrieve.with_embeddings(rows, load).collect()
    assert {r.id for r in got} == {i for i in range(300) if not 64 <= i < 128 and i % 10 != 1}
    assert {r.embedding[0] for r in got} == {4.0, 0.0}
    names = sorted(p.name for p in tmp_path.iterdir())
    assert [n.split("-")[1] for n in names if n.startswith("call")] == ["44", "64", "64", "64", "64"] and sum(n.startswith("load") for n in names) == 1


def test_numbers_skip_chunks_without_a_vector(spark):
    docs = spark.createDataFrame([(1, "f", "\n\n".join(c * 900 for c in "abcd"))], "doc_id long, filename string, text string")
    drop = lambda rows: rows.filter("text not like 'b%'").withColumn("embedding", F.array(F.lit(1.0)))
    plain = {r.chunk_id: r.text for r in text.index_chunks(docs, overlap=0).collect()}
    got = {r.chunk_id: r.text[0] for r in text.index_chunks(docs, overlap=0, embed=drop).collect()}
    assert len(plain) == 4 and got == {"1_0": "a", "1_1": "c", "1_2": "d"}
    assert length_model()(["abcde", "ab"]) == [None, [2, 1.0]]


def test_folders_are_removed(spark):
    folder = shared_folder(spark, "t")
    spark.range(3).write.parquet(folder)
    assert spark.read.parquet(folder).count() == 3
    assert scratch.remove_folders() >= 1 and scratch.MADE == []
    with pytest.raises(AnalysisException):
        spark.read.parquet(folder)


def test_rows_of_an_upsert_are_made_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def made(batches):
        for pdf in batches:
            calls.add(len(pdf))
            yield pdf

    store, rows = ChunkStore(spark, shared_folder(spark, "t"), 4), given(spark, 50)
    store.sink(known(spark, 50), "s")(rows.mapInPandas(made, rows.schema), 0)
    assert calls.value == 100 and store.read().count() == 100


def shuffled_joins(spark, build):
    """Joins by shuffle in the plan, where Spark has no sizes to go by."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = build()
        return df, df._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_few_documents_that_come_again_leave_the_texts_where_they_are(spark):
    new = spark.createDataFrame([(1, "0", None, None, f"t{i}", None, i) for i in range(9)] + [(2, "1", None, None, "one", None, 1)], CHUNK)
    old = spark.createDataFrame([(d, 0, 1, "f", None, "old", None) for d in (1, 2, 3)], tables.SCHEMAS["chunks"])
    got, joins = shuffled_joins(spark, lambda: tables.upsert_chunks(new, old, known(spark, 10)))
    assert not joins and sorted((r.doc_id, r.chunk, r.text) for r in got.collect()) == [(1, 0, "t8"), (2, 1, "one"), (3, 0, "old")]


def test_messages_of_reports_are_not_shuffled(spark):
    reports = spark.createDataFrame([(i, i % 3, "Bug", "a message of some length") for i in range(9)], "report_id long, user_id long, subject string, message string")
    users = spark.createDataFrame([(i, f"n{i}", f"E{i}") for i in range(2)], "user_id long, name string, email string")
    got, joins = shuffled_joins(spark, lambda: intake.accept_reports(reports, users))
    assert not joins and {(r.user_id, r.email, r.reason) for r in got.collect()} == {(0, "e0", None), (1, "e1", None), (2, None, "unknown user")}


def test_a_summary_reads_each_text_once(spark):
    df = spark.createDataFrame([(1, "\n\n".join(c * 900 for c in "abc")), (2, "short"), (3, None)], "request_id long, text string")
    plan = assets.summary_plan(df)
    assert "Union" not in plan._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.request_id, r.step, r.chunk, (r.text or "")[-1:], r.form) for r in plan.collect()) == [
        (1, "map", 0, "a", "bullets"), (1, "map", 1, "b", "bullets"), (1, "map", 2, "c", "bullets"), (1, "reduce", 3, "", None), (2, "single", 0, "t", "bullets"),
    ]


def test_texts_that_come_again_are_stored_small(spark):
    body = "".join(chr(97 + (i * i * 7 + i // 3) % 26) for i in range(60_000))
    folder = shared_folder(spark, "t")
    rows = spark.range(200, numPartitions=1).select(F.col("id").alias("report_id"), F.concat(F.lit(body), F.col("id").cast("string")).alias("message"))
    tables.write_tables({"reports": rows}, folder)
    stored = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{folder}/reports.parquet").agg(F.sum("length")).first()[0]
    assert stored < 200 * 60_000 // 20 and spark.read.parquet(f"{folder}/reports.parquet").count() == 200
