"""Registered queries of the live forms: each runs over a whole table as a stream until it has caught up, and writes its results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators import text
from quire.plans.gates import FOUND, STATES
from quire.plans.queries import ANCHORS, CHUNKS, chunks_sql
from quire.sources.scratch import shared_folder
from quire.sources.store import ChunkStore
from quire.streaming import streams


def _events(t) -> DataFrame:
    source = t.spark.readStream.schema(t("events").schema).parquet(f"{t.folder}/events.parquet*")
    return source.withColumn("ts", F.col("ts").cast("timestamp"))


def caught_up(t, df: DataFrame, tag: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what there is, and reads its rows; with mode `update` also the number of the batch (epoch) they came from."""
    folder = shared_folder(t.spark, tag)

    def batch(rows: DataFrame, epoch: int) -> None:
        rows.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{folder}/rows/run={epoch}")

    query = df.writeStream.outputMode(mode).foreachBatch(batch).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return t.spark.read.parquet(f"{folder}/rows").drop("run")


def _online(t):
    rows = caught_up(t, streams.online_users_exact(_events(t)), "online")
    return rows.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "online_users")


#: Windows of a day: as many users as the table has, so that an estimate has something to get wrong.
DAY, SIX_HOURS, ERROR = "24 hours", "6 hours", 0.02


def _estimated(t):
    """Windows with their exact number of users, and whether the live estimate lies within three deviations of it."""
    rows = caught_up(t, streams.online_users(_events(t), window=DAY, slide=SIX_HOURS, error=ERROR), "estimated").select("window", F.col("online_users").alias("estimate"))
    exact = t("events").withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.window("ts", DAY, SIX_HOURS)).agg(F.countDistinct("user_id").alias("exact"))
    near = F.abs(F.col("estimate") - F.col("exact")) <= F.greatest(F.lit(1), 3 * ERROR * F.col("exact"))
    return rows.join(exact, "window").select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "exact", near.alias("near"))


def _metrics(t):
    source = _events(t).select("ts", F.concat(F.lit("/"), "event_type").alias("route"), (F.col("value") / 100).alias("duration_s"))
    rows = caught_up(t, streams.request_metrics(source), "metrics")
    return rows.select(F.col("window.start").alias("start"), "route", "total", *[f"le_{i}" for i in range(9)], "p50_ms", "p90_ms", "p99_ms")


#: Time slices that a table is played in, one batch of files each; of their last hours some rows come with the next slice, within the allowed delay.
SLICES, LATE_HOURS, DELAY = 10, 3, "6 hours"


def replayed(t, rows: DataFrame, build, tag: str, mode: str = "append") -> DataFrame:
    """Plays rows with ts and seq slice by slice into a stream, which is stopped half way and started again from its checkpoint; returns what it wrote,
    with the number of the batch (epoch)."""
    folder = shared_folder(t.spark, tag)
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp"))
    span = rows.agg(F.min(F.unix_micros("ts")).alias("first"), F.max(F.unix_micros("ts")).alias("last")).first()
    width = max(1, ((span["last"] or 0) - (span["first"] or 0)) // SLICES + 1)
    into = F.unix_micros("ts") - (span["first"] or 0)
    shifted = F.when(F.col("seq") % 2 == 0, into + LATE_HOURS * 3_600_000_000).otherwise(into)
    rows.withColumn("slice", F.least(F.lit(SLICES - 1), F.floor(shifted / width)).cast("int")).write.partitionBy("slice").parquet(f"{folder}/slices")
    slices = t.spark.read.parquet(f"{folder}/slices")
    slices.filter("slice < 0").drop("slice").write.parquet(f"{folder}/in")

    def batch(df: DataFrame, epoch: int) -> None:
        df.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{folder}/rows/run={epoch}")

    with streams.keyed_state(t.spark):
        for half in (range(SLICES // 2), range(SLICES // 2, SLICES)):
            source = t.spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
            query = build(source).writeStream.outputMode(mode).foreachBatch(batch).option("checkpointLocation", f"{folder}/checkpoint").start()
            try:
                for k in half:
                    slices.filter(F.col("slice") == k).select(rows.columns).write.mode("append").parquet(f"{folder}/in")
                    query.processAllAvailable()
            finally:
                query.stop()
    return t.spark.read.parquet(f"{folder}/rows").drop("run")


def _consent(t):
    rows = replayed(t, t("fx_states").select("doc_id", "ts", "seq", "kind", "question"), lambda s: streams.consent_state(s, DELAY), "consent", "update")
    last = rows.groupBy("doc_id").agg(F.max_by(F.struct("sensitive", "confirmed", "awaiting", "pending"), F.struct("micros", "seq")).alias("x"))
    return last.select("doc_id", "x.*")


def _limits(t):
    rows = replayed(t, t("events").select("user_id", "ts", F.col("event_id").alias("seq")), lambda s: streams.rate_limit(s, late=DELAY), "limits")
    return rows.select("user_id", "ts", "seq", "allowed", F.col("count_in_window").cast("long").alias("count_in_window"), F.col("retry_hours").cast("string").alias("retry_hours"))


def _expired(t):
    shares = t("events").select(F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("share_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"))
    rows = replayed(t, shares.withColumn("expires_at", F.col("ts") + F.expr("INTERVAL 24 HOURS")), lambda s: streams.expire_shares(s, DELAY), "expired")
    return rows.select("share_id", "expired_at")


#: Files that uploads come in, and files of a batch.
UPLOAD_FILES, FILES_A_BATCH = 12, 3


def _uploads(t):
    """Uploads in many small files: half of them, a stop, the others from the same checkpoint, and the last batch once more; the rows of the store."""
    folder = shared_folder(t.spark, "uploads")
    docs = t("documents").select("doc_id", "text", (F.col("doc_id") % 2 == 0).alias("confirmed"), F.timestamp_seconds(F.col("doc_id") + 1_000_000).alias("ts"))
    known = t("documents").select("doc_id", (F.col("doc_id") % 100).alias("user_id"), F.concat(F.lit("file_"), "doc_id").alias("name"))
    store = ChunkStore(t.spark, f"{folder}/store")
    sink, halves = store.sink(known, "uploads"), docs.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY doc_id)")).first()[0]
    for half in (F.col("doc_id") <= F.lit(halves), F.col("doc_id") > F.lit(halves)):
        docs.filter(half).repartitionByRange(UPLOAD_FILES // 2, "doc_id").write.mode("append").parquet(f"{folder}/in")
        source = t.spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", FILES_A_BATCH).parquet(f"{folder}/in")
        streams.index_uploads(source, sink, f"{folder}/checkpoint", late="30 days").awaitTermination()
    done = store.read()
    sink(done.select("doc_id", "chunk", F.lit("again").alias("text")), 0)  # a batch that the store holds
    return store.read().select("doc_id", "chunk", "user_id", "filename", F.md5("text").alias("digest"))


def _store(t):
    """A store of all chunks in which one document in a hundred comes again with other chunks, twice."""
    known = t("documents").select("doc_id", (F.col("doc_id") % 100).alias("user_id"), F.concat(F.lit("file_"), "doc_id").alias("name"))
    store, chunks = ChunkStore(t.spark, shared_folder(t.spark, "store")), text.chunk(t("fx_paragraphs"))
    sink = store.sink(known, "texts")
    sink(chunks, 0)
    changed = chunks.filter("doc_id % 100 = 7 and chunk % 2 = 0").withColumn("text", F.concat(F.lit("changed "), "text"))
    sink(changed, 1)
    sink(changed.withColumn("text", F.lit("again")), 1)
    return store.read().select("doc_id", "chunk", "user_id", "filename", F.md5("text").alias("digest"))


#: What a window's end must reach before it is complete: the latest event less the allowed delay; the same for replayed rows.
CLOSED, PASSED = "(SELECT max(ts) - INTERVAL 10 MINUTES FROM events)", "(SELECT max(ts) - INTERVAL 6 HOURS FROM events)"
BUCKET = "time_bucket(INTERVAL 5 MINUTES, ts)"
BOUNDS = ["0.025", "0.05", "0.1", "0.25", "0.5", "1", "2", "5", "'inf'::DOUBLE"]


def bound_at(p: float) -> str:
    reached = " ".join(f"WHEN le_{i} >= {p} * total THEN {b}" for i, b in enumerate(BOUNDS))
    return f"round(1000 * CASE {reached} END) AS p{round(100 * p)}_ms"


QUERIES = {
    "live_online_users": (
        _online,
        f"""SELECT CAST(start AS TIMESTAMP) AS start, CAST(start + INTERVAL 10 MINUTES AS TIMESTAMP) AS "end", CAST(count(DISTINCT user_id) AS INT) AS online_users
            FROM (SELECT user_id, {BUCKET} AS start FROM events UNION ALL SELECT user_id, {BUCKET} - INTERVAL 5 MINUTES FROM events)
            GROUP BY start HAVING start + INTERVAL 10 MINUTES <= {CLOSED}""",
    ),
    "live_online_users_estimated": (
        _estimated,
        f"""SELECT CAST(start AS TIMESTAMP) AS start, CAST(start + INTERVAL 24 HOURS AS TIMESTAMP) AS "end", count(DISTINCT user_id) AS exact, TRUE AS near
            FROM (SELECT user_id, time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '2000-01-01') - to_hours(CAST(6 * k AS BIGINT)) AS start FROM events, range(4) r(k))
            GROUP BY start HAVING start + INTERVAL 24 HOURS <= {CLOSED}""",
    ),
    "live_request_metrics": (
        _metrics,
        f"""SELECT *, {bound_at(0.5)}, {bound_at(0.9)}, {bound_at(0.99)} FROM (
              SELECT CAST({BUCKET} AS TIMESTAMP) AS start, concat('/', event_type) AS route, count(*) AS total,
                     {', '.join(f"count(*) FILTER (WHERE value / 100 <= {b}) AS le_{i}" for i, b in enumerate(BOUNDS))}
              FROM events WHERE {BUCKET} + INTERVAL 5 MINUTES <= {CLOSED} GROUP BY 1, 2)""",
    ),
    "live_consent_state": (
        _consent,
        f"""WITH states AS (SELECT * FROM fx_states WHERE ts <= {PASSED}), {STATES.rsplit('fallbacks AS', 1)[0]}
            last AS (SELECT doc_id, arg_max({{'q': CASE WHEN kind IN ('empty', 'outside') THEN question END}}, (ts, seq)) AS pending
                     FROM gated WHERE kind IN ('empty', 'outside') OR (kind IN ('yes', 'no') AND NOT gate) GROUP BY doc_id)
            SELECT c.*, l.pending.q AS pending FROM consents c LEFT JOIN last l USING (doc_id)""",
    ),
    "live_rate_limit": (
        _limits,
        f"""{ANCHORS}
            SELECT user_id, CAST(ts AS TIMESTAMP) AS ts, event_id AS seq, k <= 3 AS allowed, least(k, 3) AS count_in_window,
                   CASE WHEN k > 3 THEN CAST(CAST(ceil(date_diff('microsecond', ts, t0 + INTERVAL 24 HOURS) / 3600000000) AS BIGINT) AS VARCHAR) END AS retry_hours
            FROM counted WHERE ts <= {PASSED}""",
    ),
    "live_expired_shares": (
        _expired,
        f"""SELECT concat('s', CAST(user_id AS VARCHAR)) AS share_id, CAST(ts + INTERVAL 24 HOURS AS TIMESTAMP) AS expired_at
            FROM (SELECT user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS then_ FROM events)
            WHERE (then_ IS NULL OR then_ >= ts + INTERVAL 24 HOURS) AND ts + INTERVAL 24 HOURS <= {PASSED}""",
    ),
    "live_index_uploads": (
        _uploads,
        f"""SELECT doc_id, chunk, doc_id % 100 AS user_id, concat('file_', CAST(doc_id AS VARCHAR)) AS filename, md5(text) AS digest
            FROM ({chunks_sql(1000, f'SELECT doc_id, text FROM documents WHERE doc_id % 2 = 0 OR ({FOUND}) = 0')})""",
    ),
    "chunk_store": (
        _store,
        f"""SELECT doc_id, chunk, doc_id % 100 AS user_id, concat('file_', CAST(doc_id AS VARCHAR)) AS filename, md5(CASE WHEN doc_id % 100 = 7 THEN concat('changed ', text) ELSE text END) AS digest
            FROM ({CHUNKS}) WHERE doc_id % 100 <> 7 OR chunk % 2 = 0""",
    ),
}
