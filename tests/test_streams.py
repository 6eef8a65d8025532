"""Live state across batches on literal rows: order of time whatever the batch, rows that come too late, timers."""

import pytest
from pyspark.sql import functions as F

from quire.sources.scratch import shared_folder
from quire.streaming import streams

HOUR = 3600


def played(spark, batches, kind, build, mode="append"):
    """Rows that a stream tells, a list for each batch of (..., seconds, ...) rows given to it; it starts anew for every batch."""
    folder, out = shared_folder(spark, "played"), []
    spark.createDataFrame([], kind).write.parquet(f"{folder}/in")
    with streams.keyed_state(spark):
        for rows in batches:
            spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(f"{folder}/in")
            told = []
            source = spark.readStream.schema(kind).parquet(f"{folder}/in").withColumn("ts", F.timestamp_seconds("s"))
            query = build(source).writeStream.outputMode(mode).foreachBatch(lambda df, epoch: told.extend(df.collect())).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()  # noqa: B023
            query.awaitTermination()
            out.append(told)
    return out


def test_limits_across_batches(spark):
    """The fourth change of a day comes in the first batch, the third in the second; a row older than the watermark is left out."""
    t = 1_000_000
    batches = [
        [(1, t, 1), (1, t + 10, 2), (1, t + 300, 4), (2, t + 60 * HOUR, 9)],
        [(1, t + 61 * HOUR, 6), (1, t + 55 * HOUR, 5), (1, t + 100, 3), (2, t + 90 * HOUR, 10)],
        [(3, t + 200 * HOUR, 11)],
    ]
    # with a delay of 70 hours the row of t + 100 comes in time, with one of 10 hours it doesn't
    late = played(spark, batches, "user_id long, s long, seq long", lambda s: streams.rate_limit(s, late="70 hours"))
    assert sorted((r.user_id, r.seq, r.allowed, r.count_in_window, r.retry_hours) for told in late for r in told) == [
        (1, 1, True, 1, None), (1, 2, True, 2, None), (1, 3, True, 3, None), (1, 4, False, 3, 24), (1, 5, True, 1, None), (1, 6, True, 2, None), (2, 9, True, 1, None), (2, 10, True, 1, None),
    ]
    strict = played(spark, batches, "user_id long, s long, seq long", lambda s: streams.rate_limit(s, late="10 hours"))
    assert (1, 3) not in {(r.user_id, r.seq) for told in strict for r in told} and (1, 4, True) in {(r.user_id, r.seq, r.allowed) for told in strict for r in told}


def test_shares_expire_by_timers(spark):
    """A row in a later batch extends a share; one after its end starts it anew."""
    t = 1_000_000
    kind = "share_id string, s long, e long"
    batches = [[("a", t, t + 10 * HOUR), ("b", t, t + 5 * HOUR)], [("a", t + 8 * HOUR, t + 30 * HOUR), ("c", t + 20 * HOUR, t + 500 * HOUR)], [("b", t + 21 * HOUR, t + 22 * HOUR), ("c", t + 60 * HOUR, t + 70 * HOUR)]]
    told = played(spark, batches, kind, lambda s: streams.expire_shares(s.withColumn("expires_at", F.timestamp_seconds("e")), late="1 hour"))
    got = [{(r.share_id, int(r.expired_at.timestamp()) - t) for r in x} for x in told]
    assert set().union(*got) == {("a", 30 * HOUR), ("b", 5 * HOUR), ("b", 22 * HOUR)} and ("b", 5 * HOUR) in got[1]


@pytest.mark.parametrize("late", ["30 hours"])
def test_consent_across_batches(spark, late):
    t = 1_000_000
    kind = "doc_id long, s long, seq long, kind string, question string"
    batches = [[(1, t + 20, 2, "ask", "q"), (2, t, 1, "empty", "why")], [(1, t + 10, 1, "scan_hit", None), (9, t + 100 * HOUR, 1, "other", None)], [(1, t + 80 * HOUR, 3, "yes", None), (2, t + 80 * HOUR, 2, "yes", None), (9, t + 200 * HOUR, 2, "other", None)]]
    told = played(spark, batches, kind, lambda s: streams.consent_state(s, late), "update")
    state = lambda x: {r.doc_id: (r.sensitive, r.confirmed, r.awaiting, r.pending) for r in x if r.doc_id < 9}
    assert [state(x) for x in told] == [{}, {1: (True, False, True, None), 2: (False, False, False, "why")}, {1: (True, True, False, None), 2: (False, False, False, None)}]


def test_estimated_users(spark):
    """The state of a window is one sketch; the estimate of 20,000 users lies within three deviations."""
    rows = spark.range(20_000).select(F.col("id").alias("user_id"), F.timestamp_seconds(F.lit(1_000_000) + F.col("id") % 60).alias("ts")).union(spark.createDataFrame([(1, 2_000_000)], "user_id long, s long").select("user_id", F.timestamp_seconds("s")))
    folder = shared_folder(spark, "users")
    rows.write.parquet(f"{folder}/in")
    told, sizes = [], []
    source = spark.readStream.schema("user_id long, ts timestamp").parquet(f"{folder}/in")
    query = streams.online_users(source).writeStream.foreachBatch(lambda df, e: told.extend(df.collect())).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    sizes = [s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"]]
    assert len(told) == 2 and all(abs(r.online_users - 20_000) < 3 * 0.02 * 20_000 for r in told) and max(sizes) <= 4
