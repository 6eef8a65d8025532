"""Live forms of intake, presence, consent, limits, metrics and expiry as Structured Streaming queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from quire.operators.guard import is_sensitive, stepped
from quire.operators.metrics import BOUNDS
from quire.operators.text import chunk


def index_uploads(uploads: DataFrame, upsert: Callable[[DataFrame, int], None], checkpoint: str, late: str = "10 minutes"):
    """Starts a query that scans and chunks each new document (doc_id, text, confirmed, ts) once, and upserts the chunks of allowed ones, with the
    number of the batch: one that fails comes again with the same number (ChunkStore.sink takes it once)."""

    def batch(df: DataFrame, epoch: int) -> None:
        held = df.persist()
        try:
            held.write.format("noop").mode("overwrite").save()  # all of it, also where the store holds the batch: the stream's own state goes on with it
            upsert(chunk(held.filter(F.coalesce("confirmed", F.lit(False)) | ~is_sensitive(F.col("text")))), epoch)
        finally:
            held.unpersist()

    fresh = uploads.withWatermark("ts", late).dropDuplicatesWithinWatermark(["doc_id"])
    return fresh.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def online_users(activity: DataFrame, late: str = "10 minutes", window: str = "10 minutes", slide: str = "5 minutes", error: float = 0.02) -> DataFrame:
    """window, online_users: distinct users (user_id, ts) in sliding windows, estimated within `error` (relative standard deviation).

    A window's state is one sketch, whose size depends on the error alone; sketches of tasks and batches are merged.
    """
    return activity.withWatermark("ts", late).groupBy(F.window("ts", window, slide)).agg(F.approx_count_distinct("user_id", error).alias("online_users"))


def online_users_exact(activity: DataFrame, late: str = "10 minutes", window: str = "10 minutes", slide: str = "5 minutes") -> DataFrame:
    """window, online_users as above but exact, for windows of few users: the state holds each of them."""
    return activity.withWatermark("ts", late).groupBy(F.window("ts", window, slide)).agg(F.size(F.collect_set("user_id")).alias("online_users"))


def request_metrics(requests: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """window, route, total, a cumulative count for each latency bound, and p50_ms, p90_ms, p99_ms: the smallest bounds that such shares stay under."""
    counts = [F.sum((F.col("duration_s") <= b).cast("long")).alias(f"le_{i}") for i, b in enumerate(BOUNDS)]
    sums = requests.withWatermark("ts", late).groupBy(F.window("ts", window), "route").agg(F.count("*").alias("total"), *counts)

    def bound(share: float):
        out = F
        for i, b in enumerate(BOUNDS):
            out = out.when(F.col(f"le_{i}") >= share * F.col("total"), F.lit(b))
        return F.round(1000 * out)

    return sums.select("*", *[bound(x / 100).alias(f"p{x}_ms") for x in (50, 90, 99)])


@contextmanager
def keyed_state(spark: SparkSession):
    """Queries over consent_state, rate_limit and expire_shares are started within this: their processors need a state store with timers."""
    name, store = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name)
    spark.conf.set(name, store)
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: Groups that keys are dealt to: each is one call of a processor for a batch, however many keys it has.
GROUPS = 512


class InOrder(StatefulProcessor):
    """Holds the rows (key, micros, seq, ...) of a group of keys until the watermark has passed them, and folds each key's in order of time, whatever
    batches they came in. A timer waits for the first row held and for the first deadline of a state; rows of the delay are all that is held.

    A group has one list of rows and one of states, so a batch costs a few calls to the state store for each group and none for a key.
    """

    ROW = STATE = ""
    START: tuple = ()

    def __init__(self, key_type: str):
        self.key_type = key_type

    def init(self, handle) -> None:
        self.handle = handle
        self.held, self.states = handle.getListState("held", f"key {self.key_type}, {self.ROW}"), handle.getListState("states", f"key {self.key_type}, {self.STATE}")
        self.due = handle.getValueState("due", "micros long")

    def step(self, state: tuple, row: tuple, out: list[tuple]) -> tuple:
        """The state after a row; what it tells is appended to `out`."""
        raise NotImplementedError

    def deadline(self, state: tuple) -> int | None:
        """When the state ends by itself."""
        return None

    def ended(self, state: tuple, out: list[tuple]) -> None:
        """What is told when it does."""

    def told(self, key, state: tuple, out: list[tuple], ready: bool) -> list[tuple]:
        """Rows of a key that had rows or told something."""
        return [(key, *r) for r in out]

    def frame(self, rows: list[tuple]) -> pd.DataFrame:
        raise NotImplementedError

    def wake(self, micros: int) -> None:
        if not self.due.exists() or micros < self.due.get()[0]:
            self.due.update((micros,))
            self.handle.registerTimer(-(-micros // 1000))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        names = ["key", *[c.split()[0] for c in self.ROW.split(", ")]]
        new = [r for pdf in rows for r in pdf[names].astype(object).itertuples(index=False, name=None)]
        if new:
            self.held.appendList(new)
            self.wake(min(r[1] for r in new))
        return iter(())

    def folded(self, key, state: tuple, rows: list[tuple], now: int) -> tuple[tuple, list[tuple]]:
        """A key's state after the rows that `now` has passed, in order, and what that tells."""
        out: list[tuple] = []
        for row in rows:
            if (end := self.deadline(state)) is not None and end <= row[0]:
                self.ended(state, out)
                state = self.START
            state = self.step(state, row, out)
        if (end := self.deadline(state)) is not None and end <= now:
            self.ended(state, out)
            state = self.START
        return state, self.told(key, state, out, bool(rows))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs() * 1000
        if not self.due.exists() or self.due.get()[0] > now:  # an earlier timer has done it
            return
        held = sorted((tuple(r) for r in self.held.get()), key=lambda r: r[1:3])
        states = {r[0]: tuple(r[1:]) for r in self.states.get()}
        ready: dict = {k: [] for k, s in states.items() if (end := self.deadline(s)) is not None and end <= now}
        for row in held:
            if row[1] <= now:
                ready.setdefault(row[0], []).append(row[1:])
        later, rows = [r for r in held if r[1] > now], []
        for k, some in ready.items():
            states[k], told = self.folded(k, states.get(k, self.START), some, now)
            rows += told
        kept = [(k, *s) for k, s in states.items() if s != self.START]
        for state, values in ((self.held, later), (self.states, kept)):
            if values:
                state.put(values)
            else:
                state.clear()
        self.due.clear()
        if waits := [r[1] for r in later[:1]] + [end for s in kept if (end := self.deadline(s[1:])) is not None]:
            self.wake(min(waits))
        if rows:
            yield self.frame(rows)

    def close(self) -> None:
        pass


def in_order(rows: DataFrame, key: str, processor: Callable[[str], InOrder], told: str, late: str, mode: str = "Append") -> DataFrame:
    held = rows.withWatermark("ts", late).withColumn("micros", F.unix_micros("ts")).withColumnRenamed(key, "key")
    dealt = held.withColumn("_group", F.pmod(F.xxhash64("key"), F.lit(GROUPS)).cast("int"))
    return dealt.groupBy("_group").transformWithStateInPandas(processor(rows.schema[key].dataType.simpleString()), told, mode, "EventTime")


class Consent(InOrder):
    ROW, STATE = "micros long, seq long, kind string, question string", "micros long, seq long, sensitive boolean, confirmed boolean, awaiting boolean, pending string"
    START = (None, None, False, False, False, None)

    def step(self, state, row, out):
        micros, seq, kind, question = row
        _, _, sensitive, confirmed, awaiting, pending = state
        if kind in ("empty", "outside"):
            pending = question
        elif kind in ("yes", "no") and not (sensitive and not confirmed):
            pending = None
        return (micros, seq, *stepped((sensitive, confirmed, awaiting), kind), pending)

    def told(self, key, state, out, ready):
        return [(key, *state)] if ready else []

    def frame(self, rows):
        return pd.DataFrame(rows, columns=["doc_id", "micros", "seq", "sensitive", "confirmed", "awaiting", "pending"])


def consent_state(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """doc_id, micros, seq (of the last event), sensitive, confirmed, awaiting, pending after events (doc_id, ts, seq, kind, question) that the watermark has passed.

    Kinds are those of guard.consent_state, and `empty` and `outside` for questions that the document didn't answer: the last of them is pending
    until a `yes` or `no` that isn't about consent.
    """
    return in_order(events, "doc_id", Consent, f"doc_id long, {Consent.STATE}", late, "Update")


class Limit(InOrder):
    ROW, STATE, START = "micros long, seq long", "start long, n long", (None, 0)

    def __init__(self, key_type: str, most: int, span: int):
        super().__init__(key_type)
        self.most, self.span = most, span

    def step(self, state, row, out):
        t0, n = (row[0], 0) if state[0] is None else state
        ok = n < self.most
        out.append((row[0], row[1], ok, n + ok, None if ok else -((row[0] - t0 - self.span) // 3_600_000_000)))
        return t0, n + ok

    def deadline(self, state):
        return None if state[0] is None else state[0] + self.span

    def frame(self, rows):
        return pd.DataFrame(rows, columns=["user_id", "micros", "seq", "allowed", "count_in_window", "retry_hours"]).astype({"retry_hours": "Int64"})


def rate_limit(events: DataFrame, most: int = 3, hours: int = 24, late: str = "10 minutes") -> DataFrame:
    """user_id, ts, seq, allowed, count_in_window, retry_hours (where not allowed) for live changes (user_id, ts, seq) that the watermark has passed."""
    told = in_order(events, "user_id", lambda key: Limit(key, most, hours * 3_600_000_000), "user_id long, micros long, seq long, allowed boolean, count_in_window long, retry_hours long", late)
    return told.withColumn("ts", F.timestamp_micros("micros")).drop("micros")


class Expiry(InOrder):
    ROW, STATE, START = "micros long, seq long, end long", "end long", (None,)

    def step(self, state, row, out):
        return (row[2] if state[0] is None else max(state[0], row[2]),)

    def deadline(self, state):
        return state[0]

    def ended(self, state, out):
        out.append(state)

    def frame(self, rows):
        return pd.DataFrame(rows, columns=["share_id", "end"])


def expire_shares(shares: DataFrame, late: str = "10 minutes") -> DataFrame:
    """share_id, expired_at of shares (share_id, ts, expires_at) once event time has passed their expiry; a row before that extends it, a row
    after it starts the share anew."""
    told = in_order(shares.withColumn("seq", F.lit(0).cast("long")).withColumn("end", F.unix_micros("expires_at")), "share_id", Expiry, "share_id string, end long", late)
    return told.select("share_id", F.timestamp_micros("end").alias("expired_at"))
