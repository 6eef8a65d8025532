"""Conversations, ratings, and shared snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def overview(messages: DataFrame, chats: DataFrame | None = None, documents: DataFrame | None = None) -> DataFrame:
    """conv_id, message_count, last_role, last_text of each conversation; with `chats` (conv_id, doc_id) and `documents` also document_name."""
    last = messages.groupBy("conv_id").agg(F.count("*").alias("message_count"), F.max_by(F.struct("role", "text"), "turn").alias("x"))
    rows = last.select("conv_id", "message_count", F.col("x.role").alias("last_role"), F.col("x.text").alias("last_text"))
    if chats is None or documents is None:
        return rows
    return rows.join(chats.select("conv_id", "doc_id"), "conv_id", "left").join(documents.select("doc_id", F.col("name").alias("document_name")), "doc_id", "left").drop("doc_id")


def append(messages: DataFrame, new: DataFrame, now: str) -> DataFrame:
    """Messages with accepted submissions (submission_id, conv_id, seq, role, text, sent_at, rating) after their turns; one bad message
    rejects its submission: an unknown role, or no text (an empty one will do). Answers without a rating get `none`, others have none.
    """
    good = F.col("role").isin("user", "assistant", "system") & F.col("text").isNotNull()
    fine = new.groupBy("submission_id").agg(F.bool_and(F.coalesce(good, F.lit(False))).alias("_ok")).filter("_ok").select("submission_id")
    top = messages.groupBy("conv_id").agg(F.max("turn").alias("_top"))
    rows = new.join(fine, "submission_id", "left_semi").join(top, "conv_id", "left")
    turn = F.coalesce("_top", F.lit(-1)) + F.row_number().over(Window.partitionBy("conv_id").orderBy("submission_id", "seq"))
    rating = F.when(F.col("role") == "assistant", F.coalesce(F.nullif(F.col("rating"), F.lit("")), F.lit("none")))
    added = rows.select("conv_id", turn.cast("long").alias("turn"), "role", "text", F.coalesce("sent_at", F.lit(now).cast("timestamp")).alias("sent_at"), rating.alias("rating"))
    return messages.select("conv_id", "turn", "role", "text", "sent_at", "rating").unionByName(added)


def apply_ratings(messages: DataFrame, ratings: DataFrame) -> DataFrame:
    """conv_id, turn, rating, reason for the last rating (by ts) of each turn; reason is null where it is accepted."""
    last = ratings.groupBy("conv_id", "turn").agg(F.max_by("rating", "ts").alias("rating"))
    m = messages.select("conv_id", "turn", F.col("role").alias("_role"))
    reason = F.when(~F.coalesce(F.col("rating").isin("positive", "negative", "none"), F.lit(False)), "bad rating").when(F.col("_role").isNull(), "no such turn").when(F.col("_role") != "assistant", "not an answer")
    return last.join(m, ["conv_id", "turn"], "left").select("conv_id", "turn", "rating", reason.alias("reason"))


def feedback_summary(messages: DataFrame) -> DataFrame:
    """rating, n for positive and negative, both always there."""
    n = messages.filter("role = 'assistant'").agg(F.count_if(F.col("rating") == "positive").alias("p"), F.count_if(F.col("rating") == "negative").alias("n"))
    return n.select(F.explode(F.create_map(F.lit("positive"), "p", F.lit("negative"), "n")).alias("rating", "n"))


def snapshot_hash(messages: DataFrame) -> DataFrame:
    """conv_id, snapshot_hash, message_count: SHA-256 of role and text of all messages in order."""
    rows = F.array_sort(F.collect_list(F.struct("turn", F.concat(F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("\n")).alias("t"))))
    return messages.groupBy("conv_id").agg(F.sha2(F.array_join(F.transform(rows, lambda x: x["t"]), ""), 256).alias("snapshot_hash"), F.count("*").alias("message_count"))


def plan_shares(snapshots: DataFrame, shares: DataFrame, now: str) -> DataFrame:
    """conv_id, action (reuse, new, reject), share_id, expires_at: the newest share of the conversation is reused if its hash is equal."""
    t = F.lit(now).cast("timestamp")
    newest = shares.groupBy("conv_id").agg(F.max_by(F.struct("share_id", "snapshot_hash"), F.struct("created_at", "share_id")).alias("s"))
    id_ = F.substring(F.translate(F.base64(F.unhex(F.sha2(F.concat_ws("|", F.col("conv_id").cast("string"), "snapshot_hash", F.lit(now)), 256))), "+/", "-_"), 1, 12)
    action = F.when(F.col("message_count") == 0, "reject").when(F.col("s.snapshot_hash") == F.col("snapshot_hash"), "reuse").otherwise("new")
    out = snapshots.join(newest, "conv_id", "left").withColumn("action", action)
    return out.select("conv_id", "action", F.when(F.col("action") == "reuse", F.col("s.share_id")).when(F.col("action") == "new", id_).alias("share_id"), F.when(F.col("action") != "reject", t + F.expr("INTERVAL 24 HOURS")).alias("expires_at"))


def resolve_shares(requests: DataFrame, shares: DataFrame, now: str) -> DataFrame:
    """share_id, outcome (missing, expired, ok), title."""
    found = requests.join(shares.select("share_id", "title", "document_name", "expires_at", F.lit(True).alias("_have")), "share_id", "left")
    outcome = F.when(F.col("_have").isNull(), "missing").when(F.col("expires_at") <= F.lit(now).cast("timestamp"), "expired").otherwise("ok")
    return found.select("share_id", outcome.alias("outcome"), F.when(outcome == "ok", F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col("document_name"), F.lit("Shared chat"))).alias("title"))


def purge_expired(shares: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """Shares that stay, and the number removed (removed)."""
    gone = F.coalesce(F.col("expires_at") <= F.lit(now).cast("timestamp"), F.lit(False))
    return shares.filter(~gone), shares.agg(F.count_if(gone).alias("removed"))


def transcript(messages: DataFrame, per_page: int = 6) -> DataFrame:
    """conv_id, n, page, label, text, sent_at: messages in order, `per_page` a page."""
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    return messages.withColumn("n", n).select("conv_id", "n", (F.floor(F.col("n") / per_page) + 1).alias("page"), F.when(F.col("role") == "user", "You").otherwise("Assistant").alias("label"), "text", "sent_at")
