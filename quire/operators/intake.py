"""Checks on uploads and reports as they come in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.joins import few

#: Senders whose names and addresses are broadcast, so that messages stay where they are; with more, reports are joined by a shuffle.
MOST_SENDERS = 1_000_000
#: MIME types, endings, subjects and characters that no name may hold.
WORD_TYPES = ["application/msword", "application/vnd.openxmlformats-officedocument.wordprocessingml.document"]
TYPES = ["application/pdf", *WORD_TYPES, "text/plain", "text/markdown"]
EXTENSIONS = ["pdf", "doc", "docx", "txt", "md"]
SUBJECTS = ["Bug", "Feedback", "Feature Request", "Other"]
BAD_NAME = '[<>:"/\\\\|?*]'


def extension(name: Column) -> Column:
    return F.lower(F.element_at(F.split(F.coalesce(name, F.lit("")), "\\."), -1))


def validate_files(files: DataFrame, most_bytes: int = 25 << 20) -> DataFrame:
    """Adds reason, the first that holds: unsupported type, too large, invalid name; null for an accepted file."""
    fine = F.coalesce(F.col("type").isin(TYPES), F.lit(False)) | extension(F.col("name")).isin(EXTENSIONS)
    bad = F.col("name").rlike(BAD_NAME) | (F.length("name") > 255) | F.col("name").isNull()
    return files.withColumn("reason", F.when(~fine, "unsupported type").when(F.col("size") > most_bytes, "too large").when(bad, "invalid name"))


def dedupe_files(files: DataFrame) -> DataFrame:
    """The first arrival of each (name, size, last_modified)."""
    w = Window.partitionBy("name", "size", "last_modified").orderBy("arrival")
    return files.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def converted_name(files: DataFrame) -> DataFrame:
    """Adds stored_name (Word endings become .pdf) and converted (Word at first, stored as PDF)."""
    return files.withColumn("stored_name", F.regexp_replace("name", "\\.(docx?|DOCX?)$", ".pdf")).withColumn("converted", F.coalesce(F.col("original_type").isin(WORD_TYPES) & (F.col("type") == "application/pdf"), F.lit(False)))


def backfill_doc_id(rows: DataFrame, key: str = "id") -> DataFrame:
    """An empty or null doc_id becomes the key as text."""
    return rows.withColumn("doc_id", F.coalesce(F.nullif(F.col("doc_id"), F.lit("")), F.col(key).cast("string")))


def accept_reports(reports: DataFrame, users: DataFrame) -> DataFrame:
    """Reports (user_id, subject, message) with trimmed texts, the user's name and lower-cased email, and a reject reason."""
    who = users.select("user_id", F.col("name").alias("name"), F.lower("email").alias("email"), F.lit(True).alias("_known"))
    who = few(who.join(few(reports.select("user_id").distinct(), MOST_SENDERS), "user_id", "left_semi"), MOST_SENDERS)
    s, m = F.trim(F.coalesce("subject", F.lit(""))), F.trim(F.coalesce("message", F.lit("")))
    reason = F.when(s == "", "no subject").when(m == "", "no message").when(F.col("_known").isNull(), "unknown user").when(~s.isin(SUBJECTS), "unknown subject").when(~F.length(m).between(10, 1000), "message length")
    return reports.join(who, "user_id", "left").withColumn("reason", reason).withColumn("subject", s).withColumn("message", m).drop("_known")
