"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.joins import BROADCAST_ROWS, few

SCHEMAS = {
    "users": "user_id BIGINT, name STRING, email STRING, google_id STRING, avatar STRING, auth_provider STRING, last_login TIMESTAMP, is_admin BOOLEAN, is_active BOOLEAN, role STRING, created_at TIMESTAMP",
    "documents": "doc_id BIGINT, user_id BIGINT, name STRING, type STRING, size BIGINT, text STRING, uploaded_at TIMESTAMP, original_type STRING, pinned BOOLEAN, pinned_at TIMESTAMP",
    "chunks": "doc_id BIGINT, chunk INT, user_id BIGINT, filename STRING, sheet STRING, text STRING, embedding ARRAY<FLOAT>",
    "messages": "conv_id BIGINT, turn BIGINT, role STRING, text STRING, sent_at TIMESTAMP, rating STRING",
    "shares": "share_id STRING, created_by BIGINT, document BIGINT, snapshot_hash STRING, message_count BIGINT, created_at TIMESTAMP, expires_at TIMESTAMP",
    "reports": "report_id BIGINT, user_id BIGINT, subject STRING, message STRING, status STRING, created_at TIMESTAMP",
    "requests": "ts TIMESTAMP, method STRING, route STRING, status_code INT, duration_s DOUBLE",
}
#: Endings and MIME types of files that are read as text.
TEXT_ENDINGS, TEXT_TYPES = ["txt"], ["text/plain"]


def read_text_files(spark: SparkSession, path: str, types: DataFrame | None = None) -> DataFrame:
    """path, name, size, modified, text of each file: UTF-8 with undecodable bytes dropped; files that aren't text by their ending, or by
    their type in `types` (path, type), give the empty text."""
    files = spark.read.format("binaryFile").load(path)
    text = F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "\ufffd", "")
    name = F.element_at(F.split("path", "/"), -1)
    plain = F.lower(F.element_at(F.split(name, "\\."), -1)).isin(TEXT_ENDINGS)
    if types is not None:
        files = files.join(types.select("path", "type"), "path", "left")
        plain = plain | F.coalesce(F.col("type").isin(TEXT_TYPES), F.lit(False))
    return files.select("path", name.alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.when(plain, text).otherwise("").alias("text"))


def write_tables(rows: dict[str, DataFrame], folder: str) -> None:
    """Writes entity tables to a folder as read_tables reads them. Texts come again and again (one message in many reports), which zstd finds across rows."""
    for name, df in rows.items():
        df.write.option("compression", "zstd").parquet(f"{folder}/{name}.parquet")


def read_tables(spark: SparkSession, folder: str, kind: str = "parquet") -> dict[str, DataFrame]:
    """The entity tables of a folder, with the schemas fixed here."""
    return {name: spark.read.format(kind).schema(schema).load(f"{folder}/{name}.{kind}") for name, schema in SCHEMAS.items()}


def upsert_chunks(new: DataFrame, existing: DataFrame, documents: DataFrame) -> DataFrame:
    """Existing chunks without those of documents that `new` brings, and the new ones: last of each (doc_id, chunk) by `seq`.

    A known document loses its old chunks even if none of its new ones is valid. Rows whose chunk is no number or whose text is null, and
    those of documents that `documents` (doc_id, user_id, name) doesn't have, are dropped; an empty sheet is null, a null or empty
    filename is the document's name, and the user is the document's.
    """
    asked = new.select("doc_id").distinct()
    owners = documents.select("doc_id", F.col("user_id").alias("_user"), F.col("name").alias("_name")).join(few(asked), "doc_id", "left_semi")
    known = new.join(few(owners), "doc_id")
    fine = known.withColumn("chunk", F.expr("try_cast(chunk AS INT)")).filter("chunk is not null and text is not null")
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    row = F.struct(F.col("_user").alias("user_id"), F.coalesce(filled("filename"), F.col("_name")).alias("filename"), filled("sheet").alias("sheet"), "text", "embedding")
    # what comes how often is told by numbers alone: chunks that come once need no choice, and few that come often are found by the number of their last row
    latest = fine.groupBy("doc_id", "chunk").agg(F.max("seq").alias("_seq"), F.count("*").alias("_n"))
    keys = latest.agg(F.count("*").alias("n"), F.max("_n").alias("most")).first()
    if (keys["most"] or 1) == 1:
        last = fine.select("doc_id", "chunk", row.alias("x")).select("doc_id", "chunk", "x.*")
    else:
        if keys["n"] <= BROADCAST_ROWS:
            fine = fine.join(F.broadcast(latest), ["doc_id", "chunk"]).filter(F.col("seq").eqNullSafe(F.col("_seq")))
        last = fine.groupBy("doc_id", "chunk").agg(F.max_by(row, "seq").alias("x")).select("doc_id", "chunk", "x.*")
    columns = ["doc_id", "chunk", "user_id", "filename", "sheet", "text", "embedding"]
    return existing.join(few(owners.select("doc_id").distinct()), "doc_id", "left_anti").select(columns).unionByName(last.select(columns))


def write_flashcards_json(deck: DataFrame, path: str) -> None:
    """A deck as JSON lines, a file for each partition."""
    deck.select("request_id", "position", "front", "back", "category", "difficulty").write.mode("overwrite").json(path)
