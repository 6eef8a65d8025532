"""A training corpus from raw documents: rules, language, near-duplicates, mixture, token ids."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.byte_bpe import document_codes
from quire.llm.common import free_name, materialise, passing_scratch
from quire.llm.divergence import keep_good
from quire.llm.langid import learn_languages, with_language
from quire.llm.mixing import drawn
from quire.llm.similar import similar_components

#: Least posterior of the predicted language, and least fit. At sf0.1 held-out texts of a learnt language are at -1.26 or above (labelled good ones at
#: -0.92), texts of a language left out of the learning at -1.45 or below.
LEAST_CONFIDENCE, LEAST_FIT = 0.5, -1.4
#: Near-duplicates: words of a shingle, and least Jaccard similarity of the shingle sets in percent.
SHINGLE_WORDS, LEAST_SIMILAR = 5, 80
#: Ids of dropped or repeated documents up to this number are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Rows of an Arrow batch of texts at most; executors and Python workers hold each batch several times over.
BATCH_ROWS = 1_000
#: Shares of the tokens by domain; good documents are wanted a little more often than they occur, so none of them is left
#: out, and toxic ones aren't wanted.
WEIGHTS, SCALE, WHOLE = {"good": 0.98, "low": 0.02, "toxic": 0.0}, 1.02, "good"


def small_batches(spark: SparkSession) -> None:
    """Holds the session's Arrow batches to BATCH_ROWS. That stays so, since what a stage returns is planned when the caller writes it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Null, empty and short texts fail the base rule. Repeated rows, null ids, and other columns pass through as they are.
    """
    return keep_good(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with confidence and that read like it; learns from the lang of the documents themselves.

    A language that no document names is rejected by its fit. Texts that are null or hold no letter have no language and go; so do all where no row has a lang. Repeated rows count as
    often as they occur, null ids and other columns pass through as they are.
    """
    small_batches(spark)
    told = free_name(docs, "told")
    marked = with_language(docs, learn_languages(docs), F.col("text"), told)
    sure = (F.col(f"{told}.score") >= LEAST_CONFIDENCE) & (F.col(f"{told}.fit") >= LEAST_FIT)
    return marked.filter((F.col(f"{told}.lang_pred") != "und") & sure).drop(told)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id.

    Null, empty and blank texts are copies of each other. Rows that repeat a doc_id are one document, the first by a hash of its
    text. Rows without a doc_id are told apart by a hash of their text and come after all others. Of an empty table nothing is left; other
    columns are kept, whatever their names.
    """
    small_batches(spark)
    key, order = free_name(docs, "key"), free_name(docs, "order")
    unnamed = F.lit(1 << 62) + F.pmod(F.xxhash64("text"), F.lit(1 << 61))
    keyed = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), unnamed))
    # the result reads these two tables only
    with passing_scratch(spark):
        found = materialise(similar_components(keyed.select(F.col(key).alias("doc_id"), "text"), SHINGLE_WORDS, LEAST_SIMILAR), "classes")
        named = found.select(F.col("component_id").alias("doc_id")).distinct()
        gone = materialise(found.select("doc_id").distinct().join(named, "doc_id", "left_anti").select(F.col("doc_id").alias(key)), "gone", lasting=True)
        again = materialise(keyed.groupBy(key).agg(F.count("*").alias(order)).filter(F.col(order) > 1).select(key), "again", lasting=True)
    gone, again = (F.broadcast(x) if x.count() <= BROADCAST_IDS else x for x in (gone, again))
    kept = keyed.join(gone, key, "left_anti")
    first = F.row_number().over(Window.partitionBy(key).orderBy(F.xxhash64("text")))
    one = kept.join(again, key, "left_semi").withColumn(order, first).filter(F.col(order) == 1)
    return kept.join(again, key, "left_anti").select(*docs.columns).union(one.select(*docs.columns))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn at the rates that meet the target weights; a rate over one gives copies.

    Rows with null or empty texts weigh nothing and are drawn like others; identical rows are drawn alike. Null ids and other
    columns pass through as they are.
    """
    return drawn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), WEIGHTS, SCALE, WHOLE)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the bytes decoded from them; none for null and empty texts."""
    small_batches(spark)
    return document_codes(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("quality rules", quality),
    ("language ID", language),
    ("SimHash near-dedup", near_dedup),
    ("mixing sources to target weights", mixture),
    ("byte-level BPE encoding and decoding", encode),
]
#: The stages learn, iterate and link, which SQL can't express; tests hold the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs, name.replace(" ", "-"))
    return docs
