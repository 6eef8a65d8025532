"""The pipeline against its stages done plainly on the driver."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import divergence, langid
from quire.llm.common import words_of
from quire.llm.vptree import shingle_hashes

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet").withColumn("told", F.lit(1)), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        out.append({r.doc_id: r for r in docs.collect()})
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "told"], name
    return out


def test_stages(spark, kept):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert set(kept[0]) == {r.doc_id for r in divergence.quality_verdicts(docs).filter("kept").collect()}
    first = docs.filter(F.col("doc_id").isin(list(kept[0])))
    model = langid.learn_languages(first).model(0)
    logs = langid.score_batch(model, [r.text for r in kept[0].values()])
    fit = logs.max(axis=1) / langid.gram_counts([r.text for r in kept[0].values()]) - model.level[logs.argmax(axis=1)]
    sure = (1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1) >= corpus_pipeline.LEAST_CONFIDENCE) & (fit >= corpus_pipeline.LEAST_FIT)
    assert set(kept[1]) == {i for i, x in zip(kept[0], sure) if x}
    ids = sorted(kept[1])
    sets = [set(shingle_hashes(words_of(kept[1][i].text), 5, 42)) for i in ids]
    near = np.array([[len(a & b) >= 0.8 * len(a | b) for b in sets] for a in sets])
    label = np.array(ids)
    for _ in ids:
        label = np.array([label[x].min() for x in near])
    assert set(kept[2]) == set(label.tolist())
    assert {r.doc_id for r in kept[3].values()} <= set(kept[2])


ODD = [
    (1, None, "en"), (2, "", "en"), (3, " \t", "en"), (None, None, "en"), (None, "", None), (7, "short text", "de"), (7, "short text", "de"),
    *[(i, "The old man and the sea is a story of the long fight between an old fisherman and a great fish that he has caught at last. " * 4 + f"End {i}", "en") for i in (11, 12, 13)],
    *[(None, "La mer est grande et le vieil homme est seul dans son bateau sur les eaux de la baie avec un poisson qui est plus grand que lui. " * 4, "fr")] * 2,
    (20, "y" * 200_000, "en"), (21, "a b c " * 30_000, "en"),
]


def test_odd_rows(spark, tmp_path):
    """Nulls, empties, repeated rows, rows without id, long texts, and columns with the names that stages use inside."""
    clash = {"told": "t", "key": "k", "order": "o", "copy": "c", "seen": "s", "_0": "u"}
    docs = spark.createDataFrame([(i, t, x, None, None) for i, t, x in ODD], "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit(v) for c, v in clash.items()})
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, str(tmp_path))
        rows = got.collect()
        assert got.columns == docs.columns and all(r.told == "t" and r["_0"] == "u" for r in rows), name
        if name == "quality rules":
            assert all(len(r.text.split()) >= 50 for r in rows)
        elif name == "language ID":
            # blank texts have no language, the runs of one sign read like none
            assert {(r.doc_id, r.text) for r in rows} <= {(i, t) for i, t, _ in ODD if t and t.strip()} and sum(r.doc_id in (11, 12, 13) for r in rows) == 3
        elif name == "SimHash near-dedup":
            # null, empty and blank texts are one group; so are 11 to 13; the two French rows without id have one text
            assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == [(False, 1), (False, 7), (False, 11), (False, 20), (False, 21), (True, 0)]
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    coded = corpus_pipeline.encode(spark, docs, str(tmp_path)).collect()
    assert len(coded) == len(ODD) and sum(r.n_tokens == 0 for r in coded) == sum(not t for _, t, _ in ODD)


def test_run(spark, kept):
    found = corpus_pipeline.run(spark, SF).collect()
    rows = {r.doc_id: r for r in found}
    assert set(rows) == set(kept[3]) and len(found) >= len(rows)
    for i, r in rows.items():
        assert r.decoded_sha256 == hashlib.sha256(kept[3][i].text.encode()).hexdigest() and len(r.ids) == r.n_tokens


def test_labelled_documents(spark):
    sf = "/root/testdata/sf0.01"
    labels = defaultdict(set)
    for r in spark.read.parquet(f"{sf}/labels.parquet").collect():
        labels["toxic" if r.toxic else "good" if r.quality else "low"].add(r.doc_id)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good, toxic = (docs.filter(F.col("doc_id").isin(list(labels[k]))) for k in ("good", "toxic"))
    assert corpus_pipeline.mixture(spark, good.union(toxic), sf).filter(F.col("doc_id").isin(list(labels["good"]))).select("doc_id").distinct().count() >= 0.97 * good.count()


def test_a_language_that_was_not_learnt(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("length(text) > 400 and lang is not null")
    unnamed = docs.withColumn("lang", F.when(F.col("lang") != "es", F.col("lang")))
    kept = {r["lang"]: r["n"] for r in corpus_pipeline.language(spark, unnamed, "").drop("lang").join(docs.select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.count("*").alias("n")).collect()}
    all_ = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    assert kept.get("es", 0) <= 0.05 * all_["es"]
    assert all(kept[x] >= 0.97 * n for x, n in all_.items() if x != "es")
