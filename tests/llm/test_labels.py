"""What the labels say of op3's verdicts and op7's posteriors."""

from pyspark.sql import functions as F

from quire.llm import divergence, mixing, queries


def test_verdicts_against_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), mixing.label_domains(spark.read.parquet(f"{sf}/labels.parquet"))
    told = divergence.quality_verdicts(docs).filter("not base_failed").join(docs.select("doc_id", (F.size(F.split("text", "[|]")) - 1).alias("bars")), "doc_id").join(labels, "doc_id", "left").collect()
    bars, good, low = ([r.kept for r in told if ok(r)] for ok in (lambda r: r.bars >= 0.2 * r.n_words, lambda r: r.domain == "good", lambda r: r.domain == "low"))
    assert len(bars) >= 20 and sum(bars) <= 0.2 * len(bars)
    assert len(low) >= 10 and sum(low) <= 0.2 * len(low)
    assert sum(good) >= 0.99 * len(good)


def test_toxic_documents_of_each_language(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = mixing.mixing_rates(docs, labels, queries.WEIGHTS).join(docs.select("doc_id", "lang"), "doc_id").join(mixing.label_domains(labels), "doc_id")
    share = lambda d: {r.lang: r.x for r in rows.filter(F.col("domain") == d).groupBy("lang").agg(F.avg((F.col(f"p_{d}") >= 0.5).cast("int")).alias("x")).collect()}
    toxic, good = share("toxic"), share("good")
    assert set(toxic) == {"en", "fr", "de", "es"} and min(toxic.values()) >= 0.5
    assert min(good.values()) >= 0.99


def test_sql_twins(spark):
    """Queries with SQL give the same rows in DuckDB, distances and scores to nine decimals."""
    import duckdb

    sf = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    for t in ("documents", "embeddings"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        got = queries.queries()[name](spark, sf)
        rows = lambda xs: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in x) for x in xs)
        want = duck.execute(f"SELECT {', '.join(got.columns)} FROM ({sql})").fetchall()
        assert rows(map(tuple, got.collect())) == rows(want) and want, name
