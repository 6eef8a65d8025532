"""Collocations: the SQL of the query on given tables, odd rows, and counts by a plain walk where shards are tiny."""

from collections import Counter

import duckdb
import numpy as np
from pyspark.sql import functions as F

from quire.llm import collocations as co
from quire.llm import queries

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def by_sql(rows_or_path):
    c = duckdb.connect()
    if isinstance(rows_or_path, str):
        c.execute(f"CREATE VIEW documents AS SELECT * FROM '{rows_or_path}'")
    else:
        documents = rows_or_path  # noqa: F841
        c.register("documents", documents)
    return sorted(c.execute(queries.OP13).df()[COLUMNS].itertuples(index=False, name=None))


def test_given_documents(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    got = co.collocations(spark.read.parquet(path)).select(COLUMNS).collect()
    assert len(got) and sorted(map(tuple, got)) == by_sql(path)


def test_odd_rows_in_tiny_shards(spark, monkeypatch):
    """Blocks of a few hundred characters, so that every count is a sum across shards; languages with blanks, nulls, ties, breaks."""
    monkeypatch.setattr(co, "SLICE", 400)
    rng = np.random.default_rng(1)
    words = ["One", "two", "THREE", "fo%ur", "é", "\xa0six", "\x1cseven"]
    rows = [(i, " ".join(rng.choice(words, 30)) + ("." if i % 3 else "\n") + "two\tthree, one two", ["x y", "x%20y", None, "und"][i % 4]) for i in range(160)]
    rows += [(None, None, "en"), (1, "", "en"), (2, " \t\n.,", None), (3, "a " * 400, "a\nb"), (3, "a " * 400, "a\nb")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("node", F.lit("clash"))
    got = sorted(map(tuple, co.collocations(df).select(COLUMNS).collect()))
    assert len(got) > 50 and {r[0] for r in got} == {"x y", "x%20y", "und", "a\nb"}
    assert got == by_sql(df.toPandas())
    assert co.collocations(df.limit(0)).collect() == []


def test_interval_extension_counts():
    seq = np.array([1, 2, 1, 2, 3, 0, 1, 2, 3, 0])
    order = co.suffix_order(seq, 4)
    assert sorted(order.tolist(), key=lambda i: (seq[i:].tolist() + [0] * 4)[:4]) == order.tolist()
    keys, first, size = co.extended(seq[order - 1].astype(np.int32), np.arange(4), seq[order])
    want = Counter((a, b) for a, b in zip(seq[:-1].tolist(), seq[1:].tolist()) if a and b)
    assert {(int(k) >> 32, int(k) & 0xFFFFFFFF): int(n) for k, n in zip(keys, size)} == want
