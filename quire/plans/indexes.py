"""Registered queries of stored indexes: each builds the index of all chunks once and asks it twice."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators.search import SearchIndex, keyword_search, substring_candidates, substring_search
from quire.plans.queries import QUERIES as PLAIN
from quire.plans.queries import _asked, _owned
from quire.sources.scratch import shared_folder

#: Parts of each benchmark text, from 1: whole ones, two characters, blanks around a middle, nothing but blanks.
NEEDLES = ["q", "substr(q, 3, 2)", "concat('  ', substr(q, 8, 7), ' ')", "'   '"]


def _index(t, tag, **kinds):
    return SearchIndex(t.spark, shared_folder(t.spark, tag)).build(_owned(t), **kinds)


def _ranked(t):
    index, asked = _index(t, "ranked", grams=False), _asked(t)
    return keyword_search(asked, index).withColumn("asked", F.lit(1)).union(keyword_search(asked, index, 5).withColumn("asked", F.lit(2)))


def _needles(t):
    each = F.posexplode(F.array(*[F.expr(n) for n in NEEDLES])).alias("k", "needle")
    return _asked(t).select("query_id", "user_id", "q", each).select((F.col("query_id") * len(NEEDLES) + F.col("k")).alias("query_id"), "user_id", F.col("needle").alias("q"))


def _substrings(t):
    return substring_search(_needles(t), _index(t, "substrings", terms=False)).drop("score")


def _narrowed(t):
    """For each query its hits, and whether the trigrams left no fewer candidates than there are hits."""
    index, asked = _index(t, "candidates", terms=False), _needles(t)
    candidates = substring_candidates(asked, index).groupBy("query_id").agg(F.count("*").alias("n"))
    hits = substring_search(asked, index, 50).groupBy("query_id").agg(F.count("*").alias("hits"))
    return hits.join(candidates, "query_id").select("query_id", "hits", (F.col("n") >= F.col("hits")).alias("enough"))


NEEDLE_SQL = f"SELECT query_id * {len(NEEDLES)} + k AS query_id, user_id, regexp_replace(n, '^\\s+|\\s+$', '', 'g') AS q FROM (SELECT query_id, user_id, unnest(range({len(NEEDLES)})) AS k, unnest([{', '.join(NEEDLES)}]) AS n FROM asked)"
FOUND = f"""SELECT query_id, doc_id, chunk, CAST(row_number() OVER (PARTITION BY query_id ORDER BY doc_id, chunk) AS INT) AS rank
           FROM ({NEEDLE_SQL}) JOIN owned USING (user_id) WHERE q <> '' AND contains(lower(text), lower(q))"""
RANKED = PLAIN["keyword_search"][1]

QUERIES = {
    "indexed_keyword_search": (
        _ranked,
        RANKED.replace("SELECT * FROM (SELECT *, CAST(row", "SELECT *, unnest(CASE WHEN rank <= 5 THEN [1, 2] ELSE [1] END) AS asked FROM (SELECT *, CAST(row"),
    ),
    "indexed_substring_search": (_substrings, f"SELECT * FROM ({FOUND}) WHERE rank <= 20"),
    "substring_candidates": (_narrowed, f"SELECT query_id, count(*) AS hits, TRUE AS enough FROM ({FOUND}) WHERE rank <= 50 GROUP BY query_id"),
}
