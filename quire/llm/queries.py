"""The registered queries of this subpackage, and SQL for those that it can express."""

from __future__ import annotations

import public_tokenizers

from quire.llm import divergence
from quire.llm.align import alignment_digests
from quire.llm.byte_bpe import document_codes
from quire.llm.collocations import collocations
from quire.llm.divergence import quality_verdicts
from quire.llm.langid import language_predictions
from quire.llm.mixing import mixing_rates
from quire.llm.nearest import nearest_vectors
from quire.llm.packing import pack_documents
from quire.llm.ppm import ppm_scores
from quire.llm.pretokens import document_token_counts
from quire.llm.sequences import sequence_digests
from quire.llm.vptree import simhash_components
from quire.llm.wrapper import main_texts

WORD_BPE, BYTE_BPE = "word_bpe_49k.json", "byte_bpe_multi_50k.tiktoken"
BYTE_JSON, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Shares of the tokens that documents of each domain should have.
WEIGHTS = {"good": 0.90, "low": 0.08, "toxic": 0.02}


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries():
    docs = lambda s, d: table(s, d, "documents")
    return {
        "op1_ppm": lambda s, d: ppm_scores(docs(s, d)),
        "op2_token_counts": lambda s, d: document_token_counts(docs(s, d), public_tokenizers.path(WORD_BPE)),
        "op3_divergence": lambda s, d: quality_verdicts(docs(s, d)),
        "op4_language": lambda s, d: language_predictions(docs(s, d)),
        "op5_nearest": lambda s, d: nearest_vectors(table(s, d, "embeddings")),
        "op6_wrapper": lambda s, d: main_texts(table(s, d, "pages")),
        "op7_mixing": lambda s, d: mixing_rates(docs(s, d), table(s, d, "labels"), WEIGHTS),
        "op8_simhash": lambda s, d: simhash_components(docs(s, d)),
        "op9_sequences": lambda s, d: sequence_digests(docs(s, d), public_tokenizers.path(WORD_BPE)),
        "op10_byte_bpe": lambda s, d: document_codes(docs(s, d), public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN),
        "op11_alignment": lambda s, d: alignment_digests(docs(s, d), public_tokenizers.path(BYTE_JSON), public_tokenizers.path(PIECES)),
        "op12_packing": lambda s, d: pack_documents(docs(s, d), public_tokenizers.path(BYTE_JSON)),
        "op13_collocations": lambda s, d: collocations(docs(s, d)),
        "pipeline": pipeline,
    }


OP5 = """SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.e, c.e) AS score FROM fine q JOIN fine c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)) WHERE rank <= 5"""
FINE = """WITH fine AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0)
"""


#: Characters of each class of divergence.CLASSES in what is left of a text without a-z and white space.
IN_REST = {
    "upper": "\\p{Lu}", "letter": "\\p{L}", "digit": "\\p{N}", "point": "[.,;:!?''\"()-]", "bar": "[|]", "symbol": "[#*$%&<>=+~^_/\\\\@{}\\[\\]]",
}


def op3_sql() -> str:
    """Base counts by windows over a row for each word; histograms as rows (kind, place, count), held against those of the languages."""
    count = lambda c: f"length(rest) - length(regexp_replace(rest, '{c}', '', 'g'))"
    classes = {k: count(c) for k, c in IN_REST.items()} | {"letter": f"({count(IN_REST['letter'])}) - ({count(IN_REST['upper'])})"}
    listed = ", ".join(f"'{w}'" for w in divergence.WORDS)
    langs = ", ".join(f"'{x}'" for x in divergence.COMMON)
    part = lambda a: f"CASE WHEN {a} > 0 THEN {a} * log2({a} / ((p + q) / 2)) ELSE 0 END"
    return f"""WITH texts AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS text FROM documents),
split AS (SELECT *, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS l, regexp_replace(text, '[a-z\\x20\\x09-\\x0D]+', '', 'g') AS rest,
                 list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM texts),
words AS (SELECT r, unnest(range(len(l))) AS i, unnest(l) AS w FROM split),
windows AS (SELECT r, i, count(*) OVER (PARTITION BY r, w, w1, w2) AS k FROM (
              SELECT r, i, w, lead(w) OVER o AS w1, lead(w, 2) OVER o AS w2 FROM words WINDOW o AS (PARTITION BY r ORDER BY i)) WHERE w2 IS NOT NULL),
repeats AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM windows WHERE k > 1) GROUP BY r),
base AS (SELECT s.r, doc_id, lang, len(l) AS n_words, length(array_to_string(l, '')) AS word_chars, {count('[#*$%&|<>]')} AS n_symbols,
                len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, rest, l FROM split s LEFT JOIN repeats USING (r)),
counted AS (
  SELECT r, lang, 'chars' AS kind, list_append(c, length(rest) - list_sum(c[2:])) AS c FROM (
    SELECT r, lang, rest, [word_chars - length(rest), {', '.join(classes[k] for k in divergence.CLASSES)}] AS c FROM base)
  UNION ALL SELECT r, lang, 'words', list_append(c, n_words - list_sum(c)) FROM (
    SELECT r, lang, n_words, list_transform([{listed}], lambda x: len(list_filter(l, lambda y: y = x OR y = concat(upper(x[1]), x[2:])))) AS c FROM base)),
hist AS (SELECT r, lang, kind, unnest(range(len(c))) AS k, CAST(unnest(c) AS DOUBLE) AS n FROM counted),
shares AS (SELECT r, kind, k, n / greatest(1, sum(n) OVER (PARTITION BY r, kind)) AS p FROM hist),
fixed AS (SELECT x AS lang, kind, k, n / greatest(1, sum(n) OVER (PARTITION BY x, kind)) AS q FROM (
            SELECT x, kind, k, coalesce(sum(n) FILTER (WHERE lang = x), 0) AS n FROM hist, (SELECT unnest([{langs}]) AS x) GROUP BY ALL)),
nearest AS (SELECT r, kind, min(d) AS d FROM (
              SELECT r, kind, f.lang, sqrt(greatest(0, sum((({part('p')}) + ({part('q')})) / 2))) AS d FROM shares JOIN fixed f USING (kind, k) GROUP BY ALL) GROUP BY ALL),
far AS (SELECT r, max(d) FILTER (WHERE kind = 'chars') AS c, max(d) FILTER (WHERE kind = 'words') AS w FROM nearest GROUP BY r)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND NOT (n_words >= {divergence.LEAST_WORDS} AND (c > {divergence.FAR_CHARS} OR w > {divergence.FAR_WORDS})) AS kept,
       round(c, 9) AS char_distance, round(w, 9) AS word_distance
FROM (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base) JOIN far USING (r)"""


#: Phrases by windows over a row for each word, their cuts, and the longer phrases that hold them.
OP13 = """WITH texts AS (SELECT row_number() OVER () AS t, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS (SELECT row_number() OVER () AS p, lang, piece FROM (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM texts)),
split AS (SELECT p, lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS l FROM pieces),
words AS (SELECT p, lang, unnest(range(len(l))) AS i, unnest(l) AS w FROM split),
next AS (SELECT lang, w, lead(w) OVER o AS w1, lead(w, 2) OVER o AS w2, lead(w, 3) OVER o AS w3 FROM words WINDOW o AS (PARTITION BY p ORDER BY i)),
f AS (SELECT lang, g, count(*) AS f FROM (SELECT lang, unnest([[w], CASE WHEN w1 IS NOT NULL THEN [w, w1] END, CASE WHEN w2 IS NOT NULL THEN [w, w1, w2] END, CASE WHEN w3 IS NOT NULL THEN [w, w1, w2, w3] END]) AS g FROM next)
      WHERE g IS NOT NULL GROUP BY ALL HAVING count(*) >= 30),
cand AS (SELECT lang, g, f AS a FROM f WHERE len(g) > 1),
cuts AS (SELECT c.lang, c.g, c.a, k, x.f AS l, y.f AS r, CAST(CAST(2000000 AS HUGEINT) * a // (x.f + y.f) AS BIGINT) AS score
         FROM (SELECT *, unnest(range(1, len(g))) AS k FROM cand) c JOIN f x ON x.lang = c.lang AND x.g = c.g[1:k] JOIN f y ON y.lang = c.lang AND y.g = c.g[k + 1:]),
least AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, k) AS o FROM cuts) WHERE o = 1),
inner_ AS (SELECT lang, s, max(a) AS m FROM (SELECT lang, a, unnest(list_concat([g[i:i + 1] FOR i IN range(1, len(g))], CASE WHEN len(g) = 4 THEN [g[1:3], g[2:4]] ELSE [] END)) AS s FROM cand WHERE len(g) > 2) GROUP BY ALL),
kept AS (SELECT l.lang, array_to_string(l.g, ' ') AS phrase, a, l, r, score FROM least l LEFT JOIN inner_ i ON i.lang = l.lang AND i.s = l.g WHERE m IS NULL OR CAST(100 AS HUGEINT) * m < CAST(80 AS HUGEINT) * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
JOIN (SELECT lang, count(*) AS n FROM words GROUP BY lang) USING (lang) WHERE rank <= 2000"""


def oracle_sql():
    return {"op3_divergence": op3_sql(), "op5_nearest": FINE + OP5, "op13_collocations": OP13}
