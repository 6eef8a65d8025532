"""Registered queries of study material (quizzes, cards, summaries), with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import assets, text
from quire.plans.gates import CLEAN
from quire.plans.queries import CHUNKS, STRIP, chunks_sql


def parsed(raw: str) -> str:
    """The JSON that a model's answer holds: the whole, a fenced block, or what the outermost braces hold."""
    fence, braces = f"trim(regexp_extract({raw}, '(?s)```(?:json)?\\s*(.*?)```', 1), ' ' || chr(10))", f"regexp_extract({raw}, '(?s)(\\{{.*\\}})', 1)"
    return f"CASE WHEN json_valid({raw}) THEN {raw} WHEN {fence} <> '' AND json_valid({fence}) THEN {fence} WHEN {braces} <> '' AND json_valid({braces}) THEN {braces} END"


def listed(view: str, name: str, keys: str) -> str:
    """A row for each element of a list: its place and value."""
    return f"""SELECT {keys}, unnest(range(len(l))) AS pos, unnest(l) AS v FROM (
      SELECT {keys}, CAST(json_extract(j, '$.{name}') AS JSON[]) AS l FROM (SELECT {keys}, {parsed('raw')} AS j FROM {view}) WHERE json_type(j, '$.{name}') = 'ARRAY')"""


def said(path: str) -> str:
    return STRIP.format(f"json_extract_string(v, '$.{path}')")


QUIZ = f"""SELECT request_id, CAST(row_number() OVER (PARTITION BY request_id ORDER BY pos) AS INT) AS position, type, question, options, correct_answer, explanation FROM (
  SELECT *, CASE type WHEN 'mcq' THEN CASE WHEN len(o) >= 3 THEN array_to_string(o[1:5], '|') END WHEN 'true_false' THEN 'true|false' ELSE '' END AS options FROM (
    SELECT *, list_reduce(list_concat([[]::VARCHAR[]], list_transform(CASE WHEN list_contains(kept, correct_answer) THEN kept ELSE list_append(kept, correct_answer) END, lambda x: [x])),
                          lambda a, x: CASE WHEN list_contains(a, x[1]) THEN a ELSE list_concat(a, x) END) AS o FROM (
      SELECT request_id, pos, {STRIP.format("lower(json_extract_string(v, '$.type'))")} AS type, {said('question')} AS question, coalesce({said('explanation')}, '') AS explanation,
             list_filter(list_transform(coalesce(CAST(json_extract(v, '$.options') AS VARCHAR[]), []), lambda x: {STRIP.format('x')}), lambda x: x <> '') AS kept,
             CASE WHEN lower(json_extract_string(v, '$.type')) <> 'true_false' THEN {said('correct_answer')}
                  WHEN lower({said('correct_answer')}) IN ('true', 't', 'yes', 'y', '1') THEN 'true'
                  WHEN lower({said('correct_answer')}) IN ('false', 'f', 'no', 'n', '0') THEN 'false' END AS correct_answer
      FROM ({listed('fx_quiz', 'questions', 'request_id')}) WHERE pos < 10 AND json_type(v) = 'OBJECT')
    WHERE type IN ('mcq', 'true_false', 'short_answer') AND question <> '' AND correct_answer <> ''))
WHERE options IS NOT NULL"""


def shortened(column: str, most: int) -> str:
    return f"CASE WHEN length({column}) > {most} THEN concat(rtrim(substr({column}, 1, {most})), '…') ELSE {column} END"


CARDS = f"""SELECT request_id, round, CAST(pos AS INT) AS "at", {shortened('front', 200)} AS front, {shortened('back', 600)} AS back,
  coalesce(nullif(category, ''), 'General') AS category, CASE lower(difficulty) WHEN 'easy' THEN 'Easy' WHEN 'hard' THEN 'Hard' ELSE 'Medium' END AS difficulty FROM (
  SELECT request_id, round, pos, {said('front')} AS front, {said('back')} AS back, {said('category')} AS category, {said('difficulty')} AS difficulty
  FROM ({listed('fx_cards', 'flashcards', 'request_id, round')}) WHERE pos < 15)
WHERE front <> '' AND back <> ''"""


def deck_sql(n: int) -> str:
    """Decks of `cards` round by round: what is missing says how many elements a round looks at."""
    firsts = lambda k, left, known: f"""SELECT * EXCLUDE (k) FROM (SELECT c.*, row_number() OVER (PARTITION BY c.request_id, c.front, c.back ORDER BY c."at") AS k
      FROM cards c {left} WHERE c.round = {k} AND c."at" < {'15' if k == 1 else 'missing'} {known}) WHERE k = 1"""  # noqa: E731
    unknown = lambda *of: "".join(f" AND (c.request_id, c.front, c.back) NOT IN (SELECT (request_id, front, back) FROM {r})" for r in of)
    left = "JOIN {} m ON m.request_id = c.request_id"
    return f"""r1 AS ({firsts(1, '', f'AND c."at" < {n}')}),
m1 AS (SELECT request_id, least(15, {n} - count(*)) AS missing, count(*) AS n FROM r1 GROUP BY request_id),
r2 AS ({firsts(2, left.format('m1'), unknown('r1'))}),
m2 AS (SELECT request_id, least(15, {n} - m1.n - count(*)) AS missing FROM r2 JOIN m1 USING (request_id) GROUP BY request_id, m1.n),
r3 AS ({firsts(3, left.format('m2'), unknown('r1', 'r2'))})
SELECT request_id, CAST(row_number() OVER (PARTITION BY request_id ORDER BY round, "at") AS INT) AS position, front, back, category, difficulty
FROM (SELECT * FROM r1 UNION ALL SELECT * FROM r2 UNION ALL SELECT * FROM r3)"""


DECK = deck_sql(20)
#: Answers to a quiz: right ones, ones with blanks around, wrong ones, and some left out.
ANSWERED = "CASE (request_id + position) % 4 WHEN 0 THEN correct_answer WHEN 1 THEN concat(' ', correct_answer, ' ') WHEN 2 THEN 'wrong' END"


def _quiz(t):
    return assets.clean_quiz(t("fx_quiz"))


def _graded(t):
    key = _quiz(t)
    answers = key.select("request_id", "position", F.expr(ANSWERED).alias("answer")).filter("answer is not null")
    return assets.grade_quiz(answers, key)


def _cards(t):
    return assets.clean_cards(t("fx_cards"))


def _plan(t):
    return assets.summary_plan(t("documents").select(F.col("doc_id").alias("request_id"), "text"), "short", False)


def _merged(t):
    partials = text.chunk(t("fx_paragraphs")).select(F.col("doc_id").alias("request_id"), "chunk", F.when(F.col("chunk") % 3 == 1, " ").otherwise(F.concat(F.lit(" "), "text", F.lit("\n"))).alias("text"))
    return assets.merge_partials(partials).select("request_id", "length", F.md5("text").alias("digest"))


PARTS = f"SELECT doc_id AS request_id, chunk, count(*) OVER (PARTITION BY doc_id) AS n, text FROM ({chunks_sql(1600, f'SELECT doc_id, {CLEAN} AS text FROM documents')})"

QUERIES = {
    "parse_json": (
        lambda t: t("fx_quiz").select("request_id", assets.parse_json(F.col("raw")).isNotNull().alias("parsed")),
        f"SELECT request_id, {parsed('raw')} IS NOT NULL AS parsed FROM fx_quiz",
    ),
    "clean_quiz": (lambda t: _quiz(t).withColumn("options", F.array_join("options", "|")), QUIZ),
    "clean_options": (
        lambda t: t("documents").select("doc_id", F.array_join(assets.clean_options(F.split("text", " "), F.col("lang")), "|").alias("options")),
        f"""SELECT doc_id, CASE WHEN len(o) >= 3 THEN array_to_string(o[1:5], '|') END AS options FROM documents LEFT JOIN (
              SELECT doc_id, list(w ORDER BY pos) AS o FROM (
                SELECT doc_id, w, min(pos) AS pos FROM (
                  SELECT doc_id, pos, {STRIP.format('raw')} AS w FROM (
                    SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS raw FROM (SELECT doc_id, list_append(string_split(text, ' '), lang) AS l FROM documents)))
                WHERE w <> '' GROUP BY doc_id, w)
              GROUP BY doc_id) USING (doc_id)""",
    ),
    "quiz_status": (
        lambda t: assets.quiz_status(t("fx_quiz")),
        f"""SELECT request_id, CASE WHEN json_type(j, '$.questions') IS DISTINCT FROM 'ARRAY' THEN 'invalid' WHEN q.request_id IS NULL THEN 'empty' ELSE 'ok' END AS status
            FROM (SELECT request_id, {parsed('raw')} AS j FROM fx_quiz) r LEFT JOIN (SELECT DISTINCT request_id FROM ({QUIZ})) q USING (request_id)""",
    ),
    "clean_cards": (_cards, CARDS),
    "assemble_deck": (lambda t: assets.assemble_deck(_cards(t)), f"WITH cards AS ({CARDS}), {DECK}"),
    "assemble_small_deck": (lambda t: assets.assemble_deck(_cards(t), 5), f"WITH cards AS ({CARDS}), {deck_sql(5)}"),
    "grade_quiz": (
        _graded,
        f"""SELECT request_id, CAST(score AS BIGINT) AS score, total, percent, CASE WHEN percent >= 90 THEN 'excellent' WHEN percent >= 70 THEN 'good' WHEN percent >= 50 THEN 'fair' ELSE 'poor' END AS band
            FROM (SELECT *, CAST(round(100 * score / total) AS BIGINT) AS percent FROM (
              SELECT request_id, count(*) FILTER (WHERE (request_id + position) % 4 < 2) AS score, count(*) AS total FROM ({QUIZ}) GROUP BY request_id))""",
    ),
    "summary_plan": (
        lambda t: _plan(t).withColumn("text", F.md5("text")),
        f"""SELECT request_id, CASE WHEN n = 1 THEN 'single' ELSE 'map' END AS step, chunk, md5(text) AS text, '80-120' AS target_words, 'paragraphs' AS form FROM ({PARTS})
            UNION ALL SELECT DISTINCT request_id, 'reduce', CAST(n AS INT), NULL, '80-120', NULL FROM ({PARTS}) WHERE n > 1""",
    ),
    "merge_partials": (
        _merged,
        f"""SELECT request_id, CAST(length(text) AS INT) AS length, md5(text) AS digest FROM (
              SELECT doc_id AS request_id, string_agg({STRIP.format('text')}, chr(10) || chr(10) ORDER BY chunk) AS text FROM ({CHUNKS}) WHERE chunk % 3 <> 1 GROUP BY doc_id)""",
    ),
}
