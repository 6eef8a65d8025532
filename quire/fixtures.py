"""Entity views over the base tables, in text that Spark SQL and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Rows of a table, numbered from 0 by its key, so that each row of another table can be given one of them.
COUNT = "(SELECT count(*) AS n FROM {{{0}}})"
VIEWS = {
    "fx_users": """
SELECT c.c_custkey AS user_id, c.c_name AS name, concat('user', CAST(c.c_custkey AS VARCHAR(20)), '@example.com') AS email,
       CASE WHEN c.c_custkey % 4 = 0 THEN concat('g', CAST(c.c_custkey AS VARCHAR(20))) END AS google_id,
       CASE WHEN c.c_custkey % 3 = 0 THEN concat('pic', CAST(c.c_custkey AS VARCHAR(20))) END AS avatar,
       c.c_acctbal >= 0 AS is_active, c.c_custkey % 50 = 0 AS is_admin, CAST(e.ts AS TIMESTAMP) AS created_at, CAST(l.last_login AS TIMESTAMP) AS last_login
FROM {customer} c JOIN {events} e ON e.event_id = c.c_custkey * 6
LEFT JOIN (SELECT user_id, min(ts) AS last_login FROM {events} GROUP BY user_id) l ON l.user_id = c.c_custkey""",
    "fx_documents": """
SELECT d.doc_id, d.doc_id % 100 AS user_id,
       concat('file_', CAST(d.doc_id AS VARCHAR(20)), CASE d.doc_id % 8 WHEN 0 THEN '.pdf' WHEN 1 THEN '.docx' WHEN 2 THEN '.doc' WHEN 3 THEN '.txt'
              WHEN 4 THEN '.md' WHEN 5 THEN '.pptx' WHEN 6 THEN '.xlsx' ELSE '.bin' END) AS name,
       CASE WHEN d.doc_id % 3 = 0 THEN 'application/octet-stream' WHEN d.doc_id % 8 IN (0, 1) THEN 'application/pdf'
            WHEN d.doc_id % 8 = 2 THEN 'application/msword' WHEN d.doc_id % 8 IN (3, 4) THEN 'text/plain' ELSE 'application/octet-stream' END AS type,
       CASE WHEN d.doc_id % 8 IN (1, 2) THEN 'application/msword' WHEN d.doc_id % 8 = 3 THEN 'text/plain' WHEN d.doc_id % 8 = 4 THEN '' END AS original_type,
       d.n_chars AS size, d.text, CAST(e.ts AS TIMESTAMP) AS uploaded_at, d.doc_id % 10 = 0 AS pinned,
       CASE WHEN d.doc_id % 20 = 0 THEN CAST(p.ts AS TIMESTAMP) END AS pinned_at
FROM {documents} d JOIN {events} e ON e.event_id = d.doc_id * 5 JOIN {events} p ON p.event_id = d.doc_id * 3""",
    "fx_paragraphs": "SELECT doc_id, replace(text, chr(10), concat(chr(10), chr(10))) AS text FROM {documents}",
    "fx_vectors": f"""
SELECT e.label AS doc_id, d.doc_id AS chunk, d.text, e.embedding
FROM {{documents}} d CROSS JOIN {COUNT.format('embeddings')} c JOIN {{embeddings}} e ON e.vec_id = d.doc_id % c.n""",
    "fx_questions": f"""
SELECT b.item_id AS question_id, e.label AS doc_id, b.text AS question, e.embedding
FROM {{benchmark}} b CROSS JOIN {COUNT.format('embeddings')} c JOIN {{embeddings}} e ON e.vec_id = b.item_id % c.n""",
    "fx_messages": """
SELECT c.conv_id, c.turn, c.role, c.text, CAST(e.ts AS TIMESTAMP) AS sent_at,
       CASE WHEN c.role <> 'assistant' THEN 'none' WHEN (c.conv_id + c.turn) % 3 = 0 THEN 'positive' WHEN (c.conv_id + c.turn) % 3 = 1 THEN 'negative' ELSE 'none' END AS rating
FROM {conversations} c JOIN {events} e ON e.event_id = c.conv_id * 8 + c.turn""",
    "fx_reports": f"""
SELECT e.event_id AS report_id, e.user_id, concat('User ', CAST(e.user_id AS VARCHAR(20))) AS name, concat('user', CAST(e.user_id AS VARCHAR(20)), '@example.com') AS email,
       CASE e.event_id % 4 WHEN 0 THEN 'Bug' WHEN 1 THEN 'Feedback' WHEN 2 THEN 'Feature Request' ELSE 'Other' END AS subject,
       concat(d.text, CASE WHEN e.event_id % 5 = 0 THEN ' app crash' ELSE '' END) AS message,
       CASE e.event_id % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'in_progress' ELSE 'resolved' END AS status, CAST(e.ts AS TIMESTAMP) AS created_at
FROM {{events}} e CROSS JOIN {COUNT.format('documents')} c JOIN {{documents}} d ON d.doc_id = e.event_id % c.n""",
    "fx_requests": """
SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, 'GET' AS method, concat('/', event_type) AS route,
       CASE WHEN event_type = 'error' THEN 500 WHEN event_id % 20 = 0 THEN 404 ELSE 200 END AS status_code, value / 100 AS duration_s
FROM {events}""",
    "fx_asks": """
SELECT event_id AS question_id, CASE WHEN event_id % 13 <> 0 THEN event_id % 3000 END AS doc_id,
       CASE event_type WHEN 'click' THEN 'Y ' WHEN 'error' THEN ' no' WHEN 'view' THEN concat('What about ', CAST(user_id AS VARCHAR(20)), '?')
            WHEN 'purchase' THEN CASE WHEN event_id % 2 = 0 THEN 'Hello  there' ELSE 'see www.example.com' END
            ELSE CASE WHEN event_id % 2 = 0 THEN ' ' ELSE 'the building, please' END END AS question
FROM {events}""",
    "fx_states": """
SELECT event_id % 3000 AS doc_id, ts, event_id AS seq,
       CASE event_type WHEN 'click' THEN CASE WHEN user_id % 3 = 0 THEN 'agree' ELSE 'yes' END WHEN 'error' THEN CASE WHEN user_id % 2 = 0 THEN 'refuse' ELSE 'no' END
            WHEN 'view' THEN CASE WHEN user_id % 4 = 0 THEN 'ask' ELSE 'scan_hit' END WHEN 'purchase' THEN CASE WHEN user_id % 2 = 0 THEN 'scan_clear' ELSE 'empty' END
            ELSE CASE WHEN user_id % 5 = 0 THEN 'outside' ELSE 'ask' END END AS kind,
       CASE event_type WHEN 'click' THEN 'empty' WHEN 'error' THEN 'outside' WHEN 'view' THEN 'yes' WHEN 'purchase' THEN 'no' ELSE 'other' END AS turn,
       concat('question ', CAST(event_id AS VARCHAR(20))) AS question
FROM {events}""",
    "fx_quiz": """
SELECT doc_id AS request_id,
       CASE doc_id % 5 WHEN 0 THEN body WHEN 1 THEN concat('Here you are:', chr(10), '```json', chr(10), body, chr(10), '```')
            WHEN 2 THEN concat('so ', body, ' there') WHEN 3 THEN substr(body, 1, length(body) - 3)
            ELSE CASE WHEN doc_id % 2 = 0 THEN '{{"questions": []}}' ELSE '{{"answers": 1}}' END END AS raw
FROM (SELECT doc_id, concat('{{"questions": [{{"type": " MCQ ", "question": " q', CAST(doc_id AS VARCHAR(20)), ' ", "options": ["a", " b ", "", "a", "',
             CAST(n_chars AS VARCHAR(20)), '"], "correct_answer": " c ", "explanation": " why ', lang, ' "}}, 7, {{"type": "true_false", "question": "', source,
             '", "correct_answer": "', CASE doc_id % 4 WHEN 0 THEN 'Yes' WHEN 1 THEN '0' WHEN 2 THEN 'maybe' ELSE 'FALSE' END,
             '"}}, {{"type": "short_answer", "question": "s", "correct_answer": "', CASE WHEN doc_id % 3 = 0 THEN ' ' ELSE lang END,
             '"}}, {{"type": "essay", "question": "e", "correct_answer": "x"}}, {{"type": "mcq", "question": "m", "options": ["', lang, '", "', source,
             '"], "correct_answer": "', lang, '"}}, {{"type": "mcq", "question": "long", "options": ["1", "2", "3", "4", "5"], "correct_answer": "6"}}]}}') AS body
      FROM {documents}) b""",
    "fx_cards": """
SELECT d.doc_id AS request_id, r.round, concat('{{"flashcards": [{{"front": " ', d.lang, ' ", "back": "', d.source, '", "difficulty": "hARD"}}, 5, {{"front": "f',
       CAST(d.doc_id % 7 * (r.round % 3) AS VARCHAR(20)), '", "back": "b", "category": "', CASE WHEN d.doc_id % 2 = 0 THEN ' ' ELSE 'Terms' END,
       '", "difficulty": "Impossible"}}, {{"front": "", "back": "x"}}, {{"front": "', repeat('long ', 41), '", "back": "', repeat('back ', 121),
       CAST(r.round % 2 AS VARCHAR(20)), '"}}]}}') AS raw
FROM {documents} d CROSS JOIN (SELECT 1 AS round UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) r""",
}
BASE = ("customer", "events", "documents", "embeddings", "conversations", "benchmark")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table or a view over base tables."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in BASE if f"{{{t}}}" in VIEWS[name]}
    view = VIEWS[name]
    for t, rows in used.items():
        # the number itself: joined as a table, a filter on both sides would come before the join by key and meet all pairs of rows
        if COUNT.format(t) in view:
            view = view.replace(COUNT.format(t), f"(SELECT {rows.count()}L AS n)")
    return spark.sql(view, **used)


def plain(view: str) -> str:
    """A view's text with the tables' own names."""
    for t in BASE:
        view = view.replace(f"{{{t}}}", t)
    return view.replace("{{", "{").replace("}}", "}")


def with_views(sql: str) -> str:
    """DuckDB text: the views that `sql` names, as common table expressions before it."""
    used = [n for n in VIEWS if n in sql]
    body = ",\n".join(f"{n} AS ({plain(VIEWS[n])})" for n in used)
    return f"WITH {body}\n{sql}" if used else sql
