"""The registered queries of the engine's own operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.fixtures import load, with_views
from quire.functions.strings import keywords
from quire.operators import admin, chat, guard, intake, metrics, retrieve, text

NOW, LATER, MINUTES = "2024-01-02 12:00:00", "2024-01-20 12:00:00", 1440
COSINE = """round(1 - list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[])
 / (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(c.embedding::DOUBLE[], c.embedding::DOUBLE[]))), 6) + 0"""
STOP = "('the','a','an','and','or','of','in','on','to','for','is','are','was','were','be','with','by','at','from','as','that','this','it','its','if','then','than','into','about','over','under','within','between')"
STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"


def terms_sql(column: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array(lower({column}), '[^A-Za-z0-9]+'), lambda t: length(t) >= 3 AND t NOT IN {STOP} AND NOT regexp_full_match(t, '[0-9]+')))"


KNN = f"""SELECT question_id, doc_id, chunk, distance, rank FROM (
SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY distance, chunk) AS INT) AS rank FROM (
SELECT q.question_id, q.doc_id, c.chunk, {COSINE} AS distance FROM fx_questions q JOIN fx_vectors c ON c.doc_id = q.doc_id)) WHERE rank <= 12"""
RERANK = f"""SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, rank) AS INT) AS score_rank FROM (
SELECT k.*, CAST(len(list_intersect(qt, ct)) AS INT) AS overlap, round(0.7 * (1 - least(greatest(distance, 0), 1)) + 0.3 * len(list_intersect(qt, ct)) / greatest(1, len(qt)), 9) AS score
FROM ({KNN}) k JOIN (SELECT question_id, {terms_sql('question')} AS qt FROM fx_questions) q USING (question_id) JOIN (SELECT doc_id, chunk, {terms_sql('text')} AS ct FROM fx_vectors) c USING (doc_id, chunk))"""
SELECTED = f"""SELECT question_id, doc_id, chunk, CAST(row_number() OVER (PARTITION BY question_id ORDER BY CASE WHEN any5 THEN score_rank ELSE rank END) AS INT) AS position, CASE WHEN any5 THEN 'reranked' ELSE 'distance' END AS source
FROM (SELECT *, score_rank <= 5 AND distance < 0.9 AS best, max(CAST(score_rank <= 5 AND distance < 0.9 AS INT)) OVER (PARTITION BY question_id) = 1 AS any5 FROM ({RERANK})) WHERE CASE WHEN any5 THEN best ELSE distance < 0.6 END"""


def chunks_sql(size: int, source: str) -> str:
    """Chunks of the texts (doc_id, text) of a query: a fold over paragraphs with the chunks done, the open one, and its counted size."""
    more = "{'w': a.w, 'b': a.b || chr(10) || chr(10) || x.b, 'n': a.n + length(x.b) + 2}"
    tail = "CASE WHEN length(a.b) > 200 THEN right(a.b, 200) || chr(10) || chr(10) ELSE '' END"
    cut = f"{{'w': list_append(a.w, a.b), 'b': {tail} || x.b, 'n': CASE WHEN length(a.b) > 200 THEN 200 ELSE 0 END + length(x.b) + 2}}"
    paragraphs = f"list_filter(list_transform(regexp_split_to_array({STRIP.format('text')}, '\\n\\s*\\n'), lambda p: {STRIP.format('p')}), lambda p: p <> '')"
    return f"""SELECT doc_id, CAST(unnest(range(len(l))) AS INT) AS chunk, unnest(l) AS text FROM (SELECT doc_id, list_append(s.w, s.b) AS l FROM (
      SELECT doc_id, list_reduce(list_transform(ps, lambda x: {{'w': CAST([] AS VARCHAR[]), 'b': x, 'n': length(x) + 2}}),
                                 lambda a, x: CASE WHEN a.n + length(x.b) + 2 <= {size} THEN {more} ELSE {cut} END) AS s
      FROM (SELECT doc_id, {paragraphs} AS ps FROM ({source})) WHERE len(ps) > 0))"""


CHUNKS = chunks_sql(1000, "SELECT * FROM fx_paragraphs")
SNAP = "SELECT conv_id, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn)) AS snapshot_hash, count(*) AS message_count FROM fx_messages GROUP BY conv_id"


def class_sql(feature: str = "feature_request") -> str:
    t = "concat(coalesce(subject, ''), ' ', coalesce(message, ''))"
    return f"CASE WHEN regexp_matches({t}, 'bug|error|issue|fail|crash', 'i') THEN 'bug' WHEN regexp_matches({t}, 'feature|request|enhancement|improvement', 'i') THEN '{feature}' WHEN regexp_matches({t}, 'feedback|suggestion|opinion|comment', 'i') THEN 'feedback' ELSE 'other' END"


#: Windows of 24 hours by user: each starts at the first event after the one before ended; events numbered in theirs.
ANCHORS = """WITH RECURSIVE anchors AS (
  SELECT user_id, min(ts) AS t0 FROM events GROUP BY user_id
  UNION ALL
  SELECT a.user_id, min(e.ts) FROM anchors a JOIN events e ON e.user_id = a.user_id AND e.ts >= a.t0 + INTERVAL 24 HOURS GROUP BY a.user_id, a.t0),
counted AS (SELECT *, row_number() OVER (PARTITION BY user_id, t0 ORDER BY ts, event_id) AS k FROM (
  SELECT e.*, (SELECT max(a.t0) FROM anchors a WHERE a.user_id = e.user_id AND a.t0 <= e.ts) AS t0 FROM events e))"""


DOC_CLASS = """CASE WHEN type = 'application/pdf' OR ext = 'pdf' THEN 'pdf' WHEN type = 'application/msword' OR ext IN ('doc', 'docx') THEN 'word' WHEN ext IN ('ppt', 'pptx') THEN 'powerpoint'
WHEN ext IN ('xls', 'xlsx') THEN 'excel' WHEN type IN ('text/plain', 'text/markdown') OR ext IN ('txt', 'md', 'text') THEN 'text' ELSE 'others' END"""
BUCKETS = "SELECT method, route, status_code, b.le, count(*) FILTER (WHERE duration_s <= b.le) AS cumulative, count(*) AS total, round(sum(duration_s), 6) AS sum_s FROM fx_requests, (SELECT unnest([0.025, 0.05, 0.1, 0.25, 0.5, 1, 2, 5, 'inf'::DOUBLE]) AS le) b GROUP BY ALL"
COUNTS = {k: f"CAST(len(regexp_extract_all(text, '{p}')) AS BIGINT)" for k, p in guard.PATTERNS.items()}

#: name: (query, SQL or None). `t` loads a table or view.
QUERIES = {
    "chunk_documents": (lambda t: text.chunk(t("fx_paragraphs")), CHUNKS),
    "index_chunks": (
        lambda t: text.index_chunks(t("fx_paragraphs").withColumn("filename", F.lit(None).cast("string"))),
        f"""SELECT concat(CAST(doc_id AS VARCHAR), '_', CAST(chunk AS VARCHAR)) AS chunk_id, doc_id, chunk, 'document.txt' AS filename, CAST(NULL AS VARCHAR) AS sheet, text
           FROM ({CHUNKS})""",
    ),
    "scan_sensitive": (
        lambda t: t("documents").select("doc_id", *[c.alias(k) for k, c in guard.sensitive_counts(F.col("text")).items()]),
        f"""SELECT doc_id, {', '.join(f'{c} AS {k}' for k, c in COUNTS.items())}
           FROM documents""",
    ),
    "pii_summary": (
        lambda t: guard.pii_summary(t("documents")),
        f"""SELECT category, count(*) AS documents, CAST(sum(n) AS BIGINT) AS hits
           FROM (UNPIVOT (SELECT {', '.join(f'{c} AS {k}' for k, c in COUNTS.items())}
           FROM documents) ON {', '.join(COUNTS)} INTO NAME category VALUE n)
           WHERE n > 0
           GROUP BY category""",
    ),
    "keywords": (
        lambda t: t("documents").select("doc_id", F.size(keywords(F.col("text"))).alias("n"), F.array_join(F.sort_array(keywords(F.col("text"))), " ").alias("terms")),
        f"""SELECT doc_id, CAST(len(k) AS INT) AS n, array_to_string(list_sort(k), ' ') AS terms
           FROM (SELECT doc_id, {terms_sql('text')} AS k
           FROM documents)""",
    ),
    "links": (
        lambda t: t("pages").select("page_id", guard.has_link(F.col("html")).alias("link")),
        """SELECT page_id, regexp_matches(html, '(https?://\\S+|www\\.\\S+|ftp://\\S+|mailto:\\S+|t\\.me/\\S+|discord\\.gg/\\S+)', 'i') AS link
           FROM pages""",
    ),
    "consent_gate": (
        lambda t: guard.consent_gate(guard.scan_sensitive(t("documents")), t("documents").filter("doc_id % 3 = 0").select("doc_id", (F.col("doc_id") % 2 == 0).alias("confirmed"))),
        f"""SELECT doc_id, found AS sensitive, doc_id % 6 = 0 AS confirmed, NOT found OR doc_id % 6 = 0 AS allowed
           FROM (SELECT doc_id, {' + '.join(COUNTS.values())} > 0 AS found
           FROM documents)""",
    ),
    "knn": (lambda t: retrieve.knn(t("fx_questions"), t("fx_vectors")), KNN),
    "knn_l2sq": (
        lambda t: retrieve.knn(t("fx_questions"), t("fx_vectors"), metric="l2sq"),
        KNN.replace(COSINE, "round(list_sum(list_transform(list_zip(q.embedding, c.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))), 6)"),
    ),
    "rerank": (
        lambda t: retrieve.rerank(retrieve.knn(t("fx_questions"), t("fx_vectors")), t("fx_questions"), t("fx_vectors")).select("question_id", "doc_id", "chunk", "distance", "rank", "overlap", "score", "score_rank"),
        RERANK,
    ),
    "select_context": (
        lambda t: retrieve.select_context(retrieve.rerank(retrieve.knn(t("fx_questions"), t("fx_vectors")), t("fx_questions"), t("fx_vectors"))),
        SELECTED,
    ),
    "context_text": (
        lambda t: retrieve.context_text(retrieve.select_context(retrieve.rerank(retrieve.knn(t("fx_questions"), t("fx_vectors")), t("fx_questions"), t("fx_vectors"))), t("fx_vectors")),
        f"""SELECT question_id, string_agg(text, chr(10) || chr(10)
           ORDER BY position) AS context
           FROM ({SELECTED})
           JOIN fx_vectors USING (doc_id, chunk)
           GROUP BY question_id""",
    ),
    "document_context": (
        lambda t: retrieve.document_context(t("fx_paragraphs"), text.chunk(t("fx_paragraphs"))),
        f"""SELECT doc_id, substr({STRIP.format('coalesce(j, text)')}, 1, 12000) AS context
           FROM fx_paragraphs
           LEFT JOIN (SELECT doc_id, string_agg(text, chr(10) || chr(10)
           ORDER BY chunk) AS j
           FROM ({CHUNKS})
           WHERE chunk < 500
           GROUP BY doc_id) USING (doc_id)""",
    ),
    "keyword_search": (
        lambda t: retrieve.keyword_search(_asked(t), _owned(t)),
        """WITH post AS (SELECT user_id, doc_id, chunk, term, count(*) AS tf FROM (SELECT user_id, doc_id, chunk, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')) AS term FROM owned) WHERE term <> '' GROUP BY ALL),
n AS (SELECT user_id, count(*) AS total FROM owned GROUP BY user_id), df AS (SELECT user_id, term, count(*) AS df FROM post GROUP BY ALL), a AS (SELECT DISTINCT query_id, user_id, term FROM (SELECT query_id, user_id, unnest(regexp_split_to_array(lower(q), '[^\\p{L}\\p{N}]+')) AS term FROM asked) WHERE term <> ''),
s AS (SELECT query_id, doc_id, chunk, round(sum(tf * ln(1 + total / df)), 6) AS score FROM a JOIN post USING (user_id, term) JOIN df USING (user_id, term) JOIN n USING (user_id) GROUP BY ALL)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, chunk) AS INT) AS rank FROM s) WHERE rank <= 20""",
    ),
    "substring_search": (
        lambda t: retrieve.substring_search(_asked(t), _owned(t)).drop("score"),
        """SELECT *
           FROM (SELECT query_id, doc_id, chunk, CAST(row_number() OVER (PARTITION BY query_id
           ORDER BY doc_id, chunk) AS INT) AS rank
           FROM asked
           JOIN owned USING (user_id)
           WHERE contains(lower(text), lower(regexp_replace(q, '^\\s+|\\s+$', '', 'g'))) AND regexp_replace(q, '^\\s+|\\s+$', '', 'g') <> '')
           WHERE rank <= 20""",
    ),
    "snippet": (
        lambda t: t("documents").select("doc_id", retrieve.snippet(F.col("text"), F.lit("tion")).alias("snippet")),
        """SELECT doc_id, substr(text, CAST(greatest(1, instr(lower(text), 'tion') - 60) AS BIGINT), 180) AS snippet
           FROM documents""",
    ),
    "documents_from_chunks": (
        lambda t: retrieve.documents_from_chunks(t("fx_documents").withColumn("filename", F.col("name")).withColumn("chunk", F.lit(0))),
        """SELECT doc_id, name AS filename, regexp_extract(name, '\\.([^.]+)$', 1) AS type, 0 AS size
           FROM fx_documents""",
    ),
    "overview": (
        lambda t: chat.overview(t("fx_messages")),
        """SELECT conv_id, count(*) AS message_count, arg_max(role, turn) AS last_role, arg_max(text, turn) AS last_text
           FROM fx_messages
           GROUP BY conv_id""",
    ),
    "feedback_summary": (
        lambda t: chat.feedback_summary(t("fx_messages")),
        """SELECT 'positive' AS rating, count(*) FILTER (WHERE rating = 'positive') AS n
           FROM fx_messages
           WHERE role = 'assistant'
           UNION ALL SELECT 'negative', count(*) FILTER (WHERE rating = 'negative')
           FROM fx_messages
           WHERE role = 'assistant'""",
    ),
    "apply_ratings": (
        lambda t: chat.apply_ratings(t("fx_messages"), t("events").select((F.col("event_id") % 60).alias("conv_id"), (F.col("event_id") % 5).alias("turn"), F.when(F.col("event_type") == "click", "positive").when(F.col("event_type") == "view", "negative").otherwise("bad").alias("rating"), F.col("event_id").alias("ts"))),
        """SELECT r.conv_id, r.turn, r.rating, CASE WHEN r.rating = 'bad' THEN 'bad rating' WHEN m.role IS NULL THEN 'no such turn' WHEN m.role <> 'assistant' THEN 'not an answer' END AS reason
           FROM (SELECT event_id % 60 AS conv_id, event_id % 5 AS turn, arg_max(CASE event_type WHEN 'click' THEN 'positive' WHEN 'view' THEN 'negative' ELSE 'bad' END, event_id) AS rating
           FROM events
           GROUP BY ALL) r
           LEFT JOIN fx_messages m USING (conv_id, turn)""",
    ),
    "snapshot_hash": (lambda t: chat.snapshot_hash(t("fx_messages")), SNAP),
    "plan_shares": (
        lambda t: chat.plan_shares(chat.snapshot_hash(t("fx_messages")), _shares(t), NOW).select("conv_id", "action", F.when(F.col("action") == "reuse", F.col("share_id")).alias("share_id"), "expires_at"),
        f"""SELECT conv_id, CASE WHEN s.h = a.snapshot_hash THEN 'reuse' ELSE 'new' END AS action, CASE WHEN s.h = a.snapshot_hash THEN concat('s', CAST(conv_id AS VARCHAR)) END AS share_id, TIMESTAMP '2024-01-03 12:00:00' AS expires_at
           FROM ({SNAP}) a
           LEFT JOIN (SELECT conv_id, sha256(string_agg(concat(role, chr(10), text, chr(10)), ''
           ORDER BY turn)) AS h
           FROM fx_messages
           WHERE turn <= 2
           GROUP BY conv_id) s USING (conv_id)""",
    ),
    "transcript": (
        lambda t: chat.transcript(t("fx_messages")),
        """SELECT conv_id, n, n // 6 + 1 AS page, CASE WHEN role = 'user' THEN 'You' ELSE 'Assistant' END AS label, text, sent_at
           FROM (SELECT *, CAST(row_number() OVER (PARTITION BY conv_id
           ORDER BY turn) - 1 AS INT) AS n
           FROM fx_messages)""",
    ),
    "totals": (
        lambda t: admin.totals(t("fx_users"), t("fx_documents"), t("fx_messages"), t("fx_reports")),
        """SELECT (SELECT count(*)
           FROM fx_users) AS users, (SELECT count(*)
           FROM fx_documents) AS documents, (SELECT count(DISTINCT conv_id)
           FROM fx_messages) AS chats, (SELECT count(*)
           FROM fx_reports) AS reports, (SELECT CAST(sum(size) AS BIGINT)
           FROM fx_documents) AS storage_bytes""",
    ),
    "conversion_rate": (
        lambda t: admin.conversion_rate(t("fx_documents")),
        """SELECT *, CASE WHEN word_documents > 0 THEN CAST(round(100.0 * converted / word_documents) AS BIGINT) ELSE 0 END AS percent
           FROM (SELECT count(*) FILTER (WHERE original_type = 'application/msword') AS word_documents, count(*) FILTER (WHERE original_type = 'application/msword' AND type = 'application/pdf') AS converted
           FROM fx_documents)""",
    ),
    "online_users": (
        lambda t: admin.online_users(t("fx_users"), _said(t), t("fx_documents"), NOW, MINUTES),
        f"""SELECT count(DISTINCT user_id) AS online_users
           FROM (SELECT user_id, last_login AS ts
           FROM fx_users
           WHERE is_active
           UNION ALL SELECT conv_id, sent_at
           FROM fx_messages
           UNION ALL SELECT user_id, uploaded_at
           FROM fx_documents)
           WHERE ts BETWEEN TIMESTAMP '{NOW}' - INTERVAL {MINUTES} MINUTES AND TIMESTAMP '{NOW}'""",
    ),
    "document_types": (
        lambda t: admin.document_types(t("fx_documents")),
        f"""SELECT class, coalesce(n, 0) AS n
           FROM (SELECT unnest(['pdf','word','powerpoint','excel','text','others']) AS class)
           LEFT JOIN (SELECT {DOC_CLASS} AS class, count(*) AS n
           FROM (SELECT type, lower(regexp_extract(name, '([^.]*)$', 1)) AS ext
           FROM fx_documents)
           GROUP BY 1) USING (class)""",
    ),
    "report_types": (
        lambda t: admin.report_types(t("fx_reports")),
        f"""SELECT class, coalesce(n, 0) AS n
           FROM (SELECT unnest(['bug','feature_request','feedback','other']) AS class)
           LEFT JOIN (SELECT {class_sql()} AS class, count(*) AS n
           FROM fx_reports
           GROUP BY 1) USING (class)""",
    ),
    "report_summary": (
        lambda t: admin.report_summary(t("fx_reports")),
        f"""SELECT count(*) AS total, count(*) FILTER (WHERE status = 'resolved') AS resolved, count(*) FILTER (WHERE status = 'open') AS open_reports, count(*) FILTER (WHERE c = 'bug') AS bug, count(*) FILTER (WHERE c = 'feature') AS feature, count(*) FILTER (WHERE c = 'feedback') AS feedback, count(*) FILTER (WHERE c = 'other') AS other
           FROM (SELECT status, {class_sql('feature')} AS c
           FROM fx_reports)""",
    ),
    "recent_activity": (
        lambda t: admin.recent_activity(t("fx_documents"), t("fx_users")),
        """SELECT doc_id, label, concat(coalesce(u.name, 'Unknown'), CASE WHEN label = 'convert' THEN ' converted ' ELSE ' uploaded ' END, d.name) AS description, uploaded_at
           FROM (SELECT *, CASE WHEN original_type <> '' THEN 'convert' ELSE 'upload' END AS label
           FROM fx_documents
           ORDER BY uploaded_at DESC, doc_id DESC
           LIMIT 20) d
           LEFT JOIN fx_users u USING (user_id)""",
    ),
    "weekly_growth": (
        lambda t: admin.weekly_growth(t("fx_users"), t("fx_reports"), LATER),
        f"""SELECT CAST(isodow(day) AS INT) AS iso_day, day, coalesce(u.n, 0) AS new_users, coalesce(r.n, 0) AS new_reports
           FROM (SELECT CAST(unnest(range(TIMESTAMP '2024-01-14', TIMESTAMP '2024-01-21', INTERVAL 1 DAY)) AS DATE) AS day)
           LEFT JOIN (SELECT CAST(created_at AS DATE) AS day, count(*) AS n
           FROM fx_users
           WHERE created_at <= TIMESTAMP '{LATER}'
           GROUP BY 1) u USING (day)
           LEFT JOIN (SELECT CAST(created_at AS DATE) AS day, count(*) AS n
           FROM fx_reports
           WHERE created_at <= TIMESTAMP '{LATER}'
           GROUP BY 1) r USING (day)""",
    ),
    "user_page": (
        lambda t: admin.user_page(t("fx_users"), "user1", "name", False, 2, 20),
        """SELECT *
           FROM fx_users
           WHERE regexp_matches(name, 'user1', 'i') OR regexp_matches(email, 'user1', 'i')
           ORDER BY name, user_id
           LIMIT 20 OFFSET 20""",
    ),
    "user_totals": (
        lambda t: admin.user_totals(t("fx_users"), "7@"),
        """SELECT count(*) AS total, count(*) FILTER (WHERE is_active) AS active, count(*) FILTER (WHERE is_admin) AS admins
           FROM fx_users
           WHERE contains(email, '7@')""",
    ),
    "user_stats": (
        lambda t: admin.user_stats(t("fx_users"), t("fx_documents"), _said(t)),
        """SELECT user_id, coalesce(d.n, 0) AS document_count, CAST(coalesce(d.s, 0) AS BIGINT) AS total_storage, coalesce(c.n, 0) AS chat_count
           FROM fx_users
           LEFT JOIN (SELECT user_id, count(*) AS n, sum(size) AS s
           FROM fx_documents
           GROUP BY 1) d USING (user_id)
           LEFT JOIN (SELECT conv_id AS user_id, count(DISTINCT conv_id) AS n
           FROM fx_messages
           GROUP BY 1) c USING (user_id)""",
    ),
    "document_page_by_size": (
        lambda t: admin.document_page(t("fx_documents"), t("fx_users"), "file_", "", 2, 15, "size", True),
        """SELECT d.user_id, doc_id, d.name, type, size, uploaded_at, u.name AS owner
           FROM (SELECT *
           FROM fx_documents
           WHERE contains(name, 'file_')
           ORDER BY size, doc_id
           LIMIT 15 OFFSET 15) d
           LEFT JOIN fx_users u USING (user_id)""",
    ),
    "document_page": (
        lambda t: admin.document_page(t("fx_documents"), t("fx_users"), "file_1", "text/plain"),
        """SELECT d.user_id, doc_id, d.name, type, size, uploaded_at, u.name AS owner
           FROM (SELECT *
           FROM fx_documents
           WHERE contains(name, 'file_1') AND type = 'text/plain'
           ORDER BY uploaded_at DESC, doc_id DESC
           LIMIT 20) d
           LEFT JOIN fx_users u USING (user_id)""",
    ),
    "report_page": (
        lambda t: admin.report_page(t("fx_reports"), "open", "crash", "2024-01-03", "2024-01-05"),
        """SELECT *
           FROM fx_reports
           WHERE status = 'open' AND (contains(lower(name), 'crash') OR contains(lower(email), 'crash') OR contains(lower(subject), 'crash') OR contains(lower(message), 'crash')) AND created_at >= TIMESTAMP '2024-01-03' AND created_at < TIMESTAMP '2024-01-06'
           ORDER BY created_at DESC, report_id DESC
           LIMIT 20""",
    ),
    "report_by_day": (
        lambda t: admin.report_timeseries(t("fx_reports"), "day", LATER, "2024-01-03", "2024-01-10"),
        """SELECT strftime(created_at, '%Y-%m-%d') AS bucket, count(*) AS n
           FROM fx_reports
           WHERE created_at >= TIMESTAMP '2024-01-03' AND created_at < TIMESTAMP '2024-01-11'
           GROUP BY 1""",
    ),
    "report_by_week": (
        lambda t: admin.report_timeseries(t("fx_reports"), "week", LATER, "2024-01-01", "2024-01-17"),
        """SELECT strftime(created_at, '%G-%V') AS bucket, count(*) AS n
           FROM fx_reports
           WHERE created_at >= TIMESTAMP '2024-01-01' AND created_at < TIMESTAMP '2024-01-18'
           GROUP BY 1""",
    ),
    "report_by_month": (
        lambda t: admin.report_timeseries(t("fx_reports"), "month", LATER),
        """SELECT strftime(created_at, '%Y-%m') AS bucket, count(*) AS n
           FROM fx_reports
           WHERE created_at >= TIMESTAMP '2024-01-14 12:00:00' AND created_at < TIMESTAMP '2024-01-21'
           GROUP BY 1""",
    ),
    "cascade_delete": (
        lambda t: admin.cascade_delete(t("fx_users").filter("user_id % 7 = 0"), 14, t("fx_users"), documents=t("fx_documents"), reports=t("fx_reports"))[1],
        """SELECT 'users' AS "table", count(*) AS removed
           FROM fx_users
           WHERE user_id % 7 = 0 AND user_id <> 14
           UNION ALL SELECT 'documents', count(*)
           FROM fx_documents
           WHERE user_id IN (SELECT user_id
           FROM fx_users
           WHERE user_id % 7 = 0 AND user_id <> 14)
           UNION ALL SELECT 'reports', count(*)
           FROM fx_reports
           WHERE user_id IN (SELECT user_id
           FROM fx_users
           WHERE user_id % 7 = 0 AND user_id <> 14)""",
    ),
    "delete_documents": (
        lambda t: admin.delete_documents(t("fx_documents").filter("doc_id % 4 = 0"), documents=t("fx_documents"))["documents"].select("doc_id", "name"),
        """SELECT doc_id, name
           FROM fx_documents
           WHERE doc_id % 4 <> 0""",
    ),
    "my_documents": (
        lambda t: admin.my_documents(t("fx_documents"), 10),
        """SELECT doc_id, name, pinned, pinned_at, uploaded_at,
                  CAST(row_number() OVER (ORDER BY pinned DESC, pinned_at DESC NULLS LAST, uploaded_at DESC, doc_id) AS INT) AS position
           FROM fx_documents WHERE user_id = 10""",
    ),
    "history_view": (
        lambda t: admin.history_view(t("fx_documents"), 10, "FILE", "size", True),
        """SELECT doc_id, name, size, pinned, uploaded_at, CAST(row_number() OVER (ORDER BY pinned DESC, size, doc_id) AS INT) AS position
           FROM fx_documents WHERE user_id = 10 AND contains(lower(name), 'file')""",
    ),
    "rate_limit": (
        lambda t: admin.rate_limit(t("events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"))).withColumn("retry_hours", F.col("retry_hours").cast("string")),
        f"""{ANCHORS}
            SELECT user_id, CAST(ts AS TIMESTAMP) AS ts, k <= 3 AS allowed, CAST(least(k, 3) AS INT) AS count_in_window,
                   CASE WHEN k > 3 THEN CAST(CAST(ceil(date_diff('microsecond', ts, t0 + INTERVAL 24 HOURS) / 3600000000) AS BIGINT) AS VARCHAR) END AS retry_hours
            FROM counted""",
    ),
    "activity_log": (
        lambda t: admin.activity_log(t("fx_documents").withColumn("status", F.when(F.col("doc_id") % 5 == 0, "failed").when(F.col("doc_id") % 5 == 1, "awaiting-consent").otherwise("done")), t("fx_users"), "error"),
        """SELECT doc_id, 'error' AS level, coalesce(u.name, 'Unknown') AS user_name, d.name, uploaded_at
           FROM (SELECT *
           FROM fx_documents
           ORDER BY uploaded_at DESC, doc_id DESC
           LIMIT 100) d
           LEFT JOIN fx_users u USING (user_id)
           WHERE doc_id % 5 = 0
           ORDER BY uploaded_at DESC, doc_id DESC
           LIMIT 20""",
    ),
    "metrics_summary": (
        lambda t: metrics.summary(t("fx_requests")),
        """SELECT count(*) AS requests, CAST(round(sum(duration_s) / count(*) * 1000) AS BIGINT) AS mean_ms, round(100.0 * count(*) FILTER (WHERE status_code BETWEEN 200 AND 299) / count(*), 2) AS success_percent
           FROM fx_requests""",
    ),
    "request_histogram": (lambda t: metrics.request_histogram(t("fx_requests")), BUCKETS),
    "histogram_percentiles": (
        lambda t: metrics.histogram_percentiles(metrics.request_histogram(t("fx_requests")), [0.5, 0.9, 0.99]),
        f"""SELECT p, round(min(le) * 1000) AS bound_ms
           FROM (SELECT le, sum(cumulative) AS c
           FROM ({BUCKETS})
           GROUP BY le) h, (SELECT unnest([0.5, 0.9, 0.99])::DOUBLE AS p)
           WHERE c >= p * (SELECT count(*)
           FROM fx_requests)
           GROUP BY p""",
    ),
    "top_routes": (
        lambda t: metrics.top_routes(metrics.request_histogram(t("fx_requests"))),
        f"""SELECT route, n, round(min(le) * 1000) AS p90_ms
           FROM (SELECT route, le, CAST(sum(cumulative) AS BIGINT) AS c
           FROM ({BUCKETS})
           GROUP BY ALL)
           JOIN (SELECT route, count(*) AS n
           FROM fx_requests
           GROUP BY route) USING (route)
           WHERE c >= 0.9 * n
           GROUP BY ALL
           ORDER BY n DESC, route
           LIMIT 5""",
    ),
    "converted_name": (
        lambda t: intake.converted_name(t("fx_documents")).select("doc_id", "stored_name", "converted"),
        """SELECT doc_id, regexp_replace(name, '\\.(docx?|DOCX?)$', '.pdf') AS stored_name, coalesce(original_type = 'application/msword' AND type = 'application/pdf', FALSE) AS converted
           FROM fx_documents""",
    ),
}


def _owned(t):
    return t("fx_vectors").withColumn("user_id", F.col("doc_id") % 3)


def _asked(t):
    return t("benchmark").select(F.col("item_id").alias("query_id"), (F.col("item_id") % 3).alias("user_id"), F.col("text").alias("q"))


def _said(t):
    return t("fx_messages").withColumn("user_id", F.col("conv_id"))


def _shares(t):
    early = chat.snapshot_hash(t("fx_messages").filter("turn <= 2"))
    return early.select(F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("share_id"), "conv_id", "snapshot_hash", F.lit("2024-01-01 00:00:00").cast("timestamp").alias("created_at"))


EXTRA = {"owned": "owned AS (SELECT *, doc_id % 3 AS user_id FROM fx_vectors)", "asked": "asked AS (SELECT item_id AS query_id, item_id % 3 AS user_id, text AS q FROM benchmark)"}


def full_sql(sql: str) -> str:
    own = [EXTRA[k] for k in EXTRA if f" {k}" in sql]
    if own:
        rest = sql.removeprefix("WITH ")
        sql = "WITH " + ", ".join(own) + (", " if sql.startswith("WITH ") else " ") + rest
    body = with_views(sql)
    if body is not sql and sql.startswith("WITH "):
        head = body[: len(body) - len(sql)].rstrip()
        body = f"{head},\n{sql.removeprefix('WITH ')}"
    return body


def all_queries():
    from quire.plans import changes, gates, indexes, live, study

    return QUERIES | gates.QUERIES | study.QUERIES | changes.QUERIES | live.QUERIES | indexes.QUERIES


def load_from(spark, sf_dir):
    def t(name):
        return load(spark, sf_dir, name)

    t.spark, t.folder = spark, sf_dir
    return t


def queries():
    return {name: (lambda s, d, f=f: f(load_from(s, d))) for name, (f, _) in all_queries().items()}


def oracle_sql():
    return {name: full_sql(sql) for name, (_, sql) in all_queries().items() if sql}
