"""Registered queries of routing, state, greetings, text clean-up, headings and intake, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import guard, intake, retrieve, text
from quire.plans.queries import CHUNKS, COUNTS, SELECTED, STRIP

FOUND = " + ".join(COUNTS.values())
NOT_WORD = "[^\\p{L}\\p{N}_]"


def words_sql(words: list[str]) -> str:
    return f"(^|{NOT_WORD})({'|'.join(w.replace(chr(39), chr(39) * 2) for w in words)})($|{NOT_WORD})"


def squeezed(column: str) -> str:
    return f"regexp_replace({STRIP.format(f'lower(coalesce({column}, {chr(39) * 2}))')}, '\\s+', ' ', 'g')"


def greeting_sql(column: str) -> str:
    """Whether a squeezed text is a greeting."""
    short = f"length({column}) <= 40 AND NOT contains({column}, '?') AND regexp_matches({column}, '{words_sql([*guard.GREETINGS, *guard.CHATTER])}')"
    return f"{column} <> '' AND (({short}) OR regexp_matches({column}, '{words_sql(guard.GREETINGS)}'))"


#: State of documents after their events, from `states` (doc_id, ts, seq, kind, turn, question): what scans said so far; then the last event that
#: set the consent (the form, or a yes while the document was sensitive); then the last that set or ended the waiting.
STATES = """scanned AS (
  SELECT *, last_value(CASE WHEN kind LIKE 'scan%' THEN kind = 'scan_hit' END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ts, seq) AS hit FROM states),
settled AS (
  SELECT *, last_value(CASE WHEN kind IN ('agree', 'refuse') THEN kind = 'agree' WHEN kind = 'yes' AND hit THEN TRUE END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ts, seq) AS sure FROM scanned),
gated AS (SELECT *, coalesce(hit, FALSE) AND NOT coalesce(lag(sure) OVER (PARTITION BY doc_id ORDER BY ts, seq), FALSE) AS gate FROM settled),
consents AS (
  SELECT doc_id, coalesce(arg_max(hit, (ts, seq)), FALSE) AS sensitive, coalesce(arg_max(sure, (ts, seq)), FALSE) AS confirmed,
         coalesce(arg_max(gate AND kind = 'ask', (ts, seq)) FILTER (WHERE kind LIKE 'scan%' OR kind IN ('agree', 'refuse') OR (gate AND kind IN ('yes', 'no', 'ask'))), FALSE) AS awaiting
  FROM (SELECT doc_id, ts, seq, kind, coalesce(hit, FALSE) AS hit, coalesce(sure, FALSE) AS sure, gate FROM gated) GROUP BY doc_id),
fallbacks AS (
  SELECT doc_id, question AS pending FROM (
    SELECT doc_id, turn, question, row_number() OVER (PARTITION BY doc_id ORDER BY seq DESC) AS k FROM states WHERE turn <> 'other')
  WHERE k = 1 AND turn IN ('empty', 'outside'))"""


def routed_sql(asks: str, states: str, indexed: str) -> str:
    answered = lambda name: f"CASE WHEN s IN ('y', 'yes') THEN '{name}-yes' WHEN s IN ('n', 'no') THEN '{name}-no' ELSE '{name}-pending' END"
    return f"""WITH states AS ({states}), {STATES},
rude AS (SELECT DISTINCT question_id FROM (SELECT question_id, unnest(regexp_split_to_array(lower(question), '[^\\p{{L}}\\p{{N}}_'']+')) AS word FROM ({asks}))
         WHERE word IN (SELECT lower(c_mktsegment) FROM customer)),
routes AS (SELECT question_id, CASE
  WHEN s = '' THEN 'empty' WHEN {greeting_sql('s')} THEN 'greeting'
  WHEN regexp_matches(question, '(https?://\\S+|www\\.\\S+|ftp://\\S+|mailto:\\S+|t\\.me/\\S+|discord\\.gg/\\S+)', 'i') THEN 'link'
  WHEN question_id IN (SELECT question_id FROM rude) THEN 'profanity' WHEN doc_id IS NULL THEN 'no-document'
  WHEN doc_id IN (SELECT doc_id FROM consents WHERE sensitive AND NOT confirmed) THEN {answered('consent')}
  WHEN doc_id IN (SELECT doc_id FROM fallbacks) THEN {answered('fallback')}
  WHEN doc_id NOT IN ({indexed}) THEN 'not-indexed' ELSE 'retrieve' END AS route
FROM (SELECT *, {squeezed('question')} AS s FROM ({asks})))"""


def length_model():
    """A model that gives nothing for some texts."""
    return lambda texts: [[len(t), 1.0] if len(t) % 5 else None for t in texts]


def _route(t):
    chunks = text.chunk(t("fx_paragraphs"))
    rude = guard.has_profanity(t("fx_asks"), t("customer").select(F.col("c_mktsegment").alias("word")), "question_id", "question")
    states = t("fx_states")
    pending = guard.fallback_state(states.withColumn("kind", F.col("turn")))
    return guard.route_question(t("fx_asks"), guard.consent_state(states), pending, retrieve.has_index(t("documents"), chunks).select("doc_id"), rude)


def _routes(t):
    """Routes of the questions about documents, whose states are those of ten documents."""
    q = t("fx_questions")
    state = t("fx_states").withColumn("doc_id", F.col("doc_id") % 10)
    rude = guard.has_profanity(q, t("customer").select(F.col("c_mktsegment").alias("word")), "question_id", "question")
    return guard.route_question(q, guard.consent_state(state), guard.fallback_state(state.withColumn("kind", F.col("turn"))), t("fx_vectors").select("doc_id"), rude)


def _answers(t):
    told = retrieve.answer_questions(t("fx_questions"), t("fx_vectors"), _routes(t))
    chunks = F.array_join(F.transform("chunks", lambda x: x.cast("string")), ",")
    return told.select("question_id", "route", F.coalesce(F.length("context"), F.lit(0)).alias("n_chars"), F.coalesce(chunks, F.lit("")).alias("chunks"))


def _topics(t):
    gate = guard.consent_gate(guard.scan_sensitive(t("documents")), t("documents").select("doc_id", (F.col("doc_id") % 2 == 0).alias("confirmed")))
    return text.suggest_topics(t("documents"), gate).select("doc_id", F.array_join("topics", "|").alias("topics"))


def _files(t):
    """The files of the documents table, with a size, name or type that some check refuses."""
    d = t("fx_documents")
    name = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("a/b?"), "name")).when(F.col("doc_id") % 11 == 0, F.concat(F.repeat(F.lit("n"), 300), "name")).otherwise(F.col("name"))
    return d.select("doc_id", name.alias("name"), "type", (F.col("size") * F.when(F.col("doc_id") % 5 == 0, 10_000).otherwise(1)).alias("size"))


FILES = """SELECT doc_id, type, CASE WHEN doc_id % 7 = 0 THEN concat('a/b?', name) WHEN doc_id % 11 = 0 THEN concat(repeat('n', 300), name) ELSE name END AS name,
                  size * CASE WHEN doc_id % 5 = 0 THEN 10000 ELSE 1 END AS size
           FROM fx_documents"""
#: Sections: parts that begin at a line of the marker, numbered from 0.
SECTIONED = "SELECT doc_id, replace(text, ' the ', concat(chr(10), '# Sheet: the', chr(10))) AS text FROM {}"
HEADINGS = f"""SELECT doc_id, rank, regexp_replace(line, '[: .]+$', '') AS heading FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS INT) AS rank FROM (
    SELECT doc_id, key, min(pos) AS pos, arg_min(line, pos) AS line FROM (
      SELECT doc_id, pos, line, regexp_replace(lower(line), '^:+|:+$', '', 'g') AS key FROM (
        SELECT doc_id, pos, {STRIP.format('raw')} AS line FROM (
          SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS raw FROM (SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '\\r\\n|[\\n\\r]') AS l FROM documents)))
      WHERE line <> '' AND length(line) <= 100 AND (
        regexp_matches(line, '^[0-9]+(\\.[0-9]+){{0,3}}\\s+.{{3,80}}$') OR (line = upper(line) AND length(line) BETWEEN 3 AND 80)
        OR (ends_with(line, ':') AND length(line) BETWEEN 3 AND 80) OR regexp_matches(lower(line), '{'|'.join(x.lower() for x in text.TOPICS)}')
        OR (len(regexp_split_to_array(line, '\\s+')) <= 8 AND regexp_matches(line, '^\\p{{Lu}}'))))
    GROUP BY doc_id, key)) WHERE rank <= 6"""
GENERAL = "|".join(text.TOPICS[:6])


def rewritten(column: str, *rules: tuple[str, str]) -> str:
    for pattern, by in rules:
        column = f"regexp_replace({column}, '{pattern}', {by}, 'g')"
    return STRIP.format(column)


CLEAN = rewritten("replace(coalesce(text, ''), chr(13), '')", ("([A-Za-z])-\\n+([A-Za-z])", "'\\1\\2'"), ("([^\\n])\\n([a-z0-9(])", "'\\1 \\2'"), ("\\n\\s*\\n\\s*\\n+", "concat(chr(10), chr(10))"), ("(?m)^\\s*[-•*]\\s*", "'• '"))
FORMAT = rewritten(
    "coalesce(text, '')", ("\\n\\s*\\n\\s*\\n+", "concat(chr(10), chr(10))"), ("[ \\t]+", "' '"), ("([\\p{L}\\p{N}_])\\. ([A-Z])", "concat('\\1.', chr(10), chr(10), '\\2')"), ("(?m)^\\s*[-•*]\\s*", "'• '"),
    ("(?m)^\\s*([0-9]+)\\.\\s*", "'\\1. '"), ("([.!?])\\s*(•|[0-9]+\\.)", "concat('\\1', chr(10), chr(10), '\\2')"), (":(\\s*)(•|[0-9]+\\.)", "concat(':', chr(10), chr(10), '\\1\\2')"), ("([^:\\n]):\\s*\\n", "concat('\\1:', chr(10), chr(10))"),
)

QUERIES = {
    "greetings": (
        lambda t: t("conversations").select("conv_id", "turn", guard.is_greeting(F.concat(F.when(F.col("conv_id") % 3 == 0, "Hello,  ").otherwise(""), "text")).alias("greeting")),
        f"""SELECT conv_id, turn, {greeting_sql('s')} AS greeting
            FROM (SELECT conv_id, turn, {squeezed("concat(CASE WHEN conv_id % 3 = 0 THEN 'Hello,  ' ELSE '' END, text)")} AS s FROM conversations)""",
    ),
    "profanity": (
        lambda t: guard.has_profanity(t("documents"), t("benchmark").select(F.element_at(F.split("text", " "), 2).alias("word")), "doc_id", "text"),
        """SELECT DISTINCT doc_id FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_'']+')) AS word FROM documents)
           WHERE word IN (SELECT lower(string_split(text, ' ')[2]) FROM benchmark)""",
    ),
    "out_of_document": (
        lambda t: t("conversations").select("conv_id", "turn", guard.is_out_of_document(F.concat("text", F.when(F.col("turn") % 4 == 1, "  I couldn't  FIND it").otherwise(""))).alias("outside")),
        f"""SELECT conv_id, turn, {' OR '.join(f"contains(s, '{p.replace(chr(39), chr(39) * 2)}')" for p in guard.OUT_OF_DOCUMENT)} AS outside
            FROM (SELECT conv_id, turn, {squeezed("concat(text, CASE WHEN turn % 4 = 1 THEN '  I couldn''t  FIND it' ELSE '' END)")} AS s FROM conversations)""",
    ),
    "consent_state": (lambda t: guard.consent_state(t("fx_states")), f"WITH states AS (SELECT * FROM fx_states), {STATES}\nSELECT * FROM consents"),
    "fallback_state": (lambda t: guard.fallback_state(t("fx_states").withColumn("kind", F.col("turn"))), f"WITH states AS (SELECT * FROM fx_states), {STATES}\nSELECT * FROM fallbacks"),
    "processing_status": (
        lambda t: guard.processing_status(t("events").select("event_id", (F.col("event_type") != "error").alias("ok"), (F.col("event_type") == "view").alias("needs_confirmation"), F.when(F.col("event_id") % 2 == 0, "timeout").alias("error"))),
        """SELECT event_id, event_type <> 'error' AS ok, event_type = 'view' AS needs_confirmation,
                  CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'timeout' ELSE 'indexing failed' END END AS error,
                  CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'awaiting-consent' ELSE 'done' END AS status
           FROM events""",
    ),
    "route_question": (_route, routed_sql("SELECT * FROM fx_asks", "SELECT * FROM fx_states", f"SELECT doc_id FROM documents WHERE {STRIP.format('text')} <> ''") + "\nSELECT * FROM routes"),
    "answer_questions": (
        _answers,
        routed_sql("SELECT * FROM fx_questions", "SELECT * REPLACE (doc_id % 10 AS doc_id) FROM fx_states", "SELECT doc_id FROM fx_vectors")
        + f""",
told AS (SELECT question_id, CAST(length(string_agg(text, chr(10) || chr(10) ORDER BY position)) AS INT) AS n_chars, string_agg(CAST(chunk AS VARCHAR), ',' ORDER BY position) AS chunks
         FROM ({SELECTED}) JOIN fx_vectors USING (doc_id, chunk) WHERE question_id IN (SELECT question_id FROM routes WHERE route = 'retrieve') GROUP BY question_id)
SELECT question_id, CASE WHEN route = 'retrieve' AND chunks IS NULL THEN 'no-answer' ELSE route END AS route, coalesce(n_chars, 0) AS n_chars, coalesce(chunks, '') AS chunks
FROM routes LEFT JOIN told USING (question_id)""",
    ),
    "has_index": (
        lambda t: retrieve.has_index(t("fx_documents"), text.chunk(t("fx_paragraphs"))).select("doc_id", "name"),
        f"SELECT doc_id, name FROM fx_documents WHERE {STRIP.format('text')} <> ''",
    ),
    "with_embeddings": (
        lambda t: retrieve.with_embeddings(t("documents").select("doc_id", "text"), length_model).select("doc_id", F.size("embedding").alias("n"), F.get("embedding", 0).cast("double").alias("first")),
        "SELECT doc_id, 2 AS n, CAST(length(text) AS DOUBLE) AS first FROM documents WHERE length(text) % 5 > 0",
    ),
    "index_chunks_embedded": (
        lambda t: text.index_chunks(t("fx_paragraphs").withColumn("filename", F.lit(None).cast("string")), embed=lambda rows: retrieve.with_embeddings(rows, length_model)).select("chunk_id", "doc_id", "chunk", F.md5("text").alias("digest"), F.get("embedding", 0).cast("double").alias("first")),
        f"""SELECT concat(CAST(doc_id AS VARCHAR), '_', CAST(k AS VARCHAR)) AS chunk_id, doc_id, CAST(k AS INT) AS chunk, digest, first FROM (
              SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY chunk) - 1 AS k, md5(text) AS digest, CAST(length(text) AS DOUBLE) AS first FROM ({CHUNKS}) WHERE length(text) % 5 > 0)""",
    ),
    "headings": (lambda t: text.headings(t("documents")), HEADINGS),
    "suggest_topics": (
        _topics,
        f"""SELECT doc_id, CASE WHEN withheld OR own IS NULL THEN '{GENERAL}' ELSE own END AS topics
            FROM (SELECT doc_id, ({FOUND}) > 0 AND doc_id % 2 <> 0 AS withheld FROM documents)
            LEFT JOIN (SELECT doc_id, string_agg(heading, '|' ORDER BY rank) AS own FROM ({HEADINGS}) GROUP BY doc_id) USING (doc_id)""",
    ),
    "clean_selection": (lambda t: t("documents").select("doc_id", F.md5(text.clean_selection(F.col("text"))).alias("digest")), f"SELECT doc_id, md5({CLEAN}) AS digest FROM documents"),
    "format_answer": (lambda t: t("documents").select("doc_id", F.md5(text.format_answer(F.col("text"))).alias("digest")), f"SELECT doc_id, md5({FORMAT}) AS digest FROM documents"),
    "split_sections": (
        lambda t: text.split_sections(t("documents").withColumn("text", F.replace("text", F.lit(" the "), F.lit("\r\n# Sheet:  the \r ")))).select("doc_id", "section", "sheet", F.md5("text").alias("digest")),
        f"""SELECT doc_id, CAST(section AS INT) AS section, CASE WHEN section > 0 THEN 'the' END AS sheet, md5(CASE WHEN n = 1 THEN part ELSE {STRIP.format("replace(replace(part, chr(13) || chr(10), chr(10)), chr(13), chr(10))")} END) AS digest FROM (
              SELECT doc_id, unnest(range(len(l))) AS section, unnest(l) AS part, len(l) AS n FROM (SELECT doc_id, string_split(text, ' the ') AS l FROM documents))
            WHERE {STRIP.format('part')} <> ''""",
    ),
    "validate_files": (
        lambda t: intake.validate_files(_files(t)).select("doc_id", "reason"),
        f"""SELECT doc_id, CASE
              WHEN NOT (coalesce(type IN ('application/pdf', 'application/msword', 'text/plain', 'text/markdown'), FALSE)
                        OR lower(regexp_extract(name, '([^.]*)$', 1)) IN ('pdf', 'doc', 'docx', 'txt', 'md')) THEN 'unsupported type'
              WHEN size > 26214400 THEN 'too large' WHEN regexp_matches(name, '[<>:"/\\\\|?*]') OR length(name) > 255 THEN 'invalid name' END AS reason
            FROM ({FILES})""",
    ),
    "dedupe_files": (
        lambda t: intake.dedupe_files(t("fx_documents").select("doc_id", F.concat(F.lit("f"), (F.col("doc_id") % 50).cast("string")).alias("name"), (F.col("size") % 3).alias("size"), (F.col("doc_id") % 4).alias("last_modified"), F.col("uploaded_at").alias("arrival"))).select("doc_id", "name", "size"),
        """SELECT doc_id, name, size FROM (
             SELECT doc_id, concat('f', CAST(doc_id % 50 AS VARCHAR)) AS name, size % 3 AS size,
                    row_number() OVER (PARTITION BY doc_id % 50, size % 3, doc_id % 4 ORDER BY uploaded_at) AS k FROM fx_documents)
           WHERE k = 1""",
    ),
    "backfill_doc_id": (
        lambda t: intake.backfill_doc_id(t("fx_documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 1, F.col("name")).alias("doc_id"))),
        "SELECT doc_id AS id, CASE WHEN doc_id % 3 = 1 THEN name ELSE CAST(doc_id AS VARCHAR) END AS doc_id FROM fx_documents",
    ),
    "accept_reports": (
        lambda t: intake.accept_reports(t("fx_reports").drop("name", "email"), t("fx_users")).select("report_id", "subject", "name", "email", F.md5("message").alias("digest"), "reason"),
        """SELECT report_id, subject, u.name, u.email, md5(trim(message)) AS digest,
                  CASE WHEN trim(message) = '' THEN 'no message' WHEN u.user_id IS NULL THEN 'unknown user' WHEN length(trim(message)) NOT BETWEEN 10 AND 1000 THEN 'message length' END AS reason
           FROM fx_reports r LEFT JOIN fx_users u USING (user_id)""",
    ),
}
