"""Registered queries of chats, uploads, users and metrics that change or page rows, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import admin, chat, metrics
from quire.plans.queries import NOW, SNAP
from quire.plans.study import CARDS, DECK
from quire.sources import tables

MESSAGE = ["conv_id", "turn", "role", "text", "sent_at", "rating"]


def _submitted(t):
    """Every message handed in again as a submission of its conversation, some with a rating of their own, some with an unknown role."""
    m = t("fx_messages").filter("turn < 2")
    role = F.when((F.col("conv_id") % 5 == 0) & (F.col("turn") == 1), "robot").otherwise(F.col("role"))
    text = F.when(F.col("conv_id") % 7 == 0, "").otherwise(F.col("text"))
    sent = F.when(F.col("turn") == 0, F.col("sent_at"))
    rating = F.when(F.col("conv_id") % 2 == 0, "positive").otherwise("")
    return m.select(F.col("conv_id").alias("submission_id"), "conv_id", F.col("turn").alias("seq"), role.alias("role"), text.alias("text"), sent.alias("sent_at"), rating.alias("rating"))


def _shared(t):
    early = chat.snapshot_hash(t("fx_messages"))
    title = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("t"), F.col("conv_id").cast("string"))).when(F.col("conv_id") % 3 == 1, "")
    expires = F.lit(NOW).cast("timestamp") + F.make_dt_interval(hours=((F.col("conv_id") % 5) - 2).cast("int"))
    return early.select(F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("share_id"), title.alias("title"), F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("d"), F.col("conv_id").cast("string"))).alias("document_name"), expires.alias("expires_at"))


SHARED = f"""SELECT concat('s', CAST(conv_id AS VARCHAR)) AS share_id, CASE WHEN conv_id % 3 = 0 THEN concat('t', CAST(conv_id AS VARCHAR)) WHEN conv_id % 3 = 1 THEN '' END AS title,
  CASE WHEN conv_id % 2 = 0 THEN concat('d', CAST(conv_id AS VARCHAR)) END AS document_name, TIMESTAMP '{NOW}' + to_hours(conv_id % 5 - 2) AS expires_at FROM ({SNAP})"""


def _lines(t):
    """Exposition text of the requests: counters by route, process values, comments, broken lines."""
    r = t("fx_requests").groupBy("route").agg(F.count("*").alias("n"), F.round(F.sum("duration_s"), 3).alias("s"))
    return metrics.parse_exposition(r.select(F.explode(_of_routes()).alias("value")).union(_of_process(t)))


def _of_process(t):
    """The lines of one process over all requests: up as long as they last, busy for their durations, with a page of memory for each."""
    p = t("fx_requests").agg((F.unix_seconds(F.max("ts")) - F.unix_seconds(F.min("ts"))).alias("up"), F.round(F.sum(F.when(F.col("status_code") < 400, F.col("duration_s"))), 3).alias("user"), F.round(F.sum(F.when(F.col("status_code") >= 400, F.col("duration_s"))), 3).alias("system"), (F.count("*") * 4096).alias("rss"))
    names = {"up": "process_uptime_seconds", "user": "process_cpu_user_seconds_total", "system": "process_cpu_system_seconds_total", "rss": "process_resident_memory_bytes"}
    return p.select(F.explode(F.array(*[F.concat(F.lit(f"{name} "), F.col(c).cast("string")) for c, name in names.items()])))


def _of_routes():
    label = F.concat(F.lit('{method="GET",route="'), F.col("route"), F.lit('"}'))
    return F.array(
        F.lit("# HELP requests"), F.concat(F.lit("requests_total"), label, F.lit(" "), F.col("n").cast("string")), F.concat(F.lit("seconds_sum"), label, F.lit(" "), F.col("s").cast("string")),
        F.lit("broken"), F.lit("no_number x"), F.lit('bucket{le="+Inf"} +Inf'),
    )


def _changed(t):
    e = t("events")
    field = F.when(F.col("event_type") == "click", "name").when(F.col("event_type").isin("view", "error"), "pinned").otherwise("other")
    value = F.when(F.col("event_type") == "click", F.concat(F.lit("new "), F.col("event_id").cast("string"))).when(F.col("event_type") == "view", "true").when(F.col("event_type") == "error", "false")
    return e.select((F.col("event_id") % 700).alias("doc_id"), F.col("ts").cast("timestamp").alias("ts"), field.alias("field"), value.alias("value"))


def _logins(t):
    u = t("fx_users")
    google = F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("g"), F.col("user_id").cast("string"))).otherwise(F.concat(F.lit("x"), F.col("user_id").cast("string")))
    email = F.when(F.col("user_id") % 5 == 0, F.concat(F.lit(" New"), F.col("user_id").cast("string"), F.lit("@Example.com"))).otherwise(F.upper("email"))
    one = u.select(F.col("user_id").alias("login_id"), google.alias("google_id"), email.alias("email"), F.when(F.col("user_id") % 2 == 0, " ").otherwise("Said").alias("name"), F.lit("photo").alias("avatar"))
    # new emails once more with another id, and ids that were linked with another email
    again = u.filter("user_id % 5 = 0").select(F.col("user_id") + 10_000_000, F.concat(F.lit("y"), "user_id"), email, F.lit("Again"), F.lit("other"))
    linked = u.filter("user_id % 4 > 0 and user_id % 5 > 0").select(F.col("user_id") + 20_000_000, google, F.concat(F.lit("elsewhere"), "user_id"), F.lit("Again"), F.lit("other"))
    return one.union(again).union(linked)


PROCESS = """SELECT epoch(date_trunc('second', max(ts))) - epoch(date_trunc('second', min(ts))) AS up, round(sum(duration_s) FILTER (WHERE status_code < 400), 3) AS user_s,
  round(sum(duration_s) FILTER (WHERE status_code >= 400), 3) AS system_s, count(*) * 4096 AS rss FROM fx_requests"""
LOGINS = """SELECT user_id AS login_id, concat(CASE WHEN user_id % 2 = 0 THEN 'g' ELSE 'x' END, CAST(user_id AS VARCHAR)) AS google_id,
  lower(trim(CASE WHEN user_id % 5 = 0 THEN concat(' New', CAST(user_id AS VARCHAR), '@Example.com') ELSE upper(email) END)) AS email, CASE WHEN user_id % 2 = 1 THEN 'Said' END AS name FROM fx_users"""


def _upserted(t):
    v = t("fx_vectors").select("doc_id", F.col("chunk").cast("int").alias("chunk"), F.lit(0).cast("long").alias("user_id"), F.lit("old.txt").alias("filename"), F.lit(None).cast("string").alias("sheet"), "text", "embedding")
    d = t("fx_documents")
    new = d.select(
        (F.col("doc_id") % 20).alias("doc_id"), F.when(F.col("doc_id") % 20 == 4, "x").otherwise((F.col("doc_id") % 30).cast("string")).alias("chunk"), F.when(F.col("doc_id") % 3 == 0, "").otherwise("new.txt").alias("filename"),
        F.when(F.col("doc_id") % 2 == 0, "").otherwise("Sheet1").alias("sheet"), F.when(F.col("doc_id") % 9 > 0, F.col("text")).alias("text"), F.lit(None).cast("array<float>").alias("embedding"), F.col("doc_id").alias("seq"),
    )
    return tables.upsert_chunks(new, v, d).select("doc_id", "chunk", "user_id", "filename", "sheet", F.md5("text").alias("digest"), F.coalesce(F.size("embedding"), F.lit(0)).alias("n"))


def _cards(t):
    from quire.operators import assets
    from quire.sources.scratch import shared_folder

    path = shared_folder(t.spark, "deck")
    tables.write_flashcards_json(assets.assemble_deck(assets.clean_cards(t("fx_cards"))), path)
    return t.spark.read.schema("request_id long, position int, front string, back string, category string, difficulty string").json(path)


#: What is read of each entity: a key and the characters of some of its columns.
ENTITY_SUMS = {
    "users": ("user_id", "length(concat(name, email))"), "documents": ("doc_id", "length(concat(name, text))"), "chunks": ("chunk", "length(text)"), "messages": ("turn", "length(concat(role, text))"),
    "shares": ("message_count", "length(snapshot_hash)"), "reports": ("report_id", "length(concat(subject, message))"), "requests": ("status_code", "length(concat(method, route))"),
}


def _entities(t):
    """The entity tables written as the store keeps them, and read again with their fixed schemas: rows of each, and sums over what they hold."""
    from quire.sources.scratch import shared_folder

    folder = shared_folder(t.spark, "store")
    rows = {name: t(f"fx_{name}") for name in ("users", "documents", "messages", "reports", "requests")}
    rows["chunks"] = t("fx_vectors").withColumn("chunk", F.col("chunk").cast("int"))
    rows["shares"] = chat.snapshot_hash(t("fx_messages"))
    tables.write_tables(rows, folder)
    out = None
    for name, df in tables.read_tables(t.spark, folder).items():
        key, size = ENTITY_SUMS[name]
        n = df.agg(F.count("*").alias("n"), F.sum(F.col(key).cast("long")).alias("keys"), F.sum(F.expr(size).cast("long")).alias("chars")).select(F.lit(name).alias("entity"), "n", "keys", "chars")
        out = n if out is None else out.union(n)
    return out


def _texts(t):
    from quire.sources.scratch import shared_folder

    folder = shared_folder(t.spark, "files")
    lines = t("conversations").select(F.concat_ws(" ", F.col("conv_id").cast("string"), "role").alias("value")).repartition(3, "value")
    lines.write.text(f"{folder}/plain")
    lines.write.json(f"{folder}/other")
    files = tables.read_text_files(t.spark, f"{folder}/*/part-*")
    lines = files.select(F.explode(F.split("text", "\n")).alias("line")).filter("line <> ''")
    return lines.groupBy("line").agg(F.count("*").alias("n"))


QUERIES = {
    "overview": (
        lambda t: chat.overview(t("fx_messages"), t("fx_messages").select("conv_id").distinct().withColumn("doc_id", F.col("conv_id") * 3), t("fx_documents")),
        """SELECT o.*, d.name AS document_name FROM (
             SELECT conv_id, count(*) AS message_count, arg_max(role, turn) AS last_role, arg_max(text, turn) AS last_text FROM fx_messages GROUP BY conv_id) o
           LEFT JOIN fx_documents d ON d.doc_id = o.conv_id * 3""",
    ),
    "append": (
        lambda t: chat.append(t("fx_messages"), _submitted(t), NOW).select(*MESSAGE),
        f"""SELECT conv_id, turn, role, text, sent_at, rating FROM fx_messages UNION ALL
            SELECT conv_id, top + row_number() OVER (PARTITION BY conv_id ORDER BY turn), role, CASE WHEN conv_id % 7 = 0 THEN '' ELSE text END,
                   CASE WHEN turn = 0 THEN sent_at ELSE TIMESTAMP '{NOW}' END, CASE WHEN role = 'assistant' THEN CASE WHEN conv_id % 2 = 0 THEN 'positive' ELSE 'none' END END
            FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS top, bool_or(turn = 1) OVER (PARTITION BY conv_id) AS second FROM fx_messages)
            WHERE turn < 2 AND NOT (conv_id % 5 = 0 AND second)""",
    ),
    "resolve_shares": (
        lambda t: chat.resolve_shares(t("events").select(F.concat(F.lit("s"), (F.col("event_id") % 400).cast("string")).alias("share_id"), "event_id").distinct().drop("event_id"), _shared(t), NOW),
        f"""SELECT r.share_id, outcome, CASE WHEN outcome = 'ok' THEN coalesce(nullif(title, ''), document_name, 'Shared chat') END AS title FROM (
              SELECT r.share_id, title, document_name, CASE WHEN s.share_id IS NULL THEN 'missing' WHEN expires_at <= TIMESTAMP '{NOW}' THEN 'expired' ELSE 'ok' END AS outcome
              FROM (SELECT concat('s', CAST(event_id % 400 AS VARCHAR)) AS share_id FROM events) r LEFT JOIN ({SHARED}) s USING (share_id)) r""",
    ),
    "purge_expired": (
        lambda t: chat.purge_expired(_shared(t), NOW)[0].select("share_id", "expires_at").crossJoin(F.broadcast(chat.purge_expired(_shared(t), NOW)[1])),
        f"""SELECT share_id, expires_at, (SELECT count(*) FROM ({SHARED}) WHERE expires_at <= TIMESTAMP '{NOW}') AS removed FROM ({SHARED}) WHERE expires_at > TIMESTAMP '{NOW}'""",
    ),
    "parse_exposition": (
        lambda t: _lines(t).select("name", F.coalesce(F.get(F.map_values("labels"), F.size("labels") - 1), F.lit("")).alias("last_label"), F.size("labels").alias("n"), "value"),
        """SELECT u.name, u.label AS last_label, CAST(u.n AS INT) AS n, u.value FROM (SELECT route, count(*) AS c, round(sum(duration_s), 3) AS s FROM fx_requests GROUP BY route), LATERAL (VALUES
             ('requests_total', route, 2, CAST(c AS DOUBLE)), ('seconds_sum', route, 2, s), ('bucket', '+Inf', 1, CAST('inf' AS DOUBLE))) u(name, label, n, value)
           UNION ALL SELECT u.name, '', 0, u.value FROM (""" + PROCESS + """), LATERAL (VALUES ('process_uptime_seconds', CAST(up AS DOUBLE)), ('process_cpu_user_seconds_total', user_s), ('process_cpu_system_seconds_total', system_s),
             ('process_resident_memory_bytes', CAST(rss AS DOUBLE))) u(name, value)""",
    ),
    "runtime": (
        lambda t: metrics.runtime(_lines(t)),
        f"SELECT CAST(up AS DOUBLE) AS uptime_s, CAST(least(100, round((user_s + system_s) / up * 100)) AS BIGINT) AS cpu_percent, CAST(round(rss / 1048576) AS BIGINT) AS rss_mb FROM ({PROCESS})",
    ),
    "user_pages": (
        lambda t: admin.page_counts(admin.find_users(t("fx_users"), "user1"), 20),
        "SELECT count(*) AS total, CAST(greatest(1, ceil(count(*) / 20)) AS BIGINT) AS pages FROM fx_users WHERE regexp_matches(name, 'user1', 'i') OR regexp_matches(email, 'user1', 'i')",
    ),
    "user_page_by_status": (
        lambda t: admin.user_page(t("fx_users"), "", "is_admin", True, 1, 40),
        "SELECT * FROM fx_users ORDER BY is_admin DESC, user_id LIMIT 40",
    ),
    "document_pages": (
        lambda t: admin.page_counts(admin.find_documents(t("fx_documents"), "file_1", "text/plain"), 20),
        "SELECT count(*) AS total, CAST(greatest(1, ceil(count(*) / 20)) AS BIGINT) AS pages FROM fx_documents WHERE contains(name, 'file_1') AND type = 'text/plain'",
    ),
    "report_pages": (
        lambda t: admin.page_counts(admin.find_reports(t("fx_reports"), "open", "user 1", "2024-01-03", "2024-01-05"), 20),
        """SELECT count(*) AS total, CAST(greatest(1, ceil(count(*) / 20)) AS BIGINT) AS pages FROM fx_reports
           WHERE status = 'open' AND created_at >= TIMESTAMP '2024-01-03' AND created_at < TIMESTAMP '2024-01-06'
             AND (contains(lower(name), 'user 1') OR contains(lower(email), 'user 1') OR contains(lower(subject), 'user 1') OR contains(lower(message), 'user 1'))""",
    ),
    "update_reports": (
        lambda t: admin.update_reports(t("fx_reports"), t("events").select((F.col("event_id") * 2).alias("report_id"), F.when(F.col("event_type") == "click", "resolved").when(F.col("event_type") == "view", "open").otherwise("lost").alias("status"), "ts")),
        """SELECT e.event_id * 2 AS report_id, CASE event_type WHEN 'click' THEN 'resolved' WHEN 'view' THEN 'open' ELSE 'lost' END AS status,
                  CASE WHEN r.report_id IS NULL THEN 'not found' WHEN event_type NOT IN ('click', 'view') THEN 'bad status' END AS reason
           FROM events e LEFT JOIN (SELECT report_id FROM fx_reports) r ON r.report_id = e.event_id * 2""",
    ),
    "delete_reports": (
        lambda t: admin.delete_reports(t("fx_reports"), t("events").select((F.col("event_id") * 2).alias("report_id")))[1],
        "SELECT event_id * 2 AS report_id, CASE WHEN event_id * 2 IN (SELECT report_id FROM fx_reports) THEN 'deleted' ELSE 'not found' END AS outcome FROM events",
    ),
    "toggle_users": (
        lambda t: admin.toggle_users(t("fx_users"), t("events").select("user_id"), 7),
        """SELECT e.user_id, CASE WHEN e.user_id <> 7 THEN u.is_active <> (n % 2 = 1) ELSE u.is_active END AS is_active,
                  CASE WHEN e.user_id = 7 THEN 'own account' WHEN u.user_id IS NULL THEN 'not found' END AS reason
           FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) e LEFT JOIN (SELECT user_id, is_active FROM fx_users) u USING (user_id)""",
    ),
    "apply_document_changes": (
        lambda t: admin.apply_document_changes(t("fx_documents"), _changed(t)),
        """SELECT d.doc_id, coalesce(new_name, name) AS name, coalesce(pin = 'view', pinned) AS pinned, CASE WHEN pin IS NULL THEN pinned_at WHEN pin = 'view' THEN pin_at END AS pinned_at
           FROM fx_documents d LEFT JOIN (
             SELECT event_id % 700 AS doc_id, arg_max(concat('new ', CAST(event_id AS VARCHAR)), ts) FILTER (WHERE event_type = 'click') AS new_name,
                    arg_max(event_type, ts) FILTER (WHERE event_type IN ('view', 'error')) AS pin, CAST(max(ts) FILTER (WHERE event_type IN ('view', 'error')) AS TIMESTAMP) AS pin_at
             FROM events GROUP BY 1) c USING (doc_id)""",
    ),
    "link_identities": (
        lambda t: admin.link_identities(t("fx_users"), _logins(t)).withColumn("user_id", F.col("user_id").cast("string")),
        f"""WITH first AS (
              SELECT login_id, CAST(coalesce(a.user_id, b.user_id) AS VARCHAR) AS user_id, CASE WHEN a.user_id IS NOT NULL THEN l.google_id ELSE coalesce(b.google_id, l.google_id) END AS google_id,
                     CASE WHEN a.user_id IS NOT NULL THEN 'known' WHEN b.user_id IS NULL THEN 'new' WHEN b.google_id IS NULL THEN 'linked' ELSE 'known' END AS action,
                     coalesce(a.name, b.name, l.name, string_split(l.email, '@')[1]) AS name,
                     CASE WHEN a.user_id IS NOT NULL THEN a.avatar WHEN b.google_id IS NOT NULL THEN b.avatar ELSE coalesce(b.avatar, 'photo') END AS avatar
              FROM ({LOGINS}) l LEFT JOIN fx_users a ON a.google_id = l.google_id LEFT JOIN fx_users b ON lower(b.email) = l.email)
            SELECT * FROM first
            UNION ALL SELECT login_id + 10000000, NULL, CASE WHEN action = 'new' THEN google_id ELSE concat('y', CAST(login_id AS VARCHAR)) END, CASE WHEN action = 'new' THEN 'known' ELSE 'new' END,
                             CASE WHEN action = 'new' THEN name ELSE 'Again' END, CASE WHEN action = 'new' THEN avatar ELSE 'other' END FROM first WHERE login_id % 5 = 0
            UNION ALL SELECT login_id + 20000000, user_id, google_id, 'known', name, avatar FROM first WHERE action = 'linked'""",
    ),
    "upsert_chunks": (
        _upserted,
        """WITH brought AS (SELECT doc_id % 20 AS doc_id, doc_id % 30 AS chunk, doc_id AS seq, text FROM fx_documents WHERE doc_id % 20 IN (SELECT doc_id FROM fx_documents))
           SELECT doc_id, CAST(chunk AS INT) AS chunk, CAST(0 AS BIGINT) AS user_id, 'old.txt' AS filename, NULL AS sheet, md5(text) AS digest, CAST(len(embedding) AS INT) AS n
           FROM fx_vectors WHERE doc_id NOT IN (SELECT doc_id FROM brought)
           UNION ALL SELECT b.doc_id, CAST(chunk AS INT), d.user_id, CASE WHEN seq % 3 = 0 THEN d.name ELSE 'new.txt' END, CASE WHEN seq % 2 = 1 THEN 'Sheet1' END, digest, 0
           FROM (SELECT doc_id, chunk, max(seq) AS seq, arg_max(md5(text), seq) AS digest FROM brought WHERE doc_id <> 4 AND seq % 9 > 0 GROUP BY doc_id, chunk) b JOIN fx_documents d USING (doc_id)""",
    ),
    "write_flashcards_json": (_cards, f"WITH cards AS ({CARDS}), {DECK}"),
    "read_tables": (
        _entities,
        " UNION ALL ".join(
            f"SELECT '{name}' AS entity, count(*) AS n, CAST(sum({key}) AS BIGINT) AS keys, CAST(sum({size}) AS BIGINT) AS chars FROM {({'chunks': 'fx_vectors', 'shares': f'({SNAP})'}).get(name, f'fx_{name}')}"
            for name, (key, size) in ENTITY_SUMS.items()
        ),
    ),
    "read_text_files": (_texts, "SELECT concat(CAST(conv_id AS VARCHAR), ' ', role) AS line, count(*) AS n FROM conversations GROUP BY 1"),
}
