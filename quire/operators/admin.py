"""Administration: totals, classes, pages of rows, changes and deletions. `now` is always an argument."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.intake import WORD_TYPES, extension
from quire.sources.scratch import shared_folder

#: MIME types and endings by class of document, first match wins.
DOCUMENT_CLASSES = {
    "pdf": (["application/pdf"], ["pdf"]),
    "word": (WORD_TYPES, ["doc", "docx"]),
    "powerpoint": (["application/vnd.ms-powerpoint", "application/vnd.openxmlformats-officedocument.presentationml.presentation"], ["ppt", "pptx"]),
    "excel": (["application/vnd.ms-excel", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"], ["xls", "xlsx"]),
    "text": (["text/plain", "text/markdown"], ["txt", "md", "text"]),
}
#: Words by class of report, first match wins.
REPORT_CLASSES = {"bug": "bug|error|issue|fail|crash", "feature_request": "feature|request|enhancement|improvement", "feedback": "feedback|suggestion|opinion|comment"}


def stamp(now: str) -> Column:
    return F.lit(now).cast("timestamp")


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(100 * part / whole)).otherwise(0).cast("long")


def zero_filled(rows: DataFrame, name: str, values: list[str]) -> DataFrame:
    """Counts by `name` with a row for each of `values`."""
    all_ = rows.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, values))).alias(name))
    return all_.join(rows.groupBy(name).agg(F.count("*").alias("n")), name, "left").select(name, F.coalesce("n", F.lit(0)).alias("n"))


def document_class(kind: Column, name: Column) -> Column:
    out = F
    for label, (types, endings) in DOCUMENT_CLASSES.items():
        out = out.when(F.coalesce(kind.isin(types), F.lit(False)) | extension(name).isin(endings), label)
    return out.otherwise("others")


def report_class(subject: Column, message: Column, feature: str = "feature_request") -> Column:
    def judge(low: Column) -> Column:
        """By plain searches, which are several times as fast as a pattern; letters that lower case alone makes plain ones are left to the pattern."""
        out = F
        for label, words in REPORT_CLASSES.items():
            held = reduce(or_, [low["low"].contains(w) for w in words.split("|")])
            out = out.when(held & (low["plain"] | low["text"].rlike(f"(?i){words}")), feature if label == "feature_request" else label)
        return out.otherwise("other")

    text = F.concat(F.coalesce(subject, F.lit("")), F.lit(" "), F.coalesce(message, F.lit("")))
    low = F.transform(F.array(text), lambda t: F.struct(t.alias("text"), F.lower(t).alias("low"), (F.octet_length(t) == F.length(t)).alias("plain")))
    return F.coalesce(F.transform(low, judge)[0], F.lit("other"))  # never null, so no filter before a join reads the text a second time


def totals(users: DataFrame, documents: DataFrame, messages: DataFrame, reports: DataFrame) -> DataFrame:
    """One row: users, documents, chats, reports, storage_bytes."""
    parts = [users.agg(F.count("*").alias("v")).select(F.lit("users").alias("k"), "v"), documents.agg(F.count("*").alias("v")).select(F.lit("documents").alias("k"), "v"), messages.agg(F.countDistinct("conv_id").alias("v")).select(F.lit("chats").alias("k"), "v"), reports.agg(F.count("*").alias("v")).select(F.lit("reports").alias("k"), "v"), documents.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("v")).select(F.lit("storage_bytes").alias("k"), "v")]
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.union(p)
    return all_.agg(*[F.max(F.when(F.col("k") == k, F.col("v"))).alias(k) for k in ("users", "documents", "chats", "reports", "storage_bytes")])


def conversion_rate(documents: DataFrame) -> DataFrame:
    """One row: word_documents, converted, percent."""
    word = F.coalesce(F.col("original_type").isin(WORD_TYPES), F.lit(False))
    n = documents.agg(F.count_if(word).alias("word_documents"), F.count_if(word & (F.col("type") == "application/pdf")).alias("converted"))
    return n.withColumn("percent", percent(F.col("converted"), F.col("word_documents")))


def online_users(users: DataFrame, messages: DataFrame, documents: DataFrame, now: str, minutes: int = 10) -> DataFrame:
    """One row: distinct users with a login (active ones), chat or upload in the last `minutes`; messages carry user_id."""
    recent = lambda c: (F.col(c) >= stamp(now) - F.expr(f"INTERVAL {max(1, minutes)} MINUTES")) & (F.col(c) <= stamp(now))
    seen = users.filter(recent("last_login") & F.col("is_active")).select("user_id").union(messages.filter(recent("sent_at")).select("user_id")).union(documents.filter(recent("uploaded_at")).select("user_id"))
    return seen.filter("user_id is not null").agg(F.countDistinct("user_id").alias("online_users"))


def document_types(documents: DataFrame) -> DataFrame:
    return zero_filled(documents.select(document_class(F.col("type"), F.col("name")).alias("class")), "class", [*DOCUMENT_CLASSES, "others"])


def report_types(reports: DataFrame) -> DataFrame:
    return zero_filled(reports.select(report_class(F.col("subject"), F.col("message")).alias("class")), "class", [*REPORT_CLASSES, "other"])


def recent_activity(documents: DataFrame, users: DataFrame, n: int = 20) -> DataFrame:
    """The newest uploads with label and description, newest first; a document that had another type at first was converted."""
    top = documents.select("doc_id", "user_id", "name", "original_type", "uploaded_at").orderBy(F.desc("uploaded_at"), F.desc("doc_id")).limit(n)
    label = F.when(F.coalesce("original_type", F.lit("")) != "", "convert").otherwise("upload")
    who, did = F.coalesce("_who", F.lit("Unknown")), F.when(label == "convert", " converted ").otherwise(" uploaded ")
    rows = top.join(users.select("user_id", F.col("name").alias("_who")), "user_id", "left")
    return rows.select("doc_id", label.alias("label"), F.concat(who, did, "name").alias("description"), "uploaded_at").orderBy(F.desc("uploaded_at"), F.desc("doc_id"))


def daily(rows: DataFrame, at: str, now: str, name: str) -> DataFrame:
    day = F.to_date(F.col(at))
    return rows.filter((day > F.date_sub(F.to_date(stamp(now)), 7)) & (F.col(at) <= stamp(now))).groupBy(day.alias("day")).agg(F.count("*").alias(name))


def weekly_growth(users: DataFrame, reports: DataFrame, now: str) -> DataFrame:
    """iso_day, day, new_users, new_reports for today and the six days before."""
    today = F.to_date(stamp(now))
    week = users.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(today, 6), today)).alias("day"))
    both = week.join(daily(users, "created_at", now, "new_users"), "day", "left").join(daily(reports, "created_at", now, "new_reports"), "day", "left")
    return both.select((F.weekday("day") + 1).alias("iso_day"), "day", F.coalesce("new_users", F.lit(0)).alias("new_users"), F.coalesce("new_reports", F.lit(0)).alias("new_reports"))


def paged(rows: DataFrame, order: list, page: int, limit: int) -> DataFrame:
    return rows.orderBy(*order).offset((max(1, page) - 1) * limit).limit(limit)


def matches(search: str, *names: str) -> Column:
    out = F.lit(search == "")
    for n in names:
        out = out | F.coalesce(F.col(n).rlike(f"(?i){search}"), F.lit(False))
    return out


def page_counts(rows: DataFrame, limit: int = 20) -> DataFrame:
    """One row: total, and pages of `limit` rows (one at least)."""
    return rows.agg(F.count("*").alias("total")).select("total", F.greatest(F.lit(1), F.ceil(F.col("total") / limit)).cast("long").alias("pages"))


def find_users(users: DataFrame, search: str = "") -> DataFrame:
    """Users whose name or email matches."""
    return users.filter(matches(search, "name", "email"))


def user_page(users: DataFrame, search: str = "", sort: str = "created_at", descending: bool = True, page: int = 1, limit: int = 20) -> DataFrame:
    """A page of the users found, by created_at, name, email, is_active or is_admin."""
    key = F.col(sort if sort in ("created_at", "name", "email", "is_active", "is_admin") else "created_at")
    return paged(find_users(users, search), [key.desc() if descending else key.asc(), F.col("user_id")], page, max(1, min(200, limit)))


def user_totals(users: DataFrame, search: str = "") -> DataFrame:
    return find_users(users, search).agg(F.count("*").alias("total"), F.count_if("is_active").alias("active"), F.count_if("is_admin").alias("admins"))


def user_stats(users: DataFrame, documents: DataFrame, messages: DataFrame) -> DataFrame:
    """user_id, document_count, total_storage, chat_count; messages carry user_id."""
    d = documents.groupBy("user_id").agg(F.count("*").alias("document_count"), F.sum("size").alias("total_storage"))
    c = messages.groupBy("user_id").agg(F.countDistinct("conv_id").alias("chat_count"))
    zero = lambda n: F.coalesce(n, F.lit(0)).alias(n)
    return users.select("user_id").join(d, "user_id", "left").join(c, "user_id", "left").select("user_id", zero("document_count"), zero("total_storage"), zero("chat_count"))


def find_documents(documents: DataFrame, search: str = "", kind: str = "") -> DataFrame:
    """Documents by name and exact type; never their content."""
    some = documents.filter(matches(search, "name") & (F.lit(kind == "") | (F.col("type") == kind)))
    return some.select("doc_id", "user_id", "name", "type", "size", "uploaded_at")


def document_page(documents: DataFrame, users: DataFrame, search: str = "", kind: str = "", page: int = 1, limit: int = 20, sort: str = "uploaded_at", ascending: bool = False) -> DataFrame:
    """A page of the documents found, by any of their fields (newest first unless told otherwise), with the owner; equals are in the order of doc_id,
    the other way round where the sort is descending."""
    found = find_documents(documents, search, kind)
    if sort not in found.columns:
        raise ValueError(f"documents are sorted by one of {', '.join(found.columns)}")
    order = [c.asc() if ascending else c.desc() for c in (F.col(sort), F.col("doc_id"))]
    top = paged(found, order, page, max(1, min(200, limit)))
    return top.join(users.select("user_id", F.col("name").alias("owner")), "user_id", "left")


def find_reports(reports: DataFrame, status: str = "", search: str = "", start: str = "", end: str = "") -> DataFrame:
    """Reports by status, by text in name, email, subject or message, and by time (end day included)."""
    some = reports.filter(matches(search, "name", "email", "subject", "message"))
    if status in ("open", "in_progress", "resolved"):
        some = some.filter(F.col("status") == status)
    if start:
        some = some.filter(F.col("created_at") >= stamp(start))
    return some.filter(F.col("created_at") < day_after(end)) if end else some


def day_after(end: str) -> Column:
    return F.date_add(F.lit(end).cast("date"), 1).cast("timestamp")


def report_page(reports: DataFrame, status: str = "", search: str = "", start: str = "", end: str = "", page: int = 1, limit: int = 20) -> DataFrame:
    """A page of the reports found, newest first."""
    return paged(find_reports(reports, status, search, start, end), [F.desc("created_at"), F.desc("report_id")], page, max(1, min(100, limit)))


def report_summary(reports: DataFrame) -> DataFrame:
    """One row: total, resolved, open_reports, and counts by class."""
    c = report_class(F.col("subject"), F.col("message"), "feature").alias("class")
    each = reports.groupBy(c, "status").agg(F.count("*").alias("n"))  # a report's texts are read once for all counts
    total = lambda which: F.coalesce(F.sum(F.when(which, F.col("n"))), F.lit(0))
    return each.agg(total(F.lit(True)).alias("total"), total(F.col("status") == "resolved").alias("resolved"), total(F.col("status") == "open").alias("open_reports"), *[total(F.col("class") == k).alias(k) for k in ("bug", "feature", "feedback", "other")])


def report_timeseries(reports: DataFrame, grain: str, now: str, start: str = "", end: str = "") -> DataFrame:
    """bucket, n by day, ISO week or month from `start` (six days before `now`) to the end of the day of `end` (of `now`); gaps aren't filled."""
    t = F.col("created_at")
    week = F.concat_ws("-", F.extract(F.lit("YEAROFWEEK"), t).cast("string"), F.lpad(F.weekofyear(t).cast("string"), 2, "0"))
    bucket = {"week": week, "month": F.date_format(t, "yyyy-MM")}.get(grain, F.date_format(t, "yyyy-MM-dd"))
    since = stamp(start) if start else stamp(now) - F.expr("INTERVAL 6 DAYS")
    return reports.filter((t >= since) & (t < day_after(end or now))).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def update_reports(reports: DataFrame, changes: DataFrame) -> DataFrame:
    """report_id, status, reason for each changed report: the last change (by ts) applies, unless it names no status or no report."""
    last = changes.groupBy("report_id").agg(F.max_by("status", "ts").alias("status"))
    reason = F.when(F.col("_have").isNull(), "not found").when(~F.coalesce(F.col("status").isin("open", "in_progress", "resolved"), F.lit(False)), "bad status")
    return last.join(reports.select("report_id", F.lit(True).alias("_have")), "report_id", "left").select("report_id", "status", reason.alias("reason"))


def delete_reports(reports: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reports that stay, and for each id asked for its outcome (deleted, not found)."""
    have = reports.select("report_id", F.lit(True).alias("_have"))
    told = ids.select("report_id").distinct().join(have, "report_id", "left").select("report_id", F.when(F.col("_have"), "deleted").otherwise("not found").alias("outcome"))
    return reports.join(ids.select("report_id").distinct(), "report_id", "left_anti"), told


def toggle_users(users: DataFrame, toggles: DataFrame, actor: int) -> DataFrame:
    """user_id, is_active, reason for each user in `toggles` (user_id, a row for each toggle): an odd number turns the status; nobody changes their own."""
    n = toggles.groupBy("user_id").agg((F.count("*") % 2 == 1).alias("_odd"))
    rows = n.join(users.select("user_id", "is_active", F.lit(True).alias("_have")), "user_id", "left")
    reason = F.when(F.col("user_id") == actor, "own account").when(F.col("_have").isNull(), "not found")
    return rows.select("user_id", F.when(reason.isNull(), F.col("is_active") != F.col("_odd")).otherwise(F.col("is_active")).alias("is_active"), reason.alias("reason"))


def cascade_delete(ids: DataFrame, actor: int, users: DataFrame, **owned: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """What stays of users and of the tables they own (by user_id), and removed rows by table; nobody deletes themselves."""
    gone = ids.select("user_id").filter(F.col("user_id") != actor).distinct()
    tables = {"users": users, **owned}
    kept = {k: t.join(gone, "user_id", "left_anti") for k, t in tables.items()}
    counts = None
    for k, t in tables.items():
        n = t.join(gone, "user_id", "left_semi").agg(F.count("*").alias("removed")).select(F.lit(k).alias("table"), "removed")
        counts = n if counts is None else counts.union(n)
    return kept, counts


def delete_documents(ids: DataFrame, **tables: DataFrame) -> dict[str, DataFrame]:
    """What stays of tables that carry doc_id."""
    gone = ids.select("doc_id").distinct()
    return {k: t.join(gone, "doc_id", "left_anti") for k, t in tables.items()}


def apply_document_changes(documents: DataFrame, changes: DataFrame) -> DataFrame:
    """doc_id, name, pinned, pinned_at after changes (doc_id, ts, field in name and pinned; value): the last of each applies.

    Pinning sets pinned_at, unpinning clears it; documents without a change of their pin keep both.
    """
    last = lambda f: F.max_by(F.when(F.col("field") == f, F.col("value")), F.when(F.col("field") == f, F.col("ts")))
    each = changes.groupBy("doc_id").agg(last("name").alias("_name"), last("pinned").alias("_pin"), F.max(F.when(F.col("field") == "pinned", F.col("ts"))).alias("_at"))
    pin = F.col("_pin") == "true"
    at = F.when(F.col("_pin").isNull(), F.col("pinned_at")).when(pin, F.col("_at"))
    return documents.join(each, "doc_id", "left").select("doc_id", F.coalesce("_name", "name").alias("name"), F.coalesce(pin, F.col("pinned")).alias("pinned"), at.alias("pinned_at"))


def placed(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Rows with position, from 1, in an order; the rows are one user's."""
    return rows.withColumn("position", F.row_number().over(Window.orderBy(*order))).orderBy("position")


def my_documents(documents: DataFrame, user: int) -> DataFrame:
    """A user's documents with position: pinned ones first, those pinned last before others, then newest first."""
    mine = documents.filter(F.col("user_id") == user).select("doc_id", "name", "pinned", "pinned_at", "uploaded_at")
    return placed(mine, [F.desc("pinned"), F.desc_nulls_last("pinned_at"), F.desc_nulls_last("uploaded_at"), F.col("doc_id")])


def history_view(documents: DataFrame, user: int, term: str = "", sort: str = "date", ascending: bool = False) -> DataFrame:
    """A user's documents whose name holds the term, with position: pinned on top, then by name, size or date."""
    key = {"name": F.lower("name"), "size": F.col("size")}.get(sort, F.col("uploaded_at"))
    some = documents.filter((F.col("user_id") == user) & F.lower("name").contains(term.lower())).select("doc_id", "name", "size", "pinned", "uploaded_at")
    return placed(some, [F.desc("pinned"), key.asc() if ascending else key.desc(), F.col("doc_id")])


def link_identities(users: DataFrame, logins: DataFrame) -> DataFrame:
    """login_id, user_id, google_id, action (linked, known, new), name, avatar of logins (login_id, google_id, email, name, avatar), in the order of login_id: by
    google id, else by email.

    A user found by email without a google id gets that of their first login so found, and its avatar where they have none; a known user stays as they
    are. A login that finds no user makes one, named by what stands before the @ of the email unless it says a name, whom later
    logins find (as known). The rows are what the users table holds after each login; a made user has no user_id yet.
    """
    filled = lambda c: F.nullif(F.trim(c), F.lit(""))
    by_id = users.filter("google_id is not null").select("google_id", F.col("user_id").alias("_a"), F.struct("name", "avatar").alias("_pa"))
    by_mail = users.select(F.lower("email").alias("_mail"), F.col("user_id").alias("_b"), F.col("google_id").alias("_g"), F.struct("name", "avatar").alias("_pb"))
    rows = logins.withColumn("_mail", F.lower(F.trim("email"))).join(by_id, "google_id", "left").join(by_mail, "_mail", "left")
    free = F.col("_a").isNull() & F.col("_b").isNotNull() & F.col("_g").isNull()
    links = rows.filter(free).groupBy("_b").agg(F.min(F.struct("login_id", "google_id", filled(F.col("avatar")).alias("avatar"))).alias("_link"))
    # who logs in by the google id that an earlier login linked finds that user
    linked = links.select(F.col("_link.google_id").alias("google_id"), F.col("_link.login_id").alias("_since"), F.col("_b").alias("_c")).groupBy("google_id").agg(F.min(F.struct("_since", "_c")).alias("_x"))
    rows = rows.join(linked.select("google_id", "_x._since", "_x._c"), "google_id", "left").withColumn("_c", F.when((F.col("_since") < F.col("login_id")) & F.col("_a").isNull(), F.col("_c")))
    known = rows.withColumn("_u", F.coalesce("_a", "_c", "_b"))
    found = known.filter("_u is not null").join(users.select(F.col("user_id").alias("_u"), F.struct("name", "avatar", F.col("google_id").alias("g")).alias("_own")), "_u").join(links.withColumnRenamed("_b", "_u"), "_u", "left")
    after = F.col("_link.login_id") <= F.col("login_id")
    action = F.when(F.col("_own.g").isNull() & (F.col("_link.login_id") == F.col("login_id")), "linked").otherwise("known")
    own, pic = F.col("_own"), filled(F.col("_own.avatar"))
    said = F.coalesce(filled(F.col("name")), F.split("_mail", "@")[0])
    told = found.select("login_id", F.col("_u").alias("user_id"), F.coalesce(own["g"], F.when(after, F.col("_link.google_id"))).alias("google_id"), action.alias("action"), own["name"].alias("name"), F.coalesce(pic, F.when(own["g"].isNull() & after, F.col("_link.avatar"))).alias("avatar"))
    return told.unionByName(made_users(known.filter("_u is null").select("login_id", "google_id", F.col("_mail").alias("mail"), said.alias("name"), filled(F.col("avatar")).alias("avatar"))))


def made_users(logins: DataFrame) -> DataFrame:
    """Rows of link_identities for logins (login_id, google_id, mail, name, avatar) that no user stands behind: in rounds, those that no open login before them shares an
    id or an email with make users, and logins that find one of these are known. A round settles at least the first login of each
    group that is tied by ids and emails, so there are as many rounds as a chain of such ties is long."""
    spark, out, folder = logins.sparkSession, [], shared_folder(logins.sparkSession, "logins")
    logins.write.parquet(f"{folder}/0")
    open_, n = spark.read.parquet(f"{folder}/0"), 0
    while not open_.isEmpty():
        first = lambda by: open_.filter(F.col(by).isNotNull()).groupBy(by).agg(F.min("login_id").alias(f"_{by}"))  # noqa: B023, E731
        marked = open_.join(first("google_id"), "google_id", "left").join(first("mail"), "mail", "left")
        alone = lambda by: F.coalesce(F.col(f"_{by}"), F.col("login_id")) == F.col("login_id")
        makers = marked.filter(alone("google_id") & alone("mail")).select(*logins.columns)
        made = lambda by: makers.filter(F.col(by).isNotNull()).select(by, F.struct("login_id", "google_id", "name", "avatar").alias(f"of_{by}"))  # noqa: B023, E731
        met = marked.join(made("google_id"), "google_id", "left").join(made("mail"), "mail", "left")
        of = F.coalesce("of_google_id", F.when(alone("google_id") | F.col("google_id").isNull(), F.col("of_mail")))
        settled = met.withColumn("of", of)
        told = settled.filter("of is not null").select("login_id", F.lit(None).cast("long").alias("user_id"), "of.google_id", F.when(F.col("of.login_id") == F.col("login_id"), "new").otherwise("known").alias("action"), "of.name", "of.avatar")
        told.write.parquet(f"{folder}/told-{n}")
        settled.filter("of is null").select(*logins.columns).write.parquet(f"{folder}/{n + 1}")
        n += 1
        out.append(f"{folder}/told-{n - 1}")
        open_ = spark.read.parquet(f"{folder}/{n}")
    kind = "login_id long, user_id long, google_id string, action string, name string, avatar string"
    return spark.read.schema(kind).parquet(*out) if out else spark.createDataFrame([], kind)


#: Events from which a user's are spread over tasks instead of held in one row.
BUSY = 200_000


def counted(rows: DataFrame, most: int, span: int) -> DataFrame:
    """Windows of users with few events (user_id, ts, seq, micros): a fold over the sorted events finds where windows start, and each is a slice of them."""
    each = rows.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("micros", "seq", "ts"))).alias("e"))
    start = F.struct(F.array().cast("array<int>").alias("at"), F.lit(None).cast("long").alias("t0"), F.lit(0).alias("i"))

    def step(acc: Column, x: Column) -> Column:
        new = acc["t0"].isNull() | (x["micros"] >= acc["t0"] + span)
        return F.struct(F.when(new, F.array_append(acc["at"], acc["i"])).otherwise(acc["at"]).alias("at"), F.when(new, x["micros"]).otherwise(acc["t0"]).alias("t0"), (acc["i"] + 1).alias("i"))

    starts = each.select("user_id", "e", F.aggregate("e", start, step, lambda acc: acc["at"]).alias("at"))
    end = F.coalesce(F.get("at", F.col("w") + 1), F.size("e"))
    windows = starts.select("user_id", "e", "at", F.posexplode("at").alias("w", "first")).select("user_id", F.slice("e", F.col("first") + 1, end - F.col("first")).alias("e"))
    return windows.select("user_id", F.col("e")[0]["micros"].alias("t0"), F.posexplode("e").alias("k", "x")).select("user_id", "x.*", "t0", (F.col("k") + 1).alias("k"))


def counted_in_slices(rows: DataFrame, most: int, span: int) -> DataFrame:
    """Windows of users with many events: time is cut in slices as long as a window, so a user has at most one start in each.

    Slice after slice, all users at once: the start is the first event that lies a window's length after the start before, a minimum that tasks take
    of what they hold before it is shuffled. What is carried is a row a user. Then each event finds its start by user and slice, and
    the first `most` of a window are numbered; all others are denied.
    """
    spark, folder = rows.sparkSession, shared_folder(rows.sparkSession, "busy")
    rows.withColumn("num", F.monotonically_increasing_id()).withColumn("slice", F.floor(F.col("micros") / span)).write.partitionBy("slice").parquet(f"{folder}/rows")
    held = spark.read.parquet(f"{folder}/rows")
    carry, starts = spark.createDataFrame([], "user_id long, t0 long"), []
    for r in held.select("slice").distinct().orderBy("slice").collect():  # as many as windows fit the whole time
        here = held.filter(F.col("slice") == r["slice"]).join(carry, "user_id", "left")
        new = here.filter(F.col("t0").isNull() | (F.col("micros") >= F.col("t0") + span)).groupBy("user_id").agg(F.min("micros").alias("new"))
        carry.join(new, "user_id", "full").select("user_id", F.lit(r["slice"]).cast("long").alias("slice"), "t0", "new").write.parquet(f"{folder}/starts/{len(starts)}")
        starts.append(f"{folder}/starts/{len(starts)}")
        carry = spark.read.parquet(starts[-1]).select("user_id", F.coalesce("new", "t0").alias("t0"))
    table = spark.read.parquet(*starts).withColumnRenamed("t0", "before")
    placed = held.withColumn("slice", F.col("slice").cast("long")).join(table, ["user_id", "slice"]).withColumn("t0", F.when(F.col("micros") >= F.col("new"), F.col("new")).otherwise(F.col("before")))
    first = placed.withColumn("k", F.row_number().over(Window.partitionBy("user_id", "t0").orderBy("micros", "seq", "num"))).filter(F.col("k") <= most).select("num", "k")
    return placed.join(first, "num", "left").select("user_id", "micros", "seq", "ts", "t0", F.coalesce("k", F.lit(most + 1)).alias("k"))


def rate_limit(events: DataFrame, most: int = 3, hours: int = 24, busy: int = BUSY) -> DataFrame:
    """user_id, ts, allowed, count_in_window, retry_hours: a window starts at the first change after the one before ended.

    Events are (user_id, ts, seq); those without a user or a time are left out. A user with more than `busy` events is spread over tasks.
    """
    span = hours * 3_600_000_000
    rows = events.filter("user_id is not null and ts is not null").select("user_id", "ts", "seq", F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"))
    many = rows.groupBy("user_id").agg(F.count("*").alias("n")).filter(F.col("n") > busy).select("user_id")
    if many.isEmpty():
        told = counted(rows, most, span)
    else:
        told = counted(rows.join(many, "user_id", "left_anti"), most, span).union(counted_in_slices(rows.join(many, "user_id", "left_semi"), most, span))
    ok = F.col("k") <= most
    left = F.when(~ok, F.ceil((F.col("t0") + span - F.col("micros")) / 3_600_000_000))
    return told.select("user_id", "ts", ok.alias("allowed"), F.least("k", F.lit(most)).alias("count_in_window"), left.alias("retry_hours"))


def activity_log(documents: DataFrame, users: DataFrame, level: str = "", page: int = 1, limit: int = 20) -> DataFrame:
    """A page of the newest 100 uploads as log rows; documents carry status."""
    top = documents.orderBy(F.desc("uploaded_at"), F.desc("doc_id")).limit(100)
    grade = F.when(F.col("status") == "failed", "error").when(F.col("status") == "awaiting-consent", "warning").otherwise("info")
    rows = top.join(users.select("user_id", F.col("name").alias("_who")), "user_id", "left").select("doc_id", grade.alias("level"), F.coalesce("_who", F.lit("Unknown")).alias("user_name"), "name", "uploaded_at")
    return paged(rows.filter(F.lit(level == "") | (F.col("level") == level)), [F.desc("uploaded_at"), F.desc("doc_id")], page, limit)
