"""Rules of the own operators on literal rows, with answers worked out by hand."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators import admin, assets, chat, guard, metrics, retrieve, search, text
from quire.sources import tables
from quire.sources.scratch import shared_folder


def stamp(s):
    return F.to_timestamp(F.lit(s))


def test_chunks_count_what_they_carry(spark):
    body = "\n\n".join(c * n for c, n in (("a", 150), ("b", 900), ("c", 50)))
    got = [r.text for r in text.chunk(spark.createDataFrame([(1, body)], "doc_id long, text string")).orderBy("chunk").collect()]
    assert [len(x) for x in got] == [150, 952]  # a chunk of 150 hands nothing on, so 900 + 2 + 50 fit


def test_knn_keeps_a_chunk_numbered_like_the_question(spark):
    chunks = spark.createDataFrame([(1, 3, [1.0, 0.0]), (1, 4, [0.0, 1.0]), (2, 5, [1.0, 0.0])], "doc_id long, chunk long, embedding array<double>")
    q = spark.createDataFrame([(3, 1, [1.0, 0.0])], "question_id long, doc_id long, embedding array<double>")
    assert [(r.chunk, r.distance, r["rank"]) for r in retrieve.knn(q, chunks).orderBy("rank").collect()] == [(3, 0.0, 1), (4, 1.0, 2)]


def test_knn_of_one_document_over_many_tiles(spark):
    """A document with most chunks, in tiles of ten; vectors of length zero, without an embedding, and equal ones."""
    rng = np.random.default_rng(2)
    rows = [(1 if i % 5 else 2, i, None if i == 7 else [0.0, 0.0] if i == 8 else [float(x) for x in rng.integers(-2, 3, 2)]) for i in range(300)]
    q = [(i, 1 + i % 3, [1.0, float(i)]) for i in range(9)] + [(20, 1, None), (21, None, [1.0, 0.0])]
    chunks, asked = spark.createDataFrame(rows, "doc_id long, chunk long, embedding array<double>"), spark.createDataFrame(q, "question_id long, doc_id long, embedding array<double>")
    for metric in ("cosine", "l2sq"):
        want = set()
        for i, d, x in q:
            far = []
            for e, c, y in rows:
                if x and y and e == d:
                    gap, size = (np.subtract(x, y) ** 2).sum(), np.linalg.norm(x) * np.linalg.norm(y)
                    far.append((round(gap, 6) if metric == "l2sq" else round(1 - np.dot(x, y) / size, 6) if size else math.inf, c))
            want |= {(i, c, None if f == math.inf else f + 0.0, k + 1) for k, (f, c) in enumerate(sorted(far)[:12])}
        got = retrieve.knn(asked, chunks, metric=metric, tile=10)
        assert {(r.question_id, r.chunk, r.distance, r["rank"]) for r in got.collect()} == want


def test_context_keeps_unknown_distances(spark):
    rows = [(1, 1, 1, None, 6, 6), (1, 1, 2, 0.7, 7, 7), (1, 1, 3, 0.5, 8, 8)]
    df = spark.createDataFrame(rows, "question_id long, doc_id long, chunk long, distance double, rank int, score_rank int")
    assert sorted(r.chunk for r in retrieve.select_context(df).collect()) == [1, 3]


def test_timeseries_has_the_whole_end_day(spark):
    df = spark.createDataFrame([(1, "2024-01-10 23:59:00"), (2, "2024-01-11 00:00:00"), (3, "2024-01-04 11:59:59"), (4, "2024-01-04 12:00:00")], "report_id long, t string").select("report_id", F.col("t").cast("timestamp").alias("created_at"))
    day = lambda *a: {r.bucket: r.n for r in admin.report_timeseries(df, "day", "2024-01-10 12:00:00", *a).collect()}
    assert day("2024-01-10", "2024-01-10") == {"2024-01-10": 1}
    assert day() == {"2024-01-04": 1, "2024-01-10": 1}  # six days before now, to the end of today


def test_append(spark):
    old = spark.createDataFrame([(1, 0, "user", "hi", None, None)], "conv_id long, turn long, role string, text string, sent_at timestamp, rating string")
    rows = [(1, 1, 0, "system", "", None, "x"), (1, 1, 1, "assistant", "a", None, "positive"), (2, 1, 0, "assistant", "b", None, ""), (3, 1, 0, "robot", "c", None, None), (3, 1, 1, "user", "d", None, None), (4, 1, 0, "user", None, None, None)]
    new = spark.createDataFrame(rows, "submission_id long, conv_id long, seq long, role string, text string, sent_at timestamp, rating string")
    got = [(r.turn, r.role, r.text, r.rating) for r in chat.append(old, new, "2024-01-01").orderBy("turn").collect()]
    assert got == [(0, "user", "hi", None), (1, "system", "", None), (2, "assistant", "a", "positive"), (3, "assistant", "b", "none")]


def test_summary_lengths_follow_the_style(spark):
    df = spark.createDataFrame([(1, "a"), (2, "\n\n".join("x" * 900 for _ in range(3)))], "request_id long, text string")
    words = lambda *a: {(r.step, r.target_words) for r in assets.summary_plan(df, *a).collect()}
    assert words("concise", True) == {(s, "120-180") for s in ("single", "map", "reduce")}
    assert words("short", False) == {(s, "80-120") for s in ("single", "map", "reduce")}
    assert words("odd") == {("single", "120-180"), ("map", "120-180"), ("reduce", "80-120")}


def test_difficulty(spark):
    raw = '{"flashcards": [{"front": "a", "back": "b", "difficulty": "Impossible"}, {"front": "c", "back": "d", "difficulty": " eASY "}, {"front": "e", "back": "f"}]}'
    df = spark.createDataFrame([(1, 1, raw)], "request_id long, round int, raw string")
    assert [r.difficulty for r in assets.clean_cards(df).orderBy("at").collect()] == ["Medium", "Easy", "Medium"]


def test_activity_label(spark):
    d = spark.createDataFrame([(1, 1, "a.txt", "text/plain"), (2, 9, "b", ""), (3, 1, "c", None)], "doc_id long, user_id long, name string, original_type string").withColumn("uploaded_at", stamp("2024-01-01") + F.make_dt_interval(F.col("doc_id").cast("int")))
    u = spark.createDataFrame([(1, "Ann")], "user_id long, name string")
    assert [(r.doc_id, r.label, r.description) for r in admin.recent_activity(d, u).collect()] == [(3, "upload", "Ann uploaded c"), (2, "upload", "Unknown uploaded b"), (1, "convert", "Ann converted a.txt")]


def test_pages_and_toggles(spark):
    u = spark.createDataFrame([(i, f"n{i}", f"e{i}", i % 2 == 0, i == 3) for i in range(1, 6)], "user_id long, name string, email string, is_active boolean, is_admin boolean").withColumn("created_at", stamp("2024-01-01"))
    assert [r.user_id for r in admin.user_page(u, "", "is_admin", True, 1, 2).collect()] == [3, 1]
    assert admin.page_counts(u, 2).first() == (5, 3) and admin.page_counts(u.limit(0), 2).first() == (0, 1)
    t = spark.createDataFrame([(1,), (1,), (2,), (3,), (9,)], "user_id long")
    assert {r.user_id: (r.is_active, r.reason) for r in admin.toggle_users(u, t, 3).collect()} == {1: (False, None), 2: (False, None), 3: (False, "own account"), 9: (None, "not found")}


def test_document_changes_and_order(spark):
    rows = [(1, 7, "a", True, "2024-01-01", "2024-01-05"), (2, 7, "b", True, "2024-01-03", "2024-01-04"), (3, 7, "c", False, None, "2024-01-09"), (4, 7, "d", True, None, "2024-01-08"), (5, 8, "e", True, "2024-01-09", "2024-01-09")]
    d = spark.createDataFrame(rows, "doc_id long, user_id long, name string, pinned boolean, p string, u string").select("doc_id", "user_id", "name", "pinned", F.col("p").cast("timestamp").alias("pinned_at"), F.col("u").cast("timestamp").alias("uploaded_at"))
    assert [(r.position, r.doc_id) for r in admin.my_documents(d, 7).collect()] == [(1, 2), (2, 1), (3, 4), (4, 3)]
    c = spark.createDataFrame([(2, "2024-02-01", "pinned", "false"), (3, "2024-02-01", "pinned", "true"), (3, "2024-02-02", "name", "new")], "doc_id long, t string, field string, value string").withColumn("ts", F.col("t").cast("timestamp"))
    got = {r.doc_id: (r.name, r.pinned, r.pinned_at and r.pinned_at.day) for r in admin.apply_document_changes(d, c).collect()}
    assert got == {1: ("a", True, 1), 2: ("b", False, None), 3: ("new", True, 1), 4: ("d", True, None), 5: ("e", True, 9)}


def test_upsert_removes_old_chunks_even_without_new_ones(spark):
    kind = "doc_id long, chunk int, user_id long, filename string, sheet string, text string, embedding array<float>"
    old = spark.createDataFrame([(1, 0, 5, "f", None, "old", [1.0]), (2, 0, 5, "f", None, "stays", None)], kind)
    new = spark.createDataFrame([(1, "x", None, None, "t", None, 1), (9, "0", None, None, "t", None, 1)], "doc_id long, chunk string, filename string, sheet string, text string, embedding array<float>, seq long")
    docs = spark.createDataFrame([(1, 5, "doc one"), (2, 5, "doc two")], "doc_id long, user_id long, name string")
    assert [(r.doc_id, r.text) for r in tables.upsert_chunks(new, old, docs).collect()] == [(2, "stays")]
    more = spark.createDataFrame([(1, "0", "", "", "t", [2.0], 1), (1, "0", "g", "s", "u", None, 2)], new.schema)
    assert sorted((r.doc_id, r.user_id, r.filename, r.sheet, r.text) for r in tables.upsert_chunks(more, old, docs).collect()) == [(1, 5, "g", "s", "u"), (2, 5, "f", None, "stays")]


def test_rate_limit_of_one_busy_user(spark):
    rows = spark.range(20_000).select(F.lit(1).cast("long").alias("user_id"), F.timestamp_seconds(F.col("id") * 60).alias("ts"), F.col("id").alias("seq"))
    got = admin.rate_limit(rows)
    assert got.filter("allowed").count() == 3 * 14 and got.agg(F.max("retry_hours")).first()[0] == 24  # 20,000 minutes: 13.9 windows of a day


def test_consent_of_scans_form_and_chat(spark):
    """By doc_id: what the chat does depends on the gate, what the form does doesn't; a scan ends the waiting."""
    told = {
        1: ("scan_hit no", (True, False, False)),
        2: ("scan_hit ask yes", (True, True, False)),
        3: ("yes scan_hit", (True, False, False)),  # a yes to a document that isn't gated confirms nothing
        4: ("agree scan_hit", (True, True, False)),  # the form confirms any document
        5: ("scan_hit ask", (True, False, True)),
        6: ("scan_hit ask scan_hit", (True, False, False)),
        7: ("scan_hit yes refuse ask", (True, False, True)),
        8: ("scan_hit yes no", (True, True, False)),  # no longer gated
        9: ("scan_hit ask scan_clear ask", (False, False, False)),
        10: ("other", (False, False, False)),
    }
    rows = [(d, i, k) for d, (kinds, _) in told.items() for i, k in enumerate(kinds.split())]
    events = spark.createDataFrame(rows + [(None, 1, "yes"), (11, 1, None)], "doc_id long, seq long, kind string").withColumn("ts", stamp("2024-01-01"))
    state = guard.consent_state(events)
    assert {r.doc_id: (r.sensitive, r.confirmed, r.awaiting) for r in state.collect()} == {d: want for d, (_, want) in told.items()} | {11: (False, False, False)}
    assert guard.consent_state(events.limit(0)).collect() == []
    q = spark.createDataFrame([(1, 1, "what?"), (2, 2, "what?"), (3, 3, "Yes")], "question_id long, doc_id long, question string")
    none = q.limit(0)
    routes = guard.route_question(q, state, none.select("doc_id"), q.select("doc_id"), none.select("question_id"))
    assert {r.question_id: r.route for r in routes.collect()} == {1: "consent-pending", 2: "retrieve", 3: "consent-yes"}


def test_consent_of_one_busy_document(spark):
    """Many events of one document, over several ranges, against a plain fold."""
    rng = random.Random(3)
    rows = [(7 if rng.random() < 0.6 else rng.randrange(20), i, rng.choice([*guard.KINDS, "other"])) for i in range(4000)]
    want = {}
    for d, _, k in rows:
        want[d] = guard.stepped(want.get(d, (False, False, False)), k)
    events = spark.createDataFrame(rows, "doc_id long, seq long, kind string").withColumn("ts", F.timestamp_seconds("seq"))
    assert {r.doc_id: (r.sensitive, r.confirmed, r.awaiting) for r in guard.consent_state(events).collect()} == want


def plain_chunks(body, size, overlap):
    done, open_, n = [], "", 0
    for p in filter(None, (x.strip(" \t\n\x0b\f\r") for x in re.split(r"\n\s*\n", body.strip(" \t\n\x0b\f\r")))):
        if n + len(p) + 2 <= size or not open_:
            open_, n = f"{open_}\n\n{p}" if open_ else p, n + len(p) + 2
        else:
            done.append(open_)
            tail = open_[-overlap:] if overlap and len(open_) > overlap else ""
            open_, n = f"{tail}\n\n{p}" if tail else p, len(tail) + len(p) + 2
    return done + [open_] * bool(open_)


def test_chunks_of_many_paragraphs(spark):
    """Texts of up to 3,000 paragraphs, tiny ones among them, so that what a chunk hands on spans many."""
    rng, rows = random.Random(5), [(0, None), (1, ""), (2, " \n\n \n"), (3, "x" * 5000)]
    for i, (n, most) in enumerate([(3000, 400), (600, 3), (300, 60), (257, 900), (256, 1), (30, 1500)]):
        rows.append((10 + i, "\n \n".join(rng.choice("abé😀") * rng.randint(1, most) for _ in range(n))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for size, overlap in ((1000, 200), (1600, 200), (50, 7), (300, 0)):
        got = {}
        for r in text.chunk(df, size, overlap).orderBy("doc_id", "chunk").collect():
            got.setdefault(r.doc_id, []).append(r.text)
        assert got == {d: c for d, t in rows if (c := plain_chunks(t or "", size, overlap))}


def test_sections(spark):
    rows = [(1, "\n  body a  \n"), (2, "# Sheet: B\r\n x \r\n\r\n# Sheet:  \ny\x0b z"), (3, "head\u2028# Sheet: C # Sheet: D\n\n"), (4, None), (5, "# Sheet: E\n\n# Sheet: F\n f # Sheet: g")]
    got = [(r.doc_id, r.sheet, r.text) for r in text.split_sections(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id", "section").collect()]
    assert got == [(1, None, "\n  body a  \n"), (2, "B", "x"), (2, None, "y\n z"), (3, None, "head"), (5, "F", "f # Sheet: g")]


def test_decks_ask_for_what_is_missing(spark):
    card = lambda r, at, f: (1, r, at, f, "b", "c", "Easy")
    rows = [card(1, i, f"c{i}") for i in range(15)] + [card(2, 0, "c0"), card(2, 1, "c1"), *(card(2, 1 + i, f"d{i}") for i in range(1, 7))]
    df = spark.createDataFrame(rows, "request_id long, round int, at int, front string, back string, category string, difficulty string")
    deck = lambda n: [r.front for r in assets.assemble_deck(df, n).orderBy("position").collect()]
    assert deck(20) == [f"c{i}" for i in range(15)] + ["d1", "d2", "d3"]  # five are missing, so the second round looks at five
    assert deck(5) == [f"c{i}" for i in range(5)] and deck(1) == ["c0", "c1", "c2"]
    dry = df.filter("round = 1").union(df.filter("round = 1 and at < 2").withColumn("round", F.lit(2))).union(df.filter("round = 1 and at = 3").selectExpr("request_id", "3", "0", "'new'", "back", "category", "difficulty"))
    assert assets.assemble_deck(dry, 30).count() == 15  # the second round adds none, so the third isn't asked for
    gap = df.filter("round = 1").union(df.filter("round = 2").withColumn("round", F.lit(3)))
    assert assets.assemble_deck(gap, 30).count() == 15


def test_identities(spark):
    users = spark.createDataFrame([(1, "Ann", "ann@x", "g1", None), (2, "Bob", "Bob@x", None, None), (3, "Cy", "cy@x", "g3", "own")], "user_id long, name string, email string, google_id string, avatar string")
    rows = [(1, "g1", "other@x", "n", "pic"), (2, "g2", "bob@X ", "n", "pic"), (3, "g2", "new@x", "n", "pic2"), (4, "g9", "cy@x", "n", "pic"), (5, "g5", "Dee@x", " ", None), (6, "g5", "dee2@x", "Dee", "late"), (7, "g6", "dee@x", "n", None), (8, "g6", "dee2@x", "n", "p"), (9, None, "eve@x", None, "p"), (10, None, "eve@x", "Eve", None)]
    got = admin.link_identities(users, spark.createDataFrame(rows, "login_id long, google_id string, email string, name string, avatar string"))
    assert [tuple(r)[1:] for r in got.orderBy("login_id").collect()] == [
        (1, "g1", "known", "Ann", None), (2, "g2", "linked", "Bob", "pic"), (2, "g2", "known", "Bob", "pic"), (3, "g3", "known", "Cy", "own"), (None, "g5", "new", "dee", None),
        (None, "g5", "known", "dee", None), (None, "g5", "known", "dee", None), (None, "g6", "new", "n", "p"), (None, None, "new", "eve", "p"), (None, None, "known", "eve", "p"),
    ]


def test_rate_limit_spreads_busy_users(spark):
    """A user with a third of all events, in windows that begin anywhere, gaps of days, equal rows; both ways give the same."""
    rng = random.Random(9)
    rows = [(7 if i % 3 == 0 else rng.randrange(30), rng.choice([0, 40, 300]) * 86400 + rng.randrange(6 * 86400), i // 2) for i in range(3000)]
    rows += [(7, 86400, 5)] * 3 + [(None, 5, 1)]
    df = spark.createDataFrame(rows, "user_id long, s long, seq long").select("user_id", F.timestamp_seconds("s").alias("ts"), "seq")
    few, many = (sorted(map(str, admin.rate_limit(df, busy=b).collect())) for b in (10**6, 200))
    assert few == many and len(few) == 3003
    want, start = {}, {}
    for u, s, q in sorted(r for r in rows if r[0] is not None):
        if u not in start or s - start[u][0] >= 86400:
            start[u] = (s, 0)
        t0, n = start[u]
        ok = n < 3
        start[u] = (t0, n + ok)
        want[u] = want.get(u, 0) + ok
    assert {r.user_id: r.n for r in admin.rate_limit(df, busy=200).filter("allowed").groupBy("user_id").agg(F.count("*").alias("n")).collect()} == want


def test_pages_of_documents_by_any_field(spark):
    d = spark.createDataFrame([(i, 1, f"n{i}", "t", s, None) for i, s in ((1, 5), (2, 3), (3, 5), (4, 9))], "doc_id long, user_id long, name string, type string, size long, uploaded_at timestamp")
    u = spark.createDataFrame([(1, "Ann")], "user_id long, name string")
    page = lambda *a: [r.doc_id for r in admin.document_page(d, u, "", "", 1, 3, *a).collect()]
    assert page("size", True) == [2, 1, 3] and page("size") == [4, 3, 1] and page("name", True) == [1, 2, 3]
    with pytest.raises(ValueError):
        page("text")


def test_searches_of_the_index(spark):
    rows = [(u, d, c, t) for u in (1, 2) for d in range(40) for c, t in enumerate([f"Common word{d % 7} x{d}", None if d == 3 else f"rare{d} COMMON common 😀é"])]
    chunks = spark.createDataFrame(rows, "user_id long, doc_id long, chunk long, text string").withColumn("num", F.lit("clash"))
    index = search.SearchIndex(spark, shared_folder(spark, "index")).build(chunks)
    q = spark.createDataFrame([(1, 1, "common rare5"), (2, 2, "WORD3 nothing"), (3, 1, " "), (4, 9, "common"), (5, 1, "x1"), (6, 1, "é"), (7, 1, "common x3"), (8, 2, "mmon w"), (9, 1, None)], "query_id long, user_id long, q string")
    plain = lambda f: sorted(map(tuple, f(q, chunks, 7).select("query_id", "doc_id", "chunk", "rank").collect()))
    for ours, whole in ((search.keyword_search, retrieve.keyword_search), (search.substring_search, retrieve.substring_search)):
        assert sorted(map(tuple, ours(q, index, 7).select("query_id", "doc_id", "chunk", "rank").collect())) == plain(whole)
    assert {r.query_id for r in search.substring_candidates(q, index).collect()} == {1, 4, 5, 6, 7, 8} - {1, 4, 7}


def test_runtime(spark):
    lines = ["process_uptime_seconds 10", "process_cpu_user_seconds_total 9", "process_cpu_system_seconds_total 8", "process_resident_memory_bytes 3145728", "# x"]
    of = lambda x: metrics.runtime(metrics.parse_exposition(spark.createDataFrame([(v,) for v in x], "value string"))).first()
    assert of(lines) == (10.0, 100, 3) and of(lines[1:]) == (0.0, None, 3)


def test_consent_of_one_document_alone(spark):
    events = spark.createDataFrame([(7, 1, 1, "scan_hit"), (7, 2, 2, "ask"), (7, 3, 3, "yes")], "doc_id long, ts long, seq long, kind string")
    assert [tuple(r) for r in guard.consent_state(events).collect()] == [(7, True, True, False)]


def test_postings_are_whole_rows_of_a_block(spark):
    """Each block of a user has one row for each term, which says how many chunks hold it, whatever tasks and batches its chunks came in."""
    rows = [(d % 2, d, 0, f"aa{d % 3} aa{d % 3} zz") for d in range(50)]
    index = search.SearchIndex(spark, shared_folder(spark, "index")).build(spark.createDataFrame(rows, "user_id long, doc_id long, chunk long, text string"))
    for name, term, most in (("terms", "zz", 1), ("terms", "aa1", 2), ("grams", " zz", None)):
        got = index.table(name).filter(F.col("term") == term).collect()
        assert sum(r.n for r in got) == sum(term in t for *_, t in rows) and len({(r.user_id, r.block) for r in got}) == len(got)
        assert all(len(r["at"]) == r.n and r["at"] == sorted(set(r["at"])) for r in got) and (most is None or {r.most for r in got} == {most})
    with_few = search.SearchIndex(spark, shared_folder(spark, "index")).build(spark.createDataFrame([(1, 1, 0, "x")], "user_id long, doc_id long, chunk long, text string"), terms=False)
    assert [r.term for r in with_few.table("grams").collect()] == ["x\x00\x00"]


def test_queries_whose_first_candidates_fail_go_through_all(spark, monkeypatch):
    """Chunks with all trigrams of a needle but not the needle come before those that contain it."""
    monkeypatch.setattr(search, "FIRST_HELD", 3)
    rows = [(1, d, 0, "abcd bcde" if d < 30 else "abcde") for d in range(40)]
    index = search.SearchIndex(spark, shared_folder(spark, "index")).build(spark.createDataFrame(rows, "user_id long, doc_id long, chunk long, text string"))
    q = spark.createDataFrame([(1, 1, "abcde"), (2, 1, "bc")], "query_id long, user_id long, q string")
    assert sorted((r.query_id, r.doc_id, r["rank"]) for r in search.substring_search(q, index, 2).collect()) == [(1, 30, 1), (1, 31, 2), (2, 0, 1), (2, 1, 2)]
