"""Quizzes, cards and folds on literal rows."""

from pyspark.sql import functions as F

from quire.operators import admin, assets, guard, text


def test_quiz(spark):
    raw = '{"questions": [{"type": "mcq", "question": "q1", "options": ["a", " b ", "", "a"], "correct_answer": "c"}, 7, {"type": "true_false", "question": "q2", "correct_answer": "Yes"}, {"type": "mcq", "question": "q3", "options": ["a"], "correct_answer": "a"}]}'
    df = spark.createDataFrame([(1, raw), (2, f"Here:\n```json\n{raw}\n```"), (3, f"so {raw} there"), (4, "{broken"), (5, None)], "request_id long, raw string")
    got = sorted((r.request_id, r.position, r.type, list(r.options), r.correct_answer) for r in assets.clean_quiz(df).collect())
    one = [(1, "mcq", ["a", "b", "c"], "c"), (2, "true_false", ["true", "false"], "true")]
    assert got == [(i, *x) for i in (1, 2, 3) for x in one]
    assert {r.request_id: r.status for r in assets.quiz_status(df).collect()} == {1: "ok", 2: "ok", 3: "ok", 4: "invalid", 5: "invalid"}


def test_deck(spark):
    card = lambda f: f'{{"front": "{f}", "back": "b", "difficulty": "hARD"}}'
    rows = [(1, 1, [card("a"), card("b"), card("a")]), (1, 2, [card("a")]), (1, 3, [card("z")])]
    df = spark.createDataFrame([(i, r, '{"flashcards": [' + ",".join(c) + "]}") for i, r, c in rows], "request_id long, round int, raw string")
    got = [(r.position, r.front, r.category, r.difficulty) for r in assets.assemble_deck(assets.clean_cards(df)).orderBy("position").collect()]
    assert got == [(1, "a", "General", "Hard"), (2, "b", "General", "Hard")]


def test_chunk_limits(spark):
    body = "a" * 996 + "\n\n" + "b" * 5000 + "\n \n" + "c"
    got = [r.text for r in text.chunk(spark.createDataFrame([(1, body), (2, None), (3, "  ")], "doc_id long, text string")).orderBy("chunk").collect()]
    assert got == ["a" * 996, "a" * 200 + "\n\n" + "b" * 5000, "b" * 200 + "\n\n" + "c"]


def test_scan(spark):
    df = spark.createDataFrame([(1, "ABCDE1234F and 123-45-6789"), (2, None), (3, "1234 5678 9012")], "doc_id long, text string")
    got = {r.doc_id: r.matches for r in guard.scan_sensitive(df).collect()}
    assert got == {1: {"pan": 1, "ssn_like": 1}, 2: {}, 3: {"aadhaar": 1}}


def test_rate_limit(spark):
    rows = [(1, f"2024-01-0{1 + k // 24} {k % 24:02d}:00:00", k) for k in (0, 1, 2, 3, 24)]
    df = spark.createDataFrame(rows, "user_id long, ts string, seq long").withColumn("ts", F.col("ts").cast("timestamp"))
    assert [(r.allowed, r.count_in_window, r.retry_hours) for r in admin.rate_limit(df).orderBy("ts").collect()] == [(True, 1, None), (True, 2, None), (True, 3, None), (False, 3, 21), (True, 1, None)]
