"""Reports: joins by key before searches, and classes from one reading of a text."""

import re

from pyspark.sql import functions as F

from quire.operators import admin
from quire.plans.queries import load_from


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_search_waits_for_the_join_by_key(spark):
    t = load_from(spark, "/root/testdata/sf0.001")
    shown = plan(admin.find_reports(t("fx_reports"), "open", "crash"))
    assert re.search(r"(HashJoin|SortMergeJoin)", shown) and not re.search(r"NestedLoopJoin.*RLIKE", shown)


def test_classes_and_summary(spark):
    rows = [("x", "A BUG", "open"), ("x", "feedbacK", "open"), ("x", "K and FeedBack", "resolved"), (None, "request", None), ("İssue", None, "open")]
    df = spark.createDataFrame(rows, "subject string, message string, status string")
    got = [r[0] for r in df.select(admin.report_class(F.col("subject"), F.col("message"))).collect()]
    assert got == ["bug", "other", "feedback", "feature_request", "other"]
    assert tuple(admin.report_summary(df).first()) == (5, 1, 3, 1, 1, 1, 2) and tuple(admin.report_summary(df.limit(0)).first()) == (0,) * 7
    assert len(re.findall("Filter.*class", plan(admin.report_types(df)))) == 0
