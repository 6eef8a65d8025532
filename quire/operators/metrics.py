"""Request metrics: exposition text, histograms, percentiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Upper bounds of the latency buckets, in seconds.
BOUNDS = [0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.0, 5.0, float("inf")]


def parse_exposition(lines: DataFrame) -> DataFrame:
    """name, labels, value of metric lines (column value); comments and other lines are skipped."""
    p = "^([a-zA-Z_:][a-zA-Z0-9_:]*)(?:\\{(.*)\\})?\\s+(\\S+)"
    part = lambda i: F.regexp_extract(F.trim("value"), p, i)
    body = F.regexp_replace(part(2), ",\\s*$", "")
    labels = F.when(body != "", F.transform_values(F.str_to_map(F.regexp_replace(body, '",\\s*', '"\u0001'), F.lit("\u0001"), F.lit("=")), lambda k, v: F.regexp_replace(v, '^"|"$', ""))).otherwise(F.create_map().cast("map<string,string>"))
    number = F.expr("try_cast(" + "v AS DOUBLE)")
    rows = lines.filter(~F.col("value").rlike("^\\s*(#|$)")).select(part(1).alias("name"), labels.alias("labels"), F.replace(part(3), F.lit("+Inf"), F.lit("Infinity")).alias("v"))
    return rows.select("name", "labels", number.alias("value")).filter("name <> '' and value is not null")


def summary(requests: DataFrame) -> DataFrame:
    """One row: requests, mean_ms, success_percent (2xx, two decimals); nulls where there are none."""
    n = requests.agg(F.count("*").alias("requests"), F.sum("duration_s").alias("_s"), F.count_if(F.col("status_code").between(200, 299)).alias("_ok"))
    return n.select("requests", F.when(F.col("requests") > 0, F.round(F.col("_s") / F.col("requests") * 1000).cast("long")).alias("mean_ms"), F.when(F.col("requests") > 0, F.round(100 * F.col("_ok") / F.col("requests"), 2)).alias("success_percent"))


def request_histogram(requests: DataFrame) -> DataFrame:
    """method, route, status_code, le, cumulative, total, sum_s."""
    keys = ["method", "route", "status_code"]
    sums = requests.groupBy(*keys).agg(F.count("*").alias("total"), F.round(F.sum("duration_s"), 6).alias("sum_s"), *[F.count_if(F.col("duration_s") <= b).alias(f"_{i}") for i, b in enumerate(BOUNDS)])
    rows = F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"_{i}").alias("cumulative")) for i, b in enumerate(BOUNDS)])
    return sums.select(*keys, F.explode(rows).alias("x"), "total", "sum_s").select(*keys, "x.le", "x.cumulative", "total", "sum_s")


def histogram_percentiles(buckets: DataFrame, points: list[float], by: list[str] | None = None) -> DataFrame:
    """p, bound_ms (for each of `by`): the smallest bound that p of all requests stay under; 0 without data."""
    by = by or []
    sums = buckets.groupBy(*by, "le").agg(F.sum("cumulative").alias("c"))
    each = sums.groupBy(*by).agg(F.max("c").alias("n"), F.collect_list(F.struct("le", "c")).alias("b")).withColumn("p", F.explode(F.array(*map(F.lit, points))))
    bound = F.array_min(F.transform(F.filter("b", lambda x: x["c"] >= F.col("p") * F.col("n")), lambda x: x["le"]))
    return each.select(*by, "p", F.when(F.col("n") > 0, F.round(bound * 1000)).otherwise(0.0).alias("bound_ms"))


def top_routes(buckets: DataFrame, n: int = 5) -> DataFrame:
    """route, n, p90_ms of the routes with most requests."""
    count = buckets.groupBy("route", "le").agg(F.sum("cumulative").alias("c")).groupBy("route").agg(F.max("c").alias("n"))
    return count.join(histogram_percentiles(buckets, [0.9], ["route"]), "route").select("route", "n", F.col("bound_ms").alias("p90_ms")).orderBy(F.desc("n"), "route").limit(n)


def runtime(samples: DataFrame) -> DataFrame:
    """One row from parsed samples (name, value): uptime_s, cpu_percent (100 at most; null without an uptime), rss_mb."""
    of = lambda n: F.coalesce(F.max(F.when(F.col("name") == n, F.col("value"))), F.lit(0.0)).alias(n)
    up, user, system, rss = "process_uptime_seconds", "process_cpu_user_seconds_total", "process_cpu_system_seconds_total", "process_resident_memory_bytes"
    cpu = F.least(F.lit(100.0), F.round((F.col(user) + F.col(system)) / F.col(up) * 100))
    return samples.agg(*map(of, (up, user, system, rss))).select(F.col(up).alias("uptime_s"), F.when(F.col(up) > 0, cpu).cast("long").alias("cpu_percent"), F.round(F.col(rss) / (1 << 20)).cast("long").alias("rss_mb"))
