"""Queries: aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakewright.plans.catalog import register
from lakewright.session import table

#: The day on which time-dependent queries are asked.
AS_OF = "2024-01-30"


@register(
    "d2_conditional_counts",
    """WITH j AS (SELECT c_custkey, ts::DATE AS day, event_type AS s FROM customer LEFT JOIN events ON user_id = c_custkey),
n AS (SELECT c_custkey, day, count(s) AS total, count(*) FILTER (s = 'purchase') AS done, count(*) FILTER (s = 'error') AS failed, count(*) FILTER (s = 'click') AS running, count(*) FILTER (s = 'view') AS queued FROM j GROUP BY c_custkey, day)
SELECT c_custkey, day::VARCHAR AS day, done, failed, total, CASE WHEN total = 0 THEN 0 ELSE floor(100.0 * done / total + 0.5) END::BIGINT AS progress,
  CASE WHEN total = 0 THEN 'idle' WHEN failed > 0 AND running = 0 AND queued = 0 THEN 'failed' WHEN done >= total THEN 'indexed' WHEN running > 0 THEN 'indexing' ELSE 'queued' END AS status FROM n""",
)
def conditional_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job is a customer's day: idle without tasks; failed once nothing runs or waits; indexed when all is done."""
    n = lambda kind: F.count_if(F.col("event_type") == kind)
    e = table(spark, sf_dir, "events").groupBy("user_id", F.col("ts").cast("date").cast("string").alias("day")).agg(F.count("*").alias("total"), n("purchase").alias("done"), n("error").alias("failed"), n("click").alias("running"), n("view").alias("queued"))
    d = table(spark, sf_dir, "customer").select("c_custkey").join(e, F.col("c_custkey") == F.col("user_id"), "left").fillna(0, ["total", "done", "failed", "running", "queued"])
    status = F.when(F.col("total") == 0, "idle").when((F.col("failed") > 0) & (F.col("running") == 0) & (F.col("queued") == 0), "failed").when(F.col("done") >= F.col("total"), "indexed").when(F.col("running") > 0, "indexing").otherwise("queued")
    progress = F.when(F.col("total") == 0, 0).otherwise(F.floor(100.0 * F.col("done") / F.col("total") + 0.5)).cast("long")
    return d.select("c_custkey", "day", "done", "failed", "total", progress.alias("progress"), status.alias("status"))


@register("d1_filtered_count", "SELECT count(*) AS n, max(o_orderkey) AS top FROM orders WHERE o_orderstatus = 'O'")
def filtered_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("top"))


@register("d5_zero_filled", "SELECT k AS kind, (SELECT count(*) FROM events WHERE event_type = k) AS n FROM (SELECT unnest(['view', 'click', 'refund', 'signup']) AS k)")
def zero_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    domain = spark.range(1).select(F.explode(F.array(*map(F.lit, ("view", "click", "refund", "signup")))).alias("kind"))
    counts = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("_k")).agg(F.count("*").alias("n"))
    return domain.join(counts, F.col("kind") == F.col("_k"), "left").select("kind", F.coalesce("n", F.lit(0)).alias("n"))


@register("d6_index_health", """
SELECT count(*) AS total, sum((quality = 1)::INT)::BIGINT AS ready, sum((quality = 0)::INT)::BIGINT AS stale, sum((quality IS NULL)::INT)::BIGINT AS unindexed,
  CASE WHEN sum((quality IS NULL)::INT) > 0 THEN 'unindexed' WHEN sum((quality = 0)::INT) > 0 THEN 'stale' ELSE 'ready' END AS verdict FROM documents LEFT JOIN labels USING (doc_id)""")
def index_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    q = F.col("quality")
    d = both.agg(F.count("*").alias("total"), F.count_if(q == 1).alias("ready"), F.count_if(q == 0).alias("stale"), F.count_if(q.isNull()).alias("unindexed"))
    return d.withColumn("verdict", F.when(F.col("unindexed") > 0, "unindexed").when(F.col("stale") > 0, "stale").otherwise("ready"))


@register("d7_usage_summary", f"""
SELECT event_type AS model, count(*) AS requests, round(sum(value), 4) AS total, round(coalesce(sum(value) FILTER (ts >= DATE '{AS_OF}'), 0), 4) AS today,
  round(coalesce(sum(value) FILTER (ts >= DATE '{AS_OF}' - 6), 0), 4) AS week, round(coalesce(sum(value) FILTER (ts >= DATE '{AS_OF}' - 29), 0), 4) AS month,
  min(ts)::DATE::VARCHAR AS first_use, max(ts)::DATE::VARCHAR AS last_use, count(DISTINCT user_id) AS threads
FROM events GROUP BY event_type ORDER BY total DESC, requests DESC, model LIMIT 12""")
def usage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    since = lambda days: F.col("ts") >= F.date_sub(F.lit(AS_OF).cast("date"), days).cast("timestamp_ntz")
    total = lambda days: F.round(F.coalesce(F.sum(F.when(since(days), F.col("value"))), F.lit(0.0)), 4)
    d = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("model")).agg(
        F.count("*").alias("requests"), F.round(F.sum("value"), 4).alias("total"), total(0).alias("today"), total(6).alias("week"), total(29).alias("month"),
        F.min("ts").cast("date").cast("string").alias("first_use"), F.max("ts").cast("date").cast("string").alias("last_use"), F.count_distinct("user_id").alias("threads"),
    )
    return d.orderBy(F.col("total").desc(), F.col("requests").desc(), "model").limit(12)


@register("d9_arg_max", "SELECT user_id, event_type, n FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) = 1")
def arg_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    best = n.groupBy("user_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "event_type")).alias("b"))
    return best.select("user_id", "b.event_type", (-F.col("b.n")).alias("n"))


@register("d10_hit_rate", "SELECT round(sum(CASE WHEN event_type = 'click' THEN value ELSE 0 END) / sum(value), 6) AS rate FROM (SELECT * FROM events WHERE value > 0 ORDER BY event_id DESC LIMIT 50)")
def hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = table(spark, sf_dir, "events").filter("value > 0").orderBy(F.col("event_id").desc()).limit(50)
    return last.agg(F.round(F.sum(F.when(F.col("event_type") == "click", F.col("value")).otherwise(0.0)) / F.sum("value"), 6).alias("rate"))


@register("d13_cards", """
WITH o AS (SELECT o_custkey, count(*) AS n, max(o_orderdate) AS last FROM orders GROUP BY 1), l AS (SELECT o_custkey, count(*) AS n, max(l_shipdate) AS last FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)
SELECT c_custkey, coalesce(o.n, 0)::BIGINT AS n_orders, coalesce(l.n, 0)::BIGINT AS n_lines, greatest(o.last, l.last)::DATE::VARCHAR AS last FROM customer LEFT JOIN o ON c_custkey = o.o_custkey LEFT JOIN l ON c_custkey = l.o_custkey""")
def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    o = orders.groupBy(F.col("o_custkey").alias("_o")).agg(F.count("*").alias("no"), F.max("o_orderdate").alias("lo"))
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("_l")).agg(F.count("*").alias("nl"), F.max("l_shipdate").alias("ll"))
    d = table(spark, sf_dir, "customer").select("c_custkey").join(o, F.col("c_custkey") == F.col("_o"), "left").join(l, F.col("c_custkey") == F.col("_l"), "left")
    return d.select("c_custkey", F.coalesce("no", F.lit(0)).alias("n_orders"), F.coalesce("nl", F.lit(0)).alias("n_lines"), F.greatest("lo", "ll").cast("date").cast("string").alias("last"))


#: Weeks that a heat map shows if none are asked for, and the most that can be.
WEEKS, MOST_WEEKS = 16, 30


@register("d15_activity_heatmap", f"""
WITH s AS (SELECT unnest(generate_series(date_trunc('week', DATE '{AS_OF}')::DATE - 7 * {WEEKS - 1}, date_trunc('week', DATE '{AS_OF}')::DATE + 6, INTERVAL 1 DAY))::DATE AS day),
a AS (SELECT ts::DATE AS day, sum(CASE event_type WHEN 'purchase' THEN 3 WHEN 'click' THEN 2 ELSE 1 END)::BIGINT AS score FROM events GROUP BY 1)
SELECT s.day::VARCHAR AS day, coalesce(score, 0)::BIGINT AS score, datediff('week', min(s.day) OVER (), s.day)::BIGINT AS week FROM s LEFT JOIN a USING (day)""")
def heatmap(spark: SparkSession, sf_dir: str, weeks: int = WEEKS) -> DataFrame:
    """Every day of so many weeks, from 1 to 30, up to the week of the day asked for."""
    back = 7 * (max(1, min(MOST_WEEKS, weeks)) - 1)
    monday = F.date_trunc("week", F.lit(AS_OF).cast("date")).cast("date")
    spine = spark.range(1).select(monday.alias("m")).select("m", F.explode(F.sequence(F.date_sub("m", back), F.date_add("m", 6))).alias("day"))
    score = F.when(F.col("event_type") == "purchase", 3).when(F.col("event_type") == "click", 2).otherwise(1)
    daily = table(spark, sf_dir, "events").groupBy(F.col("ts").cast("date").alias("day")).agg(F.sum(score).alias("score"))
    return spine.join(daily, "day", "left").select(F.col("day").cast("string").alias("day"), F.coalesce("score", F.lit(0)).alias("score"), F.floor(F.datediff("day", F.date_sub("m", back)) / 7).cast("long").alias("week"))


@register("d16_group_statistics", "SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT props) AS paths, sum((value > 50)::INT)::BIGINT AS big FROM events GROUP BY event_type")
def group_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.count_distinct("props").alias("paths"), F.count_if(F.col("value") > 50).alias("big"))


@register("d18_listing", "SELECT CASE WHEN event_type IN ('view', 'click') THEN 'browse' ELSE 'act' END AS section, count(*) AS n FROM events GROUP BY 1 HAVING count(*) > 0 ORDER BY 1")
def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.when(F.col("event_type").isin("view", "click"), "browse").otherwise("act").alias("section")).agg(F.count("*").alias("n")).filter("n > 0").orderBy("section")


@register("d23_used_range", "SELECT l_returnflag, min(l_linenumber) AS first, max(l_linenumber) AS last, min(l_orderkey) AS low, max(l_orderkey) AS high FROM lineitem GROUP BY l_returnflag")
def used_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.min("l_linenumber").alias("first"), F.max("l_linenumber").alias("last"), F.min("l_orderkey").alias("low"), F.max("l_orderkey").alias("high"))


@register("d24_coverage", "SELECT source, CASE WHEN count(*) = 0 THEN 'skipped' WHEN sum((length(trim(text)) = 0 OR length(text) > 20000)::INT) > 0 THEN 'partial' ELSE 'complete' END AS coverage FROM documents GROUP BY source")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = F.count_if((F.length(F.trim("text")) == 0) | (F.length("text") > 20000))
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.when(F.count("*") == 0, "skipped").when(bad > 0, "partial").otherwise("complete").alias("coverage"))


@register("h1_percentiles", "SELECT l_returnflag, min(l_quantity)::DOUBLE AS lowest, quantile_cont(l_quantity, 0.25) AS q1, quantile_cont(l_quantity, 0.5) AS med, quantile_cont(l_quantity, 0.75) AS q3, max(l_quantity)::DOUBLE AS highest FROM lineitem GROUP BY l_returnflag")
def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.percentile("l_quantity", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    d = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.min("l_quantity").cast("double").alias("lowest"), p.alias("p"), F.max("l_quantity").cast("double").alias("highest"))
    return d.select("l_returnflag", "lowest", F.col("p")[0].alias("q1"), F.col("p")[1].alias("med"), F.col("p")[2].alias("q3"), "highest")


@register("h3_shares", "WITH s AS (SELECT o_orderpriority AS name, greatest(sum(o_totalprice), 0) AS v FROM orders GROUP BY 1) SELECT name, round(v / sum(v) OVER (), 6) AS share, round(sum(v) OVER (ORDER BY name) / sum(v) OVER (), 6) AS upto FROM s")
def shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("name")).agg(F.greatest(F.sum("o_totalprice"), F.lit(0.0)).alias("v"))
    total = F.sum("v").over(Window.partitionBy())
    return s.select("name", F.round(F.col("v") / total, 6).alias("share"), F.round(F.sum("v").over(Window.orderBy("name")) / total, 6).alias("upto"))
