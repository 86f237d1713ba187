"""Joins: latest rows, lookups, intervals, cascades."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewright.operators.relational import as_of, best_overlap, latest_per
from lakewright.plans.catalog import register
from lakewright.session import table


@register("c1_semi_join", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'N' AND l_quantity > 45)")
def semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'N' AND l_quantity > 45")
    return table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey")


@register("c2_three_way", "SELECT p_brand, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE o_orderstatus = 'F' GROUP BY p_brand")
def three_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice")
    orders = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select("o_orderkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    both = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return both.groupBy("p_brand").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


LATEST_SQL = "SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1"


@register("c4_latest_row_join", f"SELECT c_custkey, o_orderkey, o_orderstatus FROM customer LEFT JOIN ({LATEST_SQL}) ON c_custkey = o_custkey")
def latest_row_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = latest_per(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate"), ["o_custkey"], F.col("o_orderdate").desc(), F.col("o_orderkey").desc())
    return table(spark, sf_dir, "customer").select("c_custkey").join(latest, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey", "o_orderstatus")


@register("c9_tree", "SELECT c.n_nationkey, c.n_name, coalesce(r.r_name, 'root') AS parent FROM nation c LEFT JOIN (SELECT * FROM region WHERE r_regionkey <> 2) r ON c.n_regionkey = r.r_regionkey")
def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents = table(spark, sf_dir, "region").filter("r_regionkey <> 2")
    return table(spark, sf_dir, "nation").join(parents, F.col("n_regionkey") == F.col("r_regionkey"), "left").select("n_nationkey", "n_name", F.coalesce("r_name", F.lit("root")).alias("parent"))


@register("c11_preaggregated", "SELECT c_custkey, coalesce(n, 0)::BIGINT AS n_orders, coalesce(f, 0)::BIGINT AS n_done FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, sum((o_orderstatus = 'F')::INT) AS f FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey")
def preaggregated(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("f"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(sums, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"), F.coalesce("f", F.lit(0)).alias("n_done"))


@register("c12_week_sessions", "SELECT s.s_suppkey, (DATE '1996-01-01' + (w.w * 7 + s.s_suppkey % 7)::INTEGER)::VARCHAR AS day FROM supplier s, (SELECT unnest(range(0, 4)) AS w) w")
def week_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    weeks = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("w")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", weeks)
    return s.select("s_suppkey", F.date_add(F.lit("1996-01-01").cast("date"), (F.col("w") * 7 + F.col("s_suppkey") % 7).cast("int")).cast("string").alias("day"))


@register("c13_best_overlap", """
WITH i AS (SELECT o_orderkey, o_orderdate::DATE AS s, o_orderdate::DATE + 5 AS e FROM orders),
p AS (SELECT o_orderkey, m, datediff('day', greatest(s, m), least(e, last_day(m))) + 1 AS overlap FROM i, LATERAL (SELECT unnest([date_trunc('month', s)::DATE, date_trunc('month', e)::DATE]) AS m))
SELECT o_orderkey, m::VARCHAR AS span, overlap::BIGINT AS overlap FROM p QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY overlap DESC, m) = 1""")
def overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("start"), F.date_add(F.col("o_orderdate").cast("date"), 5).alias("end"))
    month = F.explode(F.sequence(F.lit("1980-01-01").cast("date"), F.lit("2030-12-01").cast("date"), F.expr("interval 1 month")))
    spans = spark.range(1).select(month.alias("s")).select("s", F.last_day("s").alias("e"), F.col("s").cast("string").alias("span"))
    return best_overlap(items, spans, "o_orderkey", 31).select("o_orderkey", "span", F.col("overlap").cast("long").alias("overlap"))


@register("c15_exact_lookup", "SELECT l_orderkey, l_linenumber, p_name FROM lineitem LEFT JOIN (SELECT p_size, arg_min(p_name, p_partkey) AS p_name FROM part GROUP BY p_size) ON l_quantity = p_size")
def exact_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "part").groupBy("p_size").agg(F.min_by("p_name", "p_partkey").alias("p_name"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity").join(first, F.col("l_quantity") == F.col("p_size"), "left").select("l_orderkey", "l_linenumber", "p_name")


_AS_OF = "SELECT l.l_orderkey, l.l_linenumber, p.p_partkey AS part FROM lineitem l ASOF LEFT JOIN (SELECT p_retailprice, max(p_partkey) AS p_partkey FROM part GROUP BY p_retailprice) p ON l.l_extendedprice {} p.p_retailprice"


@register("c16_as_of", _AS_OF.format(">="))
def as_of_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return as_of(lines, table(spark, sf_dir, "part").select("p_retailprice", "p_partkey"), "l_extendedprice", "p_retailprice", "p_partkey").select("l_orderkey", "l_linenumber", F.col("p_partkey").alias("part"))


@register("c17_reverse_as_of", _AS_OF.format("<="))
def reverse_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return as_of(lines, table(spark, sf_dir, "part").select("p_retailprice", "p_partkey"), "l_extendedprice", "p_retailprice", "p_partkey", reverse=True).select("l_orderkey", "l_linenumber", F.col("p_partkey").alias("part"))


@register("c18_last_resolution", """
WITH q AS (SELECT user_id, min(event_id) AS asked FROM events WHERE event_type = 'signup' GROUP BY user_id),
r AS (SELECT user_id, arg_max(event_type, event_id) AS decision FROM events WHERE event_type IN ('purchase', 'error') GROUP BY user_id)
SELECT user_id, asked, coalesce(decision, 'open') AS decision FROM q LEFT JOIN r USING (user_id)""")
def last_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    asked = e.filter("event_type = 'signup'").groupBy("user_id").agg(F.min("event_id").alias("asked"))
    last = e.filter("event_type IN ('purchase', 'error')").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("decision"))
    return asked.join(last, "user_id", "left").select("user_id", "asked", F.coalesce("decision", F.lit("open")).alias("decision"))


@register("c20_live_over_history", """
WITH h AS (SELECT event_id, value FROM events WHERE event_id % 3 <> 0), v AS (SELECT event_id, value * 2 AS value FROM events WHERE event_id % 2 = 0 AND event_type <> 'error')
SELECT coalesce(v.event_id, h.event_id) AS event_id, round(coalesce(v.value, h.value), 4) AS value, v.event_id IS NOT NULL AS live FROM h FULL OUTER JOIN v ON h.event_id = v.event_id""")
def live_over_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    h = e.filter("event_id % 3 <> 0").select("event_id", F.col("value").alias("old"))
    v = e.filter("event_id % 2 = 0 AND event_type <> 'error'").select("event_id", (F.col("value") * 2).alias("new"), F.lit(True).alias("live"))
    return h.join(v, "event_id", "full_outer").select("event_id", F.round(F.coalesce("new", "old"), 4).alias("value"), F.coalesce("live", F.lit(False)).alias("live"))


@register("c25_keep_existing", "SELECT n_name, true AS enabled FROM nation WHERE n_regionkey < 3 UNION ALL SELECT n_name, false FROM nation WHERE n_nationkey % 2 = 0 AND n_name NOT IN (SELECT n_name FROM nation WHERE n_regionkey < 3)")
def keep_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    old = n.filter("n_regionkey < 3").select("n_name", F.lit(True).alias("enabled"))
    new = n.filter("n_nationkey % 2 = 0").select("n_name", F.lit(False).alias("enabled"))
    return old.unionByName(new.join(old, "n_name", "left_anti"))
