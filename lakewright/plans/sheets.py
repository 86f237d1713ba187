"""Queries: spreadsheet functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakewright.functions import sheets as S
from lakewright.plans.catalog import register
from lakewright.session import table


@register("g1_aggregates", "SELECT round(sum(l_quantity), 2) AS total, round(avg(l_quantity), 6) AS mean, min(l_quantity)::DOUBLE AS low, max(l_quantity)::DOUBLE AS high, count(l_quantity) AS n, median(l_quantity) AS med, round(stddev_samp(l_quantity), 6) AS sd, round(stddev_pop(l_quantity), 6) AS sdp FROM lineitem")
def aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity").cast("double")
    return table(spark, sf_dir, "lineitem").agg(F.round(F.sum(q), 2).alias("total"), F.round(F.avg(q), 6).alias("mean"), F.min(q).alias("low"), F.max(q).alias("high"), F.count(q).alias("n"), F.median(q).alias("med"), F.round(F.stddev_samp(q), 6).alias("sd"), F.round(F.stddev_pop(q), 6).alias("sdp"))


@register("g5_rounding", "SELECT l_orderkey, l_linenumber, floor((l_extendedprice - 20000) * 10 + 0.5) / 10 AS rounded, floor(l_extendedprice - 20000)::BIGINT AS whole, abs(l_extendedprice - 20000) AS size FROM lineitem")
def rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("l_extendedprice") - 20000
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", S.sheet_round(x, 1).alias("rounded"), F.floor(x).cast("long").alias("whole"), F.abs(x).alias("size"))


@register("g7_sumifs", "SELECT round(sum(l_extendedprice) FILTER (l_quantity >= 10 AND l_returnflag = 'N'), 2) AS s, round(avg(l_extendedprice) FILTER (l_quantity < 10 AND l_returnflag <> 'N'), 4) AS a, count(*) FILTER (l_quantity > 40 AND l_linestatus = 'O') AS n FROM lineitem")
def sumifs(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, flag, status, price = F.col("l_quantity"), F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_extendedprice")
    return table(spark, sf_dir, "lineitem").agg(
        F.round(S.sumifs(price, [(q, ">=10"), (flag, "N")]), 2).alias("s"), F.round(S.averageifs(price, [(q, "<10"), (flag, "<>N")]), 4).alias("a"), S.countifs([(q, ">40"), (status, "=O")]).alias("n")
    )


@register("g8_criteria", "SELECT p_partkey FROM part WHERE regexp_matches(p_brand, '(?is)^brand#.2$') AND p_size <> 7")
def criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").filter(S.criteria([(F.col("p_brand"), "brand#?2"), (F.col("p_size"), "<>7")])).select("p_partkey")


@register("g10_sumproduct", "SELECT round(sum(l_extendedprice * (1 - l_discount) * (l_quantity > 25)::INT), 2) AS total FROM lineitem")
def sumproduct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (F.col("l_quantity") > 25).cast("int")), 2).alias("total"))


@register("g13_dates", "SELECT o_orderkey, year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m, last_day((o_orderdate::DATE + INTERVAL 2 MONTH)::DATE)::VARCHAR AS eomonth, datediff('day', o_orderdate::DATE, DATE '2000-01-01')::BIGINT AS days FROM orders")
def dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate").cast("date")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.year(d).alias("y"), F.month(d).alias("m"), F.last_day(F.add_months(d, 2)).cast("string").alias("eomonth"), F.datediff(F.lit("2000-01-01").cast("date"), d).cast("long").alias("days"))


@register("g14_unique_sorted", "SELECT n_regionkey, array_to_string(list_sort(list(DISTINCT left(n_name, 3))), ', ') AS names FROM nation GROUP BY n_regionkey")
def unique_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_set(F.left("n_name", F.lit(3)))), ", ").alias("names"))


@register("g15_text_functions", r"SELECT p_partkey, left(p_name, 4) AS l, right(p_name, 3) AS r, upper(p_type) AS u, length(p_name)::BIGINT AS n, trim(regexp_replace(p_name, ' +', ' ', 'g')) AS t, replace(p_name, 'a', '_') AS s FROM part")
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_name")
    return table(spark, sf_dir, "part").select("p_partkey", F.left(n, F.lit(4)).alias("l"), F.right(n, F.lit(3)).alias("r"), F.upper("p_type").alias("u"), F.length(n).cast("long").alias("n"), F.trim(F.regexp_replace(n, " +", " ")).alias("t"), F.replace(n, F.lit("a"), F.lit("_")).alias("s"))


@register("h2_waterfall", "WITH m AS (SELECT o_orderpriority AS step, sum(CASE WHEN o_orderstatus = 'F' THEN -1 ELSE 1 END)::BIGINT AS v FROM orders GROUP BY 1) SELECT step, v, (sum(v) OVER (ORDER BY step) - v)::BIGINT AS bar_from, (sum(v) OVER (ORDER BY step))::BIGINT AS bar_to FROM m")
def waterfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("step")).agg(F.sum(F.when(F.col("o_orderstatus") == "F", -1).otherwise(1)).alias("v"))
    upto = F.sum("v").over(Window.orderBy("step"))
    return m.select("step", "v", (upto - F.col("v")).alias("bar_from"), upto.alias("bar_to"))


def _nice_sql(x: str) -> str:
    return f"CASE WHEN {x} IS NULL OR isnan({x}) OR {x} <= 0 OR isinf({x}) THEN 1 WHEN {x} <= 5 THEN ceil({x}) ELSE pow(10.0, floor(log10({x}))) * CASE WHEN {x} / pow(10.0, floor(log10({x}))) <= 1 THEN 1 WHEN {x} / pow(10.0, floor(log10({x}))) <= 2 THEN 2 WHEN {x} / pow(10.0, floor(log10({x}))) <= 5 THEN 5 ELSE 10 END END::DOUBLE"


@register("h5_nice_axis", f"SELECT o_orderkey, {_nice_sql('x')} AS top, {_nice_sql('(x / 100000)')} AS small_top FROM (SELECT o_orderkey, o_totalprice::DOUBLE AS x FROM orders)")
def nice_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("o_totalprice").cast("double")
    return table(spark, sf_dir, "orders").select("o_orderkey", S.nice_max(x).alias("top"), S.nice_max(x / 100000).alias("small_top"))


@register("h8_heat_ratio", "SELECT l_returnflag, l_linestatus, round((v - min(v) OVER ()) / nullif(max(v) OVER () - min(v) OVER (), 0), 6) AS heat FROM (SELECT l_returnflag, l_linestatus, avg(l_quantity) AS v FROM lineitem GROUP BY ALL)")
def heat_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.avg("l_quantity").alias("v"))
    w = Window.partitionBy()
    return v.select("l_returnflag", "l_linestatus", F.round((F.col("v") - F.min("v").over(w)) / F.nullif(F.max("v").over(w) - F.min("v").over(w), F.lit(0.0)), 6).alias("heat"))
