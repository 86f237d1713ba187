"""Queries: latest rows, turns, runs, budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakewright.operators.ordered import running
from lakewright.operators.relational import latest_per
from lakewright.plans.catalog import register
from lakewright.session import table
from lakewright.streaming.timeline import run_states, running_digests, turns


@register("i1_latest_per_scope", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return latest_per(d, ["o_custkey"], F.col("o_orderdate").desc(), F.col("o_orderkey").desc()).select("o_custkey", "o_orderkey")


@register("i2_last_row", "SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def last_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("event_type"), F.max("event_id").alias("event_id"))


@register("i3_keep_first", "SELECT min(doc_id) AS doc_id, md5(text) AS digest FROM documents GROUP BY text")
def keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(F.md5("text").alias("digest")).agg(F.min("doc_id").alias("doc_id"))


@register("i5_turns", "SELECT conv_id, n AS turn_no, min(turn) AS first_turn, max(turn) AS last_turn, count(*) AS records FROM (SELECT *, (sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING))::BIGINT AS n FROM conversations) WHERE n > 0 GROUP BY conv_id, n")
def turn_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(table(spark, sf_dir, "conversations"))


@register("i6_next_user_input", "SELECT conv_id, turn, min(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_user FROM conversations")
def next_user_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(1, Window.unboundedFollowing)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.min(F.when(F.col("role") == "user", F.col("turn"))).over(w).alias("next_user"))


@register("i9_open_runs", "SELECT user_id, max(event_id) AS run FROM events s WHERE event_type = 'signup' AND NOT EXISTS (SELECT 1 FROM events t WHERE t.user_id = s.user_id AND t.event_type IN ('purchase', 'error') AND t.event_id > s.event_id) GROUP BY user_id")
def open_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    ended = e.filter("event_type IN ('purchase', 'error')").groupBy("user_id").agg(F.max("event_id").alias("ended"))
    last = e.filter("event_type = 'signup'").groupBy("user_id").agg(F.max("event_id").alias("run"))
    return last.join(ended, "user_id", "left").filter("ended IS NULL OR ended < run").select("user_id", "run")


@register("i10_carried_run", "SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM events")
def carried_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "events").select("event_id", F.last(F.when(F.col("event_type") == "signup", F.col("event_id")), ignorenulls=True).over(w).alias("run"))


#: What a cache may hold: days since the table's last event, and hundredths of value.
MAX_DAYS, MAX_SIZE = 20, 500_000


def evicted(entries: DataFrame, by: str, age_days: int, budget: int) -> DataFrame:
    """entries (by, id, at, size) with kept: those not older than age_days, less the oldest ones until each cache is within its budget.

    So the newest stay while their sizes, summed from the newest on, are within it. Caches are cut into ranges: a cache of
    most entries is no task of its own.
    """
    now = entries.agg(F.max("at").alias("_now"))  # one row
    d = entries.join(F.broadcast(now), F.lit(True)).withColumn("_old", ~F.coalesce(F.col("at") >= F.col("_now") - F.make_dt_interval(F.lit(age_days)), F.lit(False)))
    d = d.withColumn("_size", F.when(F.col("_old"), 0).otherwise(F.col("size")))
    d = running(d, [F.col("at").desc(), F.col("id").desc()], (by,), "_size")
    return d.select(*entries.columns, (~F.col("_old") & (F.col("total") <= budget)).alias("kept"))


@register(
    "i15_budgeted_eviction",
    f"""WITH e AS (SELECT event_type, event_id, round(value * 100)::BIGINT AS size, ts, ts < (SELECT max(ts) FROM events) - INTERVAL {MAX_DAYS} DAY AS old FROM events),
s AS (SELECT *, sum(CASE WHEN old THEN 0 ELSE coalesce(size, 0) END) OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS total FROM e)
SELECT event_type, event_id, NOT old AND total <= {MAX_SIZE} AS kept FROM s""",
)
def eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "events").select("event_type", F.col("event_id").alias("id"), F.col("ts").alias("at"), F.round(F.col("value") * 100).cast("long").alias("size"))
    return evicted(entries, "event_type", MAX_DAYS, MAX_SIZE).select("event_type", F.col("id").alias("event_id"), "kept")


@register("i16_offsets", "SELECT l_orderkey, l_linenumber, round(coalesce(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 2) AS start FROM lineitem")
def offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").rowsBetween(Window.unboundedPreceding, -1)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.coalesce(F.sum("l_quantity").over(w), F.lit(0)), 2).cast("double").alias("start"))


@register("m4_delta_accumulation", "SELECT conv_id, turn, md5(string_agg(text, '') OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)) AS digest FROM conversations WHERE role = 'assistant'")
def accumulated(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "conversations").filter("role = 'assistant'").select("conv_id", "turn", "text")
    return running_digests(d, "conv_id", "turn", "text").select("conv_id", "turn", "digest")


@register("m9_run_status", "SELECT user_id, arg_max(CASE event_type WHEN 'signup' THEN 'running' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' END, event_id) FILTER (event_type IN ('signup', 'purchase', 'error')) AS status, max(event_id) FILTER (event_type IN ('signup', 'purchase', 'error')) AS seq FROM events WHERE event_type IN ('signup', 'purchase', 'error') GROUP BY user_id")
def run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_states(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"))
