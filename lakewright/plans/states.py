"""Queries: state transitions of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakewright.operators.ordered import running
from lakewright.plans.catalog import register
from lakewright.session import table


@register("l3_delete_by_key", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def delete_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").filter("quality = 0"), "doc_id", "left_anti")


@register("l4_cascade_delete", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING'))")
def cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "customer").filter("c_mktsegment <> 'BUILDING'")
    orders = table(spark, sf_dir, "orders").join(gone, F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    return table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select("l_orderkey", "l_linenumber")


@register("l8_append_if_absent", "SELECT event_id, user_id FROM events WHERE event_type = 'view' UNION ALL SELECT min(event_id), user_id FROM events WHERE event_type = 'click' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'view') GROUP BY user_id")
def append_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    now = e.filter("event_type = 'view'").select("event_id", "user_id")
    new = e.filter("event_type = 'click'").join(now, "user_id", "left_anti").groupBy("user_id").agg(F.min("event_id").alias("event_id"))
    return now.unionByName(new)


@register("l9_claim", "WITH c AS (SELECT event_id FROM events WHERE event_type = 'view' ORDER BY ts, event_id LIMIT 3) SELECT event_id, CASE WHEN event_id IN (SELECT event_id FROM c) THEN 'running' ELSE 'queued' END AS status, CASE WHEN event_id IN (SELECT event_id FROM c) THEN 1 ELSE 0 END AS attempts FROM events WHERE event_type = 'view'")
def claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready = table(spark, sf_dir, "events").filter("event_type = 'view'").select("event_id", "ts")
    taken = ready.orderBy("ts", "event_id").limit(3).select(F.col("event_id").alias("_id"))
    hit = F.col("_id").isNotNull()
    return ready.join(F.broadcast(taken), F.col("event_id") == F.col("_id"), "left").select("event_id", F.when(hit, "running").otherwise("queued").alias("status"), F.when(hit, 1).otherwise(0).alias("attempts"))


@register("l12_retry_backoff", "SELECT event_id, CASE WHEN a < 5 THEN 'queued' ELSE 'failed' END AS status, CASE WHEN a < 5 THEN least(120.0, 10 * pow(2.0, a - 1)) END AS wait FROM (SELECT event_id, user_id % 7 + 1 AS a FROM events WHERE event_type = 'error')")
def backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter("event_type = 'error'").select("event_id", (F.col("user_id") % 7 + 1).alias("a"))
    return e.select("event_id", F.when(F.col("a") < 5, "queued").otherwise("failed").alias("status"), F.when(F.col("a") < 5, F.least(F.lit(120.0), 10 * F.pow(F.lit(2.0), F.col("a") - 1))).alias("wait"))


@register("l15_coalesce_update", "SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 4 = 0 THEN 'X' END, o_orderstatus) AS status FROM orders")
def coalesce_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.coalesce(F.when(F.col("o_orderkey") % 4 == 0, "X"), F.col("o_orderstatus")).alias("status"))


@register("l20_snapshot_sync", "SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'insert' WHEN b.doc_id IS NULL THEN 'delete' WHEN a.n <> b.n THEN 'update' ELSE 'keep' END AS change FROM (SELECT doc_id, n_chars AS n FROM documents WHERE doc_id % 3 <> 0) a FULL OUTER JOIN (SELECT doc_id, n_chars + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS n FROM documents WHERE doc_id % 4 <> 0) b ON a.doc_id = b.doc_id")
def snapshot_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    old = d.filter("doc_id % 3 <> 0").select("doc_id", F.col("n_chars").alias("o"))
    new = d.filter("doc_id % 4 <> 0").select("doc_id", (F.col("n_chars") + F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0)).alias("n"))
    change = F.when(F.col("o").isNull(), "insert").when(F.col("n").isNull(), "delete").when(F.col("o") != F.col("n"), "update").otherwise("keep")
    return old.join(new, "doc_id", "full_outer").select("doc_id", change.alias("change"))


#: Names to be given, some of which end in a number, and the names that are taken.
WISHES = "SELECT p_partkey AS id, CASE p_type WHEN 'PROMO' THEN p_name || ' 2' WHEN 'SMALL' THEN '  ' || upper(p_name) || CASE WHEN p_size > 45 THEN ' 5' ELSE '' END ELSE replace(p_name, ' ', '  ') END AS name FROM part WHERE p_type <> 'LARGE'"
TAKEN = "SELECT DISTINCT p_name || CASE WHEN p_size < 10 THEN '' WHEN p_size < 20 THEN ' 4' ELSE ' 3' END AS name FROM part WHERE p_type = 'LARGE' AND p_name < 'l'"
_KEY = r"lower(regexp_replace(trim(name), '\s+', ' ', 'g'))"


@register(
    "l21_unique_names",
    rf"""WITH w AS (SELECT id, trim(name) AS name, {_KEY} AS key FROM ({WISHES})), t AS (SELECT {_KEY} AS key FROM ({TAKEN})),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY id) AS r FROM w),
own AS (SELECT key, 1 AS n FROM t UNION SELECT regexp_extract(key, '^(.*) [1-9][0-9]*$', 1), TRY_CAST(regexp_extract(key, ' ([1-9][0-9]*)$', 1) AS BIGINT) FROM (SELECT key FROM t UNION SELECT key FROM w) WHERE regexp_matches(key, ' [1-9][0-9]*$')),
f AS (SELECT key, n, row_number() OVER (PARTITION BY key ORDER BY n) AS r FROM (SELECT key, unnest(range(1, m + 1)) AS n FROM (SELECT key, count(*) + (SELECT count(*) FROM own WHERE own.key = w.key) AS m FROM w GROUP BY key)) ANTI JOIN own USING (key, n))
SELECT id, CASE WHEN n = 1 THEN name ELSE name || ' ' || n END AS name FROM r JOIN f USING (key, r)""",
)
def unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    ask = lambda sql: spark.sql(sql.replace("FROM part", "FROM {p}"), p=part)
    return name_apart(ask(WISHES), ask(TAKEN))


def name_apart(wishes: DataFrame, taken: DataFrame) -> DataFrame:
    """(id, name): each wish (id, name) gets its name if it is free, else the smallest number from 2 on behind it that is; by id.

    Names are compared without case and with single blanks. Free is what is neither taken nor another wish's own name, so
    no two results are alike. Numbers that are used lie in one order with the wishes, in ranges: of a wish's place among
    those of its name, and the used numbers below, its number follows; no task holds a name's rows.
    """
    key = F.lower(F.regexp_replace(F.trim("name"), r"\s+", " "))
    w = wishes.select("id", F.trim("name").alias("name"), key.alias("key"))
    w = running(w, [F.col("id")], ("key",)).select("id", "name", "key", F.col("place").alias("at"))
    number = r" ([1-9][0-9]*)$"
    all_ = taken.select(key.alias("key")).unionByName(w.select("key")).distinct().filter(F.col("key").rlike(number))
    used = all_.select(F.regexp_replace("key", number, "").alias("key"), F.regexp_extract("key", number, 1).try_cast("long").alias("n")).filter("n IS NOT NULL")
    used = used.unionByName(taken.select(key.alias("key"), F.lit(1).cast("long").alias("n"))).distinct()
    # below the k-th used number n there are n - k free ones
    used = running(used, [F.col("n")], ("key",)).select("key", (F.col("n") - F.col("place") + 1).alias("at"), F.lit(1).alias("used"))
    both = w.withColumn("used", F.lit(0)).unionByName(used, allowMissingColumns=True)
    d = running(both, [F.col("at"), F.col("used").desc(), F.col("id")], ("key",), "used").filter("used = 0")
    n = F.col("at") + F.col("total")
    return d.select("id", F.when(n == 1, F.col("name")).otherwise(F.concat("name", F.lit(" "), n.cast("string"))).alias("name"))
