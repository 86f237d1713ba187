"""Scans, predicates, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakewright.plans.catalog import register
from lakewright.session import table


def _t(name: str):
    return lambda spark, sf_dir: table(spark, sf_dir, name)


@register("a1_sorted_scan", "SELECT n_nationkey, n_name, n_regionkey FROM nation ORDER BY n_regionkey DESC, n_name")
def sorted_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").orderBy(F.col("n_regionkey").desc(), "n_name")


@register("a2_point_lookup", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders)")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.filter(F.col("o_orderkey") == o.agg(F.min("o_orderkey")).first()[0]).select("o_orderkey", "o_custkey", "o_totalprice")


#: File kinds by extension.
KINDS = {
    "pdf": ("pdf",),
    "docx": ("docx", "doc"),
    "pptx": ("pptx", "ppt"),
    "spreadsheet": ("xlsx", "xls", "csv", "tsv"),
    "image": ("png", "jpg", "jpeg", "gif", "webp", "bmp", "svg"),
    "markdown": ("md", "markdown"),
    "code": ("ts", "tsx", "js", "jsx", "py", "java", "cpp", "c", "h", "css", "html", "json"),
    "text": ("txt", "rtf"),
}


@register("a4_file_kind", "SELECT page_id, CASE " + " ".join(f"WHEN ext IN ({', '.join(repr(e) for e in es)}) THEN '{k}'" for k, es in KINDS.items()) + r" ELSE 'unknown' END AS kind FROM (SELECT page_id, lower(regexp_extract(url, '\.([A-Za-z0-9]+)$', 1)) AS ext FROM pages)")
def file_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext, kind = F.lower(F.regexp_extract("url", r"\.([A-Za-z0-9]+)$", 1)), F.lit("unknown")
    for k, es in KINDS.items():
        kind = F.when(ext.isin(*es), k).otherwise(kind)
    return table(spark, sf_dir, "pages").select("page_id", kind.alias("kind"))


@register("a17_ranged_read", "SELECT doc_id, substring(text, 1001, 500) AS part, least(1500, length(text))::BIGINT AS next_offset, length(text) > 1500 AS truncated FROM documents")
def ranged_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1001, 500).alias("part"), F.least(F.lit(1500), F.length("text")).cast("long").alias("next_offset"), (F.length("text") > 1500).alias("truncated"))


@register("b1_optional_filters", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 100000")
def optional_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = {"o_orderstatus": ("=", "F"), "o_totalprice": (">=", 100000), "o_orderpriority": ("=", None)}
    o = table(spark, sf_dir, "orders")
    for name, (op, value) in asked.items():
        if value is not None:
            o = o.filter(F.col(name) == value if op == "=" else F.col(name) >= value)
    return o.select("o_orderkey")


@register("b2_scope", "SELECT event_id FROM events WHERE (user_id = 7 OR user_id IS NULL) AND event_type IN ('view', 'click')")
def scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").filter(((F.col("user_id") == 7) | F.col("user_id").isNull()) & F.col("event_type").isin("view", "click")).select("event_id")


@register("b6_exclusion", "SELECT event_type, count(*) AS n FROM events WHERE event_type IS NULL OR event_type NOT IN ('error', 'signup') GROUP BY event_type")
def exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").filter(F.col("event_type").isNull() | ~F.col("event_type").isin("error", "signup")).groupBy("event_type").agg(F.count("*").alias("n"))


@register("b10_eligibility", "SELECT d.doc_id, coalesce(l.quality = 1, d.n_chars > 2000) AS eligible FROM documents d LEFT JOIN labels l USING (doc_id)")
def eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left").select("doc_id", F.coalesce(F.col("quality") == 1, F.col("n_chars") > 2000).alias("eligible"))


@register("b12_interval_overlap", "SELECT o_orderkey FROM orders WHERE o_orderdate::DATE <= DATE '1996-03-31' AND o_orderdate::DATE + 14 >= DATE '1996-03-01'")
def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    return table(spark, sf_dir, "orders").filter((day <= F.lit("1996-03-31").cast("date")) & (F.date_add(day, 14) >= F.lit("1996-03-01").cast("date"))).select("o_orderkey")


@register("b13_status_default", "SELECT CASE WHEN event_type IN ('view', 'click', 'purchase') THEN event_type ELSE 'pending' END AS status, count(*) AS n FROM events GROUP BY ALL")
def status_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_type").isin("view", "click", "purchase"), F.col("event_type")).otherwise("pending")
    return table(spark, sf_dir, "events").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@register("b16_user_inputs", "SELECT conv_id, turn FROM conversations WHERE role = 'user' AND trim(text) <> ''")
def user_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").filter((F.col("role") == "user") & (F.trim("text") != "")).select("conv_id", "turn")


@register("b18_visible", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0 AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 0))")
def visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").filter("n_regionkey <> 0")
    customers = table(spark, sf_dir, "customer").filter("c_acctbal >= 0").join(nations, F.col("c_nationkey") == F.col("n_nationkey"), "left_semi")
    return table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'").join(customers, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")


@register("j1_nulls_lowest", "SELECT c_custkey, c_mktsegment FROM customer ORDER BY c_mktsegment DESC NULLS LAST, c_custkey")
def nulls_lowest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").orderBy(F.col("c_mktsegment").desc_nulls_last(), "c_custkey").select("c_custkey", "c_mktsegment")


@register("j5_natural_sort", r"SELECT p_partkey, p_name FROM part ORDER BY TRY_CAST(regexp_extract(p_name, '([0-9]+)', 1) AS BIGINT) NULLS LAST, lower(p_name), p_partkey")
def natural_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").orderBy(F.regexp_extract("p_name", "([0-9]+)", 1).try_cast("long").asc_nulls_last(), F.lower("p_name"), "p_partkey").select("p_partkey", "p_name")


@register("j7_page_with_total", "SELECT event_id, (SELECT count(*) FROM events WHERE event_type = 'error') AS total, (SELECT count(*) FROM events WHERE event_type = 'error') > 20 AS truncated FROM events WHERE event_type = 'error' ORDER BY event_id LIMIT 20")
def page_with_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "events").filter("event_type = 'error'").select("event_id")
    total = hits.agg(F.count("*").alias("total"))
    return hits.orderBy("event_id").limit(20).join(F.broadcast(total)).withColumn("truncated", F.col("total") > 20)


@register("j9_coalesced_order", "SELECT o_orderkey FROM orders ORDER BY coalesce(CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderdate END, TIMESTAMP '1995-01-01') DESC, o_orderkey")
def coalesced_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.coalesce(F.when(F.col("o_orderstatus") != "F", F.col("o_orderdate")), F.lit("1995-01-01").cast("timestamp_ntz"))
    return table(spark, sf_dir, "orders").orderBy(at.desc(), "o_orderkey").select("o_orderkey")


@register("k1_union_tree", "SELECT 'r' || r_regionkey AS id, r_name AS name, NULL AS parent FROM region UNION ALL SELECT 'n' || n_nationkey, n_name, 'r' || n_regionkey FROM nation")
def union_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.col("r_name").alias("name"), F.lit(None).cast("string").alias("parent"))
    nations = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.col("n_name").alias("name"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))
    return regions.unionByName(nations)


@register("k2_difference", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey").distinct().join(table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@register("k3_distinct_union", "SELECT c_nationkey AS key FROM customer UNION SELECT s_nationkey FROM supplier")
def distinct_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("key")).union(table(spark, sf_dir, "supplier").select("s_nationkey")).distinct()
