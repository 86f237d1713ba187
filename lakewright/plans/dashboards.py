"""Queries: figures of courses and of a whole semester, merged cells, JSON inside talk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewright.plans.catalog import register
from lakewright.session import table


@register("c24_merged_cell", "SELECT sheet, r, c, min(p_partkey) AS merge FROM (SELECT DISTINCT l_suppkey AS sheet, l_orderkey % 60 AS r, l_linenumber AS c FROM lineitem) JOIN (SELECT p_partkey, p_partkey % 100 AS s, p_partkey % 50 AS r0, p_partkey % 50 + p_partkey % 5 AS r1, p_partkey % 4 AS c0, p_partkey % 4 + 2 AS c1 FROM part) ON s = sheet AND r BETWEEN r0 AND r1 AND c BETWEEN c0 AND c1 GROUP BY sheet, r, c")
def merged_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first merged range that a cell lies in. A range gives a row for each row it spans, so that the join is on equal keys."""
    cells = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("sheet"), (F.col("l_orderkey") % 60).alias("r"), F.col("l_linenumber").alias("c")).distinct()
    key = F.col("p_partkey")
    merges = table(spark, sf_dir, "part").select(key.alias("merge"), (key % 100).alias("sheet"), F.explode(F.sequence(key % 50, key % 50 + key % 5)).alias("r"), (key % 4).alias("c0"), (key % 4 + 2).alias("c1"))
    return cells.join(merges, ["sheet", "r"]).filter(F.col("c").between(F.col("c0"), F.col("c1"))).groupBy("sheet", "r", "c").agg(F.min("merge").alias("merge"))


@register("d11_course_figures", "WITH f AS (SELECT doc_id % 9 AS course, count(*) AS files, count(*) FILTER (doc_id % 5 = 3) AS lectures, count(*) FILTER (doc_id % 6 = 0) AS drafts, count(*) FILTER (doc_id % 30 <= 7) AS touched FROM documents GROUP BY ALL), t AS (SELECT user_id % 11 AS course, count(*) AS threads, count(*) FILTER (event_type <> 'signup') AS with_messages FROM events WHERE event_type <> 'error' GROUP BY ALL) SELECT course, coalesce(files, 0) AS files, coalesce(lectures, 0) AS lectures, coalesce(drafts, 0) AS drafts, coalesce(touched, 0) AS touched, coalesce(threads, 0) AS threads, coalesce(with_messages, 0) AS with_messages FROM f FULL JOIN t USING (course)")
def course_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and threads of each course; both sides are summed up before they meet. Archived threads don't count."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    files = d.groupBy((F.col("doc_id") % 9).alias("course")).agg(F.count("*").alias("files"), F.count_if(F.col("doc_id") % 5 == 3).alias("lectures"), F.count_if(F.col("doc_id") % 6 == 0).alias("drafts"), F.count_if(F.col("doc_id") % 30 <= 7).alias("touched"))
    e = table(spark, sf_dir, "events").filter("event_type <> 'error'")
    threads = e.groupBy((F.col("user_id") % 11).alias("course")).agg(F.count("*").alias("threads"), F.count_if(F.col("event_type") != "signup").alias("with_messages"))
    return files.join(threads, "course", "full").na.fill(0, ["files", "lectures", "drafts", "touched", "threads", "with_messages"])


@register("d12_semester_figures", "WITH c AS (SELECT n_nationkey AS course FROM nation WHERE n_nationkey <> 0 AND n_regionkey <> 4), t AS (SELECT o_custkey % 30 AS course, max(o_orderdate) AS last FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 30 % 3 > 0 GROUP BY ALL), f AS (SELECT doc_id % 20 AS course, count(*) AS files FROM documents GROUP BY ALL) SELECT count(*) AS courses, count(*) FILTER (last IS NULL OR last < TIMESTAMP '2001-07-15') AS quiet, count(*) FILTER (files IS NULL) AS empty, sum(coalesce(files, 0))::BIGINT AS files FROM c LEFT JOIN t USING (course) LEFT JOIN f USING (course)")
def semester_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible courses, those without activity in the last days, those without files."""
    courses = table(spark, sf_dir, "nation").filter("n_nationkey <> 0 AND n_regionkey <> 4").select(F.col("n_nationkey").cast("long").alias("course"))
    last = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F' AND o_custkey % 30 % 3 > 0").groupBy((F.col("o_custkey") % 30).alias("course")).agg(F.max("o_orderdate").alias("last"))
    files = table(spark, sf_dir, "documents").groupBy((F.col("doc_id") % 20).alias("course")).agg(F.count("*").alias("n"))
    quiet = F.col("last").isNull() | (F.col("last") < F.lit("2001-07-15").cast("timestamp_ntz"))
    cards = courses.join(last, "course", "left").join(files, "course", "left")
    return cards.agg(F.count("*").alias("courses"), F.count_if(quiet).alias("quiet"), F.count_if(F.col("n").isNull()).alias("empty"), F.coalesce(F.sum("n"), F.lit(0)).alias("files"))


#: Answers with JSON in them (the same text for Spark and DuckDB).
_TALK = "SELECT event_id, CASE CAST(event_id % 5 AS INT) WHEN 0 THEN '```json' || chr(10) || props || chr(10) || '``` ' WHEN 1 THEN 'Here it is: ' || props || ' as asked.' WHEN 2 THEN props WHEN 3 THEN '```' || chr(10) || 'well, ' || props || '```' ELSE 'none { here' END AS talk FROM events"


@register("e38_json_in_talk", f"SELECT event_id, coalesce(TRY_CAST(bare AS JSON), TRY_CAST(regexp_extract(bare, '(?s)\\{{.*\\}}') AS JSON))->>'k' AS k FROM (SELECT event_id, regexp_replace(regexp_replace(trim(talk), '(?i)^```(?:json)?\\s*', ''), '\\s*```$', '') AS bare FROM ({_TALK}))")
def json_in_talk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text without its fence as JSON; else what stands from the first to the last brace; else null."""
    talk = spark.sql(_TALK.replace("{", "{{").replace("FROM events", "FROM {e}"), e=table(spark, sf_dir, "events").select("event_id", "props"))
    bare = F.regexp_replace(F.regexp_replace(F.trim("talk"), r"(?i)^```(?:json)?\s*", ""), r"\s*```$", "")
    found = talk.select("event_id", bare.alias("bare"))
    braces = F.regexp_extract("bare", r"(?s)\{.*\}", 0)
    return found.select("event_id", F.coalesce(F.get_json_object("bare", "$.k"), F.get_json_object(braces, "$.k")).alias("k"))
