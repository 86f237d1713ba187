"""Queries: web sources and proposals of a workspace. Events name pages by their property k; the event's kind tells how the address is written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakewright.functions.text import canonical_url
from lakewright.plans.catalog import register
from lakewright.plans.documents import URL_SQL
from lakewright.session import table

LINKS_SQL = f"""links AS (SELECT event_id, event_type, scope, {URL_SQL} AS key FROM (SELECT event_id, event_type, scope, regexp_replace(url, '#.*$', '') AS b FROM (
  SELECT event_id, event_type, CASE WHEN value > 50 THEN 'task' ELSE 'course' END AS scope,
    CASE event_type WHEN 'click' THEN url || '#part' WHEN 'signup' THEN regexp_extract(url, '^https?://') || upper(regexp_extract(url, '^https?://([^/?#]*)', 1)) || regexp_extract(url, '^https?://[^/?#]*(.*)$', 1)
      WHEN 'error' THEN regexp_extract(url, '^https?://[^/?#]*') || CASE WHEN starts_with(url, 'https') THEN ':443' ELSE ':80' END || regexp_extract(url, '^https?://[^/?#]*(.*)$', 1) ELSE url END AS url
  FROM events JOIN pages ON page_id = CAST(props->>'$.k' AS BIGINT))))"""


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, event_type, scope, key): addresses in several spellings, by their canonical form."""
    e = table(spark, sf_dir, "events").withColumn("page_id", F.get_json_object("props", "$.k").cast("long"))
    d = e.join(table(spark, sf_dir, "pages").select("page_id", "url"), "page_id")
    head, host, rest = F.regexp_extract("url", "^https?://", 0), F.regexp_extract("url", "^https?://([^/?#]*)", 1), F.regexp_extract("url", "^https?://[^/?#]*(.*)$", 1)
    port = F.when(F.startswith("url", F.lit("https")), ":443").otherwise(":80")
    kind = F.col("event_type")
    url = F.when(kind == "click", F.concat("url", F.lit("#part"))).when(kind == "signup", F.concat(head, F.upper(host), rest)).when(kind == "error", F.concat(head, host, port, rest)).otherwise(F.col("url"))
    return d.select("event_id", "event_type", F.when(F.col("value") > 50, "task").otherwise("course").alias("scope"), canonical_url(url).alias("key"))


@register("c26_same_source", f"WITH {LINKS_SQL}, s AS (SELECT scope, key, min(event_id) AS first_source FROM links WHERE event_type <> 'error' GROUP BY scope, key) SELECT event_id, first_source FROM links LEFT JOIN s USING (scope, key)")
def same_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first source of the same canonical address and scope that has not failed. Keys are summed up before they meet."""
    d = links(spark, sf_dir)
    first = d.filter("event_type <> 'error'").groupBy("scope", "key").agg(F.min("event_id").alias("first_source"))
    return d.join(first, ["scope", "key"], "left").select("event_id", "first_source")


@register(
    "l16_proposals",
    f"""WITH {LINKS_SQL},
k AS (SELECT *, CASE event_type WHEN 'purchase' THEN 'accepted' WHEN 'error' THEN 'failed' ELSE 'pending' END AS says FROM links),
s AS (SELECT *, coalesce(sum((says = 'accepted')::INT) OVER (PARTITION BY scope, key ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM k),
f AS (SELECT *, min(event_id) FILTER (says = 'pending') OVER (PARTITION BY scope, key, part) AS id FROM s)
SELECT scope, key, id, count(*) FILTER (says = 'pending') AS proposals, arg_max(says, event_id) AS status FROM f WHERE event_id >= id GROUP BY scope, key, id""",
)
def proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One candidate for each address in a scope: made again it is pending again, also after a failure; an accepted one is left alone, and the next proposal makes another."""
    says = F.when(F.col("event_type") == "purchase", "accepted").when(F.col("event_type") == "error", "failed").otherwise("pending")
    w = Window.partitionBy("scope", "key").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    d = links(spark, sf_dir).withColumn("says", says)
    d = d.withColumn("part", F.coalesce(F.sum((F.col("says") == "accepted").cast("int")).over(w), F.lit(0)))
    d = d.withColumn("id", F.min(F.when(F.col("says") == "pending", F.col("event_id"))).over(Window.partitionBy("scope", "key", "part"))).filter("event_id >= id")
    return d.groupBy("scope", "key", "id").agg(F.count_if(F.col("says") == "pending").alias("proposals"), F.max_by("says", "event_id").alias("status"))
