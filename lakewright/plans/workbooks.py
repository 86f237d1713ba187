"""Queries: charts, fonts and audits of workbooks; Markdown tables, quoted blocks, heads of texts, context usage, fields of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakewright.functions import anchors
from lakewright.operators import search, workbooks
from lakewright.operators.front_matter import front_matter
from lakewright.plans import search as search_plans
from lakewright.plans.catalog import register
from lakewright.plans.outlines import blocks
from lakewright.session import table

#: Sheets are customers and rows their orders: column 1 priorities (none for machinery), 2 prices in several spellings, 3 states.
CELLS_SQL = """WITH o AS (SELECT o_custkey AS sheet, o_orderkey, o_orderpriority AS a, CAST(floor(o_totalprice) AS BIGINT) AS p, o_orderstatus AS s, c_mktsegment AS segment, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS row FROM orders JOIN customer ON c_custkey = o_custkey)
SELECT sheet, row, 1 AS col, CASE WHEN segment <> 'MACHINERY' THEN a END AS text FROM o
UNION ALL SELECT sheet, row, 2, CASE s WHEN 'F' THEN CAST(p // 1000 AS VARCHAR(9)) || ',' || lpad(CAST(p % 1000 AS VARCHAR(3)), 3, '0') WHEN 'P' THEN 'n/a' ELSE CAST(p AS VARCHAR(9)) || '%' END FROM o
UNION ALL SELECT sheet, row, 3, s FROM o"""
#: A series for each customer; the segment tells where its categories and its name are.
SERIES_SQL = """SELECT c_custkey AS sheet, 1 AS series, c_name AS name, CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 1 END AS name_row, CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 3 END AS name_col, 2 AS value_col, 1 AS first_row, 8 AS last_row, CASE WHEN c_mktsegment = 'BUILDING' THEN 3 END AS category_col, c_mktsegment = 'FURNITURE' AS own FROM customer"""


def _ask(spark: SparkSession, sf_dir: str, sql: str, *names: str) -> DataFrame:
    for n in names:
        sql = sql.replace(f"FROM {n}", f"FROM {{{n}}}").replace(f"JOIN {n}", f"JOIN {{{n}}}")
    return spark.sql(sql.replace("//", "DIV"), **{n: table(spark, sf_dir, n) for n in names})


_NUMBERS = "list_filter(list_transform(v, lambda x: TRY_CAST(regexp_replace(replace(x, ',', ''), '%$', '') AS DOUBLE)), lambda x: x IS NOT NULL)"


@register(
    "h7_chart_series",
    f"""WITH cells AS ({CELLS_SQL}), s AS ({SERIES_SQL}),
v AS (SELECT s.*, coalesce((SELECT list(text ORDER BY row) FROM cells c WHERE c.sheet = s.sheet AND c.col = value_col AND row BETWEEN first_row AND last_row AND text <> ''), []) AS v, coalesce((SELECT list(text ORDER BY row) FROM cells c WHERE c.sheet = s.sheet AND c.col = category_col AND row BETWEEN first_row AND last_row AND text <> ''), []) AS k,
  coalesce((SELECT list(text ORDER BY row) FROM cells c WHERE c.sheet = s.sheet AND c.col = value_col - 1 AND row BETWEEN first_row AND last_row AND text <> ''), []) AS l, (SELECT any_value(text) FROM cells c WHERE c.sheet = s.sheet AND c.row = name_row AND c.col = name_col AND text <> '') AS cell_name FROM s),
n AS (SELECT *, {_NUMBERS} AS vals FROM v),
c AS (SELECT *, CASE WHEN own THEN ['x', 'y', 'z'] WHEN len(k) > 0 THEN k WHEN len(l) > 0 THEN l ELSE list_transform(range(1, len(vals) + 1), lambda i: i::VARCHAR) END AS cats FROM n)
SELECT sheet, coalesce(cell_name, name) AS name, CASE WHEN len(vals) > 0 THEN cats[1:len(vals)] ELSE cats END AS categories, vals AS values FROM c""",
)
def chart_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = _ask(spark, sf_dir, SERIES_SQL, "customer")
    series = series.withColumn("categories", F.when(F.col("own"), F.array(*map(F.lit, "xyz"))).otherwise(F.array().cast("array<string>")))
    return workbooks.hydrate_series(series, _ask(spark, sf_dir, CELLS_SQL, "orders", "customer")).select("sheet", "name", "categories", "values")


#: Points of a line by its number of words; longer lines are plain text.
SIZES = ((1, 24.04), (2, 18.0), (3, 13.96), (4, 12.0))
PLAIN = 10.5


@register(
    "d19_font_sizes",
    f"""WITH l AS (SELECT doc_id, unnest(range(len(x))) AS i, unnest(x) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
s AS (SELECT doc_id, i, text, round(CASE len(regexp_split_to_array(trim(text), ' +')) {" ".join(f"WHEN {n} THEN {p}::DOUBLE" for n, p in SIZES)} ELSE {PLAIN}::DOUBLE END, 1) AS size FROM l WHERE trim(text) <> ''),
g AS (SELECT doc_id, size, sum(length(trim(text))) AS n, min(i) AS first FROM s GROUP BY 1, 2),
b AS (SELECT doc_id, size AS body FROM g QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) = 1),
h AS (SELECT g.doc_id, size, row_number() OVER (PARTITION BY g.doc_id ORDER BY size DESC) AS r FROM g JOIN b USING (doc_id) WHERE size > body + 1)
SELECT b.doc_id, body, max(size) FILTER (r = 1) AS h1, max(size) FILTER (r = 2) AS h2, max(size) FILTER (r = 3) AS h3 FROM b LEFT JOIN h USING (doc_id) GROUP BY b.doc_id, body""",
)
def font_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = blocks(spark, sf_dir)
    size = F.lit(PLAIN)
    for n, points in SIZES:
        size = F.when(F.col("level") == n, points).otherwise(size)
    return workbooks.font_sizes(b.select("doc_id", F.col("index").alias("at"), size.alias("size"), "text"))


#: Books are priorities, sheets their orders (hidden in state P), cells their lines: formulas where the line is open, errors by discount, tax and mode.
LINE_CELLS = "SELECT l_orderkey AS sheet, CASE WHEN l_discount = 0 AND l_tax > 0.06 THEN 'x #DIV/0! #VALUE!' WHEN l_tax = 0 AND l_discount > 0.08 THEN '#N/A' WHEN l_quantity = 1 AND l_tax > 0.05 THEN '=#REF!' WHEN l_linestatus = 'O' THEN '=B1*2' ELSE CAST(l_linenumber AS VARCHAR(9)) END AS text FROM lineitem"
_CODE = "CASE " + " ".join(f"WHEN contains(text, '{e}') THEN '{e}'" for e in workbooks.ERRORS) + " END"


@register(
    "d22_workbook_audit",
    f"""WITH c AS (SELECT *, {_CODE} AS error FROM ({LINE_CELLS})),
e AS (SELECT o_orderpriority AS book, error, count(*) AS n FROM c JOIN orders ON o_orderkey = sheet WHERE error IS NOT NULL GROUP BY 1, 2),
s AS (SELECT o_orderpriority AS book, o_orderstatus = 'P' AS hidden, o_orderkey NOT IN (SELECT sheet FROM c) AS blank, (SELECT count(*) FROM c WHERE c.sheet = o_orderkey AND starts_with(text, '=')) AS formulas FROM orders)
SELECT s.book, count(*) AS sheets, count(*) FILTER (hidden) AS hidden, count(*) FILTER (blank) AS blank, sum(formulas)::BIGINT AS formulas, (SELECT string_agg(error || '=' || n, ',' ORDER BY error) FROM e WHERE e.book = s.book) AS errors,
  CASE WHEN s.book IN (SELECT book FROM e) THEN 'errors_found' WHEN count(*) FILTER (blank) > 0 THEN 'warnings' ELSE 'ok' END AS status FROM s GROUP BY s.book""",
)
def workbook_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    sheets = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("book"), F.col("o_orderkey").alias("sheet"), (F.col("o_orderstatus") == "P").alias("hidden"))
    d = workbooks.audit(sheets, _ask(spark, sf_dir, LINE_CELLS, "lineitem"))
    entries = F.array_sort(F.transform(F.map_entries("errors"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))))
    return d.withColumn("errors", F.when(F.size("errors") > 0, F.array_join(entries, ",")))


#: Tables of names (a customer's segment, its name with a bar and blanks, or nothing), and of numbers, by nation.
TABLES_SQL = """SELECT c_nationkey, kind, id, a, b, c FROM (
 SELECT c_nationkey, 'names' AS kind, c_custkey AS id, c_mktsegment AS a, ' ' || replace(c_name, '#', ' |  ') || ' ' AS b, CASE WHEN c_acctbal > 0 THEN 'x' END AS c FROM customer
 UNION ALL SELECT c_nationkey, 'numbers', c_custkey, CAST(c_custkey AS VARCHAR(9)), CASE WHEN c_acctbal < 0 THEN '' ELSE CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR(9)) || '%' END, NULL FROM customer)"""
_CELL = r"replace(trim(regexp_replace(coalesce({}, ''), '\s+', ' ', 'g')), '|', '\|')"


@register(
    "e27_markdown_tables",
    f"""WITH r AS (SELECT c_nationkey, kind, id, {_CELL.format("a")} AS a, {_CELL.format("b")} AS b, {_CELL.format("c")} AS c FROM ({TABLES_SQL})),
t AS (SELECT c_nationkey, kind, list(a || ' | ' || b || CASE WHEN kind = 'names' THEN ' | ' || c ELSE '' END ORDER BY id) AS l FROM r GROUP BY 1, 2)
SELECT c_nationkey, kind, md5('| ' || CASE kind WHEN 'names' THEN l[1] || ' |' || chr(10) || '| --- | --- | --- |' ELSE 'Column A | Column B |' || chr(10) || '| --- | --- |' END || chr(10) || array_to_string(list_transform(CASE kind WHEN 'names' THEN l[2:] ELSE l END, lambda x: '| ' || x || ' |'), chr(10))) AS digest FROM t""",
)
def markdown_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _ask(spark, sf_dir, TABLES_SQL, "customer")
    row = F.when(F.col("kind") == "names", F.array("a", "b", "c")).otherwise(F.array("a", "b"))
    rows = d.groupBy("c_nationkey", "kind").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", row.alias("row")))), lambda x: x["row"]).alias("rows"))
    return rows.select("c_nationkey", "kind", F.md5(anchors.markdown_table(F.col("rows"))).alias("digest"))


#: Messages with quoted files (with and without a path), quoted messages, or both, before their text.
QUOTES_SQL = """SELECT conv_id, turn, role, text, CASE WHEN turn % 3 = 0 THEN '<quoted_file path="a &amp; b/' || CAST(conv_id AS VARCHAR(9)) || '.pdf" page="' || CAST(turn AS VARCHAR(9)) || '" semantic_unit_id="u&lt;' || role || '&gt;">' || left(text, 20) || '</quoted_file>' || chr(10) || chr(10) ELSE '' END
 || CASE WHEN turn % 4 = 1 THEN '<quoted_file page="1">none</quoted_file>' ELSE '' END || CASE WHEN role = 'user' THEN '<quoted_message role="' || CASE WHEN turn > 2 THEN 'user' ELSE 'other' END || '">' || left(text, 9) || '</quoted_message>' || chr(10) ELSE '' END || text AS content FROM conversations"""


@register(
    "e33_quoted_blocks",
    f"""SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'file:a & b/' || conv_id || '.pdf:' || conv_id || '.pdf:' || turn || ':u<' || role || '>' ELSE '' END || CASE WHEN role = 'user' THEN CASE WHEN turn % 3 = 0 THEN ';' ELSE '' END || 'message:' || CASE WHEN turn > 2 THEN 'user' ELSE 'assistant' END ELSE '' END AS anchors,
  md5(regexp_replace(text, '^[\\s\\x{{A0}}\\x{{FEFF}}]+|[\\s\\x{{A0}}\\x{{FEFF}}]+$', '', 'g')) AS digest FROM conversations""",
)
def quoted_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _ask(spark, sf_dir, QUOTES_SQL, "conversations")
    said = F.transform(anchors.quoted_anchors(F.col("content")), lambda a: F.when(a["kind"] == "file", F.concat_ws(":", a["kind"], a["path"], a["name"], a["page"].cast("string"), a["unit"])).otherwise(F.concat_ws(":", a["kind"], a["role"])))
    return d.select("conv_id", "turn", F.array_join(said, ";").alias("anchors"), F.md5(anchors.without_anchors(F.col("content"))).alias("digest"))


#: Heads of texts: the type of a part tells how its description and its lists are written.
HEADS_SQL = """SELECT p_partkey, '---' || chr(10) || 'name: ' || CASE WHEN p_size > 25 THEN '"' || p_name || '"' ELSE p_name END || chr(10) || 'no entry' || chr(10)
 || CASE WHEN p_type < 'M' THEN 'description: |' || chr(10) || '  ' || p_brand || chr(10) || '    ' || p_type || chr(10) ELSE 'description: >-' || chr(10) || '  ' || p_brand || chr(10) || '  ' || p_type || chr(10) END
 || CASE p_type WHEN 'ECONOMY' THEN 'tags: [' || p_brand || ', ''' || p_name || ''', ]' WHEN 'LARGE' THEN 'tags:' || chr(10) || '  - ' || p_brand || chr(10) || '- "' || p_name || '"' WHEN 'MEDIUM' THEN 'tags: ' || p_brand || ', ' || p_name WHEN 'PROMO' THEN 'tags: ' || p_name ELSE 'tags:' END || chr(10)
 || CASE WHEN p_size % 2 = 0 THEN 'allowed-tools' ELSE 'allowed_tools' END || ': ' || p_type || chr(10) || 'version: 1.' || CAST(p_size AS VARCHAR(9)) || chr(10) || '---' || chr(10) || chr(10) || 'Body of ' || p_name AS text FROM part"""


@register(
    "e40_front_matter",
    """SELECT p_partkey, p_name AS name, p_brand || CASE WHEN p_type < 'M' THEN chr(10) || '  ' ELSE ' ' END || p_type AS description, '1.' || p_size AS version, CASE WHEN p_type = 'PROMO' THEN [p_name] WHEN p_type IN ('ECONOMY', 'LARGE', 'MEDIUM') THEN [p_brand, p_name] END AS tags, [p_type] AS tools, 'Body of ' || p_name AS body FROM part""",
)
def heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = front_matter(_ask(spark, sf_dir, HEADS_SQL, "part"), "p_partkey", "text")
    return d.select("p_partkey", "name", "description", "version", "tags", F.col("allowedTools").alias("tools"), "body")


#: Records that a hit rate is taken over.
LAST = 50


@register(
    "i13_context_usage",
    f"""WITH e AS (SELECT *, CAST(props->>'$.k' AS BIGINT) AS k FROM events),
s AS (SELECT user_id, arg_max(value, event_id) AS tokens, arg_max(k * 10, event_id) AS context FROM e WHERE event_type = 'signup' GROUP BY user_id),
u AS (SELECT user_id, value, k, event_type FROM e WHERE event_type IN ('click', 'purchase') AND value > 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= {LAST}),
r AS (SELECT user_id, count(*) AS sample, sum(CASE WHEN event_type = 'click' THEN value * k / 100 ELSE 0 END) AS hits, sum(value) AS input FROM u GROUP BY user_id)
SELECT user_id, round(tokens, 4) AS tokens, context, sample, round(hits / input, 6) AS hit_rate FROM s LEFT JOIN r USING (user_id) WHERE tokens > 0 OR context > 0""",
)
def context_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's last snapshot with the hit rate of the last usable records; without tokens and a window there is none."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    s = e.filter("event_type = 'signup'").groupBy("user_id").agg(F.max_by("value", "event_id").alias("tokens"), F.max_by(F.col("k") * 10, "event_id").alias("context"))
    u = e.filter("event_type IN ('click', 'purchase') AND value > 0").withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("event_id").desc()))).filter(F.col("n") <= LAST)
    hit = F.when(F.col("event_type") == "click", F.col("value") * F.col("k") / 100).otherwise(0.0)
    r = u.groupBy("user_id").agg(F.count("*").alias("sample"), F.sum(hit).alias("hits"), F.sum("value").alias("input"))
    d = s.join(r, "user_id", "left").filter("tokens > 0 OR context > 0")
    return d.select("user_id", F.round("tokens", 4).alias("tokens"), "context", "sample", F.round(F.col("hits") / F.col("input"), 6).alias("hit_rate"))


_FIELDS = "r.id, lang AS course_id, r.file AS file_id, r.file_name, r.file_path, NULL::VARCHAR AS section_id, NULL::VARCHAR AS task_file_bucket, NULL::BIGINT AS chunk_index, NULL::BIGINT AS chunk_count, md5(r.text) AS text, r.title, r.citation, r.source_path, r.source_label, r.section_title"


@register("b9_result_fields", f"WITH {search_plans.ROWS_SQL}, {search_plans._near_sql(3)} SELECT q, {_FIELDS}, round(distance, 6) AS distance FROM near JOIN r USING (id) JOIN documents ON doc_id = r.id")
def result_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the nearest rows the fields that every result has (null where the table lacks one), those further ones that the table has, and the distance."""
    lang = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("course_id"))
    rows = search_plans.rows(spark, sf_dir).join(lang, "id").withColumnRenamed("file", "file_id")
    near = search.nearest(table(spark, sf_dir, "embeddings"), search_plans._probes(spark, sf_dir), 3)
    hits = near.select("q", F.col("key").alias("id"), "distance").join(rows, "id")
    return search.result_fields(hits, "q").withColumn("text", F.md5("text")).withColumn("distance", F.round("distance", 6))
