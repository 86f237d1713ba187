"""Queries: sections, tasks, files, errors, proposals and ids of a workspace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakewright.functions.sheets import once
from lakewright.functions.text import SPACE, collapsed
from lakewright.operators.ordered import running
from lakewright.plans.catalog import register
from lakewright.session import table

#: Files of a workspace, made from the documents table: section id, path and chunk number (the same text for Spark and DuckDB).
FILES = """SELECT doc_id, source, text,
 'c' || CAST(doc_id % 9 AS VARCHAR(4)) || CASE CAST(doc_id % 5 AS INT) WHEN 0 THEN ':task-' || CAST(doc_id % 40 AS VARCHAR(8)) WHEN 1 THEN ':shared' WHEN 2 THEN ':task-task-task-' || CAST(doc_id % 40 AS VARCHAR(8)) WHEN 3 THEN ':lecture' ELSE ':all' END AS section_id,
 CASE CAST(doc_id % 7 AS INT) WHEN 0 THEN '/Task/task-' || CAST(doc_id % 40 AS VARCHAR(8)) || '/notes.md' WHEN 1 THEN '/Course shared/plan.pdf' WHEN 2 THEN '/Semester shared/plan.pdf' WHEN 3 THEN '/Lecture/Week ' || CAST(doc_id % 14 AS VARCHAR(8)) || '/slides.pptx' WHEN 4 THEN '/Lecture/wk' || CAST(doc_id % 14 AS VARCHAR(8)) || ' notes.md' WHEN 5 THEN '/第 ' || CAST(doc_id % 14 AS VARCHAR(8)) || ' 周/a.docx' ELSE '/inbox/x.txt' END AS path
 FROM documents"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(FILES.replace("FROM documents", "FROM {d}"), d=table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def section_kind(section: Column, path: Column) -> Column:
    return (
        F.when(section.contains(":lecture") | path.contains("/Lecture/"), "lecture")
        .when(section.contains(":task-") | path.contains("/Task/"), "task")
        .when(section.contains(":shared") | path.contains("/Course shared/") | path.contains("/Semester shared/"), "course_shared")
    )


def task_id(section: Column, path: Column) -> Column:
    """From the section's id, with a doubled prefix taken off once; else from the path."""
    own = F.regexp_replace(F.regexp_extract(section, ":task-(.+)$", 1), "^task-task-", "task-")
    return F.when(own != "", own).otherwise(F.nullif(F.regexp_extract(path, "/Task/(task-[^/]+)", 1), F.lit("")))


#: A whole part of a path that names a week.
WEEK_PART = r"(?i)(?:^|/)(?:week|wk|第)\s*([0-9]{1,2})\s*周?(?:/|$)"


def lecture_week(path: Column) -> Column:
    """From the first part of the path that is nothing but a week's name; weeks count from 1."""
    return F.nullif(F.regexp_extract(F.replace(path, F.lit("\\"), F.lit("/")), WEEK_PART, 1).try_cast("int"), F.lit(0))


KIND_SQL = "CASE WHEN strpos(section_id, ':lecture') > 0 OR strpos(path, '/Lecture/') > 0 THEN 'lecture' WHEN strpos(section_id, ':task-') > 0 OR strpos(path, '/Task/') > 0 THEN 'task' WHEN strpos(section_id, ':shared') > 0 OR strpos(path, '/Course shared/') > 0 OR strpos(path, '/Semester shared/') > 0 THEN 'course_shared' END"
TASK_SQL = "CASE WHEN regexp_extract(section_id, ':task-(.+)$', 1) <> '' THEN regexp_replace(regexp_extract(section_id, ':task-(.+)$', 1), '^task-task-', 'task-') ELSE nullif(regexp_extract(path, '/Task/(task-[^/]+)', 1), '') END"
WEEK_SQL = rf"nullif(TRY_CAST(regexp_extract(replace(path, '\', '/'), '{WEEK_PART}', 1) AS INT), 0)"


@register("b3_soft_deleted", "SELECT o_orderkey, o_orderstatus = 'F' AS archived FROM orders WHERE CASE WHEN o_orderstatus = 'F' THEN o_orderdate END IS NULL UNION ALL SELECT o_orderkey, true FROM orders WHERE o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '1998-01-01'")
def soft_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that aren't archived, and those archived lately."""
    o = table(spark, sf_dir, "orders").withColumn("archived_at", F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")))
    late = F.col("archived_at") >= F.lit("1998-01-01").cast("timestamp_ntz")
    return o.filter(F.col("archived_at").isNull() | late).select("o_orderkey", F.col("archived_at").isNotNull().alias("archived"))


@register("b4_section_filter", f"SELECT doc_id FROM ({FILES}) WHERE section_id = 'c3:lecture' OR starts_with(path, '/Lecture/')")
def section_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).filter((F.col("section_id") == "c3:lecture") | F.col("path").startswith("/Lecture/")).select("doc_id")


@register("b5_task_filter", f"SELECT doc_id FROM ({FILES}) WHERE section_id = 'c2:task-20' OR strpos(path, 'task-20') > 0")
def task_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).filter((F.col("section_id") == "c2:task-20") | F.col("path").contains("task-20")).select("doc_id")


@register("b7_section_kind", f"SELECT doc_id, {KIND_SQL} AS kind FROM ({FILES})")
def kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("doc_id", section_kind(F.col("section_id"), F.col("path")).alias("kind"))


@register("b8_task_id", f"SELECT doc_id, {TASK_SQL} AS task FROM ({FILES})")
def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("doc_id", task_id(F.col("section_id"), F.col("path")).alias("task"))


#: Names of files and folders that a workspace's own tools keep.
CONTROL_FILE, CONTROL_FOLDERS = "Plan.PDF", ("inbox", ".state", ".context")


@register("b11_control_files", f"SELECT doc_id FROM ({FILES}) WHERE NOT (lower(parse_filename(path)) = lower('{CONTROL_FILE}') OR lower(parse_filename(source)) = lower('{CONTROL_FILE}') OR list_has_any(string_split(replace(path, chr(92), '/'), '/'), {list(CONTROL_FOLDERS)}))")
def control_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without files of that name, whatever its case, and without those below such a folder."""
    name = lambda c: F.lower(F.element_at(F.split(c, "/"), -1)) == CONTROL_FILE.lower()
    below = F.arrays_overlap(F.split(F.replace(F.col("path"), F.lit("\\"), F.lit("/")), "/"), F.array(*map(F.lit, CONTROL_FOLDERS)))
    return files(spark, sf_dir).filter(~(name("path") | name("source") | below)).select("doc_id")


#: Parts of messages that forbid and that allow another try.
DENY = ("no embedding provider", "no api key", "api key is available", "embedding model is required", "invalid model", "model_not_found", "not found model", "unauthorized", "forbidden", "401", "403", "invalidparameter", "invalid parameter", "invalid_request", "unsupported", "legacy .doc", "legacy .ppt", "larger than")
ALLOW = ("429", "408", "500", "502", "503", "504", "timeout", "timed out", "econnreset", "econnrefused", "enotfound", "network", "rate limit", "temporar", "overloaded", "try again", "terminated")
MESSAGES = """SELECT event_id, user_id, ts, event_type, CASE CAST(event_id % 8 AS INT) WHEN 0 THEN 'HTTP 429 Too Many Requests' WHEN 1 THEN 'Error: 403 Forbidden, try again' WHEN 2 THEN 'socket ECONNRESET' WHEN 3 THEN 'Unsupported file' WHEN 4 THEN ' ' WHEN 5 THEN 'Request timed out  after 45 s' WHEN 6 THEN 'odd failure' ELSE 'Error: upstream 50' || CAST(user_id % 6 AS VARCHAR(2)) END AS message FROM events"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(MESSAGES.replace("FROM events", "FROM {e}"), e=table(spark, sf_dir, "events"))


def retryable(message: Column) -> Column:
    low = F.lower(message)
    some = lambda parts: F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains(low, p))
    return (F.trim(low) != "") & ~some(DENY) & some(ALLOW)


def _some_sql(parts) -> str:
    return "(" + " OR ".join(f"strpos(lower(message), '{p}') > 0" for p in parts) + ")"


RETRY_SQL = f"(trim(message) <> '' AND NOT {_some_sql(DENY)} AND {_some_sql(ALLOW)})"


@register("b14_retryable", f"SELECT event_id, {RETRY_SQL} AS retry FROM ({MESSAGES})")
def retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).select("event_id", retryable(F.col("message")).alias("retry"))


#: What is taken off a message's start, each once, in this order.
ERROR_HEADS = ("Error invoking remote method '[^']+':", "Error:", "API Error:", "Provider error:", "Agent error:")
#: Turns of conversations as messages, with such heads before them in several orders and cases.
REPORTS = """SELECT conv_id, turn, CASE CAST(turn % 7 AS INT) WHEN 0 THEN 'Error: Error: ' WHEN 1 THEN 'error invoking remote method ''save'': API ERROR:  ' WHEN 2 THEN 'Error: api error: Provider error:' WHEN 3 THEN 'Agent Error: Error: ' WHEN 4 THEN ' Error: ' WHEN 5 THEN 'PROVIDER ERROR: agent error:' ELSE '' END || text AS message FROM conversations"""
_BARE = "message"
for _head in ERROR_HEADS:
    _BARE = f"regexp_replace({_BARE}, '(?i)^{_head.replace(chr(39), chr(39) * 2)}{SPACE}*', '')"


@register("e39_clean_error", f"SELECT conv_id, turn, md5(trim(regexp_replace({_BARE}, '{SPACE}+', ' ', 'g'))) AS digest, left(trim(regexp_replace({_BARE}, '{SPACE}+', ' ', 'g')), 20) AS head FROM ({REPORTS})")
def clean_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.sql(REPORTS.replace("FROM conversations", "FROM {c}"), c=table(spark, sf_dir, "conversations"))
    message = F.col("message")
    for head in ERROR_HEADS:
        message = F.regexp_replace(message, f"(?i)^{head}{SPACE}*", "")
    message = collapsed(message)
    return d.select("conv_id", "turn", F.md5(message).alias("digest"), F.left(message, F.lit(20)).alias("head"))


@register(
    "b15_file_status",
    """WITH l AS (SELECT user_id, max_by(event_type, event_id) AS task, max_by(CAST(props->>'$.k' AS INT), event_id) AS k, max_by(value, event_id) AS value FROM events GROUP BY user_id)
SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'idle' WHEN task = 'view' THEN 'queued' WHEN task = 'click' THEN 'indexing' WHEN task = 'error' THEN 'failed' WHEN task = 'signup' THEN 'cancelled'
  WHEN task = 'purchase' THEN CASE WHEN k // 30 = 0 AND value > 30 THEN 'skipped' WHEN k >= 60 THEN 'partial' ELSE 'indexed' END WHEN c_acctbal > 5000 THEN 'indexed' ELSE 'idle' END AS status
FROM customer LEFT JOIN l ON c_custkey = user_id""",
)
def file_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file's status from its latest task: a failed one stays failed; of a done one, no chunks with a warning is skipped, and what its result covers decides else.

    Customers are files, those in debt folders, those of some wealth indexed before; events are tasks, whose property and
    value give chunks (k // 30), coverage (partial from 60 on) and a warning (a value above 30).
    """
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    last = e.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("task"), F.max_by("k", "event_id").alias("k"), F.max_by("value", "event_id").alias("value"))
    d = table(spark, sf_dir, "customer").join(last, F.col("c_custkey") == F.col("user_id"), "left")
    done = F.when((F.floor(F.col("k") / 30) == 0) & (F.col("value") > 30), "skipped").when(F.col("k") >= 60, "partial").otherwise("indexed")
    return d.select("c_custkey", file_status_of(F.col("c_acctbal") < 0, F.col("task"), done, F.col("c_acctbal") > 5000).alias("status"))


#: States of tasks by kind of event.
TASK_STATES = {"view": "queued", "click": "indexing", "error": "failed", "signup": "cancelled"}


def file_status_of(folder: Column, task: Column, done: Column, indexed_before: Column) -> Column:
    out = F.when(folder, "idle")
    for kind, state in TASK_STATES.items():
        out = out.when(task == kind, state)
    return out.when(task == "purchase", done).when(indexed_before, "indexed").otherwise("idle")


@register("c8_excluded_hits", "SELECT doc_id FROM documents WHERE contains(lower(text), 'license') AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def excluded_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = table(spark, sf_dir, "labels").filter("quality = 0").select("doc_id")
    return table(spark, sf_dir, "documents").filter(F.contains(F.lower("text"), F.lit("license"))).join(bad, "doc_id", "left_anti").select("doc_id")


@register("c10_lookup_default", "SELECT c_custkey, coalesce(n_name, 'Unknown course') AS name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 1) ON c_nationkey = n_nationkey")
def lookup_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").filter("n_regionkey <> 1")
    return table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", F.coalesce("n_name", F.lit("Unknown course")).alias("name"))


WEEKS, FIRST_DAY = 20, "2024-01-01"


@register("c14_week_of_date", f"WITH w AS (SELECT i + 1 AS week, DATE '{FIRST_DAY}' + 7 * i AS a, DATE '{FIRST_DAY}' + 7 * i + 6 AS b FROM (SELECT unnest(range({WEEKS}))::INT AS i)) SELECT event_id, week::INT AS week FROM events LEFT JOIN w ON CAST(ts AS DATE) BETWEEN a AND b")
def week_of_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The week of a semester that a date lies in: weeks are of seven days, so the number follows from the first day."""
    week = F.floor(F.date_diff(F.col("ts").cast("date"), F.lit(FIRST_DAY).cast("date")) / 7).cast("int") + 1
    return table(spark, sf_dir, "events").select("event_id", F.when(week.between(1, WEEKS), week).alias("week"))


@register("c21_cascading_match", f"""WITH f AS (SELECT doc_id, path FROM ({FILES}) WHERE doc_id % 7 <> 6), n AS (SELECT path, min(doc_id) AS id FROM f GROUP BY path),
b AS (SELECT parse_filename(path) AS base, min(id) AS id, count(*) AS k FROM n GROUP BY 1),
q AS (SELECT DISTINCT q FROM (SELECT path AS q FROM f UNION ALL SELECT regexp_extract(path, '[^/]+/[^/]+$') FROM f UNION ALL SELECT 'old/' || parse_filename(path) FROM f UNION ALL SELECT 'none'))
SELECT q, coalesce((SELECT id FROM n WHERE path = q), (SELECT min(id) FROM n WHERE ends_with(path, '/' || q)), (SELECT id FROM b WHERE base = parse_filename(q) AND k = 1)) AS id FROM q""")
def cascading_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths asked for: exact, else as the end of a path, else by a base name that only one path has. Equi-joins on all ends of the paths."""
    f = files(spark, sf_dir).filter("doc_id % 7 <> 6").select("doc_id", "path")
    known = f.groupBy("path").agg(F.min("doc_id").alias("id"))
    asked = f.select(F.explode(F.array("path", F.regexp_extract("path", "[^/]+/[^/]+$", 0), F.concat(F.lit("old/"), F.substring_index("path", "/", -1)), F.lit("none"))).alias("q")).distinct()
    parts = F.split("path", "/")
    ends = known.select("id", F.explode(F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("end"))
    ends = ends.groupBy("end").agg(F.min("id").alias("by_end"))
    bases = known.groupBy(F.substring_index("path", "/", -1).alias("base")).agg(F.min("id").alias("by_base"), F.count("*").alias("k")).filter("k = 1")
    out = asked.join(known.withColumnRenamed("id", "exact"), F.col("q") == F.col("path"), "left").join(ends, F.col("q") == F.col("end"), "left").join(bases, F.substring_index("q", "/", -1) == F.col("base"), "left")
    return out.select("q", F.coalesce("exact", "by_end", "by_base").alias("id"))


@register("d3_latest_version", "SELECT source, max(doc_id) AS version FROM documents GROUP BY source")
def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.max("doc_id").alias("version"))


@register("d4_distinct_set", "SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS types FROM events GROUP BY user_id")
def distinct_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_set("event_type")), ",").alias("types"))


@register("d8_derived_totals", "SELECT o_orderkey, coalesce(nullif(CASE WHEN o_orderstatus = 'O' THEN 0 ELSE floor(o_totalprice) END, 0), o_custkey + o_orderkey % 10 + length(o_orderpriority))::BIGINT AS total FROM orders")
def derived_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A total that is missing or zero is the sum of its parts."""
    total = F.when(F.col("o_orderstatus") == "O", F.lit(0)).otherwise(F.floor("o_totalprice"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.coalesce(F.nullif(total, F.lit(0)), F.col("o_custkey") + F.col("o_orderkey") % 10 + F.length("o_orderpriority")).cast("long").alias("total"))


@register("d14_by_week", f"SELECT coalesce(week::VARCHAR, 'unsorted') AS week, count(*) AS files, count(*) FILTER (doc_id % 3 = 0) AS indexed, max(doc_id) AS latest, row_number() OVER (ORDER BY week NULLS LAST)::INT AS place FROM (SELECT doc_id, {WEEK_SQL} AS week FROM ({FILES})) GROUP BY week")
def by_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = files(spark, sf_dir).groupBy(lecture_week(F.col("path")).alias("w")).agg(F.count("*").alias("files"), F.count_if(F.col("doc_id") % 3 == 0).alias("indexed"), F.max("doc_id").alias("latest"))
    return d.select(F.coalesce(F.col("w").cast("string"), F.lit("unsorted")).alias("week"), "files", "indexed", "latest", F.row_number().over(Window.orderBy(F.col("w").asc_nulls_last())).alias("place"))


@register("e35_lecture_week", f"SELECT doc_id, {WEEK_SQL} AS week FROM ({FILES})")
def weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("doc_id", lecture_week(F.col("path")).alias("week"))


@register("d28_sections", f"SELECT coalesce({KIND_SQL}, 'other') AS kind, CASE WHEN {KIND_SQL} = 'task' THEN {TASK_SQL} END AS task, count(*) AS files, CASE WHEN count(*) FILTER (doc_id % 11 = 0) > 0 THEN 'failed' WHEN count(*) FILTER (doc_id % 3 = 0) = count(*) THEN 'ready' ELSE 'indexing' END AS status FROM ({FILES}) GROUP BY ALL")
def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = section_kind(F.col("section_id"), F.col("path"))
    d = files(spark, sf_dir).select("doc_id", F.coalesce(kind, F.lit("other")).alias("kind"), F.when(kind == "task", task_id(F.col("section_id"), F.col("path"))).alias("task"))
    failed, ready = F.count_if(F.col("doc_id") % 11 == 0), F.count_if(F.col("doc_id") % 3 == 0)
    return d.groupBy("kind", "task").agg(F.count("*").alias("files"), F.when(failed > 0, "failed").when(ready == F.count("*"), "ready").otherwise("indexing").alias("status"))


#: Pages as Markdown: headings, links of the navigation as rows of a table, the first address of it once more as a link, advertisements as images.
MARKDOWN = r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<h1>', chr(10) || '# ', 'g'), '</h1>', chr(10), 'g'), '<li><a href="([^"]*)">([^<]*)</a></li>', chr(10) || '| [\2](\1) |', 'g'), '<div class="ad">([^<]*)</div>', chr(10) || '![\1](ad.png)', 'g'), '<p>', chr(10) || chr(10), 'g') AS text FROM pages"""


@register("d21_markdown_statistics", rf"""WITH l AS (SELECT page_id, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM (SELECT page_id, string_split(text, chr(10)) AS lines FROM ({MARKDOWN}))),
t AS (SELECT page_id, line, starts_with(trim(line), '|') AS row, coalesce(starts_with(trim(lag(line) OVER (PARTITION BY page_id ORDER BY i)), '|'), false) AS before FROM l),
n AS (SELECT page_id, count(*) AS lines, count(*) FILTER (regexp_matches(line, '^#{{1,6}}\s+')) AS headings, count(*) FILTER (row AND NOT before) AS tables FROM t GROUP BY page_id)
SELECT page_id, lines, headings, tables, len(regexp_extract_all(text, '(?:^|[^!])\[[^\]]+\]\([^)]+\)'))::BIGINT AS links, len(regexp_extract_all(text, '!\[[^\]]*\]\([^)]+\)'))::BIGINT AS images FROM n JOIN ({MARKDOWN}) USING (page_id)""")
def markdown_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, headings, runs of table rows, links and images of each page."""
    t = F.regexp_replace(F.regexp_replace("html", "<h1>", "\n# "), "</h1>", "\n")
    t = F.regexp_replace(t, '<li><a href="([^"]*)">([^<]*)</a></li>', "\n| [$2]($1) |")
    t = F.regexp_replace(F.regexp_replace(t, '<div class="ad">([^<]*)</div>', "\n![$1](ad.png)"), "<p>", "\n\n")
    d = table(spark, sf_dir, "pages").select("page_id", t.alias("text"))
    lines = F.split("text", "\n")
    row = lambda x: F.startswith(F.trim(x), F.lit("|"))
    starts = F.filter(F.zip_with(lines, F.concat(F.array(F.lit("")), F.slice(lines, 1, F.size(lines) - 1)), lambda x, before: row(x) & ~row(before)), lambda x: x)
    n = lambda p: F.regexp_count("text", F.lit(p)).cast("long")
    return d.select("page_id", F.size(lines).cast("long").alias("lines"), F.size(F.filter(lines, lambda x: x.rlike(r"^#{1,6}\s+"))).cast("long").alias("headings"), F.size(starts).cast("long").alias("tables"), n(r"(?:^|[^!])\[[^\]]+\]\([^)]+\)").alias("links"), n(r"!\[[^\]]*\]\([^)]+\)").alias("images"))


@register("d25_sources_of_arrays", "SELECT o_orderkey, len(list_distinct([o_custkey % 3, o_custkey % 5, o_orderkey % 3] || [o_orderkey % 7] || CASE WHEN o_orderstatus = 'F' THEN [o_custkey % 3] ELSE [] END))::INT AS sources FROM orders")
def sources_of_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = F.col("o_custkey"), F.col("o_orderkey")
    last = F.when(F.col("o_orderstatus") == "F", F.array(c % 3)).otherwise(F.array().cast("array<bigint>"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.size(F.array_distinct(F.concat(F.array(c % 3, c % 5, o % 3), F.array(o % 7), last))).alias("sources"))


@register("d26_diff_lines", r"WITH l AS (SELECT conv_id, turn, unnest(string_split(regexp_replace(text, '[.]', chr(10) || CASE WHEN turn % 2 = 0 THEN '+' ELSE '-' END, 'g') || chr(10) || '+++ b' || chr(10) || '--- a', chr(10))) AS line FROM conversations) SELECT conv_id, turn, count(*) FILTER (starts_with(line, '+') AND NOT starts_with(line, '+++')) AS added, count(*) FILTER (starts_with(line, '-') AND NOT starts_with(line, '---')) AS removed FROM l GROUP BY conv_id, turn")
def diff_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    diff = F.concat(F.regexp_replace(F.col("text"), F.lit("[.]"), F.concat(F.lit("\n"), F.when(F.col("turn") % 2 == 0, "+").otherwise("-"))), F.lit("\n+++ b\n--- a"))
    n = lambda sign: F.size(F.filter(F.split(diff, "\n"), lambda x: x.startswith(sign) & ~x.startswith(3 * sign))).cast("long")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", n("+").alias("added"), n("-").alias("removed"))


VERSIONS = "SELECT p_partkey, CAST(p_size % 4 AS VARCHAR(4)) || '.' || CAST(p_partkey % 23 AS VARCHAR(4)) || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '.' || CAST(p_partkey % 13 AS VARCHAR(4)) END AS version FROM part"


@register("e41_version_order", rf"SELECT p_partkey, version, row_number() OVER (ORDER BY coalesce(TRY_CAST(regexp_extract(v, '^(\d+)', 1) AS BIGINT), 0), coalesce(TRY_CAST(regexp_extract(v, '^\d+\.(\d+)', 1) AS BIGINT), 0), coalesce(TRY_CAST(regexp_extract(v, '^\d+\.\d+\.(\d+)', 1) AS BIGINT), 0), p_partkey) AS place FROM (SELECT *, trim(version) AS v FROM ({VERSIONS}))")
def version_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions by their first three numbers; one that is missing, or not a number, is zero. Places are counted in ranges."""
    v = spark.sql(VERSIONS.replace("FROM part", "FROM {p}"), p=table(spark, sf_dir, "part"))
    number = lambda i: F.coalesce(F.expr(f"try_cast(regexp_extract(trim(version), '^(\\\\d+)(?:\\\\.(\\\\d+))?(?:\\\\.(\\\\d+))?', {i}) AS BIGINT)"), F.lit(0))
    v = v.withColumns({f"n{i}": number(i) for i in (1, 2, 3)})
    return running(v, [F.col(c) for c in ("n1", "n2", "n3", "p_partkey")]).select("p_partkey", "version", "place")


#: Full-width forms, which stand for ASCII ones.
WIDE, NARROW = "".join(map(chr, range(0xFF01, 0xFF5F))), "".join(map(chr, range(0x21, 0x7F)))
#: Words for all weeks, odd and even ones, and what stands between the ends of a range.
ALL_WEEKS, ODD_WEEKS, EVEN_WEEKS = "all|every|全部|全周|所有|整学期", "odd|single|单周|单数周", "even|double|双周|双数周"
WEEK_SPAN = r"([0-9]{1,2})\s*(?:-|~|–|—|to|至|到)\s*([0-9]{1,2})"
WEEKS = 16
#: Expressions, one for each part: its kind tells the form, its size and brand the numbers.
WEEK_EXPRESSIONS = """SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN CASE WHEN p_size < 10 THEN 'Ａｌｌ weeks' WHEN p_size < 20 THEN '整学期' WHEN p_size < 30 THEN '' ELSE 'none' END
 WHEN 'LARGE' THEN CASE WHEN p_size < 25 THEN 'ODD weeks' ELSE '单周' END WHEN 'MEDIUM' THEN CASE WHEN p_size < 25 THEN 'double, ' ELSE '双数周 ' END || p_size
 WHEN 'PROMO' THEN p_size || ' 至 ' || replace(p_brand, 'Brand#', '') WHEN 'SMALL' THEN '第' || p_size || '–' || replace(p_brand, 'Brand#', '') || '周，１４' ELSE replace(p_brand, 'Brand#', '') || ',' || p_size || '; single' END AS x FROM part"""


@register("e36_week_expression", f"""WITH e AS (SELECT p_partkey, trim(lower(translate(x, '{WIDE}', '{NARROW.replace(chr(39), chr(39) * 2)}'))) AS x FROM ({WEEK_EXPRESSIONS})),
w AS (SELECT unnest(range(1, {WEEKS + 1})) AS week),
h AS (SELECT p_partkey, week, x = '' OR regexp_matches(x, '{ALL_WEEKS}') AS every,
  (regexp_matches(x, '{ODD_WEEKS}') AND week % 2 = 1) OR (regexp_matches(x, '{EVEN_WEEKS}') AND week % 2 = 0)
  OR len(list_filter(list_zip(regexp_extract_all(x, '{WEEK_SPAN}', 1), regexp_extract_all(x, '{WEEK_SPAN}', 2)), lambda p: week BETWEEN least(p[1]::INT, p[2]::INT) AND greatest(p[1]::INT, p[2]::INT))) > 0
  OR list_contains(list_transform(regexp_extract_all(x, '[0-9]{{1,2}}'), lambda y: y::INT), week) AS hit FROM e, w),
s AS (SELECT *, bool_or(hit) OVER (PARTITION BY p_partkey) AS any_hit FROM h)
SELECT p_partkey, string_agg(week::VARCHAR, ',' ORDER BY week) AS weeks FROM s WHERE every OR hit OR NOT any_hit GROUP BY p_partkey""")
def week_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weeks that an expression names: all, odd, even, ranges in either order, single numbers; all if it names none."""
    d = spark.sql(WEEK_EXPRESSIONS.replace("FROM part", "FROM {p}"), p=table(spark, sf_dir, "part"))
    d = d.select("p_partkey", F.trim(F.lower(F.translate("x", WIDE, NARROW))).alias("x"))
    return d.select("p_partkey", F.array_join(named_weeks(F.col("x"), WEEKS), ",").alias("weeks"))


def named_weeks(x: Column, last: int) -> Column:
    """Of the weeks 1 to last; x in lower case."""
    ends = F.zip_with(F.regexp_extract_all(x, F.lit(WEEK_SPAN), F.lit(1)), F.regexp_extract_all(x, F.lit(WEEK_SPAN), F.lit(2)), lambda a, b: F.struct(F.least(a.cast("int"), b.cast("int")).alias("a"), F.greatest(a.cast("int"), b.cast("int")).alias("b")))
    numbers = F.transform(F.regexp_extract_all(x, F.lit("[0-9]{1,2}"), F.lit(0)), lambda y: y.cast("int"))
    weeks = F.sequence(F.lit(1), F.lit(last))
    said = F.struct(ends.alias("ends"), numbers.alias("numbers"), x.rlike(ODD_WEEKS).alias("odd"), x.rlike(EVEN_WEEKS).alias("even"))
    # what is said is read once, not for each week
    hit = once(said, lambda s: F.filter(weeks, lambda w: (s["odd"] & (w % 2 == 1)) | (s["even"] & (w % 2 == 0)) | F.exists(s["ends"], lambda e: w.between(e["a"], e["b"])) | F.array_contains(s["numbers"], w)))
    return F.when((x == "") | x.rlike(ALL_WEEKS), weeks).otherwise(once(hit, lambda h: F.when(F.size(h) == 0, weeks).otherwise(h)))


@register("i4_first_warnings", f"SELECT user_id, message, place FROM (SELECT user_id, message, row_number() OVER (PARTITION BY user_id ORDER BY first) AS place FROM (SELECT user_id, message, min(event_id) AS first FROM ({MESSAGES}) GROUP BY ALL)) WHERE place <= 8")
def first_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = messages(spark, sf_dir).groupBy("user_id", "message").agg(F.min("event_id").alias("first"))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("first"))
    return first.select("user_id", "message", place.cast("long").alias("place")).filter("place <= 8")


@register("j2_latest_row", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1")
def latest_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc()).limit(1).select("o_orderkey", "o_orderdate")


@register("j3_top_models", "SELECT user_id, tokens, requests FROM (SELECT user_id, round(sum(value), 4) AS tokens, count(*) AS requests FROM events GROUP BY user_id) ORDER BY tokens DESC, requests DESC, user_id LIMIT 12")
def top_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(F.sum("value"), 4).alias("tokens"), F.count("*").alias("requests"))
    return m.orderBy(F.col("tokens").desc(), F.col("requests").desc(), "user_id").limit(12)


@register("j8_newest_conversation", "SELECT max(conv_id) AS conv_id FROM conversations WHERE role = 'system'")
def newest_conversation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").filter("role = 'system'").agg(F.max("conv_id").alias("conv_id"))


@register("k4_membership", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").filter("toxic = 1"), "doc_id", "left_semi").select("doc_id")


OLD_ROWS, NEW_ROWS = "SELECT doc_id, source, 'old' AS version FROM documents WHERE doc_id % 3 <> 2", "SELECT doc_id, source, 'new' AS version FROM documents WHERE doc_id % 2 = 0"


def _states(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    return d.filter("doc_id % 3 <> 2").withColumn("version", F.lit("old")), d.filter("doc_id % 2 = 0").withColumn("version", F.lit("new"))


@register("l2_upsert_by_id", f"SELECT * FROM ({OLD_ROWS}) WHERE doc_id NOT IN (SELECT doc_id FROM ({NEW_ROWS})) UNION ALL {NEW_ROWS}")
def upsert_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with an id that comes again are replaced, others stay, also those of a file that has shrunk."""
    old, new = _states(spark, sf_dir)
    return old.join(new, "doc_id", "left_anti").unionByName(new)


@register("l6_replace_scope", f"SELECT * FROM ({OLD_ROWS}) WHERE source <> 'src2' UNION ALL SELECT * FROM ({NEW_ROWS}) WHERE source = 'src2'")
def replace_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _states(spark, sf_dir)
    return old.filter("source <> 'src2'").unionByName(new.filter("source = 'src2'"))


@register("l13_cancel_job", "SELECT event_id, user_id, CASE WHEN user_id % 10 = 3 AND event_type IN ('view', 'click') THEN 'cancelled' ELSE event_type END AS state FROM events")
def cancel_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queued and running tasks of cancelled jobs are cancelled; ended ones stay."""
    hit = (F.col("user_id") % 10 == 3) & F.col("event_type").isin("view", "click")
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.when(hit, "cancelled").otherwise(F.col("event_type")).alias("state"))


@register("l14_json_merge", "SELECT event_id, (json_extract(props, '$.k'))::BIGINT AS k, CASE WHEN event_type = 'error' THEN 'bad' ELSE NULL END AS note, user_id AS owner FROM events")
def json_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of the patch replace those of the document; the others stay."""
    old = F.from_json("props", "map<string,string>")
    patch = F.map_concat(F.create_map(F.lit("owner"), F.col("user_id").cast("string")), F.when(F.col("event_type") == "error", F.create_map(F.lit("note"), F.lit("bad"))).otherwise(F.create_map().cast("map<string,string>")))
    merged = F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(patch, k)), patch)
    out = table(spark, sf_dir, "events").select("event_id", merged.alias("m"))
    return out.select("event_id", F.col("m")["k"].cast("long").alias("k"), F.col("m")["note"].alias("note"), F.col("m")["owner"].cast("long").alias("owner"))


@register("l17_stale_accepting", "SELECT event_id, CASE WHEN event_type = 'click' AND (SELECT max(ts) FROM events) - ts > INTERVAL 2 MINUTE THEN 'failed' ELSE event_type END AS state FROM events")
def stale_accepting(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    now = e.agg(F.max("ts").alias("now"))  # one row
    stale = (F.col("event_type") == "click") & (F.col("ts") < F.col("now") - F.expr("INTERVAL 2 MINUTES"))
    return e.join(F.broadcast(now)).select("event_id", F.when(stale, "failed").otherwise(F.col("event_type")).alias("state"))


@register("l18_manual_fields", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND trim(o_orderpriority) <> '' THEN o_orderpriority ELSE 'refreshed' END AS summary, coalesce(CASE WHEN o_custkey % 2 = 0 THEN o_orderdate + INTERVAL 7 DAY END, o_orderdate) AS due FROM orders")
def manual_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that a person wrote survive a refresh; a date that the refresh leaves out stays."""
    manual = (F.col("o_orderstatus") == "F") & (F.trim("o_orderpriority") != "")
    due = F.when(F.col("o_custkey") % 2 == 0, F.col("o_orderdate") + F.expr("INTERVAL 7 DAYS"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(manual, F.col("o_orderpriority")).otherwise("refreshed").alias("summary"), F.coalesce(due, F.col("o_orderdate")).alias("due"))


ID_KINDS = "CASE WHEN c_mktsegment < 'C' THEN 'requirement' ELSE 'rubric' END"
_DIGITS = "0123456789abcdefghijklmnopqrstuvwxyz"


@register("l19_item_ids", f"WITH h AS (SELECT c_custkey, {ID_KINDS} AS kind, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(lower(trim(c_name)), ''), lambda c: ord(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619::HUGEINT % 4294967296)::BIGINT) AS h FROM customer) SELECT c_custkey, kind || '_' || coalesce(nullif(ltrim(array_to_string(list_transform([2176782336, 60466176, 1679616, 46656, 1296, 36, 1], lambda p: '{_DIGITS}'[(h // p % 36 + 1)::INT]), ''), '0'), ''), '0') AS id FROM h")
def item_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kind, and FNV-1a over the characters of the normalised text, in 32 bits, to the base 36."""
    codes = F.transform(F.split(F.lower(F.trim("c_name")), ""), lambda c: F.ascii(c).cast("long"))
    mixed = F.aggregate(F.filter(codes, lambda c: c > 0), F.lit(2166136261).cast("long"), lambda h, c: F.pmod(h.bitwiseXOR(c) * F.lit(16777619).cast("long"), F.lit(1 << 32).cast("long")))
    return table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.expr(ID_KINDS), F.lit("_"), F.lower(F.conv(mixed.cast("string"), 10, 36))).alias("id"))
