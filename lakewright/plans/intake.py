"""Queries: what comes into a workspace (paths, addresses, pages, slides) and the jobs that index it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakewright.functions.text import TEXT_CAP
from lakewright.operators.ordered import running
from lakewright.plans.catalog import register
from lakewright.session import table

#: Source types by a file's suffix.
SOURCE_TYPES = {
    "pdf": ("pdf",),
    "doc": ("docx", "doc", "odt", "rtf", "epub", "html", "htm", "tex", "latex", "rst", "org", "ipynb", "typ"),
    "excel": ("xlsx", "xlsm", "xls"),
    "pptx": ("pptx", "pptm", "ppsx", "ppsm", "potx", "potm"),
    "markdown": ("md", "markdown"),
    "text": ("txt", "text"),
}

#: Names made from event ids (the same text for Spark and DuckDB).
NAMES = """SELECT event_id, CASE CAST(event_id % 12 AS INT) WHEN 0 THEN 'https://a.example.org/x.pdf' WHEN 1 THEN 'HTTP://b.example.org' WHEN 2 THEN 'http:///none.md' WHEN 3 THEN '/data/folder/'
 WHEN 4 THEN '/data/Report.PDF' WHEN 5 THEN 'notes.ipynb' WHEN 6 THEN '/ws/.state/sessions/s.jsonl' WHEN 7 THEN '/ws/.state/index.db' WHEN 8 THEN '/ws/threads/t1/deck.pptx' WHEN 9 THEN 'C:\\ws\\.DS_Store' WHEN 10 THEN '/ws/a.xlsm.tmp' ELSE '/ws/book.xlsm' END AS name FROM events"""


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = NAMES.replace("FROM events", "FROM {e}").replace("\\", "\\\\")
    return spark.sql(raw, e=table(spark, sf_dir, "events").select("event_id"))


_SUFFIX_SQL = " ".join(f"WHEN suffix IN ({', '.join(repr(s) for s in found)}) THEN '{kind}'" for kind, found in SOURCE_TYPES.items())


@register("a19_source_type", f"SELECT event_id, CASE WHEN regexp_matches(name, '(?i)^https?://[^/?#]') THEN 'web' WHEN suffix(name, '/') THEN 'directory' {_SUFFIX_SQL} ELSE 'unknown' END AS kind FROM (SELECT *, lower(regexp_extract(name, '\\.([A-Za-z0-9]+)$', 1)) AS suffix FROM ({NAMES}))")
def source_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web addresses, folders, then the suffix; anything else is unknown."""
    suffix, kind = F.lower(F.regexp_extract("name", r"\.([A-Za-z0-9]+)$", 1)), F.lit("unknown")
    for name, found in SOURCE_TYPES.items():
        kind = F.when(suffix.isin(*found), name).otherwise(kind)
    kind = F.when(F.col("name").rlike("(?i)^https?://[^/?#]"), "web").when(F.col("name").endswith("/"), "directory").otherwise(kind)
    return names(spark, sf_dir).select("event_id", kind.alias("kind"))


#: Folders that aren't watched, the folder of a program's state, and in it the sessions'.
UNWATCHED, STATE, SESSIONS = ("/threads/",), "/.state/", "/.state/sessions/"


@register("b17_path_event", f"SELECT event_id, CASE WHEN strpos(name, '/threads/') > 0 THEN 'ignore' WHEN strpos(name, '/.state/sessions/') > 0 THEN 'session' WHEN strpos(name, '/.state/') > 0 THEN 'ignore' WHEN list_last(string_split(name, '/')) = '.DS_Store' OR suffix(name, '.tmp') THEN 'ignore' ELSE 'sync' END AS kind FROM (SELECT event_id, replace(name, '\\', '/') AS name FROM ({NAMES}))")
def path_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule that holds decides what a changed path asks for."""
    path = F.replace("name", F.lit("\\"), F.lit("/"))
    kind = F.when(F.col("path").isNull() | (F.col("path") == ""), "ignore")
    for folder in UNWATCHED:
        kind = kind.when(F.col("path").contains(folder), "ignore")
    kind = kind.when(F.col("path").contains(SESSIONS), "session").when(F.col("path").contains(STATE), "ignore")
    own = F.element_at(F.split("path", "/"), -1)
    kind = kind.when((own == ".DS_Store") | own.endswith(".tmp"), "ignore").otherwise("sync")
    return names(spark, sf_dir).select("event_id", path.alias("path")).select("event_id", kind.alias("kind"))


@register("c3_active_jobs", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_partkey <= 40 AND l_linestatus = 'O') ORDER BY o_orderdate DESC, o_orderkey")
def active_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open jobs with an open task for one of the files asked for, each once, latest first."""
    tasks = table(spark, sf_dir, "lineitem").filter("l_partkey <= 40 AND l_linestatus = 'O'").select("l_orderkey")
    jobs = table(spark, sf_dir, "orders").filter("o_orderstatus IN ('O', 'P')").select("o_orderkey", "o_orderstatus", "o_orderdate")
    return jobs.join(tasks, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").orderBy(F.desc("o_orderdate"), "o_orderkey").select("o_orderkey", "o_orderstatus")


_TASKS = "SELECT l_orderkey AS job, CASE WHEN l_linestatus = 'F' THEN 'done' WHEN l_returnflag = 'N' THEN 'queued' ELSE 'running' END AS status, CASE WHEN l_linenumber <> 3 THEN l_shipdate END AS locked_until, CASE WHEN l_suppkey % 5 > 0 THEN l_suppkey % 5 END AS locked_by FROM lineitem"
_FREED = "status = 'running' AND locked_until < TIMESTAMP '1996-01-01' AND (locked_by IS NULL OR locked_by <> 2)"


@register("c5_recover_expired", f"WITH tasks AS (SELECT job, CASE WHEN {_FREED} THEN 'queued' ELSE status END AS status FROM ({_TASKS})) SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND EXISTS (SELECT 1 FROM tasks WHERE job = o_orderkey AND status = 'queued') THEN 'queued' ELSE o_orderstatus END AS status, CASE WHEN o_orderstatus = 'O' AND EXISTS (SELECT 1 FROM tasks WHERE job = o_orderkey AND status = 'queued') THEN 'recovered' END AS stage FROM orders")
def recover_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running tasks of other workers whose lock ran out are queued again, then running jobs that have a queued task."""
    tasks = spark.sql(_TASKS.replace("FROM lineitem", "FROM {l}"), l=table(spark, sf_dir, "lineitem"))
    late = F.col("locked_until") < F.lit("1996-01-01").cast("timestamp_ntz")
    freed = (F.col("status") == "running") & late & (F.col("locked_by").isNull() | (F.col("locked_by") != 2))
    # grouped by job before the join: one row a job, summed up on the map side
    queued = tasks.filter((F.col("status") == "queued") | freed).groupBy("job").agg(F.lit(True).alias("again"))
    again = (F.col("o_orderstatus") == "O") & F.col("again")
    jobs = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").join(queued, F.col("o_orderkey") == F.col("job"), "left")
    return jobs.select("o_orderkey", F.when(again, "queued").otherwise(F.col("o_orderstatus")).alias("status"), F.when(again, "recovered").alias("stage"))


@register("c6_latest_completed", "SELECT l_partkey, o_orderpriority AS fingerprint, l_shipdate AS completed_at FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linestatus = 'F' QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, o_orderdate DESC, l_orderkey DESC) = 1")
def latest_completed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each file the latest finished task with its job's fingerprint; an aggregate, so nothing is sorted."""
    done = table(spark, sf_dir, "lineitem").filter("l_linestatus = 'F'").select("l_partkey", "l_orderkey", "l_shipdate")
    jobs = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate")
    last = F.max_by(F.struct("o_orderpriority", "l_shipdate"), F.struct("l_shipdate", "o_orderdate", "l_orderkey"))
    found = done.join(jobs, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_partkey").agg(last.alias("x"))
    return found.select("l_partkey", F.col("x.o_orderpriority").alias("fingerprint"), F.col("x.l_shipdate").alias("completed_at"))


@register("c23_approvals", "WITH asked AS (SELECT user_id, event_id % 9 AS request, arg_max(event_id % 5, event_id) AS tool FROM events WHERE event_type = 'view' GROUP BY ALL), said AS (SELECT user_id, event_id % 9 AS request, arg_max(CASE WHEN event_id % 4 = 0 THEN 'deny' ELSE 'allow' END, event_id) AS decision, min(event_id) AS first FROM events WHERE event_type = 'click' GROUP BY ALL) SELECT user_id, tool, arg_max(decision, first) AS decision FROM asked JOIN said USING (user_id, request) GROUP BY user_id, tool")
def approvals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decision to request to tool: a request's last tool and last decision; of a tool's requests the one decided on last."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", (F.col("event_id") % 9).alias("request"))
    asked = e.filter("event_type = 'view'").groupBy("user_id", "request").agg(F.max_by(F.col("event_id") % 5, "event_id").alias("tool"))
    decision = F.when(F.col("event_id") % 4 == 0, "deny").otherwise("allow")
    said = e.filter("event_type = 'click'").groupBy("user_id", "request").agg(F.max_by(decision, "event_id").alias("decision"), F.min("event_id").alias("first"))
    return asked.join(said, ["user_id", "request"]).groupBy("user_id", "tool").agg(F.max_by("decision", "first").alias("decision"))


@register("e7_section_budget", f"SELECT doc_id, lang, least(n, {TEXT_CAP} - used)::BIGINT AS n, md5(left(text, ({TEXT_CAP} - used)::BIGINT)) AS digest FROM (SELECT doc_id, lang, text, length(text) AS n, coalesce(sum(length(text)) OVER (PARTITION BY lang ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM documents) WHERE used < {TEXT_CAP}")
def section_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections are taken until their file's budget is used up; the last is cut. The documents of a language are the sections of a file; lengths are summed up without the texts, in ranges."""
    d = table(spark, sf_dir, "documents")
    sums = running(d.select("doc_id", "lang", F.length("text").alias("n")), [F.col("doc_id")], ("lang",), "n")
    taken = sums.withColumn("left", F.lit(TEXT_CAP) - (F.col("total") - F.coalesce("n", F.lit(0)))).filter("left > 0")
    return d.select("doc_id", "text").join(taken, "doc_id").select("doc_id", "lang", F.least("n", "left").cast("long").alias("n"), F.md5(F.left("text", F.col("left").cast("int"))).alias("digest"))


_LINKS = "SELECT page_id, CASE CAST(page_id % 5 AS INT) WHEN 0 THEN '  ' || url || '#top ' WHEN 1 THEN replace(url, 'http://', '') WHEN 2 THEN regexp_replace(url, '/[a-z]+/.*$', '') WHEN 3 THEN 'https:// bad' ELSE upper(url) END AS link FROM pages"


@register("e12_source_url", f"SELECT page_id, CASE WHEN regexp_matches(full_link, '^https?://[^/?#\\s]+([/?#]|$)') THEN lower(regexp_extract(full_link, '^(https?://[^/?#]+)', 1)) || CASE WHEN regexp_matches(full_link, '^https?://[^/?#]+/') THEN '' ELSE '/' END || regexp_extract(full_link, '^https?://[^/?#]+([^#]*)', 1) END AS url FROM (SELECT page_id, CASE WHEN starts_with(trim(link), 'http://') OR starts_with(trim(link), 'https://') THEN trim(link) ELSE 'https://' || trim(link) END AS full_link FROM ({_LINKS}))")
def source_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trimmed, https where no scheme stands, host in lower case, without fragment; null where there is no valid host."""
    links = spark.sql(_LINKS.replace("FROM pages", "FROM {p}"), p=table(spark, sf_dir, "pages").select("page_id", "url"))
    own = F.trim("link")
    full = links.select("page_id", F.when(own.startswith("http://") | own.startswith("https://"), own).otherwise(F.concat(F.lit("https://"), own)).alias("full"))
    host = F.lower(F.regexp_extract("full", "^(https?://[^/?#]+)", 1))
    path = F.regexp_extract("full", "^https?://[^/?#]+([^#]*)", 1)
    url = F.concat(host, F.when(path.startswith("/"), "").otherwise("/"), path)
    return full.select("page_id", F.when(F.col("full").rlike(r"^https?://[^/?#\s]+([/?#]|$)"), url).alias("url"))


#: Characters of a sparse page or slide, and the share of a slide that a large picture covers.
PAGE_CHARS, PICTURES_CHARS, SLIDE_CHARS, LARGE_SHARE = 80, 200, 240, 0.35


@register("e19_page_needs_ocr", "SELECT doc_id, CASE WHEN n = 0 THEN 'empty_page' WHEN images > 0 AND n < 80 THEN 'image_heavy_low_text_page' END AS reason FROM (SELECT doc_id, n_chars % 160 AS n, doc_id % 3 AS images FROM documents)")
def page_needs_ocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 160).alias("n"), (F.col("doc_id") % 3).alias("images"))
    return d.select("doc_id", F.when(F.col("n") == 0, "empty_page").when((F.col("images") > 0) & (F.col("n") < PAGE_CHARS), "image_heavy_low_text_page").alias("reason"))


def slide_needs_ocr(media: Column, chars: Column, share: Column) -> Column:
    """Never without pictures; always without text; with little text if pictures are several or large."""
    return (media > 0) & ((chars == 0) | ((media >= 2) & (chars <= PICTURES_CHARS)) | ((chars <= SLIDE_CHARS) & (share >= LARGE_SHARE)))


@register("e20_slide_needs_ocr", "SELECT doc_id, media > 0 AND (n = 0 OR (media >= 2 AND n <= 200) OR (n <= 240 AND share >= 0.35)) AS ocr FROM (SELECT doc_id, n_chars % 400 AS n, doc_id % 4 AS media, (doc_id % 100) / 100.0::DOUBLE AS share FROM documents)")
def slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", slide_needs_ocr(F.col("doc_id") % 4, F.col("n_chars") % 400, F.col("doc_id") % 100 / F.lit(100.0)).alias("ocr"))


@register("e21_slides_to_ocr", "WITH parts AS (SELECT conv_id, turn, role, max(turn) OVER (PARTITION BY conv_id) + 2 AS n FROM conversations) SELECT conv_id, turn AS slide FROM parts WHERE role = 'user' AND turn > 0 UNION SELECT conv_id, slide FROM (SELECT conv_id, unnest(range(1, n + 1)) AS slide FROM (SELECT DISTINCT conv_id, n FROM parts)) ANTI JOIN (SELECT conv_id, turn AS slide FROM parts) USING (conv_id, slide)")
def slides_to_ocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagged slides, and those of 1 to N that no part of the text belongs to."""
    parts = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("slide"), "role")
    every = parts.groupBy("conv_id").agg(F.max("slide").alias("last")).select("conv_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("last") + 2)).alias("slide"))
    missing = every.join(parts, ["conv_id", "slide"], "left_anti")
    return parts.filter("role = 'user' AND slide > 0").select("conv_id", "slide").union(missing).distinct()


#: Tool inputs whose stream has been cut at some place (the same text for Spark and DuckDB); chr(92) is the backslash.
_INPUTS = "SELECT event_id, left('{\"n\": 1, \"path\" : \"a' || chr(92) || '\"b' || chr(92) || chr(92) || 'c' || chr(92) || 'u00e9 ' || CASE WHEN event_id % 7 = 0 THEN chr(92) || 'q' ELSE '' END || event_type || '\", \"x\": 2}', CAST(10 + event_id % 50 AS INT)) AS input FROM events"
_FIELD = r'"path"\s*:\s*"((?:\\.|[^"\\])*)'


@register("e37_partial_json", f"SELECT event_id, CASE WHEN raw = '' THEN '' ELSE coalesce(json_extract_string(TRY_CAST('{{\"v\":\"' || raw || '\"}}' AS JSON), '$.v'), trim(replace(replace(raw, chr(92) || '\"', '\"'), chr(92) || chr(92), chr(92)))) END AS path FROM (SELECT event_id, regexp_extract(input, '{_FIELD}', 1) AS raw FROM ({_INPUTS}))")
def partial_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A string field of unfinished JSON: what is there of it, decoded; by hand where it can't be decoded."""
    inputs = spark.sql(_INPUTS.replace("{", "{{").replace("}", "}}").replace("FROM events", "FROM {e}"), e=table(spark, sf_dir, "events").select("event_id", "event_type"))
    raw = inputs.select("event_id", F.regexp_extract("input", _FIELD, 1).alias("raw"))
    decoded = F.from_json(F.concat(F.lit('{"v":"'), "raw", F.lit('"}')), "v string")["v"]
    by_hand = F.trim(F.replace(F.replace("raw", F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\")))
    return raw.select("event_id", F.when(F.col("raw") == "", "").otherwise(F.coalesce(decoded, by_hand)).alias("path"))


@register("l7_replace", "SELECT user_id AS key, arg_max(v, (late, event_id)) AS value FROM (SELECT user_id, event_id, event_type || event_id AS v, event_type = 'click' AS late FROM events WHERE event_type IN ('view', 'click')) GROUP BY user_id")
def replace_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that come in replace those with their key, the last wins; one aggregate over both tables."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.concat("event_type", "event_id").alias("v"), "event_type")
    there, coming = e.filter("event_type = 'view'").withColumn("late", F.lit(False)), e.filter("event_type = 'click'").withColumn("late", F.lit(True))
    return there.unionByName(coming).groupBy(F.col("user_id").alias("key")).agg(F.max_by("v", F.struct("late", "event_id")).alias("value"))
