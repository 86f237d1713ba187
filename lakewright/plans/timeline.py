"""Queries: cells and charts, runs, events and usage of conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakewright.functions import sheets as S
from lakewright.plans.catalog import register
from lakewright.plans.sheets import _nice_sql
from lakewright.session import table
from lakewright.streaming import frames

@register("g2_counta", "SELECT user_id, count(*) FILTER (x IS NOT NULL AND x <> '') AS counta, count(*) FILTER (x IS NULL OR x = '') AS countblank FROM (SELECT user_id, CASE event_type WHEN 'view' THEN '' WHEN 'click' THEN NULL ELSE event_type END AS x FROM events) GROUP BY user_id")
def counta(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.when(F.col("event_type") == "view", "").when(F.col("event_type") != "click", F.col("event_type"))
    blank = F.coalesce(x == "", F.lit(True))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(~blank).alias("counta"), F.count_if(blank).alias("countblank"))


@register("g9_conditionals", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_quantity > 25 THEN 'large' ELSE 'small' END AS size, CASE WHEN l_discount = 0 THEN 'none' WHEN l_discount < 0.05 THEN 'low' WHEN l_discount < 0.08 THEN 'mid' END AS band, coalesce(l_extendedprice / nullif(l_discount, 0), -1) AS safe, l_tax > 0 AND NOT (l_returnflag = 'A' OR l_linestatus = 'F') AS flag FROM lineitem")
def conditionals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IF, IFS without a case that holds, IFERROR of a division, AND, OR and NOT."""
    d = F.col("l_discount")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.when(F.col("l_quantity") > 25, "large").otherwise("small").alias("size"),
        F.when(d == 0, "none").when(d < 0.05, "low").when(d < 0.08, "mid").alias("band"),
        F.coalesce(F.try_divide("l_extendedprice", d), F.lit(-1.0)).alias("safe"),
        ((F.col("l_tax") > 0) & ~((F.col("l_returnflag") == "A") | (F.col("l_linestatus") == "F"))).alias("flag"),
    )


#: Rows of a lookup range: from, label, rate.
BRACKETS = ((0, "none", 0.0), (5, "some", 0.1), (20, "many", 0.2), (40, "bulk", 0.3))


@register("g11_vlookup", "WITH b(k, label, rate) AS (VALUES " + ", ".join(f"({k}::DOUBLE, '{n}', {r}::DOUBLE)" for k, n, r in BRACKETS) + ") SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (SELECT arg_max(label, k) FROM b WHERE k <= l_quantity) AS near_label, (SELECT rate FROM b WHERE k = l_quantity) AS exact_rate FROM lineitem")
def vlookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last row not above the value, and the row that equals it; the range is a constant of the formula."""
    rows = F.array(*[F.struct(F.lit(float(k)).alias("k"), F.lit(n).alias("label"), F.lit(r).alias("rate")) for k, n, r in BRACKETS])
    q = F.col("l_quantity")
    near, exact = F.filter(rows, lambda x: x["k"] <= q), F.filter(rows, lambda x: x["k"] == q)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.try_element_at(near, F.lit(-1))["label"].alias("near_label"), F.get(exact, F.lit(0))["rate"].alias("exact_rate"))


@register("g12_match_index", "WITH o AS (SELECT l_orderkey, list(l_quantity ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS q, list(l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS p FROM lineitem GROUP BY l_orderkey) SELECT l_orderkey, list_position(q, 10.0)::INT AS place, p[2] AS second, CASE WHEN list_position(q, 10.0) > 0 THEN p[list_position(q, 10.0)] ELSE -1 END AS xlookup FROM o")
def match_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MATCH (exact), INDEX, and XLOOKUP with a fallback, over the lines of each order."""
    lines = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")))
    o = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(lines.alias("x"))
    at = F.array_position(F.transform("x", lambda r: r["l_quantity"]), 10.0)
    part = F.transform("x", lambda r: r["l_partkey"])
    return o.select("l_orderkey", F.nullif(at, F.lit(0)).cast("int").alias("place"), F.get(part, F.lit(1)).alias("second"), F.when(at > 0, F.get(part, at.cast("int") - 1)).otherwise(F.lit(-1)).alias("xlookup"))


@register("g19_result_format", r"SELECT event_id, regexp_replace((floor(value * 1000 + 0.5) / 1000)::VARCHAR, '\.0$', '') AS shown, CASE WHEN value > 50 THEN 'TRUE' ELSE 'FALSE' END AS large FROM events")
def result_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.regexp_replace((F.floor(F.col("value") * 1000 + 0.5) / 1000).cast("string"), r"\.0$", "")
    return table(spark, sf_dir, "events").select("event_id", shown.alias("shown"), F.when(F.col("value") > 50, "TRUE").otherwise("FALSE").alias("large"))


@register("g20_cell_display", "SELECT o_orderkey, format('{:,.2f}', o_totalprice) AS grouped, '$' || format('{:,.2f}', o_totalprice) AS money, (DATE '1970-01-01' + (date_diff('day', DATE '1899-12-30', CAST(o_orderdate AS DATE)) - 25569)::INT)::VARCHAR AS day FROM orders")
def cell_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers with grouping and currency, and a date from its serial number (days since 1899-12-30)."""
    serial = F.date_diff(F.col("o_orderdate").cast("date"), F.lit("1899-12-30").cast("date"))
    shown = F.format_number("o_totalprice", 2)
    return table(spark, sf_dir, "orders").select("o_orderkey", shown.alias("grouped"), F.concat(F.lit("$"), shown).alias("money"), F.date_add(F.lit("1970-01-01").cast("date"), serial - 25569).cast("string").alias("day"))


CELLS_SQL = "SELECT o_orderpriority AS category, o_orderstatus AS series, round(sum(CASE WHEN o_custkey % 7 = 0 THEN -o_totalprice ELSE o_totalprice END), 2) AS v FROM orders GROUP BY ALL"


@register("h4_bar_maximum", f"WITH c AS ({CELLS_SQL}), m AS (SELECT (SELECT greatest(max(s), 1) FROM (SELECT sum(greatest(v, 0)) AS s FROM c GROUP BY category)) AS stacked, (SELECT greatest(max(v), 1) FROM c) AS clustered) SELECT {_nice_sql('stacked')} AS stacked, {_nice_sql('clustered')} AS clustered, 100.0::DOUBLE AS percent FROM m")
def bar_maximum(spark: SparkSession, sf_dir: str) -> DataFrame:
    signed = F.when(F.col("o_custkey") % 7 == 0, -F.col("o_totalprice")).otherwise(F.col("o_totalprice"))
    c = table(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.round(F.sum(signed), 2).alias("v"))
    per = c.groupBy("o_orderpriority").agg(F.sum(F.greatest("v", F.lit(0.0))).alias("s"), F.max("v").alias("m"))
    m = per.agg(F.greatest(F.max("s"), F.lit(1.0)).alias("s"), F.greatest(F.max("m"), F.lit(1.0)).alias("m"))
    return m.select(S.nice_max(F.col("s")).alias("stacked"), S.nice_max(F.col("m")).alias("clustered"), F.lit(100.0).alias("percent"))


_AXIS = "SELECT p_partkey, (p_size - 25) * 1.5::DOUBLE AS low, (p_size - 25) * 1.5::DOUBLE + p_retailprice / (10 + p_size) AS high, CASE WHEN p_type = 'LARGE' THEN p_size::DOUBLE END AS major FROM part"
_STEP = "(high - low) / 4 / pow(10, floor(log10((high - low) / 4)))"


@register(
    "h6_axis_ticks",
    f"""WITH a AS (SELECT *, coalesce(major, pow(10, floor(log10((high - low) / 4))) * CASE WHEN {_STEP} <= 1 THEN 1 WHEN {_STEP} <= 2 THEN 2 WHEN {_STEP} <= 5 THEN 5 ELSE 10 END) AS unit FROM ({_AXIS})),
v AS (SELECT *, ceil(low / unit) * unit AS first FROM a),
t AS (SELECT *, list_transform(list_filter(range(8), lambda i: first + i * unit <= high + unit * 0.001), lambda i: round(first + i * unit, 6) + 0) AS own FROM v)
SELECT p_partkey, list_transform((CASE WHEN abs(first - low) > unit * 0.001 THEN [low] ELSE [] END || own || CASE WHEN abs(coalesce(own[-1], low) - high) > unit * 0.001 THEN [high] ELSE [] END)[1:7], lambda x: round(x, 6) + 0) AS ticks FROM t""",
)
def axis_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The axis' start, multiples of the unit from there on, and its end; seven at most. Without a unit of its own the axis has a round one for four steps."""
    low = (F.col("p_size") - 25) * 1.5
    d = table(spark, sf_dir, "part").select("p_partkey", low.alias("low"), (low + F.col("p_retailprice") / (10 + F.col("p_size"))).alias("high"), F.when(F.col("p_type") == "LARGE", F.col("p_size").cast("double")).alias("major"))
    return d.select("p_partkey", S.axis_ticks(F.col("low"), F.col("high"), F.col("major")).alias("ticks"))


TURNS_SQL = "SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM conversations"


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "conversations").withColumn("run", F.sum((F.col("role") == "user").cast("int")).over(w))


#: Events of users as runs: a view is an input, an error ends the run in a way that its property tells, a purchase is a result.
RUNS_SQL = """r AS (SELECT *, CAST(props->>'$.k' AS INT) AS k, sum((event_type = 'view')::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM events)"""
_ENDED = "CASE WHEN {k} < 30 THEN 'failed' WHEN {k} < 60 THEN 'stopped' ELSE 'interrupted' END"
_RESULT = "CASE WHEN {v} > 50 THEN 'completed' WHEN {k} < 30 THEN 'stopped' WHEN {k} < 60 THEN 'interrupted' ELSE 'failed' END"


@register(
    "i7_run_summary",
    f"""WITH {RUNS_SQL},
g AS (SELECT user_id, run, min(ts) AS started, arg_max(k, event_id) FILTER (event_type = 'error') AS lk, max(ts) FILTER (event_type = 'error') AS lts, arg_max(k, event_id) FILTER (event_type = 'purchase') AS rk, arg_max(value, event_id) FILTER (event_type = 'purchase') AS rv, max(ts) FILTER (event_type = 'purchase') AS rts,
  arg_max(event_type, event_id) = 'click' AND run = max(run) OVER (PARTITION BY user_id) AS live FROM r WHERE run > 0 GROUP BY user_id, run)
SELECT user_id, run, CASE WHEN lk IS NOT NULL THEN {_ENDED.format(k="lk")} WHEN rk IS NOT NULL THEN {_RESULT.format(k="rk", v="rv")} WHEN live THEN 'running' ELSE 'completed' END AS status,
  greatest(0, (epoch_us(coalesce(lts, rts, (SELECT max(ts) FROM events))) - epoch_us(started)) // 1000) AS duration_ms FROM g""",
)
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each input's run: its lifecycle's end first, else its result, else still running if it is the last one and live, else completed."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    e = e.withColumn("run", F.sum((F.col("event_type") == "view").cast("long")).over(w)).filter("run > 0")
    last = lambda c, kind: F.max_by(F.when(F.col("event_type") == kind, F.col(c)), F.when(F.col("event_type") == kind, F.col("event_id")))
    g = e.groupBy("user_id", "run").agg(F.min("ts").alias("started"), last("k", "error").alias("lk"), last("ts", "error").alias("lts"), last("k", "purchase").alias("rk"), last("value", "purchase").alias("rv"), last("ts", "purchase").alias("rts"), F.max_by("event_type", "event_id").alias("tail"))
    g = g.withColumn("live", (F.col("tail") == "click") & (F.col("run") == F.max("run").over(Window.partitionBy("user_id"))))
    now = table(spark, sf_dir, "events").agg(F.max("ts").alias("now"))  # one row
    status = F.when(F.col("lk").isNotNull(), F.expr(_ENDED.format(k="lk"))).when(F.col("rk").isNotNull(), F.expr(_RESULT.format(k="rk", v="rv"))).when(F.col("live"), "running").otherwise("completed")
    ended = F.coalesce("lts", "rts", "now")
    micros = lambda t: F.unix_micros(t.cast("timestamp"))
    duration = F.greatest(F.lit(0), F.floor((micros(ended) - micros(F.col("started"))) / 1000))
    return g.join(F.broadcast(now), F.lit(True)).select("user_id", "run", status.alias("status"), duration.alias("duration_ms"))


@register("i8_last_retry", "SELECT user_id, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events WHERE event_type = 'error' GROUP BY user_id")
def last_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").filter("event_type = 'error'").groupBy("user_id").agg(F.max("event_id").alias("event_id"), F.max_by("value", "event_id").alias("value"))


@register("i11_compaction", "SELECT user_id, arg_max(event_type = 'signup', event_id) AS compacting FROM events WHERE event_type IN ('signup', 'purchase') GROUP BY user_id")
def compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the last marker is a start."""
    return table(spark, sf_dir, "events").filter("event_type IN ('signup', 'purchase')").groupBy("user_id").agg(F.max_by(F.col("event_type") == "signup", "event_id").alias("compacting"))


@register("i12_weekly", "SELECT (i // 7)::BIGINT AS week, min(day)::VARCHAR AS first_day, sum(n)::BIGINT AS n FROM (SELECT day, n, row_number() OVER (ORDER BY day) - 1 AS i FROM (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1)) GROUP BY 1")
def weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days in groups of seven by position; one row a day, so a single ordered window is small."""
    days = table(spark, sf_dir, "events").groupBy(F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("n"))
    i = F.row_number().over(Window.orderBy("day")) - 1
    return days.withColumn("week", F.floor(i / 7).cast("long")).groupBy("week").agg(F.min("day").cast("string").alias("first_day"), F.sum("n").alias("n"))


@register(
    "i14_task_progress",
    """WITH e AS (SELECT user_id || ':' || ts::DATE AS thread, event_id, event_type, CASE WHEN value > 50 THEN 'todo:' ELSE 'task:' END || (CAST(props->>'$.k' AS INT) // 25) AS key, value > 50 AS todo FROM events),
r AS (SELECT thread, max(event_id) FILTER (event_type = 'signup') AS reset, max(event_id) FILTER (event_type = 'view') AS input, max(event_id) FILTER (event_type <> 'view') AS progress FROM e GROUP BY thread),
s AS (SELECT thread, key, arg_max(event_type, event_id) AS state, any_value(input > progress) AS later FROM e JOIN r USING (thread) WHERE event_type IN ('click', 'purchase', 'error') AND (NOT todo OR reset IS NULL OR event_id > reset) GROUP BY thread, key),
k AS (SELECT *, bool_and(state = 'purchase') OVER (PARTITION BY thread) AS done FROM s WHERE state <> 'error')
SELECT thread, key, state FROM k WHERE NOT (done AND coalesce(later, false))""",
)
def task_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest state of each task of a thread: a full write (signup) clears the todos before it, a delete (error) takes its task away, and a list completed before the latest input (view) is gone."""
    todo = F.col("value") > 50
    key = F.concat(F.when(todo, "todo:").otherwise("task:"), F.floor(F.get_json_object("props", "$.k").cast("int") / 25).cast("string"))
    e = table(spark, sf_dir, "events").select(F.concat(F.col("user_id").cast("string"), F.lit(":"), F.col("ts").cast("date").cast("string")).alias("thread"), "event_id", "event_type", key.alias("key"), todo.alias("todo"))
    latest = lambda kind: F.max(F.when(kind, F.col("event_id")))
    kind = F.col("event_type")
    r = e.groupBy("thread").agg(latest(kind == "signup").alias("reset"), latest(kind == "view").alias("input"), latest(kind != "view").alias("progress"))
    s = e.join(r, "thread").filter(kind.isin("click", "purchase", "error") & (~F.col("todo") | F.col("reset").isNull() | (F.col("event_id") > F.col("reset"))))
    s = s.groupBy("thread", "key").agg(F.max_by("event_type", "event_id").alias("state"), F.any_value(F.col("input") > F.col("progress")).alias("later")).filter("state <> 'error'")
    done = F.bool_and(F.col("state") == "purchase").over(Window.partitionBy("thread"))
    return s.withColumn("done", done).filter(~(F.col("done") & F.coalesce("later", F.lit(False)))).select("thread", "key", "state")


@register("i18_links_of_turn", "SELECT page_id % 11 AS turn, regexp_replace(url, '[#?].*$', '') AS link, min(page_id) AS page_id FROM pages GROUP BY ALL")
def links_of_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").groupBy((F.col("page_id") % 11).alias("turn"), F.regexp_replace("url", "[#?].*$", "").alias("link")).agg(F.min("page_id").alias("page_id"))


@register("c19_tool_results", "SELECT u.event_id, min(r.event_id) AS result FROM events u LEFT JOIN events r ON r.user_id = u.user_id AND r.event_type = 'purchase' AND r.event_id > u.event_id WHERE u.event_type = 'click' GROUP BY u.event_id")
def tool_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each use the next result of the same thread; one ordered window, no pairs."""
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(1, Window.unboundedFollowing)
    e = table(spark, sf_dir, "events").filter("event_type IN ('click', 'purchase')")
    return e.withColumn("result", F.min(F.when(F.col("event_type") == "purchase", F.col("event_id"))).over(w)).filter("event_type = 'click'").select("event_id", "result")


@register("m1_event_blocks", r"""WITH b AS (SELECT event_id, 'event: ' || event_type || chr(10) || ': note' || chr(10) || CASE WHEN event_id % 4 = 0 THEN '' ELSE 'data:' || props || chr(10) || 'data: ' || user_id END AS block FROM events),
l AS (SELECT event_id, unnest(string_split(block, chr(10))) AS line, unnest(range(4)[:len(string_split(block, chr(10)))]) AS i FROM b)
SELECT event_id, max(regexp_replace(line, '^event: ?', '')) FILTER (starts_with(line, 'event:')) AS event, string_agg(regexp_replace(line, '^data: ?', ''), chr(10) ORDER BY i) FILTER (starts_with(line, 'data:')) AS data FROM l GROUP BY event_id HAVING count(*) FILTER (starts_with(line, 'data:')) > 0""")
def event_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event and data of each block of an event stream: comments go, data lines are joined, a block without data is none."""
    data = F.concat(F.lit("data:"), F.col("props"), F.lit("\ndata: "), F.col("user_id").cast("string"))
    block = F.concat(F.lit("event: "), F.col("event_type"), F.lit("\n: note\n"), F.when(F.col("event_id") % 4 == 0, "").otherwise(data))
    lines = F.filter(F.split(F.regexp_replace(block, "\r\n", "\n"), "\n"), lambda x: (x != "") & ~x.startswith(":"))
    of = lambda field: F.transform(F.filter(lines, lambda x: x.startswith(field + ":")), lambda x: F.regexp_replace(x, f"^{field}: ?", ""))
    d = table(spark, sf_dir, "events").select("event_id", of("event").alias("e"), of("data").alias("d")).filter(F.size("d") > 0)
    return d.select("event_id", F.try_element_at("e", F.lit(-1)).alias("event"), F.array_join("d", "\n").alias("data"))


#: Bytes of a piece of a stream: a prime, so that cuts fall anywhere.
PIECE = 97


def stream_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stream, seq, data): each conversation as an event stream, a block a turn, with line ends of both sorts, cut into pieces of bytes."""
    end = F.when(F.col("turn") % 2 == 0, "\n").otherwise("\r\n")
    lines = F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit("data: "), x))
    block = F.concat(F.lit(": turn"), end, F.lit("event:"), F.col("role"), end, F.array_join(lines, "\n"), end, end)
    d = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("stream")).agg(F.array_sort(F.collect_list(F.struct("turn", block.alias("block")))).alias("blocks"))
    whole = F.encode(F.array_join(F.transform("blocks", lambda b: b["block"]), ""), "utf-8")
    d = d.select("stream", whole.alias("whole")).withColumn("seq", F.explode(F.sequence(F.lit(0), F.floor((F.octet_length("whole") - 1) / PIECE).cast("int"))))
    return d.select("stream", F.col("seq").cast("long").alias("seq"), F.substring("whole", F.col("seq") * PIECE + 1, F.lit(PIECE)).alias("data"))


@register("m2_framed_events", "SELECT conv_id AS stream, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, role AS event, text AS data FROM conversations")
def framed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.events(stream_pieces(spark, sf_dir))


@register("m5_segments", "SELECT conv_id, turn, coalesce(sum((role = 'assistant')::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS segment FROM conversations")
def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce(F.sum((F.col("role") == "assistant").cast("int")).over(w), F.lit(0)).cast("long").alias("segment"))


@register("m6_unique_records", "SELECT user_id, event_type, min(event_id) AS place, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id, event_type")
def unique_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record for each identity: the latest, at the place of the first."""
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("place"), F.max("event_id").alias("event_id"), F.max_by("value", "event_id").alias("value"))


USAGE = """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '{"input_tokens":' || CAST(user_id AS VARCHAR(8)) || ',"output_tokens":' || CAST(event_id % 50 AS VARCHAR(8)) || ',"input_tokens_details":{"cached_tokens":' || CAST(event_id % 7 AS VARCHAR(8)) || '}}' WHEN event_id % 3 = 1 THEN '{"prompt_tokens":' || CAST(user_id AS VARCHAR(8)) || ',"completion_tokens":' || CAST(event_id % 50 AS VARCHAR(8)) || ',"total_tokens":' || CAST(event_id % 40 AS VARCHAR(8)) || '}' ELSE '{}' END AS usage FROM events"""


@register("m12_usage", f"""WITH u AS (SELECT event_id, usage AS j FROM ({USAGE})),
n AS (SELECT event_id, coalesce(nullif(coalesce((j->>'$.input_tokens')::BIGINT, 0), 0), (j->>'$.prompt_tokens')::BIGINT, 0) AS input, coalesce(nullif(coalesce((j->>'$.output_tokens')::BIGINT, 0), 0), (j->>'$.completion_tokens')::BIGINT, 0) AS output,
 coalesce((j->>'$.input_tokens_details.cached_tokens')::BIGINT, 0) AS cached, coalesce((j->>'$.total_tokens')::BIGINT, 0) AS total FROM u)
SELECT event_id, input, output, cached, coalesce(nullif(total, 0), input + output) AS total FROM n WHERE input > 0 OR output > 0 OR total > 0""")
def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens from either shape of a provider's payload; without any there is no row."""
    e = table(spark, sf_dir, "events")
    u = e.selectExpr("event_id", USAGE.removeprefix("SELECT event_id, ").removesuffix(" FROM events"))
    of = lambda *paths: F.coalesce(*[F.nullif(F.get_json_object("usage", p).cast("long"), F.lit(0).cast("long")) for p in paths], F.lit(0).cast("long"))
    d = u.select("event_id", of("$.input_tokens", "$.prompt_tokens").alias("input"), of("$.output_tokens", "$.completion_tokens").alias("output"), of("$.input_tokens_details.cached_tokens", "$.prompt_tokens_details.cached_tokens").alias("cached"), of("$.total_tokens", "$.total").alias("t"))
    d = d.filter("input > 0 OR output > 0 OR t > 0")
    return d.select("event_id", "input", "output", "cached", F.when(F.col("t") > 0, F.col("t")).otherwise(F.col("input") + F.col("output")).alias("total"))


@register("d27_ratio_class", "SELECT p_partkey, CASE WHEN r > 2.0 THEN 'Ultra-wide' WHEN r > 1.5 THEN 'Wide landscape' WHEN r > 1.2 THEN 'Standard landscape' WHEN r > 0.8 THEN 'Near square' ELSE 'Portrait' END AS class FROM (SELECT p_partkey, p_size::DOUBLE / (1 + p_partkey % 30) AS r FROM part)")
def ratio_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("p_size").cast("double") / (1 + F.col("p_partkey") % 30)
    return table(spark, sf_dir, "part").select("p_partkey", F.when(r > 2.0, "Ultra-wide").when(r > 1.5, "Wide landscape").when(r > 1.2, "Standard landscape").when(r > 0.8, "Near square").otherwise("Portrait").alias("class"))
