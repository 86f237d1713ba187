"""Each branch of these queries has rows, at a scale at which they are compared with SQL; and rules on small examples."""

import random

import pytest
from paths import SMALL, TINY
from pyspark.sql import functions as F

from lakewright.functions import sheets
from lakewright.operators.relational import merge_by_id
from lakewright.plans import catalog, states, workspace


@pytest.mark.parametrize(
    "name, column, values",
    [
        ("b15_file_status", "status", {"idle", "queued", "indexing", "failed", "cancelled", "skipped", "partial", "indexed"}),
        ("i7_run_summary", "status", {"failed", "stopped", "interrupted", "completed", "running"}),
        ("d2_conditional_counts", "status", {"idle", "failed", "indexed", "indexing", "queued"}),
        ("e2_length_cap", "cut", {True, False}),
        ("e31_first_rule", "class", {"treated", "machine", "spare", "worn", "other"}),
        ("i15_budgeted_eviction", "kept", {True, False}),
        ("l1_merge_by_file", "action", {"update", "insert", "delete", "keep"}),
        ("l16_proposals", "status", {"pending", "failed", "accepted"}),
        ("l6_replace_scope", "version", {"old", "new"}),
        ("d20_repeated_lines", "zone", {"head", "foot"}),
    ],
)
def test_values(spark, name, column, values):
    assert {r[0] for r in catalog.queries()[name](spark, SMALL).select(column).distinct().collect()} == values


@pytest.mark.parametrize(
    "name, conditions",
    [
        ("e29_mojibake", ["score = 0", "score > 0 AND score % 70 <> 0", "score > 1000"]),
        ("d21_markdown_statistics", ["headings > 0", "links > 0", "images > 0", "tables > 0"]),
        ("l16_proposals", ["proposals = 1", "proposals > 3"]),
        ("c26_same_source", ["event_id = first_source", "event_id > first_source"]),
        ("e35_lecture_week", ["week IS NULL", "week = 12"]),
        ("e7_section_budget", ["n > 0"]),
        ("h6_axis_ticks", ["size(ticks) = 7", "size(ticks) < 7", "ticks[0] < 0", "ticks[0] >= 0"]),
        ("i14_task_progress", ["state = 'click'", "state = 'purchase'"]),
    ],
)
def test_conditions(spark, name, conditions):
    d = catalog.queries()[name](spark, SMALL)
    counts = d.agg(*[F.count_if(F.expr(c)) for c in conditions]).first()
    assert all(counts), counts


def test_a_budget_is_used_up(spark):
    taken = catalog.queries()["e7_section_budget"](spark, SMALL).groupBy("lang").agg(F.sum("n").alias("n")).collect()
    assert max(r.n for r in taken) == 900_000 and min(r.n for r in taken) < 900_000


def brute_names(wishes, taken):
    clean = lambda n: " ".join(n.split()).lower()
    used = set(map(clean, taken))
    own = {clean(n) for _, n in wishes}
    out = {}
    for i, name in sorted(wishes):
        key, n = clean(name), 1
        while (found := key if n == 1 else f"{key} {n}") in used or (n > 1 and found in own):
            n += 1
        used.add(found)
        out[i] = name.strip() if n == 1 else f"{name.strip()} {n}"
    return out


def test_smallest_unused_numbers(spark):
    rng = random.Random(21)
    word = lambda: rng.choice(["ring", " Ring", "ring 2", "RING  2", "ring 3", "ring 10", "ring 02", "rod", "ring 2 2", "2"])
    wishes, taken = [(i, word()) for i in range(120)], [rng.choice(["ring", "ring 5", "Rod 2", "ring 7", "rod 3", "ring 2 4"]) for _ in range(8)]
    got = states.name_apart(spark.createDataFrame(wishes, "id long, name string"), spark.createDataFrame([(t,) for t in taken], "name string")).collect()
    assert {r.id: r.name for r in got} == brute_names(wishes, taken)
    assert len({" ".join(r.name.split()).lower() for r in got} | {" ".join(t.split()).lower() for t in taken}) == len(got) + len({" ".join(t.split()).lower() for t in taken})


def test_names_of_the_query_are_apart(spark):
    d = states.unique_names(spark, TINY)
    assert d.select(F.lower("name")).distinct().count() == d.count()


def test_merge(spark):
    schema = "id long, file string, v string"
    target = spark.createDataFrame([(1, "a", "old"), (2, "a", "old"), (3, "b", "old"), (4, None, "old")], schema)
    source = spark.createDataFrame([(1, "a", "new"), (5, "a", "new"), (6, "c", "new")], schema)
    assert {tuple(r) for r in merge_by_id(target, source, "id", "file").collect()} == {(1, "a", "new", "update"), (2, "a", "old", "delete"), (3, "b", "old", "keep"), (4, None, "old", "keep"), (5, "a", "new", "insert"), (6, "c", "new", "insert")}
    assert {r.action for r in merge_by_id(target, source.limit(0), "id", "file").collect()} == {"keep"}
    assert {r.action for r in merge_by_id(target.limit(0), source, "id", "file").collect()} == {"insert"}


@pytest.mark.parametrize("path, week", [("/Lecture/Week 3/a.pdf", 3), ("/Lecture/wk12/a", 12), ("Week 3", 3), ("/biweek 3/a", None), ("/wk3 notes.md", None), ("/第 5 周/a", 5), ("\\x\\WEEK 7\\a", 7), ("/Week 0/a", None), ("/Week 123/a", None)])
def test_week_parts(spark, path, week):
    assert spark.range(1).select(workspace.lecture_week(F.lit(path))).first()[0] == week


@pytest.mark.parametrize("x, weeks", [("", "1,2,3,4,5,6"), ("整学期", "1,2,3,4,5,6"), ("单数周", "1,3,5"), ("5 至 3", "3,4,5"), ("even; 1", "1,2,4,6"), ("nothing", "1,2,3,4,5,6"), ("2~3, 9", "2,3"), ("99", "1,2,3,4,5,6")])
def test_week_expressions(spark, x, weeks):
    assert spark.range(1).select(F.array_join(workspace.named_weeks(F.lit(x), 6), ",")).first()[0] == weeks


@pytest.mark.parametrize("low, high, unit, ticks", [(0.0, 100.0, None, [0, 50, 100]), (-7.0, 13.0, 5.0, [-7, -5, 0, 5, 10, 13]), (0.0, 7.0, 1.0, [0, 1, 2, 3, 4, 5, 6]), (3.0, 3.0, 1.0, [3]), (0.0, 0.8, None, [0, 0.2, 0.4, 0.6, 0.8])])
def test_ticks(spark, low, high, unit, ticks):
    got = spark.range(1).select(sheets.axis_ticks(F.lit(low), F.lit(high), F.lit(unit).cast("double"))).first()[0]
    assert got == ticks


def test_an_expression_is_read_once_a_row_not_for_each_week_or_tick(spark):
    weeks = str(workspace.named_weeks(F.col("x"), 16)).lower()
    assert "regexp" in weeks and not any(w in weeks[weeks.rindex("filter(") :] for w in ("regexp", "rlike"))
    ticks = str(sheets.axis_ticks(F.col("a"), F.col("b"), F.col("c"))).lower()
    assert ticks.count("log10") == str(sheets.tick_unit(F.col("a"))).lower().count("log10")
