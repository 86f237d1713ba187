import hashlib
import random
import time
from bisect import bisect_left, bisect_right

import pytest
from paths import TINY
from pyspark.sql import functions as F

from lakewright.operators import ordered
from lakewright.operators.relational import as_of
from lakewright.plans import windows
from lakewright.session import table
from lakewright.streaming import timeline


@pytest.fixture(autouse=True)
def ranges(spark):
    """Small tables would be put together in one range."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def even(d):
    """d, after a look at its ranges: none above twice the mean."""
    sizes = [r["count"] for r in d.groupBy("_range").count().collect()]
    assert len(sizes) >= 6 and max(sizes) <= 2 * sum(sizes) / len(sizes), sizes
    return d


@pytest.mark.parametrize("reverse", [False, True])
def test_as_of_with_one_key_in_nine_rows_of_ten(spark, monkeypatch, reverse):
    rng = random.Random(16)
    keys = sorted({rng.randint(0, 500) for _ in range(40)})
    right = [(k, f"v{k}") for k in keys] + [(keys[3], "a"), (None, "x"), (600, None)]
    left = [(i, 250 if i % 10 else rng.choice([None, rng.randint(-20, 620)])) for i in range(20_000)]
    seen, keep = [], ordered.in_ranges
    monkeypatch.setattr(ordered, "in_ranges", lambda *a: seen.append(even(keep(*a))) or seen[-1])
    got = as_of(spark.createDataFrame(left, "id long, x int"), spark.createDataFrame(right, "at int, value string"), "x", "at", "value", reverse)
    for r in got.collect():
        i = None if r.x is None else bisect_left(keys, r.x) if reverse else bisect_right(keys, r.x) - 1
        assert r.value == (None if i is None or not 0 <= i < len(keys) else f"v{keys[i]}"), r
    assert seen and got.count() == len(left)


@pytest.mark.parametrize("by", [(), ("g",), ("g", "h")])
def test_places_and_sums(spark, monkeypatch, by):
    """Groups of nine rows in ten, null keys and values, groups that many ranges cut."""
    rng = random.Random(41)
    rows = [(i, rng.choice(["hot"] * 18 + ["a", None]), rng.choice([1, 2, None]), rng.choice([None, 0, 5, -3, 1 << 40])) for i in range(20_000)]
    keep = ordered.in_ranges
    monkeypatch.setattr(ordered, "in_ranges", lambda *a: even(keep(*a)))
    got = ordered.running(spark.createDataFrame(rows, "id long, g string, h int, v long"), [F.col("id").desc()], by, "v")
    so_far, want = {}, {}
    for i, g, h, v in sorted(rows, reverse=True, key=lambda r: r[0]):
        key = tuple({"g": g, "h": h}[b] for b in by)
        n, t = so_far.get(key, (0, 0))
        so_far[key] = want[i] = (n + 1, t + (v or 0))
    assert {r.id: (r.place, r.total) for r in got.collect()} == want


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id long, v long")
    assert ordered.running(none, [F.col("id")], (), "v").count() == ordered.running(none, [F.col("id")], ("v",)).count() == 0
    left = spark.createDataFrame([(1, 2)], "id long, x long")
    assert [r.v for r in as_of(left, none, "x", "id", "v").collect()] == [None] and as_of(left.limit(0), none, "x", "id", "v").count() == 0


def test_plans_have_no_single_partition(spark):
    d = ordered.running(table(spark, TINY, "part").select("p_partkey", "p_size"), [F.col("p_size"), F.col("p_partkey")])
    assert "SinglePartition" not in d._jdf.queryExecution().toString()


def test_eviction_has_entries_of_each_sort(spark):
    found = windows.eviction(spark, TINY).join(table(spark, TINY, "events").select("event_id", "ts"), "event_id")
    last = found.agg(F.max("ts")).first()[0]
    young = (F.lit(last) - F.col("ts")) <= F.expr(f"INTERVAL {windows.MAX_DAYS} DAYS")
    assert {(r.young, r.kept) for r in found.select(young.alias("young"), "kept").distinct().collect()} == {(False, False), (True, False), (True, True)}


def test_running_digests(spark):
    rows = [(k, i, t) for k in (1, None, 2) for i, t in enumerate(["a", None, "", "é日", "b" * 100])]
    got = timeline.running_digests(spark.createDataFrame(rows, "conv_id long, turn long, text string"), "conv_id", "turn", "text").collect()
    for r in got:
        text = "".join(t or "" for k, i, t in rows if k == r.conv_id and i <= r.turn)
        assert (r.digest, r.length) == (hashlib.md5(text.encode()).hexdigest(), len(text))
    assert len(got) == len(rows)


def test_time_is_in_proportion_to_a_conversation(spark):
    def seconds(n):
        d = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("some words of a record ").alias("text"))
        began = time.time()
        assert timeline.running_digests(d, "conv_id", "turn", "text").agg(F.max("length")).first()[0] == 23 * n
        return time.time() - began

    seconds(1000)
    # quadratic work would be 100 GB of text
    assert seconds(100_000) < 60
