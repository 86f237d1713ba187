import math
import random
from collections import Counter

import numpy as np
import pytest
from paths import SMALL
from pyspark.sql import functions as F

from lakewright.operators import search, text_index
from lakewright.plans import catalog
from lakewright.plans import search as plans

ROW = "id long, file string, file_name string, file_path string, source_path string, title string, citation string, text string, source_label string, section_title string"


def test_query_phrases():
    many = " ".join(f"t{i}" for i in range(20))
    assert text_index.query_phrases("Full-text ﬁle x x - Straße_É " + many) == ["full text", "file", "x", "x", "straße e", *[f"t{i}" for i in range(6)]]
    assert text_index.query_phrases("") == text_index.query_phrases(" -- _ ") == []


def brute_bm25(rows, queries, limit):
    """rows: (id, texts of the columns); queries: (q, text). Each phrase of a query counts, repeated ones again."""
    tokens = {k: [text_index.words(t or "") for t in texts] for k, texts in rows}
    size = {k: sum(map(len, t)) for k, t in tokens.items()}
    average = sum(size.values()) / len(rows)

    def tf(k, phrase):
        p = phrase.split(" ")
        return sum(w[i : i + len(p)] == p for w in tokens[k] for i in range(len(w)))

    out = []
    for q, text in queries:
        score = Counter()
        for phrase in text_index.query_phrases(text or ""):
            hits = {k: n for k in tokens if (n := tf(k, phrase))}
            idf = max(math.log((len(rows) - len(hits) + 0.5) / (len(hits) + 0.5)), 1e-6)
            for k, n in hits.items():
                score[k] += idf * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * size[k] / average))
        best = sorted((round(-s, 6), k) for k, s in score.items())[:limit]
        out += [(q, k, r, i) for i, (r, k) in enumerate(best, 1)]
    return sorted(out)


def small_rows(rng):
    """Few words, some with accents, rows without any, columns that are null, equal rows."""
    word = lambda: rng.choice(["alpha", "Beta", "béta", "gamma", "x-y", "1_2", "ß", "a", "a a"])
    text = lambda n: rng.choice([None, "", *[" ".join(word() for _ in range(rng.randint(1, n))) for _ in range(6)]])
    rows = [(i, rng.choice(["f", "g", None]), *[text(3) for _ in range(5)], text(30), text(2), text(3)) for i in range(120)]
    return rows + [(200 + i, *rows[i][1:]) for i in range(20)]


@pytest.mark.parametrize("block", [4096, 7])
def test_bm25_is_the_brute_force_one(spark, block):
    """Also in blocks of 7 rows and of 5 queries."""
    rng = random.Random(3)
    rows = small_rows(rng)
    queries = [(i, rng.choice([None, "", "nothing", "alpha beta-gamma", "x-y a_a BETA x y", "a a a", "1-2 ß alpha"])) for i in range(30)]
    index = text_index.build(spark.createDataFrame(rows, ROW), block_rows=block)
    assert (index.blocks > 10) == (block == 7)
    got = text_index.bm25(index, spark.createDataFrame(queries, "q long, query string"), 9, block_queries=5 if block == 7 else 4096)
    order = [ROW.split(", ").index(f"{c} string") for c in text_index.COLUMNS]
    assert sorted((r.q, r.key, round(r["rank"], 6), r.nr) for r in got.collect()) == brute_bm25([(r[0], [r[i] for i in order]) for r in rows], queries, 9)


def test_empty_tables(spark):
    none, rows = spark.createDataFrame([], ROW), spark.createDataFrame([(1, *["a"] * 9)], ROW)
    asked = spark.createDataFrame([(1, "a", [1.0])], "q long, query string, vector array<float>")
    vectors = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")
    assert text_index.bm25(text_index.build(none), asked).count() == 0
    assert text_index.bm25(text_index.build(rows), asked.limit(0)).count() == 0
    assert search.hybrid(none, vectors.limit(0), asked).count() == search.hybrid(rows, vectors, asked.limit(0)).count() == 0
    # a side without rows leaves the other one
    assert [r.id for r in search.hybrid(rows, vectors.limit(0), asked).collect()] == [r.id for r in search.hybrid(rows, vectors, asked.selectExpr("q", "'b' AS query", "vector")).collect()] == [1]


@pytest.mark.parametrize("block", [4096, 6])
def test_nearest_is_the_brute_force_one(spark, block):
    rng = random.Random(4)
    point = lambda: [float(rng.randint(0, 2)) for _ in range(3)]
    rows = [(i, point(), i % 3) for i in range(150)] + [(300, None, 0), (301, [1.0], 0), (302, [None, 1.0, 1.0], 0)]
    probes = [(i, point()) for i in range(20)] + [(50, None), (51, [1.0, 2.0])]
    got = search.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), spark.createDataFrame(probes, "q long, vector array<float>"), 8, extra=("label",), block=block)
    want = []
    for q, p in probes:
        near = sorted((sum((a - b) ** 2 for a, b in zip(v, p)), k, label) for k, v, label in rows if v and p and len(v) == len(p) and None not in v)[:8]
        want += [(q, k, label, d, 1 / (1 + d), i) for i, (d, k, label) in enumerate(near, 1)]
    assert sorted((r.q, r.key, r.label, r.distance, r.score, r.nr) for r in got.collect()) == sorted(want)


def test_candidates_of_a_file_are_capped_before_the_cut(spark):
    found = spark.createDataFrame([(1, i, "a" if i < 6 else "b") for i in range(1, 9)], "q long, nr int, file string")
    assert [(r.nr, r.file) for r in search.capped(found, 4, "file", 2).orderBy("nr").collect()] == [(1, "a"), (2, "a"), (3, "b"), (4, "b")]


def hits(spark, rows):
    return spark.createDataFrame([(1, *r) for r in rows], "q long, id long, file string, v_score double, rv int, t_rank double, rt int, both boolean, blended double")


def test_diversify_takes_each_file_first(spark):
    rows = [(i, f, 1.0 - i / 10, i, None, None, False, 1.0 - i / 10) for i, f in enumerate("aaab")]
    got = search.diversify(hits(spark, rows), 3).orderBy("pos").collect()
    assert [r.id for r in got] == [0, 3, 1] and got[0].final_score == 1.0
    alone = [(i, "a", 1.0, i, None, None, False, 1.0 - i / 10) for i in range(4)]
    assert [r.id for r in search.diversify(hits(spark, alone), 6).orderBy("pos").collect()] == [0, 1]


def fused(spark, v, t):
    vectors = spark.createDataFrame([(1, i, n, s) for n, (i, s) in enumerate(v, 1)], "q long, id long, nr int, score double")
    return search.fuse(vectors, spark.createDataFrame([(1, i, n, s) for n, (i, s) in enumerate(t, 1)], "q long, id long, nr int, rank double"))


def test_both_sides_come_first_and_a_side_may_miss(spark):
    both = {r.id: r for r in fused(spark, [(1, 0.91), (2, 0.82)], [(1, -3.1), (3, -2.7)]).collect()}
    assert both[1].both and both[1].blended == 1 / 61 + 1.12 / 61 + 0.003 and both[2].blended == 1 / 62 and both[3].blended == 1.12 / 62
    assert [r.id for r in fused(spark, [], [(5, -2.0)]).collect()] == [5]


def test_anchors_break_ties(spark):
    rows = spark.createDataFrame([(1, None, "", None), (2, "Slide 5", None, None), (3, None, None, "Title"), (4, "x", "y", "z")], "id long, source_label string, slide string, title string")
    assert [round(r[0], 4) for r in rows.select(search.anchor_bonus(rows)).collect()] == [0, 0.0015, 0.0012, 0.0027]


def test_each_branch_of_the_queries_has_rows(spark):
    """Candidates of one side and of both, rows with every bonus, phrases of several words, queries without a vector."""
    found = plans._candidates(spark, SMALL).groupBy("both", (F.col("rv").isNotNull()).alias("v"), F.round("bonus", 4).alias("bonus")).count().collect()
    assert {(r.both, r.v) for r in found} == {(True, True), (False, True), (False, False)} and {r.bonus for r in found} == {0.0, 0.0012, 0.0027}
    asked = plans.queries(spark, SMALL)
    assert 0 < asked.filter("vector IS NULL").count() < asked.count()
    assert text_index.phrases_of(asked).filter("phrase LIKE '% %'").count() >= asked.count()


def test_lists_and_blocks_stay_few(spark):
    """One posting for a term of a lot, however many rows have it; and no more blocks than BLOCKS before blocks are full."""
    rows = spark.createDataFrame([(i, *["same words"] * 9) for i in range(400)], ROW).coalesce(1)
    index = text_index.build(rows, block_rows=10)
    assert index.blocks == text_index.BLOCKS and index.average == 16.0
    terms = index.postings.filter("term IS NOT NULL")
    assert terms.count() == 2 * 40 and terms.selectExpr("sum(size(rows))", "sum(aggregate(tfs, 0, (a, x) -> a + x))", "sum(size(at))").first() == (800, 6400, 6400)
    asked = spark.createDataFrame([(i, "same words-same") for i in range(30)], "q long, query string")
    got = text_index.bm25(index, asked, 3, block_queries=7).collect()
    assert sorted((r.q, r.key) for r in got) == [(q, k) for q in range(30) for k in range(3)]


def test_rows_that_cannot_be_among_the_best_are_left_out(spark):
    """The best rows of a block for a least score: those of all rows that reach it, whatever phrases are looked up and not added."""
    rng = random.Random(8)
    rows = [(i, *["f"] * 5, " ".join(rng.choice("aaaaaabbbccd") * rng.randint(1, 2) for _ in range(rng.randint(1, 12))), "", "") for i in range(300)]
    index = text_index.build(spark.createDataFrame([(r[0], None, *r[1:]) for r in rows], ROW).coalesce(1))
    have = index.postings.withColumnRenamed("term", "phrase").drop("at").toArrow()
    block = text_index._Block(have, index.average)
    for _ in range(60):
        ask = np.array([rng.randrange(len(block.names)) for _ in range(rng.randint(1, 8))])
        idf = np.array([rng.random() * 5 + 1e-6 for _ in ask])
        sums = np.zeros(300)
        for p, w in zip(ask, idf):
            a, b = block.edge[p], block.edge[p + 1]
            sums[block.row[a:b]] += w * block.value[a:b]
        want = [(float(round(-s, 6)), int(block.keys[i])) for i, s in enumerate(sums) if s]
        for least in (0.0, *sorted(sums)[-8:-3:4]):
            keys, rank = block.best(ask, idf, 5, least)
            assert list(zip(np.round(rank, 6).tolist(), keys.tolist()))[:5] == [x for x in sorted(want)[:5] if -x[0] >= least - text_index.MARGIN]


def exchanged(df):
    """How many rows the shuffles of a DataFrame's own plan, once it is run, have passed on."""
    df.collect()
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        name, inner = p.nodeName(), p.children()
        if name.startswith("AdaptiveSparkPlan"):
            todo.append(p.executedPlan())
        elif name.endswith("QueryStage"):
            todo.append(p.plan())
        elif name.startswith("Exchange"):
            total += p.metrics().apply("shuffleRecordsWritten").value()
        todo += [inner.apply(i) for i in range(inner.size())]
    return total


def test_lists_queries_and_best_rows_are_passed_on_packed(spark):
    """A few rows for each pair of a block and a chunk of queries, however many words, queries and best rows there are."""
    rows = spark.createDataFrame([(i, *["same words"] * 9) for i in range(400)], ROW).coalesce(1)
    index = text_index.build(rows, block_rows=10)
    asked = spark.createDataFrame([(i, "same words-same") for i in range(40)], "q long, query string")
    found = text_index.bm25(index, asked, 20)
    assert 0 < exchanged(found) <= 3 * index.blocks and found.count() == 800
    words = spark.createDataFrame([(i, f"w{i}") for i in range(500)] + [(500, "same"), (501, "same words")], "id long, phrase string").coalesce(1)
    lists = text_index.block_lists(text_index.build(rows.withColumn("text", F.concat_ws(" ", *[F.lit(f"w{i}") for i in range(500)]))), words)
    assert [list(r) for r in lists.select(F.size("ids"), F.expr("aggregate(dfs, 0L, (a, x) -> a + x)")).collect()] == [[502, 502 * 400]]
    assert exchanged(lists) < 50


def test_blocks_are_of_a_size(spark):
    rows = spark.createDataFrame([(i, *["same words"] * 9) for i in range(1024)], ROW).repartition(13)
    index = text_index.build(rows, block_rows=4)
    sizes = [r[1] for r in index.postings.filter("term IS NULL").groupBy("block").agg(F.sum(F.size("keys"))).collect()]
    assert index.blocks == len(sizes) == 16 and sum(sizes) == 1024 and max(sizes) <= 1.2 * 64


@pytest.mark.parametrize("chunk", [3, 2048])
def test_groups_of_blocks_and_chunks_of_queries(spark, monkeypatch, chunk):
    """Several blocks in a task, several chunks for a task, several tasks for a block: the brute force rows."""
    monkeypatch.setattr(text_index, "GROUPS", 5)
    monkeypatch.setattr(text_index, "CHUNK", chunk)
    rng = random.Random(5)
    rows = small_rows(rng)
    queries = [(i, rng.choice([None, "", "nothing", "alpha beta-gamma", "x-y a_a BETA x y", "a a a", "1-2 ß alpha", "beta-gamma-alpha a"])) for i in range(40)]
    index = text_index.build(spark.createDataFrame(rows, ROW).coalesce(2), block_rows=7)
    got = text_index.bm25(index, spark.createDataFrame(queries, "q long, query string"), 4, block_queries=15)
    order = [ROW.split(", ").index(f"{c} string") for c in text_index.COLUMNS]
    assert sorted((r.q, r.key, round(r["rank"], 6), r.nr) for r in got.collect()) == brute_bm25([(r[0], [r[i] for i in order]) for r in rows], queries, 4)


def test_probes_and_their_nearest_rows_are_passed_on_packed(spark):
    """A row for each vector, probe and block, and one for the best rows of a block's chunk of probes: not one for each of these."""
    rng = random.Random(6)
    point = lambda: [rng.random() for _ in range(4)]
    rows = spark.createDataFrame([(i, point()) for i in range(400)], "vec_id long, embedding array<double>")
    probes = spark.createDataFrame([(i, point()) for i in range(60)], "q long, vector array<double>")
    found = search.nearest(rows, probes, 30, block=25)
    assert exchanged(found) <= 400 + 60 * 16 + 16 and found.count() == 1800


def test_nearest_over_tiles_and_chunks(spark, monkeypatch):
    """More rows than a tile, and several chunks and blocks of probes, with equal distances and vectors that are not finite."""
    rng = np.random.default_rng(7)
    a, b, keys = rng.integers(0, 4, (9000, 5)).astype(float), rng.integers(0, 4, (9, 5)).astype(float), rng.permutation(9000)
    probe, row, d = search._nearest(a, keys, b, 20)
    for i in range(9):
        all_ = ((a - b[i]) ** 2).sum(axis=1)
        best = np.lexsort((keys, all_))[:20]
        assert row[probe == i].tolist() == best.tolist() and d[probe == i].tolist() == all_[best].tolist()
    monkeypatch.setattr(text_index, "CHUNK", 4)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(a[:60])] + [(100, [float("inf")] * 5)]
    probes = [(i, [float(x) for x in v]) for i, v in enumerate(np.concatenate([b, b[:8]]))]
    got = search.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), spark.createDataFrame(probes, "q long, vector array<double>"), 61, block=2)
    want = [(q, k, sum((x - y) ** 2 for x, y in zip(v, p))) for q, p in probes for k, v in rows]
    assert sorted((r.q, r.key, r.distance) for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("name", ["f5_anchor_bonus", "f6_hybrid_search"])
def test_both_sides_of_the_fused_queries_are_passed_on_packed(spark, monkeypatch, name):
    """Vectors, probes and what is joined are passed on as rows, all else as a few packed ones."""
    steps = {}
    monkeypatch.setattr(search, "materialize", lambda df, step: steps.setdefault(step, df))
    assert catalog.queries()[name](spark, SMALL).count() > 0
    vectors, probes = (spark.read.parquet(f"{SMALL}/embeddings.parquet").filter(f"vec_id % {n} = 0").count() for n in (1, plans.EVERY))
    assert vectors <= exchanged(steps["fused"]) <= vectors + probes + 100 + 2 * steps["fused"].count()
