import random

import numpy as np
import pytest
import xxhash
from cases import documents, nothing

from lakewright.llm import embeddings, simhash
from lakewright.session import table

TINY, SMALL = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(keys, linked):
    root = list(range(len(keys)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(keys)):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, k in enumerate(keys):
        if k is not None:
            least[find(i)] = min(least.get(find(i), k), k)
    return [least.get(find(i)) for i in range(len(keys))]


@pytest.mark.parametrize("which", ["cases", "tiny", "nothing"])
def test_simhash(spark, which):
    d = {"cases": documents, "nothing": nothing, "tiny": lambda s: table(s, TINY, "documents")}[which](spark)
    rows = [(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()]
    prints = [brute_print(t) for _, t in rows]
    comp = classes([k for k, _ in rows], lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 3)
    want = sorted([(k, f"{p:016x}", c) for (k, _), p, c in zip(rows, prints, comp)], key=repr)
    assert sorted(map(tuple, simhash.near_duplicates(d).collect()), key=repr) == want


def test_buckets_find_all_near_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 40)
    rng = random.Random(5)
    values = set()
    for _ in range(60):
        base = rng.getrandbits(64)
        for _ in range(rng.choice([1, 3, 12])):
            x = base
            for b in rng.sample(range(64), rng.randint(0, 5)):
                x ^= 1 << b
            values.add(x)
    base = rng.getrandbits(64)
    for _ in range(400):  # one group that is cut into tiles
        values.add(base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    from lakewright.llm.components import components

    roots = {r.node: r.root for r in components(simhash.near_pairs(spark.createDataFrame([(v,) for v in signed], "fp long"))).collect()}
    want = classes(signed, lambda i, j: (values[i] ^ values[j]).bit_count() <= 3)
    assert [roots.get(v, v) for v in signed] == want


def test_bit_sliced_distances():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    values[100:200] = values[:100] ^ (np.uint64(1) << rng.integers(0, 63, 100, dtype=np.uint64))
    planes = simhash.planes_of(values)
    for radius in (1, 2, 3, 4, 7):
        for shift in (1, 100):
            bits = simhash.within(planes, shift, (1 << (300 - shift)) - 1, radius)
            want = [int(a ^ b).bit_count() <= radius for a, b in zip(values, values[shift:])]
            assert [bool(bits >> i & 1) for i in range(300 - shift)] == want


def test_deduplicate_keeps_one_of_each(spark):
    d = table(spark, TINY, "documents")
    kept = simhash.deduplicate(d)
    assert kept.columns == d.columns
    comps = {r.component_id for r in simhash.near_duplicates(d).collect()}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(comps)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in simhash.deduplicate(documents(spark)).select("doc_id").collect())


def test_deduplicate_decides_by_row(spark):
    one, two, three = (" ".join(f"{w}{i}" for i in range(60)) for w in ("red", "green", "blue"))
    rows = [(1, one), (2, one), (2, two), (2, three), (3, three), (None, "lone text of no id"), (None, "lone text of no id"), (None, two), (4, one), (4, one), (None, None), (5, "")]
    kept = sorted(map(tuple, simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert kept == sorted([(1, one), (2, two), (2, three), (None, "lone text of no id"), (5, "")], key=repr)


@pytest.mark.parametrize("make", [documents, nothing])
def test_deduplicate_leaves_one_row_of_each_component(spark, make):
    d = make(spark)
    rows = [r.text for r in d.select("text").collect()]
    prints = [brute_print(t) for t in rows]
    comp = classes(list(range(len(rows))), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 3)
    got = simhash.deduplicate(d)
    assert got.columns == d.columns
    assert sorted(comp[rows.index(r.text)] for r in got.collect()) == sorted(set(comp))


def brute_vectors(rows):
    def ok(v):
        return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)

    def linked(i, j):
        a, b = rows[i][1], rows[j][1]
        if not (ok(a) and ok(b)) or len(a) != len(b):
            return False
        a, b = np.array(a, np.float64), np.array(b, np.float64)
        return a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.9

    n = [sum(linked(i, j) for j in range(len(rows)) if j != i) for i in range(len(rows))]
    comp = classes([k for k, _ in rows], linked)
    return sorted([(k, a, c, k == c) for (k, _), a, c in zip(rows, n, comp)], key=repr)


def test_embeddings_edges(spark):
    rng = np.random.default_rng(3)
    rows = [(1, None), (2, []), (3, [0.0] * 4), (4, [1.0, None, 0.0, 0.0]), (5, [float("nan"), 1.0, 0.0, 0.0]), (6, [float("inf"), 1.0, 0.0, 0.0]), (None, [1.0, 2.0, 3.0, 4.0]), (7, [1.0, 2.0, 3.0, 4.0]), (7, [1.0, 2.0, 3.0, 4.0]), (8, [1.0, 2.0]), (9, [1e-30, 2e-30])]
    rows += [(10 + i, rng.normal(size=4).round(2).tolist()) for i in range(60)]
    for kind in ("float", "double"):
        d = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").selectExpr("*", "1 AS uid", "2 AS cell", "3 AS n")
        got = embeddings.near_duplicates(d, tile=16)
        exact = [(r.vec_id, r.embedding) for r in d.collect()]
        assert sorted(map(tuple, got.collect()), key=repr) == brute_vectors(exact)
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_embeddings_whole_table(spark):
    d = table(spark, SMALL, "embeddings")
    rows = [(r.vec_id, r.embedding) for r in d.collect()]
    x = np.array([v for _, v in rows], np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.9
    comp = classes([k for k, _ in rows], lambda i, j: near[i, j])
    want = sorted((k, int(near[i].sum()) - 1, comp[i], k == comp[i]) for i, (k, _) in enumerate(rows))
    assert sorted(map(tuple, embeddings.near_duplicates(d, tile=100).collect())) == want


def test_embeddings_keep_one_row_of_each_component(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.01]), (2, [0.0, 1.0]), (None, [-1.0, 0.0]), (None, [0.0, -1.0]), (3, None), (None, None), (4, [0.0, 2.0]), (1, [1.0, 0.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS _keep", "2 AS _rank", "3 AS uid", "4 AS row", "5 AS root")
    got = embeddings.deduplicate(d)
    assert got.columns == d.columns
    want = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (None, [-1.0, 0.0]), (None, [0.0, -1.0]), (3, None), (None, None)]
    assert sorted(((r[0], r[1]) for r in got.collect()), key=repr) == sorted(want, key=repr)
    assert embeddings.deduplicate(d.limit(0)).collect() == []


def test_embeddings_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK_BYTES", 8 * 8 * 90)
    rng = np.random.default_rng(8)
    base = rng.normal(size=(40, 8))
    x = np.concatenate([base[rng.integers(0, 40, 700)] + 0.15 * rng.normal(size=(700, 8)), np.tile(base[0], (200, 1)), rng.normal(size=(100, 8))])
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, embeddings.near_duplicates(d, tile=30).collect()), key=repr) == brute_vectors([(i, v) for i, v in enumerate(x)])


def test_error_bound_is_rigorous():
    rng = np.random.default_rng(4)
    u = embeddings.unit(rng.normal(size=(200, 24)))
    u[:50] = embeddings.unit(u[50:100] + 0.2 * rng.normal(size=(50, 24)))
    q = embeddings.quantise(u)
    for t in (0.5, 0.9):
        assert not ((u @ u.T >= t) & ~embeddings.possible(q, q, t)).any()
