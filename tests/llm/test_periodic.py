import hashlib
import random
import zlib
from fractions import Fraction

import pytest
from cases import documents, nothing

from lakewright.llm import periodic_runs
from lakewright.llm.queries import op11_periodic_runs
from lakewright.session import table

TINY = "/root/testdata/sf0.001"


def brute_runs(w, min_exp=3, min_length=24):
    """Each stretch that repeats at a lag and can't be made longer, by its smallest period."""
    found = {}
    for q in range(1, len(w) // min_exp + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(min_length, min_exp * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, m, q) for (s, m), q in found.items())


def brute_collapsed(w, runs):
    return [x for i, x in enumerate(w) if not any(s + q <= i < s + m for s, m, q in runs)]


def brute_row(doc_id, text):
    w = (text or "").encode().split()
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    head = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *head, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(brute_collapsed(w, runs))).hexdigest())


def plain(rows):
    return sorted(((r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) for r in rows), key=repr)


def repetitive(spark):
    """Few words, repeated passages of all lengths, ids whose text is repeated by the query among them."""
    rng = random.Random(11)
    rows = []
    for i in range(300):
        w, n = [], rng.choice([0, 5, 24, 60, 200, 400])
        while len(w) < n:
            w += [rng.choice(["a", "b", "é", " "]) for _ in range(rng.randint(1, 12))] * rng.choice([1, 1, 2, 3, 4, 9])
        rows.append((rng.choice([i, i, i, None]), rng.choice([" ", "\t\n", "\x0b "]).join(w)))
    return spark.createDataFrame(rows + rows[:3], "doc_id long, text string")


@pytest.mark.parametrize("make", [repetitive, nothing, lambda s: documents(s).filter("doc_id IS DISTINCT FROM 8")])
def test_rows_are_the_brute_force_rows(spark, make):
    d = make(spark)
    got = plain(periodic_runs.planted_runs(d).collect())
    assert got == sorted((brute_row(r.doc_id, r.text) for r in d.collect()), key=repr)


def test_query(spark):
    want = sorted((brute_row(r.doc_id, r.text) for r in table(spark, TINY, "documents").collect() if len(r.text or "") < 9000), key=repr)
    got = plain(op11_periodic_runs(spark, TINY).collect())
    assert len(got) == table(spark, TINY, "documents").count() and set(want) <= set(got) and sum(r[1] > 0 for r in want) > 15


@pytest.mark.parametrize("min_exp, min_length", [(3, 24), (2, 6), (4, 8)])
def test_ranges_of_lags_give_what_one_task_gives(spark, min_exp, min_length):
    """With ranges of 2,000 comparisons the longer texts are dealt out, texts without id and repeated rows among them."""
    d = repetitive(spark).selectExpr("*", "1 AS _hash", "2 AS text_hash", "3 AS runs", "4 AS low", "5 AS _id")
    got = periodic_runs.periodic_runs(d, min_exp, min_length, size=2000).collect()
    assert sum(len(periodic_runs.lag_ranges(r.n_words, min_exp, 2000)) > 3 for r in got) > 50
    want = []
    for r in d.collect():
        w = (r.text or "").encode().split()
        runs = brute_runs(w, min_exp, min_length)
        want.append((r.doc_id, len(w), runs, b" ".join(brute_collapsed(w, runs)).decode()))
    assert sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("n", [0, 1, 5, 24, 1000, 19_689])
def test_ranges_of_lags_are_even_and_whole(n):
    ranges = periodic_runs.lag_ranges(n, size=100_000)
    assert [q for low, high in ranges for q in range(low, high)] == list(range(1, n // 3 + 1))
    assert all(sum(n - q for q in range(low, high)) <= 100_000 + 2 * n for low, high in ranges)


def test_a_long_text_of_one_word(spark):
    d = spark.createDataFrame([(1, "word " * 30_000 + "end"), (2, "x" * 300_000)], "doc_id long, text string")
    got = {r.doc_id: r for r in periodic_runs.periodic_runs(d).collect()}
    assert [tuple(x) for x in got[1].runs] == [(0, 30_000, 1)] and got[1].collapsed == "word end"
    assert got[2].runs == [] and got[2].n_words == 1 and got[2].collapsed == "x" * 300_000
