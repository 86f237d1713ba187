import hashlib
import random

import numpy as np
import pytest
from cases import documents, nothing

from lakewright.llm import induced, suffix_dedup
from lakewright.session import table


def brute(rows):
    first, out = {}, []
    key = lambda k: float("inf") if k is None else k
    for k, t in rows:
        data = (t or "").encode()
        for i in range(len(data) - 49):
            w = data[i : i + 50]
            first[w] = min(first.get(w, key(k)), key(k))
    for k, t in rows:
        data = (t or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - 49):
            if first[data[i : i + 50]] < key(k):
                gone[i : i + 50] = b"\1" * 50
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out.append((k, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def planted(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5)))
    passages = [" ".join(word() for _ in range(n)) for n in (12, 14, 16, 30, 80)]
    rows = []
    for i in range(120):
        parts = []
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)
            a = rng.randint(0, 20)
            parts.append(p[a : len(p) - rng.randint(0, 20)] if rng.random() < 0.7 else " ".join(word() for _ in range(20)))
        rows.append((i % 97, rng.choice([" ", "", "\n"]).join(parts)))
    rows += [(200, "x" * 300), (201, "x" * 70), (202, "x" * 49 + "y"), (203, "ab" * 200), (204, "ba" * 40), (None, passages[4]), (None, passages[4]), (205, passages[4])]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("which", ["planted", "cases", "nothing", "tiny", "small blocks", "small shards", "hot anchors"])
def test_removed_bytes(spark, monkeypatch, which):
    if which == "small blocks":
        monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 1500)
    if which == "small shards":
        monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 900)
    if which == "hot anchors":
        monkeypatch.setattr(suffix_dedup, "HOT_RUNS", 3)
    d = {"planted": planted, "small blocks": planted, "small shards": planted, "hot anchors": planted, "cases": documents, "nothing": nothing, "tiny": lambda s: table(s, "/root/testdata/sf0.001", "documents")}[which](spark)
    rows = [(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()]
    got = sorted(map(tuple, suffix_dedup.without_repeats(d).collect()), key=repr)
    assert got == brute(rows)


def test_pieces_of_a_long_text_lose_nothing(monkeypatch):
    rng = random.Random(1)
    data = bytes(rng.choice(b"abcd ") for _ in range(5000))
    whole = list(suffix_dedup.anchored_runs(data))
    monkeypatch.setattr(suffix_dedup, "PIECE", 777)
    cut = list(suffix_dedup.anchored_runs(data))
    cover = lambda parts: [(i, int(n)) for p in parts for n, a, b in zip(p[0], p[2], p[3]) for i in range(a, b + 1)]
    assert cover(whole) == cover(cut) and len(cover(whole)) == 4951


def test_cleaned_table(spark):
    d = documents(spark)
    out = suffix_dedup.clean(d)
    assert out.columns == d.columns and out.count() == d.count()
    t = {r.doc_id: r.text for r in suffix_dedup.clean(table(spark, "/root/testdata/sf0.001", "documents")).collect()}
    want = {r.doc_id: r.kept for r in suffix_dedup.without_repeats(table(spark, "/root/testdata/sf0.001", "documents"), text=True).collect()}
    assert t == want


def brute_order(t, cap):
    order = sorted(range(len(t)), key=lambda i: t[i:])
    common = [0]
    for a, b in zip(order, order[1:]):
        common.append(next((k for k in range(cap) if t[a + k] != t[b + k]), cap))
    return order, common


def test_induced_order_and_common_prefixes(monkeypatch):
    rng, spilled = random.Random(1), 0
    spill = induced.Queue.spill

    def count(self):
        nonlocal spilled
        spilled += 1
        spill(self)

    monkeypatch.setattr(induced.Queue, "spill", count)
    for _ in range(300):
        monkeypatch.setattr(induced, "RANGE", rng.choice([3, 50, 1 << 14]))
        monkeypatch.setattr(induced, "BULK", rng.choice([1, 7, 4096]))
        k, n = rng.choice([1, 2, 3, 30, 200]), rng.randint(0, rng.choice([5, 60, 300]))
        t = [rng.randint(1, k) for _ in range(n)]
        t = (t[:10] * rng.randint(1, 12) if rng.random() < 0.3 else t) + [0]
        cap = rng.choice([5, 50])
        order, common = induced.suffix_order(np.array(t), cap, rng.choice([100, 10**7]))
        assert (order.tolist(), common.tolist()) == brute_order(t, cap)
    assert spilled > 100


def test_recursion_over_names(monkeypatch):
    monkeypatch.setattr(induced, "UNIQUE", 0.999999)  # recursion until all names differ
    t = [1 + (i * i // 7) % 3 for i in range(60)] * 8 + [0]
    order, common = induced.suffix_order(np.array(t), 50)
    assert (order.tolist(), common.tolist()) == brute_order(t, 50)


def test_null_ids_and_ids_with_several_texts(spark):
    rng = random.Random(9)
    p = " ".join("".join(rng.choice("abcdef") for _ in range(5)) for _ in range(30))
    rows = [(None, p), (None, "x " + p), (5, p + " five"), (5, "other " + p), (9, p), (None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, suffix_dedup.without_repeats(d).collect()), key=repr) == brute(rows)
