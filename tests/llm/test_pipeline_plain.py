"""Each stage of the pipeline against a plain way to its rows, which shares no code with it."""

from collections import Counter
from itertools import combinations

import corpus_pipeline
import duckdb
import pyarrow as pa
import xxhash

from lakewright.llm.sql import MIXING_SQL
from lakewright.session import materialize, table

TINY = "/root/testdata/sf0.001"
BLANKS = " \t\n\x0b\x0c\r"


def words(text):
    return (text or "").encode().split()


def plain_rules(rows):
    """(doc_id, text) of what stays: lines counted by host in documents, then judged."""
    lines = {i: [" ".join(x.decode() for x in words(line)).lower() for line in (r.text or "").split("\n") if words(line)] for i, r in enumerate(rows)}
    documents, holders = {}, {}
    for i, r in enumerate(rows):
        documents.setdefault(r.source, set()).add(r.doc_id)
        for line in lines[i]:
            holders.setdefault((r.source, line), set()).add(r.doc_id)
    bad = {k for k, d in holders.items() if len(d) > 20 and len(d) > 0.1 * len(documents[k[0]])}
    out = []
    for r in rows:
        w = words(r.text)
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        twice = Counter(grams)
        covered = {i + k for i, g in enumerate(grams) if twice[g] > 1 for k in range(3)}
        size = lambda t: sum(c not in BLANKS for c in t)
        is_bad = lambda line: bool(words(line)) and (r.source, " ".join(x.decode() for x in words(line)).lower()) in bad  # noqa: E731, B023
        parts = (r.text or "").split("\n")
        gone = sum(size(p) for p in parts if is_bad(p))
        if len(w) >= 50 and 100 * len(covered) <= 50 * len(w) and size(r.text or "") - gone >= 0.5 * size(r.text or ""):
            out.append((r.doc_id, "\n".join(p for p in parts if not is_bad(p)) if gone else r.text))
    return out


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = words(low)
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_near(rows):
    """The smallest doc_id of each component."""
    prints = [plain_fingerprint(r.text) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 3:
            root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(r.doc_id, least.get(find(i), r.doc_id))
    return sorted(least.values())


def plain_suffix(rows):
    """(doc_id, text) without bytes of strings that a smaller doc_id has."""
    seen, out = set(), []
    for r in sorted(rows, key=lambda r: r.doc_id):
        data = (r.text or "").encode()
        own = [data[i : i + 50] for i in range(len(data) - 49)]
        gone = {i + k for i, s in enumerate(own) if s in seen for k in range(50)}
        out.append((r.doc_id, bytes(b for i, b in enumerate(data) if i not in gone).decode(errors="ignore") if gone else r.text))
        seen |= set(own)
    return out


def test_stages_against_plain_ways(spark):
    steps = [table(spark, TINY, "documents")]
    for name, stage in corpus_pipeline.STAGES[:4]:
        steps.append(materialize(stage(spark, steps[-1], TINY), name))
    first, rules, near, exact, mixed = (s.collect() for s in steps)
    assert len({r.doc_id for r in first}) == len(first)
    assert sorted((r.doc_id, r.text) for r in rules) == sorted(plain_rules(first)) and 0 < len(rules) < len(first)
    assert sorted(r.doc_id for r in near) == plain_near(rules) and 0 < len(near) < len(rules)
    assert {(r.doc_id, r.text) for r in near} <= {(r.doc_id, r.text) for r in rules}
    assert sorted((r.doc_id, r.text) for r in exact) == sorted(plain_suffix(near)) and any(len(a.text) < len(b.text) for a, b in zip(sorted(exact, key=lambda r: r.doc_id), sorted(near, key=lambda r: r.doc_id)))
    con = duckdb.connect()
    con.register("documents", pa.table({c: pa.array([r[c] for r in exact], pa.int64() if c == "doc_id" else pa.string()) for c in ("doc_id", "text", "source")}))
    due = {d: n for d, n in con.sql(f"SELECT doc_id, taken FROM ({MIXING_SQL})").fetchall() if n}
    taken, texts = Counter(), {r.doc_id: r.text for r in exact}
    for r in mixed:
        taken[r.doc_id] += len(words(r.text))
        assert texts[r.doc_id].startswith(r.text)
    assert +taken == due
