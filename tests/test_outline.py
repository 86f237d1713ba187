import random

import pyarrow as pa
import pytest
from paths import SMALL
from pyspark.sql import functions as F

from lakewright.operators import chunking, outline
from lakewright.plans import outlines


def brute_paths(rows):
    """A stack of levels for each document, in order."""
    out, stacks = [], {}
    for doc, index, level, title, _ in sorted(rows, key=lambda r: (r[0], r[1])):
        stack = stacks.setdefault(doc, {})
        if level is not None:
            stack[level] = title
            for deeper in [x for x in stack if x > level]:
                del stack[deeper]
        out.append((doc, index, [stack[x] for x in sorted(stack) if stack[x]]))
    return out


def some_blocks(rng):
    return [(d, i, *(lambda n: (n, rng.choice(["a", "b", "c", ""]), f"{n} heading") if n <= 6 else (None, None, rng.choice(["text", " "])))(rng.randint(1, 9))) for d in range(12) for i in range(0, 60, 2)]


def test_paths_are_those_of_a_stack(spark):
    rows = some_blocks(random.Random(2))
    d = spark.createDataFrame(rows, "doc_id long, index long, level int, title string, text string")
    got = outline.heading_paths(d).select("doc_id", "index", "path").collect()
    assert sorted((r.doc_id, r["index"], r.path) for r in got) == brute_paths(rows)


def test_sections_are_in_the_order_in_which_paths_are_met(spark):
    rows = some_blocks(random.Random(5))
    texts = {(r[0], r[1]): r[4] for r in rows}
    want = {}
    for doc, index, path in brute_paths(rows):
        want.setdefault(doc, {}).setdefault(" > ".join(path) or "Document", []).append(index)
    d = spark.createDataFrame(rows, "doc_id long, index long, level int, title string, text string")
    got = outline.sections(outline.heading_paths(d)).orderBy("doc_id", "no").collect()
    for doc, groups in want.items():
        kept = [(t, at) for t, at in groups.items() if "".join(texts[doc, i] for i in at).strip()]
        assert [(r.no, r.title, r.blocks, r.text) for r in got if r.doc_id == doc] == [(n, t, at, "\n\n".join(texts[doc, i] for i in at)) for n, (t, at) in enumerate(kept, 1)]


def test_paragraphs_fill_even_parts(spark):
    paragraph = "Paragraph {}: persuasive speech assessment detail with evidence, timing, academic references, classroom delivery, and grading expectations for students."
    long = "\n\n".join(paragraph.format(i + 1) for i in range(14))
    short = "Late submissions receive a 30% deduction without an AR form.\n\nNo visual aid or written script is allowed."
    d = spark.createDataFrame([(1, 1, "Guidelines", long), (1, 2, "Rules", short)], "doc_id long, no long, title string, text string")
    got = chunking.section_chunks(d).orderBy("section_index", "chunk_in_section").collect()
    assert len([r for r in got if r.section_index == 1]) == 3 and any("Paragraph 14:" in r.chunk for r in got)
    assert [(r.title, r.chunk_in_section, r.chunks_in_section, r.chunk) for r in got if r.section_index == 2] == [("Rules", 1, 1, short)]
    assert [(r.chunk_in_section, r.chunks_in_section) for r in got if r.section_index == 1] == [(1, 3), (2, 3), (3, 3)]


@pytest.mark.parametrize(
    "text, parts",
    [("x" * 899, 1), ("x" * 900, 1), ("x" * 1799, 1), ("x" * 1800, 3), ("x" * 2401, 1), (" " * 3000 + "x" * 100, 1), ("\n\n".join(["w" * 150] * 6), 2), ("\n\n".join(["w" * 149] * 5), 1), ("\n\n".join(["w" * 80] * 12), 3), ("\n".join(["w" * 100] * 10), 2), ("\n".join(["w" * 110] * 9), 1)],
)
def test_how_many_parts(text, parts):
    assert chunking.least_parts(text) == parts


def test_parts_end_where_the_share_is_reached():
    assert chunking.balanced("aaaa\n\nbb\n\ncccc\n\nd", 2) == ["aaaa\n\nbb", "cccc\n\nd"]
    assert chunking.balanced("aaaa\nbb\ncccc", 3) == ["aaaa", "bb", "cccc"] and chunking.balanced("one line", 2) == ["one line"]
    # too few units: windows as ever
    assert [c for _, c in chunking.structured_pieces("x" * 2000)] == ["x" * 2000]


def test_each_branch_of_the_queries_has_rows(spark):
    placed = outline.heading_paths(outlines.blocks(spark, SMALL), levels=outlines.HEADING_WORDS)
    depth = {r[0] for r in placed.select(F.size("path")).distinct().collect()}
    assert {0, 1, 2, 3} <= depth
    found = outline.sections(placed)
    # paths that are left and met again
    assert found.filter(F.element_at("blocks", -1) - F.col("blocks")[0] >= F.size("blocks")).count() > 0
    per = {r[0] for r in outlines.balanced_chunks(spark, SMALL).groupBy("doc_id").count().select("count").distinct().collect()}
    assert {1, 2, 3} <= per
    assert {r[0] for r in chunking.section_chunks(found).select("chunks_in_section").distinct().collect()} >= {1, 2, 3}


def test_chunks_are_handed_on_a_few_at_a_time(spark, monkeypatch):
    """However many rows a batch has, and however long one is; keys of any type go along."""
    docs = spark.createDataFrame([({"a": 1}, "x")], "key struct<a:long>, text string")
    taken = []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: taken.append(run))
    chunking.chunks(docs, "key")
    texts = ["word " * 600] * 1200 + ["z" * 5_000_000, None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array([{"a": i} for i in range(len(texts))], pa.struct([("a", pa.int64())])), pa.array(texts)], ["key", "text"])
    made = list(taken[0](iter([batch])))
    assert max(sum(map(len, b["chunk"].to_pylist())) for b in made) <= chunking.HELD + chunking.SIZE
    want = [(i, n, s, c) for i, t in enumerate(texts) for n, (s, c) in enumerate(chunking.pieces(t or ""), 1)]
    assert [(r["key"]["a"], r["no"], r["start"], r["chunk"]) for b in made for r in b.to_pylist()] == want
