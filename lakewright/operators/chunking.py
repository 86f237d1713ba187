"""Overlapping chunks of documents at soft boundaries."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SIZE, OVERLAP = 2400, 260
#: Chunks are handed on once they hold so many characters, and rows are taken so many at a time.
HELD, ROWS = 2_000_000, 256
#: A text from so many characters up to SIZE is split if it has this many paragraphs, characters or lines: into 3, 3, 2 and 2 parts.
SPLITTABLE, MANY_PARAGRAPHS, LONG, SOME_PARAGRAPHS, MANY_LINES = 900, 12, 1800, 6, 10
#: A boundary counts beyond this share of the size: blank line, line end, sentence end.
PARAGRAPH, LINE, SENTENCE = 0.55, 0.65, 0.70
MARKS = (". ", "。", "? ", "! ")
#: What is trimmed from chunks.
SPACE = "\t\n\v\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def cut(window: str, size: int = SIZE) -> int:
    """Where a full window ends: before the last blank line, else line end, else behind the last sentence's mark, if late enough, else at its end."""
    if (at := window.rfind("\n\n")) > size * PARAGRAPH or (at := window.rfind("\n")) > size * LINE:
        return at
    at = max(map(window.rfind, MARKS))
    return at + 1 if at > size * SENTENCE else len(window)


def pieces(text: str, size: int = SIZE, overlap: int = OVERLAP) -> Iterator[tuple[int, str]]:
    """Where each window starts, and its trimmed text; windows of white space are left out."""
    start = 0
    while start < len(text):
        end = len(text) if start + size >= len(text) else start + cut(text[start : start + size], size)
        if chunk := text[start:end].strip(SPACE):
            yield start, chunk
        if end >= len(text):
            return
        start = max(end - overlap, start + 1)


def least_parts(text: str) -> int:
    """How many chunks a short text of many paragraphs or lines should give."""
    bare = text.strip(SPACE)
    if not SPLITTABLE <= len(bare) <= SIZE:
        return 1
    paragraphs = sum(bool(p.strip(SPACE)) for p in re.split("\n{2,}", bare))
    if paragraphs >= MANY_PARAGRAPHS or len(bare) >= LONG:
        return 3
    lines = sum(bool(x.strip(SPACE)) for x in bare.split("\n"))
    return 2 if paragraphs >= SOME_PARAGRAPHS or lines >= MANY_LINES else 1


def balanced(text: str, parts: int) -> list[str]:
    """The text's paragraphs, or its lines where there are too few, filled into parts: one ends where the next unit would reach an even share."""
    units = [p.strip(SPACE) for p in re.split("\n{2,}", text) if p.strip(SPACE)]
    if len(units) < parts:
        units = [x.strip(SPACE) for x in text.split("\n") if x.strip(SPACE)]
    if len(units) < parts:
        return [text.strip(SPACE)]
    share, out = -(-len(text) // parts), [units[0]]
    for unit in units[1:]:
        if len(out) < parts and len(out[-1]) + 2 + len(unit) >= share:
            out.append(unit)
        else:
            out[-1] += "\n\n" + unit
    return out


def structured_pieces(text: str) -> Iterator[tuple[int | None, str]]:
    """pieces, but a short text of many paragraphs or lines in balanced parts, which have no start of their own."""
    parts = least_parts(text)
    if parts > 1 and len(found := balanced(text, parts)) >= parts:
        return zip([None] * len(found), found)
    return pieces(text)


def chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, overlap: int = OVERLAP, structured: bool = False) -> DataFrame:
    """(key, no from 1, start, chunk) of each document; rows stay where they are, and a document's chunks are made one by one.

    structured: short texts of many paragraphs or lines are split evenly, and their chunks have no start.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                row, no, starts, out, held = [], [], [], [], 0

                def made() -> pa.RecordBatch:
                    keys = part.column(0).take(pa.array(row, pa.int64()))
                    return pa.RecordBatch.from_arrays([keys, pa.array(no, pa.int64()), pa.array(starts, pa.int64()), pa.array(out, pa.string())], [key, "no", "start", "chunk"])

                for r in range(part.num_rows):
                    t = part.column(1)[r].as_py() or ""
                    for i, (s, c) in zip(count(1), structured_pieces(t) if structured else pieces(t, size, overlap)):
                        row.append(r)
                        no.append(i)
                        starts.append(s)
                        out.append(c)
                        held += len(c)
                        if held > HELD:
                            yield made()
                            row, no, starts, out, held = [], [], [], [], 0
                yield made()

    d = docs.select(F.col(key), F.col(text))
    return d.mapInArrow(run, f"{key} {d.schema[key].dataType.simpleString()}, no long, start long, chunk string")


def section_chunks(found: DataFrame, doc: str = "doc_id", no: str = "no", text: str = "text") -> DataFrame:
    """(doc, section_index, title, chunk_in_section from 1, chunks_in_section, chunk) of sections (doc, no, title, text)."""
    d = found.select(F.struct(F.col(doc), F.col(no).alias("section_index"), F.col("title")).alias("section"), F.col(text).alias("text"))
    parts = chunks(d, "section", "text", structured=True)
    in_section = F.count("*").over(Window.partitionBy(f"section.{doc}", "section.section_index"))
    return parts.select("section.*", F.col("no").alias("chunk_in_section"), in_section.alias("chunks_in_section"), "chunk")
