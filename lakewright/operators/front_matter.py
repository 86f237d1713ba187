"""The head of a text between two lines of dashes: named scalars, blocks and lists."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

ENTRY, ITEM = re.compile(r"^([A-Za-z][A-Za-z0-9_-]*):\s*(.*)$"), re.compile(r"^\s*-\s+(.+)$")
BLOCKS = ("|", "|-", "|+", ">", ">-", ">+")
#: Other spellings of names, and names whose values are lists.
ALIASES = {"allowed-tools": "allowedTools", "allowed_tools": "allowedTools"}
SCALARS, LISTS = ("name", "description", "version", "category", "icon"), ("triggers", "tags", "scopes", "allowedTools")


def unquoted(value: str) -> str:
    bare = value.strip()
    return bare[1:-1] if len(bare) > 1 and bare[0] == bare[-1] and bare[0] in "\"'" else bare


def listed(raw: str, rest: list[str]) -> tuple[list[str] | None, int]:
    """A list in brackets, or with commas, or in the lines that follow; and how many of these it takes."""
    bare = raw.strip()
    if bare.startswith("[") and bare.endswith("]"):
        return [v for v in map(unquoted, bare[1:-1].split(",")) if v], 0
    if bare:
        return ([v for v in map(unquoted, bare.split(",")) if v] if "," in bare else [bare]) or None, 0
    items = []
    for line in rest:
        if not (m := ITEM.match(line)):
            break
        items.append(unquoted(m[1]))
    return items or None, len(items)


def parse(text: str) -> tuple[dict[str, object], str]:
    """Values by name, and the text behind the head; a text without a head is all body."""
    end = text.find("\n---", 3) if text.startswith("---") else -1
    if end < 0:
        return {}, text
    out: dict[str, object] = {}
    lines = text[3:end].strip("\n").split("\n")
    i = 0
    while i < len(lines):
        m = ENTRY.match(lines[i])
        i += 1
        if not m:
            continue
        key, raw = ALIASES.get(m[1], m[1]), m[2]
        if raw.strip() in BLOCKS:
            block = []
            while i < len(lines) and (lines[i][:1] in (" ", "\t") or not lines[i].strip()):
                block.append(re.sub(r"^\s{2}", "", lines[i]))
                i += 1
            raw = (" " if raw.strip().startswith(">") else "\n").join(block)
        value = unquoted(raw)
        items, taken = listed(value, lines[i:])
        i += taken
        if key in SCALARS:
            out[key] = value
        elif key in LISTS:
            out[key] = items
    return out, text[end + 4 :].lstrip()


def front_matter(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, the scalars, the lists, body) of each text; what is missing is null. Rows stay where they are."""
    strings = pa.list_(pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [parse(t or "") for t in batch.column(1).to_pylist()]
            columns = [pa.array([f.get(n) for f, _ in found], pa.string() if n in SCALARS else strings) for n in (*SCALARS, *LISTS)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array([b for _, b in found], pa.string())], [key, *SCALARS, *LISTS, "body"])

    d = docs.select(key, text)
    fields = [f"`{n}` string" for n in SCALARS] + [f"`{n}` array<string>" for n in LISTS]
    return d.mapInArrow(run, f"{key} {d.schema[key].dataType.simpleString()}, {', '.join(fields)}, body string")
