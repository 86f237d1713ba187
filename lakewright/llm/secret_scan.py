"""Secrets in texts: patterns, and candidates that their own structure confirms."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewright.llm.common import pick
from lakewright.llm.key_encodings import decoded, openssh_key, private_key, signed_token

BASE = ("assign", "access", "hex")
#: The kinds in the order in which they are listed at one place.
KINDS = (*BASE, "pem", "key", "token")
#: Words of the first pattern in lower case; without one of them it can't match.
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{32,}")
#: Lines of base64 with line ends or their escapes between, as they stand in files and in strings of programs.
_END = r"(?:\r?\n|\\r\\n|\\n)"
_LINES = rf"[A-Za-z0-9+/]*(?:{_END}[A-Za-z0-9+/]+)*={{0,2}}"
PEM = re.compile(rf"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----{_END}((?:[A-Za-z-]+: [^\r\n\\]*{_END})*){_END}?({_LINES}){_END}?-----END \1-----")
#: What starts with a sequence's tag, or with the other format's name, in base64; and a sequence in hex.
KEY = re.compile(rf"(?<![A-Za-z0-9+/])(?:M[A-Za-z0-9+/]{{23}}|b3BlbnNzaC1rZXktdjE){_LINES}")
HEX_KEY = re.compile("(?<![A-Za-z0-9])30[0-9A-Fa-f]{46,}(?![A-Za-z0-9])")
#: A JSON object starts with a brace, and a quote or a blank.
TOKEN = re.compile(r"(?<![A-Za-z0-9_.-])e[wy][A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+(?!\.?[A-Za-z0-9_-])")
FINDING = "struct<kind:string,start:long,end:long,detail:string>"

_BREAK = re.compile(_END)


def key_in(block: str) -> tuple[str, int] | None:
    """(kind, characters of the block that it takes) of the key at the start of lines of base64; the line must end with the key."""
    pure = _BREAK.sub("", block).rstrip("=")
    data = decoded(pure[: len(pure) // 4 * 4] if len(pure) % 4 == 1 else pure)
    found = data and (private_key(data) or openssh_key(data))
    if not found:
        return None
    left = -(-found[1] * 4 // 3)
    pieces = re.split(f"({_END})", block)
    at = 0
    for line, end in zip(pieces[::2], [*pieces[1::2], ""]):
        # only padding may stand behind the key
        if left <= len(line.rstrip("=")):
            return (found[0], at + len(line)) if left == len(line.rstrip("=")) else None
        left -= len(line)
        at += len(line) + len(end)
    return None


def structures(text: str) -> Iterator[tuple[str, int, int, str]]:
    """Candidates that decode to a key or a signed token. Inside an armoured key no other one is looked for."""
    armoured = []
    for m in PEM.finditer(text) if "PRIVATE KEY-----" in text else ():
        kind = key_in(m[3])
        if kind and kind[1] == len(m[3]):
            yield "pem", m.start(), m.end(), kind[0]
        elif "DEK-Info: " in m[2] and (data := decoded(_BREAK.sub("", m[3]))) and len(data) % 8 == 0:
            # a block cipher's text has no structure of its own
            yield "pem", m.start(), m.end(), "encrypted"
        else:
            continue
        armoured.append((m.start(), m.end()))
    at = 0
    for m in KEY.finditer(text):
        while at < len(armoured) and armoured[at][1] <= m.start():
            at += 1
        if at < len(armoured) and armoured[at][0] <= m.start():
            continue
        if found := key_in(m[0]):
            yield "key", m.start(), m.start() + found[1], found[0]
    for m in HEX_KEY.finditer(text):
        found = private_key(bytes.fromhex(m[0])) if len(m[0]) % 2 == 0 else None
        if found and 2 * found[1] == len(m[0]):
            yield "key", m.start(), m.end(), found[0]
    for m in TOKEN.finditer(text):
        if alg := signed_token(m[0]):
            yield "token", m.start(), m.end(), alg


def findings(text: str) -> list[tuple[str, int, int, str | None]]:
    """(kind, start, end, detail) by start, then kind, in code points; leftmost, not overlapping within each base kind."""
    found: list[tuple[str, int, int, str | None]] = []
    low = text.lower()
    if any(w in low for w in WORDS):
        found += [("assign", m.start(), m.end(), m[1].lower()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), None) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [("hex", m.start(), m.end(), None) for m in HEX.finditer(text)]
    found += structures(text)
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id and findings (kind, start, end, detail).

    Kinds of patterns: assign (detail: the word), access, hex. Kinds that structure confirms: pem (an armoured private key
    whose content is one), key (a bare one in base64 or hex), token (a signed token: header and claims are JSON objects, and
    the header names an algorithm); detail is the kind of key or the algorithm. Public keys, certificates and mere random
    strings are none. Null and empty texts: no findings. Very long texts are scanned whole, in time in proportion to them.
    Repeated rows, and rows without id, each get their row. Rows stay where they are. Empty table: no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("kind", "start", "end", "detail")
        kind = pa.list_(pa.struct(list(zip(names, (pa.string(), pa.int64(), pa.int64(), pa.string())))))
        for batch in batches:
            found = [[dict(zip(names, f)) for f in findings(t)] if t else [] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["doc_id", "findings"])

    d = pick(docs, "doc_id", "text")
    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, findings array<{FINDING}>")


def contract(docs: DataFrame) -> DataFrame:
    """The contract's columns of scan."""

    def listed(found: Column) -> Column:
        return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("findings", lambda x: x["kind"].isin(*BASE))
    return scan(docs).select("doc_id", *map(count, BASE), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("findings")).alias("spans"))
