"""Removal of byte strings that also start in an earlier document, over all documents of a table.

Shards are made of what may repeat: each 50-byte string has an anchor, its first 24-byte substring of least hash, which
equal strings share, and runs of neighbouring strings with a common anchor go to that anchor's shard if two documents have
it. There suffixes are put in order by induced sorting, and strings with a common prefix of 50 bytes are groups, of which
the smallest doc_id stays. Runs alike in all documents are put together before the shuffle; the runs of an anchor that
has too many different ones for a shard are split down to single strings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewright.llm.common import pick
from lakewright.llm.induced import suffix_order
from lakewright.session import materialize

#: Length of a repeated string, and of the anchor that each such string holds.
LENGTH, ANCHOR = 50, 24
#: Bytes of text in a block about, and bytes of a text that are looked at together.
BLOCK_BYTES, PIECE = 4_000_000, 1_000_000
#: Bytes that a shard sorts about, and different runs of one anchor beyond which it is split.
SHARD_BYTES, HOT_RUNS = 1_000_000, 10_000
NULL_ID = (1 << 63) - 1

_rng = np.random.default_rng(20_011)
_LETTER = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_BASE, n, 1 << 64))


_powers: list[np.ndarray] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        _powers[:] = []
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            factors = np.full(max(n, 4096), b, np.uint64)
            factors[0] = 1
            _powers.append(np.cumprod(factors, dtype=np.uint64))
    return _powers[0], _powers[1]


def _grams(x: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n values from each place on; n is made of powers of two."""
    have: dict[int, np.ndarray] = {1: x}
    size = 1
    while size * 2 <= n:
        h = have[size]
        have[size * 2] = h[:-size] * _power(size) + h[size:]
        size *= 2
    out, done = have[size], size
    while done < n:
        size = 1 << ((n - done).bit_length() - 1)
        tail = have[size][done:]
        out = out[: len(tail)] * _power(size) + tail
        done += size
    return out


def _first_minimum(h: np.ndarray, width: int) -> np.ndarray:
    """For each window of that width, where its first smallest value stands."""
    value, place, size = h, np.arange(len(h), dtype=np.int64), 1

    def meet(a: slice, b: slice) -> tuple[np.ndarray, np.ndarray]:
        later = value[b] < value[a]
        return np.where(later, value[b], value[a]), np.where(later, place[b], place[a])

    while size * 2 <= width:
        value, place = meet(slice(0, len(value) - size), slice(size, len(value)))
        size *= 2
    if size < width:
        d = width - size
        value, place = meet(slice(0, len(value) - d), slice(d, len(value)))
    return place


def anchored_runs(data: bytes, length: int = LENGTH, anchor: int = ANCHOR) -> Iterator[tuple[np.ndarray, ...]]:
    """All strings of that length in data, as runs of neighbours with the same anchor.

    A string's anchor is the first of its substrings of anchor bytes with the smallest hash. So equal strings have
    equal anchors at equal places, and neighbours mostly share theirs. Gives arrays name (the anchor's hash), content
    (hash of the run's bytes and the anchor's place in it), first and last (where the run's strings start), at (of the anchor).
    """
    for start in range(0, max(len(data) - length + 1, 0), PIECE):
        x = _LETTER[np.frombuffer(data, np.uint8, min(PIECE + length - 1, len(data) - start), start)]
        h = _mix(_grams(x, anchor))
        place = _first_minimum(h, length - anchor + 1)
        cut = np.flatnonzero(place[1:] != place[:-1]) + 1
        first, last = np.r_[0, cut], np.r_[cut, len(place)] - 1
        at = place[first]
        power, inverse = _tables(len(x) + 1)
        sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(x * power[: len(x)], out=sums[1:])
        size = last + length - first
        content = (sums[last + length] - sums[first]) * inverse[first]
        content = _mix(content + (size * 1000 + at - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        yield h[at], content, first + start, last + start, at + start


def _bytes(column: pa.ChunkedArray) -> list[bytes]:
    return [(t or "").encode() for t in column.to_pylist()]


def _copies(right: pa.Table) -> set[tuple[int, int]]:
    return {(d, c) for d, c, low in zip(right.column("d").to_pylist(), right.column("c").to_pylist(), right.column("lows").to_pylist()) if low is None}


def _runs_of(left: pa.Table, skip: set[tuple[int, int]]) -> Iterator[tuple[int, int, bytes, tuple[np.ndarray, ...]]]:
    """Each different document of a block that isn't a copy, with its runs."""
    seen = set(skip)
    for d, c, data in zip(left.column("d").to_pylist(), left.column("c").to_pylist(), _bytes(left.column("text"))):
        if (d, c) in seen:
            continue
        seen.add((d, c))
        for runs in anchored_runs(data):
            yield d, c, data, runs


def _by_shard(block: int, names: list[np.ndarray], owners: list[np.ndarray], shards: int) -> pa.Table:
    """A row for each shard of a block's names: each name once, in 32 bits besides the shard, and whether several owners have it."""
    rows: list[tuple] = []
    if names:
        n, o = np.concatenate(names), np.concatenate(owners)
        order = np.lexsort((o, n))
        n, o = n[order], o[order]
        heads = np.flatnonzero(np.r_[True, n[1:] != n[:-1]]) if len(n) else np.zeros(0, np.int64)
        several = (np.maximum.reduceat(o, heads) != o[heads]) if len(n) else np.zeros(0, bool)
        n = n[heads]
        shard = _shard(n, shards)
        order = np.argsort(shard, kind="stable")
        n, several, shard = n[order], several[order], shard[order]
        which, starts = np.unique(shard, return_index=True)
        for s, a, b in zip(which.tolist(), starts, np.r_[starts[1:], len(n)]):
            rows.append((s, n[a:b].astype("<u4").tobytes(), np.packbits(several[a:b]).tobytes()))
    return pa.Table.from_arrays([pa.array([block] * len(rows), pa.int32()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["block", "shard", "lows", "several"])


def _shard(names: np.ndarray, shards: int) -> np.ndarray:
    return ((names >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)


def _wanted(right: pa.Table) -> np.ndarray:
    """The shared names that a block got back, as shard and low bits."""
    got = [np.frombuffer(low, "<u4").astype(np.uint64) | np.uint64(s) << np.uint64(32) for s, low in zip(right.column("shard").to_pylist(), right.column("lows").to_pylist()) if low is not None]
    return np.unique(np.concatenate(got)) if got else np.zeros(0, np.uint64)


def _is_wanted(names: np.ndarray, want: np.ndarray, shards: int) -> np.ndarray:
    short = (_shard(names, shards).astype(np.uint64) << np.uint64(32)) | (names & np.uint64(0xFFFFFFFF))
    return want[np.minimum(np.searchsorted(want, short), len(want) - 1)] == short if len(want) else np.zeros(len(names), bool)


def _shared(named: DataFrame) -> DataFrame:
    """(block, shard, lows): those names that two documents have at least, for each block that has them.

    A block sends each name once, so a very common one weighs no more than another. Names that agree by chance are
    sorted out later.
    """

    def find(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        blocks = table.column("block").to_pylist()
        lows = [np.frombuffer(x, "<u4") for x in table.column("lows").to_pylist()]
        several = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(y)) for x, y in zip(table.column("several").to_pylist(), lows)]
        ends = np.cumsum([len(x) for x in lows])
        _, which, counts = np.unique(np.concatenate(lows), return_inverse=True, return_counts=True)
        shared = counts > 1
        shared[which[np.concatenate(several).astype(bool)]] = True
        kept = [x[keep].astype("<u4").tobytes() for x, keep in zip(lows, np.split(shared[which], ends[:-1]))]
        return pa.Table.from_arrays([pa.array(blocks, pa.int32()), pa.array([int(key[0].as_py())] * len(blocks), pa.int32()), pa.array(kept, pa.binary())], ["block", "shard", "lows"])

    return named.groupBy("shard").applyInArrow(find, "block int, shard int, lows binary").filter(F.length("lows") > 0)


def _shared_names(docs: DataFrame, copies: DataFrame, shards: int) -> DataFrame:
    """Names of anchors that stand in two documents at least, for each block."""

    def name_block(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        names, own, no, before = [], [], 0, None
        for d, c, _, runs in _runs_of(left, _copies(right)):
            no += (d, c) != before
            before = (d, c)
            names.append(np.unique(runs[0]))
            own.append(np.full(len(names[-1]), no))
        return _by_shard(int(key[0].as_py()), names, own, shards)

    return _shared(docs.groupBy("block").cogroup(copies.groupBy("block")).applyInArrow(name_block, "block int, shard int, lows binary, several binary"))


def repeated_strings(spans: list[bytes], owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(span, first, last) of the stretches of strings of LENGTH bytes that also stand in a span of a smaller owner."""
    sizes = np.array([len(x) for x in spans], np.int64)
    # bytes of UTF-8 begin at 2; 1 ends a span, 0 ends all
    text = np.frombuffer(b"\xff".join(spans) + b"\xff\xfe", np.uint8) + np.uint8(2)
    start = np.cumsum(sizes + 1) - sizes - 1
    span = np.repeat(np.arange(len(spans)), sizes + 1)
    order, common = suffix_order(text, LENGTH)
    order, common = order[1:], common[1:]
    place = order - start[span[order]]
    # a common prefix with a whole string lies before both spans' ends, so all of a group are strings
    own = np.where(place + LENGTH <= sizes[span[order]], owner[span[order]], NULL_ID)
    heads = np.flatnonzero(np.r_[True, common[1:] < LENGTH])
    least = np.repeat(np.minimum.reduceat(own, heads), np.diff(np.r_[heads, len(own)]))
    hit = np.zeros(len(text), bool)
    hit[order[(least < own) & (place + LENGTH <= sizes[span[order]])]] = True
    edge = np.diff(np.r_[0, hit.view(np.int8), 0])
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
    return np.stack([span[first], first - start[span[first]], last - start[span[first]]], axis=1)


def _sorted_shards(runs: DataFrame) -> DataFrame:
    """(d, c, s, e): the stretches of these runs' bytes that a smaller document has too, shard by shard."""

    def sort(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        d, c, first = (table.column(k).to_numpy() for k in ("d", "c", "first"))
        index: dict[bytes, int] = {}
        of = np.array([index.setdefault(x, len(index)) for x in table.column("span").to_pylist()])
        owner = np.full(len(index), NULL_ID)
        np.minimum.at(owner, of, d)
        found = repeated_strings(list(index), owner)
        # each row takes the stretches of its span
        count = np.bincount(found[:, 0], minlength=len(index))
        begin = np.cumsum(count) - count
        row = np.repeat(np.arange(len(of)), count[of])
        at = np.arange(len(row)) - np.repeat(np.cumsum(count[of]) - count[of], count[of]) + begin[of[row]]
        return pa.Table.from_arrays([pa.array(d[row]), pa.array(c[row]), pa.array(first[row] + found[at, 1]), pa.array(first[row] + found[at, 2] + LENGTH)], ["d", "c", "s", "e"])

    return runs.groupBy("shard").applyInArrow(sort, "d long, c long, s long, e long")


def _strings_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each string of each run (its span's substrings of LENGTH), and the run's position in the table."""
    spans = table.column("span").to_pylist()
    sizes = np.array([len(x) for x in spans], np.int64)
    starts = np.cumsum(sizes) - sizes
    n = sizes - LENGTH + 1
    run = np.repeat(np.arange(len(spans)), n)
    place = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n) + starts[run]
    if not len(run):
        return np.zeros(0, np.uint64), run
    return _mix(_grams(_LETTER[np.frombuffer(b"".join(spans), np.uint8)], LENGTH))[place], run


def _shared_strings(runs: DataFrame, shards: int) -> DataFrame:
    """(d, c, name, string, s) for the strings of these runs that two documents have at least."""

    def name_block(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        hashes, run = _strings_of(table)
        return _by_shard(int(key[0].as_py()), [hashes], [table.column("d").to_numpy()[run]], shards)

    names = _shared(runs.groupBy("block").applyInArrow(name_block, "block int, shard int, lows binary, several binary"))

    def pick_block(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        hashes, run = _strings_of(left)
        hit = np.flatnonzero(_is_wanted(hashes, _wanted(right), shards))
        first = np.searchsorted(run, run[hit])
        of = {k: left.column(k).to_numpy()[run[hit]] for k in ("d", "c", "name", "first")}
        return pa.Table.from_arrays([pa.array(of["d"]), pa.array(of["c"]), pa.array(of["name"]), pa.array(hashes[hit].view(np.int64)), pa.array(of["first"] + hit - first)], ["d", "c", "name", "string", "s"])

    return runs.groupBy("block").cogroup(names.groupBy("block")).applyInArrow(pick_block, "d long, c long, name long, string long, s long")


def _shared_runs(docs: DataFrame, copies: DataFrame, names: DataFrame, shards: int) -> DataFrame:
    """The runs of all documents whose anchors are shared: d, c, name, content, first, last, at (of the anchor in the run), span."""
    replies = names.select("block", F.lit(None).cast("long").alias("d"), F.lit(None).cast("long").alias("c"), "shard", "lows")
    right = copies.unionByName(replies)

    def run_block(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        want = _wanted(right)
        cols: list[list[np.ndarray]] = [[] for _ in range(7)]
        spans: list[bytes] = []
        if len(want):
            for d, c, data, (name, content, first, last, at) in _runs_of(left, _copies(right)):
                hit = np.flatnonzero(_is_wanted(name, want, shards))
                for k, v in enumerate((np.full(len(hit), d), np.full(len(hit), c), name[hit].view(np.int64), content[hit].view(np.int64), first[hit], last[hit], at[hit] - first[hit])):
                    cols[k].append(v.astype(np.int64))
                spans += [data[a : b + LENGTH] for a, b in zip(first[hit].tolist(), last[hit].tolist())]
        flat = [pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in cols]
        return pa.Table.from_arrays([*flat, pa.array(spans, pa.binary())], ["d", "c", "name", "content", "first", "last", "at", "span"])

    return docs.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(run_block, "d long, c long, name long, content long, first long, last long, at long, span binary")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(d, c, spans): for documents with repeats the covered bytes as array of (s, e); d is doc_id (null: the largest), c the text's hash.

    docs: doc_id, text. Steps: texts that an earlier document has as a whole; anchors shared by documents, block by block;
    runs alike as a whole, of which all but the first document's go; and by order of suffixes where one anchor has several
    different runs. Every grouping is by content, with sums before the shuffle; a passage in very many documents is one
    row for each task there, and the joins back can be split.
    """
    spark = docs.sparkSession
    keyed = docs.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("d"), F.xxhash64("text").alias("c"), "text")
    heads = materialize(keyed.select("d", "c", F.sha2(F.coalesce("text", F.lit("")), 256).alias("whole"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n")), "texts").filter(F.col("n") >= LENGTH)
    total = heads.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    shards = max(8, blocks // 2)
    firsts = heads.groupBy(F.col("whole").alias("_whole")).agg(F.min("d").alias("least"))
    copied = heads.join(firsts, F.col("whole") == F.col("_whole")).filter("least < d").select("d", "c", "n").distinct()
    copied = materialize(copied, "copies")
    block = F.pmod(F.xxhash64("d"), F.lit(blocks)).cast("int").alias("block")
    copies = copied.select(block, "d", "c", F.lit(None).cast("int").alias("shard"), F.lit(None).cast("binary").alias("lows"))
    long_ones = keyed.filter(F.octet_length("text") >= LENGTH).select(block, "d", "c", "text")
    runs = materialize(_shared_runs(long_ones, copies, _shared_names(long_ones, copies, shards), shards), "runs")

    classes = materialize(runs.groupBy(F.col("name").alias("_name"), F.col("content").alias("_content")).agg(F.min("d").alias("least")), "run-classes")
    mixed = classes.groupBy(F.col("_name").alias("_mixed")).agg((F.min("_content") != F.max("_content")).alias("mixed")).filter("mixed").select("_mixed")
    open_ = materialize(classes.join(mixed, F.col("_name") == F.col("_mixed"), "left_semi"), "open-classes")
    same = lambda other: (F.col("name") == other["_name"]) & (F.col("content") == other["_content"])
    rest = materialize(runs.join(open_, same(open_) & (F.col("d") == open_["least"])).select("d", "c", "name", "first", "last", "span"), "open-runs")
    whole = runs.select("d", "c", "name", "content", "first", "last").join(classes, same(classes)).filter("least < d").select("d", "c", F.col("first").alias("s"), (F.col("last") + LENGTH).alias("e"))
    each = rest.groupBy(F.col("name").alias("_hot")).agg(F.count("*").alias("runs"), F.sum(F.length("span")).alias("bytes"))
    total = each.agg(F.sum("bytes")).first()[0] or 0
    hot = materialize(each.filter(F.col("runs") > HOT_RUNS).select("_hot"), "hot")
    of_shard = F.pmod(F.xxhash64("name"), F.lit(max(1, -(-total // SHARD_BYTES)))).cast("int")
    sorted_ = materialize(_sorted_shards(rest.join(hot, F.col("name") == F.col("_hot"), "left_anti").withColumn("shard", of_shard)), "sorted")
    single = sorted_
    if hot.head() is not None:
        split = rest.join(hot, F.col("name") == F.col("_hot"), "left_semi")
        strings = materialize(_shared_strings(split.withColumn("block", block), shards), "strings")
        least = strings.groupBy(F.col("name").alias("_name"), F.col("string").alias("_string")).agg(F.min("d").alias("least"))
        alone = strings.join(least, (F.col("name") == F.col("_name")) & (F.col("string") == F.col("_string"))).filter("least < d")
        single = single.unionByName(alone.select("d", "c", "s", (F.col("s") + LENGTH).alias("e")))
    all_ = whole.unionByName(single).unionByName(copied.select("d", "c", F.lit(0).cast("long").alias("s"), F.col("n").alias("e")))
    return materialize(all_.groupBy("d", "c").agg(F.collect_list(F.struct("s", "e")).alias("spans")), "spans")


def union_of(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal runs, in order."""
    out: list[tuple[int, int]] = []
    for s, e in sorted((x["s"], x["e"]) for x in spans or ()):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def without_repeats(docs: DataFrame, text: bool = False) -> DataFrame:
    """One row per row of docs (doc_id, text): n_bytes, n_removed, n_spans, kept_sha256; with text also removed (the spans) and kept.

    A null text counts as empty. A null doc_id counts as larger than any other. Rows with the same doc_id never count as
    earlier than each other. kept is the text without its repeats; a character that is cut goes. Empty table: no rows.
    """
    docs = pick(docs, "doc_id", "text")
    spans = repeated_spans(docs).select(F.col("d").alias("_d"), F.col("c").alias("_c"), "spans")
    d, c = F.coalesce("doc_id", F.lit(NULL_ID)), F.xxhash64("text")
    both = docs.join(spans, (d == F.col("_d")) & (c == F.col("_c")), "left").select("doc_id", "text", "spans")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    if text:
        schema += ", removed array<struct<s:long,e:long>>, kept string, c long"
        both = both.withColumn("c", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            for t, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                data, gone = (t or "").encode(), union_of(spans)
                stays, at = [], 0
                for s, e in gone:
                    stays.append(data[at:s])
                    at = e
                stays.append(data[at:])
                left = b"".join(stays)
                for k, v in enumerate((len(data), len(data) - len(left), len(gone), hashlib.sha256(left).hexdigest(), [{"s": s, "e": e} for s, e in gone], t if not gone else left.decode(errors="ignore"))):
                    cols[k].append(v)
            arrays = [batch.column(0), *(pa.array(x, pa.int64()) for x in cols[:3]), pa.array(cols[3], pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if text:
                arrays += [pa.array(cols[4], pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))), pa.array(cols[5], pa.string()), batch.column(3)]
                names += ["removed", "kept", "c"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return both.mapInArrow(run, schema)


def clean(docs: DataFrame) -> DataFrame:
    """docs with the repeats taken out of their texts; all other columns stay, n_chars follows the text.

    A null text stays null; a character that is cut goes; rows are told apart by doc_id and text, as in without_repeats.
    """
    spans = repeated_spans(pick(docs, "doc_id", "text")).select(F.col("d").alias("_d"), F.col("c").alias("_c"), "spans")
    own = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("_row"))
    both = own.join(spans, (F.coalesce("_id", F.lit(NULL_ID)) == F.col("_d")) & (F.xxhash64("_text") == F.col("_c")), "left")

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, s in zip(texts, spans):
            data, at, stays = (t or "").encode(), 0, []
            for a, b in union_of(None if s is None else list(s)):
                stays.append(data[at:a])
                at = b
            out.append(t if not stays else b"".join([*stays, data[at:]]).decode(errors="ignore"))
        return pd.Series(out, dtype=object)

    both = both.withColumn("_new", F.when(F.col("spans").isNull(), F.col("_text")).otherwise(cut("_text", "spans")))
    new = {"text": F.col("_new"), "n_chars": F.when(F.col("spans").isNull(), F.col("_row.n_chars")).otherwise(F.length("_new").cast("long")) if "n_chars" in docs.columns else None}
    return both.select(*[(new[c] if c in new else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])
