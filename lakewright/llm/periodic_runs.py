"""Runs of a period: passages of a text that repeat the same words three times or more."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewright.llm.common import BLANK, let, pick

#: A run has so many periods, and so many words, at least.
MIN_EXP, MIN_LENGTH = 3, 24
#: Comparisons of one range of lags. A document of more is scanned by several tasks.
RANGE = 1 << 25
#: Comparisons made at once, so that they stay in the processor's cache.
BLOCK = 1 << 18
#: Eight true places in a row.
FULL = np.uint64(0x0101010101010101)
RUN = "struct<start:long,length:long,period:long>"


def word_ids(words: list[bytes]) -> np.ndarray:
    """Equal words have equal ids, in the narrowest type that leaves the largest value free."""
    known: dict[bytes, int] = {}
    ids = np.fromiter([known.setdefault(w, len(known)) for w in words], np.uint32, len(words))
    return ids.astype(np.uint8 if len(known) < 0xFF else np.uint16 if len(known) < 0xFFFF else np.uint32)


def lag_ranges(n: int, min_exp: int = MIN_EXP, size: int = RANGE) -> list[tuple[int, int]]:
    """The lags from 1 to n / min_exp in ranges [low, high) of about equally many comparisons, size at most where a range has several lags."""
    last = n // min_exp
    if last < 1:
        return []
    # lags up to q take q * (n - (q + 1) / 2) comparisons
    total = last * (n - (last + 1) / 2)
    parts = min(last, -(-int(total) // size))
    goals = total * np.arange(1, parts) / parts
    edges = np.floor((2 * n - 1 - np.sqrt((2 * n - 1.0) ** 2 - 8 * goals)) / 2).astype(int) + 1
    cuts = sorted({1, last + 1, *(int(e) for e in edges if 1 < e <= last)})
    return list(zip(cuts, cuts[1:]))


def scan(ids: np.ndarray, low: int, high: int, min_exp: int = MIN_EXP, min_length: int = MIN_LENGTH) -> list[tuple[int, int, int]]:
    """(start, length, period) of the stretches that repeat at a lag in [low, high), each by its smallest such lag.

    The array is compared with itself at each lag, many lags at once, and the true stretches are measured. A stretch that a
    lag and a divisor of it both give is the same one, as it holds at least min_exp >= 2 of the larger period.
    """
    n = len(ids)
    if n == 0 or low >= high:
        return []
    end = np.iinfo(ids.dtype).max  # no word's id: nothing equals what lies behind the text
    padded = np.concatenate([ids, np.full(high, end, ids.dtype)])
    # the shortest stretch of equal places, over all lags
    least = int(min(max((min_exp - 1) * q, min_length - q) for q in {low, high - 1, *(q for q in (min_length // min_exp, min_length // min_exp + 1) if low <= q < high)}))
    rows = max(1, BLOCK // n)
    found: dict[tuple[int, int], int] = {}
    for first in range(low, high, rows):
        lags = np.arange(first, min(first + rows, high))
        equal = np.lib.stride_tricks.sliding_window_view(padded[first : first + n + len(lags) - 1], n) == ids
        if least >= 15:
            # a stretch fills an aligned group of eight places, and rows don't run into each other: each ends behind the text
            full = np.flatnonzero(equal.reshape(-1)[: equal.size // 8 * 8].view(np.uint64) == FULL)
            if not len(full):
                continue
            hit = np.unique(full * 8 // n)
            lags, equal = lags[hit], equal[hit]
        same = np.flatnonzero(equal)
        if not len(same):
            continue
        breaks = np.flatnonzero(np.diff(same) != 1) + 1
        begin = np.concatenate([[0], breaks])
        size = np.diff(np.concatenate([begin, [len(same)]]))
        row, start = np.divmod(same[begin], n)
        lag = lags[row]
        keep = size >= np.maximum((min_exp - 1) * lag, min_length - lag)
        for s, m, q in zip(start[keep].tolist(), size[keep].tolist(), lag[keep].tolist()):
            found.setdefault((s, m + q), q)
    return [(s, m, q) for (s, m), q in found.items()]


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """False where a run holds a word behind its first period."""
    depth = np.zeros(n + 1, np.int64)
    for s, m, q in runs:
        depth[s + q] += 1
        depth[s + m] -= 1
    return np.cumsum(depth[:n]) == 0


def _finished(batch: pa.RecordBatch, words: list[list[bytes]], runs: list[list[tuple[int, int, int]]]) -> pa.RecordBatch:
    """doc_id with the number of words, runs and the text that is left."""
    left = [b" ".join([w for w, k in zip(ws, kept_words(len(ws), rs).tolist()) if k] if rs else ws) for ws, rs in zip(words, runs)]
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    listed = pa.array([[dict(zip(("start", "length", "period"), r)) for r in rs] for rs in runs], kind)
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(w) for w in words], pa.int64()), listed, pa.array(left, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Batches of bounded bytes."""
    step = max(1, int(batch.num_rows * 8_000_000 / max(1, batch.nbytes)))
    for i in range(0, batch.num_rows, step):
        yield batch.slice(i, step)


def _texts(column: pa.Array) -> list[list[bytes]]:
    """The words of each text; bytes are split at the six blanks and nowhere else."""
    return [(t or b"").split() for t in column.cast(pa.binary()).to_pylist()]


def periodic_runs(docs: DataFrame, min_exp: int = MIN_EXP, min_length: int = MIN_LENGTH, size: int = RANGE) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_words, runs, collapsed.

    A run is a stretch of words with smallest period q, of min_length and min_exp * q words at least (min_exp from 2), that
    can't be made longer; runs holds (start, length, period) by start, then period. collapsed has the words, joined by one
    space, that stand in no run behind its first period. Null and empty texts: no words, no runs, empty. Repeated rows each
    get their row, and so do rows without id. Empty table: no rows.

    All lags of a text are compared. Texts whose comparisons fit one range stay where they are; of a longer one the word
    ids are dealt out with ranges of lags, and what the ranges find is put together by document.
    """
    # n words have at least 2 n - 1 characters, and take 5 n² / 18 comparisons at an exponent of 3
    long = int(2 * (size * 2 * min_exp * min_exp / (2 * min_exp - 1)) ** 0.5)
    d = pick(docs, "doc_id", "text")
    is_long = F.coalesce(F.length("text") > long, F.lit(False))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in _parts(b)):
            words = _texts(batch.column(1))
            yield _finished(batch, words, [sorted(scan(word_ids(w), 1, len(w) // min_exp + 1, min_exp, min_length)) for w in words])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in _parts(b)):
            for i, words in enumerate(_texts(batch.column(1))):
                ids = word_ids(words)
                for low, high in lag_ranges(len(ids), min_exp, size):
                    values = [[ids.tobytes()], [ids.dtype.itemsize], [low], [high]]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), batch.column(2).slice(i, 1), *[pa.array(v, k) for v, k in zip(values, (pa.binary(), pa.int32(), pa.int64(), pa.int64()))]], ["doc_id", "text_hash", "ids", "width", "low", "high"])

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 1) for b in batches for i in range(b.num_rows)):
            _, _, ids, width, low, high = (c[0].as_py() for c in batch.columns)
            found = scan(np.frombuffer(ids, f"u{width}"), low, high, min_exp, min_length)
            rows = pa.array([0] * len(found), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), *[pa.array([r[k] for r in found], pa.int64()) for k in range(3)]], ["doc_id", "text_hash", "start", "length", "period"])

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in _parts(b)):
            yield _finished(batch, _texts(batch.column(1)), [[(r["start"], r["length"], r["period"]) for r in rs or []] for rs in batch.column(2).to_pylist()])

    id_type = d.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {id_type}, n_words long, runs array<{RUN}>, collapsed string"
    short = d.filter(~is_long).mapInArrow(whole, out)
    texts = d.filter(is_long).withColumn("text_hash", F.sha2("text", 256))
    work = texts.mapInArrow(dealt, f"doc_id {id_type}, text_hash string, ids binary, width int, low long, high long").repartition("text_hash", "doc_id", "low")
    found = work.mapInArrow(ranges, f"doc_id {id_type}, text_hash string, start long, length long, period long")
    # a stretch is found by each multiple of its period, perhaps in another range
    found = found.groupBy("doc_id", "text_hash", "start", "length").agg(F.min("period").alias("period"))
    listed = found.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.sort_array(F.collect_list(F.struct("start", "length", "period"))).alias("runs"))
    both = texts.join(listed, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left").select("doc_id", "text", "runs")
    return short.unionByName(both.mapInArrow(finished, out))


def plant(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with the words of each tenth document, by its id's checksum, repeated from some place on; a document without id stays."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10).cast("long")

    def repeated(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
        words = F.transform(w, lambda x, i: F.when(i < a, x).otherwise(w[(a + (i - a) % p).cast("int")]))
        return F.when(n > 0, F.array_join(words, " ")).otherwise(F.lit(""))

    words = F.array_remove(F.split("text", BLANK + "+"), "")
    d = pick(docs, "doc_id", "text")
    return d.withColumn("text", F.when(h % 10 == 0, let(words, repeated)).otherwise(F.col("text")))


def digests(found: DataFrame) -> DataFrame:
    """The contract's columns of periodic_runs: the run of the greatest exponent, and the digests of runs and text."""

    def better(a: Column, b: Column) -> Column:
        # exact: a's exponent against b's; runs come by start, then period, so the earlier wins ties
        more = b["length"] * a["period"] > a["length"] * b["period"]
        return F.when(a.isNull() | more, b).otherwise(a)

    best = F.aggregate("runs", F.lit(None).cast(RUN), better)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    d = found.withColumn("_best", best)
    return d.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("_best.start").alias("start"),
        F.col("_best.length").alias("length"),
        F.col("_best.period").alias("period"),
        F.expr("1000 * _best.length div _best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def planted_runs(docs: DataFrame) -> DataFrame:
    return digests(periodic_runs(plant(docs)))
