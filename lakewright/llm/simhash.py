"""SimHash near-duplicates with bit-sliced comparison."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lakewright.llm.common import pick
from lakewright.llm.components import components, merge_labels
from lakewright.session import materialize

SHINGLE, RADIUS, SEED = 3, 3, 42
#: Bits are cut into so many blocks; two fingerprints within the radius agree on BLOCKS - RADIUS of them at least.
BLOCKS = 6
#: About so many fingerprints of one bucket are compared at a time.
TILE = 1024
#: Buckets up to this size are compared together.
SMALL = 32


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of a whole text; bytes.lower and bytes.split know exactly A-Z and the six ASCII separators."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxh64_intdigest(joined, SEED)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: -shingle].tolist()]
    stops = (ends[shingle - 1 :] - 1).tolist()
    hashes = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, stops)], "<u8")
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        bits = np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (a signed long with the fingerprint's bits) for each row; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return pick(docs, "doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def planes_of(values: np.ndarray) -> list[int]:
    """Bit planes: plane k holds bit k of each value, as one long integer."""
    bits = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    packed = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")
    return [int.from_bytes(row.tobytes(), "little") for row in packed]


def within(planes: list[int], shift: int, alive: int, radius: int) -> int:
    """Which positions i of alive have a distance to i + shift within the radius: as a bit set.

    Carry-save counters take a plane at a time for all positions at once; it ends when every distance is over the radius.
    """
    counters = [0] * (radius + 1).bit_length()
    exact = (radius + 1).bit_count() == 1
    for k, plane in enumerate(planes):
        carry = (plane ^ (plane >> shift)) & alive
        for n in range(len(counters) - exact):
            counters[n], carry = counters[n] ^ carry, counters[n] & carry
        if exact:
            # the carry out of the counters means radius + 1 differences
            alive ^= alive & carry
        else:
            counters[-1] ^= carry
            over = alive
            for n in range(len(counters)):
                over &= counters[n] if (radius + 1) >> n & 1 else ~counters[n]
            alive ^= over
        if k % 4 == 3 and not alive:
            return 0
    return alive


def _positions(bits: int, n: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(bits.to_bytes((n + 7) // 8, "little"), np.uint8), bitorder="little"))


def spanning(values: np.ndarray, bucket: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Edges (value, smaller position's value) that connect what is linked inside buckets; at most one for each value.

    values: uint64, those of a bucket side by side.
    """
    n, planes, labels = len(values), planes_of(values), np.arange(len(values))
    largest = int(np.bincount(np.unique(bucket, return_inverse=True)[1]).max()) if n else 0
    for shift in range(1, largest):
        alive = int.from_bytes(np.packbits(bucket[:-shift] == bucket[shift:], bitorder="little").tobytes(), "little")
        if alive and (hits := within(planes, shift, alive, radius)):
            at = _positions(hits, n)
            labels = merge_labels(labels, at, at + shift)
    moved = np.flatnonzero(labels != np.arange(n))
    return values[moved], values[labels[moved]]


def near_pairs(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) over the different fingerprints (fp) that connect all fingerprints within the radius, directly or not.

    A bucket is an agreement on BLOCKS - radius blocks. A bucket of n fingerprints is cut into ceil(n / TILE) tiles, and
    each two tiles meet in a row of their own, so no task gets a whole large bucket and a tile pair's rows are bounded.
    """
    cuts = [round(64 * i / BLOCKS) for i in range(BLOCKS + 1)]
    block = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]
    masks = [sum(block[i] for i in kept) for kept in combinations(range(BLOCKS), BLOCKS - radius)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = nodes.select("fp", F.posexplode(F.array(*[F.lit(m).cast("long") for m in signed])).alias("t", "mask")).select("fp", "t", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    full = keyed.groupBy(F.col("t").alias("_t"), F.col("key").alias("_key")).agg(F.count("*").alias("n")).filter("n > 1")
    own = keyed.join(full, (F.col("t") == F.col("_t")) & (F.col("key") == F.col("_key")))
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    own = materialize(own.select("t", "key", "fp", tiles.alias("tiles"), F.pmod(F.xxhash64("fp"), tiles).cast("int").alias("tile")), "buckets")
    packed = own.groupBy("t", "key", "tiles", "tile").agg(F.collect_list("fp").alias("fps"))
    peers = F.when(F.col("tiles") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("tiles") - 1), lambda j: j != F.col("tile")))
    met = packed.select("t", "key", "tile", "fps", F.explode(peers).alias("peer"))
    met = met.groupBy("t", "key", F.least("tile", "peer").alias("i"), F.greatest("tile", "peer").alias("j")).agg(F.flatten(F.collect_list("fps")).alias("fps"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0)
            sizes = np.diff(rows.offsets.to_numpy())
            values = rows.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            bucket = np.repeat(np.arange(len(sizes)), sizes)
            small = np.repeat(sizes <= SMALL, sizes)
            found = [spanning(values[small], bucket[small], radius)] + [spanning(values[bucket == i], bucket[bucket == i], radius) for i in np.flatnonzero(sizes > SMALL)]
            a, b = (np.concatenate([x[k] for x in found]).view(np.int64) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return met.select("fps").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for each row of docs (doc_id, text).

    Null and empty texts have the fingerprint zero and link like any other. Repeated rows each get their row. A null
    doc_id gets a row and counts as larger than any other in its component. Empty table: no rows.
    """
    prints = materialize(fingerprints(docs, shingle), "fingerprints")
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(near_pairs(nodes, radius))
    placed = materialize(nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "placed")
    firsts = placed.groupBy(F.col("root").alias("_root")).agg(F.min("least").alias("component_id"))
    of = materialize(placed.join(firsts, F.col("root") == F.col("_root")).select(F.col("fp").alias("_fp"), "component_id"), "components")
    return prints.join(of, F.col("fp") == F.col("_fp")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _marked(docs: DataFrame, text: str) -> DataFrame:
    """docs with the fingerprint of each row as fp."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t) for t in batch.column(at).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found.view(np.int64))], [*batch.schema.names, "fp"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("fp", LongType())]))


def deduplicate(docs: DataFrame) -> DataFrame:
    """docs with exactly one row of each component of near-duplicates, whatever the rows' ids.

    It is the row with the smallest doc_id (null counts as largest), of these the one with the smallest text hash. Rows
    with the same doc_id and other texts are rows like any other. A row's key is its place in the written step.
    """
    # columns by their numbers meanwhile, so that none clashes with ours
    numbers = [f"c{i}" for i in range(len(docs.columns))]
    key, text = (numbers[docs.columns.index(c)] for c in ("doc_id", "text"))
    marked = materialize(_marked(docs.toDF(*numbers), text), "marked")
    place = [F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row")]
    keyed = marked.select("fp", F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id"), F.xxhash64(text).alias("hash"), *place).alias("key"))
    # the least row of each fingerprint first, so that no join has a row for each copy
    best = materialize(keyed.groupBy("fp").agg(F.min("key").alias("key")), "nodes")
    roots = components(near_pairs(best.select("fp")))
    placed = best.join(roots, F.col("fp") == F.col("node"), "left").select(F.coalesce("root", "fp").alias("root"), "key")
    kept = materialize(placed.groupBy("root").agg(F.min("key").alias("key")).select(F.col("key.file").alias("file"), F.col("key.row").alias("row")), "kept")
    return marked.select(*numbers, *place).join(kept, ["file", "row"], "left_semi").select(*numbers).toDF(*docs.columns)
