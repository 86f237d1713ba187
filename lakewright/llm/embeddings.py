"""Embedding near-duplicates by int8 tile products with error bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakewright.llm.common import pick
from lakewright.llm.components import components, merge_labels
from lakewright.session import materialize

THRESHOLD = 0.9
#: About so many vectors make a tile; at most so many pivots are drawn.
TILE, PIVOTS = 2048, 4096
#: Tiles are put into about so many blocks, until a block would hold more than so many bytes in double precision; bytes of a tile at most.
BLOCKS, BLOCK_BYTES, TILE_BYTES = 8, 64_000_000, 16_000_000
#: Above this share of possible pairs a tile pair is recomputed as a whole.
DENSE = 0.02
SLACK = 1e-9


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def quantise(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, scales, norms of what was lost and norms of what is kept, for unit vectors."""
    scale = np.abs(u).max(axis=1) / 127
    q = np.rint(u / scale[:, None]).astype(np.int8)
    back = q * scale[:, None]
    return q, scale, np.linalg.norm(u - back, axis=1), np.linalg.norm(back, axis=1)


def possible(a: tuple, b: tuple, threshold: float) -> np.ndarray:
    """Which pairs may reach the threshold, from int8 products: the true cosine differs by at most lost_a * kept_b + lost_b."""
    wide = np.float32 if a[0].shape[1] * 127 * 127 < 1 << 24 else np.float64
    near = (a[0].astype(wide) @ b[0].astype(wide).T) * a[1][:, None].astype(wide) * b[1][None, :].astype(wide)
    near += (a[2][:, None] * b[3][None, :] + b[2][None, :]).astype(wide)
    return near >= threshold - 1e-5


def links(u: np.ndarray, v: np.ndarray | None, threshold: float = THRESHOLD, a: tuple | None = None, b: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i in u, j in v) of all pairs with a cosine of at least the threshold in double precision; with v None, pairs i < j in u.

    a, b: u and v quantised, where that has been done.
    """
    a = a or quantise(u)
    b = a if v is None else b or quantise(v)
    other = u if v is None else v
    maybe = possible(a, b, threshold)
    if v is None:
        maybe = np.triu(maybe, 1)
    if maybe.mean() > DENSE:
        maybe &= u @ other.T >= threshold
        return np.nonzero(maybe)
    i, j = np.nonzero(maybe)
    exact = np.concatenate([np.einsum("nd,nd->n", u[i[k : k + 65536]], other[j[k : k + 65536]]) for k in range(0, len(i), 65536)] or [np.zeros(0)]) >= threshold
    return i[exact], j[exact]


def _valid(e: F.Column) -> F.Column:
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(e, lambda x: x != 0), F.lit(False))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE, pivots: int = PIVOTS) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors (vec_id, embedding: array of float or double).

    Equal vectors are compared as one, which counts for all of them. Each different vector belongs to the nearest of a
    bounded number of drawn pivots; cells are cut into tiles of about the same size, so that a large group of like vectors
    is spread. Two cells meet unless the angle between their pivots exceeds both radii and the threshold's angle
    together, which loses no pair. Tiles that meet are compared by int8 products.
    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing; so do vectors of
    different lengths with each other. Repeated rows are vectors of their own that link; a null vec_id counts as larger
    than any other. A very long vector makes its tiles smaller. Empty table: no rows.
    """
    placed = _placed(_written(pick(vectors, "vec_id", "embedding")), threshold, tile, pivots)
    firsts = placed.groupBy(F.col("root").alias("_root")).agg(F.min("vec_id").alias("component_id"))
    out = placed.join(firsts, F.col("root") == F.col("_root"))
    return out.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _written(vectors: DataFrame) -> DataFrame:
    """vectors' rows as row, with vec_id, embedding, and a number uid for each row, which stays with it once it is written."""
    row = F.struct(*[F.col(f"`{c}`") for c in vectors.columns])
    return materialize(vectors.select(F.col("vec_id").alias("vec_id"), F.col("embedding").alias("embedding"), row.alias("row"), F.monotonically_increasing_id().alias("uid")), "vectors")


def _placed(base: DataFrame, threshold: float, tile: int, pivots: int) -> DataFrame:
    """vec_id, uid, n_links and root (the component's smallest uid among its different vectors) for each row of base."""
    spark = base.sparkSession
    code = "<f4" if isinstance(base.schema["embedding"].dataType.elementType, T.FloatType) else "<f8"
    keyed = base.select("vec_id", "uid", F.when(_valid(F.col("embedding")), F.col("embedding")).alias("embedding"))
    # 128 bits of hash stand for a vector; a vector that links with nothing has none
    keys = [F.when(F.col("embedding").isNotNull(), F.xxhash64(F.lit(k), "embedding")).alias(f"h{k}") for k in (1, 2)]
    keyed = keyed.select("vec_id", "uid", "embedding", *keys)
    grouped = keyed.filter("embedding IS NOT NULL").groupBy("h1", "h2").agg(F.min("uid").alias("rep"), F.count("*").alias("copies"), F.any_value("embedding").alias("embedding"))
    good = materialize(grouped.withColumn("dim", F.size("embedding")), "different")
    counts = {r["dim"]: r["n"] for r in good.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    found = None
    for dim, n in sorted(counts.items()):
        one = _links(good.filter(F.col("dim") == dim), dim, n, threshold, min(tile, max(1, TILE_BYTES // (8 * dim))), pivots, code)
        found = one if found is None else found.unionByName(one)
    links_of = materialize(found if found is not None else spark.createDataFrame([], "uid long, n long, root long"), "vector-links")
    roots = components(links_of.select(F.col("uid").alias("a"), F.col("root").alias("b")))
    sums = links_of.groupBy(F.col("uid").alias("_u")).agg(F.sum("n").alias("n"))
    reps = good.select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), "rep", "copies")
    reps = reps.join(sums, F.col("rep") == F.col("_u"), "left").join(roots, F.col("rep") == F.col("node"), "left")
    reps = materialize(reps.select("_h1", "_h2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), F.coalesce("root", "rep").alias("root")), "classes")
    out = keyed.select("vec_id", "uid", "h1", "h2").join(reps, (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")), "left")
    return materialize(out.select("vec_id", "uid", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("root", "uid").alias("root")), "placed")


def _links(good: DataFrame, dim: int, n: int, threshold: float, tile: int, pivots: int, code: str) -> DataFrame:
    """(uid, n, root) for different vectors of one length: how many rows they link with in a pair of blocks, and to which uid.

    Tiles are put into blocks of neighbouring cells. A task compares two blocks, so a vector is sent to as many tasks as
    there are blocks with cells that its block's cells meet, not to as many as there are tiles. Blocks grow with the table
    from n / BLOCKS vectors to what BLOCK_BYTES hold.
    """
    spark = good.sparkSession
    k = min(pivots, -(-n // tile))
    drawn = good.orderBy(F.xxhash64("rep"), "rep").limit(k).select("embedding").collect()
    pivot = unit(np.array([r[0] for r in drawn]))
    # cells in order of the pivots' main direction, so that blocks are of neighbouring cells
    pivot = pivot[np.argsort((pivot - pivot.mean(axis=0)) @ np.linalg.svd(pivot - pivot.mean(axis=0), full_matrices=False)[2][0], kind="stable")]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            near = unit(x) @ pivot.T
            cell = near.argmax(axis=1)
            data = x.astype(code)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell.astype(np.int32)), pa.array(np.arccos(np.clip(near[np.arange(len(cell)), cell], -1, 1))), pa.array([r.tobytes() for r in data], pa.binary())], ["uid", "copies", "cell", "angle", "data"])

    cells = materialize(good.select("rep", "copies", "embedding").mapInArrow(assign, "uid long, copies long, cell int, angle double, data binary"), "cells")
    stats = {r["cell"]: (r["n"], r["radius"]) for r in cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).collect()}
    size, radius = np.zeros(len(pivot), np.int64), np.full(len(pivot), -10.0)
    for c, (m, r) in stats.items():
        size[c], radius[c] = m, r
    start = np.cumsum(size) - size
    block = max(tile, min(-(-n // BLOCKS), max(1, BLOCK_BYTES // (8 * dim))))
    last = (n - 1) // block
    limit = np.arccos(min(1.0, max(-1.0, threshold))) + SLACK

    def meets(c: int) -> np.ndarray:
        return np.arccos(np.clip(pivot @ pivot[c], -1, 1)) <= radius + radius[c] + limit

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each block the blocks from it on with a cell that one of its cells meets, as seen from either."""
        end = start + size
        for batch in batches:
            for a in batch.column(0).to_pylist():
                own = np.flatnonzero((size > 0) & (start < (a + 1) * block) & (end > a * block))
                met = np.zeros(len(pivot), bool)
                for c in own:
                    met |= meets(c)
                hit = np.zeros(last + 2, np.int64)
                for c in np.flatnonzero(met & (size > 0)):
                    hit[start[c] // block] += 1
                    hit[(end[c] - 1) // block + 1] -= 1
                others = np.flatnonzero(np.cumsum(hit[:-1]) > 0)
                others = others[others >= a]
                me, it = np.full(len(others), a), others
                twice = it[it > a]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([me, twice])), pa.array(np.concatenate([me, np.full(len(twice), a)])), pa.array(np.concatenate([it, twice]))], ["_block", "a", "b"])

    # a cell's tiles lie side by side in the order of cells: where a tile begins tells its block
    table = spark.createDataFrame([(c, -(-m // tile), int(start[c]), m) for c, (m, _) in stats.items()], "_cell int, tiles int, start long, size long")
    salted = cells.join(table, F.col("cell") == F.col("_cell")).withColumn("part", F.pmod(F.xxhash64("uid"), "tiles").cast("int"))
    salted = salted.withColumn("block", F.floor((F.col("start") + F.floor(F.col("part") * F.col("size") / F.col("tiles"))) / F.lit(block)).cast("long"))
    packed = salted.groupBy("block", "cell", "part").agg(F.collect_list(F.struct("uid", "copies", "data")).alias("rows"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array([[r[f] for r in x] for x in rows], pa.list_(pa.int64())) for f in ("uid", "copies")), pa.array([b"".join(r["data"] for r in x) for x in rows], pa.binary())],
                ["block", "cell", "uids", "copies", "data"],
            )

    tiles = materialize(packed.select("block", "cell", "rows").mapInArrow(join, "block long, cell int, uids array<long>, copies array<long>, data binary"), "tiles")
    met = tiles.join(spark.range(last + 1).mapInArrow(pairs, "_block long, a long, b long"), F.col("block") == F.col("_block"))

    def compare(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        a, b = (x.as_py() for x in key)
        blocks, of_cell = rows.column("block").to_pylist(), rows.column("cell").to_pylist()
        ids = [np.array(x, np.int64) for x in rows.column("uids").to_pylist()]
        copies = [np.array(x, np.float64) for x in rows.column("copies").to_pylist()]
        units = [unit(np.frombuffer(d, code).reshape(len(k), -1)) for d, k in zip(rows.column("data").to_pylist(), ids)]
        small = [quantise(u) for u in units]
        begin = np.cumsum([0, *map(len, ids)])
        n_of, label = np.zeros(begin[-1]), np.arange(begin[-1])
        for s in range(len(ids)):
            if blocks[s] != a:
                continue
            near = meets(of_cell[s])
            for t in range(len(ids)):
                if blocks[t] != b or (a == b and t < s) or not near[of_cell[t]]:
                    continue
                i, j = links(units[s], None if s == t else units[t], threshold, small[s], small[t])
                if len(i):
                    n_of[begin[s] : begin[s + 1]] += np.bincount(i, copies[t][j], minlength=len(ids[s]))
                    n_of[begin[t] : begin[t + 1]] += np.bincount(j, copies[s][i], minlength=len(ids[t]))
                    label = merge_labels(label, begin[s] + i, begin[t] + j)
        every, some = np.concatenate(ids), np.flatnonzero(n_of)
        return pa.Table.from_arrays([pa.array(every[some]), pa.array(n_of[some].astype(np.int64)), pa.array(every[label[some]])], ["uid", "n", "root"])

    return met.select("a", "b", "block", "cell", "uids", "copies", "data").groupBy("a", "b").applyInArrow(compare, "uid long, n long, root long")


def deduplicate(vectors: DataFrame) -> DataFrame:
    """One row of each component: that with the smallest vec_id (null counts as largest), of these the first written."""
    base = _written(vectors)
    placed = _placed(base, THRESHOLD, TILE, PIVOTS)
    kept = placed.groupBy("root").agg(F.min(F.struct(F.col("vec_id").isNull(), "vec_id", "uid")).alias("least")).select(F.col("least.uid").alias("_kept"))
    return base.join(kept, F.col("uid") == F.col("_kept"), "left_semi").select(*[F.col(f"row.`{c}`").alias(c) for c in vectors.columns])
