"""Hybrid retrieval for many queries: exact nearest neighbours, BM25, fused ranks, spread over files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakewright.operators import text_index
from lakewright.operators.packed import best_of_packed, first_of, pack
from lakewright.operators.text_index import BLOCKS, MOST_ROWS, best_of, chunks_of
from lakewright.session import materialize

RRF, TEXT_WEIGHT, BOTH = 60, 1.12, 0.003
#: What a candidate gets for a place in its document, and for a title.
ANCHOR, TITLE = 0.0015, 0.0012
#: The columns that name such a place, and such a title.
ANCHORS, TITLES = ("semantic_unit_id", "page", "slide", "sheet", "range", "source_label"), ("title", "section_title", "citation")
#: Vectors fetched for each one wanted, before the cap of each file; and that cap's least value in a hybrid search.
FETCH, HYBRID_CAP = 3, 4
#: Rows of a block at least, as in text_index; probes of a block, in such blocks; rows and probes whose products are taken at once.
BLOCK, PROBES = 4096, 8
TILE, PROBE_TILE = 4096, 256


def clamp(value: float | None, low: int, high: int) -> int:
    """Not a number: the highest."""
    return high if value is None or value != value else int(max(low, min(high, value)))


def budget(k: float | None = 6) -> tuple[int, int]:
    """Result size and candidates for each side."""
    n = clamp(k, 1, 24)
    return n, clamp(max(4 * n, 24), n, 80)


def nearest(rows: DataFrame, probes: DataFrame, k: int, vector: str = "embedding", key: str = "vec_id", extra: tuple[str, ...] = (), block: int = BLOCK) -> DataFrame:
    """(q, key, extra columns, distance, score, nr): the k rows at the smallest squared L2 distance from each probe (q, vector); ties by key.

    Blocks of rows meet blocks of probes, a task for each pair, which goes over its rows a tile at a time and leaves its k best
    rows a probe, packed. Vectors that are null, or that hold a null or another number of components than the probe, are at no
    distance.
    """
    n, m = rows.count(), probes.count()
    blocks, parts = max(1, -(-n // max(block, MOST_ROWS)), min(BLOCKS, -(-n // block))), max(1, -(-m // (PROBES * block)))
    chunks, tasks = max(parts, chunks_of(m)), blocks * parts
    to_all = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    whole = lambda c: F.col(c).isNotNull() & ~F.exists(c, lambda x: x.isNull() | F.isnan(x))
    kinds = {c: rows.schema[c].dataType.simpleString() for c in extra}
    # floats are passed on as they are
    narrow = {t.schema[c].dataType.simpleString() for t, c in ((rows, vector), (probes, "vector"))} == {"array<float>"}
    v = lambda c: F.col(c).cast("array<float>" if narrow else "array<double>").alias("v")
    left = rows.filter(whole(vector)).select(F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("task"), to_all(parts).alias("part"), F.lit(None).cast("int").alias("chunk"), F.col(key).cast("long").alias("key"), v(vector), *extra)
    right = probes.filter(whole("vector")).select(F.pmod(F.xxhash64("q"), F.lit(chunks)).cast("int").alias("chunk"), to_all(blocks).alias("task"), F.col("q").cast("long").alias("key"), v("vector"))
    right = right.select("task", (F.col("chunk") % parts).alias("part"), "chunk", "key", "v", *[F.lit(None).cast(t).alias(c) for c, t in kinds.items()])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = list(batches)
        all_ = pa.Table.from_batches(found) if found else None
        for task in all_["task"].unique() if found else ():
            own = all_.filter(pc.equal(all_["task"], task))
            have, want = own.filter(pc.is_null(own["chunk"])), own.filter(pc.is_valid(own["chunk"]))
            for dim in pc.list_value_length(want["v"]).unique():
                same, asked = (t.filter(pc.equal(pc.list_value_length(t["v"]), dim)) for t in (have, want))
                a, b = (t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(t.num_rows, dim.as_py()) for t in (same, asked))
                qs, keys, chunk = asked["key"].to_numpy(), same["key"].to_numpy(), asked["chunk"].to_numpy()
                for x in np.unique(chunk):
                    of_chunk = np.flatnonzero(chunk == x)
                    for at in range(0, len(of_chunk), PROBE_TILE) if len(a) else ():
                        i = of_chunk[at : at + PROBE_TILE]
                        probe, row, d = _nearest(a, keys, b[i], k)
                        best = same.select(["key", *extra]).take(pa.array(row)).add_column(0, "q", pa.array(qs[i][probe])).append_column("value", pa.array(d))
                        yield pa.record_batch({"chunk": pa.array([x], pa.int32()), "found": pa.array([pack(best)], pa.binary())})

    task = (F.col("task") * parts + F.col("part")).alias("task")
    found = left.unionByName(right).select(task, "chunk", "key", "v", *extra).repartitionById(tasks, "task").mapInArrow(meet, "chunk int, found binary")
    found = best_of_packed(found, chunks, k, "".join(f", {c} {t}" for c, t in kinds.items())).withColumnRenamed("value", "distance")
    return found.withColumn("score", 1 / (1 + F.greatest("distance", F.lit(0.0))))


def _nearest(a: np.ndarray, keys: np.ndarray, b: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(probe, row, distance) of the k rows of a nearest to each probe of b, ties by key."""
    squares, probe_squares = (a * a).sum(axis=1), (b * b).sum(axis=1)
    slack = 1e-9 * (1 + squares.max() + probe_squares)
    bound, best = np.full(len(b), np.inf), (np.array([], np.int64), np.array([], np.int64), np.array([]))
    for s in range(0, len(a), TILE):
        # what may be among the k best, by products; their distances are then taken exactly
        rough = squares[s : s + TILE] - 2 * (b @ a[s : s + TILE].T)
        if rough.shape[1] > k and np.isinf(bound).any():
            bound = np.minimum(bound, np.partition(rough, k - 1, axis=1)[:, k - 1])
        probe, row = np.nonzero(~(rough > (bound + slack)[:, None]))
        row += s
        d = ((a[row] - b[probe]) ** 2).sum(axis=1)
        probe, row, d = (np.concatenate(x) for x in zip(best, (probe, row, d)))
        at, nr = first_of(probe, d, keys[row], k)
        best = probe, row, d = probe[at], row[at], d[at]
        last = nr == k
        bound[probe[last]] = d[last] - probe_squares[probe[last]]
    return best


def capped(found: DataFrame, k: int, file: str, cap: int) -> DataFrame:
    """Of rows (q, nr, file) in order of nr: at most cap of each file, then the first k of each query, numbered anew."""
    nth = F.row_number().over(Window.partitionBy("q", file).orderBy("nr"))
    return best_of(found.withColumn("_n", nth).filter(F.col("_n") <= cap).drop("_n"), k, F.col("nr"))


def anchor_bonus(row: DataFrame) -> Column:
    """For a place in the document, and for a title, by those of the columns that row has; empty ones count as none."""
    any_ = lambda names: F.coalesce(*[F.when(F.col(c).cast("string") != "", True) for c in names if c in row.columns], F.lit(False))
    return F.when(any_(ANCHORS), ANCHOR).otherwise(0.0) + F.when(any_(TITLES), TITLE).otherwise(0.0)


def fuse(vector_hits: DataFrame, text_hits: DataFrame) -> DataFrame:
    """Joins both sides on (q, id): vector (q, id, nr, score), text (q, id, nr, rank); adds blended and both. A missing side counts nothing."""
    v = vector_hits.select("q", "id", F.col("score").alias("v_score"), F.col("nr").alias("rv"))
    t = text_hits.select("q", "id", F.col("rank").alias("t_rank"), F.col("nr").alias("rt"))
    both = v.join(t, ["q", "id"], "full_outer").withColumn("both", F.col("rv").isNotNull() & F.col("rt").isNotNull())
    blended = F.coalesce(1 / (RRF + F.col("rv")), F.lit(0.0)) + F.coalesce(TEXT_WEIGHT / (RRF + F.col("rt")), F.lit(0.0)) + F.when(F.col("both"), BOTH).otherwise(0.0)
    return both.withColumn("blended", blended)


def diversify(candidates: DataFrame, k: int, cap: int = 2, file: str = "file") -> DataFrame:
    """k candidates of each query, one of each file first and then up to cap + 1, if that finds at least min(k, 2) files; else the best with cap of each file.

    candidates holds q, id, file and the columns of fuse; at most a few hundred rows a query. Score: blended over the largest kept.
    """
    order = [F.col("blended").desc(), F.col("both").desc(), F.coalesce("v_score", F.lit(0.0)).desc(), F.coalesce("t_rank", F.lit(float("inf"))), F.col("id")]
    all_ = Window.partitionBy("q")
    d = candidates.withColumn("place", F.row_number().over(all_.orderBy(*order))).withColumn("nth", F.row_number().over(Window.partitionBy("q", file).orderBy("place")))
    d = d.withColumn("_n", F.count("*").over(all_)).withColumn("_files", F.sum(F.when(F.col("nth") == 1, 1).otherwise(0)).over(all_))
    two = (F.lit(cap > 1)) & (F.col("_n") > k) & (F.least("_files", F.lit(k)) >= min(k, 2))
    d = d.filter(F.col("nth") <= F.when(two, cap + 1).otherwise(cap))
    d = d.withColumn("pos", F.row_number().over(all_.orderBy((two & (F.col("nth") > 1)).cast("int"), "place"))).filter(F.col("pos") <= k)
    best = F.max("blended").over(all_)
    return d.withColumn("final_score", F.least(F.greatest(F.col("blended") / best, F.lit(0.0)), F.lit(1.0))).drop("_n", "_files")


def candidates(rows: DataFrame, vectors: DataFrame, queries: DataFrame, k: float | None = 6, cap: int = 2) -> DataFrame:
    """Both sides' best rows of each query with their fused ranks, bonuses and files. See hybrid."""
    n, wanted = budget(k)
    probes = queries.filter("vector IS NOT NULL").select("q", "vector")
    # a row without a file is a file of its own
    file_of = lambda key: F.coalesce(F.col("file").cast("string"), F.concat(F.lit("id:"), F.col(key).cast("string"))).alias("file")
    own = vectors.join(rows.select(F.col("id").alias("vec_id"), "file"), "vec_id", "left").select(*vectors.columns, file_of("vec_id"))
    v = capped(nearest(own, probes, FETCH * wanted, extra=("file",)), wanted, "file", max(cap, HYBRID_CAP))
    t = text_index.bm25(text_index.build(rows), queries, wanted)
    fused = materialize(fuse(v.withColumnRenamed("key", "id"), t.withColumnRenamed("key", "id")), "fused")
    named = rows.select("id", "file", anchor_bonus(rows).alias("bonus"))
    d = fused.join(named, "id", "left").withColumn("bonus", F.coalesce("bonus", F.lit(0.0)))
    return d.withColumns({"file": file_of("id"), "blended": F.col("blended") + F.col("bonus")})


def hybrid(rows: DataFrame, vectors: DataFrame, queries: DataFrame, k: float | None = 6, cap: int = 2) -> DataFrame:
    """The k best rows for each query by both signals, spread over files.

    rows: id, file, the index's text columns and any of the anchor columns; vectors: vec_id (an id), embedding; queries: q,
    query (a text), vector (null: by text alone).
    """
    return diversify(candidates(rows, vectors, queries, k, cap), budget(k)[0], cap)


#: Fields of every result with their types where a table lacks them, and fields that a table may have.
BASE_FIELDS = {"id": "string", "course_id": "string", "file_id": "string", "file_name": "string", "file_path": "string", "section_id": "string", "task_file_bucket": "string", "chunk_index": "long", "chunk_count": "long", "text": "string", "title": "string", "citation": "string"}
MORE_FIELDS = ("source_path", "source_label", "section_type", "section_title", "artifact_id", "semantic_unit_id", "element_ids", "page", "slide", "sheet", "range", "bbox")


def result_fields(hits: DataFrame, *keep: str) -> DataFrame:
    """Only keep, the base fields, those of the others that hits has, and distance, so that a scan reads no more columns."""
    base = [F.col(c) if c in hits.columns else F.lit(None).cast(kind).alias(c) for c, kind in BASE_FIELDS.items()]
    return hits.select(*keep, *base, *[c for c in MORE_FIELDS if c in hits.columns], "distance")
