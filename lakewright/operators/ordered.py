"""Work along one order of a whole table, in ranges: each range is passed once, and what is open at its start comes from the ranges before."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakewright.session import materialize

Step = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def in_ranges(df: DataFrame, order: list[Column], step: Step, added: str) -> DataFrame:
    """df with the columns that step adds to each range, and _range, the range's number.

    Ranges are of about equal size whatever the keys, if the order tells rows apart. The result is written, so that its
    ranges stay what they are.
    """
    d = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id())
    return materialize(d.mapInArrow(step, f"{d.schema.toDDL()}, {added}"), "ranges")


def _codes(column: pa.Array) -> np.ndarray:
    return column.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False) if not pa.types.is_null(column.type) else np.zeros(len(column), int)


def running(df: DataFrame, order: list[Column], by: tuple[str, ...] = (), value: str | None = None) -> DataFrame:
    """df with place (from 1) in this order within by, and total: the sum of value (integers, null counts as 0) up to the row.

    No task holds a whole group: ranges cut groups, and what a range's first group had before is added. order must tell
    rows apart, else equal rows are in some order.
    """

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, count, total = None, 0, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = [batch.column(batch.schema.get_field_index(b)) for b in by]
            change = np.zeros(n, bool)
            for k in keys:
                change[1:] |= np.diff(_codes(k)) != 0
            first = tuple(k[0].as_py() for k in keys)
            change[0] = last is None or first != last
            v = batch.column(batch.schema.get_field_index(value)).cast(pa.int64()).fill_null(0).to_numpy() if value else np.zeros(n, np.int64)
            sums = np.cumsum(v)
            starts = np.flatnonzero(change)
            at = np.searchsorted(starts, np.arange(n), side="right") - 1
            begun = np.where(at >= 0, starts[at] if len(starts) else 0, 0)
            before = np.where(at >= 0, sums[begun] - v[begun], 0)
            place = np.arange(n) - begun + 1 + np.where(at < 0, count, 0)
            sums = sums - before + np.where(at < 0, total, 0)
            last, count, total = tuple(k[n - 1].as_py() for k in keys), int(place[-1]), int(sums[-1])
            yield batch.append_column("place", pa.array(place)).append_column("total", pa.array(sums))

    d = in_ranges(df, [*[F.col(b) for b in by], *order], step, "place long, total long")
    ends = d.groupBy("_range", *by).agg(F.max("place").alias("_n"), F.sum(F.coalesce(F.col(value), F.lit(0)).cast("long") if value else F.lit(0)).cast("long").alias("_t"))
    # a row for each range and group in it: few, as each range but one begins at most one group that another range ends
    if by:
        before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        ends = ends.select("_range", *by, F.sum("_n").over(before).alias("_n"), F.sum("_t").over(before).alias("_t")).filter("_n IS NOT NULL")
    else:
        rows, n, t = [], 0, 0
        for r in sorted(ends.collect()):  # one row for each range
            rows.append((r["_range"], n, t))
            n, t = n + r["_n"], t + r["_t"]
        ends = d.sparkSession.createDataFrame(rows, "_range int, _n long, _t long")
    ends = ends.select(F.col("_range").alias("_r"), *[F.col(b).alias(f"_by{i}") for i, b in enumerate(by)], "_n", "_t")
    on = F.col("_range") == F.col("_r")
    for i, b in enumerate(by):
        on = on & F.col(b).eqNullSafe(F.col(f"_by{i}"))
    out = d.join(ends, on, "left")
    return out.select(*df.columns, (F.col("place") + F.coalesce("_n", F.lit(0))).alias("place"), (F.col("total") + F.coalesce("_t", F.lit(0))).alias("total"))


def filled(df: DataFrame, order: list[Column], value: str) -> DataFrame:
    """df with found: the value of the last row, up to the row, that has one."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried, at = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column(batch.schema.get_field_index(value))
            found = pc.fill_null_forward(v)
            if carried is not None and carried.is_valid:
                found = pc.fill_null(found, carried)
            carried = found[len(found) - 1]
            yield batch.append_column("found", found).append_column("_at", pa.array(np.arange(at, at + batch.num_rows)))
            at += batch.num_rows

    kind = df.schema[value].dataType.simpleString()
    d = in_ranges(df, order, step, f"found {kind}, _at long")
    ends = d.groupBy("_range").agg(F.max_by("found", "_at").alias("_last"))  # one row for each range
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(F.col("_range").alias("_r"), F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    return d.join(F.broadcast(ends), F.col("_range") == F.col("_r")).select(*df.columns, F.coalesce("found", "_carried").alias("found"))
