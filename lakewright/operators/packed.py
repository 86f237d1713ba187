"""Tables as single values, and the best rows of many queries from such values."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows of a query's chunk that are put together before they are cut to the best ones.
HELD = 1 << 20


def pack(table: pa.Table) -> bytes:
    """A table as one compressed value."""
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table.combine_chunks())
    return out.getvalue().to_pybytes()


def unpack(value: bytes) -> pa.Table:
    with pa.ipc.open_stream(value) as reader:
        return reader.read_all()


def first_of(q: np.ndarray, value: np.ndarray, key: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are the first k of each query q by value, then key, in this order, and their places from 1."""
    order = np.lexsort((key, value, q))
    start = np.flatnonzero(np.append(True, np.diff(q[order]) != 0))[: len(order)]
    nr = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order)))) + 1
    return order[nr <= k], nr[nr <= k]


def best_of_packed(found: DataFrame, chunks: int, k: int, extra: str = "") -> DataFrame:
    """(q, key, extra columns, value, nr): the first k rows of each query by value, then key, from packed rows (chunk, found).

    A query's rows are in one of the chunks, and a task has a chunk; rows are put together in Arrow, without a sort by Spark.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.Table]] = {}

        def best(tables: list[pa.Table]) -> tuple[pa.Table, np.ndarray]:
            all_ = pa.concat_tables(tables).combine_chunks()
            at, nr = first_of(*(all_[c].to_numpy() for c in ("q", "value", "key")), k)
            return all_.take(pa.array(at)), nr

        for batch in batches:
            for chunk, value in zip(batch["chunk"].to_pylist(), batch["found"]):
                tables = held.setdefault(chunk, [])
                tables.append(unpack(value.as_py()))
                if len(tables) > 1 and sum(t.num_rows for t in tables[1:]) > HELD:
                    held[chunk] = [best(tables)[0]]
        for tables in held.values():
            got, nr = best(tables)
            yield from got.append_column("nr", pa.array(nr, pa.int32())).to_batches()

    return found.select("chunk", "found").repartitionById(chunks, "chunk").mapInArrow(run, f"q long, key long{extra}, value double, nr int")
