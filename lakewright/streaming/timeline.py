"""Event logs as turns, running texts and run states; the same reduction in batch and as a stream."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Event kinds that change a run's state.
STATES = {"signup": "running", "purchase": "completed", "error": "failed"}


def turns(records: DataFrame) -> DataFrame:
    """Each user record opens a turn of its conversation; records before the first belong to none."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    n = F.sum((F.col("role") == "user").cast("long")).over(w)
    return records.select("conv_id", "turn", n.alias("turn_no")).filter("turn_no > 0").groupBy("conv_id", "turn_no").agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.count("*").alias("records"))


def deltas(records: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """Adds running: all texts of the key up to the record, in order."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return records.withColumn("running", F.array_join(F.collect_list(text).over(w), ""))


def running_digests(records: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """(key, order, digest, length): the MD5 of all texts of the key up to each record, and their characters; null texts are empty.

    A task reads its keys' records in order and holds one digest, so work is in proportion to the texts. A key's records
    are one sequence by nature: each digest goes on from the one before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, digest, length, begun = None, hashlib.md5(), 0, False
        for batch in batches:
            digests, lengths = [], []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if not begun or k != last:
                    last, digest, length, begun = k, hashlib.md5(), 0, True
                digest.update((t or "").encode())
                length += len(t or "")
                digests.append(digest.hexdigest())
                lengths.append(length)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.string()), pa.array(lengths, pa.int64())], [key, order, "digest", "length"])

    d = records.select(key, order, text).repartition(key).sortWithinPartitions(key, order)
    kind = lambda c: d.schema[c].dataType.simpleString()
    return d.mapInArrow(run, f"{key} {kind(key)}, {order} {kind(order)}, digest string, length long")


def state_of(kind: F.Column) -> F.Column:
    out = F.lit(None).cast("string")
    for k, v in STATES.items():
        out = F.when(kind == k, v).otherwise(out)
    return out


def run_states(events: DataFrame) -> DataFrame:
    """The latest state of each user with the event that set it. Batch or stream (complete or update mode)."""
    told = events.filter(F.col("event_type").isin(*STATES))
    return told.groupBy("user_id").agg(F.max_by(state_of(F.col("event_type")), "event_id").alias("status"), F.max("event_id").alias("seq"))


def live_deltas(records: DataFrame) -> DataFrame:
    """deltas for a stream of (conv_id, turn, text): each batch gives the running text after each of its records.

    State for a conversation: the text so far. Records of a conversation must come in order, as a log gives them.
    """

    def grow(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        so_far = state.get[0] if state.exists else ""
        rows = pd.concat(frames).sort_values("turn")
        out = []
        for t, x in zip(rows["turn"], rows["text"]):
            so_far += x or ""
            out.append((key[0], t, so_far))
        state.update((so_far,))
        yield pd.DataFrame(out, columns=["conv_id", "turn", "running"])

    return records.groupBy("conv_id").applyInPandasWithState(grow, "conv_id long, turn long, running string", "so_far string", "append", "NoTimeout")


def live_digests(records: DataFrame) -> DataFrame:
    """running_digests for a stream of (conv_id, turn, text), in order: each batch reads a conversation's text so far once, not once a record."""

    def grow(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        so_far = state.get[0] if state.exists else ""
        rows = pd.concat(frames).sort_values("turn")
        digest, length, out = hashlib.md5(so_far.encode()), len(so_far), []
        for turn, text in zip(rows["turn"], rows["text"]):
            digest.update((text or "").encode())
            length += len(text or "")
            out.append((key[0], turn, digest.hexdigest(), length))
        state.update((so_far + "".join(t or "" for t in rows["text"]),))
        yield pd.DataFrame(out, columns=["conv_id", "turn", "digest", "length"])

    return records.groupBy("conv_id").applyInPandasWithState(grow, "conv_id long, turn long, digest string, length long", "so_far string", "append", "NoTimeout")
