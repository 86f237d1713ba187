"""Events of a stream of text blocks that arrives in pieces, cut anywhere."""

from __future__ import annotations

import codecs
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

EVENT = "n long, event string, data string"


def parse_block(block: str) -> tuple[str | None, str] | None:
    """(event, data) of a block: the last event line, and the data lines joined; comments go, one blank behind the colon goes. None without data."""
    event, data = None, []
    for line in block.split("\n"):
        if not line or line.startswith(":"):
            continue
        field, _, value = line.partition(":")
        value = value.removeprefix(" ")
        if field == "event":
            event = value
        elif field == "data":
            data.append(value)
    return (event, "\n".join(data)) if data else None


class Framer:
    """Takes bytes, gives the events that they complete. What is left over is a text and the bytes of a character cut in two."""

    def __init__(self, text: str = "", pending: bytes = b""):
        self.text = text
        self.decoder = codecs.getincrementaldecoder("utf-8")("replace")
        self.decoder.setstate((pending, 0))

    def push(self, data: bytes, final: bool = False) -> Iterator[tuple[str | None, str]]:
        text = self.text + self.decoder.decode(data, final)
        # a carriage return at the end may belong to a line end of which the rest is to come
        held = "\r" if text.endswith("\r") and not final else ""
        *blocks, self.text = text.removesuffix(held).replace("\r\n", "\n").split("\n\n")
        if final and self.text.strip():
            blocks.append(self.text)
        self.text += held
        return filter(None, map(parse_block, blocks))

    def left(self) -> tuple[str, bytes]:
        return self.text, self.decoder.getstate()[0]


def events(pieces: DataFrame, key: str = "stream", order: str = "seq", data: str = "data") -> DataFrame:
    """(key, n from 1, event, data) of each stream's pieces (bytes), in order; what stands behind the last blank line is a block as well.

    A task reads its streams in order and holds one open block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, last, framer, n = None, None, None, 0
        for batch in batches:
            kind, out = batch.schema.field(0).type, []
            for k, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if framer is None or k != last:
                    if framer is not None:
                        out += [(last, n + i, *e) for i, e in enumerate(framer.push(b"", final=True), 1)]
                    last, framer, n = k, Framer(), 0
                for e in framer.push(d or b""):
                    n += 1
                    out.append((k, n, *e))
            yield _batch(out, kind, key)
        if framer is not None:
            yield _batch([(last, n + i, *e) for i, e in enumerate(framer.push(b"", final=True), 1)], kind, key)

    d = pieces.select(key, order, data).repartition(key).sortWithinPartitions(key, order).select(key, data)
    return d.mapInArrow(run, f"{key} {d.schema[key].dataType.simpleString()}, {EVENT}")


def _batch(rows: list[tuple], kind: pa.DataType, key: str) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [(), (), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (kind, pa.int64(), pa.string(), pa.string()))], [key, "n", "event", "data"])


class _Frames(StatefulProcessor):
    """State of a stream: the open block, the bytes of an open character, the number of events so far."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", StructType([StructField("text", StringType()), StructField("pending", BinaryType()), StructField("n", LongType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        text, pending, n = self.open.get() if self.open.exists() else ("", b"", 0)
        framer, out = Framer(text, bytes(pending)), []
        for d, end in pd.concat(rows).sort_values("seq")[["data", "last"]].itertuples(index=False):
            for e in framer.push(bytes(d or b""), final=bool(end)):
                n += 1
                out.append((key[0], n, *e))
        self.open.update((*framer.left(), n))
        yield pd.DataFrame(out, columns=["stream", "n", "event", "data"])

    def close(self) -> None:
        pass


def live_events(pieces: DataFrame) -> DataFrame:
    """events for a stream of (stream, seq, data, last), whose pieces come in order; last marks a stream's end. Needs a state store that keeps named values (RocksDB)."""
    kind = pieces.schema["stream"].dataType.simpleString()
    return pieces.groupBy("stream").transformWithStateInPandas(_Frames(), f"stream {kind}, {EVENT}", "append", "None")
