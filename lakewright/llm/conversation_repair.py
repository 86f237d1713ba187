"""Repair of conversations: blank, repeated and truncated rows, and roles out of order."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewright.llm import role_grammar as G
from lakewright.session import materialize

WORD = r"[^\x20\x09-\x0D]"
#: A block holds so many rows of a conversation, or so many characters, at most; a longer text is a block of its own.
ROWS, CHARACTERS = 1024, 1_000_000
ORDER = ("conv_id", "turn", "role", "text")


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns])


def _typed(batches: Iterator[pa.RecordBatch], names: list[str], types: list[pa.DataType], rows) -> Iterator[pa.RecordBatch]:
    """rows(batches) as batches of these columns; the first has the type of the input's first."""
    first = next(batches, None)
    if first is None:
        return

    def all_() -> Iterator[pa.RecordBatch]:
        yield first
        yield from batches

    held, size = [], 0
    kinds = [first.schema.field(0).type, *types]
    make = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)
    for weight, row in rows(all_()):
        held.append(row)
        size += weight
        if len(held) >= 2000 or size > 4 * CHARACTERS:
            yield make()
            held, size = [], 0
    if held:
        yield make()


def damage(conversations: DataFrame) -> DataFrame:
    """The contract's damage by the checksum of conv_id:turn: rows go, lose their text or its ends, stand twice, or change their role."""
    spelled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", spelled("conv_id"), spelled("turn"))) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    d = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind")).filter("kind <> 0")
    d = d.withColumn("text", F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
    d = d.withColumn("role", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")))
    return d.withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))).select(*ORDER)


def faults(rows: DataFrame) -> DataFrame:
    """rows with fault: blank, else a role and text that an earlier turn of the conversation has, else truncated.

    Repetition within a turn is left to what reads the rows in order. Groups of equal rows are summed up before they move.
    """
    d = rows.withColumn("digest", F.sha2("text", 256))
    at: Column = F.struct(F.col("turn").isNotNull().alias("has"), F.col("turn").alias("turn"))
    again = d.groupBy(*[F.col(c).alias(f"_{c}") for c in ("conv_id", "role", "digest")]).agg(F.min(at).alias("first"), F.max(at).alias("last")).filter("first <> last")
    d = d.join(again, F.col("conv_id").eqNullSafe(F.col("_conv_id")) & (F.col("role") == F.col("_role")) & (F.col("digest") == F.col("_digest")), "left")
    fault = (
        F.when(~F.col("text").rlike(WORD), G.BLANK)
        .when(F.coalesce(at > F.col("first"), F.lit(False)), G.DUPLICATE)
        .when(~F.rtrim(F.translate("text", "\t\n\x0b\f\r", "     ")).rlike("[.!?]$"), G.TRUNCATED)
        .otherwise(G.FINE)
    )
    return d.select(*ORDER, fault.alias("fault"))


def blocks(rows: DataFrame, size: int = ROWS, characters: int = CHARACTERS) -> DataFrame:
    """(conv_id, pid, seq, codes, roles, texts, first_turn, last_turn, turns, matrix): parts of conversations in order.

    Rows are dealt by ranges of the whole order, so that a conversation of many rows is spread over tasks. pid and seq
    order the parts; rows that are alike stand in one range.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, tuple]]:
        seq = 0
        for conv, members in groupby(_streamed(batches), key=lambda r: r[0]):
            before, held, weight = None, [], 0
            for _, turn, role, text, fault, pid in members:
                if (turn, role, text) == before and fault != G.BLANK:
                    fault = G.DUPLICATE
                before = (turn, role, text)
                if held and (len(held) == size or weight + len(text) > characters):
                    yield weight, block(conv, pid, seq, held)
                    seq, held, weight = seq + 1, [], 0
                held.append((turn, role, text, G.symbol(role, fault)))
                weight += len(text)
            yield weight, block(conv, pid, seq, held)
            seq += 1

    def block(conv, pid: int, seq: int, held: list[tuple]) -> tuple:
        turns = sorted({h[0] for h in held if h[0] is not None}) or [None]
        codes = bytes(h[3] for h in held)
        return conv, pid, seq, codes, [h[1] for h in held], [h[2] for h in held], turns[0], turns[-1], len(turns) if turns[0] is not None else 0, G.transfer(codes)

    names = ["conv_id", "pid", "seq", "codes", "roles", "texts", "first_turn", "last_turn", "turns", "matrix"]
    strings, long = pa.list_(pa.string()), pa.int64()
    kinds = [pa.int32(), long, pa.binary(), strings, strings, long, long, long, pa.list_(long)]
    d = rows.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).select(*ORDER, "fault", F.spark_partition_id().alias("pid"))
    schema = f"conv_id {d.schema['conv_id'].dataType.simpleString()}, pid int, seq long, codes binary, roles array<string>, texts array<string>, first_turn long, last_turn long, turns long, matrix array<long>"
    return d.mapInArrow(lambda batches: _typed(batches, names, kinds, cut), schema)


def _in_order(d: DataFrame, backward: bool = False) -> DataFrame:
    """A conversation's blocks in one task, as a sorted stream: small rows, of which none is held."""
    way = (lambda c: F.col(c).desc()) if backward else F.col
    return d.repartition("conv_id").sortWithinPartitions("conv_id", way("pid"), way("seq"))


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def costs(parts: DataFrame) -> DataFrame:
    """(conv_id, pid, seq, behind, first, last, counts): the costs behind each block; a conversation's first block has its counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, tuple]]:
        for conv, members in groupby(_streamed(batches), key=lambda r: r[0]):
            behind, low, high, turns, after = G.END, None, None, 0, None
            n, row = dict.fromkeys(COUNTS, 0), None
            for _, pid, seq, codes, first_turn, last_turn, distinct, matrix in members:
                if row is not None:
                    yield 0, (*row, False, row_last, None)
                row, row_last = (conv, pid, seq, list(behind)), row is None
                behind = G.before(matrix, behind)
                letters = [c >> 2 for c in codes] + ([] if after is None else [after])
                after = letters[0]
                n["illegal"] += sum(pair not in ((0, 1), (1, 2), (2, 1)) for pair in zip(letters, letters[1:]))
                for name, fault in (("blank", G.BLANK), ("duplicate", G.DUPLICATE), ("truncated", G.TRUNCATED)):
                    n[name] += sum(c & 3 == fault for c in codes)
                if distinct:
                    turns += distinct - (low == last_turn)
                    low, high = first_turn, last_turn if high is None else high
            n["gaps"] = high - low + 1 - turns if high is not None else 0
            n["cost"] = behind[G.START]
            yield 0, (*row, True, row_last, [n[c] for c in COUNTS])

    long = pa.int64()
    names = ["conv_id", "pid", "seq", "behind", "first", "last", "counts"]
    kinds = [pa.int32(), long, pa.list_(long), pa.bool_(), pa.bool_(), pa.list_(long)]
    d = _in_order(parts.select("conv_id", "pid", "seq", "codes", "first_turn", "last_turn", "turns", "matrix"), backward=True)
    return d.mapInArrow(lambda batches: _typed(batches, names, kinds, run), f"conv_id {d.schema['conv_id'].dataType.simpleString()}, pid int, seq long, behind array<long>, first boolean, last boolean, counts array<long>")


def entries(parts: DataFrame, found: DataFrame) -> DataFrame:
    """(pid, seq, entry): the grammar's state before each block of a conversation of several blocks."""

    def leave(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, tuple]]:
        for conv, pid, seq, codes, behind in _streamed(batches):
            steps = G.backward(codes, behind)[1]
            ends = []
            for state in range(4):
                for _, _, state in G.walk(steps, state):  # noqa: B020
                    pass
                ends.append(state)
            yield 0, (conv, pid, seq, ends)

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, tuple]]:
        for conv, members in groupby(_streamed(batches), key=lambda r: r[0]):
            state = G.START
            for _, pid, seq, ends in members:
                yield 0, (conv, pid, seq, state)
                state = ends[state]

    kind = parts.schema["conv_id"].dataType.simpleString()
    several = found.filter("NOT (first AND last)").select("pid", "seq", "behind")
    d = parts.select("conv_id", "pid", "seq", "codes").join(several, ["pid", "seq"]).select("conv_id", "pid", "seq", "codes", "behind")
    names = ["conv_id", "pid", "seq", "ends"]
    d = d.mapInArrow(lambda batches: _typed(batches, names, [pa.int32(), pa.int64(), pa.list_(pa.int32())], leave), f"conv_id {kind}, pid int, seq long, ends array<int>")
    names = [*names[:3], "entry"]
    d = _in_order(d).mapInArrow(lambda batches: _typed(batches, names, [pa.int32(), pa.int64(), pa.int32()], enter), f"conv_id {kind}, pid int, seq long, entry int")
    return d.select("pid", "seq", "entry")


def edited(parts: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, pid, seq, audit, repaired): each block's labels, and its rows (label, role, text) after the edits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, tuple]]:
        for conv, pid, seq, codes, roles, texts, behind, last, entry in _streamed(batches):
            state, audit, rows = entry, [], []
            for label, i, state in G.walk(G.backward(codes, behind)[1], entry):
                audit.append(label)
                if label != "D":
                    rows.append({"label": label, "role": roles[i] if label == "K" else G.WRITTEN[state], "text": "" if label == "I" else texts[i]})
            for to in G.closing(state) if last else ():
                audit.append("I")
                rows.append({"label": "I", "role": G.WRITTEN[to], "text": ""})
            yield sum(map(len, texts)), (conv, pid, seq, "".join(audit), rows)

    kind = parts.schema["conv_id"].dataType.simpleString()
    d = parts.join(found.select("pid", "seq", "behind", "last"), ["pid", "seq"]).join(entries(parts, found), ["pid", "seq"], "left")
    d = d.select("conv_id", "pid", "seq", "codes", "roles", "texts", "behind", "last", F.coalesce("entry", F.lit(G.START)).alias("entry"))
    row = pa.list_(pa.struct([("label", pa.string()), ("role", pa.string()), ("text", pa.string())]))
    return d.mapInArrow(lambda batches: _typed(batches, ["conv_id", "pid", "seq", "audit", "repaired"], [pa.int32(), pa.int64(), pa.string(), row], run), f"conv_id {kind}, pid int, seq long, audit string, repaired array<struct<label:string,role:string,text:string>>")


def repair(rows: DataFrame, size: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """The repair of conversations (conv_id, turn, role, text): (counts of each one, its edited blocks).

    Rows are taken by turn (nulls first), role and text. Null roles and texts count as one space. A row's first fault
    counts: blank, repeated (role and text stand earlier in the conversation), truncated (no end mark). The edits are the
    cheapest ones, and of these the least string of labels (D, I, K, R), that leave system at most once, at the start, and
    then user and assistant in turn; blank and repeated rows go. A role without a first letter can't be kept. Rows without
    conv_id are one conversation. Repeated rows are repetitions. Empty table: no rows.

    counts: conv_id and gaps, blank, duplicate, truncated, illegal, cost. Blocks: conv_id, pid, seq, audit, repaired. A
    conversation of any length is worked on in blocks: costs go from block to block as a matrix of 4 by 4, and states as a
    function of 4, so no task holds it.
    """
    filled = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    parts = materialize(blocks(faults(filled), size), "conversation-blocks")
    found = materialize(costs(parts), "conversation-costs")
    counts = found.filter("first").select("conv_id", *[F.col("counts")[i].alias(c) for i, c in enumerate(COUNTS)])
    return counts, edited(parts, found)


def digests(edits: DataFrame) -> DataFrame:
    """(conv_id, audit, repaired_sha256). A digest is sequential by nature: a conversation's blocks are read as a sorted stream, none is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, tuple]]:
        for conv, members in groupby(_streamed(batches), key=lambda r: r[0]):
            audit, digest, any_ = [], hashlib.sha256(), False
            for _, _, _, labels, text in members:
                audit.append(labels)
                if text is not None:
                    digest.update(b"\n" * any_ + text.encode())
                    any_ = True
            yield 0, (conv, "".join(audit), digest.hexdigest())

    lines = F.when(F.size("repaired") > 0, F.array_join(F.transform("repaired", lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n"))
    d = _in_order(edits.select("conv_id", "pid", "seq", "audit", lines.alias("lines")))
    return d.mapInArrow(lambda batches: _typed(batches, ["conv_id", "audit", "repaired_sha256"], [pa.string(), pa.string()], run), f"conv_id {d.schema['conv_id'].dataType.simpleString()}, audit string, repaired_sha256 string")


def repaired(conversations: DataFrame, size: int = ROWS) -> DataFrame:
    """The contract's rows: one for each conv_id of the input, zeros and the empty text's digest where no row is left after the damage."""
    counts, edits = repair(damage(conversations), size)
    d = digests(edits)
    all_ = conversations.select(F.col("conv_id").alias("_id")).distinct()
    out = all_.join(counts, F.col("_id").eqNullSafe(F.col("conv_id")), "left").drop("conv_id")
    out = out.join(d, F.col("_id").eqNullSafe(F.col("conv_id")), "left")
    return out.select(F.col("_id").alias("conv_id"), *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in COUNTS], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
