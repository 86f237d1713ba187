import json
import random

import pytest

from lakewright.streaming import frames, timeline

TEXTS = ["event: a\ndata: é日本\n\n: note\n\nevent:b\r\ndata:1\r\ndata: 2\r\n\r\ndata: no event\n\n\n\nevent: empty\n\ndata\n\ndata: tail é", "", "\n\n\r\n", "data: x\n\r\n\ndata: y\r", "data: \r\n\r\ndata:  two\n\r\ndata: z"]


def plain(text):
    """All blocks of a whole text: line ends first, then blank lines, then each block."""
    blocks = text.replace("\r\n", "\n").split("\n\n")
    return [e for e in map(frames.parse_block, blocks) if e]


def test_blocks():
    assert plain(TEXTS[0]) == [("a", "é日本"), ("b", "1\n2"), (None, "no event"), (None, ""), (None, "tail é")]


@pytest.mark.parametrize("text", TEXTS)
def test_any_two_cuts_give_the_events_of_the_whole(text):
    data = text.encode()
    for i in range(len(data) + 1):
        for j in range(i, len(data) + 1):
            framer = frames.Framer()
            got = [*framer.push(data[:i]), *framer.push(data[i:j])]
            framer = frames.Framer(*framer.left())  # as a state keeps it
            assert [*got, *framer.push(data[j:]), *framer.push(b"", final=True)] == plain(text)


def test_broken_characters_are_replaced():
    framer = frames.Framer()
    assert [*framer.push(b"data: \xff\xc3"), *framer.push(b"\n\n"), *framer.push(b"data: \xe6\x97", final=True)] == [(None, "��"), (None, "�")]


def pieces_of(rng):
    rows = []
    for stream in range(8):
        data = "".join(rng.choice([*TEXTS[:3], "data: more\n\n", "event: é\r\ndata: {}\r\n\r\n"]) for _ in range(6)).encode()
        cuts = sorted({0, len(data), *(rng.randint(0, len(data)) for _ in range(12))})
        rows += [(stream, i, data[a:b], b == len(data)) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    return rows


def test_pieces_in_batch(spark):
    rows = pieces_of(random.Random(2))
    got = frames.events(spark.createDataFrame(rows + [(None, 0, None, True)], "stream long, seq long, data binary, last boolean")).collect()
    for stream in range(8):
        whole = b"".join(r[2] for r in rows if r[0] == stream).decode()
        assert [(r.event, r.data) for r in sorted(got, key=lambda r: r.n) if r.stream == stream] == plain(whole)
    assert frames.events(spark.createDataFrame([], "stream long, seq long, data binary")).count() == 0


def written(tmp_path, rows, batches):
    for n in range(batches):
        (tmp_path / f"{n}.json").write_text("\n".join(json.dumps(r) for r in rows[n * len(rows) // batches : (n + 1) * len(rows) // batches]))
    return str(tmp_path)


def live(spark, tmp_path, make, schema, name):
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "*.json"))
    q = make(source).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "_state")).trigger(availableNow=True).start()
    q.awaitTermination(200)
    assert q.exception() is None
    return spark.table(name).collect()


def test_pieces_as_a_stream_give_the_batch_result(spark, tmp_path):
    from base64 import b64encode

    from pyspark.sql import functions as F

    rows = sorted(pieces_of(random.Random(4)), key=lambda r: r[1])
    written(tmp_path, [{"stream": s, "seq": i, "text": b64encode(d).decode(), "last": e} for s, i, d, e in rows], 4)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        got = live(spark, tmp_path, lambda d: frames.live_events(d.select("stream", "seq", F.unbase64("text").alias("data"), "last")), "stream long, seq long, text string, last boolean", "live_events")
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    batch = frames.events(spark.createDataFrame(rows, "stream long, seq long, data binary, last boolean")).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, batch), key=repr)


def test_digests_as_a_stream_give_the_batch_result(spark, tmp_path):
    rows = [{"conv_id": c, "turn": t, "text": f"{c}.{t} é" if t else None} for t in range(8) for c in range(3)]
    schema = "conv_id long, turn long, text string"
    written(tmp_path, rows, 4)
    got = live(spark, tmp_path, timeline.live_digests, schema, "live_digests")
    batch = timeline.running_digests(spark.createDataFrame(rows, schema), "conv_id", "turn", "text")
    assert sorted(map(tuple, got)) == sorted(map(tuple, batch.collect()))
