import json
import time

from pyspark.sql import functions as F

from lakewright.functions import sheets, text
from lakewright.operators import search
from lakewright.operators.chunking import pieces
from lakewright.operators.relational import best_overlap
from lakewright.sources import files
from lakewright.streaming import timeline


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_rounding_goes_up_at_half(spark):
    assert [one(spark, sheets.sheet_round(F.lit(v), 1)) for v in (2.25, -2.25, 0.04)] == [2.3, -2.2, 0.0]
    assert one(spark, sheets.number_in(F.lit("1,234.5%"))) == 1234.5


def test_criteria(spark):
    d = spark.createDataFrame([("Alpha", 1.0), ("beta", None), (None, 3.0)], "a string, b double")
    hits = lambda pairs: d.filter(sheets.criteria(pairs)).count()
    assert hits([(F.col("a"), "al*")]) == 1 and hits([(F.col("a"), "alpha")]) == 0 and hits([(F.col("a"), "<>alpha")]) == 3
    assert hits([(F.col("b"), ">=1")]) == 2 and hits([(F.col("b"), "<>1")]) == 2


def test_chunks_end_at_the_blank_line():
    t = "a" * 1500 + "\n\n" + "b" * 3000
    assert list(pieces(t)) == [(0, "a" * 1500), (1240, "a" * 260 + "\n\n" + "b" * 2138), (3380, "b" * 1122)]
    # a line end counts from 65 % on, a sentence's mark from 70 % on and stays; windows of white space are left out
    assert list(pieces("a" * 1600 + "\n" + "b" * 1000))[0] == (0, "a" * 1600)
    assert list(pieces("a" * 1700 + "。" + "b" * 1000))[0] == (0, "a" * 1700 + "。")
    assert list(pieces("a" * 1600 + ". " + "b" * 1000))[0][1] == "a" * 1600 + ". " + "b" * 798
    assert list(pieces(" " * 3000 + "end")) == [(2140, "end")]
    assert list(pieces("")) == []


def test_normalise(spark):
    assert one(spark, text.normalise(F.lit(" a \r\nb\x00\t\n\n\n\n\nc \n"))) == "a\nb\n\n\nc"
    assert one(spark, text.normalise(F.lit("\u00a0a\rb\r\n\f"))) == "a\nb"


def test_entities_are_decoded_in_order(spark):
    assert one(spark, text.strip_html(F.lit("<script>x</p></script>a&amp;lt;<br>b"))).split() == ["a<", "b"]


def test_canonical_url(spark):
    assert one(spark, text.canonical_url(F.lit("HTTP://Ex.com:80/a/?b=2&a=1#x"))) == "http://ex.com/a?a=1&b=2"
    assert one(spark, text.canonical_url(F.lit("https://Ex.com:80?b=2&a=9&b=1&a=1"))) == "https://ex.com:80/?a=9&a=1&b=2&b=1"


def test_budget():
    assert search.budget(None) == (24, 80) and search.budget(0) == (1, 24) and search.budget(6) == (6, 24)


def test_longest_overlap(spark):
    d = spark.sql("SELECT 1 AS item, date'2026-02-09' AS start, date'2026-02-15' AS end UNION ALL SELECT 2, date'2030-01-01', date'2030-01-02'")
    s = spark.sql("SELECT 1 AS span, date'2026-02-04' AS s, date'2026-02-10' AS e UNION ALL SELECT 2, date'2026-02-11', date'2026-02-17'")
    assert {(r.item, r.span) for r in best_overlap(d, s, "item", 7).collect()} == {(1, 2), (2, None)}


def test_session_log(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"type":"user","text":"a"}\n\nnot json\n{"type":"result"}\n')
    assert [(r.type, r.text) for r in files.read_session_log(spark, str(tmp_path / "log.jsonl")).collect()] == [("user", "a"), ("session_corrupted", "not json"), ("result", None)]
    (tmp_path / "t.csv").write_text('a,"b ""c"""\n,\n"x\ny",z\n')
    assert [tuple(r) for r in files.read_table_text(spark, str(tmp_path / "t.csv")).collect()] == [("a", 'b "c"'), ("x\ny", "z")]


def test_stream_is_batch(spark, tmp_path):
    records = [{"conv_id": c, "turn": t, "text": f"{c}.{t} "} for t in range(6) for c in range(3)]
    for n in range(3):
        (tmp_path / f"{n}.json").write_text("\n".join(json.dumps(r) for r in records[n * 6 : n * 6 + 6]))
        time.sleep(0.02)
    schema = "conv_id long, turn long, text string"
    live = timeline.live_deltas(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path)))
    q = live.writeStream.format("memory").queryName("live_deltas").outputMode("append").option("checkpointLocation", str(tmp_path / "_state")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = timeline.deltas(spark.createDataFrame(records, schema), ["conv_id"], "turn", "text").select("conv_id", "turn", "running")
    assert sorted(map(tuple, spark.table("live_deltas").collect())) == sorted(map(tuple, batch.collect()))
