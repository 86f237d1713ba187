import pytest
from paths import SMALL
from pyspark.sql import functions as F

from lakewright.functions import anchors
from lakewright.operators import front_matter, search, workbooks
from lakewright.plans import workbooks as plans


@pytest.mark.parametrize(
    "rows, table",
    [
        ([["a|b", " c \n d"], ["1"], ["", None], ["x", "y", "z"]], "| a\\|b | c d |  |\n| --- | --- | --- |\n| 1 |  |  |\n| x | y | z |"),
        ([["1", "-2,5%"], ["3", "4"]], "| Column A | Column B |\n| --- | --- |\n| 1 | -2,5% |\n| 3 | 4 |"),
        ([["", " "], [None]], ""),
        ([["1.2.3"]], "| 1.2.3 |\n| --- |"),
    ],
)
def test_markdown_tables(spark, rows, table):
    d = spark.createDataFrame([(rows,)], "rows array<array<string>>")
    assert d.select(anchors.markdown_table(F.col("rows"))).first()[0] == table


def test_column_names(spark):
    got = spark.createDataFrame([(i,) for i in (0, 25, 26, 51, 52, 701)], "i int").select(anchors.column_name(F.col("i"))).collect()
    assert [r[0] for r in got] == ["A", "Z", "AA", "AZ", "BA", "ZZ"]


def test_quoted_blocks(spark):
    text = 'x <quoted_message role="user">m</quoted_message>\n\n<quoted_file path="C:\\a\\b&amp;lt;.pdf" page="x" source_label="&quot;L&quot;">\nbody\n</quoted_file>\n<quoted_file path="">n</quoted_file><quoted_message>open'
    d = spark.createDataFrame([(text,), (None,)], "c string")
    got = d.select(anchors.quoted_anchors(F.col("c")).alias("a"), anchors.without_anchors(F.col("c")).alias("t")).collect()
    assert [r.asDict() for r in got[0].a] == [
        {"kind": "file", "path": "C:\\a\\b&lt;.pdf", "name": "b&lt;.pdf", "page": None, "unit": None, "label": '"L"', "role": None},
        {"kind": "message", "path": "", "name": None, "page": None, "unit": None, "label": None, "role": "user"},
    ]
    assert got[0].t == "x <quoted_message>open" and got[1].t is None


@pytest.mark.parametrize(
    "text, head, body",
    [
        ("no head", {}, "no head"),
        ("---\nname: x", {}, "---\nname: x"),
        ("---\nname: 'a: b'\nother: 1\ntags: a, \"b\" ,\nscopes: []\ntriggers: one\n---\n\n b", {"name": "a: b", "tags": ["a", "b"], "scopes": [], "triggers": ["one"]}, "b"),
        ("---\ndescription: >\n  one\n\n\ttwo\nicon: \nallowed-tools:\n - x\n - 'y'\nrest\n---", {"description": "one  \ttwo", "icon": "", "allowedTools": ["x", "y"]}, ""),
        ("---\ndescription: |-\n  one\n    two\nversion: 1\n---b", {"description": "one\n  two", "version": "1"}, "b"),
    ],
)
def test_front_matter(text, head, body):
    assert front_matter.parse(text) == (head, body)


def test_series_of_each_sort(spark):
    cells = [("s", r, c, t) for c, texts in ((1, ["a", "", "c", "d"]), (2, ["1,000", "n/a", "5%", "7"]), (3, ["x", "y", "z", None])) for r, t in enumerate(texts, 1)]
    none = []
    series = [("s", 1, "own", None, None, 2, 1, 4, 3, ["o"]), ("s", 2, "range", None, None, 2, 1, 4, 3, none), ("s", 3, "left", 1, 3, 2, 1, 4, None, none), ("s", 4, "numbered", 9, 9, 1, 1, 4, None, none), ("s", 5, "first", None, None, 1, 1, 2, 3, none), ("t", 1, "empty", None, None, 2, 1, 4, 1, none)]
    schema = "sheet string, series int, name string, name_row int, name_col int, value_col int, first_row int, last_row int, category_col int, categories array<string>"
    got = workbooks.hydrate_series(spark.createDataFrame(series, schema), spark.createDataFrame(cells, "sheet string, row int, col int, text string")).collect()
    assert {(r.sheet, r.series): (r.name, r.categories, r["values"]) for r in got} == {
        ("s", 1): ("own", ["o"], [1000, 5, 7]),
        ("s", 2): ("range", ["x", "y", "z"], [1000, 5, 7]),
        ("s", 3): ("x", ["a", "c", "d"], [1000, 5, 7]),
        ("s", 4): ("numbered", [], []),
        ("s", 5): ("first", ["x", "y"], []),
        ("t", 1): ("empty", [], []),
    }


def test_fonts(spark):
    spans = [(1, 0, 20.04, "ab"), (1, 1, 10.0, "abcdef"), (1, 2, 11.0, "abcd "), (1, 3, 11.04, "ab"), (1, 4, 14.0, " "), (1, 5, 13.0, "x"), (2, 0, 9.0, "aa"), (2, 1, 12.0, "bb"), (3, 0, 8.0, " ")]
    got = workbooks.font_sizes(spark.createDataFrame(spans, "doc_id int, at int, size double, text string")).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(1, 10.0, 20.0, 13.0, None), (2, 9.0, 12.0, None, None)]


def test_audit(spark):
    sheets = spark.createDataFrame([("a", 1, False), ("a", 2, True), ("b", 3, False), ("c", 4, False), ("c", 5, False)], "book string, sheet int, hidden boolean")
    cells = spark.createDataFrame([(1, "=A1"), (1, "#N/A #VALUE!"), (2, "=#REF!"), (3, "x"), (4, "y"), (5, "")], "sheet int, text string")
    got = {r.book: tuple(r)[1:] for r in workbooks.audit(sheets, cells).collect()}
    assert got == {"a": (2, 1, 0, 2, {"#VALUE!": 1, "#REF!": 1}, "errors_found"), "b": (1, 0, 0, 0, {}, "ok"), "c": (2, 0, 1, 0, {}, "warnings")}


def test_fields_of_results(spark):
    d = spark.createDataFrame([(1, "f", "t", "l", 0.5)], "id long, file_id string, title string, page string, distance double").withColumn("vector", F.lit(1))
    got = search.result_fields(d)
    assert got.columns == [*search.BASE_FIELDS, "page", "distance"] and got.first().title == "t" and got.first().text is None


def test_each_branch_of_the_queries_has_rows(spark):
    series = plans.chart_series(spark, SMALL).select(F.size("values").alias("n"), F.get("categories", F.lit(0)).alias("first"), "name")
    kinds = {r.first if r.first in ("x", "1") or r.first is None else r.first[1:2] == "-" for r in series.select("first").distinct().collect()}
    assert {"x", "1", True, False} <= kinds
    fonts = plans.font_sizes(spark, SMALL).agg(*[F.count(c) for c in ("body", "h1", "h2", "h3")]).first()
    assert fonts[0] > fonts[1] > fonts[2] > fonts[3] > 0
    audit = plans.workbook_audit(spark, SMALL)
    assert audit.filter("hidden > 0 AND blank > 0 AND formulas > 0 AND errors LIKE '%N/A%REF%VALUE%'").count() > 0
    heads = plans.heads(spark, SMALL)
    assert {r[0] for r in heads.select(F.size("tags")).distinct().collect()} == {1, 2, -1} or {r[0] for r in heads.select(F.size("tags")).distinct().collect()} == {1, 2, None}


def test_the_width_of_a_markdown_table_is_found_once(spark):
    """Not for each row, which took time in proportion to the square of the rows."""
    assert str(anchors.markdown_table(F.col("rows"))).lower().count("array_max") == 1
    rows = spark.range(30000).selectExpr("collect_list(array(cast(id AS string), if(id % 2 = 0, 'x', null))) AS rows")
    table = rows.select(anchors.markdown_table(F.col("rows"))).first()[0].split("\n")
    assert len(table) == 30001 and table[:4] == ["| 0 | x |", "| --- | --- |", "| 1 |  |", "| 2 | x |"]
