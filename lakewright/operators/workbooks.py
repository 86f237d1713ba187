"""Charts, fonts and audits of workbooks and documents, from their cells and spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakewright.functions.sheets import number_in

CELL_REF = r"^\$?[A-Za-z]{1,3}\$?[0-9]+$"
#: What stands in a cell whose formula failed, in the order in which they are looked for.
ERRORS = ("#VALUE!", "#DIV/0!", "#REF!", "#NAME?", "#NULL!", "#NUM!", "#N/A")


def hydrate_series(series: DataFrame, cells: DataFrame) -> DataFrame:
    """(sheet, series, name, categories, values) of chart series.

    series: sheet, series, name (a text, or a cell's address as row and column), value_col, first_row, last_row, category_col
    (may be null), categories (own ones, may be empty); cells: sheet, row, col, text. Values are the numbers of the range.
    Categories are the series' own, else those of its range, else those of the column left of the values, else 1, 2, ...;
    no more than there are values. Each series meets the cells of its three columns once.
    """
    full = cells.filter("text <> ''")
    s = series.withColumn("_cols", F.array_distinct(F.array_compact(F.array("value_col", "category_col", F.col("value_col") - 1))))
    met = s.select("sheet", "series", "first_row", "last_row", F.explode("_cols").alias("col")).join(full, ["sheet", "col"]).filter(F.col("row").between(F.col("first_row"), F.col("last_row")))
    lists = met.groupBy("sheet", "series", "col").agg(F.array_sort(F.collect_list(F.struct("row", "text"))).alias("_t")).select("sheet", "series", "col", F.transform("_t", lambda x: x["text"]).alias("texts"))
    by_col = lists.groupBy("sheet", "series").agg(F.map_from_entries(F.collect_list(F.struct("col", "texts"))).alias("_by"))
    named = full.select(F.col("sheet").alias("_s"), F.col("row").alias("_r"), F.col("col").alias("_c"), F.col("text").alias("_name"))
    d = s.join(by_col, ["sheet", "series"], "left")
    d = d.join(named, (F.col("sheet") == F.col("_s")) & (F.col("name_row") == F.col("_r")) & (F.col("name_col") == F.col("_c")), "left")
    none = F.array().cast("array<string>")
    of = lambda col: F.coalesce(F.try_element_at("_by", col), none)
    values = F.filter(F.transform(of(F.col("value_col")), number_in), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    d = d.withColumn("values", values)
    given = F.when(F.size("categories") > 0, F.col("categories")).when(F.size(of(F.col("category_col"))) > 0, of(F.col("category_col"))).otherwise(of(F.col("value_col") - 1))
    counted = F.when(F.size("values") > 0, F.transform(F.sequence(F.lit(1), F.size("values")), lambda i: i.cast("string"))).otherwise(none)
    chosen = F.when(F.size(given) > 0, given).otherwise(counted)
    limit = F.when(F.size("values") > 0, F.size("values")).otherwise(F.size(chosen))
    return d.select("sheet", "series", F.coalesce("_name", "name").alias("name"), F.slice(chosen, 1, F.greatest(limit, F.lit(1))).alias("categories"), "values")


def font_sizes(spans: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, body, h1, h2, h3): the size of most text (of equals the one met first), and the largest sizes above it by more than one.

    spans: doc, at, size, text. Sizes are summed up before anything is ordered, so a document is a few rows.
    """
    d = spans.select(doc, "at", F.round("size", 1).alias("size"), F.length(F.trim("text")).alias("n")).filter("n > 0")
    sums = d.groupBy(doc, "size").agg(F.sum("n").alias("n"), F.min("at").alias("first"))
    body = sums.groupBy(doc).agg(F.min_by("size", F.struct(-F.col("n"), "first")).alias("body"))
    w = Window.partitionBy(doc).orderBy(F.col("size").desc())
    heads = sums.join(body, doc).filter(F.col("size") > F.col("body") + 1).withColumn("n", F.row_number().over(w)).filter("n <= 3")
    pick = lambda n: F.max(F.when(F.col("n") == n, F.col("size"))).alias(f"h{n}")
    return body.join(heads.groupBy(doc).agg(*map(pick, (1, 2, 3))), doc, "left").select(doc, "body", "h1", "h2", "h3")


def error_in(text: Column) -> Column:
    """The first error that the text holds."""
    return F.coalesce(*[F.when(F.contains(text, F.lit(e)), F.lit(e)) for e in ERRORS])


def audit(sheets: DataFrame, cells: DataFrame) -> DataFrame:
    """(book, sheets, hidden, blank, formulas, errors, status): errors as a map of counts by code.

    sheets: book, sheet, hidden; cells: sheet, text. Status: errors_found, else warnings if a sheet is blank, else ok. Cells
    are summed up by sheet where they are, before they meet the sheets.
    """
    c = cells.filter("text <> ''").withColumn("error", error_in(F.col("text")))
    counts = [F.count_if(F.col("error") == e).alias(f"_{i}") for i, e in enumerate(ERRORS)]
    per = c.groupBy(F.col("sheet").alias("_sheet")).agg(F.count("*").alias("cells"), F.count_if(F.startswith("text", F.lit("="))).alias("formulas"), *counts)
    d = sheets.join(per, F.col("sheet") == F.col("_sheet"), "left")
    total = lambda col: F.coalesce(F.sum(col), F.lit(0)).alias(col)
    b = d.groupBy("book").agg(F.count("*").alias("sheets"), F.count_if(F.col("hidden")).alias("hidden"), F.count_if(F.col("cells").isNull()).alias("blank"), total("formulas"), *[total(f"_{i}") for i in range(len(ERRORS))])
    errors = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, ERRORS)), F.array(*[F.col(f"_{i}") for i in range(len(ERRORS))])), lambda _, n: n > 0)
    status = F.when(F.size(F.map_keys("errors")) > 0, "errors_found").when(F.col("blank") > 0, "warnings").otherwise("ok")
    return b.withColumn("errors", errors).select("book", "sheets", "hidden", "blank", "formulas", "errors", status.alias("status"))
