"""Heading paths of a document's blocks, and the sections that share a path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVELS = 6
JOINED, NO_PATH = " > ", "Document"


def heading_paths(blocks: DataFrame, doc: str = "doc_id", index: str = "index", level: str = "level", title: str = "title", levels: int = LEVELS) -> DataFrame:
    """blocks with path: the titles of the headings that a block stands under, its own last, by level.

    A heading (level from 1 to levels; null: none) takes the place of its level's heading and ends those of higher numbers.
    So of each level the last heading counts, unless one of a lower number came after it; empty titles are left out. One
    ordered pass over a document's blocks, whose state is a heading of each level.
    """
    before = Window.partitionBy(doc).orderBy(index).rowsBetween(Window.unboundedPreceding, 0)
    d = blocks
    for n in range(1, levels + 1):
        d = d.withColumn(f"_h{n}", F.last(F.when(F.col(level) == n, F.struct(F.col(index).alias("at"), F.col(title).alias("title"))), ignorenulls=True).over(before))

    def still(n: int) -> Column:
        open_ = F.col(f"_h{n}").isNotNull()
        for m in range(1, n):
            open_ = open_ & F.coalesce(F.col(f"_h{n}.at") > F.col(f"_h{m}.at"), F.lit(True))
        return F.when(open_, F.nullif(F.col(f"_h{n}.title"), F.lit("")))

    path = F.array_compact(F.array(*[still(n) for n in range(1, levels + 1)]))
    return d.withColumn("path", path).drop(*[f"_h{n}" for n in range(1, levels + 1)])


def sections(placed: DataFrame, doc: str = "doc_id", index: str = "index", text: str = "text") -> DataFrame:
    """(doc, no, path, title, blocks, text): the blocks of each path, in the order in which paths are first met; a path that is met again goes on.

    placed: blocks with path. Sections without text are left out and not numbered. Texts stand a blank line apart.
    """
    named = placed.withColumn("title", F.when(F.size("path") == 0, NO_PATH).otherwise(F.array_join("path", JOINED)))
    grouped = named.groupBy(doc, "title").agg(F.min(index).alias("first"), F.min_by("path", index).alias("path"), F.array_sort(F.collect_list(F.struct(F.col(index).alias("at"), F.col(text).alias("text")))).alias("_b"))
    d = grouped.withColumn("text", F.array_join(F.transform("_b", lambda b: b["text"]), "\n\n")).withColumn("blocks", F.transform("_b", lambda b: b["at"]))
    d = d.filter(F.col("text").rlike(r"\S")).withColumn("no", F.row_number().over(Window.partitionBy(doc).orderBy("first")).cast("long"))
    return d.select(doc, "no", "path", "title", "blocks", "text")
