"""Titles matched with the names of a deck in four steps, each of which must find exactly one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRAM = 3
#: How a title tells a number.
NUMBERED = (r"^\s*([0-9]{1,3})", r"^\s*(?:slide|page|p)\s*[-_:]?\s*([0-9]{1,3})", r"^\s*第\s*([0-9]{1,3})\s*[页张]")


def normal_title(title: Column) -> Column:
    """Lower case; runs of what is no ASCII letter, digit or Chinese character are one underscore, none at the ends."""
    return F.lower(F.btrim(F.regexp_replace(title, r"[^0-9A-Za-z\x{4E00}-\x{9FFF}]+", "_"), F.lit("_")))


def leading_number(title: Column) -> Column:
    low = F.lower(title)
    return F.coalesce(*[F.regexp_extract(low, p, 1).try_cast("int") for p in NUMBERED])


def grams(text: Column, n: int = GRAM) -> Column:
    """The different pieces of n characters; a shorter text has none."""
    starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(n))))


def _only(names: DataFrame, by: str) -> DataFrame:
    """The deck's names that no other one shares by with, by deck and by."""
    return names.filter(F.col(by).isNotNull()).groupBy("deck", by).agg(F.count("*").alias("_n"), F.min("name").alias("match")).filter("_n = 1").drop("_n")


def match_titles(titles: DataFrame, names: DataFrame) -> DataFrame:
    """titles (deck, title) with match and step: exact, normal, number, part; null where no step finds exactly one name of the deck.

    names: deck, name, each name of a deck once. A step that finds several passes the title on. For the last step a title
    meets only names that share its rarest piece of three characters (a shorter one: names that hold it as a piece of its
    own length), not all names of its deck; equal titles are looked up once.
    """
    known = names.select("deck", "name", F.nullif(normal_title(F.col("name")), F.lit("")).alias("normal"), leading_number(F.col("name")).alias("number"))
    t = titles.select("deck", "title").distinct().withColumn("normal", normal_title(F.col("title"))).withColumn("number", leading_number(F.col("title")))
    exact = names.select("deck", F.col("name").alias("title"), F.col("name").alias("exact"))
    t = t.join(exact, ["deck", "title"], "left")
    t = t.join(_only(known, "normal").withColumnRenamed("match", "by_normal"), ["deck", "normal"], "left")
    t = t.join(_only(known, "number").withColumnRenamed("match", "by_number"), ["deck", "number"], "left")
    rest = t.filter("exact IS NULL AND by_normal IS NULL AND by_number IS NULL AND normal <> ''").select("deck", "normal").distinct()

    def pieces(text: Column, short: bool) -> Column:
        return F.concat(grams(text), *[grams(text, n) for n in range(1, GRAM)]) if short else grams(text)

    index = known.filter("normal IS NOT NULL").select("deck", "name", "normal", F.explode(pieces(F.col("normal"), True)).alias("gram"))
    often = index.groupBy("deck", "gram").agg(F.count("*").alias("n"))
    asked = rest.select("deck", "normal", F.explode(F.when(F.length("normal") >= GRAM, grams(F.col("normal"))).otherwise(F.array("normal"))).alias("gram"))
    # an inner join: a piece that no name has means that no name holds the title, so it would be the rarest
    pieces_of = asked.groupBy("deck", "normal").agg(F.count("*").alias("all"))
    found = asked.join(often, ["deck", "gram"]).groupBy("deck", "normal").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"), F.count("*").alias("has"))
    rarest = found.join(pieces_of, ["deck", "normal"]).filter(F.col("has") == F.col("all")).select("deck", "gram", F.col("normal").alias("part"))
    held = rarest.join(index, ["deck", "gram"]).filter(F.contains("normal", F.col("part")))
    by_part = held.groupBy("deck", F.col("part").alias("normal")).agg(F.count("*").alias("_n"), F.min("name").alias("by_part")).filter("_n = 1").drop("_n")
    t = t.join(by_part, ["deck", "normal"], "left")
    steps = (("exact", "exact"), ("normal", "by_normal"), ("number", "by_number"), ("part", "by_part"))
    step = F.coalesce(*[F.when(F.col(c).isNotNull(), name) for name, c in steps])
    out = t.select("deck", "title", F.coalesce(*[F.col(c) for _, c in steps]).alias("match"), step.alias("step"))
    return titles.join(out, ["deck", "title"], "left")


def collated(title: str) -> Column:
    """A title as a key of order in the Unicode collation: letters first, then accents, then lower case before upper."""
    return F.collate(F.col(title), "UNICODE")


def title_places(rows: DataFrame, by: str, order: list[Column]) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
