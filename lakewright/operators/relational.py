"""Relational building blocks: latest rows, lookups, intervals, merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakewright.operators.ordered import filled


def latest_per(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in this order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def as_of(left: DataFrame, right: DataFrame, by: str, at: str, value: str, reverse: bool = False) -> DataFrame:
    """left with value of the right row whose at is the largest that is not above by (reverse: the smallest not below).

    Both sides are put in one order and passed in ranges of about equal size, with the value that is open at a range's
    start: no row pairs are made, and rows with the same by may lie in several ranges. Among right rows with the same at
    the largest value is taken; null values are passed over.
    """
    r = right.groupBy(F.col(at).alias("_at0")).agg(F.max(value).alias("_v")).filter("_at0 IS NOT NULL")
    both = left.withColumn("_at0", F.col(by)).withColumn("_side", F.lit(1)).unionByName(r.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    # left rows with the same by are told apart by all they hold
    both = both.withColumn("_salt", F.xxhash64(*left.columns))
    found = filled(both, [F.col("_at0").desc() if reverse else F.col("_at0").asc(), F.col("_side"), F.col("_salt")], "_v")
    value_of = F.when(F.col("_at0").isNotNull(), F.col("found"))
    return found.filter("_side = 1").select(*left.columns, value_of.alias(value))


def best_overlap(items: DataFrame, spans: DataFrame, item: str, days: int) -> DataFrame:
    """Each item (item, start, end: dates) with the span (span, s, e) that it overlaps longest, the earliest of equals, or none.

    Items and spans meet on the periods of so many days that they touch, so only near pairs are compared.
    """
    epoch = F.lit("1970-01-01").cast("date")
    period = lambda d: F.floor(F.datediff(d, epoch) / days).cast("int")
    i = items.withColumn("_p", F.explode(F.sequence(period(F.col("start")), period(F.col("end")))))
    s = spans.withColumn("_p", F.explode(F.sequence(period(F.col("s")), period(F.col("e")))))
    overlap = F.datediff(F.least("end", "e"), F.greatest("start", "s")) + 1
    pairs = i.join(s, "_p").withColumn("overlap", overlap).filter("overlap > 0").select(item, "span", "overlap").distinct()
    best = latest_per(pairs, [item], F.col("overlap").desc(), F.col("span"))
    return items.join(best, item, "left")


def merge_by_id(target: DataFrame, source: DataFrame, key: str, file: str) -> DataFrame:
    """The rows of both by key, with action: update and insert take the source's row, keep and delete are the target's.

    Deleted are rows of the source's files that the source lacks. One full outer join; keys are each side's own and not
    null. The merged table is what is not deleted.
    """
    columns = target.columns
    t = target.select(*[F.col(c).alias(f"_t_{c}") for c in columns])
    s = source.select(*[F.col(c).alias(f"_s_{c}") for c in columns])
    files = source.select(F.col(file).alias("_file")).distinct()
    d = t.join(s, F.col(f"_t_{key}") == F.col(f"_s_{key}"), "full_outer").join(files, F.col(f"_t_{file}").eqNullSafe(F.col("_file")), "left").withColumn("_hit", F.col("_file").isNotNull())
    new, old = F.col(f"_s_{key}").isNotNull(), F.col(f"_t_{key}").isNotNull()
    action = F.when(new & old, "update").when(new, "insert").when(F.col("_hit"), "delete").otherwise("keep")
    return d.select(*[F.when(new, F.col(f"_s_{c}")).otherwise(F.col(f"_t_{c}")).alias(c) for c in columns], action.alias("action"))
