"""Mixing sources to target weights by capped water-filling. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakewright.llm.common import BLANK, pick
from lakewright.session import materialize

MAX_EPOCHS = 3
#: Rows of a source that one bucket of the seeded order holds about.
BUCKET_ROWS = 20_000
SEED = "mix-1"


def word_count(text: Column) -> Column:
    """Runs of non-blanks: ends of words, counted as blanks or the text's end after a non-blank."""
    return F.when(text.isNull(), 0).otherwise(F.size(F.array_remove(F.split(text, BLANK + "+"), ""))).cast("long")


def ranked_sources(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Adds the weight of each source (source, source_size): 1, 2, 3, repeating in code point order, null last.

    Sources are dealt to partitions by ranges and numbered there; only one offset a partition meets on one place.
    """
    dealt = sizes.withColumn("_null", F.col("source").isNull()).repartitionByRange("_null", "source").sortWithinPartitions("_null", "source")
    numbered = materialize(dealt.withColumn("_id", F.monotonically_increasing_id()), "sources").withColumns({"_part": F.shiftright("_id", 33), "_row": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))})
    parts = numbered.groupBy("_part").agg(F.count("*").alias("_n"))
    offsets = parts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    place = F.col("_before") + F.col("_row")
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    return numbered.join(F.broadcast(offsets), "_part").withColumn("weight", weight.cast("double")).drop("_null", "_id", "_part", "_row", "_before", "_n")


def water_fill(sources: DataFrame, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """Adds target to sources (source_size, weight): shares of all sizes by weight, none above max_epochs times its size.

    Each round clamps the sources above their cap and shares the rest by weight among the others, until none is above.
    A round brings back three sums; a clamped source stays clamped, as what is shared per weight only grows.
    """
    cap = F.col("source_size") * float(max_epochs)
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        clamped = cap < F.col("weight") * F.lit(level)
        row = sources.agg(F.sum(F.when(clamped, cap)).alias("held"), F.sum(F.when(~clamped, F.col("weight"))).alias("weight"), F.sum(F.when(clamped, 1)).alias("n")).first()
        if not row["weight"]:
            break
        rise = (total - (row["held"] or 0.0)) / row["weight"]
        if rise <= level:
            break
        level = rise
    return sources.withColumn("target", F.least(cap, F.col("weight") * F.lit(level)))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: float = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """One row per row of docs (doc_id, text, source): size, source_size, target, taken.

    A source with target r times its size gives every document floor(r) times; the fraction that is left is filled in a
    seeded order of the documents, whole documents first, and the last one up to the word that meets the target. So a
    source's taken words differ from its target by less than one. Order: MD5 of seed and doc_id, then size; rows alike in
    both share what they are due by row order of equal rows, which gives the same multiset of rows on each run.
    Null text: size 0. Null doc_id: an id like any other. Null source: a source of its own, last. A very long text is
    counted in one pass like any other. Empty table: no rows.
    """
    sized = docs.select(
        "doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))).alias("_order")
    )
    sized = materialize(sized, "sizes")
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_rows"))
    sources = water_fill(ranked_sources(sizes, weights), max_epochs)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    sources = sources.withColumn("_whole", F.floor(ratio).cast("long")).withColumn("_need", F.round(F.col("target")).cast("long") - F.col("_whole") * F.col("source_size"))
    sources = materialize(sources.withColumn("_buckets", F.ceil(F.col("_rows") / BUCKET_ROWS).cast("long")), "targets").withColumnRenamed("source", "_source")
    # the first 8 hex digits of the order give the bucket, so that buckets follow the order
    bucket = F.floor(F.conv(F.substring("_order", 1, 8), 16, 10).cast("long") * F.col("_buckets") / F.lit(1 << 32)).cast("long")
    placed = sized.join(sources, F.col("source").eqNullSafe(F.col("_source"))).withColumn("_bucket", bucket)
    sums = placed.groupBy("_source", "_bucket").agg(F.sum("size").alias("_sum"))
    starts = sums.select(
        F.col("_source").alias("_s"), F.col("_bucket").alias("_b"), (F.sum("_sum").over(Window.partitionBy("_source").orderBy("_bucket")) - F.col("_sum")).alias("_start")
    )
    within = Window.partitionBy("source", "_bucket").orderBy("_order", "size").rowsBetween(Window.unboundedPreceding, 0)
    out = placed.withColumn("_upto", F.sum("size").over(within)).join(starts, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    left = F.col("_need") - (F.col("_start") + F.col("_upto") - F.col("size"))
    part = F.least(F.greatest(left, F.lit(0).cast("long")), F.col("size"))
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("_whole") * F.col("size") + part).alias("taken"))


def mixture(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return mix(pick(docs, "doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


def repeat_documents(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """docs, each row as often as its plan (doc_id, size, taken) says; a part of a document is its first words.

    Rows alike in doc_id and size take their plans in turn. Documents without words stay once. A part keeps the blanks and
    line ends between its words, and n_chars follows its text; the other columns stay as they are. Texts are shuffled once.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    d = docs.select(key.alias("_key"), word_count(F.col("text")).alias("_size"), F.col("text").alias("_text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    p = plan.select(key.alias("_key"), F.col("size").alias("_size"), "taken").groupBy("_key", "_size").agg(F.sort_array(F.collect_list("taken"), asc=False).alias("_taken"))
    both = d.join(p, ["_key", "_size"])
    turn = F.row_number().over(Window.partitionBy("_key", "_size").orderBy(F.xxhash64("_text")))
    both = both.withColumn("_due", F.element_at("_taken", turn))
    full, rest = F.floor(F.col("_due") / F.col("_size")).cast("int"), (F.col("_due") % F.col("_size")).cast("int")
    copies = F.concat(F.array_repeat(F.lit(-1), full), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<int>")))
    out = both.withColumn("_words", F.explode(F.when(F.col("_size") > 0, copies).otherwise(F.array(F.lit(-1)))))
    whole = F.col("_words") < 0
    words = F.regexp_extract_all(F.col("_text"), F.lit(BLANK + "*[^" + BLANK[1:] + "+"), F.lit(0))
    out = out.withColumn("_part", F.when(whole, F.col("_text")).otherwise(F.array_join(F.slice(words, 1, F.greatest("_words", F.lit(0))), "")))
    new = {"text": F.col("_part"), "n_chars": F.when(whole, F.col("_row.n_chars")).otherwise(F.length("_part").cast("long")) if "n_chars" in docs.columns else None}
    return out.select(*[(new[c] if c in new else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])
