"""Quality rules with cross-document line frequency. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewright.llm.common import BLANK, let, pick, same
from lakewright.session import materialize

#: A line is boilerplate of its host if it stands in more documents than both limits allow.
MIN_DOCS, HOST_SHARE = 20, 0.1
#: A document is depleted if less than this share of its words' characters stays after boilerplate goes.
KEEP_SHARE = 0.5
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANK + "+"), "")


def word_lines(text: Column) -> Column:
    """The lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def normal_line(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, BLANK + "+", " ")))


def repeated_window_words(found: Column) -> Column:
    """How many of these words stand in a window of 3 words that occurs twice or more in the array."""

    def covered(starts: Column) -> Column:
        # a window covers 3 words, less where the next repeated window starts sooner
        step = F.zip_with(starts, F.slice(starts, 2, F.size(starts)), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
        return F.aggregate(step, F.lit(0).cast("long"), lambda n, x: n + x)

    def repeated(ordered: Column) -> Column:
        twins = F.filter(
            F.zip_with(
                F.zip_with(ordered, F.slice(ordered, 2, F.size(ordered)), lambda a, b: F.struct(a["i"].alias("i"), a["h"].alias("h"), F.coalesce(a["h"] == b["h"], F.lit(False)).alias("next"))),
                F.concat(F.array(F.lit(None).cast("bigint")), F.slice(F.transform(ordered, lambda x: x["h"]), 1, F.greatest(F.size(ordered) - 1, F.lit(0)))),
                lambda a, h: F.struct(a["i"].alias("i"), (a["next"] | F.coalesce(a["h"] == h, F.lit(False))).alias("twin")),
            ),
            lambda x: x["twin"],
        )
        return let(F.sort_array(F.transform(twins, lambda x: x["i"])), covered)

    def windows(w: Column) -> Column:
        three = F.zip_with(
            F.zip_with(F.slice(w, 1, F.size(w) - 2), F.slice(w, 2, F.size(w) - 2), lambda a, b: F.struct(a.alias("a"), b.alias("b"))),
            F.slice(w, 3, F.size(w) - 2),
            lambda ab, c: F.xxhash64(ab["a"], ab["b"], c),
        )
        return let(
            three,
            lambda hs: F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0).cast("long")).otherwise(
                let(F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), repeated)
            ),
        )

    return F.when(F.size(found) < 3, F.lit(0).cast("long")).otherwise(windows(found))


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed to docs, all from the row's whole text."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = word_lines(t)
    counted = F.struct(
        let(words(t), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_window_words(w).alias("r"))).alias("w"),
        F.length(F.regexp_replace(t, BLANK + "+", "")).cast("long").alias("chars"),
        (F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]+", ""))).cast("long").alias("symbols"),
        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("dup"),
    )
    m = F.col("_measures")
    return (
        docs.withColumn("_measures", counted)
        .withColumns(
            {
                "n_words": m["w"]["n"],
                "word_chars": m["chars"],
                "n_symbols": m["symbols"],
                "n_dup_lines": m["dup"],
                "n_repeat_words": m["w"]["r"],
                "base_failed": (m["w"]["n"] < MIN_WORDS) | (100 * m["w"]["r"] > MAX_REPEAT_PERCENT * m["w"]["n"]),
            }
        )
        .drop("_measures")
    )


def line_hashes(text: Column) -> Column:
    return F.transform(word_lines(text), lambda x: F.xxhash64(normal_line(x)))


def boilerplate(docs: DataFrame, min_docs: int = MIN_DOCS, host_share: float = HOST_SHARE, once_per_text: bool = False) -> DataFrame:
    """(host, lines): the hashes of each host's boilerplate lines, for hosts that have some; host may be null.

    docs: doc_id, host, text. Documents are counted by doc_id; with once_per_text copies of a text count once. A line of
    which copies are counted weighs one row for each document, and a (host, line) pair is summed up before the shuffle. A
    host has at most mean lines a document / host_share boilerplate lines, however many documents it has.
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    unit = F.xxhash64("text") if once_per_text else F.col("doc_id")
    each = docs.select("host", unit.alias("unit"), F.array_distinct(line_hashes(t)).alias("lines"))
    totals = each.select("host", "unit").distinct().groupBy("host").agg(F.count("*").alias("units"))
    often = (
        each.select("host", "unit", F.explode("lines").alias("line"))
        .distinct()
        .groupBy("host", "line")
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") > min_docs)
    )
    bad = often.join(totals, same(often, totals, "host")).filter(F.col("n") > host_share * F.col("units"))
    return bad.groupBy(often["host"]).agg(F.sort_array(F.collect_list("line")).alias("lines"))


def judge(docs: DataFrame, host_col: str = "source", min_docs: int = MIN_DOCS, host_share: float = HOST_SHARE, keep_share: float = KEEP_SHARE, once_per_text: bool = False) -> DataFrame:
    """One row per row of docs (doc_id, text and the host column): its measures, removed_chars and the verdict kept.

    Null texts count as empty and are not kept. A null host is a host of its own, a null doc_id an id of its own. Repeated
    rows each get their row; they are one document. A very long text is judged whole, in time in proportion to it (its
    words are sorted once). An empty table gives no rows. Also: clean_text, the text without its boilerplate lines (the
    very text where it has none), and row, a struct of the columns of docs; columns that aren't used cost nothing.

    Each row meets its host's boilerplate lines, so nothing is summed up again by document. Those are few: Spark
    broadcasts them while they are below its threshold, else it joins by host and splits a hot one.
    """
    d = docs.select("doc_id", F.col("text").alias("text"), F.col(host_col).cast("string").alias("host"), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"))
    bad = materialize(boilerplate(d, min_docs, host_share, once_per_text), "boilerplate").select(F.col("host").alias("_host"), F.col("lines").alias("_bad"))
    out = measures(d.join(bad, F.col("host").eqNullSafe(F.col("_host")), "left"))
    is_bad = lambda x: x.rlike(r"[^\x20\x09-\x0D]") & F.array_contains("_bad", F.xxhash64(normal_line(x)))
    hit = F.filter(F.split("text", "\n"), is_bad)
    removed = F.when(F.col("_bad").isNotNull(), F.length(F.regexp_replace(F.array_join(hit, ""), BLANK + "+", "")).cast("long"))
    out = out.withColumn("removed_chars", F.coalesce(removed, F.lit(0).cast("long")))
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("word_chars") - F.col("removed_chars") >= keep_share * F.col("word_chars")))
    out = out.withColumn("clean_text", F.when(F.coalesce(F.col("removed_chars") > 0, F.lit(False)), F.array_join(F.filter(F.split("text", "\n"), lambda x: ~is_bad(x)), "\n")).otherwise(F.col("text")))
    return out.drop("_host", "_bad")


def clean(docs: DataFrame) -> DataFrame:
    """The documents that are kept, without their boilerplate lines, in the columns of docs; n_chars follows the text."""
    found = judge(docs).filter("kept")
    changed = ~F.col("clean_text").eqNullSafe(F.col("text"))
    new = {"text": F.col("clean_text"), "n_chars": F.when(changed, F.length("clean_text").cast("long")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return found.select(*[(new[c] if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def verdicts(docs: DataFrame) -> DataFrame:
    """The contract's columns, and removed_chars."""
    found = judge(pick(docs, "doc_id", "text", "source"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "removed_chars", "base_failed", "kept")
