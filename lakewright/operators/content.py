"""The main content of a web page: of its nested elements the one with the best score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Elements that are no content, and those that hold others.
CLUTTER = ("script", "style", "nav", "header", "footer", "aside", "noscript", "iframe")
CONTAINERS = ("html", "body", "main", "article", "section", "div", "table", "tr", "td", "ul", "ol", "li", "blockquote", "form", "fieldset")
#: Names, ids and classes of elements that are known to hold a page's content, and parts of classes.
NAMES, IDS = ("article", "main"), ("Zoom", "content", "article")
CLASSES = ("TRS_Editor", "TRS_UEDITOR", "ucontent", "article-content", "news-content", "detail-content", "content-text", "pages_content", "zwgk_content", "content_detail", "text_content", "main-content", "main_content", "view-content", "info-content", "content")
CLASS_PARTS = ("tys-main-zt-show", "tys-main")
#: Least texts: of a known element, of any other with paragraphs; a known one below the last score doesn't decide.
LEAST, LEAST_OTHER, SURE = 100, 200, 200
CHINESE, PARAGRAPH = 2, 50
_TAG = r"(?s)<!--.*?-->|<[!/]?[A-Za-z][^>]*>|[^<]+|<"


def attribute(tag: Column, name: str) -> Column:
    return F.regexp_extract(tag, rf"""(?i)\s{name}\s*=\s*["']([^"']*)["']""", 1)


def decoded(text: Column) -> Column:
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def tokens(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, at, open, close, tag, text): tags and texts of each page in order, without clutter and comments."""
    bare = F.regexp_replace(html, rf"(?is)<({'|'.join(CLUTTER)})\b[^>]*>.*?</\1\s*>", "")
    d = pages.select(key, F.posexplode(F.regexp_extract_all(bare, F.lit(_TAG), F.lit(0))).alias("at", "token"))
    name = F.lower(F.regexp_extract("token", r"^</?([A-Za-z][A-Za-z0-9]*)", 1))
    text = F.when(~F.startswith("token", F.lit("<")), F.trim(F.regexp_replace(decoded(F.col("token")), r"^[\s\x{A0}]+|[\s\x{A0}]+$", "")))
    return d.select(key, "at", name.alias("name"), F.startswith("token", F.lit("</")).alias("close"), F.when(name != "", F.col("token")).alias("tag"), text.alias("text"))


def main_content(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, name, score, text): the content element of each page, its score (null: no element had one, so it is the body), and its texts put together.

    A known element (by name, id or class) with LEAST characters scores its characters, and CHINESE more for each Chinese
    one. If the best has less than SURE, a div with paragraphs of its own and more than LEAST_OTHER characters may do
    better: PARAGRAPH more for each. Of equal scores the first one stands, known ones by the order of what makes them known.

    Elements are found by depth: a running sum over a page's tags of what opens and closes. An element ends at the next
    end at its own depth, and sums over it are differences of running sums. A paragraph is a container's own if no other
    container is open inside it; an unclosed paragraph ends where the next begins. Null pages: no row.
    """
    t = tokens(pages.filter(F.col(html).isNotNull()), key, html)
    holds = F.col("name").isin(*CONTAINERS)
    step = F.when(holds & ~F.col("close"), 1).when(holds, -1).otherwise(0)
    page = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    n = F.coalesce(F.length("text"), F.lit(0))
    chinese = n - F.coalesce(F.length(F.regexp_replace("text", r"[\x{4E00}-\x{9FA5}]", "")), F.lit(0))
    t = t.withColumns({"step": step, "depth": F.sum(step).over(page), "n": F.sum(n).over(page), "chinese": F.sum(chinese).over(page)})
    # the depth inside an element is the same at its start and, before the step, at its end
    t = t.withColumn("level", F.col("depth") - F.when(F.col("step") < 0, F.col("step")).otherwise(0))
    level = Window.partitionBy(key, "level").orderBy("at")
    p = (F.col("name") == "p") & ~F.col("close")
    t = t.withColumn("p", F.sum(p.cast("int")).over(level.rowsBetween(Window.unboundedPreceding, 0)))
    edges = t.filter("step <> 0")
    end = lambda c: F.lead(c).over(level)
    closed = end("step") == -1
    elements = edges.withColumns({f"_{c}": F.when(closed, end(c)) for c in ("at", "n", "chinese", "p")}).filter("step = 1")
    # what is never closed ends with the page; its own paragraphs are those of its depth from its start on
    last = t.groupBy(F.col(key).alias("_key")).agg(F.max("at").alias("_last"), F.max("n").alias("_all"), F.max("chinese").alias("_all_chinese"))
    deepest = t.groupBy(F.col(key).alias("_key2"), F.col("level").alias("_level")).agg(F.max("p").alias("_all_p"))
    e = elements.join(last, F.col(key) == F.col("_key")).join(deepest, (F.col(key) == F.col("_key2")) & (F.col("level") == F.col("_level")))
    size = F.coalesce("_n", "_all") - F.col("n")
    score = size + CHINESE * (F.coalesce("_chinese", "_all_chinese") - F.col("chinese"))
    own_p = F.coalesce("_p", "_all_p") - F.col("p")
    e = e.select(key, "at", "name", "tag", size.alias("size"), score.alias("score"), own_p.alias("own_p"), F.coalesce("_at", F.col("_last") + 1).alias("until"))
    classes, ident = F.split(attribute(F.col("tag"), "class"), r"\s+"), attribute(F.col("tag"), "id")
    known = [F.lower(attribute(F.col("tag"), "class")).contains(part) for part in CLASS_PARTS] + [F.array_contains(classes, c) for c in CLASSES[:-1]]
    known += [ident == i for i in IDS] + [F.array_contains(classes, CLASSES[-1])] + [F.col("name") == x for x in NAMES]
    rank = F.coalesce(*[F.when(k, i) for i, k in enumerate(known)])
    e = e.withColumn("rank", F.when(F.col("size") >= LEAST, rank))
    first = lambda when, value, *order: F.min_by(F.when(when, F.struct("at", "until", "name", value.alias("score"))), F.when(when, F.struct(-value, *order)))
    other = (F.col("name") == "div") & (F.col("own_p") >= 1) & (F.col("size") > LEAST_OTHER)
    best = e.groupBy(key).agg(first(F.col("rank").isNotNull(), F.col("score"), "rank", "at").alias("a"), first(other, F.col("score") + PARAGRAPH * F.col("own_p"), "at").alias("b"), F.min_by(F.struct("at", "until", "name", F.lit(None).cast("long").alias("score")), F.when(F.col("name") == "body", F.col("at"))).alias("body"))
    better = F.coalesce(F.col("b.score") > F.coalesce(F.col("a.score"), F.lit(0)), F.lit(False)) & (F.coalesce(F.col("a.score"), F.lit(0)) < SURE)
    chosen = best.select(F.col(key).alias("_k"), F.when(better, F.col("b")).otherwise(F.coalesce("a", "body")).alias("c"))
    found = t.filter("text <> ''").join(chosen, (F.col(key) == F.col("_k")) & (F.col("at") > F.col("c.at")) & (F.col("at") < F.col("c.until")))
    texts = found.groupBy("_k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), "").alias("text"))
    d = chosen.join(texts, "_k", "left")
    return d.select(F.col("_k").alias(key), F.col("c.name").alias("name"), F.col("c.score").alias("score"), F.coalesce("text", F.lit("")).alias("text"))
