"""Queries: documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewright.functions import text as T
from lakewright.operators.chunking import chunks
from lakewright.operators.relational import merge_by_id
from lakewright.plans.catalog import register
from lakewright.session import table

SPACE = T.SPACE
TRIM_SQL = f"'^{SPACE}+|{SPACE}+$', '', 'g'"
NORMAL_SQL = rf"regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(0), ''), '[ \t]+\n', chr(10), 'g'), '\n{{4,}}', chr(10) || chr(10) || chr(10), 'g'), {TRIM_SQL})"
FLAT_SQL = f"trim(regexp_replace(text, '{SPACE}+', ' ', 'g'))"


@register("e1_normalise", f"SELECT doc_id, md5({NORMAL_SQL}) AS digest, length({NORMAL_SQL})::BIGINT AS n FROM documents")
def normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", T.normalise(F.col("text")).alias("t"))
    return d.select("doc_id", F.md5("t").alias("digest"), F.length("t").cast("long").alias("n"))


WARNING = f"Parsed text was capped at {T.TEXT_CAP} characters for this indexing pass."


#: Texts are taken so many times over, so that the longest exceed the cap.
TIMES = 60


@register("e2_length_cap", f"SELECT doc_id, md5(left(t, {T.TEXT_CAP})) AS digest, length(t) > {T.TEXT_CAP} AS cut, CASE WHEN length(t) > {T.TEXT_CAP} THEN '{WARNING}' END AS warning FROM (SELECT doc_id, repeat(text, {TIMES}) AS t FROM documents)")
def length_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.repeat("text", F.lit(TIMES)).alias("text"))
    over = F.length("text") > T.TEXT_CAP
    return d.select("doc_id", F.md5(F.left("text", F.lit(T.TEXT_CAP))).alias("digest"), over.alias("cut"), F.when(over, F.lit(WARNING)).alias("warning"))


#: Windows of the texts t in n, as CTEs c and k.
WINDOWS_SQL = rf"""
c AS (
  SELECT doc_id, t, 0 AS no, 0 AS s, 0 AS e FROM n WHERE length(t) > 0
  UNION ALL
  SELECT doc_id, t, no + 1, ns, CASE WHEN ns + 2400 >= length(t) THEN length(t) ELSE ns + CASE
    WHEN length(regexp_extract(w, '(?s)^(.*)\n\n', 1)) > 1320 THEN length(regexp_extract(w, '(?s)^(.*)\n\n', 1))
    WHEN length(regexp_extract(w, '(?s)^(.*)\n', 1)) > 1560 THEN length(regexp_extract(w, '(?s)^(.*)\n', 1))
    WHEN length(regexp_extract(w, '(?s)^(.*)(?:[.?!] |。)', 1)) > 1680 THEN length(regexp_extract(w, '(?s)^(.*)(?:[.?!] |。)', 1)) + 1
    ELSE 2400 END END
  FROM (SELECT *, substring(t, ns + 1, 2400) AS w FROM (SELECT *, CASE WHEN no = 0 THEN 0 ELSE greatest(e - 260, s + 1) END AS ns FROM c WHERE no = 0 OR e < length(t)))),
k AS (SELECT doc_id, no, s, regexp_replace(substring(t, s + 1, e - s), {TRIM_SQL}) AS chunk FROM c WHERE no > 0)"""


@register("e3_chunks", rf"""
WITH RECURSIVE n AS (SELECT doc_id, {NORMAL_SQL} AS t FROM documents), {WINDOWS_SQL}
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY no) AS no, s::BIGINT AS start, md5(chunk) AS digest FROM k WHERE chunk <> ''""")
def chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", T.normalise(F.col("text")).alias("text"))
    return chunks(d).select("doc_id", "no", "start", F.md5("chunk").alias("digest"))


@register("e10_excerpt", f"SELECT doc_id, md5(CASE WHEN hit IS NULL THEN left(f, 900) ELSE trim(substring(f, greatest(hit - 260, 1), hit - greatest(hit - 260, 1) + 900)) END) AS digest FROM (SELECT doc_id, f, least(nullif(strpos(lower(f), 'license'), 0), nullif(strpos(lower(f), 'tion.'), 0)) AS hit FROM (SELECT doc_id, {FLAT_SQL} AS f FROM documents))")
def excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.excerpt(F.col("text"), ["license", "tion."])).alias("digest"))


@register("e13_summary", f"SELECT doc_id, left({FLAT_SQL}, 180) AS summary FROM documents")
def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.left(T.collapsed(F.col("text")), F.lit(T.SUMMARY)).alias("summary"))


HTML_SQL = r"""replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
 '(?is)<script\b[^>]*>.*?</script>', ' ', 'g'), '(?is)<style\b[^>]*>.*?</style>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'),
 '(?i)</(p|div|section|article|header|footer|li|tr|h[1-6])>|<br\s*/?>', chr(10), 'g'), '<[^>]+>', ' ', 'g'),
 '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', '''')"""


@register("e6_html_text", f"SELECT page_id, md5(left({HTML_SQL}, 250000)) AS digest FROM pages")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.strip_html(F.col("html"))).alias("digest"))


SCHEME, HOST, PATH, ARGS = r"lower(regexp_extract(b, '^([A-Za-z]+)://', 1))", r"lower(regexp_extract(b, '^[A-Za-z]+://([^/?]*)', 1))", r"regexp_replace(regexp_extract(b, '^[A-Za-z]+://[^/?]*([^?]*)', 1), '/+$', '')", r"regexp_extract(b, '\?(.*)$', 1)"
URL_SQL = rf"""{SCHEME} || '://' || CASE {SCHEME} WHEN 'https' THEN regexp_replace({HOST}, ':443$', '') WHEN 'http' THEN regexp_replace({HOST}, ':80$', '') ELSE {HOST} END || CASE WHEN {PATH} = '' THEN '/' ELSE {PATH} END
 || CASE WHEN {ARGS} = '' THEN '' ELSE '?' || (SELECT string_agg(x, '&' ORDER BY split_part(x, '=', 1), i) FROM (SELECT unnest(string_split({ARGS}, '&')) AS x, unnest(range(1000)[:len(string_split({ARGS}, '&'))]) AS i)) END"""


@register("e11_canonical_url", f"SELECT page_id, {URL_SQL} AS url FROM (SELECT page_id, regexp_replace(url, '#.*$', '') AS b FROM pages)")
def canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.canonical_url(F.col("url")).alias("url"))


def _count_sql(m: str) -> str:
    spelt = " || ".join(f"chr({ord(c)})" for c in m)
    return f"(length(text) - length(replace(text, {spelt}, ''))) / {len(m)}"


#: Letters of two bytes, as they look when these are read one by one.
_MISREAD = "text"
for _c in "ÀÄÇÈÉÊËÍÑÓÔÖÙÚÛÜßàáâäçèéêëíîïñóôöùúûü":
    _MISREAD = f"replace({_MISREAD}, '{_c}', chr(195) || chr({_c.encode()[1]}))"


@register("e29_mojibake", f"SELECT doc_id, (20 * ({' + '.join(map(_count_sql, T.MOJIBAKE))}) + 10 * (length(text) - length(regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g'))) + 50 * {_count_sql(chr(65533))})::BIGINT AS score FROM (SELECT doc_id, CASE WHEN lang IN ('fr', 'es') THEN {_MISREAD} WHEN lang = 'de' THEN replace(replace(text, 'ü', chr(65533)), 'ö', chr(7)) ELSE text END AS text FROM documents)")
def mojibake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """French and Spanish texts read in a wrong encoding, German ones with lost characters and control characters, others as they are."""
    misread = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    text = F.when(F.col("lang").isin("fr", "es"), misread).when(F.col("lang") == "de", F.translate("text", "üö", "�\x07")).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("text")).select("doc_id", T.decode_score(F.col("text")).alias("score"))


@register("e30_slug", rf"SELECT conv_id, turn, left(regexp_replace(regexp_replace(regexp_replace(text, '{SPACE}+', '_', 'g'), '[^\x{{4E00}}-\x{{9FA5}}a-zA-Z0-9_]', '', 'g'), '_+', '_', 'g'), 80) AS slug FROM conversations")
def slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.file_name(F.col("text")).alias("slug"))


#: Rules in order: the first whose pattern is found gives the class.
CLASSES = (("(?i)^(hot|cold)", "treated"), ("(?i)bolt|gear|rod", "machine"), ("(?i)old|small", "spare"), ("(?i)g$", "worn"))


@register("e31_first_rule", "SELECT p_partkey, CASE " + " ".join(f"WHEN regexp_matches(p_name, '{p}') THEN '{c}'" for p, c in CLASSES) + " ELSE 'other' END AS class FROM part")
def first_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = F.lit("other")
    for pattern, name in reversed(CLASSES):
        out = F.when(F.col("p_name").rlike(pattern), name).otherwise(out)
    return table(spark, sf_dir, "part").select("p_partkey", out.alias("class"))


@register("e34_citation", "SELECT doc_id, concat_ws(' · ', source, lang, 'chunk ' || (doc_id % 5 + 1) || '/5') AS citation FROM documents")
def citation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.concat_ws(" · ", "source", "lang", F.concat(F.lit("chunk "), (F.col("doc_id") % 5 + 1).cast("string"), F.lit("/5"))).alias("citation"))


#: The share of a page's texts that is its head, and its foot; in how many of a document's pages a text is no content, from so many pages on.
ZONE, REPEATED, LEAST_PAGES = 0.15, 0.6, 3
_HOST = "regexp_extract(url, '^https?://([^/?#]*)', 1)"


@register(
    "d20_repeated_lines",
    rf"""WITH t AS (SELECT host, page_id, unnest(texts) AS text, unnest(range(len(texts))) AS i, len(texts) AS n FROM (SELECT {_HOST} AS host, page_id, list_filter(list_transform(regexp_split_to_array(html, '<[^>]*>|&middot;'), lambda x: trim(x)), lambda x: x <> '') AS texts FROM pages)),
z AS (SELECT host, text, CASE WHEN i < {ZONE} * n THEN 'head' WHEN i + 1 > (1 - {ZONE}) * n THEN 'foot' END AS zone FROM t),
p AS (SELECT {_HOST} AS host, count(*) AS pages FROM pages GROUP BY 1)
SELECT host, zone, text, count(*) AS n, pages FROM z JOIN p USING (host) WHERE zone IS NOT NULL GROUP BY host, zone, text, pages HAVING count(*) > {REPEATED} * pages AND pages >= {LEAST_PAGES}""",
)
def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts at the head or the foot of most pages of a host. Texts are summed up where they are, before they move."""
    host = F.regexp_extract("url", "^https?://([^/?#]*)", 1)
    texts = F.filter(F.transform(F.split("html", "<[^>]*>|&middot;"), lambda x: F.trim(x)), lambda x: x != "")
    d = table(spark, sf_dir, "pages").select(host.alias("host"), texts.alias("texts"))
    t = d.select("host", F.size("texts").alias("size"), F.posexplode("texts").alias("i", "text"))
    zone = F.when(F.col("i") < ZONE * F.col("size"), "head").when(F.col("i") + 1 > (1 - ZONE) * F.col("size"), "foot")
    n = t.withColumn("zone", zone).filter("zone IS NOT NULL").groupBy("host", "zone", "text").agg(F.count("*").alias("n"))
    pages = d.groupBy(F.col("host").alias("_h")).agg(F.count("*").alias("pages")).filter(F.col("pages") >= LEAST_PAGES)
    return n.join(pages, F.col("host") == F.col("_h")).filter(F.col("n") > REPEATED * F.col("pages")).select("host", "zone", "text", "n", "pages")


_INCOMING = "source IN ('src2', 'src3', 'src5') AND n_chars % 2 = 0"


@register(
    "l1_merge_by_file",
    f"""WITH o AS (SELECT doc_id, source, 'old' AS version FROM documents WHERE lang <> 'es'), n AS (SELECT doc_id, source, 'new' AS version FROM documents WHERE {_INCOMING})
SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, coalesce(n.source, o.source) AS source, coalesce(n.version, o.version) AS version, CASE WHEN n.doc_id IS NOT NULL AND o.doc_id IS NOT NULL THEN 'update' WHEN n.doc_id IS NOT NULL THEN 'insert' WHEN o.source IN (SELECT source FROM n) THEN 'delete' ELSE 'keep' END AS action
FROM o FULL OUTER JOIN n ON o.doc_id = n.doc_id""",
)
def merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of an index, Spanish ones not yet in it, meet those of three files that are indexed anew; what is deleted is shown as well."""
    d = table(spark, sf_dir, "documents")
    old = d.filter("lang <> 'es'").select("doc_id", "source", F.lit("old").alias("version"))
    return merge_by_id(old, d.filter(_INCOMING).select("doc_id", "source", F.lit("new").alias("version")), "doc_id", "source")
