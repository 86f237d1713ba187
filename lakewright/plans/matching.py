"""Queries: titles of a deck, their order, the main content of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewright.operators import content, titles
from lakewright.plans.catalog import register
from lakewright.session import table

#: Names of a deck are the parts of a brand by size; the type of a part tells how its title is written.
NAMES_SQL = "SELECT DISTINCT p_brand AS deck, p_size || '_' || p_name AS name FROM part"
TITLES_SQL = """SELECT p_partkey, p_brand AS deck, CASE p_type WHEN 'ECONOMY' THEN p_size || '_' || p_name WHEN 'LARGE' THEN ' ' || p_size || ' - ' || upper(p_name) || '!' WHEN 'MEDIUM' THEN 'Slide ' || p_size || ': ' || p_type
 WHEN 'PROMO' THEN upper(p_name) WHEN 'SMALL' THEN left(p_name, 2) ELSE '第 ' || p_size || ' 页' END AS title FROM part"""
_NORMAL = r"lower(trim(regexp_replace({}, '[^0-9A-Za-z\x{{4E00}}-\x{{9FFF}}]+', '_', 'g'), '_'))"


def _number_sql(text: str) -> str:
    return "coalesce(" + ", ".join(f"TRY_CAST(regexp_extract(lower({text}), '{p}', 1) AS INT)" for p in titles.NUMBERED) + ")"


@register(
    "c22_title_match",
    f"""WITH n AS (SELECT *, {_NORMAL.format("name")} AS normal, {_number_sql("name")} AS number FROM ({NAMES_SQL})),
t AS (SELECT *, {_NORMAL.format("title")} AS normal, {_number_sql("title")} AS number FROM ({TITLES_SQL})),
s AS (SELECT p_partkey, deck, title, (SELECT any_value(name) FROM n WHERE n.deck = t.deck AND n.name = t.title) AS exact,
  (SELECT CASE WHEN count(*) = 1 THEN min(name) END FROM n WHERE n.deck = t.deck AND n.normal = t.normal) AS normal,
  (SELECT CASE WHEN count(*) = 1 THEN min(name) END FROM n WHERE n.deck = t.deck AND n.number = t.number) AS number,
  (SELECT CASE WHEN count(*) = 1 THEN min(name) END FROM n WHERE n.deck = t.deck AND t.normal <> '' AND contains(n.normal, t.normal)) AS part FROM t)
SELECT p_partkey, title, coalesce(exact, normal, number, part) AS match, CASE WHEN exact IS NOT NULL THEN 'exact' WHEN normal IS NOT NULL THEN 'normal' WHEN number IS NOT NULL THEN 'number' WHEN part IS NOT NULL THEN 'part' END AS step FROM s""",
)
def title_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    ask = lambda sql: spark.sql(sql.replace("FROM part", "FROM {p}"), p=part)
    return titles.match_titles(ask(TITLES_SQL), ask(NAMES_SQL)).select("p_partkey", "title", "match", "step")


#: Letters in the order of their accents, as far as the tables have them.
_ACCENTS = {"é": 1, "í": 1, "ó": 1, "á": 1, "ú": 1, "è": 2, "à": 2, "ù": 2, "ê": 3, "â": 3, "î": 3, "ô": 3, "û": 3, "ä": 4, "ö": 4, "ü": 4, "ë": 4, "ï": 4, "ñ": 5, "ç": 6}
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_WORD = r"replace(regexp_extract(text, '[\p{L}]+'), 'ß', 'ss')"


@register(
    "j4_collated_titles",
    f"""WITH d AS (SELECT doc_id, source, n_chars // 2000 AS size, {_WORD} AS title FROM documents)
SELECT doc_id, title, row_number() OVER (PARTITION BY source ORDER BY size DESC, strip_accents(lower(title)), translate(lower(title), '{_LETTERS + "".join(_ACCENTS)}', '{"0" * 26 + "".join(map(str, _ACCENTS.values()))}'), regexp_replace(regexp_replace(title, '\\p{{Ll}}', '0', 'g'), '\\p{{Lu}}', '1', 'g'), doc_id) AS place FROM d""",
)
def collated_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a source by size, and their first words in the order of a language's readers: letters, then accents, then case."""
    word = F.replace(F.regexp_extract("text", r"[\p{L}]+", 0), F.lit("ß"), F.lit("ss"))
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.floor(F.col("n_chars") / 2000).alias("size"), word.alias("title"))
    return titles.title_places(d, "source", [F.col("size").desc(), titles.collated("title"), F.col("doc_id")]).select("doc_id", "title", F.col("place").cast("long").alias("place"))


#: French pages have their content in a div, German ones in a section, Spanish ones in two articles; the others in an article.
PAGES_SQL = """SELECT page_id, CASE WHEN contains(html, '<html lang="fr">') THEN replace(replace(html, '<article>', '<div class="post">'), '</article>', '</div>') WHEN contains(html, '<html lang="de">') THEN replace(replace(html, '<article>', '<section>'), '</article>', '</section>')
 WHEN contains(html, '<html lang="es">') THEN replace(html, '</h1>', '</h1></article><div><div id="content">') ELSE html END AS html FROM pages"""
_CLUTTER = "|".join(content.CLUTTER)
_BARE = f"regexp_replace(html, '(?is)<script\\b[^>]*>.*?</script\\s*>', '', 'g')"
for _tag in content.CLUTTER[1:]:
    _BARE = f"regexp_replace({_BARE}, '(?is)<{_tag}\\b[^>]*>.*?</{_tag}\\s*>', '', 'g')"
_TEXT = "token"
for _entity, _code in (("nbsp", 160), ("lt", 60), ("gt", 62), ("quot", 34), ("#39", 39), ("middot", 183), ("copy", 169), ("amp", 38)):
    _TEXT = f"replace({_TEXT}, '&{_entity};', chr({_code}))"


@register(
    "e28_main_content",
    rf"""WITH k AS (SELECT page_id, unnest(ts) AS token, unnest(range(len(ts))) AS pos FROM (SELECT page_id, regexp_extract_all({_BARE}, '{content._TAG}') AS ts FROM ({PAGES_SQL}))),
t AS (SELECT page_id, pos, token, starts_with(token, '</') AS close, lower(regexp_extract(token, '^</?([A-Za-z][A-Za-z0-9]*)', 1)) AS name, CASE WHEN NOT starts_with(token, '<') THEN regexp_replace({_TEXT}, '^[\s\x{{A0}}]+|[\s\x{{A0}}]+$', '', 'g') ELSE '' END AS text FROM k),
o AS (SELECT *, sum(CASE WHEN name NOT IN {content.CONTAINERS} THEN 0 WHEN close THEN -1 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY pos) AS depth FROM t),
e AS (SELECT o.page_id, o.pos, o.name, o.token, o.depth, coalesce((SELECT min(c.pos) FROM o c WHERE c.page_id = o.page_id AND c.pos > o.pos AND c.depth < o.depth), (SELECT max(c.pos) + 1 FROM o c WHERE c.page_id = o.page_id)) AS until FROM o WHERE name IN {content.CONTAINERS} AND NOT close),
s AS (SELECT e.page_id, e.pos, e.name, e.token, e.until, sum(length(o.text)) AS size, sum(length(o.text) - length(regexp_replace(o.text, '[\x{{4E00}}-\x{{9FA5}}]', '', 'g'))) AS chinese, count(*) FILTER (o.name = 'p' AND NOT o.close AND o.depth = e.depth) AS own_p, string_agg(o.text, '' ORDER BY o.pos) AS text
  FROM e JOIN o ON o.page_id = e.page_id AND o.pos >= e.pos AND o.pos < e.until GROUP BY ALL),
c AS (SELECT *, size + 2 * chinese AS score, CASE WHEN regexp_extract(token, '\sid="([^"]*)"', 1) = 'content' THEN 1 WHEN name IN ('article', 'main') THEN 2 END AS rank FROM s),
a AS (SELECT * FROM c WHERE rank IS NOT NULL AND size >= 100 QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY score DESC, rank, pos) = 1),
b AS (SELECT *, score + 50 * own_p AS better FROM c WHERE name = 'div' AND own_p >= 1 AND size > 200 QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY score + 50 * own_p DESC, pos) = 1),
body AS (SELECT * FROM c WHERE name = 'body'),
u AS (SELECT body.page_id, a.page_id IS NOT NULL AS is_a, coalesce(a.score, 0) < 200 AND coalesce(b.better > coalesce(a.score, 0), false) AS is_b FROM body LEFT JOIN a USING (page_id) LEFT JOIN b USING (page_id))
SELECT u.page_id, CASE WHEN is_b THEN b.name WHEN is_a THEN a.name ELSE body.name END AS name, CASE WHEN is_b THEN b.better WHEN is_a THEN a.score END::BIGINT AS score, md5(CASE WHEN is_b THEN b.text WHEN is_a THEN a.text ELSE body.text END) AS digest
FROM u JOIN body USING (page_id) LEFT JOIN a USING (page_id) LEFT JOIN b USING (page_id)""",
)
def main_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.sql(PAGES_SQL.replace("FROM pages", "FROM {p}"), p=table(spark, sf_dir, "pages"))
    return content.main_content(pages).select("page_id", "name", "score", F.md5("text").alias("digest"))
