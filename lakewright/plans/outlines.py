"""Queries: outlines of documents, their sections and balanced chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewright.functions import text as T
from lakewright.operators import outline
from lakewright.operators.chunking import LONG, MANY_LINES, MANY_PARAGRAPHS, SIZE, SOME_PARAGRAPHS, SPLITTABLE, chunks, section_chunks
from lakewright.plans.catalog import register
from lakewright.plans.documents import NORMAL_SQL, TRIM_SQL, WINDOWS_SQL
from lakewright.session import table

#: A line of up to so many words is a heading, its first word the title, and the number of its words the level.
HEADING_WORDS = 4


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, index, level, title, text): the lines of documents that hold something; short ones are headings."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("index", "text")).filter(F.trim("text") != "")
    words = F.size(F.split(F.trim("text"), " +"))
    heading = words <= HEADING_WORDS
    return d.select("doc_id", F.col("index").cast("long").alias("index"), F.when(heading, words).alias("level"), F.when(heading, F.lower(F.split_part(F.trim("text"), F.lit(" "), F.lit(1)))).alias("title"), "text")


BLOCKS_SQL = f"""b AS (SELECT doc_id, index, text, CASE WHEN words <= {HEADING_WORDS} THEN words END AS level, CASE WHEN words <= {HEADING_WORDS} THEN lower(split_part(trim(text), ' ', 1)) END AS title
  FROM (SELECT *, len(regexp_split_to_array(trim(text), ' +')) AS words FROM (SELECT doc_id, unnest(lines) AS text, unnest(range(len(lines))) AS index FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)) WHERE trim(text) <> ''))"""
#: A heading is open at a block if no heading of its level or a lower number stands behind it, up to the block.
PATHS_SQL = f"""{BLOCKS_SQL},
h AS (SELECT doc_id, index, level, title, (SELECT min(n.index) FROM b n WHERE n.doc_id = b.doc_id AND n.index > b.index AND n.level <= b.level) AS until FROM b WHERE level IS NOT NULL),
p AS (SELECT b.doc_id, b.index, b.text, coalesce(list(h.title ORDER BY h.level) FILTER (h.title <> ''), []) AS path
  FROM b LEFT JOIN h ON h.doc_id = b.doc_id AND h.index <= b.index AND (h.until IS NULL OR h.until > b.index) GROUP BY ALL)"""


@register("e24_heading_paths", f"WITH {PATHS_SQL} SELECT doc_id, index, path, md5(text) AS digest FROM p")
def heading_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outline.heading_paths(blocks(spark, sf_dir), levels=HEADING_WORDS).select("doc_id", "index", "path", F.md5("text").alias("digest"))


SECTIONS_SQL = f"""{PATHS_SQL},
s AS (SELECT doc_id, title, row_number() OVER (PARTITION BY doc_id ORDER BY first) AS no, blocks, text FROM (
  SELECT doc_id, CASE WHEN len(path) = 0 THEN '{outline.NO_PATH}' ELSE array_to_string(path, '{outline.JOINED}') END AS title, min(index) AS first, list(index ORDER BY index) AS blocks, string_agg(text, chr(10) || chr(10) ORDER BY index) AS text
  FROM p GROUP BY 1, 2) WHERE regexp_matches(text, '\\S'))"""


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outline.sections(outline.heading_paths(blocks(spark, sf_dir), levels=HEADING_WORDS))


@register("e25_sections", f"WITH {SECTIONS_SQL} SELECT doc_id, no, title, blocks, md5(text) AS digest FROM s")
def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sections(spark, sf_dir).select("doc_id", "no", "title", "blocks", F.md5("text").alias("digest"))


def _filled(unit: str) -> str:
    return f"list_filter(list_transform({unit}, lambda x: regexp_replace(x, {TRIM_SQL})), lambda x: x <> '')"


#: Of texts t by doc_id in n: chunks (doc_id, no, chunk) in z, as CTEs.
BALANCED_SQL = rf"""
least AS (SELECT doc_id, t, CASE WHEN length(b) NOT BETWEEN {SPLITTABLE} AND {SIZE} THEN 1 WHEN np >= {MANY_PARAGRAPHS} OR length(b) >= {LONG} THEN 3 WHEN np >= {SOME_PARAGRAPHS} OR nl >= {MANY_LINES} THEN 2 ELSE 1 END AS parts
  FROM (SELECT doc_id, t, b, len({_filled("regexp_split_to_array(b, '\n{2,}')")}) AS np, len({_filled("string_split(b, chr(10))")}) AS nl FROM (SELECT doc_id, t, regexp_replace(t, {TRIM_SQL}) AS b FROM n))),
units AS (SELECT doc_id, parts, ceil(length(t) / parts) AS share, CASE WHEN len(p) >= parts THEN p ELSE l END AS u
  FROM (SELECT *, {_filled("regexp_split_to_array(t, '\n{2,}')")} AS p, {_filled("string_split(t, chr(10))")} AS l FROM least WHERE parts > 1)),
fold AS (
  SELECT doc_id, 1::BIGINT AS i, 1::BIGINT AS no, length(u[1])::BIGINT AS held FROM units WHERE len(u) >= parts
  UNION ALL
  SELECT doc_id, i + 1, CASE WHEN ends THEN no + 1 ELSE no END, CASE WHEN ends THEN length(u[i + 1]) ELSE held + 2 + length(u[i + 1]) END
  FROM (SELECT f.*, u, no < parts AND held + 2 + length(u[i + 1]) >= share AS ends FROM fold f JOIN units USING (doc_id) WHERE i < len(u))),
even AS (SELECT doc_id, no, string_agg(u[i], chr(10) || chr(10) ORDER BY i) AS chunk, max(no) OVER (PARTITION BY doc_id) >= any_value(parts) AS whole FROM fold JOIN units USING (doc_id) GROUP BY doc_id, no),
z AS (SELECT doc_id, no, chunk FROM even WHERE whole
  UNION ALL SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY no), chunk FROM k WHERE chunk <> '' AND doc_id NOT IN (SELECT doc_id FROM even WHERE whole))"""


@register("e5_balanced_chunks", f"WITH RECURSIVE n AS (SELECT doc_id, {NORMAL_SQL} AS t FROM documents), {WINDOWS_SQL}, {BALANCED_SQL} SELECT doc_id, no, md5(chunk) AS digest, length(chunk)::BIGINT AS n FROM z")
def balanced_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", T.normalise(F.col("text")).alias("text"))
    return chunks(d, structured=True).select("doc_id", "no", F.md5("chunk").alias("digest"), F.length("chunk").cast("long").alias("n"))


@register(
    "e8_section_chunks",
    f"WITH RECURSIVE {SECTIONS_SQL}, n AS (SELECT {{'d': doc_id, 's': no}} AS doc_id, text AS t FROM s), {WINDOWS_SQL}, {BALANCED_SQL}"
    " SELECT z.doc_id.d AS doc_id, z.doc_id.s AS section_index, s.title, z.no AS chunk_in_section, count(*) OVER (PARTITION BY z.doc_id) AS chunks_in_section, md5(chunk) AS digest FROM z JOIN s ON s.doc_id = z.doc_id.d AND s.no = z.doc_id.s",
)
def sections_in_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return section_chunks(_sections(spark, sf_dir)).select("doc_id", "section_index", "title", "chunk_in_section", "chunks_in_section", F.md5("chunk").alias("digest"))
