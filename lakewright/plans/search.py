"""Retrieval queries: the rows whose id is divisible by 20 ask, all rows answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakewright.operators import search, text_index
from lakewright.plans.catalog import register
from lakewright.session import table

EVERY = 20
#: Results of a hybrid search, candidates of each side, vectors fetched.
K = 6
CANDIDATES = search.budget(K)[1]
FETCHED = search.FETCH * CANDIDATES

_FIRST, _LAST, _LINES = "split_part(text, chr(10), 1)", "string_split(text, chr(10))[-1]", "contains(text, chr(10))"
ROWS_SQL = f"""r AS (SELECT doc_id AS id, source AS file, doc_id || '.txt' AS file_name, source || '/' || lang || '/' || doc_id || '.txt' AS file_path, source AS source_path,
  CASE WHEN {_LINES} AND length({_FIRST}) <= 80 THEN {_FIRST} END AS title, CASE WHEN {_LINES} THEN source || ' · ' || lang END AS citation, text,
  CASE WHEN {_LINES} AND length({_FIRST}) <= 80 THEN 'Part of ' || source END AS source_label, CASE WHEN {_LINES} AND length({_LAST}) <= 80 THEN {_LAST} END AS section_title
  FROM documents)"""


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as rows of a search: a short first line is the title, a short last line a section's, several lines make a citation."""
    lines = F.split("text", "\n")
    several = F.size(lines) > 1
    short = lambda line: several & (F.length(line) <= 80)
    first, last = lines[0], F.element_at(lines, -1)
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("source").alias("file"), name.alias("file_name"), F.concat("source", F.lit("/"), "lang", F.lit("/"), name).alias("file_path"), F.col("source").alias("source_path"),
        F.when(short(first), first).alias("title"), F.when(several, F.concat("source", F.lit(" · "), "lang")).alias("citation"), "text",
        F.when(short(first), F.concat(F.lit("Part of "), "source")).alias("source_label"), F.when(short(last), last).alias("section_title"),
    )


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every twentieth document asks: its source and language as a phrase, then its text; and its vector, if it has one."""
    d = table(spark, sf_dir, "documents").filter(F.col("doc_id") % EVERY == 0)
    asked = d.select(F.col("doc_id").alias("q"), F.concat("source", F.lit("-"), "lang", F.lit(" "), "text").alias("query"))
    return asked.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("q"), F.col("embedding").alias("vector")), "q", "left")


_WORDS = r"regexp_extract_all(lower(strip_accents({})), '[\p{{L}}\p{{N}}]+')"
_TOKENS = " UNION ALL ".join(f"SELECT id, {i} AS c, {_WORDS.format(c)} AS w FROM r" for i, c in enumerate(text_index.COLUMNS))
BM25_SQL = rf"""{ROWS_SQL},
tok AS (SELECT id, c, unnest(w) AS term, unnest(range(len(w))) AS pos FROM ({_TOKENS}) WHERE len(w) > 0),
lens AS (SELECT id, count(*) AS len FROM tok GROUP BY id),
g AS (SELECT (SELECT count(*) FROM r) AS n, (SELECT count(*) FROM tok)::DOUBLE / (SELECT count(*) FROM r) AS avg_len),
terms AS (SELECT q, unnest(t) AS term FROM (SELECT doc_id AS q, regexp_extract_all(source || '-' || lang || ' ' || text, '[\p{{L}}\p{{N}}_-]+')[:{text_index.MAX_TERMS}] AS t FROM documents WHERE doc_id % {EVERY} = 0)),
ph AS (SELECT q, array_to_string({_WORDS.format("term")}, ' ') AS phrase FROM terms),
pw AS (SELECT phrase, unnest(w) AS term, unnest(range(len(w))) AS off, len(w) AS n FROM (SELECT DISTINCT phrase, string_split(phrase, ' ') AS w FROM ph WHERE phrase <> '')),
occ AS (SELECT phrase, id, c, pos - off AS s FROM tok JOIN pw USING (term) GROUP BY phrase, n, id, c, s HAVING count(*) = n),
hit AS (SELECT phrase, id, count(*) AS tf FROM occ GROUP BY phrase, id),
known AS (SELECT phrase, count(*) AS df FROM hit GROUP BY phrase),
worth AS (SELECT phrase, id, greatest(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 1e-6::DOUBLE) * (tf * 2.2::DOUBLE) / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avg_len)) AS w FROM hit JOIN known USING (phrase) JOIN lens USING (id), g),
bm AS (SELECT q, id, round(-sum(w), 6) AS rank FROM ph JOIN worth USING (phrase) GROUP BY q, id),
t AS (SELECT q, id, rank, row_number() OVER (PARTITION BY q ORDER BY rank, id) AS rt FROM bm QUALIFY rt <= {CANDIDATES})"""


def _near_sql(k: int) -> str:
    return f"""near AS (SELECT q, id, label, distance, 1 / (1 + distance) AS score, row_number() OVER (PARTITION BY q ORDER BY distance, id) AS nr
  FROM (SELECT p.vec_id AS q, e.vec_id AS id, e.label, list_sum(list_transform(list_zip(e.embedding, p.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE))) AS distance
    FROM embeddings e, embeddings p WHERE p.vec_id % {EVERY} = 0) QUALIFY nr <= {k})"""


def _probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").filter(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("q"), F.col("embedding").alias("vector"))


@register("f1_knn_l2", f"WITH {_near_sql(3 * K)} SELECT q, id AS vec_id, nr, round(distance, 6) AS distance, round(score, 6) AS score FROM near")
def knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.nearest(table(spark, sf_dir, "embeddings"), _probes(spark, sf_dir), search.FETCH * K)
    return found.select("q", F.col("key").alias("vec_id"), F.col("nr").cast("long").alias("nr"), F.round("distance", 6).alias("distance"), F.round("score", 6).alias("score"))


@register("f2_knn_per_file", f"WITH {_near_sql(3 * K)}, c AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY q, label ORDER BY nr) <= 2) SELECT q, id AS vec_id, label, round(distance, 6) AS distance FROM c QUALIFY row_number() OVER (PARTITION BY q ORDER BY nr) <= {K}")
def knn_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three times as many as wanted are fetched, two of each file stay, and of these the nearest ones."""
    found = search.nearest(table(spark, sf_dir, "embeddings"), _probes(spark, sf_dir), search.FETCH * K, extra=("label",))
    return search.capped(found, K, "label", 2).select("q", F.col("key").alias("vec_id"), "label", F.round("distance", 6).alias("distance"))


@register("f3_bm25", f"WITH {BM25_SQL} SELECT q, id AS doc_id, rank FROM t")
def bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = text_index.bm25(text_index.build(rows(spark, sf_dir)), queries(spark, sf_dir).drop("vector"), CANDIDATES)
    return found.select("q", F.col("key").alias("doc_id"), "rank")


FUSED_SQL = f"""WITH {BM25_SQL}, {_near_sql(FETCHED)},
nf AS (SELECT near.*, coalesce(r.file, 'id:' || near.id) AS file FROM near LEFT JOIN r USING (id) WHERE q IN (SELECT doc_id FROM documents)),
nc AS (SELECT * FROM nf QUALIFY row_number() OVER (PARTITION BY q, file ORDER BY nr) <= {search.HYBRID_CAP}),
v AS (SELECT q, id, score, row_number() OVER (PARTITION BY q ORDER BY nr) AS rv FROM nc QUALIFY rv <= {CANDIDATES}),
f AS (SELECT coalesce(v.q, t.q) AS q, coalesce(v.id, t.id) AS id, score AS v_score, rank AS t_rank, rv IS NOT NULL AND rt IS NOT NULL AS both_,
  coalesce(1::DOUBLE / (60 + rv), 0) + coalesce(1.12::DOUBLE / (60 + rt), 0) + CASE WHEN rv IS NOT NULL AND rt IS NOT NULL THEN 0.003::DOUBLE ELSE 0 END AS fused
  FROM v FULL OUTER JOIN t ON v.q = t.q AND v.id = t.id),
b AS (SELECT f.*, coalesce(r.file, 'id:' || f.id) AS file,
  CASE WHEN r.source_label <> '' THEN {search.ANCHOR}::DOUBLE ELSE 0 END + CASE WHEN r.title <> '' OR r.section_title <> '' OR r.citation <> '' THEN {search.TITLE}::DOUBLE ELSE 0 END AS bonus FROM f LEFT JOIN r USING (id)),
c AS (SELECT *, fused + bonus AS blended FROM b)"""


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.candidates(rows(spark, sf_dir), table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), queries(spark, sf_dir), K)


@register("f4_fused_ranks", FUSED_SQL + " SELECT q, id, both_ AS both, round(blended, 8) AS blended FROM c")
def fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir).select("q", "id", "both", F.round("blended", 8).alias("blended"))


@register("f5_anchor_bonus", FUSED_SQL + " SELECT q, id, round(bonus, 6) AS bonus, round(blended, 8) AS blended FROM c")
def anchored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir).select("q", "id", F.round("bonus", 6).alias("bonus"), F.round("blended", 8).alias("blended"))


@register(
    "f6_hybrid_search",
    FUSED_SQL
    + f""", o AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY blended DESC, both_ DESC, coalesce(v_score, 0) DESC, coalesce(t_rank, 'inf'::DOUBLE), id) AS place FROM c),
n AS (SELECT *, row_number() OVER (PARTITION BY q, file ORDER BY place) AS nth FROM o),
w AS (SELECT *, count(*) OVER (PARTITION BY q) > {K} AND least(sum((nth = 1)::INT) OVER (PARTITION BY q), {K}) >= 2 AS two FROM n),
k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY (two AND nth > 1)::INT, place) AS pos FROM w WHERE nth <= CASE WHEN two THEN 3 ELSE 2 END)
SELECT q, pos, id, file, round(blended / max(blended) OVER (PARTITION BY q), 6) AS score FROM k WHERE pos <= {K}""",
)
def hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.hybrid(rows(spark, sf_dir), table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), queries(spark, sf_dir), K)
    return found.select("q", F.col("pos").cast("long").alias("pos"), "id", "file", F.round("final_score", 6).alias("score"))


@register("f12_vector_check", "SELECT len(embedding)::BIGINT AS dim, count(*) AS n, sum((len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) > 0)::INT)::BIGINT AS n_bad FROM embeddings GROUP BY ALL")
def vector_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return table(spark, sf_dir, "embeddings").groupBy(F.size("embedding").cast("long").alias("dim")).agg(F.count("*").alias("n"), F.count_if(bad).alias("n_bad"))


@register("f14_metadata_mismatch", "SELECT vec_id, label FROM embeddings WHERE label IS DISTINCT FROM 3 ORDER BY vec_id LIMIT 1")
def mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").filter(~F.col("label").eqNullSafe(3)).orderBy("vec_id").limit(1).select("vec_id", "label")


@register("d17_evidence_by_source", """
WITH s AS (SELECT source, doc_id, left(text, 80) AS snippet, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS n, count(*) OVER (PARTITION BY source) AS hits FROM documents)
SELECT source, max(hits) AS hits, list(snippet ORDER BY n) AS snippets FROM s WHERE n <= 2 GROUP BY source ORDER BY hits DESC, source LIMIT 6""")
def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars", F.left("text", F.lit(80)).alias("snippet"))
    totals = d.groupBy("source").agg(F.count("*").alias("hits"))
    best = d.withColumn("n", F.row_number().over(Window.partitionBy("source").orderBy(F.col("n_chars").desc(), "doc_id"))).filter("n <= 2")
    best = best.groupBy("source").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "snippet"))), lambda x: x["snippet"]).alias("snippets"))
    return totals.join(best, "source").orderBy(F.col("hits").desc(), "source").limit(6).select("source", "hits", "snippets")
