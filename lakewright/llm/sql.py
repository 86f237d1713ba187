"""DuckDB SQL for the operators that SQL can express."""

from lakewright.llm.mixing import MAX_EPOCHS, SEED
from lakewright.llm.quality_rules import HOST_SHARE, KEEP_SHARE, MAX_REPEAT_PERCENT, MIN_DOCS, MIN_WORDS

MIXING_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS ord
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         1.0::DOUBLE + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight
  FROM sized GROUP BY source),
ladder AS (
  SELECT *, {MAX_EPOCHS} * source_size::DOUBLE AS cap,
         sum({MAX_EPOCHS} * source_size::DOUBLE) OVER w - {MAX_EPOCHS} * source_size::DOUBLE AS held,
         sum(weight) OVER () - sum(weight) OVER w + weight AS open_weight,
         sum(source_size) OVER ()::DOUBLE AS total
  FROM sources WINDOW w AS (ORDER BY {MAX_EPOCHS} * source_size::DOUBLE / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
level AS (SELECT arg_min((total - held) / open_weight, cap / weight) AS level FROM ladder WHERE cap / weight >= (total - held) / open_weight),
targets AS (
  SELECT source, source_size, least(cap, weight * level) AS target,
         CASE WHEN source_size > 0 THEN floor(least(cap, weight * level) / source_size)::BIGINT ELSE 0 END AS whole
  FROM ladder, level),
summed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, t.whole,
         round(t.target)::BIGINT - t.whole * t.source_size AS need,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.ord, s.size ROWS UNBOUNDED PRECEDING) - s.size AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (whole * size + least(greatest(need - before, 0), size))::BIGINT AS taken
FROM summed
"""

QUALITY_RULES_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, source AS host FROM documents),
w AS (SELECT rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM docs),
pos AS (
  SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM pos) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT i + k)::BIGINT AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid),
lines AS (
  SELECT rid, host, doc_id, l, lower(trim(regexp_replace(l, '[\x20\x09-\x0D]+', ' ', 'g'), ' ')) AS norm,
         length(regexp_replace(l, '[\x20\x09-\x0D]+', '', 'g')) AS chars
  FROM (SELECT rid, host, doc_id, unnest(string_split(t, chr(10))) AS l FROM docs)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
dup AS (SELECT rid, (count(*) - count(DISTINCT l))::BIGINT AS n FROM lines GROUP BY rid),
totals AS (SELECT host, count(DISTINCT doc_id) + max(CASE WHEN doc_id IS NULL THEN 1 ELSE 0 END) AS n FROM docs GROUP BY host),
bad AS (
  SELECT l.host, l.norm FROM (
    SELECT host, norm, count(DISTINCT doc_id) + max(CASE WHEN doc_id IS NULL THEN 1 ELSE 0 END) AS n FROM lines GROUP BY host, norm) l
  JOIN totals t ON l.host IS NOT DISTINCT FROM t.host
  WHERE l.n > {MIN_DOCS} AND l.n > {HOST_SHARE} * t.n),
gone AS (
  SELECT rid, sum(chars)::BIGINT AS n FROM lines l
  JOIN bad b ON l.host IS NOT DISTINCT FROM b.host AND l.norm = b.norm GROUP BY rid),
m AS (
  SELECT d.doc_id, len(w.w)::BIGINT AS n_words,
         length(regexp_replace(d.t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(d.t) - length(regexp_replace(d.t, '[#*$%&|<>]+', '', 'g')))::BIGINT AS n_symbols,
         coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
         coalesce(gone.n, 0)::BIGINT AS removed_chars
  FROM docs d JOIN w USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN gone USING (rid)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND word_chars - removed_chars >= {KEEP_SHARE} * word_chars AS kept FROM b
"""
