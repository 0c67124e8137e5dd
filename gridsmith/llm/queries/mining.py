"""Hard negatives, divergence of sources and mixing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..common import read
from ..divergence import audit_divergence
from ..mixing import mix_sources, word_count
from ..negatives import mine_negatives
from .registry import query

NEGATIVES_SQL = """
WITH vectors AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM vectors a JOIN vectors b ON len(a.v) = len(b.v) AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN pairs USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""


@query("op11_hard_negatives", NEGATIVES_SQL)
def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_negatives(read(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


DIVERGENCE_SQL = r"""
WITH texts AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
uses AS (
  SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM texts),
kept AS (
  SELECT lang, term, count(*) AS total FROM uses GROUP BY lang, term HAVING count(DISTINCT row) >= 3),
counts AS (
  SELECT lang, source, term, count(*) AS n FROM uses SEMI JOIN kept USING (lang, term) GROUP BY ALL),
of_lang AS (SELECT lang, count(*) AS terms, sum(total) AS lang_total FROM kept GROUP BY lang),
groups AS (
  SELECT g.lang, g.source, coalesce(l.terms, 0) AS terms, coalesce(l.lang_total, 0) AS lang_total, coalesce(c.group_total, 0) AS group_total
  FROM (SELECT DISTINCT lang, source FROM texts) g LEFT JOIN of_lang l USING (lang)
  LEFT JOIN (SELECT lang, source, sum(n) AS group_total FROM counts GROUP BY ALL) c USING (lang, source)),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 1) // CAST(g.group_total + g.terms AS HUGEINT) AS p,
         1 + CAST(1000000000 AS HUGEINT) * (k.total + 1) // CAST(g.lang_total + g.terms AS HUGEINT) AS q
  FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c USING (lang, source, term)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every_pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(p.value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source),
terms AS (
  SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // q AS BIGINT) AS value FROM shares WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
  FROM (SELECT * FROM every_pair UNION ALL SELECT * FROM terms))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200
"""


@query("op12_source_divergence", DIVERGENCE_SQL)
def op12_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return audit_divergence(read(spark, folder, "documents"))


MIXING_SQL = r"""
WITH marked AS (SELECT doc_id, avg(quality) AS quality FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
sized AS (
  SELECT d.doc_id, d.source, len(regexp_extract_all(coalesce(d.text, ''), '[^\x20\x09-\x0D]+')) AS size,
         CASE WHEN m.quality IS NULL THEN 1.0 ELSE 0.5 + 1.5 * m.quality END AS quality
  FROM documents d LEFT JOIN marked m USING (doc_id)),
keyed AS (
  SELECT *, -ln((CAST('0x' || substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || size), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0) / quality AS at
  FROM sized),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
  FROM sized GROUP BY source),
filled AS (
  SELECT *, coalesce(sum(2 * source_size) OVER before, 0) AS capped, coalesce(sum(weight) OVER before, 0) AS used,
         sum(source_size) OVER () AS total, sum(weight) OVER () AS every
  FROM sources
  WINDOW before AS (ORDER BY 2.0 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (
  SELECT 3 * total - 2 * capped AS top, 2 * (every - used) AS bottom FROM filled
  WHERE 2 * source_size * 2 * (every - used) > weight * (3 * total - 2 * capped)
  ORDER BY 2.0 * source_size / weight, source NULLS LAST LIMIT 1),
aimed AS (
  SELECT s.source, s.source_size,
         CASE WHEN l.top IS NULL OR 2 * s.source_size * l.bottom <= s.weight * l.top THEN CAST(2 * s.source_size AS DOUBLE)
              ELSE CAST(s.weight * l.top AS DOUBLE) / CAST(l.bottom AS DOUBLE) END AS target
  FROM sources s LEFT JOIN levels l ON true),
ordered AS (
  SELECT k.doc_id, k.source, k.size, a.source_size, a.target, CAST(floor(a.target + 0.5) AS BIGINT) AS budget,
         CAST(coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.at, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM keyed k JOIN aimed a ON k.source IS NOT DISTINCT FROM a.source)
SELECT doc_id, source, size, source_size, target,
       CAST(size * (budget // greatest(source_size, 1))
            + greatest(0, least(size, budget % greatest(source_size, 1) - start)) AS BIGINT) AS taken
FROM ordered
"""


@query("op13_source_mixing", MIXING_SQL)
def op13_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Documents marked as good are four times as likely to come first as those marked as bad."""
    marked = read(spark, folder, "labels").where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.avg("quality").alias("quality"))
    # Counted before the join, which texts do not go through.
    docs = read(spark, folder, "documents").select("doc_id", "source", word_count(F.col("text")).alias("words"))
    quality = F.when(F.col("quality").isNull(), F.lit(1.0)).otherwise(0.5 + 1.5 * F.col("quality"))
    return mix_sources(docs.join(marked, "doc_id", "left"), size="words", quality=quality)
