"""The operators with production parameters, over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxframe.llm import (
    decontamination, divergence, language_model, mixing, negatives, passages, quality, secrets, sharding, simhash, toxicity,
    vectors, warc,
)
from voxframe.llm.common import table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near equal bytes."""
    return sharding.digest(table(spark, sf_dir, "documents"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets in all documents."""
    return secrets.digest(table(spark, sf_dir, "documents"))


def op3_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passages of all documents that another document repeats."""
    return passages.find_passages(table(spark, sf_dir, "documents"))


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and classes of all embeddings."""
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the words the mix takes of them."""
    return mixing.digest(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents, learned from the labels that are not held out."""
    return quality.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of a benchmark item in all documents."""
    return decontamination.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, fingerprint, component_id) of all documents."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    shown = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return found.select("doc_id", shown.alias("fingerprint"), "component_id")


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of those that are not held out."""
    return language_model.digest(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents."""
    return toxicity.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, written to archives and read back."""
    return warc.digest(table(spark, sf_dir, "pages"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of the sources of all documents, and their typical terms."""
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives for the positives of every anchor among all embeddings."""
    return negatives.mine(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_secrets": op2_secrets,
    "op3_passages": op3_passages,
    "op4_embeddings": op4_embeddings,
    "op5_mixing": op5_mixing,
    "op6_quality": op6_quality,
    "op7_decontamination": op7_decontamination,
    "op8_simhash": op8_simhash,
    "op9_language_model": op9_language_model,
    "op10_toxicity": op10_toxicity,
    "op11_warc": op11_warc,
    "op12_divergence": op12_divergence,
    "op13_negatives": op13_negatives,
}

MIXING_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    md5(concat_ws('-', '17', doc_id::VARCHAR, md5(text))) AS key
  FROM documents),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT source, source_size, source_size * 2.0::DOUBLE AS cap,
    [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w
  FROM sums),
levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
      - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
targets AS (SELECT source, source_size, least(cap, max(level) OVER () * w) AS target FROM levels),
run AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
    sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key ROWS UNBOUNDED PRECEDING)::BIGINT AS upto
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
timed AS (
  SELECT *, CASE WHEN target > 0 THEN upto::DOUBLE / target END AS first,
    CASE WHEN target > 0 THEN (upto + source_size)::DOUBLE / target END AS second
  FROM run),
times AS (
  SELECT t, sum(size) AS size
  FROM (SELECT first AS t, size FROM timed UNION ALL SELECT second, size FROM timed) WHERE t IS NOT NULL AND size > 0 GROUP BY t),
last AS (
  SELECT max(t) AS t FROM (SELECT t, sum(size) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING) AS upto FROM times)
  WHERE upto <= 1.5 * (SELECT sum(size) FROM sized))
SELECT doc_id, size, source_size, target,
  (size * copies)::BIGINT AS taken, copies
FROM (SELECT d.*, (coalesce((d.first <= l.t)::INT, 0) + coalesce((d.second <= l.t)::INT, 0)) * (size > 0)::INT AS copies
      FROM timed d, last l)
"""

EMBEDDINGS_SQL = """
WITH RECURSIVE good AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND list_sum(list_transform(embedding, lambda x: x * x)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reach AS (
  SELECT vec_id, vec_id AS other FROM embeddings
  UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON r.other = l.a)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links, m.component_id, m.component_id = e.vec_id AS kept
FROM embeddings e JOIN (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id) m USING (vec_id)
"""

WARC_SQL = """
SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha256(body) AS payload_digest,
  CASE WHEN strlen(body) >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN strlen(body) >= 100 AND page_id > first THEN first END AS refers_to
FROM (SELECT page_id, body, min(page_id) OVER (PARTITION BY body) AS first
      FROM (SELECT page_id, coalesce(html, '') AS body FROM pages))
"""

DIVERGENCE_SQL = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS rid,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT lang, source, rid, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
vocab AS (SELECT lang, term, count(*) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT rid) >= 10),
langs AS (SELECT lang, count(*) AS v, sum(total) AS n FROM vocab GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
counts AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY lang, source, term),
cells AS (
  SELECT lang, g.source, term, coalesce(c.n, 0) AS n, v.total
  FROM groups g JOIN vocab v USING (lang) LEFT JOIN counts c USING (lang, source, term)),
sums AS (SELECT lang, source, sum(n) AS here FROM cells GROUP BY lang, source),
shares AS (
  SELECT lang, source, term, c.n,
    1 + (1000000000 * (c.n::HUGEINT + 2)) // (here + 2 * v) AS p, 1 + (1000000000 * (total::HUGEINT + 2)) // (l.n + 2 * v) AS q
  FROM cells c JOIN sums USING (lang, source) JOIN langs l USING (lang)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT FROM shares WHERE n > 0 AND p > q)
SELECT * FROM (
  SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM parts)
WHERE part = 'pair' OR rank <= 10
"""

NEGATIVES_SQL = """
WITH good AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM good a JOIN good b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
positives AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM scored WHERE same)
  WHERE place <= 5),
ranked AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
    (row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id))::INTEGER AS rank
  FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
    AND n.score * 100 BETWEEN 50 * p.score AND 95 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 3
"""

ORACLES: dict[str, str] = {
    "op4_embeddings": EMBEDDINGS_SQL,
    "op5_mixing": MIXING_SQL,
    "op11_warc": WARC_SQL,
    "op12_divergence": DIVERGENCE_SQL,
    "op13_negatives": NEGATIVES_SQL,
}
