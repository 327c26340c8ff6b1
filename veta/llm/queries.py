"""The operators of this package as queries; each returns the columns its contract names.

Whole tables, production parameters. The mix, the archives and the hard negatives can be said in
SQL: the others rest on hashes, encoders, alignments or trained models that SQL does not have.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veta.llm import (
    conversation_repair, fingerprints, hard_negatives, html_extract, lm, mixing, packing, quality_rules, simhash_dedup, substring_dedup,
    suffix_dedup, token_counts, warc,
)
from veta.llm.text import store, table

NEAR_BITS = 11  # what a few changed words of a text move, see README
SEARCH_EVERY = 50


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also n_near: for ids divisible by 50, the documents within NEAR_BITS bits by the block tables."""
    found = store(fingerprints.edited_fingerprints(table(spark, sf_dir, "documents")))
    asked = found.filter(F.col("doc_id") % SEARCH_EVERY == 0)
    near = fingerprints.near_counts(found, asked, NEAR_BITS)
    searched = F.when(F.col("doc_id") % SEARCH_EVERY == 0, F.struct("fp", "fp2"))
    near = near.select(F.struct("fp", "fp2").alias("_asked"), "n_near")
    return found.withColumn("_s", searched).join(near, F.col("_s") == F.col("_asked"), "left").select(
        "doc_id", "n_chars", "edited_sha256", fingerprints.hex32(F.col("fp"), F.col("fp2")).alias("fingerprint"),
        fingerprints.hex32(F.col("efp"), F.col("efp2")).alias("edited_fingerprint"), "near_edited", "near_next", "n_near",
    )


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *quality_rules.BASE_COLUMNS, "base_failed", "kept")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.suffix_sums(token_counts.length_histogram(table(spark, sf_dir, "documents")))


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.as_contract(simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, max_bits=2))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scores(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents")).drop("copies", "draws")


OP6_SQL = """
WITH RECURSIVE sized AS (
  SELECT doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) AS size,
    ('0x' || substr(md5(concat_ws('|', 'mix-1', doc_id)), 1, 13))::BIGINT AS h
  FROM documents
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n,
    ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w, row_number() OVER (ORDER BY source NULLS LAST) AS r
  FROM sized GROUP BY source
), levels AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(source_size * 3.0::DOUBLE) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS l
  FROM totals WINDOW o AS (ORDER BY source_size * 3.0::DOUBLE / w, r)
), goals AS (
  SELECT source, source_size, n, least(source_size * 3.0::DOUBLE, max(l) OVER () * w) AS target FROM levels
), passes AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS p,
    least(greatest(floor(log2(n / 128.0::DOUBLE)), 0), 20)::INT AS bits
  FROM goals
), placed AS (
  SELECT s.doc_id, s.size, s.h, g.source, g.source_size, g.target, g.p, target - p * source_size AS over, s.h >> (52 - bits) AS cell
  FROM sized s JOIN passes g ON s.source IS NOT DISTINCT FROM g.source
), cells AS (
  SELECT source, cell, any_value(over) AS over, sum(size) AS words, sum(sum(size)) OVER (PARTITION BY source ORDER BY cell) AS upto
  FROM placed GROUP BY source, cell
), stops AS (
  SELECT source, cell, over - upto + words AS room FROM cells WHERE over > 0 AND upto > over AND upto - words <= over
), queue AS (
  SELECT p.source, p.doc_id, p.size, s.room, row_number() OVER (PARTITION BY p.source ORDER BY p.size DESC, p.h, p.doc_id) AS i
  FROM placed p JOIN stops s ON p.source IS NOT DISTINCT FROM s.source AND p.cell = s.cell
), taking AS (
  SELECT source, doc_id, i, (size > 0 AND size <= room) AS took, CASE WHEN size > 0 AND size <= room THEN room - size ELSE room END AS room
  FROM queue WHERE i = 1
  UNION ALL
  SELECT q.source, q.doc_id, q.i, (q.size > 0 AND q.size <= t.room), CASE WHEN q.size > 0 AND q.size <= t.room THEN t.room - q.size ELSE t.room END
  FROM taking t JOIN queue q ON q.source IS NOT DISTINCT FROM t.source AND q.i = t.i + 1
)
SELECT p.doc_id, p.size, p.source_size, p.target,
  (p.size * (p.p + CASE WHEN p.cell < coalesce(s.cell, -1) THEN 1 WHEN t.took THEN 1 ELSE 0 END))::BIGINT AS taken
FROM placed p LEFT JOIN stops s ON p.source IS NOT DISTINCT FROM s.source
  LEFT JOIN taking t ON p.source IS NOT DISTINCT FROM t.source AND p.doc_id = t.doc_id
"""


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.duplicate_bytes(table(spark, sf_dir, "documents"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.duplicate_words(table(spark, sf_dir, "documents")).drop("kept")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    crawled = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.resolved(warc.deduplicate(crawled)).drop("url")


OP11_SQL = """
WITH payloads AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), firsts AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM payloads
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM firsts
"""


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"))


OP12_SQL = """
WITH vectors AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256.0::DOUBLE * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id, (row_number() OVER w)::INT AS rank, n.vec_id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN scores n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * p.positive_score <= 100 * n.score AND n.score <= p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id)
QUALIFY row_number() OVER w <= 5
"""


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repaired(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_fingerprints, op2_quality_rules, op3_token_counts, op4_simhash_dedup, op5_lm_scoring, op6_mixing, op7_suffix_dedup,
        op8_html_extraction, op9_substring_dedup, op10_packing, op11_warc, op12_hard_negatives, op13_conversation_repair,
    )
}
ORACLES: dict[str, str] = {"op6_mixing": OP6_SQL, "op11_warc": OP11_SQL, "op12_hard_negatives": OP12_SQL}
