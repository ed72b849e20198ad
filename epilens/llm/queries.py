"""The operators with production parameters over their whole tables, and SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epilens.llm.decontam import contaminated, find_contamination
from epilens.llm.exact_dedup import exact_groups
from epilens.llm.lexical import ranked_search
from epilens.llm.licenses import find_licenses, license_digest
from epilens.llm.negatives import hard_negatives
from epilens.llm.ngram_join import ngram_components
from epilens.llm.packing import pack
from epilens.llm.pii import find_pii, pii_digest
from epilens.llm.quality import score_quality
from epilens.llm.sharding import shard
from epilens.llm.sstable import read_tables, write_tables
from epilens.llm.toxicity import score_toxicity, train
from epilens.llm.wrapper import extract_main_text


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard(spark, _table(spark, sf_dir, "documents"), shards=40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(spark, _table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(spark, _table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op5_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, manifest = write_tables(spark, _table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return read_tables(spark, folder, manifest).select("doc_id", "start", "n_tokens", "ids_crc32")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digest(find_pii(spark, _table(spark, sf_dir, "documents")))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(spark, _table(spark, sf_dir, "documents"), width=4, percent=85)


def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, _table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0, capacity=2048)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = find_contamination(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return contaminated(hits).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return score_toxicity(spark, docs, train(spark, docs, _table(spark, sf_dir, "labels")))


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(spark, vectors.withColumn("label", moved), every=50, positives=5, negatives=3, low=50, high=95)


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_digest(find_licenses(spark, _table(spark, sf_dir, "documents")))


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), top=50)


QUERIES = {f.__name__: f for f in (op1_shard, op2_html, op3_quality, op4_exact_dedup, op5_sstable, op6_pii, op7_ngram_join, op8_pack, op9_decontaminate, op10_toxicity, op11_negatives, op12_licenses, op13_search)}

SQL = {
    "op4_exact_dedup": r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
FROM n JOIN g USING (norm)
""",
    "op9_decontaminate": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT item_id, w, least(13, len(w)) AS n FROM b WHERE len(w) > 0))
), dw AS (
  SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)
), hits AS (SELECT doc_id, item_id, i, n FROM dw JOIN bw USING (n, g)),
spots AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS items_sha256 FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN spots USING (doc_id) LEFT JOIN items USING (doc_id)
""",
    "op11_negatives": r"""
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM e a, e b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 3
""",
    "op13_search": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents
), c AS (SELECT count(*) AS n_all, CAST(sum(len(t)) AS BIGINT) AS l_all FROM d WHERE len(t) > 0),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM d) GROUP BY ALL),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n_all) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, c GROUP BY term),
m AS (SELECT doc_id, 50 + (50 * len(t) * n_all) // l_all AS m FROM d, c WHERE len(t) > 0),
s AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM q JOIN tf USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY ALL
)
SELECT item_id, CAST(row_number() OVER w AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0
WINDOW w AS (PARTITION BY item_id ORDER BY score DESC, doc_id)
QUALIFY row_number() OVER w <= 50
""",
}
