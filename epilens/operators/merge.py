"""Upserts and other changes as functions from old and incoming rows to merged rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epilens.functions.numeric import ladder
from epilens.functions.text import truncate
from epilens.registry import query
from epilens.sources.adapter import Tables, sql


def upsert(old: DataFrame, new: DataFrame, key: str, overwrite: list[str], keep: list[str]) -> DataFrame:
    """One row per key: new values over old in `overwrite`, old over new (unless empty) in `keep`; action tells which.

    A natural key that repeats among the incoming rows must be reduced before.
    """
    values = [*overwrite, *keep]
    a = old.select(key, *[F.col(c).alias(f"o_{c}") for c in values], F.lit(True).alias("had"))
    b = new.select(key, *[F.col(c).alias(f"n_{c}") for c in values], F.lit(True).alias("came"))
    both = a.join(b, key, "full")
    action = F.when(F.col("had").isNull(), "created").when(F.col("came").isNull(), "untouched").otherwise("updated")
    return both.select(key, *[F.coalesce(f"n_{c}", f"o_{c}").alias(c) for c in overwrite], *[fill(F.col(f"o_{c}"), F.col(f"n_{c}")).alias(c) for c in keep], action.alias("action"))


def fill(old: Column, new: Column) -> Column:
    """old, or new where old is null or empty."""
    return F.when(old.isNull() | (old.cast("string") == ""), new).otherwise(old)


@query(sql(", o AS (SELECT id, threat_score, status, raw_location_text FROM signal WHERE id % 3 <> 0), n AS (SELECT id, 100 - threat_score AS threat_score, 'raw' AS status, 'incoming ' || id AS raw_location_text FROM signal WHERE id % 2 = 0) SELECT coalesce(o.id, n.id) AS id, coalesce(n.threat_score, o.threat_score) AS threat_score, coalesce(o.status, n.status) AS status, CASE WHEN coalesce(o.raw_location_text, '') = '' THEN n.raw_location_text ELSE o.raw_location_text END AS raw_location_text, CASE WHEN o.id IS NULL THEN 'created' WHEN n.id IS NULL THEN 'untouched' ELSE 'updated' END AS action FROM o FULL JOIN n ON o.id = n.id"))
def merge_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Re-ingest: scores are overwritten, status survives, empty places are filled."""
    s = Tables(spark, sf_dir).signal
    old = s.where("id % 3 <> 0").select("id", "threat_score", "status", "raw_location_text")
    new = s.where("id % 2 = 0").select("id", (100 - F.col("threat_score")).alias("threat_score"), F.lit("raw").alias("status"), F.concat(F.lit("incoming "), "id").alias("raw_location_text"))
    return upsert(old, new, "id", ["threat_score"], ["status", "raw_location_text"])


@query(sql(", m AS (SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'created' WHEN n.id IS NULL THEN 'untouched' ELSE 'updated' END AS action FROM (SELECT id FROM signal WHERE id % 3 <> 0) o FULL JOIN (SELECT id FROM signal WHERE id % 2 = 0) n ON o.id = n.id) SELECT action, count(*) AS n FROM m GROUP BY 1"))
def ingest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_signals(spark, sf_dir).groupBy("action").agg(F.count("*").alias("n"))


@query(sql("SELECT 'stored' AS what, count(*) AS n, CAST(sum(length(content)) AS BIGINT) AS chars_before, CAST(sum(CASE WHEN length(content) > 5000 THEN length(regexp_replace(substr(content, 1, 5000), '[ \t\n\x0B\f\r]+$', '')) + 25 ELSE length(content) END) AS BIGINT) AS chars_after, count(*) FILTER (WHERE length(content) > 5000) AS cut FROM article JOIN signal USING (id) WHERE NOT (status = 'noise' AND published_at < TIMESTAMP '2024-01-11')".replace("\t", "\\t").replace("\n", "\\n").replace("\x0b", "\\x0B").replace("\f", "\\f").replace("\r", "\\r")))
def compact_storage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What compaction stores after old noise went: characters before and after, and how many texts were cut."""
    t = Tables(spark, sf_dir)
    after = F.length(truncate(F.col("content"), 5000, "\n\n[TRUNCATED_FOR_STORAGE]"))
    rows = t.articles(F.length("content").alias("before"), after.alias("after")).join(t.signal.where("not (status = 'noise' and published_at < timestamp_ntz'2024-01-11 00:00:00')").select("id"), "id")
    return rows.agg(F.lit("stored").alias("what"), F.count("*").alias("n"), F.sum("before").alias("chars_before"), F.sum("after").alias("chars_after"), F.count_if(F.col("before") > 5000).alias("cut"))


def transition(action: str) -> Column:
    """The status after validate, noise or approve; approval needs a validated signal, noise spares approved ones."""
    rules = {
        "validate": [("status = 'raw'", "validated")],
        "noise": [("status in ('raw', 'validated')", "noise")],
        "approve": [("status = 'validated'", "approved")],
    }
    return ladder(*rules[action], default=F.col("status"))


@query(sql(", x AS (SELECT id, status, CASE id % 3 WHEN 0 THEN 'validate' WHEN 1 THEN 'noise' ELSE 'approve' END AS action FROM signal), y AS (SELECT *, CASE WHEN action = 'validate' AND status = 'raw' THEN 'validated' WHEN action = 'noise' AND status IN ('raw', 'validated') THEN 'noise' WHEN action = 'approve' AND status = 'validated' THEN 'approved' ELSE status END AS after FROM x) SELECT action, status AS before, after, count(*) AS n, count(*) FILTER (WHERE status <> after) AS changed FROM y GROUP BY ALL"))
def status_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Tables(spark, sf_dir).signal.withColumn("action", F.expr("case id % 3 when 0 then 'validate' when 1 then 'noise' else 'approve' end"))
    after = F.when(F.col("action") == "validate", transition("validate")).when(F.col("action") == "noise", transition("noise")).otherwise(transition("approve"))
    return s.groupBy("action", F.col("status").alias("before"), after.alias("after")).agg(F.count("*").alias("n"), F.count_if(F.col("status") != after).alias("changed"))


@query(sql(", x AS (SELECT id, status, CASE WHEN status = 'raw' THEN 'validated' ELSE status END AS after FROM signal) SELECT id, '{\"status\":\"' || status || '\"}' AS before_data, '{\"status\":\"' || after || '\"}' AS after_data FROM x WHERE status <> after"))
def audit_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Before and after images of the rows that a validation changes."""
    s = Tables(spark, sf_dir).signal.withColumn("after", transition("validate")).where("status <> after")
    return s.select("id", F.to_json(F.struct("status")).alias("before_data"), F.to_json(F.struct(F.col("after").alias("status"))).alias("after_data"))
