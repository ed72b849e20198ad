"""Signal clusters: disease, place and UTC day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from epilens.functions.numeric import ladder, ratio2
from epilens.functions.text import slug, strip
from epilens.registry import query
from epilens.sources.adapter import Tables, r2, sql


def cluster_rows(t: Tables, signals: DataFrame) -> DataFrame:
    """signals with cluster_key; the place is the first link's (primary first, newest), else the raw text.

    One link is chosen before anything is grouped, so a signal with two primary links counts once. The key's parts are made
    below the join, the places' once for each place: above it they and the join are too much code for one compiled method.
    """
    place = t.location.select(F.col("id").alias("location_id"), F.struct(F.col("name").alias("place"), slug(F.coalesce("name", F.lit("")), "unknown-location").alias("slug")).alias("_at"))
    first = t.link.join(place, "location_id").groupBy(F.col("signal_id").alias("id")).agg(F.min_by("_at", F.struct(~F.col("is_primary"), -F.unix_micros(F.col("created_at").cast("timestamp")), "slot")).alias("_at"))
    x = signals.withColumns({"_disease": slug(F.coalesce("disease_tag", F.lit("")), "unknown-disease"), "_raw": slug(F.coalesce("raw_location_text", F.lit("")), "unknown-location")})
    x = x.join(first, "id", "left").withColumn("place", F.expr("coalesce(_at.place, nullif(raw_location_text, ''))"))
    day = F.coalesce(F.date_format("published_at", "yyyy-MM-dd"), F.lit("unknown_date"))
    key = F.concat_ws("|", "_disease", F.when(F.col("_at.place").isNull(), F.col("_raw")).otherwise(F.col("_at.slug")), day)
    return x.withColumn("cluster_key", key).withColumn("day_utc", F.to_date("published_at")).drop("_at", "_disease", "_raw")


def clusters(rows: DataFrame) -> DataFrame:
    """One row per key: counts of all members, scores of those that are not noise, the priority."""
    n = lambda c, a: F.expr(f"count_if({c})").alias(a)
    g = rows.groupBy("cluster_key").agg(
        F.count("*").alias("signal_count"),
        n("status = 'raw'", "raw_count"),
        n("status = 'validated'", "validated_count"),
        n("status in ('validated', 'approved')", "verified_count"),
        n("status = 'noise'", "noise_count"),
        F.expr("sum(threat_score) filter (where status <> 'noise')").alias("s"),
        F.expr("sum(confidence_score) filter (where status <> 'noise')").alias("cs"),
        F.expr("coalesce(max(threat_score) filter (where status <> 'noise'), 0)").alias("max_score"),
        F.min("day_utc").alias("date_start"),
        F.max("day_utc").alias("date_end"),
    )
    g = g.withColumn("k", F.expr("signal_count - noise_count"))
    # Thresholds compare sums, never rounded means.
    priority = ladder(
        ("signal_count >= 3 and max_score >= 75 and coalesce(cs, 0) >= 70 * k and k > 0", "urgent"),
        ("signal_count >= 2 and max_score >= 60 and coalesce(cs, 0) >= 55 * k and k > 0", "high"),
        ("k > 0 and (s >= 40 * k or cs >= 50 * k)", "medium"),
        default="low",
    )
    return g.withColumns({"avg_score": ratio2("coalesce(s, 0)", "k"), "avg_confidence": ratio2("coalesce(cs, 0)", "k"), "priority": priority}).drop("s", "cs", "k")


_KEY = """
, fl AS (SELECT signal_id, first(name ORDER BY is_primary DESC, link.created_at DESC, slot) AS place FROM link JOIN location ON location.id = location_id GROUP BY 1),
ck AS (SELECT s.*, CAST(published_at AS DATE) AS day_utc, coalesce(nullif(lower(disease_tag), ''), 'unknown-disease') || '|' || coalesce(nullif(trim(regexp_replace(lower(coalesce(place, nullif(raw_location_text, ''), '')), '[ -]+', '-', 'g'), '-'), ''), 'unknown-location') || '|' || strftime(published_at, '%Y-%m-%d') AS cluster_key FROM signal s LEFT JOIN fl ON signal_id = s.id),
cl AS (SELECT cluster_key, count(*) AS signal_count, count(*) FILTER (WHERE status = 'raw') AS raw_count, count(*) FILTER (WHERE status = 'validated') AS validated_count, count(*) FILTER (WHERE status IN ('validated', 'approved')) AS verified_count, count(*) FILTER (WHERE status = 'noise') AS noise_count,
  coalesce(max(threat_score) FILTER (WHERE status <> 'noise'), 0) AS max_score, min(day_utc) AS date_start, max(day_utc) AS date_end,
  """ + r2("coalesce(sum(threat_score) FILTER (WHERE status <> 'noise'), 0)", "count(*) FILTER (WHERE status <> 'noise')") + " AS avg_score, " + r2("coalesce(sum(confidence_score) FILTER (WHERE status <> 'noise'), 0)", "count(*) FILTER (WHERE status <> 'noise')") + """ AS avg_confidence,
  coalesce(avg(threat_score) FILTER (WHERE status <> 'noise'), 0) AS a, coalesce(avg(confidence_score) FILTER (WHERE status <> 'noise'), 0) AS c FROM ck GROUP BY 1),
clp AS (SELECT * EXCLUDE (a, c), CASE WHEN signal_count >= 3 AND max_score >= 75 AND c >= 70 THEN 'urgent' WHEN signal_count >= 2 AND max_score >= 60 AND c >= 55 THEN 'high' WHEN a >= 40 OR c >= 50 THEN 'medium' ELSE 'low' END AS priority FROM cl)
"""


@query(sql(_KEY + "SELECT * FROM clp"))
def cluster_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return clusters(cluster_rows(t, t.signal))


@query(sql(_KEY + "SELECT priority, count(*) AS clusters, CAST(sum(signal_count) AS BIGINT) AS signals, max(max_score) AS top_score FROM clp GROUP BY 1"))
def cluster_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return clusters(cluster_rows(t, t.signal)).groupBy("priority").agg(F.count("*").alias("clusters"), F.sum("signal_count").alias("signals"), F.max("max_score").alias("top_score"))


@query(sql(_KEY + "SELECT cluster_key, priority, signal_count, max_score, avg_score FROM clp WHERE priority IN ('urgent', 'high') ORDER BY CASE priority WHEN 'urgent' THEN 0 ELSE 1 END, max_score DESC, signal_count DESC, cluster_key LIMIT 50"))
def cluster_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of fifty."""
    t = Tables(spark, sf_dir)
    g = clusters(cluster_rows(t, t.signal)).where("priority in ('urgent', 'high')")
    return g.orderBy(F.expr("if(priority = 'urgent', 0, 1)"), F.desc("max_score"), F.desc("signal_count"), "cluster_key").limit(50).select("cluster_key", "priority", "signal_count", "max_score", "avg_score")


@query(sql(_KEY + ", x AS (SELECT cluster_key, id, assessment_summary, raw_location_text, row_number() OVER (PARTITION BY cluster_key ORDER BY threat_score DESC, published_at DESC, id) AS k, count(*) OVER (PARTITION BY cluster_key) AS n FROM ck WHERE status <> 'noise') SELECT cluster_key, max(n) AS members, count(*) FILTER (WHERE assessment_summary <> '') AS assessed, CASE WHEN count(*) FILTER (WHERE assessment_summary <> '') = 0 THEN 'empty' WHEN count(*) FILTER (WHERE assessment_summary <> '') = max(n) THEN 'complete' ELSE 'partial' END AS quality, array_to_string(list_slice(list(assessment_summary ORDER BY k) FILTER (WHERE assessment_summary <> ''), 1, 3), '; ') AS what, (SELECT string_agg(p, '; ' ORDER BY o) FROM (SELECT raw_location_text AS p, min(k) AS o FROM x y WHERE y.cluster_key = x.cluster_key AND raw_location_text <> '' GROUP BY 1 ORDER BY o LIMIT 3)) AS places FROM x GROUP BY cluster_key"))
def cluster_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What and where of each cluster: the best members' summaries and distinct places, in order of score."""
    t = Tables(spark, sf_dir)
    x = cluster_rows(t, t.signal).where("status <> 'noise'")
    order = F.struct((-F.col("threat_score")).alias("a"), (-F.unix_micros(F.col("published_at").cast("timestamp"))).alias("b"), "id")
    x = x.select("cluster_key", order.alias("o"), F.col("assessment_summary").alias("w"), strip(F.col("raw_location_text")).alias("p"))
    g = x.groupBy("cluster_key").agg(F.count("*").alias("members"), F.count_if(F.col("w") != "").alias("assessed"))
    spelt = x.where("p <> ''").groupBy("cluster_key", F.lower("p").alias("folded")).agg(F.min_by("p", "o").alias("p"), F.min("o").alias("o"))
    g = g.join(_first_three(x.where("w <> ''"), "w", "what"), "cluster_key", "left").join(_first_three(spelt, "p", "places"), "cluster_key", "left")
    quality = ladder(("assessed = 0", "empty"), ("assessed = members", "complete"), default="partial")
    return g.select("cluster_key", "members", "assessed", quality.alias("quality"), "what", "places")


def _first_three(rows: DataFrame, value: str, name: str) -> DataFrame:
    """The first three values of each key, joined. Parts of a key are cut to three first, so that no task meets all of its rows."""
    for part in (F.pmod(F.xxhash64("o"), F.lit(64)), F.lit(0)):
        rows = rows.withColumn("part", part)
        rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("cluster_key", "part").orderBy("o"))).where("k <= 3")
    first = F.array_sort(F.collect_list(F.struct("k", value)))
    return rows.groupBy("cluster_key").agg(F.array_join(F.transform(first, lambda r: r[value]), "; ").alias(name))
