"""Dashboard, report recaps and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from epilens.functions.numeric import ratio2, risk_class
from epilens.plans.trend import STATUSES, in_days
from epilens.registry import query
from epilens.sources.adapter import AS_OF, LOCAL, Tables, r2, sql

#: Geocode statuses that count as placed in reports. Fixed values.
PLACED = ["OK", "ok", "matched", "manual", "gazetteer_only", "MANUAL"]
#: Days of the period presets.
PERIODS = {"daily": 1, "weekly": 7, "monthly": 30}


def scope(t: Tables, signals: DataFrame, disease: str = "", province_id: int | None = None, place_id: int | None = None) -> DataFrame:
    """Signals of a disease (any case), of a province with the places in it, or of one place; blank filters nothing."""
    if disease:
        signals = signals.where(F.lower("disease_tag") == disease.lower())
    if province_id is not None:
        inside = t.primary.where((F.col("location_id") == province_id) | (F.col("parent_id") == province_id))
        signals = signals.join(inside.select(F.col("signal_id").alias("id")), "id", "left_semi")
    if place_id is not None:
        signals = signals.join(t.primary.where(F.col("location_id") == place_id).select(F.col("signal_id").alias("id")), "id", "left_semi")
    return signals


def period(t: Tables, preset: str = "weekly", status: str = "operational") -> DataFrame:
    return in_days(t.signal.where(F.col("status").isin(STATUSES[status])), AS_OF, PERIODS[preset])


_WEEK = ", w AS (SELECT * FROM signal WHERE status IN ('raw', 'validated', 'approved') AND CAST(published_at + INTERVAL 7 HOUR AS DATE) BETWEEN DATE '2024-01-25' AND DATE '2024-01-31')"
_RISK = "CASE WHEN high_risk_total >= 3 OR avg_score >= 70 THEN 'HIGH' WHEN high_risk_total >= 1 OR avg_score >= 50 THEN 'MEDIUM_HIGH' WHEN avg_score >= 35 OR total >= 3 THEN 'MEDIUM' ELSE 'LOW' END AS risk_label"


@query(sql("SELECT count(*) AS total_all, count(*) FILTER (WHERE published_at >= TIMESTAMP '2024-01-30') AS total_24h, count(*) FILTER (WHERE published_at >= TIMESTAMP '2024-01-24') AS total_week, " + r2("100 * count(*) FILTER (WHERE geocode_status = 'OK')", "count(*)") + " AS geocode_success_rate, " + r2("100 * count(*) FILTER (WHERE threat_score > 50)", "count(*)") + " AS high_risk_rate FROM signal"))
def dashboard_kpi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noise counts too here, and only the upper-case status counts as placed."""
    s = Tables(spark, sf_dir).signal
    now = f"timestamp_ntz'{AS_OF}'"
    g = s.agg(F.count("*").alias("total_all"), F.expr(f"count_if(published_at >= {now} - interval 24 hours)").alias("total_24h"), F.expr(f"count_if(published_at >= {now} - interval 7 days)").alias("total_week"), F.expr("count_if(geocode_status = 'OK')").alias("ok"), F.expr("count_if(threat_score > 50)").alias("high"))
    return g.withColumns({"geocode_success_rate": ratio2("100 * ok", "total_all"), "high_risk_rate": ratio2("100 * high", "total_all")}).drop("ok", "high")


@query(sql("SELECT disease_tag AS disease, count(*) AS total FROM signal WHERE published_at >= TIMESTAMP '2024-01-24' AND disease_tag <> '' GROUP BY 1 ORDER BY total DESC, disease LIMIT 5"))
def dashboard_diseases(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Tables(spark, sf_dir).signal.where(F.expr(f"published_at >= timestamp_ntz'{AS_OF}' - interval 7 days and disease_tag <> ''"))
    return s.groupBy(F.col("disease_tag").alias("disease")).agg(F.count("*").alias("total")).orderBy(F.desc("total"), "disease").limit(5)


@query(sql("SELECT place, count(*) AS total FROM plink JOIN signal ON id = signal_id WHERE published_at >= TIMESTAMP '2024-01-24' GROUP BY 1 ORDER BY total DESC, place LIMIT 5"))
def dashboard_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By link, so a signal with two primary places counts at both."""
    t = Tables(spark, sf_dir)
    recent = t.signal.where(F.expr(f"published_at >= timestamp_ntz'{AS_OF}' - interval 7 days")).select(F.col("id").alias("signal_id"))
    return t.primary.join(recent, "signal_id").groupBy("place").agg(F.count("*").alias("total")).orderBy(F.desc("total"), "place").limit(5)


@query(sql(_WEEK + "SELECT count(*) AS total, count(*) FILTER (WHERE status = 'raw') AS raw, count(*) FILTER (WHERE status = 'validated') AS validated, count(*) FILTER (WHERE status = 'approved') AS approved, count(*) FILTER (WHERE threat_score >= 70) AS high, count(*) FILTER (WHERE threat_score BETWEEN 40 AND 69) AS medium, count(*) FILTER (WHERE threat_score < 40) AS low, " + r2("100 * count(*) FILTER (WHERE threat_score >= 70)", "count(*)") + " AS high_rate, " + r2("100 * count(*) FILTER (WHERE geocode_status NOT IN ('not_found', 'pending'))", "count(*)") + " AS geocode_rate, " + r2("100 * count(*) FILTER (WHERE assessment_summary <> '')", "count(*)") + " AS assessment_rate, " + r2("sum(threat_score)", "count(*)") + " AS avg_score FROM w"))
def report_recap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recap(period(Tables(spark, sf_dir)))


def recap(s: DataFrame) -> DataFrame:
    """All counts of a report in one pass."""
    n = lambda c, a: F.expr(f"count_if({c})").alias(a)
    g = s.agg(F.count("*").alias("total"), n("status = 'raw'", "raw"), n("status = 'validated'", "validated"), n("status = 'approved'", "approved"), n("threat_score >= 70", "high"), n("threat_score >= 40 and threat_score < 70", "medium"), n("threat_score < 40", "low"), F.count_if(F.col("geocode_status").isin(PLACED)).alias("ok"), n("assessment_summary <> ''", "ready"), F.sum("threat_score").alias("s"))
    return g.withColumns({"high_rate": ratio2("100 * high", "total"), "geocode_rate": ratio2("100 * ok", "total"), "assessment_rate": ratio2("100 * ready", "total"), "avg_score": ratio2("s", "total")}).drop("ok", "ready", "s")


@query(sql(_WEEK + ", c AS (SELECT * FROM w WHERE id IN (SELECT signal_id FROM plink WHERE location_id = 1002 OR parent_id = 1002)) SELECT count(*) AS total, count(*) FILTER (WHERE status = 'raw') AS raw, count(*) FILTER (WHERE status = 'validated') AS validated, count(*) FILTER (WHERE status = 'approved') AS approved, count(*) FILTER (WHERE threat_score >= 70) AS high, count(*) FILTER (WHERE threat_score BETWEEN 40 AND 69) AS medium, count(*) FILTER (WHERE threat_score < 40) AS low, " + r2("100 * count(*) FILTER (WHERE threat_score >= 70)", "count(*)") + " AS high_rate, " + r2("100 * count(*) FILTER (WHERE geocode_status NOT IN ('not_found', 'pending'))", "count(*)") + " AS geocode_rate, " + r2("100 * count(*) FILTER (WHERE assessment_summary <> '')", "count(*)") + " AS assessment_rate, " + r2("sum(threat_score)", "count(*)") + " AS avg_score FROM c"))
def report_scope_province(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recap of one province, its cities included, each signal once."""
    t = Tables(spark, sf_dir)
    return recap(scope(t, period(t), province_id=1002))


@query(sql(_WEEK + ", g AS (SELECT disease_tag AS disease, count(*) AS total, count(*) FILTER (WHERE threat_score >= 70) AS high_risk_total, " + r2("sum(threat_score)", "count(*)") + " AS avg_score FROM w WHERE disease_tag <> '' GROUP BY 1) SELECT *, " + _RISK + " FROM g"))
def recap_disease(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = period(Tables(spark, sf_dir)).where("disease_tag <> ''")
    g = s.groupBy(F.col("disease_tag").alias("disease")).agg(F.count("*").alias("total"), F.expr("count_if(threat_score >= 70)").alias("high_risk_total"), F.sum("threat_score").alias("s"))
    return g.withColumn("avg_score", ratio2("s", "total")).withColumn("risk_label", risk_class("high_risk_total", "avg_score", "total")).drop("s")


def _linked(t: Tables, links: DataFrame, s: DataFrame) -> DataFrame:
    return links.join(s.drop("created_at", "user_id"), F.col("signal_id") == F.col("id"))


@query(sql(_WEEK + ", g AS (SELECT province, count(*) AS total, count(*) FILTER (WHERE threat_score >= 70) AS high_risk_total, " + r2("sum(threat_score)", "count(*)") + " AS avg_score FROM prov JOIN w ON id = signal_id GROUP BY 1) SELECT *, " + _RISK + " FROM g"))
def recap_province(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    g = _linked(t, t.promoted, period(t)).groupBy("province").agg(F.count("*").alias("total"), F.expr("count_if(threat_score >= 70)").alias("high_risk_total"), F.sum("threat_score").alias("s"))
    return g.withColumn("avg_score", ratio2("s", "total")).withColumn("risk_label", risk_class("high_risk_total", "avg_score", "total")).drop("s")


@query(sql(_WEEK + ", g AS (SELECT place || '::' || level || '::' || province AS place_key, count(*) AS total, count(*) FILTER (WHERE threat_score >= 70) AS high_risk_total, " + r2("sum(threat_score)", "count(*)") + " AS avg_score FROM prov JOIN w ON id = signal_id GROUP BY 1) SELECT * FROM g ORDER BY total DESC, avg_score DESC, place_key LIMIT 25"))
def recap_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    g = _linked(t, t.promoted, period(t)).groupBy(F.concat_ws("::", "place", "level", "province").alias("place_key")).agg(F.count("*").alias("total"), F.expr("count_if(threat_score >= 70)").alias("high_risk_total"), F.sum("threat_score").alias("s"))
    return g.withColumn("avg_score", ratio2("s", "total")).drop("s").orderBy(F.desc("total"), F.desc("avg_score"), "place_key").limit(25)


@query(sql(_WEEK + "SELECT CAST(published_at + INTERVAL 7 HOUR AS DATE) AS day_local, count(*) AS n, count(*) FILTER (WHERE threat_score >= 70) AS high FROM w GROUP BY 1"))
def report_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = period(Tables(spark, sf_dir))
    return s.groupBy(F.expr(f"to_date(published_at + {LOCAL})").alias("day_local")).agg(F.count("*").alias("n"), F.expr("count_if(threat_score >= 70)").alias("high"))


_MAP = _WEEK + """
, ranked AS (SELECT location_id, place, level, w.id, threat_score, coalesce(nullif(disease_tag, ''), '-') AS disease, published_at FROM plink JOIN w ON w.id = signal_id ORDER BY threat_score DESC, published_at DESC, w.id, slot LIMIT 3000),
g AS (SELECT location_id, place, level, count(*) AS total, count(*) FILTER (WHERE threat_score >= 70) AS high_risk_total, """ + r2("sum(threat_score)", "count(*)") + """ AS avg_score,
  string_agg(CAST(id AS VARCHAR), ',' ORDER BY threat_score DESC, published_at DESC, id) AS all_ids FROM ranked GROUP BY ALL),
dd AS (SELECT location_id, disease, row_number() OVER (PARTITION BY location_id ORDER BY count(*) DESC, disease) AS k FROM ranked GROUP BY 1, 2)
SELECT g.location_id, place, level, total, high_risk_total, avg_score, dd.disease AS dominant_disease, array_to_string(list_slice(string_split(all_ids, ','), 1, 3), ',') AS samples
FROM g JOIN dd ON dd.location_id = g.location_id AND k = 1 ORDER BY total DESC, avg_score DESC, g.location_id LIMIT 500
"""


@query(sql(_MAP))
def report_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of the 3000 highest links: dominant disease and three samples each."""
    t = Tables(spark, sf_dir)
    top = _linked(t, t.primary, period(t)).orderBy(F.desc("threat_score"), F.desc("published_at"), "id", "slot").limit(3000)
    return points(top).orderBy(F.desc("total"), F.desc("avg_score"), "location_id").limit(500)


def points(links: DataFrame, samples: int = 3) -> DataFrame:
    top = links.withColumn("disease", F.expr("coalesce(nullif(disease_tag, ''), '-')"))
    keys = ["location_id", "place", "level"]
    modes = top.groupBy(*keys, "disease").agg(F.count("*").alias("k")).groupBy(*keys).agg(F.min_by("disease", F.struct(-F.col("k"), "disease")).alias("dominant_disease"))
    best = top.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("threat_score"), F.desc("published_at"), "id", "slot")))
    picked = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("rn") <= samples, F.struct("rn", "id")))), lambda x: x["id"].cast("string")), ",")
    g = best.groupBy(*keys).agg(F.count("*").alias("total"), F.expr("count_if(threat_score >= 70)").alias("high_risk_total"), F.sum("threat_score").alias("s"), picked.alias("samples"))
    return g.join(modes, keys).withColumn("avg_score", ratio2("s", "total")).drop("s")


@query(sql(_WEEK + "SELECT id, disease_tag, threat_score, status, published_at FROM w WHERE threat_score >= 50 ORDER BY threat_score DESC, published_at DESC, id LIMIT 15"))
def report_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = period(Tables(spark, sf_dir)).where("threat_score >= 50")
    return s.orderBy(F.desc("threat_score"), F.desc("published_at"), "id").limit(15).select("id", "disease_tag", "threat_score", "status", "published_at")


@query(sql(_WEEK + "SELECT id, coalesce(disease_tag, '') AS disease, threat_score, status, geocode_status, strftime(published_at, '%Y-%m-%dT%H:%M:%S') AS published_iso, source_url, raw_location_text FROM w WHERE status IN ('validated', 'approved')"))
def export_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the CSV export: ISO times, nulls as empty text. Order is left to the writer."""
    s = period(Tables(spark, sf_dir)).where("status in ('validated', 'approved')")
    return s.select("id", F.coalesce("disease_tag", F.lit("")).alias("disease"), "threat_score", "status", "geocode_status", F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss").alias("published_iso"), "source_url", "raw_location_text")


@query(sql("SELECT status, geocode_status, count(*) AS n, count(*) FILTER (WHERE is_high_risk) AS high FROM signal GROUP BY ALL"))
def status_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).signal.groupBy("status", "geocode_status").agg(F.count("*").alias("n"), F.count_if("is_high_risk").alias("high"))


@query(sql(_WEEK + ", g AS (SELECT disease_tag AS disease, count(*) AS total, count(*) FILTER (WHERE threat_score >= 70) AS high FROM w WHERE disease_tag <> '' GROUP BY 1 ORDER BY total DESC, disease LIMIT 6), p AS (SELECT disease_tag AS disease, place, count(*) AS n, row_number() OVER (PARTITION BY disease_tag ORDER BY count(*) DESC, place) AS k FROM plink JOIN w ON id = signal_id GROUP BY 1, 2) SELECT g.disease, total, high, (SELECT string_agg(place, ', ' ORDER BY k) FROM p WHERE p.disease = g.disease AND k <= 5) AS top_places FROM g"))
def disease_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six most frequent diseases of the period, each with its five most frequent places."""
    t = Tables(spark, sf_dir)
    s = period(t).where("disease_tag <> ''")
    top = s.groupBy(F.col("disease_tag").alias("disease")).agg(F.count("*").alias("total"), F.expr("count_if(threat_score >= 70)").alias("high")).orderBy(F.desc("total"), "disease").limit(6)
    counts = _linked(t, t.primary, s).groupBy(F.col("disease_tag").alias("disease"), "place").agg(F.count("*").alias("n"))
    best = counts.withColumn("k", F.row_number().over(Window.partitionBy("disease").orderBy(F.desc("n"), "place"))).where("k <= 5")
    named = best.groupBy("disease").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "place"))), lambda x: x["place"]), ", ").alias("top_places"))
    return top.join(named, "disease", "left")
