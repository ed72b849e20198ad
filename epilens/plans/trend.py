"""Disease trends: a period against the one before it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epilens.functions.numeric import growth2, ladder, ratio2, risk_class
from epilens.registry import query
from epilens.sources.adapter import AS_OF, LOCAL, Tables, r2, sql

STATUSES = {"approved": ["approved"], "validated": ["validated", "approved"], "raw": ["raw"], "operational": ["raw", "validated", "approved"]}


def in_days(signals: DataFrame, as_of: str, days: int, back: int = 0) -> DataFrame:
    """Signals whose local day is among the days up to as_of, the window moved back by `back` windows.

    The bounds on the raw column let Parquet skip row groups; the derived day decides.
    """
    last = f"date_sub(to_date(timestamp_ntz'{as_of}'), {back * days})"
    raw = F.expr(f"published_at >= cast(date_sub({last}, {days}) as timestamp_ntz) and published_at < cast(date_add({last}, 2) as timestamp_ntz)")
    return signals.where(raw).where(F.expr(f"to_date(published_at + {LOCAL}) between date_sub({last}, {days - 1}) and {last}"))


def disease_trends(signals: DataFrame, as_of: str = AS_OF, days: int = 7, status: str = "operational") -> DataFrame:
    """One row per disease of the period, both periods counted in one pass over the signals."""
    chosen = signals.where(F.col("status").isin(STATUSES.get(status, STATUSES["operational"]))).where("disease_tag <> ''")
    both = in_days(chosen, as_of, 2 * days).withColumn("now", F.expr(f"to_date(published_at + {LOCAL}) > date_sub(to_date(timestamp_ntz'{as_of}'), {days})"))
    g = both.groupBy(F.col("disease_tag").alias("disease")).agg(
        F.expr("count_if(now)").alias("total"),
        F.expr("count_if(not now)").alias("previous_total"),
        F.expr("sum(threat_score) filter (where now)").alias("s"),
        F.expr("count_if(now and threat_score >= 70)").alias("high_risk_total"),
        F.expr("min(published_at) filter (where now)").alias("first_signal_at"),
        F.expr("max(published_at) filter (where now)").alias("last_signal_at"),
    )
    g = g.where("total > 0").withColumn("avg_score", ratio2("s", "total")).withColumn("growth_abs", F.expr("total - previous_total")).withColumn("growth_percent", growth2("total", "previous_total"))
    label = ladder(("previous_total <= 0 and total > 0", "NEW"), ("total > previous_total", "UP"), ("total < previous_total", "DOWN"), default="STABLE")
    return g.withColumn("trend_label", label).withColumn("risk_label", risk_class("high_risk_total", "avg_score", "total")).drop("s")


_COUNTS = """
, d AS (
  SELECT *, CAST(published_at + INTERVAL 7 HOUR AS DATE) AS day FROM signal WHERE status IN ('raw', 'validated', 'approved')
), cur AS (
  SELECT disease_tag AS disease, count(DISTINCT id) AS total, sum(threat_score) AS s, count(DISTINCT id) FILTER (WHERE threat_score >= 70) AS high, min(published_at) AS f, max(published_at) AS l
  FROM d WHERE disease_tag <> '' AND day BETWEEN DATE '2024-01-25' AND DATE '2024-01-31' GROUP BY ALL
), prev AS (
  SELECT disease_tag AS disease, count(DISTINCT id) AS before FROM d WHERE day BETWEEN DATE '2024-01-18' AND DATE '2024-01-24' GROUP BY ALL
), t AS (
  SELECT disease, total, coalesce(before, 0) AS previous_total, total - coalesce(before, 0) AS growth_abs,
    CASE WHEN coalesce(before, 0) = 0 THEN 100.0 ELSE """ + r2("100 * (total - before)", "before") + """ END AS growth_percent,
    CASE WHEN before IS NULL THEN 'NEW' WHEN total > before THEN 'UP' WHEN total < before THEN 'DOWN' ELSE 'STABLE' END AS trend_label,
    """ + r2("s", "total") + """ AS avg_score, high AS high_risk_total,
    f AS first_signal_at, l AS last_signal_at
  FROM cur LEFT JOIN prev USING (disease)
), tr AS (
  SELECT *, CASE WHEN high_risk_total >= 3 OR avg_score >= 70 THEN 'HIGH' WHEN high_risk_total >= 1 OR avg_score >= 50 THEN 'MEDIUM_HIGH' WHEN avg_score >= 35 OR total >= 3 THEN 'MEDIUM' ELSE 'LOW' END AS risk_label FROM t
)
"""


@query(sql(_COUNTS + "SELECT * FROM tr"))
def trend_disease(spark: SparkSession, sf_dir: str) -> DataFrame:
    return disease_trends(Tables(spark, sf_dir).signal)


def _ranked(trends: DataFrame, *order: str, k: int = 10) -> DataFrame:
    """The top k with their rank; ties keep the list's own order (-total, -average, name)."""
    from pyspark.sql import Window

    keys = [F.desc(c) for c in order] + [F.desc("total"), F.desc("avg_score"), F.asc("disease")]
    top = trends.orderBy(*keys).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*keys)).cast("long")).select("rank", "disease", "total", "growth_abs", "growth_percent", "high_risk_total", "avg_score")


@query(sql(_COUNTS + "SELECT row_number() OVER (ORDER BY growth_abs DESC, growth_percent DESC, total DESC, avg_score DESC, disease) AS rank, disease, total, growth_abs, growth_percent, high_risk_total, avg_score FROM tr QUALIFY rank <= 10"))
def trend_rising(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(disease_trends(Tables(spark, sf_dir).signal), "growth_abs", "growth_percent", "total", "avg_score")


@query(sql(_COUNTS + "SELECT row_number() OVER (ORDER BY high_risk_total DESC, avg_score DESC, total DESC, growth_abs DESC, disease) AS rank, disease, total, growth_abs, growth_percent, high_risk_total, avg_score FROM tr QUALIFY rank <= 10"))
def trend_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(disease_trends(Tables(spark, sf_dir).signal), "high_risk_total", "avg_score", "total", "growth_abs")


@query(sql(", d AS (SELECT *, CAST(published_at + INTERVAL 7 HOUR AS DATE) AS day FROM signal WHERE status IN ('raw', 'validated', 'approved') AND disease_tag <> ''), w AS (SELECT * FROM d WHERE day BETWEEN DATE '2024-01-18' AND DATE '2024-01-31'), top AS (SELECT disease_tag FROM w GROUP BY 1 ORDER BY count(*) DESC, disease_tag LIMIT 5), spine AS (SELECT CAST(x AS DATE) AS day FROM range(DATE '2024-01-18', DATE '2024-02-01', INTERVAL 1 DAY) r(x)) SELECT CAST(spine.day AS DATE) AS day_local, top.disease_tag AS disease, (SELECT count(*) FROM w WHERE w.day = spine.day AND w.disease_tag = top.disease_tag) AS n FROM spine, top"))
def trend_daily_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts of the five most frequent diseases, days without signals as 0."""
    days = 14
    s = in_days(Tables(spark, sf_dir).signal.where(F.col("status").isin(STATUSES["operational"])).where("disease_tag <> ''"), AS_OF, days)
    daily = s.groupBy(F.expr(f"to_date(published_at + {LOCAL})").alias("day_local"), F.col("disease_tag").alias("disease")).agg(F.count("*").alias("n"))
    top = daily.groupBy("disease").agg(F.sum("n").alias("t")).orderBy(F.desc("t"), "disease").limit(5).select("disease")
    last = f"to_date(timestamp_ntz'{AS_OF}')"
    spine = top.select("disease", F.explode(F.expr(f"sequence(date_sub({last}, {days - 1}), {last}, interval 1 day)")).alias("day_local"))
    return spine.join(daily, ["day_local", "disease"], "left").select("day_local", "disease", F.coalesce("n", F.lit(0)).alias("n"))


@query(sql(", w AS (SELECT * FROM signal WHERE status IN ('raw', 'validated', 'approved') AND CAST(published_at + INTERVAL 7 HOUR AS DATE) BETWEEN DATE '2024-01-25' AND DATE '2024-01-31'), g AS (SELECT location_id, place, level, count(DISTINCT w.id) AS total, count(DISTINCT w.id) FILTER (WHERE threat_score >= 70) AS high_risk_total, sum(threat_score) AS s, count(*) AS links FROM plink JOIN w ON w.id = signal_id GROUP BY ALL), a AS (SELECT *, " + r2("s", "links") + " AS avg_score FROM g) SELECT location_id, place, level, total, high_risk_total, avg_score, CASE WHEN high_risk_total >= 3 OR avg_score >= 70 THEN 'HIGH' WHEN high_risk_total >= 1 OR avg_score >= 50 THEN 'MEDIUM_HIGH' WHEN avg_score >= 35 OR total >= 3 THEN 'MEDIUM' ELSE 'LOW' END AS risk_label FROM a ORDER BY total DESC, avg_score DESC, location_id LIMIT 15"))
def trend_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    s = in_days(t.signal.where(F.col("status").isin(STATUSES["operational"])), AS_OF, 7).select("id", "threat_score")
    g = t.primary.join(s, F.col("signal_id") == F.col("id")).groupBy("location_id", "place", "level")
    g = g.agg(F.countDistinct("id").alias("total"), F.expr("count(distinct id) filter (where threat_score >= 70)").alias("high_risk_total"), F.sum("threat_score").alias("s"), F.count("*").alias("links"))
    g = g.withColumn("avg_score", ratio2("s", "links")).withColumn("risk_label", risk_class("high_risk_total", "avg_score", "total"))
    return g.drop("s", "links").orderBy(F.desc("total"), F.desc("avg_score"), "location_id").limit(15)


@query(sql("SELECT id, disease_tag, threat_score, triage_priority, published_at FROM signal WHERE status IN ('raw', 'validated', 'approved') AND CAST(published_at + INTERVAL 7 HOUR AS DATE) BETWEEN DATE '2024-01-25' AND DATE '2024-01-31' AND (threat_score >= 70 OR triage_priority IN ('urgent', 'high')) ORDER BY threat_score DESC, published_at DESC, id LIMIT 15"))
def trend_recent_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = in_days(Tables(spark, sf_dir).signal.where(F.col("status").isin(STATUSES["operational"])), AS_OF, 7)
    top = s.where("threat_score >= 70 or triage_priority in ('urgent', 'high')").orderBy(F.desc("threat_score"), F.desc("published_at"), "id").limit(15)
    return top.select("id", "disease_tag", "threat_score", "triage_priority", "published_at")
