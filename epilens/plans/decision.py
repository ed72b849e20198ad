"""Decision support: disease and place groups ranked by priority."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from epilens.functions.numeric import ladder, ratio2, risk_class
from epilens.plans.report import _WEEK, _linked, period
from epilens.registry import query
from epilens.sources.adapter import Tables, r2, sql

#: Days until review and whether a field response is advised, by risk label. Fixed values.
ACTIONS = {"HIGH": ("FIELD_RESPONSE", 1), "MEDIUM_HIGH": ("VERIFY_LOCAL", 2), "MEDIUM": ("MONITOR", 7), "LOW": ("ROUTINE", 14)}

_GROUPS = _WEEK + """
, x AS (SELECT lower(coalesce(nullif(disease_tag, ''), 'UNKNOWN')) AS folded, coalesce(nullif(disease_tag, ''), 'UNKNOWN') AS label, location_id, place, level, id, threat_score, published_at, slot FROM plink JOIN w ON id = signal_id),
g AS (SELECT folded, location_id, place, level, count(*) AS total, count(*) FILTER (WHERE threat_score >= 70) AS high_risk_total, """ + r2("sum(threat_score)", "count(*)") + """ AS avg_score,
  first(label ORDER BY threat_score DESC, published_at DESC, id, slot) AS disease, array_to_string(list_slice(list(CAST(id AS VARCHAR) ORDER BY threat_score DESC, published_at DESC, id, slot), 1, 4), ',') AS samples FROM x GROUP BY folded, location_id, place, level),
p AS (SELECT *, round(2 * total + avg_score + 8 * high_risk_total, 2) AS priority_score,
  CASE WHEN high_risk_total >= 3 OR avg_score >= 70 THEN 'HIGH' WHEN high_risk_total >= 1 OR avg_score >= 55 THEN 'MEDIUM_HIGH' WHEN avg_score >= 35 OR total >= 3 THEN 'MEDIUM' ELSE 'LOW' END AS risk_label FROM g)
"""


def decision_groups(t: Tables, signals: DataFrame) -> DataFrame:
    """(folded disease, place) groups with label, samples, priority and action."""
    x = _linked(t, t.primary, signals).withColumn("label", F.expr("coalesce(nullif(disease_tag, ''), 'UNKNOWN')")).withColumn("folded", F.lower("label"))
    keys = ["folded", "location_id", "place", "level"]
    x = x.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("threat_score"), F.desc("published_at"), "id", "slot")))
    picked = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("rn") <= 4, F.struct("rn", "id")))), lambda r: r["id"].cast("string")), ",")
    g = x.groupBy(*keys).agg(F.count("*").alias("total"), F.expr("count_if(threat_score >= 70)").alias("high_risk_total"), F.sum("threat_score").alias("s"), F.min_by("label", "rn").alias("disease"), picked.alias("samples"))
    g = g.withColumn("avg_score", ratio2("s", "total")).withColumn("priority_score", F.round(2 * F.col("total") + F.col("avg_score") + 8 * F.col("high_risk_total"), 2)).drop("s")
    g = g.withColumn("risk_label", risk_class("high_risk_total", "avg_score", "total", (70, 55, 35)))
    return g.withColumn("action", ladder(*((f"risk_label = '{k}'", a) for k, (a, _) in ACTIONS.items()), default="ROUTINE")).withColumn("review_days", ladder(*((f"risk_label = '{k}'", d) for k, (_, d) in ACTIONS.items()), default=14))


@query(sql(_GROUPS + "SELECT disease, location_id, place, level, total, high_risk_total, avg_score, priority_score, risk_label, samples, CASE risk_label WHEN 'HIGH' THEN 'FIELD_RESPONSE' WHEN 'MEDIUM_HIGH' THEN 'VERIFY_LOCAL' WHEN 'MEDIUM' THEN 'MONITOR' ELSE 'ROUTINE' END AS action, CASE risk_label WHEN 'HIGH' THEN 1 WHEN 'MEDIUM_HIGH' THEN 2 WHEN 'MEDIUM' THEN 7 ELSE 14 END AS review_days FROM p ORDER BY priority_score DESC, total DESC, disease, place, location_id LIMIT 20"))
def decision_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return decision_groups(t, period(t)).orderBy(F.desc("priority_score"), F.desc("total"), "disease", "place", "location_id").limit(20).drop("folded")


@query(sql(_GROUPS + "SELECT risk_label, count(*) AS groups, CAST(sum(total) AS BIGINT) AS links, CAST(sum(high_risk_total) AS BIGINT) AS high FROM p GROUP BY 1"))
def decision_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return decision_groups(t, period(t)).groupBy("risk_label").agg(F.count("*").alias("groups"), F.sum("total").alias("links"), F.sum("high_risk_total").alias("high"))


@query(sql(_WEEK + "SELECT disease_tag AS disease, count(*) AS total, count(*) FILTER (WHERE threat_score >= 70) AS high_risk_total, " + r2("sum(threat_score)", "count(*)") + " AS avg_score FROM w WHERE disease_tag <> '' GROUP BY 1 ORDER BY total DESC, avg_score DESC, disease LIMIT 12"))
def decision_diseases(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = period(Tables(spark, sf_dir)).where("disease_tag <> ''")
    g = s.groupBy(F.col("disease_tag").alias("disease")).agg(F.count("*").alias("total"), F.expr("count_if(threat_score >= 70)").alias("high_risk_total"), F.sum("threat_score").alias("s")).withColumn("avg_score", ratio2("s", "total")).drop("s")
    return g.orderBy(F.desc("total"), F.desc("avg_score"), "disease").limit(12)
