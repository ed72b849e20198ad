"""Province and city roll-ups, box map, choropleth, thematic maps and map points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from epilens.functions.numeric import ladder, ratio2
from epilens.plans.report import _linked
from epilens.plans.trend import STATUSES
from epilens.registry import query
from epilens.sources.adapter import Tables, r2, sql

_VERIFIED = ", v AS (SELECT * FROM signal WHERE status IN ('validated', 'approved'))"


def verified(t: Tables) -> DataFrame:
    return t.signal.where(F.col("status").isin(STATUSES["validated"]))


_REGION = _VERIFIED + ", pl AS (SELECT province, location_id, count(DISTINCT id) AS n, sum(threat_score) AS s, count(*) AS k, count(DISTINCT id) FILTER (WHERE is_high_risk) AS high FROM prov JOIN v ON id = signal_id GROUP BY ALL)"


@query(sql(_REGION + "SELECT province AS region_name, CAST(sum(n) AS BIGINT) AS total_signals, CAST(sum(high) AS BIGINT) AS high_risk_count, round(sum(CAST(s AS DOUBLE) / k * n) / sum(n), 6) AS avg_score FROM pl GROUP BY 1"))
def region_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places first, then provinces: a place's mean weighs as many as its distinct signals."""
    t = Tables(spark, sf_dir)
    places = _linked(t, t.promoted, verified(t)).groupBy("province", "location_id")
    places = places.agg(F.countDistinct("id").alias("n"), F.sum("threat_score").alias("s"), F.count("*").alias("k"), F.expr("count(distinct id) filter (where is_high_risk)").alias("high"))
    g = places.groupBy(F.col("province").alias("region_name")).agg(F.sum("n").alias("total_signals"), F.sum("high").alias("high_risk_count"), (F.sum(F.expr("cast(s as double) / k * n")) / F.sum("n")).alias("a"))
    return g.select("region_name", "total_signals", "high_risk_count", F.round("a", 6).alias("avg_score"))


@query(sql(_VERIFIED + ", g AS (SELECT location_id, place, level, count(DISTINCT id) AS total_signals, count(DISTINCT id) FILTER (WHERE is_high_risk) AS high_risk_count, " + r2("sum(threat_score)", "count(*)") + " AS avg_score, max(threat_score) AS max_score FROM plink JOIN v ON id = signal_id WHERE parent_id = 1001 AND level IN ('city', 'regency') GROUP BY ALL) SELECT *, CASE WHEN total_signals >= 100 THEN 6 WHEN total_signals >= 50 THEN 5 WHEN total_signals >= 25 THEN 4 WHEN total_signals >= 10 THEN 3 WHEN total_signals >= 5 THEN 2 WHEN total_signals >= 1 THEN 1 ELSE 0 END AS count_class FROM g"))
def city_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    inside = t.primary.where("parent_id = 1001 and level in ('city', 'regency')")
    g = _linked(t, inside, verified(t)).groupBy("location_id", "place", "level")
    g = g.agg(F.countDistinct("id").alias("total_signals"), F.expr("count(distinct id) filter (where is_high_risk)").alias("high_risk_count"), F.sum("threat_score").alias("s"), F.count("*").alias("k"), F.max("threat_score").alias("max_score"))
    classes = ladder(*((f"total_signals >= {n}", c) for n, c in ((100, 6), (50, 5), (25, 4), (10, 3), (5, 2), (1, 1))), default=0)
    return g.withColumn("avg_score", ratio2("s", "k")).withColumn("count_class", classes).drop("s", "k")


@query(sql(_VERIFIED + ", g AS (SELECT province_id, province, count(DISTINCT id) AS total_signals, count(DISTINCT id) FILTER (WHERE is_high_risk) AS high_risk_count, " + r2("sum(threat_score)", "count(*)") + " AS avg_score FROM prov JOIN v ON id = signal_id GROUP BY ALL) SELECT *, round(greatest(8, least(30, 7 + sqrt(total_signals) * 5)), 4) AS radius FROM g"))
def province_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals of a province and its cities, each once, with the marker radius."""
    t = Tables(spark, sf_dir)
    g = _linked(t, t.promoted, verified(t)).groupBy("province_id", "province")
    g = g.agg(F.countDistinct("id").alias("total_signals"), F.expr("count(distinct id) filter (where is_high_risk)").alias("high_risk_count"), F.sum("threat_score").alias("s"), F.count("*").alias("k"))
    radius = F.round(F.greatest(F.lit(8.0), F.least(F.lit(30.0), 7 + F.sqrt("total_signals") * 5)), 4)
    return g.withColumns({"avg_score": ratio2("s", "k"), "radius": radius}).drop("s", "k")


_BOX = _VERIFIED + ", b AS (SELECT province_code, province, coalesce(nullif(disease_tag, ''), 'UNKNOWN') AS disease, id, threat_score, published_at, slot FROM (SELECT * EXCLUDE (province_code), (SELECT province_code FROM location l WHERE l.id = province_id) AS province_code FROM prov) x JOIN v ON id = signal_id)"


@query(sql(_BOX + ", g AS (SELECT province_code, province, disease, count(*) AS total, count(*) FILTER (WHERE threat_score >= 70) AS high_risk_total, " + r2("sum(threat_score)", "count(*)") + " AS avg_score, array_to_string(list_slice(list(CAST(id AS VARCHAR) ORDER BY threat_score DESC, published_at DESC, id, slot), 1, 4), ',') AS samples FROM b GROUP BY ALL) SELECT row_number() OVER (ORDER BY total DESC, high_risk_total DESC, avg_score DESC, disease, province) AS rank, * FROM g QUALIFY rank <= 12"))
def box_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve most frequent pairs of province and disease, with four samples each."""
    t = Tables(spark, sf_dir)
    b = _linked(t, t.promoted, verified(t)).withColumn("disease", F.expr("coalesce(nullif(disease_tag, ''), 'UNKNOWN')"))
    keys = ["province_code", "province", "disease"]
    b = b.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("threat_score"), F.desc("published_at"), "id", "slot")))
    picked = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("rn") <= 4, F.struct("rn", "id")))), lambda x: x["id"].cast("string")), ",")
    g = b.groupBy(*keys).agg(F.count("*").alias("total"), F.expr("count_if(threat_score >= 70)").alias("high_risk_total"), F.sum("threat_score").alias("s"), picked.alias("samples")).withColumn("avg_score", ratio2("s", "total")).drop("s")
    order = [F.desc("total"), F.desc("high_risk_total"), F.desc("avg_score"), F.asc("disease"), F.asc("province")]
    return g.orderBy(*order).limit(12).withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))


@query(sql(_BOX + ", g AS (SELECT province_code, province, count(*) AS total, count(*) FILTER (WHERE threat_score >= 70) AS high_risk_total, " + r2("sum(threat_score)", "count(*)") + " AS avg_score FROM b GROUP BY ALL), m AS (SELECT province_code, disease, count(*) AS n FROM b GROUP BY ALL) SELECT g.*, (SELECT disease FROM m WHERE m.province_code = g.province_code ORDER BY n DESC, disease LIMIT 1) AS dominant_disease, (SELECT max(n) FROM m WHERE m.province_code = g.province_code) AS dominant_total FROM g"))
def box_map_provinces(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    b = _linked(t, t.promoted, verified(t)).withColumn("disease", F.expr("coalesce(nullif(disease_tag, ''), 'UNKNOWN')"))
    keys = ["province_code", "province"]
    pairs = b.groupBy(*keys, "disease").agg(F.count("*").alias("n"), F.expr("count_if(threat_score >= 70)").alias("h"), F.sum("threat_score").alias("s"))
    g = pairs.groupBy(*keys).agg(F.sum("n").alias("total"), F.sum("h").alias("high_risk_total"), F.sum("s").alias("s"), F.min_by("disease", F.struct(-F.col("n"), "disease")).alias("dominant_disease"), F.max("n").alias("dominant_total"))
    return g.withColumn("avg_score", ratio2("s", "total")).drop("s")


_CHORO = _VERIFIED + """
, u AS (SELECT DISTINCT province, id, threat_score, is_high_risk, coalesce(nullif(disease_tag, ''), 'UNKNOWN') AS disease, published_at FROM prov JOIN v ON id = signal_id),
m AS (SELECT province, disease, count(*) AS n FROM u GROUP BY ALL),
g AS (SELECT province, count(*) AS signal_count, count(*) FILTER (WHERE threat_score >= 70 OR is_high_risk) AS high_risk_count, CAST(sum(threat_score) AS BIGINT) AS score_sum, """ + r2("sum(threat_score)", "count(*)") + """ AS avg_score, max(threat_score) AS max_score,
  arg_max(id, (threat_score, id)) AS top_signal_id FROM u GROUP BY 1),
c AS (SELECT *, round(avg_score * 0.55 + high_risk_count * 8 + least(signal_count * 2, 30), 2) AS risk_index FROM g)
"""


@query(sql(_CHORO + "SELECT province, signal_count, high_risk_count, avg_score, max_score, risk_index, CASE WHEN risk_index >= 75 THEN 'HIGH' WHEN risk_index >= 50 THEN 'MEDIUM_HIGH' WHEN risk_index >= 30 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level, (SELECT disease FROM m WHERE m.province = c.province ORDER BY n DESC, disease LIMIT 1) AS dominant_disease, (SELECT string_agg(disease || '=' || n, ',' ORDER BY disease) FROM m WHERE m.province = c.province) AS breakdown, top_signal_id FROM c"))
def choropleth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return choropleth_rows(Tables(spark, sf_dir)).drop("score_sum")


def choropleth_rows(t: Tables) -> DataFrame:
    """One row per province; a signal counts once in a province however many links it has there."""
    u = _linked(t, t.promoted, verified(t)).select("province", "id", "threat_score", "is_high_risk", F.expr("coalesce(nullif(disease_tag, ''), 'UNKNOWN')").alias("disease")).distinct()
    pairs = u.groupBy("province", "disease").agg(F.count("*").alias("n"), F.expr("count_if(threat_score >= 70 or is_high_risk)").alias("h"), F.sum("threat_score").alias("s"), F.max("threat_score").alias("m"), F.max(F.struct("threat_score", "id")).alias("top"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("disease", "n"))), lambda x: F.concat(x["disease"], F.lit("="), x["n"])), ",")
    g = pairs.groupBy("province").agg(F.sum("n").alias("signal_count"), F.sum("h").alias("high_risk_count"), F.sum("s").alias("score_sum"), F.max("m").alias("max_score"), F.max("top").alias("top"), F.min_by("disease", F.struct(-F.col("n"), "disease")).alias("dominant_disease"), listed.alias("breakdown"))
    g = g.withColumn("avg_score", ratio2("score_sum", "signal_count"))
    g = g.withColumn("risk_index", F.round(F.col("avg_score") * 0.55 + F.col("high_risk_count") * 8 + F.least(F.col("signal_count") * 2, F.lit(30)), 2))
    level = ladder(("risk_index >= 75", "HIGH"), ("risk_index >= 50", "MEDIUM_HIGH"), ("risk_index >= 30", "MEDIUM"), default="LOW")
    return g.withColumn("risk_level", level).withColumn("top_signal_id", F.col("top.id")).drop("top")


@query(sql(_CHORO + "SELECT CAST(sum(signal_count) AS BIGINT) AS signals, CAST(sum(high_risk_count) AS BIGINT) AS high_risk, count(*) AS provinces, " + r2("sum(score_sum)", "sum(signal_count)") + " AS national_mean FROM c"))
def choropleth_national(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = choropleth_rows(Tables(spark, sf_dir)).agg(F.sum("signal_count").alias("signals"), F.sum("high_risk_count").alias("high_risk"), F.count("*").alias("provinces"), F.sum("score_sum").alias("s"))
    return g.withColumn("national_mean", ratio2("s", "signals")).drop("s")


def floor_quantile_bands(rows: DataFrame, value: str, steps: tuple[float, ...] = (0.4, 0.6, 0.8)) -> DataFrame:
    """Band 1 to 5 by values[floor((n - 1) p)] of the positive values; 0 without a positive value.

    The first band ends at the .4 break: the .2 break has no effect in the map it serves. The
    values are one per region, so sorting them in one task is bounded by the gazetteer.
    """
    sorted_ = rows.where(F.col(value) > 0).agg(F.array_sort(F.collect_list(value)).alias("v"))
    at = [F.expr(f"element_at(v, cast(floor((size(v) - 1) * {p}) as int) + 1)") for p in steps]
    cuts = sorted_.select(F.when(F.size("v") > 0, F.array(*at)).alias("cuts")).scalar()
    band = F.when(F.col(value) <= 0, 0)
    for k in range(len(steps)):
        band = band.when(F.col(value) <= F.col("cuts")[k], k + 1)
    return rows.withColumn("cuts", cuts).withColumn("band", band.otherwise(len(steps) + 1)).drop("cuts")


@query(sql(_VERIFIED + ", g AS (SELECT location_id, place, count(DISTINCT id) AS n FROM plink JOIN v ON id = signal_id GROUP BY ALL), o AS (SELECT n, row_number() OVER (ORDER BY n) - 1 AS i, count(*) OVER () AS c FROM g), q AS (SELECT min(n) FILTER (WHERE i = floor((c - 1) * 0.4)) AS a, min(n) FILTER (WHERE i = floor((c - 1) * 0.6)) AS b, min(n) FILTER (WHERE i = floor((c - 1) * 0.8)) AS d FROM o) SELECT location_id, place, n, CASE WHEN n <= a THEN 1 WHEN n <= b THEN 2 WHEN n <= d THEN 3 ELSE 4 END AS band FROM g, q"))
def choropleth_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    g = _linked(t, t.primary, verified(t)).groupBy("location_id", "place").agg(F.countDistinct("id").alias("n"))
    return floor_quantile_bands(g, "n")


@query(sql(_VERIFIED + ", g AS (SELECT province_code, count(*) AS total, count(*) FILTER (WHERE threat_score > 50) AS high, " + r2("sum(threat_score)", "count(*)") + " AS avg_score FROM plink JOIN v ON id = signal_id GROUP BY 1) SELECT *, CASE WHEN avg_score < 10 THEN 0 WHEN avg_score < 20 THEN 1 WHEN avg_score < 40 THEN 2 WHEN avg_score < 60 THEN 3 WHEN avg_score < 80 THEN 4 ELSE 5 END AS avg_class FROM g"))
def thematic_province(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the place's own province code, links counted, with the fixed classes of averages."""
    t = Tables(spark, sf_dir)
    g = _linked(t, t.primary, verified(t)).groupBy("province_code").agg(F.count("*").alias("total"), F.expr("count_if(threat_score > 50)").alias("high"), F.sum("threat_score").alias("s")).withColumn("avg_score", ratio2("s", "total")).drop("s")
    return g.withColumn("avg_class", ladder(*((f"avg_score < {b}", k) for k, b in enumerate((10, 20, 40, 60, 80))), default=5))


@query(sql(_VERIFIED + ", g AS (SELECT city_code, count(*) AS total FROM plink JOIN v ON id = signal_id WHERE city_code <> '' GROUP BY 1), k AS (SELECT max(total) AS m FROM g) SELECT city_code, total, CASE WHEN m <= 5 THEN 5 WHEN m <= 10 THEN 10 WHEN m <= 20 THEN 20 WHEN m <= 50 THEN 50 ELSE m END AS top_break FROM g, k"))
def thematic_city(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links by city with the last break that the legend derives from the maximum."""
    t = Tables(spark, sf_dir)
    g = _linked(t, t.primary, verified(t)).where("city_code <> ''").groupBy("city_code").agg(F.count("*").alias("total"))
    top = g.agg(F.max("total").alias("m")).select(ladder(*((f"m <= {b}", F.lit(b).cast("long")) for b in (5, 10, 20, 50)), default=F.col("m")).alias("top_break"))
    return g.withColumn("top_break", top.scalar())


@query(sql("SELECT signal_id, location_id, threat_score, disease_tag, round(location_id * 0.5 - 10, 4) AS lat, CAST(location_id + 95 AS DOUBLE) AS lon FROM plink JOIN signal ON id = signal_id WHERE status = 'approved' AND threat_score >= 35 ORDER BY published_at DESC, signal_id, slot LIMIT 2000"))
def map_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 newest approved points of at least the default score."""
    t = Tables(spark, sf_dir)
    top = _linked(t, t.primary, t.signal.where("status = 'approved' and threat_score >= 35")).orderBy(F.desc("published_at"), "signal_id", "slot").limit(2000)
    place = t.location.select(F.col("id").alias("location_id"), F.round("lat", 4).alias("lat"), "lon")
    return top.join(place, "location_id").select("signal_id", "location_id", "threat_score", "disease_tag", "lat", "lon")
