"""Detail pages: alert evidence, cluster duplicates, JSON payloads, status and master-data lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epilens.functions.numeric import ladder, ratio2
from epilens.functions.text import region_code
from epilens.operators.cluster import _KEY, cluster_rows
from epilens.plans.alerts import Settings, disease_city
from epilens.registry import query
from epilens.sources.adapter import Tables, r2, sql
from epilens.sources.masterdata import CATALOGUE_SQL, catalogue

# Stored spellings of geocode statuses and their canonical form.
STATUS_FORMS = {"OK": "ok", "MATCHED": "matched", "MANUAL": "manual", "GAZETTEER_ONLY": "gazetteer_only", "EMPTY_LOC": "empty_loc", "NOT_FOUND": "not_found", "NET_ERR": "net_err", "SKIP_LOW_CONF": "skip_low_conf", "SKIP_TOO_GENERAL": "skip_too_general", "PENDING": "pending"}


def canonical_status(c: Column) -> Column:
    """The canonical status; unknown ones in lower case, empty ones pending."""
    mapped = F.create_map(*[F.lit(v) for kv in STATUS_FORMS.items() for v in kv])
    return F.coalesce(mapped[F.upper(F.trim(c))], F.nullif(F.lower(F.trim(c)), F.lit("")), F.lit("pending"))


@query(sql("SELECT s AS status, count(*) AS n FROM (SELECT CASE WHEN id % 10 = 0 THEN 'pending' WHEN id % 10 = 1 THEN 'odd' ELSE lower(geocode_status) END AS s FROM signal) GROUP BY 1"))
def canonical_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Tables(spark, sf_dir).signal.withColumn("g", F.expr("case id % 10 when 0 then '  ' when 1 then 'Odd' else upper(geocode_status) end"))
    return s.groupBy(canonical_status(F.col("g")).alias("status")).agg(F.count("*").alias("n"))


def evidence_window(first: str, last: str, as_of: str) -> tuple[Column, Column]:
    """From and to: both bounds a day wider; one bound a week on; none, the last thirty days."""
    day, week = "interval 1 day", "interval 7 days"
    low = F.expr(f"case when {first} is not null then {first} - {day} when {last} is not null then {last} - {week} else {as_of} - interval 30 days end")
    high = F.expr(f"case when {last} is not null then {last} + {day} when {first} is not null then {first} + {week} else {as_of} end")
    return low, high


@query(sql(""", a AS (SELECT location_id, lower(coalesce(nullif(trim(disease_tag), ''), 'UNKNOWN')) AS d, min(published_at) AS f, max(published_at) AS l, count(DISTINCT id) AS n, sum(threat_score) AS s, count(*) FILTER (WHERE threat_score >= 70) AS h FROM (SELECT DISTINCT location_id, s.* FROM plink JOIN signal s ON s.id = signal_id WHERE level <> 'province' AND status IN ('validated', 'approved') AND published_at BETWEEN TIMESTAMP '2024-01-24' AND TIMESTAMP '2024-01-31') GROUP BY ALL HAVING count(DISTINCT id) >= 5 AND (sum(threat_score) >= 35 * count(*) OR count(*) FILTER (WHERE threat_score >= 70) > 0)),
e AS (SELECT DISTINCT a.location_id, a.d, x.id, x.threat_score FROM a JOIN plink p ON p.location_id = a.location_id JOIN signal x ON x.id = p.signal_id AND x.status <> 'noise' AND lower(coalesce(nullif(trim(x.disease_tag), ''), 'UNKNOWN')) = a.d AND x.published_at BETWEEN a.f - INTERVAL 1 DAY AND a.l + INTERVAL 1 DAY)
SELECT location_id AS target, d AS folded, count(*) AS evidence, count(*) FILTER (WHERE threat_score >= 70) AS high FROM e GROUP BY ALL"""))
def alert_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals behind each disease alert of a city, within its window widened by a day."""
    t, s = Tables(spark, sf_dir), Settings()
    low, high = evidence_window("first_signal_at", "last_signal_at", s.now)
    alerts = disease_city(t, s).select("target", "folded", low.alias("low"), high.alias("high"))
    rows = t.primary.select("signal_id", F.col("location_id").alias("target")).join(t.signal.where("status <> 'noise'").select(F.col("id").alias("signal_id"), F.expr("lower(coalesce(nullif(trim(disease_tag), ''), 'UNKNOWN'))").alias("folded"), "published_at", "threat_score"), "signal_id")
    # Alerts are a few per place and disease, but grow with the gazetteer: the join is left to the optimiser.
    found = rows.join(alerts, ["target", "folded"]).where("published_at between low and high").select("target", "folded", "signal_id", "threat_score").distinct()
    return found.groupBy("target", "folded").agg(F.count("*").alias("evidence"), F.count_if(F.col("threat_score") >= 70).alias("high"))


@query(sql(_KEY + ", u AS (SELECT cluster_key, source_url, count(*) AS n FROM ck WHERE source_url <> '' AND status <> 'noise' GROUP BY ALL), a AS (SELECT source_url, CAST(sum(n) AS BIGINT) AS t FROM u GROUP BY 1) SELECT cluster_key, CAST(sum(n - 1) AS BIGINT) AS inside, CAST(sum(t - n) AS BIGINT) AS outside FROM u JOIN a USING (source_url) GROUP BY 1"))
def cluster_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies by URL within a cluster and in other clusters, from counts and without pairs."""
    t = Tables(spark, sf_dir)
    u = cluster_rows(t, t.signal).where("source_url <> '' and status <> 'noise'").groupBy("cluster_key", "source_url").agg(F.count("*").alias("n"))
    total = u.groupBy("source_url").agg(F.sum("n").alias("t"))
    return u.join(total, "source_url").groupBy("cluster_key").agg(F.sum(F.col("n") - 1).alias("inside"), F.sum(F.col("t") - F.col("n")).alias("outside"))


@query(sql("SELECT id, '{\"final_score\":' || threat_score || ',\"risk_level\":\"' || CASE WHEN threat_score >= 70 THEN 'high' WHEN threat_score >= 40 THEN 'medium' ELSE 'low' END || '\",\"matched\":[{\"keyword\":\"' || disease_tag || '\",\"weight\":' || confidence_score || '}]}' AS breakdown FROM signal WHERE disease_tag <> ''"))
def score_breakdown_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Tables(spark, sf_dir).signal.where("disease_tag <> ''")
    level = ladder(("threat_score >= 70", "high"), ("threat_score >= 40", "medium"), default="low")
    matched = F.array(F.struct(F.col("disease_tag").alias("keyword"), F.col("confidence_score").alias("weight")))
    return s.select("id", F.to_json(F.struct(F.col("threat_score").alias("final_score"), level.alias("risk_level"), matched.alias("matched"))).alias("breakdown"))


@query(sql("SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) // 10 AS decile, count(*) AS n, " + r2("sum(least(100, floor(value)))", "count(*)") + " AS avg_score FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) >= 50 GROUP BY 1"))
def json_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter and group by a value inside a JSON column."""
    k = F.get_json_object("props", "$.k").cast("long")
    e = Tables(spark, sf_dir).raw("events").where(k >= 50)
    return e.groupBy(F.floor(k / 10).alias("decile")).agg(F.count("*").alias("n"), F.sum(F.least(F.lit(100), F.floor("value"))).alias("s")).withColumn("avg_score", ratio2("s", "n")).drop("s")


@query(sql("SELECT p.id, p.name, p.province_code, (SELECT count(*) FROM location c WHERE c.parent_id = p.id) AS cities, (SELECT string_agg(name, '|' ORDER BY name) FROM location c WHERE c.parent_id = p.id) AS city_names FROM location p WHERE level = 'province'"))
def province_cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = Tables(spark, sf_dir).location
    cities = places.where("parent_id is not null").groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("cities"), F.array_join(F.array_sort(F.collect_list("name")), "|").alias("city_names"))
    return places.where("level = 'province'").join(cities, "id", "left").select("id", "name", "province_code", F.coalesce("cities", F.lit(0)).alias("cities"), "city_names")


@query(CATALOGUE_SQL + "SELECT count(*) AS total, count(*) FILTER (WHERE skdr_priority AND is_active) AS priority, count(*) FILTER (WHERE report_24h AND is_active) AS immediate, count(*) FILTER (WHERE emerging_watchlist AND is_active) AS emerging, count(*) FILTER (WHERE reemerging_watch AND is_active) AS reemerging FROM c")
def disease_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All diseases of the catalogue, and the active ones of each class."""
    active = lambda c, n: F.count_if(F.col(c) & F.col("is_active")).alias(n)
    return catalogue(Tables(spark, sf_dir)).agg(F.count("*").alias("total"), active("skdr_priority", "priority"), active("report_24h", "immediate"), active("emerging_watchlist", "emerging"), active("reemerging_watch", "reemerging"))


def disease_list(rows: DataFrame, q: str = "", classification: str = "", disease_type: str = "", alert_rule: str = "", is_active: str = "") -> DataFrame:
    """The catalogue's list in name order: q is anywhere in a name, its code, aliases or keywords in any case; unknown classes
    and flags filter nothing."""
    from epilens.plans.lists import tri_state

    flags = {"skdr": "skdr_priority", "24h": "report_24h", "emerging": "emerging_watchlist", "reemerging": "reemerging_watch"}
    x = rows
    if q.strip():
        hay = [F.col("name"), region_code(F.col("name")), *map(F.col, ("aliases", "keyword_id", "keyword_en", "skdr_code"))]
        found = [F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(q.strip().lower())) for c in hay]
        x = x.where(reduce(lambda a, b: a | b, found))
    x = x.where(F.col(flags[classification])) if classification in flags else x
    x = x.where(F.col("disease_type") == disease_type) if disease_type else x
    x = x.where(F.col("alert_rule") == alert_rule) if alert_rule else x
    return tri_state(x, "is_active", is_active).orderBy("name")


_LISTS = {
    "text": (dict(q=" RING "), "contains(lower(name), 'ring') OR contains(lower(aliases), 'ring') OR contains(lower(keyword_id), 'ring') OR contains(lower(keyword_en), 'ring')"),
    "code": (dict(q="blue_bolt"), "contains(replace(lower(name), ' ', '_'), 'blue_bolt')"),
    "class": (dict(classification="24h", is_active="yes"), "report_24h AND is_active"),
    "rule": (dict(alert_rule="unknown_cluster", disease_type="other", is_active="no"), "alert_rule = 'unknown_cluster' AND disease_type = 'other' AND NOT is_active"),
    "any": (dict(classification="odd", is_active="any"), "TRUE"),
}


@query(CATALOGUE_SQL + " UNION ALL ".join(f"SELECT '{n}' AS list, name FROM c WHERE {where}" for n, (_, where) in _LISTS.items()))
def disease_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue's list under several filters."""
    rows = catalogue(Tables(spark, sf_dir))
    parts = [disease_list(rows, **asked).select(F.lit(n).alias("list"), "name") for n, (asked, _) in _LISTS.items()]
    return reduce(DataFrame.unionByName, parts)
