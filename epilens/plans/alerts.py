"""Alert rules over three pre-aggregated populations, and the alert upsert.

Populations (validated and approved signals): the last `window_hours`, the
last `recent_days`, and the `baseline_days` before those. Histories are one
anti join each, never a probe per signal.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epilens.functions.numeric import ladder, ratio2
from epilens.plans.report import _linked
from epilens.registry import query
from epilens.sources.adapter import AS_OF, Tables, r2, sql


@dataclass(frozen=True)
class Settings:
    """Thresholds; the defaults are the engine's fixed values."""

    as_of: str = AS_OF
    city_signal_count: int = 5
    window_hours: int = 48
    avg_score: int = 60
    recent_days: int = 7
    baseline_days: int = 21
    disease_signal_count: int = 5
    spike_ratio: float = 2.0

    @property
    def now(self) -> str:
        return f"timestamp_ntz'{self.as_of}'"

    @property
    def since(self) -> str:
        return f"({self.now} - interval {self.window_hours} hours)"

    @property
    def recent(self) -> str:
        return f"({self.now} - interval {self.recent_days} days)"

    @property
    def baseline(self) -> str:
        return f"({self.recent} - interval {self.baseline_days} days)"


def severity() -> Column:
    return ladder(("high >= 3 or avg_score >= 70 or ratio >= 3", "RED"), ("high >= 1 or avg_score >= 55 or ratio >= 2", "ORANGE"), ("n >= 3 or avg_score >= 40", "YELLOW"), default="GREEN")

_SIGNALS = "status in ('validated', 'approved')"
_V = ", v AS (SELECT * FROM signal WHERE status IN ('validated', 'approved'))"


def place_links(t: Tables, s: Settings) -> DataFrame:
    """Primary links of verified signals."""
    return _linked(t, t.primary, t.signal.where(_SIGNALS))


def _alerts(rows: DataFrame, kind: str, key: str, place: str = "location_id") -> DataFrame:
    """The columns that all rules return."""
    return rows.select(F.lit(kind).alias("alert_type"), F.col(place).cast("long").alias("location_id"), F.col("n").cast("long").alias("signal_count"), F.col("avg_score").cast("double").alias("avg_score"), "first_signal_at", "last_signal_at", F.expr(key).alias("dedup_key"))


def _stats(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("threat_score").alias("s"), F.expr("count_if(threat_score >= 70)").alias("high"), F.min("published_at").alias("first_signal_at"), F.max("published_at").alias("last_signal_at"))


def city_cluster(t: Tables, s: Settings) -> DataFrame:
    g = _stats(place_links(t, s).where(f"published_at >= {s.since} and level in ('city', 'regency')"), "location_id").where(f"n >= {s.city_signal_count}").withColumn("avg_score", ratio2("s", "n"))
    return _alerts(g, "cluster_city_48h", f"concat('cluster_city_48h::', location_id, '::', date({s.since}))")


def high_average(t: Tables, s: Settings) -> DataFrame:
    g = _stats(place_links(t, s).where(f"published_at >= {s.since} and level in ('city', 'regency')"), "location_id").where(f"s > {s.avg_score} * n and n >= 2").withColumn("avg_score", ratio2("s", "n"))
    return _alerts(g, "high_avg_score", f"concat('high_avg_score::', location_id, '::', date({s.since}))")


def new_place(t: Tables, s: Settings) -> DataFrame:
    """Places linked in the window and never before."""
    g = _stats(place_links(t, s), "location_id").where(f"first_signal_at >= {s.since}").withColumn("avg_score", ratio2("s", "n"))
    return _alerts(g, "new_location", f"concat('new_location::', location_id, '::', date({s.since}))")


def disease_place_stats(t: Tables, s: Settings, where: str, level: str) -> DataFrame:
    """(place, folded disease): a signal counts once at a place; the label is the highest, newest signal's spelling."""
    links = t.promoted.withColumn("target", F.col("province_id")) if level == "province" else t.primary.where("level in ('city', 'regency')").withColumn("target", F.col("location_id"))
    rows = _linked(t, links, t.signal.where(_SIGNALS).where(where)).withColumn("label", F.expr("coalesce(nullif(trim(disease_tag), ''), 'UNKNOWN')")).withColumn("folded", F.lower("label"))
    once = rows.select("target", "folded", "label", "id", "threat_score", "published_at").distinct()
    g = once.groupBy("target", "folded").agg(
        F.count("*").alias("n"), F.sum("threat_score").alias("s"), F.expr("count_if(threat_score >= 70)").alias("high"), F.min("published_at").alias("first_signal_at"), F.max("published_at").alias("last_signal_at"), F.max_by("label", F.struct("threat_score", "published_at", "id")).alias("disease")
    )
    return g.withColumn("avg_score", ratio2("s", "n"))


def _recent(s: Settings) -> str:
    return f"published_at >= {s.recent} and published_at <= {s.now}"


def province_spike(t: Tables, s: Settings, scores: bool = True) -> DataFrame:
    """Enough signals, and a ratio to the scaled baseline (or, with scores, a high score) beyond its threshold."""
    now = disease_place_stats(t, s, _recent(s), "province")
    before = disease_place_stats(t, s, f"published_at >= {s.baseline} and published_at < {s.recent}", "province").select("target", "folded", F.col("n").alias("b"))
    f = max(1, s.baseline_days // s.recent_days)
    g = now.join(before, ["target", "folded"], "left").withColumn("b", F.coalesce("b", F.lit(0)))
    # ratio = n / max(1, b / f) = n f / max(f, b), rounded before it is compared
    g = g.withColumn("ratio", ratio2(f"n * {f}", f"greatest({f}, b)"))
    extra = f" or high > 0 or avg_score >= {s.avg_score}" if scores else ""
    return g.where(f"n >= {s.disease_signal_count}").where(f"ratio >= {s.spike_ratio}{extra}")


def disease_city(t: Tables, s: Settings) -> DataFrame:
    return disease_place_stats(t, s, _recent(s), "city").where(f"n >= {max(2, s.city_signal_count)} and (avg_score >= 35 or high > 0)")


def new_disease_place(t: Tables, s: Settings) -> DataFrame:
    older = place_links(t, s).where(f"published_at < {s.recent}").select(F.col("location_id").alias("target"), F.expr("lower(coalesce(nullif(trim(disease_tag), ''), 'UNKNOWN'))").alias("folded")).distinct()
    return disease_place_stats(t, s, _recent(s), "city").join(older, ["target", "folded"], "left_anti").where(f"n >= 2 or avg_score >= {s.avg_score}")


def _with_disease(t: Tables, s: Settings) -> DataFrame:
    """Recent verified signals of a catalogued disease, with its flags."""
    d = t.disease.select(F.col("id").alias("disease_id"), F.lower("name").alias("folded"), "alert_rule", "disease_type", "report_24h", "emerging_watchlist", "reemerging_watch")
    return t.signal.where(_SIGNALS).withColumn("folded", F.lower("disease_tag")).join(d, "folded")


def priority_disease(t: Tables, s: Settings) -> DataFrame:
    """Unknown cluster, emerging or immediate, per signal; the first that holds."""
    kind = ladder(("alert_rule = 'unknown_cluster' or disease_type = 'unknown_cluster'", "unknown_cluster_signal"), ("emerging_watchlist", "emerging_disease_signal"), ("report_24h", "immediate_disease_signal"), default=F.lit(None).cast("string"))
    rows = _with_disease(t, s).where(_recent(s)).withColumn("kind", kind).where("kind is not null")
    first = t.primary.groupBy("signal_id").agg(F.min_by("location_id", "slot").alias("location_id"))
    rows = rows.join(first, F.col("signal_id") == F.col("id"), "left")
    return rows.select(F.col("kind").alias("alert_type"), F.col("location_id").cast("long").alias("location_id"), F.lit(1).cast("long").alias("signal_count"), F.col("threat_score").cast("double").alias("avg_score"), F.col("published_at").alias("first_signal_at"), F.col("published_at").alias("last_signal_at"), F.concat_ws("::", "kind", "id", "disease_id").alias("dedup_key"))


def reemerging(t: Tables, s: Settings) -> DataFrame:
    """Watched diseases at places without an earlier signal of theirs: the highest, newest signal stands for the key."""
    rows = _with_disease(t, s).where("reemerging_watch")
    links = rows.join(t.primary.select("signal_id", "location_id", "slot"), F.col("signal_id") == F.col("id"))
    older = links.where(f"published_at < {s.recent}").select("location_id", "disease_id").distinct()
    first = links.where(_recent(s)).groupBy("id").agg(F.min_by(F.struct("location_id", "disease_id", "threat_score", "published_at"), "slot").alias("x")).select("id", "x.*")
    g = first.join(older, ["location_id", "disease_id"], "left_anti").groupBy("location_id", "disease_id").agg(F.max(F.struct("threat_score", "published_at")).alias("x"))
    g = g.select("location_id", "disease_id", F.lit(1).alias("n"), F.col("x.threat_score").alias("avg_score"), F.col("x.published_at").alias("first_signal_at"), F.col("x.published_at").alias("last_signal_at"))
    return _alerts(g, "reemerging_disease_location", f"concat('reemerging_disease_location::', location_id, '::', disease_id, '::', date({s.recent}))")


def all_alerts(t: Tables, s: Settings) -> DataFrame:
    """Every rule's alerts under one schema."""
    days = f"'::', date({s.recent}), '::', date({s.now})"
    parts = [
        priority_disease(t, s),
        reemerging(t, s),
        city_cluster(t, s),
        high_average(t, s),
        new_place(t, s),
        _alerts(province_spike(t, s), "disease_spike_province", f"concat('disease_spike_province::', target, '::', folded, {days})", "target"),
        _alerts(disease_city(t, s), "disease_cluster_city", f"concat('disease_cluster_city::', target, '::', folded, {days})", "target"),
        _alerts(new_disease_place(t, s), "new_disease_location", f"concat('new_disease_location::', target, '::', folded, '::', date({s.recent}))", "target"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def upsert_alerts(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """One row per dedup_key: new keys open; known keys take the new figures only while open.

    action says inserted, updated, kept (closed, or not met again).
    """
    values = ["alert_type", "location_id", "signal_count", "avg_score", "first_signal_at", "last_signal_at"]
    old = existing.select("dedup_key", "status", *[F.col(c).alias(f"old_{c}") for c in values], F.lit(True).alias("had"))
    both = old.join(incoming.select("dedup_key", *values, F.lit(True).alias("came")), "dedup_key", "full")
    take = F.col("came").isNotNull() & (F.col("had").isNull() | (F.col("status") == "open"))
    action = F.when(F.col("had").isNull(), "inserted").when(take, "updated").otherwise("kept")
    return both.select("dedup_key", *[F.when(take, F.col(c)).otherwise(F.col(f"old_{c}")).alias(c) for c in values], F.coalesce("status", F.lit("open")).alias("status"), action.alias("action"))


# Each rule in SQL, written on its own from the rule.
_T = "TIMESTAMP '2024-01-31'"
_CITY48 = _V + f", c AS (SELECT location_id, count(*) AS n, sum(threat_score) AS s, min(published_at) AS f, max(published_at) AS l FROM plink JOIN v ON id = signal_id WHERE published_at >= {_T} - INTERVAL 48 HOUR AND level <> 'province' GROUP BY 1)"
_ROW = "CAST(location_id AS BIGINT) AS location_id, n AS signal_count, " + r2("s", "n") + " AS avg_score, f AS first_signal_at, l AS last_signal_at"
_STATS = _V + f""", r AS (SELECT *, CASE WHEN trim(disease_tag) = '' THEN 'UNKNOWN' ELSE trim(disease_tag) END AS label FROM v WHERE published_at BETWEEN {_T} - INTERVAL 7 DAY AND {_T}),
b AS (SELECT *, CASE WHEN trim(disease_tag) = '' THEN 'UNKNOWN' ELSE trim(disease_tag) END AS label FROM v WHERE published_at >= {_T} - INTERVAL 28 DAY AND published_at < {_T} - INTERVAL 7 DAY),
ps AS (SELECT province_id AS target, lower(label) AS folded, count(DISTINCT id) AS n, count(DISTINCT id) FILTER (WHERE threat_score >= 70) AS high, sum(threat_score) AS s, min(published_at) AS f, max(published_at) AS l FROM (SELECT DISTINCT province_id, r.* FROM prov JOIN r ON id = signal_id) GROUP BY ALL),
pb AS (SELECT province_id AS target, lower(label) AS folded, count(DISTINCT id) AS b FROM prov JOIN b ON id = signal_id GROUP BY ALL),
cs AS (SELECT location_id AS target, lower(label) AS folded, count(*) AS n, count(*) FILTER (WHERE threat_score >= 70) AS high, sum(threat_score) AS s, min(published_at) AS f, max(published_at) AS l FROM (SELECT DISTINCT location_id, r.* FROM plink JOIN r ON id = signal_id WHERE level IN ('city', 'regency')) GROUP BY ALL)
"""
_SPIKE = _STATS + ", k AS (SELECT ps.*, " + r2("3 * n", "greatest(3, coalesce(b, 0))") + " AS ratio, " + r2("s", "n") + " AS avg_score FROM ps LEFT JOIN pb USING (target, folded))"


@query(sql(_CITY48 + "SELECT 'cluster_city_48h' AS alert_type, " + _ROW + ", 'cluster_city_48h::' || location_id || '::2024-01-29' AS dedup_key FROM c WHERE n >= 5"))
def alert_city_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return city_cluster(Tables(spark, sf_dir), Settings())


@query(sql(_CITY48 + "SELECT 'high_avg_score' AS alert_type, " + _ROW + ", 'high_avg_score::' || location_id || '::2024-01-29' AS dedup_key FROM c WHERE n >= 2 AND CAST(s AS DOUBLE) / n > 60"))
def alert_high_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return high_average(Tables(spark, sf_dir), Settings())


@query(sql(_V + f", c AS (SELECT location_id, count(*) AS n, sum(threat_score) AS s, min(published_at) AS f, max(published_at) AS l FROM plink JOIN v ON id = signal_id WHERE published_at >= {_T} - INTERVAL 48 HOUR GROUP BY 1) SELECT 'new_location' AS alert_type, " + _ROW + f", 'new_location::' || location_id || '::2024-01-29' AS dedup_key FROM c WHERE NOT EXISTS (SELECT 1 FROM plink p JOIN v ON id = signal_id WHERE p.location_id = c.location_id AND published_at < {_T} - INTERVAL 48 HOUR)"))
def alert_new_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    return new_place(Tables(spark, sf_dir), Settings())


@query(sql(_SPIKE + "SELECT target, folded, n, high, avg_score, ratio, CASE WHEN high >= 3 OR avg_score >= 70 OR ratio >= 3 THEN 'RED' WHEN high >= 1 OR avg_score >= 55 OR ratio >= 2 THEN 'ORANGE' WHEN n >= 3 OR avg_score >= 40 THEN 'YELLOW' ELSE 'GREEN' END AS severity FROM k WHERE n >= 45 AND (ratio >= 2 OR high > 0 OR avg_score >= 60)"))
def alert_province_spike(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a count threshold of 45, so that some groups pass and some fail."""
    g = province_spike(Tables(spark, sf_dir), Settings(disease_signal_count=45))
    return g.withColumn("severity", severity()).select("target", "folded", "n", "high", "avg_score", "ratio", "severity")


@query(sql(_SPIKE + "SELECT target, folded, n, ratio FROM k WHERE n >= 5 AND ratio >= 1.1"))
def alert_province_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ratio alone, at 1.1."""
    return province_spike(Tables(spark, sf_dir), Settings(spike_ratio=1.1), scores=False).select("target", "folded", "n", "ratio")


@query(sql(_STATS + ", k AS (SELECT *, " + r2("s", "n") + " AS avg_score FROM cs) SELECT target, folded, n, high, avg_score, CASE WHEN high >= 3 OR avg_score >= 70 THEN 'RED' WHEN high >= 1 OR avg_score >= 55 THEN 'ORANGE' WHEN n >= 3 OR avg_score >= 40 THEN 'YELLOW' ELSE 'GREEN' END AS severity FROM k WHERE n >= 5 AND (avg_score >= 35 OR high > 0)"))
def alert_disease_city(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = disease_city(Tables(spark, sf_dir), Settings()).withColumn("ratio", F.lit(0.0)).withColumn("severity", severity())
    return g.select("target", "folded", "n", "high", "avg_score", "severity")


@query(sql(_STATS + ", k AS (SELECT *, " + r2("s", "n") + f" AS avg_score FROM cs) SELECT target, folded, n, avg_score FROM k WHERE (n >= 2 OR avg_score >= 60) AND NOT EXISTS (SELECT 1 FROM plink p JOIN v ON id = signal_id WHERE p.location_id = k.target AND lower(CASE WHEN trim(disease_tag) = '' THEN 'UNKNOWN' ELSE trim(disease_tag) END) = k.folded AND published_at < {_T} - INTERVAL 7 DAY)"))
def alert_new_disease_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    return new_disease_place(Tables(spark, sf_dir), Settings()).select("target", "folded", "n", "avg_score")


_PRIORITY = _V + f", x AS (SELECT v.*, d.id AS did, CASE WHEN 'unknown_cluster' IN (alert_rule, disease_type) THEN 'unknown_cluster_signal' WHEN emerging_watchlist THEN 'emerging_disease_signal' WHEN report_24h THEN 'immediate_disease_signal' END AS kind FROM v JOIN disease d ON lower(name) = lower(disease_tag) WHERE published_at BETWEEN {_T} - INTERVAL 7 DAY AND {_T})"


@query(sql(_PRIORITY + "SELECT kind AS alert_type, CAST((SELECT location_id FROM plink WHERE signal_id = x.id ORDER BY slot LIMIT 1) AS BIGINT) AS location_id, CAST(1 AS BIGINT) AS signal_count, CAST(threat_score AS DOUBLE) AS avg_score, published_at AS first_signal_at, published_at AS last_signal_at, kind || '::' || id || '::' || did AS dedup_key FROM x WHERE kind IS NOT NULL"))
def alert_priority_disease(spark: SparkSession, sf_dir: str) -> DataFrame:
    return priority_disease(Tables(spark, sf_dir), Settings())


_REEMERGING = _V + f""", w AS (SELECT v.id, published_at, threat_score, d.id AS did, location_id, slot, published_at < {_T} - INTERVAL 7 DAY AS old FROM v JOIN disease d ON lower(name) = lower(disease_tag) AND reemerging_watch JOIN plink ON signal_id = v.id),
f AS (SELECT * FROM w WHERE published_at BETWEEN {_T} - INTERVAL 7 DAY AND {_T} QUALIFY row_number() OVER (PARTITION BY id ORDER BY slot) = 1),
n AS (SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.old AND w.location_id = f.location_id AND w.did = f.did) QUALIFY row_number() OVER (PARTITION BY location_id, did ORDER BY threat_score DESC, published_at DESC) = 1)
"""


@query(sql(_REEMERGING + "SELECT 'reemerging_disease_location' AS alert_type, CAST(location_id AS BIGINT) AS location_id, CAST(1 AS BIGINT) AS signal_count, CAST(threat_score AS DOUBLE) AS avg_score, published_at AS first_signal_at, published_at AS last_signal_at, 'reemerging_disease_location::' || location_id || '::' || did || '::2024-01-24' AS dedup_key FROM n"))
def alert_reemerging(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reemerging(Tables(spark, sf_dir), Settings())


_ALL = _SPIKE + f""", z AS (
SELECT 'cluster_city_48h' AS t, count(*) AS c FROM (SELECT location_id FROM plink JOIN v ON id = signal_id WHERE published_at >= {_T} - INTERVAL 48 HOUR AND level <> 'province' GROUP BY 1 HAVING count(*) >= 5)
UNION ALL SELECT 'high_avg_score', count(*) FROM (SELECT location_id FROM plink JOIN v ON id = signal_id WHERE published_at >= {_T} - INTERVAL 48 HOUR AND level <> 'province' GROUP BY 1 HAVING count(*) >= 2 AND avg(threat_score) > 60)
UNION ALL SELECT 'new_location', count(*) FROM (SELECT location_id FROM plink JOIN v ON id = signal_id GROUP BY 1 HAVING min(published_at) >= {_T} - INTERVAL 48 HOUR)
UNION ALL SELECT 'disease_spike_province', count(*) FROM k WHERE n >= 5 AND (ratio >= 2 OR high > 0 OR avg_score >= 60)
UNION ALL SELECT 'disease_cluster_city', count(*) FROM cs WHERE n >= 5 AND (s >= 35 * n OR high > 0)
UNION ALL SELECT 'new_disease_location', count(*) FROM cs WHERE (n >= 2 OR s >= 60 * n) AND (target, folded) NOT IN (SELECT location_id, lower(CASE WHEN trim(disease_tag) = '' THEN 'UNKNOWN' ELSE trim(disease_tag) END) FROM plink JOIN v ON id = signal_id WHERE published_at < {_T} - INTERVAL 7 DAY)
UNION ALL SELECT 'emerging_disease_signal', count(*) FROM v WHERE lower(disease_tag) = 'antraks' AND published_at BETWEEN {_T} - INTERVAL 7 DAY AND {_T}
UNION ALL SELECT 'immediate_disease_signal', count(*) FROM v WHERE lower(disease_tag) = 'rabies' AND published_at BETWEEN {_T} - INTERVAL 7 DAY AND {_T}
UNION ALL SELECT 'reemerging_disease_location', count(*) FROM (SELECT location_id FROM (SELECT id, published_at, arg_min(location_id, slot) AS location_id FROM plink JOIN v ON id = signal_id WHERE disease_tag = 'Campak' AND published_at BETWEEN {_T} - INTERVAL 7 DAY AND {_T} GROUP BY ALL) GROUP BY 1 HAVING location_id NOT IN (SELECT location_id FROM plink JOIN v ON id = signal_id WHERE disease_tag = 'Campak' AND published_at < {_T} - INTERVAL 7 DAY))
)
"""


@query(sql(_ALL + "SELECT t AS alert_type, c AS alerts FROM z WHERE c > 0"))
def alert_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many alerts each rule raises."""
    return all_alerts(Tables(spark, sf_dir), Settings()).groupBy("alert_type").agg(F.count("*").alias("alerts"))


@query(sql(_CITY48 + """, e AS (SELECT 'cluster_city_48h::' || location_id || '::2024-01-29' AS dedup_key, location_id, CASE WHEN location_id % 3 = 0 THEN 'closed' ELSE 'open' END AS status FROM c WHERE n >= 5 AND location_id % 2 = 0 UNION ALL SELECT 'gone', 7, 'open')
SELECT coalesce(e.dedup_key, i.k) AS dedup_key, coalesce(e.status, 'open') AS status, CASE WHEN e.dedup_key IS NULL THEN 'inserted' WHEN i.k IS NOT NULL AND e.status = 'open' THEN 'updated' ELSE 'kept' END AS action, CASE WHEN i.k IS NOT NULL AND coalesce(e.status, 'open') = 'open' THEN i.n ELSE 0 END AS signal_count
FROM e FULL JOIN (SELECT 'cluster_city_48h::' || location_id || '::2024-01-29' AS k, n FROM c WHERE n >= 5) i ON i.k = e.dedup_key"""))
def alert_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Existing alerts of every second place, some closed, and one that no rule raises now."""
    t = Tables(spark, sf_dir)
    incoming = city_cluster(t, Settings())
    old = incoming.where("location_id % 2 = 0").withColumn("signal_count", F.lit(0).cast("long")).withColumn("status", F.expr("case when location_id % 3 = 0 then 'closed' else 'open' end"))
    gone = old.limit(1).withColumns({"dedup_key": F.lit("gone"), "location_id": F.lit(7).cast("long"), "status": F.lit("open")})
    return upsert_alerts(old.unionByName(gone), incoming).select("dedup_key", "status", "action", "signal_count")
