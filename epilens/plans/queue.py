"""Work-queue lists, verified lists, geocode errors, signal briefs and alert centre levels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epilens.functions.numeric import ladder, ratio2
from epilens.operators.triage import PROBLEM
from epilens.registry import query
from epilens.sources.adapter import AS_OF, Tables, r2, sql

#: Sort keys a list may be asked for; anything else takes the first.
SORTS = {"newest": ["-published_at"], "score": ["-threat_score", "-published_at"], "confidence": ["-confidence_score", "-published_at"], "disease": ["disease_tag", "-threat_score"]}


def order_by(name: str) -> list:
    keys = SORTS.get(name, SORTS["newest"])
    return [F.desc(k[1:]) if k.startswith("-") else F.asc(k) for k in keys] + [F.asc("id")]


def search(t: Tables, signals: DataFrame, text: str = "", province_id: int | None = None) -> DataFrame:
    """Literal, case-free search over columns and linked places; the province filter is a semi join of its own.

    A signal may satisfy the two by different links.
    """
    if text:
        needle = F.lit(text.lower())
        own = F.lit(False)
        for c in ("disease_tag", "raw_location_text", "source_url", "status", "geocode_status"):
            own = own | F.contains(F.lower(c), needle)
        by_place = t.link.join(t.location.where(F.contains(F.lower("name"), needle)).select(F.col("id").alias("location_id")), "location_id").select(F.col("signal_id").alias("id")).distinct().withColumn("_found", F.lit(True))
        signals = signals.join(by_place, "id", "left").where(own | F.col("_found").isNotNull()).drop("_found")
    if province_id is not None:
        inside = t.link.join(t.location.where((F.col("id") == province_id) | (F.col("parent_id") == province_id)).select(F.col("id").alias("location_id")), "location_id")
        signals = signals.join(inside.select(F.col("signal_id").alias("id")), "id", "left_semi")
    return signals


def page(rows: DataFrame, number: int, size: int, order: list) -> DataFrame:
    """A page of rows; a number beyond the end gives the last page."""
    pages = max(1, -(-rows.count() // size))
    return rows.orderBy(*order).offset((min(max(1, number), pages) - 1) * size).limit(size)


_QUEUE = ", b AS (SELECT * FROM signal WHERE status IN ('raw', 'validated'))"


@query(sql(_QUEUE + ", f AS (SELECT * FROM b WHERE (contains(lower(disease_tag), 'ra') OR contains(lower(raw_location_text), 'ra') OR contains(source_url, 'ra') OR contains(status, 'ra') OR contains(lower(geocode_status), 'ra') OR EXISTS (SELECT 1 FROM link JOIN location p ON p.id = location_id WHERE signal_id = b.id AND contains(lower(p.name), 'ra'))) AND EXISTS (SELECT 1 FROM link JOIN location p ON p.id = location_id WHERE signal_id = b.id AND (p.id = 1003 OR p.parent_id = 1003))) SELECT id, disease_tag, threat_score, status FROM f ORDER BY threat_score DESC, published_at DESC, id LIMIT 25 OFFSET 25"))
def queue_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second page of a search by score."""
    t = Tables(spark, sf_dir)
    found = search(t, t.signal.where("status in ('raw', 'validated')"), "ra", 1003)
    return page(found, 2, 25, order_by("score")).select("id", "disease_tag", "threat_score", "status")


@query(sql(_QUEUE + ", n AS (SELECT count(*) AS c FROM b WHERE threat_score >= 70) SELECT id, threat_score FROM b, n WHERE threat_score >= 70 QUALIFY row_number() OVER (ORDER BY published_at DESC, id) > (c - 1) // 25 * 25"))
def queue_last_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page far beyond the end is the last one; an unknown sort key means newest first."""
    rows = Tables(spark, sf_dir).signal.where("status in ('raw', 'validated') and threat_score >= 70")
    return page(rows, 99_999, 25, order_by("no such key")).select("id", "threat_score")


@query(sql(", v AS (SELECT * FROM signal WHERE status IN ('validated', 'approved')) SELECT count(*) AS total, count(*) FILTER (WHERE status = 'approved') AS approved, count(*) FILTER (WHERE threat_score >= 70) AS high, count(DISTINCT nullif(lower(disease_tag), '')) AS diseases, count(*) FILTER (WHERE id IN (SELECT signal_id FROM plink)) AS placed, " + r2("sum(threat_score)", "count(*)") + " AS avg_score FROM v"))
def verified_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    v = t.signal.where("status in ('validated', 'approved')").join(t.primary.select(F.col("signal_id").alias("id")).distinct().withColumn("p", F.lit(True)), "id", "left")
    g = v.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "approved").alias("approved"), F.count_if(F.col("threat_score") >= 70).alias("high"), F.countDistinct(F.nullif(F.lower("disease_tag"), F.lit(""))).alias("diseases"), F.count("p").alias("placed"), F.sum("threat_score").alias("s"))
    return g.withColumn("avg_score", ratio2("s", "total")).drop("s")


@query(sql("SELECT geocode_status, count(*) AS n, count(*) FILTER (WHERE id NOT IN (SELECT signal_id FROM link)) AS without_link, count(*) FILTER (WHERE threat_score > 50) AS high FROM signal WHERE status <> 'noise' AND (geocode_status IN ('not_found', 'pending') OR id NOT IN (SELECT signal_id FROM link)) GROUP BY 1"))
def geocode_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals whose status or missing link asks for work."""
    t = Tables(spark, sf_dir)
    s = t.signal.where("status <> 'noise'").join(t.link.select(F.col("signal_id").alias("id")).distinct().withColumn("l", F.lit(True)), "id", "left")
    bad = s.where(F.col("geocode_status").isin(PROBLEM) | F.col("l").isNull())
    return bad.groupBy("geocode_status").agg(F.count("*").alias("n"), F.count_if(F.col("l").isNull()).alias("without_link"), F.count_if(F.col("threat_score") > 50).alias("high"))


_T = "TIMESTAMP '2024-01-31'"


@query(sql(f", a AS (SELECT id, lower(disease_tag) AS d, threat_score, published_at FROM signal WHERE threat_score >= 95 AND status IN ('validated', 'approved') AND disease_tag <> ''), fp AS (SELECT signal_id, first(location_id ORDER BY slot) AS place, first(coalesce(parent_id, location_id) ORDER BY slot) AS prov FROM plink GROUP BY 1), r AS (SELECT a.id, count(s.id) AS related FROM a JOIN fp ON fp.signal_id = a.id LEFT JOIN (SELECT DISTINCT x.id, lower(x.disease_tag) AS d, coalesce(parent_id, location_id) AS prov FROM signal x JOIN plink ON signal_id = x.id WHERE x.status <> 'noise' AND x.published_at >= {_T} - INTERVAL 7 DAY) s ON s.d = a.d AND s.prov = fp.prov AND s.id <> a.id GROUP BY 1) SELECT a.id, coalesce(related, 0) AS related, CASE WHEN threat_score >= 70 THEN 'HIGH' WHEN threat_score >= 50 THEN 'MEDIUM_HIGH' WHEN threat_score >= 35 THEN 'MEDIUM' ELSE 'LOW' END AS label, CASE WHEN threat_score >= 70 THEN 'HIGH_RISK' WHEN coalesce(related, 0) >= 3 THEN 'CLUSTERED' ELSE 'ROUTINE' END AS warning FROM a LEFT JOIN r USING (id)"))
def signal_brief(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals of 95 and more with the number of recent signals of their disease in the same province."""
    t = Tables(spark, sf_dir)
    a = t.signal.where("threat_score >= 95 and status in ('validated', 'approved') and disease_tag <> ''").select("id", F.lower("disease_tag").alias("d"), "threat_score")
    prov = F.coalesce("parent_id", "location_id")
    first = t.primary.groupBy(F.col("signal_id").alias("id")).agg(F.min_by(prov, "slot").alias("prov"))
    recent = t.signal.where(F.expr(f"status <> 'noise' and published_at >= timestamp_ntz'{AS_OF}' - interval 7 days")).select("id", F.lower("disease_tag").alias("d"))
    each = t.primary.select(F.col("signal_id").alias("id"), prov.alias("prov")).distinct().join(recent, "id")
    # Counts by disease and province, less the signal itself where it is one of them: no pairs.
    counts = each.groupBy("d", "prov").agg(F.count("*").alias("n"))
    own = each.select("id", "prov", F.lit(1).alias("self"))
    x = a.join(first, "id", "left").join(counts, ["d", "prov"], "left").join(own, ["id", "prov"], "left").withColumn("related", F.coalesce("n", F.lit(0)) - F.coalesce("self", F.lit(0)))
    label = ladder(("threat_score >= 70", "HIGH"), ("threat_score >= 50", "MEDIUM_HIGH"), ("threat_score >= 35", "MEDIUM"), default="LOW")
    return x.select("id", F.col("related").cast("long").alias("related"), label.alias("label"), ladder(("threat_score >= 70", "HIGH_RISK"), ("related >= 3", "CLUSTERED"), default="ROUTINE").alias("warning"))


@query(sql(", g AS (SELECT location_id, count(*) AS n, sum(threat_score) AS s, count(*) FILTER (WHERE threat_score >= 70) AS high FROM plink JOIN signal ON id = signal_id WHERE status IN ('validated', 'approved') AND published_at >= TIMESTAMP '2024-01-30' GROUP BY 1), a AS (SELECT *, " + r2("s", "n") + " AS avg_score FROM g) SELECT location_id, n, avg_score, CASE WHEN avg_score >= 70 OR n >= 10 THEN 'RED' WHEN avg_score >= 60 OR n >= 5 THEN 'ORANGE' WHEN avg_score >= 40 OR n >= 2 THEN 'YELLOW' ELSE 'GREEN' END AS list_level, CASE WHEN avg_score >= 70 OR n >= 10 OR high >= 3 THEN 'RED' WHEN avg_score >= 60 OR n >= 5 OR high >= 1 THEN 'ORANGE' WHEN avg_score >= 40 OR n >= 2 THEN 'YELLOW' ELSE 'GREEN' END AS detail_level FROM a"))
def alert_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of places over the last day as the alert list and the alert page show them."""
    t = Tables(spark, sf_dir)
    s = t.signal.where(F.expr(f"status in ('validated', 'approved') and published_at >= timestamp_ntz'{AS_OF}' - interval 1 day")).select("id", "threat_score")
    g = t.primary.join(s, F.col("signal_id") == F.col("id")).groupBy("location_id").agg(F.count("*").alias("n"), F.sum("threat_score").alias("s"), F.count_if(F.col("threat_score") >= 70).alias("high")).withColumn("avg_score", ratio2("s", "n"))
    levels = lambda a="false", b="false": ladder((f"avg_score >= 70 or n >= 10 or {a}", "RED"), (f"avg_score >= 60 or n >= 5 or {b}", "ORANGE"), ("avg_score >= 40 or n >= 2", "YELLOW"), default="GREEN")
    return g.select("location_id", "n", "avg_score", levels().alias("list_level"), levels("high >= 3", "high >= 1").alias("detail_level"))


@query(sql(", x AS (SELECT s.id, count(l.location_id) AS places, string_agg(p.name, '|' ORDER BY l.slot) AS names FROM signal s LEFT JOIN link l ON l.signal_id = s.id AND l.is_primary LEFT JOIN location p ON p.id = l.location_id GROUP BY 1) SELECT id, places, coalesce(names, '') AS names FROM x"))
def primary_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each signal with its primary places in order."""
    t = Tables(spark, sf_dir)
    nested = t.primary.groupBy(F.col("signal_id").alias("id")).agg(F.count("*").alias("places"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("slot", "place"))), lambda x: x["place"]), "|").alias("names"))
    return t.signal.select("id").join(nested, "id", "left").select("id", F.coalesce("places", F.lit(0)).alias("places"), F.coalesce("names", F.lit("")).alias("names"))


@query(sql(", u AS (SELECT *, row_number() OVER (PARTITION BY source_url ORDER BY published_at DESC, id DESC) AS k, count(*) OVER (PARTITION BY source_url) AS c FROM signal WHERE source_url <> '') SELECT id, source_url, c AS copies FROM u WHERE k = 1"))
def latest_by_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest signal of each URL and how many share it."""
    s = Tables(spark, sf_dir).signal.where("source_url <> ''")
    return s.groupBy("source_url").agg(F.max_by("id", F.struct("published_at", "id")).alias("id"), F.count("*").alias("copies")).select("id", "source_url", "copies")
