"""Country, provinces and cities of a map from one pass over the links, and the JSON documents that maps read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from epilens.functions.numeric import ladder, ratio2
from epilens.registry import query
from epilens.sources.adapter import Tables, r2, sql

#: What a map's choice of status means; anything else is approved.
CHOICES = {"approved": ["approved"], "validated": ["validated"], "all": ["validated", "approved"], "raw": ["raw", "validated", "approved"]}


def shown(signals: DataFrame, choice: str = "approved", disease: str = "", date_from: str = "", date_to: str = "", least: int | None = None) -> DataFrame:
    """Signals that a map shows; dates are UTC days and inclusive, empty filters filter nothing."""
    x = signals.where(F.col("status").isin(CHOICES.get(choice, CHOICES["approved"])))
    x = x.where(F.lower("disease_tag") == disease.lower()) if disease else x
    x = x.where(F.col("published_at") >= F.lit(date_from).cast("date")) if date_from else x
    x = x.where(F.col("published_at") < F.date_add(F.lit(date_to).cast("date"), 1)) if date_to else x
    return x if least is None else x.where(F.col("threat_score") >= least)


def regions(links: DataFrame, signals: DataFrame, places: DataFrame) -> DataFrame:
    """ROLLUP of links over province and city: level, ids, names, codes, and the numbers of both kinds of map.

    A region counts a signal once however many of its links lie in it (total_signals, high_risk_count); averages, maxima,
    links and high_links (scores above 50) are over links. Links to a province itself make a row of level `direct` beside its
    cities. The signal's first link of each region is marked while links lie with their signal, so that all three levels are
    sums of numbers, combined by hash before they are shuffled: no distinct counts, and nothing larger than the regions is
    shuffled after the links have met their signals. Names and codes are joined to the regions.
    """
    x = links.select("signal_id", "slot", "location_id", "level", "province_id").join(signals.select(F.col("id").alias("signal_id"), "threat_score", "is_high_risk"), "signal_id")
    x = x.withColumn("city_id", F.expr("if(level = 'province', null, location_id)"))
    keys = ["signal_id", "province_id", "city_id"]
    for k, name in enumerate(("country", "province", "city"), 1):
        first = F.row_number().over(Window.partitionBy(*keys[:k]).orderBy("slot", "location_id")) == 1
        x = x.withColumn(f"in_{name}", first)
    counts = [F.count_if(f"in_{n}").alias(f"n_{n}") for n in ("country", "province", "city")]
    high = [F.count_if(F.col(f"in_{n}") & F.col("is_high_risk")).alias(f"h_{n}") for n in ("country", "province", "city")]
    g = x.rollup("province_id", "city_id").agg(F.grouping_id().alias("g"), *counts, *high, F.count("*").alias("links"), F.count_if(F.col("threat_score") > 50).alias("high_links"), F.sum("threat_score").alias("s"), F.max("threat_score").alias("max_score"))
    g = g.join(places.select(F.col("id").alias("province_id"), F.col("name").alias("province"), "province_code"), "province_id", "left")
    g = g.join(places.select(F.col("id").alias("city_id"), F.col("name").alias("city"), "city_code"), "city_id", "left")
    level = ladder(("g = 3", "country"), ("g = 1", "province"), ("city_id is null", "direct"), default="city")
    pick = lambda c: ladder(("g = 3", F.col(f"{c}_country")), ("g = 1", F.col(f"{c}_province")), default=F.col(f"{c}_city"))
    return g.select(level.alias("level"), "province_id", "city_id", "province", "province_code", "city", "city_code", pick("n").alias("total_signals"), pick("h").alias("high_risk_count"), "links", "high_links", ratio2("s", "links").alias("avg_score"), "max_score")


def count_class(n: str) -> Column:
    return ladder(*((f"{n} >= {least}", c) for least, c in ((100, 6), (50, 5), (25, 4), (10, 3), (5, 2), (1, 1))), default=0)


def province_documents(levels: DataFrame) -> DataFrame:
    """province_id, document: a province's row with its cities' rows in it, most signals first, then by name.

    A document is as long as a province has cities. A province without direct links has its cities' sums all the same.
    """
    row = lambda name: [F.col(name).alias("name"), F.col("total_signals"), F.col("avg_score"), F.col("high_risk_count")]
    city = F.struct((-F.col("total_signals")).alias("o"), F.col("city").alias("n"), F.col("city_id"), F.struct(*row("city"), F.col("city_code"), count_class("total_signals").alias("count_class")).alias("row"))
    x = levels.where("level in ('province', 'city')")
    g = x.groupBy("province_id").agg(F.max(F.when(F.col("level") == "province", F.struct(*row("province")))).alias("own"), F.array_sort(F.collect_list(F.when(F.col("level") == "city", city))).alias("cities"))
    return g.select("province_id", F.to_json(F.struct("own.*", F.transform("cities", lambda c: c["row"]).alias("cities"))).alias("document"))


def thematic_document(levels: DataFrame, level: str = "province") -> DataFrame:
    """One document of all regions of a level that have a code: links, their average and high scores, most links first."""
    key = F.col("province_code" if level == "province" else "city_code")
    x = levels.where((F.col("level") == level) & (key != "")).groupBy(key.alias("region_key")).agg(F.sum("links").alias("n"), F.max("avg_score").alias("avg_score"), F.sum("high_links").alias("high"))
    row = F.struct("region_key", F.col("n").alias("signal_count"), "avg_score", F.col("high").alias("high_risk_count"))
    rows = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "region_key", row.alias("row"))))
    return x.agg(F.to_json(F.struct(F.transform(rows, lambda r: r["row"]).alias("results"))).alias("document"))


def city_list(places: DataFrame, province_code: str = "") -> DataFrame:
    """One document of the active cities and regencies, of one province if a code is given, by name."""
    x = places.where("level in ('city', 'regency') and is_active and not is_false_positive")
    x = x.where(F.col("province_code") == province_code) if province_code else x
    row = F.struct("id", "name", F.col("city_code").alias("city_regency_code"), "level", "province_code")
    rows = F.array_sort(F.collect_list(F.struct("name", "id", row.alias("row"))))
    return x.agg(F.to_json(F.struct(F.transform(rows, lambda r: r["row"]).alias("results"))).alias("document"))


def point_document(links: DataFrame, signals: DataFrame, places: DataFrame, titles: DataFrame, top: int = 2000) -> DataFrame:
    """One document of the newest points, as many as a map may ask for; titles and places are joined to those alone."""
    newest = ("published_at", "created_at")
    s = signals.select(F.col("id").alias("signal_id"), "disease_tag", "threat_score", "status", "geocode_status", "raw_location_text", "source_url", *newest)
    x = links.select("signal_id", "location_id", "slot").join(s, "signal_id").orderBy(*map(F.desc, newest), "signal_id", "slot").limit(top)
    x = x.join(places.where("lat is not null and lon is not null").select(F.col("id").alias("location_id"), F.round("lat", 4).alias("lat"), "lon", F.col("name").alias("location_name"), F.col("level").alias("location_level"), "province_code"), "location_id")
    x = x.join(titles.select(F.col("id").alias("signal_id"), "title"), "signal_id", "left")
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    row = F.struct(F.col("signal_id").alias("id"), text("title"), text("disease_tag"), "threat_score", "status", "geocode_status", text("raw_location_text"), F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss").alias("published_at"), text("source_url"), "lat", "lon", "location_name", "location_level", text("province_code"))
    order = [(-F.unix_micros(F.col(c).cast("timestamp"))).alias(c) for c in newest]
    rows = F.array_sort(F.collect_list(F.struct(*order, "signal_id", "slot", row.alias("row"))))
    return x.agg(F.to_json(F.struct(F.count("*").alias("count"), F.transform(rows, lambda r: r["row"]).alias("results"))).alias("document"))


def write_documents(rows: DataFrame, path: str, by: str | None = None) -> None:
    """Documents as text, one a line, in a folder for each value of `by` if that is given."""
    kept = rows.select("document", *([by] if by else []))
    (kept.write.partitionBy(by) if by else kept.write).mode("overwrite").text(path)


_LEVELS = ", v AS (SELECT * FROM signal WHERE status IN ({0})), x AS (SELECT prov.* EXCLUDE (province_code), (SELECT y.province_code FROM location y WHERE y.id = province_id) AS province_code, CASE WHEN level = 'province' THEN NULL ELSE location_id END AS city_id, v.id, threat_score, is_high_risk FROM prov JOIN v ON v.id = signal_id), g AS (SELECT province_id, city_id, GROUPING(province_id, city_id) AS g, max(province) AS p, max(province_code) AS pc, max(CASE WHEN city_id IS NOT NULL THEN place END) AS c, max(CASE WHEN city_id IS NOT NULL THEN city_code END) AS cc, count(DISTINCT id) AS total_signals, count(DISTINCT id) FILTER (WHERE is_high_risk) AS high_risk_count, count(*) AS links, count(*) FILTER (WHERE threat_score > 50) AS high_links, " + r2("sum(threat_score)", "count(*)") + " AS avg_score, max(threat_score) AS max_score FROM x GROUP BY ROLLUP (province_id, city_id)), lv AS (SELECT CASE WHEN g = 3 THEN 'country' WHEN g = 1 THEN 'province' WHEN city_id IS NULL THEN 'direct' ELSE 'city' END AS level, province_id, city_id, CASE WHEN g < 3 THEN p END AS province, CASE WHEN g < 3 THEN pc END AS province_code, CASE WHEN g = 0 THEN c END AS city, CASE WHEN g = 0 THEN cc END AS city_code, total_signals, high_risk_count, links, high_links, avg_score, max_score FROM g)"
_ALL = "'raw', 'validated', 'approved'"


def _levels(t: Tables, choice: str) -> DataFrame:
    return regions(t.promoted, shown(t.signal, choice), t.location)


@query(sql(_LEVELS.format(_ALL) + " SELECT * FROM lv"))
def map_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _levels(Tables(spark, sf_dir), "raw")


@query(sql(_LEVELS.format(_ALL) + """, c AS (SELECT province_id, to_json(list({'name': city, 'total_signals': total_signals, 'avg_score': avg_score, 'high_risk_count': high_risk_count, 'city_code': city_code, 'count_class': CASE WHEN total_signals >= 100 THEN 6 WHEN total_signals >= 50 THEN 5 WHEN total_signals >= 25 THEN 4 WHEN total_signals >= 10 THEN 3 WHEN total_signals >= 5 THEN 2 WHEN total_signals >= 1 THEN 1 ELSE 0 END} ORDER BY total_signals DESC, city, city_id)) AS j FROM lv WHERE level = 'city' GROUP BY 1)
SELECT province_id, left(h, length(h) - 1) || ',"cities":' || coalesce(j, '[]') || '}' AS document FROM (SELECT province_id, CAST(to_json({'name': province, 'total_signals': total_signals, 'avg_score': avg_score, 'high_risk_count': high_risk_count}) AS VARCHAR) AS h FROM lv WHERE level = 'province') LEFT JOIN c USING (province_id)"""))
def province_documents_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each province with its cities, from one roll-up."""
    return province_documents(_levels(Tables(spark, sf_dir), "raw"))


_THEMATIC = "SELECT '{0}' AS level, CAST(to_json({{'results': list({{'region_key': {0}_code, 'signal_count': links, 'avg_score': avg_score, 'high_risk_count': high_links}} ORDER BY links DESC, {0}_code)}}) AS VARCHAR) AS document FROM lv WHERE level = '{0}' AND {0}_code <> ''"


@query(sql(_LEVELS.format("'approved'") + " " + _THEMATIC.format("province") + " UNION ALL " + _THEMATIC.format("city")))
def thematic_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The thematic map's answers for provinces and for cities."""
    levels = _levels(Tables(spark, sf_dir), "approved")
    one = lambda level: thematic_document(levels, level).select(F.lit(level).alias("level"), "document")
    return one("province").unionByName(one("city"))


@query(sql("SELECT c AS chosen, CAST(to_json({'results': list({'id': id, 'name': name, 'city_regency_code': city_code, 'level': level, 'province_code': province_code} ORDER BY name, id)}) AS VARCHAR) AS document FROM location JOIN (VALUES (''), ('asia'), ('middle_east')) z(c) ON c = '' OR c = province_code WHERE level <> 'province' AND id NOT IN (23, 24) GROUP BY 1"))
def city_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The city list of all provinces and of two chosen ones."""
    places = Tables(spark, sf_dir).location
    one = lambda code: city_list(places, code).select(F.lit(code).alias("chosen"), "document")
    return one("").unionByName(one("asia")).unionByName(one("middle_east"))


@query(sql("""SELECT CAST(to_json({'count': count(*), 'results': list({'id': id, 'title': coalesce(title, ''), 'disease_tag': disease_tag, 'threat_score': threat_score, 'status': status, 'geocode_status': geocode_status, 'raw_location_text': raw_location_text, 'published_at': strftime(published_at, '%Y-%m-%dT%H:%M:%S'), 'source_url': source_url, 'lat': CAST(round(location_id * 0.5 - 10, 4) AS DOUBLE), 'lon': CAST(location_id + 95 AS DOUBLE), 'location_name': place, 'location_level': level, 'province_code': province_code} ORDER BY published_at DESC, created_at DESC, id, slot)}) AS VARCHAR) AS document
FROM (SELECT s.*, title, location_id, place, level, province_code, slot FROM (SELECT * EXCLUDE (created_at) FROM plink) k JOIN signal s ON s.id = signal_id LEFT JOIN article a ON a.id = s.id WHERE status IN ('validated', 'approved') AND threat_score >= 35 AND lower(disease_tag) = 'dbd' AND published_at >= DATE '2024-01-05' AND published_at < DATE '2024-01-26' ORDER BY published_at DESC, s.created_at DESC, s.id, slot LIMIT 2000)"""))
def point_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The map's points of one disease and three weeks, as the map asks for them."""
    t = Tables(spark, sf_dir)
    s = shown(t.signal, "all", "DBD", "2024-01-05", "2024-01-25", 35)
    return point_document(t.primary, s, t.location, t.article)
