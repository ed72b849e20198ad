"""File sources and sinks: crawl CSV, GeoJSON places, feed XML, dates."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epilens.functions.text import truncate
from epilens.registry import query
from epilens.sources.adapter import Tables, sql

#: Crawl columns and the spellings they may have. Fixed values.
COLUMNS = {"title": ["judul", "title"], "source": ["sumber", "source"], "published": ["tanggal", "published_at"], "url": ["final_url", "link", "url"], "score": ["skor_ancaman", "threat_score"], "disease": ["penyakit_tag", "disease_tag"]}


def folder(spark: SparkSession) -> str:
    """A new folder that all executors share: below spark.checkpoint.dir, else the warehouse, else (local master) a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = f"file://{tempfile.mkdtemp(prefix='epilens-')}" if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master) else spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/files-{uuid.uuid4().hex}"


def first_of(names: list[str], have: list[str]) -> Column:
    """The first non-empty of the columns that exist; '' if there is none."""
    found = [F.nullif(F.trim(F.col(n)), F.lit("")) for n in names if n in have]
    return F.coalesce(*found, F.lit("")) if found else F.lit("")


def read_crawl_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a crawl file under canonical names; rows without title or url go. All columns are read as text."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    rows = raw.select(*[first_of(names, raw.columns).alias(k) for k, names in COLUMNS.items()])
    return rows.where("title <> '' and url <> ''").withColumn("score", F.expr("cast(coalesce(try_cast(score as double), 0) as int)")).withColumn("published_at", parse_instant(F.col("published")))


def parse_instant(c: Column) -> Column:
    """RFC 2822 or ISO time in UTC; null if it is neither."""
    rfc = F.try_to_timestamp(F.regexp_replace(c, r"^[A-Za-z]{3},\s*", ""), F.lit("d MMM yyyy HH:mm:ss z"))
    return F.coalesce(rfc, F.try_to_timestamp(c)).cast("timestamp_ntz")


def map_ready(rows: DataFrame) -> DataFrame:
    """The crawl rows that a map can show."""
    return rows.where("geocode_status in ('OK', 'ok') and confidence >= 0.75 and level in ('province', 'city', 'regency') and lat is not null and lon is not null")


@query(sql("SELECT id, disease_tag AS disease, threat_score AS score, CASE WHEN id % 2 = 0 THEN date_trunc('second', published_at) ELSE published_at END AS published_at, CASE WHEN id % 2 = 0 THEN 'tanggal' ELSE 'iso' END AS form FROM signal WHERE source_url <> ''"))
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals written as a crawl CSV with RFC 2822 and ISO dates, and read back."""
    s = Tables(spark, sf_dir).signal
    stamp = F.col("published_at").cast("timestamp")
    date = F.when(F.col("id") % 2 == 0, F.date_format(stamp, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")).otherwise(F.date_format(stamp, "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    path = folder(spark)
    s.select(F.concat(F.lit('say "hi", '), "id").alias("judul"), date.alias("tanggal"), F.col("threat_score").cast("double").cast("string").alias("skor_ancaman"), F.col("disease_tag").alias("penyakit_tag"), F.col("source_url").alias("link")).write.option("header", True).option("escape", '"').csv(path)
    back = read_crawl_csv(spark, path)
    key = F.regexp_extract("title", "([0-9]+)$", 1).cast("long")
    return back.select(key.alias("id"), "disease", "score", "published_at", F.when(key % 2 == 0, "tanggal").otherwise("iso").alias("form"))


def read_geojson(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One row per feature: name, level, province and the mean vertex of the outer ring; lines: a collection on each line."""
    ring = "array<array<array<double>>>"
    raw = spark.read.schema(f"type string, features array<struct<properties: map<string,string>, geometry: struct<type: string, coordinates: {ring}>>>").option("multiLine", not lines).json(path)
    f = raw.select(F.explode("features").alias("f")).select("f.properties", "f.geometry")
    p = lambda *names: F.coalesce(*[F.nullif(F.trim(F.col("properties")[n]), F.lit("")) for n in names], F.lit(""))
    outer = F.col("geometry.coordinates")[0]
    mean = lambda k: F.aggregate(F.transform(outer, lambda v: v[k]), F.lit(0.0), lambda a, x: a + x) / F.size(outer)
    level = F.when(F.lower(p("level")) != "", F.lower(p("level"))).when(F.lower(p("name")).startswith("kota "), "city").otherwise("regency")
    return f.select(p("display_name", "name", "WADMKK").alias("name"), level.alias("level"), p("province_name", "WADMPR").alias("province"), F.round(mean(1), 6).alias("lat"), F.round(mean(0), 6).alias("lon"))


@query(sql("SELECT name, level, province_code AS province, round((id * 0.5 - 10) + 0.5, 6) AS lat, round((id + 95) + 0.5, 6) AS lon FROM location"))
def geojson_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places written as squares in GeoJSON, read back to their mean vertex."""
    t = Tables(spark, sf_dir)
    x, y = F.col("lon"), F.col("lat")
    corners = F.array(*[F.array(x + a, y + b) for a, b in ((0, 0), (1, 0), (1, 1), (0, 1))])
    feature = F.struct(F.create_map(F.lit("name"), F.col("name"), F.lit("level"), F.col("level"), F.lit("province_name"), F.col("province_code")).alias("properties"), F.struct(F.lit("Polygon").alias("type"), F.array(corners).alias("coordinates")).alias("geometry"))
    path = folder(spark)
    t.location.select(F.lit("FeatureCollection").alias("type"), F.array(feature).alias("features")).write.json(path)
    return read_geojson(spark, path, lines=True)


@query("SELECT page_id, title, length(title) AS n FROM (SELECT min(page_id) AS page_id, substr(trim(regexp_extract(html, '<title>([^<&]*)', 1)), 1, 220) AS title FROM pages GROUP BY title)")
def feed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of pages written as feed items in XML, read back; one item for each title."""
    pages = Tables(spark, sf_dir).raw("pages").select("page_id", F.trim(F.regexp_extract("html", "<title>([^<&]*)", 1)).alias("title"))
    path = folder(spark)
    pages.write.format("xml").option("rowTag", "item").option("rootTag", "channel").save(path)
    back = spark.read.format("xml").schema("page_id long, title string").option("rowTag", "item").load(path)
    items = back.withColumn("title", F.substring(F.coalesce("title", F.lit("")), 1, 220))
    return items.groupBy("title").agg(F.min("page_id").alias("page_id")).select("page_id", "title", F.length("title").cast("long").alias("n"))


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """Feed entries by (title, link), the first by position: title, link, summary without tags, published_at; entries without title or link go.

    Titles are cut at 220 characters and summaries at 320, as `truncate` does; titles that are equal once cut are one.
    """
    back = spark.read.format("xml").schema("position long, title string, link string, description string, pubDate string").option("rowTag", "item").load(path)
    squeezed = lambda c: F.trim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"[ \t\n\x0B\f\r]+", " "))
    items = back.select("position", truncate(squeezed("title"), 220).alias("title"), squeezed("link").alias("link"), truncate(F.trim(F.regexp_replace(squeezed("description"), "<[^>]*>", "")), 320).alias("summary"), parse_instant(F.col("pubDate")).alias("published_at"))
    return items.where("title <> '' and link <> ''").groupBy("title", "link").agg(F.min_by(F.struct("summary", "published_at"), "position").alias("e")).select("title", "link", "e.*")


@query(sql("SELECT 'T ' || id // 4 AS title, 'https://f.example/' || id // 2 AS link, arg_min(replace('about ' || disease_tag || ' & more', '  ', ' '), id) AS summary, arg_min(date_trunc('second', published_at), id) AS published_at FROM signal WHERE id % 10 <> 7 GROUP BY 1, 2"))
def feed_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals written as feed entries with markup, some of them twice, some without a link, and read back."""
    s = Tables(spark, sf_dir).signal
    date = F.date_format(F.col("published_at").cast("timestamp"), "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    path = folder(spark)
    text = F.concat(F.lit("<p>about  "), "disease_tag", F.lit(" & <b>more</b></p>"))
    s.select(F.col("id").alias("position"), F.concat(F.lit("T  "), F.expr("id div 4")).alias("title"), F.expr("if(id % 10 = 7, ' ', concat('https://f.example/', id div 2))").alias("link"), text.alias("description"), date.alias("pubDate")).write.format("xml").option("rowTag", "item").option("rootTag", "channel").save(path)
    return read_feed(spark, path)


def read_gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """(name, level, province, alias): one row for each alias of a gazetteer file, whose aliases are parted by bars; a place without any keeps a row."""
    raw = spark.read.option("header", True).schema("name string, level string, province string, aliases string").csv(path)
    clean = F.array_distinct(F.filter(F.transform(F.split(F.coalesce("aliases", F.lit("")), "[|]"), lambda a: F.trim(a)), lambda a: a != ""))
    return raw.where("trim(name) <> ''").select(F.trim("name").alias("name"), F.lower(F.trim("level")).alias("level"), F.coalesce(F.trim("province"), F.lit("")).alias("province"), F.explode_outer(clean).alias("alias"))


@query(sql("SELECT name, level, CASE WHEN level = 'province' THEN '' ELSE province_code END AS province, CASE WHEN id % 4 = 3 THEN NULL ELSE a END AS alias FROM location, LATERAL (SELECT unnest(CASE WHEN id % 4 = 3 THEN [''] ELSE ['A ' || id, 'B, ' || name] END) AS a)"))
def gazetteer_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Tables(spark, sf_dir).location
    joined = F.expr("if(id % 4 = 3, '', concat('A ', id, ' || B, ', name, '|A ', id))")
    path = folder(spark)
    p.select(F.concat(F.lit(" "), "name").alias("name"), F.upper("level").alias("level"), F.expr("if(level = 'province', '', province_code)").alias("province"), joined.alias("aliases")).write.option("header", True).csv(path)
    return read_gazetteer(spark, path)


#: Columns of the signals' CSV export, in order. Fixed values.
EXPORT = ["id", "title", "disease_tag", "threat_score", "confidence_score", "status", "geocode_status", "raw_location_text", "source_url", "published_at", "published_day"]


def export_csv(rows: DataFrame, path: str) -> None:
    """Writes the export columns as CSV: ISO times, days as day/month/year, nulls empty, quotes doubled."""
    at = F.col("published_at")
    out = rows.withColumns({"published_day": F.date_format(at, "dd/MM/yyyy"), "published_at": F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")})
    out.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in EXPORT]).write.option("header", True).option("escape", '"').option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


@query(sql("SELECT CAST(id AS VARCHAR) AS id, md5(title) AS title, disease_tag, CAST(threat_score AS VARCHAR) AS threat_score, CAST(confidence_score AS VARCHAR) AS confidence_score, status, geocode_status, raw_location_text, source_url, strftime(published_at, '%Y-%m-%dT%H:%M:%S') AS published_at, strftime(published_at, '%d/%m/%Y') AS published_day FROM signal JOIN article USING (id)"))
def export_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The export of all signals, read back as text."""
    t = Tables(spark, sf_dir)
    path = folder(spark)
    export_csv(t.signal.join(t.article.select("id", "title"), "id"), path)
    back = spark.read.schema(", ".join(f"{c} string" for c in EXPORT)).option("header", True).option("multiLine", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("emptyValue", "").csv(path)
    empty = [F.coalesce(c, F.lit("")).alias(c) for c in EXPORT if c != "title"]
    return back.select(F.md5(F.encode(F.coalesce("title", F.lit("")), "UTF-8")).alias("title"), *empty)


@query(sql("SELECT s.id, p.name, p.level FROM signal s JOIN plink l ON l.signal_id = s.id AND l.slot = 1 JOIN location p ON p.id = l.location_id WHERE lower(geocode_status) = 'ok' AND confidence_score >= 75 AND p.id % 6 <> 0"))
def map_ready_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawl rows that a map can show: placed, sure, with coordinates."""
    t = Tables(spark, sf_dir)
    place = t.location.select(F.col("id").alias("location_id"), "name", "level", F.expr("if(id % 6 = 0, null, lat)").alias("lat"), "lon")
    first = t.link.where("is_primary and slot = 1").join(place, "location_id").select(F.col("signal_id").alias("id"), "name", "level", "lat", "lon")
    rows = t.signal.select("id", "geocode_status", (F.col("confidence_score") / 100).alias("confidence")).join(first, "id")
    return map_ready(rows).select("id", "name", "level")
