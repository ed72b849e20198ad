"""Place candidates from texts, their confidence, query variants and manual placement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epilens.functions.numeric import clamp, ladder
from epilens.functions.text import first_of_each, starting, strip
from epilens.registry import query
from epilens.sources.adapter import Tables, sql

_NAME = r"[A-Z][A-Za-z0-9_-]+(?: [A-Z][A-Za-z0-9_-]+){0,4}"


def candidates(rows: DataFrame, text: str, lead: str = "di", kinds: tuple[str, ...] = ("Kota", "Kabupaten", "Provinsi")) -> DataFrame:
    """rows with names: capitalised names after the lead word or an administrative word, distinct in any case, in pattern order."""
    patterns = [rf"{starting(lead)} +({k} {_NAME})" for k in kinds[:2]] + [rf"{starting(lead)} +({_NAME})"] + [rf"({starting(k)} {_NAME})" for k in kinds]
    found = F.flatten(F.array(*[F.regexp_extract_all(F.col(text), F.lit(p), 1) for p in patterns]))
    items = F.filter(F.transform(found, lambda x: strip(x)), lambda x: F.length(x) >= 3)
    return first_of_each(rows, items, lambda x: F.lower(x), "names")


_CAND = "flatten([" + ", ".join(f"regexp_extract_all(text, '{p}', 1)" for p in [rf"(?:^|[^A-Za-z0-9_])the +({k} {_NAME})" for k in ("The", "Of")] + [rf"(?:^|[^A-Za-z0-9_])the +({_NAME})"] + [rf"(?:^|[^A-Za-z0-9_])({k} {_NAME})" for k in ("The", "Of", "And")]) + "])"


@query("WITH c AS (SELECT doc_id, list_filter(list_transform(" + _CAND + ", lambda x: trim(x)), lambda x: x <> '') AS c FROM documents), d AS (SELECT doc_id, list_filter(list_filter(c, lambda x, i: list_position(list_transform(c, lambda y: lower(y)), lower(x)) = i), lambda x: length(x) >= 3) AS c FROM c) SELECT doc_id, CAST(len(c) AS BIGINT) AS n, md5(array_to_string(c, '|')) AS digest FROM d")
def place_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With words of the test texts as lead and administrative words."""
    x = candidates(Tables(spark, sf_dir).texts("documents"), "text", "the", ("The", "Of", "And"))
    return x.select("doc_id", F.size("names").cast("long").alias("n"), F.md5(F.encode(F.array_join("names", "|"), "UTF-8")).alias("digest"))


def candidate_confidence(origin: str, is_alias: str, level: str) -> Column:
    """.96, .95 or .82 by origin, an alias +.01, a city or regency +.02, a province -.03; at most .99."""
    base = ladder((f"{origin} = 'raw'", 96), (f"{origin} = 'title'", 95), default=82)
    points = base + F.when(F.expr(is_alias), 1).otherwise(0) + ladder((f"{level} in ('city', 'regency')", 2), (f"{level} = 'province'", -3), default=0)
    return clamp(points, 0, 99) / 100


@query(sql(", x AS (SELECT l.signal_id, l.location_id, l.slot, CASE l.slot WHEN 1 THEN 96 WHEN 2 THEN 95 ELSE 82 END + CASE WHEN l.location_id % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN level = 'province' THEN -3 ELSE 2 END AS p FROM link l JOIN location ON location.id = l.location_id) SELECT signal_id, first(location_id ORDER BY least(99, p) DESC, slot) AS location_id, CAST(max(least(99, p)) AS DOUBLE) / 100 AS confidence FROM x GROUP BY 1"))
def best_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surest candidate place of each signal; the earliest of equals."""
    t = Tables(spark, sf_dir)
    x = t.link.join(t.location.select(F.col("id").alias("location_id"), "level"), "location_id").withColumn("origin", F.expr("case slot when 1 then 'raw' when 2 then 'title' else 'content' end"))
    x = x.withColumn("confidence", candidate_confidence("origin", "location_id % 2 = 0", "level"))
    best = x.groupBy("signal_id").agg(F.min_by(F.struct("location_id", "confidence"), F.struct(-F.col("confidence"), "slot")).alias("b"))
    return best.select("signal_id", F.col("b.location_id").alias("location_id"), F.col("b.confidence").alias("confidence"))


def query_variants(place: Column, province: Column, level: Column) -> Column:
    """Search forms of a place for a geocoder, most specific first, distinct."""
    country = F.lit(", Indonesia")
    own = F.when(level == "province", F.array(F.concat(F.lit("Provinsi "), place, country), F.concat(place, country))).otherwise(F.array(F.concat(place, F.lit(", "), province, country), F.concat(F.initcap(level), F.lit(" "), place, country), F.concat(place, country)))
    return F.array_distinct(own)


@query(sql("SELECT l.id, CASE WHEN l.level = 'province' THEN 'Provinsi ' || l.name || ', Indonesia|' || l.name || ', Indonesia' ELSE l.name || ', ' || p.name || ', Indonesia|' || CASE l.level WHEN 'city' THEN 'City ' ELSE 'Regency ' END || l.name || ', Indonesia|' || l.name || ', Indonesia' END AS variants FROM location l LEFT JOIN location p ON p.id = l.parent_id"))
def geocode_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = Tables(spark, sf_dir).location
    parents = places.select(F.col("id").alias("parent_id"), F.col("name").alias("province"))
    return places.join(parents, "parent_id", "left").select("id", F.array_join(query_variants(F.col("name"), F.coalesce("province", F.lit("")), F.col("level")), "|").alias("variants"))


@query(sql(", m AS (SELECT id AS signal_id, CASE WHEN id % 2 = 0 THEN id % 25 END AS city, 1000 + id % 5 AS province FROM signal WHERE id % 3 = 0) SELECT signal_id, CAST(coalesce(city, province) AS BIGINT) AS location_id, l.level AS location_level, CASE WHEN l.level = 'province' THEN l.name ELSE p.name END AS admin_province, CASE WHEN l.level = 'province' THEN '' ELSE l.name END AS admin_city, 'manual' AS geocode_status FROM m JOIN location l ON l.id = coalesce(city, province) LEFT JOIN location p ON p.id = l.parent_id"))
def manual_geocode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hand placement of every third signal: a city wins over a province, and the names follow."""
    t = Tables(spark, sf_dir)
    m = t.signal.where("id % 3 = 0").select(F.col("id").alias("signal_id"), F.expr("coalesce(if(id % 2 = 0, id % 25, null), 1000 + id % 5)").alias("location_id"))
    parents = t.location.select(F.col("id").alias("parent_id"), F.col("name").alias("parent"))
    place = t.location.select(F.col("id").alias("location_id"), "name", "level", "parent_id").join(parents, "parent_id", "left")
    x = m.join(place, "location_id")
    return x.select("signal_id", "location_id", F.col("level").alias("location_level"), F.expr("if(level = 'province', name, parent)").alias("admin_province"), F.expr("if(level = 'province', '', name)").alias("admin_city"), F.lit("manual").alias("geocode_status"))


@query(sql("SELECT p.id, p.name, count(DISTINCT c.id) AS cities, EXISTS (SELECT 1 FROM link WHERE location_id = p.id) AS linked, count(DISTINCT c.id) = 0 AND NOT EXISTS (SELECT 1 FROM link WHERE location_id = p.id) AS may_go FROM location p LEFT JOIN location c ON c.parent_id = p.id GROUP BY p.id, p.name"))
def guarded_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which places may be deleted: those that nothing refers to."""
    t = Tables(spark, sf_dir)
    children = t.location.where("parent_id is not null").groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("cities"))
    used = t.link.select(F.col("location_id").alias("id")).distinct().withColumn("u", F.lit(True))
    x = t.location.join(children, "id", "left").join(used, "id", "left").select("id", "name", F.coalesce("cities", F.lit(0)).alias("cities"), F.coalesce("u", F.lit(False)).alias("linked"))
    return x.withColumn("may_go", F.expr("cities = 0 and not linked"))
