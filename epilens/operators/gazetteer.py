"""Places: forms, aliases, the resolver ladder, phrase matching, validity and deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from epilens.functions.numeric import ladder
from epilens.functions.text import resolver_key, search_text, strip_admin
from epilens.operators.phraseindex import mentions
from epilens.registry import query
from epilens.sources.adapter import Tables, sql

# Words that are no places.
TOO_GENERAL = ["indonesia", "ri", "nusantara", "nasional", "global", "dunia", "asia", "eropa", "amerika", "afrika", "australia"]
JUNK = ["ini", "awal", "video", "update", "terbaru", "hari ini", "kemarin", "kemenkes", "kementerian", "pemerintah", "id", "co", "com"]
RISK_WORDS = ["kasus", "wabah", "meningkat", "waspada", "darurat", "kematian", "lonjakan", "suspek"]
#: Abbreviations of the test provinces.
PROVINCE_ALIASES = {"afr": "africa", "amr": "america", "asi": "asia", "eur": "europe", "mea": "middle_east"}


def aliases(places: DataFrame) -> DataFrame:
    """(place id, alias, normalised): the name, its bare and prefixed forms, distinct per place."""
    prefixes = F.when(F.col("level") == "province", F.array(F.lit("Provinsi "), F.lit("Prov. "))).when(F.col("level") == "city", F.array(F.lit("Kota "), F.lit("Kodya "))).otherwise(F.array(F.lit("Kabupaten "), F.lit("Kab. ")))
    forms = F.concat(F.array("name"), F.array(F.initcap(F.lower("name"))), F.transform(prefixes, lambda p: F.concat(p, "name")))
    rows = places.select(F.col("id").alias("location_id"), F.posexplode(forms).alias("pos", "alias")).withColumn("normalized", search_text(F.col("alias")))
    return rows.groupBy("location_id", "normalized").agg(F.min_by("alias", "pos").alias("alias"))


_FORMS = """, fr AS (SELECT id, unnest(CASE level WHEN 'province' THEN ['', 'Provinsi ', 'Prov. '] WHEN 'city' THEN ['', 'Kota ', 'Kodya '] ELSE ['', 'Kabupaten ', 'Kab. '] END) || name AS alias, name FROM location)"""


@query(sql(_FORMS + "SELECT id AS location_id, trim(regexp_replace(replace(lower(alias), '&', ' dan '), '[^a-z0-9]+', ' ', 'g')) AS normalized, alias FROM fr"))
def alias_generate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aliases(Tables(spark, sf_dir).location)


def forms(places: DataFrame) -> DataFrame:
    """(form, location_id, priority): forms of a place for text matching; city 4, regency 3, province 2."""
    rank = F.when(F.col("level") == "city", 4).when(F.col("level") == "regency", 3).otherwise(2)
    return aliases(places).join(places.select(F.col("id").alias("location_id"), rank.alias("priority")), "location_id").select("location_id", F.col("normalized").alias("form"), "priority")


@query(sql(_FORMS + "SELECT length(form) AS len, priority, count(*) AS n FROM (SELECT trim(regexp_replace(lower(alias), '[^a-z0-9]+', ' ', 'g')) AS form, CASE level WHEN 'city' THEN 4 WHEN 'regency' THEN 3 ELSE 2 END AS priority FROM fr JOIN location USING (id)) GROUP BY ALL"))
def gazetteer_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forms(Tables(spark, sf_dir).location).groupBy(F.length("form").cast("long").alias("len"), "priority").agg(F.count("*").alias("n"))


def resolve(texts: DataFrame, places: DataFrame, text: str = "raw") -> DataFrame:
    """texts with method, confidence and location_id: the first rung of the ladder that answers.

    province alias .95, normalised name .95, alias .93, explicit prefix .90, unique bare
    name .80, ambiguous .20, none 0, empty 0. Each rung is one equi-join with a table of
    a few rows per place; a false-positive place answers to a province alias only.
    """
    key = resolver_key(F.col(text))
    bare = resolver_key(strip_admin(F.col(text)))
    told = ladder((f"lower(ltrim({text})) like 'kota %' or lower(ltrim({text})) like 'kodya %'", "city"), (f"lower(ltrim({text})) like 'kab%'", "regency"), default="")
    x = texts.withColumns({"_key": key, "_bare": bare, "_level": told})
    good = places.where("is_active and not is_false_positive").select("id", "level", resolver_key(F.col("name")).alias("name_key"))
    abbreviation = F.create_map(*[F.lit(v) for kv in PROVINCE_ALIASES.items() for v in kv])
    provinces = places.where("level = 'province' and is_active").select(F.col("id").alias("r1"), resolver_key(F.col("name")).alias("_full"))
    x = x.withColumn("_full", abbreviation[F.col("_key")]).join(provinces, "_full", "left")
    names = good.groupBy(F.col("name_key").alias("_key")).agg(F.min("id").alias("r2"))
    x = x.join(names, "_key", "left")
    alias = aliases(places.where("is_active and not is_false_positive")).groupBy(F.regexp_replace("normalized", " ", "_").alias("_key")).agg(F.min("location_id").alias("r3"))
    x = x.join(alias, "_key", "left")
    level = good.groupBy(F.col("name_key").alias("_bare"), F.col("level").alias("_level")).agg(F.min("id").alias("r4"))
    x = x.join(level, ["_bare", "_level"], "left")
    generic = good.groupBy(F.col("name_key").alias("_bare")).agg(F.count("*").alias("_n"), F.min("id").alias("r5"))
    x = x.join(generic, "_bare", "left")
    rungs = [("_key = ''", "empty", 0.0, None), ("r1 is not null", "province_alias", 0.95, "r1"), ("r2 is not null", "name", 0.95, "r2"), ("r3 is not null", "alias", 0.93, "r3"), ("r4 is not null", "prefix", 0.90, "r4"), ("_n = 1", "generic", 0.80, "r5"), ("_n > 1", "ambiguous", 0.20, None)]
    pick = lambda k, none: ladder(*((r[0], F.expr(r[3]) if k == 3 and r[3] else (F.lit(None).cast("long") if k == 3 else r[k])) for r in rungs), default=none)
    return x.withColumns({"method": pick(1, "not_found"), "confidence": pick(2, 0.0), "location_id": pick(3, F.lit(None).cast("long"))}).drop("_key", "_bare", "_level", "_full", "_n", *[f"r{k}" for k in range(1, 6)])


#: Raw place texts for the test: the event's nation in one of eight spellings.
_RAW = "case event_id % 8 when 0 then '' when 1 then lower(name) when 2 then concat('Kota ', name) when 3 then concat('Kab. ', name) when 4 then concat('  ', initcap(name), ' ') when 5 then substring(lower(name), 1, 3) when 6 then 'afr' else concat('Provinsi ', name) end"


@query(sql(r""", e AS (SELECT event_id, CASE event_id % 8 WHEN 0 THEN '' WHEN 1 THEN lower(n_name) WHEN 2 THEN 'Kota ' || n_name WHEN 3 THEN 'Kab. ' || n_name WHEN 4 THEN '  ' || n_name || ' ' WHEN 5 THEN substr(lower(n_name), 1, 3) WHEN 6 THEN 'afr' ELSE 'Provinsi ' || n_name END AS raw FROM events JOIN nation ON n_nationkey = user_id % 25),
k AS (SELECT *, trim(regexp_replace(regexp_replace(lower(trim(raw)), '^provinsi ', ''), '[^a-z0-9]+', '_', 'g'), '_') AS key, trim(regexp_replace(regexp_replace(lower(trim(raw)), '^(kab\.|kota|provinsi) *', ''), '[^a-z0-9]+', '_', 'g'), '_') AS bare, CASE WHEN raw LIKE 'Kota %' THEN 'city' WHEN raw LIKE 'Kab%' THEN 'regency' ELSE '' END AS told FROM e),
g AS (SELECT id, level, trim(regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g'), '_') AS nk FROM location WHERE id NOT IN (23, 24)),
a AS (SELECT trim(regexp_replace(lower(pre || name), '[^a-z0-9]+', '_', 'g'), '_') AS ak, id FROM (SELECT id, name, unnest(CASE level WHEN 'province' THEN ['', 'Provinsi ', 'Prov. '] WHEN 'city' THEN ['', 'Kota ', 'Kodya '] ELSE ['', 'Kabupaten ', 'Kab. '] END) AS pre FROM location WHERE id NOT IN (23, 24))),
m AS (SELECT event_id, CASE WHEN key = '' THEN 'empty' WHEN key IN ('afr', 'amr', 'asi', 'eur', 'mea') THEN 'province_alias' WHEN key IN (SELECT nk FROM g) THEN 'name' WHEN key IN (SELECT ak FROM a) THEN 'alias' WHEN EXISTS (SELECT 1 FROM g WHERE nk = bare AND level = told) THEN 'prefix' WHEN (SELECT count(*) FROM g WHERE nk = bare) = 1 THEN 'generic' WHEN (SELECT count(*) FROM g WHERE nk = bare) > 1 THEN 'ambiguous' ELSE 'not_found' END AS method, key, bare, told FROM k)
SELECT event_id, method, CAST(CASE method WHEN 'province_alias' THEN 0.95 WHEN 'name' THEN 0.95 WHEN 'alias' THEN 0.93 WHEN 'prefix' THEN 0.9 WHEN 'generic' THEN 0.8 WHEN 'ambiguous' THEN 0.2 ELSE 0 END AS DOUBLE) AS confidence,
  CASE method WHEN 'province_alias' THEN (SELECT id FROM location WHERE level = 'province' AND province_code = CASE key WHEN 'afr' THEN 'africa' WHEN 'amr' THEN 'america' WHEN 'asi' THEN 'asia' WHEN 'eur' THEN 'europe' ELSE 'middle_east' END) WHEN 'name' THEN (SELECT min(id) FROM g WHERE nk = key) WHEN 'alias' THEN (SELECT min(id) FROM a WHERE ak = key) WHEN 'prefix' THEN (SELECT min(id) FROM g WHERE nk = bare AND level = told) WHEN 'generic' THEN (SELECT min(id) FROM g WHERE nk = bare) END AS location_id FROM m"""))
def resolve_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    nation = t.raw("nation").select(F.col("n_nationkey").cast("long").alias("nk"), F.col("n_name").alias("name"))
    raw = t.raw("events").withColumn("nk", F.col("user_id") % 25).join(nation, "nk").select("event_id", F.expr(_RAW).alias("raw"))
    return resolve(raw, t.location).select("event_id", "method", "confidence", "location_id")


def validity(c: str) -> Column:
    """EMPTY_LOC, SKIP_TOO_GENERAL, SKIP_NOISE or ''."""
    low = f"lower(trim({c}))"
    words = lambda w: ", ".join(f"'{x}'" for x in w)
    risk = " or ".join(f"contains({low}, '{w}')" for w in RISK_WORDS)
    return ladder((f"coalesce(trim({c}), '') = ''", "EMPTY_LOC"), (f"{low} in ({words(TOO_GENERAL)})", "SKIP_TOO_GENERAL"), (f"{low} in ({words(JUNK)}) or length({low}) < 4 or {risk}", "SKIP_NOISE"), (f"length({low}) - length(replace({low}, 'indonesia', '')) >= 18", "SKIP_TOO_GENERAL"), default="")


def geocode_status(c: str, confidence: str) -> Column:
    """The status without a network: why it was refused, too unsure, or placed by the gazetteer."""
    v = validity(c)
    return F.when(v != "", v).when(F.expr(f"{confidence} < 0.6"), "SKIP_LOW_CONF").otherwise("GAZETTEER_ONLY")


@query(sql(", x AS (SELECT id, confidence_score / 100.0 AS c, CASE id % 10 WHEN 0 THEN '' WHEN 1 THEN 'Indonesia' WHEN 2 THEN 'hari ini' WHEN 3 THEN 'abc' WHEN 4 THEN 'Kasus Baru' WHEN 5 THEN 'indonesia raya indonesia' ELSE raw_location_text END AS p FROM signal) SELECT st AS status, count(*) AS n FROM (SELECT CASE WHEN p = '' THEN 'EMPTY_LOC' WHEN lower(p) = 'indonesia' THEN 'SKIP_TOO_GENERAL' WHEN lower(p) = 'hari ini' OR length(p) < 4 OR contains(lower(p), 'kasus') THEN 'SKIP_NOISE' WHEN p = 'indonesia raya indonesia' THEN 'SKIP_TOO_GENERAL' WHEN c < 0.6 THEN 'SKIP_LOW_CONF' ELSE 'GAZETTEER_ONLY' END AS st FROM x) GROUP BY 1"))
def geocode_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.expr("case id % 10 when 0 then '' when 1 then 'Indonesia' when 2 then 'hari ini' when 3 then 'abc' when 4 then 'Kasus Baru' when 5 then 'indonesia raya indonesia' else raw_location_text end")
    s = Tables(spark, sf_dir).signal.select("id", (F.col("confidence_score") / 100).alias("c"), p.alias("p"))
    return s.groupBy(geocode_status("p", "c").alias("status")).agg(F.count("*").alias("n"))


def phrases(texts: DataFrame, forms_: DataFrame, key: str, text: str) -> DataFrame:
    """(key, form, location_id, priority, hits): forms that stand as whole words in the text."""
    counts = mentions(texts, forms_, key, text).groupBy(key, "form").agg(F.count("*").alias("hits"))
    return counts.join(forms_, "form").select(key, "form", "location_id", "priority", "hits")


#: Forms that occur in the test texts.
TEST_FORMS = [("apache license", 1, 4), ("the and", 2, 3), ("license", 3, 2), ("version 2", 4, 2), ("of the", 5, 3), ("scum", 6, 4)]


@query("WITH f(form, location_id, priority) AS (VALUES " + ", ".join(f"('{a}', {b}, {c})" for a, b, c in TEST_FORMS) + r"), d AS (SELECT doc_id, ' ' || replace(trim(regexp_replace(replace(lower(text), '&', ' dan '), '[^a-z0-9]+', ' ', 'g')), ' ', '  ') || ' ' AS x FROM documents), h AS (SELECT doc_id, form, location_id, priority, (length(x) - length(replace(x, ' ' || replace(form, ' ', '  ') || ' ', ''))) // (length(form) + 2 + length(form) - length(replace(form, ' ', ''))) AS hits FROM d, f) SELECT doc_id, form, CAST(location_id AS BIGINT) AS location_id, priority, CAST(hits AS BIGINT) AS hits FROM h WHERE hits > 0")
def place_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = spark.createDataFrame(TEST_FORMS, "form string, location_id long, priority int")
    return phrases(Tables(spark, sf_dir).texts("documents"), f, "doc_id", "text")


@query("WITH f(form, location_id, priority) AS (VALUES " + ", ".join(f"('{a}', {b}, {c})" for a, b, c in TEST_FORMS) + r"), d AS (SELECT doc_id, ' ' || trim(regexp_replace(replace(lower(text), '&', ' dan '), '[^a-z0-9]+', ' ', 'g')) || ' ' AS x FROM documents), h AS (SELECT * FROM d JOIN f ON contains(x, ' ' || form || ' ')) SELECT doc_id, CAST(arg_max(location_id, (priority, length(form), form)) AS BIGINT) AS location_id, CASE WHEN max(priority) >= 3 THEN 0.9 ELSE 0.75 END::DOUBLE AS confidence FROM h GROUP BY 1")
def extract_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best place of a text: higher level first, then the longer form; .90 for cities, .75 for provinces."""
    f = spark.createDataFrame(TEST_FORMS, "form string, location_id long, priority int")
    hits = phrases(Tables(spark, sf_dir).texts("documents"), f, "doc_id", "text")
    best = hits.groupBy("doc_id").agg(F.max(F.struct("priority", F.length("form").alias("n"), "form", "location_id")).alias("b"))
    return best.select("doc_id", F.col("b.location_id").alias("location_id"), F.when(F.col("b.priority") >= 3, 0.9).otherwise(0.75).alias("confidence"))


def dedupe_provinces(places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Keeper of each province, and all other places with their parent moved to its keeper.

    Copies share the code without underscores; the best has an underscore (10), no space
    (5), coordinates (3), and the smallest id among equals.
    """
    p = places.where("level = 'province'").withColumn("group", F.regexp_replace("province_code", "[^a-z0-9]", ""))
    score = F.when(F.contains("province_code", F.lit("_")), 10).otherwise(0) + F.when(~F.contains("province_code", F.lit(" ")), 5).otherwise(0) + F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), 3).otherwise(0)
    ranked = p.withColumn("score", score)
    keep = ranked.groupBy("group").agg(F.max_by("id", F.struct("score", -F.col("id"))).alias("keep_id"), F.count("*").alias("copies"))
    mapping = ranked.select("id", "group").join(keep, "group")
    moved = places.where("level <> 'province'").join(mapping.select(F.col("id").alias("parent_id"), "keep_id"), "parent_id", "left").withColumn("parent_id", F.coalesce("keep_id", "parent_id")).drop("keep_id")
    return mapping.select("id", "keep_id", "copies"), moved


@query(sql(", p AS (SELECT id, province_code, regexp_replace(province_code, '[^a-z0-9]', '', 'g') AS g, 3 AS geo FROM location WHERE level = 'province' UNION ALL SELECT id + 5000, replace(province_code, '_', ' '), regexp_replace(province_code, '[^a-z0-9]', '', 'g'), 0 FROM location WHERE level = 'province'), k AS (SELECT g, count(*) AS copies, first(id ORDER BY CASE WHEN contains(province_code, '_') THEN 10 ELSE 0 END + CASE WHEN contains(province_code, ' ') THEN 0 ELSE 5 END + geo DESC, id) AS keep_id FROM p GROUP BY 1) SELECT p.id, keep_id, copies FROM p JOIN k USING (g)"))
def province_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = Tables(spark, sf_dir).location
    copies = places.where("level = 'province'").withColumns({"id": F.col("id") + 5000, "province_code": F.replace("province_code", F.lit("_"), F.lit(" ")), "lat": F.lit(None).cast("double")})
    return dedupe_provinces(places.unionByName(copies))[0]
