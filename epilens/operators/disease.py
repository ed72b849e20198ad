"""Matching signals to the disease catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from epilens.functions.text import listed, region_code, squeeze
from epilens.operators.phraseindex import needles_in
from epilens.registry import query
from epilens.sources.adapter import Tables
from epilens.sources.files import folder
from epilens.sources.masterdata import CATALOGUE_SQL, catalogue


def needles(catalogue: DataFrame) -> DataFrame:
    """(disease id, name, place in list, needle): name first, then the listed aliases and keywords, in order; of active diseases."""
    lists = [c for c in ("aliases", "keyword_id", "keyword_en") if c in catalogue.columns]
    values = F.concat(F.array(F.col("name")), *[listed(F.coalesce(c, F.lit(""))) for c in lists])
    active = catalogue.where("is_active") if "is_active" in catalogue.columns else catalogue
    return active.select("id", "name", F.posexplode(values).alias("pos", "needle")).withColumn("needle", F.lower(F.trim("needle")))


def match(signals: DataFrame, catalogue: DataFrame, key: str, tag: str = "disease_tag", text: str = "text") -> DataFrame:
    """signals with disease_id and how: exact name, equal alias, or the longest needle in the text.

    A name or alias equal to the tag wins at once, diseases in name order; among substrings the longest wins, the first of
    equals. Tags meet codes by equi-joins; needles are found by `needles_in`. `key` names a signal.
    """
    n = needles(catalogue).where("needle <> ''").withColumn("code", region_code(F.col("needle")))
    first = lambda rows, name: rows.where("code <> ''").groupBy(F.col("code").alias("_code")).agg(F.min_by("id", F.struct("name", "pos")).alias(name))
    found = needles_in(signals, n, key, F.concat_ws(" ", tag, text))
    order = F.struct((-F.length("needle")).alias("n"), "name", "pos")
    found = found.join(n, "needle").groupBy(key).agg(F.min_by("id", order).alias("_found"))
    x = signals.withColumn("_code", region_code(F.col(tag)))
    x = x.join(first(n.where("pos = 0"), "_exact"), "_code", "left").join(first(n, "_alias"), "_code", "left").join(found, key, "left")
    how = F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_alias").isNotNull(), "alias").when(F.col("_found").isNotNull(), "text").otherwise("none")
    return x.withColumns({"disease_id": F.coalesce("_exact", "_alias", "_found"), "how": how}).drop("_code", "_exact", "_alias", "_found")


#: A catalogue whose needles occur in the test texts.
TEST_ROWS = [(1, "Stupid", "idiot;scum"), (2, "Loser", "trash,worthless\nclown"), (3, "Moron", "pathetic"), (4, "Token", "licen;# ;License, Version 2;. #"), (5, "Zulu", "the the;of")]
_CAT = "c(id, name, needle, o) AS (VALUES (1, 'Stupid', 'stupid', 6), (1, 'Stupid', 'idiot', 7), (1, 'Stupid', 'scum', 8), (2, 'Loser', 'loser', 1), (2, 'Loser', 'trash', 2), (2, 'Loser', 'worthless', 3), (2, 'Loser', 'clown', 4), (3, 'Moron', 'moron', 4.5), (3, 'Moron', 'pathetic', 5), (4, 'Token', 'token', 9), (4, 'Token', 'licen', 10), (4, 'Token', '#', 11), (4, 'Token', 'license', 12), (4, 'Token', 'version 2', 13), (4, 'Token', '. #', 14), (5, 'Zulu', 'zulu', 15), (5, 'Zulu', 'the the', 16), (5, 'Zulu', 'of', 17))"


@query("WITH " + _CAT + ", d AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'Moron' WHEN doc_id % 7 = 1 THEN 'CLOWN' ELSE '' END AS tag, text FROM documents), m AS (SELECT doc_id, CASE WHEN tag = 'Moron' THEN 3 WHEN tag = 'CLOWN' THEN 2 ELSE (SELECT first(id ORDER BY length(needle) DESC, o) FROM c WHERE contains(lower(text), needle)) END AS did, CASE WHEN tag = 'Moron' THEN 'exact' WHEN tag = 'CLOWN' THEN 'alias' END AS h FROM d) SELECT doc_id, CAST(did AS BIGINT) AS disease_id, coalesce(h, CASE WHEN did IS NULL THEN 'none' ELSE 'text' END) AS how FROM m")
def disease_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    docs = t.raw("documents").withColumn("disease_tag", F.expr("case doc_id % 7 when 0 then 'Moron' when 1 then 'CLOWN' else '' end"))
    return match(docs, spark.createDataFrame(TEST_ROWS, "id long, name string, aliases string"), "doc_id").select("doc_id", "disease_id", "how")


def crawl_queries(rows: DataFrame, per_disease: int = 4) -> DataFrame:
    """name, term, k: search terms of active diseases, aliases and keywords, else the name; at most per_disease each.

    In name order each disease takes its first terms that none before it took, in any case; a term beyond its share stays
    free. Found in rounds: a disease takes what no earlier one took in the round before, until a round changes nothing. After
    r rounds the first r diseases are right, but a round is only needed where a term passes on, so a few do. Rows without a
    name are passed over; names are unique.
    """
    spark = rows.sparkSession
    listing = F.concat(*[listed(F.coalesce(c, F.lit(""))) for c in ("aliases", "keyword_id", "keyword_en")])
    terms = F.when(F.size(listing) > 0, listing).otherwise(F.array("name"))
    x = rows.where("is_active and name is not null").select("name", F.posexplode(F.transform(terms, squeeze)).alias("pos", "term")).where("term <> ''").withColumn("folded", F.lower("term"))
    x = x.groupBy("name", "folded").agg(F.min(F.struct("pos", "term")).alias("t")).select("name", "folded", "t.*")
    path, number, before = folder(spark), 0, None
    x.write.parquet(f"{path}/terms")
    x = spark.read.parquet(f"{path}/terms")
    share = F.row_number().over(Window.partitionBy("name").orderBy("pos"))
    while True:
        free = x
        if number:
            first = spark.read.parquet(f"{path}/{number - 1}").groupBy("folded").agg(F.min("name").alias("by"))
            free = x.join(first, "folded", "left").where("by is null or by >= name").drop("by")
        free.withColumn("k", share).where(F.col("k") <= per_disease).write.parquet(f"{path}/{number}")
        taken = spark.read.parquet(f"{path}/{number}")
        now = taken.agg(F.count("*"), F.sum(F.xxhash64("name", "folded").cast("decimal(38,0)"))).first()
        if now == before:
            return taken.select("name", "term", F.col("k").cast("long").alias("k"))
        number, before = number + 1, now


_TERMS = CATALOGUE_SQL + """, a0 AS (SELECT name, list_filter(list_transform(string_split(replace(replace(aliases || ',' || keyword_id || ',' || keyword_en, ';', ','), chr(10), ','), ','), lambda x: trim(regexp_replace(x, '[ ]+', ' ', 'g'))), lambda x: x <> '') AS l FROM c WHERE is_active),
a1 AS (SELECT name, CASE WHEN len(l) > 0 THEN l ELSE [name] END AS l FROM a0), a2 AS (SELECT name, unnest(l) AS term, generate_subscripts(l, 1) AS pos FROM a1), x AS MATERIALIZED (SELECT name, lower(term) AS folded, min(pos) AS pos, arg_min(term, pos) AS term FROM a2 GROUP BY ALL)"""
#: Rounds that the SQL unrolls: more than the test tables need.
_ROUNDS = 12


def _rounds() -> str:
    first = ", r0 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY name ORDER BY pos) AS k FROM x QUALIFY k <= 4)"
    step = ", r{1} AS MATERIALIZED (SELECT x.*, row_number() OVER (PARTITION BY x.name ORDER BY pos) AS k FROM x LEFT JOIN (SELECT folded, min(name) AS first FROM r{0} GROUP BY 1) USING (folded) WHERE first IS NULL OR first >= x.name QUALIFY k <= 4)"
    return first + "".join(step.format(i, i + 1) for i in range(_ROUNDS))


@query(_TERMS + _rounds() + f" SELECT name, term, k FROM r{_ROUNDS}")
def disease_crawl_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl_queries(catalogue(Tables(spark, sf_dir)))


@query("WITH RECURSIVE " + CATALOGUE_SQL[len("WITH "):] + """, n0 AS (SELECT name, list_concat([name], list_filter(list_transform(string_split(replace(replace(aliases || ',' || keyword_id || ',' || keyword_en, ';', ','), chr(10), ','), ','), lambda x: trim(x)), lambda x: x <> '')) AS l FROM c WHERE is_active AND (change IN ('created', 'updated') OR aliases = '')),
n AS MATERIALIZED (SELECT name, pos, lower(trim(needle)) AS needle FROM (SELECT name, unnest(l) AS needle, generate_subscripts(l, 1) AS pos FROM n0)),
d AS (SELECT doc_id, lower(text) AS h, CASE doc_id % 4 WHEN 0 THEN ' dbd' WHEN 1 THEN 'campak ' WHEN 2 THEN 'MERS-CoV' ELSE '' END AS tag, CASE doc_id % 5 WHEN 0 THEN ' kasus gigitan anthrax dan flu' WHEN 1 THEN ' Ebola Virus Disease' ELSE '' END AS more FROM documents),
b AS (SELECT doc_id, first(name ORDER BY length(needle) DESC, name, pos) AS name FROM d JOIN n ON contains(lower(concat_ws(' ', tag, coalesce(h, '') || more)), needle) GROUP BY 1)
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Demam Dengue' WHEN 1 THEN 'Campak' WHEN 2 THEN 'MERS-CoV' ELSE b.name END AS disease, CASE doc_id % 4 WHEN 0 THEN 'alias' WHEN 1 THEN 'exact' WHEN 2 THEN 'exact' ELSE CASE WHEN b.name IS NULL THEN 'none' ELSE 'text' END END AS how FROM d LEFT JOIN b USING (doc_id)""")
def seed_disease_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents matched to the seeded catalogue, without the parts that have aliases; most carry a tag, some a disease's name."""
    t = Tables(spark, sf_dir)
    rows = catalogue(t).where("change in ('created', 'updated') or aliases = ''").withColumn("id", F.col("name"))
    tag = "case doc_id % 4 when 0 then ' dbd' when 1 then 'campak ' when 2 then 'MERS-CoV' else '' end"
    text = "concat(coalesce(text, ''), case doc_id % 5 when 0 then ' kasus gigitan anthrax dan flu' when 1 then ' Ebola Virus Disease' else '' end)"
    docs = t.texts("documents").select("doc_id", F.expr(tag).alias("disease_tag"), F.expr(text).alias("text"))
    return match(docs, rows, "doc_id").select("doc_id", F.col("disease_id").alias("disease"), "how")


#: The labels of a disease, and when it has them, in order.
LABELS = [("skdr_priority", "SKDR Priority"), ("report_24h", "Immediate 24h"), ("emerging_watchlist", "Emerging"), ("reemerging_watch", "Re-emerging Watch"), ("alert_rule = 'unknown_cluster' or disease_type = 'unknown_cluster'", "Unknown Cluster")]


@query(CATALOGUE_SQL + "SELECT name, concat_ws('|', " + ", ".join(f"CASE WHEN {c} THEN '{v}' END" for c, v in LABELS) + ") AS labels FROM c")
def disease_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue(Tables(spark, sf_dir)).select("name", F.concat_ws("|", *[F.when(F.expr(c), F.lit(v)) for c, v in LABELS]).alias("labels"))
