"""Engine tables from the star-schema and event tables.

Events stand in for signals, nations and regions for places, documents for
article texts. Every rule is a function of the row: no clock, no randomness.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The instant that queries on the test tables take as now.
AS_OF = "2024-01-31 00:00:00"
LOCAL = "INTERVAL 7 HOURS"


class Tables:
    """The engine's tables over one folder; each is a lazy plan."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def texts(self, name: str) -> DataFrame:
        """raw, dealt over the cluster's cores where its files make fewer tasks than that: for queries that work long on each text."""
        df, cores = self.raw(name), self.spark.sparkContext.defaultParallelism
        return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df

    @cached_property
    def location(self) -> DataFrame:
        """Provinces from regions and cities or regencies from nations: at most a few thousand rows in any gazetteer."""
        code = lambda c: F.regexp_replace(F.lower(F.trim(c)), r"[\s-]+", "_")
        region, nation = self.raw("region"), self.raw("nation")
        provinces = region.select(
            (F.col("r_regionkey") + 1000).cast("long").alias("id"), F.col("r_name").alias("name"), F.lit("province").alias("level"), F.lit(None).cast("long").alias("parent_id"), code("r_name").alias("province_code"), F.lit("").alias("city_code")
        )
        cities = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
            F.col("n_nationkey").cast("long").alias("id"),
            F.col("n_name").alias("name"),
            F.when(F.col("n_nationkey") % 2 == 0, "city").otherwise("regency").alias("level"),
            (F.col("n_regionkey") + 1000).cast("long").alias("parent_id"),
            code("r_name").alias("province_code"),
            code("n_name").alias("city_code"),
        )
        both = provinces.unionByName(cities)
        return both.withColumns({"lat": F.col("id") * 0.5 - 10, "lon": F.col("id") + 95.0, "is_active": F.col("id") != 24, "is_false_positive": F.col("id") == 23})

    @cached_property
    def disease(self) -> DataFrame:
        rows = [
            (1, "DBD", "demam berdarah,dengue", "trend_based", "endemic", True, False, False, False),
            (2, "Campak", "measles;morbili", "reemerging", "reemerging", True, False, False, True),
            (3, "Rabies", "anjing gila\nrabies klinis", "immediate", "zoonosis", True, True, False, False),
            (4, "Antraks", "anthrax", "novelty", "emerging", True, False, True, False),
            (5, "Klaster Tidak Dikenal", "misterius", "unknown_cluster", "unknown_cluster", False, False, False, False),
        ]
        return self.spark.createDataFrame(rows, "id long, name string, aliases string, alert_rule string, disease_type string, skdr_priority boolean, report_24h boolean, emerging_watchlist boolean, reemerging_watch boolean")

    @cached_property
    def signal(self) -> DataFrame:
        """Signals without their texts."""
        e = self.raw("events")
        pick = lambda c, values: F.element_at(F.array(*map(F.lit, values)), (c + 1).cast("int"))
        i = F.col("event_id")
        tag = F.when(F.col("event_type") == "click", F.when(i % 13 == 0, "dbd").otherwise("DBD")).when(F.col("event_type") == "view", "Campak").when(F.col("event_type") == "purchase", "Rabies").when(F.col("event_type") == "error", "Antraks").otherwise("")
        score = F.least(F.lit(100), F.floor("value")).cast("int")
        return e.select(
            i.alias("id"),
            F.col("ts").alias("published_at"),
            F.expr("ts + make_dt_interval(0, cast(event_id % 50 as int))").alias("created_at"),
            tag.alias("disease_tag"),
            score.alias("threat_score"),
            F.get_json_object("props", "$.k").cast("int").alias("confidence_score"),
            pick(i % 10, ["raw"] * 4 + ["validated"] * 2 + ["approved"] * 3 + ["noise"]).alias("status"),
            pick(i % 7, ["ok", "matched", "manual", "gazetteer_only", "not_found", "pending", "OK"]).alias("geocode_status"),
            pick(i % 5, ["ok", "fallback", "failed", "pending", "not_generated"]).alias("assessment_status"),
            F.when(i % 5 < 3, F.concat(F.lit("summary "), i)).otherwise("").alias("assessment_summary"),
            F.when(i % 5 == 2, "timeout").otherwise("").alias("assessment_error"),
            (score > 50).alias("is_high_risk"),
            pick(i % 6, ["approve", "review", "fix_location", "noise", "duplicate", "review"]).alias("recommendation"),
            pick(i % 4, ["urgent", "high", "medium", "low"]).alias("triage_priority"),
            F.when(i % 9 == 0, "").otherwise(F.concat(F.lit("place "), F.col("user_id") % 40)).alias("raw_location_text"),
            F.when(i % 8 == 0, "").otherwise(F.concat(F.lit("https://www.src"), i % 20, F.lit(".example.org/read/"), F.expr("event_id div 3"))).alias("source_url"),
            (i % 20).alias("source_id"),
            F.col("user_id"),
        )

    @cached_property
    def article(self) -> DataFrame:
        """id, title, content: an event's document is the one numbered by the event modulo the document count."""
        return self.articles("title", "content")

    def articles(self, *values: str | Column) -> DataFrame:
        """id and the values, which are made of each document's title and content before events meet it.

        An event's row then carries the values, not a text that many events share.
        """
        title = F.substring(F.substring_index("text", "\n", 1), 1, 80).alias("title")
        docs = self.raw("documents").select("doc_id", title, F.col("text").alias("content")).select("doc_id", *values)
        n = self.raw("documents").count()
        ids = self.raw("events").select(F.col("event_id").alias("id"), (F.col("event_id") % n).alias("doc_id"))
        return ids.join(docs, "doc_id").drop("doc_id")

    @cached_property
    def report(self) -> DataFrame:
        """doc_id, title, content: the documents as reports that name places, in several spellings and with traps."""
        nation = self.raw("nation").select(F.col("n_nationkey").cast("long").alias("nk"), "n_name")
        region = self.raw("region").select(F.col("r_regionkey").cast("long").alias("rk"), "r_name")
        i = F.col("doc_id")
        x = self.texts("documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumns({"nk": i * 7 % 25, "rk": i % 5, "nk2": i % 25})
        x = x.join(nation, "nk").join(region, "rk").join(nation.select(F.col("nk").alias("nk2"), F.lower("n_name").alias("other")), "nk2")
        title = "case doc_id % 6 when 0 then '' when 1 then concat('Kasus di Kota ', n_name, ' naik') when 2 then concat('Wabah: ', lower(n_name), '!') when 3 then concat('di Provinsi ', r_name, ' waspada') when 4 then concat('di ', split_part(n_name, ' ', 1), ' dan sekitarnya') else concat('x', n_name, 'y di Nowhere Land') end"
        content = "concat(text, case doc_id % 4 when 0 then concat(' Laporan dari ', other, '.') when 1 then concat(' Kab. ', r_name) else '' end)"
        return x.select("doc_id", F.expr(title).alias("title"), F.expr(content).alias("content"))

    @cached_property
    def link(self) -> DataFrame:
        """Places of signals: some primary, some doubly primary, some absent."""
        s = self.signal
        place = F.col("user_id") % 30
        kinds = F.filter(
            F.array(
                F.when(F.col("id") % 11 != 0, F.struct(F.lit(1).alias("slot"), F.when(place < 25, place).otherwise(place + 975).alias("location_id"), F.lit(True).alias("is_primary"))),
                F.when(F.col("id") % 17 == 0, F.struct(F.lit(2).alias("slot"), ((F.col("user_id") + 7) % 25).alias("location_id"), F.lit(True).alias("is_primary"))),
                F.when(F.col("id") % 7 == 0, F.struct(F.lit(3).alias("slot"), ((F.col("user_id") + 3) % 25).alias("location_id"), F.lit(False).alias("is_primary"))),
            ),
            lambda x: x.isNotNull(),
        )
        out = s.select(F.col("id").alias("signal_id"), "published_at", "created_at", "disease_tag", F.explode(kinds).alias("k")).select("signal_id", "published_at", "created_at", "disease_tag", "k.*")
        fresh5 = f"location_id = 5 and published_at < timestamp_ntz'{AS_OF}' - INTERVAL 48 HOURS"
        fresh11 = f"location_id = 11 and disease_tag in ('Campak', 'Antraks') and published_at < timestamp_ntz'{AS_OF}' - INTERVAL 7 DAYS"
        return out.where(f"not (({fresh5}) or ({fresh11}))").select("signal_id", "location_id", "is_primary", "slot", "created_at")

    @cached_property
    def primary(self) -> DataFrame:
        """Primary links with their place: id, name, level, parent."""
        place = self.location.select(F.col("id").alias("location_id"), F.col("name").alias("place"), "level", "parent_id", "province_code", "city_code")
        return self.link.where("is_primary").join(place, "location_id")

    @cached_property
    def promoted(self) -> DataFrame:
        """Primary links with the province they belong to; links without one are left out."""
        parent = self.location.where("level = 'province'").select(F.col("id").alias("province_id"), F.col("name").alias("province"))
        return self.primary.withColumn("province_id", F.expr("case when level = 'province' then location_id else parent_id end")).join(parent, "province_id")


#: The same tables for DuckDB, as the head of a WITH clause.
ADAPTER_SQL = """
WITH location AS (
  SELECT CAST(1000 + r_regionkey AS BIGINT) AS id, r_name AS name, 'province' AS level, CAST(NULL AS BIGINT) AS parent_id,
    regexp_replace(lower(trim(r_name)), '[\\s-]+', '_', 'g') AS province_code, '' AS city_code FROM region
  UNION ALL
  SELECT CAST(n_nationkey AS BIGINT), n_name, CASE WHEN n_nationkey % 2 = 0 THEN 'city' ELSE 'regency' END, CAST(1000 + n_regionkey AS BIGINT),
    regexp_replace(lower(trim(r_name)), '[\\s-]+', '_', 'g'), regexp_replace(lower(trim(n_name)), '[\\s-]+', '_', 'g')
  FROM nation JOIN region ON n_regionkey = r_regionkey
), disease(id, name, aliases, alert_rule, disease_type, skdr_priority, report_24h, emerging_watchlist, reemerging_watch) AS (
  VALUES (CAST(1 AS BIGINT), 'DBD', 'demam berdarah,dengue', 'trend_based', 'endemic', TRUE, FALSE, FALSE, FALSE),
    (2, 'Campak', 'measles;morbili', 'reemerging', 'reemerging', TRUE, FALSE, FALSE, TRUE),
    (3, 'Rabies', 'anjing gila' || chr(10) || 'rabies klinis', 'immediate', 'zoonosis', TRUE, TRUE, FALSE, FALSE),
    (4, 'Antraks', 'anthrax', 'novelty', 'emerging', TRUE, FALSE, TRUE, FALSE),
    (5, 'Klaster Tidak Dikenal', 'misterius', 'unknown_cluster', 'unknown_cluster', FALSE, FALSE, FALSE, FALSE)
), signal AS (
  SELECT event_id AS id, ts AS published_at, ts + to_hours(CAST(event_id % 50 AS INTEGER)) AS created_at,
    CASE event_type WHEN 'click' THEN CASE WHEN event_id % 13 = 0 THEN 'dbd' ELSE 'DBD' END WHEN 'view' THEN 'Campak' WHEN 'purchase' THEN 'Rabies' WHEN 'error' THEN 'Antraks' ELSE '' END AS disease_tag,
    CAST(least(100, floor(value)) AS INTEGER) AS threat_score, CAST(json_extract_string(props, '$.k') AS INTEGER) AS confidence_score,
    CASE WHEN event_id % 10 < 4 THEN 'raw' WHEN event_id % 10 < 6 THEN 'validated' WHEN event_id % 10 < 9 THEN 'approved' ELSE 'noise' END AS status,
    ['ok', 'matched', 'manual', 'gazetteer_only', 'not_found', 'pending', 'OK'][CAST(event_id % 7 + 1 AS INTEGER)] AS geocode_status,
    ['ok', 'fallback', 'failed', 'pending', 'not_generated'][CAST(event_id % 5 + 1 AS INTEGER)] AS assessment_status,
    CASE WHEN event_id % 5 < 3 THEN 'summary ' || event_id ELSE '' END AS assessment_summary,
    CASE WHEN event_id % 5 = 2 THEN 'timeout' ELSE '' END AS assessment_error,
    least(100, floor(value)) > 50 AS is_high_risk,
    ['approve', 'review', 'fix_location', 'noise', 'duplicate', 'review'][CAST(event_id % 6 + 1 AS INTEGER)] AS recommendation,
    ['urgent', 'high', 'medium', 'low'][CAST(event_id % 4 + 1 AS INTEGER)] AS triage_priority,
    CASE WHEN event_id % 9 = 0 THEN '' ELSE 'place ' || (user_id % 40) END AS raw_location_text,
    CASE WHEN event_id % 8 = 0 THEN '' ELSE 'https://www.src' || (event_id % 20) || '.example.org/read/' || (event_id // 3) END AS source_url,
    event_id % 20 AS source_id, user_id
  FROM events
), link0 AS (
  SELECT id AS signal_id, published_at, created_at, disease_tag, 1 AS slot, CASE WHEN user_id % 30 < 25 THEN user_id % 30 ELSE 975 + user_id % 30 END AS location_id, TRUE AS is_primary FROM signal WHERE id % 11 <> 0
  UNION ALL SELECT id, published_at, created_at, disease_tag, 2, (user_id + 7) % 25, TRUE FROM signal WHERE id % 17 = 0
  UNION ALL SELECT id, published_at, created_at, disease_tag, 3, (user_id + 3) % 25, FALSE FROM signal WHERE id % 7 = 0
), link AS (
  SELECT signal_id, location_id, is_primary, slot, created_at FROM link0
  WHERE NOT (location_id = 5 AND published_at < TIMESTAMP '2024-01-31' - INTERVAL 48 HOUR)
    AND NOT (location_id = 11 AND disease_tag IN ('Campak', 'Antraks') AND published_at < TIMESTAMP '2024-01-31' - INTERVAL 7 DAY)
), plink AS (
  SELECT l.signal_id, l.location_id, l.slot, l.created_at, p.name AS place, p.level, p.parent_id, p.province_code, p.city_code FROM link l JOIN location p ON p.id = l.location_id WHERE l.is_primary
), prov AS (
  SELECT x.*, q.id AS province_id, q.name AS province FROM plink x JOIN location q ON q.id = CASE WHEN x.level = 'province' THEN x.location_id ELSE x.parent_id END AND q.level = 'province'
), article AS (
  SELECT event_id AS id, substr(split_part(text, chr(10), 1), 1, 80) AS title, text AS content FROM events JOIN documents ON doc_id = event_id % (SELECT count(*) FROM documents)
), report AS (
  SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '' WHEN 1 THEN 'Kasus di Kota ' || a.n_name || ' naik' WHEN 2 THEN 'Wabah: ' || lower(a.n_name) || '!' WHEN 3 THEN 'di Provinsi ' || r_name || ' waspada'
    WHEN 4 THEN 'di ' || split_part(a.n_name, ' ', 1) || ' dan sekitarnya' ELSE 'x' || a.n_name || 'y di Nowhere Land' END AS title,
    coalesce(text, '') || CASE doc_id % 4 WHEN 0 THEN ' Laporan dari ' || lower(b.n_name) || '.' WHEN 1 THEN ' Kab. ' || r_name ELSE '' END AS content
  FROM documents JOIN nation a ON a.n_nationkey = doc_id * 7 % 25 JOIN region ON r_regionkey = doc_id % 5 JOIN nation b ON b.n_nationkey = doc_id % 25
)
"""


def sql(body: str) -> str:
    """body continues the WITH clause (a comma first) or is a SELECT."""
    return ADAPTER_SQL + body


def r2(top: str, bottom: str) -> str:
    """DuckDB text for top / bottom to two decimals, half to even, 0 without a bottom."""
    x, n = f"CAST(100 * ({top}) AS BIGINT)", f"nullif(CAST({bottom} AS BIGINT), 0)"
    rest = f"((({x} % {n}) + {n}) % {n})"
    q = f"(({x} - {rest}) // {n})"
    return f"coalesce(CAST({q} + CASE WHEN 2 * {rest} > {n} THEN 1 WHEN 2 * {rest} = {n} THEN abs({q} % 2) ELSE 0 END AS DOUBLE) / 100, 0)"
