"""The report's CSV export, cluster mates of a signal, fingerprints of signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from epilens.functions.text import dedup_text
from epilens.operators.cluster import _KEY, cluster_rows
from epilens.plans.report import PERIODS, scope
from epilens.plans.trend import STATUSES, in_days
from epilens.registry import query
from epilens.sources.adapter import AS_OF, Tables, sql
from epilens.sources.files import folder

#: Columns of the report's export, in order. Fixed values.
COLUMNS = ["id", "title", "source", "source_url", "published_at", "disease_tag", "threat_score", "raw_location_text", "geocode_status", "status", "approved_for_mapping", "is_high_risk", "assessment_status", "assessment_summary", "validated_by", "validated_at"]
_CSV = {"header": True, "escape": '"', "emptyValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def iso(c: Column) -> Column:
    """A UTC instant as ISO text, with microseconds where there are any; '' for null."""
    part = F.date_format(c, "SSSSSS")
    return F.coalesce(F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.when(part != "000000", F.concat(F.lit("."), part)).otherwise(""), F.lit("+00:00")), F.lit(""))


def export_name(spark: SparkSession, preset: str, status: str, as_of: str = AS_OF) -> str:
    """The export's file name: status, period, first and last day."""
    status = status if status in STATUSES else "operational"
    first, last = spark.sql(f"select cast(date_sub(to_date(timestamp_ntz'{as_of}'), {PERIODS[preset] - 1}) as string), cast(to_date(timestamp_ntz'{as_of}') as string)").first()
    return f"signals_{status}_{preset}_{first}_{last}.csv"


def report_rows(t: Tables, signals: DataFrame, sources: DataFrame, preset: str = "weekly", status: str = "operational", disease: str = "", province_id: int | None = None, place_id: int | None = None) -> DataFrame:
    """The export's rows as text, the newest first.

    signals have the columns of COLUMNS but source, and source_id and created_at; sources: id, name. An unknown status means
    all operational ones, a place wins over its province, nulls are '', equally old rows come by falling id. A signal without
    a date is in no period.
    """
    chosen = signals.where(F.col("status").isin(STATUSES.get(status, STATUSES["operational"])))
    chosen = scope(t, in_days(chosen, AS_OF, PERIODS[preset]), disease, province_id if place_id is None else None, place_id)
    named = chosen.join(sources.select(F.col("id").alias("source_id"), F.col("name").alias("source")), "source_id", "left")
    flag = lambda c: F.initcap(F.col(c).cast("string"))
    form = {"published_at": iso(F.col("published_at")), "validated_at": iso(F.col("validated_at")), "approved_for_mapping": flag("approved_for_mapping"), "is_high_risk": flag("is_high_risk")}
    ordered = named.orderBy(F.desc("published_at"), F.desc("created_at"), F.desc("id"))
    return ordered.select(*[F.coalesce(form.get(c, F.col(c).cast("string")), F.lit("")).alias(c) for c in COLUMNS])


def read_export(spark: SparkSession, path: str) -> DataFrame:
    back = spark.read.schema(", ".join(f"{c} string" for c in COLUMNS)).options(**_CSV, multiLine=True).csv(path)
    return back.select(*[F.coalesce(c, F.lit("")).alias(c) for c in COLUMNS])


def exportable(t: Tables) -> DataFrame:
    """Signals with the columns that the test tables lack: who validated them, and when."""
    x = t.signal.join(t.article.select("id", "title"), "id")
    done = F.col("status").isin("validated", "approved")
    return x.withColumns({"approved_for_mapping": F.col("status") == "approved", "validated_by": F.when(done, F.concat(F.lit("user "), F.col("id") % 6)), "validated_at": F.when(done, F.expr("date_trunc('second', created_at) + interval 1 hour").cast("timestamp_ntz"))})


_ISO = "strftime({0}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN strftime({0}, '%f') <> '000000' THEN '.' || strftime({0}, '%f') ELSE '' END || '+00:00'"
_TEXTS = f"""CAST(id AS VARCHAR) AS id, md5(title) AS title, CASE WHEN source_id < 18 THEN 'Source, ' || source_id ELSE '' END AS source, source_url, {_ISO.format('published_at')} AS published_at, disease_tag, CAST(threat_score AS VARCHAR) AS threat_score, raw_location_text, geocode_status, status,
  CASE WHEN status = 'approved' THEN 'True' ELSE 'False' END AS approved_for_mapping, CASE WHEN is_high_risk THEN 'True' ELSE 'False' END AS is_high_risk, assessment_status, assessment_summary,
  CASE WHEN status IN ('validated', 'approved') THEN 'user ' || id % 6 ELSE '' END AS validated_by, CASE WHEN status IN ('validated', 'approved') THEN {_ISO.format("(date_trunc('second', created_at) + INTERVAL 1 HOUR)")} ELSE '' END AS validated_at"""
_DAYS = "CAST(published_at + INTERVAL 7 HOUR AS DATE) BETWEEN DATE '{0}' AND DATE '2024-01-31'"


@query(sql(f""", x AS (SELECT * FROM signal JOIN article USING (id))
SELECT 'signals_operational_weekly_2024-01-25_2024-01-31.csv' AS file, {_TEXTS} FROM x WHERE status IN ('raw', 'validated', 'approved') AND {_DAYS.format('2024-01-25')}
UNION ALL SELECT 'signals_validated_monthly_2024-01-02_2024-01-31.csv', {_TEXTS} FROM x WHERE status IN ('validated', 'approved') AND lower(disease_tag) = 'dbd' AND {_DAYS.format('2024-01-02')} AND id IN (SELECT signal_id FROM plink WHERE location_id = 1002 OR parent_id = 1002)"""))
def report_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two exports, all of a week and a disease in a province for a month, written as CSV and read back; titles as digests."""
    t, path = Tables(spark, sf_dir), folder(spark)
    sources = spark.range(18).select("id", F.concat(F.lit("Source, "), "id").alias("name"))
    out = None
    for asked in ({"preset": "weekly", "status": "all"}, {"preset": "monthly", "status": "validated", "disease": "DBD", "province_id": 1002}):
        name = export_name(spark, asked["preset"], asked["status"])
        report_rows(t, exportable(t), sources, **asked).write.options(**_CSV).csv(f"{path}/{name}")
        back = read_export(spark, f"{path}/{name}").withColumns({"file": F.lit(name), "title": F.md5(F.encode("title", "UTF-8"))})
        out = back if out is None else out.unionByName(back)
    return out


def cluster_mates(rows: DataFrame, asked: DataFrame, most: int = 10) -> DataFrame:
    """id, mates: for each of asked (id, cluster_key) the first other signals of its cluster that are not noise.

    By score, then the newest, then the greatest id. Only the first most + 1 of a cluster travel: the limit is applied before
    rows are dealt by cluster, and one of them is left out where it is the signal itself. No mates: an empty list.
    """
    order = [F.desc(c) for c in ("threat_score", "published_at", "created_at", "id")]
    k = F.row_number().over(Window.partitionBy("cluster_key").orderBy(*order))
    first = rows.where("status <> 'noise' and cluster_key is not null").withColumn("k", k).where(F.col("k") <= most + 1)
    tops = first.groupBy("cluster_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "id"))), lambda x: x["id"]).alias("tops"))
    met = asked.join(tops, "cluster_key", "left")
    others = F.slice(F.filter(F.coalesce("tops", F.array().cast("array<bigint>")), lambda x: x != F.col("id")), 1, most)
    return met.select("id", others.alias("mates"))


@query(sql(_KEY + ", m AS (SELECT a.id, b.id AS other, row_number() OVER (PARTITION BY a.id ORDER BY b.threat_score DESC, b.published_at DESC, b.created_at DESC, b.id DESC) AS k FROM ck a JOIN ck b ON a.cluster_key = b.cluster_key AND a.id <> b.id AND b.status <> 'noise' WHERE a.status IN ('raw', 'validated')), g AS (SELECT id, string_agg(other, ',' ORDER BY k) AS mates FROM m WHERE k <= 10 GROUP BY 1) SELECT s.id, coalesce(mates, '') AS mates FROM signal s LEFT JOIN g USING (id) WHERE status IN ('raw', 'validated')"))
def brief_cluster_mates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten cluster mates of every queued signal."""
    t = Tables(spark, sf_dir)
    rows = cluster_rows(t, t.signal).select("id", "cluster_key", "status", "threat_score", "published_at", "created_at")
    mates = cluster_mates(rows, rows.where("status in ('raw', 'validated')").select("id", "cluster_key"))
    return mates.select("id", F.array_join(F.col("mates").cast("array<string>"), ",").alias("mates"))


def fingerprint(title: Column, disease: Column, place: Column, source: Column) -> Column:
    """SHA-256 of the four normalised texts; nulls are empty."""
    return F.sha2(F.concat_ws(" | ", *[F.coalesce(dedup_text(c), F.lit("")) for c in (title, disease, place, source)]), 256)


_N5 = r"trim(regexp_replace(regexp_replace(regexp_replace(lower({0}), 'https?://[^ \t\n\x0B\f\r]+', ' ', 'g'), '[^a-z0-9 \t\n\x0B\f\r]', ' ', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g'))"


@query(sql(", f AS (SELECT id, sha256(" + " || ' | ' || ".join(_N5.format(c) for c in ("CASE WHEN id % 2 = 0 THEN '>> ' || title || '  !' ELSE title || ' https://x.example/' || id END", "disease_tag", "raw_location_text", "'Source-' || source_id % 3")) + ") AS fingerprint FROM signal JOIN article USING (id)) SELECT id, fingerprint, count(*) OVER (PARTITION BY fingerprint) AS copies FROM f"))
def signal_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals by title, disease, place and source, and how many share all four. Every other title has marks around it, the rest end in a link."""
    t = Tables(spark, sf_dir)
    x = t.signal.join(t.article.select("id", "title"), "id")
    title = F.expr("if(id % 2 = 0, concat('>> ', title, '  !'), concat(title, ' https://x.example/', id))")
    marked = x.select("id", fingerprint(title, F.col("disease_tag"), F.col("raw_location_text"), F.expr("concat('Source-', source_id % 3)")).alias("fingerprint")).persist()  # a short row a signal, for the counts and the join
    return marked.join(marked.groupBy("fingerprint").agg(F.count("*").alias("copies")), "fingerprint")
