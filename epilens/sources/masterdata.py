"""Master data: fixed seed tables, and a store that takes them, or a user's files, in versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epilens.functions.text import region_code, squeeze
from epilens.registry import query
from epilens.sources.adapter import Tables
from epilens.sources.files import folder

# The notifiable diseases, as name | code | aliases | type | severity | alert rule | marks | superseded names.
NOTIFIABLE = """
Diare Akut | A | diare, diare akut | waterborne | medium | trend_based | |
Malaria | B | malaria | vector_borne | high | trend_based | | Malaria Konfirmasi
Demam Dengue | C | dbd, dengue, demam berdarah, demam dengue | vector_borne | high | trend_based | | Tersangka Demam Dengue
Pneumonia | D | pneumonia, radang paru | respiratory | high | trend_based | |
Disentri | E | disentri, diare berdarah | waterborne | high | immediate | | Diare Berdarah atau Disentri
Demam Tifoid | F | tifoid, typhoid, demam tifoid, tipes | foodborne | medium | trend_based | | Tersangka Demam Tifoid
Jaundis Akut | G | jaundis akut, ikterus akut, hepatitis akut | other | high | immediate | | Sindrom Jaundis Akut
Chikungunya | H | chikungunya | vector_borne | medium | trend_based | | Tersangka Chikungunya
Flu Burung pada Manusia | J | flu burung manusia, flu burung, avian influenza, h5n1, h5n6, h9n2 | zoonosis | critical | immediate | emerging | Tersangka Flu Burung pada Manusia
Campak | K | campak, measles | vaccine_preventable | high | reemerging | reemerging | Tersangka Campak
Difteri | L | difteri, diphtheria | vaccine_preventable | critical | immediate | reemerging | Tersangka Difteri
Pertussis | M | pertussis, pertusis, batuk rejan | vaccine_preventable | high | reemerging | reemerging | Tersangka Pertussis
Polio/AFP | N | afp, lumpuh layuh mendadak, polio | vaccine_preventable | critical | immediate | reemerging | AFP / Lumpuh Layuh Mendadak
Rabies | P | rabies, gigitan hewan penular rabies, ghpr | zoonosis | critical | immediate | reemerging | Kasus Gigitan Hewan Penular Rabies
Antraks | Q | antraks, anthrax | zoonosis | critical | immediate | emerging | Tersangka Antraks
Leptospirosis | R | leptospirosis | zoonosis | high | immediate | | Tersangka Leptospirosis
Kolera | S | kolera, cholera | waterborne | critical | immediate | | Tersangka Kolera
Klaster Penyakit yang Tidak Lazim | T | klaster penyakit tidak lazim, penyakit tidak lazim, penyakit tidak diketahui, unknown outbreak | unknown_cluster | high | unknown_cluster | emerging |
Meningitis/Ensefalitis | U | meningitis, ensefalitis, encephalitis | other | critical | immediate | | Tersangka Meningitis/Ensefalitis
Tersangka Tetanus Neonatorum | V | tetanus neonatorum | vaccine_preventable | critical | immediate | |
Tetanus | W | tetanus | vaccine_preventable | critical | immediate | | Tersangka Tetanus
Influenza Like Illness | X | ili, influenza like illness, influenza, flu | respiratory | medium | trend_based | | ILI / Influenza Like Illness
HFMD | Y | hfmd, hand foot mouth disease, flu singapura | other | medium | trend_based | | Tersangka HFMD / Hand Foot Mouth Disease
Covid-19 | AC | covid, covid-19, coronavirus, sars-cov-2 | respiratory | high | trend_based | | Tersangka Covid-19
"""
# The emerging diseases to watch, as name | aliases | type | severity | superseded names.
WATCHED = """
Mpox | mpox, monkeypox, cacar monyet | zoonosis | high |
MERS-CoV | mers, mers-cov, middle east respiratory syndrome | respiratory | critical |
Nipah | nipah, nipah virus | zoonosis | critical |
Ebola | ebola, ebola virus disease | zoonosis | critical | Ebola/Marburg
Marburg | marburg, marburg virus disease | zoonosis | critical | Ebola/Marburg
Yellow Fever | yellow fever, demam kuning | vector_borne | critical |
Lassa Fever | lassa, lassa fever, demam lassa | zoonosis | critical |
CCHF | cchf, crimean-congo haemorrhagic fever, crimean-congo hemorrhagic fever | zoonosis | critical |
Rift Valley Fever | rift valley fever, rvf | zoonosis | critical |
Hantavirus | hantavirus, hanta virus | zoonosis | high |
Legionellosis | legionellosis, legionella | respiratory | high |
"""
# Publishers by domain, as domain | names.
PUBLISHERS = """
rri.co.id | RRI, RRI.co.id
kompas.com | Kompas, Kompas.com
antaranews.com | ANTARA, ANTARA News
detik.com | Detik, detikcom
tribunnews.com | Tribunnews
cnnindonesia.com | CNN Indonesia
tempo.co | Tempo
liputan6.com | Liputan6
radarmadiun.jawapos.com | Radar Madiun, Radar Pacitan, radarmadiun.jawapos.com, Jawa Pos Radar Madiun
radarkepahiang.disway.id | Radar Kepahiang, radarkepahiang.disway.id
disway.id | Disway
kalimantanpost.com | Kalimantan Post
sabangmeraukenews.com | Sabang Merauke NEWS, Sabang Merauke
serumpun.babelprov.go.id | Pemerintah Provinsi Kepulauan Bangka Belitung, Pemprov Babel, Serumpun Babel, Babelprov, serumpun.babelprov.go.id
berita.cilegon.go.id | Berita Cilegon, Pemerintah Kota Cilegon, berita.cilegon.go.id
"""
# Scoring rules, as name | weight, with | keyword where it isn't the name in lower case.
RULES = """
KLB | 40
Kejadian Luar Biasa | 40
Wabah | 35
Darurat | 30
Waspada | 20
Meninggal | 30
Kematian | 30
Tewas | 30
Fatal | 25
Dirawat | 20
Rawat Inap | 20
Kasus meningkat | 20 | meningkat
Lonjakan kasus | 25 | lonjakan
Penyebaran | 20
Merebak | 25
Meluas | 25
Suspek | 15
Positif | 15
Terdeteksi | 15
Ditemukan | 10
Dilaporkan | 10
DBD | 25
Demam Berdarah | 25
Dengue | 25
Mpox | 30
Monkeypox | 30
Flu Burung | 35
Avian Influenza | 35
Antraks | 35
Anthrax | 35
Rabies | 30
Polio | 35
Difteri | 30
Campak | 25
Rubela | 20
Diare | 15
Kolera | 35
Demam Tifoid | 20
Tifoid | 20
Chikungunya | 25
Leptospirosis | 30
TBC | 20
Tuberkulosis | 20
HIV | 20
AIDS | 20
IMS | 15
Infeksi Menular Seksual | 15
Pertusis | 25
Batuk Rejan | 25
Nipah | 40
"""
# Provinces; a code is the name's region code.
PROVINCES = """
Aceh, Sumatera Utara, Sumatera Barat, Riau, Jambi, Sumatera Selatan, Bengkulu, Lampung, Kepulauan Bangka Belitung,
Kepulauan Riau, DKI Jakarta, Jawa Barat, Jawa Tengah, DI Yogyakarta, Jawa Timur, Banten, Bali, Nusa Tenggara Barat,
Nusa Tenggara Timur, Kalimantan Barat, Kalimantan Tengah, Kalimantan Selatan, Kalimantan Timur, Kalimantan Utara,
Sulawesi Utara, Sulawesi Tengah, Sulawesi Selatan, Sulawesi Tenggara, Gorontalo, Sulawesi Barat, Maluku, Maluku Utara,
Papua, Papua Barat, Papua Selatan, Papua Tengah, Papua Pegunungan, Papua Barat Daya
"""

DISEASE = "name string, aliases string, skdr_code string, skdr_priority boolean, report_24h boolean, emerging_watchlist boolean, reemerging_watch boolean, disease_type string, severity_weight string, alert_rule string, keyword_id string, keyword_en string"
_VALUES = [c.split()[0] for c in DISEASE.split(", ")][1:]
SUPERSEDED = "superseded"


def _lines(text: str) -> list[list[str]]:
    return [[cell.strip() for cell in line.split("|")] for line in text.strip().splitlines()]


def _disease_rows() -> list[tuple]:
    """Seed rows: position, the columns of DISEASE (None: left as it is), superseded names."""
    rows = []
    for name, code, aliases, kind, severity, rule, marks, old in _lines(NOTIFIABLE):
        rows.append((name, aliases, code, True, rule in ("immediate", "unknown_cluster"), marks == "emerging", marks == "reemerging", kind, severity, rule, aliases, None, [old] if old else []))
    for name, aliases, kind, severity, old in _lines(WATCHED):
        rows.append((name, aliases, None, False, True, True, False, kind, severity, "novelty_based", aliases, aliases, [old] if old else []))
    return [(i, *row) for i, row in enumerate(rows)]


def diseases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_disease_rows(), f"seq int, {DISEASE}, supersedes array<string>")


def rules(spark: SparkSession) -> DataFrame:
    """Scoring rules as `rule_scores` takes them, with a name."""
    rows = [(i, r[0], "keyword", r[2] if len(r) > 2 else r[0].lower(), int(r[1]), True) for i, r in enumerate(_lines(RULES))]
    return spark.createDataFrame(rows, "seq int, name string, kind string, keyword string, weight long, active boolean")


def publishers(spark: SparkSession) -> DataFrame:
    rows = [(alias.strip(), domain) for domain, names in _lines(PUBLISHERS) for alias in names.split(",")]
    x = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "seq int, alias string, domain string")
    return publisher_rows(x)


def publisher_rows(rows: DataFrame) -> DataFrame:
    """rows with the key of their alias and a plain domain; rows without either go."""
    key = squeeze(F.regexp_replace(F.lower(F.trim("alias")), r"[^a-z0-9 \t\n\x0B\f\r.-]", " "))
    host = F.regexp_replace(F.lower(F.trim("domain")), "^https?://([^/]*).*$", "$1")
    domain = F.btrim(F.regexp_replace(host, r"^(.*?)www\.", "$1"), F.lit("/"))
    x = rows.withColumns({"normalized_alias": key, "alias": F.trim("alias"), "domain": domain})
    return x.where("alias <> '' and domain <> '' and normalized_alias <> ''")


def provinces(spark: SparkSession) -> DataFrame:
    names = [" ".join(n.split()) for n in PROVINCES.split(",")]
    x = spark.createDataFrame(list(enumerate(names)), "seq int, name string")
    return x.select("seq", region_code(F.col("name")).alias("province_code"), "name", F.lit("province").alias("level"))


def read_seeds(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Seed rows from CSV files with a header: seq, the columns of schema in any order, and supersedes, names parted by bars.

    Columns that a file lacks, and cells without a value, are null: they leave what is stored. Rows without a seq come first.
    """
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    cells = {c.strip().lower(): F.nullif(F.btrim(F.col(f"`{c}`")), F.lit("")) for c in raw.columns}
    columns = [F.expr(f"try_cast(_{n} as {kind})").alias(n) for n, kind in (x.split() for x in f"seq int, {schema}".split(", "))]
    names = ["seq", *[x.split()[0] for x in schema.split(", ")], "supersedes"]
    text = raw.select(*[cells.get(n, F.lit(None).cast("string")).alias(f"_{n}") for n in names])
    parts = F.filter(F.transform(F.split(F.coalesce("_supersedes", F.lit("")), "[|]"), lambda x: F.trim(x)), lambda x: x != "")
    return text.select(*columns, parts.alias("supersedes")).withColumn("seq", F.coalesce("seq", F.lit(-1)))


def seeded(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with the rows of new put in by key, and `change`: created, updated, unchanged, superseded or untouched.

    new: key, seq, any of old's columns, supersedes (optional). A null in new leaves old's value, and is '' in a created row
    where the column is text. Of rows that share a key the last by seq counts. A seeded row is active unless it says otherwise; a
    row whose name the supersedes of another row gives, at or after its own place, is not, and its notes say so. Rows of new without a key are
    passed over; rows of old that share a key all change; no rows change nothing.
    """
    given = [c for c in old.columns if c in new.columns and c != key]
    n = new.where(F.trim(key) != "").groupBy(key).agg(F.max_by(F.struct("seq", *given), "seq").alias("n"))
    rest = [c for c in old.columns if c != key]
    o = old.select(key, F.struct(*rest).alias("o"))
    both = o.join(n, key, "full")
    text = {f.name for f in old.schema if f.dataType.simpleString() == "string"}

    def merged(c: str) -> Column:
        if c == "is_active":
            return F.when(F.col("n").isNotNull(), F.coalesce("n.is_active", F.lit(True)) if c in given else True).otherwise(F.col("o.is_active"))
        value = F.coalesce(f"n.{c}", f"o.{c}") if c in given else F.col(f"o.{c}")
        return F.when(F.col("o").isNull(), F.coalesce(value, F.lit(""))).otherwise(value) if c in text else value

    both = both.select(key, "o", F.col("n.seq").alias("seq"), F.col("n").isNotNull().alias("came"), *[merged(c).alias(c) for c in rest])
    if "supersedes" in new.columns:
        ends = new.select(F.col(key).alias("by"), "seq", F.explode("supersedes").alias(key)).where(F.col("by") != F.col(key)).groupBy(key).agg(F.max("seq").alias("end"))
        both = both.join(ends, key, "left")
        over = F.col("is_active") & (F.col("end") >= F.coalesce("seq", F.lit(-1)))
        both = both.withColumn("over", F.coalesce(over, F.lit(False)))
        both = both.withColumns({"is_active": F.col("is_active") & ~F.col("over"), "notes": F.when(F.col("over"), SUPERSEDED).otherwise(F.col("notes"))})
    differs = ~F.struct(*rest).eqNullSafe(F.col("o"))
    change = F.when(F.col("o").isNull(), "created").when(F.col("o.is_active") & ~F.col("is_active"), "superseded").when(differs, "updated").when(F.col("came"), "unchanged").otherwise("untouched")
    return both.select(key, *rest, change.alias("change"))


class MasterStore:
    """Master tables in a shared folder, by version. A version counts once its line in `versions` is written, after its rows.

    Each seeding writes a table anew: master tables are what people keep by hand. A seeding that dies, or changes nothing,
    leaves no version; the next one overwrites what it wrote.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @classmethod
    def create(cls, spark: SparkSession, path: str) -> MasterStore:
        spark.createDataFrame([], "table string, version long").write.parquet(f"{path}/versions")
        return cls(spark, path)

    def version(self, table: str) -> int:
        """The newest version; 0 before the first."""
        lines = self.spark.read.schema("table string, version long").parquet(f"{self.path}/versions")
        return lines.where(F.col("table") == table).agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest unless one is named."""
        number = self.version(table) if version is None else version
        return self.spark.read.parquet(f"{self.path}/{table}/{number}").drop("change")

    def seed(self, table: str, new: DataFrame, key: str, empty: str | None = None) -> DataFrame:
        """change, n: what the seeding did to each row. empty: the schema of a table that has no version yet."""
        number = self.version(table)
        old = self.read(table, number) if number else self.spark.createDataFrame([], empty)
        place = f"{self.path}/{table}/{number + 1}"
        seeded(old, new, key).write.mode("overwrite").parquet(place)
        counts = self.spark.read.parquet(place).groupBy("change").agg(F.count("*").alias("n"))
        if counts.where("change in ('created', 'updated', 'superseded')").head(1):
            self.spark.createDataFrame([(table, number + 1)], "table string, version long").coalesce(1).write.mode("append").parquet(f"{self.path}/versions")
        return counts


#: What a catalogue holds beside the columns of DISEASE.
CATALOGUE = DISEASE + ", is_active boolean, notes string"


def imported(t: Tables) -> DataFrame:
    """A catalogue before seeding: a disease for each part, every third seed with other values, and names that seeds supersede."""
    i = "p_partkey"
    part = t.raw("part").selectExpr(
        f"concat(p_name, ' ', {i}) as name",
        f"if({i} % 11 = 0, '', concat(p_name, ', ', p_brand, '; ', p_type, '\n size  ', p_size, ',p', {i})) as aliases",
        "'' as skdr_code", "p_size % 3 = 0 as skdr_priority", "p_size % 5 = 0 as report_24h", "p_type = 'SMALL' as emerging_watchlist", "p_size > 45 as reemerging_watch",
        f"if({i} % 17 = 0, 'unknown_cluster', 'other') as disease_type", "'medium' as severity_weight", f"if({i} % 19 = 0, 'unknown_cluster', 'trend_based') as alert_rule",
        f"if({i} % 11 = 0, '', lower(p_brand)) as keyword_id", f"if({i} % 5 = 0 and {i} % 11 <> 0, concat('en ', p_size), '') as keyword_en", f"{i} % 13 <> 0 as is_active", "'' as notes",
    )
    seeds = diseases(t.spark)
    changed = {"aliases": F.concat(F.lit("old "), "name"), "severity_weight": F.lit("low"), "keyword_en": F.lit("kept"), "skdr_code": F.coalesce("skdr_code", F.lit("")), "is_active": F.col("seq") % 2 == 0, "notes": F.lit("by hand")}
    names = [c.split()[0] for c in CATALOGUE.split(", ")]
    known = seeds.where("seq % 3 = 0").withColumns(changed).select(*names)
    old = seeds.where("seq % 2 = 0").select(F.explode("supersedes").alias("name")).distinct()
    blank = {c: F.lit(False) if kind == "boolean" else F.lit("") for c, kind in (x.split() for x in CATALOGUE.split(", ")[1:])}
    return part.unionByName(known).unionByName(old.withColumns(blank | {"is_active": F.lit(True)}))


def catalogue(t: Tables) -> DataFrame:
    """The imported catalogue after seeding, with what the seeding did."""
    return seeded(imported(t), diseases(t.spark), "name")


def _literal(v: object) -> str:
    return "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int) else f"'{v}'"


_OLD_PART = """p_name || ' ' || p_partkey AS name, CASE WHEN p_partkey % 11 = 0 THEN '' ELSE p_name || ', ' || p_brand || '; ' || p_type || chr(10) || ' size  ' || p_size || ',p' || p_partkey END AS aliases,
  '' AS skdr_code, p_size % 3 = 0 AS skdr_priority, p_size % 5 = 0 AS report_24h, p_type = 'SMALL' AS emerging_watchlist, p_size > 45 AS reemerging_watch,
  CASE WHEN p_partkey % 17 = 0 THEN 'unknown_cluster' ELSE 'other' END AS disease_type, 'medium' AS severity_weight, CASE WHEN p_partkey % 19 = 0 THEN 'unknown_cluster' ELSE 'trend_based' END AS alert_rule,
  CASE WHEN p_partkey % 11 = 0 THEN '' ELSE lower(p_brand) END AS keyword_id, CASE WHEN p_partkey % 5 = 0 AND p_partkey % 11 <> 0 THEN 'en ' || p_size ELSE '' END AS keyword_en, p_partkey % 13 <> 0 AS is_active, '' AS notes"""
#: The seeded catalogue for DuckDB, as the head of a WITH clause: c.
CATALOGUE_SQL = f"""WITH seed(seq, name, {', '.join(_VALUES)}) AS (VALUES {', '.join('(' + ', '.join(map(_literal, r[:-1])) + ')' for r in _disease_rows())}),
legacy(seq, name) AS (VALUES {', '.join(f"({r[0]}, '{n}')" for r in _disease_rows() for n in r[-1])}),
old AS (SELECT {_OLD_PART} FROM part
  UNION ALL SELECT name, 'old ' || name, coalesce(skdr_code, ''), skdr_priority, report_24h, emerging_watchlist, reemerging_watch, disease_type, 'low', alert_rule, keyword_id, 'kept', seq % 2 = 0, 'by hand' FROM seed WHERE seq % 3 = 0
  UNION ALL SELECT DISTINCT name, '', '', FALSE, FALSE, FALSE, FALSE, '', '', '', '', '', TRUE, '' FROM legacy WHERE seq % 2 = 0),
c AS (SELECT coalesce(o.name, s.name) AS name, {', '.join(f"coalesce(s.{v}, o.{v}, {chr(39) * 2})" + f' AS {v}' if v not in ('skdr_priority', 'report_24h', 'emerging_watchlist', 'reemerging_watch') else f'coalesce(s.{v}, o.{v}) AS {v}' for v in _VALUES)},
  s.name IS NOT NULL OR (o.is_active AND o.name NOT IN (SELECT name FROM legacy)) AS is_active, CASE WHEN s.name IS NULL AND o.is_active AND o.name IN (SELECT name FROM legacy) THEN 'superseded' ELSE coalesce(o.notes, '') END AS notes,
  CASE WHEN o.name IS NULL THEN 'created' WHEN s.name IS NOT NULL THEN 'updated' WHEN o.is_active AND o.name IN (SELECT name FROM legacy) THEN 'superseded' ELSE 'untouched' END AS change
  FROM old o FULL JOIN seed s ON o.name = s.name)
"""


@query(CATALOGUE_SQL + "SELECT * FROM c")
def disease_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue after seeding: seeds created or brought up to date, superseded names inactive, the rest untouched."""
    return catalogue(Tables(spark, sf_dir))


@query(CATALOGUE_SQL + "SELECT 1 AS seeding, change, count(*) AS n FROM c GROUP BY ALL UNION ALL SELECT 2, CASE WHEN change IN ('created', 'updated') THEN 'unchanged' ELSE 'untouched' END, count(*) FROM c GROUP BY 2 UNION ALL SELECT 3, 'versions', 2")
def seed_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two seedings of a stored catalogue: the second changes nothing and leaves no version."""
    t = Tables(spark, sf_dir)
    store, seeds = MasterStore.create(spark, folder(spark)), diseases(spark)
    store.seed("disease", imported(t).withColumn("seq", F.lit(0)), "name", CATALOGUE)
    first = store.seed("disease", seeds, "name").withColumn("seeding", F.lit(1))
    second = store.seed("disease", seeds, "name").withColumn("seeding", F.lit(2))
    last = spark.range(1).select(F.lit("versions").alias("change"), F.lit(store.version("disease")).cast("long").alias("n"), F.lit(3).alias("seeding"))
    return first.unionByName(second).unionByName(last).select("seeding", "change", "n")


@query("WITH r(k, w) AS (VALUES " + ", ".join(f"('{r[2] if len(r) > 2 else r[0].lower()}', {r[1]})" for r in _lines(RULES)) + "), m AS (SELECT doc_id, sum(w) AS w, string_agg(k, '|' ORDER BY k) AS matched FROM documents JOIN r ON contains(lower(text), k) GROUP BY 1) SELECT doc_id, CAST(least(100, coalesce(w, 0)) AS BIGINT) AS points, coalesce(matched, '') AS matched FROM documents LEFT JOIN m USING (doc_id)")
def seed_rule_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents scored by the seeded rules."""
    from epilens.operators.upkeep import rule_scores

    settings = spark.createDataFrame([], "name string, value string")
    return rule_scores(Tables(spark, sf_dir).texts("documents").select("doc_id", "text"), rules(spark), settings, "doc_id", "text")
