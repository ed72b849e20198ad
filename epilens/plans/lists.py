"""Lists and pages: queue presets and filters, verified list, recents, choices, briefs, alert pages, report texts as codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from epilens.functions.numeric import ladder, ratio2
from epilens.operators.triage import PROBLEM_LOWER, with_place
from epilens.plans.queue import page
from epilens.plans.report import PLACED
from epilens.registry import query
from epilens.sources.adapter import AS_OF, Tables, r2, sql
from epilens.sources.masterdata import CATALOGUE_SQL, catalogue

_EMPTY = "coalesce(assessment_summary, '') = ''"
_FAILED = "(assessment_status in ('failed', 'fallback') or coalesce(assessment_error, '') <> '')"
_OK = f"geocode_status in ({', '.join(map(repr, PLACED))})"
#: Conditions of the eight work lists on a signal with placed: any link.
PRESETS = {
    "high_risk": "threat_score >= 70",
    "needs_assessment": f"({_EMPTY} or assessment_status in ('pending', 'not_generated', ''))",
    "assessment_failed": _FAILED,
    "needs_location": f"(geocode_status in ({', '.join(map(repr, PROBLEM_LOWER))}) or not placed)",
    "url_problem": _FAILED,
    "duplicate_candidate": "recommendation = 'duplicate'",
    "ready_validation": f"(status = 'raw' and {_OK} and not ({_EMPTY}) and recommendation not in ('noise', 'duplicate', 'fix_location'))",
    "ready_approval": f"(status = 'validated' and {_OK} and (recommendation = 'approve' or confidence_score >= 60))",
}
#: The sort keys that a list may be asked for; anything else is newest first.
SORTABLE = ["id", "published_at", "threat_score", "created_at", "title", "disease_tag", "raw_location_text", "geocode_status", "status", "confidence_score", "triage_priority"]


def sorting(asked: str) -> list[Column]:
    name = asked.lstrip("-")
    keys = [asked] if name in SORTABLE and asked in (name, f"-{name}") else ["-published_at"]
    return [F.desc(k[1:]) if k.startswith("-") else F.asc(k) for k in [*keys, "-created_at", "-id"]]


def presets(signals: DataFrame) -> DataFrame:
    """(preset, id, ...): each signal once in every work list that it is on; one pass."""
    on = F.filter(F.array(*[F.when(F.expr(c), F.lit(n)) for n, c in PRESETS.items()]), lambda x: x.isNotNull())
    return signals.withColumn("preset", F.explode(on))


_Q = ", q AS (SELECT s.*, s.id IN (SELECT signal_id FROM link) AS placed FROM signal s WHERE status IN ('raw', 'validated'))"


@query(sql(_Q + "".join(f", p{i} AS (SELECT '{n}' AS preset, * FROM q WHERE {c})" for i, (n, c) in enumerate(PRESETS.items())) + ", u AS (" + " UNION ALL ".join(f"SELECT * FROM p{i}" for i in range(len(PRESETS))) + "), r AS (SELECT preset, id, threat_score, row_number() OVER (PARTITION BY preset ORDER BY published_at DESC, created_at DESC, id DESC) AS place, count(*) OVER (PARTITION BY preset) AS total FROM u) SELECT * FROM r WHERE place <= 25"))
def queue_presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of each of the eight work lists, newest first."""
    t = Tables(spark, sf_dir)
    x = presets(with_place(t, t.signal.where("status in ('raw', 'validated')")))
    total = x.groupBy("preset").agg(F.count("*").alias("total"))
    # Each task keeps 25 of a list before lists meet in one task.
    rank = lambda *keys: F.row_number().over(Window.partitionBy("preset", *keys).orderBy(*sorting("")))
    x = x.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(64)))
    x = x.withColumn("place", rank("part")).where("place <= 25").withColumn("place", rank()).where("place <= 25")
    return x.join(total, "preset").select("preset", "id", "threat_score", "place", "total")


def wide_search(t: Tables, signals: DataFrame, text: str) -> DataFrame:
    """Signals that hold text, in any case, in title, raw place, URL, content, source name, or the raw text, name or parent's name of a linked place."""
    needle = F.lit(text.lower())
    has = lambda c: F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), needle)
    place = t.location.select(F.col("id").alias("location_id"), "name", "parent_id")
    parent = t.location.select(F.col("id").alias("parent_id"), F.col("name").alias("parent"))
    named = place.join(parent, "parent_id", "left").where(has("name") | has("parent")).select("location_id")
    by_place = t.link.join(named, "location_id").select(F.col("signal_id").alias("id"))
    own = signals.join(t.article, "id", "left").where(has("title") | has("raw_location_text") | has("source_url") | has("content") | has("source")).select("id")
    return signals.join(own.union(by_place).distinct(), "id", "left_semi")


def filtered(t: Tables, signals: DataFrame, disease: str = "", geocode: str = "", priority: str = "", recommendation: str = "", min_confidence: str = "", assessment: str = "", date_from: str = "", date_to: str = "", province_id: int | None = None, city_id: int | None = None) -> DataFrame:
    """The filters of the work list; empty ones and a confidence that is no number don't count."""
    fold = lambda c, v: signals.where(F.lower(c) == v.lower()) if v else signals
    signals = fold("disease_tag", disease)
    signals = fold("geocode_status", geocode)
    for c, v in (("triage_priority", priority), ("recommendation", recommendation)):
        signals = signals.where(F.col(c) == v) if v else signals
    if min_confidence.lstrip("+-").isdigit():
        signals = signals.where(F.col("confidence_score") >= int(min_confidence))
    if assessment == "not_generated":
        signals = signals.where(_EMPTY)
    elif assessment == "failed":
        signals = signals.where("assessment_status = 'failed' or coalesce(assessment_error, '') <> ''")
    elif assessment in ("article_based", "article_based_partial", "low_fallback"):
        signals = signals.where(F.col("assessment_quality") == assessment)
    if date_from:
        signals = signals.where(F.to_date("published_at") >= F.to_date(F.lit(date_from)))
    if date_to:
        signals = signals.where(F.to_date("published_at") <= F.to_date(F.lit(date_to)))
    primary = t.primary.select(F.col("signal_id").alias("id"), "location_id", "level", "parent_id")
    if province_id is not None:
        signals = signals.join(primary.where((F.col("parent_id") == province_id) | ((F.col("location_id") == province_id) & (F.col("level") == "province"))).select("id"), "id", "left_semi")
    if city_id is not None:
        signals = signals.join(primary.where(F.col("location_id") == city_id).select("id"), "id", "left_semi")
    return signals


def _sourced(t: Tables) -> DataFrame:
    quality = F.expr("case assessment_status when 'ok' then 'article_based' when 'fallback' then 'low_fallback' else '' end")
    return t.signal.withColumns({"source": F.concat(F.lit("src"), "source_id"), "assessment_quality": quality})


@query(sql(", b AS (SELECT s.*, title, content, 'src' || source_id AS source FROM signal s JOIN article USING (id) WHERE status IN ('raw', 'validated')), f AS (SELECT * FROM b WHERE (contains(lower(title), 'stan') OR contains(lower(raw_location_text), 'stan') OR contains(lower(source_url), 'stan') OR contains(lower(content), 'stan') OR contains(source, 'stan') OR id IN (SELECT signal_id FROM link JOIN location p ON p.id = location_id LEFT JOIN location q ON q.id = p.parent_id WHERE contains(lower(p.name), 'stan') OR contains(lower(q.name), 'stan'))) AND lower(disease_tag) = 'rabies' AND confidence_score >= 20 AND assessment_status = 'ok' AND CAST(published_at AS DATE) BETWEEN DATE '2024-01-03' AND DATE '2024-01-28') SELECT id, threat_score, title FROM f ORDER BY title, created_at DESC, id DESC LIMIT 25"))
def queue_wide_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of a search over nine columns with five filters, by title."""
    t = Tables(spark, sf_dir)
    rows = filtered(t, _sourced(t).where("status in ('raw', 'validated')"), disease="RABIES", min_confidence="20", assessment="article_based", date_from="2024-01-03", date_to="2024-01-28")
    found = wide_search(t, rows, "STAN").join(t.article.select("id", "title"), "id")
    return page(found, 1, 25, sorting("title")).select("id", "threat_score", "title")


@query(sql(", f AS (SELECT s.* FROM signal s WHERE lower(geocode_status) = 'ok' AND triage_priority = 'high' AND status = 'raw' AND id IN (SELECT signal_id FROM plink WHERE parent_id = 1002 OR (location_id = 1002 AND level = 'province'))) SELECT 'province' AS list, count(*) AS n, CAST(coalesce(sum(threat_score), 0) AS BIGINT) AS points FROM f UNION ALL SELECT 'city', count(*), CAST(coalesce(sum(threat_score), 0) AS BIGINT) FROM signal WHERE recommendation = 'review' AND assessment_summary = '' AND id IN (SELECT signal_id FROM plink WHERE location_id = 8) UNION ALL SELECT 'failed', count(*), CAST(coalesce(sum(threat_score), 0) AS BIGINT) FROM signal WHERE assessment_status = 'failed' OR assessment_error <> '' UNION ALL SELECT 'none', 0, 0"))
def queue_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of lists under the remaining filters, and of one whose required filter is missing."""
    t = Tables(spark, sf_dir)
    s = _sourced(t)
    lists = {
        "province": filtered(t, s.where("status = 'raw'"), geocode="Ok", priority="high", min_confidence="many", province_id=1002),
        "city": filtered(t, s, recommendation="review", assessment="not_generated", city_id=8),
        "failed": filtered(t, s, assessment="failed"),
        "none": required(s, None),
    }
    parts = [x.agg(F.lit(n).alias("list"), F.count("*").alias("n"), F.coalesce(F.sum("threat_score"), F.lit(0)).alias("points")) for n, x in lists.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def required(rows: DataFrame, value: object) -> DataFrame:
    """rows, or none of them where a required filter has no value."""
    return rows if value not in (None, "") else rows.where(F.lit(False))


def tri_state(rows: DataFrame, flag: str, asked: str) -> DataFrame:
    """yes and no filter by a flag, anything else doesn't."""
    return rows.where(F.col(flag)) if asked == "yes" else rows.where(~F.col(flag)) if asked == "no" else rows


@query(CATALOGUE_SQL + "SELECT a AS asked, name FROM c JOIN (VALUES ('yes'), ('no'), ('any')) v(a) ON a = 'any' OR (a = 'yes') = report_24h")
def flag_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = catalogue(Tables(spark, sf_dir))
    parts = [tri_state(d, "report_24h", a).select(F.lit(a).alias("asked"), "name") for a in ("yes", "no", "any")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(sql("SELECT 'disease' AS list, disease_tag AS choice FROM signal WHERE disease_tag <> '' GROUP BY 2 UNION ALL SELECT 'geocode', geocode_status FROM signal WHERE geocode_status <> '' GROUP BY 2 UNION ALL SELECT 'province', name FROM location WHERE level = 'province' AND id NOT IN (23, 24) UNION ALL SELECT 'city', name FROM location WHERE level <> 'province' AND id NOT IN (23, 24)"))
def filter_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct values that the filters of a list offer, in order."""
    t = Tables(spark, sf_dir)
    some = lambda rows, c, n: rows.where(F.col(c) != "").select(F.lit(n).alias("list"), F.col(c).alias("choice")).distinct()
    good = t.location.where("is_active and not is_false_positive")
    out = some(t.signal, "disease_tag", "disease").unionByName(some(t.signal, "geocode_status", "geocode"))
    return out.unionByName(some(good.where("level = 'province'"), "name", "province")).unionByName(some(good.where("level <> 'province'"), "name", "city")).orderBy("list", "choice")


@query(sql(", a AS (SELECT s.id, s.threat_score, published_at, created_at, is_high_risk, id IN (SELECT signal_id FROM plink) AS mapped FROM signal s WHERE status = 'approved'), c AS (SELECT count(*) AS total, count(*) FILTER (WHERE mapped) AS mapped_total, count(*) FILTER (WHERE is_high_risk) AS high FROM a) SELECT id, threat_score, total, mapped_total, high FROM a, c ORDER BY threat_score DESC, created_at DESC, id DESC LIMIT 25"))
def verified_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of approved signals by score, with the totals of the whole list."""
    t = Tables(spark, sf_dir)
    mapped = t.primary.select(F.col("signal_id").alias("id")).distinct().withColumn("mapped", F.lit(True))
    a = t.signal.where("status = 'approved'").join(mapped, "id", "left")
    totals = a.agg(F.count("*").alias("total"), F.count("mapped").alias("mapped_total"), F.count_if("is_high_risk").alias("high")).first()
    return page(a, 1, 25, sorting("-threat_score")).select("id", "threat_score", *[F.lit(totals[k]).cast("long").alias(k) for k in ("total", "mapped_total", "high")])


_RECENT = {"high_risk": ("threat_score > 50", 10), "errors": ("geocode_status not in ('OK', 'PENDING')", 10), "recent": ("status in ('validated', 'approved')", 75), "priority": ("status in ('validated', 'approved') and threat_score >= 50", 15)}


@query(sql(", " + ", ".join(f"r{i} AS (SELECT '{n}' AS list, id, threat_score, row_number() OVER (ORDER BY {'threat_score DESC, ' if n == 'priority' else ''}published_at DESC, created_at DESC, id DESC) AS place FROM signal WHERE {c})" for i, (n, (c, _)) in enumerate(_RECENT.items())) + " " + " UNION ALL ".join(f"SELECT * FROM r{i} WHERE place <= {k}" for i, (_, k) in enumerate(_RECENT.values()))))
def recent_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten newest risky signals, ten newest with geocode errors, the 75 newest of a report and its 15 of priority."""
    s, out = Tables(spark, sf_dir).signal, None
    for name, (condition, size) in _RECENT.items():
        keys = [F.desc("threat_score")] if name == "priority" else []
        keys += [F.desc("published_at"), F.desc("created_at"), F.desc("id")]
        top = s.where(condition).orderBy(*keys).limit(size)
        top = top.select(F.lit(name).alias("list"), "id", "threat_score", F.row_number().over(Window.orderBy(*keys)).alias("place"))
        out = out.unionByName(top) if out is not None else top
    return out


def readiness() -> dict[str, Column]:
    """Flags of a signal's brief from its own columns and placed, duplicates."""
    has = f"not ({_EMPTY})"
    return {
        "has_assessment": F.expr(has),
        "has_location": F.col("placed"),
        "has_source_url": F.expr("source_url <> ''"),
        "has_duplicates": F.expr("copies > 0"),
        "ready_for_validation": F.expr(f"status = 'raw' and {has} and placed"),
        "ready_for_approval": F.expr("status = 'validated' and placed"),
    }


def related_signals(t: Tables, anchors: DataFrame, top: int = 10) -> DataFrame:
    """(id, related ids) of anchors: the riskiest signals of the anchor's disease whose primary place is the anchor's, its child or its parent.

    Signals are ranked within disease and place first, then over the places near one, top + 1 kept, so an anchor meets one
    row. An id is one anchor.
    """
    order = F.struct((-F.col("threat_score")).alias("a"), (-F.unix_micros(F.col("published_at").cast("timestamp"))).alias("b"), (-F.unix_micros(F.col("created_at").cast("timestamp"))).alias("c"), (-F.col("id")).alias("d"))
    rows = t.signal.where("status <> 'noise'").select("id", F.lower("disease_tag").alias("d"), order.alias("o"))
    placed = t.primary.select(F.col("signal_id").alias("id"), "location_id").distinct().join(rows, "id").withColumn("part", F.pmod(F.xxhash64("id"), F.lit(64)))
    for keys in (["d", "location_id", "part"], ["d", "location_id"]):
        placed = placed.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy("o"))).where(F.col("k") <= top + 1)
    place = t.location.select(F.col("id").alias("place"), "parent_id")
    near = place.select("place", F.col("place").alias("location_id"))
    near = near.unionByName(place.where("parent_id is not null").select("place", F.col("parent_id").alias("location_id"))).unionByName(place.where("parent_id is not null").select(F.col("parent_id").alias("place"), F.col("place").alias("location_id")))
    # An anchor's list is its disease's and place's, less itself: one more than wanted is made once for each of these.
    met = near.join(placed.select("d", "location_id", F.col("id").alias("other"), "o"), "location_id").select("d", "place", "other", "o").distinct()
    met = met.withColumn("k", F.row_number().over(Window.partitionBy("d", "place").orderBy("o"))).where(F.col("k") <= top + 1)
    best = met.groupBy("d", "place").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "other"))), lambda x: x["other"]).alias("tops"))
    others = F.slice(F.filter("tops", lambda x: x != F.col("id")), 1, top)
    return anchors.join(best, ["d", "place"]).select("id", others.alias("related")).where(F.size("related") > 0)


_BRIEF = f"""CASE WHEN threat_score >= 70 THEN 'HIGH_RISK' WHEN related >= 3 THEN 'CLUSTERED' WHEN copies > 0 THEN 'DUPLICATES' ELSE 'ROUTINE' END"""


@query(sql(f""", fp AS (SELECT signal_id, first(location_id ORDER BY slot) AS place FROM plink GROUP BY 1), u AS (SELECT source_url, count(*) AS n FROM signal WHERE source_url <> '' AND status <> 'noise' GROUP BY 1),
near AS (SELECT id AS place, id AS location_id FROM location UNION ALL SELECT id, parent_id FROM location WHERE parent_id IS NOT NULL UNION ALL SELECT parent_id, id FROM location WHERE parent_id IS NOT NULL),
x AS (SELECT DISTINCT s.id, lower(disease_tag) AS d, location_id, threat_score, published_at, s.created_at FROM signal s JOIN plink ON signal_id = s.id WHERE status <> 'noise'),
a AS (SELECT s.id, lower(disease_tag) AS d, place FROM signal s JOIN fp ON signal_id = id WHERE status IN ('raw', 'validated') AND disease_tag <> ''),
r AS (SELECT DISTINCT a.id, x.id AS other, threat_score AS ts, published_at AS pa, created_at AS ca FROM a JOIN near ON near.place = a.place JOIN x ON x.d = a.d AND x.location_id = near.location_id AND x.id <> a.id),
k AS (SELECT id, other, row_number() OVER (PARTITION BY id ORDER BY ts DESC, pa DESC, ca DESC, other DESC) AS k FROM r), rel AS (SELECT id, string_agg(other, ',' ORDER BY k) AS ids, count(*) AS related FROM k WHERE k <= 10 GROUP BY 1),
b AS (SELECT s.*, coalesce(rel.ids, '') AS related_ids, coalesce(related, 0) AS related, coalesce(u.n, 0) - CASE WHEN source_url <> '' THEN 1 ELSE 0 END AS copies, p.name AS place, CASE WHEN p.level = 'province' THEN p.name ELSE q.name END AS province, p.id IS NOT NULL AS placed FROM signal s LEFT JOIN rel USING (id) LEFT JOIN u USING (source_url) LEFT JOIN fp ON signal_id = s.id LEFT JOIN location p ON p.id = fp.place LEFT JOIN location q ON q.id = p.parent_id WHERE status IN ('raw', 'validated'))
SELECT id, coalesce(place, nullif(raw_location_text, ''), 'unmapped') AS place, coalesce(province, '-') AS province, related_ids, CASE WHEN threat_score >= 70 THEN 'HIGH' WHEN threat_score >= 50 THEN 'MEDIUM_HIGH' WHEN threat_score >= 35 THEN 'MEDIUM' ELSE 'LOW' END AS label, {_BRIEF} AS warning, NOT ({_EMPTY}) AS has_assessment, placed AS has_location, source_url <> '' AS has_source_url, copies > 0 AS has_duplicates, status = 'raw' AND NOT ({_EMPTY}) AND placed AS ready_for_validation, status = 'validated' AND placed AS ready_for_approval FROM b"""))
def signal_briefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The brief of every queued signal: place, ten related signals, label, narrative code and readiness; copies are by URL."""
    t = Tables(spark, sf_dir)
    s = t.signal.where("status in ('raw', 'validated')")
    first = t.primary.groupBy(F.col("signal_id").alias("id")).agg(F.min_by(F.struct(F.col("location_id"), "place", "level", "parent_id"), "slot").alias("p"))
    parent = t.location.select(F.col("id").alias("parent_id"), F.col("name").alias("parent"))
    first = first.select("id", "p.*").join(parent, "parent_id", "left")
    copies = t.signal.where("source_url <> '' and status <> 'noise'").groupBy("source_url").agg(F.count("*").alias("n"))
    anchors = s.where("disease_tag <> ''").select("id", F.lower("disease_tag").alias("d")).join(first.select("id", F.col("location_id").alias("place")), "id")
    x = s.join(first, "id", "left").join(copies, "source_url", "left").join(related_signals(t, anchors), "id", "left")
    x = x.withColumns({"placed": F.col("location_id").isNotNull(), "copies": F.expr("coalesce(n, 0) - if(source_url <> '', 1, 0)"), "others": F.coalesce("related", F.array().cast("array<bigint>"))}).withColumn("related", F.size("others"))
    label = ladder(("threat_score >= 70", "HIGH"), ("threat_score >= 50", "MEDIUM_HIGH"), ("threat_score >= 35", "MEDIUM"), default="LOW")
    return x.select("id", F.expr("coalesce(place, nullif(raw_location_text, ''), 'unmapped')").alias("place"), F.expr("coalesce(if(level = 'province', place, parent), '-')").alias("province"), F.array_join(F.col("others").cast("array<string>"), ",").alias("related_ids"), label.alias("label"), F.expr(_BRIEF).alias("warning"), *[c.alias(n) for n, c in readiness().items()])


#: Words of a disease's name and the code of what is advised for it, first that holds.
ACTIONS = [(["dbd", "demam berdarah", "dengue", "chikungunya", "malaria"], "VECTOR"), (["campak", "measles", "rubella"], "IMMUNISATION"), (["rabies"], "RABIES"), (["anthrax", "antraks"], "ONE_HEALTH"), (["influenza", "ispa", "pneumonia"], "RESPIRATORY")]


def advised(disease: str) -> Column:
    return ladder(*((" or ".join(f"contains(lower({disease}), '{w}')" for w in words), code) for words, code in ACTIONS), default="GENERAL")


_LEVEL = "CASE WHEN high >= 3 OR avg_score >= 70 THEN 'RED' WHEN high >= 1 OR avg_score >= 55 THEN 'ORANGE' WHEN total >= 3 OR avg_score >= 40 THEN 'YELLOW' ELSE 'GREEN' END"


@query(sql(f""", e AS (SELECT DISTINCT l.location_id AS target, s.* FROM signal s JOIN plink l ON signal_id = s.id WHERE status <> 'noise' AND disease_tag <> '' AND published_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY),
g AS (SELECT target, lower(disease_tag) AS d, count(*) AS total, sum(threat_score) AS s, count(*) FILTER (WHERE threat_score >= 70) AS high FROM e GROUP BY ALL), a AS (SELECT *, {r2('s', 'total')} AS avg_score FROM g),
k AS (SELECT target, lower(disease_tag) AS d, id, row_number() OVER (PARTITION BY target, lower(disease_tag) ORDER BY threat_score DESC, published_at DESC, id DESC) AS k FROM e), t AS (SELECT target, d, string_agg(id, ',' ORDER BY k) AS evidence FROM k WHERE k <= 25 GROUP BY ALL)
SELECT target, d AS disease, total, high, avg_score, {_LEVEL} AS level, CASE WHEN {_LEVEL} IN ('RED', 'ORANGE') THEN 'ESCALATE' WHEN {_LEVEL} = 'YELLOW' THEN 'MONITOR' ELSE 'ROUTINE' END AS package, CASE WHEN contains(d, 'dbd') THEN 'VECTOR' WHEN contains(d, 'campak') THEN 'IMMUNISATION' WHEN contains(d, 'rabies') THEN 'RABIES' WHEN contains(d, 'antraks') THEN 'ONE_HEALTH' ELSE 'GENERAL' END AS action, evidence FROM a JOIN t USING (target, d)"""))
def alert_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page of each place and disease of the last week: totals, level, package and action codes, the first 25 signals by score."""
    t = Tables(spark, sf_dir)
    s = t.signal.where(F.expr(f"status <> 'noise' and disease_tag <> '' and published_at >= timestamp_ntz'{AS_OF}' - interval 7 days"))
    e = t.primary.select(F.col("signal_id").alias("id"), F.col("location_id").alias("target")).distinct().join(s, "id").withColumn("d", F.lower("disease_tag"))
    g = e.groupBy("target", "d").agg(F.count("*").alias("total"), F.sum("threat_score").alias("s"), F.count_if(F.col("threat_score") >= 70).alias("high")).withColumn("avg_score", ratio2("s", "total"))
    order = F.struct((-F.col("threat_score")).alias("a"), (-F.unix_micros(F.col("published_at").cast("timestamp"))).alias("b"), (-F.col("id")).alias("c"))
    e = e.select("target", "d", "id", order.alias("o"), F.pmod(F.xxhash64("id"), F.lit(64)).alias("part"))
    for keys in (["target", "d", "part"], ["target", "d"]):
        e = e.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy("o"))).where("k <= 25")
    top = e.groupBy("target", "d").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "id"))), lambda x: x["id"].cast("string")), ",").alias("evidence"))
    level = F.expr(_LEVEL)
    package = F.when(level.isin("RED", "ORANGE"), "ESCALATE").when(level == "YELLOW", "MONITOR").otherwise("ROUTINE")
    return g.join(top, ["target", "d"]).select("target", F.col("d").alias("disease"), "total", "high", "avg_score", level.alias("level"), package.alias("package"), advised("d").alias("action"), "evidence")


#: Codes of alert types and their labels.
ALERT_TYPES = {"disease_spike_province": "Disease Spike Province", "disease_cluster_city": "Disease Cluster City", "new_disease_location": "New Disease Location", "immediate_disease_signal": "Immediate Disease Signal", "emerging_disease_signal": "Emerging Disease Signal", "reemerging_disease_location": "Re-emerging Disease Location", "unknown_cluster_signal": "Unknown Cluster Signal"}


def edit_alerts(alerts: DataFrame, edits: DataFrame, statuses: tuple[str, ...] = ("open", "monitoring", "closed")) -> DataFrame:
    """alerts after edits (id, to_status, note): a known status is taken, the description only with it; before and after images of changed rows."""
    x = alerts.join(edits, "id", "left")
    ok = F.coalesce(F.col("to_status").isin(*statuses), F.lit(False))
    x = x.withColumns({"new_status": F.when(ok, F.col("to_status")).otherwise(F.col("status")), "new_description": F.when(ok & F.col("note").isNotNull(), F.col("note")).otherwise(F.col("description"))})
    changed = (F.col("new_status") != F.col("status")) | (F.col("new_description") != F.col("description"))
    image = lambda s, d: F.to_json(F.struct(F.col(s).alias("status"), F.col(d).alias("description")))
    labels = F.create_map(*[F.lit(v) for kv in ALERT_TYPES.items() for v in kv])
    return x.select("id", F.coalesce(labels[F.col("alert_type")], F.col("alert_type")).alias("type_label"), F.col("new_status").alias("status"), F.when(changed, image("status", "description")).alias("before_data"), F.when(changed, image("new_status", "new_description")).alias("after_data"))


@query(sql(", a AS (SELECT id, ['disease_spike_province', 'disease_cluster_city', 'new_disease_location', 'immediate_disease_signal', 'emerging_disease_signal', 'reemerging_disease_location', 'unknown_cluster_signal', 'other'][CAST(id % 8 + 1 AS INTEGER)] AS ty, CASE WHEN id % 2 = 0 THEN 'open' ELSE 'monitoring' END AS s, 'd' || id AS d, CASE id % 4 WHEN 0 THEN 'closed' WHEN 1 THEN 'odd' WHEN 2 THEN 'open' END AS ts, CASE WHEN id % 3 = 0 THEN 'n' || id END AS n FROM signal), b AS (SELECT *, CASE WHEN ts IN ('open', 'closed') THEN ts ELSE s END AS ns, CASE WHEN ts IN ('open', 'closed') AND n IS NOT NULL THEN n ELSE d END AS nd FROM a) SELECT id, CASE ty WHEN 'disease_spike_province' THEN 'Disease Spike Province' WHEN 'disease_cluster_city' THEN 'Disease Cluster City' WHEN 'new_disease_location' THEN 'New Disease Location' WHEN 'immediate_disease_signal' THEN 'Immediate Disease Signal' WHEN 'emerging_disease_signal' THEN 'Emerging Disease Signal' WHEN 'reemerging_disease_location' THEN 'Re-emerging Disease Location' WHEN 'unknown_cluster_signal' THEN 'Unknown Cluster Signal' ELSE ty END AS type_label, ns AS status, CASE WHEN ns <> s OR nd <> d THEN '{\"status\":\"' || s || '\",\"description\":\"' || d || '\"}' END AS before_data, CASE WHEN ns <> s OR nd <> d THEN '{\"status\":\"' || ns || '\",\"description\":\"' || nd || '\"}' END AS after_data FROM b"))
def alert_status_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts, one for each signal, under edits that change status, description, both or nothing."""
    s = Tables(spark, sf_dir).signal
    types = F.array(*map(F.lit, [*ALERT_TYPES, "other"]))
    alerts = s.select("id", F.element_at(types, (F.col("id") % 8 + 1).cast("int")).alias("alert_type"), F.expr("if(id % 2 = 0, 'open', 'monitoring')").alias("status"), F.concat(F.lit("d"), "id").alias("description"))
    edits = s.where("id % 4 <> 3").select("id", F.expr("case id % 4 when 0 then 'closed' when 1 then 'odd' when 2 then 'open' end").alias("to_status"), F.expr("if(id % 3 = 0, concat('n', id), null)").alias("note"))
    return edit_alerts(alerts, edits)


def risk_class(avg: str, high: str, total: str) -> str:
    return f"CASE WHEN {avg} >= 70 OR {high} >= 3 THEN 'HIGH' WHEN {avg} >= 50 OR {high} >= 1 THEN 'MEDIUM_HIGH' WHEN {avg} >= 35 OR {total} >= 5 THEN 'MEDIUM' ELSE 'LOW' END"


_REPORT = f", v AS (SELECT * FROM signal WHERE status IN ('validated', 'approved') AND published_at >= TIMESTAMP '2024-01-17' AND published_at <= TIMESTAMP '{AS_OF}')"


@query(sql(_REPORT + f""", d AS (SELECT disease_tag AS title, count(*) AS total, count(*) FILTER (WHERE threat_score >= 70) AS high, {r2('sum(threat_score)', 'count(*)')} AS avg_score FROM v WHERE disease_tag <> '' GROUP BY 1),
dk AS (SELECT *, row_number() OVER (ORDER BY total DESC, avg_score DESC, title) AS k FROM d), l AS (SELECT place AS title, count(DISTINCT id) AS total, count(DISTINCT id) FILTER (WHERE threat_score >= 70) AS high, {r2('sum(threat_score)', 'count(*)')} AS avg_score FROM (SELECT DISTINCT location_id, place, v.id, threat_score FROM plink JOIN v ON v.id = signal_id) GROUP BY location_id, place),
lk AS (SELECT *, row_number() OVER (ORDER BY total DESC, avg_score DESC, title) AS k FROM l), n AS (SELECT count(*) FILTER (WHERE threat_score >= 70) AS high, count(*) FILTER (WHERE assessment_summary = '') AS pending, count(*) AS total FROM v),
f AS (SELECT 10 + k AS o, 'disease' AS kind, title, total, high, avg_score, {risk_class('avg_score', 'high', 'total')} AS level FROM dk WHERE k <= 5 UNION ALL SELECT 20, 'place', title, total, high, avg_score, {risk_class('avg_score', 'high', 'total')} FROM lk WHERE k = 1 AND total >= 2 UNION ALL SELECT 30, 'high_risk', '', high, high, 0, 'HIGH' FROM n WHERE high > 0 UNION ALL SELECT 40, 'assessment', '', pending, 0, 0, 'SUPPORTING' FROM n WHERE pending > 0)
SELECT row_number() OVER (ORDER BY o) AS place, kind, title, total, high, CAST(avg_score AS DOUBLE) AS avg_score, level, CASE kind WHEN 'disease' THEN CASE WHEN level IN ('HIGH', 'MEDIUM_HIGH') THEN 'FOCUS' ELSE 'WATCH' END WHEN 'place' THEN 'CONCENTRATION' WHEN 'high_risk' THEN 'VERIFY' ELSE 'COMPLETE' END AS note FROM f QUALIFY row_number() OVER (ORDER BY o) <= 8"""))
def report_focus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a report puts first: five diseases, the leading place, risky signals, missing assessments; texts as codes."""
    t = Tables(spark, sf_dir)
    v = t.signal.where(F.expr(f"status in ('validated', 'approved') and published_at >= timestamp_ntz'2024-01-17 00:00:00' and published_at <= timestamp_ntz'{AS_OF}'"))
    sums = [F.count("*").alias("total"), F.count_if(F.col("threat_score") >= 70).alias("high"), F.sum("threat_score").alias("s")]
    top = lambda g, n: g.withColumn("avg_score", ratio2("s", "total")).orderBy(F.desc("total"), F.desc("avg_score"), "title").limit(n)
    d = top(v.where("disease_tag <> ''").groupBy(F.col("disease_tag").alias("title")).agg(*sums), 5)
    d = d.select((F.row_number().over(Window.orderBy(F.desc("total"), F.desc("avg_score"), "title")) + 10).alias("o"), F.lit("disease").alias("kind"), "title", "total", "high", "avg_score", F.expr(risk_class("avg_score", "high", "total")).alias("level"))
    links = t.primary.select(F.col("signal_id").alias("id"), "location_id", "place").distinct().join(v.select("id", "threat_score"), "id")
    p = top(links.groupBy("location_id", F.col("place").alias("title")).agg(*sums), 1).where("total >= 2").select(F.lit(20).alias("o"), F.lit("place").alias("kind"), "title", "total", "high", "avg_score", F.expr(risk_class("avg_score", "high", "total")).alias("level"))
    n = v.agg(F.count_if(F.col("threat_score") >= 70).alias("high"), F.count_if(F.expr(_EMPTY)).alias("pending"))
    fixed = lambda o, kind, total, high, level: n.select(F.lit(o).alias("o"), F.lit(kind).alias("kind"), F.lit("").alias("title"), F.col(total).alias("total"), high.cast("long").alias("high"), F.lit(0.0).alias("avg_score"), F.lit(level).alias("level")).where("total > 0")
    every = d.unionByName(p).unionByName(fixed(30, "high_risk", "high", F.col("high"), "HIGH")).unionByName(fixed(40, "assessment", "pending", F.lit(0), "SUPPORTING"))
    note = ladder(("kind = 'disease' and level in ('HIGH', 'MEDIUM_HIGH')", "FOCUS"), ("kind = 'disease'", "WATCH"), ("kind = 'place'", "CONCENTRATION"), ("kind = 'high_risk'", "VERIFY"), default="COMPLETE")
    return every.withColumn("place", F.row_number().over(Window.orderBy("o"))).where("place <= 8").select("place", "kind", "title", "total", "high", "avg_score", "level", note.alias("note"))


def recommendations(scope: str, totals: DataFrame) -> DataFrame:
    """(place, basis, priority) of a report from one row: high, top_place_total, top_disease_total, pending; a routine line where nothing holds."""
    rules = [("HIGH_RISK", "HIGH", "high > 0"), ("PLACE", "MEDIUM_HIGH", "top_place_total >= 2"), ("DISEASE", "MEDIUM", f"top_disease_total >= 2 and {str(scope in ('general', 'region')).lower()}"), ("ASSESSMENT", "SUPPORTING", "pending > 0")]
    made = F.filter(F.array(*[F.when(F.expr(c), F.struct(F.lit(b).alias("basis"), F.lit(p).alias("priority"))) for b, p, c in rules]), lambda x: x.isNotNull())
    routine = F.array(F.struct(F.lit("ROUTINE").alias("basis"), F.lit("NORMAL").alias("priority")))
    return totals.select(F.posexplode(F.when(F.size(made) > 0, made).otherwise(routine)).alias("place", "r")).select((F.col("place") + 1).alias("place"), "r.*")


@query(sql(_REPORT + ", n AS (SELECT count(*) FILTER (WHERE threat_score >= 70) AS high, count(*) FILTER (WHERE assessment_summary = '') AS pending, coalesce((SELECT max(c) FROM (SELECT count(*) AS c FROM v WHERE disease_tag <> '' GROUP BY disease_tag)), 0) AS td, coalesce((SELECT max(c) FROM (SELECT count(DISTINCT id) AS c FROM plink JOIN v ON id = signal_id GROUP BY location_id)), 0) AS tp FROM v), r AS (SELECT s.scope, x.* FROM n, (VALUES ('general'), ('disease')) s(scope), LATERAL (SELECT * FROM (VALUES (1, 'HIGH_RISK', 'HIGH', high > 0), (2, 'PLACE', 'MEDIUM_HIGH', tp >= 2), (3, 'DISEASE', 'MEDIUM', td >= 2 AND s.scope = 'general'), (4, 'ASSESSMENT', 'SUPPORTING', pending > 0)) y(o, basis, priority, holds)) x WHERE holds) SELECT scope, CAST(row_number() OVER (PARTITION BY scope ORDER BY o) AS INTEGER) AS place, basis, priority FROM r UNION ALL SELECT 'region', 1, 'ROUTINE', 'NORMAL'"))
def report_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recommendations of a general and a disease report, and of a region without signals."""
    t = Tables(spark, sf_dir)
    v = t.signal.where(F.expr(f"status in ('validated', 'approved') and published_at >= timestamp_ntz'2024-01-17 00:00:00' and published_at <= timestamp_ntz'{AS_OF}'"))

    def totals(rows: DataFrame) -> DataFrame:
        most = lambda g: g.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n")).first()[0]
        disease = most(rows.where("disease_tag <> ''").groupBy("disease_tag").agg(F.count("*").alias("n")))
        place = most(t.primary.join(rows.select(F.col("id").alias("signal_id")), "signal_id").groupBy("location_id").agg(F.countDistinct("signal_id").alias("n")))
        return rows.agg(F.count_if(F.col("threat_score") >= 70).alias("high"), F.count_if(F.expr(_EMPTY)).alias("pending")).withColumns({"top_disease_total": F.lit(disease), "top_place_total": F.lit(place)})

    parts = [recommendations(scope, totals(rows)).withColumn("scope", F.lit(scope)) for scope, rows in (("general", v), ("disease", v), ("region", required(v, None)))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def report_readiness(scope: str, disease: str, province_id: int | None, city_id: int | None) -> list[str]:
    """What a report of this scope still needs."""
    missing = ["disease"] if scope in ("disease", "disease_region") and not disease else []
    return missing + (["region"] if scope in ("region", "disease_region") and not (province_id or city_id) else [])


@query(sql(_REPORT + ", s(scope, d, pid, cid) AS (VALUES ('general', '', NULL, NULL), ('disease', 'rabies', NULL, NULL), ('region', '', 1001, NULL), ('region_city', '', NULL, 6), ('disease_region', 'campak', 1002, NULL)) SELECT scope, count(v.id) AS total, count(v.id) FILTER (WHERE threat_score >= 70) AS high, CAST(coalesce(sum(threat_score), 0) AS BIGINT) AS points FROM s LEFT JOIN v ON (d = '' OR lower(disease_tag) = d) AND (pid IS NULL OR v.id IN (SELECT signal_id FROM plink WHERE location_id = pid OR parent_id = pid)) AND (cid IS NULL OR v.id IN (SELECT signal_id FROM plink WHERE location_id = cid)) GROUP BY scope UNION ALL SELECT 'disease_missing', 0, 0, 0"))
def report_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's population under each scope, and one that lacks its disease."""
    t = Tables(spark, sf_dir)
    v = t.signal.where(F.expr(f"status in ('validated', 'approved') and published_at >= timestamp_ntz'2024-01-17 00:00:00' and published_at <= timestamp_ntz'{AS_OF}'"))
    asked = {"general": {}, "disease": {"disease": "Rabies"}, "region": {"province_id": 1001}, "region_city": {"city_id": 6}, "disease_region": {"disease": "campak", "province_id": 1002}, "disease_missing": {}}
    out = None
    for name, given in asked.items():
        scope = {"region_city": "region", "disease_missing": "disease"}.get(name, name)
        missing = report_readiness(scope, given.get("disease", ""), given.get("province_id"), given.get("city_id"))
        rows = required(filtered(t, v, **given), None if missing else scope)
        part = rows.agg(F.lit(name).alias("scope"), F.count("*").alias("total"), F.count_if(F.col("threat_score") >= 70).alias("high"), F.coalesce(F.sum("threat_score"), F.lit(0)).alias("points"))
        out = out.unionByName(part) if out is not None else part
    return out
