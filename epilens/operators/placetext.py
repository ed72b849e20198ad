"""Places of texts in full: candidates with their stop-word cut, search forms, best match, extractor, fallbacks, resolver ladder, backfills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epilens.functions.numeric import ladder
from epilens.functions.text import first_of_each, region_code, resolver_key, search_text, squeeze, starting
from epilens.operators.gazetteer import JUNK, PROVINCE_ALIASES, RISK_WORDS, TOO_GENERAL, aliases, forms, validity
from epilens.operators.phraseindex import leftmost_longest, mentions
from epilens.operators.places import candidate_confidence, candidates
from epilens.registry import query
from epilens.sources.adapter import Tables, sql

# Words before a place, words that end one, administrative prefixes, calendar words.
LEADS = ["di", "ke", "dari", "wilayah", "area", "sekitar", "menuju", "asal"]
STOPS = ["turun", "naik", "berkat", "karena", "dengan", "untuk", "dalam", "akibat", "sejak", "hingga", "dan", "yang", "jadi", "mulai", "aman", "dikonsumsi", "terbaru", "bikin", "heboh", "harga", "program", "larang", "impor", "unggas", "gejala", "banyak", "dialami", "anak", "pengusaha", "jamin", "ayam"]
PREFIXES = ["provinsi", r"prov\.", "kabupaten", r"kab\.", "kab", "kota", "kecamatan", r"kec\.", "kelurahan", "desa"]
FORM_PREFIXES = ["", "Kabupaten ", "Kab. ", "Kab ", "Kota ", "Provinsi ", "Kecamatan ", "Dinkes ", "Dinas Kesehatan ", "Pemkab ", "Pemkot ", "Pemprov "]
CALENDAR = ["Tahun", "Hari", "Pekan", "Minggu", "Bulan", "Senin", "Selasa", "Rabu", "Kamis", "Jumat", "Sabtu"]
_NAME = r"[A-Z][A-Za-z'`-]+(?:[ \t\n\x0B\f\r]+[A-Z][A-Za-z'`-]+){0,4}"
_TRIM = r" ,.;:\-()\[\]{}"
_B = "(?:^|[^A-Za-z0-9_])"


def spaced(c: Column) -> Column:
    """The matching form with spaces: dots and hyphens are spaces."""
    c = F.replace(F.regexp_replace(F.lower(F.trim(c)), r"[^a-z0-9 \t\n\x0B\f\r.-]", " "), F.lit("."), F.lit(" "))
    return F.trim(F.regexp_replace(c, r"[ \t\n\x0B\f\r-]+", " "))


def region_like(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.replace(spaced(c), F.lit(" "), F.lit("_")), "_+", "_"), "^_+|_+$", "")


def without_prefix(c: Column) -> Column:
    """Without one leading administrative word that a space follows, spelling kept."""
    return F.trim(F.regexp_replace(F.trim(c), rf"(?i)^({'|'.join(PREFIXES)})[ \t\n\x0B\f\r]+", ""))


def title_slug(title: Column) -> Column:
    """The title without its publisher as a URL slug; dots vanish."""
    from epilens.functions.text import headline

    c = F.replace(F.lower(squeeze(headline(title)[0])), F.lit("."), F.lit(""))
    c = F.regexp_replace(F.regexp_replace(c, r"[^a-z0-9 \t\n\x0B\f\r-]", " "), r"[ \t\n\x0B\f\r-]+", "-")
    return F.regexp_replace(c, "^-+|-+$", "")


_SP = r"trim(regexp_replace(replace(regexp_replace(lower(trim({0})), '[^a-z0-9 \t\n\x0B\f\r.-]', ' ', 'g'), '.', ' '), '[ \t\n\x0B\f\r-]+', ' ', 'g'))"
_NP = r"trim(regexp_replace(trim({0}), '(?i)^(" + "|".join(PREFIXES) + r")[ \t\n\x0B\f\r]+', ''))"
_RL = "regexp_replace(regexp_replace(replace(" + _SP + ", ' ', '_'), '_+', '_', 'g'), '^_+|_+$', '', 'g')"
_PLACES = "SELECT id, CASE id % 8 WHEN 0 THEN 'Kab. ' || name WHEN 1 THEN 'KOTA  ' || name WHEN 2 THEN 'Prov. ' || name || '-x_y' WHEN 3 THEN 'Kec. St. ' || name || ' & co' WHEN 4 THEN 'kabupatena ' || name WHEN 5 THEN '  Desa ' || name || ' ' ELSE name || ' - News: A.B.C! Portal - ' || id END AS p FROM location"


@query(sql(f", x AS ({_PLACES}), y AS (SELECT id, p, CASE WHEN contains(p, ' - ') THEN left(p, length(p) - length(string_split(p, ' - ')[-1]) - 3) ELSE p END AS h FROM x) SELECT id, {_SP.format('p')} AS spaced, {_RL.format('p')} AS region_like, {_NP.format('p')} AS bare, " + r"regexp_replace(regexp_replace(regexp_replace(replace(lower(trim(regexp_replace(h, '[ \t\n\x0B\f\r]+', ' ', 'g'))), '.', ''), '[^a-z0-9 \t\n\x0B\f\r-]', ' ', 'g'), '[ \t\n\x0B\f\r-]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM y"))
def place_text_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised forms of place names with prefixes, dots, hyphens, ampersands and publishers."""
    p = F.expr(_PLACES.split("SELECT id, ")[1].split(" AS p FROM")[0])
    x = Tables(spark, sf_dir).location.select("id", p.alias("p"))
    return x.select("id", spaced(F.col("p")).alias("spaced"), region_like(F.col("p")).alias("region_like"), without_prefix(F.col("p")).alias("bare"), title_slug(F.col("p")).alias("slug"))


def _cut(c: Column, stops: list[str]) -> Column:
    """Before the first stop word, trimmed of punctuation."""
    padded = F.regexp_replace(c, rf"(?is){_B}(?:{'|'.join(stops)})(?:[^A-Za-z0-9_].*)?\z", "")
    return F.regexp_replace(padded, rf"^[{_TRIM}]+|[{_TRIM}]+$", "")


def text_candidates(rows: DataFrame, text: str, leads: list[str] = LEADS, kinds: tuple[list[str], list[str]] = (["Kabupaten", r"Kab\.", "Kab", "Kota", "Provinsi"], ["Kecamatan", r"Kec\.", "Kelurahan", "Desa"]), stops: list[str] = STOPS) -> DataFrame:
    """rows with candidates: capitalised names after a lead word or with an administrative one, cut at stop words, of three characters and more, each once in its normal form."""
    patterns = [rf"{starting(*leads)}[ \t\n\x0B\f\r]+({_NAME})", *[rf"({starting(*k)}[ \t\n\x0B\f\r]+{_NAME})" for k in kinds]]
    found = F.flatten(F.array(*[F.regexp_extract_all(F.col(text), F.lit(p), 1) for p in patterns]))
    cut = F.filter(F.transform(found, lambda x: _cut(x, stops)), lambda x: F.length(x) >= 3)
    return first_of_each(rows, cut, spaced, "candidates")


#: Lead, administrative and stop words that occur in the test texts.
TEST_LEADS, TEST_KINDS, TEST_STOPS = ["the", "of", "and"], (["The", "Of"], ["In", "For"]), ["is", "to", "that"]
_CANDIDATES = "flatten([" + ", ".join(f"regexp_extract_all(text, '{p}', 1)" for p in [rf"{_B}(?:{'|'.join(TEST_LEADS)})[ \t\n\x0B\f\r]+({_NAME})".replace("'", "''"), *[rf"{_B}((?:{'|'.join(k)})[ \t\n\x0B\f\r]+{_NAME})".replace("'", "''") for k in TEST_KINDS]]) + "])"


@query(f"WITH c AS (SELECT doc_id, list_filter(list_transform({_CANDIDATES}, lambda x: regexp_replace(regexp_replace(x, '(?is){_B}(?:{'|'.join(TEST_STOPS)})(?:[^A-Za-z0-9_].*)?\\z', ''), '^[{_TRIM}]+|[{_TRIM}]+$', '', 'g')), lambda x: length(x) >= 3) AS c FROM documents), f AS (SELECT doc_id, c, list_transform(c, lambda x: {_SP.format('x')}) AS f FROM c), d AS (SELECT doc_id, list_filter(c, lambda x, i: list_position(f, f[i]) = i) AS c FROM f) SELECT doc_id, CAST(len(c) AS BIGINT) AS n, md5(array_to_string(c, '|')) AS digest FROM d")
def place_names_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = text_candidates(Tables(spark, sf_dir).texts("documents"), "text", TEST_LEADS, TEST_KINDS, TEST_STOPS)
    return x.select("doc_id", F.size("candidates").cast("long").alias("n"), F.md5(F.encode(F.array_join("candidates", "|"), "UTF-8")).alias("digest"))


def search_forms(place: Column) -> Column:
    """The text and its bare form, each with twelve prefixes, distinct in order."""
    raw, bare = F.trim(place), without_prefix(place)
    forms = F.concat(*[F.transform(F.array(*map(F.lit, FORM_PREFIXES)), lambda p: F.concat(p, x)) for x in (raw, bare)])  # noqa: B023
    return F.when(raw == "", F.array().cast("array<string>")).otherwise(F.array_distinct(forms))


def best_of_candidates(candidates: DataFrame, places: DataFrame) -> DataFrame:
    """id, location_id, method, confidence of each signal's surest candidate; among equals the earliest.

    candidates: id, seq, text, origin (raw, title or content). Forms of candidates meet aliases and names on their
    normal forms, one equi-join each.
    """
    forms = candidates.select("id", "seq", "origin", F.posexplode(search_forms(F.col("text"))).alias("form_no", "form"))
    keys = F.array_distinct(F.array(region_like(F.col("form")), region_like(without_prefix(F.col("form")))))
    forms = forms.withColumn("key", F.explode(keys)).where("key <> ''")
    good = places.where("is_active and not is_false_positive")
    named = aliases(good).select("location_id", region_like(F.col("normalized")).alias("key"), F.lit("alias").alias("method"))
    own = good.select(F.col("id").alias("location_id"), region_like(F.col("name")).alias("key"), F.lit("gazetteer").alias("method"))
    known = named.unionByName(own).distinct().join(good.select(F.col("id").alias("location_id"), "level"), "location_id")
    met = forms.join(known, "key").withColumn("confidence", candidate_confidence("origin", "method = 'alias'", "level"))
    order = F.struct((-F.col("confidence")).alias("c"), "seq", "form_no", "method", "location_id")
    best = met.groupBy("id").agg(F.min_by(F.struct("location_id", "method", "confidence"), order).alias("b"))
    return best.select("id", "b.*")


_RAWS = "case event_id % 6 when 0 then '' when 1 then lower(name) when 2 then concat('Kota ', name) when 3 then concat('Dinkes ', name) when 4 then concat('  ', initcap(name), ' ') else 'Nowhere' end"


@query(sql(r""", e AS (SELECT event_id AS id, CASE event_id % 6 WHEN 0 THEN '' WHEN 1 THEN lower(n_name) WHEN 2 THEN 'Kota ' || n_name WHEN 3 THEN 'Dinkes ' || n_name WHEN 4 THEN n_name ELSE 'Nowhere' END AS raw, CASE WHEN event_id % 4 = 0 THEN (SELECT r_name FROM region WHERE r_regionkey = event_id % 5) ELSE '' END AS title FROM events JOIN nation ON n_nationkey = user_id % 25),
c AS (SELECT id, 1 AS seq, raw AS t, 'raw' AS origin FROM e WHERE raw <> '' UNION ALL SELECT id, 2, title, 'title' FROM e WHERE title <> ''),
k AS (SELECT id, seq, origin, regexp_replace(regexp_replace(lower(t), '^(kota|dinkes) ', ''), '[^a-z0-9]+', '_', 'g') AS bare, lower(t) LIKE 'dinkes %' AS d FROM c),
g AS (SELECT id AS location_id, level, regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g') AS key FROM location WHERE id NOT IN (23, 24)),
m AS (SELECT k.id, k.seq, location_id, least(99, CASE origin WHEN 'raw' THEN 96 ELSE 95 END + 1 + CASE WHEN level = 'province' THEN -3 ELSE 2 END) AS p FROM k JOIN g ON key = bare WHERE NOT d)
SELECT id, arg_min(location_id, (-p, seq)) AS location_id, 'alias' AS method, max(p) / 100.0::DOUBLE AS confidence FROM m GROUP BY 1"""))
def best_candidate_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best place of raw texts and titles by search forms."""
    t = Tables(spark, sf_dir)
    nation = t.raw("nation").select(F.col("n_nationkey").cast("long").alias("nk"), F.col("n_name").alias("name"))
    region = t.raw("region").select(F.col("r_regionkey").cast("long").alias("rk"), F.col("r_name").alias("region"))
    e = t.raw("events").withColumns({"nk": F.col("user_id") % 25, "rk": F.col("event_id") % 5}).join(nation, "nk").join(region, "rk")
    e = e.select(F.col("event_id").alias("id"), F.trim(F.expr(_RAWS)).alias("raw"), F.expr("if(event_id % 4 = 0, region, '')").alias("title"))
    c = e.select("id", F.explode(F.array(F.struct(F.lit(1).alias("seq"), F.col("raw").alias("text"), F.lit("raw").alias("origin")), F.struct(F.lit(2).alias("seq"), F.col("title").alias("text"), F.lit("title").alias("origin")))).alias("c")).select("id", "c.*")
    return best_of_candidates(c.where("text <> ''"), t.location)


def pattern_place(text: Column, leads: list[str], kinds: list[str], calendar: list[str] = CALENDAR) -> Column:
    """The first capitalised name after lead and administrative word, after a lead word, or after an administrative word; cut at a calendar word, '' below three characters."""
    name = r"([A-Z][A-Za-z0-9_.-]+(?:\s+[A-Z][A-Za-z0-9_.-]+){0,4})"
    patterns = [rf"{starting(*leads)}\s+(?:{'|'.join(kinds)})\s+{name}", rf"{starting(*leads)}\s+{name}", rf"{starting(*kinds)}\s+{name}"]
    found = F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns], F.lit(""))
    found = squeeze(F.regexp_replace(found, "^[ ,.;:()-]+|[ ,.;:()-]+$", ""))
    cut = F.trim(F.regexp_replace(found, rf"(?s){_B}(?:{'|'.join(calendar)})(?:[^A-Za-z0-9_].*)?\z", ""))
    return F.when(F.length(found) >= 3, cut).otherwise("")


_PN = r"([A-Z][A-Za-z0-9_.-]+(?:\s+[A-Z][A-Za-z0-9_.-]+){0,4})"
_PATTERN = "coalesce(" + ", ".join(f"nullif(regexp_extract(text, '{p}', 1), '')" for p in [rf"{_B}(?:the|of)\s+(?:In|The)\s+{_PN}", rf"{_B}(?:the|of)\s+{_PN}", rf"{_B}(?:In|The)\s+{_PN}"]) + ", '')"


@query(f"WITH x AS (SELECT doc_id, trim(regexp_replace(regexp_replace({_PATTERN}, '^[ ,.;:()-]+|[ ,.;:()-]+$', '', 'g'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS f FROM documents) SELECT doc_id, CASE WHEN length(f) >= 3 THEN trim(regexp_replace(f, '(?s){_B}(?:Is|It)(?:[^A-Za-z0-9_].*)?\\z', '')) ELSE '' END AS place FROM x")
def place_by_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With words of the test texts as lead, administrative and calendar words."""
    return Tables(spark, sf_dir).texts("documents").select("doc_id", pattern_place(F.col("text"), ["the", "of"], ["In", "The"], ["Is", "It"]).alias("place"))


def candidate_hits(names: DataFrame, forms_: DataFrame, key: str) -> DataFrame:
    """key, form: forms that equal a candidate name, stand in it, or that it stands in, word for word.

    names: key, name. Both directions are one phrase index each, over the distinct names.
    """
    n = names.select(key, search_text(F.col("name")).alias("name")).where("name <> ''").distinct().persist()  # a few names a text, read by both indexes
    known = n.select("name").distinct()
    own = forms_.select("form").distinct()
    inside = mentions(known, own, "name", "name").select("name", "form")
    around = mentions(own.withColumnRenamed("form", "whole"), known, "whole", "whole", form="name").select(F.col("form").alias("name"), F.col("whole").alias("form"))
    return n.join(inside.unionByName(around).distinct(), "name").select(key, "form").distinct()


def text_place(texts: DataFrame, places: DataFrame, key: str, text: str, lead: str = "di", kinds: tuple[str, ...] = ("Kota", "Kabupaten", "Provinsi")) -> DataFrame:
    """key, place, level, confidence, admin_province, admin_city of each text.

    Forms that meet a candidate name decide, else forms that stand in the text: the higher level, then the longer form,
    then the place with the longest form, then the smallest id. A city or regency has .90, a province .75. Without any
    the first name by pattern has .55, unless it is no place.
    """
    good = places.where("is_active and not is_false_positive")
    known = forms(good).withColumn("length", F.length("form"))
    known = known.join(known.groupBy("location_id").agg(F.max("length").alias("most")), "location_id")
    rows = texts.select(key, F.col(text).alias("text"))
    named = candidates(rows, "text", lead, kinds).select(key, F.explode_outer("names").alias("name")).where("name is not null")
    hits = candidate_hits(named, known, key).withColumn("by_name", F.lit(1)).unionByName(mentions(rows, known, key, "text").select(key, "form").distinct().withColumn("by_name", F.lit(0)))
    order = F.struct("by_name", "priority", "length", "most", (-F.col("location_id")).alias("o"), "location_id")
    best = hits.join(known, "form").groupBy(key).agg(F.max(order).alias("b")).select(key, F.col("b.location_id").alias("location_id"))
    parent = good.where("level = 'province'").select(F.col("id").alias("parent_id"), F.col("name").alias("parent"))
    place = good.select(F.col("id").alias("location_id"), "name", "level", "parent_id").join(parent, "parent_id", "left").drop("parent_id")
    x = rows.withColumn("pattern", pattern_place(F.col("text"), [lead], list(kinds))).drop("text").join(best, key, "left").join(place, "location_id", "left")
    hit, province = F.col("location_id").isNotNull(), F.col("level") == "province"
    usable = (F.col("pattern") != "") & (validity("pattern") == "")
    admin_province, admin_city = F.when(~hit, "").when(province, F.col("name")).otherwise(F.coalesce("parent", F.lit(""))), F.when(hit & ~province, F.col("name")).otherwise("")
    joined = F.when(hit & ~province & F.col("parent").isNotNull(), F.concat("name", F.lit(", "), "parent")).when(hit, F.col("name")).when(usable, F.col("pattern")).otherwise("")
    return x.select(
        key,
        F.regexp_replace(squeeze(F.regexp_replace(joined, r"(?i)(?:,\s*indonesia)+\s*$", "")), "^[ ,]+|[ ,]+$", "").alias("place"),
        F.when(hit, F.col("level")).when(usable, "unknown").otherwise("none").alias("level"),
        F.when(hit & ~province, 0.9).when(hit, 0.75).when(usable, 0.55).otherwise(0.0).alias("confidence"),
        admin_province.alias("admin_province"),
        admin_city.alias("admin_city"),
    )


_NORM = "trim(regexp_replace(replace(lower({0}), '&', ' dan '), '[^a-z0-9]+', ' ', 'g'))"
_G = f"""fr AS (SELECT id, name, level, parent_id, unnest(CASE level WHEN 'province' THEN ['', 'Provinsi ', 'Prov. '] WHEN 'city' THEN ['', 'Kota ', 'Kodya '] ELSE ['', 'Kabupaten ', 'Kab. '] END) || name AS alias FROM location WHERE id NOT IN (23, 24)),
g AS (SELECT *, {_NORM.format('alias')} AS form, CASE level WHEN 'city' THEN 4 WHEN 'regency' THEN 3 ELSE 2 END AS priority FROM fr)"""
_N4 = "[A-Z][A-Za-z0-9_-]+(?: [A-Z][A-Za-z0-9_-]+){0,4}"
_NAMES = "flatten([" + ", ".join(f"regexp_extract_all(text, '{p}', 1)" for p in [*(rf"{_B}di +({k} {_N4})" for k in ("Kota", "Kabupaten")), rf"{_B}di +({_N4})", *(rf"{_B}({k} {_N4})" for k in ("Kota", "Kabupaten", "Provinsi"))]) + "])"
_KINDS = "(?:Kota|Kabupaten|Provinsi)"
_FALLBACK = "coalesce(" + ", ".join(f"nullif(regexp_extract(text, '{p}', 1), '')" for p in [rf"{_B}(?:di)\s+{_KINDS}\s+{_PN}", rf"{_B}(?:di)\s+{_PN}", rf"{_B}{_KINDS}\s+{_PN}"]) + ", '')"
_VALID = " AND ".join(["pattern <> ''", "length(lower(pattern)) >= 4", "lower(pattern) NOT IN (" + ", ".join(f"'{w}'" for w in [*TOO_GENERAL, *JUNK]) + ")", *[f"NOT contains(lower(pattern), '{w}')" for w in RISK_WORDS], "length(lower(pattern)) - length(replace(lower(pattern), 'indonesia', '')) < 18"])


@query(sql(f""", {_G}, t AS (SELECT doc_id, title || '. ' || content AS text FROM report), n AS (SELECT doc_id, text, ' ' || {_NORM.format('text')} || ' ' AS x FROM t),
c AS (SELECT doc_id, {_NORM.format('c')} AS c FROM (SELECT doc_id, unnest({_NAMES}) AS c FROM t) WHERE length(trim(c)) >= 3),
ch AS (SELECT doc_id, id, priority, length(form) AS n FROM (SELECT DISTINCT * FROM c WHERE c <> '') JOIN g ON contains(' ' || c || ' ', ' ' || form || ' ') OR contains(' ' || form || ' ', ' ' || c || ' ')),
h AS (SELECT * FROM ch UNION ALL SELECT doc_id, id, priority, length(form) FROM n JOIN g ON contains(x, ' ' || form || ' ') WHERE doc_id NOT IN (SELECT doc_id FROM ch)),
b AS (SELECT doc_id, arg_max(id, (priority, n, most, -id)) AS id FROM h JOIN (SELECT id, max(length(form)) AS most FROM g GROUP BY 1) USING (id) GROUP BY 1),
f AS (SELECT doc_id, trim(regexp_replace(regexp_replace({_FALLBACK}, '^[ ,.;:()-]+|[ ,.;:()-]+$', '', 'g'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS f FROM t),
k AS (SELECT doc_id, CASE WHEN length(f) >= 3 THEN trim(regexp_replace(f, '(?s){_B}(?:{'|'.join(CALENDAR)})(?:[^A-Za-z0-9_].*)?\\z', '')) ELSE '' END AS pattern FROM f),
o AS (SELECT k.doc_id, l.name, l.level, p.name AS parent, {_VALID} AS usable, pattern FROM k LEFT JOIN b USING (doc_id) LEFT JOIN location l ON l.id = b.id LEFT JOIN location p ON p.id = l.parent_id)
SELECT doc_id, trim(CASE WHEN name IS NULL THEN CASE WHEN usable THEN pattern ELSE '' END WHEN level = 'province' THEN name ELSE name || ', ' || parent END, ' ,') AS place, CASE WHEN name IS NOT NULL THEN level WHEN usable THEN 'unknown' ELSE 'none' END AS level,
 CAST(CASE WHEN level = 'province' THEN 0.75 WHEN name IS NOT NULL THEN 0.9 WHEN usable THEN 0.55 ELSE 0 END AS DOUBLE) AS confidence, CASE WHEN name IS NULL THEN '' WHEN level = 'province' THEN name ELSE parent END AS admin_province, CASE WHEN level <> 'province' THEN name ELSE '' END AS admin_city FROM o"""))
def text_to_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of whole reports by candidate names, gazetteer forms and the pattern fallback."""
    t = Tables(spark, sf_dir)
    return text_place(t.report.select("doc_id", F.concat("title", F.lit(". "), "content").alias("text")), t.location, "doc_id", "text")


_SPOTS = f"""{_G}, w AS (SELECT doc_id, string_split({_NORM.format("title || ' ' || content")}, ' ') AS w FROM report), s0 AS (SELECT w.doc_id, w, form, len(string_split(form, ' ')) AS n FROM w JOIN (SELECT DISTINCT form FROM g) ON contains(' ' || array_to_string(w, ' ') || ' ', ' ' || form || ' ')),
s AS (SELECT doc_id, form, i - 1 AS s, i - 1 + n AS e FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM s0) WHERE array_to_string(list_slice(w, i, i + n - 1), ' ') = form),
m AS (SELECT doc_id, s, max(e) AS e, arg_max(form, e) AS form FROM s GROUP BY ALL), x AS (SELECT m.doc_id, m.s, m.e, m.form, min(y.s) AS next FROM m LEFT JOIN m y ON y.doc_id = m.doc_id AND y.s >= m.e GROUP BY ALL)"""


@query(sql(f", {_SPOTS}, r AS (WITH RECURSIVE k AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY s) = 1 UNION ALL SELECT x.* FROM k JOIN x ON x.doc_id = k.doc_id AND x.s = k.next) SELECT * FROM k) SELECT doc_id, form, CAST(s AS BIGINT) AS start, CAST(e AS BIGINT) AS \"end\" FROM r"))
def place_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where reports name places: leftmost-longest mentions, in words."""
    t = Tables(spark, sf_dir)
    found = mentions(t.report, forms(t.location.where("is_active and not is_false_positive")), "doc_id", F.concat("title", F.lit(" "), "content"))
    return leftmost_longest(found, "doc_id")


def extractor_scores(found: DataFrame) -> DataFrame:
    """id, raw, method, confidence: aliases 50, names 40, a city or regency 20 more, eight characters 5 more; the longer of equals, aliases first.

    found: id, is_alias, level, matched (the alias or name found), display.
    """
    points = F.when(F.col("is_alias"), 50).otherwise(40) + F.when(F.col("level").isin("city", "regency"), 20).otherwise(0) + F.when(F.length(F.when(F.col("is_alias"), F.col("matched")).otherwise(F.col("display"))) >= 8, 5).otherwise(0)
    best = found.withColumn("points", points).groupBy("id").agg(F.max(F.struct("points", F.length("display").alias("n"), F.col("is_alias").cast("int").alias("a"), "display")).alias("b"))
    return best.select("id", F.col("b.display").alias("raw"), F.when(F.col("b.a") == 1, "alias_match").otherwise("location_match").alias("method"), F.when(F.col("b.a") == 1, 0.85).otherwise(0.8).alias("confidence"))


def extracted_place(texts: DataFrame, places: DataFrame, key: str, text: str | Column) -> DataFrame:
    """id, raw, method, confidence of every text with an active alias or name in it, word for word.

    An administrative word before it changes nothing: the name stands there without it as well.
    """
    good = places.where("is_active and not is_false_positive").select(F.col("id").alias("location_id"), "level", F.col("name").alias("display"))
    called = aliases(places).join(good, "location_id").select("location_id", "level", "display", F.col("alias").alias("matched"), F.col("normalized").alias("form"), F.lit(True).alias("is_alias"))
    own = good.select("location_id", "level", "display", F.col("display").alias("matched"), search_text(F.col("display")).alias("form"), F.lit(False).alias("is_alias"))
    known = called.unionByName(own)
    found = mentions(texts, known, key, text).select(key, "form").distinct().join(known, "form")
    return extractor_scores(found.withColumnRenamed(key, "id"))


@query(sql(f""", {_G}, a AS (SELECT id, name AS display, level, form, alias AS matched, TRUE AS is_alias FROM g UNION ALL SELECT id, name, level, form, name, FALSE FROM g WHERE alias = name),
t AS (SELECT doc_id, ' ' || {_NORM.format("title || ' ' || content")} || ' ' AS x FROM report), f AS (SELECT DISTINCT doc_id, a.* FROM t JOIN a ON contains(x, ' ' || form || ' ')),
p AS (SELECT *, CASE WHEN is_alias THEN 50 ELSE 40 END + CASE WHEN level <> 'province' THEN 20 ELSE 0 END + CASE WHEN length(CASE WHEN is_alias THEN matched ELSE display END) >= 8 THEN 5 ELSE 0 END AS points FROM f),
b AS (SELECT doc_id, arg_max(display, (points, length(display), is_alias, display)) AS raw, arg_max(is_alias, (points, length(display), is_alias, display)) AS a FROM p GROUP BY 1)
SELECT doc_id AS id, raw, CASE WHEN a THEN 'alias_match' ELSE 'location_match' END AS method, CAST(CASE WHEN a THEN 0.85 ELSE 0.8 END AS DOUBLE) AS confidence FROM b"""))
def place_extractor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best-scored alias or name in the title and content of reports."""
    t = Tables(spark, sf_dir)
    return extracted_place(t.report, t.location, "doc_id", F.concat("title", F.lit(" "), "content"))


def resolve_fully(texts: DataFrame, places: DataFrame, names: DataFrame, text: str = "raw") -> DataFrame:
    """texts with method, confidence, location_id by the whole ladder.

    Province alias .95, name .95, alias .93, explicit prefix .90 by name and .89 by alias, the one city of a bare name
    .80, the one city of an alias .78, several .20, none and empty 0. names: location_id, normalized aliases. A
    false-positive place answers to a province alias only.
    """
    own = F.lower(F.trim(text))
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(own, r"^kab\.\s*", ""), r"^kabupaten\s*", ""), r"^kota\s*", ""))
    told = F.when(own.startswith("kota "), "city").when(own.rlike(r"^(kab |kab\. |kabupaten )"), "regency").otherwise("")
    x = texts.withColumns({"_key": resolver_key(F.col(text)), "_bare": resolver_key(bare), "_level": told})
    good = places.where("is_active and not is_false_positive").select(F.col("id").alias("location_id"), "level", resolver_key(F.col("name")).alias("key"))
    called = names.select("location_id", resolver_key(F.col("normalized")).alias("key")).join(good.select("location_id", "level"), "location_id")
    abbreviation = F.create_map(*[F.lit(v) for kv in PROVINCE_ALIASES.items() for v in kv])
    provinces = places.where("level = 'province' and is_active").groupBy(resolver_key(F.col("name")).alias("_full")).agg(F.min("id").alias("r1"))
    x = x.withColumn("_full", abbreviation[F.col("_key")]).join(provinces, "_full", "left")
    for rows, r in ((good, "r2"), (called, "r3")):
        x = x.join(rows.groupBy(F.col("key").alias("_key")).agg(F.min("location_id").alias(r)), "_key", "left")
    for rows, r in ((good, "r4"), (called, "r5")):
        x = x.join(rows.groupBy(F.col("key").alias("_bare"), F.col("level").alias("_level")).agg(F.min("location_id").alias(r)), ["_bare", "_level"], "left")
    city = F.col("level").isin("city", "regency")
    for rows, r in ((good, "r6"), (called, "r7")):
        x = x.join(rows.where(city).groupBy(F.col("key").alias("_bare")).agg(F.min("location_id").alias(r), F.countDistinct("location_id").alias(f"{r}_n")), "_bare", "left")
    rungs = [
        ("_key = '' and trim(" + text + ") = ''", "empty", 0.0, None), ("r1 is not null", "province_alias", 0.95, "r1"), ("r2 is not null", "location_exact", 0.95, "r2"), ("r3 is not null", "alias_exact", 0.93, "r3"),
        ("r4 is not null", "explicit_admin_prefix", 0.90, "r4"), ("r5 is not null", "explicit_admin_alias", 0.89, "r5"), ("r6_n = 1", "generic_unique", 0.80, "r6"), ("r7_n = 1", "generic_alias_unique", 0.78, "r7"), ("r6_n > 1 or r7_n > 1", "ambiguous", 0.20, None),
    ]
    none = F.lit(None).cast("long")
    out = {
        "method": ladder(*((c, m) for c, m, _, _ in rungs), default="not_found"),
        "confidence": ladder(*((c, v) for c, _, v, _ in rungs), default=0.0),
        "location_id": ladder(*((c, F.col(r) if r else none) for c, _, _, r in rungs), default=none),
    }
    return x.withColumns(out).drop("_key", "_bare", "_level", "_full", *[f"r{k}" for k in range(1, 8)], "r6_n", "r7_n")


# Aliases of the test: a nickname for every place, one nickname shared by two cities, and short ones by level.
_NICKS = "SELECT id AS location_id, 'nick ' || lower(name) AS n FROM location UNION ALL SELECT id, 'twin' FROM location WHERE id IN (2, 3) UNION ALL SELECT id, 'solo' FROM location WHERE id = 4 UNION ALL SELECT id, 'kota_' || lower(left(name, 3)) FROM location WHERE id = 6"
_RAW9 = "CASE event_id % 9 WHEN 0 THEN '' WHEN 1 THEN lower(n_name) WHEN 2 THEN 'Kota ' || n_name WHEN 3 THEN 'Kabupaten ' || n_name WHEN 4 THEN 'nick ' || n_name WHEN 5 THEN 'Kota nick ' || n_name WHEN 6 THEN 'kab. twin' WHEN 7 THEN 'kota solo' ELSE CASE WHEN event_id % 2 = 0 THEN 'amr' ELSE 'nowhere' END END"


@query(sql(f""", e AS (SELECT event_id, {_RAW9} AS raw FROM events JOIN nation ON n_nationkey = user_id % 25), nk AS ({_NICKS}),
k AS (SELECT *, trim(regexp_replace(lower(raw), '[^a-z0-9]+', '_', 'g'), '_') AS key, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(raw), '^kab\\. *', ''), '^kabupaten *', ''), '^kota *', ''), '[^a-z0-9]+', '_', 'g'), '_') AS bare, CASE WHEN raw ILIKE 'kota %' THEN 'city' WHEN raw ILIKE 'kab %' OR raw ILIKE 'kab. %' OR raw ILIKE 'kabupaten %' THEN 'regency' ELSE '' END AS told FROM e),
g AS (SELECT id, level, trim(regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g'), '_') AS k FROM location WHERE id NOT IN (23, 24)),
a AS (SELECT location_id AS id, level, trim(regexp_replace(lower(n), '[^a-z0-9]+', '_', 'g'), '_') AS k FROM nk JOIN location ON location.id = location_id WHERE location_id NOT IN (23, 24)),
d AS (SELECT DISTINCT raw, key, bare, told FROM k),
m AS (SELECT *, CASE WHEN key IN ('afr', 'amr', 'asi', 'eur', 'mea') THEN 1001 END AS r1, (SELECT min(id) FROM g WHERE k = key) AS r2, (SELECT min(id) FROM a WHERE k = key) AS r3, (SELECT min(id) FROM g WHERE k = bare AND level = told) AS r4, (SELECT min(id) FROM a WHERE k = bare AND level = told) AS r5,
 (SELECT count(DISTINCT id) FROM g WHERE k = bare AND level <> 'province') AS n6, (SELECT min(id) FROM g WHERE k = bare AND level <> 'province') AS r6, (SELECT count(DISTINCT id) FROM a WHERE k = bare AND level <> 'province') AS n7, (SELECT min(id) FROM a WHERE k = bare AND level <> 'province') AS r7 FROM d),
o AS (SELECT raw, CASE WHEN raw = '' THEN 'empty' WHEN r1 IS NOT NULL THEN 'province_alias' WHEN r2 IS NOT NULL THEN 'location_exact' WHEN r3 IS NOT NULL THEN 'alias_exact' WHEN r4 IS NOT NULL THEN 'explicit_admin_prefix' WHEN r5 IS NOT NULL THEN 'explicit_admin_alias' WHEN n6 = 1 THEN 'generic_unique' WHEN n7 = 1 THEN 'generic_alias_unique' WHEN n6 > 1 OR n7 > 1 THEN 'ambiguous' ELSE 'not_found' END AS method, r1, r2, r3, r4, r5, r6, r7 FROM m)
SELECT event_id, method, CAST(CASE method WHEN 'province_alias' THEN 0.95 WHEN 'location_exact' THEN 0.95 WHEN 'alias_exact' THEN 0.93 WHEN 'explicit_admin_prefix' THEN 0.9 WHEN 'explicit_admin_alias' THEN 0.89 WHEN 'generic_unique' THEN 0.8 WHEN 'generic_alias_unique' THEN 0.78 WHEN 'ambiguous' THEN 0.2 ELSE 0 END AS DOUBLE) AS confidence,
 CAST(CASE method WHEN 'province_alias' THEN r1 WHEN 'location_exact' THEN r2 WHEN 'alias_exact' THEN r3 WHEN 'explicit_admin_prefix' THEN r4 WHEN 'explicit_admin_alias' THEN r5 WHEN 'generic_unique' THEN r6 WHEN 'generic_alias_unique' THEN r7 END AS BIGINT) AS location_id FROM k JOIN o USING (raw)"""))
def resolve_whole_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nine rungs, with nicknames of places as aliases."""
    t = Tables(spark, sf_dir)
    return resolve_fully(_nine(t), t.location, _nicks(t)).select("event_id", "method", "confidence", "location_id")


def _nine(t: Tables) -> DataFrame:
    nation = t.raw("nation").select(F.col("n_nationkey").cast("long").alias("nk"), "n_name")
    return t.raw("events").withColumn("nk", F.col("user_id") % 25).join(nation, "nk").select("event_id", F.expr(_RAW9).alias("raw"))


def _nicks(t: Tables) -> DataFrame:
    p = t.location
    some = lambda ids, n: p.where(F.col("id").isin(ids)).select(F.col("id").alias("location_id"), n.alias("normalized"))
    every = p.select(F.col("id").alias("location_id"), F.concat(F.lit("nick "), F.lower("name")).alias("normalized"))
    return every.unionByName(some([2, 3], F.lit("twin"))).unionByName(some([4], F.lit("solo"))).unionByName(some([6], F.concat(F.lit("kota_"), F.lower(F.left("name", F.lit(3))))))


def admin_fallback(rows: DataFrame, places: DataFrame) -> DataFrame:
    """rows with location_id, method, confidence from the crawler's admin columns: a city within the province .90, the province .82.

    A told level restricts the city; without a known province any parent will do; the smallest id of equals.
    """
    good = places.where("is_active and not is_false_positive").select(F.col("id").alias("place_id"), "level", "parent_id", resolver_key(F.col("name")).alias("key"))
    p = good.where("level = 'province'").groupBy(F.col("key").alias("_p")).agg(F.min("place_id").alias("province_id"))
    x = rows.withColumns({"_p": resolver_key(F.col("admin_province")), "_c": resolver_key(F.col("admin_city")), "_want": F.when(F.lower("level").isin("city", "kota"), "city").when(F.lower("level").isin("regency", "kabupaten"), "regency").otherwise("")})
    x = x.join(p, "_p", "left")
    cities = good.where("level <> 'province'").select(F.col("key").alias("_c"), F.col("level").alias("_l"), F.col("parent_id").alias("_parent"), "place_id")
    met = x.join(cities, "_c", "left").where("true")
    fits = F.expr("place_id is not null and (_want = '' or _want = _l) and (province_id is null or province_id = _parent)")
    best = met.groupBy("key").agg(F.min(F.when(fits, F.col("place_id"))).alias("city_id"), F.first("province_id").alias("province_id"))
    return best.select("key", F.coalesce("city_id", "province_id").alias("location_id"), F.expr("case when city_id is not null then 'legacy_admin_normalized' when province_id is not null then 'legacy_admin_province_normalized' else '' end").alias("method"), F.expr("cast(case when city_id is not null then 0.9 when province_id is not null then 0.82 else 0 end as double)").alias("confidence"))


@query(sql(""", r AS (SELECT event_id AS key, CASE WHEN event_id % 4 = 0 THEN '' WHEN event_id % 4 = 1 THEN (SELECT r_name FROM region WHERE r_regionkey = (n_regionkey + 1) % 5) ELSE (SELECT r_name FROM region WHERE r_regionkey = n_regionkey) END AS ap, CASE WHEN event_id % 3 = 0 THEN '' ELSE lower(n_name) END AS ac, CASE event_id % 5 WHEN 0 THEN 'kota' WHEN 1 THEN 'Regency' ELSE '' END AS lv, n_nationkey AS c, n_regionkey AS rg FROM events JOIN nation ON n_nationkey = user_id % 25),
x AS (SELECT *, CASE WHEN ap = '' THEN NULL WHEN key % 4 = 1 THEN 1000 + (rg + 1) % 5 ELSE 1000 + rg END AS pid FROM r),
y AS (SELECT *, CASE WHEN ac <> '' AND c NOT IN (23, 24) AND (lv = '' OR (lv = 'kota') = (c % 2 = 0)) AND (pid IS NULL OR pid = 1000 + rg) THEN c END AS cid FROM x)
SELECT key, CAST(coalesce(cid, pid) AS BIGINT) AS location_id, CASE WHEN cid IS NOT NULL THEN 'legacy_admin_normalized' WHEN pid IS NOT NULL THEN 'legacy_admin_province_normalized' ELSE '' END AS method, CAST(CASE WHEN cid IS NOT NULL THEN 0.9 WHEN pid IS NOT NULL THEN 0.82 ELSE 0 END AS DOUBLE) AS confidence FROM y"""))
def admin_columns_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places from province and city columns, some contradictory, some with a told level."""
    t = Tables(spark, sf_dir)
    nation = t.raw("nation").select(F.col("n_nationkey").cast("long").alias("nk"), F.col("n_name").alias("city"), F.col("n_regionkey").cast("long").alias("rk"))
    region = t.raw("region").select(F.col("r_regionkey").cast("long").alias("pk"), F.col("r_name").alias("province"))
    e = t.raw("events").withColumn("nk", F.col("user_id") % 25).join(nation, "nk").withColumn("pk", F.expr("if(event_id % 4 = 1, (rk + 1) % 5, rk)")).join(region, "pk")
    rows = e.select(F.col("event_id").alias("key"), F.expr("if(event_id % 4 = 0, '', province)").alias("admin_province"), F.expr("if(event_id % 3 = 0, '', lower(city))").alias("admin_city"), F.expr("case event_id % 5 when 0 then 'kota' when 1 then 'Regency' else '' end").alias("level"))
    return admin_fallback(rows, t.location)


def backfill(resolved: DataFrame, links: DataFrame, update: bool, only_empty: bool) -> DataFrame:
    """One row of counters for linking signals by their raw text: checked, matched, ambiguous, not_found, created, updated, skipped."""
    had = links.where("is_primary").select(F.col("signal_id").alias("id")).distinct().withColumn("had", F.lit(True))
    any_ = links.select(F.col("signal_id").alias("id")).distinct()
    rows = resolved.join(any_, "id", "left_anti") if only_empty else resolved
    x = rows.join(had, "id", "left").withColumns({"hit": F.col("location_id").isNotNull(), "had": F.coalesce("had", F.lit(False))})
    n = lambda c, a: F.expr(f"count_if({c})").alias(a)
    done = "true" if update else "false"
    return x.agg(F.count("*").alias("checked"), n("hit", "matched"), n("method = 'ambiguous'", "ambiguous"), n("method = 'not_found'", "not_found"), n("hit and not had", "created"), n(f"hit and had and {done}", "updated"), n(f"hit and had and not {done}", "skipped"))


@query(sql(f""", e AS (SELECT event_id AS id, {_RAW9} AS raw, n_nationkey AS c FROM events JOIN nation ON n_nationkey = user_id % 25),
x AS (SELECT id, CASE WHEN raw = '' THEN 'empty' WHEN id % 9 = 8 AND id % 2 = 1 THEN 'not_found' WHEN id % 9 = 6 AND FALSE THEN 'ambiguous' WHEN id % 9 IN (1, 2, 3, 4, 5) AND c IN (23, 24) THEN 'not_found' ELSE 'hit' END AS m, id IN (SELECT signal_id FROM plink) AS had, id IN (SELECT signal_id FROM link) AS linked FROM e),
s AS (SELECT 'all' AS run, * FROM x UNION ALL SELECT 'update', * FROM x UNION ALL SELECT 'empty', * FROM x WHERE NOT linked)
SELECT run, count(*) AS checked, count(*) FILTER (WHERE m = 'hit') AS matched, count(*) FILTER (WHERE m = 'ambiguous') AS ambiguous, count(*) FILTER (WHERE m = 'not_found') AS not_found, count(*) FILTER (WHERE m = 'hit' AND NOT had) AS created, count(*) FILTER (WHERE m = 'hit' AND had AND run = 'update') AS updated, count(*) FILTER (WHERE m = 'hit' AND had AND run <> 'update') AS skipped FROM s GROUP BY 1"""))
def place_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of three runs: all signals, all with updates, those without any link."""
    t = Tables(spark, sf_dir)
    r = resolve_fully(_nine(t), t.location, _nicks(t)).withColumnRenamed("event_id", "id")
    runs = [backfill(r, t.link, update, empty).withColumn("run", F.lit(name)) for name, update, empty in (("all", False, False), ("update", True, False), ("empty", False, True))]
    return runs[0].unionByName(runs[1]).unionByName(runs[2])


def renormalised(places: DataFrame) -> DataFrame:
    """id, province_code, city_code and whether they changed: codes made again from the names."""
    parent = places.where("level = 'province'").select(F.col("id").alias("_pid"), F.col("name").alias("_province"))
    x = places.join(parent, places.parent_id == parent["_pid"], "left")
    province = F.when(F.col("level") == "province", region_code(F.col("name"))).otherwise(region_code(F.coalesce("_province", F.lit(""))))
    city = F.when(F.col("level") == "province", "").otherwise(region_code(F.col("name")))
    return x.select("id", province.alias("province_code"), city.alias("city_code"), ((province != F.col("province_code")) | (city != F.col("city_code"))).alias("changed"))


@query(sql("SELECT id, province_code, city_code, id % 3 = 0 AND (province_code LIKE '%\\_%' ESCAPE '\\' OR city_code LIKE '%\\_%' ESCAPE '\\') OR id % 4 = 1 AS changed FROM location"))
def code_renormalisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes with hyphens or capitals, made again."""
    p = Tables(spark, sf_dir).location
    old = {c: F.when(F.col("id") % 4 == 1, F.upper(c)).when(F.col("id") % 3 == 0, F.replace(c, F.lit("_"), F.lit("-"))).otherwise(F.col(c)) for c in ("province_code", "city_code")}
    return renormalised(p.withColumns(old))
