"""Articles: text and metadata of a page, whether a text is only a fallback, and the assessment made of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epilens.functions.lexicon import any_of, any_sql
from epilens.functions.numeric import ladder
from epilens.functions.text import WS, first_of_each, headline, numbers, single_spaced, squeeze, unescape
from epilens.operators.assess import QUESTIONS, SUMMARY_WORDS, first_sentence, summary
from epilens.registry import query
from epilens.sources.adapter import Tables, sql

# Elements without article text, words of container names, and words of paragraphs that are no article text.
DROPPED = ["script", "style", "noscript", "iframe", "svg", "form", "header", "footer", "nav", "aside"]
CONTAINERS = "article|content|detail|post|entry|read|news|body|story"
BOILERPLATE = ["baca juga", "ikuti kami", "download aplikasi", "copyright", "redaksi", "advertisement", "iklan", "login", "subscribe", "bagikan artikel", "komentar", "tag:"]
ENTITIES = [("&nbsp;", " "), ("&#160;", " "), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")]
_JSONLD = "array<struct<articleBody:string,description:string,headline:string,`@graph`:array<struct<articleBody:string,description:string,headline:string>>>>"


def meta_tags(html: Column) -> Column:
    """The meta elements of a page, in order."""
    return F.regexp_extract_all(html, F.lit(r"(?is)(<meta\s[^>]*>)"), 1)


def meta(tags: Column, *names: str) -> Column:
    """The content of the first of the named meta elements that has one, property before name; ''."""
    found = []
    for name in names:
        for attribute in ("property", "name"):
            pattern = rf"(?i)\s{attribute}=.{name}."
            tag = F.get(F.filter(tags, lambda t: t.rlike(pattern)), F.lit(0))  # noqa: B023
            found.append(F.regexp_extract(tag, r"(?is)\scontent=\"([^\"]*)\"", 1))
    plain = F.transform(F.array(*found), lambda c: squeeze(unescape(c)))
    return F.coalesce(F.get(F.filter(plain, lambda c: c != ""), F.lit(0)), F.lit(""))


def canonical_url(html: Column, tags: Column) -> Column:
    link = F.regexp_extract(html, r"(?is)(<link\s[^>]*rel=\"canonical\"[^>]*>)", 1)
    return F.coalesce(F.nullif(meta(tags, "og:url"), F.lit("")), F.regexp_extract(link, r"(?is)\shref=\"([^\"]*)\"", 1))


def jsonld_items(html: Column) -> Column:
    """The items of a page's JSON-LD scripts; broken scripts count for nothing."""
    scripts = F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*type=\"application/ld\+json\"[^>]*>(.*?)</script>"), 1)
    return F.flatten(F.filter(F.transform(scripts, lambda s: F.from_json(F.trim(s), _JSONLD)), lambda x: x.isNotNull()))


def jsonld_text(items: Column) -> Column:
    """articleBody, description and headline of all JSON-LD items, those of the page's scripts first, then of their graphs."""
    said = lambda xs: F.flatten(F.transform(xs, lambda x: F.array(x["articleBody"], x["description"], x["headline"])))
    graphs = F.flatten(F.filter(F.transform(items, lambda x: x["@graph"]), lambda g: g.isNotNull()))
    return squeeze(F.array_join(F.filter(F.concat(said(items), said(graphs)), lambda t: t.isNotNull() & (t != "")), " "))


def without_dropped(html: Column) -> Column:
    """The page without the elements that have no article text, one kind after the other."""
    for tag in DROPPED:
        html = F.regexp_replace(html, rf"(?is)<{tag}[ >].*?</{tag}>", " ")
    return html


def inside(pieces: Column, mark: str, limit: int) -> Column:
    """The pieces of a page within the outermost of its first `limit` marked elements, each up to where it closes.

    pieces: kind (element name, '' before the first), step (1 opens, -1 closes), mark and text. One fold keeps the kind
    of the element that is open and how deep elements of that kind lie in it.
    """
    none = F.struct(F.lit("").alias("kind"), F.lit(0).alias("depth"), F.lit(0).alias("seen"), F.array().cast("array<string>").alias("kept"))

    def step(a: Column, x: Column) -> Column:
        seen = a["seen"] + x[mark]
        depth = a["depth"] + F.when(x["kind"] == a["kind"], x["step"]).otherwise(0)
        state = lambda kind, depth, kept: F.struct(kind.alias("kind"), depth.alias("depth"), seen.alias("seen"), kept.alias("kept"))
        still = state(a["kind"], depth, F.when(depth > 0, F.concat(a["kept"], F.array(x["text"]))).otherwise(a["kept"]))
        opens = state(x["kind"], F.lit(1), F.concat(a["kept"], F.array(x["text"])))
        return F.when(a["depth"] > 0, still).when((x[mark] == 1) & (a["seen"] < limit), opens).otherwise(state(a["kind"], F.lit(0), a["kept"]))

    return F.array_join(F.aggregate(pieces, none, step, lambda a: a["kept"]), "")


_PARTS = "div|main|section|article"
_NAMED = rf"(?is)^<(?:div|main|section)\s[^>]*{{0}}=\"[^\"]*(?:{CONTAINERS})[^\"]*\""


def with_article(rows: DataFrame, html: str, limit: int = 18000) -> DataFrame:
    """rows with title, description, canonical_url, jsonld, paragraphs and article_text (these in one, cut at limit characters) of the page.

    Paragraphs are the paragraphs and list items of 35 characters and more of the first article, then of the first six
    containers named by class, then by id, each up to where it closes; boilerplate left out, each once by its first 140
    characters. A page without any of these is taken whole. An unclosed paragraph ends at the next one.
    """
    page = F.col(html)
    # Elements and scripts are columns of their own: within coalesce and lambdas they would be sought for each use.
    x = rows.withColumns({"_tags": meta_tags(page), "_items": jsonld_items(page), "_clean": without_dropped(page)})
    tags = F.col("_tags")
    x = x.withColumns({"title": meta(tags, "og:title", "twitter:title"), "description": meta(tags, "og:description", "description", "twitter:description"), "canonical_url": canonical_url(page, tags), "jsonld": jsonld_text(F.col("_items"))})
    kind = lambda t: F.lower(F.regexp_extract(t, rf"(?i)^</?({_PARTS})[\s>/]", 1))
    mark = lambda c, name: F.when(c, 1).otherwise(0).alias(name)
    part = lambda t: F.struct(kind(t).alias("kind"), F.when(F.startswith(t, F.lit("</")), -1).otherwise(1).alias("step"), mark(t.rlike(r"(?i)^<article[\s>/]"), "article"), *(mark(t.rlike(_NAMED.format(a)), a) for a in ("class", "id")), t.alias("text"))
    x = x.withColumn("_parts", F.transform(F.split("_clean", rf"(?i)(?=</?(?:{_PARTS})[\s>/])"), part))
    x = x.withColumns({"_article": inside(F.col("_parts"), "article", 1), "_class": inside(F.col("_parts"), "class", 6), "_id": inside(F.col("_parts"), "id", 6)})
    scopes = F.concat_ws("</article>", "_article", "_class", "_id")
    scope = F.when((F.col("_article") == "") & (F.col("_class") == "") & (F.col("_id") == ""), F.col("_clean")).otherwise(scopes)
    x = x.withColumn("_pieces", F.split(scope, r"(?i)<(?:p|li)(?:\s[^>]*)?>"))
    text = lambda t: squeeze(unescape(F.regexp_replace(F.regexp_replace(t, r"(?is)</(?:p|li|article|div|section|main|ul|ol)>.*\z", ""), "<[^>]*>", " ")))
    kept = F.filter(F.transform(F.slice("_pieces", F.lit(2), F.size("_pieces")), text), lambda t: (F.length(t) >= 35) & ~any_of(F.lower(t), BOILERPLATE))
    x = first_of_each(x, kept, lambda t: F.left(F.lower(t), F.lit(140)), "paragraphs").drop("_tags", "_items", "_clean", "_parts", "_article", "_class", "_id", "_pieces")
    whole = squeeze(F.concat_ws(" ", "title", "description", "jsonld", F.array_join("paragraphs", " ")))
    return x.withColumn("article_text", F.left(whole, F.lit(limit)))


# Pages of the test with metadata, JSON-LD as object, graph and list, and a container in place of the article.
_PAGE = """CASE page_id % 4
 WHEN 0 THEN '<meta property="og:title" content="Head ' || page_id || ' &amp; more"><meta name="description" content="A short text"><link rel="canonical" href="https://c.example/' || page_id || '"><script type="application/ld+json">{"@graph":[{"headline":"H' || page_id || '","articleBody":"Body of it"}],"description":"D"}</script>' || html
 WHEN 1 THEN '<script type="application/ld+json">[{"headline":"A"},{"description":"B"}]</script><script type="application/ld+json">broken {</script><meta name="twitter:title" content="T"><meta property="og:url" content="https://o.example/' || page_id || '">' || html
 WHEN 2 THEN replace(replace(html, '<article>', '<DIV class="story-body"><div>'), '</article>', '</div></div><p>A paragraph after the container, which is long enough to count as one.</p>') || '<section id="news"><section><p>A second container by id, long enough to count as well &amp; more.</p></section></section><p>And once more text that is behind it, of some length.</p>'
 ELSE '<main><div class="post"><p>A first post that is outside of the article and counts after it.</p></div></main>' || html END"""
_SQUEEZE = r"trim(regexp_replace({0}, '[ \t\n\x0B\f\r]+', ' ', 'g'))"


def _unescape_sql(c: str) -> str:
    for entity, plain in ENTITIES:
        c = f"replace({c}, '{entity}', {'chr(39)' if plain == chr(39) else repr(plain)})"
    return c


def _meta_sql(*names: str) -> str:
    one = lambda n, a: f"nullif({_SQUEEZE.format(_unescape_sql(f'''regexp_extract(list_filter(tags, lambda t: regexp_matches(t, '(?i)\\s{a}=.{n}.'))[1], '(?is)\\scontent=\"([^\"]*)\"', 1)'''))}, '')"
    return "coalesce(" + ", ".join(one(n, a) for n in names for a in ("property", "name")) + ", '')"


def _dropped_sql(c: str) -> str:
    for tag in DROPPED:
        c = f"regexp_replace({c}, '(?is)<{tag}[ >].*?</{tag}>', ' ', 'g')"
    return c


def _fold_sql(mark: str, limit: int) -> str:
    depth = "a.d + CASE WHEN x.k = a.k THEN x.s ELSE 0 END"
    state = lambda k, d, o: f"struct_pack(k := {k}, d := {d}, n := a.n + x.{mark}, o := {o})"
    step = f"CASE WHEN a.d > 0 THEN {state('a.k', depth, f'CASE WHEN {depth} > 0 THEN list_append(a.o, x.t) ELSE a.o END')} WHEN x.{mark} = 1 AND a.n < {limit} THEN {state('x.k', '1', 'list_append(a.o, x.t)')} ELSE {state('a.k', '0', 'a.o')} END"
    return f"array_to_string((list_reduce(parts, lambda a, x: {step}, struct_pack(k := '', d := 0, n := 0, o := CAST([] AS VARCHAR[])))).o, '')"


_TEXT = _SQUEEZE.format(_unescape_sql(r"regexp_replace(regexp_replace(x, '(?is)</(?:p|li|article|div|section|main|ul|ol)>.*\z', ''), '<[^>]*>', ' ', 'g')"))


@query(rf"""WITH p AS (SELECT page_id, {_PAGE} AS h FROM pages), t AS (SELECT page_id, h, regexp_extract_all(h, '(?is)<meta\s[^>]*>') AS tags, regexp_extract_all(h, '(?is)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>', 1) AS scripts, {_dropped_sql('h')} AS c FROM p),
y AS (SELECT *, list_transform(string_split(regexp_replace(c, '(?i)(</?(?:{_PARTS})[\s>/])', chr(1) || '\1', 'g'), chr(1)), lambda t: struct_pack(k := lower(regexp_extract(t, '(?i)^</?({_PARTS})[\s>/]', 1)), s := CASE WHEN starts_with(t, '</') THEN -1 ELSE 1 END, m0 := CAST(regexp_matches(t, '(?i)^<article[\s>/]') AS INTEGER), m1 := CAST(regexp_matches(t, '{_NAMED.format('class')}') AS INTEGER), m2 := CAST(regexp_matches(t, '{_NAMED.format('id')}') AS INTEGER), t := t)) AS parts FROM t),
s AS (SELECT *, {_fold_sql('m0', 1)} AS a, {_fold_sql('m1', 6)} AS b1, {_fold_sql('m2', 6)} AS b2 FROM y),
k AS (SELECT *, list_filter(list_transform(string_split_regex(CASE WHEN a = '' AND b1 = '' AND b2 = '' THEN c ELSE a || '</article>' || b1 || '</article>' || b2 END, '(?i)<(?:p|li)(?:\s[^>]*)?>')[2:], lambda x: {_TEXT}), lambda t: length(t) >= 35 AND NOT {any_sql('lower(t)', BOILERPLATE)}) AS kept,
  flatten(list_transform(list_filter(scripts, lambda s: json_valid(trim(s))), lambda s: CASE WHEN json_type(trim(s)) = 'ARRAY' THEN CAST(trim(s) AS JSON[]) ELSE [CAST(trim(s) AS JSON)] END)) AS items FROM s),
j AS (SELECT *, list_filter(kept, lambda t, i: list_position(list_transform(kept, lambda y: left(lower(y), 140)), left(lower(t), 140)) = i) AS paras,
  list_concat(flatten(list_transform(items, lambda x: [x->>'$.articleBody', x->>'$.description', x->>'$.headline'])), flatten(list_transform(flatten(list_transform(items, lambda x: coalesce(CAST(x->'$."@graph"' AS JSON[]), []))), lambda x: [x->>'$.articleBody', x->>'$.description', x->>'$.headline']))) AS said FROM k),
m AS (SELECT page_id, {_meta_sql('og:title', 'twitter:title')} AS title, {_meta_sql('og:description', 'description', 'twitter:description')} AS description, coalesce(nullif({_meta_sql('og:url')}, ''), regexp_extract(regexp_extract(h, '(?is)(<link\s[^>]*rel="canonical"[^>]*>)', 1), '(?is)\shref="([^"]*)"', 1)) AS canonical_url, {_SQUEEZE.format("array_to_string(list_filter(said, lambda t: t IS NOT NULL AND t <> ''), ' ')")} AS jsonld, paras FROM j)
SELECT page_id, title, description, canonical_url, md5(jsonld) AS jsonld, CAST(len(paras) AS BIGINT) AS paragraphs, md5(left({_SQUEEZE.format("concat_ws(' ', title, description, jsonld, array_to_string(paras, ' '))")}, 18000)) AS text FROM m""")
def article_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and digests of JSON-LD and text of every page, some of them with metadata put in."""
    x = with_article(Tables(spark, sf_dir).texts("pages").select("page_id", F.expr(_PAGE).alias("h")), "h")
    digest = lambda c: F.md5(F.encode(c, "UTF-8")).alias(c)
    return x.select("page_id", "title", "description", "canonical_url", digest("jsonld"), F.size("paragraphs").cast("long").alias("paragraphs"), digest("article_text").alias("text"))


def is_fallback(text: Column, title: Column, trusted: Column) -> Column:
    """Whether a text is only a title or feed entry: empty; below 500 characters; or below 800 with its title in it. Of a trusted URL 250 are enough."""
    head = F.left(F.lower(squeeze(headline(title)[0])), F.lit(50))
    text = squeeze(text)
    n = F.length(text)
    return F.coalesce((n == 0) | (~(trusted & (n >= 250)) & ((n < 500) | ((head != "") & F.contains(F.lower(text), head) & (n < 800)))), F.lit(True))


_TITLE = "substr(split_part(text, chr(10), 1), 1, 80)"
_CLEAN_TITLE = f"CASE WHEN contains({_TITLE}, ' - ') THEN left({_TITLE}, length({_TITLE}) - length(string_split({_TITLE}, ' - ')[-1]) - 3) ELSE {_TITLE} END"


@query(f"WITH x AS (SELECT doc_id, doc_id % 3 = 0 AS trusted, {_SQUEEZE.format('text')} AS t, left(lower({_SQUEEZE.format(_CLEAN_TITLE)}), 50) AS head FROM documents) SELECT doc_id, length(t) = 0 OR (NOT (trusted AND length(t) >= 250) AND (length(t) < 500 OR (head <> '' AND contains(lower(t), head) AND length(t) < 800))) AS fallback FROM x")
def fallback_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the texts of their first line; every third from a trusted URL."""
    title = F.substring(F.substring_index("text", "\n", 1), 1, 80)
    return Tables(spark, sf_dir).texts("documents").select("doc_id", is_fallback(F.col("text"), title, F.col("doc_id") % 3 == 0).alias("fallback"))


#: What an assessment says where it has no answer.
UNAVAILABLE, UNCLEAR = "no article text", "not clear from the article"


def assess(rows: DataFrame) -> DataFrame:
    """key, status, quality, summary, the six answers, numbers and error of each signal.

    rows: key, title, content, fetched (text of its page; null or '' if the fetch failed), fetch_error, trusted,
    published_at, place. A fetched text is used unless it is only a fallback; else the stored content is, up to the
    space that it may have been cut after. A source that is only a fallback gives the low form; no source at all is a
    failure.
    """
    fetched = F.coalesce(squeeze(F.col("fetched")), F.lit(""))
    good = (fetched != "") & (~is_fallback(fetched, F.col("title"), F.lit(False)) | (F.col("trusted") & (F.length(fetched) >= 250)))
    stored = F.ltrim(F.regexp_replace("content", f"{WS}+", " "))
    source = F.when(good, fetched).otherwise(F.coalesce(F.nullif(stored, F.lit("")), squeeze(F.col("title")), F.lit("")))
    x = rows.withColumns({"_good": good, "_source": source})
    x = x.withColumns({"_low": is_fallback(F.col("_source"), F.col("title"), F.col("trusted")), "_found": single_spaced(F.col("_source"))})
    x = x.withColumn("_s", F.when(F.size("_found") > 0, F.col("_found")).otherwise(F.array("title")))
    at = F.date_format("published_at", "yyyy-MM-dd HH:mm")
    default = {"when": at, "where": F.coalesce(F.nullif(F.col("place"), F.lit("")), F.lit(UNCLEAR))}
    low = {"when": at, "where": F.when((F.length("place") > 0) & (F.length("place") <= 100), F.col("place")).otherwise(F.lit(UNAVAILABLE))}
    answers = {q: F.when(F.col("_low"), low.get(q, F.lit(UNAVAILABLE))).otherwise(F.coalesce(F.nullif(first_sentence(F.col("_s"), w), F.lit("")), default.get(q, F.lit(UNCLEAR)))) for q, w in QUESTIONS.items()}
    status = ladder(("_source = ''", "failed"), ("_good", "ok"), default="fallback")
    quality = ladder(("_low", "low_fallback"), ("trusted and length(_source) < 500", "article_based_partial"), default="article_based")
    said = F.when(~F.col("_good") | F.col("_low"), F.lit(UNAVAILABLE)).otherwise(F.coalesce(F.nullif(summary(F.col("_s"), SUMMARY_WORDS), F.lit("")), F.col("title")))
    quoted = F.when(F.col("_low"), F.array().cast("array<string>")).otherwise(F.slice(F.filter(F.col("_s"), lambda s: F.size(numbers(s)) > 0), 1, 4))
    return x.select("key", status.alias("status"), quality.alias("quality"), said.alias("summary"), *[a.alias(q) for q, a in answers.items()], quoted.alias("numbers"), F.coalesce("fetch_error", F.lit("")).alias("error"))


_SENTENCES = r"list_filter(string_split(regexp_replace(src, '([.!?]) ', '\1' || chr(1), 'g'), chr(1)), lambda x: length(x) > 25)"
_ASSESS = f"""WITH r AS (SELECT doc_id AS key, {_TITLE} AS title, CASE WHEN doc_id % 7 = 0 THEN '' ELSE left({_SQUEEZE.format('text')}, 300) END AS content, CASE WHEN doc_id % 4 = 0 THEN '' ELSE {_SQUEEZE.format('text')} END AS f, CASE WHEN doc_id % 4 = 0 THEN 'HTTP 404' ELSE '' END AS error, doc_id % 3 = 0 AS trusted, '2024-01-01 ' || lpad(CAST(doc_id % 24 AS VARCHAR), 2, '0') || ':00' AS seen, CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'place ' || doc_id % 5 END AS place FROM documents WHERE text IS NOT NULL),
h AS (SELECT *, left(lower({_SQUEEZE.format(_CLEAN_TITLE.replace(_TITLE, 'title'))}), 50) AS head FROM r),
g AS (SELECT *, f <> '' AND (NOT (length(f) < 500 OR (head <> '' AND contains(lower(f), head) AND length(f) < 800)) OR (trusted AND length(f) >= 250)) AS good FROM h),
s AS (SELECT *, CASE WHEN good THEN f WHEN content <> '' THEN content ELSE {_SQUEEZE.format('title')} END AS src FROM g),
l AS (SELECT *, length(src) = 0 OR (NOT (trusted AND length(src) >= 250) AND (length(src) < 500 OR (head <> '' AND contains(lower(src), head) AND length(src) < 800))) AS low, {_SENTENCES} AS found FROM s),
x AS (SELECT *, CASE WHEN len(found) > 0 THEN found ELSE [title] END AS s FROM l)
SELECT key, CASE WHEN src = '' THEN 'failed' WHEN good THEN 'ok' ELSE 'fallback' END AS status, CASE WHEN low THEN 'low_fallback' WHEN trusted AND length(src) < 500 THEN 'article_based_partial' ELSE 'article_based' END AS quality,
md5(CASE WHEN NOT good OR low THEN '{UNAVAILABLE}' ELSE coalesce(nullif(substr(array_to_string(CASE WHEN len(list_filter(s, lambda x: {any_sql('lower(x)', SUMMARY_WORDS)})) > 0 THEN list_slice(list_filter(s, lambda x: {any_sql('lower(x)', SUMMARY_WORDS)}), 1, 4) ELSE list_slice(s, 1, 3) END, ' '), 1, 1400), ''), title) END) AS summary,
md5(""" + " || '|' || ".join(f"""CASE WHEN low THEN {"seen" if q == "when" else f"CASE WHEN length(place) > 0 THEN place ELSE '{UNAVAILABLE}' END" if q == "where" else f"'{UNAVAILABLE}'"} ELSE coalesce(nullif(list_filter(s, lambda x: {any_sql('lower(x)', w)})[1], ''), {"seen" if q == "when" else f"CASE WHEN place <> '' THEN place ELSE '{UNCLEAR}' END" if q == "where" else f"'{UNCLEAR}'"}) END""" for q, w in QUESTIONS.items()) + """) AS answers,
CAST(CASE WHEN low THEN 0 ELSE len(list_filter(s, lambda x: regexp_matches(' ' || regexp_replace(x, '[^0-9A-Za-z_]', '  ', 'g') || ' ', ' [0-9]+ '))[1:4]) END AS BIGINT) AS numbers, error FROM x"""


@query(_ASSESS)
def assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assessments from documents as fetched pages; every fourth fetch failed, every seventh signal has no content."""
    d = Tables(spark, sf_dir).texts("documents").where("text is not null")
    t = squeeze(F.col("text"))
    rows = d.select(
        F.col("doc_id").alias("key"),
        F.substring(F.substring_index("text", "\n", 1), 1, 80).alias("title"),
        F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.left(t, F.lit(300))).alias("content"),
        F.when(F.col("doc_id") % 4 == 0, "").otherwise(t).alias("fetched"),
        F.when(F.col("doc_id") % 4 == 0, "HTTP 404").otherwise("").alias("fetch_error"),
        (F.col("doc_id") % 3 == 0).alias("trusted"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(doc_id % 24 as int))").alias("published_at"),
        F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.concat(F.lit("place "), F.col("doc_id") % 5)).alias("place"),
    )
    digest = lambda c: F.md5(F.encode(c, "UTF-8"))
    return assess(rows).select("key", "status", "quality", digest("summary").alias("summary"), digest(F.concat_ws("|", *QUESTIONS)).alias("answers"), F.size("numbers").cast("long").alias("numbers"), "error")
