"""Article links: identifiers in aggregator URLs, embedded URLs, publishers, candidate links, existing signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epilens.functions.lexicon import any_of, any_sql
from epilens.functions.numeric import ladder
from epilens.functions.text import dedup_text, publisher_alias
from epilens.functions.urls import BLOCKED, HINTS, host, path
from epilens.registry import query
from epilens.sources.adapter import Tables, sql


def article_id(url: Column) -> Column:
    """The decoded path segment after `articles`, else after `read`; ''."""
    after = lambda word: F.regexp_extract(path(url), f"(?:^|/){word}/+([^/]+)", 1)
    return F.coalesce(F.nullif(F.try_url_decode(after("articles")), F.lit("")), F.try_url_decode(after("read")), F.lit(""))


def embedded_url(identifier: Column) -> Column:
    """The first URL inside a URL-safe base64 identifier whose host isn't blocked; ''."""
    clean = F.translate(F.regexp_replace(identifier, "=+$", ""), "-_", "+/")
    padded = F.rpad(clean, F.ceil(F.length(clean) / 4).cast("int") * 4, F.lit("="))
    data = F.decode(F.try_to_binary(padded, F.lit("base64")), "ISO-8859-1")
    urls = F.regexp_extract_all(data, F.lit("(https?://[^\\s\\x00-\\x1f\"'<>]+)"), 1)
    return F.coalesce(F.get(F.filter(urls, lambda u: ~any_of(host(u), BLOCKED)), F.lit(0)), F.lit(""))


@query(sql(", x AS (SELECT id, CASE id % 3 WHEN 0 THEN 'https://news.google.com/rss/articles/' WHEN 1 THEN 'https://news.google.com/read/' ELSE 'https://news.google.com/other/' END AS base, source_url FROM signal WHERE source_url <> '') SELECT id, CASE WHEN id % 3 = 2 THEN '' WHEN id % 5 = 0 THEN '' ELSE source_url END AS target FROM x"))
def url_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publisher URLs hidden in aggregator links, read back; every fifth hides a blocked host."""
    s = Tables(spark, sf_dir).signal.where("source_url <> ''")
    inner = F.when(F.col("id") % 5 == 0, F.lit("https://www.facebook.com/x")).otherwise(F.col("source_url"))
    code = F.translate(F.base64(F.encode(F.concat(F.lit("\x08\x13\""), inner, F.lit("\x01")), "ISO-8859-1")), "+/=", "-_")
    base = F.expr("case id % 3 when 0 then 'https://news.google.com/rss/articles/' when 1 then 'https://news.google.com/read/' else 'https://news.google.com/other/' end")
    link = s.select("id", F.concat(base, code, F.lit("?oc=5")).alias("url"))
    return link.select("id", embedded_url(article_id(F.col("url"))).alias("target"))


def publisher_domain(name: Column, aliases: list[tuple[str, str]]) -> Column:
    """A domain that stands in the name, else the alias equal to it, else the first in list order that contains or is contained; ''."""
    n = publisher_alias(name)
    literal = F.regexp_extract(F.lower(name), r"([a-z0-9-]+(?:\.[a-z0-9-]+)*\.(?:com|co\.id|id|org|net))", 1)
    equal = partial = F.lit(None).cast("string")
    for alias, domain in reversed(aliases):
        equal = F.when(n == alias, F.lit(domain)).otherwise(equal)
        partial = F.when((n != "") & (F.contains(n, F.lit(alias)) | F.contains(F.lit(alias), n)), F.lit(domain)).otherwise(partial)
    return F.coalesce(F.nullif(literal, F.lit("")), equal, partial, F.lit(""))


#: Publisher rows of the test: alias and domain.
TEST_PUBLISHERS = [("src1", "one.example"), ("src2", "two.example"), ("rc3", "three.example"), ("source 4 daily src4", "four.example")]
_PUB = "(VALUES " + ", ".join(f"({i}, '{a}', '{d}')" for i, (a, d) in enumerate(TEST_PUBLISHERS)) + ") p(i, a, d)"


@query("WITH s AS (SELECT DISTINCT CASE WHEN source = 'src9' THEN 'Nine www.nine.co.id' ELSE source END AS source FROM documents), n AS (SELECT source, trim(regexp_replace(regexp_replace(lower(source), '[^a-z0-9 .-]', ' ', 'g'), ' +', ' ', 'g')) AS n FROM s) SELECT source, CASE WHEN source LIKE 'Nine%' THEN 'www.nine.co.id' ELSE coalesce((SELECT d FROM " + _PUB + " WHERE a = n), (SELECT first(d ORDER BY i) FROM " + _PUB + " WHERE contains(n, a) OR contains(a, n)), '') END AS domain FROM n")
def publisher_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Tables(spark, sf_dir).raw("documents").select(F.when(F.col("source") == "src9", "Nine www.nine.co.id").otherwise(F.col("source")).alias("source")).distinct()
    return s.select("source", publisher_domain(F.col("source"), TEST_PUBLISHERS).alias("domain"))


def link_score(url: Column, anchor: Column, title: Column) -> Column:
    """Points of a link as the article of a title: slug in the URL 12, title in the anchor 7, title words in the URL up to 6, a path hint 2, a numbered path 4; blocked hosts 0."""
    words = F.array_distinct(F.filter(F.regexp_extract_all(F.lower(title), F.lit("([a-z0-9]+)"), 1), lambda w: F.length(w) >= 4))
    slug = F.regexp_replace(F.trim(F.regexp_replace(F.lower(title), "[^a-z0-9]+", " ")), " +", "-")
    low = F.lower(url)
    hits = F.size(F.filter(words, lambda w: F.contains(low, w)))
    points = F.when((slug != "") & F.contains(low, slug), 12).otherwise(0) + F.when((title != "") & F.contains(F.lower(anchor), F.lower(F.left(title, F.lit(50)))), 7).otherwise(0)
    points = points + F.when(F.size(words) > 0, F.floor(6 * hits / F.size(words))).otherwise(0) + F.when(any_of(F.lower(path(url)), HINTS), 2).otherwise(0) + F.when(path(url).rlike("^/[^/]+/[^/]+/[0-9]{5,}"), 4).otherwise(0)
    return F.when(any_of(host(url), BLOCKED), 0).otherwise(points).cast("int")


_LINKS = r"SELECT page_id, t, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS href FROM (SELECT page_id, html, regexp_extract(html, '<title>([^<]*)', 1) AS t FROM pages)"


@query("WITH l AS (" + _LINKS + "), u AS (SELECT DISTINCT page_id, lower(t) AS t, 'https://site.example/news' || href AS url FROM l), w AS (SELECT *, list_distinct(list_filter(regexp_extract_all(t, '[a-z0-9]+'), lambda x: length(x) >= 4)) AS w, lower(url) AS lu, regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) AS p FROM u) SELECT page_id, url, CAST(CASE WHEN trim(regexp_replace(t, '[^a-z0-9]+', ' ', 'g')) <> '' AND contains(lu, replace(trim(regexp_replace(t, '[^a-z0-9]+', ' ', 'g')), ' ', '-')) THEN 12 ELSE 0 END + CASE WHEN len(w) > 0 THEN floor(6.0 * len(list_filter(w, lambda x: contains(lu, x))) / len(w)) ELSE 0 END + CASE WHEN " + any_sql("lower(p)", HINTS) + " THEN 2 ELSE 0 END + CASE WHEN regexp_matches(p, '^/[^/]+/[^/]+/[0-9]{5,}') THEN 4 ELSE 0 END AS INTEGER) AS score FROM w")
def link_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of a page scored as the article of the page's own title."""
    p = Tables(spark, sf_dir).raw("pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)", 1).alias("t"), F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), 1)).alias("href"))
    links = p.select("page_id", "t", F.concat(F.lit("https://site.example/news"), "href").alias("url")).distinct()
    return links.select("page_id", "url", link_score(F.col("url"), F.lit(""), F.col("t")).alias("score"))


def find_existing(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """(key, existing id, how): by URL, else by title in any case, else by normalised title head, disease and place.

    Each rung is an equi-join with stored rows reduced to the newest per key; the third rung
    holds a stored title whose normalised head equals the incoming one's.
    """
    newest = lambda *keys: stored.groupBy(*keys).agg(F.max_by("id", F.struct("updated_at", "id")).alias("found"))
    head = F.left(dedup_text(F.col("title")), F.lit(80))
    stored = stored.withColumns({"_url": F.col("source_url"), "_title": F.lower("title"), "_head": head, "_d": F.lower("disease_tag"), "_p": F.lower("raw_location_text")})
    x = incoming.withColumns({"_url": F.col("source_url"), "_title": F.lower(F.trim("title")), "_head": head, "_d": F.lower("disease_tag"), "_p": F.lower("raw_location_text")})
    x = x.join(newest("_url").withColumnRenamed("found", "f1").where("_url <> ''"), "_url", "left")
    x = x.join(newest("_title").withColumnRenamed("found", "f2").where("_title <> ''"), "_title", "left")
    x = x.join(newest("_head", "_d", "_p").withColumnRenamed("found", "f3").where("_head <> '' and _d <> '' and _p <> ''"), ["_head", "_d", "_p"], "left")
    how = ladder(("f1 is not null", "url"), ("f2 is not null", "title"), ("f3 is not null", "parts"), default="new")
    return x.select("key", F.coalesce("f1", "f2", "f3").alias("existing_id"), how.alias("how"))


_HEAD = r"substr(trim(regexp_replace(regexp_replace(regexp_replace(lower({0}), 'https?://[^ \t\n\x0B\f\r]+', ' ', 'g'), '[^a-z0-9 \t\n\x0B\f\r]', ' ', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g')), 1, 80)"


@query(sql(", st AS (SELECT id, source_url, title, disease_tag, raw_location_text, created_at AS u FROM signal JOIN article USING (id) WHERE id % 2 = 1), inc AS (SELECT id AS key, CASE WHEN id % 4 = 0 THEN source_url ELSE '' END AS url, CASE WHEN id % 6 = 0 THEN lower(title) ELSE title || '?' END AS title, disease_tag, raw_location_text FROM signal JOIN article USING (id) WHERE id % 2 = 0), a AS (SELECT source_url AS k, arg_max(id, (u, id)) AS f FROM st WHERE source_url <> '' GROUP BY 1), b AS (SELECT lower(title) AS k, arg_max(id, (u, id)) AS f FROM st WHERE title <> '' GROUP BY 1), c AS (SELECT " + _HEAD.format("title") + " AS k, lower(disease_tag) AS d, lower(raw_location_text) AS p, arg_max(id, (u, id)) AS f FROM st WHERE disease_tag <> '' AND raw_location_text <> '' GROUP BY ALL) SELECT key, coalesce(a.f, b.f, c.f) AS existing_id, CASE WHEN a.f IS NOT NULL THEN 'url' WHEN b.f IS NOT NULL THEN 'title' WHEN c.f IS NOT NULL THEN 'parts' ELSE 'new' END AS how FROM inc LEFT JOIN a ON a.k = url LEFT JOIN b ON b.k = lower(trim(inc.title)) LEFT JOIN c ON c.k <> '' AND c.k = " + _HEAD.format("inc.title") + " AND c.d = lower(inc.disease_tag) AND c.p = lower(inc.raw_location_text)"))
def existing_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second signal looked up among the others, with changed titles and some URLs."""
    t = Tables(spark, sf_dir)
    s = t.signal.join(t.article.select("id", "title"), "id").withColumn("updated_at", F.col("created_at"))
    incoming = s.where("id % 2 = 0").select(F.col("id").alias("key"), F.expr("case when id % 4 = 0 then source_url else '' end").alias("source_url"), F.expr("case when id % 6 = 0 then lower(title) else concat(title, '?') end").alias("title"), "disease_tag", "raw_location_text")
    return find_existing(incoming, s.where("id % 2 = 1").select("id", "source_url", "title", "disease_tag", "raw_location_text", "updated_at"))
