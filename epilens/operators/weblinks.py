"""Links of pages and signals: aggregator tests, source and resolved URL, candidate articles, outbound links, resolution cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epilens.functions.lexicon import any_of, any_sql
from epilens.functions.numeric import ladder
from epilens.functions.text import headline, publisher_alias, squeeze, title_text
from epilens.functions.urls import BLOCKED, HINTS, NOT_ARTICLE, host, path, url_class
from epilens.operators.links import TEST_PUBLISHERS, publisher_domain
from epilens.registry import query
from epilens.sources.adapter import Tables, sql

# Words of an anchor that leads to the article.
ANCHOR_WORDS = ["baca", "selengkapnya", "artikel", "source", "sumber"]


def is_aggregator(url: Column) -> Column:
    """By the text of the URL, as imports test it."""
    low = F.lower(squeeze(F.coalesce(url, F.lit(""))))
    return F.contains(low, F.lit("news.google.com")) | F.contains(low, F.lit("google.com/rss"))


def on_aggregator_host(url: Column) -> Column:
    """By the host, as the resolver tests it."""
    return F.contains(F.coalesce(host(url), F.lit("")), F.lit("google."))


def pick_urls(first: list[Column], final: list[Column]) -> Column:
    """source_url, resolved_url, status and method from the first non-empty of each list; an aggregator's URL is no resolution."""
    pick = lambda cs: F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in cs], F.lit(""))
    link, end = pick(first), pick(final)
    resolved = F.when(is_aggregator(end), "").otherwise(end)
    done = resolved != ""
    return F.struct(
        F.coalesce(F.nullif(link, F.lit("")), end).alias("source_url"),
        resolved.alias("resolved_url"),
        F.when(done, "resolved").otherwise("unresolved").alias("status"),
        F.when(done, "import_final_url").otherwise("").alias("method"),
    )


_PICK = "SELECT id, source_url AS link, CASE id % 4 WHEN 0 THEN '' WHEN 1 THEN 'https://News.Google.com/rss/articles/' || id WHEN 2 THEN ' https://a.example/' || id || ' ' ELSE source_url END AS final FROM signal"


@query(sql(f", x AS ({_PICK}), y AS (SELECT id, trim(link) AS l, trim(final) AS f FROM x), z AS (SELECT id, CASE WHEN l <> '' THEN l ELSE f END AS source_url, CASE WHEN contains(lower(f), 'news.google.com') OR contains(lower(f), 'google.com/rss') THEN '' ELSE f END AS resolved_url FROM y) SELECT id, source_url, resolved_url, CASE WHEN resolved_url <> '' THEN 'resolved' ELSE 'unresolved' END AS status, CASE WHEN resolved_url <> '' THEN 'import_final_url' ELSE '' END AS method, contains(regexp_replace(lower(regexp_extract(source_url, '^[a-zA-Z]+://([^/?#:]+)', 1)), '^www\\.', ''), 'google.') AS aggregator FROM z"))
def source_and_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both URLs of every signal, with finals that are missing, an aggregator's, padded or the link itself."""
    s = Tables(spark, sf_dir).signal.select("id", F.col("source_url").alias("link"), F.expr("CASE id % 4 WHEN 0 THEN '' WHEN 1 THEN 'https://News.Google.com/rss/articles/' || id WHEN 2 THEN ' https://a.example/' || id || ' ' ELSE source_url END").alias("final"))
    x = s.select("id", pick_urls([F.col("link")], [F.col("final")]).alias("u")).select("id", "u.*")
    return x.withColumn("aggregator", on_aggregator_host(F.col("source_url")))


def publisher_candidates(name: Column, aliases: list[tuple[str, str]]) -> Column:
    """The chosen domain, then those of all aliases that contain the name or are contained, or whose domain it holds; each once."""
    n = publisher_alias(name)
    others = [F.when((n != "") & (F.contains(n, F.lit(a)) | F.contains(F.lit(a), n) | F.contains(n, F.lit(d.lower()))), F.lit(d)) for a, d in aliases]
    found = F.array(F.nullif(publisher_domain(name, aliases), F.lit("")), *others)
    return F.array_distinct(F.filter(found, lambda d: d.isNotNull()))


_PUB = "(VALUES " + ", ".join(f"({i}, '{a}', '{d}')" for i, (a, d) in enumerate(TEST_PUBLISHERS)) + ") p(i, a, d)"


@query("WITH s AS (SELECT DISTINCT CASE WHEN source = 'src9' THEN 'nine www.nine.co.id' WHEN source = 'src8' THEN 'two.example eight' ELSE source END AS n FROM documents), f AS (SELECT n, -2 AS i, 'www.nine.co.id' AS d FROM s WHERE n LIKE 'nine%' UNION ALL SELECT n, -1, d FROM s JOIN " + _PUB + " ON a = n UNION ALL SELECT n, i, d FROM s JOIN " + _PUB + " ON contains(n, a) OR contains(a, n) OR contains(n, d)) SELECT n AS source, coalesce(string_agg(d, ' ' ORDER BY i), '') AS domains FROM s LEFT JOIN (SELECT n, d, min(i) AS i FROM f GROUP BY n, d) USING (n) GROUP BY n")
def publisher_candidate_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("source") == "src9", "nine www.nine.co.id").when(F.col("source") == "src8", "two.example eight").otherwise(F.col("source"))
    s = Tables(spark, sf_dir).raw("documents").select(name.alias("source")).distinct()
    return s.select("source", F.array_join(publisher_candidates(F.col("source"), TEST_PUBLISHERS), " ").alias("domains"))


def similarity(a: Column, b: Column) -> Column:
    """Thousandths: 1 less the edit distance over the longer length; 0 if either is empty."""
    n = F.greatest(F.length(a), F.length(b))
    return F.when((a == "") | (b == ""), 0).otherwise(F.floor(1000 * (n - F.levenshtein(a, b)) / F.greatest(n, F.lit(1)))).cast("long")


def candidate_score(url: Column, anchor: Column, title: Column) -> Column:
    """Thousandths of the points of a link as the article of a title.

    Title slug in the URL 12, title head in the anchor 7, 5 times the similarity of title and anchor, 6 times the share
    of title words in either, a path hint 2, a numbered path 4; blocked hosts and paths of no article 0. The similarity
    is by edit distance on the texts without punctuation.
    """
    plain = F.lower(squeeze(headline(title)[0]))
    slug = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.replace(plain, F.lit("."), F.lit("")), r"[^a-z0-9 -]", " "), "[ -]+", "-"), "^-+|-+$", "")
    words = F.filter(F.regexp_extract_all(plain, F.lit("([a-z0-9]+)"), 1), lambda w: F.length(w) >= 4)
    low, said = F.lower(url), F.lower(squeeze(anchor))
    hits = F.size(F.filter(words, lambda w: F.contains(said, w) | F.contains(low, w)))
    points = (
        F.when((slug != "") & F.contains(low, slug), 12000).otherwise(0)
        + F.when((plain != "") & F.contains(said, F.left(plain, F.lit(50))), 7000).otherwise(0)
        + 5 * similarity(title_text(plain), title_text(said))
        + F.when(F.size(words) > 0, F.floor(6000 * hits / F.greatest(F.size(words), F.lit(1)))).otherwise(0)
        + F.when(any_of(low, HINTS), 2000).otherwise(0)
        + F.when(low.rlike("/[a-z0-9-]+/[a-z0-9-]+/[0-9]{5,}/"), 4000).otherwise(0)
    )
    return F.when((plain == "") | url_class(url).isin("blocked", "not_article", "none"), 0).otherwise(points).cast("long")


def anchors(html: Column) -> Column:
    """An array of (position, href, text) of the page's links."""
    pattern = r'(?is)<a\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>'
    hrefs, texts = F.regexp_extract_all(html, F.lit(pattern), 1), F.regexp_extract_all(html, F.lit(pattern), 2)
    return F.transform(F.arrays_zip(hrefs.alias("href"), texts.alias("text")), lambda x, i: F.struct(i.alias("pos"), x["href"].alias("href"), squeeze(F.regexp_replace(x["text"], "<[^>]*>", " ")).alias("text")))


def absolute(href: Column, base: Column) -> Column:
    """href on its page: full, of the scheme, of the host, or beside the page; '' for other schemes."""
    root = F.regexp_extract(base, r"^([a-zA-Z]+://[^/?#]*)", 1)
    folder = F.regexp_replace(F.regexp_extract(base, r"^([^?#]*)", 1), "[^/]*$", "")
    return (
        F.when(href.rlike("^https?://"), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(base, "^([a-zA-Z]+:)", 1), href))
        .when(href.startswith("/"), F.concat(root, href))
        .when(href.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:") | (href == "") | href.startswith("#"), "")
        .otherwise(F.concat(folder, href))
    )


_A = r"""p AS (SELECT page_id, regexp_replace(regexp_extract(url, '^([^?#]*)', 1), '/$', '') || '/x' AS base, regexp_extract(html, '<title>([^<]*)', 1) AS title, html || '<a href="/read/daerah/12345/' || page_id || '">Baca selengkapnya</a><a class="y" href="https://facebook.com/s"><b>Share</b></a><a href="/tag/x">a long text of a link here</a><a href="more/' || page_id || '">' || regexp_extract(html, '<title>([^<]*)', 1) || '</a>' AS h FROM pages),
a AS (SELECT page_id, base, title, unnest(range(0, len(regexp_extract_all(h, '(?is)<a\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>', 1)))) AS pos, unnest(regexp_extract_all(h, '(?is)<a\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>', 1)) AS href, unnest(regexp_extract_all(h, '(?is)<a\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>', 2)) AS t FROM p),
u AS (SELECT page_id, title, pos, CASE WHEN regexp_matches(href, '^https?://') THEN href WHEN href LIKE '//%' THEN regexp_extract(base, '^([a-zA-Z]+:)', 1) || href WHEN href LIKE '/%' THEN regexp_extract(base, '^([a-zA-Z]+://[^/?#]*)', 1) || href WHEN regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*:') OR href = '' OR href LIKE '#%' THEN '' ELSE regexp_replace(regexp_extract(base, '^([^?#]*)', 1), '[^/]*$', '') || href END AS url, trim(regexp_replace(regexp_replace(t, '<[^>]*>', ' ', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS t FROM a),
w AS (SELECT *, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)), '^www\.', '') AS host, lower(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1)) AS path FROM u),"""
_BAD = f"(host = '' OR {any_sql('host', BLOCKED)} OR {any_sql('path', NOT_ARTICLE)} OR (length(regexp_replace(path, '/+$', '')) = 0 AND regexp_matches(lower(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1)), '(^|&)(s|q|search|query)=')))"
_T = r"trim(regexp_replace(regexp_replace({0}, '[^a-z0-9 \t\n\x0B\f\r]', ' ', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g'))"


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of every page, a few put in, with their page's title."""
    title = F.regexp_extract("html", "<title>([^<]*)", 1)
    more = F.concat(F.col("html"), F.lit('<a href="/read/daerah/12345/'), "page_id", F.lit('">Baca selengkapnya</a><a class="y" href="https://facebook.com/s"><b>Share</b></a><a href="/tag/x">a long text of a link here</a><a href="more/'), "page_id", F.lit('">'), title, F.lit("</a>"))
    base = F.concat(F.regexp_replace(F.regexp_extract("url", "^([^?#]*)", 1), "/$", ""), F.lit("/x"))
    p = Tables(spark, sf_dir).raw("pages").select("page_id", base.alias("base"), title.alias("title"), F.explode(anchors(more)).alias("a"))
    return p.select("page_id", "title", "a.pos", absolute(F.col("a.href"), F.col("base")).alias("url"), "a.text")


@query("WITH " + _A + f""" z AS (SELECT *, lower(trim(CASE WHEN contains(title, ' - ') THEN left(title, length(title) - length(string_split(title, ' - ')[-1]) - 3) ELSE title END)) AS plain, lower(url) AS lu, lower(t) AS lt FROM w),
y AS (SELECT *, regexp_replace(plain, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g') AS pl FROM z),
x AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(replace(pl, '.', ''), '[^a-z0-9 -]', ' ', 'g'), '[ -]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, list_filter(regexp_extract_all(pl, '[a-z0-9]+'), lambda v: length(v) >= 4) AS ws, {_T.format('pl')} AS ta, {_T.format('lt')} AS tb FROM y),
s AS (SELECT page_id, pos, url, CASE WHEN pl = '' OR {_BAD} THEN 0 ELSE CASE WHEN slug <> '' AND contains(lu, slug) THEN 12000 ELSE 0 END + CASE WHEN pl <> '' AND contains(lt, left(pl, 50)) THEN 7000 ELSE 0 END + 5 * CASE WHEN ta = '' OR tb = '' THEN 0 ELSE floor(1000.0 * (greatest(length(ta), length(tb)) - levenshtein(ta, tb)) / greatest(length(ta), length(tb))) END + CASE WHEN len(ws) > 0 THEN floor(6000.0 * len(list_filter(ws, lambda v: contains(lt, v) OR contains(lu, v))) / len(ws)) ELSE 0 END + CASE WHEN {any_sql('lu', HINTS)} THEN 2000 ELSE 0 END + CASE WHEN regexp_matches(lu, '/[a-z0-9-]+/[a-z0-9-]+/[0-9]{{5,}}/') THEN 4000 ELSE 0 END END AS score FROM x)
SELECT page_id, CASE WHEN max(score) >= 3000 THEN arg_max(url, (score, -pos)) ELSE '' END AS url, CAST(max(score) AS BIGINT) AS score FROM s GROUP BY 1""")
def link_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best link of each page as the article of its title; '' below 3 points."""
    x = _links(spark, sf_dir).withColumn("score", candidate_score(F.col("url"), F.col("text"), F.col("title")))
    best = x.groupBy("page_id").agg(F.max_by("url", F.struct("score", -F.col("pos"))).alias("u"), F.max("score").alias("score"))
    return best.select("page_id", F.when(F.col("score") >= 3000, F.col("u")).otherwise("").alias("url"), "score")


@query("WITH " + _A + f""" s AS (SELECT page_id, pos, url, CASE WHEN {any_sql('lower(t)', ANCHOR_WORDS)} THEN 3 ELSE 0 END + CASE WHEN length(t) > 20 THEN 1 ELSE 0 END + CASE WHEN {any_sql('lower(url)', HINTS)} THEN 2 ELSE 0 END AS score FROM w WHERE regexp_matches(url, '^https?://') AND NOT {_BAD}),
d AS (SELECT page_id, url, max(score) AS score, arg_max(pos, (score, -pos)) AS pos FROM s GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, pos) AS rank FROM d) SELECT page_id, rank, url, score FROM r WHERE rank <= 5""")
def outbound_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best article links of each page by anchor words 3, a long anchor 1 and a path hint 2; equals in page order."""
    x = _links(spark, sf_dir).where(F.col("url").rlike("^https?://") & ~url_class(F.col("url")).isin("blocked", "not_article", "none"))
    low = F.lower("text")
    score = F.when(any_of(low, ANCHOR_WORDS), 3).otherwise(0) + F.when(F.length("text") > 20, 1).otherwise(0) + F.when(any_of(F.lower("url"), HINTS), 2).otherwise(0)
    best = x.withColumn("score", score).groupBy("page_id", "url").agg(F.min(F.struct((-F.col("score")).alias("neg"), "pos")).alias("b"))
    ranked = best.groupBy("page_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("b.neg", "b.pos", "url"))), 1, 5).alias("top"))
    return ranked.select("page_id", F.posexplode("top").alias("rank", "l")).select("page_id", (F.col("rank") + 1).cast("long").alias("rank"), "l.url", (-F.col("l.neg")).alias("score"))


def cached_resolution(signals: DataFrame, cache: DataFrame) -> DataFrame:
    """id, url, mode: a manual URL directly, else the newest cached resolution of the source, else the source."""
    known = cache.where("resolved_url <> ''").groupBy(F.col("original_url").alias("source_url")).agg(F.max_by("resolved_url", F.struct("updated_at", "resolved_url")).alias("cached"))
    x = signals.join(known, "source_url", "left")
    mode = ladder(("resolved_url <> ''", "direct"), ("cached is not null", "cache"), ("source_url = ''", "failed"), default="auto")
    return x.select("id", F.coalesce(F.nullif("resolved_url", F.lit("")), "cached", "source_url").alias("url"), mode.alias("mode"))


def merge_cache(cache: DataFrame, found: DataFrame) -> DataFrame:
    """The cache after an upsert of (original_url, resolved_url, method, confidence, updated_at); the newest of a URL wins, and only real changes enter."""
    rows = cache.unionByName(found.where("resolved_url <> '' and resolved_url <> original_url"))
    return rows.groupBy("original_url").agg(F.max_by(F.struct("resolved_url", "method", "confidence", "updated_at"), F.struct("updated_at", "resolved_url")).alias("r")).select("original_url", "r.*")


_CACHE = "c AS (SELECT source_url AS original_url, 'https://old.example/' || min(id) AS resolved_url, 'auto' AS method, 8 AS confidence, TIMESTAMP '2024-01-01' AS updated_at FROM signal WHERE source_url <> '' AND id % 3 = 0 GROUP BY source_url), n AS (SELECT source_url AS original_url, CASE WHEN id % 5 = 0 THEN source_url ELSE 'https://new.example/' || id END AS resolved_url, 'import_final_url' AS method, 9 AS confidence, TIMESTAMP '2024-01-02' AS updated_at FROM signal WHERE source_url <> '' AND id % 7 = 0)"


def _cache(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s = Tables(spark, sf_dir).signal.where("source_url <> ''")
    at = lambda day: F.expr(f"timestamp_ntz'2024-01-{day} 00:00:00'")
    old = s.where("id % 3 = 0").groupBy(F.col("source_url").alias("original_url")).agg(F.concat(F.lit("https://old.example/"), F.min("id")).alias("resolved_url"))
    new = s.where("id % 7 = 0").select(F.col("source_url").alias("original_url"), F.expr("if(id % 5 = 0, source_url, concat('https://new.example/', id))").alias("resolved_url"))
    return old.withColumns({"method": F.lit("auto"), "confidence": F.lit(8), "updated_at": at("01")}), new.withColumns({"method": F.lit("import_final_url"), "confidence": F.lit(9), "updated_at": at("02")})


@query(sql(f", {_CACHE}, u AS (SELECT * FROM c UNION ALL SELECT * FROM n WHERE resolved_url <> original_url) SELECT original_url, arg_max(resolved_url, (updated_at, resolved_url)) AS resolved_url, arg_max(method, (updated_at, resolved_url)) AS method, arg_max(confidence, (updated_at, resolved_url)) AS confidence FROM u GROUP BY 1"))
def url_cache_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_cache(*_cache(spark, sf_dir)).drop("updated_at")


@query(sql(f", {_CACHE} SELECT s.id, CASE WHEN id % 6 = 0 THEN 'https://manual.example/' || id ELSE coalesce(c.resolved_url, source_url) END AS url, CASE WHEN id % 6 = 0 THEN 'direct' WHEN c.resolved_url IS NOT NULL THEN 'cache' WHEN source_url = '' THEN 'failed' ELSE 'auto' END AS mode FROM signal s LEFT JOIN c ON original_url = source_url"))
def url_cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The URL to fetch for each signal; every sixth has one set by hand."""
    s = Tables(spark, sf_dir).signal.select("id", "source_url", F.expr("if(id % 6 = 0, concat('https://manual.example/', id), '')").alias("resolved_url"))
    return cached_resolution(s, _cache(spark, sf_dir)[0])


def manual_resolution(signals: DataFrame, edits: DataFrame) -> DataFrame:
    """signals after edits (id, url, renew): a valid URL becomes the resolved one, set by hand, and an assessment to renew is pending."""
    valid = F.trim("url").rlike(r"^https?://[^\s/]+\.[^\s]+$")
    e = edits.select("id", F.trim("url").alias("_url"), valid.alias("_valid"), F.col("renew").alias("_renew"))
    x = signals.join(e, "id", "left")
    ok = F.coalesce(F.col("_valid"), F.lit(False))
    return x.withColumns(
        {
            "resolved_url": F.when(ok, F.col("_url")).otherwise(F.col("resolved_url")),
            "resolution_status": F.when(ok, "manual").otherwise(F.col("resolution_status")),
            "assessment_status": F.when(ok & F.col("_renew"), "pending").otherwise(F.col("assessment_status")),
            "outcome": F.when(F.col("_valid").isNull(), "unchanged").when(ok, "saved").otherwise("invalid"),
        }
    ).drop("_url", "_valid", "_renew")


@query(sql(", e AS (SELECT id, CASE id % 6 WHEN 0 THEN ' https://manual.example/' || id WHEN 2 THEN 'ftp://x.example/a' ELSE 'nothing' END AS url, id % 4 = 0 AS renew FROM signal WHERE id % 2 = 0), v AS (SELECT id, trim(url) AS url, regexp_matches(trim(url), '^https?://[^ /]+[.][^ ]+$') AS ok, renew FROM e) SELECT s.id, CASE WHEN ok THEN url ELSE '' END AS resolved_url, CASE WHEN ok THEN 'manual' ELSE 'unresolved' END AS resolution_status, CASE WHEN ok AND renew THEN 'pending' ELSE assessment_status END AS assessment_status, CASE WHEN ok IS NULL THEN 'unchanged' WHEN ok THEN 'saved' ELSE 'invalid' END AS outcome FROM signal s LEFT JOIN v USING (id)"))
def manual_resolved_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Tables(spark, sf_dir).signal.select("id", "assessment_status", F.lit("").alias("resolved_url"), F.lit("unresolved").alias("resolution_status"))
    edits = s.where("id % 2 = 0").select("id", F.expr("case id % 6 when 0 then concat(' https://manual.example/', id) when 2 then 'ftp://x.example/a' else 'nothing' end").alias("url"), (F.col("id") % 4 == 0).alias("renew"))
    return manual_resolution(s, edits)
