"""Ladders at their boundaries, exact numbers, and invariants."""

import random
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from epilens.functions.numeric import growth2, ratio2, risk_class
from epilens.functions.text import distinct_folded, headline, listed, numbers, region_code, slug, strip_admin, truncate
from epilens.functions.urls import host, url_class
from epilens.operators.cluster import clusters
from epilens.operators.merge import upsert
from epilens.operators.triage import triage
from epilens.plans.alerts import severity, upsert_alerts
from epilens.plans.maps import floor_quantile_bands
from epilens.sources.files import parse_instant


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], [*values]).select(column.alias("x")).first()[0]


def test_ratio_is_half_even(spark):
    pairs = [(s, n) for s in range(-60, 120, 7) for n in (1, 3, 8, 40, 200)]
    got = spark.createDataFrame(pairs, "s long, n long").select("s", "n", ratio2("s", "n").alias("r")).collect()
    for r in got:
        assert r.r == round(Fraction(r.s, r.n) * 100) / 100, (r.s, r.n)
    assert one(spark, ratio2("s", "n"), s=5, n=0) == 0.0


@pytest.mark.parametrize(("now", "before", "want"), [(5, 0, 100.0), (0, 0, 0.0), (3, 2, 50.0), (1, 3, -66.67)])
def test_growth(spark, now, before, want):
    assert one(spark, growth2("a", "b"), a=now, b=before) == want


@pytest.mark.parametrize(("high", "avg", "n", "want"), [(3, 0.0, 1, "HIGH"), (0, 70.0, 1, "HIGH"), (1, 0.0, 1, "MEDIUM_HIGH"), (0, 69.99, 1, "MEDIUM_HIGH"), (0, 50.0, 1, "MEDIUM_HIGH"), (0, 49.99, 1, "MEDIUM"), (0, 34.99, 3, "MEDIUM"), (0, 34.99, 2, "LOW")])
def test_risk_class(spark, high, avg, n, want):
    assert one(spark, risk_class("h", "a", "n"), h=high, a=avg, n=n) == want


@pytest.mark.parametrize(("n", "high", "avg", "ratio", "want"), [(1, 3, 0.0, 0.0, "RED"), (1, 0, 70.0, 0.0, "RED"), (1, 0, 0.0, 3.0, "RED"), (1, 1, 0.0, 0.0, "ORANGE"), (1, 0, 55.0, 0.0, "ORANGE"), (1, 0, 0.0, 2.0, "ORANGE"), (3, 0, 0.0, 0.0, "YELLOW"), (1, 0, 40.0, 0.0, "YELLOW"), (2, 0, 39.0, 1.9, "GREEN")])
def test_severity(spark, n, high, avg, ratio, want):
    assert one(spark, severity(), n=n, high=high, avg_score=avg, ratio=ratio) == want


TRIAGE = [
    (44, 90, True, True, True, True, True, "noise_candidate", "noise"),
    (45, 45, True, True, True, True, False, "urgent", "review"),
    (0, 45, True, True, False, False, True, "urgent", "review"),
    (0, 45, True, False, False, False, True, "high", "fix_location"),
    (75, 70, True, True, False, False, False, "urgent", "approve"),
    (75, 69, True, True, False, False, False, "high", "review"),
    (60, 50, True, True, False, False, False, "high", "review"),
    (50, 49, True, False, False, False, False, "medium", "fix_location"),
    (29, 39, True, True, False, False, False, "noise_candidate", "noise"),
    (30, 44, True, True, False, False, False, "low", "review"),
    (30, 45, True, True, False, False, False, "medium", "review"),
]


@pytest.mark.parametrize("case", TRIAGE)
def test_triage(spark, case):
    row = dict(zip(("s", "c", "d", "p", "low", "report_24h", "emerging_watchlist"), case[:7], strict=True))
    priority, recommendation = triage()
    got = spark.createDataFrame([tuple(row.values())], [*row]).select(priority.alias("a"), recommendation.alias("b")).first()
    assert (got.a, got.b) == case[7:]


def test_cluster_priority(spark):
    rows = [("u", s, 70, "raw") for s in (75, 10, 10)] + [("h", s, 55, "raw") for s in (60, 1)] + [("m", 40, 0, "raw"), ("l", 39, 49, "raw"), ("n", 100, 100, "noise")]
    d = spark.createDataFrame(rows, "cluster_key string, threat_score int, confidence_score int, status string").withColumn("day_utc", F.lit("2024-01-01").cast("date"))
    assert {r.cluster_key: r.priority for r in clusters(d).collect()} == {"u": "urgent", "h": "high", "m": "medium", "l": "low", "n": "low"}


def test_texts(spark):
    s = lambda c, t: one(spark, c, t=t)
    t = F.col("t")
    assert s(region_code(t), "  Jawa-Barat / D.I. Été ") == "jawa_barat_di_ete"
    assert s(slug(t, "none"), "Été du  Sud!") == "ete-du-sud" and s(slug(t, "none"), "!!") == "none"
    assert s(truncate(t, 5), "abcd  efg") == "abcd..." and s(truncate(t, 0), "abcdef") == "abcdef"
    assert [s(c, "A - B - C") for c in headline(t)] == ["A - B", "C"] and [s(c, "A") for c in headline(t)] == ["A", ""]
    assert s(listed(t), "a, b;;c\n d") == ["a", "b", "c", "d"]
    assert s(numbers(t), "12 a3 4,5 _6 7") == ["12", "4", "5", "7"]
    assert s(strip_admin(t), "Kota Bandung") == "bandung" and s(strip_admin(t), "Kab. Bogor") == "bogor"
    assert s(distinct_folded(F.split(t, ",")), "B,a, b ,A,") == ["B", "a"]


@pytest.mark.parametrize(("url", "h", "kind"), [("https://www.x.com/a", "x.com", "blocked"), ("http://news.id/tag/a", "news.id", "not_article"), ("http://news.id/?q=x", "news.id", "not_article"), ("http://news.id/read/1", "news.id", "article"), ("http://news.id/p", "news.id", "other"), ("nothing", "", "none")])
def test_urls(spark, url, h, kind):
    assert one(spark, host(F.col("u")), u=url) == h and one(spark, url_class(F.col("u")), u=url) == kind


def test_instants(spark):
    parse = lambda t: str(one(spark, parse_instant(F.col("t")), t=t))
    assert parse("Mon, 13 Apr 2026 07:42:44 GMT") == "2026-04-13 07:42:44" == parse("2026-04-13T07:42:44Z")
    assert parse("soon") == "None"


def test_bands(spark):
    got = floor_quantile_bands(spark.createDataFrame([(v,) for v in (0, 1, 2, 3, 4, 5, 6)], "v long"), "v").collect()
    assert {r.v: r.band for r in got} == {0: 0, 1: 1, 2: 1, 3: 1, 4: 2, 5: 3, 6: 4}
    assert floor_quantile_bands(spark.createDataFrame([(0,)], "v long"), "v").first().band == 0


def test_upserts_are_idempotent(spark):
    old = spark.createDataFrame([(1, 5, ""), (2, 6, "kept")], "id long, score int, place string")
    new = spark.createDataFrame([(1, 7, "filled"), (2, 8, "lost"), (3, 9, "fresh")], "id long, score int, place string")
    once = upsert(old, new, "id", ["score"], ["place"])
    assert {tuple(r) for r in once.collect()} == {(1, 7, "filled", "updated"), (2, 8, "kept", "updated"), (3, 9, "fresh", "created")}
    twice = upsert(once.drop("action"), new, "id", ["score"], ["place"])
    assert {tuple(r)[:3] for r in twice.collect()} == {tuple(r)[:3] for r in once.collect()}


def test_closed_alerts_stay(spark):
    schema = "dedup_key string, status string, alert_type string, location_id long, signal_count long, avg_score double, first_signal_at timestamp_ntz, last_signal_at timestamp_ntz"
    old = spark.createDataFrame([("a", "closed", "t", 1, 1, 1.0, None, None), ("b", "open", "t", 1, 1, 1.0, None, None)], schema)
    new = spark.createDataFrame([(k, "", "t", 1, 9, 1.0, None, None) for k in "abc"], schema).drop("status")
    got = {r.dedup_key: (r.status, r.signal_count, r.action) for r in upsert_alerts(old, new).collect()}
    assert got == {"a": ("closed", 1, "kept"), "b": ("open", 9, "updated"), "c": ("open", 9, "inserted")}


def test_article_body_falls_back_to_the_page(spark):
    from epilens.plans.texts import article_body

    pages = ["<html><script>x</script><body><p>whole &amp; page</p></body></html>", "<p>out</p><article><p>in</p></article>", "<p>out</p><article></article>", ""]
    df = spark.createDataFrame(list(enumerate(pages)), "i int, html string")
    assert [r.b for r in df.orderBy("i").select(article_body(F.col("html")).alias("b")).collect()] == ["whole & page", "in", "", ""]


def test_snapshot_collects_at_most_three_members(spark):
    from epilens.operators.cluster import _first_three

    rows = spark.range(500).selectExpr("if(id % 2 = 0, 'a', 'b') as cluster_key", "struct(-id as a, id as b) as o", "concat('w', id) as w")
    assert {r.cluster_key: r.what for r in _first_three(rows, "w", "what").collect()} == {"a": "w498; w496; w494", "b": "w499; w497; w495"}


def test_unescape_equals_the_standard(spark):
    """All names with and without semicolon, decimal and hexadecimal numbers, and broken references."""
    import html
    from html.entities import html5

    from epilens.functions.text import unescape

    texts = [f"a&{n}b" for n in html5] + [f"&{n}" for n in html5] + [f"x&#{i};y" for i in [*range(300), 8364, 55296, 57343, 64976, 65534, 65535, 131070, 1114111, 1114112, 99999999999999999999]]
    texts += ["&#x41;&#X41z&#x0;&#xD800;&#x10FFFF;&#x110000;&#x1F600;", "&#65 &#065;&#;&#x;&;&& &amp;amp; &nosuch; &notit; &AMP &amp", "plain", "", "&lt;p&gt;", "é&eacute;日&#26085;"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r.u for r in df.select("i", unescape(F.col("t")).alias("u")).orderBy("i").collect()]
    assert got == [html.unescape(t) for t in texts]


class _Scopes(__import__("html.parser", fromlist=["HTMLParser"]).HTMLParser):
    """Texts of paragraphs and the scopes around them, by the standard parser."""

    def __init__(self):
        super().__init__()
        self.stack, self.found, self.now = [], [], None

    def handle_starttag(self, tag, attrs):
        if tag == "p":
            self.now = []
        elif tag in ("div", "main", "section", "article"):
            a = dict(attrs)
            named = [k for k in ("class", "id") if tag != "article" and re.search("article|content|detail|post|entry|read|news|body|story", a.get(k) or "")]
            self.stack.append((tag, "article" if tag == "article" else "".join(named[:1])))

    def handle_endtag(self, tag):
        if tag == "p" and self.now is not None:
            self.found.append(("".join(self.now), [s for _, s in self.stack if s]))
            self.now = None
        elif any(t == tag for t, _ in self.stack):
            while self.stack.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if self.now is not None:
            self.now.append(data)


def test_containers_end_where_they_close(spark):
    """Random nesting of elements against a parser with a stack."""
    from epilens.operators.articles import with_article

    rng = random.Random(5)
    pages = []
    for k in range(40):
        out, n = [], 0

        def block(depth):
            nonlocal n
            for _ in range(rng.randint(1, 3)):
                if depth < 4 and rng.random() < 0.6:
                    tag = rng.choice(["div", "main", "section", "DIV"])
                    name = rng.choice(["", "", ' class="story"', ' id="content"', ' class="menu"'])
                    out.append(f"<{tag}{name}>")
                    block(depth + 1)
                    out.append(f"</{tag}>")
                else:
                    n += 1
                    out.append(f"<p>Paragraph number {k}.{n} of a page with enough letters.</p>")

        block(0)
        pages.append((k, "".join(out)))
    got = {r.i: r.paragraphs for r in with_article(spark.createDataFrame(pages, "i int, h string"), "h").collect()}
    for k, page in pages:
        p = _Scopes()
        p.feed(page)
        named = {kind: [t for t, s in p.found if kind in s] for kind in ("class", "id")}
        few = page.count('class="story"') <= 6 and page.count('id="content"') <= 6
        want = list(dict.fromkeys(named["class"] + named["id"])) or [t for t, _ in p.found]
        assert not few or got[k] == want, page
