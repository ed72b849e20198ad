"""Queries against their SQL on rows made for the purpose."""

import re
from datetime import datetime, timedelta

import duckdb
import pytest

from epilens import catalog


@pytest.fixture
def both(spark, tmp_path):
    """Runs a query and its SQL over tables given as (rows, schema); the rows of both, sorted."""

    def run(name, **tables):
        con = duckdb.connect()
        con.execute("SET TimeZone = 'UTC'")
        for table, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/{table}.parquet")
            con.execute(f"CREATE OR REPLACE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
        df = catalog.QUERIES[name](spark, str(tmp_path))
        result = con.execute(catalog.SQL[name])
        columns = [c[0] for c in result.description]
        return sorted(map(repr, df.select(*columns).collect())), sorted(repr(spark_row(columns, r)) for r in result.fetchall())

    return run


def spark_row(columns, values):
    from pyspark.sql import Row

    return Row(**dict(zip(columns, values, strict=True)))


EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def test_article_text_keeps_broken_references(both):
    """A reference without its semicolon stays; whole ones are decoded, one level."""
    html = ["<article>one&amp; two &amp</article>", "<article>a &lt;b&gt; &quot;c&quot; &amp;lt; &middot; &copy</article>"]
    got, want = both("article_text", pages=([(i, f"u{i}", h) for i, h in enumerate(html)], "page_id long, url string, html string"))
    assert got == want


def test_assessment_of_a_text_cut_after_a_space(both):
    """The stored content ends in a space at its 300th character, which belongs to its last sentence."""
    first, last = "Short title here.", "the last one with "
    texts = {12: f"{first} {'w' * (298 - len(first) - len(last))} {last}and more" + " more" * 20, 24: f"{first} Of the. the scum with  it"}
    assert texts[12][299] == " "
    got, want = both("assessment", documents=(list(texts.items()), "doc_id long, text string"))
    assert got == want


def test_dup_light_rounds_to_the_nearest_second(both):
    """Three days apart but for parts of a second, before and after the half."""
    start, parts = datetime(2024, 1, 5), (0, 499_999, 500_000, 500_001, 999_999)
    times = [start + timedelta(days=d, seconds=s, microseconds=p) for d in (0, 3) for s in (0, 1) for p in parts]
    rows = [(10 * i + 1, ts, 3, "view", 5.0, '{"k": 1}') for i, ts in enumerate(times) if (10 * i + 1) % 9]
    got, want = both("dup_light", events=(rows, EVENTS), documents=([(0, "t")], "doc_id long, text string"), region=([(0, "R")], "r_regionkey int, r_name string"), nation=([(0, "N", 0)], "n_nationkey int, n_name string, n_regionkey int"))
    assert got == want and len(got) > 10


@pytest.mark.parametrize("name", ["storage_upkeep", "compact_storage", "triage_signals", "escalation_words", "stored_text"])
def test_no_text_travels_with_an_event(spark, name):
    """What is asked of a document's text is computed below the join with the events."""
    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    joins = [i for i, line in enumerate(plan) if "Join Inner" in line and "doc_id" in line]
    assert joins and not any("text#" in line or "content#" in line for line in plan[: max(joins) + 1])


def test_normalisers_match_gaps_once(spark, both):
    """Runs of marks, all white space, neighbouring administrative words; and one pattern for a gap, not one for each character of it."""
    texts = ["  \t a  b\n\n c \x0b\f\r d ", "provinsi provinsi jawa", "x_provinsi,provinsi", "Érd / ÀÉ--_ é..", "https://a.b/c?d e--f https://", "", " ", "\n", "a \n b", "KAB. x; Prov y - z", "ab é c'd", "..-- --.."]
    got, want = both("text_normalize", documents=([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    assert got == want
    plan = catalog.QUERIES["text_normalize"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "[^a-z0-9]+" in plan and r"[^a-z0-9 \t\n\x0B\f\r]," not in plan


@pytest.mark.parametrize("name", ["place_candidates", "place_names_in_text", "place_by_pattern"])
def test_names_begin_where_no_word_character_stands(spark, both, name):
    """Names that begin a text, follow each other or odd characters; the place before a word is looked at, not matched."""
    texts = ["the The Foo-", "the Foo-the Bar the Baz", "The A1b Of C2d-Of E3f The'G", "😀the Foo xthe Bar _the Baz 9The Foo \u00e9The Foo -The Foo", "the  Foo the\nBar", "and Of The In Foo-Bar Is Ab", "\nThe Foo, Of Bar. The Foo's Of It", "of The Xy' In Zz` For Q-- the R", "Of Of Of The The In In Ab Cd Ef Gh Ij Kl Mn", "the", "", "The The"]
    got, want = both(name, documents=([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    assert got == want
    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "(?<![A-Za-z0-9_])" in plan and not re.search(r"regexp_extract[^ ]*\(text#\d+, \(\?:\^", plan)


@pytest.mark.parametrize("name", ["fingerprint_dups", "signal_fingerprints"])
def test_fingerprints_are_made_once(spark, name):
    """The rows and their counts come from one kept table."""
    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().withCachedData().toString()
    assert plan.count("InMemoryRelation") == 2


def test_an_anchor_meets_one_row(spark):
    """Related signals are chosen for a disease and place, not for an anchor: its rows are not grouped."""
    from epilens.plans.lists import related_signals
    from epilens.sources.adapter import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    anchors = t.signal.where("disease_tag <> ''").selectExpr("id", "lower(disease_tag) as d", "user_id % 25 as place")
    plan = related_signals(t, anchors)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan[: plan.index("Join Inner")]


def test_titles_travel_without_their_texts(spark):
    """A signal that is looked up by its title carries no text."""
    plan = catalog.QUERIES["existing_signal"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    texts = [line.replace("raw_location_text#", "") for line in plan]
    texts = [line for line in texts if "text#" in line or "content#" in line]
    assert texts and all(re.search(r"- (Project \[doc_id#|Filter |Relation \[doc_id#)", line) for line in texts)


def test_texts_of_phrases_are_taken_apart_once(spark):
    """The places of phrases as found by looking, each text read once; texts that share a key make no phrase together."""
    from pyspark.sql import functions as F

    from epilens.operators.phraseindex import mentions

    reads = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def read(text):
        reads.add(1)
        return text

    texts = [(1, "a b a b c"), (2, "!b"), (2, "x B a"), (3, "c, c & C"), (4, ""), (5, "a a a a"), (6, "q b c dan")]
    phrases = ["a b", "b a", "a", "c dan c", "a a a", "b x", "zz a", "q b c dan", "a b c"]
    rows = spark.createDataFrame(texts, "k long, t string").repartition(1).select("k", read("t").alias("t"))
    got = {tuple(r) for r in mentions(rows, spark.createDataFrame([(p,) for p in phrases], "form string"), "k", "t").select("k", "form", "start", "end").collect()}
    want = set()
    for k, t in texts:
        w = re.sub("[^a-z0-9]+", " ", t.lower().replace("&", " dan ")).strip().split(" ")
        want |= {(k, p, i, i + len(p.split(" "))) for p in phrases for i in range(len(w)) if w[i : i + len(p.split(" "))] == p.split(" ")}
    assert got == want and reads.value == len(texts)


@pytest.mark.parametrize("name", ["place_candidates", "place_names_in_text", "place_by_pattern", "text_to_place"])
def test_names_are_sought_by_their_first_letters(spark, name):
    """The look back stands behind the words, so that most places are passed over by a letter."""
    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "(?<=(?<![A-Za-z0-9_])" in plan and not re.search(r"regexp_extract[^ ]*\([a-z]+#\d+, \(\?<!", plan)


def test_texts_of_needles_are_cut_twice(spark):
    """Needles as found by looking; a text is read for the vocabulary, for its tokens, and for needles of several tokens."""
    from pyspark.sql import functions as F

    from epilens.operators.phraseindex import needles_in

    reads = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def read(text):
        reads.add(1)
        return text

    texts = [(1, "Flu burung, H5N1!"), (2, "aflu # b"), (3, "x...y é né 1.5"), (4, ""), (5, None), (6, "a . #b; #"), (7, "İnfluenza ab"), (8, "...")]
    needles = ["flu", "flu burung", "#", ". #", "...", "é", "né", "a", "n1", "b; #", "h5n1!", "q", "fl", ";"]
    rows = spark.createDataFrame(texts, "k long, t string").repartition(1).select("k", read("t").alias("t"))
    got = sorted(tuple(r) for r in needles_in(rows, spark.createDataFrame([(n,) for n in needles], "needle string"), "k", "t").collect())
    assert got == sorted((k, n) for k, t in texts for n in needles if n in (t or "").lower())
    assert reads.value == 3 * len(texts)


@pytest.mark.parametrize("marks", ["#;.", "#;.:!?%&/()=+*-_<>|~"])
def test_texts_are_cut_into_marks_only_for_many(spark, marks):
    """A few marks are looked for; for many, texts are cut into theirs. Both find what is there."""
    from epilens.operators.phraseindex import needles_in

    texts = [(1, "a; b... (c)"), (2, ""), (3, "x & y #1 | ~"), (4, "no marks"), (5, "+-_:!?%/=*<>")]
    needles = [*marks, "; b", ". ", "no"]
    df = needles_in(spark.createDataFrame(texts, "k long, t string"), spark.createDataFrame([(n,) for n in needles], "needle string"), "k", "t")
    assert sorted(map(tuple, df.collect())) == sorted({(k, n) for k, t in texts for n in needles if n.strip() and n in t})
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert (r"[a-z0-9\s]+" in plan) == (len(marks) > 16) and "regexp_extract_all(lower" not in plan


def test_meta_elements_are_sought_once(spark, both):
    """A page is gone through once for its meta elements; the first that has a content counts, property before name."""
    pages = ['<meta name="og:title" content="By name"><meta property="og:title" content="   ">', '<meta name="description" content="d &amp; e"><META property=\'og:description\' content="f  g">', '<meta property="twitter:title" content="t"><meta property="og:title"><meta property="og:title" content="second">', ""]
    rows = [(4 * i + k, "u", p) for i, p in enumerate(pages) for k in range(4)]
    got, want = both("article_extract", pages=(rows, "page_id long, url string, html string"))
    assert got == want
    plan = catalog.QUERIES["article_extract"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"<meta\s[^>]*>") == 1
