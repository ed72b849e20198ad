"""Seeding of master data, its versions, and the crawl queries of a catalogue."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from epilens.operators.disease import crawl_queries
from epilens.sources import masterdata as m
from epilens.sources.files import folder

OLD = "name string, value string, flag boolean, is_active boolean, notes string"
NEW = "seq int, name string, value string, supersedes array<string>"


def seed(spark, old, new, new_schema=NEW):
    rows = m.seeded(spark.createDataFrame(old, OLD), spark.createDataFrame(new, new_schema), "name").collect()
    return Counter((r.name, r.value, r.flag, r.is_active, r.notes, r.change) for r in rows)


def test_seeding_creates_updates_and_supersedes(spark):
    old = [("a", "1", True, True, ""), ("b", "2", False, False, "by hand"), ("old a", "3", None, True, "x"), ("gone", "4", True, False, "y"), ("same", "5", True, True, ""), ("left", None, None, None, None), (None, "6", True, True, "")]
    new = [(0, "a", "new", ["old a", "a"]), (1, "b", None, ["gone"]), (2, "same", "5", []), (3, "c", None, None), (4, "c", "last", []), (5, None, "no", ["left"]), (6, " ", "no", None)]
    assert seed(spark, old, new) == Counter([
        ("a", "new", True, True, "", "updated"), ("b", "2", False, True, "by hand", "updated"), ("old a", "3", None, False, "superseded", "superseded"), ("gone", "4", True, False, "y", "untouched"),
        ("same", "5", True, True, "", "unchanged"), ("left", None, None, None, None, "untouched"), (None, "6", True, True, "", "untouched"), ("c", "last", None, True, "", "created"),
    ])


def test_later_rows_win_over_supersedes_and_empty_tables_are_kept(spark):
    new = [(0, "a", "1", ["b"]), (1, "b", "2", []), (2, "c", "3", ["a"])]
    got = {r[0]: (r[3], r[5]) for r in seed(spark, [], new)}
    assert got == {"a": (False, "created"), "b": (True, "created"), "c": (True, "created")}
    assert not seed(spark, [], [])
    assert seed(spark, [("a", "1", True, True, "")], []) == Counter([("a", "1", True, True, "", "untouched")])
    assert seed(spark, [("a", "1", True, True, "")], [(0, "a", False)], "seq int, name string, is_active boolean") == Counter([("a", "1", True, False, "", "superseded")])


def counts(df):
    return {r["change"]: r["n"] for r in df.collect()}


def test_seeding_twice_changes_nothing(spark):
    store = m.MasterStore.create(spark, folder(spark))
    assert store.version("disease") == 0
    assert counts(store.seed("disease", m.diseases(spark), "name", m.CATALOGUE)) == {"created": 35}
    assert counts(store.seed("disease", m.diseases(spark), "name")) == {"unchanged": 35}
    assert store.version("disease") == 1
    # A seeding that died before its line was written counts for nothing and is overwritten.
    store.read("disease").limit(3).withColumn("change", F.lit("created")).write.mode("overwrite").parquet(f"{store.path}/disease/2")
    assert store.read("disease").count() == 35
    more = spark.createDataFrame([(0, "Mpox", "mpox", ["Nipah"])], "seq int, name string, aliases string, supersedes array<string>")
    assert counts(store.seed("disease", more, "name")) == {"updated": 1, "superseded": 1, "untouched": 33}
    assert store.version("disease") == 2
    assert store.read("disease").where("not is_active").select("name", "notes").collect() == [("Nipah", "superseded")]
    assert store.read("disease", 1).where("is_active").count() == 35
    assert counts(store.seed("rule", m.rules(spark), "name", "name string, kind string, keyword string, weight long, active boolean, is_active boolean")) == {"created": 50}
    assert store.version("disease") == 2


def test_seeds_are_whole(spark):
    d = m.diseases(spark)
    assert d.count() == 35 and d.where("report_24h").count() == 24 and d.select("name").distinct().count() == 35
    assert d.where("aliases = '' or disease_type = '' or severity_weight = ''").count() == 0
    assert m.rules(spark).count() == 50 and m.provinces(spark).count() == 38
    assert {r.name: r.province_code for r in m.provinces(spark).collect()}["DI Yogyakarta"] == "di_yogyakarta"
    p = m.publishers(spark)
    assert p.count() == 30 and p.select("normalized_alias").distinct().count() == 30


def test_publisher_rows(spark):
    rows = [("  The  Post! ", "https://www.post.example/x?y"), ("A", "WWW.a.example/"), (" ", "b.example"), ("C", None), ("!", "d.example")]
    got = m.publisher_rows(spark.createDataFrame(rows, "alias string, domain string")).collect()
    assert [(r.normalized_alias, r.domain) for r in got] == [("the post", "post.example"), ("a", "a.example")]


def test_seeds_from_files(spark):
    path = folder(spark)
    rows = [("2", "b", "1, 2", "TRUE", "x | y|"), ("1", "a", "", "maybe", None), (None, "z", 'say "hi"\nyou', "false", "")]
    spark.createDataFrame(rows, "seq string, Name string, aliases string, report_24h string, supersedes string").write.option("header", True).option("escape", '"').csv(path)
    got = {r.name: r for r in m.read_seeds(spark, path, m.DISEASE).collect()}
    assert got["b"].seq == 2 and got["b"].report_24h is True and got["b"].supersedes == ["x", "y"] and got["b"].skdr_code is None
    assert got["a"].aliases is None and got["a"].report_24h is None and got["a"].supersedes == []
    assert got["z"].seq == -1 and got["z"].aliases == 'say "hi"\nyou'


def plain_queries(rows, limit=4):
    """One disease after the other, by name."""
    seen, out = set(), []
    for name, *lists, active in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        terms = [t.strip() for cell in lists for t in re.split(r"[\n,;]+", cell or "") if t.strip()] or [name]
        k = 0
        for t in (" ".join(t.split()) for t in terms) if active else ():
            if t and t.lower() not in seen and k < limit:
                seen.add(t.lower())
                k += 1
                out.append((name, t, k))
    return Counter(out)


@pytest.mark.parametrize("kind", range(6))
def test_crawl_queries_equal_one_by_one(spark, kind):
    """Few terms among many diseases: what is taken passes on through chains."""
    rng = random.Random(kind)
    terms = [f"T{i}" for i in range((3, 8, 12, 20, 40, 9)[kind])]
    cell = lambda: rng.choice([", ", ";", "\n"]).join(rng.choice([str.lower, str.upper, lambda t: f"{t}  x "])(rng.choice(terms)) for _ in range(rng.randrange(7)))
    rows = [(f"d{i:02}" if kind < 5 else f"t{i}", cell(), rng.choice([None, cell()]), cell(), rng.random() < 0.9) for i in range(30)] + [(None, "n", "", "", True)]
    got = crawl_queries(spark.createDataFrame(rows, "name string, aliases string, keyword_id string, keyword_en string, is_active boolean"))
    assert Counter((r.name, r.term, r.k) for r in got.collect()) == plain_queries(rows)


def test_crawl_queries_of_no_rows(spark):
    assert crawl_queries(m.diseases(spark).withColumn("is_active", F.lit(False))).count() == 0
