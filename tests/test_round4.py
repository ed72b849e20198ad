"""Queries of the fourth round against their SQL and plainer code."""

import random
import re

import duckdb
from pyspark.sql import functions as F

from epilens import catalog
from epilens.operators import phraseindex, upkeep


def test_normal_forms_of_one_another(spark, tmp_path):
    """Forms that are made from other forms equal those made from the text, and classes are written out where they mix ranges and characters."""
    rng = random.Random(4)
    parts = [" ", " ", " ", "  ", "\n", "\t", "&", "/", "-", "_", ".", ",", "'", "é", "É", "ÿ", "ß", "K", "😀", "provinsi", "PROVINSI", "kab.", "Kab", "prov ", "kodya", "DKI", "di\nyogyakarta", "http://", "https://x", "://", "a", "B", "z9", "0"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(3000)] + [None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    result = con.execute(catalog.SQL["text_normalize"])
    columns = [c[0] for c in result.description]
    df = catalog.QUERIES["text_normalize"](spark, str(tmp_path))
    got = {r[0]: r for r in map(tuple, df.select(*columns).collect())}
    wrong = [(texts[r[0]], c) for r in result.fetchall() for c, a, b in zip(columns, r, got.pop(r[0]), strict=True) if a != b]
    assert not wrong and not got
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"\[\^?a-z0-9[^\]_]", plan)


def test_short_heads_are_looked_for_in_the_newest_titles_first(spark, monkeypatch):
    """The newest title that holds a head, as brute force finds it, among more titles than are looked at first and among fewer."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("ab1", k=rng.randint(1, 3)))
    titles = sorted({(rng.choice("xy"), rng.choice("pq"), " ".join(word() for _ in range(rng.randint(1, 5))), i) for i in range(400)}, key=lambda r: r[3])
    titles = list({r[:3]: r for r in titles}.values())
    asked = sorted({(" ".join(word() for _ in range(rng.randint(1, 4))), rng.choice("xyz"), rng.choice("pq")) for _ in range(300)})
    want = sorted((h, d, p, max(m)) for h, d, p in asked if (m := [i for td, tp, t, i in titles if (td, tp) == (d, p) and h in t]))
    t = spark.createDataFrame(titles, "_d string, _p string, _title string, i int").select("_d", "_p", "_title", F.struct(F.struct("i").alias("o"), F.struct("i").alias("f")).alias("m"))
    a = spark.createDataFrame(asked, "_head string, _d string, _p string")
    for newest in (1000, 3):
        monkeypatch.setattr(upkeep, "NEWEST", newest)
        rows = upkeep.newest_holders(a, t).join(a, ["_head", "_d", "_p"]).select("_head", "_d", "_p", "m3.o.i")
        assert sorted(map(tuple, rows.collect())) == want and len(want) > 50


def test_heads_of_two_words_meet_titles_around_their_space(spark, monkeypatch):
    """A head of two words is no needle: titles that have one of its words alone do not meet it."""
    asked = []
    monkeypatch.setattr(upkeep, "needles_in", lambda texts, needles, *names: asked.extend(r[0] for r in needles.select("_head").collect()) or phraseindex.needles_in(texts, needles, *names))
    titles = spark.createDataFrame([("the th",), ("bath thin",), ("a  th then",), ("th",), ("x-th th",)], "_title string")
    heads = spark.createDataFrame([("th th",), ("th",), ("bath th",), ("e t",), ("a th",)], "_head string")
    found = upkeep.held_heads(heads, titles).select("_head", "_title").collect()
    assert sorted(map(tuple, found)) == [("bath th", "bath thin"), ("e t", "the th"), *[("th", t) for t in ("a  th then", "bath thin", "th", "the th", "x-th th")], *[("th th", t) for t in ("a  th then", "bath thin", "x-th th")]]
    assert asked == ["th"]
