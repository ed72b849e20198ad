"""Clusters built in steps are those of one build."""

from collections import Counter

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from epilens.functions.text import slug
from epilens.operators import clusterbuild
from epilens.operators.clusterbuild import ClusterStore, built, change_feed
from epilens.sources.adapter import AS_OF, Tables
from epilens.sources.files import folder

SF = "/root/testdata/sf0.001"
ROWS = "id long, cluster_key string, day_utc date, status string, threat_score int, confidence_score int, published_at timestamp_ntz, changed_at timestamp_ntz"


def rows(df):
    return Counter(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())


def signals(spark, *values):
    """(id, key's start, day, status, score, changed_at's minute)"""
    x = spark.createDataFrame(values, "id long, k string, d string, status string, threat_score int, m int")
    x = x.withColumns({"cluster_key": F.concat_ws("|", "k", F.lit("p"), F.coalesce("d", F.lit("unknown_date"))), "day_utc": F.col("d").cast("date"), "confidence_score": F.lit(60), "published_at": F.col("d").cast("timestamp_ntz"), "changed_at": F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, m)")})
    return x.select(*[c.split()[0] for c in ROWS.split(", ")])


def summary(df):
    r = df.first()
    return (r.processed, r.created, r.updated, r.removed)


def test_ten_builds_equal_one(spark):
    """In order of id, each build with a tenth of the signals; then a reset build over all of them."""
    t = Tables(spark, SF)
    feed = change_feed(t).where("status <> 'noise'").persist()
    last = feed.groupBy("id").agg(F.max("changed_at").alias("changed_at"))
    final = feed.join(last, ["id", "changed_at"])
    steps, once = ClusterStore.create(spark, folder(spark)), ClusterStore.create(spark, folder(spark))
    once.build(0, final)
    parts = feed.withColumn("changed_at", F.expr("changed_at + make_dt_interval(cast(id % 10 as int))"))
    for k in range(10):
        steps.build(k, parts.where(F.col("id") % 10 <= k))
    assert rows(steps.clusters()) == rows(once.clusters()) and rows(steps.members()) == rows(once.members())
    steps.build(10, final, reset=True)
    assert rows(steps.clusters()) == rows(once.clusters())
    feed.unpersist()


class Dies(ClusterStore):
    def _finish(self, number, days):
        raise RuntimeError("killed")


def test_a_build_that_died(spark):
    """Killed after it wrote all but its list of days, nothing of it counts, and it runs again."""
    t = Tables(spark, SF)
    store, feed = built(t, folder(spark), 2), change_feed(t)
    clusters, members = rows(store.clusters()), rows(store.members())
    with pytest.raises(RuntimeError, match="killed"):
        Dies(spark, store.path).build(2, feed.where("id % 2 = 0"))
    assert store._read("members").where("build = 2").count() > 0
    assert rows(store.clusters()) == clusters and rows(store.members()) == members
    store.build(2, feed.where(F.col("changed_at") <= F.expr(f"timestamp_ntz'{AS_OF}' + interval 2 hours")))
    whole = built(t, folder(spark), 3)
    assert rows(store.clusters()) == rows(whole.clusters()) and rows(store.members()) == rows(whole.members())


def test_moves_noise_and_ties(spark):
    store = ClusterStore.create(spark, folder(spark))
    first = signals(spark, (1, "a", "2024-01-01", "raw", 80, 1), (2, "a", "2024-01-01", "raw", 10, 1), (3, "b", "2024-01-02", "raw", 20, 1), (4, "c", None, "raw", 5, 1), (5, "a", "2024-01-01", "noise", 99, 1), (None, "a", "2024-01-01", "raw", 1, 1))
    assert summary(store.build(0, first)) == (4, 3, 0, 0)
    # 1 turns to noise and stays under a; 3 leaves b, which goes, for a; 6 comes twice and the later change counts.
    more = signals(spark, (1, "z", "2024-01-09", "noise", 80, 2), (3, "a", "2024-01-01", "raw", 20, 2), (6, "c", None, "raw", 7, 2), (6, "c", None, "approved", 9, 3), (2, "a", "2024-01-01", "raw", 10, 2))
    got = store.build(1, more, dry_run=True)
    assert summary(got) == (3, 0, 2, 1) and store.members().count() == 4
    assert summary(store.build(1, more)) == (3, 0, 2, 1)
    c = {r.cluster_key: r for r in store.clusters().collect()}
    assert set(c) == {"a|p|2024-01-01", "c|p|unknown_date"}
    assert (c["a|p|2024-01-01"].signal_count, c["a|p|2024-01-01"].noise_count, c["a|p|2024-01-01"].max_score) == (3, 1, 20)
    assert (c["c|p|unknown_date"].verified_count, c["c|p|unknown_date"].date_start) == (1, None)
    assert store.mark().minute == 3
    # Nothing has changed since: no day is written.
    assert summary(store.build(2, more)) == (0, 0, 0, 0) and store._read("members").where("build = 2").count() == 0
    # Run again, a build gives the same; what is older than the mark is passed over.
    want = rows(store.clusters())
    store.build(1, more)
    assert summary(store.build(3, signals(spark, (9, "q", "2024-01-03", "raw", 1, 0)))) == (0, 0, 0, 0) and rows(store.clusters()) == want


def test_options(spark):
    store = ClusterStore.create(spark, folder(spark))
    all_rows = signals(spark, *[(i, "a", f"2024-01-0{i}", "raw", i, i) for i in range(1, 6)])
    assert summary(store.build(0, all_rows, limit=2)) == (2, 2, 0, 0) and store.mark() is None
    assert {r.id for r in store.members().collect()} == {4, 5}
    changed = all_rows.withColumn("threat_score", F.lit(50))
    assert summary(store.build(1, changed, only_empty=True)) == (3, 3, 0, 0) and store.mark() is None
    assert {r.id: r.threat_score for r in store.members().collect()} == {1: 50, 2: 50, 3: 50, 4: 4, 5: 5}
    assert summary(store.build(2, changed)) == (2, 0, 2, 0)
    # Only the days of 4 and 5 were written.
    assert {r.day for r in store._read("members").where("build = 2").select("day").distinct().collect()} == {"2024-01-04", "2024-01-05"}
    small = store.compact(folder(spark))
    assert rows(small.members()) == rows(store.members()) and rows(small.clusters()) == rows(store.clusters()) and small.mark() == store.mark()
    assert summary(store.build(3, all_rows.where("id = 1"), reset=True)) == (1, 1, 0, 0) and store.clusters().count() == 1
    store.build(4, all_rows.where("id = 0"), reset=True)
    assert store.clusters().count() == 0 and store.mark() is None
    assert summary(store.build(5, signals(spark, (7, "a", "2024-02-01", "validated", 1, 0)))) == (1, 1, 0, 0)


def test_builds_open_what_changed(spark, monkeypatch):
    """No build derives the feed from the tables again, and each opens only the folders of its hours."""
    fed, build = [], ClusterStore.build
    monkeypatch.setattr(ClusterStore, "build", lambda self, number, rows, **options: (fed.append(rows), build(self, number, rows, **options))[1])
    built(Tables(spark, SF), folder(spark), 2)
    assert len(fed) == 2 and not any("events" in f for x in fed for f in x.inputFiles())
    assert all("PartitionFilters: [isnotnull(changed_at" in x._jdf.queryExecution().executedPlan().toString() for x in fed)


def test_a_build_takes_its_rows_once(spark, monkeypatch):
    """What is assigned and what stays come from one pass over the rows."""
    plans, parquet = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *args, **options: (plans.append((path, self._df._jdf.queryExecution().optimizedPlan().toString())), parquet(self, path, *args, **options))[1])
    store = ClusterStore.create(spark, folder(spark))
    rows = signals(spark, *[(i, "a", "2024-01-01", "noise" if i % 3 == 0 else "raw", i, 1) for i in range(30)])
    store.build(0, rows.withColumn("status", F.lit("raw")))
    assert summary(store.build(1, rows.withColumn("threat_score", F.lit(7)))) == (29, 0, 1, 0)
    assert [plan.count("max(struct(changed_at") for path, plan in plans if "/delta/" in path] == [1, 1]


def test_members_derive_the_feed_once(spark, monkeypatch):
    """Four builds in two stores take their changes from one written feed."""
    made, feed = [], clusterbuild.change_feed
    monkeypatch.setattr(clusterbuild, "change_feed", lambda t: (made.append(t), feed(t))[1])
    assert clusterbuild.cluster_members(spark, SF).count() > 0 and len(made) == 1


def test_slugs_of_odd_texts(spark):
    want = {"place 12": "place-12", " \t_-Á b\n--c_ ": "a-b-c", "İstanbul/日本 ſ": "istanbul", "a日b": "ab", "_": "none", "\u00a0": "none", "": "none", None: "none", "a - b": "a-b", "x\n": "x", "- a": "a"}
    got = spark.createDataFrame([(c,) for c in want], "c string").select("c", slug(F.col("c"), "none").alias("s")).collect()
    assert {r.c: r.s for r in got} == want
