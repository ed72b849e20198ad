"""Exports, mates, raw links and feed cuts against plain versions."""

import csv
import hashlib
import re
from datetime import datetime
from pathlib import Path
from urllib.parse import urljoin

from pyspark.sql import functions as F

from epilens.plans import exports as e
from epilens.plans.texts import raw_urls
from epilens.sources.adapter import Tables
from epilens.sources.files import folder, read_feed

SF = "/root/testdata/sf0.001"


def test_export_is_ordered_and_whole(spark):
    t, path = Tables(spark, SF), folder(spark)
    sources = spark.createDataFrame([(1, 'say "hi",\nyou')], "id long, name string")
    rows = e.report_rows(t, e.exportable(t), sources, "monthly", "odd", place_id=8, province_id=1000)
    rows.write.options(**e._CSV).csv(path)
    files = sorted(Path(path.removeprefix("file://").removeprefix("file:")).glob("part-*.csv"))
    lines = [line for f in files for line in list(csv.reader(f.open(newline="")))[1:]]
    plain = rows.collect()
    assert [r.id for r in e.read_export(spark, path).collect()] != [] and sorted(x[0] for x in lines) == sorted(r.id for r in plain)
    times = [datetime.fromisoformat(x[4]) for x in lines]
    assert times == sorted(times, reverse=True) and all(x.utcoffset().total_seconds() == 0 for x in times)
    inside = {r[0] for r in t.primary.where("location_id = 8").select("signal_id").collect()}
    assert {int(x[0]) for x in lines} <= inside and len(lines) > 10
    assert {x[2] for x in lines} <= {"", 'say "hi",\nyou'}
    assert e.export_name(spark, "daily", "odd") == "signals_operational_daily_2024-01-31_2024-01-31.csv"


def test_export_of_nulls(spark):
    t = Tables(spark, SF)
    none = e.exportable(t).limit(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) if f.name not in ("status", "published_at") else F.lit("raw").alias("status") if f.name == "status" else F.expr("timestamp_ntz'2024-01-31 00:00:00'").alias("published_at") for f in e.exportable(t).schema])
    (row,) = e.report_rows(t, none, spark.createDataFrame([], "id long, name string")).collect()
    assert row.published_at == "2024-01-31T00:00:00+00:00" and row.status == "raw"
    assert {row[c] for c in e.COLUMNS if c not in ("published_at", "status")} == {""}


def test_mates(spark):
    values = [(i, "a", "noise" if i % 7 == 0 else "raw", i % 4, None, None) for i in range(40)] + [(100, "b", "raw", 1, None, None), (101, None, "raw", 1, None, None), (102, "n", "noise", 1, None, None)]
    rows = spark.createDataFrame(values, "id long, cluster_key string, status string, threat_score int, published_at timestamp, created_at timestamp")
    got = {r.id: list(r.mates) for r in e.cluster_mates(rows, rows.select("id", "cluster_key")).collect()}
    for i, key, *_ in values:
        mates = sorted((r for r in values if key is not None and r[1] == key and r[0] != i and r[2] != "noise"), key=lambda r: (-r[3], -r[0]))
        assert got[i] == [r[0] for r in mates[:10]]


def test_fingerprint(spark):
    rows = [("Two  CASES!", " dbd", None, "A.b"), ("see https://x/y now", "", "Kota-X", None), (None, None, None, None)]
    x = spark.createDataFrame(rows, "t string, d string, p string, s string")
    got = [r[0] for r in x.select(e.fingerprint(F.col("t"), F.col("d"), F.col("p"), F.col("s"))).collect()]
    texts = ["two cases | dbd |  | a b", "see now |  | kota x | ", " |  |  | "]
    assert got == [hashlib.sha256(s.encode()).hexdigest() for s in texts]


def test_raw_links(spark):
    def plain(html, base):
        found = re.findall(r"https?://[^\s\"'<>\\]+", html or "") + [urljoin(base, p) for p in re.findall(r"(/[a-zA-Z0-9-]+/[a-zA-Z0-9-]+/\d{5,}/[a-zA-Z0-9\-]+)", html or "")]
        return list(dict.fromkeys(found))

    pages = [
        ('<a href="https://a.example/x/y/12345/z?q=1">x</a> "https:\\/\\/b.example\\/q" \'http://c.example\' http://c.example', "https://h.example/p/q?r#s"),
        ('"/a/b/1234/no" "/a/b/12345/yes" /a/b/12345/yes /q/a-b/c-1/999999/d-e/f', "http://h.example"), ("", "https://h.example"), (None, "https://h.example"), ("/a/b/12345/c", "https://h.example:8/x"),
    ]
    got = spark.createDataFrame(pages, "html string, base string").select(raw_urls(F.col("html"), F.col("base"))).collect()
    assert [list(r[0]) for r in got] == [plain(*p) for p in pages]


def test_feed_cuts(spark):
    path = folder(spark)
    rows = [(1, "a" * 219 + " bcd", "l", "x" * 321, None), (2, "a" * 219 + " other", "l", "second", None), (3, "b" * 220, "l", "y" * 320, None)]
    items = spark.createDataFrame(rows, "position long, title string, link string, description string, pubDate string")
    items.write.format("xml").option("rowTag", "item").option("rootTag", "channel").save(path)
    got = {r.title: r.summary for r in read_feed(spark, path).collect()}
    assert got == {"a" * 219 + "...": "x" * 320 + "...", "b" * 220: "y" * 320}
