"""Streams that are stopped and started again give what the batch gives."""

from collections import Counter

import pytest

from epilens.sources.files import folder
from epilens.streaming.alerts import SCHEMA, AlertLog, alert_stream, contributions, delivered, merged

SF = "/root/testdata/sf0.001"


def rows(df):
    return Counter(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())


@pytest.mark.parametrize("fails_after_write", [False, True])
def test_alerts_of_a_killed_stream(spark, fails_after_write):
    """It dies in its third epoch, before or after it wrote, starts again on its state, and dies no more."""
    source, state, log, died = delivered(spark, SF), folder(spark), AlertLog(spark, folder(spark)), []

    def upsert(batch, epoch):
        if fails_after_write:
            log.upsert(batch, epoch)
        if epoch == 2 and not died:
            died.append(epoch)
            raise RuntimeError("killed")
        log.upsert(batch, epoch)

    with pytest.raises(Exception, match="killed"):
        alert_stream(spark, source, log, state, upsert=upsert)
    alert_stream(spark, source, log, state, upsert=upsert)
    want = rows(contributions(spark.read.schema(SCHEMA).parquet(f"{SF}/events.parquet")))
    assert died == [2] and rows(log.totals()) == want
    alert_stream(spark, source, log, state)  # nothing new: nothing changes
    assert rows(log.totals()) == want and rows(log.compact(folder(spark)).totals()) == want


def test_late_and_repeated_events(spark):
    """A file of old and known events after the others adds only what is new and not too late."""
    source, state, log = delivered(spark, SF), folder(spark), AlertLog(spark, folder(spark))
    alert_stream(spark, source, log, state, late="60 days")
    events = spark.read.schema(SCHEMA).parquet(f"{SF}/events.parquet")
    more = events.where("event_id < 50").unionByName(events.where("event_id < 20").selectExpr("event_id + 100000 AS event_id", "ts", "user_id", "event_type", "value", "props"))
    more.coalesce(1).write.mode("append").parquet(source)
    alert_stream(spark, source, log, state, late="60 days")
    want = contributions(events.unionByName(more.where("event_id >= 100000")))
    assert rows(log.totals()) == rows(merged(want))


def test_a_feed_is_delivered_in_one_pass(spark):
    """All its files come from one write, each with its events."""
    spark.sparkContext.setJobGroup("delivered", "")
    path = delivered(spark, SF)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("delivered")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    feed, events = spark.read.parquet(path), spark.read.schema(SCHEMA).parquet(f"{SF}/events.parquet")
    assert len(feed.inputFiles()) == 4 and len(jobs) < 4
    assert rows(feed) == rows(events.unionByName(events.where("event_id % 7 = 0")))
