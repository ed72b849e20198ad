"""Alerts and sessions of signals as streams, equal to the batch results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epilens.functions.numeric import ladder
from epilens.registry import query
from epilens.sources.files import folder
from epilens.streaming.daily import SCHEMA

KEY = ["disease", "place", "day_utc"]


def contributions(events: DataFrame) -> DataFrame:
    """What events add to alerts: one row per alert key with sums, extremes and counts, which merge in any order."""
    rows = events.select(F.col("event_type").alias("disease"), (F.col("user_id") % 25).alias("place"), F.to_date("ts").alias("day_utc"), F.floor("value").cast("long").alias("score"), "ts")
    return rows.groupBy(KEY).agg(F.count("*").alias("n"), F.count_if(F.col("score") >= 70).alias("high"), F.sum("score").alias("points"), F.max("score").alias("top"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))


def merged(parts: DataFrame) -> DataFrame:
    return parts.groupBy(KEY).agg(*[F.sum(c).alias(c) for c in ("n", "high", "points")], F.max("top").alias("top"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"))


def raised(totals: DataFrame, least: int = 3) -> DataFrame:
    """The alerts: keys with enough signals, and their level."""
    level = ladder((f"n >= {2 * least} and points >= 60 * n", "critical"), ("high >= 3 or points >= 60 * n", "high"), default="medium")
    return totals.where((F.col("n") >= least) & ((F.col("high") > 0) | (F.col("points") >= 35 * F.col("n")))).withColumn("level", level)


class AlertLog:
    """Alerts kept as the contributions of each epoch: a folder per epoch, overwritten if the epoch runs again.

    An epoch costs what it brings, not what is stored. compact() folds the epochs up to one into its folder's place.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def upsert(self, batch: DataFrame, epoch: int) -> None:
        """For foreachBatch: idempotent by epoch."""
        contributions(batch).write.mode("overwrite").parquet(f"{self.path}/part={epoch}")

    def totals(self) -> DataFrame:
        return merged(self.spark.read.parquet(f"{self.path}/part=*"))

    def compact(self, to: str) -> AlertLog:
        """A log in another folder that holds the totals as its first epoch."""
        self.totals().write.mode("overwrite").parquet(f"{to}/part=-1")
        return AlertLog(self.spark, to)


def alert_stream(spark: SparkSession, source: str, log: AlertLog, state: str, late: str = "60 days", upsert=None) -> None:
    """Runs what is there in epochs of one file. Each event_id counts once within the watermark, however often it comes."""
    events = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source).withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    once = events.dropDuplicatesWithinWatermark(["event_id"])
    once.writeStream.option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(upsert or log.upsert).start().awaitTermination()


def delivered(spark: SparkSession, sf_dir: str, files: int = 4) -> str:
    """A folder of the events as a feed delivers them: several files, out of order, every seventh event twice."""
    events = spark.read.schema(SCHEMA).parquet(f"{sf_dir}/events.parquet")
    both = events.withColumn("file", F.pmod(F.col("event_id") * 7, F.lit(files))).unionByName(events.where("event_id % 7 = 0").withColumn("file", F.pmod(F.col("event_id") * 5 + 1, F.lit(files))))
    path = folder(spark)
    # One write, each file by a task of its own: the events are read once for all files.
    both.repartitionById(files, F.col("file").cast("int")).drop("file").write.parquet(path)
    return path


_ALERTS = """WITH c AS (SELECT event_type AS disease, user_id % 25 AS place, CAST(ts AS DATE) AS day_utc, count(*) AS n, count(*) FILTER (WHERE floor(value) >= 70) AS high, CAST(sum(floor(value)) AS BIGINT) AS points, CAST(max(floor(value)) AS BIGINT) AS top, min(ts) AS first_at, max(ts) AS last_at FROM events GROUP BY ALL)
SELECT *, CASE WHEN n >= 6 AND points >= 60 * n THEN 'critical' WHEN high >= 3 OR points >= 60 * n THEN 'high' ELSE 'medium' END AS level FROM c WHERE n >= 3 AND (high > 0 OR points >= 35 * n)"""


@query(_ALERTS)
def stream_alert_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts from a feed with repeats, merged epoch by epoch."""
    log = AlertLog(spark, folder(spark))
    alert_stream(spark, delivered(spark, sf_dir), log, folder(spark))
    return raised(log.totals())


@query(_ALERTS)
def batch_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raised(contributions(spark.read.schema(SCHEMA).parquet(f"{sf_dir}/events.parquet")))


def sessions(events: DataFrame, gap: str = "12 hours") -> DataFrame:
    """Runs of signals of one disease and place that are less than a gap apart; a stream emits a run once it has closed."""
    w = F.session_window("at", gap)
    rows = events.groupBy(w.alias("w"), F.col("event_type").alias("disease"), (F.col("user_id") % 25).alias("place")).agg(F.count("*").alias("n"), F.max("value").alias("top"))
    return rows.select("disease", "place", F.col("w.start").cast("timestamp_ntz").alias("started"), F.col("w.end").cast("timestamp_ntz").alias("closed"), "n", "top")


_SESSIONS = """WITH s AS (SELECT event_type AS disease, user_id % 25 AS place, ts, value, CASE WHEN ts - lag(ts) OVER w < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY event_type, user_id % 25 ORDER BY ts)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY disease, place ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM s)
SELECT disease, place, min(ts) AS started, max(ts) + INTERVAL 12 HOUR AS closed, count(*) AS n, max(value) AS top FROM r GROUP BY disease, place, run"""


@query(_SESSIONS)
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of the feed in append mode; a last signal a year later closes all of them."""
    source, out = delivered(spark, sf_dir), folder(spark)
    last = spark.read.parquet(source).agg(F.max("ts").alias("ts"))
    beat = last.select(F.lit(-1).cast("long").alias("event_id"), F.expr("ts + interval 365 days").alias("ts"), F.lit(-1).cast("long").alias("user_id"), F.lit("heartbeat").alias("event_type"), F.lit(0.0).alias("value"), F.lit("{}").alias("props"))
    beat.coalesce(1).write.mode("append").parquet(source)
    events = spark.readStream.schema(SCHEMA).parquet(source).withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "60 days").dropDuplicatesWithinWatermark(["event_id"])
    sessions(events).writeStream.format("parquet").option("path", out).option("checkpointLocation", folder(spark)).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


@query(_SESSIONS)
def batch_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(spark.read.schema(SCHEMA).parquet(f"{sf_dir}/events.parquet").withColumn("at", F.col("ts").cast("timestamp")))
