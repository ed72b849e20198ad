"""Signals as a stream: daily counts, deduplicated by id, equal to the batch result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epilens.registry import query
from epilens.sources.files import folder

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def daily_counts(events: DataFrame, late: str = "60 days") -> DataFrame:
    """Counts by UTC day and type, each event_id once within the watermark."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    once = timed.dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else timed.dropDuplicates(["event_id"])
    counts = once.groupBy(F.window("at", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") >= 70).alias("high"))
    return counts.select(F.col("w.start").cast("date").alias("day_utc"), "event_type", "n", "high")


def run_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs the stream over what is there; each batch's update rows are kept, the last row of a key counts."""
    out, state = folder(spark), folder(spark)
    source = spark.readStream.schema(SCHEMA).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    running = daily_counts(source).writeStream.outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(keep).start()
    running.awaitTermination()
    rows = spark.read.parquet(f"{out}/epoch=*")
    return rows.groupBy("day_utc", "event_type").agg(F.max_by("n", "epoch").alias("n"), F.max_by("high", "epoch").alias("high"))


_DAILY = "SELECT CAST(ts AS DATE) AS day_utc, event_type, count(*) AS n, count(*) FILTER (WHERE value >= 70) AS high FROM events GROUP BY 1, 2"


@query(_DAILY)
def stream_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_available(spark, sf_dir)


@query(_DAILY)
def batch_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_counts(spark.read.schema(SCHEMA).parquet(f"{sf_dir}/events.parquet"))
