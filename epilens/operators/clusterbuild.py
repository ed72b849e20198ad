"""Cluster builds that recompute only what changed since the last one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epilens.operators.cluster import _KEY, cluster_rows, clusters
from epilens.registry import query
from epilens.sources.adapter import AS_OF, Tables, sql
from epilens.sources.files import folder

#: Statuses that a build assigns to clusters. A member that gets another one later stays, under its key.
ASSIGNED = ["raw", "validated", "approved"]
_MEMBER = ["id", "cluster_key", "day_utc", "status", "threat_score", "confidence_score"]
_SCHEMAS = {
    "members": "id long, cluster_key string, day_utc date, status string, threat_score int, confidence_score int, build long, day string",
    "clusters": "cluster_key string, signal_count long, raw_count long, validated_count long, verified_count long, noise_count long, max_score int, date_start date, date_end date, avg_score double, avg_confidence double, priority string, build long, day string",
    "days": "day string, mark timestamp_ntz, fresh boolean, build long",
}


class ClusterStore:
    """Clusters and their members in a shared folder, kept up by numbered builds.

    A cluster lies within a day, its key's last part, so both tables are written by day. A build reads and writes the days
    that its changes touch, in folders of its own, and aggregates only the keys that a signal came to, left or changed in;
    the other clusters of those days are copied. Its list of days is written last and makes it count: a build that died, or
    runs again under its number, starts from what the builds before it left. Keys without members are gone.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @classmethod
    def create(cls, spark: SparkSession, path: str) -> ClusterStore:
        for name, schema in _SCHEMAS.items():
            spark.createDataFrame([], schema).write.partitionBy("build", *(["day"] if name != "days" else [])).parquet(f"{path}/{name}")
        return cls(spark, path)

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.schema(_SCHEMAS[name]).parquet(f"{self.path}/{name}")

    def _listed(self, before: int | None) -> DataFrame:
        """The lists of days since the last build that started anew."""
        days = self._read("days")
        days = days if before is None else days.where(F.col("build") < before)
        anew = days.agg(F.coalesce(F.max(F.when(F.col("fresh"), F.col("build"))), F.lit(-1)).alias("anew"))
        # One row, so broadcasting it is bounded.
        return days.join(F.broadcast(anew), F.col("build") >= F.col("anew"))

    def _days(self, before: int | None) -> DataFrame:
        """Each day's build that counts."""
        return self._listed(before).groupBy("day").agg(F.max("build").alias("build"))

    def _current(self, name: str, before: int | None) -> DataFrame:
        """The rows that count. Folders of later builds, whole or broken off, are not even opened where before is given."""
        rows = self._read(name)
        rows = rows if before is None else rows.where(F.col("build") < before)
        return rows.join(self._days(before), ["day", "build"], "left_semi").drop("build")

    def members(self, before: int | None = None) -> DataFrame:
        return self._current("members", before)

    def clusters(self, before: int | None = None) -> DataFrame:
        return self._current("clusters", before)

    def mark(self, before: int | None = None):
        """The newest change that a build has taken; None before the first."""
        return self._listed(before).agg(F.max("mark")).first()[0]

    def build(self, number: int, rows: DataFrame, limit: int | None = None, reset: bool = False, only_empty: bool = False, dry_run: bool = False) -> DataFrame:
        """One row: processed, created, updated, removed (clusters), mark.

        rows: signals with cluster_key and changed_at; of rows that share an id the last changed counts, of equally old
        ones the greatest. Rows older than the mark are passed over; those of the mark's very instant are taken again, since
        more may have come since. limit takes the newest by published_at and id; only_empty leaves signals that have a
        cluster as they are; both leave the mark where it was, for a later build to take the rest. reset forgets clusters and
        mark; dry_run only counts. Rows without an id or key are passed over, no rows change nothing. To find the clusters
        that signals leave, the members' ids and keys are read whole; everything else is by day.
        """
        mark = None if reset else self.mark(number)
        held = self.members(number).where(F.lit(not reset))
        fresh = rows.where("id is not null and cluster_key is not null")
        fresh = fresh if mark is None else fresh.where(F.col("changed_at") >= F.lit(mark))
        value = F.struct("changed_at", "published_at", *_MEMBER[1:])
        fresh = fresh.groupBy("id").agg(F.max(value).alias("v")).select("id", "v.*")
        known = held.select("id", F.col("cluster_key").alias("was_key"), F.struct(*_MEMBER[1:]).alias("was"), F.col("day_utc").alias("was_day_utc"))
        x = fresh.join(known, "id", "left")
        assigned = F.coalesce(F.col("status").isin(ASSIGNED), F.lit(False))
        takes = assigned & F.col("was_key").isNull() if only_empty else assigned
        stays = ~assigned & F.col("was_key").isNotNull() & F.lit(not only_empty)
        # One pass over the join; only a limit, which must order what is assigned, makes it two.
        x = x.where(takes | stays) if limit is None else x.where(takes).orderBy(F.desc("published_at"), F.desc("id")).limit(limit).unionByName(x.where(stays))
        x = x.withColumns({c: F.when(takes, F.col(c)).otherwise(F.col(was)) for c, was in (("cluster_key", "was_key"), ("day_utc", "was_day_utc"))})
        delta = x.where(F.col("was").isNull() | ~F.struct(*_MEMBER[1:]).eqNullSafe(F.col("was")))
        name = "dry" if dry_run else "delta"
        delta.select(*_MEMBER, "was_key", "changed_at").write.mode("overwrite").parquet(f"{self.path}/{name}/build={number}")
        delta = self.spark.read.parquet(f"{self.path}/{name}/build={number}")

        touched = delta.select(F.explode(F.array("cluster_key", "was_key")).alias("cluster_key")).where("cluster_key is not null").distinct()
        days = touched.select(_day().alias("day")).distinct()
        before = held.join(days, "day", "left_semi").join(delta.select("id"), "id", "left_anti")
        after = before.select(*_MEMBER).unionByName(delta.select(*_MEMBER)).withColumn("day", _day())
        old = self.clusters(number).where(F.lit(not reset)).join(days, "day", "left_semi")
        if dry_run:
            new = clusters(after.join(touched, "cluster_key", "left_semi"))
        else:
            after.hint("rebalance", "day").write.mode("overwrite").partitionBy("day").parquet(f"{self.path}/members/build={number}")
            now = self._read("members").where(F.col("build") == number)
            new = clusters(now.join(touched, "cluster_key", "left_semi"))
            kept = old.join(touched, "cluster_key", "left_anti")
            both = new.withColumn("day", _day()).unionByName(kept)
            both.hint("rebalance", "day").write.mode("overwrite").partitionBy("day").parquet(f"{self.path}/clusters/build={number}")
            new = self._read("clusters").where(F.col("build") == number)
        counts = touched.join(old.select("cluster_key", F.lit(True).alias("had")), "cluster_key", "left").join(new.select("cluster_key", F.lit(True).alias("has")), "cluster_key", "left")
        counts = counts.selectExpr("count_if(had is null and has) as created", "count_if(had and has) as updated", "count_if(had and has is null) as removed")
        seen = delta.agg(F.count("*").alias("processed"), F.max("changed_at").alias("newest")).first()
        newest = mark if limit is not None or only_empty else max(filter(None, (mark, seen.newest)), default=None)
        newest = F.lit(newest).cast("timestamp_ntz").alias("mark")
        if not dry_run:
            # A build that starts anew counts even if no day is left: its row without a day says so.
            listed = days.unionByName(self.spark.createDataFrame([(None,)], "day string")) if reset else days
            self._finish(number, listed.select("day", newest, F.lit(reset).alias("fresh")))
        return counts.select(F.lit(seen.processed).cast("long").alias("processed"), "created", "updated", "removed", newest)

    def _finish(self, number: int, days: DataFrame) -> None:
        days.write.mode("overwrite").parquet(f"{self.path}/days/build={number}")

    def compact(self, path: str) -> ClusterStore:
        """A store in another folder with the same clusters, members and mark as its build 0."""
        to, days = ClusterStore.create(self.spark, path), self._days(None).select("day")
        for name in ("members", "clusters"):
            getattr(self, name)().hint("rebalance", "day").write.partitionBy("day").parquet(f"{path}/{name}/build=0")
        days.select("day", F.lit(self.mark()).cast("timestamp_ntz").alias("mark"), F.lit(True).alias("fresh")).write.parquet(f"{path}/days/build=0")
        return to


def _day():
    """The day in a cluster's key: its last part."""
    return F.substring_index("cluster_key", "|", -1)


def change_feed(t: Tables) -> DataFrame:
    """Versions of the signals with changed_at: every third first comes raw, a day early and under another disease."""
    hour = lambda n: F.expr(f"timestamp_ntz'{AS_OF}' + make_dt_interval(0, cast({n} as int))")
    last = t.signal.withColumn("changed_at", hour("1 + id % 4"))
    first = last.where("id % 3 = 0").withColumns({"changed_at": hour("id % 4"), "status": F.lit("raw"), "disease_tag": F.lit("Early"), "published_at": F.expr("published_at - interval 1 day")})
    return cluster_rows(t, last.unionByName(first))


#: What the feed leaves: noise that was raw once stays where it was.
_LEFT = "(SELECT * REPLACE (CASE WHEN status = 'noise' THEN 'Early' ELSE disease_tag END AS disease_tag, CASE WHEN status = 'noise' THEN published_at - INTERVAL 1 DAY ELSE published_at END AS published_at) FROM signal WHERE status <> 'noise' OR id % 3 = 0)"


def kept_feed(t: Tables, path: str) -> DataFrame:
    """The feed, written once: a folder for each instant of change, of which there are five, so that a build opens what it takes."""
    feed = change_feed(t).select(*_MEMBER, "published_at", "changed_at")
    feed.write.partitionBy("changed_at").parquet(path)
    return t.spark.read.schema(feed.schema).parquet(path)


def built(t: Tables, path: str, builds: int = 5, feed: DataFrame | None = None) -> ClusterStore:
    """A store after builds over the feed as it grows, one an hour."""
    store, feed = ClusterStore.create(t.spark, path), kept_feed(t, folder(t.spark)) if feed is None else feed
    for k in range(builds):
        store.build(k, feed.where(F.col("changed_at") <= F.expr(f"timestamp_ntz'{AS_OF}' + interval {k} hours")))
    return store


@query(sql(_KEY.replace("FROM signal s LEFT JOIN fl", f"FROM {_LEFT} s LEFT JOIN fl") + "SELECT * FROM clp"))
def cluster_increments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters after five builds, in which signals come, change disease and day, and turn to noise."""
    return built(Tables(spark, sf_dir), folder(spark)).clusters().drop("day")


@query(sql(_KEY.replace("FROM signal s LEFT JOIN fl", f"FROM {_LEFT} s LEFT JOIN fl").replace("OR id % 3 = 0", "OR id % 12 IN (0, 9)") + "SELECT split_part(cluster_key, '|', 3) AS day, count(*) AS members, count(DISTINCT cluster_key) AS clusters, CAST(sum(id) AS BIGINT) AS ids FROM ck GROUP BY 1"))
def cluster_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members by day of a store that was built, put together in another folder, and built on."""
    t = Tables(spark, sf_dir)
    feed = kept_feed(t, folder(spark))
    store = built(t, folder(spark), 2, feed).compact(folder(spark))
    store.build(1, feed, limit=100)
    store.build(2, feed)
    return store.members().groupBy("day").agg(F.count("*").alias("members"), F.countDistinct("cluster_key").alias("clusters"), F.sum("id").alias("ids"))
