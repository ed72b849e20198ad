"""Order along time within a key, without one task per key.

Time is cut into stretches of `width` seconds. Rows are numbered within their
key's stretch, and stretches are counted; only the table of stretches, a row
for each hour and key, is ordered as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 3600


def seconds(ts: Column) -> Column:
    """Whole seconds of the epoch nearest to a timestamp; halves go to the even one."""
    return F.rint(F.unix_micros(ts.cast("timestamp")) / 1000000).cast("long")


def _offsets(stretches: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, stretch, before): rows of the key in earlier stretches; stretches has one n for each."""
    w = Window.partitionBy(*keys).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    return stretches.select(*keys, "stretch", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))


def numbered(rows: DataFrame, keys: list[str], order: list[str], at: str = "at", width: int = WIDTH) -> DataFrame:
    """rows with num: 1, 2, ... along order within the keys; order begins with at, in seconds."""
    x = rows.withColumn("stretch", F.floor(F.col(at) / width))
    n = x.groupBy(*keys, "stretch").agg(F.count("*").alias("n"))
    x = x.withColumn("_in", F.row_number().over(Window.partitionBy(*keys, "stretch").orderBy(*order)))
    return x.join(_offsets(n, keys), [*keys, "stretch"]).withColumn("num", F.col("_in") + F.col("before")).drop("stretch", "_in", "before")


def counted(rows: DataFrame, probes: DataFrame, keys: list[str], at: str = "at", width: int = WIDTH) -> DataFrame:
    """probes (keys, probe, at) with n: the number of rows of the keys up to and including at."""
    marks = rows.select(*keys, at, F.lit(None).cast(probes.schema["probe"].dataType).alias("probe"), F.lit(1).alias("one"))
    both = marks.unionByName(probes.select(*keys, at, "probe", F.lit(0).alias("one"))).withColumn("stretch", F.floor(F.col(at) / width))
    before = _offsets(both.groupBy(*keys, "stretch").agg(F.sum("one").alias("n")), keys)
    w = Window.partitionBy(*keys, "stretch").orderBy(at, F.desc("one")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = both.withColumn("_in", F.sum("one").over(w)).where("one = 0")
    return inside.join(before, [*keys, "stretch"]).select(*keys, "probe", at, (F.col("_in") + F.col("before")).alias("n"))


def around(rows: DataFrame, keys: list[str], span: int, at: str = "at", width: int = 6 * WIDTH) -> DataFrame:
    """id, n: how many rows of the keys lie within span seconds of each row (id, keys, at), itself included.

    n is what lies up to the later end less what lies before the earlier one. A row and both of its ends are marks of one
    table, so that a single ordered pass over a stretch counts both.
    """
    mark = lambda t, sign: F.struct(t.alias("t"), F.lit(sign).alias("sign"))
    marks = F.explode(F.array(mark(F.col(at), 0), mark(F.col(at) + span, 1), mark(F.col(at) - span - 1, -1)))
    x = rows.select("id", *keys, marks.alias("m")).select("id", *keys, "m.*").withColumn("stretch", F.floor(F.col("t") / width))
    one = F.when(F.col("sign") == 0, 1).otherwise(0)
    before = _offsets(x.groupBy(*keys, "stretch").agg(F.sum(one).alias("n")), keys)
    w = Window.partitionBy(*keys, "stretch").orderBy("t", F.abs("sign")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = x.withColumn("_in", F.sum(one).over(w)).where("sign <> 0").join(before, [*keys, "stretch"])
    return ends.groupBy("id").agg(F.sum(F.col("sign") * (F.col("_in") + F.col("before"))).alias("n"))


def previous(rows: DataFrame, keys: list[str], order: list[str], value: F.Column, at: str = "at", width: int = WIDTH) -> DataFrame:
    """rows with before: value of the row before along order within the keys, null for the first."""
    x = rows.withColumns({"stretch": F.floor(F.col(at) / width), "_value": value})
    ends = x.groupBy(*keys, "stretch").agg(F.max_by("_value", F.struct(*order)).alias("_last"))
    ends = ends.withColumn("_earlier", F.lag("_last").over(Window.partitionBy(*keys).orderBy("stretch"))).drop("_last")
    x = x.withColumn("_own", F.lag("_value").over(Window.partitionBy(*keys, "stretch").orderBy(*order)))
    return x.join(ends, [*keys, "stretch"]).withColumn("before", F.coalesce("_own", "_earlier")).drop("stretch", "_value", "_own", "_earlier")
