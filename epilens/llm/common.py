"""What the operators share: written intermediate tables, shipping, connected groups."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGE = Path(__file__).resolve().parents[1]
#: Rows of an Arrow batch at most: texts may be long, and tasks hold several copies of a batch.
BATCH_ROWS = 2_000
#: Bytes of an Arrow batch at most: index segments and sets of shingles are large rows.
BATCH_BYTES = 4 << 20
#: Rows up to which a table of ids may be broadcast (16 MB of longs); beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, unless it was sent before."""
    sc = spark.sparkContext
    name = f"{PACKAGE.name}.zip"
    if any(str(f).endswith(f"/{name}") for f in sc.listFiles):
        return
    path = os.path.join(tempfile.mkdtemp(), name)
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(PACKAGE.rglob("*.py")):
            z.write(f, f.relative_to(PACKAGE.parent))
    sc.addPyFile(path)


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a local master gets a temporary folder and any other
    master the warehouse folder, which is shared as well.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        return f"file://{tempfile.mkdtemp(prefix='epilens-')}"
    return spark.conf.get("spark.sql.warehouse.dir")


_scope: ContextVar[list | None] = ContextVar("scope", default=None)


@contextmanager
def intermediates() -> Iterator[None]:
    """Deletes, in the end, the scratch folders opened meanwhile: what was built from them has to be written by then."""
    opened: list[Scratch] = []
    token = _scope.set(opened)
    try:
        yield
    finally:
        _scope.reset(token)
        for scratch in opened:
            scratch.close()


class Scratch:
    """Tables written to the shared folder, removed when the JVM ends."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        # Frames run after this returns, so these stay set in the session; a user's lower values stay too.
        for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
            if not 0 < int(re.sub("[^0-9-].*", "", spark.conf.get(key))) <= most:
                spark.conf.set(key, most)
        self.path = f"{shared_root(spark).rstrip('/')}/epilens-{uuid.uuid4().hex}"
        ship(spark)
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(where)
        fs.deleteOnExit(where)
        self.path = str(fs.makeQualified(where))
        self._remove = lambda path: fs.delete(jvm.org.apache.hadoop.fs.Path(path), True)
        if (opened := _scope.get()) is not None:
            opened.append(self)

    def drop(self, *tables: DataFrame) -> None:
        """Deletes written tables that nothing is read from any more."""
        for t in tables:
            for path in {f.rpartition("/")[0] for f in t.inputFiles()}:
                if path.startswith(self.path):
                    self._remove(path)

    def close(self) -> None:
        """Deletes all tables: for intermediates of a result that has been written."""
        self._remove(self.path)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df and returns it as read back: its lineage ends here."""
        path = f"{self.path}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def row_key(docs: DataFrame) -> Column:
    """A hash of all of a row's columns: names a row where doc_id alone may repeat or be null. Maps, which have no hash, count as JSON."""
    return F.xxhash64(*[F.to_json(F.struct(f"`{c}`")) if "map<" in kind else F.col(f"`{c}`") for c, kind in docs.dtypes])


def unused(docs: DataFrame, name: str) -> str:
    """name, with as many underscores as it takes not to be a column of docs."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def keep_ids(df: DataFrame, ids: DataFrame, key: str | list[str], how: str = "left_semi") -> DataFrame:
    """Rows of df whose key is in ids; ids are broadcast only if they are few enough."""
    few = ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return df.join(F.broadcast(ids) if few else ids, key, how)


def connected(scratch: Scratch, edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable over the edges, for nodes with an edge.

    Alternating large-star and small-star rounds until no edge changes. A
    star's centre is found by a partial aggregate, so a node with many edges
    does not load one task; each round's edges are written.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = scratch.table(e, "edges")

    def state(x: DataFrame) -> tuple:
        return tuple(x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = state(e)
    while now[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        centre = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.where("v > u").join(centre, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        centre = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(centre, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(centre.select("u", F.col("m").alias("v")))
        e = scratch.table(small.where("u <> v").distinct(), "edges")
        then, now = now, state(e)
        if then == now:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
