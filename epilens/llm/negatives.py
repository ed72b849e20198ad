"""Hard negatives by a pivot table.

A vector x gets one more component, sqrt(M^2 - |x|^2) with M the largest norm,
and an anchor q a zero: then |q - x|^2 = |q|^2 + M^2 - 2 q.x, so the largest
inner products are the smallest Euclidean distances. The table stores the
distances of every row to a few pivots, taken farthest first from a bounded
sample. For an anchor and a pivot at distances d and e from it, the triangle
inequality puts the distance of anchor and row between |d - e| and d + e, and
so brackets their score without the row's vector.

The rows lie in blocks of one label and one nearest pivot, ordered by the
distance to it; a block keeps the least and the largest distance to each pivot.
A search goes from the bracket of a block, for which whole blocks drop out, to
those of its rows, and computes exact integer scores for the rows that are left.
Nothing drops out but what can't be in the result: pivots decide the cost only.

Anchors are taken in blocks of bounded size; each goes over all rows, once for
the positives and once for the negatives.

Cases: rows with a null label, a null vector, or a null or non-finite component
take no part; vectors of different lengths are filled up with zeros; a null
vec_id is no anchor and comes last among equal scores; rows that repeat a vec_id
are rows of their own (such an anchor has one list for each of them); an anchor
without positives, or a positive without negatives, has no rows; empty tables
give none; other columns are ignored. Scores are exact up to 2^63.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from epilens.llm.common import Scratch

PIVOTS = 16
#: Rows from which the pivots are taken, by a hash of the row.
PIVOT_SAMPLE = 2_000
#: Bytes of anchors' vectors that a search takes at a time.
ANCHOR_BLOCK = 8 << 20
#: Rows of a block.
BLOCK = 512
# A block's exact scores are one matrix product where so large a share of the pairs is left.
_MANY = 0.05
# Searches that meet a block's rows at a time.
_WANTS = 1024

_NO_ID = np.iinfo(np.int64).max


def scaled(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, label, v: the rows that take part, with components floor(scale * x)."""
    v = F.transform("embedding", lambda x: F.floor(scale * x.cast("double")))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return vectors.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite).select(F.col("vec_id").cast("long"), F.col("label").cast("long"), v.alias("v"))


def matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    """The rows' vectors, filled up with zeros."""
    n = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(n), dims), np.int64)
    out[np.arange(dims) < n[:, None]] = column.flatten().to_numpy()
    return out


class Pivots:
    """Pivots in the space with one component more; distances are doubles."""

    def __init__(self, rows: np.ndarray, largest: float, count: int):
        """rows: the sample; largest: the largest squared norm of all rows."""
        self.largest = largest
        self.points = np.zeros((0, rows.shape[1] + 1))
        points = self.lifted(rows)
        if len(points):
            chosen = [0]
            far = ((points - points[0]) ** 2).sum(axis=1)
            while len(chosen) < min(count, len(points)) and far.max() > 0:
                chosen.append(int(far.argmax()))
                far = np.minimum(far, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
            self.points = points[chosen]

    def lifted(self, rows: np.ndarray) -> np.ndarray:
        x = rows.astype(np.float64)
        return np.column_stack([x, np.sqrt(np.maximum(0, self.largest - (x * x).sum(axis=1)))])

    def distances(self, points: np.ndarray) -> np.ndarray:
        return np.stack([np.sqrt(((points - p) ** 2).sum(axis=1)) for p in self.points], axis=1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of a and of b."""
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64) if bound < 1 << 53 else a @ b.T


def _measured(pivots, dims: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p: Pivots = pivots.value
        for batch in batches:
            d = p.distances(p.lifted(matrix(batch.column(2), dims)))
            near = d.argmin(axis=1) if d.size else np.zeros(len(d), np.int64)
            lists = pa.ListArray.from_arrays(np.arange(len(d) + 1, dtype=np.int32) * d.shape[1], pa.array(d.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), lists, pa.array(near, pa.int32()), pa.array(d.min(axis=1, initial=np.inf))], ["vec_id", "label", "v", "d", "pivot", "near"])

    return run


def _blocked(dims: int):
    """Rows in order of label, pivot and distance become blocks, with their brackets."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, pivot = batch.column(1).to_numpy(), batch.column(4).to_numpy()
            d = batch.column(3).flatten().to_numpy().reshape(batch.num_rows, -1)
            x = matrix(batch.column(2), dims)
            ids = batch.column(0).fill_null(_NO_ID).to_numpy()
            cuts = np.flatnonzero((np.diff(label) != 0) | (np.diff(pivot) != 0)) + 1
            for part in np.split(np.arange(batch.num_rows), cuts):
                for s in range(0, len(part), BLOCK):
                    rows = part[s : s + BLOCK]
                    cells = [int(label[rows[0]]), ids[rows].tolist(), x[rows].tobytes(), d[rows].tobytes(), d[rows].min(axis=0).tobytes(), d[rows].max(axis=0).tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array([c], kind) for c, kind in zip(cells, [pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 4], strict=True)], ["label", "ids", "v", "d", "low", "high"])

    return run


class PivotTable:
    """The rows of a table in blocks with their pivot distances, in the shared folder; serves any number of searches."""

    def __init__(self, spark: SparkSession, rows: DataFrame, pivots: int = PIVOTS):
        """rows: vec_id, label, v, as by scaled()."""
        self.spark, self.scratch = spark, Scratch(spark)
        rows = self.scratch.table(rows, "vectors")
        norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
        self.dims, largest = rows.agg(F.max(F.size("v")), F.max(norm)).first()
        self.dims = self.dims or 0
        order = [F.xxhash64("vec_id", "v"), "vec_id", "v"]
        sample = [r.v for r in rows.orderBy(*order).select("v").limit(PIVOT_SAMPLE).toLocalIterator()]
        self.pivots = Pivots(np.array([v + [0] * (self.dims - len(v)) for v in sample], np.int64).reshape(len(sample), self.dims), largest or 0.0, pivots)
        measured = rows.mapInArrow(_measured(spark.sparkContext.broadcast(self.pivots), self.dims), "vec_id long, label long, v array<long>, d array<double>, pivot int, near double")
        placed = measured.repartitionByRange("label", "pivot", "near", "vec_id").sortWithinPartitions("label", "pivot", "near", "vec_id")
        blocks = placed.mapInArrow(_blocked(self.dims), "label long, ids array<long>, v binary, d binary, low binary, high binary")
        # A block's number tells its rows from others with the same vec_id.
        self.blocks = self.scratch.table(blocks.withColumn("block", F.monotonically_increasing_id()), "blocks")

    def negatives(self, every: int, positives: int, negatives: int, low: int, high: int) -> DataFrame:
        """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each row whose vec_id is divisible
        by `every` and each of its first `positives` rows of the same label, the first `negatives` rows of other labels
        that score between low and high percent of the positive."""
        at = F.posexplode("ids").alias("place", "vec_id")
        anchors = self.blocks.select("block", "label", "v", at).where((F.col("vec_id") % every == 0) & (F.col("vec_id") != _NO_ID))
        anchors = self.scratch.table(anchors.withColumn("v", F.expr(f"substring(v, place * {8 * self.dims} + 1, {8 * self.dims})")), "anchors")
        n = max(1, math.ceil(anchors.count() * 8 * max(1, self.dims) / ANCHOR_BLOCK))
        found = None
        for k in range(n):
            block = anchors.where(F.pmod(F.xxhash64("block", "place"), F.lit(n)) == k) if n > 1 else anchors
            part = self._block(Anchors([tuple(r) for r in block.select("block", "place", "vec_id", "label", "v").toLocalIterator()], self), positives, negatives, low, high)
            found = part if found is None else found.unionByName(part)
        return found

    def _block(self, anchors: Anchors, positives: int, negatives: int, low: int, high: int) -> DataFrame:
        sc, kinds = self.spark.sparkContext, "want long, vec_id long, score long, block long, place long"
        asked = Wants.same_label(anchors, positives)
        best = _firsts(self.blocks.mapInArrow(_search(sc.broadcast(anchors), sc.broadcast(asked)), kinds), positives)
        found = [tuple(r) for r in best.select("want", "vec_id", "score").toLocalIterator()]
        asked = Wants.between(found, negatives, low, high)
        best = _firsts(self.blocks.mapInArrow(_search(sc.broadcast(anchors), sc.broadcast(asked)), kinds), negatives)
        pairs = self.spark.createDataFrame([(k, anchors.ids[a], None if i == _NO_ID else i, s) for k, (a, i, s) in enumerate(found)], "want long, anchor_id long, positive_id long, positive_score long")
        negative = F.when(F.col("vec_id") != _NO_ID, F.col("vec_id"))
        return best.join(pairs, "want").select("anchor_id", "positive_id", "rank", negative.alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _firsts(rows: DataFrame, n: int) -> DataFrame:
    order = Window.partitionBy("want").orderBy(F.desc("score"), "vec_id", "block", "place")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


class Anchors:
    """A block of anchors: their rows, vectors, norms and pivot distances."""

    def __init__(self, rows: list[tuple], table: PivotTable):
        rows = sorted(rows, key=lambda r: r[:2])
        self.dims, self.largest = table.dims, table.pivots.largest
        self.block, self.place = (np.array([r[k] for r in rows], np.int64) for k in (0, 1))
        self.ids, self.labels = [r[2] for r in rows], np.array([r[3] for r in rows], np.int64)
        self.v = np.frombuffer(b"".join(bytes(r[4]) for r in rows), np.int64).reshape(len(rows), table.dims)
        x = self.v.astype(np.float64)
        self.norms = (x * x).sum(axis=1)
        self.d = table.pivots.distances(np.column_stack([x, np.zeros(len(x))])) if len(table.pivots.points) else np.zeros((len(x), 0))
        # Distances are rounded: brackets are widened by more than that, in units of the score.
        self.slack = 1 + 1e-9 * (self.norms.max(initial=0) + self.largest)


class Wants:
    """What is searched: for a row's anchor, the `n` best scores from low to high, of its own label or of others."""

    def __init__(self, anchor: list[int], low: list[int], high: list[int], n: int, same: bool):
        self.anchor, self.low, self.high, self.n, self.same = np.array(anchor, np.int64), np.array(low, np.int64), np.array(high, np.int64), n, same

    @classmethod
    def same_label(cls, anchors: Anchors, n: int) -> Wants:
        most = np.iinfo(np.int64).max
        return cls(list(range(len(anchors.ids))), [-most] * len(anchors.ids), [most] * len(anchors.ids), n, True)

    @classmethod
    def between(cls, found: list[tuple[int, int, int]], n: int, low: int, high: int) -> Wants:
        """low and high percent of a positive's score, both included."""
        return cls([a for a, _, _ in found], [-(-low * s // 100) for _, _, s in found], [high * s // 100 for _, _, s in found], n, False)


def _brackets(near: np.ndarray, far: np.ndarray, rest: float | np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest score for distances of at least `near` and at most `far`."""
    return (rest - far * far) / 2 - slack, (rest - near * near) / 2 + slack


def _search(anchors, wants):
    """The best rows of each want over a task's blocks."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, w = anchors.value, wants.value
        kept: dict[int, np.ndarray] = {}  # want: rows of score, vec_id, block, place, best first
        floor = w.low.copy()  # below it a score isn't among the best
        rest = a.norms + a.largest
        for batch in batches:
            lows, highs = ([np.frombuffer(x, np.float64) for x in batch.column(batch.schema.get_field_index(c)).to_pylist()] for c in ("low", "high"))
            labels = batch.column(batch.schema.get_field_index("label")).to_numpy()
            for k in range(batch.num_rows):
                # One label's anchors meet a block, or all others do.
                mine = np.flatnonzero((a.labels[w.anchor] == labels[k]) == w.same)
                who = w.anchor[mine]
                d, low, high = a.d[who], lows[k], highs[k]
                least, most = _brackets(np.maximum(0, np.maximum(d - high, low - d)).max(axis=1, initial=0), (d + high).min(axis=1, initial=np.inf), rest[who], a.slack)
                mine = mine[(most >= floor[mine]) & (least <= w.high[mine])]
                if not len(mine):
                    continue
                r = {c: batch.column(batch.schema.get_field_index(c))[k].as_py() for c in ("ids", "v", "d", "block")}
                ids = np.array(r["ids"], np.int64)
                rows, e = np.frombuffer(r["v"], np.int64).reshape(len(ids), a.dims), np.frombuffer(r["d"], np.float64).reshape(len(ids), -1)
                for c in range(0, len(mine), _WANTS):
                    for want, new in _survivors(a, w, mine[c : c + _WANTS], floor, r["block"], ids, rows, e):
                        new = np.concatenate([kept[want], new]) if want in kept else new
                        kept[want] = new[np.lexsort((new[:, 3], new[:, 2], new[:, 1], -new[:, 0]))[: w.n]]
                        if len(kept[want]) == w.n:
                            floor[want] = kept[want][-1, 0]
        for want, x in kept.items():
            yield pa.RecordBatch.from_arrays([pa.array([want] * len(x), pa.int64()), pa.array(x[:, 1]), pa.array(x[:, 0]), pa.array(x[:, 2]), pa.array(x[:, 3])], ["want", "vec_id", "score", "block", "place"])

    return run


def _survivors(a: Anchors, w: Wants, mine: np.ndarray, floor: np.ndarray, block: int, ids: np.ndarray, rows: np.ndarray, e: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Of the wants `mine`, those that have rows in a block: the rows' scores, ids and places, after exact checks."""
    who, which = np.unique(w.anchor[mine], return_inverse=True)
    low, high = floor[mine][:, None], w.high[mine][:, None]
    near, far = np.zeros((len(who), len(ids))), np.full((len(who), len(ids)), np.inf)
    for p in range(e.shape[1]):
        x, y = a.d[who, p][:, None], e[:, p]
        np.maximum(near, np.abs(x - y), out=near)
        np.minimum(far, x + y, out=far)
    least, most = _brackets(near, far, (a.norms[who] + a.largest)[:, None], a.slack)
    left = (most[which] >= low) & (least[which] <= high)
    own = np.flatnonzero(a.block[w.anchor[mine]] == block)
    left[own, a.place[w.anchor[mine[own]]]] = False
    if left.mean() >= _MANY:
        score = products(a.v[who], rows)[which]
        at, row = np.nonzero(left & (score >= low) & (score <= high))
        score = score[at, row]
    else:
        at, row = np.nonzero(left)
        pair, back = np.unique(which[at] * len(ids) + row, return_inverse=True)
        score = _pairs(a.v[who], rows, pair)[back]
        good = (score >= low[at, 0]) & (score <= high[at, 0])
        at, row, score = at[good], row[good], score[good]
    if len(at):
        used, begin = np.unique(at, return_index=True)
        for want, x in zip(mine[used].tolist(), np.split(np.arange(len(at)), begin[1:]), strict=True):
            yield want, np.stack([score[x], ids[row[x]], np.full(len(x), block), row[x]], axis=1)


def _pairs(a: np.ndarray, b: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """The exact inner products of some pairs of a row of a and one of b, given as place in a * len(b) + place in b."""
    out = np.empty(len(pair), np.int64)
    for s in range(0, len(pair), 8192):
        i, j = np.divmod(pair[s : s + 8192], len(b))
        out[s : s + 8192] = (a[i] * b[j]).sum(axis=1)
    return out


def hard_negatives(spark: SparkSession, vectors: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, pivots: int = PIVOTS) -> DataFrame:
    """vectors: vec_id, label, embedding; see PivotTable.negatives."""
    return PivotTable(spark, scaled(vectors), pivots).negatives(every, positives, negatives, low, high)
