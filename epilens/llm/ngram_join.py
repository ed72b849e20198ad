"""Jaccard self-join on word n-gram sets by rare-first prefix filtering.

Two documents link when percent-wise 100 |A and B| >= T |A or B|, for the sets
of distinct n-word shingles (lower-cased ASCII; a document of fewer words is
one shingle; none without words). Equal sets are one class, so copies are
never paired with each other.

1. One pass counts shingles in a fixed number of hash cells over all documents.
   Shingles are ordered by their cell's count, rare first, then by hash: the
   same total order in every document, which is all that exactness needs.
2. A set of n shingles posts its first n - ceil(T n / 100) + 1 of them. Two
   linked sets share a posted shingle. Lists with one set only are dropped.
3. In each list, every set and the list's lead become candidates. The lead is the
   set with the fewest rarer shingles before the shared one: among variants of a
   text, the one with the fewest changes. A candidate pair must pass the length
   filter, the positional filter (shingles before and after the shared one
   bound the overlap) and the suffix filter: a bitmap keeps the parity of the
   number of shingles in each of 256 hash cells, and each shingle that two sets
   don't share flips one bit, so the bits that differ bound the sets' distance
   from below. Each candidate pair is verified once, on the whole sets.
4. Verified links give components. What is left to find are links between
   components: for each list, rows outside its most frequent component are
   paired with rows of other components, filtered and verified as before.
   A pair has to be met at its first common shingle only, which bounds its
   overlap by what follows; so each row tells the sizes of sets that it may
   link with from there, and rows are joined on both sets' size classes.
   A list of n similar documents costs about n pairs rather than n squared,
   as do sets that share much but less than a link needs, and no link between
   components goes unseen. Left to the parity filter alone are lists whose sets
   share one rare shingle and then differ in shingles that are more frequent.

`similar_pairs` verifies all pairs of step 2's lists instead and returns them.

Cases: a document without words has no shingles and is its own component; rows
with doc_id null get no component and link nothing; rows that repeat a doc_id
are nodes of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from epilens.llm.common import BROADCAST_ROWS, Scratch, connected, keep_ids, row_key
from epilens.llm.textbytes import LOWER, NOT_SPACE, blocks, mix, release, sequence_hash, span_hash, words

#: Hash cells: 16 for each document within these powers of two; one byte each when broadcast.
CELL_BITS = (20, 22)
CHUNK_BITS = 14


def shingle_sets(raw: np.ndarray, bounds: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    low = LOWER[raw]
    starts, ends, at = words(low, bounds, NOT_SPACE)
    h = span_hash(low, starts, ends)
    grams = sequence_hash(h, width)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= width:
            yield np.unique(grams[a : b - width + 1])
        elif b > a:
            yield sequence_hash(h[a:b], b - a)
        else:
            yield np.zeros(0, np.uint64)


def signature(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit digests of a set."""
    with np.errstate(over="ignore"):
        a, b = mix(s).sum(dtype=np.uint64), mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def parity_bitmap(s: np.ndarray) -> list[int]:
    """256 bits as four longs: whether a hash cell has an odd number of the set's shingles."""
    odd = (np.bincount((s >> np.uint64(24)).astype(np.int64) & 255, minlength=256) & 1).astype(np.uint8)
    return np.packbits(odd).view("<i8").tolist()


_INFO = "doc_id long, row_key long, n int, sig long, sig2 long, bits array<long>, chunk int, counts binary"


def _describe(width: int, bits: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << bits, np.uint32)
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.binary()]
        names = [x.split()[0] for x in _INFO.split(", ")]

        for batch, raw, bounds in blocks(batches):
            rows = []
            for doc_id, key, s in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), shingle_sets(raw, bounds, width), strict=True):
                a, b = signature(s)
                rows.append((doc_id, key, len(s), a, b, parity_bitmap(s), None, None))
                np.add.at(cells, (s >> np.uint64(64 - bits)).astype(np.int64), np.uint32(1))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        for c, part in enumerate(cells.reshape(-1, 1 << CHUNK_BITS)):
            if part.any():
                row = (None, None, None, None, None, None, c, zlib.compress(part.tobytes(), 1))
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names)

    return run


def _add_counts(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(1 << CHUNK_BITS, np.uint64)
    for data in pdf["counts"]:
        total += np.frombuffer(zlib.decompress(data), np.uint32)
    total = np.minimum(total, np.uint64(2**32 - 1)).astype(np.uint32)
    return pd.DataFrame({"chunk": [int(pdf["chunk"].iloc[0])], "counts": [zlib.compress(total.tobytes(), 1)]})


def cell_ranks(parts: DataFrame, bits: int) -> np.ndarray:
    """One byte for each cell, rising with the logarithm of its count: at most 8 MB, whatever the input."""
    if parts.count() > 1 << 16:
        parts = parts.withColumn("salt", F.pmod(F.xxhash64("counts"), F.lit(64))).groupBy("chunk", "salt").applyInPandas(lambda pdf: _add_counts(pdf), "chunk int, counts binary")
    ranks = np.zeros(1 << bits, np.uint8)
    for r in parts.groupBy("chunk").applyInPandas(lambda pdf: _add_counts(pdf), "chunk int, counts binary").toLocalIterator():
        counts = np.frombuffer(zlib.decompress(r["counts"]), np.uint32)
        ranks[r["chunk"] << CHUNK_BITS : (r["chunk"] + 1) << CHUNK_BITS] = np.minimum(255, 8 * np.log2(counts + 1.0)).astype(np.uint8)
    return ranks


_POSTS = "token long, sig long, n int, pos int"


def _post(ranks, width: int, bits: int, percent: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, seen = ranks.value, set()
        for batch, raw, bounds in blocks(batches):
            tokens, sigs, sizes, places = [], [], [], []
            for s in shingle_sets(raw, bounds, width):
                n = len(s)
                if n * (100 - percent) < percent:  # so few that only equal sets link
                    continue
                sig = signature(s)
                if sig in seen:
                    continue
                seen.add(sig)
                p = n - (percent * n + 99) // 100 + 1
                r = rank[(s >> np.uint64(64 - bits)).astype(np.int64)]
                tokens.append(s[np.argsort(r, kind="stable")[:p]])
                sigs.append(np.full(p, sig[0], np.int64))
                sizes.append(np.full(p, n, np.int32))
                places.append(np.arange(p, dtype=np.int32))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).astype(np.int64)), pa.array(np.concatenate(sigs)), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(places))], ["token", "sig", "n", "pos"])

    return run


def _sets(width: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, bounds in blocks(batches):
            sets = [s.tobytes() for s in shingle_sets(raw, bounds, width)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["row_key", "hashes"])

    return run


def _verify(percent: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, inter, union = [], [], []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                inter.append(both)
                union.append(len(x) + len(y) - both)
                keep.append(100 * both >= percent * union[-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(inter, pa.int64()), pa.array(union, pa.int64())], ["a", "b", "both", "either"]).filter(pa.array(keep, pa.bool_()))
        release(kept=False)

    return run


class NgramJoin:
    """The steps on one table; each written table is reused by the later steps."""

    def __init__(self, spark: SparkSession, docs: DataFrame, width: int = 5, percent: int = 80):
        self.scratch, self.width, self.percent = Scratch(spark), width, percent
        self.docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), row_key(docs).alias("row_key"))
        bits = int(np.clip(np.log2(max(1, 16 * self.docs.count())).round(), *CELL_BITS))
        described = self.scratch.table(self.docs.mapInArrow(_describe(width, bits), _INFO), "described")
        self.info = described.where("n is not null").drop("chunk", "counts")
        ranks = cell_ranks(described.where("chunk is not null").select("chunk", "counts"), bits)
        classes = self.info.where("n > 0 and doc_id is not null").groupBy("sig", "sig2", "n").agg(F.min(F.struct("doc_id", "row_key")).alias("low"), F.first("bits").alias("bits"))
        # A class is represented by its row with the smallest doc_id.
        self.classes = self.scratch.table(classes.select("sig", "sig2", "n", F.col("low.row_key").alias("rep"), F.col("low.doc_id").alias("low"), "bits"), "classes")

        posts = self.docs.where("doc_id is not null").mapInArrow(_post(spark.sparkContext.broadcast(ranks), width, bits, percent), _POSTS)
        order = Window.partitionBy("token").orderBy("pos", "sig")
        posts = posts.withColumns({"lead": F.first(F.struct("sig", "n", "pos")).over(order), "after": F.lead("sig").over(order)})
        self.posts = self.scratch.table(posts.where("lead.sig <> sig or after <> sig").drop("after"), "posts")

    def _passes(self, n: str, pos: str, m: str, qos: str) -> F.Column:
        """Length and positional filters for sizes n and m and places pos and qos of a shared shingle."""
        t = self.percent
        length = f"100 * least({n}, {m}) >= {t} * greatest({n}, {m})"
        bound = f"1 + least({pos}, {qos}) + least({n} - {pos}, {m} - {qos}) - 1"
        return F.expr(f"{length} and {100 + t} * ({bound}) >= {t} * ({n} + {m})")

    def _alike(self, n: str, bits: str, m: str, mits: str) -> F.Column:
        """Suffix filter: bits that differ are at most the distance n + m - 2 overlap that a link allows."""
        t = self.percent
        differ = " + ".join(f"bit_count({bits}[{k}] ^ {mits}[{k}])" for k in range(4))
        return F.expr(f"({100 + t}) * ({differ}) <= ({100 - t}) * ({n} + {m})")

    def leads(self) -> DataFrame:
        """(a, b) signatures of candidates: the members of a list with its first set."""
        near = self.posts.where("lead.sig <> sig").where(self._passes("n", "pos", "lead.n", "lead.pos"))
        return near.select(F.least("sig", "lead.sig").alias("a"), F.greatest("sig", "lead.sig").alias("b")).distinct()

    def _sized(self, rows: DataFrame, n: str, pos: str) -> DataFrame:
        """rows with size, the class of their own size, and sizes, those of all sets that a set of size n may link with by its first common shingle at pos.

        Joined on both classes, sets of a list meet only if each allows the other's size.
        """
        t = self.percent
        klass = lambda x: f"cast(floor(ln({x}) / ln(1.1)) as int)"
        low, high = f"greatest(1, ceil({t} * {n} / 100))", f"least(floor(100 * {n} / {t}), floor(({100 + t} * ({n} - {pos}) - {t} * {n}) / {t}))"
        return rows.withColumns({"size": F.expr(klass(n)), "low": F.expr(low), "high": F.expr(high)}).where("low <= high").withColumn("sizes", F.expr(f"sequence({klass('low')}, {klass('high')})")).drop("low", "high")

    def across(self, components: DataFrame) -> DataFrame:
        """(a, b) signatures of all candidates that lie in different components."""
        of = self.classes.select("sig", "rep", "bits").join(components.select(F.col("node").alias("rep"), "component"), "rep", "left")
        of = of.select("sig", "bits", F.coalesce("component", "rep").alias("c"))
        rows = self.posts.select("token", "sig", "n", "pos").distinct().join(of, "sig")
        rows = self.scratch.table(rows.withColumn("prev", F.lag("token").over(Window.partitionBy("sig").orderBy("pos"))), "rows")
        counts = rows.groupBy("token", "c").agg(F.count("*").alias("k"))
        most = counts.groupBy("token").agg(F.max_by("c", F.struct("k", "c")).alias("most"), F.count("*").alias("cs")).where("cs > 1").drop("cs")
        rows = self.scratch.table(rows.join(most, "token"), "mixed")
        others = rows.where("c <> most").select("token", F.col("sig").alias("sig1"), F.col("n").alias("n1"), F.col("pos").alias("pos1"), F.col("c").alias("c1"), F.col("bits").alias("bits1"), F.col("prev").alias("prev1"))
        # A pair is met at its first common shingle: none before it is shared, so the shingles from it on bound the overlap.
        others = self._sized(others, "n1", "pos1").select("*", F.col("size").alias("size1"), F.explode("sizes").alias("size0")).drop("size", "sizes")
        rows = self._sized(rows, "n", "pos").select("*", F.col("size").alias("size0"), F.explode("sizes").alias("size1")).drop("size", "sizes")
        first = "prev is null or prev1 is null or prev <> prev1"
        t = self.percent
        bound = f"100 * least(n, n1) >= {t} * greatest(n, n1) and {100 + t} * least(n - pos, n1 - pos1) >= {t} * (n + n1)"
        met = others.join(rows, ["token", "size0", "size1"]).where("c <> c1").where(first).where(bound).where(self._alike("n", "bits", "n1", "bits1"))
        return met.select(F.least("sig", "sig1").alias("a"), F.greatest("sig", "sig1").alias("b")).distinct()

    def verified(self, pairs: DataFrame) -> DataFrame:
        """(a, b, both, either) of the pairs that link, by class representative."""
        side = lambda x: self.classes.select(F.col("sig").alias(x), F.col("rep").alias(f"{x}_rep"), F.col("n").alias(f"{x}_n"), F.col("bits").alias(f"{x}_bits"))
        met = pairs.join(side("a"), "a").join(side("b"), "b").where("a_rep <> b_rep")
        met = met.where(self._alike("a_n", "a_bits", "b_n", "b_bits")).select("a", "b", "a_rep", "b_rep")
        met = self.scratch.table(met, "candidates")
        ids = met.select(F.col("a_rep").alias("row_key")).union(met.select("b_rep")).distinct()
        ids = self.scratch.table(ids, "ids")
        sets = keep_ids(self.docs.select("row_key", "text"), ids, "row_key").mapInArrow(_sets(self.width), "row_key long, hashes binary")
        sets = self.scratch.table(sets, "sets").dropDuplicates(["row_key"])
        for x in "ab":
            met = met.join(sets.select(F.col("row_key").alias(f"{x}_rep"), F.col("hashes").alias(f"{x}_set")), f"{x}_rep")
        checked = met.select("a_rep", "b_rep", "a_set", "b_set").mapInArrow(_verify(self.percent), "a long, b long, both long, either long")
        return self.scratch.table(checked, "links")

    def components(self) -> DataFrame:
        """doc_id, n_shingles, component_id, row_key, stays (whether it is its component's row to keep) of every row."""
        first = self.scratch.table(self.leads(), "leads")
        links = self.verified(first).select("a", "b")
        parts = self.scratch.table(connected(self.scratch, links), "parts")
        rest = self.scratch.table(self.across(parts).join(first, ["a", "b"], "left_anti"), "rest")
        if not rest.isEmpty():
            more = self.verified(rest).select("a", "b")
            parts = self.scratch.table(connected(self.scratch, links.unionByName(more)), "parts")
        # The smallest doc_id of each component of several classes, and its row.
        ends = parts.withColumnRenamed("node", "rep").join(self.classes.select("rep", "low"), "rep").groupBy("component").agg(F.min(F.struct("low", "rep")).alias("end"))
        ends = self.scratch.table(ends.select("component", F.col("end.low").alias("component_id"), F.col("end.rep").alias("stays")), "ends")
        few = ends.count() <= BROADCAST_ROWS
        parts = parts.join(F.broadcast(ends) if few else ends, "component").drop("component")
        of = self.classes.join(parts.withColumnRenamed("node", "rep"), "rep", "left")
        of = of.select("sig", "sig2", "n", F.coalesce("component_id", "low").alias("component_id"), F.coalesce("stays", "rep").alias("stays"))
        out = self.info.join(of, ["sig", "sig2", "n"], "left")
        named = F.col("doc_id").isNotNull()
        return out.select(
            "doc_id",
            F.col("n").cast("long").alias("n_shingles"),
            F.when(named, F.coalesce("component_id", "doc_id")).alias("component_id"),
            "row_key",
            (~named | F.coalesce(F.col("stays") == F.col("row_key"), F.lit(True))).alias("stays"),
        )

    def pairs(self) -> DataFrame:
        """a, b, both, either: every linked pair of classes, by the smallest doc_id of each."""
        alone = self.classes.select(F.col("rep").alias("node"), F.col("rep").alias("component"))
        found = self.verified(self.across(alone))
        for x in "ab":
            found = found.withColumnRenamed(x, "rep").join(self.classes.select("rep", F.col("low").alias(x)), "rep").drop("rep")
        return found.select("a", "b", "both", "either")

    def membership(self) -> DataFrame:
        """doc_id, representative of every row with words."""
        return self.info.join(self.classes.drop("bits"), ["sig", "sig2", "n"]).select("doc_id", F.col("low").alias("representative"))


def ngram_components(spark: SparkSession, docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    return NgramJoin(spark, docs, width, percent).components()


def similar_pairs(spark: SparkSession, docs: DataFrame, width: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """All linked pairs of class representatives, and each document's representative."""
    join = NgramJoin(spark, docs, width, percent)
    return join.pairs(), join.membership()
