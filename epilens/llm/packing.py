"""Best-fit packing of token sequences by hierarchical residual packing.

A task encodes its rows, cuts documents longer than a sequence, and packs its
pieces by best-fit decreasing. Bins within `near` tokens of full are done.
The others become items themselves: they are dealt into groups of about
`GROUP` bins, each group is packed best-fit decreasing, and so on up a tree of
ever fewer bins until one group is left or a round joins hardly any (bins that
are all more than half full can't be joined). Bins name their members by
(bin, offset) steps, which are joined at the end.

Cases: null text is empty and packs its end id alone; repeated rows and rows
without doc_id are packed each for itself; an empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epilens.llm.common import Scratch
from epilens.llm.textbytes import blocks
from epilens.llm.tokens import BLOCK, PartEncoder

GROUP = 20_000


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item by best-fit decreasing; sizes lie in 1 to capacity.

    Open bins are stacked by free room; a bit for each room that has a bin
    makes the tightest fit one shift away.
    """
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = opened = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        above = rooms >> size
        if above:
            room = size + (above & -above).bit_length() - 1
            b = stacks[room].pop()
            if not stacks[room]:
                rooms ^= 1 << room
        else:
            room, b = capacity, opened
            opened += 1
        bins[i], offsets[i] = b, capacity - room
        left = room - size
        stacks[left].append(b)
        rooms |= 1 << left if left else 0
    return bins, offsets


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: all of full length but perhaps the first."""
    first = (n - 1) % capacity + 1
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, at long"


def _encode_and_pack(vocabulary: str, end_id: int, capacity: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PartEncoder.of(vocabulary)
        doc, piece, start, length, crc = [], [], [], [], []
        for batch, raw, bounds in blocks(batches, limit=BLOCK, keep=True):
            ids, at = encoder.encode(raw, bounds)
            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                own = np.append(ids[at[i] : at[i + 1]], np.uint32(end_id)).astype("<u4")
                for k, (s, n) in enumerate(cut(len(own), capacity)):
                    doc.append(doc_id), piece.append(k), start.append(s), length.append(n)
                    crc.append(zlib.crc32(own[s : s + n]))
        bins, offsets = best_fit(np.array(length, np.int64), capacity)
        bins = bins + (TaskContext.get().partitionId() << 33)
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        columns = [doc, piece, start, length, crc, bins, offsets]
        for i in range(0, len(doc), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 10_000], k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in _PIECES.split(", ")])

    return run


def _merge(capacity: int, level: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin", ignore_index=True)
        bins, offsets = best_fit(pdf["fill"].to_numpy(), capacity)
        return pd.DataFrame({"bin": pdf["bin"], "up": bins + ((level << 56) + (int(pdf["part"].iloc[0]) << 32)), "by": offsets, "fill": pdf["fill"]})

    return run


def pack(spark: SparkSession, docs: DataFrame, vocabulary: str, end_id: int = 0, capacity: int = 2048, near: int = 2, group: int = GROUP) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every row."""
    scratch = Scratch(spark)
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    pieces = scratch.table(source.mapInArrow(_encode_and_pack(vocabulary, end_id, capacity), _PIECES), "pieces")
    bins = pieces.groupBy("bin").agg(F.sum("length").alias("fill"))
    low = scratch.table(bins.where(F.col("fill") < capacity - near), "low")
    steps, level = None, 0
    n = low.count()
    while n > 1:
        level += 1
        parts = math.ceil(n / group)
        dealt = low.withColumn("part", F.pmod(F.xxhash64("bin"), F.lit(parts)))
        up = scratch.table(dealt.groupBy("part").applyInPandas(_merge(capacity, level), "bin long, up long, by long, fill long"), "up")
        if steps is None:
            steps = up.select("bin", "up", "by")
        else:
            more = up.select(F.col("bin").alias("up"), F.col("up").alias("up2"), F.col("by").alias("by2"))
            steps = steps.join(more, "up", "left").select("bin", F.coalesce("up2", "up").alias("up"), (F.col("by") + F.coalesce("by2", F.lit(0))).alias("by"))
        low = up.groupBy(F.col("up").alias("bin")).agg(F.sum("fill").alias("fill")).where(F.col("fill") < capacity - near)
        low = scratch.table(low, "low")
        before, n = n, low.count()
        if parts == 1 or n > 0.98 * before:
            break
    if steps is not None:
        pieces = pieces.join(scratch.table(steps, "steps"), "bin", "left")
        sequence, offset = F.coalesce("up", "bin"), F.col("at") + F.coalesce("by", F.lit(0))
    else:
        sequence, offset = F.col("bin"), F.col("at")
    return pieces.select("doc_id", "piece", "start", "length", "ids_crc32", sequence.alias("sequence_id"), offset.alias("offset"))
