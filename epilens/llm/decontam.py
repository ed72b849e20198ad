"""Benchmark decontamination over a distributed positional inverted index.

The training documents are indexed in segments of about 1 MB of text, spread
over the tasks and stored in the shared folder: the sorted distinct terms of a
segment (as 64-bit word hashes), and for each term the ascending word
positions. A benchmark item has one window for each 13 consecutive words, or
one of all its words if they are fewer. For each window, a segment that has
all its terms starts from the posting list of the rarest, shifts it by the
term's place in the window, and intersects it with the shifted lists of the
next rarest until none is left: what remains are exact phrase matches.
A document is near a window if three quarters of the window's distinct terms
occur in it within `slop` words.

Words are compared by 64-bit hashes; a wrong phrase match needs a collision
in each differing word.

The benchmark is taken in blocks of bounded size, each broadcast and run over
the whole index, so it may be as large as it likes; the windows of all blocks
are joined by document.

Cases: null or empty text has no words and is never contaminated; items
without words match nothing; item_ids that repeat count once; a null item_id
is an item that the digest of ids leaves out; rows with equal
or null doc_id stay apart by row; a document longer than a segment is a
segment of its own.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epilens.llm.common import Scratch, row_key
from epilens.llm.textbytes import ALNUM, LOWER, blocks, release, span_hash, words

WINDOW = 13
BENCHMARK_BLOCK = 2 << 20
# Nearness counts this many windows as one group, this many groups at a time, and keeps this many bytes of marks at most.
_PER_GROUP, _GROUPS, _MARKS = 16, 512, 16 << 20
# A term in more than this share of the stretches is counted only where rare terms can't decide; results don't depend on it.
_OFTEN = 0.1

_SEGMENT = "rows binary, doc_ids array<long>, row_keys array<long>, bounds array<long>, terms binary, counts binary, gaps binary"


def term_hashes(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all rows, and the n + 1 word bounds of the rows."""
    low = LOWER[raw]
    starts, ends, at = words(low, bounds, ALNUM)
    return span_hash(low, starts, ends), at


def _planes(x: np.ndarray) -> bytes:
    """uint32 values, byte planes apart (the high ones are mostly zero), compressed."""
    return zlib.compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _unplanes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _index(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    row = TaskContext.get().partitionId() << 33
    for batch, raw, bounds in blocks(batches):
        h, at = term_hashes(raw, bounds)
        order = np.argsort(h, kind="stable")
        terms, first, counts = np.unique(h[order], return_index=True, return_counts=True)
        gaps = np.diff(order, prepend=0)
        gaps[first] = order[first]
        rows = np.arange(row, row + batch.num_rows, dtype="<i8")
        row += batch.num_rows
        yield pa.RecordBatch.from_arrays(
            [pa.array([rows.tobytes()], pa.binary()), pa.array([batch.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([batch.column(2).to_pylist()], pa.list_(pa.int64())), pa.array([at.tolist()], pa.list_(pa.int64())), pa.array([terms.tobytes()], pa.binary()), pa.array([_planes(counts)], pa.binary()), pa.array([_planes(gaps)], pa.binary())],
            ["rows", "doc_ids", "row_keys", "bounds", "terms", "counts", "gaps"],
        )


def build_index(docs: DataFrame) -> DataFrame:
    """One row per segment: the documents, their word bounds, terms and position gaps."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), row_key(docs).alias("row_key")).mapInArrow(_index, _SEGMENT)


class Queries:
    """Windows of a block of items, as places in a sorted list of distinct terms."""

    def __init__(self, items: list[tuple[int | None, str | None]], width: int = WINDOW):
        texts = pa.array([t for _, t in items], pa.large_string())
        from epilens.llm.textbytes import utf8

        h, at = term_hashes(*utf8(texts))
        self.terms, places = np.unique(h, return_inverse=True)
        rows, lens, owners = [], [], []
        for (item, _), a, b in zip(items, at[:-1], at[1:], strict=True):
            n = min(width, b - a)
            for s in range(a, b - n + 1) if n else ():
                rows.append(np.pad(places[s : s + n], (0, width - n), mode="edge"))
                lens.append(n)
                owners.append(item)
        self.windows = np.array(rows, np.int64).reshape(-1, width)
        self.lens, self.owners = np.array(lens, np.int64), np.array(owners, object)
        # The first place of each distinct term, and how many of these make a place near.
        self.first = np.array([[k == row.index(t) for k, t in enumerate(row)] for row in self.windows.tolist()], bool).reshape(-1, width)
        distinct = self.first.sum(axis=1)
        self.need = distinct - distinct // 4
        # Up to _PER_GROUP consecutive windows of one item are one group.
        self.groups = np.array([0], np.int64)
        for item in np.split(np.arange(len(owners)), [i for i in range(1, len(owners)) if owners[i] != owners[i - 1]]):
            self.groups = np.append(self.groups, [*item[_PER_GROUP::_PER_GROUP], *(item[-1:] + 1)])


class Segment:
    def __init__(self, terms: bytes, counts: bytes, gaps: bytes):
        self.terms = np.frombuffer(terms, np.uint64)
        self.counts = _unplanes(counts)
        self.ends = np.cumsum(self.counts)
        self.starts = self.ends - self.counts
        total = np.cumsum(_unplanes(gaps))
        # gaps restart at each term: take off what was summed before it
        base = np.concatenate(([0], total))[self.starts]
        self.positions = total - np.repeat(base, self.counts)

    def places(self, terms: np.ndarray) -> np.ndarray:
        """The place of each term here, -1 if it is absent."""
        if not len(self.terms):
            return np.full(len(terms), -1)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def postings(self, place: int) -> np.ndarray:
        return self.positions[self.starts[place] : self.ends[place]]


def _member(values: np.ndarray, sorted_in: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(sorted_in, values), len(sorted_in) - 1)
    return sorted_in[at] == values


def phrase_starts(segment: Segment, places: np.ndarray, n: int) -> np.ndarray:
    """Where the n terms stand one after the other."""
    rarest = np.argsort(segment.counts[places[:n]], kind="stable").tolist()
    starts = segment.postings(places[rarest[0]]) - rarest[0]
    for k in rarest[1:]:
        starts = starts[_member(starts + k, segment.postings(places[k]))]
        if not len(starts):
            break
    return starts


class Nearness:
    """Where windows' terms stand close together in a segment.

    A document is cut into stretches of `slop` words; `need` distinct terms of a
    window within slop words lie in two neighbouring stretches. Stretches are
    counted against groups of windows first, then against the windows of the
    groups with enough terms, and what is left is checked word by word.
    """

    def __init__(self, q: Queries, segment: Segment, bounds: np.ndarray, slop: int):
        self.q, self.bounds, self.slop = q, bounds, slop
        at = segment.places(q.terms)
        self.here = np.flatnonzero(at >= 0)
        local = np.full(len(q.terms) + 1, len(self.here))
        local[self.here] = np.arange(len(self.here))
        # Terms as places among those that occur here; one more place stands for all that don't.
        self.windows = np.where(q.first, local[q.windows], len(self.here))
        self.kind = np.full(int(bounds[-1]), -1, np.int32)
        for k, place in enumerate(at[self.here].tolist()):
            self.kind[segment.postings(place)] = k
        self.spans = -(-np.diff(bounds) // slop) + 1  # an empty stretch parts the documents
        self.begin = np.concatenate(([0], np.cumsum(self.spans)))

    def found(self) -> Iterator[tuple[int, int]]:
        """(document, owner) pairs, each once."""
        known: set[tuple[int, int | None]] = set()
        position = np.flatnonzero(self.kind >= 0)
        doc = np.searchsorted(self.bounds, position, "right") - 1
        stretch = self.begin[doc] + (position - self.bounds[doc]) // self.slop
        total, width = int(self.begin[-1]), len(self.here) + 1
        step = max(64, _MARKS // width)
        for low in range(0, total, step):
            high = min(total, low + step + 1)
            a, b = np.searchsorted(stretch, (low, high))
            rows, terms = np.divmod(np.unique((stretch[a:b] - low) * width + self.kind[position[a:b]]), width)
            seen = np.zeros((high - low, width), bool)
            seen[rows, terms] = True
            often = np.bincount(terms, minlength=width) > _OFTEN * (high - low)
            plain = np.minimum.reduceat(self.q.need, self.q.groups[:-1])
            rare = np.minimum.reduceat(self.q.need - often[self.windows].sum(axis=1), self.q.groups[:-1])
            # Groups that need several rare terms are counted on these alone; the others on all terms.
            single = ~often[terms]
            yield from self._count(np.flatnonzero(rare >= 3), rare, rows[single], terms[single], seen, low, known)
            yield from self._count(np.flatnonzero(rare < 3), plain, rows, terms, seen, low, known)

    def _count(self, groups: np.ndarray, least: np.ndarray, rows: np.ndarray, terms: np.ndarray, seen: np.ndarray, low: int, known: set) -> Iterator[tuple[int, int]]:
        if not len(rows):
            return
        used, first = np.unique(rows, return_index=True)
        begin, end = self.q.groups[groups], self.q.groups[groups + 1]
        for g in range(0, len(groups), _GROUPS):
            a, b = begin[g : g + _GROUPS], end[g : g + _GROUPS]
            # A stretch has at most slop words, so several counts add up in one 64-bit word.
            kind = np.uint8 if self.slop < 128 else np.uint32
            holds = np.zeros((seen.shape[1], -(-len(a) // 8) * 8), kind)
            for k in range(_PER_GROUP):
                holds[self.windows[np.minimum(a + k, b - 1)], np.arange(len(a))[:, None]] = 1
            counts = np.zeros((len(seen) + 1, holds.shape[1]), kind)
            counts[used] = np.add.reduceat(holds.view(np.uint64)[terms], first, axis=0).view(kind)
            counts = counts[:, : len(a)]
            flat = np.flatnonzero(counts[:-1] + counts[1:] >= least[groups[g : g + _GROUPS]].astype(kind))
            pair, group = np.divmod(flat, len(a))
            step = min(4096, max(64, _MARKS // seen.shape[1]))
            for c in range(0, len(pair), step):
                part = group[c : c + step]
                yield from self._check(pair[c : c + step], a[part], b[part], seen, low, known)

    def _check(self, pair: np.ndarray, first: np.ndarray, end: np.ndarray, seen: np.ndarray, low: int, known: set) -> Iterator[tuple[int, int]]:
        q = self.q
        window = first[:, None] + np.arange(_PER_GROUP)
        real = window < end[:, None]
        window = np.minimum(window, end[:, None] - 1)
        both = seen[pair] | seen[np.minimum(pair + 1, len(seen) - 1)]
        enough = np.take_along_axis(both, self.windows[window].reshape(len(pair), -1), 1).reshape(*window.shape, -1).sum(axis=2) >= q.need[window]
        row, k = np.nonzero(enough & real)
        pair, window = pair[row] + low, window[row, k]
        doc = np.searchsorted(self.begin, pair, "right") - 1
        start = self.bounds[doc] + (pair - self.begin[doc]) * self.slop
        place = start[:, None] + np.arange(2 * self.slop)
        inside = place < self.bounds[doc + 1][:, None]
        words = np.where(inside, self.kind[np.minimum(place, len(self.kind) - 1)], -1)
        for c in range(0, len(pair), 512):
            w = window[c : c + 512]
            hit = words[c : c + 512, :, None] == self.windows[w][:, None, :]
            total = np.concatenate([np.zeros((len(w), 1, hit.shape[2]), np.int16), hit.cumsum(axis=1, dtype=np.int16)], axis=1)
            within = (total[:, self.slop + 1 :] > total[:, : self.slop]).sum(axis=2)
            for i in np.flatnonzero((within >= q.need[w][:, None]).any(axis=1)).tolist():
                key = (int(doc[c + i]), q.owners[w[i]])
                if key not in known:
                    known.add(key)
                    yield key


_HITS = "row long, doc_id long, row_key long, n_words long, runs array<struct<s:long,e:long>>, items array<long>, near array<long>"


def _search(queries, slop: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q: Queries = queries.value
        for batch in batches:
            for r in batch.to_pylist():
                bounds = np.array(r["bounds"], np.int64)
                segment = Segment(r["terms"], r["counts"], r["gaps"])
                runs, items, close = defaultdict(list), defaultdict(set), defaultdict(set)
                n_docs = len(r["doc_ids"])
                if len(q.windows):
                    here = segment.places(q.terms)[q.windows]
                    for w in np.flatnonzero((here >= 0).all(axis=1)).tolist():
                        n = int(q.lens[w])
                        found = phrase_starts(segment, here[w], n)
                        doc = np.searchsorted(bounds, found, "right") - 1
                        inside = found + n <= bounds[doc + 1]
                        for d, s in zip(doc[inside].tolist(), found[inside].tolist(), strict=True):
                            runs[d].append((s - bounds[d], s - bounds[d] + n))
                            items[d].add(q.owners[w])
                    for d, owner in Nearness(q, segment, bounds, slop).found():
                        close[d].add(owner)
                joined = [_union(runs.get(d, [])) for d in range(n_docs)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.frombuffer(r["rows"], "<i8"), pa.int64()),
                        pa.array(r["doc_ids"], pa.int64()),
                        pa.array(r["row_keys"], pa.int64()),
                        pa.array(np.diff(bounds), pa.int64()),
                        pa.array([[{"s": s, "e": e} for s, e in x] for x in joined], pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))),
                        pa.array([sorted(items.get(d, ()), key=_null_last) for d in range(n_docs)], pa.list_(pa.int64())),
                        pa.array([sorted(close.get(d, ()), key=_null_last) for d in range(n_docs)], pa.list_(pa.int64())),
                    ],
                    ["row", "doc_id", "row_key", "n_words", "runs", "items", "near"],
                )
        release()

    return run


def _null_last(item: int | None) -> tuple[bool, int]:
    return item is None, item or 0


def _union(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(runs):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def find_contamination(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, slop: int = 2 * WINDOW) -> DataFrame:
    """row, doc_id, row_key, n_words, runs (word spans inside windows, apart from each other), items, near of every document."""
    scratch = Scratch(spark)
    index = scratch.table(build_index(docs), "index")
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(size / BENCHMARK_BLOCK))
    results = []
    for k in range(n):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else items
        queries = spark.sparkContext.broadcast(Queries([tuple(r) for r in block.toLocalIterator()], width))
        results.append(index.mapInArrow(_search(queries, slop), _HITS))
    if n == 1:
        return results[0]
    hits = results[0]
    for r in results[1:]:
        hits = hits.unionByName(r)
    merged = hits.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("row_key").alias("row_key"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("runs")).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))).alias("near"))
    # Runs of several blocks may overlap: keep each hit position once, as runs of one word.
    spots = F.array_sort(F.array_distinct(F.flatten(F.transform("runs", lambda x: F.sequence(x["s"], x["e"] - 1)))))
    return merged.withColumn("runs", F.transform(spots, lambda p: F.struct(p.alias("s"), (p + 1).alias("e"))))


def contaminated(hits: DataFrame) -> DataFrame:
    """The digest of each document: doc_id, row_key, n_words, n_hit, n_items, items_sha256, contaminated, n_near."""
    n_hit = F.aggregate("runs", F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"])
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return hits.withColumn("n_hit", n_hit).select(
        "doc_id", "row_key", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), F.size("near").cast("long").alias("n_near")
    )
