"""Ranked lexical search over a two-level quantised index.

The documents are indexed in segments of about 1 MB of text, written to the
shared folder. A segment's first level has, for each term, the documents and
one byte each: the term's impact there (its share of the score without the
term's weight), rounded up to a multiple of `STEP`. Its second level has the
exact occurrences and document lengths. Parquet reads the two levels apart.

A search takes two passes. The first reads bytes only: a byte gives an upper
and a lower bound of the impact, weighted sums of the lower bounds give each
item's k-th best lower bound over all segments. The second sums the upper
bounds and rescores, in exact integers from the second level, every document
whose bound reaches the item's k-th lower bound; no other document can be among
the k best. The items are taken in blocks of bounded size.

Terms are compared by 64-bit hashes.

Cases: null or empty text has no terms, is in no result and counts in neither
N nor L; an item without terms, or of terms that no document has, has no rows;
rows with the same doc_id are ranked apart, a null doc_id comes after others of
its score; rows with the same item_id, or a null one, are ranked as items of
their own; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from epilens.llm.common import Scratch
from epilens.llm.decontam import term_hashes
from epilens.llm.textbytes import ALNUM, LOWER, blocks, utf8, words

TOP = 50
#: Impacts are below 1,000,000: their bytes go up to 245.
STEP = 4096
ITEM_BLOCK = 2 << 20
# Postings of a segment that are summed at a time.
_AT_ONCE = 1 << 21

_SEGMENT = "doc_ids array<long>, lengths array<long>, terms binary, ends binary, docs binary, impacts binary, counts binary"
_NO_ID = np.iinfo(np.int64).max


def _sizes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, raw, bounds in blocks(batches):
        n = np.diff(words(LOWER[raw], bounds, ALNUM)[2])
        yield pa.RecordBatch.from_arrays([pa.array([int((n > 0).sum())]), pa.array([int(n.sum())])], ["docs", "terms"])


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


def _least(x: np.ndarray) -> bytes:
    """Unsigned integers in as few bytes each as the largest needs."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0)))).tobytes()


def _wide(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"u{len(data) // n}" if n else "u1").astype(np.int64)


def _postings(total_docs: int, total_terms: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, bounds in blocks(batches):
            h, at = term_hashes(raw, bounds)
            n = np.diff(at)
            m = np.array([50 + 50 * k * total_docs // max(1, total_terms) for k in n.tolist()], np.int64)
            order = np.argsort(h, kind="stable")
            h, doc = h[order], np.repeat(np.arange(len(n)), n)[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            first = np.flatnonzero(new)
            tf = np.diff(first, append=len(h))
            h, doc = h[first], doc[first]
            terms, starts = np.unique(h, return_index=True)
            ends = np.append(starts[1:], len(h)) if len(h) else starts
            up = -(-impact(tf, m[doc]) // STEP)
            cells = [batch.column(0).to_pylist(), m.tolist(), terms.tobytes(), ends.astype("<u4").tobytes(), _least(doc), up.astype(np.uint8).tobytes(), _least(tf)]
            kinds = [pa.list_(pa.int64())] * 2 + [pa.binary()] * 5
            yield pa.RecordBatch.from_arrays([pa.array([c], kind) for c, kind in zip(cells, kinds, strict=True)], ["doc_ids", "lengths", "terms", "ends", "docs", "impacts", "counts"])

    return run


class LexicalIndex:
    """The index of a table of documents, in the shared folder; serves any number of searches."""

    def __init__(self, spark: SparkSession, docs: DataFrame):
        self.spark, self.scratch = spark, Scratch(spark)
        texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        n, total = texts.mapInArrow(_sizes, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
        self.n_docs, self.n_terms = n or 0, total or 0
        self.segments = self.scratch.table(texts.mapInArrow(_postings(self.n_docs, self.n_terms), _SEGMENT), "segments")

    def search(self, items: DataFrame, top: int = TOP) -> DataFrame:
        """item_id, rank, doc_id, score: the `top` best documents of each row of items (item_id, text)."""
        items = items.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
        size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        n = max(1, math.ceil(size / ITEM_BLOCK))
        found = None
        for k in range(n):
            block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else items
            part = self._block([tuple(r) for r in block.toLocalIterator()], top).withColumn("block", F.lit(k))
            found = part if found is None else found.unionByName(part)
        best = Window.partitionBy("block", "item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")

    def _block(self, items: list[tuple[int | None, str | None]], top: int) -> DataFrame:
        q = Items(items)
        level = self.segments.select("terms", "ends")
        df = level.mapInArrow(_document_counts(q.terms), "term long, n long").groupBy("term").agg(F.sum("n")).collect()
        q.weigh(self.n_docs, dict(map(tuple, df)))
        sent = self.spark.sparkContext.broadcast(q)
        lows = self.segments.select("terms", "ends", "docs", "impacts").mapInArrow(_lower_bounds(sent, top), "item long, low long")
        best = Window.partitionBy("item").orderBy(F.desc("low"))
        kth = lows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).groupBy("item").agg(F.min("low"), F.count("*"))
        least = np.zeros(len(items), np.int64)
        for item, low, count in kth.collect():
            least[item] = low if count == top else 0
        return self.segments.mapInArrow(_rescored(sent, self.spark.sparkContext.broadcast(least), top), "item long, item_id long, doc_id long, score long")


class Items:
    """A block of items as sorted distinct terms and (item, place of term) pairs, each once."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        h, at = term_hashes(*utf8(pa.array([t for _, t in items], pa.large_string())))
        self.ids = [i for i, _ in items]
        self.terms, place = np.unique(h, return_inverse=True)
        pairs = np.unique(np.stack([np.repeat(np.arange(len(items)), np.diff(at)), place]), axis=1) if len(h) else np.zeros((2, 0), np.int64)
        self.item, self.term = pairs[0], pairs[1]
        self.weight = np.zeros(len(self.item), np.int64)

    def weigh(self, n_docs: int, counts: dict[int, int]) -> None:
        """Sets the pairs' weights from how many documents have each term; terms of none are left out."""
        df = np.array([counts.get(k, 0) for k in range(len(self.terms))], np.int64)
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * k + 1))) for k in df.tolist()], np.int64)
        there = df[self.term] > 0
        self.item, self.term = self.item[there], self.term[there]
        self.weight = weights[self.term]

    def parts(self, ends: np.ndarray, places: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """Runs of items a to b, the place of each of their postings, its item less a, and its weight."""
        here = np.flatnonzero(places[self.term] >= 0)
        if not len(here):
            return
        item, place, weight = self.item[here], places[self.term[here]], self.weight[here]
        end = ends[place]
        n = end - np.where(place > 0, ends[place - 1], 0)
        total = np.cumsum(n)
        i = 0
        while i < len(here):
            j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + _AT_ONCE, "right")))
            if j < len(here):  # an item is not parted
                first = int(np.searchsorted(item, item[j]))
                j = first if first > i else int(np.searchsorted(item, item[j], "right"))
            k = n[i:j]
            at = np.arange(int(k.sum())) + np.repeat(end[i:j] - np.cumsum(k), k)
            yield int(item[i]), int(item[j - 1]) + 1, at, np.repeat(item[i:j] - item[i], k), np.repeat(weight[i:j], k)
            i = j


def _places(terms: bytes, wanted: np.ndarray) -> np.ndarray:
    """The place of each wanted term among a segment's, -1 if it is absent."""
    have = np.frombuffer(terms, np.uint64)
    if not len(have):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(have, wanted), len(have) - 1)
    return np.where(have[at] == wanted, at, -1)


def _sums(key: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    if int(values.sum()) < 1 << 53:  # doubles are exact
        return np.bincount(key, values, size).astype(np.int64)
    out = np.zeros(size, np.int64)
    np.add.at(out, key, values)
    return out


def _document_counts(terms: np.ndarray):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(terms), np.int64)
        for batch in batches:
            for have, ends in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at = _places(have, terms)
                counts[at >= 0] += np.diff(np.frombuffer(ends, "<u4").astype(np.int64), prepend=0)[at[at >= 0]]
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(counts[some])], ["term", "n"])

    return run


def _lower_bounds(items, top: int):
    """The best lower bounds of each item over a task's segments."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q: Items = items.value
        best = np.zeros((len(q.ids), top), np.int64)
        for batch in batches:
            for r in batch.to_pylist():
                ends, impacts = np.frombuffer(r["ends"], "<u4").astype(np.int64), np.frombuffer(r["impacts"], np.uint8).astype(np.int64)
                docs = _wide(r["docs"], len(impacts))
                width = int(docs.max(initial=-1)) + 1
                low = np.where(impacts > 0, (impacts - 1) * STEP + 1, 0)
                for a, b, at, item, weight in q.parts(ends, _places(r["terms"], q.terms)):
                    sums = _sums(item * width + docs[at], weight * low[at], (b - a) * width).reshape(b - a, width)
                    better = np.flatnonzero(sums.max(axis=1) > best[a:b].min(axis=1))
                    both = np.concatenate([best[a + better], sums[better]], axis=1)
                    best[a + better] = np.partition(both, width, axis=1)[:, width:]
        item, k = np.nonzero(best)
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(best[item, k])], ["item", "low"])

    return run


def _rescored(items, least, top: int):
    """The exact scores of all documents whose upper bound reaches the item's least one; the best of each task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, floor = items.value, least.value
        kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for r in batch.to_pylist():
                ends, impacts = np.frombuffer(r["ends"], "<u4").astype(np.int64), np.frombuffer(r["impacts"], np.uint8).astype(np.int64)
                docs, tf, m = _wide(r["docs"], len(impacts)), _wide(r["counts"], len(impacts)), np.array(r["lengths"], np.int64)
                ids = np.array([_NO_ID if i is None else i for i in r["doc_ids"]], np.int64)
                width = len(ids)
                for a, b, at, item, weight in q.parts(ends, _places(r["terms"], q.terms)):
                    key = item * width + docs[at]
                    upper = _sums(key, weight * impacts[at] * STEP, (b - a) * width)
                    reach = (upper > 0) & (upper >= np.repeat(floor[a:b], width))
                    some = reach[key]
                    at, key = at[some], key[some]
                    exact = _sums(key, weight[some] * impact(tf[at], m[docs[at]]), (b - a) * width)
                    pair = np.flatnonzero(exact)
                    if not len(pair):
                        continue
                    which, begin = np.unique(pair // width, return_index=True)
                    for i, x in zip((which + a).tolist(), np.split(pair, begin[1:]), strict=True):
                        score, doc = exact[x], ids[x % width]
                        if i in kept:
                            score, doc = np.concatenate([kept[i][0], score]), np.concatenate([kept[i][1], doc])
                        order = np.lexsort((doc, -score))[:top]
                        kept[i] = score[order], doc[order]
        for i, (score, doc) in kept.items():
            n = len(score)
            yield pa.RecordBatch.from_arrays([pa.array([i] * n, pa.int64()), pa.array([q.ids[i]] * n, pa.int64()), pa.array(doc, mask=doc == _NO_ID), pa.array(score)], ["item", "item_id", "doc_id", "score"])

    return run


def ranked_search(spark: SparkSession, docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the best documents of each item by the integer BM25 score."""
    return LexicalIndex(spark, docs).search(items, top)
