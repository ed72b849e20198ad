"""Token ids of whole texts by the tokenizers library, word by word.

Both public vocabularies pre-tokenise on white space, so a text may be cut
before a single space or line feed that stands between two characters which
are surely no white space: the ids of the parts, joined, are the ids of the
text. Parts repeat, so each distinct part is encoded once while a process keeps
it. New parts are joined for the library where the same rule lets them be cut
again; the offsets of the ids tell which part each belongs to.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np

from epilens.llm.textbytes import KEPT, span_hash

#: Distinct parts kept per process (about 50 bytes each); beyond it only those met again stay.
CACHE_PARTS = 500_000
_TABLE = 1 << 20
#: Bytes of text encoded at a time.
BLOCK = 1 << 18
#: Parts joined into one text for the library.
_JOIN = 256

_GRAPH = np.zeros(256, bool)
_GRAPH[0x21:0x7F] = True
#: Lead bytes of two-byte Latin letters (U+00C0 to U+027F): no white space, no combining mark.
_LATIN = np.zeros(256, bool)
_LATIN[0xC3:0xCA] = True
_GAP = np.zeros(256, bool)
_GAP[[0x20, 0x0A]] = True


def part_starts(raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where parts begin: at each non-empty row, and at each safe white space inside it."""
    cut = np.zeros(len(raw), bool)
    if len(raw) > 2:
        before, here, after = raw[:-2], raw[1:-1], raw[2:]
        safe = _GRAPH[before]
        safe[1:] |= (before[1:] >= 0x80) & (before[1:] < 0xC0) & _LATIN[raw[: len(raw) - 3]]
        cut[1:-1] = _GAP[here] & safe & (_GRAPH[after] | _LATIN[after])
    # A row's first or last character has no neighbour in its own row.
    for edge in (bounds[:-1], bounds[1:] - 1):
        cut[edge[(edge >= 0) & (edge < len(raw))]] = False
    heads = bounds[:-1][bounds[1:] > bounds[:-1]]
    cut[heads] = True
    return np.flatnonzero(cut)


def _ranges(data: np.ndarray, begin: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The items of data at begin, begin + 1, ... for each begin and length, one range after the other."""
    after = np.cumsum(lens, dtype=np.int64)
    return data[np.repeat(begin - (after - lens), lens) + np.arange(int(after[-1]) if len(after) else 0)]


class PartEncoder:
    """Encodes blocks of texts; one for each process and vocabulary file.

    An open-addressing table of part hashes (0 marks an empty place) leads to
    the ids of the parts met so far, so that only new parts reach the library.
    """

    _kept: dict[str, PartEncoder] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self._reset()

    @classmethod
    def of(cls, path: str) -> PartEncoder:
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def _reset(self) -> None:
        self.keys = np.zeros(_TABLE, np.uint64)
        self.slots = np.zeros(_TABLE, np.int32)
        self.hashes = np.zeros(1 << 12, np.uint64)
        self.begin = np.zeros(1 << 12, np.int32)
        self.length = np.zeros(1 << 12, np.int32)
        self.again = np.zeros(1 << 12, bool)
        self.flat = np.zeros(1 << 14, np.uint32)
        self.parts = self.used = 0

    def _shrink(self) -> None:
        """Forgets the parts that were met in one block only, or all if most were met again."""
        stay = np.flatnonzero(self.again[: self.parts])
        hashes, lens = self.hashes[stay], self.length[stay]
        ids = _ranges(self.flat, self.begin[stay], lens)
        self._reset()
        if len(stay) <= CACHE_PARTS // 2:
            self._store(hashes, ids, lens)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 where it is new."""
        found = np.full(len(keys), -1, np.int32)
        at = (keys & np.uint64(_TABLE - 1)).astype(np.int64)
        left = np.arange(len(keys))
        while len(left):
            there = self.keys[at[left]]
            hit = there == keys[left]
            found[left[hit]] = self.slots[at[left[hit]]]
            left = left[~hit & (there != 0)]
            at[left] = (at[left] + 1) % _TABLE
        return found

    def _store(self, keys: np.ndarray, ids: np.ndarray, lens: np.ndarray) -> None:
        """New, distinct keys with the ids of their parts, one part after the other."""
        n, total = self.parts, int(lens.sum())
        while n + len(keys) > len(self.begin):
            for name in ("hashes", "begin", "length", "again"):
                setattr(self, name, np.resize(getattr(self, name), 2 * len(getattr(self, name))))
        while self.used + total > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        new = slice(n, n + len(keys))
        self.flat[self.used : self.used + total] = ids
        self.hashes[new], self.length[new], self.again[new] = keys, lens, False
        self.begin[new] = self.used + np.cumsum(lens) - lens
        self.used += total
        self.parts += len(keys)
        slots = np.arange(n, n + len(keys), dtype=np.int32)
        at = (keys & np.uint64(_TABLE - 1)).astype(np.int64)
        left = np.arange(len(keys))
        while len(left):
            free = self.keys[at[left]] == 0
            self.keys[at[left[free]]] = keys[left[free]]
            done = self.keys[at[left]] == keys[left]
            self.slots[at[left[done]]] = slots[left[done]]
            left = left[~done]
            at[left] = (at[left] + 1) % _TABLE

    def _tokenise(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the parts, one after the other, and how many each has."""
        last = raw[ends - 1]
        sound = _GRAPH[last] | (last >= 0x80) & (last < 0xC0) & _LATIN[raw[np.maximum(ends - 2, 0)]] & (ends - starts > 1)
        joins = sound & _GAP[raw[starts]] & (ends - starts > 1)
        joins &= _GRAPH[raw[np.minimum(starts + 1, len(raw) - 1)]] | _LATIN[raw[np.minimum(starts + 1, len(raw) - 1)]]
        order = np.argsort(~joins, kind="stable")
        n, lens = int(joins.sum()), (ends - starts)[order]
        data = _ranges(raw, starts[order], lens)
        text = data.tobytes().decode("utf-8", "replace")
        chars = np.cumsum((data & 0xC0) != 0x80)
        if len(text) != chars[-1]:  # no UTF-8: each part alone, as the library sees it
            texts = [raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            lists = [x.ids for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
            return np.fromiter(chain.from_iterable(lists), np.uint32), np.fromiter(map(len, lists), np.int64, len(lists))
        begin = np.concatenate(([0], chars[np.cumsum(lens) - 1]))
        heads = np.concatenate((np.arange(0, n, _JOIN), np.arange(n, len(order))))
        edges = begin[np.append(heads, len(order))].tolist()
        met = self.tokenizer.encode_batch([text[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)], add_special_tokens=False)
        lists = [x.ids for x in met]
        many = np.fromiter(map(len, lists), np.int64, len(lists))
        ids = np.fromiter(chain.from_iterable(lists), np.uint32, int(many.sum()))
        offsets = np.fromiter((o[0] for x in met for o in x.offsets), np.int64, len(ids)) + np.repeat(np.array(edges[:-1]), many)
        counts = np.zeros(len(order), np.int64)
        counts[order] = ordered = np.bincount(np.searchsorted(begin, offsets, "right") - 1, minlength=len(order))
        at = np.empty(len(order), np.int64)
        at[order] = np.cumsum(ordered) - ordered
        return _ranges(ids, at, counts), counts

    def encode(self, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows, and the n + 1 bounds of each row's ids."""
        starts = part_starts(raw, bounds)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(bounds), np.int64)
        ends = np.append(starts[1:], len(raw))
        keys = np.maximum(span_hash(raw, starts, ends), np.uint64(1))
        slot = self._find(keys)
        self.again[slot[slot >= 0]] = True
        if (new := np.flatnonzero(slot < 0)).size:
            fresh, first = np.unique(keys[new], return_index=True)
            if self.parts + len(fresh) > CACHE_PARTS:
                self._shrink()
                new = np.flatnonzero(self._find(keys) < 0)
                fresh, first = np.unique(keys[new], return_index=True)
                if self.parts + len(fresh) > CACHE_PARTS:  # one huge row
                    self._reset()
                    return self._whole(raw, bounds)
            self._store(fresh, *self._tokenise(raw, starts[new[first]], ends[new[first]]))
            slot = self._find(keys)
        lens = self.length[slot].astype(np.int64)
        after = np.cumsum(lens)
        return _ranges(self.flat, self.begin[slot], lens), np.concatenate(([0], after))[np.searchsorted(starts, bounds)]

    def _whole(self, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = [np.array(self.tokenizer.encode(raw[a:b].tobytes().decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        return np.concatenate(rows), np.cumsum([0, *map(len, rows)])


KEPT.append(PartEncoder._kept.clear)
