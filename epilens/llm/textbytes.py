"""Vectorised work on the UTF-8 bytes of an Arrow text column.

Tasks receive Arrow batches; these helpers cut them into blocks of bounded
size and find, hash and count words with numpy, with no Python loop per word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
_AT_ONCE = 1 << 17
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit scrambler (the splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = x + _GOLD
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(256, dtype=np.uint64) + np.uint64(7919)) | np.uint64(1)
_weights = mix(np.arange(1024, dtype=np.uint64) << np.uint64(20)) | np.uint64(1)

#: Lower-cases A-Z and leaves every other byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(members: bytes, negate: bool = False) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(members)] = True
    return ~table if negate else table


NOT_SPACE = byte_class(SPACES, negate=True)
#: Letters and digits after lower-casing, and every byte of a non-ASCII character.
ALNUM = byte_class(bytes([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]))


def weights(n: int) -> np.ndarray:
    global _weights
    if len(_weights) < n:
        _weights = mix(np.arange(2 * n, dtype=np.uint64) << np.uint64(20)) | np.uint64(1)
    return _weights


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows and their n + 1 bounds; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64, len(column) + 1 + column.offset)[column.offset :]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


#: What a process keeps over its tasks, as functions that let go of it.
KEPT: list[Callable[[], None]] = []
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release(kept: bool = True) -> None:
    """Gives memory that is free back to the system, which other processes of the executor need; what is kept as well."""
    for let_go in KEPT if kept else []:
        let_go()
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def blocks(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES, keep: bool = False) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with at most limit bytes of text (or one row), their bytes and bounds.

    A task with keep goes on with what its process kept; another one lets go of it.
    """
    release(kept=not keep)
    yield from _blocks(batches, column, limit)
    release(kept=False)


def _blocks(batches: Iterable[pa.RecordBatch], column: str, limit: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        if not batch.num_rows:
            continue
        raw, bounds = utf8(batch.column(batch.schema.get_field_index(column)))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + limit, "right")) - 1)
            yield batch.slice(i, j - i), raw[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
            i = j


def words(raw: np.ndarray, bounds: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of member bytes, and the n + 1 word bounds of the rows."""
    n = len(raw)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(bounds), np.int64)
    inside = member[raw]
    before = np.empty(n + 1, bool)
    before[0] = False
    before[1:] = inside
    before[bounds[:-1]] = False
    starts = np.flatnonzero(inside & ~before[:-1])
    after = np.empty(n, bool)
    after[:-1] = inside[1:]
    after[-1] = False
    edge = bounds[1:] - 1
    after[edge[edge >= 0]] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def span_hash(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of non-empty byte spans: a multilinear sum, scrambled with the length."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    after = np.cumsum(lens)
    out = np.empty(len(starts), np.uint64)
    w = weights(int(lens.max()))
    i = 0
    while i < len(starts):  # a few bytes at a time: each takes some 40 of memory meanwhile
        j = max(i + 1, int(np.searchsorted(after, (after[i - 1] if i else 0) + _AT_ONCE, "right")))
        n = lens[i:j]
        first = np.cumsum(n) - n
        at = np.arange(int(n.sum())) - np.repeat(first, n)
        with np.errstate(over="ignore"):
            values = _BYTE[raw[at + np.repeat(starts[i:j], n)]] * w[at]
            out[i:j] = np.add.reduceat(values, first) + n.astype(np.uint64) * _GOLD
        i = j
    return mix(out)


def prefix_hash(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """span_hash of the first length bytes of those spans that are longer."""
    long = ends - starts > length
    return span_hash(raw, starts[long], starts[long] + length)


def sequence_hash(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of each width consecutive items of h."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, width, np.uint64)
    w = weights(width + 1)
    with np.errstate(over="ignore"):
        for k in range(width):
            total = total + h[k : k + n] * w[k + 1]
    return mix(total)
