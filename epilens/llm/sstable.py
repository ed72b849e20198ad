"""Token ids in sorted-string-table files.

Documents are range-partitioned and sorted by identifier; each task encodes
its rows and writes files of about `FILE_TOKENS` ids. A file holds, in order:

* data blocks: zlib-compressed runs of entries. A key is 8 big-endian bytes of
  doc_id + 2**63, so that byte order is numeric order, then 4 bytes that
  number repeats of one doc_id. An entry is varint(shared prefix with the key
  before), varint(rest), rest of key, varint(ids), ids as little-endian uint32;
* the sparse index: for each block its last key, offset and length;
* a Bloom filter of the doc_ids: 10 bits each, 7 probes;
* a footer of fixed size with the places of both, the entry count, the id
  count and a magic number.

Lookup reads the footer, tests the filter, bisects the index and scans one
block. A task writes under a name of its own and then renames, so a task that
runs again after a lost executor replaces nothing half-written; only files
named in the tasks' results are read.

Cases: null text is empty and has the end id alone; rows with doc_id null come
first, before any number, and their key is flagged; rows that repeat a doc_id,
or have none, all stay, in order of a 64-bit hash of their texts; an empty table
writes no file; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from epilens.llm.common import Scratch
from epilens.llm.textbytes import blocks
from epilens.llm.tokens import BLOCK, PartEncoder

BLOCK_BYTES = 64 << 10
FILE_TOKENS = 16 << 20
MAGIC = b"EPLSST01"
FOOTER = struct.Struct("<QQQQQQ8s")
BLOOM_BITS, BLOOM_PROBES = 10, 7


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 0x7F) << shift
        if b < 0x80:
            return n, at
        shift += 7


def key_of(doc_id: int | None, repeat: int = 0) -> bytes:
    """13 bytes: a null flag, the identifier, the repeat."""
    return struct.pack(">BQI", doc_id is not None, (doc_id or 0) + (1 << 63) if doc_id is not None else 0, repeat)


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key[1:9])[0] - (1 << 63) if key[0] else None


def _probes(keys: np.ndarray, bits: int) -> np.ndarray:
    from epilens.llm.textbytes import mix

    h = mix(keys.astype(np.uint64))
    g = mix(h) | np.uint64(1)
    with np.errstate(over="ignore"):
        return (h[:, None] + g[:, None] * np.arange(BLOOM_PROBES, dtype=np.uint64)) % np.uint64(bits)


class TableWriter:
    """Writes one file; keys must come in ascending order."""

    def __init__(self, sink):
        self.sink, self.at, self.block, self.last, self.index, self.ids_of = sink, 0, bytearray(), b"", [], []
        self.entries = self.tokens = 0

    def add(self, key: bytes, value: np.ndarray) -> None:
        shared = 0
        while shared < len(self.last) and self.last[shared] == key[shared]:
            shared += 1
        self.block += _varint(shared) + _varint(len(key) - shared) + key[shared:] + _varint(len(value)) + value.astype("<u4").tobytes()
        self.last = key
        self.ids_of.append(id_of(key) or 0)
        self.entries += 1
        self.tokens += len(value)
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            data = zlib.compress(bytes(self.block), 1)
            self.index.append((self.last, self.at, len(data)))
            self.sink.write(data)
            self.at += len(data)
            self.block, self.last = bytearray(), b""

    def close(self) -> None:
        self._flush()
        index = b"".join(k + struct.pack("<QI", a, n) for k, a, n in self.index)
        bits = max(64, BLOOM_BITS * self.entries)
        bloom = np.zeros(bits, bool)
        bloom[_probes(np.array(self.ids_of, np.int64), bits).ravel().astype(np.int64)] = True
        bloom = np.packbits(bloom).tobytes()
        self.sink.write(index + bloom + FOOTER.pack(self.at, len(index), self.at + len(index), bits, self.entries, self.tokens, MAGIC))


class TableReader:
    """Scan and binary-search lookup in one file."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        self.index_at, index_n, bloom_at, self.bits, self.entries, self.tokens, magic = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token table")
        raw = self._read(self.index_at, index_n)
        self.index = [(raw[i : i + 13], *struct.unpack("<QI", raw[i + 13 : i + 25])) for i in range(0, index_n, 25)]
        self.bloom_at = bloom_at

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def _block(self, at: int, n: int) -> Iterator[tuple[bytes, np.ndarray]]:
        data, i, last = zlib.decompress(self._read(at, n)), 0, b""
        while i < len(data):
            shared, i = _read_varint(data, i)
            rest, i = _read_varint(data, i)
            last = last[:shared] + data[i : i + rest]
            n_ids, i = _read_varint(data, i + rest)
            yield last, np.frombuffer(data, "<u4", n_ids, i)
            i += 4 * n_ids

    def scan(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for _, at, n in self.index:
            yield from self._block(at, n)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of each row with this doc_id; the filter counts a row without one as 0."""
        bloom = np.unpackbits(np.frombuffer(self._read(self.bloom_at, (self.bits + 7) // 8), np.uint8))
        if not bloom[_probes(np.array([doc_id or 0], np.int64), self.bits)[0].astype(np.int64)].all():
            return []
        low, found = key_of(doc_id), []
        for _, at, n in self.index[bisect_left(self.index, (low,)) :]:
            for key, ids in self._block(at, n):
                if id_of(key) == doc_id:
                    found.append(ids.copy())
                elif key > low:
                    return found
        return found


def open_fs(uri: str):
    """File system and path of a URI; pyarrow knows file, s3, gs, hdfs and others."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri)


def _writer(folder: str, vocabulary: str, end_id: int, file_tokens: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, (files, base) = PartEncoder.of(vocabulary), open_fs(folder)
        sink = writer = None
        name, last, repeat, low, low_tie, done = "", None, 0, None, 0, []

        def close() -> None:
            writer.close()
            sink.close()
            files.move(f"{base}/.{name}", f"{base}/{name}")
            done.append((name, low, low_tie, len(done), writer.entries, writer.tokens))

        for batch, raw, bounds in blocks(batches, limit=BLOCK, keep=True):
            ids, at = encoder.encode(raw, bounds)
            for i, (doc_id, tie) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                repeat = repeat + 1 if writer and doc_id == last else 0
                if writer is None:
                    name, low, low_tie = f"{uuid.uuid4().hex}.sst", doc_id, tie
                    sink = files.open_output_stream(f"{base}/.{name}")
                    writer = TableWriter(sink)
                    repeat = 0
                writer.add(key_of(doc_id, repeat), np.append(ids[at[i] : at[i + 1]], np.uint32(end_id)))
                last = doc_id
                if writer.tokens >= file_tokens:
                    close()
                    writer = None
        if writer is not None:
            close()
        columns = list(zip(*done, strict=True)) if done else [[]] * 6
        kinds = [pa.string(), *[pa.int64()] * 5]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["file", "low", "tie", "at", "entries", "tokens"])

    return run


def write_tables(spark: SparkSession, docs: DataFrame, vocabulary: str, end_id: int = 1, folder: str | None = None, file_tokens: int = FILE_TOKENS) -> tuple[str, DataFrame]:
    """Writes the files; returns their folder and one row per file: file, low, tie, at, entries, tokens; key order is by (low, tie, at).

    Rows of one doc_id, or without one, are in order of a hash of their texts, and
    may be spread over tasks; files that begin alike come from one task, which
    numbers its files, or hold one text.
    """
    scratch = Scratch(spark)
    folder = folder or f"{scratch.path}/sst"
    files, base = open_fs(folder)
    files.create_dir(base, recursive=True)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.asc_nulls_first("doc_id"), F.asc("tie")]
    ordered = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("tie")).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    listed = ordered.mapInArrow(_writer(folder, vocabulary, end_id, file_tokens), "file string, low long, tie long, at long, entries long, tokens long")
    return folder, scratch.table(listed, "manifest")


def _reader(folder: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = open_fs(folder)
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with files.open_input_file(f"{base}/{name}") as source:
                    rows = []
                    for key, ids in TableReader(source).scan():
                        rows.append((id_of(key), start, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes()))
                        start += len(ids)
                        if len(rows) == 1000:
                            yield _rows(rows)
                            rows = []
                    yield _rows(rows)

    return run


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])


def read_tables(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, ids (little-endian uint32) of every entry, from the files.

    The window over the manifest orders files, not rows: about one row for 64 MB of ids.
    """
    order = Window.orderBy(F.asc_nulls_first("low"), "tie", "at")
    starts = manifest.where("entries > 0").select("file", F.coalesce(F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return starts.repartition(parts).mapInArrow(_reader(folder), "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def lookup(folder: str, manifest_rows: Iterable[tuple[str, int | None]], doc_id: int | None) -> list[np.ndarray]:
    """The ids of each row with this doc_id, or without one: bisects the files' lowest keys, given as (file, low), then the files that may hold it."""
    rows = sorted(((key_of(low), name) for name, low in manifest_rows))
    files, base = open_fs(folder)
    key = key_of(doc_id)
    first = bisect_left(rows, (key,))
    if first:  # the file that begins before the key, and others that begin like it
        first = bisect_left(rows, (rows[first - 1][0],))
    found: list[np.ndarray] = []
    for low, name in rows[first:]:
        if low > key:
            break
        with files.open_input_file(f"{base}/{name}") as source:
            found += TableReader(source).get(doc_id)
    return found
