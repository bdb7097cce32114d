"""Vectorised text kernels: the words, word hashes and shingles of an Arrow column, without a Python loop over words.

Texts are UTF-8 bytes.  Words never span documents.  Hashes are 64 bits of a polynomial over a random byte
table, finished by a mixer; equal strings hash equally in every task and at every size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

U64 = np.uint64
_MUL = U64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(20240611)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]
_P = U64(0xD1342543DE82EF95)
_PINV = U64(pow(0xD1342543DE82EF95, -1, 2**64))
_pow = {"p": np.ones(1, np.uint64), "i": np.ones(1, np.uint64)}

#: Words of everything but white space, ``[^\x20\x09-\x0D]+``.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Words of ASCII letters, digits and all of non-ASCII, ``[0-9A-Za-z\x80-]+`` (upper case counts as lower case).
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


#: Rows and bytes of an Arrow batch between Spark and Python, and rows that a Parquet reader decodes at once.
BATCH_ROWS, BATCH_BYTES, READER_ROWS = 2000, 4 << 20, 512


def small_batches(spark: SparkSession) -> None:
    """Lower the session's limits of Arrow batches to BATCH_ROWS and BATCH_BYTES, and of Parquet's to READER_ROWS, unless they are lower.

    Spark's own, 10,000 rows and 64 MB, hold tens of megabytes of texts outside the heap of the JVM for each running task,
    in both directions, and again in the Python worker; its reader's 4,096 rows of texts are arrays of many megabytes in
    the heap.  The settings stay: they count when a result is computed.
    """
    unit = {"": 1, "b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES), ("spark.sql.parquet.columnarReaderBatchSize", READER_ROWS)):
        number, kind = re.fullmatch(r"(-?\d+)([bkmgt]?)b?", spark.conf.get(key).lower()).groups()
        if not 0 < int(number) * unit[kind] <= most:
            spark.conf.set(key, str(most))


def gathered(batches: Iterator[pa.RecordBatch], rows: int = 1 << 62, size: int = 1 << 62) -> Iterator[pa.RecordBatch]:
    """Batches put together to about so many rows or bytes."""
    held, n, m = [], 0, 0
    for batch in batches:
        held.append(batch)
        n, m = n + batch.num_rows, m + batch.nbytes
        if n >= rows or m >= size:
            yield pa.concat_batches(held)
            held, n, m = [], 0, 0
    if held:
        yield pa.concat_batches(held)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit (the murmur3 finaliser)."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow["p"]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in (("p", _P), ("i", _PINV)):
            steps = np.full(size, base, np.uint64)
            steps[0] = U64(1)
            _pow[k] = np.cumprod(steps, dtype=np.uint64)
    return _pow["p"][:n], _pow["i"]


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes; a longer text is a range of its own."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def by_document(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``values[bounds[i]:bounds[i + 1]]`` for each i."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


class Words:
    """The words of texts ``data[offsets[i]:offsets[i + 1]]``: byte ranges, hashes, and ``first[i]:first[i + 1]`` for text i."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, lower: bool = True):
        n = len(data)
        m = inside[data]
        s, e = m.copy(), m.copy()
        s[1:] &= ~m[:-1]
        e[:-1] &= ~m[1:]
        some = offsets[:-1][np.diff(offsets) > 0]
        s[some] = m[some]
        last = offsets[1:][np.diff(offsets) > 0] - 1
        e[last] = m[last]
        self.start, self.end = np.flatnonzero(s), np.flatnonzero(e) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        p, inv = _powers(max(n, 1))
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((_BYTE_LOWER if lower else _BYTE)[data] * p[:n], out=total[1:])
        self.total, self.inverse = total, inv
        self.hash = mix((total[self.end] - total[self.start]) * inv[self.start] + (self.end - self.start).astype(np.uint64) * _MUL)

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the bytes of each range."""
        return mix((self.total[end] - self.total[start]) * self.inverse[start] + (end - start).astype(np.uint64) * _MUL)

    def runs(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on; it spans documents near their ends."""
        h, n = self.hash, len(self.hash) - k + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        acc = np.full(n, k, np.uint64)
        for j in range(k):
            acc = acc * _MUL + h[j : n + j]
        return mix(acc)

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all k-word shingles by document, and their n + 1 bounds; a shorter document, if not empty, is one shingle."""
        c = self.count
        full = np.maximum(c - k + 1, 0)
        per = np.where((c > 0) & (c < k), 1, full)
        bounds = np.concatenate([[0], np.cumsum(per)])
        out = np.empty(bounds[-1], np.uint64)
        h = self.runs(k)
        if len(h):
            word = np.arange(len(self.hash))
            ok = word < np.repeat(self.first[:-1] + full, c)
            out[np.repeat(full > 0, per)] = h[ok[: len(h)]] if ok[len(h) :].sum() == 0 else h[np.flatnonzero(ok)]
        for size in range(1, k):
            docs = np.flatnonzero(c == size)
            if len(docs):
                acc = np.full(len(docs), size, np.uint64)
                for j in range(size):
                    acc = acc * _MUL + self.hash[self.first[docs] + j]
                out[bounds[docs]] = mix(acc)
        return out, bounds
