"""Removal of long passages that occur in an earlier document, by suffix arrays over shards.

A byte goes if it is covered by a ``length``-byte string that also starts in a document with a smaller ``doc_id``.

1. Documents are dealt into parts by hash.  For each string of ``length`` bytes the least hash of its GRAM-byte
   substrings is its anchor; equal strings have equal anchors, and neighbouring strings mostly share theirs, so
   a text has few.  Parts send their distinct anchors by hash; those that two documents have come back.
2. Strings with a shared anchor are candidates.  A run of neighbouring candidates with one anchor is a segment.
   Each part sends its distinct segments, with the least and largest document of each, to the shard of the anchor:
   all places of a string meet in one shard.  Anchors with very many segments (a passage that stands in many
   documents, each with its own neighbours) are hot: their strings go to shards one by one, by their own hashes.
3. A shard joins its distinct segments, sorts their suffixes by induced sorting (``suffixes``; in piles by anchor), and finds by
   permuted common prefixes which neighbours share ``length`` bytes: these are equal strings, and each gets the
   least document of its group.
4. Parts get back, for their segments, the ranges whose strings have a smaller document than some of theirs, and
   cut them from the texts.

Hashes only bring strings together; segments that are taken as one have been compared byte by byte.
Copies meet as one segment a part, so a group of copies of any size costs no more than its parts; texts are
shuffled once (the parts' exchange is reused by the three steps that read it).

Defined results: null or empty texts have no bytes; rows with one ``doc_id`` do not remove each other's bytes; a
row without ``doc_id`` removes nothing and keeps everything; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm.suffixes import shared_prefix, suffix_array
from wayfare.llm.text import _BYTE, _MUL, U64, _powers, chunks, mix, small_batches, utf8

GRAM = 20
_SPREAD = U64(0x5851F42D4C957F2D)
#: Bits of an anchor that are sent: they only have to tell most anchors of one bucket apart, since chance finds cost time alone.
TAG = 40
#: Bytes of text in a part.
PART_BYTES = 6 << 20
#: Bytes of text for each shard; its segments are a fraction of them.
SHARD_BYTES = 4 << 20
#: A shard's segments are sorted in so many piles: arrays of about a megabyte of text are sorted faster than longer ones.
PILES = 8
#: An anchor with so many different segments in a part is counted; one with more than HOT of them in all parts is hot: its
#: strings are dealt to shards one by one, each by its own hash, and not as segments by the anchor.
CROWD, HOT = 8, 20_000
#: The longest segment, in strings: runs of one anchor are cut there (neighbouring segments overlap by length - 1 bytes).
SEGMENT = 4096


class Strings:
    """The anchors of all ``length``-byte strings of a chunk of texts, as runs of neighbours with one anchor."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int):
        n, gram = len(data), min(GRAM, length)
        p, inverse = _powers(n + 1)
        self.total = np.concatenate([[U64(0)], np.cumsum(_BYTE[data] * p[:n], dtype=np.uint64)])
        self.inverse = inverse
        sizes = np.diff(offsets)
        count = np.maximum(sizes - length + 1, 0)
        self.count = count
        if n < length or not count.sum():
            self.anchor, self.start, self.stop, self.doc = np.empty(0, np.uint64), *(np.empty(0, np.int64),) * 3
            return
        least = mix((self.total[gram:] - self.total[:-gram]) * inverse[: n - gram + 1])
        width, done = length - gram + 1, 1
        while done * 2 <= width:
            least = np.minimum(least[: len(least) - done], least[done:])
            done *= 2
        if done < width:
            least = np.minimum(least[: len(least) - (width - done)], least[width - done :])
        change = np.ones(n - length + 1, bool)
        change[1:] = least[1:] != least[:-1]
        change[offsets[:-1][count > 0]] = True
        inside = np.zeros(n + 1, np.int8)
        inside[offsets[:-1][count > 0]] += 1
        stops = (offsets[:-1] + count)[count > 0]
        inside[stops] -= 1
        edge = np.union1d(np.flatnonzero(change), stops[stops < n - length + 1])
        on = np.cumsum(inside)[edge] > 0
        stop = np.append(edge[1:], n - length + 1)
        start, stop = edge[on], stop[on]
        pieces = -(-(stop - start) // SEGMENT)
        if (pieces > 1).any():
            k = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start, stop = np.repeat(start, pieces) + k * SEGMENT, np.repeat(stop, pieces)
            stop = np.minimum(stop, start + SEGMENT)
        self.start, self.stop, self.anchor = start, stop, least[start]
        self.doc = np.searchsorted(offsets, start, "right") - 1

    def prints(self, length: int) -> np.ndarray:
        """Hashes of the runs' bytes."""
        return self.ranges(self.start, self.stop + length - 1)

    def ranges(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hashes of byte ranges."""
        return mix((self.total[b] - self.total[a]) * self.inverse[a] + (b - a).astype(np.uint64) * _MUL)


def _ordered(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, offsets and doc_ids of a part in the order of doc_id and text, and which ids are not null; null ids are the last."""
    table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    data, offsets = utf8(table.column("text"))
    ids = table.column("doc_id")
    return data, offsets, ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy()


def _packed(key: str, bucket: np.ndarray, buckets: int, part: int, *columns: tuple) -> pa.Table:
    """One row a bucket; each column (values, encoder) as the encoded values of the bucket."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    some = np.flatnonzero(np.diff(cuts))
    sets = {f"c{i}": (c[order], pack) for i, (c, pack) in enumerate(columns)}
    parts = {n: pa.array([pack(c[cuts[k] : cuts[k + 1]]) for k in some], pa.binary()) for n, (c, pack) in sets.items()}
    return pa.table({key: pa.array(some, pa.int64()), "part": pa.array(np.full(len(some), part), pa.int64()), **parts})


def _blob(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _planes(values: np.ndarray, n_bytes: int = 8) -> bytes:
    """The low bytes of 64-bit numbers, first all lowest bytes, then all next ones: what is alike lies together and packs well."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8)[:, :n_bytes].T.tobytes()


def _numbers(parts: list[bytes], n_bytes: int = 8) -> list[np.ndarray]:
    """The numbers of each of many ``_planes``."""
    out = []
    for raw in parts:
        n = len(raw) // n_bytes
        v = np.zeros((n, 8), np.uint8)
        v[:, :n_bytes] = np.frombuffer(raw, np.uint8).reshape(n_bytes, n).T
        out.append(v.reshape(-1).view(np.uint64))
    return out


def _anchors(length: int, buckets: int, crowd: int):
    def anchors(table: pa.Table) -> pa.Table:
        data, offsets, ids, known = _ordered(table)
        values, docs, prints = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
        for a, b in chunks(offsets):
            s = Strings(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], length)
            ok = known[a + s.doc]
            values.append(s.anchor[ok])
            docs.append(ids[a + s.doc[ok]])
            prints.append(s.prints(length)[ok])
        v, d, p = (np.concatenate(x) for x in (values, docs, prints))
        order = np.argsort(v)
        v, d, p = v[order], d[order], p[order]
        first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]])) if len(v) else np.empty(0, np.int64)
        twice = np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first) if len(v) else np.zeros(0, bool)
        count = np.diff(np.append(first, len(v)))
        for k in np.flatnonzero(count >= crowd).tolist():  # of anchors that many places have: how many segments differ
            count[k] = len(np.unique(p[first[k] : first[k] + count[k]]))
        tag, bits = lambda x: _planes(x >> U64(64 - TAG), TAG // 8), lambda x: np.packbits(x).tobytes()

        def crowds(x: np.ndarray) -> bytes:
            some = np.flatnonzero(x >= crowd)
            return np.stack([some, x[some]]).astype(np.int32).tobytes()

        return _packed("bucket", (mix(v[first]) % U64(buckets)).astype(np.int64), buckets, table.column("part")[0].as_py(), (v[first], tag), (twice, bits), (count, crowds))

    return anchors


def _shared(most: int):
    def shared(table: pa.Table) -> pa.Table:
        """The anchors of a bucket that two documents have, for each part that has them (as tags): c0, and of these the hot ones: c1."""
        parts = _numbers(table.column("c0").to_pylist(), TAG // 8)
        v = np.concatenate(parts)
        order = np.sort(v)
        again = order[1:][order[1:] == order[:-1]]
        twice = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8))[: len(p)] for x, p in zip(table.column("c1").to_pylist(), parts)])
        both = np.union1d(again, v[twice > 0])
        crowds = [np.frombuffer(x, np.int32).reshape(2, -1) for x in table.column("c2").to_pylist()]
        tags, which = np.unique(np.concatenate([p[c[0]] for p, c in zip(parts, crowds)]), return_inverse=True)
        hot = np.intersect1d(tags[np.bincount(which, np.concatenate([c[1] for c in crowds])) > most], both)
        packed = lambda keys: pa.array([_planes(p[_member(p, keys)], TAG // 8) for p in parts], pa.binary())
        out = pa.table({"part": table.column("part").combine_chunks(), "c0": packed(both), "c1": packed(hot)})
        return out.filter(pa.compute.greater(pa.compute.binary_length(out.column("c0")), 0))

    return shared


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (size[0] of them), start[1], ..."""
    return np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)


def byte_prints(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges, as ``Strings`` gives them."""
    p, inverse = _powers(len(data) + 1)
    total = np.concatenate([[U64(0)], np.cumsum(_BYTE[data] * p[: len(data)], dtype=np.uint64)])
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64) * _MUL)


def _member(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
    return keys[at] == values


def _same_bytes(data: np.ndarray, start: np.ndarray, size: np.ndarray, first: np.ndarray, order: np.ndarray) -> None:
    """Ranges of one hash (``order``, in runs from ``first`` on) must be equal byte by byte."""
    run = np.diff(np.append(first, len(order)))
    one, other = np.repeat(order[first], run - 1), np.delete(order, first)
    k = 0
    ends = np.concatenate([[0], np.cumsum(size[other])])
    while k < len(other):
        stop = max(k + 1, int(np.searchsorted(ends, ends[k] + (1 << 20), "right")) - 1)
        a, b = one[k:stop], other[k:stop]
        if (size[a] != size[b]).any() or (data[_ranges(start[a], size[a])] != data[_ranges(start[b], size[b])]).any():
            raise ValueError("two different strings have one hash: nothing is removed on the word of a hash alone")
        k = stop


def _grouped(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by print, and where each group begins in it."""
    order = np.argsort(prints, kind="stable")
    p = prints[order]
    return order, np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]])) if len(p) else np.empty(0, np.int64)


def _segments(length: int, shards: int):
    def segments(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["shard", "part", *(f"c{i}" for i in range(4)), "bytes"]
        none = pa.table({n: pa.array([], pa.int64() if k < 2 else pa.binary()) for k, n in enumerate(names)})
        if not left.num_rows or not right.num_rows:
            return none
        data, offsets, ids, known = _ordered(left)
        keys, hot_keys = (np.sort(np.concatenate(_numbers(right.column(c).to_pylist(), TAG // 8))) for c in ("c0", "c1"))
        found = []
        for a, b in chunks(offsets):
            s = Strings(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], length)
            tags = s.anchor >> U64(64 - TAG)
            k = np.flatnonzero(_member(tags, keys) & known[a + s.doc])
            hot = _member(tags[k], hot_keys)
            plain, many = k[~hot], k[hot]
            found.append((s.prints(length)[plain], mix(s.anchor[plain] ^ _SPREAD), s.start[plain] + offsets[a], (s.stop - s.start)[plain] + length - 1, ids[a + s.doc[plain]], np.zeros(len(plain), np.uint64)))
            if len(many):
                n = (s.stop - s.start)[many]
                at = _ranges(s.start[many], n)
                own = s.ranges(at, at + length)
                found.append((own, own, at + offsets[a], np.full(len(at), length), np.repeat(ids[a + s.doc[many]], n), np.ones(len(at), np.uint64)))
        print_, spread, start, size, doc, hot = (np.concatenate(x) for x in zip(*found))
        if not len(print_):
            return none
        order, first = _grouped(print_)
        _same_bytes(data, start, size, first, order)
        one = order[first]
        low, high = np.minimum.reduceat(doc[order], first), np.maximum.reduceat(doc[order], first)
        shard = (spread[one] % U64(shards)).astype(np.int64)
        pile = (spread[one] // U64(shards) % U64(PILES)) << U64(1) | hot[one]
        table = _packed("shard", shard, shards, left.column("part")[0].as_py(), (size[one], lambda x: _planes(x, 2)), (low, _planes), (high, _planes), (pile, lambda x: _planes(x, 1)))
        by = np.argsort(shard, kind="stable")
        n = size[one][by]
        ends = np.cumsum(n)
        joined, cuts = data[_ranges(start[one][by], n)], np.concatenate([[0], ends])
        edges = np.searchsorted(shard[by], np.append(np.unique(shard), shards))
        return table.append_column("bytes", pa.array([joined[cuts[edges[k]] : cuts[edges[k + 1]]].tobytes() for k in range(len(edges) - 1)], pa.binary()))

    return segments


def earliest(text: np.ndarray, sizes: np.ndarray, low: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of the joined segments: the least document that has the string starting there, and whether a whole string does."""
    n, begin = len(text), np.cumsum(sizes) - sizes
    # a separator below all bytes follows each segment, and the end symbol the last
    joined = np.zeros(n + len(sizes) + 1, np.int64)
    at = np.arange(n) + np.repeat(np.arange(len(sizes)), sizes)
    joined[at] = text.astype(np.int64) + 2
    joined[(begin + sizes + np.arange(len(sizes)))] = 1
    sa = suffix_array(joined, 258)
    padded = np.zeros(len(joined) + length + 16, np.uint8)
    padded[at] = text
    seg = np.repeat(np.arange(len(sizes)), sizes + 1)
    left = np.zeros(len(joined), np.int64)
    left[: len(seg)] = (begin + sizes + np.arange(len(sizes)))[seg] - np.arange(len(seg))
    lcp = shared_prefix(padded, sa, length, left >= length)
    before = np.flatnonzero(left[sa] >= length)
    own = sa[before]  # suffixes that hold a whole string, in order; equal strings are neighbours
    group = np.ones(len(own), bool)
    # between two of them there may be only suffixes that do not share ``length`` bytes with either
    group[1:] = (lcp[own[1:]] < length) | (np.diff(before) > 1)
    first = np.flatnonzero(group)
    out, whole = np.zeros(n, np.int64), np.zeros(n, bool)
    if len(own):
        least = np.minimum.reduceat(low[seg[own]], first)
        out[own - seg[own]] = np.repeat(least, np.diff(np.append(first, len(own))))
        whole[own - seg[own]] = True
    return out, whole


def _found(sizes: np.ndarray, low: np.ndarray, high: np.ndarray, text: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """The prints of segments (joined in ``text``), and the ranges of their strings with a smaller document than some of theirs: segment, first, stop, document."""
    begin = np.cumsum(sizes) - sizes
    prints = byte_prints(text, begin, begin + sizes)
    order, first = _grouped(prints)
    _same_bytes(text, begin, sizes, first, order)
    which = np.empty(len(order), np.int64)
    which[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
    one = order[first]
    least = np.minimum.reduceat(low[order], first)
    n = sizes[one]
    starts = np.cumsum(n) - n
    early, whole = earliest(text[_ranges(begin[one], n)], n, least, length)
    # runs of strings with one earliest document, by segment
    change = np.ones(len(early), bool)
    change[1:] = (early[1:] != early[:-1]) | (whole[1:] != whole[:-1])
    change[starts] = True
    a = np.flatnonzero(change)
    b = np.append(a[1:], len(early))
    seg = np.searchsorted(starts, a, "right") - 1
    some = whole[a]
    a, b, seg, doc = a[some] - starts[seg[some]], b[some] - starts[seg[some]], seg[some], early[a[some]]
    cut = np.searchsorted(seg, np.arange(len(one) + 1))
    runs = cut[which + 1] - cut[which]
    k = _ranges(cut[which], runs)
    entry = np.repeat(np.arange(len(prints)), runs)
    good = doc[k] < high[entry]
    k, entry = k[good], entry[good]
    return prints, entry, a[k], b[k], doc[k]


def _sorted_shard(length: int):
    def shard(table: pa.Table) -> pa.Table:
        sizes = np.concatenate(_numbers(table.column("c0").to_pylist(), 2)).astype(np.int64)
        low, high = (np.concatenate(_numbers(table.column(c).to_pylist())).view(np.int64) for c in ("c1", "c2"))
        pile = np.concatenate(_numbers(table.column("c3").to_pylist(), 1))
        text = _blob(table.column("bytes"), np.uint8)
        counts = [len(x) for x in table.column("c3").to_pylist()]
        part = np.repeat(table.column("part").to_numpy(), counts)
        begin = np.cumsum(sizes) - sizes
        found = []
        for own in np.unique(pile):  # equal strings are in one pile
            at = np.flatnonzero(pile == own)
            prints, entry, *ranges = _found(sizes[at], low[at], high[at], text[_ranges(begin[at], sizes[at])], length)
            found.append((part[at[entry]], prints[entry], *ranges, np.full(len(entry), own & U64(1))))
        part, prints, a, b, doc, hot = (np.concatenate(c) for c in zip(*found))
        names, back = np.unique(part, return_inverse=True)
        two = lambda x: _planes(x, 2)
        out = _packed("at", back, len(names), 0, (prints, bytes), (a, two), (b, two), (doc, _planes), (hot, lambda x: _planes(x, 1)))
        return out.set_column(1, "part", pa.array(names, pa.int64())).drop_columns(["at"])

    return shard


def _cut(length: int):
    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        if not left.num_rows:
            return pa.table({n: pa.array([], pa.string() if n == "kept_sha256" else pa.int64()) for n in names})
        data, offsets, ids, known = _ordered(left)
        prints = _blob(right.column("c0"), np.uint64)
        a0, b0, doc0, hot0 = (np.concatenate([np.empty(0, np.uint64), *_numbers(right.column(c).to_pylist(), w)]).view(np.int64) for c, w in (("c1", 2), ("c2", 2), ("c3", 8), ("c4", 1)))
        # ranges of segments, and those of hot anchors' strings
        ranges = []
        for own in (hot0 == 0, hot0 == 1):
            order = np.flatnonzero(own)
            order = order[np.argsort(prints[order])]
            ranges.append((prints[order], a0[order], b0[order], doc0[order]))
        out = []
        for a, b in chunks(offsets):
            own, cuts = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            gone = np.zeros(len(own) + 1, np.int64)
            s = Strings(own, cuts, length) if len(prints) else None
            for hot, (keys, first, stop, earlier) in enumerate(ranges):
                if not len(keys):
                    continue
                at = s.start
                if hot:
                    at = _ranges(cuts[:-1], s.count)
                mine = s.ranges(at, at + length) if hot else s.prints(length)
                hit = np.flatnonzero(_member(mine, keys))
                lo, hi = np.searchsorted(keys, mine[hit]), np.searchsorted(keys, mine[hit], "right")
                k, at = _ranges(lo, hi - lo), np.repeat(at[hit], hi - lo)
                doc = a + np.searchsorted(cuts, at, "right") - 1
                later = (earlier[k] < ids[doc]) & known[doc]
                k, at = k[later], at[later]
                np.add.at(gone, at + first[k], 1)
                np.add.at(gone, at + stop[k] + length - 1, -1)
            mask = np.cumsum(gone)[:-1] > 0
            for i in range(b - a):
                m, x = mask[cuts[i] : cuts[i + 1]], own[cuts[i] : cuts[i + 1]]
                n = int(m.sum())
                spans = int(m[:1].sum() + (m[1:] & ~m[:-1]).sum()) if n else 0
                out.append((int(ids[a + i]) if known[a + i] else None, len(x), n, spans, hashlib.sha256((x[~m] if n else x).tobytes()).hexdigest()))
        return pa.table({n: pa.array([r[k] for r in out], pa.string() if n == "kept_sha256" else pa.int64()) for k, n in enumerate(names)})

    return cut


def dedup_substrings(docs: DataFrame, length: int = 50, crowd: int = CROWD, hot: int = HOT) -> DataFrame:
    """For each document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (``crowd`` and ``hot``: see CROWD, HOT; results are the same)."""
    spark = docs.sparkSession
    small_batches(spark)
    size = docs.agg(F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0))).first()[0]
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    parts, shards = max(tasks, size // PART_BYTES), max(tasks, size // SHARD_BYTES)
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)))
    four = ", ".join(f"c{i} binary" for i in range(4))
    anchors = rows.groupBy("part").applyInArrow(_anchors(length, parts, crowd), "bucket long, part long, c0 binary, c1 binary, c2 binary")
    shared = anchors.groupBy("bucket").applyInArrow(_shared(hot), "part long, c0 binary, c1 binary")
    segments = rows.groupBy("part").cogroup(shared.groupBy("part")).applyInArrow(_segments(length, shards), f"shard long, part long, {four}, bytes binary")
    early = segments.groupBy("shard").applyInArrow(_sorted_shard(length), f"part long, {four}, c4 binary")
    return rows.groupBy("part").cogroup(early.groupBy("part")).applyInArrow(_cut(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
