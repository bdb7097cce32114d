"""Benchmark decontamination by a prefix-filtered set join.

An item's windows are ``window`` consecutive words (an item of fewer words is one window).  A window is a set
of ``shingle``-word shingles; the shingles are ordered by how many documents have them.  A document holds a
window only if it holds all of its shingles, so the prefix that has to be joined is the rarest one.  A place
where a document has that shingle gives, by its position in the window, the only place the window can start;
it must lie inside the document (length and position bound), and the window is then verified word by word.

The items are taken in blocks of bounded size.  Each block goes to all tasks; documents are read once for the
counts and once for the join of each block, and are never shuffled.

Defined results: null or empty texts have no words and hit nothing; an item without words has no window; a
null ``item_id`` is the id ''; items that repeat an id count once; repeated documents each get their row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm.text import ALNUM, U64, Words, by_document, chunks, small_batches, utf8
from wayfare.plans.scratch import stored


class Block:
    """The windows of some items: their words' hashes, the item they are of, and their shingles."""

    def __init__(self, ids: list[str], texts: list[str | None], window: int, shingle: int):
        data, offsets = utf8(pa.array(texts, pa.string()))
        w = Words(data, offsets, ALNUM)
        starts, items, sizes = [], [], []
        for i in np.flatnonzero(w.count):
            n = max(1, w.count[i] - window + 1)
            starts.append(np.arange(w.first[i], w.first[i] + n))
            items.append(np.full(n, i))
            sizes.append(np.full(n, min(window, w.count[i])))
        join = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
        self.ids, self.hash = ids, w.hash
        self.start, self.item, self.size = join(starts), join(items), join(sizes)
        #: a shingle is of min(shingle, size) words: sizes under ``shingle`` occur for short items only
        self.unit = np.minimum(self.size, shingle)
        self.units = sorted(set(self.unit.tolist()))
        self.runs = {u: w.runs(u) for u in self.units}
        self.shingles = {u: np.unique(self.runs[u][self._places(u)]) for u in self.units}

    def _places(self, u: int) -> np.ndarray:
        """Where shingles of ``u`` words of the block's windows begin."""
        start, n = self.start[self.unit == u], self.size[self.unit == u] - u + 1
        inside = np.zeros(len(self.hash) + 1, np.int64)
        np.add.at(inside, start, 1)
        np.add.at(inside, start + n, -1)
        return np.flatnonzero(np.cumsum(inside) > 0)

    def prefixes(self, counts: dict[int, np.ndarray]) -> None:
        """Choose each window's rarest shingle (ties: the least hash, then the first place); ``counts`` follow ``shingles``."""
        self.token, self.at = np.zeros(len(self.start), np.uint64), np.zeros(len(self.start), np.int64)
        for u in self.units:
            own = np.flatnonzero(self.unit == u)
            for part in np.array_split(own, len(own) // 50_000 + 1):
                n = self.size[part] - u + 1
                window = np.repeat(np.arange(len(part)), n)
                place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                have = self.runs[u][self.start[part][window] + place]
                rare = counts[u][np.searchsorted(self.shingles[u], have)]
                order = np.lexsort((place, have, rare, window))
                best = order[np.cumsum(n) - n]
                self.token[part], self.at[part] = have[best], place[best]
        order = np.lexsort((self.token, self.unit))
        for name in ("start", "item", "size", "unit", "token", "at"):
            setattr(self, name, getattr(self, name)[order])
        del self.runs, self.shingles


def nothing(window: int, shingle: int) -> Block:
    """A block without windows."""
    block = Block([], [], window, shingle)
    block.prefixes({})
    return block


class _Finder:
    """Which of many hashes are in a fixed set: a bit table first, then a binary search."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = np.zeros(1 << 22, bool)
        self.bits[keys >> U64(42)] = True

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(self.bits[hashes >> U64(42)])
        pos = np.searchsorted(self.keys, hashes[at])
        return at[self.keys[np.minimum(pos, len(self.keys) - 1)] == hashes[at]] if len(self.keys) else at[:0]


def _counts(spark, docs: DataFrame, block: Block) -> dict[int, np.ndarray]:
    """In how many documents each shingle of the block occurs."""
    shingles = block.shingles

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = {u: _Finder(s) for u, s in shingles.items()}
        total = {u: np.zeros(len(s), np.int64) for u, s in shingles.items()}
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for a, b in chunks(offsets):
                w = Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], ALNUM)
                for u, keys in shingles.items():
                    run = w.runs(u)
                    at = find[u](run)
                    doc = np.searchsorted(w.first, at, "right") - 1
                    ok = at + u <= w.first[doc + 1]
                    pair = np.unique(doc[ok] * len(keys) + np.searchsorted(keys, run[at[ok]]))
                    np.add.at(total[u], pair % len(keys), 1)
        for u, t in total.items():
            k = np.flatnonzero(t)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), u, np.int32)), pa.array(k), pa.array(t[k])], ["unit", "k", "n"])

    out = {u: np.zeros(len(s), np.int64) for u, s in shingles.items()}
    rows = docs.select("text").mapInArrow(count, "unit int, k long, n long").groupBy("unit", "k").agg(F.sum("n").alias("n"))
    for u, k, n in rows.collect():  # at most one row for each shingle of the block
        out[u][k] = n
    return out


def find(w: Words, b: Block, tokens: dict[int, tuple[_Finder, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(word where a window of the block occurs, index of that window), for a chunk of documents."""
    starts, windows = [], []
    for u, (finder, base) in tokens.items():
        run = w.runs(u)
        if not len(run) or not len(finder.keys):
            continue
        at = finder(run)
        keys = b.token[b.unit == u]
        lo, hi = np.searchsorted(keys, run[at]), np.searchsorted(keys, run[at], "right")
        n = hi - lo
        place = np.repeat(at, n)
        k = base + np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        doc = np.searchsorted(w.first, place, "right") - 1
        start = place - b.at[k]
        ok = (start >= w.first[doc]) & (start + b.size[k] <= w.first[doc + 1])
        start, k = start[ok], k[ok]
        for j in range(int(b.size.max()) if len(b.size) else 0):
            inside = j < b.size[k]
            same = ~inside
            same[inside] = w.hash[start[inside] + j] == b.hash[b.start[k[inside]] + j]
            start, k = start[same], k[same]
        starts.append(start)
        windows.append(k)
    join = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
    return join(starts), join(windows)


def _spans(docs: DataFrame, block: Block, keep_all: bool) -> DataFrame:
    """Each document with its number of words, the word ranges that are hit (start, end, start, end, ...) and the items."""

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = {}
        for u in block.units:
            at = np.flatnonzero(block.unit == u)
            tokens[u] = (_Finder(np.unique(block.token[at])), int(at[0]))
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            n_words, spans, items = [], [], []
            for a, b in chunks(offsets):
                w = Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], ALNUM)
                start, k = find(w, block, tokens)
                cover = np.zeros(len(w.hash) + 1, np.int64)
                np.add.at(cover, start, 1)
                np.add.at(cover, start + block.size[k], -1)
                hit = np.diff(np.concatenate([[0], (np.cumsum(cover) > 0)[:-1], [0]]).astype(np.int8))
                n_words += w.count.tolist()
                own_spans, own_items = [[] for _ in range(b - a)], [set() for _ in range(b - a)]
                for s, e in zip(np.flatnonzero(hit == 1).tolist(), np.flatnonzero(hit == -1).tolist()):
                    while s < e:  # a run of hit words may reach over the end of a document
                        d = int(np.searchsorted(w.first, s, "right") - 1)
                        stop = min(e, int(w.first[d + 1]))
                        own_spans[d] += [s - int(w.first[d]), stop - int(w.first[d])]
                        s = stop
                pair = np.unique((np.searchsorted(w.first, start, "right") - 1) * len(block.ids) + block.item[k])
                for d, i in zip((pair // max(1, len(block.ids))).tolist(), (pair % max(1, len(block.ids))).tolist()):
                    own_items[d].add(block.ids[i])
                spans += own_spans
                items += [sorted(x) for x in own_items]
            cols = [batch.column(0), batch.column(2), pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))]
            out = pa.RecordBatch.from_arrays(cols, ["doc_id", "row_key", "n_words", "spans", "items"])
            yield out if keep_all else out.filter(pa.array([bool(x) for x in spans], pa.bool_()))

    return docs.select("doc_id", F.col("text").cast("string"), "row_key").mapInArrow(match, "doc_id long, row_key long, n_words long, spans array<long>, items array<string>")


def _digest(rows: DataFrame) -> DataFrame:
    """n_hit, n_items, items_sha256 and contaminated from spans and items (both may be of several blocks)."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = batch.to_pydict()
            hit = []
            for spans in d["spans"]:
                end = n = 0
                for s, e in sorted(zip(spans[::2], spans[1::2])):
                    n += max(0, e - max(s, end))
                    end = max(end, e)
                hit.append(n)
            items = [sorted(set(x)) for x in d["items"]]
            cols = [batch.column(0), batch.column(2), pa.array(hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items])]
            cols.insert(1, batch.column(1))
            cols.append(pa.array([h > 0 and 20 * h >= n for h, n in zip(hit, d["n_words"])], pa.bool_()))
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "row_key", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return rows.mapInArrow(digest, "doc_id long, row_key long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 13, shingle: int = 5, block_bytes: int = 8 << 20) -> DataFrame:
    """For each document: doc_id, row_key (xxhash64 of its text), n_words, n_hit, n_items, items_sha256 and
    contaminated (a twentieth of the words or more is hit)."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("row_key"))
    items = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("string").alias("text"))
    items = stored(items.distinct(), "items")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_blocks = -(-size // block_bytes) or 1
    found = []
    for k in range(n_blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == k).select("item_id", "text").collect()  # block_bytes on average, whatever ids repeat
        block = Block([r[0] for r in part], [r[1] for r in part], window, shingle)
        block.prefixes(_counts(spark, docs, block))
        found.append(_spans(docs, block, keep_all=n_blocks == 1) if n_blocks == 1 else stored(_spans(docs, block, keep_all=False), "spans"))
    if n_blocks == 1:
        return _digest(found[0])
    hits = found[0]
    for more in found[1:]:
        hits = hits.unionByName(more)
    hits = hits.dropDuplicates().groupBy("doc_id", "row_key").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
    words = _spans(docs, nothing(window, shingle), keep_all=True).select("doc_id", "row_key", "n_words")
    joined = words.alias("w").join(hits.alias("h"), F.expr("w.doc_id <=> h.doc_id and w.row_key = h.row_key"), "left")
    none = F.array().cast("array<long>"), F.array().cast("array<string>")
    return _digest(joined.select("w.doc_id", "w.row_key", "w.n_words", F.coalesce("h.spans", none[0]).alias("spans"), F.coalesce("h.items", none[1]).alias("items")))


def without_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    bad = decontaminate(docs, items).where("contaminated").select("doc_id", "row_key").distinct()
    same = F.expr("d.doc_id <=> b.doc_id and xxhash64(cast(d.text as string)) = b.row_key")
    return docs.alias("d").join(bad.alias("b"), same, "left_anti")
