"""Near duplicates by MinHash signatures and a multi-index Hamming join.

A document's set is its distinct 5-word shingles; documents are linked when 100 * |intersection| >= 75 * |union|.

1. Texts are read once: set size, a 128-bit digest of the set, a signature of CHUNKS * WIDTH MinHash values of b
   bits.  Documents of equal sets are one class, stood for by its least ``doc_id``.
2. Multi-index join: the signature is split into CHUNKS chunks.  Two signatures that differ in at most
   2 * CHUNKS - 1 places have, by the pigeonhole principle, a chunk with at most one error; so the keys of a chunk
   are its WIDTH subsets that leave one place out.  Every pair under that distance shares a key.
3. Within a key each class is paired only with the class in the middle of those that have the key, and each class
   keeps its nearest partners, so a group of any size gives a linear number of pairs.  Pairs are confirmed on full sets.
4. Exact completion for classes that share a key but are not yet connected: shingles are ordered by rarity
   (a fixed-size count sketch), and classes of different components that share a shingle of their prefixes
   are paired if both can still reach the needed overlap from there (prefix and positional bounds).  A link
   between two classes that are already connected adds nothing, and is not looked for.  Where many classes share
   a shingle they are compared by blocks, and paired only if the parities of their sets, which never differ in
   more places than the sets have items apart, allow a link: templates just under the threshold give no pairs.
5. Connected components of the links.

Nothing is capped; shuffles carry packed keys, not texts, but for the sets of classes that share a key.

Defined results: a null, empty or wordless text has an empty set, is linked with nothing and is kept; rows of one
``doc_id`` are one node (if their texts differ, the last of their sets in byte order speaks for it in steps 3 and 4); a row without ``doc_id`` has no component, and is kept; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from wayfare.llm.text import NOT_SPACE, U64, Words, chunks, gathered, mix, small_batches, utf8
from wayfare.operators.components import components
from wayfare.plans.scratch import stored

SHINGLE, SHARE = 5, 75
CHUNKS, WIDTH = 16, 5
PLACES = CHUNKS * WIDTH
_rng = np.random.default_rng(7)
_A = _rng.integers(0, 2**31, PLACES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 2**32, PLACES, dtype=np.uint32)
_SALT = mix(np.arange(1, CHUNKS * WIDTH + 1, dtype=np.uint64))
#: Sketches of one bit a place that differ in more places than this are of sets far below the threshold.
SKETCH = 24
#: Documents for each bucket of keys; a bucket's keys are in memory at once.
CLASSES = 4000
#: Classes whose keys a task makes at once, and how many of them with one key are paired at once.
GATHER, HOT = 16_000, 32
#: Rows of a bucket that are paired at once.
BLOCK = 1 << 14
#: Nearest partners of a class that are confirmed at once; the completion finds links of the others.
PARTNERS = 3
#: Classes that share a prefix shingle from which on they are compared by blocks, and about how many make a block.
CROWD, CROWD_BLOCK = 64, 1000
#: Bits of the table that tells which documents' sets are wanted, whatever the size of the input: 2 MB.
MARKS = 1 << 24
#: Counters of the rarity sketch, whatever the size of the input: 4 bytes each.
RARITY_BITS = 21


def needed(na: np.ndarray, nb: np.ndarray, share: int = SHARE) -> np.ndarray:
    """The least intersection with which sets of these sizes are linked: share / 100 of the union."""
    return -((-share * (na + nb)) // (100 + share))


def _sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each document, sorted, and their bounds."""
    h, bounds = Words(data, offsets, NOT_SPACE).shingles(SHINGLE)
    out = np.empty_like(h)
    sizes, n = np.zeros(len(bounds) - 1, np.int64), 0
    for i in range(len(sizes)):
        s = np.sort(h[bounds[i] : bounds[i + 1]])
        if len(s) > 1:
            s = s[np.concatenate([[True], s[1:] != s[:-1]])]
        out[n : n + len(s)] = s
        sizes[i] = len(s)
        n += len(s)
    return out[:n], np.concatenate([[0], np.cumsum(sizes)])


def _signatures(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """16 bits of the least of each of PLACES hash functions over each set that is not empty; zeros for the others."""
    n = np.diff(bounds)
    out = np.zeros((len(n), PLACES), np.uint16)
    full = np.flatnonzero(n)
    if len(full):
        x, starts = (h >> U64(32)).astype(np.uint32), bounds[:-1][full]
        for k in range(PLACES):
            least = np.minimum.reduceat(x * _A[k] + _B[k], starts)
            out[full, k] = (least * np.uint32(0x9E3779B1)) >> np.uint32(16)
    return out


def features(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, digest of the set (a, b), signature: one row a document."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for a, b in chunks(offsets):
                h, bounds = _sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                sig, n = _signatures(h, bounds), np.diff(bounds)
                sums = []
                for salt in (U64(0x243F6A8885A308D3), U64(0x13198A2E03707344)):
                    total = np.concatenate([[U64(0)], np.cumsum(mix(h ^ salt), dtype=np.uint64)])
                    sums.append(pa.array((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64)))
                cols = [batch.column(0).slice(a, b - a), pa.array(n), *sums, pa.array([s.tobytes() for s in sig], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n", "a", "b", "sig"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(rows, "doc_id long, n long, a long, b long, sig binary")


def _packed(bucket: np.ndarray, buckets: int, *columns: np.ndarray) -> pa.RecordBatch:
    """One row a bucket, each column as the bytes of its values there."""
    order = np.argsort(bucket.astype(np.uint16 if buckets <= 1 << 16 else np.int64), kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    some = np.flatnonzero(np.diff(cuts))
    parts = [pa.array([c[cuts[k] : cuts[k + 1]].tobytes() for k in some], pa.binary()) for c in (c[order] for c in columns)]
    return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *parts], ["bucket", *(f"c{i}" for i in range(len(columns)))])


def _unpacked(table: pa.Table, *types: type) -> list[np.ndarray]:
    return [np.frombuffer(b"".join(table.column(f"c{i}").to_pylist()), t) for i, t in enumerate(types)]


def _runs(keys: np.ndarray, least: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by key, and where runs of ``least`` or more equal keys begin and end in it."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    edge = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.empty(0, np.int64)
    end = np.append(edge[1:], len(k))
    some = end - edge >= least
    return order, edge[some], end[some]


def _majority(sketch: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The majority of each bit over each run of sketches."""
    total = np.zeros((len(first), 64), np.int32)
    for k in range(0, len(sketch), BLOCK):  # a run that is longer than BLOCK is a block of its own, and counted by parts
        bits = np.unpackbits(sketch[k : k + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += np.add.reduceat(bits, first if k == 0 else first[:1], axis=0, dtype=np.int32)
    return np.packbits(2 * total > size[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]


def _starred(key: np.ndarray, ids: np.ndarray, n: np.ndarray, sketch: np.ndarray, least: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each key of ``least`` or more classes: the class nearest to the middle of them, paired with each of the others.

    The middle is the majority of each bit of their sketches; of edited copies of one text it is close to the
    text itself, with which more of them are linked than with each other.  Returns (x, p, far) of the pairs, where
    far is 99 if the pair cannot be linked, and which rows are left if those of such keys but their heads go.
    """
    by = np.lexsort((ids, n))
    key, ids, n, sketch = key[by], ids[by], n[by].astype(np.int64), sketch[by]
    order, a, b = _runs(key, least)
    left = np.ones(len(key), bool)
    out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32))]
    begun = np.concatenate([[0], np.cumsum(b - a)])
    k = 0
    while k < len(a):  # blocks of whole runs
        stop = max(k + 1, int(np.searchsorted(begun, begun[k] + BLOCK, "right")) - 1)
        size = (b - a)[k:stop]
        first = begun[k:stop] - begun[k]
        at = order[np.repeat(a[k:stop] - first, size) + np.arange(size.sum())]
        off = np.bitwise_count(sketch[at] ^ np.repeat(_majority(sketch[at], first, size), size)).astype(np.int64)
        # ties: the smaller size, then the smaller id, as ordered above
        head = at[np.minimum.reduceat(off << 40 | np.arange(len(at)), first) & ((1 << 40) - 1)]
        left[at] = False
        left[head] = True
        head = np.repeat(head, size)
        ok = ids[at] != ids[head]
        at, head = at[ok], head[ok]
        far = np.bitwise_count(sketch[at] ^ sketch[head]).astype(np.int32)
        good = (far <= SKETCH) & (100 * np.minimum(n[head], n[at]) >= SHARE * np.maximum(n[head], n[at]))
        # a class with no partner that may reach the threshold still is a candidate of step 4
        out.append((ids[at], ids[head], np.where(good, far, 99).astype(np.int32)))
        k = stop
    x, p, far = (np.concatenate(c) for c in zip(*out))
    return x, p, far, by[left]


def _keys(classes: DataFrame, buckets: int) -> DataFrame:
    """The multi-index keys of each class, packed by bucket: key, id, size, sketch; and pairs: x, p, far.

    A bucket has keys of one chunk.  A key that HOT of GATHER classes or more have is starred at once, and only its head
    goes on: so a bucket gets few rows of each task for any key.
    """
    each = -(-buckets // CHUNKS)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, GATHER):
            ids, n = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int32)
            sig = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint16).reshape(len(ids), PLACES)
            sketch = np.zeros(len(ids), np.uint64)
            for k in range(64):
                sketch |= ((sig[:, k] >> 3) & 1).astype(np.uint64) << U64(k)
            ids, n, sketch = np.tile(ids, WIDTH), np.tile(n, WIDTH), np.tile(sketch, WIDTH)
            for c in range(CHUNKS):
                part = mix(sig[:, c * WIDTH : (c + 1) * WIDTH].astype(np.uint64) + (np.arange(c * WIDTH, (c + 1) * WIDTH, dtype=np.uint64) << U64(20)))
                total = part.sum(1, dtype=np.uint64)
                key = np.concatenate([mix(total - part[:, d] + _SALT[c * WIDTH + d]) for d in range(WIDTH)])
                x, p, far, left = _starred(key, ids, n, sketch, HOT)
                packed = _packed((key[left] % U64(each)).astype(np.int64), each, key[left], ids[left], n[left], sketch[left])
                pairs = _packed(np.arange(len(x)) * each // max(1, len(x)), each, x, p, far).rename_columns(["bucket", "x", "p", "far"])
                for some in (packed, pairs):
                    if some.num_rows:
                        bucket = pa.array(some.column(0).to_numpy() + np.int32(c * each))
                        have = dict(zip(some.schema.names, some.columns)) | {"bucket": bucket}
                        yield pa.RecordBatch.from_arrays([have.get(name, pa.nulls(some.num_rows, pa.binary())) for name in names], names)

    names = ["bucket", "c0", "c1", "c2", "c3", "x", "p", "far"]
    return classes.select("id", "n", "sig").mapInArrow(rows, "bucket int, " + ", ".join(f"{name} binary" for name in names[1:]))


def _stars(table: pa.Table) -> pa.Table:
    """The pairs of a bucket's keys, and those that batches have made, each once with its least distance."""
    got = [np.frombuffer(b"".join(v for v in table.column(c).to_pylist() if v), t) for c, t in (("x", np.int64), ("p", np.int64), ("far", np.int32))]
    own = table.filter(pa.compute.is_valid(table.column("c0")))
    x, p, far = (np.concatenate(c) for c in zip(got, _starred(*_unpacked(own, np.uint64, np.int64, np.int32, np.uint64))[:3]))
    order = np.lexsort((far, p, x))
    x, p, far = x[order], p[order], far[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (p[1:] != p[:-1])
    return pa.table({"x": x[new], "p": p[new], "far": far[new]})


def _confirmed(pairs: DataFrame, sets: DataFrame, parts: int) -> DataFrame:
    """The pairs (p, x) that are linked, by the intersection of their full sets.

    The set of x comes with each pair, that of p once for each of the shares into which its pairs are split.
    """
    pairs = pairs.withColumn("salt", F.pmod(F.xxhash64("x"), F.lit(64)))
    x = pairs.join(sets.select(F.col("id").alias("x"), "items"), "x").select("p", "salt", F.lit(1).alias("side"), "x", "items")
    p = pairs.select("p", "salt").distinct().join(sets.select(F.col("id").alias("p"), "items"), "p").select("p", "salt", F.lit(0).alias("side"), F.col("p").alias("x"), "items")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, None
        for batch in batches:
            ps, salts, sides, xs = (batch.column(k).to_pylist() for k in range(4))
            left, right = [], []
            for k in range(len(ps)):
                items = np.frombuffer(batch.column(4)[k].as_py(), np.uint64)
                if not sides[k]:
                    at, own = (ps[k], salts[k]), items
                    continue
                assert at == (ps[k], salts[k])
                small, large = (items, own) if len(items) < len(own) else (own, items)
                pos = np.searchsorted(large, small)
                both = int((large[np.minimum(pos, len(large) - 1)] == small).sum())
                if 100 * both >= SHARE * (len(items) + len(own) - both):
                    left.append(ps[k])
                    right.append(xs[k])
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["u", "v"])

    return p.unionByName(x).repartition(parts, "p", "salt").sortWithinPartitions("p", "salt", "side", "x").mapInArrow(rows, "u long, v long")


def _rarity(spark: SparkSession, sets: DataFrame) -> np.ndarray:
    """How many of the classes have a shingle, for shingles by RARITY_BITS bits of their hash: a table of one size for any input."""
    shift, parts = U64(64 - RARITY_BITS), 64
    each = (1 << RARITY_BITS) // parts

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << RARITY_BITS, np.uint32)
        for batch in batches:
            h = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint64)
            total += np.bincount((h >> shift).astype(np.int64), minlength=1 << RARITY_BITS).astype(np.uint32)
        some = np.flatnonzero(total)  # a task's counters that are not zero
        yield _packed(some // each, parts, (some % each).astype(np.uint32), total[some]).rename_columns(["part", "at", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(each, np.uint64)
        for at, x in zip(table.column("at").to_pylist(), table.column("counts").to_pylist()):
            total[np.frombuffer(at, np.uint32)] += np.frombuffer(x, np.uint32)
        return pa.table({"part": table.column("part")[:1], "counts": pa.array([np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()], pa.binary())})

    rows = sets.select("items").mapInArrow(count, "part int, at binary, counts binary").groupBy("part").applyInArrow(add, "part int, counts binary").collect()
    out = np.zeros((parts, each), np.uint32)
    for part, counts in rows:
        out[part] = np.frombuffer(counts, np.uint32)
    return out.reshape(-1)


def _prefixes(sets: DataFrame, rarity, buckets: int) -> DataFrame:
    """The prefix shingles of each class, rarest first, packed by bucket: shingle, id, size, place, component.

    A shingle in the prefixes of more than CROWD classes of a batch is told with two rows of size 0, the least and
    the largest component that have it; its own rows are of kind 1, and wait for the answer of its bucket.
    """
    shift = U64(64 - RARITY_BITS)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = rarity.value
        for batch in batches:
            token, ids, n, place, comp = [], [], [], [], []
            for k in range(batch.num_rows):
                items = np.frombuffer(batch.column(1)[k].as_py(), np.uint64)
                size = len(items)
                first = size - int(needed_own(size)) + 1
                order = np.lexsort((items, table[(items >> shift).astype(np.int64)]))[:first]
                token.append(items[order])
                ids.append(np.full(len(order), batch.column(0)[k].as_py(), np.int64))
                n.append(np.full(len(order), size, np.int32))
                place.append(np.arange(len(order), dtype=np.int32))
                comp.append(np.full(len(order), batch.column(2)[k].as_py(), np.int64))
            if not token:
                continue
            token, ids, n, place, comp = (np.concatenate(c) for c in (token, ids, n, place, comp))
            order, a, b = _runs(token, CROWD + 1)
            crowded = np.zeros(len(token), bool)
            told = []
            for s, e in zip(a.tolist(), b.tolist()):
                at = order[s:e]
                crowded[at] = True
                told += [(token[at[0]], comp[at].min()), (token[at[0]], comp[at].max())]
            named = np.array([t for t, _ in told], np.uint64), np.array([c for _, c in told], np.int64)
            none = np.zeros(len(told), np.int64)
            own = [c[~crowded] for c in (token, ids, n, place, comp)]
            told = [named[0], none, none.astype(np.int32), none.astype(np.int32), named[1]]
            for kind, columns in ((0, [np.concatenate(c) for c in zip(own, told)]), (1, [c[crowded] for c in (token, ids, n, place, comp)])):
                out = _packed((mix(columns[0]) % U64(buckets)).astype(np.int64), buckets, *columns)
                if out.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(out.num_rows, kind, np.int32)), *out.columns], ["kind", *out.schema.names])

    return sets.select("id", "items", "component").mapInArrow(rows, "kind int, bucket int, c0 binary, c1 binary, c2 binary, c3 binary, c4 binary")


def needed_own(n: int) -> int:
    """The least intersection of a set of n with any set that it is linked with."""
    return -((-SHARE * n) // 100)


def _reach(n: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The largest partner with which a set can reach the needed overlap if ``place`` of its rarest items aren't shared."""
    return ((100 + SHARE) * (n - place)) // SHARE - n


def _completed(table: pa.Table) -> pa.Table:
    """Kind 0: pairs (a, b) of different components that share a prefix shingle and pass the length and positional bounds.

    Of a shingle that more than CROWD classes share (or that a batch has told of) no pairs are made here: kind 1 are
    its classes (a; b is the component), for ``_crowds``, and kind 2 says that rows of kind 1 of the batches are of use.
    """
    token, ids, n, place, comp = _unpacked(table, np.uint64, np.int64, np.int32, np.int32, np.int64)
    n, place = n.astype(np.int64), place.astype(np.int64)
    order, a, b = _runs(token)
    comps = comp[order]
    edges = np.flatnonzero(comps[1:] != comps[:-1])  # only runs with a change of component can give pairs
    some = np.searchsorted(edges, b - 1) > np.searchsorted(edges, a)
    found, crowd, wanted = [np.empty((0, 2), np.int64)], [np.empty(0, np.int64)], []
    for s, e in zip(a[some].tolist(), b[some].tolist()):
        at = order[s:e]
        if (n[at] == 0).any():
            wanted.append(token[at[0]])
            crowd.append(at[n[at] > 0])
            continue
        while True:
            near = at[_reach(n[at], place[at]) >= n[at].min()] if len(at) else at
            if len(near) == len(at):
                break
            at = near
        if len(at) > CROWD:
            crowd.append(at)
            continue
        reach, size = _reach(n[at], place[at]), n[at]
        i, j = np.nonzero(np.triu((comp[at][:, None] != comp[at]) & (reach[:, None] >= size) & (reach >= size[:, None])))
        found.append(np.sort(np.stack([ids[at[i]], ids[at[j]]], 1), axis=1))
    pairs, at = np.concatenate(found), np.concatenate(crowd)
    order = np.lexsort((pairs[:, 1], pairs[:, 0]))
    pairs = pairs[order]
    new = np.ones(len(pairs), bool)
    new[1:] = (pairs[1:] != pairs[:-1]).any(1)
    pairs = pairs[new]
    m, w = len(pairs), len(wanted)
    pad = np.zeros(m, np.int64)
    cols = {
        "kind": np.repeat(np.array([0, 1, 2], np.int32), [m, len(at), w]),
        "token": np.concatenate([pad, token[at].view(np.int64), np.array(wanted, np.uint64).view(np.int64)]),
        "a": np.concatenate([pairs[:, 0], ids[at], np.zeros(w, np.int64)]),
        "b": np.concatenate([pairs[:, 1], comp[at], np.zeros(w, np.int64)]),
        "n": np.concatenate([pad, n[at], np.zeros(w, np.int64)]),
        "reach": np.concatenate([pad, _reach(n[at], place[at]), np.zeros(w, np.int64)]),
    }
    return pa.table(cols)


def parity(items: np.ndarray) -> bytes:
    """Which of a power of two of places, at least 4 for each item, hold an odd number of the items."""
    size = max(256, 1 << (4 * len(items) - 1).bit_length())
    return np.packbits(np.bincount((items & U64(size - 1)).astype(np.int64), minlength=size) & 1, bitorder="little").tobytes()


def _folded(bits: np.ndarray, width: int) -> np.ndarray:
    """Parities over fewer places: places that are equal modulo the new size are added."""
    while bits.shape[1] > width:
        bits = bits[:, : bits.shape[1] // 2] ^ bits[:, bits.shape[1] // 2 :]
    return bits


def _compared(table: pa.Table) -> pa.Table:
    """The pairs of a bucket's blocks that may be linked: in reach of each other, and their parities differ in no more
    places than linked sets of their sizes may have items in one of them only (so no link is lost)."""
    group, block, ids, comp, n, reach = (table.column(c).to_numpy() for c in ("g", "block", "a", "b", "n", "reach"))
    left, right = table.column("left").to_numpy(), table.column("right").to_numpy()
    order = np.lexsort((ids, block, right, left, group))
    key = np.stack([group, left, right], 1)[order]
    edge = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(1)])) if len(key) else np.empty(0, np.int64)
    found = [np.empty((0, 2), np.int64)]
    raw = table.column("bits").combine_chunks()
    for s, e in zip(edge.tolist(), [*edge[1:].tolist(), len(key)]):
        at = order[s:e]
        bits = [np.frombuffer(raw[k].as_py(), np.uint64) for k in at.tolist()]
        width = np.array([len(x) for x in bits])
        least = {w: _folded(np.stack([bits[k] for k in np.flatnonzero(width == w)]), w) for w in np.unique(width).tolist()}
        place = np.zeros(len(at), np.int64)
        for w in least:
            place[width == w] = np.arange((width == w).sum())
        ok = (comp[at][:, None] != comp[at]) & (reach[at][:, None] >= n[at]) & (reach[at] >= n[at][:, None])
        if left[at[0]] != right[at[0]]:
            ok &= (block[at] == left[at[0]])[:, None] & (block[at] == right[at[0]])
        else:
            ok = np.triu(ok)
        i, j = np.nonzero(ok)
        most = n[at[i]] + n[at[j]] - 2 * needed(n[at[i]], n[at[j]])
        for wi in least:
            for wj in least:
                some = np.flatnonzero((width[i] == wi) & (width[j] == wj))
                w = min(wi, wj)
                x, y = _folded(least[wi], w), _folded(least[wj], w)
                step = max(1, (1 << 19) // w)
                for k in range(0, len(some), step):
                    part = some[k : k + step]
                    far = np.bitwise_count(x[place[i[part]]] ^ y[place[j[part]]]).sum(1)
                    part = part[far <= most[part]]
                    found.append(np.sort(np.stack([ids[at[i[part]]], ids[at[j[part]]]], 1), axis=1))
    pairs = np.concatenate(found)
    return pa.table({"p": pairs[:, 0], "x": pairs[:, 1]})


def _crowds(rows: DataFrame, sets: DataFrame, parts: int) -> DataFrame:
    """Pairs (p, x) of classes of crowded shingles: blocks of about CROWD_BLOCK classes of a shingle meet pair by pair, each
    pair of blocks in one task; only pairs that pass the exact bounds of ``_compared`` are made."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [parity(np.frombuffer(x.as_py(), np.uint64)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["a", "bits"])

    rows = rows.distinct()
    size = rows.groupBy("token").agg(F.ceil(F.count("*") / CROWD_BLOCK).alias("blocks"))
    marks = sets.join(rows.select(F.col("a").alias("id")).distinct(), "id", "left_semi").select("id", "items").mapInArrow(bits, "a long, bits binary")
    own = rows.join(size, "token").withColumn("block", F.pmod(F.xxhash64("a"), F.col("blocks")))
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    met = met.select(F.col("token").alias("g"), "a", "b", "n", "reach", "block", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right")).join(marks, "a")
    dealt = met.withColumn("task", F.pmod(F.xxhash64("g", "left", "right"), F.lit(64 * parts)))
    return dealt.repartition(parts, "task").groupBy("task").applyInArrow(_compared, "p long, x long").distinct()


def link_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with their class: doc_id, n, cid; links between classes: u, v)."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = stored(features(docs), "features")
    total = rows.count()
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    classes = rows.where("n > 0 and doc_id is not null").groupBy("n", "a", "b").agg(F.min("doc_id").alias("id"), F.min_by("sig", "doc_id").alias("sig"))
    classes = stored(classes, "classes")
    buckets = max(16, total // CLASSES)
    stars = stored(_keys(classes, buckets).repartition(parts, "bucket").groupBy("bucket").applyInArrow(_stars, "x long, p long, far int"), "stars")
    # at most PLACES partners a class, one a key
    near = F.slice(F.array_sort(F.collect_set(F.struct("far", "p"))), 1, PARTNERS)
    pairs = stored(stars.where("far < 99").groupBy("x").agg(near.alias("near")).select("x", F.explode("near.p").alias("p")), "pairs")
    members = stars.select(F.col("x").alias("id")).union(stars.select(F.col("p").alias("id"))).distinct()
    sets = stored(_full_sets(docs, classes, members), "sets")
    links = stored(_confirmed(pairs, sets, parts), "links")
    comps = components(links)
    labelled = stored(sets.join(comps, "id", "left").withColumn("component", F.coalesce("component", "id")), "labelled")
    rarity = spark.sparkContext.broadcast(_rarity(spark, sets))
    more = stored(_unlinked(labelled, rarity, buckets, parts), "more")
    links = links.unionByName(stored(_confirmed(more, sets, parts), "links"))
    return rows.join(classes.select("n", "a", "b", F.col("id").alias("cid")), ["n", "a", "b"], "left").select("doc_id", "n", "cid"), links


def _unlinked(labelled: DataFrame, rarity, buckets: int, parts: int) -> DataFrame:
    """Pairs (p, x) of classes of different components that may be linked."""
    prefixes = stored(_prefixes(labelled, rarity, buckets), "prefixes")
    own = prefixes.where("kind = 0").drop("kind").repartition(parts, "bucket").groupBy("bucket")
    found = stored(own.applyInArrow(_completed, "kind int, token long, a long, b long, n long, reach long"), "found")
    pairs = found.where("kind = 0").select(F.col("a").alias("p"), F.col("b").alias("x")).distinct()
    if found.where("kind > 0").isEmpty():
        return pairs

    def waiting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            token, ids, n, place, comp = _unpacked(pa.table(batch.columns, batch.schema.names), np.int64, np.int64, np.int32, np.int32, np.int64)
            n, place = n.astype(np.int64), place.astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (token, ids, comp, n, _reach(n, place))], ["token", "a", "b", "n", "reach"])

    held = prefixes.where("kind = 1").select("c0", "c1", "c2", "c3", "c4").mapInArrow(waiting, "token long, a long, b long, n long, reach long")
    held = held.join(found.where("kind = 2").select("token").distinct(), "token", "left_semi")
    crowd = stored(found.where("kind = 1").drop("kind").unionByName(held), "crowd")
    return pairs.unionByName(_crowds(crowd, labelled, parts)).distinct()


def _marked(ids: DataFrame) -> np.ndarray:
    """MARKS bits, those at the hashes of the ids set: a table of one size for any input."""
    parts = 16
    each = MARKS // parts

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(MARKS, bool)
        for batch in batches:
            bits[_mark(batch.column(0).to_numpy())] = True
        at = np.flatnonzero(bits)
        yield _packed(at // each, parts, (at % each).astype(np.uint32)).rename_columns(["part", "at"])

    def add(table: pa.Table) -> pa.Table:
        bits = np.zeros(each, bool)
        for at in table.column("at").to_pylist():
            bits[np.frombuffer(at, np.uint32)] = True
        return pa.table({"part": table.column("part")[:1], "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    out = np.zeros((parts, each // 8), np.uint8)
    for part, bits in ids.mapInArrow(mark, "part int, at binary").groupBy("part").applyInArrow(add, "part int, bits binary").collect():
        out[part] = np.frombuffer(bits, np.uint8)
    return out.reshape(-1)


def _mark(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.view(np.uint64)) % U64(MARKS)).astype(np.int64)


def _full_sets(docs: DataFrame, classes: DataFrame, members: DataFrame) -> DataFrame:
    """(id, items): the sorted shingles of the classes that share a key with another class.

    Texts are not shuffled: a bit table of fixed size tells where they are which documents may be of these, and only
    the sets of those are joined.
    """
    spark = docs.sparkSession
    wanted = classes.join(members, "id", "left_semi").select("id")
    marks = spark.sparkContext.broadcast(_marked(wanted))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = marks.value
        for batch in batches:
            at = _mark(batch.column(0).to_numpy())
            batch = batch.filter(pa.array((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)))
            data, offsets = utf8(batch.column(1))
            for a, b in chunks(offsets):
                h, bounds = _sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([h[bounds[k] : bounds[k + 1]].tobytes() for k in range(b - a)], pa.binary())], ["id", "items"])

    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).where("id is not null")
    sets = texts.mapInArrow(rows, "id long, items binary").where("length(items) > 0")
    return sets.join(wanted, "id", "left_semi").groupBy("id").agg(F.max("items").alias("items"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """For each document: doc_id, n_shingles, component_id (least doc_id reachable over links), kept (it is that document)."""
    rows, links = link_classes(docs)
    rows = stored(rows, "rows")
    # a doc_id that has several texts ties their classes together
    ties = rows.where("cid is not null and doc_id is not null").select("doc_id", "cid").distinct()
    least = ties.groupBy("doc_id").agg(F.min("cid").alias("lo"), F.count("*").alias("c")).where("c > 1")
    extra = ties.join(least, "doc_id").where("cid <> lo").select(F.col("cid").alias("u"), F.col("lo").alias("v"))
    comps = components(links.unionByName(extra))
    out = rows.join(comps.select(F.col("id").alias("cid"), "component").repartition("cid", "component"), "cid", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "cid", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def without_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each group of near duplicates, with all its columns; rows without doc_id all stay.

    Of several rows of a doc_id that stays the first is kept, in order of the text, then of a hash of all columns.
    """
    kept = near_duplicates(docs).where("kept and doc_id is not null").select("doc_id").distinct()
    hashed = [f.name for f in docs.schema.fields if not isinstance(f.dataType, MapType)]
    row, place = F.struct(*(F.col(f"`{c}`") for c in docs.columns)), F.struct(F.col("text").cast("string"), F.xxhash64(*(F.col(f"`{c}`") for c in hashed)))
    same = docs.withColumn("doc_id", F.col("doc_id").cast("long")).join(kept, "doc_id", "left_semi").select(*docs.columns)
    one = same.groupBy(F.col("doc_id").alias("_id")).agg(F.min_by(row, place).alias("_row")).select("_row.*")
    return one.unionByName(docs.where("doc_id is null"))
