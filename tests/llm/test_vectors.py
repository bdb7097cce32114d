"""Operators over embeddings, and resampling, against brute force on small tables with nulls, copies, ties and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from wayfare.llm import negatives, resampling, vector_dedup

SCHEMA = "vec_id long, embedding array<float>, label int, key string, cell long, kind int, a int, b int, n int, component string, score int, rank int"
NAN, INF = float("nan"), float("inf")


def _vectors(rng, n=150, d=9):
    """Clusters around a few centres, at all cosines from 0.95 on, with copies, ties and rows that take no part."""
    out = []
    centres = rng.standard_normal((6, d))
    for k in range(n):
        c = centres[k % 6] + rng.standard_normal(d) * rng.choice([0.0, 0.05, 0.1, 0.2, 1.0])
        out.append((k, [float(np.float32(x)) for x in c / np.linalg.norm(c)], int(k % 6 % 4)))
    out += [(n + 1, out[3][1], out[3][2]), (n + 2, out[3][1], out[3][2]), (3, out[4][1], out[3][2]), out[7], out[7], (100, out[100][1], 1)]
    out += [(n + 3, None, 1), (n + 4, [], 1), (n + 5, [0.0] * d, 1), (n + 6, [NAN] * d, 1), (n + 7, [INF] + [0.0] * (d - 1), 1), (n + 8, [None] + [1.0] * (d - 1), 1)]
    out += [(n + 9, out[0][1], None), (None, out[1][1], out[1][2]), (n + 10, [1.0, 2.0], 2), (n + 11, [2.0, 4.0], 2), (n + 12, [3e38] * d, 2), (-100, out[5][1], 3), (-101, out[5][1], 2)]
    return out


@pytest.fixture(scope="module")
def vectors():
    rows = _vectors(np.random.default_rng(4))
    random.Random(2).shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def table(spark, vectors):
    return spark.createDataFrame([(*r, "k", 1, 2, 3, 4, 5, "c", 6, 7) for r in vectors], SCHEMA).repartition(3).cache()


def _finite(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def _hard(rows, every, positives, count, band, scale=256):
    """Hard negatives in Python's integers; rows are told apart by their place."""
    own = []
    for i, (vec, v, label) in enumerate(rows):
        if vec is not None and label is not None and _finite(v):
            q = [math.floor(scale * x) for x in v]
            if sum(x * x for x in q) < 2**62:
                own.append((i, vec, label, q))
    out = []
    dot = lambda p, q: sum(x * y for x, y in zip(p, q))
    for a in own:
        if a[1] % every:
            continue
        scored = sorted((-dot(a[3], r[3]), r[1], r[2]) for r in own if r[0] != a[0])
        for s, p, _ in [t for t in scored if t[2] == a[2]][:positives]:
            ok = [t for t in scored if t[2] != a[2] and band[0] * -s <= 100 * -t[0] <= band[1] * -s][:count]
            out += [(a[1], p, k + 1, t[1], -s, -t[0]) for k, t in enumerate(ok)]
    return Counter(out)


@pytest.mark.parametrize("tile", [(1024, 512), (7, 3)])
def test_hard_negatives(table, vectors, monkeypatch, tile):
    monkeypatch.setattr(negatives, "TILE_ROWS", tile[0])
    monkeypatch.setattr(negatives, "TILE_ANCHORS", tile[1])
    monkeypatch.setattr(negatives, "ANCHORS", 8 if tile[0] == 7 else 16_384)
    for every, band in ((100, (80, 100)), (10, (80, 100)), (5, (-50, 110))):
        got = negatives.hard_negatives(table, every=every, band=band)
        assert Counter(tuple(r) for r in got.collect()) == _hard(vectors, every, 5, 5, band)


def test_hard_negatives_of_nothing(table):
    assert negatives.hard_negatives(table.where("false")).count() == 0
    assert negatives.hard_negatives(table.where("label is null")).count() == 0
    assert negatives.hard_negatives(table.where("label = 1")).count() == 0


def test_bounds_discard_and_lose_nothing():
    """Most pairs under what is needed are discarded before their integer product, and none at or over it."""
    rng = np.random.default_rng(1)
    q = np.floor(rng.standard_normal((400, 32)) * np.geomspace(400, 1, 32) @ np.linalg.qr(rng.standard_normal((32, 32)))[0]).astype(np.int64)
    moments = (q.T @ q).astype(float)
    values, turn = np.linalg.eigh(moments)
    turn = turn[:, np.argsort(-values)]
    cuts = [8, 16, 24]
    x, a = negatives.Rotated.of(q, turn, cuts), negatives.Rotated.of(q[:50], turn, cuts)
    exact = q @ q[:50].T
    low = np.sort(exact, axis=0)[-10].astype(float)
    i, j, score = negatives.survivors(x, a, np.ones(exact.shape, bool), low, np.full(50, np.inf), cuts, negatives.slack(turn))
    assert (score == exact[i, j]).all()
    found = np.zeros(exact.shape, bool)
    found[i, j] = True
    assert found[exact >= low].all() and len(i) < exact.size / 5
    wrong = turn.copy()
    wrong[:, 0] *= 1.01  # not orthogonal: the slack makes up for it
    x, a = negatives.Rotated.of(q, wrong, cuts), negatives.Rotated.of(q[:50], wrong, cuts)
    i, j, _ = negatives.survivors(x, a, np.ones(exact.shape, bool), low, np.full(50, np.inf), cuts, negatives.slack(wrong))
    found[:] = False
    found[i, j] = True
    assert found[exact >= low].all()


def _linked(rows, least):
    """(vec_id, n_links, component_id, kept) of each row by comparing all pairs."""
    n = len(rows)
    ok = [r[2] is not None and _finite(r[1]) and any(r[1]) for r in rows]
    d = max((len(r[1]) for r in rows if r[1]), default=0)
    x = np.array([[*r[1], *[0.0] * (d - len(r[1]))] if o else [0.0] * d for r, o in zip(rows, ok)])
    x = x / np.maximum(np.abs(x).max(1, keepdims=True), 1e-300)
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    label = np.array([r[2] if o else -1 for r, o in zip(rows, ok)])
    close = (x @ x.T >= least) & (label[:, None] == label) & np.array(ok)[:, None] & np.array(ok) & ~np.eye(n, dtype=bool)
    root = vector_dedup.connected(close)
    out = []
    for k in range(n):
        ids = [rows[m][0] for m in np.flatnonzero(root == root[k]) if rows[m][0] is not None] if ok[k] else [rows[k][0]]
        first = min(ids, default=None)
        out.append((rows[k][0], int(close[k].sum()), first, first is None or rows[k][0] is None or rows[k][0] == first))
    return Counter(out)


@pytest.mark.parametrize("block", [1024, 3])
def test_vector_duplicates(table, vectors, monkeypatch, block):
    monkeypatch.setattr(vector_dedup, "BLOCK", block)
    got = Counter(tuple(r) for r in vector_dedup.vector_duplicates(table).collect())
    assert got == _linked(vectors, 0.98)
    assert vector_dedup.vector_duplicates(table.where("false")).count() == 0
    none = vector_dedup.vector_duplicates(table.where("label is null")).collect()
    assert all(r.n_links == 0 and r.kept for r in none) and len(none) == 1


def test_a_hot_group_is_dealt_into_blocks(spark, monkeypatch):
    """A third of all rows lie around one centre, at cosines on both sides of the limit; half of these are exact copies."""
    monkeypatch.setattr(vector_dedup, "BLOCK", 40)
    rng = np.random.default_rng(8)
    base = rng.standard_normal(64) / 8
    rows = [(k, (rng.standard_normal(64) / 8).tolist(), k % 3) for k in range(600)]
    rows += [(1000 + k, (base + (k % 2) * rng.standard_normal(64) / 8 * 0.11).tolist(), 1) for k in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)
    got = sorted(tuple(r) for r in vector_dedup.vector_duplicates(df).collect())
    want = sorted(_linked(rows, 0.98).elements())
    assert [g[2:] for g in got] == [w[2:] for w in want]
    links, all_links = sum(g[1] for g in got), sum(w[1] for w in want)
    assert all(g[1] <= w[1] for g, w in zip(got, want)) and links >= 0.99 * all_links


def test_recall_at_the_limit():
    """Pairs at exactly the limit share a key in 99 of 100 cases; unrelated vectors hardly ever do."""
    rng = np.random.default_rng(3)
    x = vector_dedup.unit(rng.standard_normal((2000, 64)))
    other = rng.standard_normal((2000, 64))
    other = vector_dedup.unit(other - (other * x).sum(1, keepdims=True) * x)
    y = 0.98 * x + math.sqrt(1 - 0.98**2) * other
    label = np.zeros(2000, np.int64)
    a, b = vector_dedup.table_keys(x, label), vector_dedup.table_keys(y, label)
    assert (a == b).any(1).mean() >= 0.99
    assert (a == vector_dedup.table_keys(other, label)).any(1).mean() < 0.01
    assert not (a == vector_dedup.table_keys(x, label + 1)).any()


TEXTS = [None, "", " .,; ", "one two", "z" * 5000 + " y", "Ärger naïve ABC abc 日本 x_1"]


def _documents():
    rng = random.Random(6)
    words = ["alpha", "Beta", "gamma", "délta", "x1", "日本", "the", "of", "and", "q" * 70]
    make = lambda n: " ".join(rng.choice(words) + rng.choice(["", ",", "-", "'s"]) for _ in range(n))
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(10 + k, make(rng.randrange(1, 60))) for k in range(150)]
    rows += [(500, make(30))] * 40 + [(None, make(40))] * 30 + [(None, None), (11, make(25)), (900, make(20_000))]
    return rows


def _resampled(docs, target, share, least, longest, buckets):
    def features(text):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        runs = [" ".join(ws[i : i + n]) for n in range(1, longest + 1) for i in range(len(ws) - n + 1)]
        return len(ws), [zlib.crc32(r.encode()) % buckets for r in runs]

    found = [features(t) for _, t in docs]
    s, t = Counter(b for _, f in found for b in f), Counter(b for text in target for b in features(text)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in s}
    rows = []
    for (i, _), (n, f) in zip(docs, found):
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, n])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for k, r in enumerate(able[: share * len(able) // 100]):
        r[4] = k + 1
    return Counter(tuple(r[:5]) for r in rows)


@pytest.mark.parametrize("share, longest, buckets", [(10, 1, 10_000), (45, 3, 500), (100, 2, 7), (0, 1, 50)])
def test_resampling(spark, share, longest, buckets):
    rows = _documents()
    target = ["the of and the of", "Délta x1", None, ""]
    docs = spark.createDataFrame([(i, t, 1, "w", 2, "r", 3, 4, 5, 6) for i, t in rows], "doc_id long, text string, score int, weight string, rank int, last string, copies int, place int, before int, n_words int").repartition(3)
    aim = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    got = resampling.importance_resample(docs, aim, share=share, longest=longest, buckets=buckets)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(tuple(r) for r in got.collect()) == _resampled(rows, target, share, 20, longest, buckets)


def test_resampling_of_nothing(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "doc_id long, text string")
    none = docs.where("false")
    assert resampling.importance_resample(none, docs).count() == 0
    got = resampling.importance_resample(docs, none)
    assert got.count() == len(TEXTS) and got.where("rank is not null").count() == 0
    texts = spark.createDataFrame([(k, "common words here " * 10 + ("aim " * 20 if k % 3 == 0 else "")) for k in range(60)], "doc_id long, text string")
    aim = spark.createDataFrame([("aim " * 50,)], "text string")
    kept = resampling.drawn(texts, aim, share=30).collect()
    aimed = sum(r.doc_id % 3 == 0 for r in kept)  # of 20 such documents, and 40 others
    assert len(kept) == 18 and aimed / 20 > 2 * (18 - aimed) / 40 and all(r.text for r in kept)


def test_crc32_of_ranges():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 256, 5000).astype(np.uint8)
    start = rng.integers(0, 4000, 300)
    end = start + rng.choice([0, 1, 5, 60, 900], 300)
    assert [zlib.crc32(data[s:e].tobytes()) for s, e in zip(start, end)] == resampling.crc32(data, start, end).tolist()
