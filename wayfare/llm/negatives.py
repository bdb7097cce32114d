"""Hard negatives: rows of another label that score nearly as high for an anchor as one of its positives.

A row's score for an anchor is the inner product of their integer vectors, each component floor(scale * x).  An anchor's
positives are the best rows of its label, and for each positive the best rows of other labels are wanted whose scores
lie in a band below the positive's.  Every anchor is compared with every row, in cells of a block of anchors and a share
of the rows; a cell keeps the best rows of each of its anchors, and the cells' bests are merged by a window.

Within a cell most pairs are discarded early, by a rotation to the principal components of all vectors:

1. The second moments of all vectors are summed by tasks; their eigenvectors are an orthogonal rotation, which keeps
   inner products, and puts most of a vector's length into its leading components.
2. The product over the leading quarter of the components is a partial product.  What the others can add is at most
   the product of both vectors' residual norms (Cauchy and Schwarz), plus slack for the rounding of the rotation and of
   the sums.  A pair whose upper bound is below what its anchor still needs, or whose lower bound is above its band, is
   discarded; for the others the next quarter is added, and so on.
3. Pairs that survive are scored by integer products, so the rotation decides nothing but the work.

Defined results: rows with a null id, label or vector, or a component that is null or not finite, take no part, nor do
those whose integer vector is 2^31 or longer (their scores do not fit 64 bits).  Repeated rows are rows of their own, and
so are rows that share an id; ties go to the smaller id.  A shorter vector counts as followed by zeros.  An anchor
without positives or without negatives in a band has no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfare.llm.text import gathered
from wayfare.llm.vectors import keyed, matrix, whole
from wayfare.plans.scratch import stored

#: Anchors of a block, and rows of a share, on average; a cell holds its anchors, and its rows pass by.
ANCHORS, ROWS = 16_384, 1 << 19
#: Rows and anchors that are compared at once, and pairs whose components are.
TILE_ROWS, TILE_ANCHORS, PAIRS = 1024, 512, 1 << 16
_LEAST, _MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
_PAIR = "cell long, kind int, key long, vec_id long, label long, q array<long>, p array<long>"


def integers(vectors: DataFrame, scale: int) -> DataFrame:
    """(key, vec_id, label, q) of the rows that take part, a stored table."""
    rows = keyed(vectors).where("vec_id is not null and label is not null").where(whole("embedding"))
    rows = rows.withColumn("q", F.transform("embedding", lambda x: F.floor(x * scale)))
    short = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + F.floor(x * scale).cast("double") * F.floor(x * scale)) < float(2**62)
    return stored(rows.where(short).select("key", "vec_id", "label", "q"), "integers")


def rotation(rows: DataFrame, width: int) -> np.ndarray:
    """An orthogonal matrix to the principal components of all vectors, the leading ones first.

    Tasks sum products of components, and at most width * (width + 1) / 2 sums come to the driver.
    """

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            x = matrix(batch.column(0), width, np.float64)
            total += x.T @ x
        at = np.flatnonzero(np.triu(np.ones((width, width), bool)))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.reshape(-1)[at])], ["at", "sum"])

    total = np.zeros(width * width)
    for at, value in rows.select("q").mapInArrow(moments, "at long, sum double").groupBy("at").agg(F.sum("sum")).collect():
        total[at] = value
    total = total.reshape(width, width)
    values, vectors = np.linalg.eigh(total + np.triu(total, 1).T)
    return vectors[:, np.argsort(-values)]


@dataclass
class Rotated:
    """Integer vectors, their rotation, and at each cut the norms of the components from there on."""

    q: np.ndarray
    y: np.ndarray
    norm: np.ndarray
    rest: list[np.ndarray]

    @classmethod
    def of(cls, q: np.ndarray, turn: np.ndarray, cuts: list[int]) -> Rotated:
        x = q.astype(np.float64)
        y = x @ turn
        return cls(q, y, np.linalg.norm(x, axis=1), [np.linalg.norm(y[:, c:], axis=1) for c in cuts])

    def part(self, at: np.ndarray | slice) -> Rotated:
        return Rotated(self.q[at], self.y[at], self.norm[at], [r[at] for r in self.rest])


def slack(turn: np.ndarray) -> float:
    """By how much, times both norms, a bound made of rotated components may miss the true product: how far the matrix
    is from orthogonal, and the rounding of the rotation and of the sums, twice over."""
    d = len(turn)
    return 2 * (float(np.abs(turn.T @ turn - np.eye(d)).sum()) + 8 * (d + 8) * np.finfo(float).eps) if d else 0.0


def survivors(x: Rotated, a: Rotated, wanted: np.ndarray, low: np.ndarray, high: np.ndarray, cuts: list[int], loose: float) -> tuple[np.ndarray, ...]:
    """(row, anchor, score) of the ``wanted`` pairs whose score may be in ``low[anchor]..high[anchor]``; scores are exact."""
    first = cuts[0] if cuts else 0
    p = x.y[:, :first] @ a.y[:, :first].T
    bound = (np.outer(x.rest[0], a.rest[0]) if cuts else 0.0) + loose * np.outer(x.norm, a.norm)
    i, j = np.nonzero(wanted & (p + bound >= low) & (p - bound <= high))
    out = []
    for s in range(0, len(i), PAIRS):
        ri, aj = i[s : s + PAIRS], j[s : s + PAIRS]
        part = p[ri, aj]
        for k in range(1, len(cuts)):
            part += np.einsum("ij,ij->i", x.y[ri, cuts[k - 1] : cuts[k]], a.y[aj, cuts[k - 1] : cuts[k]])
            bound = x.rest[k][ri] * a.rest[k][aj] + loose * x.norm[ri] * a.norm[aj]
            keep = (part + bound >= low[aj]) & (part - bound <= high[aj])
            ri, aj, part = ri[keep], aj[keep], part[keep]
        out.append((ri, aj, np.einsum("ij,ij->i", x.q[ri], a.q[aj])))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (i, j, np.empty(0, np.int64))


class Best:
    """The first ``k`` rows of each of ``m`` searches, by score from the highest on and then by id from the least on."""

    def __init__(self, m: int, k: int):
        self.k = k
        self.score, self.id = np.full((m, k), _LEAST), np.full((m, k), _MOST)

    def offer(self, search: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        some = np.flatnonzero(score >= self.score[search, -1])
        touched, place = np.unique(search[some], return_inverse=True)
        s = np.concatenate([np.repeat(np.arange(len(touched)), self.k), place])
        score = np.concatenate([self.score[touched].reshape(-1), score[some]])
        ids = np.concatenate([self.id[touched].reshape(-1), ids[some]])
        order = np.lexsort((ids, ~score, s))
        s, score, ids = s[order], score[order], ids[order]
        rank = np.arange(len(s)) - np.searchsorted(s, np.arange(len(touched)))[s]
        keep = rank < self.k
        self.score[touched], self.id[touched] = score[keep].reshape(-1, self.k), ids[keep].reshape(-1, self.k)


def _ceil(p: np.ndarray, share: int) -> np.ndarray:
    """ceil(share * p / 100), without a product of more than 64 bits."""
    return p // 100 * share - (-(p % 100) * share) // 100


def _floor(p: np.ndarray, share: int) -> np.ndarray:
    return p // 100 * share + p % 100 * share // 100


class Positives:
    """The best rows of each anchor's own label, but for the anchor itself."""

    def __init__(self, anchors: dict[str, np.ndarray], k: int, band: tuple[int, int]):
        self.label, self.key = anchors["label"], anchors["key"]
        self.best = Best(len(self.label), k)

    def limits(self, at: slice) -> tuple[np.ndarray, np.ndarray]:
        return self.best.score[at, -1].astype(float), np.full(len(self.label[at]), np.inf)

    def wanted(self, at: slice, label: np.ndarray, key: np.ndarray) -> np.ndarray:
        return (label[:, None] == self.label[at]) & (key[:, None] != self.key[at])

    def offer(self, anchor: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        self.best.offer(anchor, score, ids)


class Negatives:
    """The best rows of other labels in the band below each positive."""

    def __init__(self, anchors: dict[str, np.ndarray], k: int, band: tuple[int, int]):
        self.label, self.positive = anchors["label"], anchors["p"]
        self.there = anchors["n"][:, None] > np.arange(self.positive.shape[1])
        self.low = np.where(self.there, _ceil(self.positive, band[0]), _MOST)
        self.high = np.where(self.there, _floor(self.positive, band[1]), _LEAST)
        self.best = Best(self.positive.size, k)

    def limits(self, at: slice) -> tuple[np.ndarray, np.ndarray]:
        now = self.best.score[:, -1].reshape(self.positive.shape)[at]
        return np.maximum(now, self.low[at]).min(1).astype(float), self.high[at].max(1).astype(float)

    def wanted(self, at: slice, label: np.ndarray, key: np.ndarray) -> np.ndarray:
        return label[:, None] != self.label[at]

    def offer(self, anchor: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        slots = self.positive.shape[1]
        for s in range(slots):
            ok = np.flatnonzero((self.low[anchor, s] <= score) & (score <= self.high[anchor, s]))
            self.best.offer(anchor[ok] * slots + s, score[ok], ids[ok])


def _searched(kind: Callable, turn: np.ndarray, k: int, band: tuple[int, int]) -> Callable:
    """A task over cells, each its anchors first and then its rows: (key, slot, vec_id, score) of the best rows of each search."""
    width = len(turn)
    cuts = sorted({width // 4, width // 2, 3 * width // 4} - {0}) if width > 3 else []
    loose = slack(turn)

    def ended(search, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        n, j = np.nonzero(search.best.score > _LEAST)
        slots = len(search.best.score) // len(keys)
        cols = keys[n // slots], (n % slots).astype(np.int32), search.best.id[n, j], search.best.score[n, j]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["key", "slot", "vec_id", "score"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, search, anchors = None, [], None, None
        for batch in gathered(batches, rows=TILE_ROWS):
            marks = batch.column("cell").to_numpy() * 2 + batch.column("kind").to_numpy()
            for run in np.split(np.arange(len(marks)), np.flatnonzero(np.diff(marks)) + 1):
                own = batch.slice(run[0], len(run))
                if own.column("cell")[0].as_py() != cell:
                    if search is not None:
                        yield from ended(search, keys)
                    cell, held, search = own.column("cell")[0].as_py(), [], None
                if own.column("kind")[0].as_py() == 0:
                    held.append(own)
                    continue
                if not held:
                    continue
                if search is None:
                    a = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    keys = a.column("key").to_numpy()
                    anchors = Rotated.of(matrix(a.column("q"), width, np.int64), turn, cuts)
                    p = a.column("p").fill_null([])
                    n = p.value_lengths().to_numpy(zero_copy_only=False)
                    search = kind({"label": a.column("label").to_numpy(), "key": keys, "p": matrix(p, int(n.max()), np.int64), "n": n}, k, band)
                rows = Rotated.of(matrix(own.column("q"), width, np.int64), turn, cuts)
                label, key, ids = (own.column(c).to_numpy() for c in ("label", "key", "vec_id"))
                for s in range(0, len(keys), TILE_ANCHORS):
                    at = slice(s, s + TILE_ANCHORS)
                    i, j, score = survivors(rows, anchors.part(at), search.wanted(at, label, key), *search.limits(at), cuts, loose)
                    search.offer(j + s, score, ids[i])
        if search is not None:
            yield from ended(search, keys)

    return task


def _best(rows: DataFrame, anchors: DataFrame, total: int, n_anchors: int, kind: Callable, turn: np.ndarray, k: int, band: tuple[int, int]) -> DataFrame:
    """(key, slot, rank, vec_id, score): the first k rows of each search over all rows."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    blocks = -(-n_anchors // ANCHORS) or 1
    shares = max(-(-total // ROWS), min(cores, -(-total // (4 * TILE_ROWS))), 1)
    block, share = F.pmod(F.xxhash64("key"), F.lit(blocks)), F.pmod(F.xxhash64("key"), F.lit(shares))
    every_share = F.explode(F.transform(F.sequence(F.lit(0), F.lit(shares - 1)), lambda k: block * shares + k))
    every_block = F.explode(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda k: k * shares + share))
    columns = "key", "vec_id", "label", "q"
    a = anchors.select(every_share.alias("cell"), F.lit(0).alias("kind"), *columns, "p")
    r = rows.select(every_block.alias("cell"), F.lit(1).alias("kind"), *columns, F.lit(None).cast("array<long>").alias("p"))
    cells = a.unionByName(r).repartition(blocks * shares, "cell").sortWithinPartitions("cell", "kind")
    found = cells.mapInArrow(_searched(kind, turn, k, band), "key long, slot int, vec_id long, score long")
    order = Window.partitionBy("key", "slot").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, band: tuple[int, int] = (80, 100), scale: int = 256) -> DataFrame:
    """For each anchor (a row whose ``vec_id`` is divisible by ``every``) and each of its first ``positives`` positives, the first
    ``negatives`` rows of other labels with band[0] * positive_score <= 100 * negative_score <= band[1] * positive_score:
    anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score."""
    rows = integers(vectors, scale)
    total, width, n_anchors = rows.agg(F.count("*"), F.coalesce(F.max(F.size("q")), F.lit(0)), F.count_if(F.col("vec_id") % every == 0)).first()
    turn = rotation(rows, width)
    anchors = rows.where(F.col("vec_id") % every == 0).withColumn("p", F.lit(None).cast("array<long>"))
    near = stored(_best(rows, anchors, total, n_anchors, Positives, turn, positives, band).drop("slot"), "positives")
    scores = near.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda s: s["score"]).alias("p"))
    far = _best(rows, anchors.drop("p").join(scores, "key"), total, n_anchors, Negatives, turn, negatives, band)
    named = near.join(anchors.select("key", F.col("vec_id").alias("anchor_id")), "key").select(
        "key", (F.col("rank") - 1).alias("slot"), "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")
    )
    return far.withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"}).join(named, ["key", "slot"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
