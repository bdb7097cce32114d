"""Toxicity by a classifier chain.

Categories are predicted one after another, each with labels of its own: low quality (``quality`` is 0) first, then
toxic.  Each link is a linear (logistic) model over the words of a text and the probabilities of the categories before
it.  While a chain is fitted, those probabilities are out of fold: a labelled document gets them from models that have
not seen it, whose words were chosen without it too; so later models learn from probabilities as they will be at
prediction.  A label table without a column for a category makes a chain without its link.

The chain is fitted on at most SAMPLE labelled documents of each class of ``toxic``, those least by hash of
``doc_id``: Spark counts their words by fold, and only the words that some model may choose come to the driver, at most
KEEP for each model.  Every document is then scored, in one pass without a shuffle.  Features are hashed (words, the
first letters of words, and steps of the share of marks), so no vocabulary grows with the input.

Defined results: null or empty texts have no features and get the chain's base probabilities, and are not toxic;
labels that are null or without a document are ignored; of several labels of a document the largest toxic and the
least quality count; without labelled documents of both classes nothing is toxic; null keys and repeated rows each get
their row; columns of the documents that are named like a result are replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfare.llm.text import ALNUM, U64, Words, by_document, chunks, mix, small_batches, utf8
from wayfare.plans.scratch import stored

#: Labelled documents of each class that the chain is fitted on, at most.
SAMPLE = 4000
#: The links in order: name, and SQL over a row of labels (1, 0, or null).
LINKS = {"low_quality": "1 - quality", "toxic": "toxic"}
BITS, KEEP, FOLDS = 18, 300, 3
#: A feature counts if so many labelled documents of the class have it, and its log odds are so large.
LEAST, ODDS = 5, 3.0
_PREFIXES = (4, 6, 8)
_MARK = ~ALNUM
_MARK[[0x20, *range(0x09, 0x0E)]] = False


def features(data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) pairs of texts, each once; only those ``wanted``."""
    w = Words(data, offsets, ALNUM)
    doc = np.repeat(np.arange(len(w.count)), w.count)
    docs, feats = [doc], [w.hash >> U64(64 - BITS)]
    for n in _PREFIXES:
        long = np.flatnonzero(w.end - w.start > n)
        docs.append(doc[long])
        feats.append(mix(w.span_hash(w.start[long], w.start[long] + n) + U64(n)) >> U64(64 - BITS))
    size = np.diff(offsets)
    full = np.flatnonzero(size)
    share = by_document(_MARK[data], offsets)[full] * 20 // size[full]
    docs.append(full)
    feats.append(mix(share.astype(np.uint64) + U64(0xA24BAED4963EE407)) >> U64(64 - BITS))
    docs, feats = np.concatenate(docs), np.concatenate(feats).astype(np.int64)
    if wanted is not None:
        some = np.flatnonzero(wanted[feats])
        docs, feats = docs[some], feats[some]
    pair = np.unique(docs << BITS | feats)
    return pair >> BITS, pair & ((1 << BITS) - 1)


def chosen(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int) -> np.ndarray:
    """The features most tied to a class, at most KEEP, from how many documents inside and outside of it have them."""
    odds = np.log((pos + 0.5) / (n_pos + 1)) - np.log((neg + 0.5) / (n_neg + 1))
    tied = np.where((pos >= max(LEAST, 0.002 * n_pos)) & (odds > ODDS), odds * np.sqrt(pos), 0)
    best = np.argsort(-tied, kind="stable")[:KEEP]
    return best[tied[best] > 0]


def fit_link(x: np.ndarray, y: np.ndarray, l2: float = 1.0) -> np.ndarray:
    """Logistic regression with L2 by damped Newton steps until the gradient is nothing: weights, then the bias (not penalised).

    With one class only, weights are 0 and the bias is that of near certainty.
    """
    n, m = x.shape
    w = np.zeros(m + 1)
    if not n or y.min() == y.max():
        w[-1] = 20.0 if n and y[0] else -20.0
        return w
    x = np.column_stack([x, np.ones(n)])
    penalty = np.append(np.full(m, l2), 0.0)
    cost = lambda w: np.logaddexp(0, x @ w).sum() - y @ (x @ w) + 0.5 * (penalty * w * w).sum()
    now = cost(w)
    for _ in range(100):
        p = 1 / (1 + np.exp(-(x @ w)))
        grad = x.T @ (p - y) + penalty * w
        if np.abs(grad).max() < 1e-8 * n:
            return w
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(penalty + 1e-9), grad)
        size = 1.0
        while (new := cost(w - size * step)) > now and size > 1e-9:
            size /= 2
        if size <= 1e-9:
            return w
        w, now = w - size * step, new
    raise RuntimeError("the link did not converge")


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


class Chain:
    """A fitted chain: for each link its features and weights, and the threshold of the last."""

    def __init__(self, names: list[str], keep: list[np.ndarray], models: list[np.ndarray], threshold: float):
        self.names, self.keep, self.models, self.threshold = names, keep, models, threshold
        self.wanted = np.zeros(1 << BITS, bool)
        for k in keep:
            self.wanted[k] = True

    def predict(self, rows: np.ndarray, feats: np.ndarray, n: int) -> np.ndarray:
        """Probabilities of all categories, (n, links)."""
        extra = np.zeros((n, 0))
        for keep, w in zip(self.keep, self.models):
            weight = np.zeros(1 << BITS)
            weight[keep] = w[: len(keep)]
            z = w[-1] + extra @ w[len(keep) : -1] + np.bincount(rows, weight[feats], n)
            extra = np.column_stack([extra, _sigmoid(z)])
        return extra


def sampled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[DataFrame, list[str], dict[int, int]]:
    """(fold, text, y0, y1, ...) of the sample, a stored table; the chain's links; how many labelled documents a class has.

    Only labels of documents that are there are drawn from; a repeated doc_id counts once, with the last of its texts in
    byte order.  The drawn ids are bounded by ``sample``, so they are joined by broadcast.
    """
    small_batches(docs.sparkSession)
    names = [k for k, sql in LINKS.items() if sql.split()[-1] in labels.columns]
    there = docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    marks = [F.max(F.expr(LINKS[k]).cast("int")).alias(f"y{i}") for i, k in enumerate(names)]
    last = f"y{len(names) - 1}"
    marked = labels.where("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*marks)
    marked = stored(marked.join(there, "doc_id", "left_semi"), "labels")
    ids = None
    for value in (0, 1):
        part = marked.where(F.col(last) == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        ids = part if ids is None else ids.unionByName(part)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ys = [f"y{i}" for i in range(len(names))]
    joined = texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id", *ys).agg(F.max("text").alias("text"))
    rows = stored(joined.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("fold"), "text", *ys), "sample")
    return rows, names, dict(marked.groupBy(last).count().collect())


def _counts(rows: DataFrame, links: int) -> tuple[np.ndarray, np.ndarray]:
    """How many documents of each fold have each feature, (link, fold, class, feature), and how many there are."""
    names = [f"y{i}" for i in range(links)]
    schema = "link int, fold int, y int, feature int, n long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            fold = batch.column(0).to_numpy()
            ys = [batch.column(2 + i).fill_null(-1).to_numpy() for i in range(links)]
            for a, b in chunks(offsets):
                doc, feat = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                for i, y in enumerate(ys):
                    ok = y[a + doc] >= 0
                    key, n = np.unique((fold[a + doc[ok]].astype(np.int64) * 2 + y[a + doc[ok]]) << BITS | feat[ok], return_counts=True)
                    cell = key >> BITS
                    cols = [np.full(len(key), i), cell // 2, cell % 2, key & ((1 << BITS) - 1), n]
                    yield pa.RecordBatch.from_arrays([pa.array(c.astype(t)) for c, t in zip(cols, (*[np.int32] * 4, np.int64))], ["link", "fold", "y", "feature", "n"])

    own = rows.select("fold", "text", *names).mapInArrow(count, schema).groupBy("link", "fold", "y", "feature").agg(F.sum("n").alias("n"))
    # a feature can be chosen only if LEAST documents of a class have it: at most 2^BITS rows for each link, fold and class
    some = own.where("y = 1").groupBy("link", "feature").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST).select("link", "feature")
    out = np.zeros((links, FOLDS, 2, 1 << BITS), np.int32)
    t = own.join(some, ["link", "feature"], "left_semi").toArrow()
    out[tuple(t.column(c).to_numpy() for c in ("link", "fold", "y", "feature"))] = t.column("n").to_numpy()
    total = np.zeros((links, FOLDS, 2), np.int64)
    sums = rows.groupBy("fold").agg(*(F.count_if(F.col(c) == v).alias(f"{c}_{v}") for c in names for v in (0, 1)))
    for r in sums.collect():
        for i, c in enumerate(names):
            total[i, r.fold] = r[f"{c}_0"], r[f"{c}_1"]
    return out, total


def _collected(rows: DataFrame, links: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, feature) pairs of the wanted features, folds and labels (-1: none) of the sample, in order of doc_id."""
    names = [f"y{i}" for i in range(links)]

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            for a, b in chunks(offsets):
                doc, feat = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], wanted)
                cuts = np.searchsorted(doc, np.arange(b - a + 1))
                packed = pa.array([feat[cuts[k] : cuts[k + 1]].astype("<i4").tobytes() for k in range(b - a)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, b - a) for k in (0, 1)), packed, *(batch.column(3 + i).slice(a, b - a) for i in range(links))], ["doc_id", "fold", "feats", *names])

    schema = ", ".join(["doc_id long, fold int, feats binary", *(f"{c} int" for c in names)])
    found = sorted(tuple(r) for r in rows.select("doc_id", "fold", "text", *names).mapInArrow(own, schema).collect())
    sizes = [len(r[2]) // 4 for r in found]
    y = np.array([[-1 if v is None else v for v in r[3:]] for r in found], np.int64).reshape(len(found), links)
    return np.repeat(np.arange(len(found)), sizes), np.frombuffer(b"".join(bytes(r[2]) for r in found), "<i4").astype(np.int64), np.array([r[1] for r in found], np.int64), y


def _matrix(rows: np.ndarray, feats: np.ndarray, n: int, keep: np.ndarray) -> np.ndarray:
    index = np.full(1 << BITS, -1, np.int32)
    index[keep] = np.arange(len(keep))
    at = index[feats]
    x = np.zeros((n, len(keep)))
    x[rows[at >= 0], at[at >= 0]] = 1
    return x


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Chain | None:
    """The chain for these labels; None if a class has no labelled document."""
    table, names, total = sampled(docs, labels, sample)
    links = len(names)
    counts, sums = _counts(table, links)
    if not sums[-1].sum(0).all():
        return None
    pick = lambda i, c, s: chosen(c[i, 1], c[i, 0], s[i, 1], s[i, 0])
    whole = [pick(i, counts.sum(1), sums.sum(1)) for i in range(links)]
    # what a fold's models choose from: the counts of the other folds
    part = [[pick(i, counts.sum(1) - counts[:, f], sums.sum(1) - sums[:, f]) for f in range(FOLDS)] for i in range(links)]
    wanted = np.zeros(1 << BITS, bool)
    for keep in [*whole, *(k for ks in part for k in ks)]:
        wanted[keep] = True
    rows, feats, fold, ys = _collected(table, links, wanted)
    n, models = len(ys), []
    extra = np.zeros((n, 0))
    for i in range(links):
        y, out = ys[:, i], np.zeros(n)
        for f in range(FOLDS):
            x = np.column_stack([_matrix(rows, feats, n, part[i][f]), extra])
            seen = (fold != f) & (y >= 0)
            w = fit_link(x[seen], y[seen])
            out[fold == f] = _sigmoid(x[fold == f] @ w[:-1] + w[-1])
        x = np.column_stack([_matrix(rows, feats, n, whole[i]), extra])
        models.append(fit_link(x[y >= 0], y[y >= 0]))
        extra = np.column_stack([extra, out])
    y = ys[:, -1]
    weight = np.array([total.get(t, 0) / max(1, int((y == t).sum())) for t in (0, 1)])[y]  # how many labelled documents each stands for
    return Chain(names, whole, models, best_threshold(extra[:, -1], y, weight))


def best_threshold(p: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The threshold of greatest F1 over weighted documents, in the middle between two probabilities."""
    order = np.argsort(-p, kind="stable")
    hit = np.cumsum((weight * y)[order])
    f1 = 2 * hit / (np.cumsum(weight[order]) + (weight * y).sum())
    ends = np.append(p[order][1:] != p[order][:-1], True)
    at = int(np.argmax(np.where(ends, f1, 0)))
    return float((p[order][at] + (p[order][at + 1] if at + 1 < len(p) else 0.0)) / 2)


def score(docs: DataFrame, chain: Chain | None) -> DataFrame:
    """All columns of ``docs`` with ``p_<category>`` for each link and ``is_toxic``."""
    names = [f"p_{c}" for c in (chain.names if chain else LINKS)]
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in (*names, "is_toxic")))
    if chain is None:
        return docs.select("*", *(F.lit(0.0).alias(n) for n in names), F.lit(False).alias("is_toxic"))
    place = docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, T.DoubleType()) for n in names), T.StructField("is_toxic", T.BooleanType())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(place).cast(pa.string()))
            parts = [np.zeros((0, len(names)))]
            for a, b in chunks(offsets):
                doc, feat = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], chain.wanted)
                parts.append(chain.predict(doc, feat, b - a))
            p = np.concatenate(parts).round(9)
            toxic = (p[:, -1] >= chain.threshold) & (np.diff(offsets) > 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(p[:, k]) for k in range(len(names))), pa.array(toxic)], [*batch.schema.names, *names, "is_toxic"])

    return docs.mapInArrow(rows, schema)


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Fit the chain on the labels and score all documents."""
    return score(docs, fit(docs, labels, sample))
