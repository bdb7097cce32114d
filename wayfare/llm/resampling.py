"""Importance resampling towards a target distribution, over hashed word features.

1. Words are the runs of ASCII letters, digits and non-ASCII bytes, A-Z lower-cased; features are all runs of 1 to
   ``longest`` of them, joined by a space.  A feature's bucket is the CRC-32 of its bytes modulo ``buckets``.
2. One pass over the documents and one over the target text count features by bucket; tasks add up their own counts, so
   a task sends at most ``buckets`` rows, and the driver gets ``buckets`` sums, whatever the input.
3. The gains of all buckets are one array; a document's weight is the floored mean of its features' gains, and its score
   adds Gumbel noise from a keyed hash of its id.  So the best scores are a draw without replacement by weight.
4. Scores are integers in a range that the counts bound (some ten thousand values), so their exact histogram is small.
   Its sums from the highest score on are the ranks at which each score starts, and give the cutoff score; only rows
   from there on are ranked, each score apart, by ``row_number`` over ``doc_id``.  No sort spans the table.

Rows of one score, id and weight are the same draw: they are counted before the window and dealt out after it, so a
row that repeats without end makes no hot group.

Defined results: null, empty or wordless texts have no features, weight 0, and are never drawn; a null ``doc_id`` is hashed
as an empty text, and comes last among ties; every row has its own place in the ranking, repeated ones too; an
empty table or target gives weights from the counts as they are (no features: sums of 0); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfare.llm.text import ALNUM, Words, by_document, chunks, small_batches, utf8
from wayfare.plans.scratch import stored

_POLYNOMIAL = 0xEDB88320


def _table() -> np.ndarray:
    value = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        value = np.where(value & 1, value >> 1 ^ np.uint32(_POLYNOMIAL), value >> 1).astype(np.uint32)
    return value


_STEP = _table()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def crc32(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of the bytes of each range: all ranges at once, byte by byte, the longer ones on."""
    size = end - start
    order = np.argsort(-size, kind="stable")
    at, left = start[order], size[order]
    value = np.full(len(order), 0xFFFFFFFF, np.uint32)
    live = len(order)
    for k in range(int(left[0]) if live else 0):
        live = int(np.searchsorted(-left[:live], -k, "left"))
        value[:live] = _STEP[(value[:live] ^ data[at[:live] + k]) & 0xFF] ^ (value[:live] >> np.uint32(8))
    out = np.empty(len(order), np.uint32)
    out[order] = ~value
    return out


def features(data: np.ndarray, offsets: np.ndarray, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each feature, the bounds of each text's features, words of each text)."""
    w = Words(data, offsets, ALNUM)
    # the texts' words with one space between them: a run of words is a range of these bytes
    size = w.end - w.start
    first = np.cumsum(size + 1) - (size + 1)
    joined = np.full(int((size + 1).sum()), 0x20, np.uint8)
    byte = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    joined[np.repeat(first, size) + byte] = _LOWER[data[np.repeat(w.start, size) + byte]]
    doc = np.repeat(np.arange(len(w.count)), w.count)
    docs, found = [], []
    for n in range(1, longest + 1):
        lead = np.flatnonzero(np.arange(len(size)) + n <= w.first[doc + 1]) if len(size) else np.empty(0, np.int64)
        last = lead + n - 1
        docs.append(doc[lead])
        found.append(crc32(joined, first[lead], first[last] + size[last]) % np.uint32(buckets))
    docs, found = np.concatenate(docs), np.concatenate(found).astype(np.int64)
    if longest > 1:
        order = np.argsort(docs, kind="stable")
        docs, found = docs[order], found[order]
    return found, np.searchsorted(docs, np.arange(len(w.count) + 1)), w.count


def bucket_counts(texts: DataFrame, longest: int, buckets: int) -> np.ndarray:
    """How often each bucket occurs in all texts (a column ``text``)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for a, b in chunks(offsets):
                total += np.bincount(features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], longest, buckets)[0], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    rows = texts.select(F.col("text").cast("string")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n"))
    for bucket, n in rows.collect():  # one row a bucket
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * log ratio) of each bucket's smoothed shares in the target and in the source, in doubles."""
    s, t, n = source.astype(float), target.astype(float), float(len(source))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, longest: int) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each document."""
    buckets = len(gain)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for a, b in chunks(offsets):
                found, bounds, words = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], longest, buckets)
                n = np.diff(bounds)
                weight = by_document(gain[found], bounds) // np.maximum(n, 1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(words.astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(score, "doc_id long, n_words long, n_features long, weight long")


def importance_resample(docs: DataFrame, target: DataFrame, share: int = 10, least: int = 20, seed: str = "2024", longest: int = 1, buckets: int = 10_000) -> DataFrame:
    """For each document: doc_id, n_features, weight, score and rank (1 on for the floor(share * N / 100) drawn ones, else null),
    where N counts the documents of at least ``least`` words; ``target`` has a column ``text``."""
    small_batches(docs.sparkSession)
    gain = gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    rows = stored(weighted(docs, gain, longest).withColumn("score", F.col("weight") + noise), "scores")
    may = rows.where(F.col("n_words") >= least)
    histogram = sorted(may.groupBy("score").count().collect(), reverse=True)  # one row a score
    wanted = share * sum(n for _, n in histogram) // 100
    starts, seen = [], 0
    for score, n in histogram:
        if seen >= wanted:
            break
        starts.append((score, seen))
        seen += n
    named = ["doc_id", "n_features", "weight", "score"]
    if not starts:
        return rows.select(*named, F.lit(None).cast("long").alias("rank"))
    drawable = (F.col("n_words") >= least) & (F.col("score") >= starts[-1][0])
    alike = rows.where(drawable).groupBy(*named).agg(F.count("*").alias("copies"))
    order = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_features", "weight").rowsBetween(Window.unboundedPreceding, 0)
    placed = alike.withColumn("last", F.sum("copies").over(order)).withColumn("place", F.explode(F.expr("sequence(last - copies + 1, last)")))
    begins = F.broadcast(docs.sparkSession.createDataFrame(starts, "score long, before long"))  # at most one row a score
    rank = F.col("before") + F.col("place")
    ranked = placed.join(begins, "score").select(*named, F.when(rank <= wanted, rank).alias("rank"))
    return ranked.unionByName(rows.where(~drawable).select(*named, F.lit(None).cast("long").alias("rank")))


def drawn(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The documents of the drawn ids, with all their columns; rows without ``doc_id`` are not among them."""
    ids = importance_resample(docs, target, **options).where("rank is not null and doc_id is not null").select("doc_id").distinct()
    return docs.join(ids.withColumnRenamed("doc_id", "drawn_id"), F.col("doc_id").cast("long") == F.col("drawn_id"), "left_semi")
