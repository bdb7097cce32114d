"""Token ids as raw binary shards with keyed access.

Documents are dealt by ranges of ``doc_id``; a task writes its documents in ascending order as shards:

* payload: the ids of all documents one after another, 2 bytes each where the vocabulary allows it, else 4;
* index: where each document begins, and a minimal perfect hash of the shard's keys (levels of bit arrays: a
  key sits at the first level where no other key has its place; its rank among set bits is its slot).  A slot
  holds a 32-bit fingerprint of the key, its first document and how many documents have the key.

A lookup takes constant time: a few bit tests, a rank, a fingerprint and a range of the payload.  The manifest,
a Parquet table, lists the shards in order with their key ranges and totals; shards that a failed attempt of a
task wrote are in no manifest.

Defined results: null texts are empty; null keys come first, and are reached by position only; documents with one
key are kept together and a lookup returns them all (in each shard whose key range has the key); an empty table
gives an empty manifest.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfare.llm.files import get, put
from wayfare.llm.text import U64, gathered, mix, small_batches
from wayfare.llm.tokens import AT_ONCE, encoder
from wayfare.plans.scratch import new_path, stored

MANIFEST = "part int, seq int, payload string, keys string, first_key long, last_key long, n_docs long, n_tokens long"
_SPREAD = 2  # places for each key at a level


def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(keys ^ mix(np.array([level + 1], np.uint64))) % U64(size)).astype(np.int64)


def fingerprint(keys: np.ndarray) -> np.ndarray:
    """32 bits of a key, independent of its places."""
    return (mix(keys + U64(0xA0761D6478BD642F)) >> U64(32)).astype(np.uint32)


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys onto 0..n-1."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.base = np.concatenate([[0], np.cumsum([int(x.sum()) for x in levels])])
        self.ranks = [np.cumsum(x) - 1 for x in levels]

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], keys
        while len(left):
            size = max(8, _SPREAD * len(left))
            at = _place(left, len(levels), size)
            bits = np.bincount(at, minlength=size) == 1
            levels.append(bits)
            left = left[~bits[at]]
        return cls(levels)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 for keys that end at no level (other keys may get any slot: compare fingerprints)."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for k, bits in enumerate(self.levels):
            at = _place(keys[left], k, len(bits))
            hit = bits[at]
            out[left[hit]] = self.base[k] + self.ranks[k][at[hit]]
            left = left[~hit]
        return out


def index_bytes(keys: list[int | None], starts: np.ndarray, width: int) -> bytes:
    """The index of a shard whose documents have these keys in order and begin at these places."""
    nulls = sum(k is None for k in keys)
    ordered = np.array(keys[nulls:], np.int64)
    own, first, count = np.unique(ordered, return_index=True, return_counts=True)
    own = own.view(np.uint64)
    mph = PerfectHash.build(own)
    slot = mph(own)
    prints, docs, counts = np.zeros(len(own), "<u4"), np.zeros(len(own), "<u4"), np.zeros(len(own), "<u4")
    prints[slot], docs[slot], counts[slot] = fingerprint(own), first + nulls, count
    levels = [np.packbits(x).tobytes() for x in mph.levels]
    parts = [starts.astype("<u8").tobytes(), prints.tobytes(), docs.tobytes(), counts.tobytes(), ordered.astype("<i8").tobytes(), *levels]
    head = json.dumps({"width": width, "docs": len(keys), "keys": len(own), "nulls": nulls, "levels": [len(x) for x in mph.levels]}).encode()
    return b"WFTX" + len(head).to_bytes(4, "little") + head + b"".join(parts)


class Shard:
    """A shard opened for reading."""

    def __init__(self, payload: str, keys: str):
        raw = get(keys)
        n = int.from_bytes(raw[4:8], "little")
        head, at = json.loads(raw[8 : 8 + n]), 8 + n

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, count, at)
            at += out.nbytes
            return out

        self.payload, self.width, self.nulls = payload, head["width"], head["nulls"]
        self.starts = take("<u8", head["docs"] + 1).astype(np.int64)
        self.prints, self.docs, self.counts = (take("<u4", head["keys"]) for _ in range(3))
        self.keys = take("<i8", head["docs"] - head["nulls"])
        self.mph = PerfectHash([np.unpackbits(take("u1", (size + 7) // 8))[:size].astype(bool) for size in head["levels"]])

    def lookup(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first document, number of documents) of each key; 0 documents where the shard doesn't have it."""
        keys = np.asarray(keys, np.int64).view(np.uint64)
        slot = self.mph(keys)
        ok = slot >= 0
        ok[ok] = self.prints[slot[ok]] == fingerprint(keys[ok])
        # a fingerprint of 32 bits refuses nearly all keys that are not there, and the key itself the others
        ok[ok] = self.keys[self.docs[slot[ok]].astype(np.int64) - self.nulls].view(np.uint64) == keys[ok]
        first, count = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        first[ok], count[ok] = self.docs[slot[ok]], self.counts[slot[ok]]
        return first, count

    def ids(self, doc: int) -> np.ndarray:
        """The ids of a document by its position, read from the payload."""
        a, b = self.starts[doc], self.starts[doc + 1]
        return np.frombuffer(get(self.payload, int(a) * self.width, int(b - a) * self.width), f"<u{self.width}")


def write_index(docs: DataFrame, folder: str, vocabulary: str, end_id: int, width: int = 2, shard_tokens: int = 8_000_000) -> DataFrame:
    """Write shards to ``folder`` and return the manifest, in order of (part, seq)."""
    spark = docs.sparkSession
    small_batches(spark)
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("tie"))
    ordered = rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, tokens, kind = TaskContext.get().partitionId(), 0, encoder(vocabulary), f"<u{width}"
        keys, sizes, held, total = [], [np.zeros(1, np.int64)], [], 0

        def shard() -> pa.RecordBatch:
            starts, own = np.cumsum(np.concatenate(sizes)), [k for k in keys if k is not None]
            row = {"part": part, "seq": seq, "payload": put(f"{folder}/ids", f"{part:06d}-{seq:04d}", b"".join(held)), "keys": put(f"{folder}/keys", f"{part:06d}-{seq:04d}", index_bytes(keys, starts, width))}
            row |= {"first_key": min(own, default=None), "last_key": max(own, default=None), "n_docs": len(keys), "n_tokens": total}
            types = [pa.int32(), pa.int32(), pa.string(), pa.string(), *[pa.int64()] * 4]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), types)], list(row))

        for batch in gathered(batches, size=AT_ONCE):
            ids, bounds = tokens.documents(batch.column(1), end_id)
            if width == 2 and ids.max(initial=0) > 0xFFFF:
                raise ValueError("the vocabulary needs ids of 4 bytes")
            a, n = 0, batch.num_rows
            while a < n:  # documents up to the one that fills the shard
                b = min(n, max(a + 1, int(np.searchsorted(bounds, bounds[a] + shard_tokens - total))))
                held.append(ids[bounds[a] : bounds[b]].astype(kind).tobytes())
                keys += batch.column(0).slice(a, b - a).to_pylist()
                sizes.append(np.diff(bounds[a : b + 1]))
                total += int(bounds[b] - bounds[a])
                if total >= shard_tokens:
                    yield shard()
                    keys, sizes, held, total, seq = [], [np.zeros(1, np.int64)], [], 0, seq + 1
                a = b
        if keys:
            yield shard()

    ordered.select("doc_id", "text").mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")
    return open_manifest(spark, folder)


def open_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest, with ``base``: the tokens of all shards before.  It has a row for each shard."""
    rows = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_documents(manifest: DataFrame) -> DataFrame:
    """Every document from the files, each looked up by its key: doc_id, start, n_tokens, ids_crc32."""
    parts = max(manifest.sparkSession.sparkContext.defaultParallelism, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload, keys, base in zip(*(batch.column(k).to_pylist() for k in range(3))):
                shard = Shard(payload, keys)
                ids = np.frombuffer(get(payload), f"<u{shard.width}")
                own = np.unique(shard.keys)
                first, count = shard.lookup(own)
                if (count == 0).any():
                    raise ValueError(f"{keys} lacks keys of its own")
                docs = np.concatenate([np.arange(shard.nulls), np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)])
                names = pa.array([None] * shard.nulls + np.repeat(own, count).tolist(), pa.int64())
                a, b = shard.starts[docs], shard.starts[docs + 1]
                crc = [zlib.crc32(ids[s:e].astype("<u4").tobytes()) for s, e in zip(a.tolist(), b.tolist())]
                yield pa.RecordBatch.from_arrays([names, pa.array(a + base), pa.array(b - a), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return manifest.select("payload", "keys", "base").repartition(parts, "payload").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _holding(wanted: DataFrame, shards: DataFrame) -> DataFrame:
    """(doc_id, payload, keys): for each wanted key the last shard that begins before it, if it does not end before it.

    Keys and shards are sorted together over all tasks; a task whose keys come before its first shard is told the last
    shard of the tasks before it.
    """
    spark = wanted.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    shard = F.struct("first_key", "last_key", "payload", "keys")
    rows = shards.select(F.col("first_key").alias("at"), shard.alias("shard")).unionByName(wanted.select(F.col("doc_id").alias("at"), "doc_id"), allowMissingColumns=True)
    rows = stored(rows.repartitionByRange(parts, "at").withColumn("part", F.spark_partition_id()), "fetch")
    before = F.max("last").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row a task
    told = rows.groupBy("part").agg(F.max("shard").alias("last")).select("part", before.alias("told"))
    own = F.last("shard", ignorenulls=True).over(Window.partitionBy("part").orderBy("at", F.col("doc_id").asc_nulls_first(), "shard"))
    found = rows.join(told, "part").select("doc_id", F.coalesce(own, "told").alias("shard")).where("doc_id is not null and doc_id <= shard.last_key")
    return found.select("doc_id", "shard.payload", "shard.keys")


def fetch(manifest: DataFrame, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """Keyed access: the ids of the documents with the given keys, (doc_id, ids).

    A key inside the range of a shard is in this shard alone; one at the edge of a range may be in several, and is
    joined by the edge itself.
    """
    shards = manifest.where("first_key is not null").select("first_key", "last_key", "payload", "keys")
    edges = shards.select(F.explode(F.array_distinct(F.array("first_key", "last_key"))).alias("doc_id"), "payload", "keys")
    wanted = keys.select(F.col(key).cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    found = wanted.join(edges, "doc_id").unionByName(_holding(wanted.join(edges, "doc_id", "left_anti"), shards))

    def read(table: pa.Table) -> pa.Table:
        shard = Shard(table.column("payload")[0].as_py(), table.column("keys")[0].as_py())
        own = np.sort(table.column("doc_id").to_numpy())
        first, count = shard.lookup(own)
        rows = [(k, shard.ids(d).tolist()) for k, f, c in zip(own.tolist(), first.tolist(), count.tolist()) for d in range(f, f + c)]
        return pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "ids": pa.array([r[1] for r in rows], pa.list_(pa.int64()))})

    return found.groupBy("payload").applyInArrow(read, "doc_id long, ids array<long>")


def token_index(docs: DataFrame, vocabulary: str, end_id: int = 2) -> DataFrame:
    """Write the index of all documents to the shared folder and return every document as read back from it."""
    return read_documents(write_index(docs, new_path(docs.sparkSession, "token-index"), vocabulary, end_id))
