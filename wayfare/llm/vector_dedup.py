"""Near duplicates of embeddings of one label, by Euclidean p-stable hashing and exact cosines.

1. Rows of one label and equal components are one class, with its number of rows; so exact copies, however many, are one
   vector from here on.
2. Vectors are divided by their length, so a cosine of c is a Euclidean distance of sqrt(2 - 2c).  A table's key of a
   vector is its label and HASHES values floor((a . v + b) / WIDTH), with a drawn from the normal distribution (which is
   2-stable: a . (u - v) is normal with the distance as its deviation) and b uniform in 0..WIDTH.  There are TABLES of them.
   At a cosine of 0.98 a value is equal with probability 0.92, a key with 0.26, and some key with 0.998.
3. Classes that share a key are compared by exact cosines.  A key of many classes is dealt into blocks by a hash of
   class and key, and each pair of blocks is one group, so no task holds more than two blocks' vectors.
   A pair is counted in the first table whose key both share: nothing is counted twice, and no pairs are written.  A group
   gives each of its vectors how many vectors it is linked with, and links that span what is connected.
4. Connected components of these links.

Defined results: a row whose label or vector is null, or whose vector is zero, empty or has a component that is null or
not finite, is linked with nothing; it stays, and is its own component.  Repeated rows, and rows of one id, are vectors of
their own (copies are linked with each other).  A row without ``vec_id`` is linked like any other, names no component, and is kept;
a component without any id has none.  A shorter vector counts as followed by zeros.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm.text import U64, mix
from wayfare.llm.vectors import keyed, matrix, whole
from wayfare.operators.components import components
from wayfare.plans.scratch import stored

TABLES, HASHES, WIDTH = 20, 16, 2.0
#: Classes of one key in a block, on average.
BLOCK = 1024


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; a row is first divided by its largest component, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def table_keys(x: np.ndarray, label: np.ndarray, seed: int = 13) -> np.ndarray:
    """The key of each unit vector in each table."""
    rng = np.random.default_rng(seed)
    b = rng.uniform(0, WIDTH, TABLES * HASHES)
    a = rng.standard_normal((x.shape[1], TABLES * HASHES))
    cell = np.floor((x @ a + b) / WIDTH).astype(np.int64).astype(np.uint64).reshape(len(x), TABLES, HASHES)
    key = mix(label.astype(np.int64).astype(np.uint64))[:, None] + np.arange(TABLES, dtype=np.uint64)
    for k in range(HASHES):
        key = mix(key * U64(0x9E3779B97F4A7C15) + cell[:, :, k])
    return key.view(np.int64)


def classes(rows: DataFrame, width: int) -> DataFrame:
    """(cid, copies, embedding, keys) of the classes of rows with a vector and a label."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = table_keys(unit(matrix(batch.column("embedding"), width, np.float64)), batch.column("label").to_numpy())
            at = pa.array(np.arange(0, found.size + 1, TABLES, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.ListArray.from_arrays(at, pa.array(found.reshape(-1)))], ["cid", "copies", "embedding", "keys"])

    same = rows.where("a is not null").groupBy("a", "b").agg(F.min("key").alias("cid"), F.count("*").alias("copies"), F.min_by("embedding", "key").alias("embedding"), F.min("label").alias("label"))
    return same.select("cid", "copies", "embedding", "label").mapInArrow(keys, "cid long, copies long, embedding array<double>, keys array<long>")


def connected(linked: np.ndarray) -> np.ndarray:
    """The least member of each row's component, from a symmetric matrix of links."""
    least = np.arange(len(linked))
    while True:
        new = np.minimum(least, np.where(linked, least[None, :], len(linked)).min(1, initial=len(linked)))
        new = np.minimum(new, new[new])
        if (new == least).all():
            return least
        least = new


def _linked(width: int, least: float):
    """A task over groups of one key and one pair of blocks: (kind 0, cid, vectors it is linked with), and spanning links (kind 1, u, v)."""

    def group(g: pa.Table) -> Iterator[pa.RecordBatch]:
        if g.num_rows < 2:
            return
        cid, copies, block = (g.column(c).to_numpy() for c in ("cid", "copies", "block"))
        x = unit(matrix(g.column("embedding").combine_chunks(), width, np.float64))
        keys = matrix(g.column("keys").combine_chunks(), TABLES, np.int64)
        table = int(np.flatnonzero(keys[0] == g.column("gkey")[0].as_py())[0])
        cross = g.column("lo")[0].as_py() != g.column("hi")[0].as_py()
        close = (x @ x.T >= least) & ~np.eye(len(x), dtype=bool)
        if cross:
            close &= block[:, None] != block[None, :]
        i, j = np.nonzero(close)
        if not len(i):
            return
        root = connected(close)
        new = np.ones(len(i), bool)
        for t in range(table):
            new &= keys[i, t] != keys[j, t]
        n = np.bincount(i[new], copies[j[new]], len(cid)).astype(np.int64)
        counted, hung = np.flatnonzero(n), np.flatnonzero(root != np.arange(len(cid)))
        u, v = np.concatenate([cid[counted], cid[hung]]), np.concatenate([n[counted], cid[root[hung]]])
        kind = np.repeat(np.array([0, 1], np.int32), [len(counted), len(hung)])
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (kind, u, v)], ["kind", "u", "v"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            mark = [batch.column(c).to_numpy() for c in ("gkey", "lo", "hi")]
            ends = np.flatnonzero(np.any([m[1:] != m[:-1] for m in mark], axis=0)) + 1
            for s, e in zip([0, *ends.tolist()], [*ends.tolist(), batch.num_rows]):
                own = batch.slice(s, e - s)
                if held and any(held[0].column(c)[0] != own.column(c)[0] for c in ("gkey", "lo", "hi")):
                    yield from group(pa.Table.from_batches(held))
                    held = []
                held.append(own)
        if held:
            yield from group(pa.Table.from_batches(held))

    return task


def vector_duplicates(vectors: DataFrame, least: float = 0.98) -> DataFrame:
    """For each row: vec_id, n_links (other vectors of its label at a cosine of ``least`` or more), component_id (the least
    vec_id reachable over links) and kept (it is that vector)."""
    spark = vectors.sparkSession
    rows = keyed(vectors)
    ok = F.col("label").isNotNull() & whole("embedding") & F.exists("embedding", lambda x: x != 0)
    hashes = [F.when(ok, F.xxhash64(F.lit(k), "label", "embedding")).alias(c) for k, c in ((1, "a"), (2, "b"))]
    rows = stored(rows.select("key", "vec_id", "label", "embedding", *hashes), "vectors")
    width = rows.agg(F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()[0]
    held = stored(classes(rows, width), "classes")
    keys = held.select("cid", F.explode("keys").alias("gkey"))
    crowds = keys.groupBy("gkey").agg(F.count("*").alias("n")).where("n > 1")
    own = keys.join(crowds.select("gkey", F.ceil(F.col("n") / BLOCK).alias("blocks")), "gkey")
    own = own.withColumn("block", F.pmod(F.xxhash64("cid", "gkey"), F.col("blocks")))
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    met = met.select("cid", "gkey", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = met.join(held, "cid").repartition(parts, "gkey", "lo", "hi").sortWithinPartitions("gkey", "lo", "hi")
    found = stored(dealt.mapInArrow(_linked(width, least), "kind int, u long, v long"), "found")
    links = found.where("kind = 0").groupBy(F.col("u").alias("cid")).agg(F.sum("v").alias("n"))
    comps = components(found.where("kind = 1").select("u", "v"))
    sized = held.select("cid", "copies").join(links, "cid", "left").join(comps.withColumnRenamed("id", "cid"), "cid", "left")
    sized = sized.select("cid", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "cid").alias("component"))
    ids = rows.where("a is not null").groupBy("a", "b").agg(F.min("key").alias("cid"), F.min("vec_id").alias("id"))
    sized = stored(sized.join(ids, "cid"), "sized")
    least_id = sized.groupBy("component").agg(F.min("id").alias("component_id"))
    named = sized.join(least_id, "component").select("a", "b", "n_links", "component_id")
    out = rows.select("vec_id", "a", "b").join(named, ["a", "b"], "left")
    component = F.when(F.col("a").isNotNull(), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
