"""Connected components of an undirected edge table (Kiveris et al. 2014: alternating large-star and small-star)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.plans.scratch import stored


#: Rows of a round for each file, at least.
ROWS_A_FILE = 250_000
#: Tables of no more rows than this (8 MB of pairs) are settled by one task at once, not in rounds.
FEW = 1 << 19


def few(df: DataFrame, files: int) -> DataFrame:
    """``df`` in no more than so many partitions: tables that are known to be small are not written as many small files."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.coalesce(files) if files < parts else df


def _stars(both: DataFrame, keep: Column) -> DataFrame:
    """Each node u hangs those neighbours that ``keep`` names, and itself, on the least of its neighbours and itself."""
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    joined = both.join(least.repartition("u", "m"), "u")
    return joined.where(keep & (F.col("v") != F.col("m"))).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _round(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = _stars(both, F.col("v") > F.col("u")).distinct()
    down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    hung = down.join(least.repartition("u", "m"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def settled(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the least node of each one's component: roots are hung on lesser roots, and paths halved, until no edge joins two."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        new = low < high
        if not new.any():
            return nodes, nodes[root]
        np.minimum.at(root, high[new], low[new])
        while (root[root] != root).any():
            root = root[root]


def _at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pairs = [b for b in batches if b.num_rows]
    if pairs:
        rows = pa.Table.from_batches(pairs)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in settled(rows.column("u").to_numpy(), rows.column("v").to_numpy())], ["id", "component"])


def near(bits: int = 14) -> Callable[[str], Column]:
    """Blocks of 2^``bits`` consecutive numbers, for tables whose neighbours mostly have near numbers."""
    return lambda c: F.shiftright(c, bits)


def blocks_of(pairs: DataFrame, a: str, b: str, block: Callable[[str], Column]) -> DataFrame:
    """``pairs`` in the blocks of both their ends: block, the columns, and whether each end is of that block (own_a, own_b)."""
    both = pairs.withColumn("_a", block(a)).withColumn("_b", block(b)).withColumn("block", F.explode(F.array_distinct(F.array("_a", "_b"))))
    return both.select("*", (F.col("_a") == F.col("block")).alias("own_a"), (F.col("_b") == F.col("block")).alias("own_b")).drop("_a", "_b")


def _settled_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of a block with the least node that they reach within it, and the links of these to nodes of other blocks.

    Links inside are kept as stars of what they join, and those to others as one for each component and node, so a block takes
    memory by nodes, not by links.
    """
    inner, outer = [np.zeros((2, 0), np.int64)], [np.zeros((2, 0), np.int64)]
    held, enough = 0, FEW

    def joined() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        out = np.concatenate(outer, 1)
        alone = np.unique(out[0])
        nodes, root = settled(*np.concatenate([*inner, np.stack([alone, alone])], 1))
        return nodes, root, np.unique(np.stack([root[np.searchsorted(nodes, out[0])], out[1]]), axis=1)

    for batch in batches:
        u, v, inside = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("u", "v", "inside"))
        inner.append(np.stack([u, v])[:, inside])
        outer.append(np.stack([u, v])[:, ~inside])
        held += len(u)
        if held >= enough:
            nodes, root, out = joined()
            inner, outer, held = [np.stack([nodes, root])], [out], 0
            enough = max(FEW, len(nodes) + out.shape[1])
    nodes, root, out = joined()
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(root), pa.nulls(len(nodes), pa.int64())], ["id", "component", "other"])
    if out.shape[1]:
        yield pa.RecordBatch.from_arrays([pa.nulls(out.shape[1], pa.int64()), pa.array(out[0]), pa.array(out[1])], ["id", "component", "other"])


def _by_blocks(edges: DataFrame, block: Callable[[str], Column]) -> DataFrame:
    """``components`` where most edges join nodes of one block: each block is settled by one task, and then what joins blocks."""
    both = edges.withColumn("inside", block("u") == block("v"))
    # an edge goes to the block of u; if v is of another block, that one gets v alone
    ends = F.array(F.struct("u", "v", "inside"), F.struct(F.col("v").alias("u"), "v", F.lit(True).alias("inside")))
    sent = both.select(F.explode(F.when(F.col("inside"), F.slice(ends, 1, 1)).otherwise(ends)).alias("e")).select("e.*").withColumn("block", block("u"))
    rows = stored(sent.groupBy("block").applyInArrow(_settled_block, "id long, component long, other long"), "blocks")
    nodes = rows.where("id is not null").select("id", "component")
    between = rows.where("other is not null").select(F.col("component").alias("u"), "other").join(nodes.select(F.col("id").alias("other"), F.col("component").alias("v")), "other")
    joined = components(between.select("u", "v")).select(F.col("id").alias("component"), F.col("component").alias("least"))
    return nodes.join(joined, "component", "left").select("id", F.coalesce("least", "component").alias("component"))


def components(edges: DataFrame, u: str = "u", v: str = "v", max_rounds: int = 60, block: Callable[[str], Column] | None = None) -> DataFrame:
    """``(id, component)`` for every node of ``edges``; a component is named by its least node.

    Self-loops give a component of their own; null ends are ignored; an empty table gives an empty result.
    Each round is written to the shared folder, so lineage does not grow and a lost executor costs one round.  A table of
    at most FEW edges needs no rounds.  ``block``, if given, numbers a node's block by its name: of a larger table, blocks
    are settled first, and rounds see only what joins them.
    """
    clean = edges.select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v")).where("u is not null and v is not null")
    clean = stored(clean.distinct(), "edges")
    size = clean.count()
    if size <= FEW:
        return clean.coalesce(1).mapInArrow(_at_once, "id long, component long")
    if block is not None:
        return _by_blocks(clean, block)
    files = size // ROWS_A_FILE + 1  # rounds have no more rows
    now = clean.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    mark = F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))
    seen = None
    for _ in range(max_rounds):
        now = stored(few(_round(now), files), "stars")
        state = now.agg(F.count("*"), mark).first()
        if state == seen or not state[0]:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = clean.select(F.col("u").alias("id")).union(clean.select(F.col("v").alias("id"))).distinct()
    return nodes.join(now.select(F.col("u").alias("id"), F.col("v").alias("root")), "id", "left").select("id", F.coalesce("root", "id").alias("component"))
