"""Distances of a mask's cells to the nearest cell outside of it, exactly: a pass along columns, then one along rows.

With an extent, cells outside of it do not exist: a cell of a plan without any cell outside the mask has no distance
(null).  Without one, everything outside the mask counts.  Each pass is a shuffle by column or row; nothing iterates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfare.operators.runs import BITS, Extent

#: A distance along a column that stands for none: longer than any, so that its square outweighs the square of any other.
NONE = 1 << (BITS + 1)
#: Cells whose rows are worked on at once.
CELLS = 1 << 19


def _end(axis: str, last: Column, size: int | None) -> tuple[Column, Column]:
    """Steps from a cell to the cell before its run and to the one after it (NONE where the extent ends)."""
    first, after = F.col(axis) - F.col("first") + 1, last - F.col(axis) + 1
    if size is None:
        return first, after
    return F.when(F.col("first") == 0, NONE).otherwise(first), F.when(last == size - 1, NONE).otherwise(after)


def _columns(mask: DataFrame, extent: Extent | None) -> DataFrame:
    """(plan_id, x, y, g): steps to the nearest cell of the column that is outside the mask."""
    column = Window.partitionBy("plan_id", "x").orderBy("y")
    cells = mask.select("plan_id", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y")).repartition("plan_id", "x").distinct()
    cells = cells.withColumn("part", F.col("y") - F.row_number().over(column))
    run = Window.partitionBy("plan_id", "x", "part")
    ends = cells.withColumn("first", F.min("y").over(run)).withColumn("last", F.max("y").over(run))
    return ends.select("plan_id", "x", "y", F.least(*_end("y", F.col("last"), extent and extent[1])).cast("long").alias("g"))


def city_block(mask: DataFrame, extent: Extent | None = None) -> DataFrame:
    """(plan_id, x, y, d1): steps along the axes to the nearest cell outside the mask."""
    row = Window.partitionBy("plan_id", "y").orderBy("x")
    cells = _columns(mask, extent).withColumn("part", F.col("x") - F.row_number().over(row))
    run = Window.partitionBy("plan_id", "y", "part").orderBy("x")
    ends = cells.withColumn("first", F.min("x").over(Window.partitionBy("plan_id", "y", "part"))).withColumn("last", F.max("x").over(Window.partitionBy("plan_id", "y", "part")))
    left = F.min(F.col("g") - F.col("x")).over(run.rowsBetween(Window.unboundedPreceding, 0)) + F.col("x")
    right = F.min(F.col("g") + F.col("x")).over(run.rowsBetween(0, Window.unboundedFollowing)) - F.col("x")
    d = F.least(left, right, *_end("x", F.col("last"), extent and extent[0]))
    return ends.select("plan_id", "x", "y", d.alias("d")).select("plan_id", "x", "y", F.when(F.col("d") < NONE // 2, F.col("d")).alias("d1"))


def envelopes(g: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each place p of a row the least (p - q)^2 + g[q]^2 over its places q; row i is ``bounds[i]:bounds[i + 1]``.

    The best q never falls as p rises.  So places are settled from coarse to fine: one between two settled ones looks only
    from the one's best to the other's.  All rows take a step at once; a step looks at each place about once.
    """
    size = np.diff(bounds)
    row = np.repeat(np.arange(len(size)), size)
    start = bounds[:-1][row]
    local = np.arange(len(g)) - start
    square = g * g
    best = np.zeros(len(g), np.int64)  # relative to the row's start
    out = np.zeros(len(g), np.int64)

    def settle(at: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        n = high - low + 1
        begin = np.cumsum(n) - n
        q = np.arange(n.sum()) - np.repeat(begin - low, n)
        p = np.repeat(at, n)
        cost = (local[p] - q) ** 2 + square[start[p] + q]
        least = np.minimum.reduceat(cost << BITS | q, begin)
        best[at], out[at] = least & ((1 << BITS) - 1), least >> BITS

    first = bounds[:-1][size > 0]
    if not len(first):
        return out
    settle(first, np.zeros(len(first), np.int64), size[size > 0] - 1)
    step = 1 << int(size.max() - 1).bit_length()
    while step:
        at = np.flatnonzero((local & (2 * step - 1)) == step)
        if len(at):
            last = size[row[at]] - 1
            onto = np.minimum(at + step, len(g) - 1)
            settle(at, best[at - step], np.where(local[at] + step <= last, best[onto], last))
        step >>= 1
    return out


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("g")
        size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        bounds = np.concatenate([[0], np.cumsum(size)])
        flat, out, a = lists.flatten().to_numpy().astype(np.int64), [], 0
        while a < len(size):
            b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + CELLS, "right")) - 1)
            out.append(envelopes(flat[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]))
            a = b
        d2 = np.concatenate(out) if out else flat
        d2 = pa.array(d2, pa.int64(), mask=d2 >= NONE * NONE // 2)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("plan_id", "y", "x1")), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), d2)], ["plan_id", "y", "x1", "d2"])


def euclidean(mask: DataFrame, extent: Extent | None = None) -> DataFrame:
    """(plan_id, x, y, d2): the squared distance to the nearest cell outside the mask.

    Each run of a row is a list of its cells' distances along columns, with the cells outside at its ends (0, or NONE where
    the extent ends); the least (x - x')^2 + g(x')^2 is their lower envelope of parabolas.
    """
    row = Window.partitionBy("plan_id", "y").orderBy("x")
    cells = _columns(mask, extent).withColumn("part", F.col("x") - F.row_number().over(row))
    runs = cells.groupBy("plan_id", "y", "part").agg(F.array_sort(F.collect_list(F.struct("x", "g"))).alias("c")).select("plan_id", "y", F.col("c")[0]["x"].alias("x1"), F.col("c.g").alias("g"))
    end = lambda here: F.when(here, NONE).otherwise(0).cast("long") if extent else F.lit(0).cast("long")
    left, right = F.col("x1") == 0, F.col("x1") + F.size("g") == (extent[0] if extent else -1)
    rows = runs.select("plan_id", "y", "x1", F.concat(F.array(end(left)), "g", F.array(end(right))).alias("g"))
    found = rows.mapInArrow(_rows, "plan_id long, y long, x1 long, d2 array<long>")
    inner = found.select("plan_id", "y", "x1", F.posexplode(F.slice("d2", 2, F.size("d2") - 2)).alias("k", "d2"))
    return inner.select("plan_id", (F.col("x1") + F.col("k")).alias("x"), "y", "d2")


def ridge(mask: DataFrame, extent: Extent | None = None) -> DataFrame:
    """Cells (plan_id, x, y) from which no step along an axis leads farther from the outside: the morphological skeleton by a cross.

    What n erosions leave are the cells more than n steps from the outside, and an opening of that takes away those that
    have no neighbour at n + 2.  Plans that are in the mask as a whole have none.
    """
    d = city_block(mask, extent).where("d1 is not null")
    for axis, other in (("x", "y"), ("y", "x")):
        line = Window.partitionBy("plan_id", other).orderBy(axis)
        near = [F.when(f(axis).over(line) == F.col(axis) + s, f(c).over(line)) for f, s, c in ((F.lag, -1, "d1"), (F.lead, 1, "d1"))]
        d = d.withColumn(f"most_{axis}", F.greatest(*near))
    return d.where(F.coalesce(F.greatest("most_x", "most_y"), F.lit(0)) <= F.col("d1")).select("plan_id", "x", "y")
