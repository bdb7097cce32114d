"""Masks coded by intervals: a table (plan_id, y, x1, x2) of the runs of each row's cells that are on, both ends included.

All set operations and neighbourhoods are one sweep along each row: runs, shifted and stretched by the rows of a
kernel, begin and end at events; where the running sum of their weights is high enough, cells are on.  So a step's work
grows with the runs and the kernel's rows, not with cells times the kernel's cells, and takes one shuffle by row.

Results are disjoint, and apart by one cell or more.  An extent is a pair (width, height); cells outside of it do not exist.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfare.functions import geom as g
from wayfare.operators.components import components
from wayfare.plans.scratch import stored

RUN = ["plan_id", "y", "x1", "x2"]
Extent = tuple[int, int]
Kernel = list[tuple[int, int]]
#: Cells are numbered below 2^20 on each axis, plans below 2^PLAN_BITS, so that numbers of cells, of edges between them and of
#: an edge's directions fit in 63 bits.
BITS, PLAN_BITS = 20, 20


def cell_id(x: Column | str = "x", y: Column | str = "y") -> Column:
    """A number for a cell of a plan: by plan, then y, then x."""
    return F.shiftleft(F.col("plan_id"), 2 * BITS) + F.shiftleft(g.col(y).cast("long"), BITS) + g.col(x).cast("long")


def tile(cell: Column | str, bits: int = 9) -> Column:
    """The number of a cell's tile, of 2^``bits`` cells on each side, by the cell's number."""
    low = g.col(cell).bitwiseAND((1 << BITS) - 1)
    return F.shiftleft(F.shiftright(g.col(cell), BITS + bits), BITS - bits).bitwiseOR(F.shiftright(low, bits))


def covered(parts: DataFrame, need: Column | int = 1) -> DataFrame:
    """The runs of cells at which the weights ``w`` of ``parts`` (plan_id, y, x1, x2, w) add up to ``need`` or more.

    ``need`` may depend on ``y``.  Parts may overlap; those that are empty (x2 < x1) do not count.
    """
    two = F.array(F.struct(F.col("x1").cast("long").alias("x"), F.col("w").alias("w")), F.struct((F.col("x2") + 1).cast("long").alias("x"), (-F.col("w")).alias("w")))
    events = parts.where("x1 <= x2").select("plan_id", F.col("y").cast("long").alias("y"), F.explode(two).alias("e")).select("plan_id", "y", "e.*")
    events = events.repartition("plan_id", "y").groupBy("plan_id", "y", "x").agg(F.sum("w").alias("w"))
    row = Window.partitionBy("plan_id", "y").orderBy("x")
    need = need if isinstance(need, Column) else F.lit(need)
    on = events.withColumn("on", F.sum("w").over(row) >= need)
    turns = on.withColumn("was", F.coalesce(F.lag("on").over(row), F.lit(False))).where("`on` <> was")
    return turns.withColumn("x2", F.lead("x").over(row) - 1).where("`on`").select("plan_id", "y", F.col("x").alias("x1"), "x2")


def runs_of(cells: DataFrame) -> DataFrame:
    """The runs of a mask of cells (plan_id, x, y)."""
    row = Window.partitionBy("plan_id", "y").orderBy("x")
    at = cells.select("plan_id", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x")).repartition("plan_id", "y").distinct()
    part = at.withColumn("k", F.col("x") - F.row_number().over(row))
    return part.groupBy("plan_id", "y", "k").agg(F.min("x").alias("x1"), F.max("x").alias("x2")).drop("k")


def cells_of(runs: DataFrame) -> DataFrame:
    return runs.select("plan_id", F.explode(F.sequence("x1", "x2")).alias("x"), "y")


def weighted(runs: DataFrame, w: int = 1) -> DataFrame:
    return runs.select(*RUN, F.lit(w).alias("w"))


def union(*masks: DataFrame) -> DataFrame:
    return covered(reduce(DataFrame.unionByName, map(weighted, masks)))


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return covered(weighted(a).unionByName(weighted(b)), 2)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return covered(weighted(a).unionByName(weighted(b, -1)))


def canvas(plans: DataFrame, extent: Extent) -> DataFrame:
    """A run for each row of each plan."""
    rows = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(extent[1] - 1).cast("long"))).alias("y")
    return plans.select("plan_id").distinct().select("plan_id", rows).select("plan_id", "y", F.lit(0).cast("long").alias("x1"), F.lit(extent[0] - 1).cast("long").alias("x2"))


def clipped(runs: DataFrame, extent: Extent) -> DataFrame:
    inside = runs.where(F.col("y").between(0, extent[1] - 1))
    ends = F.greatest("x1", F.lit(0).cast("long")).alias("x1"), F.least("x2", F.lit(extent[0] - 1).cast("long")).alias("x2")
    return inside.select(*(c for c in runs.columns if c not in ("x1", "x2")), *ends).where("x1 <= x2")


def kernel_rows(kernel: Kernel) -> list[tuple[int, int, int]]:
    """A kernel's rows as (dy, first dx, last dx); a row with gaps has an entry for each piece."""
    out: list[tuple[int, int, int]] = []
    for dx, dy in sorted(set(kernel), key=lambda o: (o[1], o[0])):
        if out and out[-1][0] == dy and out[-1][2] == dx - 1:
            out[-1] = (dy, out[-1][1], dx)
        else:
            out.append((dy, dx, dx))
    return out


def _rows(rows: list[tuple[int, int, int]]) -> Column:
    return F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(a).alias("a"), F.lit(b).alias("b")) for dy, a, b in rows))


def _narrows(rows: list[tuple[int, int, int]]) -> bool:
    """Whether each row of a kernel is one piece, inside that of the row next to it on the way to its own row."""
    by = {dy: (a, b) for dy, a, b in rows}
    inner = lambda dy: by.get(dy - (dy > 0) + (dy < 0), (0, -1))
    return len(by) == len(rows) and all(inner(dy)[0] <= a and b <= inner(dy)[1] for dy, (a, b) in by.items() if dy)


def dilated(runs: DataFrame, kernel: Kernel, extent: Extent) -> DataFrame:
    """Cells that see a cell of the mask through the kernel.

    With a kernel that narrows away from its own row, a cell adds nothing to the rows below if the cell under it is on too,
    and likewise above; so with one of many rows only cells at the lower and the upper rim are moved by all its rows.
    """
    rows = kernel_rows(kernel)

    def seen(part: DataFrame, some: list[tuple[int, int, int]]) -> DataFrame:
        k = part.select(*RUN, F.explode(_rows(some)).alias("k"))
        return k.select("plan_id", (F.col("y") - F.col("k.dy")).alias("y"), (F.col("x1") - F.col("k.b")).alias("x1"), (F.col("x2") - F.col("k.a")).alias("x2"), F.lit(1).alias("w"))

    if len(rows) < 9 or not _narrows(rows):
        return covered(clipped(seen(runs, rows), extent))
    rim = lambda step: difference(runs, runs.withColumn("y", F.col("y") + step))
    own, down, up = ([r for r in rows if test(r[0])] for test in ((0).__eq__, (0).__gt__, (0).__lt__))
    parts = seen(runs, own).unionByName(seen(rim(-1), down)).unionByName(seen(rim(1), up))
    return covered(clipped(parts, extent))


def eroded(runs: DataFrame, kernel: Kernel, extent: Extent) -> DataFrame:
    """Cells that see through the kernel cells of the mask only; places outside the extent do not count.

    Each row of the kernel must be one piece with a cell at dx = 0, and one row must be its own (dy = 0).
    """
    width, height = extent
    if (0, 0) not in kernel or any(a > 0 or b < 0 for _, a, b in kernel_rows(kernel)):
        raise ValueError("a kernel to erode with needs rows of one piece around their middle")
    reach = max(max(-a, b) for _, a, b in kernel_rows(kernel))
    # a run at an edge goes on beyond it, as far as the kernel sees
    open_ends = F.when(F.col("x1") == 0, F.lit(-reach)).otherwise(F.col("x1")).alias("x1"), F.when(F.col("x2") == width - 1, F.lit(width - 1 + reach)).otherwise(F.col("x2")).alias("x2")
    seen = runs.select("plan_id", "y", *open_ends, F.explode(_rows(kernel_rows(kernel))).alias("k"))
    moved = seen.select("plan_id", (F.col("y") - F.col("k.dy")).alias("y"), (F.col("x1") - F.col("k.a")).alias("x1"), (F.col("x2") - F.col("k.b")).alias("x2"), F.lit(1).alias("w"))
    there = reduce(Column.__add__, ((F.col("y") + dy).between(0, height - 1).cast("int") for dy, _, _ in kernel_rows(kernel)))
    return covered(clipped(moved, extent), there)


def median3(runs: DataFrame, extent: Extent) -> DataFrame:
    """The 3 x 3 median: on where five of the nine cells are; beyond the edge the edge's cells repeat."""
    width, height = extent
    near = F.explode(F.array(*(F.lit(d) for d in (-1, 0, 1))))
    wide = runs.select("plan_id", "y", F.when(F.col("x1") == 0, -1).otherwise(F.col("x1")).alias("x1"), F.when(F.col("x2") == width - 1, width).otherwise(F.col("x2")).alias("x2"))
    edge = lambda d, y: (F.col("d") == d) & (F.col("y") == y)
    tall = wide.withColumn("d", near).withColumn("at", F.col("y") + F.col("d")).withColumn("w", F.lit(1))
    # the row beyond an edge is the edge's own, seen from the edge
    tall = tall.unionByName(tall.where(edge(-1, 0) | edge(1, height - 1)).withColumn("at", F.col("y")))
    moved = tall.withColumn("s", near).select("plan_id", F.col("at").alias("y"), (F.col("x1") + F.col("s")).alias("x1"), (F.col("x2") + F.col("s")).alias("x2"), "w")
    return covered(clipped(moved, extent), 5)


def discs(runs: DataFrame, radius: int, extent: Extent) -> DataFrame:
    """Cells at an exact distance of ``radius`` or less from a cell of the mask."""
    from math import isqrt

    return dilated(runs, [(dx, dy) for dy in range(-radius, radius + 1) for dx in range(-isqrt(radius * radius - dy * dy), isqrt(radius * radius - dy * dy) + 1)], extent)


def meeting(a: DataFrame, b: DataFrame, key_a: str, key_b: str) -> DataFrame:
    """(plan_id, u, v): keys of a run of ``a`` and one of ``b`` that share a cell, each pair once.

    Runs of one table are disjoint within a row, so of two that meet the one that begins later begins inside the other: in
    the order of beginnings it needs to be compared with the last of the other table only.
    """
    side = lambda t, k, s: t.select(*RUN, F.col(k).alias("key"), F.lit(s).alias("side"))
    both = side(a, key_a, 0).unionByName(side(b, key_b, 1))
    before = Window.partitionBy("plan_id", "y").orderBy("x1", "side").rowsBetween(Window.unboundedPreceding, -1)
    last = lambda s: F.last(F.when(F.col("side") == s, F.struct("x2", "key")), ignorenulls=True).over(before)
    met = both.withColumn("o", F.when(F.col("side") == 0, last(1)).otherwise(last(0))).where(F.col("o.x2") >= F.col("x1"))
    own, other = F.col("key"), F.col("o.key")
    return met.select("plan_id", F.when(F.col("side") == 0, own).otherwise(other).alias("u"), F.when(F.col("side") == 0, other).otherwise(own).alias("v"))


def labelled(runs: DataFrame, diagonal: bool = True) -> DataFrame:
    """(plan_id, y, x1, x2, label) of disjoint runs: connected ones have one label, the number of their first cell (least y,
    then x).  A stored table."""
    own = stored(runs.select(*RUN).withColumn("run", cell_id("x1", "y")), "runs")
    # two runs meet by a corner if, each longer by a cell to the right, they share a cell
    wide = own.withColumn("x2", F.col("x2") + int(diagonal))
    links = meeting(wide, wide.withColumn("y", F.col("y") - 1), "run", "run")
    return stored(own.join(components(links, block=tile), F.col("run") == F.col("id"), "left").select(*RUN, F.coalesce("component", "run").alias("label")), "labels")


def touching(runs: DataFrame, marks: DataFrame, least: int) -> DataFrame:
    """Components (diagonals count) of ``least`` or more cells that share a cell with ``marks``."""
    labels = labelled(runs)
    touched = meeting(labels, marks.select(*RUN, F.lit(0).alias("mark")), "label", "mark").select(F.col("u").alias("label")).distinct()
    large = labels.groupBy("label").agg(F.sum(F.col("x2") - F.col("x1") + 1).alias("n")).where(F.col("n") >= least).select("label")
    return labels.join(touched, "label", "left_semi").join(large, "label", "left_semi").select(*RUN)


def nesting(runs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """How a mask's components and the holes in them contain each other.

    (components, holes, tree): labelled runs of the mask (diagonals count); labelled runs of what is outside of it
    (sides only), as far as one cell beyond its box; and for each component and hole (plan_id, label, hole, parent): a
    hole's parent is the component around it, a component's the hole that it lies in, null if it lies in none.

    The first run of a component or hole (least y, then x) has what is around it at its left: nothing inside of it
    reaches up to that row.
    """
    mask = labelled(runs)
    box = mask.groupBy("plan_id").agg(F.min("x1").alias("left"), F.max("x2").alias("right"), F.min("y").alias("top"), F.max("y").alias("bottom"))
    whole = box.select("plan_id", F.explode(F.sequence(F.col("top") - 1, F.col("bottom") + 1)).alias("y"), (F.col("left") - 1).alias("x1"), (F.col("right") + 1).alias("x2"))
    # numbers of cells do not go below 0: places are moved by one
    moved = lambda t, d: t.select("plan_id", (F.col("y") + d).alias("y"), (F.col("x1") + d).alias("x1"), (F.col("x2") + d).alias("x2"), *(c for c in t.columns if c not in RUN))
    rest = moved(labelled(moved(difference(whole, mask), 1), diagonal=False), -1)
    first = lambda t: t.groupBy("plan_id", "label").agg(F.min(F.struct("y", "x1")).alias("f")).select("plan_id", "label", "f.y", (F.col("f.x1") - 1).alias("x2"))
    outside = rest.join(box, "plan_id").where("y = top - 1").select("label").distinct()
    holes = stored(rest.join(outside, "label", "left_anti"), "holes")
    around = lambda t: t.select("plan_id", "y", "x2", F.col("label").alias("parent"))
    at = ["plan_id", "y", "x2"]
    named = first(mask).join(around(holes), at, "left").withColumn("hole", F.lit(False))
    inner = first(holes).join(around(mask), at, "left").withColumn("hole", F.lit(True))
    return mask, holes, named.unionByName(inner).select("plan_id", "label", "hole", "parent")
