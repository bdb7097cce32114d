"""Components of masks of cells, by tiles of 512 x 512 cells.

A tile comes with the cells around it and is worked on by one task.  What lies in one tile is settled there; a component that
goes on in other tiles has a part in each of them, and only links between parts are joined.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from wayfare.operators.components import components, settled
from wayfare.operators.runs import BITS, RUN, Extent, cells_of, tile
from wayfare.plans.scratch import stored

TILE = 9
#: Rows of three kinds: runs (x to x2) of a tile's rows, links from a part to a cell at a tile's edge (other), and sizes and marks of open parts (n).
PARTS = "plan_id long, x long, x2 long, y long, part long, open boolean, other long, n long, hit boolean"
#: Whether a component is kept, by its number of cells and whether one of them is marked: for arrays as for columns.
Keep = Callable[..., object]


def tiled(cells: DataFrame, margin: int, bits: int = TILE) -> GroupedData:
    """``cells`` (plan_id, x, y, and more) by tiles (plan_id, tx, ty), each with those up to ``margin`` cells around it."""
    over = lambda c: F.explode(F.sequence(F.shiftright(F.col(c) - margin, bits), F.shiftright(F.col(c) + margin, bits)))
    more = [c for c in cells.columns if c not in ("plan_id", "x", "y")]
    rows = cells.select("plan_id", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), *more).where("plan_id is not null and x is not null and y is not null")
    return rows.withColumn("tx", over("x")).withColumn("ty", over("y")).groupBy("plan_id", "tx", "ty")


def tiled_runs(runs: DataFrame, margin: int, extent: Extent, bits: int = TILE) -> GroupedData:
    """``runs`` (plan_id, y, x1, x2, and more) within the extent by tiles (plan_id, tx, ty), each with those that come up to ``margin`` cells near it."""

    def over(a: str, b: str, size: int):
        return F.explode(F.sequence(F.shiftright(F.greatest(F.col(a) - margin, F.lit(0)), bits), F.shiftright(F.least(F.col(b) + margin, F.lit(size - 1)), bits)))

    return runs.withColumn("tx", over("x1", "x2", extent[0])).withColumn("ty", over("y", "y", extent[1])).groupBy("plan_id", "tx", "ty")


def drawn(shape: tuple[int, int], y: np.ndarray, x1: np.ndarray, x2: np.ndarray) -> np.ndarray:
    """The cells of runs as an array; what lies beyond it is cut."""
    here = (y >= 0) & (y < shape[0]) & (x1 < shape[1]) & (x2 >= 0)
    turns = np.zeros((shape[0], shape[1] + 1), np.int32)
    np.add.at(turns, (y[here], np.maximum(x1[here], 0)), 1)
    np.add.at(turns, (y[here], np.minimum(x2[here], shape[1] - 1) + 1), -1)
    return turns.cumsum(1)[:, :-1] > 0


def dilated(on: np.ndarray, halves: list[tuple[int, int]]) -> np.ndarray:
    """Cells that see one of ``on`` through a kernel with rows (dy, half): from -half to half.  Nothing is on beyond the array."""
    most, at = max(half for _, half in halves), np.arange(on.shape[1], dtype=np.int32)
    far = np.int32(on.shape[1] + most + 1)
    before = np.maximum.accumulate(np.where(on, at, -far), 1)
    after = np.minimum.accumulate(np.where(on, at, at[-1] + far)[:, ::-1], 1)[:, ::-1]
    gap = np.minimum(np.minimum(at - before, after - at), most + 1).astype(np.uint8 if most < 255 else np.int32)
    out, height = np.zeros_like(on), len(on)
    for dy, half in halves:
        if abs(dy) < height:
            out[max(0, -dy) : height - max(0, dy)] |= gap[max(0, dy) : height + min(0, dy)] <= half
    return out


def places(key: tuple, rows: pa.Table, margin: int, bits: int) -> tuple[int, int, int, tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """A tile's plan, its first x and y, less the margin; the shape of its arrays, and the rows' places in them."""
    plan, left, top = int(key[0].as_py()), *((int(k.as_py()) << bits) - margin for k in key[1:])
    wide = (1 << bits) + 2 * margin
    return plan, left, top, (wide, wide), (rows.column("y").to_numpy() - top, rows.column("x").to_numpy() - left)


def parts_of(on: np.ndarray, hit: np.ndarray | None, keep: Keep | None, diagonal: bool, plan: int, left: int, top: int) -> pa.Table:
    """PARTS of a tile's mask with one cell around it; parts that end in it and are not to be kept are left out."""
    own = np.zeros_like(on)
    own[1:-1, 1:-1] = on[1:-1, 1:-1]
    around = on & ~own
    number = lambda y, x: (plan << 2 * BITS) + ((y + top) << BITS) + x + left
    seen = lambda a, dx, dy: np.roll(a, (-dy, -dx), (0, 1))
    # runs of rows are joined with those below; a part is named by its first cell
    starts = own & ~seen(own, -1, 0)
    run = np.cumsum(starts).reshape(on.shape) - 1
    every = np.arange(np.count_nonzero(starts))
    u, v = [every], [every]
    for dx in (-1, 0, 1) if diagonal else (0,):
        y, x = np.nonzero(own & seen(own, dx, 1))
        u.append(run[y, x])
        v.append(run[y + 1, x + dx])
    root = settled(np.concatenate(u), np.concatenate(v))[1]
    part = number(*np.nonzero(starts))[root]
    # of two cells on both sides of an edge the later one names the link, in both tiles
    links = [np.zeros((2, 0), np.int64)]
    for dx, dy in ((1, 0), (1, 1), (0, 1), (-1, 1)) if diagonal else ((1, 0), (0, 1)):
        y, x = np.nonzero(own & seen(around, dx, dy))
        links.append(np.stack([part[run[y, x]], number(y + dy, x + dx)]))
        y, x = np.nonzero(own & seen(around, -dx, -dy))
        links.append(np.stack([part[run[y, x]], number(y, x)]))
    link = np.unique(np.concatenate(links, 1), axis=1)
    (y, x), x2 = np.nonzero(starts), np.nonzero(own & ~seen(own, 1, 0))[1]
    n = np.bincount(root, x2 - x + 1, len(every)).astype(np.int64)
    marked = np.zeros(len(every), bool)
    if hit is not None:
        marked[root[run[own & hit]]] = True
    goes_on = np.isin(part, link[0])
    stays = (goes_on | keep(n, marked) if keep else np.ones(len(every), bool))[root]
    y, x, x2 = y[stays], x[stays], x2[stays]
    more = np.flatnonzero(goes_on & (root == every))
    table = lambda k, **c: {"plan_id": np.full(k, plan), **c}
    kinds = table(len(y), x=x + left, x2=x2 + left, y=y + top, part=part[stays], open=goes_on[stays]), table(link.shape[1], part=link[0], other=link[1]), table(len(more), part=part[more], n=n[more], hit=marked[more])
    schema = pa.schema([(f.split()[0], pa.bool_() if f.endswith("boolean") else pa.int64()) for f in PARTS.split(", ")])
    column = lambda rows, f: pa.array(rows[f.name], f.type) if f.name in rows else pa.nulls(len(rows["plan_id"]), f.type)
    return pa.concat_tables([pa.Table.from_arrays([column(rows, f) for f in schema], schema=schema) for rows in kinds])


def _masked(key: tuple, rows: pa.Table, keep: Keep | None, diagonal: bool, bits: int) -> pa.Table:
    plan, left, top, shape, at = places(key, rows, 1, bits)
    on, hit = np.zeros(shape, bool), None
    if keep is None:
        on[at] = True
    else:
        hit = np.zeros(shape, bool)
        for array, name in ((on, "on"), (hit, "hit")):
            some = rows.column(name).to_numpy()
            array[at[0][some], at[1][some]] = True
    return parts_of(on, hit, keep, diagonal, plan, left, top)


def _roots(parts: DataFrame) -> DataFrame:
    """(part, label): parts that go on in other tiles, with the least cell of their component."""
    found = components(parts.where("other is not null"), "part", "other", block=lambda c: tile(c, 13))
    return stored(found.select(F.col("id").alias("part"), F.col("component").alias("label")), "roots")


def labelled(mask: DataFrame, diagonal: bool = True, bits: int = TILE) -> DataFrame:
    """(plan_id, x, y, label): connected cells have one label, the number of their first cell (least y, then x)."""
    parts = stored(tiled(mask.select("plan_id", "x", "y"), 1, bits).applyInArrow(lambda key, t: _masked(key, t, None, diagonal, bits), PARTS), "parts")
    some, run = parts.where("x is not null"), ["plan_id", "y", "x", "x2", "label"]
    both = some.where("not open").withColumn("label", F.col("part")).select(*run).unionByName(some.where("open").join(_roots(parts), "part").select(*run))
    return both.select("plan_id", F.explode(F.sequence("x", "x2")).alias("x"), "y", "label")


def kept_runs(rows: DataFrame, keep: Keep) -> DataFrame:
    """(plan_id, y, x1, x2) of components to keep, from rows in the form of PARTS; runs that go on in the next tile are cut there."""
    parts = stored(rows, "parts")
    roots, own = _roots(parts), parts.where("x is not null").withColumnRenamed("x", "x1")
    whole = parts.where("n is not null").select("part", "n", "hit").join(roots, "part")
    some = whole.groupBy("label").agg(F.sum("n").alias("n"), F.max("hit").alias("hit")).where(keep(F.col("n"), F.col("hit"))).select("label")
    there = own.where("open").join(roots.join(some, "label", "left_semi"), "part", "left_semi")
    return own.where("not open").select(*RUN).unionByName(there.select(*RUN))


def kept(rows: DataFrame, keep: Keep) -> DataFrame:
    """(plan_id, x, y) of components to keep, from rows in the form of PARTS."""
    return cells_of(kept_runs(rows, keep))


def selected(cells: DataFrame, keep: Keep, diagonal: bool = True, bits: int = TILE) -> DataFrame:
    """(plan_id, x, y) of components to keep of the cells that are ``on``, by their size and whether one of them is a ``hit``."""
    return kept(tiled(cells, 1, bits).applyInArrow(lambda key, t: _masked(key, t, keep, diagonal, bits), PARTS), keep)
