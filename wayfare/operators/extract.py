"""Units from images: masks by colour or structure, their outlines, and the tables of corners and centres."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfare.functions import geom as g
from wayfare.operators import distance, graph, raster, runs
from wayfare.operators.relational import large_units, numbered_units, usable_rings
from wayfare.operators.route import simplified
from wayfare.plans.scratch import spread, stored


def outlines(mask: DataFrame) -> DataFrame:
    """(plan_id, id, hole, parent_id, ring) of a mask's outlines.

    A hole's parent is the outline around its component, and an outline's the hole that its component lies in (null: none),
    so outlines without a parent are the outermost ones.  Points inside straight sides are left out; outer rings run
    clockwise where y points down.
    """
    rows = stored(graph.contours(mask), "contours")
    points = F.transform(F.array_sort(F.collect_list(F.struct("rank", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    side = F.min_by(F.when(F.col("hole"), F.struct(F.col("out_x").alias("x"), F.col("out_y").alias("y"))).otherwise(F.struct(F.col("cell_x").alias("x"), F.col("cell_y").alias("y"))), "rank")
    rings = rows.groupBy("plan_id", F.col("contour").alias("id"), "hole").agg(points.alias("p"), side.alias("c"))
    n = F.size("p")
    bend = lambda q, k: g.turn(*(c for j in (k - 1, k, k + 1) for c in (F.get("p", (j + n) % n)["x"], F.get("p", (j + n) % n)["y"]))) != 0
    rings = stored(rings.select("plan_id", "id", "hole", F.filter("p", bend).alias("ring"), F.col("c.y").alias("y"), F.col("c.x").alias("x1"), F.col("c.x").alias("x2")), "rings")
    # a component and a hole have one outline each: the one with a side at one of their cells
    components, holes, tree = runs.nesting(runs.runs_of(mask))
    named = runs.meeting(rings.where("not hole"), components, "id", "label").withColumn("hole", F.lit(False))
    named = stored(named.unionByName(runs.meeting(rings.where("hole"), holes, "id", "label").withColumn("hole", F.lit(True))), "named")
    own = tree.join(named.select("hole", F.col("u").alias("id"), F.col("v").alias("label")), ["hole", "label"])
    around = named.select((~F.col("hole")).alias("hole"), F.col("u").alias("parent_id"), F.col("v").alias("parent"))
    parents = own.join(around, ["hole", "parent"], "left").select("id", "parent_id")
    return rings.join(parents, "id").select("plan_id", "id", "hole", "parent_id", "ring")


def approximated(rings: DataFrame, share: float, least: float = 0.0) -> DataFrame:
    """Closed rings by Douglas and Peucker with a tolerance of ``share`` of each ring's length, ``least`` at least.

    A ring is cut at its first point and the one farthest from it.
    """
    first = F.element_at("ring", 1)
    far = lambda p: (p["x"] - first["x"]) * (p["x"] - first["x"]) + (p["y"] - first["y"]) * (p["y"] - first["y"])
    k = F.array_position(F.transform("ring", far), F.array_max(F.transform("ring", far))).cast("int")
    size = F.greatest(F.lit(least), g.path_length(g.closed("ring")) * share)
    cut = rings.withColumn("k", k).withColumn("unit_len", size).where("k is not null")
    halves = F.array(F.struct(F.lit(0).alias("half"), F.slice("ring", 1, F.col("k")).alias("points")), F.struct(F.lit(1).alias("half"), F.concat(F.slice("ring", F.col("k"), F.size("ring") - F.col("k") + 1), F.slice("ring", 1, 1)).alias("points")))
    # one tolerance for all: lines are scaled by their own, and back
    scaled = lambda c, f: F.transform(c, lambda p: F.struct(f(p["x"]).alias("x"), f(p["y"]).alias("y")))
    lines = cut.select("plan_id", "id", "unit_len", F.explode(halves).alias("h")).select("plan_id", "id", "unit_len", "h.half", scaled("h.points", lambda v: v / F.col("unit_len")).alias("points"))
    kept = simplified(lines, 1.0).groupBy("plan_id", "id", "unit_len").agg(F.sort_array(F.collect_list(F.struct("half", "points"))).alias("h"))
    whole = F.flatten(F.transform("h", lambda h: F.slice(h["points"], 1, F.size(h["points"]) - 1)))
    back = kept.select("plan_id", "id", scaled(whole, lambda v: F.rint(v * F.col("unit_len")).cast("long")).alias("ring"))
    return rings.drop("ring").join(back, ["plan_id", "id"])


#: Units whose box has no more cells (and columns) than this are worked on one by one, larger ones cell by cell over all tasks.
BOX, WIDE = 1 << 16, 1 << 10


def _filled(rings: list, left: int, top: int, shape: tuple[int, int], extent: raster.Extent) -> np.ndarray:
    """The cells of rings as in ``raster.polygon_runs``, within their box and one cell around it."""
    turns, mask = np.zeros((shape[0], shape[1] + 1), np.int64), np.zeros(shape, bool)
    for x1, y1 in rings:
        x1, y1 = x1 - left, y1 - top
        x2, y2 = np.roll(x1, -1), np.roll(y1, -1)
        level, steep = y1 == y2, y1 != y2
        np.add.at(turns, (y1[level], np.minimum(x1, x2)[level]), 1)
        np.add.at(turns, (y1[level], np.maximum(x1, x2)[level] + 1), -1)
        x1, y1, x2, y2 = x1[steep], y1[steep], x2[steep], y2[steep]
        dx, dy = x2 - x1, y2 - y1
        high = np.abs(dy)
        e = np.repeat(np.arange(len(high)), high)
        y = np.minimum(y1, y2)[e] + np.arange(len(e)) - np.repeat(np.cumsum(high) - high, high)
        at = (x1 + left)[e] + ((y - y1[e]) * dx[e]) / dy[e]
        order = np.lexsort((at, y))
        y, at = y[order][::2], at[order]
        a, b = np.ceil(at[::2]).astype(np.int64) - left, np.floor(at[1::2]).astype(np.int64) - left
        some = a <= b
        np.add.at(turns, (y[some], a[some]), 1)
        np.add.at(turns, (y[some], b[some] + 1), -1)
        n, m = np.maximum(np.abs(dx), high), np.minimum(np.abs(dx), high)
        e = np.repeat(np.arange(len(n)), n + 1)
        i = np.arange(len(e)) - np.repeat(np.cumsum(n + 1) - n - 1, n + 1)
        short = (2 * i * m[e] + n[e]) // (2 * n[e])
        wide = (np.abs(dx) >= high)[e]
        mask[y1[e] + np.sign(dy)[e] * np.where(wide, short, i), x1[e] + np.where(dx > 0, 1, -1)[e] * np.where(wide, i, short)] = True
    mask |= turns.cumsum(1)[:, :-1] > 0
    mask[: max(0, -top)], mask[max(0, extent[1] - top) :] = False, False
    mask[:, : max(0, -left)], mask[:, max(0, extent[0] - left) :] = False, False
    return mask


def _pole(mask: np.ndarray) -> tuple[int, int, int] | None:
    """(d2, y, x) of the cell farthest from all cells outside a mask whose edges are off; ties: least y, then x.

    A cell is no farther from the outside than along its column and its row; only cells for which this is enough are measured.
    """

    def steps(m: np.ndarray) -> np.ndarray:
        k = np.arange(len(m))[:, None]
        before = np.maximum.accumulate(np.where(m, 0, k), 0)
        after = np.minimum.accumulate(np.where(m, len(m), k)[::-1], 0)[::-1]
        return np.minimum(k - before, after - k)

    g = steps(mask)
    bound, square, column = np.minimum(g, steps(mask.T).T) ** 2, g * g, np.arange(mask.shape[1])
    if not bound.any():
        return None

    def measured(y: np.ndarray, x: np.ndarray) -> np.ndarray:
        size = max(1, (1 << 20) // len(column))
        return np.concatenate([((x[k : k + size, None] - column) ** 2 + square[y[k : k + size]]).min(1) for k in range(0, len(y), size)])

    y, x = np.nonzero(bound >= measured(*np.nonzero(bound == bound.max())).max())
    d2 = measured(y, x)
    k = int(d2.argmax())
    return int(d2[k]), int(y[k]), int(x[k])


def pole_centers(units: DataFrame, extent: raster.Extent) -> DataFrame:
    """(uid, cx, cy, d2): the cell of each unit farthest from all cells outside it (exact; ties: least y, then x).

    A unit of at most BOX cells is filled and measured as a whole by one task; no cells are shuffled.
    """
    whole = lambda c: F.transform("ring", lambda p: F.floor(p[c]))
    ends = [f(whole(c)).alias(n) for n, f, c in (("xa", F.array_min, "x"), ("xb", F.array_max, "x"), ("ya", F.array_min, "y"), ("yb", F.array_max, "y"))]
    own = units.where(F.size("ring") >= 3).select("uid", F.transform("ring", lambda p: F.struct(F.floor(p["x"]).alias("x"), F.floor(p["y"]).alias("y"))).alias("ring"), *ends, F.exists("ring", lambda p: p["x"].isNull() | p["y"].isNull()).alias("gap"))
    named = spread(own, "uid").groupBy("uid").agg(F.collect_list("ring").alias("rings"), F.min("xa").alias("xa"), F.max("xb").alias("xb"), F.min("ya").alias("ya"), F.max("yb").alias("yb"), F.bool_or("gap").alias("gap"))
    named = stored(named.withColumn("small", F.expr(f"not gap and xb - xa < {WIDE} and (xb - xa + 1) * (yb - ya + 1) <= {BOX}")), "rings")

    def poles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for uid, rings, xa, xb, ya, yb in zip(*(batch.column(c).to_pylist() for c in ("uid", "rings", "xa", "xb", "ya", "yb"))):
                arrays = [tuple(np.array([p[c] for p in ring], np.int64) for c in "xy") for ring in rings]
                found = _pole(_filled(arrays, xa - 1, ya - 1, (yb - ya + 3, xb - xa + 3), extent))
                if found:
                    rows.append((uid, found[2] + xa - 1, found[1] + ya - 1, found[0]))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], ["uid", "cx", "cy", "d2"])

    small = spread(named.where("small").select("uid", "rings", "xa", "xb", "ya", "yb"), "uid").mapInArrow(poles, "uid long, cx long, cy long, d2 long")
    large = named.where("not small").select("uid", F.explode("rings").alias("ring"))
    if large.isEmpty():
        return small
    cells = raster.fill_polygons(large.select(F.col("uid").alias("plan_id"), "ring"), 1, extent)
    far = distance.euclidean(cells).groupBy(F.col("plan_id").alias("uid")).agg(F.min(F.struct((-F.col("d2")).alias("n"), "y", "x")).alias("b"))
    return small.unionByName(far.select("uid", F.col("b.x").alias("cx"), F.col("b.y").alias("cy"), (-F.col("b.n")).alias("d2")))


def _rings_of(mask: DataFrame, extent: raster.Extent, share: float) -> DataFrame:
    rings = approximated(outlines(mask).where("not hole and parent_id is null"), share)  # what lies in holes is not looked at
    return large_units(usable_rings(rings), *extent)


def cleaned_mask(pixels: DataFrame, extent: raster.Extent, ranges: list[raster.Range] | None = None) -> DataFrame:
    """The colour mask, smoothed twice and eroded by the image's scale."""
    return raster.erode(raster.median3(raster.hsv_mask(pixels, ranges), extent, 2), raster.rect(max(1, round(2 * max(extent) / 4000))), extent)


def color_units(pixels: DataFrame, extent: raster.Extent, ranges: list[raster.Range] | None = None, share: float = 0.012) -> DataFrame:
    """Units by colour: (plan_id, unit, uid, pass, ring, cx, cy), the coloured ones first, then white ones.

    The colour mask is smoothed twice and eroded; white cells are opened, cleared of what touches the image's edge, and
    count only in plans with one coloured pixel in a hundred or more.
    """
    kernel = raster.rect(max(1, round(2 * max(extent) / 4000)))
    mask = stored(cleaned_mask(pixels, extent, ranges), "coloured")
    enough = mask.groupBy("plan_id").agg(F.count("*").alias("n")).where(F.col("n") >= 0.01 * extent[0] * extent[1])
    white = raster.without_border(raster.opened(raster.white_mask(pixels), raster.rect(3), extent), extent)
    white = raster.erode(raster.median3(white, extent), kernel, extent).join(enough, "plan_id", "left_semi")
    both = _rings_of(mask, extent, share).withColumn("pass", F.lit(1)).unionByName(_rings_of(stored(white, "white"), extent, share).withColumn("pass", F.lit(2)))
    rows = numbered_units(both.withColumn("at", F.struct("pass", "id")), "at").drop("at", "hole", "parent_id").withColumnRenamed("id", "uid")
    rows = stored(rows.withColumn("uid", F.col("uid") * 2 + F.col("pass") - 1), "units")
    centre = g.moment_center("ring")
    return rows.select("plan_id", "unit", "uid", "pass", "ring", centre["cx"].alias("cx"), centre["cy"].alias("cy"))


def structure_units(image: DataFrame, extent: raster.Extent, share: float = 0.015) -> DataFrame:
    """Blocks and their units by structure, from a gray image: (plan_id, block, unit, typ, id, ring).

    The image is equalised, smoothed and compared with its surroundings; outlines of dark lines are blocks, the holes
    in them units.
    """
    smooth = raster.convolved(raster.equalized(image), raster.gaussian(5), extent).withColumn("gray", F.rint("gray"))
    lines = stored(outlines(stored(raster.adaptive_threshold(smooth, extent), "dark")), "outlines")
    rings = approximated(lines, share)
    blocks = large_units(rings.where("not hole"), *extent, mode="structure", role="block")
    name = lambda prefix, over: F.concat(F.lit(prefix), F.row_number().over(over))
    blocks = stored(blocks.withColumn("block", name("Block_", Window.partitionBy("plan_id").orderBy("id"))), "blocks")
    inner = large_units(rings.where("hole"), *extent, mode="structure", role="unit").join(blocks.select(F.col("id").alias("parent_id"), "block"), "parent_id")
    inner = inner.withColumn("unit", name("Unit_", Window.partitionBy("plan_id", "block").orderBy("id")))
    cols = ["plan_id", "block", "unit", "typ", "id", "ring"]
    edge = blocks.withColumn("unit", F.lit("")).withColumn("typ", F.lit("Block Boundary"))
    turned = inner.withColumn("typ", F.lit("Unit")).withColumn("ring", g.oriented("ring"))
    return edge.select(*cols).unionByName(turned.select(*cols))


def decision_record(pixels: DataFrame, units: DataFrame, extent: raster.Extent, outputs: dict[str, str], mode: str = "auto", ranges: list[raster.Range] | None = None) -> DataFrame:
    """(plan_id, decision): how each plan's units were found, as a struct: the mode asked for, the fraction of coloured pixels, the
    mode taken and why, the units (plan_id, unit) found, the fraction after cleaning, the artefacts written by name, and the
    colour ranges used.  What a manual mode or the structure mode does not look at is null.
    """
    probe = raster.mask_fraction(pixels, ranges).select("plan_id", "fraction", raster.choose_mode(F.col("fraction"), mode)["mode"].alias("selected"))
    clean = cleaned_mask(pixels, extent, ranges).groupBy("plan_id").agg((F.count("*") / (extent[0] * extent[1])).alias("cleaned"))
    found = units.groupBy("plan_id").agg(F.count_distinct("unit").alias("units_found"))
    rows = probe.join(clean, "plan_id", "left").join(found, "plan_id", "left")
    auto, color = F.lit(mode == "auto"), F.col("selected") == "color"
    # The names of the record's fields and reasons.
    reason = F.when(F.col("fraction") >= 0.02, "strict_color_frac>=0.02").otherwise("standard_preference")
    used = F.array(*(F.array(*(F.array(*map(F.lit, end)) for end in box)) for box in ranges or raster.PRESETS["orange"]))
    fields = {
        "requested_mode": F.lit(mode), "color_pixel_fraction_probe": F.when(auto, F.col("fraction")), "selected_mode": F.col("selected"), "auto_reason": F.when(auto, reason), "mode": F.col("selected"),
        "units_found": F.coalesce("units_found", F.lit(0)), "orange_pixel_fraction": F.when(color, F.coalesce("cleaned", F.lit(0.0))),
        "outputs": F.create_map(*(F.lit(v) for kv in sorted(outputs.items()) for v in kv)).cast("map<string,string>"), "hsv_ranges_used": used,
    }
    return rows.select("plan_id", F.struct(*(v.alias(k) for k, v in fields.items())).alias("decision"))


def extract(pixels: DataFrame, extent: raster.Extent, mode: str = "auto", ranges: list[raster.Range] | None = None) -> tuple[str, DataFrame]:
    """(mode, units) of one plan's image; the mode is chosen by the fraction of coloured pixels unless it is given."""
    share: Column = F.col("fraction")
    chosen = raster.mask_fraction(pixels, ranges).select(raster.choose_mode(share, mode).alias("m")).select("m.mode").first()
    selected = chosen["mode"] if chosen else "structure"
    return selected, color_units(pixels, extent, ranges) if selected == "color" else structure_units(pixels.select("plan_id", "x", "y", "gray"), extent)
