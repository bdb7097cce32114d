"""Raster operators on cell sets: a mask is a table (plan_id, x, y) of the cells that are on.

Morphology, medians and bands work on the rows' runs (``runs``), not on cells; components and edges of gray images are found by
tiles (``tiles``), and gray images are filtered by shifts and counts.  An extent is a pair (width, height); cells outside of it do not exist.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfare.functions import geom as g
from wayfare.operators import distance, runs, tiles
from wayfare.operators.runs import PLAN_BITS, Extent, cell_id
from wayfare.operators.spatial import line_cells
from wayfare.plans.scratch import stored

CELL = ["plan_id", "x", "y"]
# Colour ranges ((h, s, v) low, (h, s, v) high), with h in 0..179.
PRESETS = {
    "orange": [((4, 40, 140), (22, 255, 255)), ((22, 30, 170), (32, 255, 255))],
    "blue": [((100, 50, 50), (130, 255, 255))],
    "pink": [((140, 50, 50), (170, 255, 255))],
    "red": [((0, 70, 50), (10, 255, 255)), ((170, 70, 50), (179, 255, 255))],
    "yellow": [((20, 70, 70), (35, 255, 255))],
    "green": [((40, 40, 40), (85, 255, 255))],
    "cyan": [((85, 50, 50), (100, 255, 255))],
    "purple": [((125, 50, 50), (150, 255, 255))],
}
Range = tuple[tuple[int, int, int], tuple[int, int, int]]


def parse_range(spec: str) -> Range:
    """``H,S,V:H,S,V`` with h clamped to 0..179, s and v to 0..255."""
    if ":" not in spec:
        raise ValueError(f"a range is H,S,V:H,S,V, not {spec!r}")
    low, high = ([int(float(v)) for v in part.split(",")] for part in spec.split(":", 1))
    clamp = lambda t: tuple(max(0, min(v, most)) for v, most in zip(t, (179, 255, 255), strict=True))
    return clamp(low), clamp(high)


def ranges_of(specs: list[str] | None = None, preset: str | None = None) -> list[Range]:
    """Explicit ranges, else those of a preset, else the default (orange)."""
    if specs:
        return [parse_range(s) for s in specs]
    if preset is not None and preset not in PRESETS:
        raise ValueError(f"no preset {preset!r}")
    return PRESETS[preset or "orange"]


def bgr_to_hsv(b: Column, green: Column, r: Column) -> Column:
    """struct(h, s, v) of 8-bit colours, h halved to 0..179."""
    v, low = F.greatest(b, green, r), F.least(b, green, r)
    d = (v - low).cast("double")
    h = F.when(d == 0, F.lit(0.0)).when(v == r, 60 * (green - b) / d).when(v == green, 120 + 60 * (b - r) / d).otherwise(240 + 60 * (r - green) / d)
    h = F.when(h < 0, h + 360).otherwise(h)
    s = F.when(v == 0, F.lit(0.0)).otherwise(255 * d / v)
    return F.struct((F.rint(h / 2) % 180).cast("int").alias("h"), F.rint(s).cast("int").alias("s"), v.cast("int").alias("v"))


def gray(b: Column, green: Column, r: Column) -> Column:
    """The brightness of a colour: .299 r + .587 g + .114 b, rounded."""
    return F.floor((r * 4899 + green * 9617 + b * 1868 + 8192) / 16384).cast("int")


def in_ranges(ranges: list[Range]) -> Column:
    """True for pixels (h, s, v) inside one of the boxes, ends included."""
    boxes = [reduce(Column.__and__, (F.col(c).between(a, b) for c, a, b in zip("hsv", low, high))) for low, high in ranges]
    return reduce(Column.__or__, boxes)


def hsv_mask(pixels: DataFrame, ranges: list[Range] | None = None) -> DataFrame:
    return pixels.where(in_ranges(ranges or PRESETS["orange"])).select(*CELL)


def white_mask(pixels: DataFrame, s_max: int = 40, v_min: int = 230) -> DataFrame:
    return pixels.where((F.col("s") <= s_max) & (F.col("v") >= v_min)).select(*CELL)


def mask_fraction(pixels: DataFrame, ranges: list[Range] | None = None) -> DataFrame:
    """(plan_id, n_on, n_pixels, fraction)."""
    on = F.count_if(in_ranges(ranges or PRESETS["orange"]))
    return pixels.groupBy("plan_id").agg(on.alias("n_on"), F.count("*").alias("n_pixels"), (on / F.count("*")).alias("fraction"))


def choose_mode(fraction: Column, manual: str = "auto") -> Column:
    """struct(mode, reason) by the fraction of coloured pixels; a manual mode stands."""
    if manual != "auto":
        return F.struct(F.lit(manual).alias("mode"), F.lit("manual").alias("reason"))
    mode = F.when((fraction >= 0.02) | fraction.between(0.01, 0.40), "color").otherwise("structure")
    reason = F.when(fraction >= 0.02, "strict").when(fraction.between(0.01, 0.40), "plausible").otherwise("scarce")
    return F.struct(mode.alias("mode"), reason.alias("reason"))


# -- kernels: lists of (dx, dy) ------------------------------------------------------------------------------------


def rect(k: int) -> list[tuple[int, int]]:
    """A k x k square; for even k its anchor is right of and below the middle."""
    return [(dx - k // 2, dy - k // 2) for dy in range(k) for dx in range(k)]


def cross() -> list[tuple[int, int]]:
    return [(0, -1), (-1, 0), (0, 0), (1, 0), (0, 1)]


def ellipse(r: int) -> list[tuple[int, int]]:
    """The cells of a (2 r + 1)-wide ellipse: in each row as far as the circle of radius r, rounded."""
    wide = lambda dy: round((r * r - dy * dy) ** 0.5)
    return [(dx, dy) for dy in range(-r, r + 1) for dx in range(-wide(dy), wide(dy) + 1)]


def disc(r: int) -> list[tuple[int, int]]:
    return [(dx, dy) for dy in range(-r, r + 1) for dx in range(-r, r + 1) if dx * dx + dy * dy <= r * r]


def _offsets(kernel: list[tuple[int, int]]) -> Column:
    return F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in kernel))


def _inside(x: Column, y: Column, extent: Extent) -> Column:
    return x.between(0, extent[0] - 1) & y.between(0, extent[1] - 1)


def _by_runs(step, mask: DataFrame, *args) -> DataFrame:
    return runs.cells_of(step(runs.runs_of(mask), *args))


def dilate(mask: DataFrame, kernel: list[tuple[int, int]], extent: Extent) -> DataFrame:
    """Cells that see a cell of the mask through the kernel."""
    return _by_runs(runs.dilated, mask, kernel, extent)


def erode(mask: DataFrame, kernel: list[tuple[int, int]], extent: Extent) -> DataFrame:
    """Cells that see through the kernel cells of the mask only; places outside the extent do not count."""
    return _by_runs(runs.eroded, mask, kernel, extent)


def opened(mask: DataFrame, kernel: list[tuple[int, int]], extent: Extent) -> DataFrame:
    return _by_runs(lambda r: runs.dilated(runs.eroded(r, kernel, extent), kernel, extent), mask)


def closed(mask: DataFrame, kernel: list[tuple[int, int]], extent: Extent) -> DataFrame:
    return _by_runs(lambda r: runs.eroded(runs.dilated(r, kernel, extent), kernel, extent), mask)


def median3(mask: DataFrame, extent: Extent, times: int = 1) -> DataFrame:
    """The 3 x 3 median: on where five of the nine cells are; beyond the edge the edge's cells repeat."""
    now = runs.runs_of(mask)
    for _ in range(times):
        now = runs.median3(now, extent)
    return runs.cells_of(now)


# -- set algebra ----------------------------------------------------------------------------------------------------


def mask_or(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*CELL).union(b.select(*CELL)).distinct()


def mask_and(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*CELL).join(b.select(*CELL), CELL, "left_semi").distinct()


def mask_minus(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*CELL).join(b.select(*CELL), CELL, "left_anti").distinct()


def canvas(plans: DataFrame, extent: Extent) -> DataFrame:
    """All cells of each plan."""
    upto = lambda size: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long")))
    return plans.select("plan_id").distinct().select("plan_id", upto(extent[0]).alias("x")).select("*", upto(extent[1]).alias("y"))


def mask_not(mask: DataFrame, plans: DataFrame, extent: Extent) -> DataFrame:
    return mask_minus(canvas(plans, extent), mask)


def downscaled(mask: DataFrame, ds: int) -> DataFrame:
    return mask.select("plan_id", F.floor(F.col("x") / ds).alias("x"), F.floor(F.col("y") / ds).alias("y")).distinct()


def side_by_side(a: DataFrame, b: DataFrame, width: int) -> DataFrame:
    """The second mask to the right of the first."""
    return a.select(*CELL).union(b.select("plan_id", (F.col("x") + width).alias("x"), "y"))


# -- components ---------------------------------------------------------------------------------------------------


def cell_components(mask: DataFrame, diagonal: bool = True) -> DataFrame:
    """(plan_id, x, y, label): connected cells have one label, the number of their first cell (least y, then x).

    Cells are labelled by tiles; only parts of components that go on in other tiles are nodes of the component search.
    """
    return tiles.labelled(mask, diagonal)


def component_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("plan_id", "label").agg(F.count("*").alias("size"))


def without_border(mask: DataFrame, extent: Extent, diagonal: bool = False) -> DataFrame:
    """The mask without components that have a cell on the edge of the image."""
    on_edge = (F.col("x") <= 0) | (F.col("y") == 0) | (F.col("x") >= extent[0] - 1) | (F.col("y") == extent[1] - 1)
    return tiles.selected(mask.select(*CELL, F.lit(True).alias("on"), on_edge.alias("hit")), lambda n, hit: ~hit, diagonal)


def touching_components(mask: DataFrame, marks: DataFrame, least: int) -> DataFrame:
    """Components (diagonals count) of ``least`` or more cells that have a cell of ``marks``."""
    side = lambda t, on: t.select(*CELL, F.lit(on).alias("on"), F.lit(not on).alias("hit"))
    return tiles.selected(side(mask, True).unionByName(side(marks, False)), lambda n, hit: hit & (n >= least))


# -- drawing --------------------------------------------------------------------------------------------------------


def merged_runs(runs: DataFrame) -> DataFrame:
    """Runs of cells (plan_id, y, x1, x2) of each row joined where they overlap or follow on each other, so that none share a cell."""
    row = Window.partitionBy("plan_id", "y").orderBy("x1", "x2")
    reach = F.max("x2").over(row.rowsBetween(Window.unboundedPreceding, -1))
    new = runs.select("plan_id", "y", "x1", "x2", F.coalesce(F.col("x1") > reach + 1, F.lit(True)).cast("int").alias("new"))
    part = new.withColumn("part", F.sum("new").over(row.rowsBetween(Window.unboundedPreceding, 0)))
    return part.groupBy("plan_id", "y", "part").agg(F.min("x1").alias("x1"), F.max("x2").alias("x2")).drop("part")


def polygon_runs(units: DataFrame, ds: int, extent: Extent) -> DataFrame:
    """The cells of all polygons as runs (plan_id, y, x1, x2) that share no cell; see ``fill_polygons``.

    Edges give a crossing for each row that they pass, and a polygon's crossings of a row are paired; nothing is sent
    by cells but the sides that slant.
    """
    small = units.where(F.size("ring") >= 3).select("plan_id", F.transform("ring", lambda p: F.struct(F.floor(p["x"] / ds).alias("x"), F.floor(p["y"] / ds).alias("y"))).alias("ring"))
    small = stored(small.withColumn("own", F.monotonically_increasing_id()), "rings")
    lines = small.select("plan_id", "own", F.explode(g.edges("ring")).alias("e")).select("plan_id", "own", "e.*")
    level = lines.where("y1 = y2").select("plan_id", F.col("y1").alias("y"), F.least("x1", "x2").alias("x1"), F.greatest("x1", "x2").alias("x2"))
    steep = lines.where("y1 <> y2")
    # rows that an upright edge crosses begin or end a span there: only its last cell is left
    tips = steep.where("x1 = x2").select("plan_id", F.greatest("y1", "y2").alias("y"), "x1", "x2")
    sides = steep.where("x1 <> x2").select("plan_id", F.explode(line_cells(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))).alias("c")).select("plan_id", "c.y", F.col("c.x").alias("x1"), F.col("c.x").alias("x2"))
    # where a row's middle line crosses edges, each with its lower end but not its upper
    rows = steep.withColumn("y", F.explode(F.sequence(F.least("y1", "y2"), F.greatest("y1", "y2") - 1)))
    at = F.col("x1") + (F.col("y") - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    crossed = rows.groupBy("plan_id", "own", "y").agg(F.array_sort(F.collect_list(at)).alias("c"))
    spans = crossed.select("plan_id", "y", F.explode(F.sequence(F.lit(0), F.size("c") - 2, F.lit(2))).alias("k"), "c")
    inner = spans.select("plan_id", "y", F.ceil(F.get("c", F.col("k"))).alias("x1"), F.floor(F.get("c", F.col("k") + 1)).alias("x2")).where("x1 <= x2")
    every = inner.unionByName(level).unionByName(tips).unionByName(sides).where(F.col("y").between(0, extent[1] - 1))
    cut = every.select("plan_id", "y", F.greatest("x1", F.lit(0).cast("long")).alias("x1"), F.least("x2", F.lit(extent[0] - 1).cast("long")).alias("x2"))
    return merged_runs(cut.where("x1 <= x2"))


def fill_polygons(units: DataFrame, ds: int, extent: Extent) -> DataFrame:
    """The cells of all polygons, boundary included; coordinates are cut to cells first.  ``units`` have plan_id, ring."""
    return polygon_runs(units, ds, extent).select("plan_id", F.explode(F.sequence("x1", "x2")).alias("x"), "y")


def exit_discs(exits: DataFrame, ds: int, extent: Extent, radius: int = 12) -> DataFrame:
    """Discs around usable exits (plan_id, ex, ey, is_corridor) whose centre is in the extent."""
    usable = exits.where("is_corridor and ex is not null").select("plan_id", F.floor(F.col("ex") / ds).alias("x"), F.floor(F.col("ey") / ds).alias("y"))
    return dilate(usable.where(_inside(F.col("x"), F.col("y"), extent)), disc(max(1, round(radius / ds))), extent)


def within(mask: DataFrame, radius: int, extent: Extent) -> DataFrame:
    """Cells at an exact distance of ``radius`` or less from a cell of the mask."""
    return _by_runs(runs.discs, mask, radius, extent)


def _free(key: tuple, rows: pa.Table, extent: Extent, kernels: tuple, margin: int, keep: tiles.Keep, bits: int) -> pa.Table:
    """The parts of free cells of a tile that comes with ``margin`` cells around it; see ``free_runs``.  Rows are of units (0), hulls (1) and exits (2)."""
    plan, left, top = int(key[0].as_py()), *((int(k.as_py()) << bits) - margin for k in key[1:])
    shape = ((1 << bits) + 2 * margin,) * 2
    kind, y, x1, x2 = (rows.column(c).to_numpy() for c in ("kind", "y", "x1", "x2"))
    taken, hull, exits = (tiles.drawn(shape, (y - top)[kind == k], (x1 - left)[kind == k], (x2 - left)[kind == k]) for k in range(3))
    band, walls, marks = (tiles.dilated(mask, kernel) for mask, kernel in zip((taken, taken, exits), kernels, strict=True))
    # the extent's first cells, and the ones after its last, as places here
    x, y = ((max(-low, 0), min(size - low, shape[0])) for low, size in ((left, extent[0]), (top, extent[1])))
    there = np.zeros(shape, bool)
    there[slice(*y), slice(*x)] = True
    raw = hull & band & ~walls & there
    for a, (first, end) in ((raw, y), (raw.T, x)):  # beyond the edge its cells repeat
        if first:
            a[first - 1] = a[first]
        if end < shape[0]:
            a[end] = a[end - 1]
    n = raw[:-2].astype(np.uint8) + raw[1:-1] + raw[2:]
    free = np.zeros(shape, bool)
    free[1:-1, 1:-1] = n[:, :-2] + n[:, 1:-1] + n[:, 2:] >= 5
    own = (slice(margin - 1, 1 - margin),) * 2
    return tiles.parts_of((free & there)[own], marks[own], keep, True, plan, left + margin - 1, top + margin - 1)


def free_runs(units: DataFrame, exits: DataFrame, extent_px: Extent, ds: int = 3, clearance: int = 8, near: int = 200, exit_radius: int = 12, least_area: int = 800, bits: int = tiles.TILE) -> DataFrame:
    """Where one can walk, as runs: inside the hull of the exits (or anywhere, with fewer than three), clear of units by
    ``clearance`` and no farther from them than ``near``, smoothed, and connected to an exit.

    A tile comes with all runs as far as ``near`` around it, so one task knows what is free there; runs end at a tile's edge.
    """
    from wayfare.operators.relational import hulls

    extent = (extent_px[0] // ds, extent_px[1] // ds)
    taken = stored(polygon_runs(units, ds, extent), "taken")
    usable = exits.where("is_corridor and ex is not null").select("plan_id", F.col("ex").alias("x"), F.col("ey").alias("y"))
    many = usable.groupBy("plan_id").agg(F.count("*").alias("n")).where("n >= 3").select("plan_id")
    hull = polygon_runs(hulls(usable.join(many, "plan_id", "left_semi"), ["plan_id"]), ds, extent)
    whole = runs.canvas(units.select("plan_id").join(many, "plan_id", "left_anti"), extent)
    at = usable.select("plan_id", F.floor(F.col("x") / ds).alias("x1"), F.floor(F.col("y") / ds).alias("y")).withColumn("x2", F.col("x1"))
    sent = lambda t, kind: t.select("plan_id", *(F.col(c).cast("long").alias(c) for c in ("y", "x1", "x2")), F.lit(kind).alias("kind"))
    rows = sent(taken, 0).unionByName(sent(hull.unionByName(whole), 1)).unionByName(sent(at.where(_inside(F.col("x1"), F.col("y"), extent)), 2))
    halves = lambda kernel: [(dy, half) for dy, _, half in runs.kernel_rows(kernel)]
    band, walls, marks = (halves(k) for k in (disc(max(1, round(near / ds))), ellipse(max(1, round(clearance / ds))), disc(max(1, round(exit_radius / ds)))))
    margin, least = max(dy for dy, _ in band + walls + marks) + 2, max(1, round(least_area / ds**2))
    keep = lambda n, hit: hit & (n >= least)
    parts = tiles.tiled_runs(rows, margin, extent, bits).applyInArrow(lambda key, t: _free(key, t, extent, (band, walls, marks), margin, keep, bits), tiles.PARTS)
    return tiles.kept_runs(parts, keep)


def free_mask(units: DataFrame, exits: DataFrame, extent_px: Extent, *args, **named) -> DataFrame:
    """The cells of ``free_runs``."""
    return runs.cells_of(free_runs(units, exits, extent_px, *args, **named))


# -- skeletons and gray images ----------------------------------------------------------------------------------------


def skeleton(mask: DataFrame, extent: Extent) -> DataFrame:
    """The morphological skeleton: what, for each number of erosions by a cross, an opening takes away (see ``distance.ridge``)."""
    return distance.ridge(mask, extent)


def bridged(skeleton_cells: DataFrame, gap: int, extent: Extent) -> DataFrame:
    """A skeleton with breaks of up to twice ``gap`` cells closed, and thinned again; as it is with ``gap`` 0."""
    if gap <= 0:
        return skeleton_cells.select(*CELL)
    return skeleton(closed(skeleton_cells, rect(2 * gap + 1), extent), extent)


def skeleton_points(cells: DataFrame, ds: int) -> DataFrame:
    """(plan_id, tid, x, y): the middles of cells in full size, each with its cell's number."""
    return cells.select("plan_id", cell_id().alias("tid"), ((F.col("x") + 0.5) * ds).alias("x"), ((F.col("y") + 0.5) * ds).alias("y"))


def equalized(image: DataFrame) -> DataFrame:
    """(plan_id, x, y, gray) with gray levels spread by their cumulative frequency."""
    counts = image.groupBy("plan_id", "gray").agg(F.count("*").alias("n"))
    by_level = Window.partitionBy("plan_id").orderBy("gray")
    counts = counts.withColumn("cdf", F.sum("n").over(by_level)).withColumn("first", F.first("n").over(by_level)).withColumn("total", F.sum("n").over(Window.partitionBy("plan_id")))
    level = F.when(F.col("total") == F.col("first"), F.col("gray")).otherwise(F.rint((F.col("cdf") - F.col("first")) * 255.0 / (F.col("total") - F.col("first"))))
    return image.join(counts.select("plan_id", "gray", level.cast("int").alias("level")), ["plan_id", "gray"]).select(*CELL, F.col("level").alias("gray"))


def convolved(image: DataFrame, weights: list[float], extent: Extent, value: str = "gray") -> DataFrame:
    """(plan_id, x, y, value) filtered by the same weights along rows, then columns; beyond the edge its cells are mirrored.

    ``image`` has a row for every cell of the extent.
    """
    half = len(weights) // 2
    kernel = F.array(*(F.struct(F.lit(k - half).alias("d"), F.lit(float(w)).alias("w")) for k, w in enumerate(weights)))
    out = image.select(*CELL, F.col(value).cast("double").alias(value))
    for axis, size in (("x", extent[0]), ("y", extent[1])):
        other = "y" if axis == "x" else "x"
        # a cell is seen from itself and, near an edge, from places that its mirror images are in reach of
        images = F.array_distinct(F.array(F.col(axis), -F.col(axis), 2 * (size - 1) - F.col(axis)))
        rows = out.select("plan_id", other, value, F.explode(images).alias("at")).select("plan_id", other, value, "at", F.explode(kernel).alias("k"))
        rows = rows.select("plan_id", other, (F.col("at") - F.col("k.d")).alias(axis), (F.col(value) * F.col("k.w")).alias(value)).where(F.col(axis).between(0, size - 1))
        out = rows.groupBy("plan_id", other, axis).agg(F.sum(value).alias(value))
    return out.select(*CELL, value)


def gaussian(size: int) -> list[float]:
    """Weights of a Gaussian of the given width, its spread 0.3 ((size - 1) / 2 - 1) + 0.8."""
    from math import exp

    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    w = [exp(-((k - size // 2) ** 2) / (2 * sigma * sigma)) for k in range(size)]
    return [v / sum(w) for v in w]


def adaptive_threshold(image: DataFrame, extent: Extent, size: int = 21, c: float = 10.0) -> DataFrame:
    """Cells that are darker than the Gaussian mean around them less ``c``."""
    mean = convolved(image, gaussian(size), extent).withColumnRenamed("gray", "mean")
    return image.join(mean, CELL).where(F.col("gray") <= F.rint("mean") - c).select(*CELL)


def _edges(key: tuple, rows: pa.Table, extent: Extent, low: float, high: float, keep: tiles.Keep, bits: int) -> pa.Table:
    """The parts of edges of a tile that comes with three cells around it; see ``canny``."""
    plan, left, top, shape, at = tiles.places(key, rows, 3, bits)
    gray, there = np.zeros(shape), np.zeros(shape, bool)
    np.add.at(gray, at, rows.column("gray").to_numpy())
    there[at] = True
    seen = lambda a, dx, dy: a[1 + dy : len(a) - 1 + dy, 1 + dx : len(a) - 1 + dx]
    near = [(dx, dy) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dx or dy]
    gx, gy = (sum(d[k] * (1 if d[1 - k] else 2) * seen(gray, *d) for d in near) for k in (0, 1))
    y, x = np.ogrid[top + 1 : top + 1 + len(gx), left + 1 : left + 1 + len(gx)]
    inside = (x > 0) & (x < extent[0] - 1) & (y > 0) & (y < extent[1] - 1) & reduce(np.logical_or, (seen(there, *d) for d in near))
    m = np.where(inside, abs(gx) + abs(gy), -1.0)  # less than any gradient where there is none
    turn, same = abs(gy) / np.maximum(abs(gx), 1e-9), np.sign(gx) * np.sign(gy) >= 0
    flat, steep = turn < 0.41421356, turn > 2.41421356
    ridge = np.zeros((len(m) - 2,) * 2, bool)
    for (dx, dy), here in {(1, 0): flat, (0, 1): steep, (1, 1): ~flat & ~steep & same, (1, -1): ~flat & ~steep & ~same}.items():
        ridge |= seen(here, 0, 0) & (seen(m, 0, 0) > seen(m, -dx, -dy)) & (seen(m, 0, 0) >= seen(m, dx, dy))
    m, inside = seen(m, 0, 0), seen(inside, 0, 0)
    return tiles.parts_of(ridge & inside & (m > low), m > high, keep, True, plan, left + 2, top + 2)


def canny(image: DataFrame, extent: Extent, low: float = 60.0, high: float = 160.0, bits: int = tiles.TILE) -> DataFrame:
    """Edges: Sobel gradients that are largest along their direction and over ``low``, in components that reach ``high``.

    Tiles come with three cells around them, so gradients, edges and what continues them at the next tile's rim are known in one task.
    """
    keep = lambda n, hit: hit
    rows = tiles.tiled(image.where("gray is not null").select(*CELL, F.col("gray").cast("double").alias("gray")), 3, bits)
    return tiles.kept(rows.applyInArrow(lambda key, t: _edges(key, t, extent, low, high, keep, bits), tiles.PARTS), keep)


def numbered_images(img: DataFrame) -> DataFrame:
    """Images with ``plan_id``: their places (``origin``) in order, numbered from 1 without gaps, so that no two share one.

    Places are sorted over all tasks, and counted by task first; more than 2^PLAN_BITS images are an error, since cells'
    numbers would not be unique.
    """
    spark = img.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    places = stored(img.select("origin").distinct().repartitionByRange(parts, "origin").withColumn("part", F.spark_partition_id()), "places")
    size = places.groupBy("part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a task
    place = F.row_number().over(Window.partitionBy("part").orderBy("origin"))
    numbers = places.withColumn("place", place).join(size.select("part", before.alias("before")), "part").select("origin", (F.col("before") + F.col("place")).cast("long").alias("plan_id"))
    if places.count() >= 1 << PLAN_BITS:
        raise ValueError(f"more than {1 << PLAN_BITS} images in one table")
    return img.join(numbers, "origin")


def image_pixels(spark: SparkSession, path: str) -> DataFrame:
    """Pixels of the images under a path: plan_id (see ``numbered_images``), x, y, b, g, r, gray and h, s, v.

    Undecodable files are left out.  Images are spread by rows of pixels, which stay in the JVM.
    """
    img = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*").where("nChannels >= 3 or nChannels = 1")
    rows = numbered_images(img).select("plan_id", "width", "nChannels", "data", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y"))
    line = rows.select("plan_id", "y", "width", "nChannels", F.substring("data", F.col("y") * F.col("width") * F.col("nChannels") + 1, F.col("width") * F.col("nChannels")).alias("line"))
    cells = line.select("plan_id", "y", "nChannels", "line", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("x"))
    byte = lambda k: F.conv(F.hex(F.substring("line", F.col("x") * F.col("nChannels") + F.least(F.lit(k + 1), F.col("nChannels")), F.lit(1))), 16, 10).cast("int")
    px = cells.select("plan_id", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), byte(0).alias("b"), byte(1).alias("g"), byte(2).alias("r"))
    return px.withColumn("gray", gray(F.col("b"), F.col("g"), F.col("r"))).withColumn("c", bgr_to_hsv(F.col("b"), F.col("g"), F.col("r"))).select("*", "c.*").drop("c")
