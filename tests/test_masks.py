"""Runs, distances and the nesting of outlines against brute force on random masks of several plans at the same places."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfare.operators import distance, extract, raster, relational, runs, tiles

W, H = 15, 11
CELLS = [(x, y) for y in range(H) for x in range(W)]


@pytest.fixture(scope="module")
def masks():
    rng = random.Random(3)
    out = {p: {c for c in CELLS if rng.random() < share} for p, share in ((1, 0.3), (2, 0.6), (3, 0.85), (5, 0.97))}
    out[6] = {(0, 0), (W - 1, 0), (0, H - 1), (W - 1, H - 1), (7, 5)}
    out[7] = {(x, y) for x in range(W) for y in range(3, 9)}
    return out


@pytest.fixture(scope="module")
def table(spark, masks):
    rows = [(p, x, y) for p, m in masks.items() for x, y in m]
    return spark.createDataFrame(rows + rows[:20], "plan_id long, x long, y long").repartition(3).cache()


def _got(df):
    rows = [tuple(r) for r in df.select("plan_id", "x", "y").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def _each(masks, f):
    return {(p, x, y) for p, m in masks.items() for x, y in f(m)}


def _inside(x, y):
    return 0 <= x < W and 0 <= y < H


KERNELS = {"cross": raster.cross(), "two": raster.rect(2), "ellipse": raster.ellipse(3), "large": raster.ellipse(5), "tall": raster.rect(9), "gap": [(-2, 0), (2, 0), (0, 1)], "one": [(1, -1)]}


@pytest.mark.parametrize("kernel", KERNELS)
def test_morphology(table, masks, kernel):
    k = KERNELS[kernel]
    dilated = _each(masks, lambda m: {(x, y) for x, y in CELLS if any((x + a, y + b) in m for a, b in k)})
    eroded = _each(masks, lambda m: {(x, y) for x, y in CELLS if all((x + a, y + b) in m for a, b in k if _inside(x + a, y + b)) and any(_inside(x + a, y + b) for a, b in k)})
    assert _got(raster.dilate(table, k, (W, H))) == dilated
    if kernel in ("gap", "one"):
        with pytest.raises(ValueError):
            raster.erode(table, k, (W, H))
    else:
        assert _got(raster.erode(table, k, (W, H))) == eroded


def test_median_and_bands(table, masks):
    clamp = lambda v, n: max(0, min(n - 1, v))
    median = lambda m: {(x, y) for x, y in CELLS if sum((clamp(x + a, W), clamp(y + b, H)) in m for a in (-1, 0, 1) for b in (-1, 0, 1)) >= 5}
    assert _got(raster.median3(table, (W, H))) == _each(masks, median)
    assert _got(raster.median3(table, (W, H), 2)) == _each(masks, lambda m: median(median(m)))
    for r in (1, 3, 20):
        assert _got(raster.within(table, r, (W, H))) == _each(masks, lambda m: {(x, y) for x, y in CELLS if any((x - a) ** 2 + (y - b) ** 2 <= r * r for a, b in m)})


def test_set_algebra_of_runs(table, masks):
    other = {p: {(x, y) for x, y in CELLS if (x * 3 + y * p) % 5 < 2} for p in (1, 2, 9)}
    b = runs.runs_of(table.sparkSession.createDataFrame([(p, x, y) for p, m in other.items() for x, y in m], "plan_id long, x long, y long"))
    a = runs.runs_of(table)
    both = set(masks) | set(other)
    for f, op in ((runs.union, set.__or__), (runs.intersection, set.__and__), (runs.difference, set.__sub__)):
        assert _got(runs.cells_of(f(a, b))) == {(p, *c) for p in both for c in op(masks.get(p, set()), other.get(p, set()))}
    met = runs.meeting(a.withColumn("k", runs.cell_id("x1", "y")), b.withColumn("k", runs.cell_id("x1", "y")), "k", "k").collect()
    brute = [(i, j) for i in a.withColumn("k", runs.cell_id("x1", "y")).collect() for j in b.withColumn("k", runs.cell_id("x1", "y")).collect() if i.plan_id == j.plan_id and i.y == j.y and i.x1 <= j.x2 and j.x1 <= i.x2]
    assert sorted((r.u, r.v) for r in met) == sorted((i.k, j.k) for i, j in brute)


def _flood(cells, diagonal):
    """Cell to the first cell (least y, then x) of its component."""
    out = {}
    for start in sorted(cells, key=lambda c: (c[1], c[0])):
        stack = [] if start in out else [start]
        while stack:
            x, y = c = stack.pop()
            if c in out or c not in cells:
                continue
            out[c] = start
            stack += [(x + a, y + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (diagonal or not a or not b)]
    return out


@pytest.mark.parametrize("diagonal", [True, False])
def test_components(table, masks, diagonal):
    want = {(p, *c, *first) for p, m in masks.items() for c, first in _flood(m, diagonal).items()}
    low = (1 << 20) - 1
    assert {(r.plan_id, r.x, r.y, r.label & low, r.label >> 20 & low) for r in raster.cell_components(table, diagonal).collect()} == want
    edge = {(p, first) for p, m in masks.items() for c, first in _flood(m, diagonal).items() if c[0] in (0, W - 1) or c[1] in (0, H - 1)}
    kept = {(p, *c) for p, m in masks.items() for c, first in _flood(m, diagonal).items() if (p, first) not in edge}
    assert _got(raster.without_border(table, (W, H), diagonal)) == kept


def _far(m, extent, metric):
    pad = 0 if extent else 1
    off = [(x, y) for x in range(-pad, W + pad) for y in range(-pad, H + pad) if (x, y) not in m]
    return {c: min((metric(c[0] - a, c[1] - b) for a, b in off), default=None) for c in m}


@pytest.mark.parametrize("extent", [(W, H), None])
def test_distances(table, masks, extent):
    for f, name, metric in ((distance.euclidean, "d2", lambda a, b: a * a + b * b), (distance.city_block, "d1", lambda a, b: abs(a) + abs(b))):
        want = {(p, *c, d) for p, m in masks.items() for c, d in _far(m, extent, metric).items()}
        assert {(r.plan_id, r.x, r.y, r[name]) for r in f(table, extent).collect()} == want


def test_a_plan_without_outside_has_no_distance(spark):
    full = spark.createDataFrame([(1, x, y) for x, y in CELLS], "plan_id long, x long, y long")
    assert full.sparkSession and distance.euclidean(full, (W, H)).where("d2 is not null").isEmpty()
    assert distance.city_block(full, (W, H)).where("d1 is not null").isEmpty() and raster.skeleton(full, (W, H)).isEmpty()
    assert distance.euclidean(full.where("false")).isEmpty() and distance.ridge(full.where("false")).isEmpty()


def test_envelopes_of_many_rows(monkeypatch):
    rng = np.random.default_rng(2)
    size = rng.integers(1, 60, 80)
    g = rng.choice([0, 1, 3, 9, 40, distance.NONE], size.sum()).astype(np.int64)
    bounds = np.concatenate([[0], np.cumsum(size)])
    got = distance.envelopes(g, bounds)
    for a, b in zip(bounds[:-1], bounds[1:]):
        x = np.arange(b - a)
        assert (got[a:b] == ((x[:, None] - x) ** 2 + g[a:b] ** 2).min(1)).all()
    assert len(distance.envelopes(g[:0], np.zeros(1, np.int64))) == 0


def test_skeleton_is_what_openings_take_away(table, masks):
    k = raster.cross()
    erode = lambda m: {(x, y) for x, y in m if all((x + a, y + b) in m for a, b in k if _inside(x + a, y + b))}
    dilate = lambda m: {(x, y) for x, y in CELLS if any((x + a, y + b) in m for a, b in k)}

    def thin(m):
        out = set()
        while m:
            out |= m - dilate(erode(m))
            m, before = erode(m), m
            if m == before:
                break
        return out

    assert _got(raster.skeleton(table, (W, H))) == _each(masks, thin)


def _depths(m):
    """Of each component of a mask and each hole in it: (is a hole, first cell, first cell of what it lies in)."""
    wide = {(x, y) for x in range(-1, W + 1) for y in range(-1, H + 1)}
    comp, gap = _flood(m, True), _flood(wide - m, False)
    near = lambda f, other: {other[(x + a, y + b)] for x, y in f for a, b in ((-1, 0), (1, 0), (0, -1), (0, 1)) if (x + a, y + b) in other}
    seen, level, out = {("g", gap[(-1, -1)])}, {gap[(-1, -1)]}, []
    outside = True  # from the outside in, components and gaps by turns
    while level:
        cells = [c for c, f in (gap if outside else comp).items() if f in level]
        onto = {}
        for c in cells:
            for f in near([c], comp if outside else gap):
                if ("c" if outside else "g", f) not in seen:
                    onto.setdefault(f, (gap if outside else comp)[c])
        seen |= {("c" if outside else "g", f) for f in onto}
        out += [(not outside, f, None if outside and p == gap[(-1, -1)] else p) for f, p in onto.items()]
        level, outside = set(onto), not outside
    return out


def test_nesting(table, masks):
    low = (1 << 20) - 1
    at = lambda v, moved: None if v is None else ((v & low) - moved, (v >> 20 & low) - moved)
    _, _, tree = runs.nesting(runs.runs_of(table))
    got = {(r.plan_id, r.hole, at(r.label, r.hole), at(r.parent, not r.hole)) for r in tree.collect()}
    assert got == {(p, *row) for p, m in masks.items() for row in _depths(m)}


def _frame(x, y, w, h):
    return {(a, b) for a in range(x, x + w) for b in range(y, y + h) if a in (x, x + w - 1) or b in (y, y + h - 1)}


def _block(x, y, w, h):
    return {(a, b) for a in range(x, x + w) for b in range(y, y + h)}


def test_islands_have_outlines_but_are_not_outermost(spark):
    """Two plans at the same places: a frame in a frame in a frame around a block, with a block beside; and one block."""
    deep = _frame(2, 2, 20, 15) | _frame(4, 4, 12, 11) | _frame(6, 6, 6, 6) | _block(8, 8, 2, 2) | _block(17, 5, 3, 3)
    rows = [(1, *c) for c in deep] + [(2, *c) for c in _block(4, 4, 12, 11)]
    rings = extract.outlines(spark.createDataFrame(rows, "plan_id long, x long, y long")).cache()
    box = lambda r: (r.plan_id, min(p.x for p in r.ring), min(p.y for p in r.ring), max(p.x for p in r.ring), max(p.y for p in r.ring), r.hole)
    by_id = {r.id: r for r in rings.collect()}
    got = {box(r): box(by_id[r.parent_id]) if r.parent_id is not None else None for r in by_id.values()}
    a, a_in = (1, 2, 2, 22, 17, False), (1, 3, 3, 21, 16, True)
    b, b_in = (1, 4, 4, 16, 15, False), (1, 5, 5, 15, 14, True)
    c, c_in = (1, 6, 6, 12, 12, False), (1, 7, 7, 11, 11, True)
    assert got == {a: None, a_in: a, b: a_in, b_in: b, c: b_in, c_in: c, (1, 8, 8, 10, 10, False): c_in, (1, 17, 5, 20, 8, False): a_in, (2, 4, 4, 16, 15, False): None}
    links = {(box(by_id[r.parent_id]), box(by_id[r.id])) for r in relational.children(rings).collect()}
    assert links == {(p, k) for k, p in got.items() if p is not None}
    big = [(p, 10 * x + i, 10 * y + j) for p, x, y in rows for i in range(10) for j in range(10)]
    units = extract._rings_of(spark.createDataFrame(big, "plan_id long, x long, y long"), (300, 300), 0.012).collect()
    assert sorted((r.plan_id, max(p.x for p in r.ring)) for r in units) == [(1, 220), (2, 160)]


@pytest.fixture
def stored_rows(monkeypatch):
    """The rows of each table that the components by tiles store, by name."""
    from wayfare.operators import tiles

    found, whole = {}, tiles.stored

    def counted(df, name="stage"):
        out = whole(df, name)
        found[name] = out.count()
        return out

    monkeypatch.setattr(tiles, "stored", counted)
    return found


@pytest.mark.parametrize("bits", [1, 2, 9])
@pytest.mark.parametrize("diagonal", [True, False])
def test_components_over_tiles_are_the_same(table, masks, bits, diagonal):
    by_runs = runs.labelled(runs.runs_of(table), diagonal)
    want = {(r.plan_id, x, r.y, r.label) for r in by_runs.collect() for x in range(r.x1, r.x2 + 1)}
    got = [tuple(r) for r in tiles.labelled(table, diagonal, bits).select("plan_id", "x", "y", "label").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    sizes = {}
    for _, _, _, label in want:
        sizes[label] = sizes.get(label, 0) + 1
    marked = {label for _, x, _, label in want if x == 7}
    rows = table.select("plan_id", "x", "y", F.lit(True).alias("on"), (F.col("x") == 7).alias("hit"))
    some = tiles.selected(rows, lambda n, hit: (n > 3) & ~hit, diagonal, bits)
    assert _got(some) == {(p, x, y) for p, x, y, label in want if sizes[label] > 3 and label not in marked}


def test_components_within_a_tile_leave_nothing_to_join(spark, stored_rows):
    cells = spark.createDataFrame([(1, x, y) for x in range(0, 500, 5) for y in range(0, 500, 50)], "plan_id long, x long, y long")
    assert raster.cell_components(cells).select("label").distinct().count() == 1000
    assert stored_rows == {"parts": 1000, "roots": 0}


def _canny(image, width, height, low, high):
    near = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]
    grad = {}
    for x, y in ((x, y) for x in range(1, width - 1) for y in range(1, height - 1)):
        gx, gy = (sum(d[k] * (1 if d[1 - k] else 2) * image[x + d[0], y + d[1]] for d in near) for k in (0, 1))
        t = abs(gy) / max(abs(gx), 1e-9)
        same = gx * gy >= 0
        grad[x, y] = abs(gx) + abs(gy), (1, 0) if t < 0.41421356 else (0, 1) if t > 2.41421356 else (1, 1) if same else (1, -1)
    least = (-1, None)
    ridge = {(x, y): m for (x, y), (m, (a, b)) in grad.items() if m > low and m > grad.get((x - a, y - b), least)[0] and m >= grad.get((x + a, y + b), least)[0]}
    found = [c for c, m in ridge.items() if m > high]
    reached = set(found)
    while found:
        x, y = found.pop()
        new = {(x + a, y + b) for a, b in near} & ridge.keys() - reached
        reached |= new
        found += new
    return reached


@pytest.mark.parametrize("bits", [1, 3, 9])
def test_canny_over_tiles(spark, bits):
    rng, size = random.Random(bits), (21, 17)
    images = {p: {(x, y): rng.randrange(0, top) + 40 * (x + y > 20) for x in range(size[0]) for y in range(size[1])} for p, top in ((1, 25), (2, 60), (4, 120))}
    rows = spark.createDataFrame([(p, x, y, v) for p, image in images.items() for (x, y), v in image.items()], "plan_id long, x long, y long, gray int")
    want = _each(images, lambda image: _canny(image, *size, 60, 160))
    assert len(want) > 50 and _got(raster.canny(rows, size, bits=bits)) == want


def test_canny_stores_edges_only(spark, stored_rows):
    image = spark.createDataFrame([(1, x, y, 200 * (x > 30)) for x in range(60) for y in range(60)], "plan_id long, x long, y long, gray int")
    assert raster.canny(image, (60, 60)).count() == 58
    assert stored_rows == {"parts": 58, "roots": 0}  # not the gradients of 3,364 cells


@pytest.mark.parametrize("bits", [3, 9])
def test_free_cells_over_tiles_are_the_same(spark, bits):
    """By tiles, and by the runs' set algebra over the whole image; plan 2 has too few exits for a hull."""
    rng, extent = random.Random(11), (61, 47)
    units, exits = [], [(2, 90.0, 60.0, True), (2, None, None, True), (1, 500.0, 20.0, True)]
    for plan in (1, 2):
        for k in range(7):
            x, y, w, h = rng.randrange(-10, 160), rng.randrange(-10, 130), rng.randrange(6, 40), rng.randrange(6, 30)
            units.append((plan, k, [(x, y), (x + w, y + h // 3), (x + w // 2, y + h), (x, y + h)]))
    exits += [(1, rng.uniform(0, 182), rng.uniform(0, 140), k != 3) for k in range(9)]
    units = spark.createDataFrame(units, "plan_id long, uid long, ring array<struct<x: long, y: long>>")
    exits = spark.createDataFrame(exits, "plan_id long, ex double, ey double, is_corridor boolean")
    taken = raster.polygon_runs(units, 3, extent)
    usable = exits.where("is_corridor and ex is not null and plan_id = 1").select("plan_id", F.col("ex").alias("x"), F.col("ey").alias("y"))
    hull = raster.polygon_runs(relational.hulls(usable, ["plan_id"]), 3, extent).unionByName(runs.canvas(units.where("plan_id = 2"), extent))
    near, walls = runs.discs(taken, 10, extent), runs.dilated(taken, raster.ellipse(2), extent)
    free = runs.median3(runs.difference(runs.intersection(hull, near), walls), extent)
    want = _got(runs.cells_of(runs.touching(free, runs.runs_of(raster.exit_discs(exits, 3, extent, 6)), 9)))
    assert {p for p, _, _ in want} == {1, 2}
    sizes = {"clearance": 6, "near": 30, "exit_radius": 6, "least_area": 81, "bits": bits}
    rows = raster.free_runs(units, exits, (185, 143), **sizes)
    got = [(r.plan_id, x, r.y) for r in rows.collect() for x in range(r.x1, r.x2 + 1)]
    assert len(got) == len(set(got)) and set(got) == want
    assert {r.plan_id for r in rows.where(f"x1 >> {bits} <> x2 >> {bits}").collect()} == set()


def test_upright_sides_send_no_cells(spark, monkeypatch):
    """A spike up and down, a box, a slanted side and a box beyond the image: few rows are merged, and all cells are there."""
    rings = [[(5, 5), (5, 30), (5, 5)], [(10, 2), (30, 2), (30, 32), (10, 32)], [(40, 2), (50, 2), (46, 12), (40, 12)], [(35, -5), (38, -5), (38, 60), (35, 60)]]
    units = spark.createDataFrame([(1, k, r) for k, r in enumerate(rings)], "plan_id long, uid long, ring array<struct<x: long, y: long>>")
    sent, merged = [], raster.merged_runs
    monkeypatch.setattr(raster, "merged_runs", lambda t: sent.append(t.count()) or merged(t))
    got = _got(runs.cells_of(raster.polygon_runs(units, 1, (60, 40))))
    want = {(1, 5, y) for y in range(5, 31)} | {(1, x, y) for x in range(10, 31) for y in range(2, 33)} | {(1, x, y) for x in range(35, 39) for y in range(40)}
    assert {c for c in got if c[1] < 40} == want and {c for c in got if c[1] >= 40} >= {(1, x, y) for x in range(40, 47) for y in range(2, 13)}
    assert sent[0] < 25 + 30 + 10 + 40 + 25  # a row for each row of a polygon, and some
