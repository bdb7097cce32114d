"""Row operators on units, corners, text boxes and keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfare.functions import geom as g
from wayfare.operators.spatial import UNIT, cell_of, points_in_polygons, ring_cells
from wayfare.plans.scratch import stored


def rings(corners: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key with its corners, in order, as ``ring``."""
    ordered = F.array_sort(F.collect_list(F.struct("corner", "x", "y")))
    return corners.groupBy(*keys).agg(F.transform(ordered, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("ring"))


def corner_table(units: DataFrame, kind: str = "Unit") -> DataFrame:
    """Corners of rings, numbered from 1: the keys, ``typ``, corner, x, y."""
    keys = [c for c in units.columns if c != "ring"]
    return units.select(*keys, F.posexplode("ring")).select(*keys, F.lit(kind).alias("typ"), (F.col("pos") + 1).alias("corner"), F.col("col.x").alias("x"), F.col("col.y").alias("y"))


def numbered_units(units: DataFrame, order: str, per_block: bool = False) -> DataFrame:
    """``unit`` is Unit_1, Unit_2, ... in the given order, over the plan or within each block."""
    over = Window.partitionBy("plan_id", *(["block"] if per_block else [])).orderBy(order)
    return units.withColumn("unit", F.concat(F.lit("Unit_"), F.row_number().over(over)))


def edge_list(units: DataFrame) -> DataFrame:
    """The edges of rings, numbered from 1 around: seq, x1, y1, x2, y2."""
    keys = [c for c in units.columns if c != "ring"]
    return units.select(*keys, F.posexplode(g.edges("ring"))).select(*keys, (F.col("pos") + 1).alias("seq"), "col.*")


def canvas_extent(*points: DataFrame, margin: int = 50) -> DataFrame:
    """(plan_id, width, height): the largest coordinates of all point tables plus a margin, cut to whole numbers."""
    every = points[0].select("plan_id", "x", "y")
    for p in points[1:]:
        every = every.unionByName(p.select("plan_id", "x", "y"))
    size = lambda c: F.floor(F.max(c) + margin).cast("long")
    return every.groupBy("plan_id").agg(size("x").alias("width"), size("y").alias("height"))


def large_units(units: DataFrame, width: int, height: int, mode: str = "color", role: str = "unit") -> DataFrame:
    """Units of a plan of this size whose area is large enough for the mode (colour: inclusive; structure: more than)."""
    area = F.abs(g.twice_area("ring", "double")) / 2
    if mode == "color":
        return units.where(area >= int(220 * (max(width, height) / 4000) ** 2))
    least = max(1000, int(0.001 * width * height)) if role == "block" else max(200, int(5e-5 * width * height))
    return units.where(area > least)


def usable_rings(units: DataFrame) -> DataFrame:
    """Units with at least three different corners around, and a valid ring."""
    return units.where((F.size("ring") >= 3) & g.is_valid("ring"))


def match_text(units: DataFrame, boxes: DataFrame, least: int = 3, cell: float = 100.0) -> DataFrame:
    """Units with the texts of boxes that have ``least`` or more corners strictly inside.

    ``boxes`` have plan_id, box_id, text, bbox.  all_possible_texts: the distinct texts of all of a unit's boxes, sorted;
    matched_texts: those of the boxes with most corners inside; best_text: these joined by spaces.  Blank texts
    are ignored; texts are not trimmed.  Units without a box keep their row with empty lists.
    """
    corners = boxes.where(F.col("text").rlike(r"\S")).select("plan_id", "box_id", "text", F.explode("bbox").alias("c")).select("plan_id", "box_id", "text", "c.x", "c.y")
    inside = points_in_polygons(corners, units.select(*UNIT, "ring"), cell)
    pairs = inside.groupBy(*UNIT, "box_id", "text").agg(F.count("*").alias("pts")).where(F.col("pts") >= least)
    # the boxes of a unit are grouped by text and number of corners first, so a unit has few rows to gather
    texts = pairs.groupBy(*UNIT, "text").agg(F.max("pts").alias("pts"))
    found = texts.groupBy(*UNIT).agg(F.array_sort(F.collect_list(F.struct("text", "pts"))).alias("t"), F.max("pts").alias("most"))
    best = F.transform(F.filter("t", lambda p: p["pts"] == F.col("most")), lambda p: p["text"])
    found = found.select(*UNIT, best.alias("matched_texts"), F.transform("t", lambda p: p["text"]).alias("all_possible_texts"))
    none = F.array().cast("array<string>")
    joined = units.join(found, UNIT, "left")
    joined = joined.withColumn("matched_texts", F.coalesce("matched_texts", none)).withColumn("all_possible_texts", F.coalesce("all_possible_texts", none))
    return joined.withColumn("best_text", F.array_join("matched_texts", " "))


def assign_block(points: DataFrame, blocks: DataFrame, key: str = "pid", cell: float = 200.0, default: str = "Block_1") -> DataFrame:
    """``points`` with ``block``: the first (by idx) that has the point inside or on its boundary, else that with the nearest boundary.

    ``blocks`` have plan_id, idx, name, ring.  A plan without blocks gives ``default``.  The search for the nearest
    boundary doubles its radius until it has one within it; it begins with a quarter of ``cell``, since a point meets every
    side in nine cells of that size.
    """
    points = stored(points, "points")
    inside = points_in_polygons(points.select("plan_id", key, "x", "y"), blocks, cell, boundary=True)
    done = inside.groupBy("plan_id", key).agg(F.min_by("name", "idx").alias("block"))
    sides = stored(blocks.select("plan_id", "idx", "name", F.explode(g.edges("ring")).alias("e")), "sides")
    left = stored(points.select("plan_id", key, "x", "y").join(done, ["plan_id", key], "left_anti").join(blocks.select("plan_id").distinct(), "plan_id", "left_semi"), "left")
    ends = sides.select(F.max(F.greatest(F.abs("e.x1"), F.abs("e.x2"), F.abs("e.y1"), F.abs("e.y2")))).first()[0] or 0
    far = left.select(F.max(F.greatest(F.abs("x"), F.abs("y")))).first()[0] or 0
    radius = cell / 4
    while not left.isEmpty():
        near = left.withColumn("gx", F.explode(F.sequence(cell_of("x", radius) - 1, cell_of("x", radius) + 1))).withColumn("gy", F.explode(F.sequence(cell_of("y", radius) - 1, cell_of("y", radius) + 1)))
        box = F.array(F.struct(F.col("e.x1").alias("x"), F.col("e.y1").alias("y")), F.struct(F.col("e.x2").alias("x"), F.col("e.y2").alias("y")))
        joined = near.join(ring_cells(sides.withColumn("box", box), radius, "box").drop("hx", "hy", "box"), ["plan_id", "gx", "gy"])
        ranked = joined.withColumn("d2", g.segment_distance2(F.col("x"), F.col("y"), F.col("e")))
        best = ranked.groupBy("plan_id", key).agg(F.min("d2").alias("d2"), F.min_by("name", F.struct("d2", "idx")).alias("block"))
        if radius < 4 * (ends + far + 1):
            best = best.where(F.col("d2") <= radius * radius)
        best = stored(best.select("plan_id", key, "block"), "nearest")
        done = done.unionByName(best)
        left = stored(left.join(best, ["plan_id", key], "left_anti"), "left")
        radius *= 2
    return points.join(done, ["plan_id", key], "left").withColumn("block", F.coalesce("block", F.lit(default)))


def keyed(df: DataFrame) -> DataFrame:
    """``df`` with its unit key as it is compared (kb, ku)."""
    return df.withColumn("kb", g.key_part("block")).withColumn("ku", g.key_part("unit"))


def delete_units(units: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, removed): units whose key is, or is not, among ``keys``, of one plan; a key removes all rows that have it."""
    wanted = keyed(keys).select("plan_id", "kb", "ku").distinct()
    rows, on = keyed(units), ["plan_id", "kb", "ku"]
    return tuple(rows.join(wanted, on, how).drop("kb", "ku") for how in ("left_anti", "left_semi"))


def restore_units(units: DataFrame, batch: DataFrame, order: str) -> DataFrame:
    """``units`` and those of ``batch`` whose key is whole and new; of equal keys in the batch the first by ``order``."""
    new = keyed(batch).where("kb <> '' and ku <> ''").withColumn("n", F.row_number().over(Window.partitionBy("plan_id", "kb", "ku").orderBy(order))).where("n = 1")
    new = new.join(keyed(units).select("plan_id", "kb", "ku").distinct(), ["plan_id", "kb", "ku"], "left_anti")
    return units.unionByName(new.select(*units.columns))


def same_keys(a: DataFrame, b: DataFrame) -> DataFrame:
    """(plan_id, only_a, only_b): how many keys just one of two unit tables has; plans without such have no row."""
    mark = lambda df, side: keyed(df).select("plan_id", "kb", "ku").distinct().withColumn(side, F.lit(1))
    both = mark(a, "a").join(mark(b, "b"), ["plan_id", "kb", "ku"], "full").where("a is null or b is null")
    return both.groupBy("plan_id").agg(F.count("a").alias("only_a"), F.count("b").alias("only_b"))


def children(contours: DataFrame) -> DataFrame:
    """(plan_id, parent_id, id) of contours that lie in another, from their links to it."""
    c = contours.select("plan_id", "id", "parent_id").where("parent_id is not null")
    return c.join(contours.select("plan_id", F.col("id").alias("parent_id")), ["plan_id", "parent_id"], "left_semi")


def units_found(corners: DataFrame) -> DataFrame:
    """(plan_id, units_found, units_keyed): distinct unit labels, and distinct (block, unit)."""
    return corners.groupBy("plan_id").agg(F.count_distinct("unit").alias("units_found"), F.count_distinct("block", "unit").alias("units_keyed"))


def grouped_points(corners: DataFrame) -> DataFrame:
    """One row for each (plan, block, unit) in the order of its names, with its points by corner."""
    points = F.transform(F.array_sort(F.collect_list(F.struct("corner", "x", "y"))), lambda p: F.array(p["x"], p["y"]))
    return corners.groupBy(*UNIT).agg(points.alias("points")).orderBy(*UNIT)


def leader_filter(corners: DataFrame, keys: list[str], range_: float, inclusive: bool) -> DataFrame:
    """Corners of each group that no kept corner before them (by ``corner``) has in its range."""

    def fold(kept: Column, p: Column) -> Column:
        d2 = lambda q: (p["x"] - q["x"]) * (p["x"] - q["x"]) + (p["y"] - q["y"]) * (p["y"] - q["y"])
        near = F.exists(kept, lambda q: d2(q) <= range_ * range_ if inclusive else d2(q) < range_ * range_)
        return F.when(near, kept).otherwise(F.concat(kept, F.array(p)))

    ordered = F.array_sort(F.collect_list(F.struct("corner", "x", "y")))
    rows = corners.groupBy(*keys).agg(ordered.alias("all"))
    kept = F.aggregate(F.slice("all", 2, F.size("all")), F.slice("all", 1, 1), fold)
    return rows.select(*keys, F.explode(kept).alias("p")).select(*keys, "p.*")


def remove_nearby(corners: DataFrame, keys: list[str], threshold: float = 10.0) -> DataFrame:
    """The leader filter that drops corners at ``threshold`` or less."""
    return leader_filter(corners, keys, threshold, True)


def superclean(corners: DataFrame, keys: list[str], threshold: float = 20.0) -> DataFrame:
    """The leader filter that drops corners at less than ``threshold``."""
    return leader_filter(corners, keys, threshold, False)


def hulls(points: DataFrame, keys: list[str]) -> DataFrame:
    """The convex hull of each group as ``ring`` (monotone chain): no point on an edge, clockwise where y points down.

    A group's points are first reduced to the least and largest y of each x, which alone can be corners.
    """
    thin = points.groupBy(*keys, "x").agg(F.min("y").alias("lo"), F.max("y").alias("hi"))
    each = thin.select(*keys, "x", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("y"))
    rows = each.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("p"))

    def chain(pts: Column) -> Column:
        def cross(a: Column, b: Column, c: Column) -> Column:
            return (b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"])

        def add(acc: Column, p: Column) -> Column:
            # the points of the chain that stay: all up to the last that turns towards p
            n = F.size(acc)
            keep = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: (k == 1) | (cross(F.get(acc, k - 2), F.get(acc, k - 1), p) > 0))
            return F.concat(F.slice(acc, 1, F.element_at(keep, -1)), F.array(p))

        return F.aggregate(F.slice(pts, 2, F.size(pts)), F.slice(pts, 1, 1), add)

    lower, upper = chain(F.col("p")), chain(F.reverse(F.col("p")))
    whole = F.concat(F.slice(F.col("l"), 1, F.size("l") - 1), F.slice(F.col("u"), 1, F.size("u") - 1))
    return rows.select(*keys, "p", lower.alias("l"), upper.alias("u")).select(*keys, F.when(F.size("p") == 1, F.col("p")).otherwise(whole).alias("ring"))


def chain_order(ring: Column | str) -> Column:
    """The points of an array in nearest-neighbour order: from the first on, always the nearest that is left (ties: the first).

    A fold over the array, for groups as small as a polygon's corners: each step looks at all points that are left.
    """
    points = F.transform(g.col(ring), lambda p, k: F.struct(k.alias("k"), p["x"].alias("x"), p["y"].alias("y")))
    start = F.struct(F.slice(points, 1, 1).alias("path"), F.slice(points, 2, F.greatest(F.size(points), F.lit(1))).alias("left"))

    def step(state: Column, _: Column) -> Column:
        here = F.element_at(state["path"], -1)
        far = lambda q: (q["x"] - here["x"]) * (q["x"] - here["x"]) + (q["y"] - here["y"]) * (q["y"] - here["y"])
        best = F.array_min(F.transform(state["left"], lambda q: F.struct(far(q).alias("d2"), q.alias("q"))))["q"]
        return F.struct(F.concat(state["path"], F.array(best)).alias("path"), F.filter(state["left"], lambda q: q["k"] != best["k"]).alias("left"))

    walked = F.aggregate(F.slice(points, 2, F.greatest(F.size(points), F.lit(1))), start, step, lambda state: state["path"])
    return F.transform(walked, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))


def artefact_counts(**tables: DataFrame) -> DataFrame:
    """(name, n): the rows of each table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out
