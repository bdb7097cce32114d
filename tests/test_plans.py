"""Images to units, and units to a route, on drawn plans."""

import json
import random

from pyspark.sql import functions as F

from wayfare.functions import geom as g
from wayfare.operators import extract
from wayfare.plans.rebuild import rebuild
from tests.test_operators import ELL, cells, ring, rings


def test_outlines_and_holes(spark):
    frame = [(x, y) for x in range(2, 12) for y in range(2, 12) if not (4 <= x < 8 and 4 <= y < 9)]
    rows = {r.hole: r for r in extract.outlines(cells(spark, *frame)).collect()}
    assert {(p.x, p.y) for p in rows[False].ring} == {(2, 2), (12, 2), (12, 12), (2, 12)} and rows[False].parent_id is None
    assert {(p.x, p.y) for p in rows[True].ring} == {(4, 4), (8, 4), (8, 9), (4, 9)} and rows[True].parent_id == rows[False].id


def test_pole_centers(spark):
    got = {r.uid: (r.cx, r.cy, r.d2) for r in extract.pole_centers(rings(spark, ring((0, 0), (8, 0), (8, 8), (0, 8)), ELL), (40, 40)).collect()}
    assert got[0] == (4, 4, 25) and got[1][2] == 16


def test_pole_centers_by_unit_and_by_cell(spark, monkeypatch):
    """Slanted and crossing rings, two of one unit, at and beyond the edges of the image: one task a unit gives what a search of all cells gives."""
    draw = random.Random(5)
    shapes = [ring(*((draw.randint(-15, 55), draw.randint(-15, 55)) for _ in range(draw.randint(3, 8)))) for _ in range(60)]
    units = rings(spark, *shapes, ring((-30, -30), (-20, -30), (-20, -20)), ring((5, 5), (30, 5))).withColumn("uid", F.col("uid") - (F.col("uid") == 7).cast("int"))
    by_unit = sorted(tuple(r) for r in extract.pole_centers(units, (45, 40)).collect())
    monkeypatch.setattr(extract, "BOX", 0)
    assert by_unit == sorted(tuple(r) for r in extract.pole_centers(units, (45, 40)).collect()) and len(by_unit) > 50


def test_units_by_colour(spark):
    size = (60, 40)
    boxes = [(5, 5, 20, 15), (30, 10, 50, 30)]
    inside = " or ".join(f"(x >= {a} and x < {c} and y >= {b} and y < {d})" for a, b, c, d in boxes)
    px = spark.range(size[0] * size[1]).selectExpr("1L as plan_id", f"id % {size[0]} as x", f"id div {size[0]} as y").withColumn("on", F.expr(inside))
    px = px.select("plan_id", "x", "y", F.when(F.col("on"), 10).otherwise(90).alias("h"), F.lit(200).alias("s"), F.lit(200).alias("v"), F.when(F.col("on"), 40).otherwise(230).alias("gray"))
    mode, units = extract.extract(px, size)
    rows = sorted(units.collect(), key=lambda r: r.unit)
    assert mode == "color" and [r.unit for r in rows] == ["Unit_1", "Unit_2"]
    assert [len(r.ring) >= 4 for r in rows] == [True, True] and abs(rows[0].cx - 12) <= 1 and abs(rows[1].cy - 20) <= 1
    area = units.select((g.twice_area("ring") / 2).alias("a")).collect()
    assert all(a.a > 120 for a in area)
    assert extract.extract(px, size, mode="structure")[0] == "structure"


def test_units_by_structure(spark):
    size = (120, 120)
    line = "(x between 10 and 110 and y between 10 and 110) and not (x between 14 and 58 and y between 14 and 106) and not (x between 62 and 106 and y between 14 and 106)"
    px = spark.range(size[0] * size[1]).selectExpr("1L as plan_id", f"id % {size[0]} as x", f"id div {size[0]} as y").withColumn("gray", F.when(F.expr(line), 20).otherwise(235))
    rows = extract.structure_units(px, size).collect()
    assert [r.block for r in rows if r.typ == "Block Boundary"] == ["Block_1"]
    assert sorted(r.unit for r in rows if r.typ == "Unit") == ["Unit_1", "Unit_2"]


def test_rebuild(spark):
    box = lambda x, y: ring((x, y), (x + 60, y), (x + 60, y + 60), (x, y + 60))
    units = rings(spark, box(30, 30), box(150, 30), box(30, 150), box(150, 150), box(270, 30), box(270, 150))
    got = rebuild(units, near_px=120, min_comp_area=100)
    assert got["exits"].where("is_corridor").count() == 6 and got["free"].count() > 0
    assert got["connectors"].count() > 0
    steps = sorted(got["route"].collect(), key=lambda r: r.step)
    assert steps and steps[0].a == steps[-1].b and all(p.b == q.a for p, q in zip(steps, steps[1:]))
    doc = json.loads(got["bundle"].first().bundle)
    assert len(doc["units"]) == 6 and len(doc["route"]["line"]) == len(steps) + 1
