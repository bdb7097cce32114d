"""Overlays, document sinks and readers."""

import json
import os

import pytest
from pyspark.sql import functions as F

from wayfare.operators import overlay, raster, relational
from wayfare.sources import io
from wayfare.sources.documents import write_documents


def _draw(spark, *rows):
    return spark.createDataFrame([(p, layer, s, kind, c, w, k, float(x), float(y)) for p, layer, s, kind, c, w, pts in rows for k, (x, y) in enumerate(pts)], "plan_id long, layer int, shape string, kind string, colour int, width int, seq long, x double, y double")


def test_painted_cells_are_not_sorted(spark):
    rows = [(1, 2, str(k), "line", k, 2, i, float(i * 9), float(k)) for k in range(12) for i in (0, 1)] + [(1, 2, None, "disc", 7, 1, 0, 4.0, 4.0)]
    draw = spark.createDataFrame(rows, "plan_id long, layer int, shape string, kind string, colour int, width int, seq long, x double, y double")
    found = overlay.painted(draw, (10, 12))
    assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()
    got = {(r.x, r.y): r.colour for r in found.collect()}
    assert got[0, 0] == 1 and got[0, 8] == 9 and got[0, 9] == 9 and got[0, 10] == 11 and got[4, 5] == 6 and got[4, 9] == 9


def test_painted_cells(spark):
    """Rings are closed, lines open, higher layers and later names on top; plans at the same places do not mix."""
    draw = _draw(
        spark, (1, 1, "a", "ring", 10, 1, [(1, 1), (4, 1), (4, 3)]), (1, 1, "b", "line", 20, 1, [(0, 1), (2, 1)]), (1, 2, "a", "disc", 30, 1, [(4, 3), (9, 9)]),
        (2, 1, "a", "line", 40, 2, [(2, 2), (4, 2)]), (3, 1, "a", "line", 50, 1, [(5, 5)]),
    )
    got = {(r.plan_id, r.x, r.y): r.colour for r in overlay.painted(draw, (8, 6)).collect()}
    ring = {(1, 1), (2, 1), (3, 1), (4, 1), (4, 2), (4, 3), (2, 2), (3, 2), (2, 3), (3, 3)}
    one = {k[1:]: c for k, c in got.items() if k[0] == 1}
    assert {k for k, c in one.items() if c == 20} == {(0, 1), (1, 1), (2, 1)} and {k for k, c in one.items() if c == 30} == {(4, 3), (3, 3), (5, 3), (4, 2), (4, 4)}
    assert {k for k, c in one.items() if c == 10} <= ring and one[(3, 1)] == 10
    assert {k[1:] for k in got if k[0] == 2} == {(x, y) for x in range(1, 5) for y in (1, 2)} and {k for k in got if k[0] == 3} == {(3, 5, 5)}
    assert overlay.painted(draw.where("false"), (8, 6)).isEmpty()


def test_tiles_are_images(spark, tmp_path):
    cells = spark.createDataFrame([(1, 0, 0, 0xFF0000), (1, 9, 4, 0x00FF00), (1, 12, 6, 0x0000FF)], "plan_id long, x long, y long, colour int")
    tiles = overlay.tiles(cells, (13, 7), size=8).collect()
    assert {(t.tx, t.ty) for t in tiles} == {(0, 0), (1, 0)}
    for t in tiles:
        os.makedirs(f"{tmp_path}/{t.tx}")
        with open(f"{tmp_path}/{t.tx}/tile.png", "wb") as out:
            out.write(t.png)
    left = {(r.x, r.y): (r.r, r.g, r.b) for r in raster.image_pixels(spark, f"file://{tmp_path}/0").collect()}
    right = {(r.x, r.y): (r.r, r.g, r.b) for r in raster.image_pixels(spark, f"file://{tmp_path}/1").collect()}
    assert len(left) == 56 and len(right) == 35  # the second is cut at the extent
    assert left[0, 0] == (255, 0, 0) and right[1, 4] == (0, 255, 0) and right[4, 6] == (0, 0, 255) and left[3, 3] == (255, 255, 255)
    a = spark.createDataFrame([(1, 0, 0)], "plan_id long, x long, y long")
    assert {(r.x, r.colour) for r in overlay.mask_mosaic(a, a, 8).collect()} == {(0, 0xFFFFFF), (8, 0xFFFFFF)}


def test_chain_order(spark):
    rows = [(1, [(0, 0), (5, 0), (1, 0), (5, 5), (2, 2)]), (2, [(0, 0), (2, 0), (0, 2), (0, 2)]), (3, [(1, 1)]), (4, [])]
    df = spark.createDataFrame([(i, [{"x": x, "y": y} for x, y in p]) for i, p in rows], "id int, ring array<struct<x:long,y:long>>")
    got = {r.id: [(p.x, p.y) for p in r.c] for r in df.select("id", relational.chain_order("ring").alias("c")).collect()}
    assert got == {1: [(0, 0), (1, 0), (2, 2), (5, 0), (5, 5)], 2: [(0, 0), (2, 0), (0, 2), (0, 2)], 3: [(1, 1)], 4: []}


def test_documents_are_all_written_or_none(spark, tmp_path):
    path = f"{tmp_path}/out"
    docs = spark.createDataFrame([(k, json.dumps({"plan": k, "text": "Straße"})) for k in range(5)], "plan_id long, bundle string").repartition(3)
    write_documents(docs, path)
    names = lambda: sorted(os.listdir(path))
    assert names() == [f"{k}.json" for k in range(5)] and json.load(open(f"{path}/3.json", encoding="utf-8")) == {"plan": 3, "text": "Straße"}
    new = docs.withColumn("bundle", F.lit("new"))
    with pytest.raises(Exception):  # the last row has no text: its task fails, and no document changes
        write_documents(new.unionByName(spark.createDataFrame([(9, None)], "plan_id long, bundle string")).repartition(4), path)
    assert names() == [f"{k}.json" for k in range(5)] and "new" not in open(f"{path}/0.json").read()
    with pytest.raises(Exception, match="more than one document"):
        write_documents(new.unionByName(new), path)
    assert names() == [f"{k}.json" for k in range(5)] and "new" not in open(f"{path}/0.json").read()
    write_documents(new.where("plan_id = 2"), path)
    assert open(f"{path}/2.json").read() == "new" and "new" not in open(f"{path}/1.json").read()


def test_tables_round_trip(spark, tmp_path):
    centers = spark.createDataFrame([("B", "Unit_1", 3, 4), ("B", "Unit_2", 5, 6)], io.CENTER)
    io.write_csv(centers, f"{tmp_path}/c")
    assert sorted(tuple(r) for r in io.read_centers(spark, f"{tmp_path}/c", 7).collect()) == [(7, "B", "Unit_1", 3, 4), (7, "B", "Unit_2", 5, 6)]
    io.write_csv(centers.where("false"), f"{tmp_path}/c")
    assert io.read_centers(spark, f"{tmp_path}/c").isEmpty()
    rows = spark.createDataFrame([(1, "B", "Unit_1", 1, 0, 0), (1, "B", "Unit_1", 2, 9, 0), (1, "B", "Unit_1", 3, 9, 9)], "plan_id long, block string, unit string, corner int, x int, y int")
    io.write_json(relational.grouped_points(rows).select("block", "unit", "points"), f"{tmp_path}/g")
    one = io.read_units(spark, f"{tmp_path}/g").first()
    assert (one.block, one.unit, [(p.x, p.y) for p in one.ring]) == ("B", "Unit_1", [(0, 0), (9, 0), (9, 9)])
