"""Closed-form cases of the plan operators: small shapes, empty tables, several plans, and what stays invariant."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfare.functions import geom as g
from wayfare.operators import edits, graph, raster, relational, route, spatial
from wayfare.operators.components import components
from wayfare.plans.queries import QUERIES
from wayfare.sources import io

RING = "array<struct<x:double,y:double>>"


def ring(*points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


SQUARE = ring((0, 0), (10, 0), (10, 10), (0, 10))
ELL = ring((0, 0), (10, 0), (10, 5), (5, 5), (5, 10), (0, 10))
BOW = ring((0, 0), (10, 10), (10, 0), (0, 10))


def rings(spark, *rs, plan=1):
    return spark.createDataFrame([(plan, "B", f"U{k}", k, r) for k, r in enumerate(rs)], f"plan_id long, block string, unit string, uid long, ring {RING}")


def one(df, *cols):
    return df.select(*cols).first()


def test_ring_functions(spark):
    df = rings(spark, SQUARE, ELL, BOW, list(reversed(SQUARE)), ring((0, 0), (5, 0), (9, 0)), ring((0, 0), (4, 4)))
    rows = df.select(g.twice_area("ring").alias("a"), g.is_valid("ring").alias("v"), F.size(g.closed("ring")).alias("n"), g.twice_area(g.oriented("ring")).alias("o"), g.centroid("ring").alias("c"), g.moment_center("ring").alias("m")).collect()
    assert [r.a for r in rows] == [200, 150, 0, -200, 0, 0]
    assert [r.v for r in rows] == [True, True, False, True, False, False]
    assert [r.n for r in rows] == [5, 7, 5, 5, 4, 3]
    assert [r.o for r in rows] == [200, 150, 0, 200, 0, 0]
    assert (rows[0].c.cx, rows[0].c.cy) == (5, 5) and rows[2].c is None and (rows[4].m.cx, rows[4].m.cy) == (0, 0)
    assert df.select(g.is_valid(F.lit(None).cast(RING)).alias("v")).first().v is None


@pytest.mark.parametrize("x, y, strict, loose", [(5, 5, True, True), (0, 5, False, True), (10, 10, False, True), (11, 5, False, False), (5, 0, False, True), (-1, 0, False, False)])
def test_point_in_square(spark, x, y, strict, loose):
    df = rings(spark, SQUARE)
    assert tuple(one(df, g.contains("ring", F.lit(x), F.lit(y)), g.covers("ring", F.lit(x), F.lit(y)))) == (strict, loose)


def test_angle_and_strip(spark):
    df = spark.createDataFrame([(" \t a b\n　",), (None,)], "t string")
    assert [r[0] for r in df.select(g.key_part("t")).collect()] == ["a b", ""]
    angle = lambda *v: one(df, g.angle_between(*map(F.lit, v)))[0]
    assert angle(1.0, 0.0, 0.0, 1.0) == pytest.approx(90) and angle(0.0, 0.0, 1.0, 0.0) == 0 and angle(1.0, 1.0, -1.0, -1.0) == pytest.approx(180)


def test_match_text(spark):
    units = rings(spark, SQUARE, ring((20, 0), (30, 0), (30, 10), (20, 10)))
    box = lambda x, y, w=2: ring((x, y), (x + w, y), (x + w, y + 2), (x, y + 2))
    three, two = ring((9, 1), (9, 3), (8, 2), (11, 2)), ring((9, 1), (9, 3), (11, 1), (11, 3))
    boxes = spark.createDataFrame([(1, 1, "b", box(1, 1)), (1, 2, "a", box(4, 4)), (1, 3, "zz", three), (1, 4, "no", two), (1, 5, "  ", box(1, 1)), (2, 6, "other", box(1, 1)), (1, 7, "a", box(6, 6)), (1, 8, None, box(1, 1))], f"plan_id long, box_id long, text string, bbox {RING}")
    rows = {r.unit: r for r in relational.match_text(units, boxes).collect()}
    assert rows["U0"].best_text == "a b" and rows["U0"].all_possible_texts == ["a", "b", "zz"] and rows["U0"].matched_texts == ["a", "b"]
    assert rows["U1"].best_text == "" and rows["U1"].matched_texts == []
    assert relational.match_text(units.where("false"), boxes).count() == 0
    assert relational.match_text(units, boxes.where("false")).where("best_text <> ''").count() == 0


def test_blocks_without_any_give_the_default(spark):
    points = spark.createDataFrame([(1, 7, 5.0, 5.0), (2, 8, 500.0, 5.0)], "plan_id long, pid long, x double, y double")
    blocks = spark.createDataFrame([(1, 1, "A", SQUARE)], f"plan_id long, idx long, name string, ring {RING}")
    assert {r.pid: r.block for r in relational.assign_block(points, blocks).collect()} == {7: "A", 8: "Block_1"}
    far = points.where("plan_id = 1").withColumn("x", F.lit(99_999.0))
    assert relational.assign_block(far, blocks).first().block == "A"


def test_snapping_moves_to_the_commonest_place(spark):
    rows = [(1, "B", "U1", 1, 0, 0), (1, "B", "U2", 2, 3, 0), (1, "B", "U3", 3, 3, 0), (1, "B", "U4", 4, 100, 0), (1, "B", "U4", 5, 103, 0), (2, "B", "U9", 6, 1, 0)]
    df = spark.createDataFrame(rows, "plan_id long, block string, unit string, vid long, x long, y long")
    got = {r.vid: (r.x, r.y) for r in spatial.snap_vertices(df, 14).collect()}
    assert got == {1: (3, 0), 2: (3, 0), 3: (3, 0), 4: (100, 0), 5: (103, 0), 6: (1, 0)}
    assert spatial.snap_vertices(df.where("false"), 14).count() == 0


def _near_by_hand(rows, tol):
    """Pairs of (plan, key, x, y) and the least key of each one's cluster, comparing all with all."""
    pairs = [(p, a, b, (x - u) ** 2 + (y - v) ** 2) for p, a, x, y in rows for q, b, u, v in rows if p == q and a < b and None not in (x, y, u, v) and (x - u) ** 2 + (y - v) ** 2 <= tol * tol]
    least = {k: k for _, k, *_ in rows}
    for _ in rows:
        for _, a, b, _ in pairs:
            least[a] = least[b] = min(least[a], least[b])
    return sorted(pairs), least


@pytest.mark.parametrize("kind", ["long", "double"])
def test_near_points_over_tiles_are_those_of_all_pairs(spark, kind, monkeypatch):
    rng = random.Random(kind)
    place = (lambda n: rng.randint(-n, n)) if kind == "long" else lambda n: rng.uniform(-n, n)
    rows = [(1 + k % 2, k, place(40 * (1 + k % 3)), place(40)) for k in range(400)]  # tiles of 64 cells of 1.5 and 1.05
    rows += [(1, 400 + k, rows[k][2], rows[k][3]) for k in range(0, 40, 4)] + [(1, 500, None, rows[0][3]), (2, 501, rows[1][2], rows[1][3])]
    df = spark.createDataFrame(rows, f"plan_id long, pid long, x {kind}, y {kind}")
    pairs, least = _near_by_hand(rows, 1.5)
    assert sorted((r.plan_id, r.a, r.b, r.d2) for r in spatial.radius_pairs(df, 1.5).collect()) == pairs
    monkeypatch.setattr(spatial, "radius_pairs", None)  # clusters make no row for a pair
    assert {r.pid: r.cluster for r in spatial.clusters(df, 1.5).collect()} == least


def test_crowded_points_are_clustered_without_a_row_for_a_pair(spark, monkeypatch):
    monkeypatch.setattr(spatial, "radius_pairs", None)
    df = spark.range(40_000).select(F.lit(1).cast("long").alias("plan_id"), F.col("id").alias("pid"), (F.col("id") % 200).alias("x"), F.floor(F.col("id") / 200).alias("y"))
    assert spatial.clusters(df, 12).where("cluster = 0").count() == 40_000  # 8.6 million pairs


def test_points_without_a_place_are_near_nothing(spark):
    df = spark.createDataFrame([(1, 7, 3, 3), (1, 8, None, 3), (1, 9, None, 3), (1, 4, 3, 4)], "plan_id long, pid long, x long, y long")
    assert {r.pid: r.cluster for r in spatial.clusters(df, 2).collect()} == {7: 4, 8: 8, 9: 9, 4: 4}


def test_components_of_points_make_no_row_for_a_pair(spark, monkeypatch):
    from wayfare.plans import queries

    rng = random.Random(8)
    rows = [(1, k, rng.randint(0, 60), rng.randint(0, 60)) for k in range(600)] + [(1, 600 + k, 200 + k % 9, 7 * (k // 9)) for k in range(60)] + [(1, 700, 130, 30)]
    points = spark.createDataFrame(rows, "plan_id long, pid long, x long, y long").cache()
    monkeypatch.setattr(queries, "view", lambda *a: points)
    pairs, least = _near_by_hand(rows, 12)
    at, sizes = {k: (x, y) for _, k, x, y in rows}, {}
    for c in least.values():
        sizes[c] = sizes.get(c, 0) + 1
    first, *more = sorted(sizes)
    assert len(more) == 2
    best = min(sizes, key=lambda c: (-sizes[c], c))
    got = [(r.a, r.b) for r in queries.largest_component(spark, "").collect()]
    assert sorted(got) == [(a, b) for _, a, b, _ in pairs if least[a] == best]
    monkeypatch.setattr(spatial, "radius_pairs", None)
    want = {min((round(math.dist(at[u], at[v]), 6), v, u) for u in at if least[u] == c for v in at if least[v] < c) for c in more}
    assert {(r.length, r.v, r.u) for r in queries.bridge_components(spark, "").collect()} == want


def test_a_block_keeps_no_row_for_each_link(spark, monkeypatch):
    """Crowded nodes whose numbers say nothing of their places: links between blocks far outnumber nodes."""
    from wayfare.operators import components as c

    found, whole = {}, c.stored

    def counted(df, name="stage"):
        out = whole(df, name)
        found[name] = max(out.count(), found.get(name, 0))
        return out

    monkeypatch.setattr(c, "FEW", 50)
    monkeypatch.setattr(c, "stored", counted)
    pairs = [(a, b) for a in range(120) for b in range(a + 1, 120) if (b - a) % 2 == 0] + [(500, 500)]
    table = spark.createDataFrame(pairs, "u long, v long")
    got = {r.id: r.component for r in components(table, block=lambda k: F.shiftright(k, 4)).collect()}
    assert got == {k: k % 2 for k in range(120)} | {500: 500}
    assert found["edges"] == len(pairs) and found["blocks"] < len(pairs) / 3


def test_batches_are_cut_between_tiles(spark):
    import pyarrow as pa

    batches = [pa.record_batch([[1] * 4, [0, 0, 1, 1]], ["p", "t"]), pa.record_batch([[1] * 3, [1, 1, 1]], ["p", "t"]), pa.record_batch([[1, 2], [2, 2]], ["p", "t"])]
    got = [[tuple(r.values()) for r in t.to_pylist()] for t in spatial._whole(iter(batches), ["p", "t"], 3)]
    assert got == [[(1, 0)] * 2, [(1, 1)] * 5 + [(1, 2), (2, 2)]]  # a tile over two batches stays whole


def test_clusters_are_transitive_and_means_weigh_copies(spark):
    df = spark.createDataFrame([(1, k, x, 0) for k, x in enumerate([0, 0, 10, 20, 50])], "plan_id long, pid long, x long, y long")
    got = {r.pid: (r.cluster, r.cx) for r in spatial.cluster_means(df, 12).collect()}
    assert got == {0: (0, 7.5), 1: (0, 7.5), 2: (0, 7.5), 3: (0, 7.5), 4: (4, 50.0)}
    grid = {r.pid: r.cx for r in spatial.cluster_means(df, 4, method="grid").collect()}
    assert grid[2] == 8.0  # 2.5 rounds to even


def test_nearest_against_brute_force(spark):
    rng = random.Random(3)
    p = [(1 + k % 2, k, rng.randrange(3000), rng.randrange(3000)) for k in range(60)]
    t = [(1 + k % 2, k, rng.randrange(3000), rng.randrange(3000)) for k in range(40)]
    got = spatial.nearest(spark.createDataFrame(p, "plan_id long, pid long, x long, y long"), spark.createDataFrame(t, "plan_id long, tid long, x long, y long"), k=3)
    want = {(a, r + 1): k for plan, a, x, y in p for r, (_, k) in enumerate(sorted(((x - u) ** 2 + (y - v) ** 2, k) for q, k, u, v in t if q == plan)[:3])}
    assert {(r.pid, r["rank"]): r.tid for r in got.collect()} == want


def test_nearest_of_a_crowd(spark):
    """40,000 points on four places: pairs of points would be 400 million."""
    n = 40_000
    at = lambda key: spark.range(n).select(F.lit(1).cast("long").alias("plan_id"), F.col("id").alias(key), (F.col("id") % 2).alias("x"), (F.col("id") % 4 / 2).cast("long").alias("y"))
    got = spatial.nearest(at("pid"), at("tid"), k=3)
    assert got.count() == 3 * n and got.where("d2 > 0 or tid <> pid % 4 + 4 * (rank - 1)").isEmpty()
    assert spatial._radius(at("tid").withColumnsRenamed({"x": "tx", "y": "ty"}), 50.0, 12) < 1


def test_exit_points(spark):
    ring_of = lambda x, y, w=40: ring((x, y), (x + w, y), (x + w, y + w), (x, y + w))
    units = rings(spark, ring_of(0, 0), ring_of(45, 0)).withColumn("cx", F.element_at("ring", 1)["x"] + 20).withColumn("cy", F.lit(20.0))
    rows = {r.uid: r for r in spatial.exit_points(units).collect()}
    assert all(r.is_corridor for r in rows.values()) and rows[0].ey < 0 and rows[0].ex == 20
    closed = rings(spark, ring_of(0, 0), ring((-100, -100), (140, -100), (140, -20), (-100, -20)), ring((-100, 60), (140, 60), (140, 140), (-100, 140)), ring((-100, -20), (-20, -20), (-20, 60), (-100, 60)), ring((60, -20), (140, -20), (140, 60), (60, 60)))
    closed = closed.withColumn("cx", F.lit(20.0)).withColumn("cy", F.lit(20.0))
    inner = spatial.exit_points(closed, max_steps=4).where("uid = 0").first()
    assert not inner.is_corridor and inner.ex is None


def test_exit_points_look_no_farther_than_the_ring(spark):
    ring_of = lambda x, y, w=40: ring((x, y), (x + w, y), (x + w, y + w), (x, y + w))
    units = rings(spark, ring_of(0, 0), ring_of(45, 0), ring((0, 100), (300, 100), (300, 400), (280, 400), (280, 120), (0, 120))).withColumn("cx", F.element_at("ring", 1)["x"] + 20).withColumn("cy", F.element_at("ring", 1)["y"] + 15.0)
    few, many = (spatial.exit_points(units, max_steps=n).orderBy("uid").collect() for n in (120, 3_000_000))
    assert few == many and all(r.is_corridor for r in few)


def test_deletes_and_restores(spark):
    units = spark.createDataFrame([(1, "B", "U1", 1), (1, "B", "U1", 2), (1, "B", None, 3), (2, "B", "U1", 4)], "plan_id long, block string, unit string, uid long")
    keys = spark.createDataFrame([(1, " B", "U1\n")], "plan_id long, block string, unit string")
    kept, gone = relational.delete_units(units, keys)
    assert {r.uid for r in kept.collect()} == {3, 4} and {r.uid for r in gone.collect()} == {1, 2}
    back = relational.restore_units(kept, units, "uid")
    assert {r.uid for r in back.collect()} == {1, 3, 4}
    assert relational.same_keys(back, units).count() == 0
    assert relational.same_keys(kept, units).first().only_b == 1


def test_undo_is_a_stack(spark):
    rows = [(1, 1, 1, "delete"), (1, 2, 2, "delete"), (1, 3, 3, "undo"), (1, 4, 4, "undo"), (1, 5, 5, "undo"), (2, 6, 6, "delete"), (2, 7, 7, "undo")]
    log = spark.createDataFrame([(p, e, t, op, "B", f"U{e}") for p, e, t, op in rows], "plan_id long, edit_id long, ts long, op string, block string, unit string")
    assert sorted(tuple(r) for r in edits.undone(log).collect()) == [(1, 3, 2), (1, 4, 1), (2, 7, 6)]
    assert edits.undone(log, depth=1).where("plan_id = 1").count() == 1
    units = spark.createDataFrame([(1, "B", "U1"), (1, "B", "U2"), (2, "B", "U6"), (2, "B", "U8")], "plan_id long, block string, unit string")
    assert edits.current_units(units, log).count() == 1
    assert edits.current_units(units, edits.with_undos(log)).count() == 4


def test_stream_of_edits(spark, tmp_path):
    from wayfare.streaming.edits import stream_last_ops

    schema = "plan_id long, edit_id long, ts timestamp, op string, block string, unit string"
    write = lambda rows, name: spark.createDataFrame(rows, "plan_id long, edit_id long, t long, op string, block string, unit string").select("plan_id", "edit_id", F.timestamp_seconds("t").alias("ts"), "op", "block", "unit").coalesce(1).write.parquet(f"{tmp_path}/{name}")
    write([(1, 1, 10, "delete", "B", "U1"), (1, 2, 20, "delete", "B", "U2")], "in/a")
    write([(1, 3, 30, "restore", "B ", "U1"), (1, 4, 15, "restore", "B", "U2"), (1, 5, 40, "noop", "B", "U2")], "in/b")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    q = stream_last_ops(stream).writeStream.format("memory").queryName("ops").outputMode("update").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    rows = spark.table("ops").collect()
    last = {r.ku: r.op for r in sorted(rows, key=lambda r: r.edit_id)}
    assert last["U1"] == "restore" and [r.op for r in rows if r.ku == "U2"] == ["delete"] or last["U2"] == "delete"


def cells(spark, *xy, plan=1):
    return spark.createDataFrame([(plan, x, y) for x, y in xy], "plan_id long, x long, y long")


def test_skeleton_and_components(spark):
    bar = [(x, y) for x in range(2, 12) for y in range(3, 6)]
    sk = {(r.x, r.y) for r in raster.skeleton(cells(spark, *bar), (20, 20)).collect()}
    assert {(x, 4) for x in range(3, 11)} <= sk <= set(bar)
    assert raster.skeleton(cells(spark, (5, 5)), (20, 20)).count() == 1
    assert raster.skeleton(cells(spark, (5, 5)).where("false"), (20, 20)).count() == 0
    two = cells(spark, (0, 0), (1, 1), (5, 5)).union(cells(spark, (0, 0), plan=2))
    assert raster.cell_components(two).select("label").distinct().count() == 3
    assert raster.cell_components(two, diagonal=False).select("label").distinct().count() == 4
    assert {(r.x, r.y) for r in raster.without_border(two, (10, 10)).collect()} == {(1, 1), (5, 5)}


def test_contours_of_a_frame(spark):
    frame = [(x, y) for x in range(2, 7) for y in range(2, 7) if x in (2, 6) or y in (2, 6)]
    rows = graph.contours(cells(spark, *frame, (10, 10), (11, 11))).collect()
    by = {}
    for r in rows:
        by.setdefault((r.contour, r.hole), []).append(r)
    assert sorted((len(v), h) for (_, h), v in by.items()) == [(8, False), (12, True), (20, False)]
    for v in by.values():
        v.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in v] == list(range(len(v)))
        assert all(abs(a.x - b.x) + abs(a.y - b.y) == 1 for a, b in zip(v, v[1:] + v[:1]))


def test_outlines_are_looked_up_once_each(spark):
    frame = [(x, y) for x in range(2, 7) for y in range(2, 7) if x in (2, 6) or y in (2, 6)]
    got = graph.contour_sizes(cells(spark, *frame, (10, 10), (11, 11))).collect()
    assert sorted((r.n_sides, r.hole) for r in got) == [(8, False), (12, True), (20, False)]
    assert {(r.x, r.y) for r in got} <= {*frame, (10, 10), (11, 11)}
    plan = QUERIES["contours"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan  # sides were joined with cells, and written twice to count outlines of each


def test_ranges_and_modes(spark):
    assert raster.parse_range("-5,300,10:200,1,999") == ((0, 255, 10), (179, 1, 255))
    with pytest.raises(ValueError):
        raster.parse_range("1,2,3")
    with pytest.raises(ValueError):
        raster.ranges_of(preset="mauve")
    assert raster.ranges_of(["1,2,3:4,5,6"], "red") == [((1, 2, 3), (4, 5, 6))] and raster.ranges_of() == raster.PRESETS["orange"]
    df = spark.createDataFrame([(0.5,), (0.015,), (0.001,)], "f double").select(raster.choose_mode(F.col("f")).alias("m"), raster.choose_mode(F.col("f"), "structure").alias("k"))
    assert [r.m.mode for r in df.collect()] == ["color", "color", "structure"] and {r.k.mode for r in df.collect()} == {"structure"}
    hsv = spark.createDataFrame([(0, 0, 255), (255, 0, 0), (128, 128, 128), (0, 128, 255)], "b int, g int, r int").select(raster.bgr_to_hsv(F.col("b"), F.col("g"), F.col("r")).alias("c")).collect()
    assert [tuple(r.c) for r in hsv] == [(0, 255, 255), (120, 255, 255), (0, 0, 128), (15, 255, 255)]


def test_free_mask_runs_between_units(spark):
    box = lambda x, y: ring((x, y), (x + 60, y), (x + 60, y + 60), (x, y + 60))
    units = rings(spark, box(30, 30), box(150, 30), box(30, 150), box(150, 150))
    exits = spark.createDataFrame([(1, 120.0, 60.0, True), (1, 60.0, 120.0, True), (1, 180.0, 120.0, True), (1, 120.0, 180.0, True), (1, None, None, False)], "plan_id long, ex double, ey double, is_corridor boolean")
    free = {(r.x, r.y) for r in raster.free_mask(units, exits, (260, 260)).collect()}
    assert (40, 40) in free and not free & {(20, 20), (60, 60), (0, 0)}
    spans = raster.free_runs(units, exits, (260, 260)).collect()
    assert len(spans) < len(free) / 4 and {(x, r.y) for r in spans for x in range(r.x1, r.x2 + 1)} == free


def edge_table(spark, *rows):
    return spark.createDataFrame([(1, k, u, v, float(w)) for k, (u, v, w) in enumerate(rows)], "plan_id long, eid long, u long, v long, length double")


def test_degree_contract_and_prune(spark):
    e = edge_table(spark, (1, 2, 1), (2, 3, 1), (3, 4, 1), (4, 4, 5), (4, 1, 1), (4, 9, 2))
    assert {r.node: r.degree for r in graph.degrees(e).collect()} == {1: 2, 2: 2, 3: 2, 4: 5, 9: 1}
    got = sorted((r.u, r.v, r.length, r.n_edges) for r in graph.contract(e).collect())
    assert got == [(4, 4, 4.0, 4), (4, 4, 5.0, 1), (4, 9, 2.0, 1)]
    ring_only = edge_table(spark, (1, 2, 1), (2, 3, 1), (3, 1, 1))
    assert [(r.u, r.v, r.length) for r in graph.contract(ring_only).collect()] == [(1, 1, 3.0)]
    assert graph.prune_spurs(e, 2).count() == 5 and graph.prune_spurs(e, 1).count() == 6
    order = [(r["rank"], r.node) for r in sorted(graph.ordered_chains(edge_table(spark, (5, 2, 1), (2, 7, 1), (7, 3, 1))).collect(), key=lambda r: r["rank"])]
    assert order == [(0, 3), (1, 7), (2, 2), (3, 5)]


@pytest.mark.parametrize("few", [0, 1 << 17])
def test_components_of_chains_stars_and_loops(spark, monkeypatch, few):
    monkeypatch.setattr("wayfare.operators.components.FEW", few)
    rng = random.Random(1)
    pairs = [(k, k + 1) for k in range(200)] + [(1000, 1000 + k) for k in range(1, 300)] + [(5000, 5000), (7, None)]
    rng.shuffle(pairs)
    got = {r.id: r.component for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(201)} | {1000 + k: 1000 for k in range(300)} | {5000: 5000}


@pytest.mark.parametrize("few", [0, 1 << 17])
def test_ranked_chains(spark, monkeypatch, few):
    monkeypatch.setattr(graph, "FEW", few)
    links = [(k, k - 1) for k in range(1, 70)] + [(100, 101), (200, 5000), (5000, 7)]
    links = [p for p in links if p != (8, 7)]
    got = {r.id: (r.head, r["rank"]) for r in graph.ranked_chains(spark.createDataFrame(links, "id long, next long")).collect()}
    want = {k: (69, 69 - k) for k in range(8, 70)} | {200: (200, 0), 5000: (200, 1)} | {k: (200, 9 - k) for k in range(8)} | {100: (100, 0), 101: (100, 1)}
    assert got == want
    assert graph.ranked_chains(spark.createDataFrame([], "id long, next long")).isEmpty()
    with pytest.raises(RuntimeError):
        graph.ranked(np.array([1, 2, 3]), np.array([2, 3, 1]))


@pytest.fixture
def no_rounds(monkeypatch):
    """Small tables count as large ones, and rounds on them are errors."""
    from wayfare.operators import components as c

    def strict(df, name="stage"):
        assert name not in ("stars", "ranks")
        return whole(df, name)

    whole = c.stored
    for module in (c, graph):
        monkeypatch.setattr(module, "FEW", 50)
        monkeypatch.setattr(module, "stored", strict)


def test_near_nodes_and_lists_are_settled_by_blocks(spark, no_rounds):
    pairs = [(k, k + 1) for k in range(16350, 16450)] + [(70000 + k, 70001 + k) for k in range(0, 90, 3)]
    want = {k: 16350 for k in range(16350, 16451)} | {70000 + k + j: 70000 + k for k in range(0, 90, 3) for j in (0, 1)}
    table = spark.createDataFrame(pairs, "u long, v long")
    assert {r.id: r.component for r in components(table, block=lambda c: F.shiftright(c, 14)).collect()} == want
    back = table.select(F.col("v").alias("id"), F.col("u").alias("next"))  # a list from 16450 on, over the edge of a block
    got = {r.id: (r.head, r["rank"]) for r in graph.ranked_chains(back).collect()}
    assert got == {k: (16450, 16450 - k) for k in range(16350, 16451)} | {70000 + k + j: (70001 + k, 1 - j) for k in range(0, 90, 3) for j in (0, 1)}


def test_chains_are_found_once_and_ordered_by_numbers_of_directions(spark, monkeypatch):
    # a path over shuffled nodes, a ring, a ring on a stalk, a self-loop, a pair of parallel edges
    rows = [(1, 1, 5, 3), (1, 2, 9, 3), (1, 3, 9, 2), (2, 11, 22, 21), (2, 12, 22, 23), (2, 13, 21, 23), (3, 21, 31, 32), (3, 22, 33, 32), (3, 23, 33, 34), (3, 24, 34, 32), (4, 31, 41, 41), (5, 41, 51, 52), (5, 42, 52, 51)]
    e = spark.createDataFrame([(*r, 1.0) for r in rows], "plan_id long, eid long, u long, v long, length double")
    calls, whole, sent, ranked = [], graph.components, [], graph.ranked_chains
    monkeypatch.setattr(graph, "components", lambda t, *a, **k: calls.append(t) or whole(t, *a, **k))
    monkeypatch.setattr(graph, "ranked_chains", lambda t, *a: sent.append(t.count()) or ranked(t, *a))
    got = {}
    for r in sorted(graph.ordered_edges(e).collect(), key=lambda r: (r.chain, r["rank"])):
        got.setdefault(r.chain, [r.a]).append(r.b)
        assert (r.a, r.b) in ((u, v) if r.d == 0 else (v, u) for _, k, u, v in rows if k == r.eid)
    assert got == {1: [2, 9, 3, 5], 11: [21, 22, 23, 21], 21: [31, 32], 22: [32, 33, 34, 32], 31: [41, 41], 41: [51, 52, 51]}
    assert len(calls) == 1 and sent == [2 * 2 + 2 * 2 + 2 * 2 + 1 * 2]  # two a joint, none where a ring begins


def test_plans_of_near_nodes_are_connected_without_rounds(spark, no_rounds):
    e = spark.createDataFrame([(k // 40, k, k, k + 1, 1) for k in range(0, 400) if k % 40 < 30], "plan_id long, eid long, u long, v long, length long")
    nodes = e.select("plan_id", F.col("u").alias("id")).union(e.select("plan_id", "v")).distinct()
    assert {r.id: r.component for r in graph.connected(nodes, e).collect()} == {k: k // 40 * 40 for k in range(400) if k % 40 < 31}


def test_outlines_within_a_tile_are_made_at_once(spark, no_rounds):
    squares = [(x + dx, y + dy) for x in range(0, 30, 5) for y in range(505, 530, 5) for dx in range(3) for dy in range(3) if (dx, dy) != (1, 1)]
    rows = graph.contours(cells(spark, *squares)).collect()
    assert len(rows) == 30 * 16 and len({r.contour for r in rows if r.hole}) == len({r.contour for r in rows if not r.hole}) == 30
    for contour in {r.contour for r in rows}:
        own = sorted((r["rank"], r.x, r.y) for r in rows if r.contour == contour)
        assert [r[0] for r in own] == list(range(len(own))) and min((y, x) for _, x, y in own) == own[0][:0:-1]
        assert all(abs(a[1] - b[1]) + abs(a[2] - b[2]) == 1 for a, b in zip(own, own[1:] + own[:1]))


@pytest.mark.parametrize("bits", [1, 2, 9])
def test_outlines_over_tiles_are_the_same(spark, bits):
    rng = random.Random(bits)
    mask = cells(spark, *((x, y) for x in range(25) for y in range(20) if rng.random() < 0.6))
    assert sorted(map(tuple, graph.contours(mask, bits).collect())) == sorted(map(tuple, graph.contours(mask).collect()))


def test_blocks_are_first_searched_for_in_small_cells(spark, monkeypatch):
    sizes, whole = [], relational.ring_cells
    monkeypatch.setattr(relational, "ring_cells", lambda t, size, *more: sizes.append(size) or whole(t, size, *more))
    blocks = rings(spark, SQUARE, ELL).select("plan_id", F.col("uid").alias("idx"), F.col("unit").alias("name"), "ring")
    points = spark.createDataFrame([(1, 1, 2.0, 2.0), (1, 2, 30.0, 2.0), (1, 3, 900.0, 2.0), (1, 4, 7.0, 12.0)], "plan_id long, pid long, x double, y double")
    got = {r.pid: r.block for r in relational.assign_block(points, blocks, "pid", cell=100.0).collect()}
    assert got == {1: "U0", 2: "U0", 3: "U0", 4: "U0"} and sizes[:2] == [25.0, 50.0]


def test_shortest_paths_and_route(spark):
    e = edge_table(spark, (1, 2, 1), (2, 3, 1), (1, 3, 5), (3, 4, 1), (4, 5, 1), (2, 5, 9), (1, 2, 4))
    odd = graph.degrees(e).where("degree % 2 = 1")
    steps = sorted(route.route(e).collect(), key=lambda r: r.step)
    assert {r.eid for r in steps} == set(range(7)) and steps[0].a == steps[-1].b and all(p.b == q.a for p, q in zip(steps, steps[1:]))
    dist = {(r.source, r.node): r.dist for r in graph.shortest_paths(e, odd).collect()}
    nodes = [r.node for r in odd.collect()]
    extra = sum(r.length for r in steps if r.again)
    assert len(nodes) == 2 and extra == dist[nodes[0], nodes[1]]
    assert route.route(edge_table(spark, (1, 2, 1), (3, 4, 1))).count() == 0
    assert route.route(e.where("false")).count() == 0


@pytest.mark.parametrize("few", [0, 1 << 17])
def test_shortest_paths_of_random_graphs(spark, monkeypatch, few):
    """Against Floyd and Warshall, with parallel edges, loops, two plans, and a source without edges; predecessors lie on a shortest path."""
    monkeypatch.setattr(graph, "FEW", few)
    rng = random.Random(9)
    rows = [(p, p * 100 + k, p * 100 + rng.randrange(12), p * 100 + rng.randrange(12), float(rng.randrange(1, 5))) for p in (1, 2) for k in range(20)]
    dist = {(n, n): 0.0 for _, _, u, v, _ in rows for n in (u, v)} | {(150, 150): 0.0}
    for _, _, u, v, w in rows:
        for a, b in ((u, v), (v, u)):
            dist[a, b] = min(dist.get((a, b), math.inf), w)
    ids = sorted({a for a, _ in dist})
    for k in ids:
        for a in ids:
            for b in ids:
                if dist.get((a, k), math.inf) + dist.get((k, b), math.inf) < dist.get((a, b), math.inf):
                    dist[a, b] = dist[a, k] + dist[k, b]
    edges = spark.createDataFrame(rows, "plan_id long, eid long, u long, v long, length double")
    sources = spark.createDataFrame([(n // 100, n) for n in ids], "plan_id long, node long")
    got = graph.shortest_paths(edges, sources).collect()
    assert {(r.source, r.node): r.dist for r in got} == dist and len(got) == len(dist)
    least = {(min(u, v), max(u, v)): min(x[4] for x in rows if {x[2], x[3]} == {u, v}) for _, _, u, v, _ in rows}
    for r in got:
        assert (r.via is None) == (r.source == r.node)
        assert r.via is None or dist[r.source, r.via] + least[min(r.via, r.node), max(r.via, r.node)] == r.dist


def test_shortest_paths_of_plans_without_rounds(spark, monkeypatch):
    """Of a large table only plans that are large themselves take rounds; both ways give the same distances."""
    monkeypatch.setattr(graph, "FEW", 0)
    rng = random.Random(4)
    rows = [(p, p * 100 + k, p * 100 + rng.randrange(12), p * 100 + rng.randrange(12), float(rng.randrange(1, 5))) for p in (1, 2, 3) for k in range(20 if p < 3 else 60)]
    edges = spark.createDataFrame(rows, "plan_id long, eid long, u long, v long, length double")
    sources = spark.createDataFrame([(p, p * 100 + k) for p in (1, 2, 3, 4) for k in range(12)], "plan_id long, node long")
    rounds, seen = graph._paths_in_rounds, []
    monkeypatch.setattr(graph, "_paths_in_rounds", lambda steps, own, most: seen.append({r.plan_id for r in own.distinct().collect()}) or rounds(steps, own, most))
    found = []
    for paths in (1 << 20, 600, 0):
        monkeypatch.setattr(graph, "PATHS", paths)
        found.append(sorted((r.plan_id, r.source, r.node, r.dist) for r in graph.shortest_paths(edges, sources).collect()))
    assert found[0] == found[1] == found[2] and len(found[0]) > 300 and seen == [{3}, {1, 2, 3}]


def test_simplified_lines_stay_in_columns(spark):
    """Null, empty and short lines, columns beside them; points are not made objects one by one."""
    from pyspark.sql import functions as F

    zigzag = [(k, k % 2 * 5) for k in range(9)]
    rows = [(0, None), (1, []), (2, [(1, 1)]), (3, [(0, 0), (5, 1), (9, 0)]), (4, zigzag), (5, None), (6, [(k, 0) for k in range(2000)])]
    lines = spark.createDataFrame(rows, "pl_id long, points array<struct<x: long, y: long>>").repartition(1)
    found = route.simplified(lines.withColumn("n", F.size("points")), 1.2)
    assert "ArrowEvalPython" in found._jdf.queryExecution().executedPlan().toString() and found.schema["points"].dataType == lines.schema["points"].dataType
    got = {r.pl_id: r.points and [tuple(p) for p in r.points] for r in found.collect()}
    assert got == {0: None, 1: [], 2: [(1, 1)], 3: [(0, 0), (9, 0)], 4: zigzag, 5: None, 6: [(0, 0), (1999, 0)]}


def test_matching_is_least(spark):
    rng = random.Random(2)
    for n in (2, 4, 6, 8):
        pts = [(rng.random(), rng.random()) for _ in range(n)]
        dist = {(a, b): math.dist(pts[a], pts[b]) for a in range(n) for b in range(a + 1, n)}

        def least(left):
            if not left:
                return 0.0
            a, *rest = left
            return min(dist[a, b] + least([x for x in rest if x != b]) for b in rest)

        pairs = route.match_odd(list(range(n)), dist)
        assert sorted(x for p in pairs for x in p) == list(range(n)) and sum(dist[p] for p in pairs) == pytest.approx(least(list(range(n))))
    many = route.match_odd(list(range(40)), {(a, b): abs(a - b) + 0.0 for a in range(40) for b in range(a + 1, 40)})
    assert sorted(x for p in many for x in p) == list(range(40)) and sum(b - a for a, b in many) == 20


def test_matching_is_least_at_every_size():
    """Points in two far groups of an odd number each, by dynamic programming over the sorted rest."""
    rng = random.Random(8)
    for n in (4, 10, 18, 18, 18, 20):
        pts = [(rng.random() + 3 * (k % 2), rng.choice([0.0, 0.5, rng.random()])) for k in range(n)]
        dist = {(a, b): math.dist(pts[a], pts[b]) for a in range(n) for b in range(a + 1, n)}
        best = {0: 0.0}
        for mask in range(1, 1 << n):
            if mask.bit_count() % 2 == 0:
                i = mask.bit_length() - 1
                best[mask] = min(best[mask ^ 1 << i ^ 1 << j] + dist[j, i] for j in range(i) if mask >> j & 1)
        pairs = route.match_odd(list(range(n)), dist)
        assert sorted(x for p in pairs for x in p) == list(range(n)) and sum(dist[p] for p in pairs) == pytest.approx(best[(1 << n) - 1])
    # greedy takes the short gaps and exchanges of two pairs never leave this: a ring of 18 nodes, gaps 1 and 1.01
    n = 18
    ring_at = [k + 0.01 * (k // 2) for k in range(n)]
    whole = n + 0.01 * 9 - 0.02
    dist = {(a, b): min(ring_at[b] - ring_at[a], whole - ring_at[b] + ring_at[a]) for a in range(n) for b in range(a + 1, n)}
    assert sum(dist[p] for p in route.match_odd(list(range(n)), dist)) == pytest.approx(min(9.0, whole - 9.0))
    with pytest.raises(KeyError):
        route.match_odd([1, 2, 3, 4], {(1, 2): 1.0, (1, 3): 1.0, (1, 4): 1.0})


def test_bridges_join_all_components(spark):
    nodes = spark.createDataFrame([(1, k, x, 0.0) for k, x in enumerate([0.0, 5.0, 400.0, 405.0, 90.0])], "plan_id long, id long, x double, y double")
    e = spark.createDataFrame([(1, 1, 0, 1, 5.0), (1, 2, 2, 3, 5.0)], "plan_id long, eid long, u long, v long, length double")
    assert sorted((r.u, r.v, r.length) for r in graph.bridges(nodes, e).collect()) == [(2, 1, 395.0), (4, 1, 85.0)]
    assert graph.largest_component(nodes, e).first().eid == 1


def test_stitching_and_greedy_pairs(spark):
    tips = spark.createDataFrame([(1, 1, 1, 0.0, 0.0, 1.0, 0.0), (1, 2, 2, 10.0, 0.0, 1.0, 0.0), (1, 3, 3, 12.0, 3.0, 0.0, 1.0), (1, 4, 1, 5.0, 0.0, 1.0, 0.0)], "plan_id long, tid long, pl_id long, x double, y double, dx double, dy double")
    pairs = graph.stitch_pairs(tips, None)
    assert sorted((r.a, r.b) for r in pairs.collect()) == [(1, 2), (2, 4)]
    assert [(r.a, r.b) for r in graph.mutual_pairs(pairs).collect()] == [(2, 4)]


def test_simplify(spark):
    rng = random.Random(5)
    line = [(float(k), math.sin(k / 9) * 5 + rng.random()) for k in range(80)]
    df = spark.createDataFrame([(1, 1, ring(*line)), (1, 2, ring((0, 0), (9, 9))), (1, 3, None)], f"plan_id long, pl_id long, points {RING}")
    rows = {r.pl_id: r.points for r in route.simplified(df, 1.2).collect()}
    got = [(p.x, p.y) for p in rows[1]]
    assert got[0] == line[0] and got[-1] == line[-1] and len(got) < len(line) and set(got) <= set(line)
    for x, y in line:
        assert min(_gap(x, y, a, b) for a, b in zip(got, got[1:])) <= 1.2 + 1e-9
    assert len(rows[2]) == 2 and rows[3] is None


def _gap(x, y, a, b):
    (ax, ay), (bx, by) = a, b
    t = max(0, min(1, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2)))
    return math.hypot(ax + t * (bx - ax) - x, ay + t * (by - ay) - y)


def test_readers_and_bundle(spark, tmp_path):
    (tmp_path / "boxes.json").write_text(json.dumps([{"text": "", "description": "Shop", "bounds": [[0, 0], [1, 0], [1, 1], [0, 1]]}, {"text": "A é", "bbox": [[0, 0], [2, 0], [2, 2], [0, 2]]}]))
    boxes = io.read_boxes(spark, f"file://{tmp_path}/boxes.json").collect()
    assert {(r.text, len(r.bbox)) for r in boxes} == {("Shop", 4), ("A é", 4)}
    (tmp_path / "lines.json").write_text(json.dumps({"polylines": [[[0, 0], [3, 4]]], "downscale": 3}))
    (tmp_path / "bare.json").write_text(json.dumps([[[0, 0], [3, 4], [5, 5]]]))
    assert [io.read_polylines(spark, f"file://{tmp_path}/{n}.json").count() for n in ("lines", "bare")] == [2, 3]
    (tmp_path / "units.json").write_text(json.dumps([{"block": "B", "unit": "U", "polygon_points": [[0, 0], [1, 0], [1, 1], [0, 0]], "centroid": [0.5, 0.25]}]))
    units = io.read_units(spark, f"file://{tmp_path}/units.json")
    assert len(units.first().ring) == 3 and units.first().cy == 0.25
    (tmp_path / "exits.json").write_text(json.dumps([{"block": "B", "unit": "U", "centroid": [1, 2], "exit_point": None, "is_corridor": False}]))
    exits = io.read_exits(spark, f"file://{tmp_path}/exits.json")
    corners = relational.corner_table(units.select("plan_id", "block", "unit", "ring")).select(F.col("block").alias("Block"), F.col("typ").alias("Type"), F.col("unit").alias("Unit"), F.col("corner").alias("Corner"), F.col("x").cast("int").alias("X"), F.col("y").cast("int").alias("Y"))
    io.write_csv(corners, f"file://{tmp_path}/csv")
    io.write_csv(corners.where("false"), f"file://{tmp_path}/csv2")
    assert io.read_corners(spark, f"file://{tmp_path}/csv").count() == 3
    line = io.read_polylines(spark, f"file://{tmp_path}/bare.json")
    doc = json.loads(io.bundle(units, exits, line, line.select("plan_id", "seq", "x", "y"), 7).first().bundle)
    assert doc["projectVersion"] == 7 and doc["units"][0]["unit"] == "U" and doc["exits"][0]["exit_point"] is None and len(doc["route"]["line"]) == 3 and doc["polylines"] == [[[0, 0], [3, 4], [5, 5]]]
    assert io.file_stats(spark, f"file://{tmp_path}/bare.json").first().size == (tmp_path / "bare.json").stat().st_size


def test_image_source(spark, tmp_path):
    import struct
    import zlib

    def png(rows):
        chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
        raw = b"".join(b"\0" + bytes(v for px in row for v in px) for row in rows)
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", len(rows[0]), len(rows), 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")

    (tmp_path / "a.png").write_bytes(png([[(255, 0, 0), (0, 255, 0), (0, 0, 255)], [(255, 255, 255), (0, 0, 0), (255, 128, 0)]]))
    rows = {(r.x, r.y): (r.h, r.s, r.v) for r in raster.image_pixels(spark, f"file://{tmp_path}").collect()}
    assert rows == {(0, 0): (0, 255, 255), (1, 0): (60, 255, 255), (2, 0): (120, 255, 255), (0, 1): (0, 0, 255), (1, 1): (0, 0, 0), (2, 1): (15, 255, 255)}


def test_rounds_do_not_end_silently(spark):
    block = cells(spark, *((x, y) for x in range(1, 10) for y in range(1, 10)))
    assert (5, 5) in {(r.x, r.y) for r in raster.skeleton(block, (11, 11)).collect()}
    assert raster.skeleton(cells(spark, *((x, y) for x in range(3) for y in range(3))), (3, 3)).count() == 0
    gaps = spark.createDataFrame([(1, k, k + 1, 10.0 - k) for k in range(9)], "plan_id long, a long, b long, d2 double")
    with pytest.raises(RuntimeError):
        graph.mutual_pairs(gaps, rounds=2)
    assert sorted((r.a, r.b) for r in graph.mutual_pairs(gaps).collect()) == [(k, k + 1) for k in range(0, 9, 2)]


def test_stitching_joins_lines_in_every_orientation(spark):
    """Four ways for two ends to meet, a line joined at both ends, a closed ring, and a gap that is not free."""
    base = [[(0, 0), (10, 0)], [(15, 0), (25, 0)], [(30, 0), (40, 0)]]
    rows, want = [], {}
    for way in range(8):  # each piece forwards or backwards
        plan = way + 1
        for k, line in enumerate(base):
            points = line[::-1] if way >> k & 1 else line
            rows += [(plan, k, s, x, y) for s, (x, y) in enumerate(points)]
        want[plan] = [(x, 0) for x in (0, 10, 15, 25, 30, 40)]
    half = [(0, 0), (0, -10), (20, -10), (20, 10)], [(20, 18), (20, 30), (0, 30), (0, 8)]
    rows += [(20, k, s, x, y) for k, line in enumerate(half) for s, (x, y) in enumerate(line)]
    lines = spark.createDataFrame(rows, "plan_id long, pl_id long, seq int, x long, y long")
    got = {}
    for r in graph.stitched(lines, None, most=9).orderBy("plan_id", "pl_id", "seq").collect():
        got.setdefault((r.plan_id, r.pl_id), []).append((r.x, r.y))
    for plan, points in want.items():
        assert got[plan, 0] in (points, points[::-1]) and (plan, 1) not in got and (plan, 2) not in got
    ring = got[20, 0]
    assert (20, 1) not in got and sorted(ring) == sorted(half[0] + half[1]) and all(abs(a[0] - b[0]) + abs(a[1] - b[1]) in (8, 10, 12, 20, 22) for a, b in zip(ring, ring[1:]))
    free = spark.createDataFrame([(1, x, 0) for x in range(45) if x != 12], "plan_id long, x long, y long")
    one = lines.where("plan_id = 1")
    assert graph.stitched(one, free, most=9, ds=1).select("pl_id").distinct().count() == 2


def test_images_have_numbers_of_their_own(spark):
    from wayfare.operators.raster import numbered_images

    img = spark.createDataFrame([(f"file:/x/{k % 1000}.png", k) for k in range(1500)], "origin string, k int")
    rows = numbered_images(img).collect()
    assert len(rows) == 1500 and sorted({r.plan_id for r in rows}) == list(range(1, 1001)) and len({(r.plan_id, r.origin) for r in rows}) == 1000
