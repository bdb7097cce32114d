"""From units and text boxes to a route: the whole chain of operators, each stage a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.functions import geom as g
from wayfare.operators import graph, raster, relational, route, spatial
from wayfare.plans.scratch import stored
from wayfare.sources.io import bundle


def rebuild(
    units: DataFrame,
    boxes: DataFrame | None = None,
    version: int = 1,
    downscale: int = 3,
    clearance: int = 8,
    near_px: int = 200,
    exit_radius: int = 12,
    min_comp_area: int = 800,
    close_px: int = 4,
    bridge_px: int = 8,
    stitch_dist: float = 18.0,
    stitch_angle: float = 30.0,
    stitch_rounds: int = 4,
    simplify_eps: float = 1.2,
    snap: float = 12.0,
    prune_spurs: float = 0.0,
    connect: str = "shortest",
    candidates: int = 1000,
    style: str = "straight",
) -> dict[str, DataFrame]:
    """The stages' tables by name, from ``units`` (plan_id, block, unit, uid, ring) and text ``boxes``.

    ``connect``: "shortest" joins the network's components by straight edges, "none" keeps the largest alone.  An exit's
    connector is the first free one of its ``candidates`` nearest points.  ``style``: the route's line runs along the
    corridors' lines ("geom") or straight from node to node ("straight").  Plans without free space have units and
    exits, but no lines and no route.
    """
    c = g.centroid("ring")
    named = relational.match_text(units, boxes) if boxes is not None else units.withColumn("best_text", F.lit(""))
    named = stored(named.withColumn("cx", g.cents(c["cx"])).withColumn("cy", g.cents(c["cy"])), "units")
    exits = stored(spatial.exit_points(named), "exits")
    points = named.select("plan_id", F.explode("ring").alias("p")).select("plan_id", F.col("p.x").cast("double").alias("x"), F.col("p.y").cast("double").alias("y"))
    tips = exits.where("is_corridor").select("plan_id", F.col("ex").alias("x"), F.col("ey").alias("y"))
    size = relational.canvas_extent(points, tips).agg(F.max("width"), F.max("height")).first()
    extent = (size[0] or 1, size[1] or 1)
    small = (extent[0] // downscale, extent[1] // downscale)
    free = raster.free_mask(named, exits, extent, downscale, clearance, near_px, exit_radius, min_comp_area)
    free = stored(raster.closed(free, raster.ellipse(max(1, round(close_px / downscale))), small), "free")
    thin = stored(raster.skeleton(free, small), "skeleton")
    thin = stored(raster.bridged(thin, max(1, round(bridge_px / downscale)) if bridge_px > 0 else 0, small), "bridged")
    cells = thin.withColumn("id", raster.cell_id())
    centre = stored(raster.skeleton_points(thin, downscale), "centre")
    connectors = spatial.connect_exits(exits.withColumnRenamed("uid", "eid"), centre, free, downscale, candidates)
    chain = graph.ordered_chains(graph.cell_neighbours(cells))
    dots = chain.join(centre.withColumnRenamed("tid", "node"), ["plan_id", "node"]).select("plan_id", F.col("chain").alias("pl_id"), F.col("rank").alias("seq"), "x", "y")
    joined = stored(graph.stitched(dots, free, stitch_dist, stitch_angle, downscale, stitch_rounds), "stitched")
    lines = joined.withColumnRenamed("seq", "rank").groupBy("plan_id", "pl_id")
    lines = lines.agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("points"))
    simple = route.simplified(lines, simplify_eps)
    vertices = stored(simple.select("plan_id", "pl_id", F.posexplode("points").alias("seq", "p")).select("plan_id", "pl_id", "seq", "p.x", "p.y"), "polylines")
    nodes, edges = (stored(t, "graph") for t in graph.graph_from_polylines(vertices, snap))
    if prune_spurs > 0:
        edges = graph.prune_spurs(edges, prune_spurs)
    if connect == "none":
        edges = stored(graph.largest_component(nodes, edges), "largest")
    else:
        new = graph.bridges(nodes, edges).withColumn("eid", -F.col("u") - 1)  # a component's only bridge begins at a node of its own
        at = lambda k: nodes.select(F.col("id").alias("u" if k == 1 else "v"), F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}"))
        new = new.join(at(1), "u").join(at(2), "v")
        edges = stored(edges.unionByName(new.select(*edges.columns)), "joined")
    lean = graph.contract(edges).select("plan_id", "eid", "u", "v", "length")
    steps = stored(route.route(lean), "route")
    line = route.route_lines(steps, nodes, graph.chain_points(edges) if style == "geom" else None)
    whole = bundle(named, exits.join(named.select("plan_id", "uid", "block", "unit"), ["plan_id", "uid"]), vertices, line, version)
    return {"units": named, "exits": exits, "free": free, "centreline": centre, "connectors": connectors, "polylines": vertices, "nodes": nodes, "edges": edges, "route": steps, "line": line, "bundle": whole}
