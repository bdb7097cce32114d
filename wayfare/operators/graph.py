"""Operators on undirected multigraphs: edges(plan_id, eid, u, v, length), nodes(plan_id, id, x, y).

Node and edge numbers are unique over all plans.  Parallel edges and self-loops are kept.  Iterative operators write
each round to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfare.functions import geom as g
from wayfare.operators.components import FEW, blocks_of, components, near
from wayfare.operators.spatial import cell_of, clusters
from wayfare.operators.tiles import tiled
from wayfare.plans.scratch import stored


def ends(edges: DataFrame) -> DataFrame:
    """Two rows an edge, one for each end: plan_id, eid, node, other, length."""
    two = F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("other")), F.struct(F.col("v").alias("node"), F.col("u").alias("other"))))
    return edges.select("plan_id", "eid", "length", two.alias("e")).select("plan_id", "eid", "length", "e.*")


def degrees(edges: DataFrame) -> DataFrame:
    """(plan_id, node, degree); a self-loop counts twice."""
    return ends(edges).groupBy("plan_id", "node").agg(F.count("*").alias("degree"))


def edges_of_lines(vertices: DataFrame) -> DataFrame:
    """Neighbouring points of lines (plan_id, pl_id, seq, x, y) as segments: x1, y1, x2, y2."""
    w = Window.partitionBy("plan_id", "pl_id").orderBy("seq")
    rows = vertices.select("plan_id", "pl_id", "seq", F.col("x").alias("x1"), F.col("y").alias("y1"), F.lead("x").over(w).alias("x2"), F.lead("y").over(w).alias("y2"))
    return rows.where("x2 is not null")


def line_lengths(vertices: DataFrame) -> DataFrame:
    """(plan_id, pl_id, n_points, length); 0 for lines of one point."""
    steps = edges_of_lines(vertices).groupBy("plan_id", "pl_id").agg(F.sum(F.hypot((F.col("x2") - F.col("x1")).cast("double"), (F.col("y2") - F.col("y1")).cast("double"))).alias("length"))
    n = vertices.groupBy("plan_id", "pl_id").agg(F.count("*").alias("n_points"))
    return n.join(steps, ["plan_id", "pl_id"], "left").withColumn("length", F.coalesce("length", F.lit(0.0)))


def graph_from_polylines(vertices: DataFrame, snap: float = 12.0) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of lines: ends of their segments within ``snap`` (in steps) are one node, at the mean of them all.

    An edge's length is that of its segment (x1, y1, x2, y2) before snapping.  Segments and their ends are numbered by
    line and place.
    """
    segs = edges_of_lines(vertices)
    size = segs.groupBy("plan_id", "pl_id").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("plan_id").orderBy("pl_id").rowsBetween(Window.unboundedPreceding, -1))  # a row a line
    place = F.row_number().over(Window.partitionBy("plan_id", "pl_id").orderBy("seq"))
    segs = segs.withColumn("place", place).join(size.select("plan_id", "pl_id", F.coalesce(before, F.lit(0)).alias("before")), ["plan_id", "pl_id"])
    segs = segs.withColumn("eid", F.col("plan_id") * (1 << 40) + F.col("before") + F.col("place")).drop("before", "place")
    two = F.array(F.struct(F.lit(0).alias("side"), F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.lit(1).alias("side"), F.col("x2").alias("x"), F.col("y2").alias("y")))
    segs = stored(segs, "segments")
    tips = segs.select("plan_id", "eid", F.explode(two).alias("t")).select("plan_id", "eid", "t.*", (F.col("eid") * 2 + F.col("t.side")).alias("pid"))
    found = stored(clusters(tips, snap, block=near()), "tips")
    nodes = found.groupBy("plan_id", F.col("cluster").alias("id")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    pairs = found.groupBy("plan_id", "eid").agg(F.max(F.when(F.col("side") == 0, F.col("cluster"))).alias("u"), F.max(F.when(F.col("side") == 1, F.col("cluster"))).alias("v"))
    length = F.hypot((F.col("x2") - F.col("x1")).cast("double"), (F.col("y2") - F.col("y1")).cast("double"))
    return nodes, pairs.join(segs.select("eid", length.alias("length"), "x1", "y1", "x2", "y2"), "eid").select("plan_id", "eid", "u", "v", "length", "x1", "y1", "x2", "y2")


def prune_spurs(edges: DataFrame, least: float, rounds: int = 3) -> DataFrame:
    """``edges`` without those at a node of degree 1 that are not longer than ``least``, repeated ``rounds`` times."""
    for _ in range(rounds):
        tips = degrees(edges).where("degree = 1").select("plan_id", "node")
        spurs = ends(edges).where(F.col("length") <= least).join(tips, ["plan_id", "node"], "left_semi").select("eid").distinct()
        edges = stored(edges.join(spurs, "eid", "left_anti"), "pruned")
    return edges


def joints(edges: DataFrame) -> DataFrame:
    """Nodes where two edges meet that are no self-loops: node, p < q.

    An edge's end is twice its number, plus 1 where it is ``v``: also the number of the direction of the edge that leaves there.
    """
    two = F.explode(F.array(F.struct(F.col("u").alias("node"), (F.col("eid") * 2).alias("k")), F.struct(F.col("v").alias("node"), (F.col("eid") * 2 + 1).alias("k"))))
    tips = edges.select((F.col("u") == F.col("v")).alias("loop"), two.alias("e")).select("e.*", "loop")
    met = tips.groupBy("node").agg(F.count("*").alias("n"), F.min("k").alias("p"), F.max("k").alias("q"), F.max("loop").alias("loop"))
    return met.where("n = 2 and not loop").select("node", "p", "q")


def chains(edges: DataFrame, met: DataFrame | None = None) -> DataFrame:
    """``edges`` with ``chain``: edges that meet in nodes of degree 2 (not self-loops) are one chain, named by its least edge.  ``met``: their joints, if known."""
    meets = (joints(edges) if met is None else met).select(F.shiftright("p", 1).alias("u"), F.shiftright("q", 1).alias("v"))
    return edges.join(components(meets, block=near()).withColumnRenamed("id", "eid"), "eid", "left").withColumn("chain", F.coalesce("component", "eid")).drop("component")


def contract(edges: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """Chains as single edges: plan_id, eid (the chain), u <= v, length (sum), n_edges.

    A chain that closes at a node of another degree, or on itself, is a self-loop there, or at its least node.  ``rows``:
    the edges with their chains, if they are known.
    """
    rows = stored(chains(edges), "chains") if rows is None else rows
    tips = ends(rows.select("plan_id", F.col("chain").alias("eid"), "u", "v", "length")).groupBy("plan_id", "eid", "node").agg(F.count("*").alias("n"))
    whole = degrees(edges).withColumnRenamed("degree", "all")
    tips = tips.join(whole, ["plan_id", "node"]).withColumn("open", (F.col("n") % 2 == 1) | (F.col("all") != F.col("n")))
    found = tips.groupBy("plan_id", "eid").agg(F.min("node").alias("least"), F.min(F.when(F.col("open") | (F.col("all") > 2), F.col("node"))).alias("a"), F.max(F.when(F.col("open") | (F.col("all") > 2), F.col("node"))).alias("b"))
    sums = rows.groupBy("plan_id", F.col("chain").alias("eid")).agg(F.sum("length").alias("length"), F.count("*").alias("n_edges"))
    return sums.join(found, ["plan_id", "eid"]).select("plan_id", "eid", F.coalesce("a", "least").alias("u"), F.coalesce("b", "least").alias("v"), "length", "n_edges")


def doubled(back: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(head, rank) of each place in lists given by what is before it (a head: itself)."""
    rank = (back != np.arange(len(back))).astype(np.int64)
    for _ in range(64):
        if (back[back] == back).all():
            return back, rank
        rank, back = rank + rank[back], back[back]
    raise RuntimeError("a list is closed")


def ranked(ids: np.ndarray, following: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, head, rank) of lists by pointer doubling; see ``ranked_chains``."""
    every, at = np.unique(np.concatenate([ids, following]), return_inverse=True)
    back = np.arange(len(every))
    back[at[len(ids) :]] = at[: len(ids)]
    head, rank = doubled(back)
    return every, every[head], rank


def _ranked_at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    some = [b for b in batches if b.num_rows]
    if some:
        rows = pa.Table.from_batches(some)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in ranked(rows.column("id").to_numpy(), rows.column("next").to_numpy())], ["id", "head", "rank"])


def _ranked_block(rows: pa.Table) -> pa.Table:
    """The nodes of a block with the head of what it has of their list, and their rank there; ``next`` where it goes on in another block."""
    ids, following, own, onto = (rows.column(c).to_numpy() for c in ("id", "next", "own_a", "own_b"))
    alone = np.concatenate([ids[own & ~onto], following[onto & ~own]])  # what follows a node of another block is a head here
    inner = own & onto
    every, at = np.unique(np.concatenate([alone, ids[inner], following[inner]]), return_inverse=True)
    back = np.arange(len(every))
    first, then = at[len(alone) :].reshape(2, -1)
    back[then] = first
    head, rank = doubled(back)
    out = np.full(len(every), -1)
    out[at[: np.count_nonzero(own & ~onto)]] = following[own & ~onto]
    goes_on = out != -1
    goes_on[at[: np.count_nonzero(own & ~onto)]] = True
    return pa.table([every, every[head], rank, pa.array(out, mask=~goes_on)], ["id", "part", "k", "next"])


def ranked_chains(links: DataFrame, bits: int = 14) -> DataFrame:
    """(id, head, rank) for lists given as links (id, next), where heads have no link to them: place in the list, from 0.

    At most FEW links are doubled by one task.  Of more, blocks of near numbers are ranked by one task each, which leaves
    a link for each part of a list, and so on with larger blocks.  If that is no less, pointers are doubled in rounds: log2(n) for a list of n.  Closed
    lists must be cut at one link before.
    """
    links = stored(links.select("id", "next"), "links")
    size = links.count()
    if size <= FEW:
        return links.coalesce(1).mapInArrow(_ranked_at_once, "id long, head long, rank long")
    parts = stored(blocks_of(links, "id", "next", near(bits)).groupBy("block").applyInArrow(_ranked_block, "id long, part long, k long, next long"), "parts")
    onward = parts.where("next is not null").select(F.col("part").alias("id"), "next", (F.col("k") + 1).alias("n"))
    rest = onward.count()
    order = _ranked_in_rounds(onward) if 2 * rest > size else ranked_chains(onward, min(bits + 6, 20))
    order = order.withColumnsRenamed({"id": "part"}).join(onward.select(F.col("id").alias("part"), "n"), "part", "left")
    before = F.sum("n").over(Window.partitionBy("head").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1))
    placed = order.select("part", "head", F.coalesce(before, F.lit(0)).alias("before"))
    return parts.join(placed, "part", "left").select("id", F.coalesce("head", "part").alias("head"), (F.col("k") + F.coalesce("before", F.lit(0))).alias("rank"))


def _ranked_in_rounds(links: DataFrame) -> DataFrame:
    back = links.select(F.col("next").alias("id"), F.col("id").alias("prev"))
    every = links.select("id").union(links.select("next")).distinct()
    now = stored(every.join(back, "id", "left").select("id", F.col("prev").alias("at"), F.when(F.col("prev").isNull(), 0).otherwise(1).cast("long").alias("rank"), F.coalesce("prev", "id").alias("head")), "ranks")
    while not now.where("at is not null").isEmpty():
        up = now.select(F.col("id").alias("at"), F.col("at").alias("at2"), F.col("rank").alias("rank2"), F.col("head").alias("head2"))
        now = stored(now.join(up, "at", "left").select("id", F.col("at2").alias("at"), (F.col("rank") + F.coalesce("rank2", F.lit(0))).alias("rank"), F.coalesce("head2", "head").alias("head")), "ranks")
    return now.select("id", "head", "rank")


def connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes`` with ``component``: its least node."""
    comps = components(edges, block=near())
    return nodes.join(comps, "id", "left").withColumn("component", F.coalesce("component", "id"))


def largest(rows: DataFrame, by: str = "component") -> DataFrame:
    """The rows of each plan's component with most of them (ties: the least)."""
    size = rows.groupBy("plan_id", by).agg(F.count("*").alias("n"))
    best = size.groupBy("plan_id").agg(F.min(F.struct((-F.col("n")).alias("n"), by)).alias("b")).select(F.col(f"b.{by}").alias(by))
    return rows.join(best, by, "left_semi")


def largest_component(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges of each plan's component with most nodes (ties: the least node)."""
    kept = largest(stored(connected(nodes, edges), "components")).select(F.col("id").alias("u"))
    return edges.join(kept, "u", "left_semi").select(*edges.columns)


def bridges(nodes: DataFrame, edges: DataFrame, cell: float = 50.0) -> DataFrame:
    """``bridges_between`` the components of a graph."""
    return bridges_between(connected(nodes, edges), cell)


def bridges_between(rows: DataFrame, cell: float = 50.0) -> DataFrame:
    """One straight edge (plan_id, u, v, length) for each component but a plan's first: the shortest to any component before it.

    ``rows``: nodes (plan_id, id, x, y) with their component.

    Components are in the order of their least nodes; ties go to the least (v, u).  The search radius doubles for
    components that have found nothing within it.
    """
    rows = stored(rows, "components")
    order = F.dense_rank().over(Window.partitionBy("plan_id").orderBy("component"))
    names = rows.select("plan_id", "component").distinct().withColumn("place", order)
    rows = stored(rows.join(names, ["plan_id", "component"]), "placed")
    left, out, radius = stored(names.where("place > 1").select("plan_id", "place"), "left"), None, float(cell)
    span = (rows.select(F.max(F.greatest(F.abs("x"), F.abs("y")))).first()[0] or 0) * 4 + 1
    old = rows.select("plan_id", F.col("id").alias("v"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("place").alias("before"))
    while not left.isEmpty():
        q = rows.join(left, ["plan_id", "place"], "left_semi")
        q = q.withColumn("gx", F.explode(F.sequence(cell_of("x", radius) - 1, cell_of("x", radius) + 1))).withColumn("gy", F.explode(F.sequence(cell_of("y", radius) - 1, cell_of("y", radius) + 1)))
        joined = q.join(old.withColumn("gx", cell_of("ox", radius)).withColumn("gy", cell_of("oy", radius)), ["plan_id", "gx", "gy"]).where("before < place")
        dx, dy = (F.col("x") - F.col("ox")).cast("double"), (F.col("y") - F.col("oy")).cast("double")
        d = F.sqrt(dx * dx + dy * dy)
        best = joined.groupBy("plan_id", "place").agg(F.min(F.struct(d.alias("length"), "v", F.col("id").alias("u"))).alias("b")).select("plan_id", "place", "b.v", "b.u", "b.length")
        if radius < span:
            best = best.where(F.col("length") <= radius)
        best = stored(best, "bridges")
        out = best if out is None else out.unionByName(best)
        left = stored(left.join(best, ["plan_id", "place"], "left_anti"), "left")
        radius *= 2
    if out is None:
        return rows.select("plan_id", F.col("id").alias("u"), F.col("id").alias("v"), F.lit(0.0).alias("length")).where("false")
    return out.select("plan_id", "u", "v", "length")


def _walk(source: int, first: list[int], other: list[int], length: list[float]) -> tuple[list[int], list[float], list[int]]:
    """Nodes that a source reaches, nearest first, their distances and the nodes before them (-1: none)."""
    best, via, done = {source: 0.0}, {source: -1}, []
    heap, settled = [(0.0, source)], set()
    while heap:
        d, u = heappop(heap)
        if u in settled:
            continue
        settled.add(u)
        done.append(u)
        for k in range(first[u], first[u + 1]):
            v, new = other[k], d + length[k]
            old = best.get(v)
            if old is None or new < old:
                best[v], via[v] = new, u
                heappush(heap, (new, v))
            elif new == old and v not in settled and u < via[v]:
                via[v] = u
    return done, [best[u] for u in done], [via[u] for u in done]


def _paths_at_once(steps: DataFrame, sources: DataFrame) -> DataFrame:
    """``shortest_paths`` of a graph small enough to be sent whole: at most FEW steps of 24 bytes."""
    rows = steps.select("node", "other", "length").orderBy("node", "other").toArrow()
    nodes, at = np.unique(np.concatenate([rows.column(c).to_numpy() for c in ("node", "other")]), return_inverse=True)
    first = np.searchsorted(at[: rows.num_rows], np.arange(len(nodes) + 1))
    graph = steps.sparkSession.sparkContext.broadcast((nodes, first, at[rows.num_rows :], rows.column("length").to_numpy()))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, *parts = graph.value
        first, other, length = (p.tolist() for p in parts)
        for batch in batches:
            for plan, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                k = int(np.searchsorted(nodes, source))
                there = k < len(nodes) and nodes[k] == source
                done, dist, via = _walk(k, first, other, length) if there else ([0], [0.0], [-1])
                v = np.array(via)
                cols = pa.array(np.full(len(done), plan)), pa.array(np.full(len(done), source)), pa.array(nodes[done] if there else np.array([source])), pa.array(dist)
                before = pa.array(nodes[np.maximum(v, 0)] if there else v, mask=v < 0)
                yield pa.RecordBatch.from_arrays([*cols, before], ["plan_id", "source", "node", "dist", "via"])

    own = sources.select("plan_id", F.col("node").cast("long").alias("node")).where("node is not null").distinct()
    parts = max(own.sparkSession.sparkContext.defaultParallelism, 1)
    return own.repartition(parts, "node").mapInArrow(task, "plan_id long, source long, node long, dist double, via long")


#: Plans with no more pairs of a source and a step than this are walked by one task each.
PATHS = 1 << 20


def _paths_by_plan(steps: DataFrame, sources: DataFrame) -> DataFrame:
    """``shortest_paths`` of plans with at most PATHS pairs of a source and a step: a plan's steps and sources meet in one task."""

    def walk(steps: pa.Table, sources: pa.Table) -> pa.Table:
        own = np.unique(sources.column("node").to_numpy())
        rows = steps.sort_by([("node", "ascending"), ("other", "ascending")])
        node, other = rows.column("node").to_numpy(), rows.column("other").to_numpy()
        nodes, at = np.unique(np.concatenate([node, other, own]), return_inverse=True)
        first = np.searchsorted(at[: len(node)], np.arange(len(nodes) + 1)).tolist()
        onto, length = at[len(node) : 2 * len(node)].tolist(), rows.column("length").to_pylist()
        found = [_walk(k, first, onto, length) for k in at[2 * len(node) :].tolist()]
        size = [len(done) for done, _, _ in found]
        done, dist, via = (np.array([v for f in found for v in f[k]], kind) for k, kind in ((0, np.int64), (1, float), (2, np.int64)))
        plan = pa.array(np.full(len(done), (sources if len(own) else steps).column("plan_id")[0].as_py()), pa.int64())
        cols = plan, pa.array(np.repeat(own, size), pa.int64()), pa.array(nodes[done], pa.int64()), pa.array(dist), pa.array(nodes[np.maximum(via, 0)], pa.int64(), mask=via < 0)
        return pa.table(list(cols), ["plan_id", "source", "node", "dist", "via"])

    both = (t.select(F.col("plan_id").cast("long").alias("plan_id"), *c).groupBy("plan_id") for t, c in ((steps, (F.col("node").cast("long").alias("node"), F.col("other").cast("long").alias("other"), "length")), (sources, ("node",))))
    return next(both).cogroup(next(both)).applyInArrow(walk, "plan_id long, source long, node long, dist double, via long")


def shortest_paths(edges: DataFrame, sources: DataFrame, most: int = 10_000) -> DataFrame:
    """(plan_id, source, node, dist, via): the least length from each source to all nodes that it reaches, and the node before.

    Each round extends only what the last one improved.  Parallel edges count by the shortest; ties by the least node.
    A graph of at most FEW steps goes to all tasks, which walk it from their own sources without rounds; of a larger one only
    plans with more than PATHS pairs of a source and a step take rounds.
    """
    steps = ends(edges).where("node <> other").groupBy("plan_id", "node", "other").agg(F.min("length").cast("double").alias("length"))
    steps = stored(steps, "steps")
    if steps.count() <= FEW:
        return _paths_at_once(steps, sources)
    own = stored(sources.select("plan_id", F.col("node").cast("long").alias("node")).where("node is not null").distinct(), "sources")
    size = steps.groupBy("plan_id").agg(F.count("*").alias("n")).join(own.groupBy("plan_id").agg(F.count("*").alias("k")), "plan_id")
    crowded = stored(size.where(F.col("n") * F.col("k") > PATHS).select("plan_id"), "crowded")
    small = _paths_by_plan(*(t.join(crowded, "plan_id", "left_anti") for t in (steps, own)))
    if crowded.isEmpty():
        return small
    return small.unionByName(_paths_in_rounds(*(t.join(crowded, "plan_id", "left_semi") for t in (steps, own)), most))


def _paths_in_rounds(steps: DataFrame, sources: DataFrame, most: int) -> DataFrame:
    steps = stored(steps, "steps")
    best = stored(sources.select("plan_id", F.col("node").alias("source"), "node", F.lit(0).cast("double").alias("dist"), F.lit(None).cast("long").alias("via")).distinct(), "paths")
    front, key = best, ["plan_id", "source", "node"]
    for _ in range(most):
        if front.isEmpty():
            return best
        tried = front.join(steps, ["plan_id", "node"]).select("plan_id", "source", F.col("other").alias("node"), (F.col("dist") + F.col("length")).alias("dist"), F.col("node").alias("via"))
        every = best.withColumn("new", F.lit(False)).unionByName(tried.withColumn("new", F.lit(True)))
        now = every.groupBy(*key).agg(F.min(F.struct("dist", "new", "via")).alias("b"))
        now = stored(now.select(*key, "b.*"), "paths")
        best, front = now.drop("new"), now.where("new").drop("new")
    raise RuntimeError(f"paths of more than {most} edges")


def cell_neighbours(cells: DataFrame) -> DataFrame:
    """Edges between neighbouring cells (plan_id, id, x, y), diagonals too, each once: plan_id, eid, u, v, length."""
    ahead = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((1, 0), (-1, 1), (0, 1), (1, 1))))
    seen = cells.select("plan_id", F.col("id").alias("u"), "x", "y", F.posexplode(ahead).alias("k", "o")).select("plan_id", "u", "k", (F.col("x") + F.col("o.dx")).alias("x"), (F.col("y") + F.col("o.dy")).alias("y"))
    joined = seen.join(cells.select("plan_id", F.col("id").alias("v"), "x", "y"), ["plan_id", "x", "y"])
    return joined.select("plan_id", (F.col("u") * 4 + F.col("k")).alias("eid"), "u", "v", F.when(F.col("k").isin(0, 2), 1.0).otherwise(2**0.5).alias("length"))


def cell_polylines(cells: DataFrame) -> DataFrame:
    """Lines through cells: one for each chain of neighbour links between cells with other than two neighbours.

    (plan_id, chain, n_links, length, closed): every link is in one line; cells without neighbours are in none.
    """
    links = stored(cell_neighbours(cells), "links")
    lines = contract(links)
    return lines.select("plan_id", F.col("eid").alias("chain"), F.col("n_edges").alias("n_links"), "length", (F.col("u") == F.col("v")).alias("closed"))


def ordered_edges(edges: DataFrame) -> DataFrame:
    """The edges of each chain in order: plan_id, chain, rank, eid, a, b, d (1: the edge is walked from v to u).

    Chains begin at their lesser end; closed ones at it too.  Each edge is taken in both directions; a direction goes on
    with the other edge at a joint, where no ring begins.  Both directions of a chain are lists, ranked by pointer doubling,
    of which the one from the lesser end is kept; only numbers of directions are sent until then.
    """
    met = stored(joints(edges), "joints")
    rows = stored(chains(edges, met).select("plan_id", "chain", "eid", "u", "v", "length"), "chains")
    whole = stored(contract(edges, rows).select(F.col("eid").alias("chain"), F.col("u").alias("tip"), F.col("v").alias("tail")), "whole")
    on = met.join(whole.where("tip = tail").select(F.col("tip").alias("node")), "node", "left_anti")
    both = F.array(*(F.struct(F.col(a).bitwiseXOR(1).alias("id"), F.col(b).alias("next")) for a, b in ("pq", "qp")))
    ranks = ranked_chains(on.select(F.explode(both).alias("l")).select("l.*"))
    leaves = F.least(*(F.when(F.col(c) == F.col("tip"), F.col("eid") * 2 + d) for d, c in enumerate("uv")))
    first = stored(rows.join(whole.select("chain", "tip"), "chain").groupBy("chain").agg(F.min(leaves).alias("head")).select("head"), "heads")
    kept = first.select(F.col("head").alias("id"), F.lit(0).cast("long").alias("rank")).unionByName(ranks.where("rank > 0").join(first, "head", "left_semi").select("id", "rank"))
    placed = rows.join(kept.select(F.shiftright("id", 1).alias("eid"), F.col("id").bitwiseAND(1).cast("int").alias("d"), "rank"), "eid")
    end = lambda d, c: F.when(F.col("d") == d, F.col("u")).otherwise(F.col("v")).alias(c)
    return stored(placed.select("plan_id", "chain", "rank", "eid", end(0, "a"), end(1, "b"), "d"), "ordered")


def _nodes_in_order(order: DataFrame) -> DataFrame:
    start = order.where("rank = 0").select("plan_id", "chain", F.lit(0).cast("long").alias("rank"), F.col("a").alias("node"))
    return start.unionByName(order.select("plan_id", "chain", (F.col("rank") + 1).alias("rank"), F.col("b").alias("node")))


def ordered_chains(edges: DataFrame) -> DataFrame:
    """The nodes of each chain in order: plan_id, chain, rank, node.  Chains begin at their lesser end; closed ones at it too."""
    return _nodes_in_order(ordered_edges(edges))


def chain_points(edges: DataFrame) -> DataFrame:
    """The points of each chain's segments in order: plan_id, chain, rank, x, y; ``edges`` with x1, y1, x2, y2 as from lines.

    A chain's first segment gives both its ends, the others their second.
    """
    order = ordered_edges(edges).join(edges.select("eid", "x1", "y1", "x2", "y2"), "eid")
    end = lambda k: F.struct(*(F.when(F.col("d") == k - 1, F.col(f"{c}1")).otherwise(F.col(f"{c}2")).alias(c) for c in "xy"))
    first = order.where("rank = 0").select("plan_id", "chain", F.lit(0).cast("long").alias("rank"), end(1).alias("p"))
    return first.unionByName(order.select("plan_id", "chain", (F.col("rank") + 1).alias("rank"), end(2).alias("p"))).select("plan_id", "chain", "rank", "p.*")


def _outlined(key: tuple, rows: pa.Table, bits: int) -> pa.Table:
    """The sides of a tile's cells with their places in what the tile has of their outlines; see ``contours``.

    A tile comes with the cells around it, so it knows what follows each side, also where that is another tile's.
    """
    plan, left, top = (int(k.as_py()) for k in key)
    left, top, wide = (left << bits) - 1, (top << bits) - 1, (1 << bits) + 2
    on = np.zeros((wide, wide), bool)
    on[rows.column("y").to_numpy() - top, rows.column("x").to_numpy() - left] = True
    own = np.zeros_like(on)
    own[1:-1, 1:-1] = on[1:-1, 1:-1]
    # a side of direction d, from (ax, ay) to (bx, by), lies between a cell and the one at (dx, dy) of it
    found = []
    for d, (dx, dy, ax, ay, bx, by) in enumerate(((0, -1, 0, 0, 1, 0), (1, 0, 1, 0, 1, 1), (0, 1, 1, 1, 0, 1), (-1, 0, 0, 1, 0, 0))):
        y, x = np.nonzero(own & ~np.roll(on, (-dy, -dx), (0, 1)))
        found.append(np.stack([y, x, y + dy, x + dx, y + ay, x + ax, y + by, x + bx, np.full(len(y), d)]))
    y, x, ny, nx, ay, ax, by, bx, d = np.concatenate(found, 1)
    number = lambda y, x, d: (plan << 44) + ((y + top) << 23) + ((x + left) << 2) + d
    ids = number(ay, ax, d)
    order = np.argsort(ids)
    ids, y, x, ny, nx, ay, ax, by, bx, d = (c[order] for c in (ids, y, x, ny, nx, ay, ax, by, bx, d))
    # a side of direction e begins at a corner if its cell is on, and the one across is off
    cell, across = ((0, 0), (0, -1), (-1, -1), (-1, 0)), ((-1, 0), (0, 0), (0, -1), (-1, -1))
    following = np.full(len(ids), -1)
    for turn in (2, 1, 0, -1):  # the last that is there stands: the one to the left keeps cells that meet by a corner together
        e = (d + turn) % 4
        (cy, cx), (oy, ox) = (np.array(c)[e].T for c in (cell, across))
        there = on[by + cy, bx + cx] & ~on[by + oy, bx + ox]
        following[there] = number(by, bx, e)[there]
    at = np.minimum(np.searchsorted(ids, following), max(len(ids) - 1, 0))
    inner = ids[at] == following
    every = np.arange(len(ids))
    back = every.copy()
    back[at[inner]] = every[inner]
    # what is closed within the tile is cut at its least side
    least, jump = every, back
    while True:
        new = np.minimum(least, least[jump])
        if (new == least).all():
            break
        least, jump = new, jump[jump]
    cut = (least[back] == every) & (back != every)
    back[cut] = every[cut]
    head, rank = doubled(back)
    goes_on = ~inner
    low = np.full(len(ids), len(ids))
    np.minimum.at(low, head, every)
    columns = [np.full(len(ids), plan), ids, ids[head], rank, cut[head], ax + left, ay + top, x + left, y + top, nx + left, ny + top]
    onward = [pa.array(v, pa.int64(), mask=~goes_on) for v in (following, ids[low[head]] if len(ids) else low, rank[low[head]] if len(ids) else low)]
    return pa.table([*columns, *onward], ["plan_id", "id", "part", "k", "closed", "x", "y", "cell_x", "cell_y", "out_x", "out_y", "next", "least", "k0"])


def contours(mask: DataFrame, bits: int = 9) -> DataFrame:
    """The outlines of a mask as closed lines of cell corners: plan_id, contour, rank, x, y, the cells inside (cell_x, cell_y) and
    outside (out_x, out_y) of the side from there on, hole.

    Sides between a cell of the mask and one outside it are directed with the mask on their right; at a corner where
    two outlines touch, cells that meet by a corner stay together.  Outlines are lists of sides, cut at their least
    side (least y, then x).  Tiles of 2^``bits`` cells on each side are outlined by one task each; outlines that leave a tile have a part for each
    stay in one, and the parts are lists that are ranked in turn.  Holes run the other way around.
    """
    rows = tiled(mask.select("plan_id", "x", "y"), 1, bits)
    place = "x long, y long, cell_x long, cell_y long, out_x long, out_y long"
    sides = stored(rows.applyInArrow(lambda key, t: _outlined(key, t, bits), f"plan_id long, id long, part long, k long, closed boolean, {place}, next long, least long, k0 long"), "sides")
    parts = stored(sides.where("next is not null").select(F.col("part").alias("id"), "next", "least", "k0", (F.col("k") + 1).alias("n")), "parts")
    loops = stored(parts.join(components(parts, "id", "next").withColumnRenamed("component", "loop"), "id"), "loops")
    whole = loops.groupBy("loop").agg(F.sum("n").alias("total"), F.min(F.struct("least", "id", "k0")).alias("f")).select("loop", "total", F.col("f.least").alias("contour"), F.col("f.id").alias("start"), F.col("f.k0").alias("skip"))
    whole = stored(whole, "whole")
    links = parts.join(whole.select(F.col("start").alias("next")), "next", "left_anti").select("id", "next")
    order = loops.join(whole, "loop").join(ranked_chains(links).select("id", "rank"), "id", "left").withColumn("rank", F.coalesce("rank", F.lit(0)))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("loop").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    order = order.select(F.col("id").alias("part"), "contour", (before - F.col("skip")).alias("before"), "total")
    columns = ["x", "y", "cell_x", "cell_y", "out_x", "out_y", (F.col("contour").bitwiseAND(3) != 0).alias("hole")]
    inside = sides.where("closed").withColumn("contour", F.col("part")).select("plan_id", "contour", F.col("k").alias("rank"), *columns)
    return inside.unionByName(sides.where("not closed").join(order, "part").select("plan_id", "contour", F.pmod(F.col("before") + F.col("k"), "total").alias("rank"), *columns))


def contour_sizes(mask: DataFrame) -> DataFrame:
    """A row for each outline: plan_id, contour, hole, n_sides, and one of the cells inside that it runs along (x, y)."""
    found = contours(mask).groupBy("plan_id", "contour", "hole").agg(F.count("*").alias("n_sides"), F.min(F.struct("cell_y", "cell_x")).alias("c"))
    return found.select("plan_id", "contour", "hole", "n_sides", F.col("c.cell_x").alias("x"), F.col("c.cell_y").alias("y"))


def line_tips(vertices: DataFrame) -> DataFrame:
    """Both ends of lines of two or more points: plan_id, pl_id, tid, x, y, and (dx, dy), the line's direction there.

    ``tid`` is twice the line's number (plan_id * 2^32 + its place among the plan's lines), plus 1 at its last point.
    """
    at = lambda order, k: F.get(F.slice(order, 1, 2), F.lit(k))
    points = F.array_sort(F.collect_list(F.struct("seq", "x", "y")))
    lines = vertices.groupBy("plan_id", "pl_id").agg(points.alias("p")).where("size(p) > 1")
    number = F.row_number().over(Window.partitionBy("plan_id").orderBy("pl_id"))  # a row a line
    ends = lines.select("plan_id", "pl_id", at(F.col("p"), 0).alias("p0"), at(F.col("p"), 1).alias("p1"), F.get("p", F.size("p") - 2).alias("q1"), F.get("p", F.size("p") - 1).alias("q0"))
    ends = ends.withColumn("line", F.col("plan_id") * (1 << 32) + number)
    tip = lambda w, here, a, b: F.struct((F.col("line") * 2 + w).alias("tid"), here["x"].alias("x"), here["y"].alias("y"), (b["x"] - a["x"]).alias("dx"), (b["y"] - a["y"]).alias("dy"))
    c = F.col
    both = F.array(tip(0, c("p0"), c("p0"), c("p1")), tip(1, c("q0"), c("q1"), c("q0")))
    return ends.select("plan_id", "pl_id", F.explode(both).alias("t")).select("plan_id", "pl_id", "t.*")


def stitched(vertices: DataFrame, free: DataFrame | None, most: float = 18.0, angle: float = 30.0, ds: int = 3, rounds: int = 4) -> DataFrame:
    """Lines (plan_id, pl_id, seq, x, y) with ends joined that ``stitch_pairs`` allows, nearest pairs first, in up to ``rounds`` rounds.

    A round may join a line at both of its ends.  Joined lines are chains of tips, by their own edges and those between
    joined tips, which are ordered by list ranking; a line that is walked from its last point comes reversed.  A new
    line is named by its first line's least pl_id; rings begin at their least tip.  Points are numbered from 0.
    """
    for _ in range(rounds):
        vertices = stored(vertices.select("plan_id", "pl_id", "seq", "x", "y"), "lines")
        tips = stored(line_tips(vertices), "tips")
        pairs = stored(mutual_pairs(stitch_pairs(tips, free, most, angle, ds)), "joins")
        if pairs.isEmpty():
            break
        line = F.floor(F.col("tid") / 2).cast("long")
        names = stored(tips.where("tid % 2 = 0").select("plan_id", "pl_id", line.alias("line")), "names")
        met = pairs.select(F.explode(F.array("a", "b")).alias("tid")).select(line.alias("line")).distinct()
        own = names.join(met, "line", "left_semi").select("plan_id", (F.col("line") * 4).alias("eid"), (F.col("line") * 2).alias("u"), (F.col("line") * 2 + 1).alias("v"), F.lit(1.0).alias("length"))
        joins = pairs.select("plan_id", (F.col("a") * 2 + 1).alias("eid"), F.col("a").alias("u"), F.col("b").alias("v"), F.lit(1.0).alias("length"))
        order = ordered_edges(own.unionByName(joins)).where("eid % 4 = 0")
        order = order.select("plan_id", F.floor(F.col("chain") / 4).cast("long").alias("chain"), "rank", F.floor(F.col("eid") / 4).cast("long").alias("line"), "d")
        size = vertices.groupBy("plan_id", "pl_id").agg(F.count("*").alias("n"))
        order = order.join(names, ["plan_id", "line"]).join(size, ["plan_id", "pl_id"])
        before = F.coalesce(F.sum("n").over(Window.partitionBy("plan_id", "chain").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        named = order.withColumn("before", before).join(names.select("plan_id", F.col("line").alias("chain"), F.col("pl_id").alias("name")), ["plan_id", "chain"])
        dense = vertices.withColumn("k", F.row_number().over(Window.partitionBy("plan_id", "pl_id").orderBy("seq")) - 1)
        placed = dense.join(named.select("plan_id", "pl_id", "name", "before", "n", "d"), ["plan_id", "pl_id"], "left")
        seq = F.coalesce("before", F.lit(0)) + F.when(F.col("d") == 1, F.col("n") - 1 - F.col("k")).otherwise(F.col("k"))
        vertices = placed.select("plan_id", F.coalesce("name", "pl_id").alias("pl_id"), seq.cast("long").alias("seq"), "x", "y")
    return vertices


def stitch_pairs(tips: DataFrame, free: DataFrame | None, most: float = 18.0, angle: float = 30.0, ds: int = 3) -> DataFrame:
    """Pairs of line ends that may be joined: of different lines, near, both lines pointing along the gap, the gap free.

    ``tips``: plan_id, tid, pl_id, x, y, and (dx, dy), the line's direction at that end.  Result: plan_id, a, b, d2.
    """
    from wayfare.operators.spatial import radius_pairs, segments_free

    pairs = radius_pairs(tips, most, "tid")
    cols = ("pl_id", "x", "y", "dx", "dy")
    for side in ("a", "b"):
        pairs = pairs.join(tips.select(F.col("tid").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in cols)), side)
    gx, gy = F.col("x_b") - F.col("x_a"), F.col("y_b") - F.col("y_a")

    def along(side: str) -> Column:
        a = g.angle_between(F.col(f"dx_{side}"), F.col(f"dy_{side}"), gx, gy)
        return F.least(a, 180 - a) <= angle

    pairs = pairs.where("pl_id_a <> pl_id_b").where(along("a") & along("b"))
    if free is not None:
        lines = pairs.select("*", F.concat_ws("-", "a", "b").alias("sid"), F.col("x_a").alias("x1"), F.col("y_a").alias("y1"), F.col("x_b").alias("x2"), F.col("y_b").alias("y2"))
        pairs = segments_free(lines, free, ds).where("is_free")
    return pairs.select("plan_id", "a", "b", "d2")


def mutual_pairs(pairs: DataFrame, rounds: int | None = None) -> DataFrame:
    """A greedy matching of weighted pairs (plan_id, a, b, d2): nearest first, then least (a, b), each end once.

    In a round every pair that is the first of both its ends is taken; that gives what taking them one by one would.
    Rounds go on until no pair is left; more than ``rounds``, if given, are an error.
    """
    left, out, done = stored(pairs, "pairs"), None, 0
    while not left.isEmpty():
        if rounds is not None and done == rounds:
            raise RuntimeError(f"pairs did not settle in {rounds} rounds")
        key = F.struct("d2", "a", "b")
        both = left.select("plan_id", "a", "b", "d2", F.explode(F.array("a", "b")).alias("end"))
        best = both.groupBy("end").agg(F.min(key).alias("k"))
        taken = best.groupBy("k").agg(F.count("*").alias("n")).where("n = 2").select("k.*")
        taken = stored(left.join(taken.select("a", "b"), ["a", "b"], "left_semi"), "taken")
        used = taken.select(F.explode(F.array("a", "b")).alias("end"))
        out = taken if out is None else out.unionByName(taken)
        done += 1
        if done % 50 == 0:
            out = stored(out, "taken")  # the plan stays small
        left = stored(left.join(used.withColumnRenamed("end", "a"), "a", "left_anti").join(used.withColumnRenamed("end", "b"), "b", "left_anti"), "pairs")
    return pairs.where("false") if out is None else out
