"""A closed route over every edge of a plan's graph (Chinese postman).

Spark contracts chains, finds the odd nodes and their shortest paths, and follows those of matched pairs; what is left
for one plan, a matching of its odd nodes by their distances and a walk over its edges, is sequential and runs in one
task for each plan, as small as the graph is after contraction.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfare.operators.graph import degrees, shortest_paths
from wayfare.operators.matching import least_matching
from wayfare.plans.scratch import stored


def match_odd(nodes: list[int], dist: dict[tuple[int, int], float]) -> list[tuple[int, int]]:
    """A perfect matching of least weight, exact at every size; KeyError if there is none."""
    at = {v: k for k, v in enumerate(nodes)}
    weight = np.full((len(nodes), len(nodes)), np.inf)
    for (a, b), d in dist.items():
        weight[at[a], at[b]] = weight[at[b], at[a]] = d
    return [(nodes[k], nodes[m]) for k, m in enumerate(least_matching(weight)) if k < m]


def circuit(edges: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """An Euler circuit of edges (eid, u, v) as steps (eid, from, to), from the least node on; empty if there is none."""
    at: dict[int, list] = {}
    for k, (_, u, v) in enumerate(edges):
        at.setdefault(u, []).append((k, v))
        at.setdefault(v, []).append((k, u))
    if not edges or any(len(x) % 2 for x in at.values()):
        return []
    used, stack, out = set(), [(None, min(at))], []
    for x in at.values():
        x.sort(reverse=True)
    while stack:
        node = stack[-1][1]
        while at[node] and at[node][-1][0] in used:
            at[node].pop()
        if at[node]:
            k, other = at[node].pop()
            used.add(k)
            stack.append((k, other))
        else:
            k, node = stack.pop()
            if k is not None:
                out.append((edges[k][0], stack[-1][1], node))
    out.reverse()
    return out if len(out) == len(edges) else []


def route(edges: DataFrame) -> DataFrame:
    """(plan_id, step, eid, a, b, length, again): the steps of a closed walk over all edges of each plan's (connected) graph.

    ``again`` marks edges that are walked a second time, along shortest paths between matched odd nodes.  A plan
    without edges, or whose graph is not connected, has no rows.
    """
    edges = stored(edges, "edges")
    odd = stored(degrees(edges).where("degree % 2 = 1").select("plan_id", "node"), "odd")
    paths = stored(shortest_paths(edges, odd), "paths")
    between = paths.join(odd, ["plan_id", "node"], "left_semi").where("source < node").select("plan_id", F.col("source").alias("a"), F.col("node").alias("b"), "dist")

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        dist = {(int(a), int(b)): float(d) for a, b, d in zip(pdf.a, pdf.b, pdf.dist)}
        try:
            pairs = match_odd(sorted({x for k in dist for x in k}), dist)
        except KeyError:
            pairs = []
        return pd.DataFrame([(int(pdf.plan_id.iloc[0]), a, b) for a, b in pairs], columns=["plan_id", "a", "b"])

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        via = {int(n): None if pd.isna(v) else int(v) for n, v in zip(pdf.node, pdf.via)}
        a, b, out = int(pdf.a.iloc[0]), int(pdf.b.iloc[0]), []
        while b != a:
            out.append((int(pdf.plan_id.iloc[0]), via[b], b))
            b = via[b]
        return pd.DataFrame(out, columns=["plan_id", "a", "b"])

    pairs = stored(between.groupBy("plan_id").applyInPandas(match, "plan_id long, a long, b long"), "pairs")
    links = paths.withColumnRenamed("source", "a").join(pairs, ["plan_id", "a"]).select("plan_id", "a", "b", "node", "via")
    links = links.groupBy("plan_id", "a").applyInPandas(follow, "plan_id long, a long, b long")
    both = edges.select("plan_id", F.col("u").alias("a"), F.col("v").alias("b"), "eid", "length").union(edges.select("plan_id", "v", "u", "eid", "length"))
    cheapest = both.groupBy("plan_id", "a", "b").agg(F.min(F.struct(F.col("length").cast("double").alias("length"), "eid")).alias("e"))
    again = links.join(cheapest, ["plan_id", "a", "b"]).select("plan_id", F.lit(1).alias("kind"), "a", "b", "e.eid", "e.length")
    rows = edges.select("plan_id", F.lit(0).alias("kind"), F.col("u").alias("a"), F.col("v").alias("b"), "eid", F.col("length").cast("double")).unionByName(again)

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        # without a matching there are odd nodes, and no circuit
        own = sorted((int(k), int(e), int(a), int(b), float(w)) for k, a, b, e, w in zip(pdf.kind, pdf.a, pdf.b, pdf.eid, pdf.length))
        lengths = {e: w for k, e, _, _, w in own if not k}
        out, seen = [], set()
        for k, (e, a, b) in enumerate(circuit([x[1:4] for x in own])):
            out.append((int(pdf.plan_id.iloc[0]), k, e, a, b, lengths[e], e in seen))
            seen.add(e)
        return pd.DataFrame(out, columns=["plan_id", "step", "eid", "a", "b", "length", "again"])

    return rows.groupBy("plan_id").applyInPandas(walk, "plan_id long, step long, eid long, a long, b long, length double, again boolean")


def route_lines(steps: DataFrame, nodes: DataFrame, points: DataFrame | None = None) -> DataFrame:
    """The route's points in order: plan_id, seq, x, y; straight from node to node, or along ``points``.

    ``points`` (plan_id, chain, rank, x, y) are those of the contracted edges, from their lesser end on; a step from the
    other end takes them backwards.  A step's first point is left out where it is the last one of the step before.
    """
    if points is None:
        first = steps.where("step = 0").select("plan_id", F.lit(0).cast("long").alias("seq"), F.col("a").alias("id"))
        rest = steps.select("plan_id", (F.col("step") + 1).alias("seq"), F.col("b").alias("id"))
        return first.unionByName(rest).join(nodes.select("id", "x", "y"), "id").select("plan_id", "seq", "x", "y")
    along = steps.select("plan_id", "step", F.col("eid").alias("chain"), (F.col("a") > F.col("b")).alias("back")).join(points, ["plan_id", "chain"])
    along = along.withColumn("k", F.when(F.col("back"), -F.col("rank")).otherwise(F.col("rank")))
    walk = Window.partitionBy("plan_id").orderBy("step", "k")  # a route is one walk by nature
    last = F.struct(F.lag("x").over(walk).alias("x"), F.lag("y").over(walk).alias("y"))
    again = (F.lag("step").over(walk) < F.col("step")) & (last == F.struct("x", "y"))
    kept = along.withColumn("again", F.coalesce(again, F.lit(False))).where("not again")
    return kept.select("plan_id", (F.row_number().over(walk) - 1).cast("long").alias("seq"), "x", "y")


def simplified(lines: DataFrame, eps: float) -> DataFrame:
    """Lines (plan_id, pl_id, points) by Douglas and Peucker: ends stay, and no point is farther than ``eps`` from the result.

    Lines of fewer than three points, and all with ``eps`` 0, stay as they are.
    """
    if eps <= 0:
        return lines
    kind = lines.schema["points"].dataType

    def kept(p: np.ndarray) -> list[int]:
        keep, stack = [0, len(p) - 1], [(0, len(p) - 1)]
        while stack:
            a, b = stack.pop()
            if b - a < 2:
                continue
            way, own = p[b] - p[a], p[a + 1 : b] - p[a]
            size = way @ way
            t = np.clip(own @ way / size, 0, 1) if size else np.zeros(len(own))
            d = ((t[:, None] * way - own) ** 2).sum(1)
            at = int(d.argmax())
            if d[at] > eps * eps:
                keep.append(a + 1 + at)
                stack += [(a, a + 1 + at), (a + 1 + at, b)]
        return sorted(keep)

    @F.arrow_udf(kind)
    def simple(points: pa.Array) -> pa.Array:
        # points stay in Arrow's columns: a line's places are picked, no point becomes an object
        size, flat = points.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), points.flatten()
        place = np.stack([pc.struct_field(flat, c).to_numpy(zero_copy_only=False).astype(float) for c in "xy"], 1)
        begin = np.cumsum(size) - size
        some = [np.arange(a, a + n) if n < 3 else a + np.array(kept(place[a : a + n])) for a, n in zip(begin, size)]
        ends = np.concatenate([[0], np.cumsum([len(k) for k in some])]).astype(np.int32)
        picked = flat.take(pa.array(np.concatenate(some) if some else np.zeros(0), pa.int64()))
        return pa.ListArray.from_arrays(pa.array(ends), picked, mask=points.is_null())

    return lines.withColumn("points", simple("points"))
