"""Overlays: what is drawn over a plan, as rows; as cells with the colour on top; and as encoded tiles.

draw(plan_id, layer, shape, kind, colour, width, seq, x, y): the points of a shape in order.  ``kind`` is "ring" (closed),
"line" or "disc" (each point by itself, ``width`` its radius); ``width`` of lines is their thickness in cells; a colour is
0xRRGGBB.  Higher layers are on top, and of one layer the shape that is later by name.
"""

from __future__ import annotations

import struct
import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfare.operators.raster import CELL, disc
from wayfare.operators.runs import Extent
from wayfare.operators.spatial import line_cells
from wayfare.plans.scratch import stored

# Colours of layers.
COLOURS = {"unit": 0x00FF00, "block": 0x0000FF, "centre": 0xFF00FF, "line": 0xC800C8, "connector": 0x008000, "exit": 0xFF0000, "route": 0xC800C8, "mask": 0xFFFFFF}
WHITE = 0xFFFFFF
DRAW = "plan_id", "layer", "shape", "kind", "colour", "width", "seq", "x", "y"


def shapes(points: DataFrame, layer: int, shape: Column | str, kind: str, colour: str | int, width: int, seq: str = "seq", x: str = "x", y: str = "y") -> DataFrame:
    """Rows to draw from points (plan_id and the named columns)."""
    shape = F.col(shape) if isinstance(shape, str) else shape
    number = COLOURS[colour] if isinstance(colour, str) else colour
    named = F.lit(layer).alias("layer"), shape.cast("string").alias("shape"), F.lit(kind).alias("kind"), F.lit(number).alias("colour"), F.lit(width).alias("width")
    return points.select("plan_id", *named, F.col(seq).cast("long").alias("seq"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))


def plan_overlay(tables: dict[str, DataFrame]) -> DataFrame:
    """What a rebuild's tables show (see ``plans.rebuild``): rings of units, lines of corridors, connectors, exits, centres and the route."""
    ring = tables["units"].select("plan_id", F.concat_ws("/", "block", "unit").alias("name"), F.posexplode("ring").alias("seq", "p")).select("plan_id", "name", "seq", "p.x", "p.y")
    link = tables["connectors"].select("plan_id", "eid", F.posexplode(F.array(*(F.struct(F.col(f"x{k}").alias("x"), F.col(f"y{k}").alias("y")) for k in (1, 2)))).alias("seq", "p")).select("plan_id", "eid", "seq", "p.x", "p.y")
    usable = tables["exits"].where("ex is not null").withColumn("seq", F.lit(0))
    rows = shapes(ring, 1, "name", "ring", "unit", 2).unionByName(shapes(tables["polylines"], 2, "pl_id", "line", "line", 2))
    rows = rows.unionByName(shapes(link, 3, "eid", "line", "connector", 2)).unionByName(shapes(usable, 4, "uid", "disc", "exit", 3, x="ex", y="ey"))
    rows = rows.unionByName(shapes(tables["units"].withColumn("seq", F.lit(0)), 5, "uid", "disc", "centre", 5, x="cx", y="cy"))
    return rows.unionByName(shapes(tables["line"], 6, F.lit("route"), "line", "route", 3))


def _thick(width: Column) -> Column:
    """The offsets of a square brush of ``width`` cells around a cell."""
    side = F.sequence(-F.floor(width / 2), F.ceil(width / 2) - 1)
    return F.flatten(F.transform(side, lambda dx: F.transform(side, lambda dy: F.struct(dx.alias("dx"), dy.alias("dy")))))


def _round(width: Column) -> Column:
    return F.filter(_thick(2 * width + 1), lambda o: o["dx"] * o["dx"] + o["dy"] * o["dy"] <= width * width)


def painted(draw: DataFrame, extent: Extent) -> DataFrame:
    """(plan_id, x, y, colour): the cells that something is drawn on, with the colour on top.  A line of one point is that point."""
    at = draw.select("plan_id", "layer", "shape", "kind", "colour", "width", "seq", *(F.floor(c).alias(c) for c in "xy"))
    order = Window.partitionBy("plan_id", "layer", "shape").orderBy("seq")
    first = lambda c: F.first(c).over(order)
    onto = lambda c: F.coalesce(F.lead(c).over(order), F.when(F.col("kind") == "ring", first(c)))
    count = F.count("*").over(Window.partitionBy("plan_id", "layer", "shape"))
    steps = at.where("kind <> 'disc'").withColumn("x2", onto("x")).withColumn("y2", onto("y")).withColumn("n", count)
    steps = steps.where("x2 is not null or n = 1")
    cells = F.explode(line_cells(F.col("x"), F.col("y"), F.coalesce("x2", "x"), F.coalesce("y2", "y")))
    # what is on top is told by a number, so that tasks keep a row a cell and no cells are sorted
    own = "plan_id", "layer", "shape", "colour"
    number = F.dense_rank().over(Window.partitionBy("plan_id").orderBy("layer", "shape", "colour"))  # a row a shape
    tops = stored(draw.select(*own).distinct().withColumn("top", number), "tops").alias("t")

    def numbered(rows: DataFrame, *columns: str) -> DataFrame:
        same = reduce(Column.__and__, (F.col(f"r.{c}").eqNullSafe(F.col(f"t.{c}")) for c in own))
        return rows.alias("r").join(tops, same).select("r.plan_id", "t.top", "r.colour", "r.width", *(f"r.{c}" for c in columns))

    def upper(rows: DataFrame, *keys: str) -> DataFrame:
        return rows.groupBy(*CELL, *keys).agg(F.max_by("colour", "top").alias("colour"), F.max("top").alias("top"))

    kept = "plan_id", "top", "colour", "width"
    lines = upper(numbered(steps, "x", "y", "x2", "y2").select(*kept, cells.alias("c")).select(*kept, "c.*"), "width").withColumn("o", F.explode(_thick(F.col("width"))))
    discs = upper(numbered(at.where("kind = 'disc'"), "x", "y"), "width").withColumn("o", F.explode(_round(F.col("width"))))
    moved = lines.unionByName(discs).select("plan_id", (F.col("x") + F.col("o.dx")).alias("x"), (F.col("y") + F.col("o.dy")).alias("y"), "top", "colour")
    inside = moved.where(F.col("x").between(0, extent[0] - 1) & F.col("y").between(0, extent[1] - 1))
    return upper(inside).select(*CELL, "colour")


def mask_mosaic(left: DataFrame, right: DataFrame, width: int, colour: int = COLOURS["mask"]) -> DataFrame:
    """Two masks side by side as painted cells."""
    from wayfare.operators.raster import side_by_side

    return side_by_side(left, right, width).distinct().withColumn("colour", F.lit(colour))


def png(rgb: np.ndarray) -> bytes:
    """An (h, w, 3) array of bytes as a PNG file."""
    h, w, _ = rgb.shape
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    lines = np.concatenate([np.zeros((h, 1), np.uint8), rgb.reshape(h, w * 3)], axis=1)  # a filter byte before each line
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(lines.tobytes())) + part(b"IEND", b"")


def tiles(cells: DataFrame, extent: Extent, size: int = 256, background: int = WHITE) -> DataFrame:
    """(plan_id, tx, ty, png): painted cells as image tiles of ``size`` cells; the last ones of a row or column are cut at the
    extent, and tiles without a cell are left out."""
    width, height = extent

    def encode(table: pa.Table) -> pa.Table:
        plan, tx, ty = (table.column(c)[0].as_py() for c in ("plan_id", "tx", "ty"))
        image = np.full((min(size, height - ty * size), min(size, width - tx * size)), background, np.int64)
        image[table.column("y").to_numpy() - ty * size, table.column("x").to_numpy() - tx * size] = table.column("colour").to_numpy()
        rgb = np.stack([image >> s & 255 for s in (16, 8, 0)], axis=2).astype(np.uint8)
        return pa.table({"plan_id": [plan], "tx": [tx], "ty": [ty], "png": pa.array([png(rgb)], pa.binary())})

    placed = cells.select("plan_id", F.floor(F.col("x") / size).alias("tx"), F.floor(F.col("y") / size).alias("ty"), F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), "colour")
    return placed.groupBy("plan_id", "tx", "ty").applyInArrow(encode, "plan_id long, tx long, ty long, png binary")
