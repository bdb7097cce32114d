"""Readers and writers of plan files: text boxes, units, exits, lines, tables of corners and centres, and the bundle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTS = "array<array<double>>"
CORNER = "Block string, Type string, Unit string, Corner int, X int, Y int"
CENTER = "Block string, Unit string, CX int, CY int"


def _points(c: str):
    """Arrays [x, y] as structs."""
    return F.transform(c, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))


def read_boxes(spark: SparkSession, path: str, plan_id: int = 1) -> DataFrame:
    """Text boxes of either dialect: text or description, bbox or bounds.  An empty text falls back too."""
    raw = spark.read.schema(f"text string, description string, bbox {POINTS}, bounds {POINTS}").json(path, multiLine=True)
    text = F.coalesce(F.nullif("text", F.lit("")), "description", F.lit(""))
    box = F.coalesce(_points("bbox"), _points("bounds"))
    return raw.select(F.lit(plan_id).cast("long").alias("plan_id"), F.monotonically_increasing_id().alias("box_id"), text.alias("text"), box.alias("bbox"))


def read_units(spark: SparkSession, path: str, plan_id: int = 1) -> DataFrame:
    """Units with their ring (points or polygon_points; a repeated first point is dropped), texts and centroid."""
    fields = f"block string, unit string, points {POINTS}, polygon_points {POINTS}, matched_texts array<string>, all_possible_texts array<string>, best_text string, centroid array<double>"
    raw = spark.read.schema(fields).json(path, multiLine=True).withColumn("ring", F.coalesce(_points("points"), _points("polygon_points")))
    whole = (F.size("ring") > 1) & (F.element_at("ring", 1) == F.element_at("ring", -1))
    ring = F.when(whole, F.slice("ring", 1, F.size("ring") - 1)).otherwise(F.col("ring"))
    return raw.select(F.lit(plan_id).cast("long").alias("plan_id"), "block", "unit", ring.alias("ring"), "matched_texts", "all_possible_texts", "best_text", F.get("centroid", F.lit(0)).alias("cx"), F.get("centroid", F.lit(1)).alias("cy"))


def read_exits(spark: SparkSession, path: str, plan_id: int = 1) -> DataFrame:
    raw = spark.read.schema("block string, unit string, centroid array<double>, exit_point array<double>, is_corridor boolean, best_text string").json(path, multiLine=True)
    at = lambda c, k: F.get(c, F.lit(k))
    return raw.select(F.lit(plan_id).cast("long").alias("plan_id"), "block", "unit", at("centroid", 0).alias("cx"), at("centroid", 1).alias("cy"), at("exit_point", 0).alias("ex"), at("exit_point", 1).alias("ey"), "is_corridor", "best_text")


def read_polylines(spark: SparkSession, path: str, plan_id: int = 1) -> DataFrame:
    """Lines of an object with ``polylines``, or of a bare array, as vertices (plan_id, pl_id, seq, x, y)."""
    text = spark.read.text(path, wholetext=True)
    lines = F.coalesce(F.from_json("value", "polylines array<array<array<double>>>")["polylines"], F.from_json("value", "array<array<array<double>>>"))
    rows = text.select(F.posexplode(lines).alias("pl_id", "line")).select("pl_id", F.posexplode("line").alias("seq", "p"))
    return rows.select(F.lit(plan_id).cast("long").alias("plan_id"), F.col("pl_id").cast("long").alias("pl_id"), "seq", F.get("p", F.lit(0)).alias("x"), F.get("p", F.lit(1)).alias("y"))


def read_corners(spark: SparkSession, path: str, plan_id: int = 1) -> DataFrame:
    raw = spark.read.schema(CORNER).csv(path, header=True)
    return raw.select(F.lit(plan_id).cast("long").alias("plan_id"), F.col("Block").alias("block"), F.col("Type").alias("typ"), F.coalesce("Unit", F.lit("")).alias("unit"), F.col("Corner").alias("corner"), F.col("X").alias("x"), F.col("Y").alias("y"))


def read_centers(spark: SparkSession, path: str, plan_id: int = 1) -> DataFrame:
    raw = spark.read.schema(CENTER).csv(path, header=True)
    return raw.select(F.lit(plan_id).cast("long").alias("plan_id"), F.col("Block").alias("block"), F.col("Unit").alias("unit"), F.col("CX").alias("cx"), F.col("CY").alias("cy"))


def write_csv(df: DataFrame, path: str) -> None:
    """Always replaces what is there, also by an empty table."""
    df.write.mode("overwrite").csv(path, header=True)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def bundle(units: DataFrame, exits: DataFrame, polylines: DataFrame, route: DataFrame, version: int) -> DataFrame:
    """(plan_id, bundle): one JSON document a plan with projectVersion, units, exits, polylines and route.

    A plan is one document by its format; its lists are gathered for each plan by itself.
    """
    point = lambda x, y: F.array(F.col(x).cast("double"), F.col(y).cast("double"))
    ring = F.transform("ring", lambda p: F.array(p["x"].cast("double"), p["y"].cast("double")))
    u = units.groupBy("plan_id").agg(F.sort_array(F.collect_list(F.struct("block", "unit", ring.alias("points")))).alias("units"))
    e = exits.groupBy("plan_id").agg(F.sort_array(F.collect_list(F.struct("block", "unit", F.when(F.col("ex").isNotNull(), point("ex", "ey")).alias("exit_point"), "is_corridor"))).alias("exits"))
    lines = polylines.groupBy("plan_id", "pl_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", point("x", "y").alias("p")))), lambda v: v["p"]).alias("line"))
    p = lines.groupBy("plan_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pl_id", "line"))), lambda v: v["line"]).alias("polylines"))
    r = route.groupBy("plan_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", point("x", "y").alias("p")))), lambda v: v["p"]).alias("line"))
    joined = u.join(e, "plan_id", "left").join(p, "plan_id", "left").join(r, "plan_id", "left")
    document = F.struct(F.lit(version).alias("projectVersion"), "units", "exits", "polylines", F.struct("line").alias("route"))
    return joined.select("plan_id", F.to_json(document, {"ignoreNullFields": "false"}).alias("bundle"))


def file_stats(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, modified) of the files under a path."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
