"""The edit log of units: deletes, restores and undos as rows, replayed as tables.

edit(plan_id, edit_id, ts, op, block, unit): rows of one delete batch share their edit_id.  Edits are ordered by
(ts, edit_id).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.operators.relational import keyed

DEPTH = 20  # batches that can be undone


def last_ops(log: DataFrame) -> DataFrame:
    """(plan_id, kb, ku, op): the last delete or restore of each key."""
    rows = keyed(log.where(F.col("op").isin("delete", "restore")))
    return rows.groupBy("plan_id", "kb", "ku").agg(F.max_by("op", F.struct("ts", "edit_id")).alias("op"))


def current_units(units: DataFrame, log: DataFrame) -> DataFrame:
    """Units whose last edit, if any, is not a delete.  A log without rows changes nothing."""
    gone = last_ops(log).where("op = 'delete'")
    return keyed(units).join(gone, ["plan_id", "kb", "ku"], "left_anti").drop("kb", "ku")


def undone(log: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(plan_id, undo_id, edit_id): the delete batch that each undo takes back; it is the newest that is left.

    Of a plan only the newest ``depth`` batches can be undone; an undo without any has no row.  Plans are spread over
    tasks, and a task reads one plan's edits in order and holds ``depth`` numbers.
    """
    steps = log.where(F.col("op").isin("delete", "undo")).select("plan_id", "ts", "edit_id", "op").distinct()
    ordered = steps.repartition("plan_id").sortWithinPartitions("plan_id", "ts", "edit_id", "op").select("plan_id", "edit_id", "op")

    def replay(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plan, stack = None, []
        for frame in frames:
            out = []
            for p, e, op in frame.itertuples(index=False):
                if p != plan:
                    plan, stack = p, []
                if op == "delete":
                    stack = [*stack, e][-depth:]
                elif stack:
                    out.append((p, e, stack.pop()))
            yield pd.DataFrame(out, columns=["plan_id", "undo_id", "edit_id"])

    return ordered.mapInPandas(replay, "plan_id long, undo_id long, edit_id long")


def with_undos(log: DataFrame, depth: int = DEPTH) -> DataFrame:
    """The log with each undo as restores of its batch's keys, at the undo's place."""
    taken = undone(log, depth)
    at = log.where("op = 'undo'").select("plan_id", F.col("edit_id").alias("undo_id"), "ts").distinct()
    batch = log.where("op = 'delete'").drop("ts", "op")
    back = taken.join(batch, ["plan_id", "edit_id"]).join(at, ["plan_id", "undo_id"]).drop("edit_id").withColumnRenamed("undo_id", "edit_id").withColumn("op", F.lit("restore"))
    return log.where("op <> 'undo'").unionByName(back.select(*log.columns))
