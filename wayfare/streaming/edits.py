"""Edits as a stream: the last operation of each unit, kept in the state store."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wayfare.operators.relational import keyed

_OUT = "plan_id long, kb string, ku string, op string, edit_id long"
_STATE = "ts timestamp, edit_id long, op string"


def _newest(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    best = tuple(state.get) if state.exists else None
    changed = False
    for frame in frames:
        for ts, edit_id, op in zip(frame["ts"], frame["edit_id"], frame["op"]):
            ts = pd.Timestamp(ts).to_pydatetime()
            if best is None or (ts, edit_id) > (best[0], best[1]):
                best, changed = (ts, int(edit_id), op), True
    if changed:
        state.update(best)
        yield pd.DataFrame([(*key, best[2], best[1])], columns=["plan_id", "kb", "ku", "op", "edit_id"])


def stream_last_ops(edits: DataFrame) -> DataFrame:
    """For a stream of edits (plan_id, edit_id, ts timestamp, op, block, unit): an update whenever a unit's last operation changes.

    An edit that comes late does not undo a newer one of its unit.
    """
    rows = keyed(edits.where("op in ('delete', 'restore')")).select("plan_id", "kb", "ku", "ts", "edit_id", "op")
    return rows.groupBy("plan_id", "kb", "ku").applyInPandasWithState(_newest, _OUT, _STATE, "update", GroupStateTimeout.NoTimeout)
