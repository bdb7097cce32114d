"""Undo as a stream: edits in, in any order within the watermark; deletes and restores out, each undo as restores of its batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from wayfare.operators.edits import DEPTH

_EDIT = "ts timestamp, edit_id long, op string, block string, unit string"
_COLUMNS = ["plan_id", "edit_id", "ts", "op", "block", "unit"]
_OUT = "plan_id long, edit_id long, ts timestamp, op string, block string, unit string"


class Undo(StatefulProcessor):
    """The edits of one plan.  State: rows that wait for the watermark; the last ``depth`` delete batches that can be undone, in
    order; and the keys of each of these."""

    def __init__(self, depth: int = DEPTH):
        self.depth = depth

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _EDIT)
        self.stack = handle.getListState("stack", "edit_id long")
        self.keys = handle.getMapState("keys", "edit_id long, k int", "block string, unit string")
        self.sizes = handle.getMapState("sizes", "edit_id long", "n int")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            own = frame[["ts", "edit_id", "op", "block", "unit"]]
            self.waiting.appendList([(pd.Timestamp(t).to_pydatetime(), int(e), op, b, u) for t, e, op, b, u in own.itertuples(index=False)])
            self.handle.registerTimer(int(own["ts"].max().timestamp() * 1000) + 1)
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        rows = list(self.waiting.get())
        due = [r for r in rows if pd.Timestamp(r[0]).timestamp() * 1000 < mark]
        if not due:
            return
        self.waiting.clear()
        late = [r for r in rows if pd.Timestamp(r[0]).timestamp() * 1000 >= mark]
        if late:
            self.waiting.put(late)
        stack = [e for (e,) in self.stack.get()]
        out = []
        for ts, e, op, block, unit in sorted(due, key=lambda r: (r[0], r[1], r[2], r[3] or "", r[4] or "")):
            if op == "delete":
                if not stack or stack[-1] != e:
                    stack.append(e)
                    if len(stack) > self.depth:
                        self._forget(stack.pop(0))
                n = self.sizes.getValue((e,))[0] if self.sizes.containsKey((e,)) else 0
                self.keys.updateValue((e, n), (block, unit))
                self.sizes.updateValue((e,), (n + 1,))
            if op != "undo":
                out.append((*key, e, ts, op, block, unit))
            elif stack:
                batch = stack.pop()
                for k in range(self.sizes.getValue((batch,))[0]):
                    out.append((*key, e, ts, "restore", *self.keys.getValue((batch, k))))
                self._forget(batch)
        self.stack.clear()
        if stack:
            self.stack.put([(e,) for e in stack])
        if out:
            yield pd.DataFrame(out, columns=_COLUMNS)

    def _forget(self, batch: int) -> None:
        for k in range(self.sizes.getValue((batch,))[0]):
            self.keys.removeKey((batch, k))
        self.sizes.removeKey((batch,))

    def close(self) -> None:
        pass


def stream_with_undos(edits: DataFrame, delay: str, depth: int = DEPTH) -> DataFrame:
    """``edits.with_undos`` for a stream of edits (plan_id, edit_id, ts timestamp, op, block, unit); rows that come more than
    ``delay`` late are lost, as the watermark says.

    An edit comes out when the watermark has passed it: nothing that comes later can change its place.  Rows of one batch
    share their edit_id and ts.  The state store must be RocksDB.
    """
    rows = edits.select(*_COLUMNS).withWatermark("ts", delay)
    return rows.groupBy("plan_id").transformWithStateInPandas(statefulProcessor=Undo(depth), outputStructType=_OUT, outputMode="Append", timeMode="EventTime")
