"""Projects: edits, undo, rebuilds with edits meanwhile, single flight; and undo as a stream."""

import threading
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wayfare.operators import edits
from wayfare.plans.project import Project
from wayfare.sources import shared

UNIT = "plan_id long, block string, unit string, uid long"


@pytest.fixture
def project(spark, tmp_path):
    p = Project(spark, f"file://{tmp_path}/project")
    rows = [(1, "B", f"U{k}", k) for k in range(6)] + [(2, "B", f"U{k}", 10 + k) for k in range(3)]
    assert p.version() == 0 and p.status()["running"] is False
    assert p.create(spark.createDataFrame(rows, UNIT)) == 1
    with pytest.raises(ValueError):
        p.create(spark.createDataFrame(rows, UNIT))
    return p


def _keys(spark, *keys):
    return spark.createDataFrame(list(keys), "plan_id long, block string, unit string")


def _uids(df):
    return sorted(r.uid for r in df.collect())


def test_edits_and_undo(spark, project):
    assert project.delete(_keys(spark, (1, " B", "U1\t"), (1, "B", "U2"), (2, "B", "U9"))) == 2
    assert project.delete(_keys(spark, (1, "B", "U3"), (2, "B", "U0"))) == 2
    assert project.delete(_keys(spark, (1, "B", "U3"))) == 0 and project.version() == 3
    assert _uids(project.units()) == [0, 4, 5, 11, 12] and _uids(project.units(1)) == [0, 1, 2, 3, 4, 5, 10, 11, 12]
    whole = spark.createDataFrame([(1, "B", "U2", 77), (1, "B", "U2", 78), (1, "B", "U4", 79), (1, " ", "U8", 80), (1, "C", "new", 81)], UNIT)
    assert project.restore(whole) == 2
    after = _uids(project.units())
    assert after in ([0, 4, 5, 11, 12, 77, 81], [0, 4, 5, 11, 12, 78, 81])
    assert project.undo(1) == 1 and 3 in _uids(project.units()) and 10 not in _uids(project.units())
    assert project.undo(1) == 1 and 1 in _uids(project.units()) and 2 not in _uids(project.units())  # U2 is there again already
    assert project.undo(1) == 0 and project.undo(2) == 1 and 10 in _uids(project.units())


def test_an_edit_during_a_rebuild_is_not_lost(spark, project):
    project.delete(_keys(spark, (1, "B", "U0")))

    def areas(tables):
        assert project.rebuild({}) == 0  # one at a time
        assert project.status()["running"] and project.status()["stage"] == "areas"
        project.delete(_keys(spark, (1, "B", "U1"), (2, "B", "U1")))
        project.undo(2)
        return tables["units"].select("plan_id", "uid")

    run = project.rebuild({"areas": areas, "count": lambda t: t["areas"].groupBy("plan_id").count()})
    assert run == 1 and _uids(project.table("areas")) == [1, 2, 3, 4, 5, 10, 11, 12]
    assert _uids(project.units()) == [2, 3, 4, 5, 10, 11, 12]  # the edits after the snapshot count
    assert project.status() | {"startedAt": 0, "finishedAt": 0} == {"running": False, "stage": "done", "lastError": None, "startedAt": 0, "finishedAt": 0, "projectVersion": project.version(), "files": {"areas": 8, "count": 2, "units": 7}}
    assert project.undo(2) == 0 and project.undo(1) == 1 and _uids(project.units())[0] == 1  # undone before; and what the rebuild did not see
    rows = project.stages().orderBy("seconds").collect()
    assert {(r.run, r.stage, r.n_rows) for r in rows} == {(1, "areas", 8), (1, "count", 2)} and all(r.seconds > 0 for r in rows)


def test_one_of_two_rebuilds_runs(spark, project):
    started, gate = [], threading.Barrier(2)

    def stage(tables):
        return tables["units"]

    def go():
        gate.wait()
        started.append(project.rebuild({"same": stage}))

    threads = [threading.Thread(target=go) for _ in range(2)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(started) in ([0, 1], [1, 2])  # the second may have come after the first had ended
    assert project.stages().where("run = 1").count() == 1


def test_an_error_ends_a_run_and_silence_frees_the_next(spark, project):
    def bad(tables):
        raise KeyError("no such table")

    with pytest.raises(KeyError):
        project.rebuild({"bad": bad})
    state = project.status()
    assert state["stage"] == "error" and "no such table" in state["lastError"] and not state["running"]
    assert project.units().count() == 9 and project.rebuild({}) == 2
    with pytest.raises(ValueError):
        project.table("bad")
    # a driver that died: its claim has no end
    assert shared.create_once(spark, project._run_file(3, "claim"), '{"ts": 0}') and not project._alive(3)
    assert not shared.create_once(spark, project._run_file(3, "claim"), '{"ts": 1}')
    assert project.rebuild({}) == 4


def test_undo_as_a_stream(spark, tmp_path):
    """Equal to the batch form, with rows that come late but within the watermark, and batches deeper than the stack."""
    from wayfare.streaming.undo import stream_with_undos

    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    start, rows = datetime(2024, 1, 1), []
    ops = {1: "ddudduuurdu", 2: "udrduu", 3: "ddddduuuuu"}
    for plan, text in ops.items():
        for k, op in enumerate(text):
            op = {"d": "delete", "u": "undo", "r": "restore"}[op]
            for unit in (f"U{k}", f"V{k % 3}") if op != "undo" else (None,):
                rows.append((plan, plan * 100 + k, start + timedelta(seconds=10 * k + plan), op, "B" if unit else None, unit))
    schema = "plan_id long, edit_id long, ts timestamp, op string, block string, unit string"
    # each file has its neighbours' rows too, out of order; the last one ends the time
    order = sorted(rows, key=lambda r: (r[2] + timedelta(seconds=(r[1] * 7) % 40)))
    files = [order[k : k + 12] for k in range(0, len(order), 12)] + [[(9, 1, start + timedelta(days=d), "noop", "B", "U")] for d in (1, 2)]
    for k, part in enumerate(files):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k:03d}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    try:
        q = stream_with_undos(stream, "60 seconds", depth=3).writeStream.format("memory").queryName("undone").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
        q.processAllAvailable()
        q.stop()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    got = sorted(tuple(r) for r in spark.table("undone").where("plan_id < 9").select("plan_id", "edit_id", "ts", "op", "block", "unit").collect())
    want = sorted(tuple(r) for r in edits.with_undos(spark.createDataFrame(rows, schema), 3).select("plan_id", "edit_id", "ts", "op", "block", "unit").collect())
    assert got == want and any(r[3] == "restore" for r in got)
    assert spark.table("undone").where(F.col("op") == "undo").isEmpty()
