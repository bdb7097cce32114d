"""A project: units that are edited while routes are rebuilt from them, by any number of drivers, in a shared folder.

Everything is in numbered commits: small files, each claimed once (``sources.shared``), that name a table.

* An edit commit has the rows of a delete, a restore or an undo.  The units of any commit are those of the last base
  commit with the later edits replayed by key; nothing is changed in place.
* A rebuild takes the units as of a commit, an immutable snapshot, runs its stages on it, and commits them as a new base
  that is ``upto`` that commit.  Edits made meanwhile have higher numbers, and are replayed on the new base: none is lost.
* One rebuild runs at a time.  A run is a claimed number too; the next can be claimed only when the last has ended, or has
  shown no sign of life for ``ttl`` seconds.  A run's stages, with rows and seconds, are a table; its jobs have a tag.

A call that finds its commit number taken reads the project again and repeats.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from wayfare.operators import edits
from wayfare.operators.relational import keyed
from wayfare.plans import rebuild as chain
from wayfare.sources import shared

Stages = dict[str, Callable[[dict[str, DataFrame]], DataFrame]]
RUNS = "run long, stage string, n_rows long, seconds double, path string"


def route_stages(**options) -> Stages:
    """The stages of a rebuild: exits, polylines and route, from the units.  The chain is built once, by the first stage."""
    made: dict[str, DataFrame] = {}

    def first(tables: dict[str, DataFrame]) -> DataFrame:
        made.update(chain.rebuild(tables["units"], **options))
        return made["exits"]

    return {"exits": first, "polylines": lambda _: made["polylines"], "route": lambda _: made["line"]}


class Project:
    """Units (plan_id, block, unit, and more columns) in a folder that all drivers share."""

    def __init__(self, spark: SparkSession, folder: str, ttl: float = 600.0):
        self.spark, self.folder, self.ttl = spark, folder.rstrip("/"), ttl

    # -- commits ---------------------------------------------------------------------------------------------------

    def _path(self, kind: str) -> str:
        return f"{self.folder}/{kind}/{uuid.uuid4().hex}"

    def _commit(self, number: int, **fields) -> bool:
        return shared.create_once(self.spark, f"{self.folder}/commits/{number:012d}.json", json.dumps(fields | {"ts": time.time()}))

    def _commits(self) -> list[int]:
        return [int(n[:12]) for n in shared.names(self.spark, f"{self.folder}/commits") if n.endswith(".json") and n[:12].isdigit() and len(n) == 17]

    def _read(self, number: int) -> dict:
        return json.loads(shared.read_text(self.spark, f"{self.folder}/commits/{number:012d}.json"))

    def version(self) -> int:
        """The number of the last commit; 0 for a new project."""
        return max(self._commits(), default=0)

    def create(self, units: DataFrame) -> int:
        """The first commit: the units as they are."""
        path = self._path("units")
        units.write.parquet(path)
        if not self._commit(1, kind="base", path=path, upto=0):
            raise ValueError("the project is there already")
        return 1

    def _log(self, at: int, since: int) -> DataFrame | None:
        """The rows of the edits in ``since < number <= at``."""
        log = None
        for number in self._commits():
            entry = self._read(number) if since < number <= at else {}
            if entry.get("kind") == "edit":
                rows = self.spark.read.parquet(entry["path"]).withColumn("edit_id", F.lit(number).cast("long"))
                log = rows if log is None else log.unionByName(rows)
        return log

    def units(self, at: int | None = None) -> DataFrame:
        """The units as of a commit (the last one, if none is named)."""
        at = self.version() if at is None else at
        base = next((e for e in map(self._read, reversed([n for n in self._commits() if n <= at])) if e["kind"] == "base"), None)
        if base is None:
            raise ValueError(f"no units at commit {at}")
        rows, log = self.spark.read.parquet(base["path"]), self._log(at, base["upto"])
        if log is None:
            return rows
        last = keyed(log).groupBy("plan_id", "kb", "ku").agg(F.max_by(F.struct("op", "payload"), "edit_id").alias("e"))
        kept = keyed(rows).join(last, ["plan_id", "kb", "ku"], "left_anti").select(*rows.columns)
        back = last.where("e.op <> 'delete'").select("e.payload.*")
        return kept.unionByName(back.select(*rows.columns))

    # -- edits -----------------------------------------------------------------------------------------------------

    def _edit(self, make: Callable[[int, DataFrame], DataFrame | None]) -> int:
        """Commit the rows that ``make`` gives for the project as it is; how many, 0 if none.  Repeats if another commit came first."""
        while True:
            at = self.version()
            rows = make(at, self.units(at))
            if rows is None:
                return 0
            path, seen = self._path("edits"), Observation()
            rows.observe(seen, F.count("*").alias("n")).write.parquet(path)
            if not seen.get["n"]:
                return 0
            if self._commit(at + 1, kind="edit", path=path):
                return seen.get["n"]

    @staticmethod
    def _rows(op: str, units: DataFrame) -> DataFrame:
        return units.select("plan_id", "block", "unit", F.lit(op).alias("op"), F.struct(*units.columns).alias("payload"))

    def delete(self, keys: DataFrame) -> int:
        """Delete the units with these keys (plan_id, block, unit; blanks around them do not count): how many there were."""
        wanted = keyed(keys).select("plan_id", "kb", "ku").distinct()
        return self._edit(lambda _, units: self._rows("delete", keyed(units).join(wanted, ["plan_id", "kb", "ku"], "left_semi").select(*units.columns)))

    def restore(self, batch: DataFrame) -> int:
        """Insert whole units; those with a blank key or one that is there are skipped, and of one key the first counts."""

        def rows(_: int, units: DataFrame) -> DataFrame:
            new = keyed(batch.select(*units.columns)).where("kb <> '' and ku <> ''").join(keyed(units).select("plan_id", "kb", "ku"), ["plan_id", "kb", "ku"], "left_anti")
            first = F.row_number().over(Window.partitionBy("plan_id", "kb", "ku").orderBy("block", "unit", F.xxhash64(*units.columns)))
            return self._rows("restore", new.withColumn("first", first).where("first = 1").select(*units.columns))

        return self._edit(rows)

    def undo(self, plan_id: int) -> int:
        """Take back a plan's newest delete that has not been taken back, of its last ``edits.DEPTH``: how many units come back."""

        def rows(at: int, units: DataFrame) -> DataFrame | None:
            log = self._log(at, 0)
            if log is None:
                return None
            steps = log.where((F.col("plan_id") == plan_id) & F.col("op").isin("delete", "undo")).select("plan_id", "edit_id", "op", F.col("edit_id").alias("ts"))
            ask = self.spark.range(1).select(F.lit(plan_id).cast("long").alias("plan_id"), F.lit(at + 1).cast("long").alias("edit_id"), F.lit("undo").alias("op"), F.lit(at + 1).cast("long").alias("ts"))
            taken = edits.undone(steps.unionByName(ask)).where(F.col("undo_id") == at + 1).select("plan_id", "edit_id")
            batch = log.where("op = 'delete'").join(taken, ["plan_id", "edit_id"], "left_semi")
            there = keyed(units).select("plan_id", "kb", "ku")
            return keyed(batch).join(there, ["plan_id", "kb", "ku"], "left_anti").select("plan_id", "block", "unit", F.lit("undo").alias("op"), "payload")

        return self._edit(rows)

    # -- rebuilds --------------------------------------------------------------------------------------------------

    def _run_file(self, run: int, kind: str) -> str:
        return f"{self.folder}/runs/{run:012d}.{kind}"

    def _last_run(self) -> int:
        return max((int(n[:12]) for n in shared.names(self.spark, f"{self.folder}/runs") if n.endswith(".claim")), default=0)

    def _alive(self, run: int) -> bool:
        """Whether a run goes on: it has not ended, and its last sign of life is not older than ``ttl``."""
        if not run or shared.read_text(self.spark, self._run_file(run, "end")) is not None:
            return False
        sign = shared.read_text(self.spark, self._run_file(run, "beat")) or shared.read_text(self.spark, self._run_file(run, "claim"))
        return time.time() - json.loads(sign)["ts"] < self.ttl

    def rebuild(self, stages: Stages | None = None) -> int:
        """Run all stages on the units as they are now, and commit them as the base of later edits: the number of the run.

        0 if another run goes on: nothing is done then.  A stage gets the tables of those before it, and "units"; an error
        ends the run, and is in its status.
        """
        last = self._last_run()
        if self._alive(last) or not shared.create_once(self.spark, self._run_file(last + 1, "claim"), json.dumps({"ts": time.time()})):
            return 0
        run, context = last + 1, self.spark.sparkContext
        tag = f"rebuild-{run}-{uuid.uuid4().hex[:8]}"
        context.addJobTag(tag)
        error = None
        try:
            at = self.version()
            snapshot = self._path("units")
            self.units(at).write.parquet(snapshot)
            tables = {"units": self.spark.read.parquet(snapshot)}
            for stage, make in (route_stages() if stages is None else stages).items():
                shared.replace(self.spark, self._run_file(run, "beat"), json.dumps({"ts": time.time(), "stage": stage, "tag": tag}))
                began, path, seen = time.time(), self._path(stage), Observation()
                make(tables).observe(seen, F.count("*").alias("n")).write.parquet(path)
                tables[stage] = self.spark.read.parquet(path)
                row = [(run, stage, seen.get["n"], time.time() - began, path)]
                self.spark.createDataFrame(row, RUNS).coalesce(1).write.mode("append").parquet(f"{self.folder}/stages")
            while not self._commit(self.version() + 1, kind="base", path=snapshot, upto=at, run=run):
                pass  # an edit took the number; it is replayed on this base like the others
        except Exception as e:
            error = f"{type(e).__name__}: {e}"
            raise
        finally:
            context.removeJobTag(tag)
            shared.create_once(self.spark, self._run_file(run, "end"), json.dumps({"ts": time.time(), "error": error}))
        return run

    def cancel(self) -> None:
        """Cancel the jobs of the run that goes on, if it is of this application."""
        beat = shared.read_text(self.spark, self._run_file(self._last_run(), "beat"))
        if beat:
            self.spark.sparkContext.cancelJobsWithTag(json.loads(beat)["tag"])

    def stages(self) -> DataFrame:
        """(run, stage, n_rows, seconds, path) of all stages that have ended."""
        there = shared.names(self.spark, f"{self.folder}/stages")
        return self.spark.read.schema(RUNS).parquet(f"{self.folder}/stages") if there else self.spark.createDataFrame([], RUNS)

    def status(self) -> dict:
        """The last run: running, stage, error, times; the project's version; rows of the last stages and units."""
        run = self._last_run()
        claim, beat, end = (json.loads(shared.read_text(self.spark, self._run_file(run, k)) or "{}") for k in ("claim", "beat", "end"))
        counts = {r.stage: r.n_rows for r in self.stages().where(F.col("run") == run).collect()}
        return {
            "running": self._alive(run), "stage": "error" if end.get("error") else "done" if end else beat.get("stage"), "lastError": end.get("error"),
            "startedAt": claim.get("ts"), "finishedAt": end.get("ts"), "projectVersion": self.version(), "files": counts | {"units": self.units().count() if self.version() else 0},
        }

    def table(self, stage: str) -> DataFrame:
        """A stage's table from the last run that ended well."""
        ended = [e for e in map(self._read, reversed(self._commits())) if e.get("run")]
        rows = self.stages().where((F.col("run") == (ended[0]["run"] if ended else 0)) & (F.col("stage") == stage)).collect()
        if not rows:
            raise ValueError(f"no rebuilt {stage}")
        return self.spark.read.parquet(rows[0].path)
