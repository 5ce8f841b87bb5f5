"""Durable steps: what a workflow's step gave is written once, and no step with an output runs again.

A workflow is a row; a step is one Spark job over all workflows that need it. Each try writes a row for each workflow:
its output as JSON rows, or its error. Whoever runs the same workflows later, after a failure of any kind, goes on from
what the log holds: finished steps are read, failed ones are tried again until their tries are used up. Tries count
within a run, so a restarted run has those that are left, and a new run that takes a failed workflow up has all. A row of
the log is a workflow's whole output, so a half-written try counts for the workflows whose rows are there.

A step fails for one workflow by a value in its ``error`` column, or for all by an exception. At the last try an exception
is narrowed down by halving the workflows, so that one bad record does not take the others with it.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import schemas as S
from tessera.scratch import settings
from tessera.sources.envelopes import json_row, typed_row

LOG = "workflow_id string, run string, attempt int, status string, error string, output array<string>, written_at timestamp"
LOST = "workflow_id string, step string, error string"
#: Lists are made from rows in order; by hash they would be sorted anew, before and after, beyond some keys.
BY_ORDER = {"spark.sql.execution.useObjectHashAggregateExec": "false"}


@dataclass
class Step:
    """``run`` gets the workflows and a reader of earlier steps' outputs (by name), and gives rows of ``ddl`` with their
    workflow_id, any number for each workflow, and an ``error`` if it likes. A fail-open step is tried once, and its
    failure counts as an empty output."""

    name: str
    run: Callable[[DataFrame, Callable[[str], DataFrame]], DataFrame]
    ddl: str
    tries: int = 3
    backoff: float = 1.0
    fail_open: bool = False


class StepLog:
    """The log of one pipeline: Parquet by step and run. Runs that are closed are not read any more."""

    def __init__(self, spark: SparkSession, path: str, run: str):
        self.spark, self.path, self.run = spark, path.rstrip("/"), run

    def _path(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def runs(self, step: str) -> list[str]:
        """The runs with rows of a step, but for closed ones."""
        fs, path = self._path(f"{self.path}/{step}")
        names = [x.getPath().getName() for x in fs.listStatus(path)] if fs.exists(path) else []
        return [n for n in names if n[0] not in "_." and f"_closed-{n}" not in names]

    def rows(self, step: str) -> DataFrame:
        runs = self.runs(step)
        if not runs:
            return self.spark.createDataFrame([], S.struct(LOG))
        return self.spark.read.schema(S.struct(LOG)).parquet(*[f"{self.path}/{step}/{n}" for n in runs])

    def write(self, step: str, rows: DataFrame) -> None:
        rows.withColumn("run", F.lit(self.run)).select(*[f.name for f in S.struct(LOG)]).write.mode("append").parquet(f"{self.path}/{step}/{self.run}")

    def failures(self, step: str) -> DataFrame:
        """(workflow_id, last) of each workflow with a failed try in this run: the last of them."""
        mine = self.rows(step).where((F.col("run") == self.run) & (F.col("status") == "failed"))
        return mine.groupBy("workflow_id").agg(F.max("attempt").alias("last"))

    def pending(self, step: str, flows: DataFrame) -> DataFrame:
        """The workflows without an output of the step in any run, with ``tried``, the tries of this run."""
        done = self.rows(step).where("status != 'failed'").select("workflow_id")
        rest = flows.join(done, "workflow_id", "left_anti").join(self.failures(step), "workflow_id", "left")
        return rest.withColumn("tried", F.coalesce("last", F.lit(0))).drop("last")

    def aside(self, step: str, rows: DataFrame) -> DataFrame:
        """Rows as they are now, written beside the log's: a kept frame over the log is made anew by each write to it."""
        path = f"{self.path}/{step}/_aside-{self.run}-{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def lose(self, step: str, lost: DataFrame) -> DataFrame:
        """(workflow_id, step, error) of workflows that failed for good, written once for all who ask."""
        errors = self.rows(step).where("status = 'failed'").groupBy("workflow_id").agg(F.max_by("error", F.struct("written_at", "attempt")).alias("error"))
        return self.aside(step, lost.join(errors, "workflow_id").select("workflow_id", F.lit(step).alias("step"), "error"))

    def output(self, step: Step) -> DataFrame:
        """The rows that a step gave, with their workflow_id; of several outputs of a workflow the first counts."""
        first = self.rows(step.name).where("status != 'failed'").repartition("workflow_id").groupBy("workflow_id").agg(F.min_by("output", F.struct("written_at", "attempt")).alias("output"))
        return first.select("workflow_id", F.explode("output").alias("_j")).select("workflow_id", typed_row(F.col("_j"), step.ddl).alias("_r")).select("workflow_id", "_r.*")

    def close(self, steps: list[Step]) -> None:
        """The run's workflows are all finished: its rows are history from now on."""
        for step in steps:
            fs, path = self._path(f"{self.path}/{step.name}/_closed-{self.run}")
            fs.create(path, True).close()


def failed_rows(todo: DataFrame, step: Step, error: Column) -> DataFrame:
    status = "skipped" if step.fail_open else "failed"
    return todo.select("workflow_id", (F.col("tried") + 1).alias("attempt"), F.lit(status).alias("status"), error.alias("error"), F.array().cast("array<string>").alias("output"), F.current_timestamp().alias("written_at"))


def given_rows(todo: DataFrame, step: Step, out: DataFrame) -> DataFrame:
    """A log row for each workflow of ``todo`` from what the step gave."""
    names = [f.name for f in S.struct(step.ddl)]
    error = F.col("error") if "error" in out.columns and "error" not in names else F.lit(None).cast("string")
    by = out.groupBy("workflow_id").agg(F.sort_array(F.collect_list(F.when(error.isNull(), json_row(names)))).alias("output"), F.max(error).alias("error"))
    status = F.when(F.col("error").isNull(), "done").otherwise("skipped" if step.fail_open else "failed")
    output = F.when(F.col("error").isNull(), F.col("output"))
    return todo.join(by, "workflow_id", "left").select("workflow_id", (F.col("tried") + 1).alias("attempt"), status.alias("status"), "error", F.coalesce(output, F.array().cast("array<string>")).alias("output"), F.current_timestamp().alias("written_at"))


def tried(log: StepLog, step: Step, todo: DataFrame, read: Callable[[str], DataFrame], splits: int) -> tuple[int, bool]:
    """One try of a step; the number of further halvings that are allowed after it, and whether nothing was raised."""
    try:
        with settings(log.spark, BY_ORDER):
            log.write(step.name, given_rows(todo, step, step.run(todo.drop("tried"), read)))
        return splits, True
    except Exception as e:  # noqa: BLE001  whatever the step raises is written down
        last = todo.agg(F.max("tried"), F.count("*")).first()
        if splits <= 0 or last[1] < 2 or last[0] + 1 < step.tries or step.fail_open:
            log.write(step.name, failed_rows(todo, step, F.lit((str(e) or type(e).__name__)[:1000])))
            return splits, False
    salt = uuid.uuid4().hex  # another cut at every level
    half = F.pmod(F.xxhash64("workflow_id", F.lit(salt)), F.lit(2))
    for side in (0, 1):
        splits, _ = tried(log, step, todo.where(half == side), read, splits - 1)
    return splits, False


def run_step(log: StepLog, alive: DataFrame, step: Step, read: Callable[[str], DataFrame], sleep: Callable[[float], None], splits: int) -> DataFrame | None:
    """Try a step until each workflow has an output or no tries left; those without an output, as LOST, if any.

    What a try leaves is told by its failed rows, which are mostly few; the whole log is compared only at the start, and
    after a try that raised."""
    tries = 1 if step.fail_open else step.tries
    left = F.col("tried") < tries
    lost: DataFrame | None = None
    todo = alive.withColumn("tried", F.lit(0))
    rest = log.aside(step.name, log.pending(step.name, alive.select("workflow_id"))) if log.runs(step.name) else None
    before = 0 if rest is None and not alive.isEmpty() else None
    while True:
        if rest is not None:  # few, mostly
            before, some = rest.agg(F.max(F.when(left, F.col("tried"))), F.bool_or(~left)).first()
            if some:
                spent = rest.where(~left).select("workflow_id")
                lost = spent if lost is None else lost.unionByName(spent)
            todo = alive.join(rest.where(left), "workflow_id")
        if before is None:
            break
        if before:
            sleep(step.backoff * 2 ** (before - 1))
        if rest is not None:
            todo.persist(StorageLevel.DISK_ONLY)
        try:
            clean = tried(log, step, todo, read, splits)[1]
            ids = todo.select("workflow_id", "tried")
            if not clean:
                rest = log.pending(step.name, ids.drop("tried"))
            elif (failures := log.failures(step.name)).isEmpty():
                break
            else:
                rest = ids.join(failures, "workflow_id").where(F.col("last") > F.col("tried")).select("workflow_id", F.col("last").alias("tried"))
            rest = log.aside(step.name, rest)
        finally:
            todo.unpersist()
    return lost if lost is None else log.lose(step.name, lost.distinct())


def execute(log: StepLog, workflows: DataFrame, steps: list[Step], sleep: Callable[[float], None] = time.sleep, after: Callable[[str], None] | None = None, splits: int = 64) -> tuple[DataFrame, DataFrame]:
    """Run the steps of ``workflows`` (workflow_id and what the steps need) in order, as far as each one gets:
    (workflow_id of those that finished all, (workflow_id, step, error) of those that failed)."""
    by_name = {s.name: s for s in steps}
    read = lambda name: log.output(by_name[name])
    # dealt and sorted once for all steps and tries
    dealt = workflows.repartition("workflow_id").sortWithinPartitions("workflow_id").persist(StorageLevel.DISK_ONLY)
    alive, finished, failed = dealt, workflows.select("workflow_id"), log.spark.createDataFrame([], LOST)
    try:
        for step in steps:
            lost = run_step(log, alive, step, read, sleep, splits)
            if after is not None:
                after(step.name)
            if lost is not None:
                alive, finished, failed = alive.join(lost, "workflow_id", "left_anti"), finished.join(lost, "workflow_id", "left_anti"), failed.unionByName(lost)
    finally:
        dealt.unpersist()
    return finished, failed
