"""Batches of queue records through durable pipelines: no envelope is lost, none takes effect twice.

A record is received, parsed and checked; each pipeline takes its envelope as one workflow, runs its model steps through
the step log, and writes the rows that change. All tables of a batch are published at once, together with what became of
each workflow and record. A record that failed (not valid, a step without success, a failed write) is received again
with the next batch, and goes to the dead letters after three receives; finished workflows of it do not run again. A
redelivery of a finished workflow runs nothing.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import schemas as S
from tessera.functions.scalars import truthy, workflow_id
from tessera.operators.upsert import one_row, upsert
from tessera.plans import deals as D
from tessera.plans.pipelines import ITEM_KEY, item_ids, run_items
from tessera.scratch import Stages
from tessera.sources.envelopes import checked, event_filter, to_interaction
from tessera.streaming.steps import Step, StepLog, execute
from tessera.streaming.tables import COMPACT, Tables

INTERACTION = ["tenant_id", "interaction_id"]
WORKFLOW = "tenant_id string, workflow_id string, pipeline string, interaction_id string, status string, step string, error string"
RECEIVE = "tenant_id string, record_id string, body string, receives int, status string, error string"
SCHEMAS = {n: S.TABLES[n] for n in ("interaction", "action_item", "action_item_version", "deal", "deal_version")} | {"workflow": WORKFLOW, "receive": RECEIVE}
KEYS = {"interaction": INTERACTION, "action_item": ITEM_KEY, "action_item_version": ["tenant_id", "version_id"], "deal": D.KEY, "deal_version": ["tenant_id", "version_id"], "workflow": ["workflow_id"], "receive": ["record_id"]}
EXTRACTED_ITEM = "tenant_id string, account_id string, interaction_id string, item_idx int, action_item_text string, summary string, owner string, is_status_update boolean, implied_status string, confidence double, score_impact int, score_urgency int, score_specificity int, embedding array<float>"
VERDICT = "tenant_id string, interaction_id string, item_idx int, actionable boolean, adjusted double, pos int"
DECISION = "query_id string, vec_id string, same boolean, confidence double, route string"


def open_tables(spark: SparkSession, root: str) -> Tables:
    return Tables(spark, root, SCHEMAS, KEYS)


@dataclass
class Pipeline:
    """A pipeline's steps, and ``write``: from the finished envelopes, a reader of the steps' outputs and the tables, the
    rows that change by table, and what to call when they are written."""

    name: str
    steps: list[Step]
    write: Callable[[DataFrame, Callable[[str], DataFrame], Tables], tuple[dict[str, DataFrame], Callable[[], None]]]


def of_accounts(state: DataFrame, envelopes: DataFrame) -> DataFrame:
    return state.join(envelopes.select("tenant_id", "account_id").distinct(), ["tenant_id", "account_id"], "left_semi")


def changed(rows: DataFrame, touched: DataFrame, key: list[str]) -> DataFrame:
    return rows.join(touched.select(*key).distinct(), key, "left_semi")


def by_interaction(rows: DataFrame, envelopes: DataFrame) -> DataFrame:
    """Rows that a model gave with their interaction, as rows of workflows."""
    return rows.join(envelopes.select("tenant_id", "interaction_id", "workflow_id"), ["tenant_id", "interaction_id"])


class Kept:
    """Frames that are read many times, on disk until ``release``."""

    def __init__(self):
        self.frames: list[DataFrame | Stages] = []

    def __call__(self, df: DataFrame) -> DataFrame:
        self.frames.append(df.persist(StorageLevel.DISK_ONLY))
        return self.frames[-1]

    def release(self) -> None:
        for df in self.frames:
            df.unpersist()


def given(read: Callable[[str], DataFrame], step: str, envelopes: DataFrame) -> DataFrame:
    """What a step gave for these envelopes."""
    return read(step).join(envelopes.select("workflow_id"), "workflow_id", "left_semi").drop("workflow_id")


def item_pipeline(models, now) -> Pipeline:
    """``models``: items, verdicts, decisions and owners as functions of envelopes (see runner.Models)."""

    def decide(envelopes, read):
        made = item_ids(read("extract")).select("workflow_id", "query_id")
        return models.decisions(envelopes).join(made, "query_id")

    def write(envelopes, read, tables):
        kept = Kept()
        state = kept(of_accounts(tables.read("action_item"), envelopes))
        versions = kept(changed(tables.read("action_item_version"), state, ITEM_KEY))
        out = run_items(*(kept(given(read, n, envelopes)) for n in ("extract", "verify")), models.owners(envelopes), state, versions, kept(given(read, "decide", envelopes)), now)
        kept.frames += out.kept
        new = out.versions.join(versions.select("tenant_id", "version_id"), ["tenant_id", "version_id"], "left_anti")
        return {"action_item": changed(out.items, out.routed, ITEM_KEY), "action_item_version": new}, kept.release

    steps = [Step("extract", lambda e, read: by_interaction(models.items(e), e), EXTRACTED_ITEM), Step("verify", lambda e, read: by_interaction(models.verdicts(e), e), VERDICT, fail_open=True), Step("decide", decide, DECISION)]
    return Pipeline("items", steps, write)


def deal_pipeline(models, now) -> Pipeline:
    def decide(envelopes, read):
        made = D.prepared(read("extract")).select("workflow_id", "query_id")
        return models.decisions(envelopes).join(made, "query_id")

    def write(envelopes, read, tables):
        kept = Kept()
        state = kept(of_accounts(tables.read("deal"), envelopes))
        versions = kept(changed(tables.read("deal_version"), state, D.KEY))
        out = D.run_deals(kept(given(read, "extract", envelopes)), state, versions, kept(given(read, "decide", envelopes)), now)
        kept.frames += out.kept
        new = out.versions.join(versions.select("tenant_id", "version_id"), ["tenant_id", "version_id"], "left_anti")
        return {"deal": changed(out.deals, out.routed, D.KEY), "deal_version": new}, kept.release

    return Pipeline("deals", [Step("extract", lambda e, read: by_interaction(models.deals(e), e), D.EXTRACTED), Step("decide", decide, DECISION)], write)


def received(bodies: DataFrame, tables: Tables) -> DataFrame:
    """The batch's records and those that wait for another receive, one row a record: record_id, body, receives before."""
    waiting = tables.read("receive").where("status = 'retry'").select("body", "receives")
    rows = bodies.select("body", F.lit(0).alias("receives")).unionByName(waiting)
    return rows.groupBy(F.sha2("body", 256).alias("record_id")).agg(F.min("body").alias("body"), F.max("receives").alias("receives"))


def process(bodies: DataFrame, tag: str, tables: Tables, log: str, pipelines: list[Pipeline], limit: int = 3, sources: list[str] | None = None, sleep: Callable[[float], None] = time.sleep, after: Callable[[str], None] | None = None) -> DataFrame:
    """One batch of record bodies under its tag; the failed records (record_id, receives, status, error) as a table. A
    tag that is published already does nothing."""
    spark = tables.spark
    if tables.has(tag):
        return tables.read("receive").where("false").select("record_id", "receives", "status", "error")
    batch = tables.begin(tag)
    keep = Kept()
    try:
        records = keep(received(bodies, tables))
        rows = checked(records).withColumn("record_id", F.sha2("body", 256))
        rows = keep(rows.withColumn("reason", F.coalesce("reason", F.when(~truthy(F.col("interaction_id")), "missing interaction_id"))))
        good = rows.where("reason is null")
        if sources is not None:
            good = event_filter(good, sources)
        new = one_row(to_interaction(good), INTERACTION, F.struct("timestamp", F.xxhash64("content_text")))
        state = changed(tables.read("interaction"), new, INTERACTION)
        batch.write("interaction", upsert(state, new, INTERACTION, update=[], fill=["title", "content_text", "trace_id", "account_id"]))
        results = []
        for p in pipelines:
            wid = workflow_id(p.name, F.col("interaction_id"))
            own = one_row(good.withColumn("workflow_id", wid).drop("reason", "body"), ["workflow_id"], F.struct("timestamp", "record_id"))
            done = tables.read("workflow").where("status = 'done'").select("workflow_id")
            flows = keep(own.join(done, "workflow_id", "left_anti"))
            results.append(keep(one_pipeline(p, flows, batch, tables, StepLog(spark, f"{log}/{p.name}", tag), sleep, after)))
        outcome = results[0]
        for r in results[1:]:
            outcome = outcome.unionByName(r)
        batch.write("workflow", outcome)
        receives = keep(judged(records, rows, outcome, limit))
        # those without a fault leave a row only if they had waited
        batch.write("receive", receives.where("error is not null or receives > 1"))
        batch.commit()
    finally:
        keep.release()
    # a record is done or dead after ``limit`` receives, so what the batch before those logged is not read again
    past = [t for _, t, _ in tables.commits() if t != COMPACT][: -limit - 1]
    for p in pipelines:
        for old in past[-1:]:
            StepLog(spark, f"{log}/{p.name}", old).close(p.steps)
    return tables.changes("receive").where((F.col("batch") == batch.number) & F.col("error").isNotNull()).select("record_id", "receives", "status", "error")


def one_pipeline(p: Pipeline, flows: DataFrame, batch, tables: Tables, log: StepLog, sleep, after) -> DataFrame:
    """Run a pipeline's workflows and write what they change into the batch; what became of each, as rows of WORKFLOW.
    If the writes fail, none of them stays, and all of its workflows failed."""
    by_name = {s.name: s for s in p.steps}
    finished, failed = execute(log, flows, p.steps, sleep, after)
    names: list[str] = []
    error: Column = F.lit(None).cast("string")
    release = None
    try:
        frames, release = p.write(flows.join(finished, "workflow_id", "left_semi"), lambda n: log.output(by_name[n]), tables)
        for name, df in frames.items():
            names.append(name)
            batch.write(name, df)
    except Exception as e:  # noqa: BLE001  the other pipeline goes on; the records are received again
        for name in names:
            batch.drop(name)
        error = F.lit((str(e) or type(e).__name__)[:1000])
    finally:
        if release is not None:
            release()
    out = flows.select("tenant_id", "workflow_id", "interaction_id").join(failed.withColumnRenamed("error", "_error"), "workflow_id", "left")
    step = F.coalesce("step", F.when(error.isNotNull(), "write"))
    error = F.coalesce("_error", error)
    return out.select("tenant_id", "workflow_id", F.lit(p.name).alias("pipeline"), "interaction_id", F.when(step.isNull(), "done").otherwise("failed").alias("status"), step.alias("step"), error.alias("error"))


def judged(records: DataFrame, rows: DataFrame, outcome: DataFrame, limit: int) -> DataFrame:
    """The receives after this one: a record failed if it is not valid or a workflow of its interaction failed."""
    faults = outcome.where("status = 'failed'").groupBy("interaction_id").agg(F.max(F.concat_ws(": ", "pipeline", "step", "error")).alias("_fault"))
    marked = rows.select("record_id", "tenant_id", "interaction_id", "reason").join(faults, "interaction_id", "left")
    error = F.coalesce("reason", "_fault")
    n = F.col("receives") + 1
    status = F.when(error.isNull(), "done").when(n >= limit, "dead").otherwise("retry")
    return records.join(marked, "record_id").select("tenant_id", "record_id", "body", n.alias("receives"), status.alias("status"), error.alias("error"))


def dead_letters(tables: Tables) -> DataFrame:
    return tables.read("receive").where("status = 'dead'").select("tenant_id", "record_id", "body", "receives", "error")


def durable(tables: Tables, log: str, pipelines: list[Pipeline], told: Callable[[str, DataFrame], None] | None = None, **more) -> Callable[[DataFrame, int], None]:
    """The foreachBatch function over record bodies; ``told`` gets each batch's tag and failed records."""

    def step(batch: DataFrame, number: int) -> None:
        tag = f"{batch.sparkSession.sparkContext.getLocalProperty('sql.streaming.queryId')}-{number}"
        failed = process(batch.select("body"), tag, tables, log, pipelines, **more)
        if told is not None:
            told(tag, failed)

    return step
