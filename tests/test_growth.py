"""Steps that grew faster than their input: groups share a task's batches, timers are few, runs are written once."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tessera.operators.resolve import cluster, first_fit, first_fits
from tessera.operators.vector import unit
from tessera.streaming.ordered import Release


def test_topic_runs_read_what_was_written_once(spark, sf_dir):
    from tessera.plans.catalog import topic_runs

    files = topic_runs(spark, sf_dir, again=True).inputFiles()
    assert files and all("tessera-topics" in f for f in files)


def test_batches_are_clustered_together(spark):
    r = np.random.default_rng(3)
    for n in (1, 2, 5, 9):
        v = r.normal(size=(40, n, 3))
        has = r.random((40, n)) > 0.1
        u = np.stack([unit([x if h else None for x, h in zip(g, hs, strict=True)] + [np.zeros(3)])[:-1] for g, hs in zip(v, has, strict=True)])
        want = [first_fit([x if h else None for x, h in zip(g, hs, strict=True)], 0.3) for g, hs in zip(v, has, strict=True)]
        assert first_fits(u, has, 0.3).tolist() == want
    rows = spark.range(90_000).select(F.when(F.col("id") >= 3, F.floor(F.col("id") / 3)).alias("batch_id"), (F.col("id") % 3).alias("item_idx"), F.array(F.lit(1.0), (F.col("id") % 3 == 1).cast("double") * 9).alias("embedding"))
    made = cluster(rows)
    assert "FlatMapGroupsInPandas" not in made._jdf.queryExecution().executedPlan().toString()
    assert {(w.item_idx, w.cluster_id): w["count"] for w in made.groupBy("item_idx", "cluster_id").count().collect()} == {(0, 0): 30_000, (1, 1): 30_000, (2, 0): 30_000}


class Cell:
    def __init__(self):
        self.rows = []

    def exists(self):
        return bool(self.rows)

    def get(self):
        return list(self.rows)

    def appendList(self, rows):  # noqa: N802
        self.rows += rows

    def put(self, rows):
        self.rows = list(rows)

    def clear(self):
        self.rows = []


class Value(Cell):
    def get(self):
        return self.rows[0]

    def update(self, row):
        self.rows = [row]


class Handle:
    def __init__(self):
        self.timers = []

    def getListState(self, *a):  # noqa: N802
        return Cell()

    def getValueState(self, *a):  # noqa: N802
        return Value()

    def registerTimer(self, at):  # noqa: N802
        self.timers.append(at)


def test_release_has_one_timer_for_what_waits():
    import pandas as pd

    class Now:
        def __init__(self, ms):
            self.ms = ms

        def getCurrentWatermarkInMs(self):  # noqa: N802
            return self.ms

    handle, release = Handle(), Release()
    release.init(handle)
    rows = pd.DataFrame({"at": [3, 1, 2, 9], "id": list("cabz"), "received": [30, 40, 20, 90], "body": list("xxxx")})
    list(release.handleInputRows(("t", "a"), iter([rows]), None))
    assert handle.timers == [20]
    first = pd.concat(release.handleExpiredTimer(("t", "a"), Now(50), None))
    assert first["id"].tolist() == ["a", "b", "c"] and handle.timers == [20, 90]
    last = pd.concat(release.handleExpiredTimer(("t", "a"), Now(95), None))
    assert last["id"].tolist() == ["z"] and last["seq"].tolist() == [4] and handle.timers == [20, 90]


def test_deal_folds_share_batches(spark):
    from tessera.plans.deals import assign

    n = 20_000
    deals = spark.range(3 * n).select(F.lit("t").alias("tenant_id"), F.floor(F.col("id") / 3).cast("string").alias("account_id"), (F.col("id") % 3 + 1).cast("int").alias("seq"), F.col("id").cast("string").alias("query_id"), F.when(F.col("id") % 3 == 1, F.array(F.lit(0.0), F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(0.0))).alias("embedding"))
    state = deals.limit(0).select("tenant_id", "account_id", F.col("query_id").alias("opportunity_id"), "embedding")
    found = assign(deals, state, spark.createDataFrame([], "query_id string, vec_id string, same boolean, route string"))
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().executedPlan().toString()
    counts = found.groupBy((F.col("query_id") % 3).cast("int").alias("k"), "match_type", (F.col("query_id").cast("int") - F.col("opportunity_id").cast("int")).alias("back")).count().collect()
    assert {(w.k, w.match_type, w.back): w["count"] for w in counts} == {(0, "create_new", 0): n, (1, "create_new", 0): n, (2, "auto_match", 2): n}


def test_a_try_reads_only_the_failed_rows_of_the_log(spark, tmp_path):
    """No try compares all workflows with the whole log again, and what a run ends with is read from what it wrote."""
    from tessera.streaming.steps import Step, StepLog, execute

    whole = []

    class Log(StepLog):
        def pending(self, step, flows):
            whole.append(step)
            return super().pending(step, flows)

    def run(todo, read):
        calls.append(1)
        bad = (F.col("workflow_id") == "1") | ((F.col("workflow_id") == "2") & F.lit(len(calls) < 3))
        return todo.select("workflow_id", F.lit(1).alias("n"), F.when(bad, "no answer").alias("error"))

    calls: list[int] = []
    flows = spark.range(100).select(F.col("id").cast("string").alias("workflow_id"))
    log, steps = Log(spark, f"{tmp_path}/log", "r"), [Step("a", run, "n int"), Step("b", lambda todo, read: read("a").join(todo.select("workflow_id"), "workflow_id", "left_semi"), "n int")]
    for _ in range(2):
        finished, failed = execute(log, flows, steps, sleep=lambda s: None)
        assert finished.count() == 99 and finished.where("workflow_id = '1'").isEmpty() and [tuple(r) for r in failed.collect()] == [("1", "a", "no answer")]
    assert len(calls) == 3 and whole == ["a", "b"]  # of the second start
    assert {(r["attempt"], r["status"]): r["count"] for r in log.rows("a").groupBy("attempt", "status").count().collect()} == {(1, "done"): 98, (1, "failed"): 2, (2, "failed"): 2, (3, "done"): 1, (3, "failed"): 1}
    assert not any(f"/{s.name}/r" in f for s in steps for f in [*finished.inputFiles(), *failed.inputFiles()])


def test_topics_retry_tells_every_account(spark, sf_dir):
    from tessera.plans.streams import w9_topics_retry

    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.col("o_custkey").cast("string").alias("topic")).agg(F.count("*").alias("members"))
    got = w9_topics_retry(spark, sf_dir).select("topic", "members")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, orders.collect()))


def test_deals_are_read_from_written_stages_and_accounts_stay_whole(spark):
    """Nothing is kept in the cache, and the deals of an account meet however the exchanges before the fold are merged."""
    import datetime as dt

    from tessera import schemas as S
    from tessera.plans.deals import EXTRACTED, run_deals

    names = [f.name for f in S.struct(EXTRACTED)]
    rows = [{"tenant_id": "t", "account_id": f"a{i % 20}", "interaction_id": f"i{i}", "deal_idx": 0, "timestamp": dt.datetime(2024, 1, 1 + i // 20), "name": "n", "embedding": [1.0, 0.0]} for i in range(60)]
    deals = spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], S.struct(EXTRACTED))
    stored = [f.name for f in S.struct(S.TABLES["deal"])]
    state = spark.createDataFrame([tuple({"tenant_id": "t", "opportunity_id": f"o{i}", "account_id": f"a{i}", "version": 1, "embedding": [1.0, 0.0]}.get(n) for n in stored) for i in range(20)], S.struct(S.TABLES["deal"]))
    none = spark.createDataFrame([], "query_id string, vec_id string, same boolean, confidence double, route string")
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    out = run_deals(deals, state, spark.createDataFrame([], S.struct(S.TABLES["deal_version"])), none, "2024-06-01")
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before
    assert all("tessera-run-deals" in f for f in out.routed.inputFiles())
    assert {(r["opportunity_id"], r["match_type"]) for r in out.routed.collect()} == {(f"o{i}", "auto_match") for i in range(20)}
    assert {(r["opportunity_id"], r["version"]) for r in out.deals.collect()} == {(f"o{i}", 4) for i in range(20)}


def test_items_are_read_from_written_stages_and_made_once(spark):
    from test_pipelines import DECISIONS, NOW, extracted, items_state, table

    from tessera.plans.pipelines import run_items

    rows = extracted(spark).where("action_item_text = 'new thing'")
    verdicts = spark.createDataFrame([], "tenant_id string, interaction_id string, item_idx int, actionable boolean, adjusted double, pos int")
    owners = spark.createDataFrame([], "tenant_id string, account_id string, canonical_name string, aliases array<string>")
    none, versions = spark.createDataFrame([], DECISIONS), table(spark, "action_item_version", [])
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    out = run_items(rows.unionByName(rows), verdicts, owners, items_state(spark), versions, none, NOW)
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before
    assert all("tessera-run-items" in f for f in out.routed.inputFiles()) and out.routed.count() == 2
    got = sorted((r["summary"], r["owner"], r["version"]) for r in out.items.collect())
    assert got == [("new", "Zoe", 1), ("s", None, 1)]
    out.release()


def test_accounts_are_released_by_rows_without_data_frames():
    from pyspark.sql import Row

    from tessera.streaming.ordered import ReleaseRows

    class Now:
        def getCurrentWatermarkInMs(self):  # noqa: N802
            return 50

    class Empty(Value):
        def get(self):
            return self.rows[0] if self.rows else None

    class Rows(Handle):
        def getValueState(self, *a):  # noqa: N802
            return Empty()

    handle, release = Rows(), ReleaseRows()
    release.init(handle)
    rows = [Row(at=a, id=i, received=r, body="x") for a, i, r in ((3, "c", 30), (1, "a", 40), (2, "b", 20), (9, "z", 90))]
    assert list(release.handleInputRows(("t", "a"), iter(rows), None)) == [] and handle.timers == [20]
    out = list(release.handleExpiredTimer(("t", "a"), Now(), None))
    assert [(r.seq, r.id, r.late, r.account_id) for r in out] == [(1, "a", False, "a"), (2, "b", False, "a"), (3, "c", False, "a")] and handle.timers == [20, 90]
    list(release.handleInputRows(("t", "a"), iter([Row(at=0, id="y", received=45, body="x")]), None))
    assert [(r.seq, r.id, r.late) for r in release.handleExpiredTimer(("t", "a"), Now(), None)] == [(4, "y", True)]
    assert list(release.handleExpiredTimer(("t", "a"), Now(), None)) == []
