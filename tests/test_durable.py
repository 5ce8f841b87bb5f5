"""Durable batches: published together, steps that never run twice, receives and dead letters."""

import collections

import pytest
from pyspark.sql import functions as F
from test_streaming import record

from tessera import schemas as S
from tessera.plans import deals as D
from tessera.streaming.durable import DECISION, EXTRACTED_ITEM, VERDICT, Pipeline, by_interaction, dead_letters, deal_pipeline, durable, item_pipeline, open_tables, process
from tessera.streaming.runner import Models, stream
from tessera.streaming.steps import Step, StepLog, execute
from tessera.streaming.tables import Tables

FOUR = ["item", "version", "deal", "history"]


@pytest.fixture
def few(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_tables_change_together(few, tmp_path):
    tables = Tables(few, str(tmp_path), dict.fromkeys(FOUR, "tenant_id string, k string, v int"), dict.fromkeys(FOUR, ["tenant_id", "k"]))
    rows = lambda *x: few.createDataFrame(list(x), "tenant_id string, k string, v int")
    assert tables.read("item").count() == 0
    one = tables.begin("q-0")
    for name in FOUR:
        one.write(name, rows(("t", "a", 1), (None, "b", 1)))
    one.commit()
    # the second of four tables fails: readers stay on the old four
    two = tables.begin("q-1")
    two.write("item", rows(("t", "a", 2)))
    with pytest.raises(Exception, match="down"):
        two.write("version", rows(("t", "a", 2)).withColumn("v", F.raise_error(F.lit("down")).cast("int")))
    see = lambda: [sorted((r["k"], r["v"]) for r in tables.read(name).collect()) for name in FOUR]
    assert see() == [[("a", 1), ("b", 1)]] * 4 and not tables.has("q-1")
    # another batch takes its number; what the failed one left is gone
    three = tables.begin("q-2")
    three.write("history", rows(("t", "c", 3)))
    three.commit()
    assert see() == [[("a", 1), ("b", 1)]] * 3 + [[("a", 1), ("b", 1), ("c", 3)]]
    # a whole state, twice: batches before the first one are deleted, and nothing is seen differently
    before = see()
    tables.compact()
    tables.compact()
    assert see() == before and tables.has("compact") and [n for n, _, _ in tables.commits()] == [2, 3]
    last = tables.begin("q-3")
    last.write("item", rows(("t", "a", 9)))
    last.commit()
    assert see()[0] == [("a", 9), ("b", 1)]


class Killed(BaseException):
    pass


def chain(calls, bad=lambda step, n: None):
    def run(name, before):
        def step(flows, read):
            calls[name] += 1
            bad(name, calls[name])
            base = read(before) if before else flows.select("workflow_id", F.lit(0).alias("n"))
            mine = base.join(flows.select("workflow_id"), "workflow_id", "left_semi")
            return mine.select("workflow_id", (F.col("n") + 1).alias("n"), F.lit(None).cast("array<string>").alias("nothing"), F.when((F.col("workflow_id") == "poison") & F.lit(name == "b"), "no such thing").alias("error"))

        return step

    return [Step(name, run(name, before), "n int, nothing array<string>") for name, before in (("a", None), ("b", "a"), ("c", "b"))]


def test_a_kill_between_any_two_steps(few, tmp_path):
    flows = few.createDataFrame([("x",), ("y",)], "workflow_id string")
    for at in "abc":
        calls, steps = collections.Counter(), None
        steps = chain(calls)

        def kill(name, at=at):
            if name == at:
                raise Killed

        with pytest.raises(Killed):
            execute(StepLog(few, f"{tmp_path}/{at}", "r"), flows, steps, sleep=lambda s: None, after=kill)
        log = StepLog(few, f"{tmp_path}/{at}", "r")
        finished, failed = execute(log, flows, steps, sleep=lambda s: None)
        assert sorted(r[0] for r in finished.collect()) == ["x", "y"] and failed.count() == 0
        assert sorted((r["workflow_id"], r["n"]) for r in log.output(steps[2]).collect()) == [("x", 3), ("y", 3)]
        assert dict(calls) == {"a": 1, "b": 1, "c": 1}


def test_tries_backoff_and_poison(few, tmp_path):
    slept, calls = [], collections.Counter()

    def bad(name, n):
        if name == "a" and n < 3:
            raise OSError("executor lost")

    flows = few.createDataFrame([("x",), ("poison",), ("y",)], "workflow_id string")
    log = StepLog(few, f"{tmp_path}/log", "r")
    finished, failed = execute(log, flows, chain(calls, bad), sleep=slept.append)
    assert slept == [1.0, 2.0, 1.0, 2.0]  # step a twice for all, step b twice for the poison
    assert sorted(r[0] for r in finished.collect()) == ["x", "y"] and [tuple(r) for r in failed.collect()] == [("poison", "b", "no such thing")]
    assert dict(calls) == {"a": 3, "b": 3, "c": 1}
    # those that failed for good do not run again, and closed runs are not read
    execute(log, flows, chain(calls, bad), sleep=slept.append)
    assert dict(calls) == {"a": 3, "b": 3, "c": 1}
    log.close(chain(calls))
    assert log.rows("a").count() == 0


def test_one_bad_workflow_does_not_take_the_others(few, tmp_path):
    """A step that raises for all because of one is halved until that one stands alone; a fail-open step loses only its
    output."""
    def run(flows, read):
        return flows.select("workflow_id", F.when(F.col("workflow_id") == "w3", F.raise_error(F.lit("bad text"))).otherwise(1).cast("int").alias("n"))

    flows = few.createDataFrame([(f"w{i}",) for i in range(6)], "workflow_id string")
    log = StepLog(few, f"{tmp_path}/log", "r")
    steps = [Step("only", run, "n int", tries=1)]
    finished, failed = execute(log, flows, steps)
    assert [r["workflow_id"] for r in failed.collect()] == ["w3"] and finished.count() == 5 and log.output(steps[0]).count() == 5
    open_ = [Step("open", run, "n int", fail_open=True)]
    finished, failed = execute(log, flows, open_)
    assert finished.count() == 6 and failed.count() == 0 and log.output(open_[0]).count() == 0


def vector(*x):
    return F.array(*[F.lit(float(v)) for v in x]).cast("array<float>")


def models(spark, calls, faults):
    """Models that give an item and a deal for each envelope; those named in ``faults`` are down."""
    def counted(name, make):
        def f(envelopes):
            calls[name] += 1
            if name in faults:
                raise OSError("executor lost")
            return make(envelopes)

        return f

    def items(e):
        return e.select("tenant_id", "account_id", "interaction_id", F.lit(0).alias("item_idx"), F.col("content.text").alias("action_item_text"), F.col("content.text").alias("summary"), F.lit("Zoe").alias("owner"), F.lit(False).alias("is_status_update"), F.lit(None).cast("string").alias("implied_status"), F.lit(0.5).alias("confidence"), F.lit(3).alias("score_impact"), F.lit(3).alias("score_urgency"), F.lit(3).alias("score_specificity"), F.when(F.col("interaction_id") == "i1", vector(1, 0)).otherwise(vector(0, 1)).alias("embedding"))

    def deals(e):
        given = {"deal_idx": F.lit(0), "name": F.col("interaction_id"), "opportunity_summary": F.col("content.text"), "amount": F.lit(1.0), "confidence": F.lit(0.5), "embedding": vector(1, 0)}
        return e.select(*[F.col(f.name) if f.name in e.columns else given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in S.struct(D.EXTRACTED)])

    nothing = lambda ddl: lambda e: spark.createDataFrame([], ddl)
    return Models(counted("items", items), counted("verdicts", nothing(VERDICT)), counted("deals", deals), nothing(DECISION), nothing("tenant_id string, account_id string, canonical_name string, aliases array<string>"))


def noted(models):
    """A second pipeline beside the deals: it writes each extracted item as it is."""

    def write(envelopes, read, tables):
        rows = read("extract").join(envelopes.select("workflow_id"), "workflow_id", "left_semi")
        return {"action_item": rows.select(*[(F.col("interaction_id") if f.name == "action_item_id" else F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in S.struct(S.TABLES["action_item"])])}, lambda: None

    return Pipeline("items", [Step("extract", lambda e, read: by_interaction(models.items(e), e), EXTRACTED_ITEM)], write)


def state_of(tables):
    return {n: sorted(map(repr, tables.read(n).collect())) for n in ("interaction", "action_item", "deal", "deal_version")}


def test_no_envelope_is_lost(few, tmp_path):
    """Both pipelines fail in the first batch, which is killed once besides; the next batch receives its records again. A
    poison record goes after three receives; a redelivery runs nothing; all tables are those of a run without faults."""
    calls = collections.Counter()
    faults = {"items", "deals"}
    tables = open_tables(few, f"{tmp_path}/tables")
    bodies = lambda *x: few.createDataFrame([(b,) for b in x], "body string")
    pipelines = [noted(models(few, calls, faults)), deal_pipeline(models(few, calls, faults), "2024-01-01")]
    quiet = {"sleep": lambda s: None}
    failed = process(bodies(record(1), "{bad", record(2)), "q-0", tables, f"{tmp_path}/log", pipelines, **quiet).collect()
    assert len(failed) == 3 and {r["status"] for r in failed} == {"retry"} and tables.read("deal").count() == 0 and tables.read("interaction").count() == 2

    def kill(name):
        if name == "extract":
            raise Killed

    faults.clear()
    with pytest.raises(Killed):
        process(bodies(record(3)), "q-1", tables, f"{tmp_path}/log", pipelines, after=kill, **quiet)
    assert tables.read("action_item").count() == 0
    failed = process(bodies(record(3)), "q-1", tables, f"{tmp_path}/log", pipelines, **quiet).collect()
    assert [(r["receives"], r["status"], r["error"]) for r in failed] == [(2, "retry", "invalid JSON")]
    assert tables.read("action_item").count() == 3 and tables.read("deal").first()["version"] == 3
    before = collections.Counter(calls)
    failed = process(bodies(record(2)), "q-2", tables, f"{tmp_path}/log", pipelines, **quiet).collect()
    assert calls == before and [(r["receives"], r["status"]) for r in failed] == [(3, "dead")]
    assert [(r["body"], r["error"]) for r in dead_letters(tables).collect()] == [("{bad", "invalid JSON")]
    # published already
    assert process(bodies(record(8)), "q-2", tables, f"{tmp_path}/log", pipelines, **quiet).count() == 0 and calls == before
    plain = open_tables(few, f"{tmp_path}/plain")
    process(bodies(record(1), record(2), record(3)), "p-0", plain, f"{tmp_path}/log2", [noted(models(few, calls, set())), deal_pipeline(models(few, calls, set()), "2024-01-01")], **quiet)
    assert state_of(plain) == state_of(tables)


def test_durable_stream(few, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.txt").write_text("\n".join([record(1), record(9, account="b"), record(4, account="")]))
    tables, told = open_tables(few, f"{tmp_path}/tables"), []
    step = durable(tables, f"{tmp_path}/log", [f(models(few, collections.Counter(), set()), "2024-01-01") for f in (item_pipeline, deal_pipeline)], lambda tag, failed: told.extend(failed.collect()), sleep=lambda s: None)
    stream(few, f"{tmp_path}/in", f"{tmp_path}/cp", step).awaitTermination()
    assert sorted(r["account_id"] for r in tables.read("deal").collect()) == ["a", "b"] and [(r["error"], r["status"]) for r in told] == [("missing account_id", "retry")]
    assert sorted((r["workflow_id"], r["status"]) for r in tables.read("workflow").collect()) == [(f"{p}:interaction-{i}", "done") for p in ("deals", "items") for i in ("i1", "i9")]
    assert sorted((r["account_id"], r["summary"], r["version"]) for r in tables.read("action_item").collect()) == [("a", "text 1", 1), ("b", "text 9", 1)]
