"""Queries of the stream's parts, and the stateful processors with a clock of our own."""

import pandas as pd
import pytest
from helpers import same

from tessera.plans import streams
from tessera.streaming.ordered import Release, Watch


@pytest.mark.parametrize("name", sorted(streams.ORACLES))
def test_stream_query_agrees_with_sql(spark, sf_dir, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert same(streams.QUERIES[name](spark, sf_dir), streams.ORACLES[name], sf_dir) == ""
    spark.conf.set("spark.sql.shuffle.partitions", before)


class State:
    def __init__(self):
        self.v = None

    exists = lambda self: self.v is not None
    get = lambda self: self.v

    def update(self, v):
        self.v = v

    put = update

    def appendList(self, v):
        self.v = (self.v or []) + list(v)

    def clear(self):
        self.v = None


class Clock:
    """A handle, timers and the time for one key."""

    def __init__(self, processor, key):
        self.p, self.key, self.now, self.timers = processor, key, 0, set()
        processor.init(self)

    def getValueState(self, name, schema):
        return State()

    getListState = getValueState

    def registerTimer(self, t):
        self.timers.add(t)

    def deleteTimer(self, t):
        self.timers.discard(t)

    getCurrentProcessingTimeInMs = getCurrentWatermarkInMs = lambda self: self.now

    def rows(self, **columns):
        return [tuple(r) for pdf in self.p.handleInputRows(self.key, iter([pd.DataFrame(columns)]), self) for r in pdf.itertuples(index=False)]

    def to(self, now):
        self.now, out = now, []
        for t in sorted(t for t in self.timers if t <= now):
            self.timers.discard(t)
            info = type("T", (), {"getExpiryTimeInMs": lambda self, t=t: t})()
            out += [tuple(r) for pdf in self.p.handleExpiredTimer(self.key, self, info) for r in pdf.itertuples(index=False)]
        return out


def test_a_workflow_without_a_result_times_out():
    c = Clock(Watch(900), ("w",))
    assert c.rows(event=["started"]) == [] and c.to(899_999) == [] and c.to(900_000) == [("w", "timeout")]
    # it can be tried again; a new start counts anew, and a result ends the wait
    assert c.rows(event=["started"]) == [] and c.to(1_000_000) == []
    assert c.rows(event=["started"]) == [] and c.to(1_800_000) == [] and c.to(1_899_999) == []
    assert c.rows(event=["result"]) == [("w", "finished")] and c.to(9_999_999) == [] and c.timers == set()
    assert c.rows(event=["started", "result"]) == [("w", "finished")] and c.timers == set()


def test_release_in_order_and_late():
    c = Clock(Release(), ("t", "a"))
    add = lambda *x: c.rows(at=[v[0] for v in x], id=[v[1] for v in x], received=[v[2] for v in x], body=["{}"] * len(x))
    assert add((30, "c", 100), (10, "a", 110), (40, "d", 300)) == []
    got = lambda now: [(r[0], r[2], r[3]) for r in c.to(now)]
    assert got(99) == [] and got(100) == [(1, "a", False), (2, "c", False)] and got(200) == []
    # one that comes after a later one has gone is told, and does not hold up the order
    assert add((20, "b", 250), (40, "a", 260)) == []
    assert got(250) == [(3, "b", True)] and got(260) == [(4, "a", False)]
    assert got(300) == [(5, "d", False)] and not c.p.waiting.exists() and c.p.last.get() == (5, 40, "d")


def test_timeouts_in_a_stream(spark, tmp_path):
    """Real timers: a start without a result runs out, one with a result does not."""
    from tessera.scratch import settings
    from tessera.streaming.ordered import STATE_CONF, watched

    (tmp_path / "in").mkdir()
    rows = lambda *x: spark.createDataFrame(list(x), "workflow_id string, event string").write.mode("append").parquet(str(tmp_path / "in"))
    with settings(spark, STATE_CONF | {"spark.sql.shuffle.partitions": "2", "spark.sql.streaming.noDataMicroBatches.enabled": "false"}):
        for events in ([("a", "started"), ("b", "started")], [("b", "result"), ("c", "started")]):
            rows(*events)
            q = watched(spark.readStream.schema("workflow_id string, event string").parquet(str(tmp_path / "in")), 0.0).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
            q.awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert ("a", "timeout") in got and ("b", "finished") in got
