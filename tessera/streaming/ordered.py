"""Envelopes of a stream once each and in order, by keyed state; and workflows that take too long, by timers.

``in_order`` drops redeliveries within the watermark, and holds each envelope in the state of its tenant and account for
as long, so that an earlier one that arrives within that time goes before it. What is released has a number within its
account. State is bounded by what arrives while an envelope is held; nothing is rewritten from batch to batch but the
state of the accounts that a batch touches. The clock is the time of receipt, which never runs behind, so no envelope is
late to Spark and none is dropped; one that comes after a later one has gone is released with ``late``.

An account's order is sequential, so an account is one key, however many envelopes it has.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tessera.shipping import ship

#: Settings of a query with these operators.
STATE_CONF = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}
RELEASED = "seq long, at long, id string, late boolean, body string, tenant_id string, account_id string"
NAMES = [x.split()[0] for x in RELEASED.split(", ")]


class Release(StatefulProcessor):
    """The envelopes of one tenant's account that wait, and the last one that went."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, id string, received long, body string")
        self.last = handle.getValueState("last", "seq long, at long, id string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.hold([r for pdf in rows for r in zip(pdf["at"].tolist(), pdf["id"].tolist(), pdf["received"].tolist(), pdf["body"].tolist(), strict=True)])
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if out := self.due(key, timerValues.getCurrentWatermarkInMs()):
            yield pd.DataFrame(out, columns=NAMES)

    def hold(self, new: list[tuple]) -> None:
        self.waiting.appendList(new)
        # one timer for the first of them; what is left when it fires gets the next
        self.handle.registerTimer(min(r[2] for r in new))

    def before(self) -> tuple | None:
        """The last one that went."""
        return tuple(self.last.get()) if self.last.exists() else None

    def due(self, key, now: int) -> list[tuple]:
        """What has waited long enough, as rows of RELEASED; with each of them go all that stand before it."""
        waiting = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: r[:2])
        over = [i for i, r in enumerate(waiting) if r[2] <= now]
        if not over:
            return []
        go, rest = waiting[: over[-1] + 1], waiting[over[-1] + 1 :]
        seq, *before = self.before() or (0, None, None)
        out = []
        for at, id_, _, body in go:
            late = before[0] is not None and (at, id_) < tuple(before)
            seq, before = seq + 1, before if late else [at, id_]
            out.append((seq, at, id_, late, body, key[0], key[1]))
        self.last.update((seq, *before))
        self.waiting.put(rest) if rest else self.waiting.clear()
        if rest:
            self.handle.registerTimer(min(r[2] for r in rest))
        return out

    def close(self) -> None:
        pass


class ReleaseRows(Release):
    """As Release, by rows: an account has few at a time, and a data frame for each costs more than what is done to it."""

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        self.hold([(r["at"], r["id"], r["received"], r["body"]) for r in rows])
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        yield from (Row(*NAMES)(*r) for r in self.due(key, timerValues.getCurrentWatermarkInMs()))

    def before(self) -> tuple | None:
        return self.last.get()


def in_order(envelopes: DataFrame, hold: str = "1 hour") -> DataFrame:
    """(seq, at, id, late, body, tenant_id, account_id) of a stream of (tenant_id, account_id, at: microseconds, id,
    received_at, body): each (tenant_id, id) once within ``hold``, released when it has waited as long, in order of at and
    id within its account."""
    ship(envelopes.sparkSession)
    once = envelopes.withWatermark("received_at", hold).dropDuplicatesWithinWatermark(["tenant_id", "id"])
    # the clock goes on as a plain number, so that nothing after this counts as late
    # (and keys of the state are never null: none counts as empty)
    key = [F.coalesce(c, F.lit("")).alias(c) for c in ("tenant_id", "account_id")]
    rows = once.select(*key, F.coalesce("at", F.lit(0).cast("long")).alias("at"), F.coalesce("id", F.lit("")).alias("id"), F.unix_millis("received_at").alias("received"), "body")
    return rows.groupBy("tenant_id", "account_id").transformWithState(ReleaseRows(), RELEASED, "Append", "EventTime")


class Watch(StatefulProcessor):
    """One workflow: when it was started, until its result or its time is over."""

    def __init__(self, timeout: float):
        self.timeout = int(timeout * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", "ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        kinds = {k for pdf in rows for k in pdf["event"]}
        if self.until.exists():
            self.handle.deleteTimer(self.until.get()[0])
            self.until.clear()
        if "result" in kinds:
            yield self.row(key, "finished")
        elif "started" in kinds:
            until = timerValues.getCurrentProcessingTimeInMs() + self.timeout
            self.until.update((until,))
            self.handle.registerTimer(until)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.until.exists() and self.until.get()[0] <= expiredTimerInfo.getExpiryTimeInMs():
            self.until.clear()
            yield self.row(key, "timeout")

    def row(self, key, status: str) -> pd.DataFrame:
        return pd.DataFrame({"workflow_id": [key[0]], "status": [status]})

    def close(self) -> None:
        pass


def watched(events: DataFrame, timeout: float = 900.0) -> DataFrame:
    """(workflow_id, status) of a stream of (workflow_id, event: started or result): finished with its result, or timeout
    if none came in ``timeout`` seconds since it was last started; it can be started again after that. The clock goes on
    without data too, so an availableNow query over it ends only with noDataMicroBatches switched off."""
    ship(events.sparkSession)
    return events.select("workflow_id", "event").groupBy("workflow_id").transformWithStateInPandas(Watch(timeout), "workflow_id string, status string", "Append", "ProcessingTime")
