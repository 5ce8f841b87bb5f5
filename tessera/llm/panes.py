"""Hourly panes of a click stream with revisions: transformWithStateInPandas by (kind, hour) with event-time timers.

The clicks are written as numbered batches and fed in order to one streaming query, which is started anew for each batch
on one checkpoint. Spark's own watermark is the clock: with no delay it is the latest event time of the earlier batches.
A pane has two ValueStates, its current totals and those published last, and two timers: the grace timer emits the pane,
the close timer forgets it. Rows of a closed pane are written as they are. A sentinel row in the last batch, later than
every event, raises the watermark once more, so that the timers of all panes run out: what was not emitted is final.

Event times are shifted into the future by a fixed span, so that Spark's first watermark, 1970, is before all of them.

Rows of panes that are still open are summed in each input partition before the shuffle, so a hot pane sends a row a
partition; only rows of closed panes travel alone, dealt over lanes, as they need no state. Which panes are closed is
known when a batch starts, from the latest event time that the stream observed so far; the stateful operator judges
every row by the watermark itself and fails if the two ever differ.

Edge cases: rows without ts are dropped, and of the rows of one click_id the first counts (by event time, batch, cents,
kind); a null click_id is one id like any other (its crc32 is that of an empty text) and is -1 in ``late``; a null
arrived_at counts as ts; a null, not finite or missing value counts as 0; a batch or a table without rows still runs; a
total beyond a long is an error; other columns are not read.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tessera.llm.common import new_path
from tessera.shipping import ship

HOUR, DAY = 3_600_000_000, 86_400_000_000
#: Microseconds added to every event time; any date from year 1 to 9999, moved by as much, stays above 0 and below LAST.
SHIFT = 4_000_000 * DAY
LAST = 3 * SHIFT
#: Lanes over which the rows of closed panes are dealt.
LANES = 64
ROWS = "kind string, hour long, click_id long, cents long, at timestamp"
SENT = "kind string, hour long, lane int, click_id long, n_rows long, cents long"
OUT = "hour long, click_id long, n_rows long, cents long, record string, kind string"


def micros(time: Column) -> Column:
    """Microseconds since 1970 of a time without a zone."""
    return F.unix_date(time.cast("date")) * F.lit(DAY) + F.hour(time) * F.lit(HOUR) + F.minute(time) * F.lit(60_000_000).cast("long") + (F.extract(F.lit("SECOND"), time) * 1_000_000).cast("long")


def keyed(clicks: DataFrame, batches: int) -> DataFrame:
    """(batch, kind, hour, click_id, cents, at) of each click_id, ``at`` being the shifted event time."""
    day = F.unix_date(F.coalesce("arrived_at", "ts").cast("date"))
    q = F.pmod(day, F.lit(batches))
    delay = F.greatest(F.lit(0), F.crc32(F.coalesce(F.col("click_id").cast("string"), F.lit("")).cast("binary")) % 30 - 23)
    value = F.when(~F.isnan("value") & (F.abs("value") != float("inf")), F.col("value"))
    rows = clicks.where("ts is not null").select(
        "click_id", (micros(F.col("ts")) - (day - q) * F.lit(DAY)).alias("et"), F.least(F.lit(batches - 1), q + delay).cast("int").alias("batch"),
        F.coalesce(F.floor(F.lit(100) * value + 0.5), F.lit(0)).cast("long").alias("cents"), F.coalesce("kind", F.lit("none")).alias("kind"))
    first = rows.groupBy("click_id").agg(F.min(F.struct("et", "batch", "cents", "kind")).alias("r")).select("click_id", "r.*")
    return first.select("kind", F.expr(f"(et - pmod(et, {HOUR})) div {HOUR}").alias("hour"), "click_id", "cents", F.timestamp_micros(F.col("et") + F.lit(SHIFT)).alias("at"), "batch")


def with_ticks(rows: DataFrame, batches: int) -> DataFrame:
    """A row without a kind for each batch, so that each has a file; in the last one it is the sentinel, later than all
    events, in the others it is earlier."""
    n = F.col("id")
    ticks = rows.sparkSession.range(0, batches, 1, 1).select(F.lit(None).cast("string").alias("kind"), F.lit(None).cast("long").alias("hour"), F.lit(None).cast("long").alias("click_id"), F.lit(0).cast("long").alias("cents"), F.timestamp_micros(F.when(n == batches - 1, F.lit(LAST)).otherwise(0)).alias("at"), n.cast("int").alias("batch"))
    return rows.unionByName(ticks)


def ends(hour: int, after: int) -> int:
    """The shifted time in milliseconds at which an hour is over since ``after`` microseconds."""
    return ((hour + 1) * HOUR + after + SHIFT) // 1000


def bundled(stream: DataFrame, mark: int, close: int) -> DataFrame:
    """Each input partition's sums of the panes that are open at watermark ``mark`` (shifted milliseconds), and the rows
    of those that are closed; ticks end here."""
    # an hour h is closed when ends(h, close) <= mark
    closed_to = (mark * 1000 - SHIFT - close) // HOUR - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch]).filter(pc.is_valid(batch.column("kind")))
            alone = pc.less_equal(rows["hour"], closed_to)
            late = rows.filter(alone)
            if late.num_rows:
                lane = pc.cast(pc.add(pc.bit_wise_and(pc.fill_null(late["click_id"], 0), LANES - 1), 1), pa.int32())
                yield from pa.table([late["kind"], late["hour"], lane, late["click_id"], pa.array([1] * late.num_rows, pa.int64()), late["cents"]], NAMES).to_batches()
            rest = rows.filter(pc.invert(alone)).select(["kind", "hour", "cents"])
            some = summed(rest.append_column("n_rows", pa.array([1] * rest.num_rows, pa.int64())))
            held = some if held is None else summed(pa.concat_tables([held, some]))
            if held.num_rows > 100_000:  # bounded memory for any number of panes
                yield from sums(held)
                held = None
        if held is not None:
            yield from sums(held)

    ship(stream.sparkSession)
    return stream.mapInArrow(run, SENT)


NAMES = [x.split()[0] for x in SENT.split(", ")]


def summed(rows: pa.Table) -> pa.Table:
    out = rows.group_by(["kind", "hour"]).aggregate([("n_rows", "sum"), ("cents", "sum")])
    return pa.table([out["kind"], out["hour"], out["n_rows_sum"], out["cents_sum"]], ["kind", "hour", "n_rows", "cents"])


def sums(held: pa.Table) -> list[pa.RecordBatch]:
    n = held.num_rows
    return pa.table([held["kind"], held["hour"], pa.array([0] * n, pa.int32()), pa.array([None] * n, pa.int64()), held["n_rows"], held["cents"]], NAMES).to_batches()


class Panes(StatefulProcessor):
    """One pane: totals so far, totals published, a timer to emit and a timer to forget."""

    def __init__(self, grace: int, close: int):
        self.grace, self.close_after = grace, close

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.current = handle.getValueState("current", "n_rows long, cents long")
        self.published = handle.getValueState("published", "n_rows long, cents long")

    def row(self, key: tuple, record: str, totals: tuple) -> pd.DataFrame:
        return pd.DataFrame({"hour": [key[1]], "click_id": [-1], "n_rows": [totals[0]], "cents": [totals[1]], "record": [record], "kind": [key[0]]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        kind, hour, lane = key
        closed = timerValues.getCurrentWatermarkInMs() >= ends(hour, self.close_after)
        if closed != (lane > 0):
            raise ValueError(f"the watermark {timerValues.getCurrentWatermarkInMs()} differs from the one that the batch was started with")
        if closed:
            for pdf in rows:
                yield pd.DataFrame({"hour": hour, "click_id": pdf["click_id"].fillna(-1).astype("int64"), "n_rows": pdf["n_rows"], "cents": pdf["cents"], "record": "late", "kind": kind})
            return
        n, cents = 0, 0
        for pdf in rows:
            n, cents = n + int(pdf["n_rows"].sum()), cents + sum(int(x) for x in pdf["cents"])
        if self.current.exists():
            before = tuple(self.current.get())
            n, cents = n + before[0], cents + before[1]
        else:
            self.handle.registerTimer(ends(hour, self.grace))
            self.handle.registerTimer(ends(hour, self.close_after))
        self.current.update((n, cents))
        if self.published.exists():
            yield self.row(key, "retract", tuple(self.published.get()))
            self.published.update((n, cents))
            yield self.row(key, "replace", (n, cents))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        hour, mark = key[1], timerValues.getCurrentWatermarkInMs()
        if not self.published.exists():
            totals = tuple(self.current.get())
            self.published.update(totals)
            yield self.row(key, "final" if mark >= LAST // 1000 else "emit", totals)
        if expiredTimerInfo.getExpiryTimeInMs() >= ends(hour, self.close_after):
            self.current.clear()
            self.published.clear()

    def close(self) -> None:
        pass


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings for what is started within; what they were is set again."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def revisions(clicks: DataFrame, batches: int = 8, grace: int = 6 * HOUR, close: int = 4 * DAY) -> DataFrame:
    """(batch, hour, click_id, n_rows, cents, record, kind): what the stream writes, batch by batch."""
    spark = clicks.sparkSession
    root = new_path(spark, "panes")
    with_ticks(keyed(clicks, batches), batches).repartition("batch", F.pmod(F.xxhash64("click_id"), F.lit(16))).write.partitionBy("batch").parquet(f"{root}/batches")
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(fs_path(f"{root}/in"))
    ship(spark)
    mark = 0
    for number in range(batches):
        # the batch's folder moves whole to where the stream looks for new files
        if not fs.rename(fs_path(f"{root}/batches/batch={number}"), fs_path(f"{root}/in/{number}")):
            raise OSError(f"batch {number} cannot be moved in {root}")
        mark = max(mark, run_batch(spark, root, number, mark, number == batches - 1, grace, close))
    return spark.read.schema(f"{OUT}, batch long").parquet(f"{root}/out").select("batch", *[x.split()[0] for x in OUT.split(", ")])


def run_batch(spark: SparkSession, root: str, number: int, mark: int, last: bool, grace: int, close: int) -> int:
    """Start the query on what is new in the folder, wait for it, and return the latest event time that it saw, in
    shifted milliseconds. Only the last start goes on without data, for the sentinel."""
    # many small stores: none takes disk ahead of its need, and those of earlier starts are closed soon
    store = "spark.sql.streaming.stateStore"
    conf = {f"{store}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", f"{store}.rocksdb.allowFAllocate": "false", f"{store}.maintenanceInterval": "2s", "spark.sql.streaming.noDataMicroBatches.enabled": str(last).lower()}
    with settings(spark, conf):
        new = spark.readStream.schema(ROWS).parquet(f"{root}/in/*").withWatermark("at", "0 seconds").observe("seen", F.max(F.unix_millis("at")).alias("at"))
        panes = bundled(new, mark, close).groupBy("kind", "hour", "lane").transformWithStateInPandas(Panes(grace, close), OUT, "Append", "EventTime")
        query = panes.withColumn("batch", F.lit(number).cast("long")).writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    seen = [p.observedMetrics["seen"]["at"] for p in query.recentProgress if "seen" in p.observedMetrics]
    return max([0, *(x for x in seen if x is not None)])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revisions(spark.read.parquet(f"{sf_dir}/clicks.parquet"))
