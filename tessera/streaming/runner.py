"""Envelope streams: every micro-batch is parsed once, deduplicated and merged into the interactions, and both pipelines
run over it."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import schemas as S
from tessera.operators.upsert import one_row, upsert
from tessera.plans.deals import run_deals
from tessera.plans.pipelines import run_items
from tessera.sources.envelopes import checked, dispatch, event_filter, to_interaction

KEY = ["tenant_id", "interaction_id"]


class SnapshotTable:
    """A table as numbered directories under one path; the newest complete one is current, so a reader never sees a
    half-written state. A directory's name ends in the writer's tag: a write with the newest one's tag is a replay and
    takes its place, any other goes on from it."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _fs(self):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def snapshots(self) -> list[tuple[int, str]]:
        """(number, tag) of the complete ones, ascending."""
        fs, p = self._fs()
        if not fs.exists(p):
            return []
        done = self.spark._jvm.org.apache.hadoop.fs.Path
        names = [(s.getPath().getName().partition("-"), s.getPath().toString()) for s in fs.listStatus(p)]
        return sorted((int(n), tag) for (n, _, tag), path in names if n.isdigit() and fs.exists(done(f"{path}/_SUCCESS")))

    def read(self, tag: str | None = None) -> DataFrame:
        """The current state; with a ``tag``, the state that a write with this tag starts from."""
        found = [x for x in self.snapshots() if tag is None or x[1] != tag]
        if not found:
            return self.spark.createDataFrame([], S.struct(self.schema))
        return self.spark.read.schema(S.struct(self.schema)).parquet(f"{self.path}/{found[-1][0]}-{found[-1][1]}")

    def write(self, df: DataFrame, tag: str, keep: int = 3) -> None:
        last, newest = (self.snapshots() or [(-1, None)])[-1]
        df.write.mode("overwrite").parquet(f"{self.path}/{last if newest == tag else last + 1}-{tag}")
        fs, _ = self._fs()
        for n, old in self.snapshots()[:-keep]:
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}-{old}"), True)


class BucketTable:
    """A table cut into buckets by the hash of its key. A write makes a directory of the buckets that it touches and a
    manifest that tells, for every bucket, which directory holds it; the newest manifest is current, so a small batch
    rewrites a small part and a reader never sees a half-written state. Manifests are named by number and the writer's
    tag: a write with the newest one's tag is a replay and takes its place, any other goes on from it."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int = 64):
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path.rstrip("/"), schema, keys, buckets

    def _at(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def snapshots(self) -> list[tuple[int, str]]:
        """(number, tag) of the manifests, ascending."""
        fs, p = self._at("_manifests")
        if not fs.exists(p):
            return []
        names = [x.getPath().getName().removesuffix(".json").partition("-") for x in fs.listStatus(p) if x.getPath().getName().endswith(".json")]
        return sorted((int(n), tag) for n, _, tag in names if n.isdigit())

    def _manifest(self, snapshot: tuple[int, str]) -> dict[str, str]:
        row = self.spark.read.text(f"{self.path}/_manifests/{snapshot[0]}-{snapshot[1]}.json", wholetext=True).first()
        return json.loads(row[0])

    def _before(self, tag: str | None) -> dict[str, str]:
        found = [x for x in self.snapshots() if tag is None or x[1] != tag]
        return self._manifest(found[-1]) if found else {}

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def read(self, tag: str | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The current state, or some buckets of it; with a ``tag``, the state that a write with this tag starts from."""
        held = {b: d for b, d in self._before(tag).items() if buckets is None or int(b) in buckets}
        if not held:
            return self.spark.createDataFrame([], S.struct(self.schema))
        return self.spark.read.schema(S.struct(self.schema)).parquet(*[f"{self.path}/{d}/bucket={b}" for b, d in sorted(held.items())])

    def merge(self, new: DataFrame, tag: str, step: Callable[[DataFrame, DataFrame], DataFrame], keep: int = 3) -> None:
        """Write ``step(state, new)`` for the buckets that ``new`` touches; others stay as they are."""
        rows = new.withColumn("bucket", self.bucket()).persist(StorageLevel.DISK_ONLY)
        touched = sorted(r["bucket"] for r in rows.select("bucket").distinct().collect())
        last, newest = (self.snapshots() or [(-1, None)])[-1]
        number, before = last if newest == tag else last + 1, self._before(tag)
        if touched:
            out = step(self.read(tag, touched), rows.drop("bucket"))
            folder = f"{number}-{tag}-{uuid.uuid4().hex[:8]}"
            out.withColumn("bucket", self.bucket()).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
            before = before | {str(b): folder for b in touched}
        rows.unpersist()
        fs, p = self._at(f"_manifests/{number}-{tag}.json")
        _, temporary = self._at(f"_manifests/.{number}-{tag}")
        data = fs.create(temporary, True)
        data.write(bytearray(json.dumps(before).encode()))
        data.close()
        if fs.exists(p):
            fs.delete(p, False)
        fs.rename(temporary, p)
        self._clean(keep)

    def _clean(self, keep: int) -> None:
        """Drop manifests but the last ``keep``, and directories that none of those names."""
        found = self.snapshots()
        for n, tag in found[:-keep]:
            fs, p = self._at(f"_manifests/{n}-{tag}.json")
            fs.delete(p, False)
        used = {d for x in found[-keep:] for d in self._manifest(x).values()}
        fs, p = self._at("")
        for x in fs.listStatus(p):
            if (name := x.getPath().getName())[0] != "_" and name not in used:
                fs.delete(x.getPath(), True)


def batch_tag(batch: DataFrame, number: int) -> str:
    """The query's id, which lasts as long as its checkpoint, and the batch's number."""
    return f"{batch.sparkSession.sparkContext.getLocalProperty('sql.streaming.queryId')}-{number}"


def merge_interactions(table: BucketTable, rejects: str | None = None, sources: list[str] | None = None, then: Callable[[DataFrame, str], None] | None = None) -> Callable[[DataFrame, int], None]:
    """The foreachBatch function. Records are parsed once a batch; those of other event sources than ``sources`` are
    passed over. Running a batch again gives the same table, and a new query goes on from what others left. ``then``
    gets the batch's good envelopes and its tag after the interactions are written."""

    def step(batch: DataFrame, number: int) -> None:
        tag = batch_tag(batch, number)
        rows = checked(batch).persist(StorageLevel.DISK_ONLY)
        good = rows.where("reason is null").drop("reason", "body")
        if sources is not None:
            good = event_filter(good, sources)
        new = one_row(to_interaction(good), KEY, F.struct("timestamp", F.xxhash64("content_text")))
        table.merge(new, tag, lambda state, new: upsert(state, new, KEY, update=[], fill=["title", "content_text", "trace_id", "account_id"]))
        if rejects:
            rows.where("reason is not null").select(F.col("body").alias("record"), "reason").write.mode("overwrite").json(f"{rejects}/{tag}")
        if then is not None:
            then(good, tag)
        rows.unpersist()

    return step


@dataclass
class Models:
    """What models decide, as functions of a batch's envelopes: tables of extracted items and deals, verdicts and match
    decisions. Any of them may be a join with a table that was made before, or a call of a service."""

    items: Callable[[DataFrame], DataFrame]
    verdicts: Callable[[DataFrame], DataFrame]
    deals: Callable[[DataFrame], DataFrame]
    decisions: Callable[[DataFrame], DataFrame]
    owners: Callable[[DataFrame], DataFrame]


def workflows_step(tables: dict[str, SnapshotTable], models: Models, now, told: Callable[[str, dict], None] | None = None) -> Callable[[DataFrame, str], None]:
    """Both pipelines over a batch's envelopes, each for itself: a failure of one is told and leaves the other's writes;
    without ``told`` it fails the batch, which is repeated. For tries, receives and dead letters see ``durable``.
    Batches come in order, and within a batch the deals of an account are taken in their time, so an account's
    envelopes take effect in order. ``tables`` has action_item, action_item_version, deal and deal_version."""

    def write(tag: str, **frames: DataFrame) -> None:
        # what is read is an older directory than the one written, so no table is read while it is replaced
        for name, df in frames.items():
            tables[name].write(df, tag)

    def items(envelopes: DataFrame, tag: str) -> None:
        state, versions = (tables[n].read(tag) for n in ("action_item", "action_item_version"))
        out = run_items(models.items(envelopes), models.verdicts(envelopes), models.owners(envelopes), state, versions, models.decisions(envelopes), now)
        write(tag, action_item=out.items, action_item_version=out.versions)
        out.release()

    def deals(envelopes: DataFrame, tag: str) -> None:
        state, versions = (tables[n].read(tag) for n in ("deal", "deal_version"))
        out = run_deals(models.deals(envelopes), state, versions, models.decisions(envelopes), now)
        write(tag, deal=out.deals, deal_version=out.versions)
        out.release()

    def step(envelopes: DataFrame, tag: str) -> None:
        found = dispatch(envelopes, {"items": lambda e: items(e, tag), "deals": lambda e: deals(e, tag)})
        if told is not None:
            told(tag, found)
        elif not found["summary"]["both"]:
            # nobody hears of the failure: the batch must not count as done
            raise RuntimeError("; ".join(f"{n}: {x['error']}" for n, x in found.items() if n != "summary" and x["error"]))

    return step


def stream(spark: SparkSession, source: str, checkpoint: str, step: Callable[[DataFrame, int], None], files: int = 1):
    """Start the query over a folder of record lines; stops when all files are done."""
    lines = spark.readStream.option("maxFilesPerTrigger", files).text(source).withColumnRenamed("value", "body")
    return lines.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, watermark: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Event counts and sums by type in tumbling windows (an extension)."""
    counts = events.withWatermark("ts", watermark) if events.isStreaming else events
    return counts.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
