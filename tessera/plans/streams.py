"""Registered queries of the stream's parts: ordered release, durable steps, published tables; and writes that are made
twice. Beside each the SQL that says the same of the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import schemas as S
from tessera.plans import catalog
from tessera.plans import deals as D
from tessera.scratch import folder, settings
from tessera.streaming.ordered import STATE_CONF, in_order
from tessera.streaming.steps import Step, StepLog, execute
from tessera.streaming.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


#: Starts of the query over the events, each after a part of them has come.
SLICES = 3
ENVELOPE = "tenant_id string, account_id string, at long, id string, received_at timestamp, body string"


@query("SELECT event_type AS tenant_id, user_id::VARCHAR AS account_id, event_id::VARCHAR AS id, row_number() OVER (PARTITION BY event_type, user_id ORDER BY epoch_us(ts::TIMESTAMP), event_id::VARCHAR) AS seq, false AS late, props AS body FROM events")
def str_ordered_release(spark, sf):
    """Events as envelopes that come up to an hour out of order, a tenth of them twice, in parts with a start each: once
    each, and in order within tenant and account."""
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    at, n = F.unix_micros("ts"), F.col("event_id")
    rows = events.select(F.col("event_type").alias("tenant_id"), F.col("user_id").cast("string").alias("account_id"), at.alias("at"), n.cast("string").alias("id"), F.explode(F.when(n % 10 == 0, F.array(F.lit(0), F.lit(20))).otherwise(F.array(F.lit(0)))).alias("again"), (n % 7 * 10).alias("delay"), F.col("props").alias("body"))
    rows = rows.withColumn("received_at", F.timestamp_micros(F.col("at") + (F.col("delay") + F.col("again")) * 60_000_000))
    first, last = rows.agg(F.min("received_at"), F.max("received_at")).first()
    names = [f.name for f in S.struct(ENVELOPE)]
    span = F.lit(last).cast("double") - F.lit(first).cast("double")
    part = F.least(F.lit(SLICES - 1), F.floor((F.col("received_at").cast("double") - F.lit(first).cast("double")) * SLICES / F.greatest(span, F.lit(1.0)))).cast("int")
    # a day later one more, of no account: what waits has waited long enough
    end = spark.range(1).select(*[(F.lit(last) + F.expr("interval 1 day") if c == "received_at" else F.lit(None)).cast(f.dataType).alias(c) for c, f in ((f.name, f) for f in S.struct(ENVELOPE))], F.lit(SLICES - 1).alias("part"))
    root = folder(spark, "ordered")
    rows.select(*names, part.alias("part")).unionByName(end).write.partitionBy("part").parquet(f"{root}/parts")
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path(f"{root}/in"))
    for number in range(SLICES):
        fs.rename(path(f"{root}/parts/part={number}"), path(f"{root}/in/{number}"))
        with settings(spark, STATE_CONF | {"spark.sql.streaming.noDataMicroBatches.enabled": str(number == SLICES - 1).lower()}):
            released = in_order(spark.readStream.schema(ENVELOPE).parquet(f"{root}/in/*"), "2 hours")
            released.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema("seq long, late boolean, id string, body string, tenant_id string, account_id string").parquet(f"{root}/out")
    return out.where("tenant_id != ''").select("tenant_id", "account_id", "id", "seq", "late", "body")


@query("""WITH o AS (SELECT o_orderkey % 50 AS k, o_orderkey % 7 AS m FROM orders), e AS (
SELECT 'extract' AS step, 1 AS attempt, CASE WHEN k > 1 THEN 'done' ELSE 'failed' END AS status FROM o
UNION ALL SELECT 'extract', 2, 'failed' FROM o WHERE k <= 1
UNION ALL SELECT 'extract', 3, CASE WHEN k = 1 THEN 'done' ELSE 'failed' END FROM o WHERE k <= 1
UNION ALL SELECT 'verify', 1, CASE WHEN m = 0 THEN 'skipped' ELSE 'done' END FROM o WHERE k > 0
UNION ALL SELECT 'persist', 1, 'done' FROM o WHERE k > 0)
SELECT step, attempt, status, count(*) AS workflows, (SELECT count(*) FROM o WHERE k > 0) AS finished, (SELECT count(*) FROM o WHERE k = 0) AS failed FROM e GROUP BY 1, 2, 3""")
def c3_durable_steps(spark, sf):
    """Orders as workflows of three steps: some fail twice and then succeed, some fail for good, a fail-open step goes on;
    the run is started twice, and the second time nothing runs."""
    flows = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").cast("string").alias("workflow_id"), "o_orderkey", "o_totalprice")
    calls: list[int] = []

    def extract(todo, read):
        calls.append(1)
        bad = (F.col("o_orderkey") % 50 == 0) | ((F.col("o_orderkey") % 50 == 1) & F.lit(len(calls) < 3))
        return todo.select("workflow_id", F.col("o_totalprice").alias("price"), F.when(bad, "no answer").alias("error"))

    verify = lambda todo, read: todo.select("workflow_id", F.lit(True).alias("fine"), F.when(F.col("o_orderkey") % 7 == 0, "no verdict").alias("error"))
    persist = lambda todo, read: read("extract").join(todo.select("workflow_id"), "workflow_id", "left_semi")
    steps = [Step("extract", extract, "price double"), Step("verify", verify, "fine boolean", fail_open=True), Step("persist", persist, "price double")]
    root = folder(spark, "steps")
    log = StepLog(spark, root, "run")
    for _ in range(2):
        finished, failed = execute(log, flows, steps, sleep=lambda s: None)
    rows = log.rows("extract").select(F.lit("extract").alias("step"), "attempt", "status")
    for name in ("verify", "persist"):
        rows = rows.unionByName(log.rows(name).select(F.lit(name).alias("step"), "attempt", "status"))
    counts = finished.agg(F.count("*").alias("finished")).crossJoin(failed.agg(F.count("*").alias("failed")))  # one row each
    return rows.groupBy("step", "attempt", "status").agg(F.count("*").alias("workflows")).crossJoin(F.broadcast(counts))


@query("SELECT c_nationkey::VARCHAR AS tenant_id, c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN -1.0 ELSE c_acctbal END AS v, 1 + (c_custkey % 3 = 0)::INT AS history FROM customer")
def s10_published_tables(spark, sf):
    """Three batches over two tables: all customers, every third one again, and one that fails after its first table; then
    the whole state is written as one batch."""
    c = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_nationkey").cast("string").alias("tenant_id"), F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    tables = Tables(spark, folder(spark, "tables"), {"state": "tenant_id string, k long, v double", "history": "tenant_id string, k long, tag string"}, {"state": ["tenant_id", "k"], "history": ["tenant_id", "k", "tag"]})
    for tag, rows, whole in (("one", c, True), ("two", c.where("k % 3 = 0").withColumn("v", F.lit(-1.0)), True), ("three", c.where("k % 5 = 0").withColumn("v", F.lit(-2.0)), False)):
        batch = tables.begin(tag)
        batch.write("state", rows)
        if whole:
            batch.write("history", rows.select("tenant_id", "k", F.lit(tag).alias("tag")))
            batch.commit()
    tables.compact()
    history = tables.read("history").groupBy("tenant_id", "k").agg(F.count("*").cast("int").alias("history"))
    return tables.read("state").join(history, ["tenant_id", "k"]).select("tenant_id", "k", "v", "history")


@query("""WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos FROM orders),
l AS (SELECT o_custkey AS topic_id, o_orderkey AS item, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderpriority END AS summary, pos FROM o WHERE pos > 1),
told AS (SELECT *, coalesce(lag(summary) OVER (PARTITION BY topic_id ORDER BY pos), 'start') AS before FROM l WHERE summary IS NOT NULL),
ch AS (SELECT * FROM told WHERE summary <> before)
SELECT o_custkey::VARCHAR AS topic, count(*) AS members, 1 + count(ch.item) AS version, coalesce(arg_max(ch.summary, ch.pos), 'start') AS summary, 1 + count(ch.item) AS versions, coalesce(string_agg(ch.before, '|' ORDER BY ch.pos), '') AS snapshots FROM o LEFT JOIN ch ON ch.topic_id = o_custkey AND ch.item = o_orderkey GROUP BY 1""")
def w9_topics_retry(spark, sf):
    """The same resolutions executed twice write what they write once."""
    return catalog.topic_runs(spark, sf, again=True)


@query("""WITH x AS (SELECT 't' || o_custkey % 2 AS tenant_id, o_custkey::VARCHAR AS account_id, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey END AS interaction, i, CASE WHEN o_orderkey % 5 > 0 THEN o_orderpriority ELSE 'same' END AS name, CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE i END AS v FROM orders, (VALUES (0), (1)) r(i))
SELECT tenant_id, account_id, count(DISTINCT (coalesce(interaction, -1), name, v)) AS deals FROM x GROUP BY 1, 2""")
def w19_deal_identity(spark, sf):
    """Two tenants, two extractions an interaction that differ in nothing or in the embedding alone, equal ones of many
    accounts without an interaction: deals that differ are told apart, equal ones of an account count once."""
    o = spark.read.parquet(f"{sf}/orders.parquet")
    k, i = F.col("o_orderkey"), F.col("i")
    given = {"tenant_id": F.concat(F.lit("t"), F.col("o_custkey") % 2), "account_id": F.col("o_custkey").cast("string"), "interaction_id": F.when(k % 5 > 0, k.cast("string")), "deal_idx": i, "name": F.when(k % 5 > 0, F.col("o_orderpriority")).otherwise("same"), "confidence": F.lit(0.5), "embedding": F.array(F.when(k % 2 == 0, 0).otherwise(i))}
    rows = o.withColumn("i", F.explode(F.array(F.lit(0), F.lit(1)))).select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in S.struct(D.EXTRACTED)])
    return D.prepared(rows).groupBy("tenant_id", "account_id").agg(F.count("*").alias("deals"))
