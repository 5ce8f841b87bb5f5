import json
import os
import sqlite3

import pytest
from helpers import same
from pyspark.sql import functions as F

from tessera.functions.models import answers, ask, extraction
from tessera.operators import figures as R
from tessera.plans import service_queries
from tessera.sources import formats, layout


@pytest.mark.parametrize("name", sorted(service_queries.ORACLES))
def test_query_agrees_with_sql(spark, sf_dir, name):
    assert same(service_queries.QUERIES[name](spark, sf_dir), service_queries.ORACLES[name], sf_dir) == ""


# model calls


class Fake:
    """Fails twice, then answers backwards; a poison text fails the call it is in."""

    def __init__(self, fails=2):
        self.fails, self.calls = fails, []

    def __call__(self, texts):
        self.calls.append(list(texts))
        if len(self.calls) <= self.fails:
            raise TimeoutError("busy")
        if "poison" in texts:
            raise ValueError("poison")
        return [(n, texts[n].upper()) for n in reversed(range(len(texts)))]


def test_answers_are_in_order_and_calls_are_counted():
    client, slept = Fake(), []
    assert answers(client, ["a", "b", "c"], sleep=slept.append) == [("A", None), ("B", None), ("C", None)]
    assert len(client.calls) == 3 and slept == [0.5, 1.0]
    assert answers(Fake(0), [], sleep=slept.append) == []


def test_only_the_poison_text_fails():
    for place in range(5):
        texts = [f"t{i}" for i in range(5)]
        texts[place] = "poison"
        assert answers(Fake(0), texts, sleep=lambda _: None) == [(None, "poison") if t == "poison" else (t.upper(), None) for t in texts]


def test_a_partial_answer_is_asked_for_the_rest_only():
    seen = []

    def client(texts):
        seen.append(list(texts))
        return [(0, texts[0])]

    assert answers(client, ["a", "b", "c"], sleep=lambda _: None) == [("a", None), ("b", None), ("c", None)]
    assert seen == [["a", "b", "c"], ["b", "c"], ["c"]]


def test_ask_keeps_every_row(spark, tmp_path):
    """Null and blank texts, repeated texts, columns of other types; one client a task, equal texts asked once."""
    log = str(tmp_path)

    class Counted:
        def __call__(self, texts):
            with open(f"{log}/{os.getpid()}", "a") as f:
                f.write("".join(t + "\n" for t in texts))
            return [(n, [float(len(t))]) for n, t in enumerate(texts)]

    df = spark.createDataFrame([(1, "abc", None), (2, None, 5), (3, " ", 6), (4, "abc", None), (5, "poison", 7), (None, "x" * 100_000, 8)], "id long, text string, extra int").coalesce(1)
    got = {r["id"]: (r["extra"], r["answer"], r["error"]) for r in ask(df, "text", Counted, "array<double>").collect()}
    assert got == {1: (None, [3.0], None), 2: (5, None, None), 3: (6, None, None), 4: (None, [3.0], None), 5: (7, [6.0], None), None: (8, [100000.0], None)}
    asked = [t for n in os.listdir(log) for t in open(f"{log}/{n}").read().split()]
    assert sorted(map(len, asked)) == [3, 6, 100_000]
    assert ask(df.limit(0), "text", Counted, "string").count() == 0
    with pytest.raises(ValueError):
        ask(df.withColumn("error", F.lit(1)), "text", Counted, "string")


def test_extraction_makes_rows(spark):
    class Split:
        def __call__(self, texts):
            if "poison" in texts:
                raise ValueError("poison")
            return [(n, t.split(",") if t != "none" else []) for n, t in reversed(list(enumerate(texts)))]

    spark.udtf.register("split_items", extraction(Split, batch=2, pause=0.0))
    texts = spark.createDataFrame([("1", "a,b"), ("2", "none"), ("3", "poison"), ("4", None), ("5", "c")], "id string, text string")
    got = sorted(map(tuple, spark.sql("SELECT * FROM split_items(TABLE({t}))", t=texts).collect()), key=repr)
    assert got == [("1", 0, "a", None), ("1", 1, "b", None), ("3", None, None, "poison"), ("5", 0, "c", None)]


# data sources


def test_sqlite_in_ranges(spark, tmp_path):
    formats.register(spark)
    for n in range(2):
        with sqlite3.connect(tmp_path / f"{n}.db") as con:
            con.execute('CREATE TABLE "odd ""name" (id INTEGER PRIMARY KEY, x REAL, t TEXT)')
            con.executemany('INSERT INTO "odd ""name" VALUES (?, ?, ?)', [(i * 3 + 1, None if i % 5 == 0 else i / 2, f"t{i}" if i % 7 else None) for i in range(n * 10, n * 10 + 40)])
    df = spark.read.format("tessera_sqlite").option("table", 'odd "name').option("rows", 17).load(str(tmp_path))
    assert df.dtypes == [("id", "bigint"), ("x", "double"), ("t", "string")] and df.rdd.getNumPartitions() == 14
    want = sorted((i * 3 + 1, None if i % 5 == 0 else i / 2, f"t{i}" if i % 7 else None) for n in range(2) for i in range(n * 10, n * 10 + 40))
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(want, key=repr)
    assert [r["t"] for r in df.where("id = 4").select("t").collect()] == ["t1"]
    with sqlite3.connect(tmp_path / "e" if (tmp_path / "e").mkdir() else tmp_path / "e" / "e.db") as con:
        con.execute("CREATE TABLE none (a INT)")
    assert spark.read.format("tessera_sqlite").option("table", "none").load(str(tmp_path / "e" / "e.db")).count() == 0


def test_queue_goes_on_where_it_stopped(spark, tmp_path):
    formats.register(spark)
    root = tmp_path / "q"
    root.mkdir()

    def run():
        stream = spark.readStream.format("tessera_queue").option("files", 2).load(str(root))
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).start().processAllAvailable()
        for q in spark.streams.active:
            q.stop()
        return sorted((r["file"], r["line"], r["body"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    def put(name, *bodies):
        formats.put(f"{root}/{name}", "\n".join(bodies))

    put("001.jsonl", "a", "", "b")
    put("002.jsonl")
    put("003.jsonl", "c")
    first = [("001.jsonl", 0, "a"), ("001.jsonl", 2, "b"), ("003.jsonl", 0, "c")]
    assert run() == first and run() == first
    put("004.jsonl", "d")
    assert run() == [*first, ("004.jsonl", 0, "d")]
    assert spark.read.format("tessera_queue").load(str(root)).count() == 4


def test_events_are_told_once(spark, tmp_path):
    """What an attempt left behind is not read; a failed job tells nothing; a batch made again replaces itself."""
    formats.register(spark)
    path = str(tmp_path / "e")
    df = spark.createDataFrame([("k1", "v\n1"), ("k2", None), (None, "v3")], "key string, value string").repartition(3)
    df.write.format("tessera_events").mode("append").save(path)
    formats.EventWriter(path, ["key", "value"]).write(iter([{"key": "lost", "value": "attempt"}]))
    read = lambda: sorted(map(tuple, spark.read.format("tessera_events").load(path).collect()), key=repr)
    want = sorted([("k1", "v\n1"), ("k2", None), (None, "v3")], key=repr)
    assert read() == want
    bad = df.withColumn("key", F.when(F.col("key") == "k2", F.raise_error(F.lit("no"))).otherwise(F.col("key")))
    with pytest.raises(Exception, match="no"):
        bad.write.format("tessera_events").mode("append").save(path)
    assert read() == want
    for body in ("old", "new"):
        writer = formats.EventStream(path, ["key", "value"])
        writer.commit([writer.write(iter([{"key": "s", "value": body}]))], 7)
    assert read() == sorted([*want, ("s", "new")], key=repr)
    empty = str(tmp_path / "none")
    df.limit(0).write.format("tessera_events").mode("append").save(empty)
    assert spark.read.format("tessera_events").load(empty).count() == 0


# figures and layout


def test_figures_take_one_job(spark, tmp_path):
    rows = spark.range(1000).select(F.col("id"), F.when(F.col("id") % 4 == 0, "open").when(F.col("id") % 4 == 1, "done").when(F.col("id") % 4 == 2, "x").alias("status"))
    spark.sparkContext.setJobGroup("figures", "figures")
    seen = R.measured(rows, lambda df: df.write.parquet(str(tmp_path / "o")), R.by_value(F.col("status"), ["open", "done"]) | {"n": F.count(F.lit(1))})
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("figures")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert (seen["open"], seen["done"], seen["other"], seen["n"]) == (250, 250, 500, 1000) and seen["seconds"] > 0 and len(jobs) == 1


def test_batches_of_a_stream_are_measured(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    heard = R.BatchFigures()
    spark.streams.addListener(heard)
    try:
        for n in range(2):
            (source / f"{n}.json").write_text("".join(json.dumps({"v": v}) + "\n" for v in range(3 + n)))
        stream = spark.readStream.schema("v long").option("maxFilesPerTrigger", 1).json(str(source)).observe("sums", F.sum("v").alias("total"))
        query = stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
        for _ in range(100):
            if str(query.id) in heard.ended:
                break
            __import__("time").sleep(0.1)
        rows = [b for b in heard.batches[str(query.id)] if b["rows"]]
        assert sorted((b["rows"], b["observed"]["sums"]["total"]) for b in rows) == [(3, 3), (4, 6)]
        assert heard.table(spark).where("rows > 0").count() == 2 and heard.ended[str(query.id)] is None
    finally:
        spark.streams.removeListener(heard)


def test_pending_lists_need_no_exchange_of_items(spark):
    """Neither the top list nor a join with accounts that are bucketed alike moves a row."""
    items = spark.range(5000).select((F.col("id") % 3).cast("string").alias("tenant_id"), (F.col("id") % 50).cast("string").alias("account_id"), F.col("id").alias("item_id"), (F.col("id") % 97 / 97).alias("priority_score"), F.when(F.col("id") % 2 == 0, "open").otherwise("completed").alias("status"))
    accounts = items.select("tenant_id", "account_id").distinct().withColumns({"name": F.lit("n"), "status": F.lit("open")})
    for name, df in (("pending_t", items), ("accounts_t", accounts)):
        layout.write_pending(df, name, 4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lists = layout.pending(spark, "pending_t", [F.desc("priority_score"), F.asc("item_id")], 3)
        both = lists.join(spark.table("accounts_t").drop("status"), layout.KEYS)
        for df in (lists, both):
            assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
        want = {}
        for r in items.where("status = 'open'").collect():
            want.setdefault((r["tenant_id"], r["account_id"]), []).append((-r["priority_score"], r["item_id"]))
        assert sorted(r["item_id"] for r in both.collect()) == sorted(i for v in want.values() for _, i in sorted(v)[:3])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        for name in ("pending_t", "accounts_t"):
            spark.sql(f"DROP TABLE {name}")
