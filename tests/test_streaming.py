import json

from pyspark.sql import functions as F

from tessera import schemas as S
from tessera.plans import deals as D
from tessera.sources.envelopes import bootstrap, by_manifest, clean_url, dispatch, extras, healthy, missing, parse_records, read_envelopes, read_jdbc, read_transcripts, rejected_duplicates, text_envelopes, validate, write_jdbc
from tessera.streaming.runner import KEY, BucketTable, Models, SnapshotTable, merge_interactions, stream, workflows_step


def record(i, account="a", **more):
    detail = {"tenant_id": "t", "user_id": "u", "interaction_type": "note", "content": {"text": f"text {i}", "format": "plain"}, "timestamp": "2024-01-01T00:00:00Z", "source": "api", "interaction_id": f"i{i}", "account_id": account} | more
    return json.dumps({"version": "0", "id": "1", "detail-type": "EnvelopeV1.note", "source": "x", "detail": detail})


def test_stream_and_replay(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.txt").write_text("\n".join([record(1), record(2), "{bad", '{"id": 1}']))
    (src / "2.txt").write_text("\n".join([record(2), record(3), record(4, account="")]))
    table = BucketTable(spark, str(tmp_path / "state"), S.TABLES["interaction"], KEY, buckets=4)
    stream(spark, str(src), str(tmp_path / "cp"), merge_interactions(table, str(tmp_path / "rejects"))).awaitTermination()
    assert sorted(r["interaction_id"] for r in table.read().collect()) == ["i1", "i2", "i3"]
    reasons = [json.loads(x)["reason"] for f in (tmp_path / "rejects").rglob("*.json") for x in f.read_text().splitlines()]
    assert sorted(reasons) == ["invalid JSON", "missing account_id", "missing detail"]
    # the same files once more, as a new stream over the same state
    stream(spark, str(src), str(tmp_path / "cp2"), merge_interactions(table)).awaitTermination()
    assert table.read().count() == 3
    # other files, as a new stream whose batches count from 0 again: what was there stays
    (tmp_path / "more").mkdir()
    (tmp_path / "more" / "1.txt").write_text(record(5))
    stream(spark, str(tmp_path / "more"), str(tmp_path / "cp3"), merge_interactions(table)).awaitTermination()
    assert sorted(r["interaction_id"] for r in table.read().collect()) == ["i1", "i2", "i3", "i5"]
    assert all(tag.rpartition("-")[0] not in ("", "None") for _, tag in table.snapshots())


def test_replayed_batch_takes_its_own_place(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "state"), "k string, v int")
    one, two = (spark.createDataFrame([("k", n)], "k string, v int") for n in (1, 2))
    table.write(one, "q-0")
    table.write(one.union(two), "q-1")
    assert table.read("q-1").count() == 1
    table.write(table.read("q-1").union(two), "q-1")
    assert table.read().count() == 2 and [n for n, _ in table.snapshots()] == [0, 1]


def test_a_merge_rewrites_only_touched_buckets(spark, tmp_path):
    table = BucketTable(spark, str(tmp_path / "state"), "k int, v string", ["k"], buckets=8)
    add = lambda state, new: state.unionByName(new)
    rows = lambda *x: spark.createDataFrame(list(x), "k int, v string")
    table.merge(rows(*[(i, "a") for i in range(40)]), "q-0", add)
    table.merge(rows((1, "b")), "q-1", add)
    made = {p.name.partition("-")[0]: len(list(p.glob("bucket=*"))) for p in (tmp_path / "state").iterdir() if p.name[0] != "_"}
    assert made == {"0": 8, "1": 1} and table.read().count() == 41
    # the same batch again, and an empty one
    table.merge(rows((1, "b")), "q-1", add)
    table.merge(rows(), "q-2", add)
    assert table.read().count() == 41 and [n for n, _ in table.snapshots()] == [0, 1, 2]


def test_both_pipelines_in_a_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.txt").write_text("\n".join([record(1), record(2)]))
    (src / "2.txt").write_text("\n".join([record(3), record(9, account="b")]))
    tables = {n: SnapshotTable(spark, str(tmp_path / n), S.TABLES[n]) for n in ("action_item", "action_item_version", "deal", "deal_version")}
    one, two = F.array(F.lit(1.0), F.lit(0.0)).cast("array<float>"), F.array(F.lit(0.0), F.lit(1.0)).cast("array<float>")

    def deals(e):
        given = {"deal_idx": F.lit(0), "name": F.col("interaction_id"), "opportunity_summary": F.col("content.text"), "stage": F.when(F.col("interaction_id") == "i3", "proposal"), "amount": F.lit(1.0), "confidence": F.lit(0.5), "embedding": one}
        return e.select(*[F.col(f.name) if f.name in e.columns else given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in S.struct(D.EXTRACTED)])

    def items(e):
        if e.where("account_id = 'b'").count():
            raise ValueError("no model for b")
        return e.select("tenant_id", "account_id", "interaction_id", F.lit(0).alias("item_idx"), F.col("content.text").alias("action_item_text"), F.col("content.text").alias("summary"), F.lit("Zoe").alias("owner"), F.lit(False).alias("is_status_update"), F.lit(None).cast("string").alias("implied_status"), F.lit(0.5).alias("confidence"), F.lit(3).alias("score_impact"), F.lit(3).alias("score_urgency"), F.lit(3).alias("score_specificity"), F.when(F.col("interaction_id") == "i1", one).otherwise(two).alias("embedding"))

    nothing = lambda ddl: lambda e: spark.createDataFrame([], ddl)
    models = Models(items, nothing("tenant_id string, interaction_id string, item_idx int, actionable boolean, adjusted double, pos int"), deals, nothing("query_id string, vec_id string, same boolean, confidence double, route string"), nothing("tenant_id string, account_id string, canonical_name string, aliases array<string>"))
    told = []
    step = workflows_step(tables, models, "2024-01-01", lambda tag, x: told.append(x["summary"]["overall"]))
    table = BucketTable(spark, str(tmp_path / "state"), S.TABLES["interaction"], KEY, buckets=2)
    stream(spark, str(src), str(tmp_path / "cp"), merge_interactions(table, sources=["x"], then=step)).awaitTermination()
    assert told == ["success", "partial"] and table.read().count() == 4
    assert sorted(r["summary"] for r in tables["action_item"].read().collect()) == ["text 1", "text 2"]
    found = {r["account_id"]: r for r in tables["deal"].read().collect()}
    assert (found["a"]["name"], found["a"]["stage"], found["a"]["version"], found["a"]["opportunity_summary"]) == ("i1", "proposal", 3, "text 3") and found["b"]["version"] == 1
    assert sorted(r["opportunity_summary"] for r in tables["deal_version"].read().collect()) == ["text 1", "text 2"]


def test_dispatch_isolates_faults(spark):
    def bad(e):
        raise RuntimeError("down")

    out = dispatch(spark.range(3), {"items": lambda e: e.count(), "deals": bad})
    assert out["items"]["result"] == 3 and out["deals"]["error"] == "down" and out["summary"] == {"any": True, "both": False, "overall": "partial"}


def test_raw_text_and_health(spark, tmp_path):
    text = text_envelopes(spark.createDataFrame([("hello", "2024-01-01 00:00:00")], "text string, timestamp string"), "t", "a", "u")
    good, bad = validate(text)
    assert good.first()["content"]["text"] == "hello" and bad.count() == 0
    text.write.json(str(tmp_path / "e"))
    assert read_envelopes(spark, str(tmp_path / "e")).first()["account_id"] == "a"
    text.write.parquet(str(tmp_path / "p"))
    assert healthy(spark, {"p": str(tmp_path / "p"), "none": str(tmp_path / "none")}) == {"spark": True, "p": True, "none": False}
    assert rejected_duplicates(spark.createDataFrame([(1,), (1,), (2,)], "k int"), ["k"]).collect() == [(1, 2)]


def test_relational_tables(spark, tmp_path):
    url, driver = f"jdbc:derby:{tmp_path}/db;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    rows = spark.createDataFrame([("t", "i1", 2), ("t", "i2", 1), ("o'x", "i3", 3)], "tenant_id string, id string, n int")
    write_jdbc(rows, url, "meetings", driver=driver)
    write_jdbc(rows.where("n > 1"), url, "meetings", tenants=["t", "o'x"], session="VALUES {}", driver=driver)
    read = read_jdbc(spark, url, "meetings", tenant="o'x", session="VALUES {}", driver=driver)
    assert sorted(r["id"] for r in read.collect()) == ["i1", "i1", "i2", "i3", "i3"]
    manifest = spark.createDataFrame([("i3",), ("i2",), ("none",)], "id string")
    assert [r["id"] for r in by_manifest(read, manifest, "id", F.col("n")).collect()] == ["i2", "i3", "i3"]


def test_sources(spark, tmp_path):
    good, bad = parse_records(spark.createDataFrame([(record(1, extras={"contacts": [{"name": "A", "email": "a@x", "role": "r"}], "duration_seconds": 60}),)], "body string"))
    row = extras(good).first()
    assert row["contact_labels"] == ["A <a@x> (r)"] and row["contact_ids"] == [] and row["duration_seconds"] == 60 and bad.count() == 0
    path = tmp_path / "t.json"
    path.write_text(json.dumps({"tenant_id": "t", "account_id": "a", "transcripts": [{"sequence": 2, "text": "b"}, {"sequence": 1, "text": "a"}]}))
    assert [r["text"] for r in read_transcripts(spark, str(path)).collect()] == ["a", "b"]
    assert clean_url("postgresql://h/db?sslmode=require&x=1&channel_binding=y") == "postgresql://h/db?x=1"


def test_bootstrap_is_idempotent(spark, tmp_path):
    made = bootstrap(spark, str(tmp_path / "db"))
    assert missing(made) == [] and bootstrap(spark, str(tmp_path / "db")) == []
