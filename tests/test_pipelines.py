import datetime as dt

from tessera import schemas as S
from tessera.operators.upsert import append_absent, upsert
from tessera.operators.mirror import bundle, write
from tessera.operators.upsert import add_columns, relate
from tessera.plans.deals import EXTRACTED as DEALS
from tessera.plans.deals import run_deals
from tessera.plans.pipelines import current_owner, run_items, topics

NOW = dt.datetime(2024, 5, 1)
EXTRACTED = "tenant_id string, account_id string, interaction_id string, item_idx int, action_item_text string, summary string, owner string, is_status_update boolean, implied_status string, confidence double, score_impact int, score_urgency int, score_specificity int, embedding array<float>"
DECISIONS = "query_id string, vec_id string, same boolean, confidence double, route string"


def table(spark, name, rows):
    names = [f.name for f in S.struct(S.TABLES[name])]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], S.struct(S.TABLES[name]))


def items_state(spark):
    return table(spark, "action_item", [{"tenant_id": "t", "action_item_id": "old", "account_id": "a", "summary": "s", "action_item_text": "x", "status": "open", "priority_score": 0.5, "confidence": 1.0, "version": 1, "embedding": [1.0, 0.0], "embedding_current": [1.0, 0.0], "created_at": NOW, "last_updated_at": NOW}])


def extracted(spark):
    rows = [
        ("t", "a", "i1", 0, "do x again", "again", "Pete", True, "completed", 0.9, 5, 5, 5, [1.0, 0.01]),
        ("t", "a", "i1", 1, "new thing", "new", "Zoe", False, None, 0.8, 3, 3, 3, [0.0, 1.0]),
        ("t", "a", "i1", 2, "dropped", "no", "Zoe", False, None, 0.8, 3, 3, 3, [0.5, 0.5]),
        ("u", "a", "i2", 0, "do x again", "other tenant", "Pete", True, "completed", 0.9, 5, 5, 5, [1.0, 0.01]),
    ]
    return spark.createDataFrame(rows, EXTRACTED)


def test_item_pipeline(spark):
    verdicts = spark.createDataFrame([("t", "i1", 2, True, 0.39, 0), ("t", "i1", 1, True, 0.4, 0), ("t", "i2", 0, False, 0.9, 0)], "tenant_id string, interaction_id string, item_idx int, actionable boolean, adjusted double, pos int")
    owners = spark.createDataFrame([("t", "a", "Peter Pan", ["Pete"]), ("t", "b", "Zoe Zed", ["Zoe"])], "tenant_id string, account_id string, canonical_name string, aliases array<string>")
    none = spark.createDataFrame([], DECISIONS)
    versions = table(spark, "action_item_version", [])
    out = run_items(extracted(spark), verdicts, owners, items_state(spark), versions, none, NOW)
    got = {r["action_item_id"] if r["action_item_id"] == "old" else r["summary"]: r for r in out.items.collect()}
    assert set(got) == {"old", "new", "other tenant"}
    assert got["old"]["status"] == "completed" and got["old"]["version"] == 2 and got["old"]["summary"] == "s"
    assert got["new"]["confidence"] == 0.4 and got["new"]["priority_score"] == 0.62 and got["new"]["version"] == 1
    # owners and verdicts of another tenant, and owners of another account, do not count
    assert got["other tenant"]["owner"] == "Pete" and got["other tenant"]["status"] == "completed" and got["new"]["owner"] == "Zoe"
    assert out.versions.count() == 1 and out.versions.first()["status"] == "open"
    # the same envelope again adds no version and no item
    again = run_items(extracted(spark), verdicts, owners, out.items, out.versions, none, NOW)
    assert again.versions.where("action_item_id = 'old'").count() == 1 and again.items.count() == 3


def test_topics_resolve_before_writing(spark):
    items = spark.createDataFrame([("t", "a", "q1", "Budget  plan", [1.0, 0.0]), ("t", "a", "q2", "budget plan", [0.0, 1.0])], "tenant_id string, account_id string, query_id string, topic_name string, topic_embedding array<float>")
    state = table(spark, "topic", [{"tenant_id": "t", "topic_id": "T", "account_id": "a", "embedding": [1.0, 0.05]}])
    got = {r["query_id"]: r for r in topics(items, state, spark.createDataFrame([], "query_id string, same_topic boolean")).collect()}
    assert got["q1"]["topic_id"] == "T" and got["q1"]["decision"] == "link_existing"
    assert got["q2"]["decision"] == "create_new" and got["q2"]["confidence"] == 1.0 and got["q2"]["topic_id"] != "T"


def deals_of(spark, *rows):
    names = [f.name for f in S.struct(DEALS)]
    base = {"tenant_id": "t", "account_id": "a", "deal_idx": 0, "embedding": [1.0, 0.0], "confidence": 0.8}
    return spark.createDataFrame([tuple((base | r).get(n) for n in names) for r in rows], S.struct(DEALS))


def run(spark, rows, state=None, versions=None, decisions=()):
    found = run_deals(deals_of(spark, *rows), state or table(spark, "deal", []), versions or table(spark, "deal_version", []), spark.createDataFrame(list(decisions), DECISIONS), NOW)
    keep = lambda d: spark.createDataFrame(d.collect(), d.schema)
    return keep(found.deals), keep(found.versions), found.routed.collect()


def test_deals_match_one_by_one(spark):
    at = dt.datetime(2024, 1, 1)
    # two envelopes of one account whose deals have the same index, and a second deal of the first envelope
    rows = [{"interaction_id": "i", "timestamp": at, "name": "Big", "opportunity_summary": "sum", "stage": "bogus", "amount": 5.0, "metrics": "m", "champion": ""}, {"interaction_id": "i", "timestamp": at, "deal_idx": 1, "name": "Big again", "opportunity_summary": "sum 2", "stage": "negotiation", "metrics": ""}, {"interaction_id": "j", "timestamp": at + dt.timedelta(1), "name": "Later", "opportunity_summary": "sum 3", "amount": 7.0, "dimensions": {"technical_fit": (2, None, "e"), "responsiveness": (None, 0.5, None)}}, {"interaction_id": "k", "timestamp": at, "tenant_id": "u", "name": "Other tenant", "opportunity_summary": "x"}]
    state, versions, routed = run(spark, rows)
    got = {r["tenant_id"]: r for r in state.collect()}
    assert state.count() == 2 and got["u"]["version"] == 1
    d = got["t"]
    assert (d["name"], d["stage"], d["amount"], d["version"], d["opportunity_summary"], d["meddic_metrics"], d["meddic_metrics_confidence"], d["meddic_champion_confidence"]) == ("Big", "negotiation", 7.0, 3, "sum 3", "", 0.8, 0.0)
    # an empty text overwrites; what stands after it is empty, so no field is filled
    assert d["meddic_completeness"] == 0.0 and d["dim_technical_fit"] == 2 and d["dim_technical_fit_confidence"] == 0.0 and abs(d["ontology_completeness"] - 1 / 15) < 1e-9 and d["evolution_summary"] == "Initial extraction: sum"
    assert sorted((v["version"], v["stage"], v["opportunity_summary"], v["meddic_completeness"]) for v in versions.collect()) == [(1, "prospecting", "sum", 1 / 6), (2, "negotiation", "sum 2", 1 / 6)]
    assert sorted(r["match_type"] for r in routed) == ["auto_match", "auto_match", "create_new", "create_new"]
    # the same envelopes again add no deal and no version
    again, more, _ = run(spark, rows, state, versions)
    assert again.count() == 2 and more.count() == 2


def test_three_updates_of_one_stored_deal_leave_one_row(spark):
    state, versions, _ = run(spark, [{"interaction_id": "i", "name": "Big", "opportunity_summary": "s"}])
    later = [{"interaction_id": f"j{i}", "timestamp": dt.datetime(2024, 2, i), "name": f"n{i}", "opportunity_summary": f"s{i}"} for i in (1, 2, 3)]
    state, versions, _ = run(spark, later, state, versions)
    assert [(r["opportunity_summary"], r["version"]) for r in state.collect()] == [("s3", 4)] and versions.count() == 3


def test_deal_decisions_below_the_threshold(spark):
    state, versions, routed = run(spark, [{"interaction_id": "i", "name": "Big", "opportunity_summary": "s"}])
    close = [{"interaction_id": "j", "name": "near", "opportunity_summary": "t", "embedding": [0.8, 0.6]}]
    _, _, first = run(spark, close, state, versions)
    assert [r["match_type"] for r in first] == ["create_new"]
    _, _, said = run(spark, close, state, versions, [(first[0]["query_id"], routed[0]["opportunity_id"], True, 0.9, "merge")])
    assert [(r["match_type"], r["opportunity_id"]) for r in said] == [("llm_match", routed[0]["opportunity_id"])]


def test_mirror_bundle_tells_failures(spark):
    row = spark.createDataFrame([("t", "i", "T", 0.5, "m")], "tenant_id string, action_item_id string, topic_id string, confidence double, method string")
    saved = {}

    def save(name, df):
        if name == "deal_versions":
            raise OSError("disk")
        saved[name] = df.collect()

    version = spark.createDataFrame([("t", "d", 1)], "tenant_id string, opportunity_id string, version_number int")
    out = bundle({"action_item_topic_memberships": (row.limit(0), row), "deal_versions": (version.limit(0), version)}, save)
    assert out == {"action_item_topic_memberships": None, "deal_versions": "disk"} and len(saved) == 1
    # a version that is there stays
    assert write("deal_versions", version, version).count() == 1


def test_columns_owners_and_relations(spark):
    df = spark.createDataFrame([(1,)], "a int")
    assert add_columns(add_columns(df, {"b": "double"}), {"a": "string", "b": "string"}).dtypes == [("a", "int"), ("b", "double")]
    owned = spark.createDataFrame([("t", "i", "x", "2024-01-01"), ("t", "i", "y", "2024-01-02")], "tenant_id string, src_id string, dst_id string, created_at string")
    assert [r["dst_id"] for r in current_owner(owned).collect()] == ["y"]
    pairs = spark.createDataFrame([("t", "b", "a", 0.4), ("t", "a", "b", 0.6), ("t", "c", "c", 1.0)], "tenant_id string, action_item_id string, vec_id string, confidence double")
    none = spark.createDataFrame([], "tenant_id string, src_id string, dst_id string, confidence double")
    assert [tuple(r) for r in relate(none, pairs).collect()] == [("t", "a", "b", 0.6)]


def test_upsert_twice_is_once(spark):
    t = spark.createDataFrame([(1, "a", None), (2, "b", "x")], "id int, v string, w string")
    s = spark.createDataFrame([(2, None, "y"), (3, "c", "z")], "id int, v string, w string")
    once = upsert(t, s, ["id"], update=["v"], fill=["w"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, upsert(once, s, ["id"], update=["v"], fill=["w"]).collect())) == [(1, "a", None), (2, None, "x"), (3, "c", "z")]
    assert append_absent(t, s, ["id"]).count() == append_absent(append_absent(t, s, ["id"]), s, ["id"]).count() == 3
