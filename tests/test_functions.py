import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import scalars as X
from tessera.functions.udfs import normal, ratio
from tessera.operators import vector as V
from tessera.operators.resolve import cluster, first_fit, inner_keys, outer_keys, owner_match, resolve_names


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_score_anchors(spark):
    one = lambda *x: value(spark, X.priority_score(*[F.lit(float(v)) for v in x]))
    assert one(5, 5, 5, 1.0) == 1.0 and one(1, 1, 1, 0.0) == 0.18


def test_uuid5_is_the_standard_one(spark):
    names = [f"key:{i}:é" for i in range(60)]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", X.uuid5(F.col("n")).alias("u")).collect()
    assert all(r["u"] == str(uuid.uuid5(uuid.NAMESPACE_URL, r["n"])) for r in rows)


@pytest.mark.parametrize(("a", "b", "expected"), [([1.0, 0.0], [1.0, 0.0], 1.0), ([1.0, 0.0], [0.0, 1.0], 0.0), ([1.0], [-1.0], -1.0), ([0.0, 0.0], [1.0, 1.0], 0.0)])
def test_cosine_edges(spark, a, b, expected):
    assert value(spark, X.cosine(F.lit(a).cast("array<double>"), F.lit(b).cast("array<double>"))) == pytest.approx(expected)


def test_names():
    assert normal("  José ") == "jose" and normal("O’Neill") == normal("O'Neill") == "o'neill"
    assert ratio("O'Neill", "O'Neil") >= 0.85 and ratio("sarah", "harsh") < 0.80 and ratio("clara", "carol") < 0.8 and ratio("", "x") == 0.0
    assert ratio("Jane", "Jane Smith") < 0.75 <= ratio("Jane Smit", "Jane Smith")


def test_two_name_predicates_differ(spark):
    p = F.lit("Peter")
    assert value(spark, X.word_boundary_match(p, F.lit("Peter O'Neill"))) and not value(spark, X.word_boundary_match(p, F.lit("Peterson")))
    assert value(spark, X.loose_affix_match(p, F.lit("Peterson"))) and not value(spark, X.loose_affix_match(F.lit("Al"), F.lit("Alan")))


def test_clusters_do_not_chain(spark):
    a, b = [1.0, 0.0], [0.0, 1.0]
    bridge = [0.5**0.5, 0.5**0.5]
    assert first_fit([a, bridge, b, None, a], 0.7) == [0, 0, 1, -1, 0]
    rows = spark.createDataFrame([("x", i, v) for i, v in enumerate([a, bridge, b])], "batch_id string, item_idx long, embedding array<double>")
    assert [r["cluster_id"] for r in cluster(rows, threshold=0.7).orderBy("item_idx").collect()] == [0, 0, 1]


def test_cluster_invariant():
    rng = random.Random(3)
    vectors = [[rng.gauss(0, 1) for _ in range(3)] for _ in range(60)]
    unit = [np.array(v) / np.linalg.norm(v) for v in vectors]
    found = first_fit(vectors, 0.8)
    for i in range(60):
        for j in range(i):
            assert found[i] != found[j] or unit[i] @ unit[j] >= 0.8 - 1e-9


def test_name_cascade(spark):
    owners = spark.createDataFrame([("a", "Peter O'Neill", ["Pete"]), ("a", "Sarah Jones", None)], "account_id string, canonical_name string, aliases array<string>")
    names = spark.createDataFrame([("a", n) for n in ["peter o’neill", "PETE", "Sarah", "Sara Jones", "Bob", None]], "account_id string, name string")
    got = {r["name"]: (r["resolved"], r["method"]) for r in resolve_names(names, owners).collect() if r["name"]}
    assert got == {"peter o’neill": ("Peter O'Neill", "exact"), "PETE": ("Peter O'Neill", "alias"), "Sarah": ("Sarah Jones", "substring"), "Sara Jones": ("Sarah Jones", "fuzzy"), "Bob": (None, "unresolved")}


def test_owner_ranks(spark):
    owners = spark.createDataFrame([("t", "1", "Peterson", None, "2024-01-02"), ("t", "2", "Ann", ["Peter"], "2024-01-01"), ("u", "3", "Peter", None, "2024-01-01"), ("t", "4", "Liam O'Neill", None, "2024-01-03")], "tenant_id string, owner_id string, canonical_name string, aliases array<string>, created_at string").withColumn("created_at", F.col("created_at").cast("timestamp"))
    names = spark.createDataFrame([("t", "Peter"), ("t", "Peters"), ("u", "Peter"), ("u", "Zed"), ("t", " Ann "), ("t", "ann"), ("t", "Liam O\u2019Neill"), ("t", "mr liam o\u2018neill"), ("t", "Li"), ("t", None)], "tenant_id string, name string")
    got = {(r["tenant_id"], r["name"]): (r["owner_id"], r["rank"]) for r in owner_match(names, owners).collect()}
    assert got == {("t", "Peter"): ("2", 1), ("t", "Peters"): ("1", 2), ("u", "Peter"): ("3", 0), ("u", "Zed"): (None, None), ("t", " Ann "): ("2", 0), ("t", "ann"): ("2", 2), ("t", "Liam O\u2019Neill"): ("4", 0), ("t", "mr liam o\u2018neill"): (None, None), ("t", "Li"): (None, None), ("t", None): (None, None)}


def test_affixes_are_scoped_to_the_account(spark):
    owners = spark.createDataFrame([("t", "1", "Peterson", None, "2024-01-01"), ("t", "2", "Peter Long", None, "2024-01-02")], "tenant_id string, owner_id string, canonical_name string, aliases array<string>, created_at string")
    owned = spark.createDataFrame([("t", "b", "2")], "tenant_id string, account_id string, owner_id string")
    names = spark.createDataFrame([("t", "a", "Peter"), ("t", "b", "Peter"), ("t", None, "Peter"), ("t", "a", "Peterson")], "tenant_id string, account_id string, name string")
    got = {(r["account_id"], r["name"]): r["owner_id"] for r in owner_match(names, owners, owned).collect()}
    assert got == {("a", "Peter"): None, ("b", "Peter"): "2", (None, "Peter"): "1", ("a", "Peterson"): "1"}


def test_affix_keys_lose_no_match(spark):
    rng = random.Random(7)
    name = lambda: "".join(rng.choice("ab ") for _ in range(rng.randrange(1, 9))).strip() or "a"
    rows = [(name(), name()) for _ in range(4000)]
    df = spark.createDataFrame(rows, "a string, b string")
    meet = lambda x, y: F.arrays_overlap(inner_keys(F.col(x)), outer_keys(F.col(y)))
    lost = df.where(X.loose_affix_match(F.col("a"), F.col("b")) & ~(meet("a", "b") | meet("b", "a")))
    assert lost.count() == 0 and df.where(X.loose_affix_match(F.col("a"), F.col("b"))).count() > 50


def test_search_in_blocks_is_exact(spark, monkeypatch):
    rng = np.random.default_rng(1)
    vectors = [[float(x) for x in rng.integers(-2, 3, 4)] for _ in range(90)]
    index = spark.createDataFrame([(i, i % 2, v) for i, v in enumerate(vectors)], "vec_id long, s int, embedding array<float>")
    queries = spark.createDataFrame([(i, i % 2, vectors[i]) for i in range(0, 90, 7)] + [(500, None, vectors[0])], "query_id long, s int, query array<float>")
    unit = lambda v: np.array(v) / max(np.linalg.norm(v), 1e-300)
    expected = {}
    for q in range(0, 90, 7):
        scored = sorted((-round(float(unit(vectors[q]) @ unit(vectors[x])), 6), x) for x in range(90) if x % 2 == q % 2)
        expected[q] = [(x, -s) for s, x in scored if -s >= 0.2][:5]
    monkeypatch.setattr(V, "INDEX_BLOCK", 11)
    monkeypatch.setattr(V, "QUERY_BLOCK", 4)
    got = {}
    for r in V.search(queries, index, 5, 0.2, ["s"]).orderBy("query_id", F.desc("score"), "vec_id").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got == {q: x for q, x in expected.items() if x}


def test_contact_labels(spark):
    c = lambda n, e, r: F.struct(F.lit(n).cast("string").alias("name"), F.lit(e).cast("string").alias("email"), F.lit(r).cast("string").alias("role"))
    assert value(spark, X.contact_label(c("A", "a@x", "lead"))) == "A <a@x> (lead)"
    assert value(spark, X.contact_label(c("A", None, None))) == "A ()" and value(spark, X.contact_label(c(None, "a@x", "r"))) == "a@x (r)"
    assert value(spark, X.contact_name(c("", None, None))) == "Unknown"

def test_search_of_many_small_scopes_and_a_hot_one(spark, monkeypatch):
    """100,000 scopes of a few vectors, and one of 30,000: every scope's best, and no task holds more than a batch and
    the pair of blocks that it ends in."""
    n = 100_000
    rows = spark.range(3 * n + 30_000).select(F.col("id").alias("vec_id"), F.when(F.col("id") < 3 * n, F.floor(F.col("id") / 3)).otherwise(-1).cast("string").alias("s"))
    rows = rows.withColumn("embedding", F.array(F.lit(1.0), (F.col("vec_id") % 3).cast("double"), F.when(F.col("vec_id") % 1000 == 999, F.lit(None)).otherwise(0.0)))
    queries = spark.range(n).select(F.col("id").alias("query_id"), F.array(F.lit(1.0), F.lit(0.0)).alias("query"), F.col("id").cast("string").alias("s")).unionByName(spark.range(3).select((n + F.col("id")).alias("query_id"), F.array(F.lit(1.0), F.lit(1.0)).alias("query"), F.lit("-1").alias("s")))
    found = V.search(queries, rows, 2, 0.5, ["s"])
    small = found.where("s != '-1'").agg(F.count("*").alias("n"), F.countDistinct("query_id").alias("q"), F.min("score").alias("least"), F.sum((F.col("vec_id") % 3).cast("int")).alias("second")).first()
    missing = sum(1 for i in range(3 * n) if i % 3 != 2 and i % 1000 == 999)
    assert small["q"] == n and small["least"] >= 0.5 - 1e-9 and small["n"] == 2 * n - missing and small["second"] == n - sum(1 for i in range(1, 3 * n, 3) if i % 1000 == 999)
    hot = sorted((r.query_id - n, r.vec_id, r.score) for r in found.where("s = '-1'").collect())
    ones = [i for i in range(3 * n, 3 * n + 30_000) if i % 3 == 1 and i % 1000 != 999][:2]
    assert hot == [(q, v, 1.0) for q in range(3) for v in ones]


def test_whole_groups_keep_groups_together():
    """However the rows are cut into batches, each group leaves in one piece and all rows leave once."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    for _ in range(200):
        keys = np.sort(rng.integers(0, rng.integers(1, 12), rng.integers(0, 40)))
        t = pa.RecordBatch.from_arrays([pa.array([str(k) for k in keys]), pa.array(np.zeros(len(keys), dtype="int32")), pa.array(np.arange(len(keys)))], ["g", "i", "n"])
        order = np.argsort(np.array([str(k) for k in keys]), kind="stable") if len(keys) else np.zeros(0, dtype=int)
        t = t.take(pa.array(order))
        cuts = [0, *np.sort(rng.integers(0, len(keys) + 1, rng.integers(0, 8))).tolist(), len(keys)]
        pieces = list(V.whole_groups((t.slice(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)), ["g", "i"]))
        assert [v for p in pieces for v in p["n"].to_pylist()] == t["n"].to_pylist()
        seen = [g for p in pieces for g in set(p["g"].to_pylist())]
        assert len(seen) == len(set(seen))


@pytest.mark.parametrize("ids", [int, str])
@pytest.mark.parametrize("product", [1, 10, 10**9])
def test_best_pairs_by_brute_force(monkeypatch, ids, product):
    """Both ways, with second vectors, ties and no vectors at all, give what comparing pair by pair gives."""
    monkeypatch.setattr(V, "PRODUCT", product)
    monkeypatch.setattr(V, "COMPONENTS", 40)
    rng = np.random.default_rng(product % 97)
    gq, gx = np.sort(rng.integers(0, 9, 40)), np.sort(rng.integers(0, 9, 70))
    half = lambda n: V.unit(list(rng.integers(-1, 2, (n, 3)).astype(float)))
    q, x, current, has = half(40), half(70), half(70), rng.random(70) < 0.5
    names = np.array([ids(i) for i in rng.permutation(70)], dtype=object if ids is str else None)
    at, to, score = V.best_pairs(q, x, current, has, gq, gx, names, 3, 0.2, "cosine")
    want = []
    for i in range(40):
        all_ = [(-round(max(q[i] @ x[j], q[i] @ current[j] if has[j] else -9), 6), names[j], j) for j in range(70) if gx[j] == gq[i]]
        want += [(i, j, -s) for s, _, j in sorted(all_)[:3] if -s >= 0.2]
    assert sorted(zip(at.tolist(), to.tolist(), score.round(6).tolist(), strict=True)) == sorted(want)
