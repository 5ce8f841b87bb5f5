"""Hard negatives, panes with revisions, and mixing: brute force and edge cases."""

import collections
import datetime as dt
import math
import zlib

import numpy as np
import pytest
from helpers import same

from tessera.llm import hardneg, mixing, panes, registry

INF = float("inf")


@pytest.fixture
def few(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_panes"])
def test_new_query_agrees_with_sql(few, sf_dir, name):
    assert same(registry.QUERIES[name](few, sf_dir), registry.ORACLES[name], sf_dir) == ""


# ---- hard negatives


def negatives(rows, every, n_positives, k):
    ok = [(i, (lab + 1) % 10 if i % 7 == 0 else lab, [math.floor(256 * x) for x in v]) for i, lab, v in rows if None not in (i, lab, v) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a in {(i, lab, tuple(v)) for i, lab, v in ok if i % every == 0}:
        order = sorted(((-sum(x * y for x, y in zip(a[2], v)), i, lab) for i, lab, v in ok if len(v) == len(a[2])), key=lambda s: (s[0], s[1]))
        pos = list(dict.fromkeys([(i, -s) for s, i, lab in order if lab == a[1] and i != a[0]][:n_positives]))
        for p, top in pos:
            found = [(i, -s) for s, i, lab in order if lab != a[1] and 80 * top <= 100 * -s <= 100 * top][:k]
            out += [(a[0], p, r, i, top, s) for r, (i, s) in enumerate(found, 1)]
    return sorted(out)


def mined(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").selectExpr("vec_id", "label", "embedding", "1 as rank", "'x' as v", "2 as akey")
    return sorted(map(tuple, hardneg.mine(df, **more).collect()))


def test_hard_negatives_by_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, int(rng.integers(0, 4)), [float(x) for x in np.float32(rng.normal(size=3).round(1))]) for i in range(300)]
    rows += [(300, 1, [1.0, 2.0, 3.0]), (301, 2, [1.0, 2.0, 3.0]), (302, 1, [1.0, 2.0, 3.0])]  # ties
    rows += [(10, None, [1.0, 1.0, 1.0]), (11, 1, None), (None, 1, [1.0, 1.0, 1.0]), (12, 1, [1.0, None, 1.0]), (13, 1, [float("nan"), 1.0, 1.0]), (14, 1, [INF, 1.0, 1.0]), (20, 1, []), (21, 1, [1.0])]
    rows += [rows[5]] * 3 + [rows[40]] * 2  # repeated rows, of an anchor too
    assert mined(spark, rows, every=20, anchor_block=7, row_block=50) == negatives(rows, 20, 5, 5)
    # one block gives what many give
    assert mined(spark, rows, every=20) == negatives(rows, 20, 5, 5)


def test_hard_negatives_of_large_components_are_exact(spark):
    rows = [(0, 0, [3e6, 1.0]), (1, 1, [3e6, 1.0]), (2, 1, [3e6, 2.0]), (3, 1, [3e6 + 1, 1.0]), (4, 2, [3e6, 1.0]), (5, 2, [3e6, 1.0])]
    got = mined(spark, rows, every=5)
    assert got == negatives(rows, 5, 5, 5) and got and max(r[4] for r in got) > 2**53


def test_hard_negatives_of_no_rows(spark):
    assert mined(spark, []) == [] and mined(spark, [(1, 1, [1.0])]) == [] and mined(spark, [(0, 1, [1.0]), (1, 1, [-1.0])]) == []


# ---- panes

EPOCH = dt.datetime(1970, 1, 1)


def revised(rows):
    """The records of all batches, step by step."""
    seen, batches = {}, collections.defaultdict(list)
    for i, ts, arrived, kind, value in rows:
        if ts is None:
            continue
        d = ((arrived or ts) - EPOCH) // dt.timedelta(days=1)
        q = d % 8
        b = min(7, q + max(0, zlib.crc32(b"" if i is None else str(i).encode()) % 30 - 23))
        cents = math.floor(100 * value + 0.5) if value is not None and math.isfinite(value) else 0
        row = ((ts - EPOCH) // dt.timedelta(microseconds=1) - (d - q) * panes.DAY, b, cents, kind or "none")
        seen[i] = min(seen.get(i, row), row)
    for i, (us, b, cents, kind) in seen.items():
        batches[b].append((us, i, cents, kind))
    mark, held, told, out = -INF, {}, {}, []
    for b in range(8):
        fresh = set()
        for us, i, cents, kind in batches[b]:
            key = (kind, us // panes.HOUR)
            if mark >= (key[1] + 1) * panes.HOUR + 4 * panes.DAY:
                out.append((b, key[1], -1 if i is None else i, 1, cents, "late", kind))
            else:
                n, c = held.get(key, (0, 0))
                held[key] = (n + 1, c + cents)
                fresh.add(key)
        for key in sorted(held):
            if key in told and key in fresh:
                out += [(b, key[1], -1, *told[key], "retract", key[0]), (b, key[1], -1, *held[key], "replace", key[0])]
                told[key] = held[key]
            elif key not in told and mark >= (key[1] + 1) * panes.HOUR + 6 * panes.HOUR:
                out.append((b, key[1], -1, *held[key], "emit", key[0]))
                told[key] = held[key]
        for key in [k for k in held if mark >= (k[1] + 1) * panes.HOUR + 4 * panes.DAY]:
            held.pop(key)
            told.pop(key, None)
        if b == 7:
            out += [(b, key[1], -1, *held[key], "final", key[0]) for key in held if key not in told]
        mark = max([mark, *(us for us, *_ in batches[b])])
    return sorted(out)


def ids_without_delay(n):
    return [i for i in range(10_000) if zlib.crc32(str(i).encode()) % 30 <= 23][:n]


CLICKS = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, kind string, value double"


def paned(spark, rows):
    df = spark.createDataFrame(rows, CLICKS).selectExpr("*", "1 as hour", "2 as batch", "'x' as at", "3 as cents", "4 as n_rows")
    out = [tuple(r) for r in panes.revisions(df).collect()]
    return sorted((r[0], r[1], r[2], r[3], r[4], r[5], r[6]) for r in out)


def test_panes_by_brute_force(few):
    """Days 0 to 7 without day 3: bounds met exactly, a microsecond and a millisecond short; late and far rows; repeats,
    nulls and broken values."""
    ids = iter(ids_without_delay(400))
    day = lambda d, **more: EPOCH + dt.timedelta(days=19_720 + d, **more)  # noqa: E731  19720 is divisible by 8
    rows = []
    add = lambda ts, at, kind="view", value=1.005: rows.append((next(ids), ts, at, kind, value))
    for h in range(0, 24, 5):
        for m in (0, 59):
            add(day(0, hours=h, minutes=m), day(0, hours=h, minutes=m))
    add(day(0, hours=23), day(0, hours=23), None, None)  # the watermark of batch 1: 6 hours after the end of hour 16
    add(day(0, hours=16, minutes=5), day(0, hours=23), "exact", 2.0)
    add(day(0, hours=17, minutes=5), day(0, hours=23), "short", 2.0)
    add(day(1, hours=23, minutes=59, seconds=59, microseconds=999_999), day(1, hours=23), "us", -3.337)  # floored to a millisecond
    add(day(1, hours=17, minutes=1), day(1, hours=23), "us", 4.0)
    add(day(0, hours=16, minutes=6), day(1), "exact", 5.0)  # a revision
    add(day(0, hours=16, minutes=7), day(2), "exact", -7.0)  # and another, by which the sum is what it was
    for d in (2, 4, 5, 6, 7):
        for k in range(6):
            add(day(d, hours=4 * k), day(d, hours=4 * k, minutes=1), ["view", "buy", None][k % 3], [0.5, float("nan"), INF, None, -0.005, 1e6][k])
            add(day(d - 5 + k % 5, hours=k), day(d, hours=4 * k, minutes=2), "slow", float(k))  # late, more or less
    add(day(-3000), day(5), "past", 1.0)
    add(day(6, hours=3), None, "unset", 1.0)
    add(None, day(6), "view", 1.0)
    rows += [rows[0], rows[0], rows[30], (rows[40][0], *rows[41][1:])]
    rows += [(None, day(4), day(4), "view", 1.0), (None, day(5), day(5), "view", 2.0)]
    delayed = [i for i in range(5000) if zlib.crc32(str(i).encode()) % 30 > 23][:60]
    rows += [(i, day(k % 8, hours=k % 24), day(k % 8, hours=23), "slow", 1.0) for k, i in enumerate(delayed)]
    expected = revised(rows)
    assert {r[5] for r in expected} == {"late", "emit", "retract", "replace", "final"}
    assert paned(few, rows) == expected


def test_panes_of_one_row_and_none(few):
    assert paned(few, []) == []
    # a time far ahead closes everything after it
    rows = [(ids_without_delay(1)[0], EPOCH + dt.timedelta(days=8 * 10_000), EPOCH, "view", 1.0), (ids_without_delay(3)[2], EPOCH + dt.timedelta(days=1), EPOCH + dt.timedelta(days=1), "view", 1.0)]
    assert paned(few, rows) == revised(rows)


# ---- mixing


def test_targets_are_shared_again_until_none_is_above():
    assert mixing.targets(np.array([10.0, 10.0, 10.0]), np.array([1.0, 2.0, 3.0])).tolist() == [5.0, 10.0, 15.0]
    got = mixing.targets(np.array([1000.0, 1.0, 2.0]), np.array([1.0, 2.0, 3.0]))
    assert got.tolist() == [994.0, 3.0, 6.0] and mixing.targets(np.zeros(2), np.ones(2)).tolist() == [0.0, 0.0]
    # 60 each at first; the third stops at 30, then 75 each; now the second is above 72 too
    assert mixing.targets(np.array([146.0, 24.0, 10.0]), np.ones(3)).tolist() == [78.0, 72.0, 30.0]


def test_permutation_takes_each_index_once():
    for n in (1, 2, 3, 7, 64, 1000):
        for key in (0, 12345):
            got = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, key, dtype=np.uint64))
            assert sorted(got.tolist()) == list(range(n))
    assert mixing.permuted(np.arange(50), np.full(50, 50), np.full(50, 1, dtype=np.uint64)).tolist() != mixing.permuted(np.arange(50), np.full(50, 50), np.full(50, 2, dtype=np.uint64)).tolist()


def corpus():
    rng = np.random.default_rng(3)
    text = lambda n: " ".join(f"w{rng.integers(0, 50)}" for _ in range(n))
    rows = [(i, text(int(rng.integers(0, 90))), f"s{i % 4}") for i in range(200)]
    rows += [(1000, None, "s0"), (1001, "", "s1"), (1002, " \t\n", None), (1003, text(3000), "s2"), (None, text(20), None), (None, text(5), None), (7, "again  and\x0bagain", "tiny"), (7, "again  and\x0bagain", "tiny"), (1004, None, "empty"), (1005, text(4000), "\U0001f600"), (1006, text(4000), "￮")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as size", "2 as src", "'x' as start", "3 as taken", "4 as target")


def test_mix_comes_near_its_targets(spark):
    rows = corpus()
    size = lambda t: len((t or "").replace("\x0b", " ").split())
    got = mixing.shares(frame(spark, rows), block=16, shard=32).collect()
    assert collections.Counter((r["doc_id"], r["size"]) for r in got) == collections.Counter((i, size(t)) for i, t, _ in rows)
    total = collections.Counter()
    for _, t, s in rows:
        total[s] += size(t)
    order = sorted((s for s in total if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: 1.0 + k % 3 for k, s in enumerate(order)}
    expected = dict(zip(order, mixing.targets(np.array([float(total[s]) for s in order]), np.array([weight[s] for s in order])), strict=True))
    of = {(i, size(t)): s for i, t, s in rows}
    taken = collections.Counter()
    for r in got:
        s = of[(r["doc_id"], r["size"])]
        assert r["source_size"] == total[s] and abs(r["target"] - expected[s]) < 1e-6 and r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    for s in order:
        assert abs(taken[s] - expected[s]) <= 16, s
    again = mixing.shares(frame(spark, rows).repartition(5), block=16, shard=32).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_mix_has_the_texts(spark):
    """The pieces of the mix, put together, have the words that the shares count, and every block is whole."""
    rows = [r for r in corpus() if r[0] is not None and r[0] != 7]
    of = {i: (t or "").replace("\x0b", " ").split() for i, t, _ in rows}
    count, slots = collections.Counter(), collections.defaultdict(int)
    for r in mixing.texts(frame(spark, rows), block=16, shard=32).collect():
        words = r["text"].split(" ")
        assert words == of[r["doc_id"]][r["from_word"] : r["from_word"] + r["n_words"]] and len(words) == r["n_words"]
        count[r["doc_id"]] += len(words)
        slots[(r["src"], r["slot"])] += len(words)
    shares = {r["doc_id"]: r["taken"] for r in mixing.shares(frame(spark, rows), block=16, shard=32).collect() if r["taken"]}
    assert shares == dict(count) and max(slots.values()) == 16


def test_mix_of_no_words(spark):
    assert mixing.shares(frame(spark, [])).collect() == []
    got = mixing.shares(frame(spark, [(1, None, "a"), (2, "", None)])).collect()
    assert sorted((r["doc_id"], r["size"], r["source_size"], r["target"], r["taken"]) for r in got) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
    assert mixing.texts(frame(spark, [(1, None, "a")])).count() == 0
