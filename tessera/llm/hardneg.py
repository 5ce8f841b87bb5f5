"""Hard negatives of embeddings: per anchor all scores are sorted, and each positive reads on from its upper limit.

Vectors become integers, so scores are exact and ties are real: higher scores come first, ties by the smaller id. Rows and
anchors are cut into blocks of bounded size and every pair of blocks is one task's work: a matrix product, then for each
anchor one lexsort of its scores by (score, id). The first pass gives each anchor's best rows of its own label, the
second one the rows of other labels, for each of those positives: a binary search finds the first score at or under the
positive's, and the k first rows of another label above the lower limit are read from there. A block gives at most k rows
for each anchor or positive, so what the blocks give together is merged by a window over few rows. An anchor's scores are
never held whole.

Edge cases: a row with a null id, a null label, a null vector, or a null or non-finite component takes no part; vectors
of another length than an anchor's meet no anchor of that length (each length is compared for itself, an empty vector
scores 0 with an empty one); rows that share an id are candidates each, but none is a positive of an anchor of that id,
and equal rows of an anchor count as one anchor; products that could leave the exact range of a double are taken with
Python's integers, and a score beyond a long is an error; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import discard, saved
from tessera.shipping import ship

#: Anchors and rows of a task, on average; a pair of blocks is multiplied some anchors at a time.
ANCHORS, ROWS, AT_ONCE = 1_000, 16_384, 64
EXACT = float(1 << 53)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, v) of the rows that take part, v being integers as doubles; labels of ids divisible by 7 move on."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & fine)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.transform(x, lambda c: whole(F.lit(256.0) * c)).alias("v"))


def whole(c: Column) -> Column:
    """The floor of a double as a double; from 2**53 on every double is whole."""
    return F.when(F.abs(c) < EXACT, F.floor(F.when(F.abs(c) < EXACT, c).otherwise(0.0)).cast("double")).otherwise(c)


def scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products."""
    high = lambda x: float(np.abs(x).max(initial=0.0))
    if high(anchors) * high(rows) * max(1, anchors.shape[1]) < EXACT:
        return (anchors @ rows.T).astype(np.int64)
    big = lambda x: np.array([[int(c) for c in r] for r in x], dtype=object).reshape(x.shape)
    return big(anchors) @ big(rows).T


def sorted_of(score: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Positions by descending score, then ascending id."""
    if score.dtype == object:
        return np.array(sorted(range(len(ids)), key=lambda i: (-score[i], ids[i])), dtype=np.int64)
    return np.lexsort((ids, -score))


def blocks(n: int, size: int) -> int:
    return max(1, -(-n // size))


def grid(anchors: DataFrame, rows: DataFrame, na: int, nr: int) -> DataFrame:
    """Anchors and rows dealt over na times nr pairs of blocks, rows by their place too, so that copies are not together."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda n, *by: F.pmod(F.xxhash64(*by), F.lit(n)).cast("int")
    a = anchors.withColumns({"i": own(na, "akey"), "is_anchor": F.lit(True)}).withColumn("j", every(nr))
    r = rows.withColumns({"j": own(nr, "vec_id", F.monotonically_increasing_id()), "is_anchor": F.lit(False), "akey": F.lit(None).cast("string"), "positives": F.lit(None).cast(POSITIVES)}).withColumn("i", every(na))
    return a.unionByName(r.select(a.columns))


POSITIVES = "array<struct<positive_id:bigint,positive_score:bigint>>"


def matrices(table: pa.Table) -> Iterator[tuple[pa.Table, np.ndarray, pa.Table, np.ndarray]]:
    """Anchors and rows of a pair of blocks with their vectors, for each length of vector."""
    lengths = np.array([len(x) for x in table["v"]], dtype=np.int64)
    is_anchor = table["is_anchor"].to_numpy(zero_copy_only=False).astype(bool)
    for n in np.unique(lengths[is_anchor]):
        pick = lambda side: table.take(np.flatnonzero((lengths == n) & side))  # noqa: B023, E731
        a, r = pick(is_anchor), pick(~is_anchor)
        if r.num_rows:
            yield a, vectors_of(a, int(n)), r, vectors_of(r, int(n))


def vectors_of(t: pa.Table, n: int) -> np.ndarray:
    """The vectors of length n as a matrix."""
    return t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(t.num_rows, n)


def best_positives(k: int):
    """The k best rows of each anchor's label in a block."""

    def run(table: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for a, av, r, rv in matrices(table):
            ids, labels = r["vec_id"].to_numpy(), r["label"].to_numpy()
            key, own, label = a["akey"].to_pylist(), a["vec_id"].to_numpy(), a["label"].to_numpy()
            for at in range(0, len(key), AT_ONCE):
                for x, score in enumerate(scores(av[at : at + AT_ONCE], rv), at):
                    same = np.flatnonzero((labels == label[x]) & (ids != own[x]))
                    found = same[sorted_of(score[same], ids[same])[:k]]
                    out += [(key[x], int(ids[f]), int(score[f])) for f in found]
        return pa.Table.from_pylist([dict(zip(("akey", "positive_id", "positive_score"), o, strict=True)) for o in out], pa.schema([("akey", pa.string()), ("positive_id", pa.int64()), ("positive_score", pa.int64())]))

    return run


def negatives_of(k: int, low: int, high: int):
    """For each anchor and positive the k first rows of another label whose score is within the limits."""

    def run(table: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for a, av, r, rv in matrices(table):
            ids, labels = r["vec_id"].to_numpy(), r["label"].to_numpy()
            key, label, positives = a["akey"].to_pylist(), a["label"].to_numpy(), a["positives"].to_pylist()
            for at in range(0, len(key), AT_ONCE):
                for x, score in enumerate(scores(av[at : at + AT_ONCE], rv), at):
                    other = np.flatnonzero(labels != label[x])
                    order = other[sorted_of(score[other], ids[other])]
                    down = -score[order]  # ascending
                    for p in positives[x]:
                        top = p["positive_score"]
                        begin = int(np.searchsorted(down, -top, side="left"))
                        for f in order[begin : begin + k]:
                            if not low * top <= high * int(score[f]):
                                break
                            out.append((key[x], p["positive_id"], top, int(ids[f]), int(score[f])))
        names = ("akey", "positive_id", "positive_score", "negative_id", "negative_score")
        return pa.Table.from_pylist([dict(zip(names, o, strict=True)) for o in out], pa.schema([("akey", pa.string()), *[(n, pa.int64()) for n in names[1:]]]))

    return run


def ranked(df: DataFrame, by: list[str], score: str, key: str, k: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc(score), key)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, every: int = 100, n_positives: int = 5, k: int = 5, low: int = 80, high: int = 100, anchor_block: int = ANCHORS, row_block: int = ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor (ids divisible by
    ``every``) and each of its first positives, the first k rows of another label whose score is at most the positive's
    and at least ``low`` hundredths (of ``high``) of it."""
    ship(vectors.sparkSession)
    rows = saved(usable(vectors), "vectors")
    akey = F.concat_ws(":", F.col("vec_id").cast("string"), F.col("label").cast("string"), F.xxhash64("v").cast("string"))
    anchors = saved(rows.where(F.col("vec_id") % every == 0).withColumn("akey", akey).dropDuplicates(["akey"]), "anchors")
    na, nr = blocks(anchors.count(), anchor_block), blocks(rows.count(), row_block)
    none = F.lit(None).cast(POSITIVES)
    found = grid(anchors.withColumn("positives", none), rows, na, nr).groupBy("i", "j").applyInArrow(best_positives(n_positives), "akey string, positive_id long, positive_score long")
    best = ranked(found, ["akey"], "positive_score", "positive_id", n_positives)
    positives = best.groupBy("akey").agg(F.collect_set(F.struct("positive_id", "positive_score")).alias("positives"))
    asked = saved(anchors.join(positives, "akey"), "asked")
    found = grid(asked, rows, na, nr).groupBy("i", "j").applyInArrow(negatives_of(k, low, high), "akey string, positive_id long, positive_score long, negative_id long, negative_score long")
    out = ranked(found, ["akey", "positive_id", "positive_score"], "negative_score", "negative_id", k)
    out = saved(out.select(F.split_part("akey", F.lit(":"), F.lit(1)).cast("long").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"), "negatives")
    discard(rows, anchors, asked)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
