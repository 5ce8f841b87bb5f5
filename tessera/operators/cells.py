"""An exact vector index in cells.

Vectors are stored as partitions of a Parquet table, one a cell: each vector goes to the centre that it is nearest to, and
a cell knows its centre and its radius, the widest angle of a member. No member can be nearer to a query than the angle to
the centre less the radius, so a search reads a query's nearest cells, takes the k-th score found there, and then reads
only those cells whose bound reaches it. The result is the same top k as without an index; how much is not read depends
on how far the vectors cluster (of vectors without any clusters all cells are read).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.graph import top
from tessera.operators.vector import matrix, search
from tessera.scratch import folder
from tessera.shipping import ship

#: Most centres of an index, rows that they are fitted on (in expectation), and rounds of fitting.
CELLS, SAMPLE, ROUNDS = 256, 20_000, 8
#: The cell of vectors that have no direction (missing, zero, not finite): its bound is always 1.
NOWHERE = -1
#: What a bound is widened by, for scores are rounded to six places.
SLACK = 2e-6
#: Cells that a query reads first.
FIRST = 2


def fitted(x: np.ndarray, cells: int) -> np.ndarray:
    """Unit centres of unit rows: the rows farthest from those before them, then moved to their members' means."""
    if not len(x):
        return np.zeros((0, x.shape[1]))
    centres, near = [x[0]], x @ x[0]
    for _ in range(min(cells, len(x)) - 1):
        at = int(near.argmin())
        if near[at] > 1 - 1e-12:
            break
        centres.append(x[at])
        near = np.maximum(near, x @ x[at])
    c = np.stack(centres)
    for _ in range(ROUNDS):
        own = (x @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        norm = np.sqrt((total * total).sum(axis=1, keepdims=True))
        c = np.where(norm > 1e-9, total / np.where(norm > 1e-9, norm, 1), c)
    return c


def directed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows of lists, and which of them have a direction."""
    with np.errstate(invalid="ignore"):
        x = matrix(column)
        ok = np.isfinite(x).all(axis=1) & ((x * x).sum(axis=1) > 0.5)
    return np.where(ok[:, None], x, 0.0), ok


def fit_to(x: np.ndarray, d: int) -> np.ndarray:
    """Rows of d components: shorter ones are padded, of longer ones only the first can count."""
    out = np.zeros((len(x), d))
    out[:, : min(d, x.shape[1])] = x[:, :d]
    return out


def build(index: DataFrame, path: str, cells: int = CELLS, sample: int = SAMPLE) -> None:
    """Write ``index`` (vec_id, embedding[, embedding_current], any other columns) to a new path as an index of at most
    ``cells`` cells. Centres are fitted on about ``sample`` vectors (in expectation; by the hash of the id); every row is
    stored, a hot cell as several files. A column named ``cell`` or ``cosine`` is an error."""
    if clash := {"cell", "cosine"} & set(index.columns):
        raise ValueError(f"the index makes columns of its own named {sorted(clash)}")
    two = "embedding_current" in index.columns
    double = lambda c: F.col(c).cast("array<double>").alias(c)
    share = math.ceil(min(1.0, sample / max(1, index.count())) * 2**30)
    some = index.where(F.pmod(F.xxhash64(F.col("vec_id").cast("string")), F.lit(2**30)) < share).where("embedding is not null").select(double("embedding")).toArrow()["embedding"].combine_chunks()
    x, ok = directed(some if isinstance(some, pa.Array) else some.chunk(0))
    centres = fitted(x[ok], cells)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            v, ok = directed(t["_a"])
            # all vectors of a row and the centres in one space: none loses a component, so angles stay angles
            d = max(v.shape[1], centres.shape[1])
            c = fit_to(centres, d)
            score = fit_to(v, d) @ c.T
            cell = score.argmax(axis=1) if len(c) else np.zeros(len(v), dtype=int)
            least = score[np.arange(len(v)), cell] if len(c) else np.zeros(len(v))
            if two:
                b, has = directed(t["_b"])
                d = max(b.shape[1], centres.shape[1])
                other = (fit_to(b, d) * fit_to(centres, d)[cell]).sum(axis=1) if len(c) else np.zeros(len(b))
                given = t["_b"].is_valid().to_numpy(zero_copy_only=False)
                least, ok = np.where(given, np.minimum(least, other), least), ok & (has | ~given)
            ok &= bool(len(c))
            rest = t.drop_columns(["_a", "_b"])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(np.where(ok, cell, NOWHERE).astype("int32")), pa.array(np.where(ok, least, -1.0))], [*rest.schema.names, "cell", "cosine"])

    ship(index.sparkSession)
    rows = index.withColumns({"_a": F.col("embedding").cast("array<double>"), "_b": (F.col("embedding_current") if two else F.lit(None)).cast("array<double>")})
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in index.schema)
    stored = rows.mapInArrow(placed, f"{schema}, cell int, cosine double")
    stored.hint("rebalance", F.col("cell")).write.partitionBy("cell").parquet(f"{path}/rows")
    spark = index.sparkSession
    found = spark.read.schema(f"{schema}, cosine double, cell int").parquet(f"{path}/rows").groupBy("cell").agg(F.count("*").alias("n"), F.min("cosine").alias("cosine"))
    made = spark.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(centres)] + [(NOWHERE, [])], "cell int, centre array<double>")
    made.join(F.broadcast(found), "cell").coalesce(1).write.parquet(f"{path}/cells")
    # the columns are kept apart, as an index of no rows has no files to tell them
    spark.createDataFrame([], index.schema).write.parquet(f"{path}/schema")


def nearest(queries: DataFrame, path: str, k: int = 10, min_score: float = 0.7, by: list[str] | None = None, first: int = FIRST, told: Callable[[dict[str, int]], None] | None = None) -> DataFrame:
    """What ``vector.search`` gives for the queries (query_id, query, scope columns) on the indexed table, in cosines.

    ``told`` gets how many cells there are and how many were read. The lists of cells that pass through the driver are
    bounded by the number of cells; scores found first are kept as a table in the shared folder."""
    by = by or []
    spark = queries.sparkSession
    stats = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()
    rows = spark.read.schema(", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(f"{path}/schema").schema) + ", cell int").parquet(f"{path}/rows")
    d = max((len(s["centre"]) for s in stats), default=0)
    centres = fit_to(matrix(pa.array([s["centre"] for s in stats], pa.list_(pa.float64()))), d)
    radius = np.array([math.pi if s["cell"] == NOWHERE else math.acos(min(1.0, max(-1.0, s["cosine"]))) for s in stats])
    number = np.array([s["cell"] for s in stats], dtype="int32")

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            q, ok = directed(t["_q"])
            w = max(d, q.shape[1])
            angle = np.arccos(np.clip(fit_to(q, w) @ fit_to(centres, w).T, -1, 1)) - radius
            bound = np.where(ok[:, None], np.cos(np.maximum(angle, 0)) + SLACK, 2.0)
            at, cell = np.nonzero(bound >= min_score)
            order = np.lexsort((number[cell], -bound[at, cell], at))
            at, cell = at[order], cell[order]
            place = np.arange(len(at)) - np.searchsorted(at, at)
            rest = t.drop_columns(["_q"]).take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(number[cell]), pa.array(bound[at, cell]), pa.array(place.astype("int32"))], [*rest.schema.names, "cell", "bound", "place"])

    ship(spark)
    own = queries.select("query_id", "query", *by)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema)
    root = folder(spark, "cells")
    own.withColumn("_q", F.col("query").cast("array<double>")).mapInArrow(bounds, f"{schema}, cell int, bound double, place int").write.parquet(f"{root}/bounds")
    near = spark.read.parquet(f"{root}/bounds")

    def read(asked: DataFrame) -> tuple[DataFrame, list[int]]:
        wanted = sorted(r["cell"] for r in asked.select("cell").distinct().collect())
        part = rows.where(F.col("cell").isin(wanted))
        return search(asked.drop("bound", "place"), part, k, min_score, [*by, "cell"]).drop("cell"), wanted

    best = lambda df: top(df, [F.desc("score"), F.asc("vec_id")], k, ["query_id", *by])
    found, one = read(near.where(F.col("place") < first))
    found.write.parquet(f"{root}/first")
    found = spark.read.parquet(f"{root}/first")
    kth = best(found).groupBy("query_id", *by).agg(F.count("*").alias("_n"), F.min("score").alias("_least")).where(F.col("_n") >= k)
    rest = near.where(F.col("place") >= first).join(kth, ["query_id", *by], "left").where(F.col("_least").isNull() | (F.col("bound") >= F.col("_least"))).drop("_n", "_least")
    more, two = read(rest)
    if told is not None:
        told({"cells": len(stats), "first": len(one), "then": len(two), "read": len({*one, *two})})
    return best(found.unionByName(more)).select("query_id", "vec_id", "score", *by)
