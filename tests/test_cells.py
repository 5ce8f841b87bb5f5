import glob

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import cells as C
from tessera.operators import vector as V


def clusters(spark, n, groups, seed=0, d=8):
    """n vectors about as many directions as there are groups, some without a direction, some twice."""
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(groups, d))
    x = centre[rng.integers(0, groups, n)] + rng.normal(scale=0.05, size=(n, d))
    rows = [(i, [float(v) for v in np.round(x[i], 3)], int(i % 3)) for i in range(n)]
    rows[3] = (3, [0.0] * d, 0)
    rows[4] = (4, None, 1)
    rows[5] = (5, [float("nan")] * d, 2)
    rows[7] = (7, rows[6][1], 1)
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


def probes(index, step=20):
    return index.where(F.col("vec_id") % step == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), "label")


def rows(df):
    return sorted(map(tuple, df.select("query_id", "vec_id", "score", *[c for c in df.columns if c == "label"]).collect()))


@pytest.mark.parametrize("n", [600, 3000])
def test_same_top_k_and_fewer_cells_read(spark, tmp_path, n):
    """At both sizes the index gives what the plain search gives, and a few queries read few of the partitions."""
    index = clusters(spark, n, 40)
    C.build(index, str(tmp_path / "i"), cells=40)
    assert rows(C.nearest(probes(index), str(tmp_path / "i"), 5, 0.2, ["label"])) == rows(V.search(probes(index), index, 5, 0.2, ["label"]))
    told = []
    few = probes(index).where("query_id < 60 and query_id > 0")
    assert rows(C.nearest(few, str(tmp_path / "i"), 5, 0.2, told=told.append)) == rows(V.search(few, index, 5, 0.2))
    assert told[0]["cells"] == len(glob.glob(f"{tmp_path}/i/rows/cell=*")) >= 30 and told[0]["read"] <= 12


def test_second_vectors_and_no_clusters(spark, tmp_path):
    """The better of two vectors counts, and without clusters every cell is read and nothing is lost."""
    rng = np.random.default_rng(5)
    made = [(i, [float(v) for v in rng.normal(size=6)], [float(v) for v in rng.normal(size=6)] if i % 2 else None) for i in range(300)]
    index = spark.createDataFrame(made, "vec_id long, embedding array<float>, embedding_current array<float>")
    C.build(index, str(tmp_path / "i"), cells=12)
    asked = index.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    assert rows(C.nearest(asked, str(tmp_path / "i"), 4, -1.0)) == rows(V.search(asked, index, 4, -1.0))


def test_edges(spark, tmp_path):
    """An empty table, queries without a direction, fewer rows than k, text ids, a name that clashes."""
    empty = spark.createDataFrame([], "vec_id string, embedding array<double>")
    ask = spark.createDataFrame([("a", [1.0, 0.0]), ("z", [0.0, 0.0]), ("n", None)], "query_id string, query array<double>")
    C.build(empty, str(tmp_path / "e"))
    assert C.nearest(ask, str(tmp_path / "e"), 3, 0.1).count() == 0
    some = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [1.0, 0.1]), ("w", None)], "vec_id string, embedding array<double>")
    C.build(some, str(tmp_path / "s"))
    assert rows(C.nearest(ask, str(tmp_path / "s"), 3, -1.0)) == rows(V.search(ask, some, 3, -1.0))
    with pytest.raises(ValueError):
        C.build(some.withColumn("cell", F.lit(1)), str(tmp_path / "c"))
