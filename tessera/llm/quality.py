"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration.

A text becomes a short vector of statistics; cos(W x + b) with Gaussian W approximates a Gaussian kernel over them.
Tasks sum the normal equations of their rows, the driver adds up the sums and solves them. Raw scores are calibrated
on rows that the regression has not seen, by pooling adjacent violators.

Edge cases: null and empty texts share one vector and so one score; very long texts are read whole; without labels
every score is 0.5; without a row to calibrate on the raw score is clipped to 0 and 1; repeated rows of documents or
labels count each, and a document labelled both ways counts both ways; equal scores share one block of the calibration;
labels without a document are ignored; other columns are not read and not returned; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import as_bytes, discard, fold, hash_sample, in_chunks, saved, word_hashes
from tessera.shipping import ship


def classes() -> np.ndarray:
    """A class for each byte."""
    out = np.full(256, 8)
    out[list(range(65, 91))], out[list(range(97, 123))], out[list(range(48, 58))] = 0, 1, 2
    out[list(b".,;:'\"-")], out[list(b"!?")], out[list(b"#$%&*@+=~^_<>{}[]\\/")], out[list(b"|")] = 3, 4, 5, 6
    out[list(b" \t\r")], out[10], out[128:] = 7, 9, 10
    return out


CLASS = classes()
N_CLASSES = 11


def statistics(data: bytes) -> list[float]:
    """The statistics of one text."""
    raw = np.frombuffer(data, dtype=np.uint8)
    n = max(1, len(raw))
    share = np.bincount(CLASS[raw], minlength=N_CLASSES) / n
    h, starts, ends = word_hashes(data)
    k = max(1, len(h))
    size = ends - starts
    _, count = np.unique(h, return_counts=True)
    lines = data.split(b"\n")
    p = np.bincount(raw, minlength=256) / n
    p = p[p > 0]
    letters = max(1e-9, share[0] + share[1])
    return [
        *share.tolist(),
        share[0] / letters,
        np.log1p(len(raw)),
        np.log1p(len(h)),
        float(size.mean()) if len(h) else 0.0,
        float(size.std()) if len(h) else 0.0,
        len(count) / k,
        float(np.log1p(count).mean()) if len(h) else 0.0,
        float(count.max() / k) if len(h) else 0.0,
        float((h[1:] == h[:-1]).sum() / k),
        float((size <= 2).sum() / k),
        np.log1p(k / len(lines)),
        len(set(lines)) / len(lines),
        float(-(p * np.log2(p)).sum()),
    ]


def vectors(texts: list[bytes]) -> np.ndarray:
    return np.array([statistics(x) for x in texts], dtype=np.float64)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: np.ndarray
    beta: np.ndarray
    knots: tuple[np.ndarray, np.ndarray]

    def features(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features, and a constant."""
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([np.sqrt(2 / len(self.b)) * np.cos(z @ self.w + self.b), np.ones((len(x), 1))])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if not len(self.beta):
            return np.full(len(x), 0.5)
        return np.clip(np.interp(self.features(x) @ self.beta, *self.knots), 0, 1)


def pooled(score: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Adjacent violators pooled: (mean score, mean y, weight) of each block, y strictly ascending."""
    blocks: list[tuple[float, float, float]] = []
    for s, v, w in zip(score, y, weight, strict=True):
        block = (s, v, w)
        while blocks and blocks[-1][1] >= block[1]:
            s0, v0, w0 = blocks.pop()
            n = w0 + block[2]
            block = ((s0 * w0 + block[0] * block[2]) / n, (v0 * w0 + block[1] * block[2]) / n, n)
        blocks.append(block)
    return tuple(np.array(x) for x in zip(*blocks, strict=True))


def isotonic(score: np.ndarray, y: np.ndarray, extra: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing fit of y by score, one for each pooled block at its mean score.

    A block of few rows would promise certainty, so each is shrunk towards the overall rate by ``extra`` rows; what no
    longer ascends then is pooled again. Rows of equal score are one block from the start."""
    s, at = np.unique(score, return_inverse=True)
    n = np.bincount(at).astype(float)
    s, v, n = pooled(s, np.bincount(at, weights=y) / n, n)
    s, v, _ = pooled(s, (v * n + extra * float(y.mean())) / (n + extra), n + extra)
    return s, v


EMPTY = Model(np.zeros(0), np.ones(0), np.zeros((0, 0)), np.zeros(0), np.zeros(0), (np.zeros(1), np.full(1, 0.5)))


def train(df: DataFrame, labels: DataFrame, max_rows: int = 20_000, n_features: int = 256, ridge: float = 1e-3, width: float = 1.0, seed: int = 7, sums: int = 8) -> Model:
    """Fit from documents and (doc_id, quality). ``max_rows`` bounds the labelled sample (in expectation); ``sums`` is
    the number of tasks, and so of partial normal equations that reach the driver."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col("quality").cast("double").alias("y"))
    known = hash_sample(known, max_rows).limit(2 * max_rows)
    part = fold(F.col("doc_id"), 5) == 0
    rows = df.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", "y", part.alias("calibrate"))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = vectors(as_bytes(batch.column(0)))
        return pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column(1), batch.column(2)], names=["x", "y", "calibrate"])

    rows = saved(in_chunks(rows, step, "x array<double>, y double, calibrate boolean"), "quality")
    first = rows.select(F.size("x")).first()
    if first is None:
        return EMPTY
    d = first[0]
    mean, scale = np.array(rows.select(*[F.avg(F.col("x")[i]) for i in range(d)], *[F.stddev_pop(F.col("x")[i]) for i in range(d)]).first()).reshape(2, d)
    rng = np.random.default_rng(seed)
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0), rng.normal(size=(d, n_features)) * width / np.sqrt(d), rng.uniform(0, 2 * np.pi, n_features), np.zeros(0), EMPTY.knots)

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = np.zeros((n_features + 1, n_features + 1)), np.zeros(n_features + 1)
        for batch in batches:
            z = model.features(np.array(batch.column(0).to_pylist()))
            a += z.T @ z
            b += z.T @ batch.column(1).to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()), pa.array([b.tobytes()], pa.binary())], names=["a", "b"])

    ship(df.sparkSession)
    fitted = rows.where(~F.col("calibrate"))
    parts = fitted.repartition(sums).select("x", "y").mapInArrow(normal, "a binary, b binary").collect()
    a = sum(np.frombuffer(r["a"]).reshape(n_features + 1, -1) for r in parts)
    b = sum(np.frombuffer(r["b"]) for r in parts)
    n = a[-1, -1]
    if not n:
        return EMPTY
    model.beta = np.linalg.solve(a + ridge * n * np.diag([1.0] * n_features + [1e-9]), b)
    held = rows.where("calibrate").select("x", "y").toArrow()
    model.knots = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    if held.num_rows:
        raw = model.features(np.array(held.column("x").to_pylist())) @ model.beta
        model.knots = isotonic(raw, held.column("y").to_numpy())
    discard(rows)
    return model


def score(df: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every whole text."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value(vectors(as_bytes(batch.column(1)))))], names=["doc_id", "score"])

    return in_chunks(df.select("doc_id", "text"), step, "doc_id long, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold(F.col("doc_id"), 3) != 1)
    model = train(docs.where(fold(F.col("doc_id"), 3) != 1), labels)
    held = (fold(F.col("doc_id"), 3) == 1).alias("held_out")
    return score(docs, model).select("doc_id", held, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
