"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic rows (P) and other rows whose label is not looked at (U) train a linear classifier over the presence
of words. Its risk is prior * P's positive loss + max(0, U's negative loss - prior * P's negative loss): the
corrected estimate of the loss on the unknown negatives, held at zero or above so that a flexible model cannot drive
it below. The class prior comes from the learnable labels, or as a parameter.

A word takes part if it sets P apart from U more clearly than the largest of so many chance differences would; it may
speak for toxicity or against it. The weights have a prior of fixed width, so few confirmed rows give small weights.

Edge cases: a null or empty text has no words and scores by the bias alone; very long texts are read whole; with no
confirmed row every score is 0; repeated rows of documents are each scored, and each may be drawn as unlabelled;
repeated label rows count as toxic if one of them does; words of equal clarity are taken in their own order; labels
without a document are ignored; other columns are not read and not returned; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import ALNUM, as_bytes, discard, fold, hash_sample, in_chunks, saved


@dataclass
class Model:
    words: dict[bytes, int]
    weights: np.ndarray
    bias: float


def word_set(data: bytes) -> set[bytes]:
    """Distinct words: runs of ASCII letters and digits, lower-cased, and of non-ASCII bytes."""
    return set(data.translate(ALNUM).split())


def labelled(df: DataFrame, labels: DataFrame, max_positive: int, max_unlabelled: int) -> DataFrame:
    """A bounded sample of (text, positive): confirmed rows by id, and unlabelled rows by hash."""
    ids = labels.where((F.col("toxic") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    # twice the sample's expected size is a proven bound for the broadcast
    ids = hash_sample(ids, max_positive).limit(2 * max_positive).withColumn("positive", F.lit(1))
    n = df.count()
    share = 1.0 if n <= max_unlabelled else max_unlabelled / n
    top = 1 << 40
    rows = df.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left")
    rows = rows.withColumn("drawn", F.pmod(F.xxhash64("doc_id", F.lit("u")), F.lit(top)) < int(top * share))
    return saved(rows.where(F.col("positive").isNotNull() | F.col("drawn")).select("text", F.col("positive").isNotNull().alias("positive"), "drawn"), "pu")


def counted(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(word, documents of P, documents of U) of a batch."""
    p, u = Counter(), Counter()
    for data, positive, drawn in zip(as_bytes(batch.column(0)), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
        words = word_set(data)
        if positive:
            p.update(words)
        if drawn:
            u.update(words)
    words = list(p | u)  # all of U's words too: another batch may hold the confirmed rows of a word
    return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([p[w] for w in words], pa.int64()), pa.array([u[w] for w in words], pa.int64())], names=["word", "p", "u"])


def fit(x: list[np.ndarray], positive: np.ndarray, drawn: np.ndarray, size: int, prior: float, steps: int = 400, rate: float = 0.1, ridge: float = 0.04) -> tuple[np.ndarray, float]:
    """Non-negative PU risk with the logistic loss, by Adam over all rows at once; x holds each row's word numbers.
    ``ridge`` holds the weights as so many confirmed rows would."""
    row = np.repeat(np.arange(len(x)), [len(v) for v in x])
    col = np.concatenate(x) if x else np.zeros(0, np.int64)
    n_p, n_u = max(1, positive.sum()), max(1, drawn.sum())
    in_p, in_u = positive / n_p, drawn / n_u
    w, m, v = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    w[-1] = np.log(prior / (1 - prior))
    for t in range(1, steps + 1):
        z = np.bincount(row, weights=w[col], minlength=len(x)) + w[-1]
        s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        rest = (in_u - prior * in_p) @ np.logaddexp(0, z)  # estimated loss on the negatives
        g = prior * in_p * (s - 1)
        # below zero the estimate has been overfitted: step back along it instead
        g = g + (in_u - prior * in_p) * s if rest >= 0 else -(in_u - prior * in_p) * s
        grad = np.append(np.bincount(col, weights=g[row], minlength=size), g.sum())
        grad[:-1] += ridge / n_p * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return w[:-1], float(w[-1])


def train(df: DataFrame, labels: DataFrame, prior: float | None = None, max_positive: int = 4000, max_unlabelled: int = 8000, n_words: int = 10_000, min_docs: int = 2) -> Model:
    """Fit on samples whose bounds are parameters: ``max_positive`` confirmed and ``max_unlabelled`` other rows (in
    expectation). ``n_words`` bounds the model that is sent to the tasks: the clearest words are taken; a word of fewer
    than ``min_docs`` sampled rows says nothing."""
    known = labels.where(F.col("toxic").isNotNull())
    share, n = known.select(F.avg((F.col("toxic") == 1).cast("double")), F.count("*")).first()
    if not n or not share:
        return Model({}, np.zeros(0), -30.0)
    prior = min(0.95, max(0.001, prior or share))
    rows = labelled(df, known, max_positive, max_unlabelled)
    n_p, n_u = rows.select(F.count_if("positive"), F.count_if("drawn")).first()
    if not n_p or not n_u:
        return Model({}, np.zeros(0), -30.0)
    counts = in_chunks(rows, counted, "word binary, p long, u long").groupBy("word").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    a, b = F.col("p") / n_p, F.col("u") / n_u
    both = (F.col("p") + F.col("u")) / (n_p + n_u)
    z = (a - b) / F.sqrt(both * (1 - both) * (1.0 / n_p + 1.0 / n_u) + 1e-12)
    counts = counts.where(F.col("p") + F.col("u") >= min_docs).withColumn("z", z)
    # beyond what the largest of so many chance differences reaches; a word for toxicity stands in a confirmed row
    # twice, and more likely in toxic rows than not
    least = float(np.sqrt(2 * np.log(max(2, counts.where(F.col("p") >= min_docs).count()))))
    toxic = (F.col("p") >= min_docs) & (prior * a >= 0.5 * b)
    best = counts.where((F.abs("z") > least) & ((F.col("z") < 0) | toxic)).orderBy(F.desc(F.abs("z")), "word").limit(n_words)
    words = {bytes(r["word"]): i for i, r in enumerate(best.select("word").collect())}

    def numbers(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [sorted(words[w] for w in word_set(x) & words.keys()) for x in as_bytes(batch.column(0))]
        return pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), batch.column(1), batch.column(2)], names=["x", "positive", "drawn"])

    data = in_chunks(rows, numbers, "x array<int>, positive boolean, drawn boolean").toArrow()
    x = [np.array(v, dtype=np.int64) for v in data.column("x").to_pylist()]
    positive, drawn = (np.array(data.column(c).to_pylist(), float) for c in ("positive", "drawn"))
    weights, bias = fit(x, positive, drawn, len(words), prior)
    discard(rows)
    return Model(words, weights, bias)


def score(df: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every whole text."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = shared.value
        z = [m.bias + float(sum(m.weights[m.words[w]] for w in sorted(word_set(x) & m.words.keys()))) for x in as_bytes(batch.column(1))]
        s = 1 / (1 + np.exp(-np.clip(np.array(z), -30, 30)))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.where(s < 1e-9, 0.0, s))], names=["doc_id", "score"])

    return in_chunks(df.select("doc_id", "text"), step, "doc_id long, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold(F.col("doc_id"), 4) != 2)
    model = train(docs.where(fold(F.col("doc_id"), 4) != 2), labels)
    held = (fold(F.col("doc_id"), 4) == 2).alias("held_out")
    return score(docs, model).select("doc_id", held, "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
