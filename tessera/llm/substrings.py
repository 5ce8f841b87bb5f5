"""Substring deduplication by seed and extend.

Seeds. Every window of ``size`` consecutive words has an anchor: the run of ``gram`` words inside it with the smallest
hash (winnowing). Equal windows have equal anchors, and the windows that share an anchor place form one stretch, the
segment of that anchor, so about two anchors in ``size`` words stand for all windows.

Extension. Occurrences of one anchor meet by its hash. Those with the same whole segment extend each other over all of
it at once: they form a class, of which only the first document goes on. Between the classes of an anchor the match is
extended word by word to both sides: the alignments of a window around the anchor, from the furthest left to the
furthest right, are compared by the hash of all their words, each class against the smallest document that has the
same window. No pairs are formed, so the work stays linear in the number of occurrences however large a group is.
Overlapping matches merge into maximal repeats, spans of at least ``size`` words.

A word is removed if it lies in a window that also starts in a document of smaller id.

Edge cases: null, empty and short texts have no window and keep all words; rows with a null id neither remove nor are
removed from; rows of equal id never remove each other's words, and each gets its own result; an empty table gives an
empty result. Very long texts are read whole. A column named ``spans`` is replaced, as are those that begin with _row or
_doc; other columns pass through. The spans of all rows of one id stand side by side in each of its rows, told apart by
a key of the text. Hash keys are 128 bits wide (anchor and segment, or anchor and window).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import WORDS, WORDS2, as_bytes, in_chunks, release, saved, signed, word_hashes, word_spans

OCCURRENCE = "anchor long, segment long, doc long, row long, start int, n int"


def segments(h: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, segment hash, first window, number of windows) of a document's word hashes."""
    width = size - gram + 1
    grams = WORDS.windows(h, gram)
    if len(grams) < width:
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none.view(np.uint64), none, none
    at = np.arange(len(grams) - width + 1) + np.lib.stride_tricks.sliding_window_view(grams, width).argmin(axis=1)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    n = np.diff(np.append(first, len(at)))
    return grams[at[first]], WORDS2.slices(h, first, first + n - 1 + size), first, n


def row_key(data: bytes) -> int:
    """Tells rows of equal id apart."""
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def occurrences(df: DataFrame, size: int, gram: int) -> DataFrame:
    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols = [[], [], [], [], [], []]
        for doc, data in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
            a, s, first, n = segments(word_hashes(data)[0], size, gram)
            for c, v in zip(cols, (signed(a), signed(s), np.full(len(a), doc, np.int64), np.full(len(a), row_key(data), np.int64), first.astype(np.int32), n.astype(np.int32)), strict=True):
                c.append(v)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names=[x.split()[0] for x in OCCURRENCE.split(", ")])

    return in_chunks(df.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text"), step, OCCURRENCE)


def windows(df: DataFrame, size: int) -> DataFrame:
    """Every window of the wanted segments; ``df`` has doc, row, text and a list of wanted (start, n, anchor, segment)."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols = [[], [], [], [], []]
        for doc, row, data, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2)), batch.column(3).to_pylist(), strict=True):
            if row_key(data) != row:
                continue
            h = word_hashes(data)[0]
            for w in wanted:
                at = np.arange(w["start"], w["start"] + w["n"])
                hashes = signed(WORDS2.slices(h, at, at + size))
                for c, v in zip(cols, (np.full(len(at), w["anchor"]), hashes, np.full(len(at), doc), np.full(len(at), w["segment"]), (at - w["start"]).astype(np.int32)), strict=True):
                    c.append(v)
        kinds = [pa.int64()] * 4 + [pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else [], k) for c, k in zip(cols, kinds, strict=True)], names=["anchor", "window", "doc", "segment", "at"])

    return in_chunks(df, step, "anchor long, window long, doc long, segment long, at int")


def repeats(df: DataFrame, size: int = 50, gram: int = 10) -> DataFrame:
    """(doc, row, spans): for each row that loses words, the [start, end) word spans to remove, possibly overlapping."""
    found = occurrences(df, size, gram)
    # anchors in more than one document; the partial sums are made before the exchange
    shared = found.groupBy("anchor").agg(F.min("doc").alias("a"), F.max("doc").alias("b"), (F.min("segment") != F.max("segment")).alias("several"))
    shared = saved(shared.where("a < b").select("anchor", "several"), "anchors")
    release(df.sparkSession)
    seeds = saved(found.join(shared, "anchor"), "seeds")
    release(df.sparkSession)
    classes = saved(seeds.groupBy("anchor", "segment", "several").agg(F.min(F.struct("doc", "row", "start", "n")).alias("first")).select("anchor", "segment", "several", "first.*"), "classes")
    # alignments between the classes of an anchor
    wanted = classes.where("several").groupBy("doc", "row").agg(F.collect_list(F.struct("start", "n", "anchor", "segment")).alias("wanted"))
    texts = df.select(F.col("doc_id").alias("doc"), "text")
    aligned = saved(windows(wanted.join(texts, "doc").select("doc", "row", "text", "wanted"), size), "windows")
    release(df.sparkSession)
    earliest = saved(aligned.groupBy("anchor", "window").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a < b").select("anchor", "window", F.col("a").alias("earliest")), "earliest")
    matched = aligned.join(earliest, ["anchor", "window"]).where("doc > earliest").groupBy("anchor", "segment").agg(F.collect_list("at").alias("hits"))
    firsts = saved(classes.select("anchor", "segment", F.col("doc").alias("first")).join(matched, ["anchor", "segment"], "left"), "firsts")
    # a later document of a class loses the whole segment, the first one what an earlier class has too
    both = seeds.join(firsts, ["anchor", "segment"])
    whole = F.array(F.struct(F.col("start").alias("a"), (F.col("start") + F.col("n") + (size - 1)).alias("b")))
    some = F.transform("hits", lambda x: F.struct((F.col("start") + x).alias("a"), (F.col("start") + x + size).alias("b")))
    spans = both.select("doc", "row", F.when(F.col("doc") > F.col("first"), whole).otherwise(some).alias("spans")).where("spans is not null")
    return spans.groupBy("doc", "row").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def removed(n: int, spans: list[dict]) -> np.ndarray:
    """Which of n words the spans cover."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, np.fromiter((s["a"] for s in spans), np.int64, len(spans)), 1)
    np.add.at(edge, np.fromiter((s["b"] for s in spans), np.int64, len(spans)), -1)
    return np.cumsum(edge)[:n] > 0


def with_spans(df: DataFrame, size: int = 50, gram: int = 10) -> DataFrame:
    """``df`` with a ``spans`` column, null where nothing is removed."""
    spans = saved(repeats(df, size, gram).withColumnRenamed("row", "_row").withColumnRenamed("doc", "_doc"), "spans")
    release(df.sparkSession)
    # a document has one row here unless rows repeat an id; the row key then decides
    by_doc = spans.groupBy("_doc").agg(F.collect_list(F.struct("_row", "spans")).alias("spans"))
    return df.drop("spans", "_doc", "_row").join(by_doc, F.col("doc_id") == F.col("_doc"), "left").drop("_doc")


def own(spans: list[dict] | None, data: bytes) -> list[dict]:
    """The spans of this row among those of its id."""
    if not spans:
        return []
    key = row_key(data)
    return next((s["spans"] for s in spans if s["_row"] == key), [])


def digest(df: DataFrame) -> DataFrame:
    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for doc, data, spans in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            words = data.split()
            found = own(spans, data)
            gone = removed(len(words), found) if found else np.zeros(len(words), bool)
            kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if found else words
            rows.append((doc, len(words), int(gone.sum()), hashlib.sha256(b" ".join(kept)).hexdigest()))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [pa.int64(), pa.int64(), pa.int64(), pa.string()], strict=True)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return in_chunks(df.select("doc_id", "text", "spans"), step, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def cut(data: bytes, gone: np.ndarray) -> bytes:
    """A text without the marked words; runs of kept words stay as they were, one space between two runs."""
    _, starts, ends = word_spans(data)
    edge = np.flatnonzero(np.diff((~gone).astype(np.int8), prepend=0, append=0))
    return b" ".join(data[starts[a] : ends[b - 1]] for a, b in zip(edge[0::2], edge[1::2], strict=True))


def without(df: DataFrame) -> DataFrame:
    """``df`` (with ``spans``) without the repeated words; ``_changed`` marks edited texts, untouched ones keep every byte."""
    kept = [f for f in df.schema if f.name not in ("text", "spans")]
    df = df.select(*[f.name for f in kept], "text", "spans")

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, changed = [], []
        given = batch.column(len(kept)).to_pylist()
        for text, data, spans in zip(given, as_bytes(batch.column(len(kept))), batch.column(len(kept) + 1).to_pylist(), strict=True):
            found = own(spans, data)
            changed.append(bool(found))
            texts.append(cut(data, removed(len(data.split()), found)).decode() if found else text)
        return pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(texts, pa.string()), pa.array(changed)], names=[*batch.schema.names[:-1], "_changed"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return in_chunks(df, step, f"{fields}, text string, _changed boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digest(with_spans(docs))
