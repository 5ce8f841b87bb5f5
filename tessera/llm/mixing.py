"""Mixing sources to target weights: fixed-length blocks, drawn by source for each output shard and joined by index.

Every source's words stand one after the other, in an order of documents by hash and id, and are cut into blocks of a
fixed number of words (the last one is shorter). The mix is a row of slots, cut into output shards. A shard draws how
many of its slots each source gets from a multinomial of the sources' quotas, with a seed of its own; slots of a source
are numbered through the shards. A slot's number goes through the source's pseudorandom permutation of block indices, one
for each pass over the source, and the slot takes that block by a join on (source, index). What a source was drawn above
its quota falls to sources that were drawn below theirs, so that in the end each has exactly its quota, and no block is
taken more than ceil(target / size) times.

A source's quota is its whole passes, and blocks for the rest, of which the last is cut to what is missing: the words
taken are the target's but for less than a block. Targets: weights 1, 2, 3, 1, ... by code point order of the source (null
last) share all words; no target is over ``most`` times its source's words, the excess goes to the others by weight.

Nothing grows with a document, a source or a shard in one task: starts come from sums by (source, bucket), numbers of
slots from sums by (source, group of shards). Only a row for each source goes to the driver, at most ``MAX_SOURCES``.

Edge cases: a null or wordless text has size 0 and is taken 0 times; a null source is a source of its own, after the
others; repeated rows and ids are documents each; a source without words has target 0; an empty table gives no row; a
long text is in many blocks; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import U64, as_bytes, discard, in_chunks, mix, saved, word_spans
from tessera.shipping import ship

#: Words of a block, slots of an output shard, shards of a group whose counts are summed together, rows of a bucket, and
#: the least number of buckets, slots made by a task.
BLOCK, SHARD, GROUP, BUCKET, BUCKETS, SLOTS = 128, 1024, 512, 50_000, 256, 1 << 20
MAX_SOURCES = 1_000_000
NO_SOURCE = "no source"


@dataclass
class Sources:
    """One entry a source, in order: words, blocks, quotas of slots and what the last slot takes."""

    size: np.ndarray
    target: np.ndarray
    n_blocks: np.ndarray
    quota: np.ndarray
    tail: np.ndarray

    @property
    def slots(self) -> int:
        return int(self.quota.sum())


def targets(size: np.ndarray, weight: np.ndarray, most: float = 3.0) -> np.ndarray:
    """Shares of all words by weight, none over ``most`` times its size; the excess is shared again by weight."""
    target, fixed = np.zeros(len(size)), size == 0
    while not fixed.all():
        left = size.sum() - target[fixed].sum()
        target[~fixed] = left * weight[~fixed] / weight[~fixed].sum()
        over = ~fixed & (target > most * size)
        if not over.any():
            break
        target[over] = most * size[over]
        fixed |= over
    return target


def sources_of(size: np.ndarray, block: int, most: float = 3.0) -> Sources:
    size = np.asarray(size, dtype=np.int64)
    target = targets(size.astype(np.float64), np.arange(len(size)) % 3 + 1.0, most)
    words = np.minimum(np.rint(target).astype(np.int64), (most * size).astype(np.int64))
    n_blocks = -(-size // block)
    passes, rest = np.divmod(words, np.maximum(size, 1))
    more = -(-rest // block)
    return Sources(size, target, n_blocks, passes * n_blocks + more, np.where(rest > 0, rest - (more - 1) * block, block))


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The place of each index below n in a pseudorandom order that the key names: a four-round Feistel network over an
    even number of bits, walked on until the place is below n."""
    half = np.array([max(1, (int(x - 1).bit_length() + 1) // 2) for x in np.unique(n)], dtype=U64)
    half = half[np.searchsorted(np.unique(n), n)]
    mask = (U64(1) << half) - U64(1)

    def once(x: np.ndarray, at: np.ndarray) -> np.ndarray:
        left, right = x >> half[at], x & mask[at]
        for r in range(4):
            left, right = right, left ^ (mix(right + key[at] + U64(0x9E3779B97F4A7C15 * (r + 1) % (1 << 64))) & mask[at])
        return (left << half[at]) | right

    at = np.arange(len(index))
    out = once(index.astype(U64), at)
    while len(at := np.flatnonzero(out >= n.astype(U64))):
        out[at] = once(out[at], at)
    return out.astype(np.int64)


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, text, src, size) of every document; src is the source's place in the order, from 0."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = [len(word_spans(t)[1]) for t in as_bytes(batch.column("text"))]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), batch.column("source"), pa.array(words, pa.int64())], names=["doc_id", "text", "source", "size"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_chunks(docs.select("doc_id", "text", "source"), count, f"doc_id {kind}, text string, source string, size long")


def placed(docs: DataFrame, texts: bool) -> tuple[DataFrame, np.ndarray]:
    """((doc_id, src, size, start[, text]) of every document, kept as a table; words by source): ``start`` counts the
    words of the source before the document."""
    spark = docs.sparkSession
    names = ["doc_id", "source", "size", *(["text"] if texts else [])]
    sizes = rows = saved(sized(docs).select(*names, F.xxhash64("text").alias("th")), "sizes")
    by_source = rows.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("rows"))
    # a row for each source; bytes compare as code points do
    kept = by_source.orderBy(F.col("source").isNull(), F.col("source").cast("binary")).limit(MAX_SOURCES + 1).collect()
    if len(kept) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    order = spark.createDataFrame([(r["source"], i) for i, r in enumerate(kept)], "source string, src int")
    buckets = max(BUCKETS, -(-sum(r["rows"] for r in kept) // BUCKET))
    # the table of sources is small (checked above) and is joined by a key that may be null
    rows = rows.join(order, rows["source"].eqNullSafe(order["source"])).drop(order["source"]).drop("source")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "th"), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("src", "bucket").agg(F.sum("size").alias("n")).select("src", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    w = Window.partitionBy("src", "bucket").orderBy("doc_id", "th").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("base") + F.coalesce(F.sum("size").over(w), F.lit(0))
    out = rows.join(base, ["src", "bucket"]).select("doc_id", "src", "size", start.alias("start"), *(["text"] if texts else []))
    out = saved(out, "starts")
    discard(sizes)
    return out, np.array([r["n"] for r in kept], dtype=np.int64)


def pieces(rows: DataFrame, block: int) -> DataFrame:
    """(src, block, start, lo, hi[, doc_id, text]): what lies in each block of a document, as words of the source."""
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    more = ["doc_id", "text"] if "text" in rows.columns else []
    cut = rows.where("size > 0").select("src", "start", "size", *more, F.explode(F.sequence(first, last)).alias("block"))
    return cut.select("src", "block", "start", F.greatest("start", F.col("block") * block).alias("lo"), F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block).alias("hi"), *more)


def drawn(spark: SparkSession, sources: Sources, shard: int, seed: int) -> DataFrame:
    """(shard, src, n) by a multinomial draw a shard."""
    slots, p = sources.slots, sources.quota / max(1, sources.slots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in batch.column(0).to_pylist():
                n = np.random.default_rng([seed, number]).multinomial(min(shard, slots - number * shard), p)
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), number), pa.int64()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=["shard", "src", "n"])

    ship(spark)
    return spark.range(0, -(-slots // shard)).mapInArrow(run, "shard long, src int, n long")


def numbered(counts: DataFrame) -> DataFrame:
    """(shard, src, n, first): the number of a shard's first slot among its source's, by sums of groups of shards."""
    rows = counts.withColumn("g", F.floor(F.col("shard") / GROUP))
    before = Window.partitionBy("src").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("src", "g").agg(F.sum("n").alias("m")).select("src", "g", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("base"))
    w = Window.partitionBy("src", "g").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(base, ["src", "g"]).select("shard", "src", "n", (F.col("base") + F.coalesce(F.sum("n").over(w), F.lit(0))).alias("first"))


def slots(spark: SparkSession, sources: Sources, block: int, shard: int, seed: int) -> DataFrame:
    """(shard, slot, src, block, take): for each slot of the mix its source, the index of its block, and the words that
    it takes of it."""
    counts = saved(drawn(spark, sources, shard, seed), "draws")
    totals = np.zeros(len(sources.size), dtype=np.int64)
    for r in counts.groupBy("src").agg(F.sum("n").alias("n")).collect():  # a row for each source
        totals[r["src"]] = r["n"]
    over, under = np.maximum(totals - sources.quota, 0), np.maximum(sources.quota - totals, 0)
    over_base, under_end = np.cumsum(over) - over, np.cumsum(under)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            src, n, first, number = (batch.column(c).to_numpy() for c in ("src", "n", "first", "shard"))
            for i in range(len(src)):
                j = np.arange(first[i], first[i] + n[i])
                s = np.full(len(j), src[i])
                # beyond the quota: the surplus slots of all sources in one row, laid over the missing ones of the others
                high = np.flatnonzero(j >= sources.quota[src[i]])
                rank = j[high] - sources.quota[src[i]] + over_base[src[i]]
                s[high] = np.searchsorted(under_end, rank, side="right")
                j[high] = totals[s[high]] + rank - (under_end - under)[s[high]]
                turn, at = np.divmod(j, sources.n_blocks[s])
                key = mix((s.astype(U64) << U64(32)) + turn.astype(U64) + mix(np.full(len(s), seed, dtype=U64)))
                take = np.where(j == sources.quota[s] - 1, sources.tail[s], block)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(j), number[i]), pa.int64()), pa.array(j, pa.int64()), pa.array(s, pa.int32()), pa.array(permuted(at, sources.n_blocks[s], key), pa.int64()), pa.array(take, pa.int64())], names=["shard", "slot", "src", "block", "take"])

    # a row of counts becomes many slots: they are made in as many tasks as slots need, and written, so that the join
    # knows how large they are
    tasks = min(-(-sources.slots // shard), max(int(spark.conf.get("spark.sql.shuffle.partitions")), sources.slots // SLOTS))
    rows = numbered(counts).select("shard", "src", "n", "first").repartition(tasks)
    out = saved(rows.mapInArrow(run, "shard long, slot long, src int, block long, take long"), "slots")
    discard(counts)
    return out


def cut(taken: DataFrame, block: int) -> DataFrame:
    """Pieces that a slot takes, ended at what the slot takes of its block."""
    end = F.least("hi", F.col("block") * block + F.col("take"))
    return taken.withColumn("hi", end).where(F.col("hi") > F.col("lo"))


def texts(docs: DataFrame, block: int = BLOCK, shard: int = SHARD, seed: int = 0) -> DataFrame:
    """The mix itself: (shard, src, slot, doc_id, from_word, n_words, text), one row for each piece of a document in a
    slot; a slot's pieces in order of from_word within their documents' order make its block."""
    rows, size = placed(docs, texts=True)
    s = sources_of(size, block)
    if not s.slots:
        return docs.sparkSession.createDataFrame([], f"shard long, src int, slot long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, from_word long, n_words long, text string")
    own = pieces(rows, block).withColumn("words", F.slice(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != ""), (F.col("lo") - F.col("start") + 1).cast("int"), (F.col("hi") - F.col("lo")).cast("int"))).drop("text")
    met = cut(slots(docs.sparkSession, s, block, shard, seed).join(own, ["src", "block"]), block)
    n = F.col("hi") - F.col("lo")
    return met.select("shard", "src", "slot", "doc_id", (F.col("lo") - F.col("start")).alias("from_word"), n.alias("n_words"), F.array_join(F.slice("words", F.lit(1), n.cast("int")), " ").alias("text"))


def shares(docs: DataFrame, block: int = BLOCK, shard: int = SHARD, seed: int = 0) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every document."""
    spark = docs.sparkSession
    rows, size = placed(docs, texts=False)
    s = sources_of(size, block)
    known = spark.createDataFrame([(i, int(n), float(t)) for i, (n, t) in enumerate(zip(s.size, s.target, strict=True))], "src int, source_size long, target double")
    if s.slots:
        met = cut(slots(spark, s, block, shard, seed).join(pieces(rows, block), ["src", "block"]), block)
        # a document with words is named by its source and start
        taken = met.groupBy("src", "start").agg(F.sum(F.col("hi") - F.col("lo")).alias("taken")).withColumn("some", F.lit(True))
    else:
        taken = spark.createDataFrame([], "src int, start long, taken long, some boolean")
    rows = rows.withColumn("some", F.when(F.col("size") > 0, True))
    out = rows.join(taken, ["src", "start", "some"], "left").join(known, "src")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shares(spark.read.parquet(f"{sf_dir}/documents.parquet"))
