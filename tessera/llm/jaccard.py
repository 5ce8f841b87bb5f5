"""Exact n-gram Jaccard self-join with set relations, and the connected components of its links.

A document is the set of its distinct word shingles, as 64-bit hashes. Two sets link when den * intersection >=
num * union. The steps and what each one skips:

* Equal sets form a class that answers once, for all its documents.
* Index lists hold a token of a set only if its position in the global order lies in the prefix that a partner must
  reach into (size - ceil(num/den * size) + 1 places). The order puts frequent tokens last, by a count sketch of all
  documents; any order is exact, so the sketch's errors cost time only.
* Each entry of a list carries its reach: the largest partner whose link with it can begin at this position, as all
  tokens before it are then unshared. Two entries meet only if each one's size is within the other's reach. Whole
  blocks of a list are skipped by the least size and the largest reach in them.
* Answers are derived from similar sets. A list's pivot is its entry of the least position, so the one with the
  fewest rare tokens: among near copies the cleanest copy. First every entry is compared with its list's pivot alone.
  What links to the pivot shares its component and so its answers; only entries of other components are then searched
  in the rest of their list, and pairs within a component are never formed. Of the pairs between two components the
  closest one is verified first, the others only if it does not link them.
* Parity bitmaps (an upper bound on the overlap) are compared before whole texts are.

So the work in a group of near copies grows with its size, not with its square, but for pairs of different components
that no bound tells from a link; those are all verified.

Edge cases: null, empty and wordless texts have an empty set, link with nothing and are their own component; a text of
fewer words than a shingle has one shingle, all its words; very long texts are read whole; rows with a null id are
never linked and have a null component; rows that repeat an id count as one node, to which the links of every text of
theirs hold; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import LOWER, U64, WORDS, WORDS2, as_bytes, discard, in_chunks, release, saved, signed, word_hashes
from tessera.shipping import ship

#: The sketch has 2 ** BITS counters, sent in slices; more of them tell rarer tokens apart in larger tables.
BITS, SLICE = 22, 1 << 17
#: A broadcast table of (id, hash) pairs has at most so many rows.
SMALL = 200_000
SETS = "doc long, th long, n int, h1 long, h2 long, bits binary, prefix array<long>"


def shingles(data: bytes, k: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    h = word_hashes(data.translate(LOWER))[0]
    if not len(h):
        return h
    return np.unique(WORDS.windows(h, k) if len(h) >= k else WORDS.slices(h, np.array([0]), np.array([len(h)])))


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """Parity of the tokens that fall on each of 256 * 2**c bits, at least a bit a token."""
    bits = 256
    while bits < len(tokens):
        bits *= 2
    odd = np.bincount((tokens & U64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little")


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """Rows of bitmaps folded to ``size`` words: parity over the lower bits of the hash only."""
    while bits.shape[1] > size:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


def cell(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> U64(64 - BITS)).astype(np.int64)


def sketch(df: DataFrame, k: int) -> np.ndarray:
    """A class for each cell of tokens by how many documents have one of them, summed over all documents: 0 up to what
    rare tokens alone make (six deviations above the median), then one more for every doubling of the excess."""
    kinds = {"slice": pa.int32(), "cells": pa.binary()}
    row = lambda i, cells: pa.RecordBatch.from_arrays([pa.array([i], kinds["slice"]), pa.array([zstandard.ZstdCompressor(level=1).compress(cells.astype("<i4").tobytes())], kinds["cells"])], names=list(kinds))
    counts = lambda data: np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "<i4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << BITS, np.int32)
        for batch in batches:
            for data in as_bytes(batch.column(0)):
                np.add.at(cells, cell(shingles(data, k)), 1)
        for i in range(0, len(cells), SLICE):
            if cells[i : i + SLICE].any():
                yield row(i, cells[i : i + SLICE])

    def total(key: tuple, groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(SLICE, np.int64)
        for batch in groups:
            for x in batch.column(1).to_pylist():
                out += counts(x)
        yield row(key[0].as_py(), np.minimum(out, 2**31 - 1))

    ship(df.sparkSession)
    rows = df.select("text").where(F.col("text").isNotNull()).mapInArrow(run, "slice int, cells binary").groupBy("slice").applyInArrow(total, "slice int, cells binary")
    cells = np.zeros(1 << BITS)
    for r in rows.collect():
        cells[r["slice"] : r["slice"] + SLICE] = counts(bytes(r["cells"]))
    middle = float(np.median(cells))
    return np.ceil(np.log2(np.maximum(1, (cells - middle) / (6 * np.sqrt(middle + 1))))).astype(np.uint8)


def sets(df: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """One row a document: hash of its text, size, 128-bit identity, bitmap and prefix of its set. An empty set, which
    links with nothing, has the identity of its row."""
    heavy = df.sparkSession.sparkContext.broadcast(sketch(df, k))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for doc, th, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2)), strict=True):
            t = shingles(data, k)
            n = len(t)
            if not n:
                rows.append((doc, th, 0, doc or 0, th, b"", []))
                continue
            same = [int(signed(r.slices(t, np.array([0]), np.array([n])))[0]) for r in (WORDS, WORDS2)]
            order = np.argsort(heavy.value[cell(t)], kind="stable")  # t is sorted already
            rows.append((doc, th, n, *same, bitmap(t).tobytes(), signed(t[order[: n + (-num * n) // den + 1]])))
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in SETS.split(", ")])

    return in_chunks(df.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("th"), "text"), step, SETS)


def distances(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """Bits that differ in each pair of bitmaps, both folded to the smaller one's width: at most the tokens that only
    one of the two sets has."""
    width = np.array([(len(x), len(y)) for x, y in zip(left, right, strict=True)], np.int64).reshape(-1, 2)
    out = np.zeros(len(width), np.int64)
    for a, b in np.unique(width, axis=0):
        at = np.flatnonzero((width[:, 0] == a) & (width[:, 1] == b))
        x, y = (np.frombuffer(b"".join(side[i] for i in at), "<u8").reshape(len(at), -1) for side in (left, right))
        size = min(a, b) // 8
        out[at] = np.bitwise_count(folded(x, size) ^ folded(y, size)).sum(axis=1, dtype=np.int64)
    return out


def near(pairs: DataFrame, reps: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b and others) whose bitmaps do not rule a link out, with the bits ``apart``."""
    side = lambda x: reps.select(F.col("doc").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}"))
    names = pairs.columns
    rows = pairs.join(side("a"), "a").join(side("b"), "b").select(*names, "n_a", "n_b", "bits_a", "bits_b")
    at = len(names)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        apart = distances(batch.column(at + 2).to_pylist(), batch.column(at + 3).to_pylist())
        size = batch.column(at).to_numpy().astype(np.int64) + batch.column(at + 1).to_numpy()
        keep = (num + den) * apart <= (den - num) * size
        return pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(apart)], names=[*names, "apart"]).filter(pa.array(keep))

    return in_chunks(rows, step, ", ".join(f"{c} long" for c in [*names, "apart"]))


def index_lists(reps: DataFrame, num: int, den: int) -> DataFrame:
    """A table of the entries of the lists that two sets or more are in: token, doc, vertex, n, reach, and the list's
    pivot. Most tokens have one set only; their lists go before anything else is made of them. What is found for each
    token is written before it is joined back, so that AQE can split a hot token."""
    each = reps.select("doc", "vertex", "n", F.posexplode("prefix").alias("pos", "token"))
    shared = saved(each.groupBy("token").agg(F.count("*").alias("size")).where("size > 1").select("token"), "tokens")
    held = saved(each.join(shared, "token"), "lists")
    lists = held.withColumn("reach", F.floor((F.col("n") - F.col("pos")).cast("long") * (num + den) / num).cast("long") - F.col("n"))
    pivots = lists.groupBy("token").agg(F.min(F.struct("pos", "doc", "n", "reach")).alias("p"))
    pivots = pivots.select("token", F.col("p.doc").alias("pivot"), F.col("p.n").alias("pivot_n"), F.col("p.reach").alias("pivot_reach"))
    pivots = saved(pivots, "pivots")
    out = saved(lists.drop("pos").join(pivots, "token"), "entries")
    discard(shared, held, pivots)
    return out


def with_pivots(entries: DataFrame) -> DataFrame:
    """(a, b): each list's pivot with every entry that it may link to."""
    met = entries.where("doc != pivot and n <= pivot_reach and pivot_n <= reach")
    return met.select(F.col("pivot").alias("a"), F.col("doc").alias("b")).distinct()


def between(entries: DataFrame, comps: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(a, b, ca, cb): every pair of one list, of components ca != cb, that may link and was not met at a pivot; and
    the scratch table it is read from.

    Entries outside the component of their list's pivot search it: first those are dropped that no size and reach in
    the list allows, then the entries that none of the rest can reach. The join's hot tokens are split by AQE.
    """
    e = entries.withColumn("comp", F.col("vertex")) if comps is None else entries.join(comps.withColumnRenamed("doc", "vertex"), "vertex", "left").withColumn("comp", F.coalesce("comp", "vertex"))
    e = e.select("token", "doc", "n", "reach", "pivot", "comp")
    home = F.max(F.when(F.col("doc") == F.col("pivot"), F.col("comp")))
    lists = e.groupBy("token").agg(home.alias("home"), F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.min("n").alias("least"), F.max("reach").alias("most")).where("c0 < c1")
    lists = saved(lists.select("token", "home", "least", "most"), "homes")
    e = saved(e.join(lists, "token"), "mixed")
    discard(lists)
    probes = e.where("comp != home and least <= reach and n <= most")
    reached = saved(probes.groupBy("token").agg(F.min("n").alias("p_least"), F.max("reach").alias("p_most")), "reached")
    others = saved(e.join(reached, "token").where("n <= p_most and p_least <= reach and doc != pivot"), "others")
    discard(reached)
    x, y = others.select("token", "doc", "n", "reach", "comp", "home").alias("x"), probes.select("token", "doc", "n", "reach", "comp").alias("y")
    met = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.comp") != F.col("y.comp")) & (F.col("x.n") <= F.col("y.reach")) & (F.col("y.n") <= F.col("x.reach")) & ((F.col("x.comp") == F.col("x.home")) | (F.col("x.doc") < F.col("y.doc"))))
    first = F.col("x.doc") < F.col("y.doc")
    pick = lambda c, turn: F.when(first != F.lit(turn), F.col(f"x.{c}")).otherwise(F.col(f"y.{c}"))
    return met.select(pick("doc", False).alias("a"), pick("doc", True).alias("b"), pick("comp", False).alias("ca"), pick("comp", True).alias("cb")).distinct(), e


def texts_of(df: DataFrame, reps: DataFrame, pairs: DataFrame) -> DataFrame:
    """A table (node, vertex, text) of the nodes of some pairs; few of them are sent to the texts, many are joined."""
    nodes = pairs.select(F.col("a").alias("doc")).union(pairs.select(F.col("b").alias("doc"))).distinct()
    wanted = saved(reps.join(nodes, "doc").select(F.col("doc").alias("node"), F.col("rep").alias("doc_id"), "th", "vertex"), "wanted")
    few = wanted.count() <= SMALL
    texts = df.select("doc_id", "text", F.xxhash64("text").alias("th")).join(F.broadcast(wanted) if few else wanted, ["doc_id", "th"])
    texts = saved(texts.select("node", "vertex", "text"), "texts")
    discard(wanted)
    return texts


def verified(pairs: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The vertices of those pairs (a, b) whose whole sets link; ``texts`` has node, vertex and text."""
    side = lambda x: texts.select(F.col("node").alias(x), F.col("vertex").alias(f"vertex_{x}"), F.col("text").alias(f"text_{x}"))
    rows = pairs.join(side("b"), "b").join(side("a"), "a")

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep, last, x = [], None, None
        for ta, tb in zip(as_bytes(batch.column(2)), as_bytes(batch.column(3)), strict=True):
            if ta != last:
                last, x = ta, shingles(ta, k)
            y = shingles(tb, k)
            same = len(x) + len(y) - len(np.union1d(x, y))
            keep.append(len(x) > 0 and den * same >= num * (len(x) + len(y) - same))
        return batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return in_chunks(rows.select(F.col("vertex_a").alias("a"), F.col("vertex_b").alias("b"), "text_a", "text_b"), step, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(doc, comp): the smallest document reachable from each document of an edge (u, v), by alternating large and small
    stars; every step takes minima before its exchange and joins them back, so hubs are no bottleneck."""
    pairs = saved(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), "edges")
    before = None
    while True:
        both = pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = saved(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = saved(large, "large")
        discard(pairs, low)
        low = saved(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u").select(F.col("v").alias("x"), "m").where("x != m").union(low.select(F.col("u").alias("x"), "m"))
        pairs = saved(small.select(F.col("x").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        discard(large, low)
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return pairs.select(F.col("u").alias("doc"), F.col("v").alias("comp"))
        before = now


def shared(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges (u, v) between the representatives of classes that rows of one id are in."""
    key = F.struct("h1", "h2", "n")
    twice = saved(rows.where("doc is not null").groupBy("doc").agg(F.min(key).alias("x"), F.max(key).alias("y")).where("x != y").select("doc"), "twice")
    at = rows.join(twice, "doc", "left_semi").select("doc", "h1", "h2", "n").distinct().join(classes, ["h1", "h2", "n"]).select("doc", "rep").distinct()
    return at.join(at.groupBy("doc").agg(F.min("rep").alias("v")), "doc").select(F.col("rep").alias("u"), "v").where("u != v")


def grouped(df: DataFrame, k: int, num: int, den: int, by_id: bool) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(rows, classes of equal sets, components of their vertices if any link).

    A class has a node of its own, in the order of its smallest row (rep, th). The components' vertices are the nodes,
    or with ``by_id`` the ids, so that classes with a document in common are one.
    """
    if not 0 < num <= den:
        raise ValueError(f"the threshold {num}/{den} is not above 0 and at most 1")
    spark, vertex = df.sparkSession, "rep" if by_id else "node"
    rows = saved(sets(df, k, num, den), "sets")
    least = rows.where("doc is not null").groupBy("h1", "h2", "n").agg(F.min(F.struct("doc", "th")).alias("r")).select("h1", "h2", "n", F.col("r.doc").alias("rep"), F.col("r.th").alias("th"))
    classes = saved(least.orderBy("rep", "th").withColumn("node", F.monotonically_increasing_id()), "classes")
    reps = rows.where("n > 0").join(classes.withColumnRenamed("rep", "doc"), ["h1", "h2", "n", "doc", "th"]).dropDuplicates(["node"])
    reps = saved(reps.select(F.col("node").alias("doc"), F.col("doc").alias("rep"), "th", F.col("doc" if by_id else "node").alias("vertex"), "n", "bits", "prefix"), "reps")
    release(spark)
    entries = index_lists(reps, num, den)
    release(spark)
    links, comps = None, None

    def link(pairs: DataFrame) -> None:
        """Verify pairs and take the links found into the components."""
        nonlocal links, comps
        texts = texts_of(df, reps, pairs)
        release(spark)
        new = saved(verified(pairs.select("a", "b"), texts, k, num, den).select(F.col("b").alias("u"), F.col("a").alias("v")), "links")
        discard(texts)
        if not new.isEmpty():
            links = new if links is None else links.union(new)
            comps = saved(components(links), "comps")

    if by_id:
        same = saved(shared(rows, classes), "same")
        if not same.isEmpty():
            links, comps = same, saved(components(same), "comps")
    first = saved(near(with_pivots(entries), reps, num, den), "near")
    if not first.isEmpty():
        link(first)
    rest, mixed = between(entries, comps)
    rest = saved(near(rest, reps, num, den), "near")
    discard(mixed, entries)
    if not rest.isEmpty():
        closest = rest.groupBy("ca", "cb").agg(F.min_by(F.struct("a", "b"), F.struct("apart", "a", "b")).alias("p")).select("p.a", "p.b")
        closest = saved(closest, "closest")
        link(closest)
        left = rest.select("a", "b").join(closest, ["a", "b"], "left_anti")
        if comps is not None:
            at = reps.select("doc", "vertex").join(comps.withColumnRenamed("doc", "vertex"), "vertex", "left").select("doc", F.coalesce("comp", "vertex").alias("comp"))
            left = left.join(at.toDF("a", "ca"), "a").join(at.toDF("b", "cb"), "b").where("ca != cb").select("a", "b")
        left = saved(left, "left")
        if not left.isEmpty():
            link(left)
        discard(closest, left)
    discard(reps, first, rest)
    return rows, classes, comps


def linked(df: DataFrame, k: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """(doc, n, component) of every row of ``df`` (doc_id, text)."""
    rows, classes, comps = grouped(df, k, num, den, by_id=True)
    out = rows.select("doc", "n", "h1", "h2").join(classes.select("h1", "h2", "n", "rep"), ["h1", "h2", "n"], "left")
    if comps is not None:
        out = out.join(comps.withColumnRenamed("doc", "rep"), "rep", "left")
    else:
        out = out.withColumn("comp", F.lit(None).cast("long"))
    return out.select("doc", "n", F.when(F.col("doc").isNotNull(), F.coalesce("comp", "rep", "doc")).alias("component"))


def firsts(df: DataFrame, k: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """(doc_id, th) of the first row, by id and hash of its text, of each group of linked texts; texts of one id are
    linked only if their sets are."""
    _, classes, comps = grouped(df, k, num, den, by_id=False)
    if comps is not None:
        classes = classes.join(comps.where("doc != comp").withColumnRenamed("doc", "node"), "node", "left_anti")
    return classes.select(F.col("rep").alias("doc_id"), "th")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return linked(docs).select(F.col("doc").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.col("component").alias("component_id"))
