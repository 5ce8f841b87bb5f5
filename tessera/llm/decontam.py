"""Benchmark decontamination with an FM-index of every training shard.

A shard is a run of documents in one task. Its text is a sequence of word numbers over the benchmark's vocabulary; a
word that no benchmark item has can be in no occurrence, so a run of such words becomes one separator, as does the
end of a document, and stretches between separators too short to hold a test phrase are left out. The index keeps
the Burrows-Wheeler transform in a wavelet matrix (rank of any symbol in as many steps as it has bits), the symbol
starts, and every eighth suffix position. A phrase is searched backwards, word by word, by two ranks a step; the rows
found are located by walking back to a sampled position; the spans of all occurrences are merged per document.

Phrases are the windows of ``size`` consecutive words of an item, or all its words if it has fewer. All phrases are
searched together, one numpy step a word. A benchmark is collected and sent to the tasks in groups of items of bounded
bytes, one group at a time; the spans of the groups are joined by row and merged.

Edge cases: null, empty and wordless texts have no words and no hits; very long texts are indexed whole, as a shard of
their own if need be; null or wordless items have no phrase; items with equal text all count, under their own ids, a
null id as None; with an empty benchmark nothing is hit; repeated documents are each reported; other columns are handed
on whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tessera.llm.common import ALNUM, as_bytes, in_chunks, saved
from tessera.shipping import ship


def words_of(data: bytes) -> list[bytes]:
    """Words of ASCII digits and letters (lower-cased) and non-ASCII bytes."""
    return data.translate(ALNUM).split()


class WaveletMatrix:
    """Ranks over a sequence of small integers."""

    STEP = 512

    def __init__(self, values: np.ndarray, bits: int):
        self.bits, self.n = bits, len(values)
        self.levels: list[tuple[np.ndarray, np.ndarray, int]] = []
        for b in range(bits - 1, -1, -1):
            bit = (values >> b & 1).astype(np.uint8)
            # ones before every STEP-th place, and the bits packed for the rest
            sums = np.concatenate([[0], np.add.reduceat(bit, np.arange(0, max(1, self.n), self.STEP), dtype=np.int64)]) if self.n else np.zeros(1, np.int64)
            packed = np.packbits(np.concatenate([bit, np.zeros(-self.n % self.STEP + self.STEP, np.uint8)]))
            zeros = self.n - int(bit.sum())
            self.levels.append((np.cumsum(sums), packed, zeros))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones among the first ``at`` bits of a level."""
        sums, packed, _ = self.levels[level]
        block, inside = at // self.STEP, at % self.STEP
        out = sums[block]
        start = block * (self.STEP // 8)
        for k in range(self.STEP // 64):
            todo = np.flatnonzero(inside > 64 * k)
            if not len(todo):
                break
            word = packed.view(">u8")[(start[todo] >> 3) + k].astype(np.uint64)
            keep = np.minimum(inside[todo] - 64 * k, 64)
            word = word >> (64 - keep).astype(np.uint64)
            out[todo] += np.bitwise_count(word).astype(np.int64)
        return out

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol among the first ``at`` values."""
        lo, hi = np.zeros(len(at), np.int64), at.astype(np.int64).copy()
        for level in range(self.bits):
            one = symbol >> (self.bits - 1 - level) & 1 == 1
            a, b = self._ones(level, lo), self._ones(level, hi)
            zeros = self.levels[level][2]
            lo, hi = np.where(one, zeros + a, lo - a), np.where(one, zeros + b, hi - b)
        return hi - lo

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol, its occurrences before that place) of each place."""
        value, lo, hi = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), at.astype(np.int64).copy()
        for level in range(self.bits):
            _, packed, zeros = self.levels[level]
            one = (packed[hi >> 3] >> (7 - (hi & 7)) & 1) == 1
            a, b = self._ones(level, lo), self._ones(level, hi)
            lo, hi = np.where(one, zeros + a, lo - a), np.where(one, zeros + b, hi - b)
            value = value * 2 + one
        return value, hi - lo


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix order by prefix doubling; only suffixes whose rank is still shared are sorted again."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    first = np.concatenate([[True], text[order][1:] != text[order][:-1]])
    rank = np.empty(n, np.int64)
    head = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank[order] = head
    k = 1
    while True:
        # groups of one are settled; the rest is sorted by (group, rank k further on)
        last = np.append(first[1:], True)
        open_ = np.flatnonzero(~(first & last))
        if not len(open_):
            return order
        at = order[open_]
        group = head[open_]
        ahead = np.where(at + k < n, rank[np.minimum(at + k, n - 1)], -1) + 1
        by = np.argsort(group * (n + 1) + ahead, kind="stable")
        at, group, ahead = at[by], group[by], ahead[by]
        order[open_] = at
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (ahead[1:] != ahead[:-1])])
        first[open_] = new
        head = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        rank[at] = head[open_]
        k *= 2


class FMIndex:
    """Count and locate over a sequence of symbols 1.., 0 being the separator; inside, all are one higher, as the end
    needs a symbol of its own."""

    SAMPLE = 8

    def __init__(self, text: np.ndarray, alphabet: int):
        text = np.append(text + 1, 0)
        order = suffix_array(text)
        bits = int(alphabet + 1).bit_length()
        self.n = len(text)
        self.bwt = WaveletMatrix(text[order - 1], bits)
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=alphabet + 2))])
        mark = order % self.SAMPLE == 0
        self.marked = np.concatenate([[0], np.cumsum(mark)])
        self.sampled = order[mark]
        self.mark = mark

    def search(self, words: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[lo, hi) of the suffixes that begin with each phrase, by backward search; a phrase is a row of ``words``, its
        last word first, of which the first ``size`` count."""
        lo, hi = np.zeros(len(size), np.int64), np.full(len(size), self.n, np.int64)
        for step in range(int(size.max(initial=0))):
            live = np.flatnonzero((size > step) & (lo < hi))
            if not len(live):
                break
            symbol = words[live, step].astype(np.int64) + 1
            both = self.bwt.rank(np.concatenate([symbol, symbol]), np.concatenate([lo[live], hi[live]]))
            lo[live], hi[live] = self.starts[symbol] + both[: len(live)], self.starts[symbol] + both[len(live) :]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each suffix row."""
        out, at, steps = np.zeros(len(rows), np.int64), rows.copy(), 0
        live = np.arange(len(rows))
        while len(live):
            hit = self.mark[at[live]]
            done = live[hit]
            out[done] = self.sampled[self.marked[at[done]]] + steps
            live = live[~hit]
            if len(live):
                symbol, before = self.bwt.access(at[live])
                at[live] = self.starts[symbol] + before
            steps += 1
        return out


class Phrases:
    """The benchmark's vocabulary, its distinct phrases (rows of ``words``, last word first) and the items of each."""

    def __init__(self, items: list[tuple[int | None, str | None]], size: int = 10):
        self.number: dict[bytes, int] = {}
        self.names = [item for item, _ in items]
        rows, owners, sizes = [np.zeros((0, size), np.int32)], [], []
        for k, (_, text) in enumerate(items):
            ids = np.array([self.number.setdefault(w, len(self.number) + 1) for w in words_of((text or "").encode())], np.int32)
            n = min(size, len(ids))
            if n:
                found = np.zeros((len(ids) - n + 1, size), np.int32)
                found[:, :n] = np.lib.stride_tricks.sliding_window_view(ids, n)[:, ::-1]
                rows.append(found)
                owners += [k] * len(found)
                sizes += [n] * len(found)
        # zeros pad the rows, and no word is 0, so equal rows are equal phrases
        self.words, of = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
        self.size = (self.words > 0).sum(axis=1)
        order = np.argsort(of.ravel(), kind="stable")
        self.owners, self.at = np.array(owners, np.int64)[order], np.searchsorted(of.ravel()[order], np.arange(len(self.words) + 1))
        self.shortest = int(self.size.min(initial=size)) if len(self.size) else 0

    def items(self, phrases: set[int]) -> set:
        return {self.names[k] for f in phrases for k in self.owners[self.at[f] : self.at[f + 1]].tolist()}


def merge(spans) -> list[list[int]]:
    """Spans in order, those that touch as one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


class Shard:
    """Documents of one task until there are enough for an index."""

    def __init__(self, phrases: Phrases, max_symbols: int):
        self.p, self.max_symbols = phrases, max_symbols
        self.clear()

    def clear(self) -> None:
        self.parts: list[np.ndarray] = []  # symbols of each stretch, a separator after it
        self.where: list[tuple[int, int, int]] = []  # of each stretch: place in the shard, document, first word
        self.size, self.docs = 0, []

    def add(self, doc, data: bytes) -> None:
        words = words_of(data)
        k = len(self.docs)
        self.docs.append((doc, data, len(words)))
        if not self.p.shortest or len(words) < self.p.shortest:
            return
        get = self.p.number.get
        ids = np.fromiter((get(w, 0) for w in words), dtype=np.int64, count=len(words))
        edge = np.flatnonzero(np.diff((ids > 0).astype(np.int8), prepend=0, append=0))
        for a, b in zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a >= self.p.shortest:
                self.where.append((self.size, k, a))
                self.parts.append(np.append(ids[a:b], 0))
                self.size += b - a + 1

    def hits(self) -> list[tuple[int, int, int, int]]:
        """(document, first word, end, phrase) of every occurrence."""
        if not self.parts:
            return []
        index = FMIndex(np.concatenate(self.parts), len(self.p.number))
        lo, hi = index.search(self.p.words, self.p.size)
        count = hi - lo
        phrase = np.repeat(np.arange(len(count)), count)
        rows = np.arange(len(phrase)) - np.repeat(np.cumsum(count) - count, count) + lo[phrase]
        at = index.locate(rows)
        places = np.array([w[0] for w in self.where])
        part = np.searchsorted(places, at, side="right") - 1
        size = self.p.size[phrase].tolist()
        first = [self.where[s][2] + p - self.where[s][0] for s, p in zip(part.tolist(), at.tolist(), strict=True)]
        return [(self.where[s][1], a, a + n, f) for s, a, n, f in zip(part.tolist(), first, size, phrase.tolist(), strict=True)]

    def results(self) -> list[tuple]:
        """(doc, words, merged spans, items) of each document in order."""
        spans: dict[int, list] = {}
        for k, a, b, f in self.hits():
            spans.setdefault(k, []).append((a, b, f))
        out = []
        for k, (doc, data, n) in enumerate(self.docs):
            found = spans.get(k, ())
            out.append((doc, data, n, merge((a, b) for a, b, _ in found), self.p.items({f for *_, f in found})))
        self.clear()
        return out


def scan(df: DataFrame, items: list[tuple], row, schema: str | StructType, size: int = 10, max_symbols: int = 1 << 20, max_docs: int = 4096) -> DataFrame:
    """Run every document through its shard's index; ``row(batch row, result)`` makes the columns of ``schema``, or
    gives None for no row.

    ``df`` has text and any other columns. A shard ends at ``max_symbols`` indexed words or ``max_docs``
    documents, which bounds a task's memory, not what is searched.
    """
    names = df.columns
    text = names.index("text")
    phrases = Phrases(items, size)
    shared = df.sparkSession.sparkContext.broadcast(phrases)
    arrow = to_arrow_schema(schema if isinstance(schema, StructType) else StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            others = [c.to_pylist() for i, c in enumerate(batch.columns) if i != text]
            data = as_bytes(batch.column(text))
            shard, first = Shard(shared.value, max_symbols), 0
            for i, x in enumerate(data):
                shard.add(i, x)
                if shard.size >= max_symbols or len(shard.docs) >= max_docs or i + 1 == len(data):
                    rows = [row({n: c[r[0]] for n, c in zip([n for n in names if n != "text"], others, strict=True)}, r) for r in shard.results()]
                    if rows := [r for r in rows if r is not None]:
                        yield pa.RecordBatch.from_arrays([pa.array([r[f] for r in rows], t) for f, t in zip(arrow.names, arrow.types, strict=True)], names=arrow.names)

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


class Benchmark:
    """Test items (item_id, text) in as many groups as it takes for each to hold about ``max_bytes`` of text at most; an
    item is in one group, and only one group is collected at a time."""

    def __init__(self, bench: DataFrame, max_bytes: int = 8 << 20):
        self.bench = bench.select("item_id", "text")
        total = self.bench.agg(F.sum(F.octet_length(F.coalesce("text", F.lit(""))) + 64)).first()[0]
        self.n = max(1, -(-(total or 0) // max_bytes))

    def group(self, k: int) -> list[tuple]:
        part = self.bench if self.n == 1 else self.bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(self.n)) == k)
        return [(r["item_id"], r["text"]) for r in part.collect()]


def search(df: DataFrame, bench: Benchmark, row, schema: str | StructType, **options) -> DataFrame:
    """As ``scan``, for a benchmark of any number of groups."""
    if bench.n == 1:
        return scan(df, bench.group(0), row, schema, **options)
    rows = saved(df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_all"), F.monotonically_increasing_id().alias("_row"), "text"), "rows")

    def spans(given: dict, result: tuple) -> dict | None:
        *_, merged, items = result
        return {"_row": given["_row"], "spans": [x for span in merged for x in span], "items": [str(x) for x in items]} if merged else None

    hits = [saved(scan(rows.select("_row", "text"), bench.group(k), spans, "_row long, spans array<int>, items array<string>", **options), "hits") for k in range(bench.n)]
    found = reduce(DataFrame.union, hits).groupBy("_row").agg(F.collect_list(F.struct("spans", "items")).alias("_found"))
    both = rows.join(found, "_row", "left").select("_all", "_found")
    arrow = to_arrow_schema(schema if isinstance(schema, StructType) else StructType.fromDDL(schema))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for given, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            data = (given.pop("text") or "").encode()
            pairs = [p for f in found or () for p in zip(f["spans"][0::2], f["spans"][1::2], strict=True)]
            out.append(row(given, (None, data, len(words_of(data)), merge(pairs), {x for f in found or () for x in f["items"]})))
        out = [r for r in out if r is not None]
        return pa.RecordBatch.from_arrays([pa.array([r[f] for r in out], t) for f, t in zip(arrow.names, arrow.types, strict=True)], names=arrow.names)

    return in_chunks(both, step, schema)


DIGEST = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def digest(given: dict, result: tuple) -> dict:
    _, _, n, merged, items = result
    ids = ",".join(sorted(str(i) for i in items))
    hit = sum(b - a for a, b in merged)
    return {"doc_id": given["doc_id"], "n_words": n, "n_hit": hit, "n_items": len(items), "items_sha256": hashlib.sha256(ids.encode()).hexdigest(), "contaminated": hit > 0}


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return search(docs, Benchmark(spark.read.parquet(f"{sf_dir}/benchmark.parquet")), digest, DIGEST)


def cut(data: bytes, spans: list[list[int]]) -> bytes:
    """A text without the words of the spans (and what stands between them), the rest untouched."""
    if not spans:
        return data
    clean = np.frombuffer(data.translate(ALNUM), dtype=np.uint8) != 0x20
    edge = np.flatnonzero(np.diff(clean.astype(np.int8), prepend=0, append=0))
    starts, ends = edge[0::2], edge[1::2]
    out, at = [], 0
    for a, b in spans:
        out.append(data[at : starts[a]])
        at = int(ends[b - 1])
    return b"".join([*out, data[at:]])


def clean(df: DataFrame, bench: Benchmark, changed: str = "_changed") -> DataFrame:
    """``df`` without the hit words; the column ``changed`` is added (or replaced) and marks edited texts. Untouched
    texts, and null ones, stay as they are."""
    df = df.drop(changed)
    others = [f.name for f in df.schema if f.name != "text"]
    packed = df.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in others]).alias("rest"), F.col("text").isNotNull().alias("some"), "text")

    def row(given: dict, result: tuple) -> dict:
        _, data, _, merged, _ = result
        return {"rest": given["rest"], "text": cut(data, merged).decode() if given["some"] else None, "changed": bool(merged)}

    found = search(packed, bench, row, StructType([packed.schema["rest"], *StructType.fromDDL("text string, changed boolean")]))
    return found.select(*[F.col("text") if c == "text" else F.col("rest").getField(c).alias(c) for c in df.columns], F.col("changed").alias(changed))
