"""Language identification by words first, then by ever shorter character n-grams.

A word seen in training scores by its log frequency in each language. A word never seen falls back to its
character n-grams (boundary marks included): to those of the longest length of which the model knows at least
one, down to single characters. A text's language is the one with the highest mean over its words.

Training counts words and n-grams of a bounded, hash-chosen sample of labelled rows; prediction reads every
whole text. Edge cases: a null text, or one without a letter, gives ``und`` with score 0; with no labelled row
at all every text gives ``und``; ties go to the language that sorts first; very long texts are read whole; repeated rows
each count, and are each predicted; rows with a null id or extra columns pass unchanged, but for columns named
lang_pred or score, which are replaced; an empty table gives an empty result with the same columns. Digits, fractions
and other numbers are no letters.
"""

from __future__ import annotations

import json
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import U64, discard, fold, in_chunks, mix, saved

#: A word is a letter and the letters and marks after it.
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
UNKNOWN = "und"


@dataclass
class Model:
    """Word scores, and one table of hashed n-gram scores for each length; a row is a language vector."""

    langs: list[str]
    words: dict[str, int]
    word_scores: np.ndarray
    gram_keys: list[np.ndarray]
    gram_scores: list[np.ndarray]


def gram_hashes(words: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of its word) of every n-gram of the marked words, over code points."""
    text = "".join(f"<{w}>" for w in words)
    code = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(U64)
    sizes = np.fromiter((len(w) + 2 for w in words), dtype=np.int64, count=len(words))
    owner = np.repeat(np.arange(len(words)), sizes)
    h = np.zeros(max(0, len(code) - n + 1), dtype=U64)
    for i in range(n):
        h = h * U64(0x100000001B3) + code[i : len(code) - n + 1 + i]
    inside = owner[: len(h)] == owner[n - 1 :] if len(h) else np.zeros(0, dtype=bool)
    return mix(h + U64(n))[inside], owner[: len(h)][inside]


def counted(batch: pa.RecordBatch, max_n: int) -> pa.RecordBatch:
    """Partial counts of a batch: (lang, n, word or null, n-gram hash, count); n = 0 marks words."""
    by: dict[str, Counter] = {}
    for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        by.setdefault(lang, Counter()).update(WORD.findall((text or "").lower()))
    langs, ns, words, keys, counts = [], [], [], [], []
    for lang, seen in by.items():
        if not seen:
            continue
        w, c = list(seen), np.fromiter(seen.values(), dtype=np.int64, count=len(seen))
        langs += [lang] * len(w)
        ns += [0] * len(w)
        words += w
        keys += [0] * len(w)
        counts += c.tolist()
        for n in range(1, max_n + 1):
            h, owner = gram_hashes(w, n)
            u, at = np.unique(h, return_inverse=True)
            total = np.bincount(at, weights=c[owner], minlength=len(u)).astype(np.int64)
            langs += [lang] * len(u)
            ns += [n] * len(u)
            words += [None] * len(u)
            keys += u.view(np.int64).tolist()
            counts += total.tolist()
    return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(ns, pa.int32()), pa.array(words, pa.string()), pa.array(keys, pa.int64()), pa.array(counts, pa.int64())], names=["lang", "n", "word", "key", "count"])


def sampled(rows: DataFrame, max_docs: int, least: int) -> DataFrame:
    """About ``max_docs`` rows chosen by hash, and of each lang about ``least`` (all, if it has no more)."""
    by_lang = {x["lang"]: x["count"] for x in rows.groupBy("lang").count().collect()}
    n, top = sum(by_lang.values()), 1 << 40
    if n <= max_docs:
        return rows
    rates = F.from_json(F.lit(json.dumps({k: int(top * min(1.0, max(max_docs / n, least / c))) for k, c in by_lang.items()})), "map<string,long>")
    return rows.where(F.pmod(F.xxhash64(*rows.columns), F.lit(top)) < F.try_element_at(rates, F.col("lang")))


def train(rows: DataFrame, max_docs: int = 12_000, max_n: int = 4, min_count: int = 2, max_entries: int = 150_000, max_cells: int = 2_000_000, least: int = 200) -> Model:
    """Fit from rows (text, lang), lang not null.

    ``max_docs`` bounds the sample (in expectation; rows are chosen by their hash, so not by order) but for rare
    languages, of each of which about ``least`` rows are drawn whatever the size of the table,
    ``min_count`` drops words and n-grams seen less often, ``max_entries`` bounds each table of the model, by
    the largest share of a language's counts, and ``max_cells`` its entries times languages, so that what is collected
    and sent to the workers has a fixed size however many languages there are.
    """
    sample = sampled(rows.where(F.col("lang").isNotNull()), max_docs, least).select("text", "lang")
    counts = in_chunks(sample, lambda b: counted(b, max_n), "lang string, n int, word string, key long, count long")
    counts = counts.groupBy("n", "word", "key", "lang").agg(F.sum("count").alias("count"))
    by_key = counts.groupBy("n", "word", "key").agg(F.sum("count").alias("total"), F.map_from_entries(F.collect_list(F.struct("lang", "count"))).alias("by"))
    by_key = saved(by_key.where(F.col("total") >= min_count), "langcounts")
    found, langs = [], set()
    sums: dict[int, dict[str, int]] = {}
    for x in by_key.select("n", F.explode("by").alias("lang", "count")).groupBy("n", "lang").agg(F.sum("count").alias("count")).collect():
        sums.setdefault(x["n"], {})[x["lang"]] = x["count"]
    rows_each = min(max_entries, max(1, max_cells // max(1, len(sums.get(0, {})))))
    for n in range(max_n + 1):
        of = F.from_json(F.lit(json.dumps(sums.get(n, {}))), "map<string,long>")
        share = F.array_max(F.transform(F.map_entries("by"), lambda e: e["value"] / F.try_element_at(of, e["key"])))
        found.append(by_key.where(F.col("n") == n).orderBy(F.desc(share), F.desc("total"), "word", "key").limit(rows_each).select("word", "key", "by").toArrow())
        for x in found[-1].column("by").to_pylist():
            langs.update(k for k, _ in x)
    langs = sorted(langs)
    at = {x: i for i, x in enumerate(langs)}
    tables = []
    for table in found:
        m = np.zeros((table.num_rows, len(langs)))
        for i, x in enumerate(table.column("by").to_pylist()):
            for k, v in x:
                m[i, at[k]] = v
        total = np.maximum(m.sum(axis=0), 1)
        tables.append(np.log((m + 0.1) / (total + 0.1 * max(1, len(m)))).astype(np.float32))
    discard(by_key)
    words = {w: i for i, w in enumerate(found[0].column("word").to_pylist())}
    keys, scores = [], []
    for n in range(1, max_n + 1):
        k = found[n].column("key").to_numpy().view(U64)
        order = np.argsort(k)
        keys.append(k[order])
        scores.append(tables[n][order])
    return Model(langs, words, tables[0], keys, scores)


def unseen(model: Model, words: list[str]) -> np.ndarray:
    """Mean score vectors of unseen words, from the longest n-grams known."""
    out = np.zeros((len(words), len(model.langs)), dtype=np.float32)
    todo = np.arange(len(words))
    for n in range(len(model.gram_keys), 0, -1):
        keys, scores = model.gram_keys[n - 1], model.gram_scores[n - 1]
        if not len(todo) or not len(keys):
            continue
        h, owner = gram_hashes([words[i] for i in todo], n)
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        hit = keys[at] == h
        seen = np.bincount(owner[hit], minlength=len(todo))
        for j in range(len(model.langs)):
            total = np.bincount(owner[hit], weights=scores[at[hit], j], minlength=len(todo))
            out[todo[seen > 0], j] = (total[seen > 0] / seen[seen > 0]).astype(np.float32)
        todo = todo[seen == 0]
    return out


class Predictor:
    """Scores texts; remembers the vectors of unseen words, up to ``room`` of them."""

    def __init__(self, model: Model, room: int = 100_000):
        self.model, self.room, self.base = model, room, len(model.words)
        self.at, self.vectors = dict(model.words), [model.word_scores]
        self.size = self.base

    def __call__(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        m = self.model
        if not m.langs:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        split = [WORD.findall(x.lower()) if x else [] for x in texts]
        new = list(dict.fromkeys(w for ws in split for w in ws if w not in self.at))
        if new:
            if self.size - self.base + len(new) > self.room:
                self.at, self.vectors, self.size = dict(m.words), [m.word_scores], self.base
                new = list(dict.fromkeys(w for ws in split for w in ws if w not in self.at))
            self.at.update(zip(new, range(self.size, self.size + len(new)), strict=True))
            self.vectors = [np.concatenate([*self.vectors, unseen(m, new)])]
            self.size += len(new)
        table, get = self.vectors[0], self.at.__getitem__
        langs, scores = [], []
        for ws in split:
            if not ws:
                langs.append(UNKNOWN)
                scores.append(0.0)
                continue
            v = table[np.fromiter(map(get, ws), dtype=np.int64, count=len(ws))].mean(axis=0, dtype=np.float64)
            p = np.exp((v - v.max()) * min(len(ws), 20))
            best = int(np.argmax(v))
            langs.append(m.langs[best])
            scores.append(float(p[best] / p.sum()))
        return langs, scores


def predict(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``df`` with lang_pred and score added; columns of those names in ``df`` are replaced."""
    df = df.drop("lang_pred", "score")
    shared = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index(text)
    memo: list[Predictor] = []

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not memo:
            memo.append(Predictor(shared.value))
        langs, scores = memo[0](batch.column(at).to_pylist())
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return in_chunks(df, step, f"{fields}, lang_pred string, score double", rows=500)


def lettered(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``df`` whose text has a letter, as ``predict`` sees letters."""
    at = df.columns.index(text)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array([bool(x) and WORD.search(x.lower()) is not None for x in batch.column(at).to_pylist()], pa.bool_()))

    return in_chunks(df, step, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), rows=500)


def learnable(docs: DataFrame, key: Column | None = None) -> DataFrame:
    """Rows from whose lang a model may learn: crc32 of the id as text, modulo 4, is not 2."""
    return docs.where((fold(F.col("doc_id") if key is None else key, 4) != 2) & F.col("lang").isNotNull())


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(learnable(docs))
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
