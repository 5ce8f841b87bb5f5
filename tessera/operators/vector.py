"""Exact vector search, matching and routing.

Search compares whole blocks: queries and vectors are dealt into blocks, each pair of blocks is one matrix product, and
only its best k per query leave the task; a last ranking joins the blocks. A hot scope is cut into blocks like any other
rows. Pairs of blocks stream through a task in order: it holds one Arrow batch and the pair of blocks that the batch ends
in, however many small scopes there are, and small scopes of a batch are compared together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import schemas as S
from tessera.functions.scalars import scaled
from tessera.operators.graph import top
from tessera.shipping import ship

#: Rows of a block, of queries and of vectors.
QUERY_BLOCK, INDEX_BLOCK = 2_000, 20_000
#: Pairs from which two blocks are a matrix product of their own, and components that smaller ones compare at a time.
PRODUCT, COMPONENTS = 4_096, 4_000_000


def unit(vectors: list) -> np.ndarray:
    """Rows of unit length in double precision; a zero or missing vector stays zero, shorter ones are padded."""
    rows = [np.zeros(0) if v is None else np.asarray(v, dtype=np.float64) for v in vectors]
    out = np.zeros((len(rows), max((len(r) for r in rows), default=0)))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    n = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.divide(out, n, out=np.zeros_like(out), where=n > 0)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = min(a.shape[1], b.shape[1])
    return a[:, :d] @ b[:, :d].T


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of every row of a with every row of b, to six places."""
    return np.round(products(a, b), 6) + 0.0


def blocks(n: int, size: int) -> int:
    return max(1, -(-n // size))


def best_of(score: np.ndarray, ids: np.ndarray, k: int, floor: float) -> np.ndarray:
    """Places of the k best scores at or above the floor, ties to the smaller id."""
    at = np.flatnonzero(score >= floor)
    if len(at) > k:
        least = np.partition(score[at], len(at) - k)[len(at) - k]
        at = at[score[at] >= least]
    return at[np.lexsort((ids[at], -score[at]))][:k]


def matrix(vectors: pa.Array) -> np.ndarray:
    """Lists as rows of unit length in double precision; a zero or missing one stays zero, shorter ones are padded."""
    n = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    out = np.zeros((len(n), int(n.max(initial=0))))
    out[np.arange(out.shape[1]) < n[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)


def group_ids(t: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """A number for each run of rows that are equal in the keys; nulls are equal to each other."""
    new = np.zeros(t.num_rows, dtype=bool)
    for c in keys:
        a, b = t[c].slice(1), t[c].slice(0, max(0, t.num_rows - 1))
        new[1:] |= pc.or_kleene(pc.not_equal(a, b), pc.xor(a.is_null(), b.is_null())).fill_null(False).to_numpy(zero_copy_only=False)
    return np.cumsum(new)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows, sorted by the keys, cut so that no group is divided: the group that a batch ends in waits for the next."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        start = int(np.searchsorted(ids := group_ids(batch, keys), ids[-1]))
        goes_on = bool(held) and all(held[-1][c][-1].as_py() == batch[c][0].as_py() for c in keys)
        if held and (start or not goes_on):
            first = int(np.searchsorted(ids, 0, side="right")) if goes_on else 0
            yield pa.concat_batches([*held, batch.slice(0, first)])
            held, batch, start = [], batch.slice(first), start - first
        if start > 0:
            yield batch.slice(0, start)
            batch = batch.slice(start)
        held.append(batch)
    if held:
        yield pa.concat_batches(held)


def best_pairs(q: np.ndarray, x: np.ndarray, current: np.ndarray | None, has: np.ndarray | None, gq: np.ndarray, gx: np.ndarray, ids: np.ndarray, k: int, floor: float, scale: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each query the k best vectors of its own group, as places of queries and vectors and their scores. Groups of
    many pairs are matrix products; the pairs of the others are made together, some at a time."""
    lo, hi = np.searchsorted(gx, gq), np.searchsorted(gx, gq, side="right")
    n, first = hi - lo, np.searchsorted(gq, gq)
    large = n * (np.searchsorted(gq, gq, side="right") - first) >= PRODUCT
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, dtype=int), np.zeros(0, dtype=int), np.zeros(0))]
    final = lambda s: np.round((1 + s) / 2 if scale == "unit_interval" else s, 6) + 0.0

    for start in np.unique(first[large]):
        own, other = np.flatnonzero(first == start), slice(lo[start], hi[start])
        for m in range(0, len(own), 256):
            rows = own[m : m + 256]
            part = products(q[rows], x[other])
            if current is not None:
                part = np.where(has[other], np.maximum(part, products(q[rows], current[other])), part)
            for row, score in zip(rows, final(part), strict=True):
                found = best_of(score, ids[other], k, floor)
                out.append((np.full(len(found), row), found + lo[start], score[found]))

    small = np.flatnonzero(~large & (n > 0))
    d = min(q.shape[1], x.shape[1])
    cut = np.cumsum(n[small]) // max(1, COMPONENTS // max(1, d))
    for rows in np.split(small, np.flatnonzero(np.diff(cut)) + 1) if len(small) else []:
        count = n[rows]
        at = np.repeat(rows, count)
        to = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo[rows], count)
        score = np.einsum("ij,ij->i", q[at, :d], x[to, :d])
        if current is not None:
            e = min(q.shape[1], current.shape[1])
            score = np.where(has[to], np.maximum(score, np.einsum("ij,ij->i", q[at, :e], current[to, :e])), score)
        score = final(score)
        ok = np.flatnonzero(score >= floor)
        at, to, score = at[ok], to[ok], score[ok]
        order = np.lexsort((ids[to], -score, at))
        at, to, score = at[order], to[order], score[order]
        kept = np.arange(len(at)) - np.searchsorted(at, at) < k
        out.append((at[kept], to[kept], score[kept]))
    at, to, score = (np.concatenate(c) for c in zip(*out, strict=True))
    return at, to, score


def search(queries: DataFrame, index: DataFrame, k: int = 10, min_score: float = 0.7, by: list[str] | None = None, scale: str = "cosine", post_filter: bool = False) -> DataFrame:
    """Top k of ``index`` (vec_id, embedding[, embedding_current], scope columns) for each query (query_id, query), as
    query_id, vec_id, score and the scope columns.

    Only vectors of the query's scope ``by`` are compared. With ``post_filter`` the k best of all scopes are taken before
    scope and score are applied. Both stored vectors count by the better score, ties go to the smaller id; a null scope
    matches nothing.
    """
    by = by or []
    scaled(F.lit(0.0), scale)
    two = "embedding_current" in index.columns
    kinds = queries.schema["query_id"].dataType.simpleString(), index.schema["vec_id"].dataType.simpleString()
    scope = F.to_json(F.struct(F.lit(0).alias("_"), *by))
    known = F.lit(True)
    for c in by:
        known = known & F.col(c).isNotNull()
    none = F.lit(None)
    # components travel as they are stored; products are in double precision
    single = all(f.dataType.simpleString() == "array<float>" for f in [queries.schema["query"], *[index.schema[c] for c in ("embedding", "embedding_current") if c in index.columns]])
    kind = "array<float>" if single else "array<double>"
    q = queries.where(known).select(F.lit(0).cast("byte").alias("side"), F.col("query_id"), none.cast(kinds[1]).alias("vec_id"), F.col("query").cast(kind).alias("a"), none.cast(kind).alias("b"), scope.alias("scope"))
    x = index.where(known | F.lit(post_filter)).select(F.lit(1).cast("byte").alias("side"), none.cast(kinds[0]).alias("query_id"), "vec_id", F.col("embedding").cast(kind).alias("a"), (F.col("embedding_current") if two else none).cast(kind).alias("b"), scope.alias("scope"))
    group = F.lit("") if post_filter else F.col("scope")
    keys = ["i", "j"] if post_filter else ["scope", "i", "j"]
    # each scope has blocks of its own; only scopes of more than one are told, and of those there are few
    count = lambda df, c: df.groupBy(group.alias("g")).agg(F.count("*").alias(c))
    sizes = count(q, "n").join(count(x, "m"), "g").where((F.col("n") > QUERY_BLOCK) | (F.col("m") > INDEX_BLOCK))
    sizes = F.broadcast(sizes.select("g", F.ceil(F.col("n") / QUERY_BLOCK).cast("int").alias("nq"), F.ceil(F.col("m") / INDEX_BLOCK).cast("int").alias("nx")))
    at = lambda key, n: F.when(F.col(n) > 1, F.pmod(F.xxhash64(key), F.col(n)).cast("int")).otherwise(0)
    span = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(F.col(n), F.lit(1)) - 1))
    dealt = lambda df: df.join(sizes, group == F.col("g"), "left")
    rows = dealt(q).withColumn("i", at("query_id", "nq")).withColumn("j", span("nx")).unionByName(dealt(x).withColumn("j", at("vec_id", "nx")).withColumn("i", span("nq"))).drop("g", "nq", "nx")
    floor = -np.inf if post_filter else min_score

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, keys):
            side, gid = t["side"].to_numpy(), group_ids(t, keys)
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            x = t.take(pa.array(right))
            vectors, ids = matrix(x["a"]), x["vec_id"].to_numpy(zero_copy_only=False)
            current, has = (matrix(x["b"]), x["b"].is_valid().to_numpy(zero_copy_only=False)) if two else (None, None)
            at, to, score = best_pairs(matrix(t["a"].take(pa.array(left))), vectors, current, has, gid[left], gid[right], ids, k, floor, scale)
            q, x = t.take(pa.array(left[at])), x.take(pa.array(to))
            yield pa.RecordBatch.from_arrays([q["query_id"], x["vec_id"], pa.array(score), q["scope"], x["scope"]], ["query_id", "vec_id", "score", "scope", "other"])

    ship(queries.sparkSession)
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, "side")
    found = rows.mapInArrow(compare, f"query_id {kinds[0]}, vec_id {kinds[1]}, score double, scope string, other string")
    found = top(found, [F.desc("score"), F.asc("vec_id")], k, ["query_id", "scope"]).where((F.col("score") >= min_score) & (F.col("scope") == F.col("other")))
    if not by:
        return found.select("query_id", "vec_id", "score")
    names = F.from_json("scope", ", ".join(f"`{c}` {queries.schema[c].dataType.simpleString()}" for c in by))
    return found.withColumn("_s", names).select("query_id", "vec_id", "score", *[F.col("_s").getField(c).alias(c) for c in by])


def merged(*searches: DataFrame, k: int) -> DataFrame:
    """Several searches as one: the best score of each (query, vector), then the top k."""
    both = searches[0]
    for s in searches[1:]:
        both = both.unionByName(s)
    return top(both.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")), [F.desc("score"), F.asc("vec_id")], k, ["query_id"])


def similar_pairs(vectors: DataFrame, group: str, min_score: float = 0.5, n: int = 20) -> DataFrame:
    """The n most similar pairs of different groups above a score, ties to the smaller ids. Every block is compared with
    itself and the later ones; n pairs at most leave a task."""
    m = blocks(vectors.count(), INDEX_BLOCK // 4)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    own = F.pmod(F.xxhash64("vec_id"), F.lit(m)).cast("int")
    rows = vectors.select("vec_id", F.col(group).cast("string").alias("g"), F.col("embedding").cast("array<double>").alias("v"), own.alias("own")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    rows = rows.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
        left, right = pdf[pdf["own"] == i], pdf[pdf["own"] == j]
        a, b, ga, gb = left["vec_id"].to_numpy(), right["vec_id"].to_numpy(), left["g"].to_numpy(), right["g"].to_numpy()
        x, y = unit(list(left["v"])), unit(list(right["v"]))
        best = pd.DataFrame({"a": a[:0], "b": a[:0], "score": np.zeros(0)})
        for k in range(0, len(a), 256):
            score = cosines(x[k : k + 256], y)
            # a null group is in no pair, as NULL differs from nothing
            ok = (score > min_score) & (ga[k : k + 256, None] != gb[None, :]) & pd.notna(ga[k : k + 256])[:, None] & pd.notna(gb)[None, :]
            ok &= a[k : k + 256, None] < b[None, :] if i == j else a[k : k + 256, None] != b[None, :]
            r, c = np.nonzero(ok)
            found = pd.DataFrame({"a": np.minimum(a[k + r], b[c]), "b": np.maximum(a[k + r], b[c]), "score": score[r, c]})
            best = pd.concat([best, found]).sort_values(["score", "a", "b"], ascending=[False, True, True]).head(n)
        return best

    ship(vectors.sparkSession)
    pairs = rows.groupBy("i", "j").applyInPandas(compare, f"a {kind}, b {kind}, score double")
    return pairs.orderBy(F.desc("score"), "a", "b").limit(n)


def item_decisions(candidates: DataFrame, decisions: DataFrame, auto: float = S.ITEM_AUTO) -> DataFrame:
    """A decision for each candidate: by score at or above ``auto``, else the given one; without one, not the same."""
    sure = F.col("score") >= auto
    d = candidates.join(decisions, ["query_id", "vec_id"], "left")
    route = F.when(F.col("is_status_update"), "update_status").otherwise("merge") if "is_status_update" in candidates.columns else F.lit("merge")
    return d.select(*candidates.columns, F.when(sure, True).otherwise(F.coalesce("same", F.lit(False))).alias("same"), F.when(sure, F.col("score")).otherwise(F.coalesce("confidence", F.lit(0.0))).alias("confidence"), F.when(sure, route).otherwise(F.coalesce("route", F.lit("create_new"))).alias("route"))


def best_match(decided: DataFrame) -> DataFrame:
    """The match of each query: the same item, to merge or update, by confidence, then score, then id."""
    usable = decided.where(F.col("same") & F.col("route").isin("merge", "update_status"))
    return top(usable, [F.desc("confidence"), F.desc("score"), F.asc("vec_id")], 1, ["query_id"])


def topic_route(score: Column, llm_same: Column, link: float = S.TOPIC_LINK, create: float = S.TOPIC_CREATE) -> Column:
    """(decision, confidence) of the top topic candidate; no candidate is a null score."""
    made = lambda d, c: F.struct(F.lit(d).alias("decision"), c.alias("confidence"))
    return F.when(score.isNull(), made("create_new", F.lit(1.0))).when(score >= link, made("link_existing", score)).when(score < create, made("create_new", 1 - score)).when(F.coalesce(llm_same, F.lit(False)), made("link_existing", score)).otherwise(made("create_new", 1 - score))


def deal_match(candidates: DataFrame, decisions: DataFrame, auto: float = S.DEAL_AUTO, floor: float = S.DEAL_CANDIDATE) -> DataFrame:
    """auto_match of a top score at or above ``auto``, else the first candidate in score order that is decided the same
    and to merge, else create_new."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    d = candidates.where(F.col("score") >= floor).join(decisions, ["query_id", "vec_id"], "left").withColumn("rank", F.row_number().over(w))
    hit = ((F.col("rank") == 1) & (F.col("score") >= auto)) | (F.coalesce("same", F.lit(False)) & (F.col("route") == "merge"))
    best = d.where(hit).groupBy("query_id").agg(F.min_by(F.struct("vec_id", "score", "rank"), "rank").alias("m"))
    kind = F.when((F.col("m.rank") == 1) & (F.col("m.score") >= auto), "auto_match").when(F.col("m").isNotNull(), "llm_match").otherwise("create_new")
    return candidates.select("query_id").distinct().join(best, "query_id", "left").select("query_id", F.col("m.vec_id").alias("vec_id"), F.col("m.score").alias("score"), kind.alias("match_type"))


def most_confident(deals: DataFrame, by: list[str]) -> DataFrame:
    """A targeted extraction keeps its most confident deal, the first of equals."""
    return top(deals, [F.desc("confidence"), F.asc("idx")], 1, by)


def mode(envelopes: DataFrame, deals: DataFrame) -> DataFrame:
    """targeted where the envelope names a known deal, else discovery."""
    known = deals.select("tenant_id", "opportunity_id").distinct().withColumn("_known", F.lit(True))
    return envelopes.join(known, ["tenant_id", "opportunity_id"], "left").withColumn("mode", F.when(F.col("_known"), "targeted").otherwise("discovery")).drop("_known")
