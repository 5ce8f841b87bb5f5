"""The deal pipeline: deals of an account are taken one by one, in time, so that a later one can match an earlier one.

Only the choice of the stored deal is sequential. It is a fold over each account's deals (one group an account, of
embeddings only); all else follows from the sequence of a deal's extractions by window functions: a field's value after
an update is the last one given so far, a version row is the state before an update.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import schemas as S
from tessera.functions.scalars import content_hash, dimensions, reference, truthy, uuid5
from tessera.operators.upsert import with_version
from tessera.operators.vector import cosines, group_ids, matrix, whole_groups
from tessera.scratch import Stages
from tessera.shipping import ship

KEY = ["tenant_id", "opportunity_id"]
MEDDIC = [f"meddic_{m}" for m in S.MEDDIC]
SCORES = [c for d in S.DIMENSIONS for c in (f"dim_{d}", f"dim_{d}_confidence")]
#: What one extraction says; every field may be missing.
EXTRACTED = (
    "tenant_id string, account_id string, interaction_id string, deal_idx int, timestamp timestamp, name string, opportunity_summary string, evolution_summary string, stage string, amount double, currency string, confidence double, "
    + ", ".join(f"{m} string" for m in S.MEDDIC)
    + ", dimensions map<string,struct<score:int,confidence:double,evidence:string>>, embedding array<float>"
)
#: Fields that an update overwrites only where the extraction has a value.
KEPT = ["stage", "amount", "opportunity_summary", "evolution_summary", *MEDDIC, *SCORES]


@dataclass
class DealResult:
    """The next tables, and what became of each extraction; ``release`` drops what is kept for them."""

    deals: DataFrame
    versions: DataFrame
    routed: DataFrame
    kept: list[Stages] = field(default_factory=list)

    def release(self) -> None:
        for stages in self.kept:
            stages.unpersist()


def identified(extracted: DataFrame) -> DataFrame:
    """Extractions with a name-based id, made of all that the extraction says but its index and time."""
    parts = [F.to_json(F.col(f.name)) if f.name == "dimensions" else F.col(f.name) for f in S.struct(EXTRACTED) if f.name not in ("tenant_id", "account_id", "interaction_id", "deal_idx", "timestamp")]
    key = F.concat_ws(":", F.lit("deal"), "tenant_id", F.coalesce("account_id", F.lit("none")), F.coalesce("interaction_id", F.lit("none")), content_hash(*parts))
    return extracted.withColumn("query_id", uuid5(key))


def once(rows: DataFrame) -> DataFrame:
    """Of extractions with one id the first by time and index."""
    first = Window.partitionBy("tenant_id", "query_id").orderBy("timestamp", "deal_idx")
    return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def sequenced(rows: DataFrame) -> DataFrame:
    """Each extraction once, with its place in the account's sequence."""
    order = Window.partitionBy("tenant_id", "account_id").orderBy("timestamp", "interaction_id", "deal_idx", "query_id")
    return once(rows).withColumn("seq", F.row_number().over(order))


def shaped(rows: DataFrame) -> DataFrame:
    """Extractions with the deal table's columns; an unknown stage counts as missing."""
    rows = rows.withColumn("stage", F.when(F.col("stage").isin(S.DEAL_STAGES), F.col("stage")))
    return rows.withColumnsRenamed({m: f"meddic_{m}" for m in S.MEDDIC}).select("*", *dimensions(F.col("dimensions"), S.DIMENSIONS))


def prepared(extracted: DataFrame) -> DataFrame:
    """Extractions with a name-based id, each once, their place in the account's sequence and the deal table's columns."""
    return shaped(sequenced(identified(extracted)))


def assign(deals: DataFrame, state: DataFrame, decisions: DataFrame, auto: float = S.DEAL_AUTO, floor: float = S.DEAL_CANDIDATE, k: int = 10) -> DataFrame:
    """(tenant_id, query_id, seq, opportunity_id, match_type, score) of each deal, in sequence within its account.

    A deal is compared with the account's stored deals and with those made before it. The best of the ``k`` nearest at
    or above ``floor`` is taken at ``auto`` or more; else the first in score order that ``decisions`` (query_id, vec_id,
    same, route) call the same and to merge; else the deal is new, under its own id.
    """
    said = decisions.where(F.col("same") & (F.col("route") == "merge")).groupBy("query_id").agg(F.collect_set("vec_id").alias("same"))
    none = F.lit(None)
    # components travel as they are stored; products are in double precision
    kind = "array<float>" if all(df.schema["embedding"].dataType.simpleString() == "array<float>" for df in (deals, state)) else "array<double>"
    # only accounts with a new deal are folded
    known = state.join(deals.select("tenant_id", "account_id").distinct(), ["tenant_id", "account_id"], "left_semi").select("tenant_id", "account_id", F.lit(0).alias("seq"), F.col("opportunity_id").alias("id"), F.col("embedding").cast(kind).alias("v"), none.cast("array<string>").alias("same"))
    new = deals.join(said, "query_id", "left").select("tenant_id", "account_id", "seq", F.col("query_id").alias("id"), F.col("embedding").cast(kind).alias("v"), "same")

    def fold(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(rows, ["tenant_id", "account_id"]):
            start = np.flatnonzero(np.diff(group_ids(t, ["tenant_id", "account_id"]), prepend=-1))
            ids, seqs, said = (t[c].to_pylist() for c in ("id", "seq", "same"))
            u, has = matrix(t["v"]), t["v"].is_valid().to_pylist()
            at: list[int] = []
            out: list[tuple] = []
            for lo, hi in zip(start.tolist(), [*start[1:].tolist(), t.num_rows], strict=True):
                stored, known = [i for i in range(lo, hi) if seqs[i] == 0 and has[i]], {ids[i] for i in range(lo, hi) if seqs[i] == 0}
                for i in range(lo, hi):
                    if seqs[i] == 0:
                        continue
                    to, how, score = ids[i], "create_new", None
                    if to in known:
                        how = "repeated"  # this extraction made the stored deal in an earlier run
                    elif has[i] and stored:
                        near = cosines(u[i : i + 1], u[stored])[0].tolist()
                        order = sorted((j for j in range(len(stored)) if near[j] >= floor), key=lambda j: (-near[j], ids[stored[j]]))[:k]
                        sure = order[:1] if order and near[order[0]] >= auto else [j for j in order if said[i] is not None and ids[stored[j]] in said[i]][:1]
                        if sure:
                            to, how, score = ids[stored[sure[0]]], "auto_match" if near[order[0]] >= auto else "llm_match", near[sure[0]]
                    if how == "create_new" and has[i]:
                        stored.append(i)
                    at.append(i)
                    out.append((to, how, score))
            left = t.take(pa.array(at, pa.int64()))
            to, how, score = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([left["tenant_id"], left["id"], left["seq"], pa.array(to, pa.string()), pa.array(how, pa.string()), pa.array(score, pa.float64())], ["tenant_id", "query_id", "seq", "opportunity_id", "match_type", "score"])

    # accounts stream through a task in order; it holds one Arrow batch and the account that the batch ends in
    ship(deals.sparkSession)
    # (dealt by a hash of the key: where both sides of the union are dealt by the key itself, Spark 4.1 leaves the exchange
    # out, and then coalesces or localises each side for itself, so that an account's rows come apart)
    rows = known.unionByName(new).repartition(F.xxhash64("tenant_id", "account_id")).sortWithinPartitions("tenant_id", "account_id", "seq", "id")
    return rows.mapInArrow(fold, "tenant_id string, query_id string, seq int, opportunity_id string, match_type string, score double")


def share(columns: list[Column]) -> Column:
    return sum((c.cast("int") for c in columns), F.lit(0)) / F.lit(float(len(columns)))


def run_deals(extracted: DataFrame, state: DataFrame, versions: DataFrame, decisions: DataFrame, now) -> DealResult:
    """The next deals and versions, and what became of each extraction (routed).

    Stage, amount, MEDDIC fields, dimension scores and summaries keep their value where an update has none; an empty
    MEDDIC text overwrites, but does not count as filled, where completeness falls back on the value before. The
    ontology's completeness is over the dimensions given for a new deal, over all of them after an update.
    """
    put = Stages(extracted.sparkSession, "run-deals")
    given = put("given", identified(extracted))
    # only what the order and the choice need is put in order; the rest of an extraction meets it in one exchange
    deals = put("sequence", sequenced(given.select("tenant_id", "account_id", "interaction_id", "deal_idx", "timestamp", "query_id", "embedding")))
    found = put("found", assign(deals, state, decisions))
    put.drop("sequence")
    routed = put("routed", shaped(once(given.join(found, ["tenant_id", "query_id"]))).withColumn("deal_ref", reference(F.col("opportunity_id"))))
    for name in ("given", "found"):
        put.drop(name)
    at = F.lit(now).cast("timestamp")
    # one event for the stored state (seq 0) and for each extraction that reached the deal, in sequence
    base = state.join(routed.select(*KEY).distinct(), KEY, "left_semi")
    first = base.select(*KEY, F.lit(0).alias("seq"), F.lit(None).cast("string").alias("query_id"), "account_id", "name", "currency", *KEPT, *[F.col(f"{m}_confidence") for m in MEDDIC], "meddic_completeness", "ontology_completeness", "confidence", "source_interaction_id", "deal_ref", "embedding", "created_at", F.col("version").alias("_old"), F.lit(None).cast("int").alias("_given"))
    made = F.col("match_type") == "create_new"
    given = share([F.col(f"dim_{d}").isNotNull() for d in S.DIMENSIONS])
    later = routed.where("match_type != 'repeated'").select(
        *KEY, "seq", "query_id", "account_id", "name", F.when(made, F.coalesce("currency", F.lit("USD"))).alias("currency"), *[F.when(made, F.coalesce("stage", F.lit("prospecting"))).otherwise(F.col("stage")).alias("stage") if c == "stage" else F.when(made, F.coalesce(c, F.concat(F.lit("Initial extraction: "), "opportunity_summary"))).otherwise(F.col(c)).alias(c) if c == "evolution_summary" else F.col(c) for c in KEPT],
        *[F.when(truthy(F.col(m)), F.col("confidence")).otherwise(0.0).alias(f"{m}_confidence") for m in MEDDIC], F.lit(None).cast("double").alias("meddic_completeness"), given.alias("ontology_completeness"), "confidence", F.col("interaction_id").alias("source_interaction_id"), "deal_ref", "embedding", at.alias("created_at"), F.lit(0).cast("long").alias("_old"), F.size(F.coalesce("dimensions", F.create_map().cast("map<string,struct<score:int,confidence:double,evidence:string>>"))).alias("_given"))
    events = first.unionByName(later)
    w = Window.partitionBy(*KEY).orderBy("seq")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    filled = share([truthy(F.col(m)) | truthy(F.last(m, ignorenulls=True).over(before)) for m in MEDDIC])
    scored = share([F.last(f"dim_{d}", ignorenulls=True).over(so_far).isNotNull() for d in S.DIMENSIONS])
    created = F.when(F.col("_given") > 0, F.col("ontology_completeness") * len(S.DIMENSIONS) / F.col("_given")).otherwise(0.0)
    step = F.row_number().over(w) - 1
    state_at = events.select(
        *KEY, "seq", step.alias("_step"), *[F.last(c, ignorenulls=True).over(so_far).alias(c) for c in KEPT], *[F.first(c).over(so_far).alias(c) for c in ("account_id", "name", "currency", *[f"{m}_confidence" for m in MEDDIC], "confidence", "source_interaction_id", "deal_ref", "embedding", "created_at", "_old")],
        F.when(F.col("seq") == 0, F.col("meddic_completeness")).otherwise(filled).alias("meddic_completeness"), F.when(F.col("seq") == 0, F.col("ontology_completeness")).when(step == 0, created).otherwise(scored).alias("ontology_completeness"), F.lead("source_interaction_id").over(w).alias("_source"), F.lead("query_id").over(w).alias("_next"))
    state_at = put("states", state_at.withColumn("version", F.greatest(F.col("_old"), F.lit(1)) + F.col("_step")))
    # the id names the deal and the extraction that changes it, so a retry makes the same row, and no two are equal here
    snap = state_at.where("_next is not null").select("*", uuid5(F.concat_ws(":", F.lit("deal-version"), "tenant_id", "opportunity_id", "_next")).alias("version_id"), F.col("_source").alias("change_source_interaction_id"), F.col("created_at").alias("valid_from"), at.alias("valid_until"))
    new_versions = versions.unionByName(snap.select(versions.columns).join(versions.select("tenant_id", "version_id"), ["tenant_id", "version_id"], "left_anti"))
    last = state_at.where("_next is null").withColumn("last_updated_at", at)
    untouched = state.join(last.select(*KEY), KEY, "left_anti")
    all_deals = untouched.unionByName(last.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in state.schema]))
    return DealResult(with_version(all_deals, new_versions, KEY).select(state.columns), new_versions, routed, [put])
