"""Keyed writes as joins: every operator gives the next snapshot of a table, and applying it twice changes nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(target: DataFrame, source: DataFrame, keys: list[str], update: list[str] | None = None, fill: list[str] = (), insert_only: list[str] = (), skip_null: bool = False) -> DataFrame:
    """Next snapshot of ``target``. On a match ``update`` columns take the source's value (nulls too, unless
    ``skip_null``), ``fill`` columns only where the target has none, others stay; new rows take all columns.
    The source must have one row a key; see ``one_row``."""
    update = [c for c in source.columns if c not in keys and c not in fill and c not in insert_only] if update is None else update
    t = target.withColumnsRenamed({c: f"_t_{c}" for c in target.columns}).withColumn("_t", F.lit(True))
    s = source.withColumnsRenamed({c: f"_s_{c}" for c in source.columns}).withColumn("_s", F.lit(True))
    on = [F.col(f"_t_{k}") == F.col(f"_s_{k}") for k in keys]
    out = []
    for c in target.columns:
        old, new = F.col(f"_t_{c}"), F.col(f"_s_{c}") if c in source.columns else F.lit(None)
        value = old
        if c in keys:
            value = F.coalesce(old, new)
        elif c in source.columns and c in update:
            value = F.when(F.col("_s"), F.coalesce(new, old) if skip_null else new).otherwise(old)
        elif c in source.columns and c in fill:
            value = F.coalesce(old, new)
        out.append(F.when(F.col("_t"), value).otherwise(new).cast(target.schema[c].dataType).alias(c))
    return t.join(s, on, "full").select(*out)


def one_row(source: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The last row of each key, so that repeated deliveries do not multiply."""
    rest = [c for c in source.columns if c not in keys]
    return source.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def append_absent(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Insert-if-absent: the first write wins."""
    return target.unionByName(source.dropDuplicates(keys).join(target.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def link(edges: DataFrame, new: DataFrame, left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """New edges between ends that both exist; ends are frames of (keys[i]) only, existing edges stay as they are."""
    known = new.join(left, left.columns, "left_semi").join(right, right.columns, "left_semi")
    return append_absent(edges, known, keys)


def snapshot(state: DataFrame, touched: DataFrame, keys: list[str], overrides: dict[str, Column], columns: list[str] | None = None) -> DataFrame:
    """Version rows of the touched entities as they are before the write."""
    rows = state.join(touched.select(*keys).distinct(), keys, "left_semi")
    rows = rows.select(*columns) if columns else rows
    return rows.withColumns(overrides)


def with_version(entities: DataFrame, versions: DataFrame, keys: list[str]) -> DataFrame:
    """Current version derived from the snapshots rather than counted up in place."""
    return entities.drop("version").join(versions.groupBy(*keys).agg(F.count("*").alias("_n")), keys, "left").withColumn("version", F.coalesce("_n", F.lit(0)) + 1).drop("_n")


def purge(df: DataFrame, tenant: str) -> DataFrame:
    """All but one tenant's rows."""
    return df.where((F.col("tenant_id") != tenant) | F.col("tenant_id").isNull())


def outbox(results: DataFrame, run: list[str]) -> DataFrame:
    """One row a run with what it created and updated; runs without either give none."""
    ids = lambda a: F.sort_array(F.collect_list(F.when(F.col("action") == a, F.col("id"))))
    rows = results.groupBy(*run).agg(ids("created").alias("created_ids"), ids("updated").alias("updated_ids"), F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("id", "score"))))).alias("scores"))
    return rows.where(F.size("created_ids") + F.size("updated_ids") > 0).withColumn("dedup_key", F.sha2(F.concat_ws(":", *run), 256))


def last_role(engaged: DataFrame, roles: DataFrame, keys: list[str]) -> DataFrame:
    """Edges with the role written last (by seq)."""
    last = roles.groupBy(*keys).agg(F.max_by("role", "seq").alias("role"))
    return engaged.drop("role").join(last, keys, "left")


def ensure_accounts(accounts: DataFrame, seen: DataFrame, now: Column) -> DataFrame:
    """Accounts with those that are missing, named by their id where no name is given."""
    new = seen.select("tenant_id", "account_id", F.coalesce("name", "account_id").alias("name"), now.cast("timestamp").alias("created_at"))
    return append_absent(accounts, new, ["tenant_id", "account_id"])


def engaged_on(edges: DataFrame, seen: DataFrame, contacts: DataFrame, deals: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(edges, matched) for (tenant_id, contact_id, opportunity_id, source, seq): an edge between a known contact and a
    known deal keeps its first source; matched counts the pairs of each deal, known before or not."""
    key = ["tenant_id", "contact_id", "opportunity_id"]
    known = seen.join(contacts.select("tenant_id", "contact_id"), ["tenant_id", "contact_id"], "left_semi").join(deals.select("tenant_id", "opportunity_id"), ["tenant_id", "opportunity_id"], "left_semi")
    first = known.groupBy(*key).agg(F.min_by("source", "seq").alias("source")).withColumn("created_at", now.cast("timestamp"))
    matched = known.select(*key).distinct().groupBy("tenant_id", "opportunity_id").agg(F.count("*").alias("matched"))
    return append_absent(edges, first, key), matched


def outcomes(results: DataFrame, by: list[str]) -> DataFrame:
    """Results (by, item_id, error) as counts, the failed ids with their errors, and the flags that follow."""
    failed = F.col("error").isNotNull()
    rows = results.groupBy(*by).agg(F.count_if(~failed).alias("succeeded"), F.count_if(failed).alias("failed"), F.sort_array(F.collect_list(F.when(failed, F.struct("item_id", "error")))).alias("errors"))
    return rows.withColumns({"all_succeeded": F.col("failed") == 0, "all_failed": (F.col("succeeded") == 0) & (F.col("failed") > 0), "partial": (F.col("succeeded") > 0) & (F.col("failed") > 0)})


def add_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Schema evolution: missing columns are added as nulls, those that are there stay."""
    return df.withColumns({c: F.lit(None).cast(kind) for c, kind in columns.items() if c not in df.columns})


def upsert_interactions(target: DataFrame, source: DataFrame, keys: list[str], fill: list[str], update: list[str], now: Column) -> DataFrame:
    """Interactions after a run: ``fill`` columns stay once they are set, ``update`` columns are the run's, and
    processed_at is set on those that were there before."""
    known = target.select(*keys).withColumn("_known", F.lit(True))
    rows = source.join(known, keys, "left").withColumn("processed_at", F.when(F.col("_known"), now.cast("timestamp"))).drop("_known")
    return upsert(target, rows, keys, update=[*update, "processed_at"], fill=fill)


def relate(edges: DataFrame, rows: DataFrame) -> DataFrame:
    """RELATED_TO edges (tenant_id, src_id, dst_id, confidence) between an item and the stored one it was decided to be
    related to, the smaller id first; the surest decision of a new pair counts, existing edges stay."""
    a, b = F.col("action_item_id"), F.col("vec_id")
    pairs = rows.where(a != b).select("tenant_id", F.least(a, b).alias("src_id"), F.greatest(a, b).alias("dst_id"), "confidence")
    return append_absent(edges, pairs.groupBy("tenant_id", "src_id", "dst_id").agg(F.max("confidence").alias("confidence")), ["tenant_id", "src_id", "dst_id"])
