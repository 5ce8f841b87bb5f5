"""Reads over node and edge tables: points, hops, top lists, histories and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scope(df: DataFrame, **equal) -> DataFrame:
    """Equality on every given column that is not None; reaches the scan as pushed filters."""
    return reduce(lambda d, kv: d.where(F.col(kv[0]) == F.lit(kv[1])), ((k, v) for k, v in equal.items() if v is not None), df)


def at_least(df: DataFrame, **low) -> DataFrame:
    return reduce(lambda d, kv: d.where(F.col(kv[0]) >= F.lit(kv[1])), ((k, v) for k, v in low.items() if v is not None), df)


def point(df: DataFrame, **key) -> DataFrame:
    return scope(df, **key).limit(1)


def hop(nodes: DataFrame, edges: DataFrame, node_key: str, how: str = "inner") -> DataFrame:
    """Nodes at the far end (dst_id) of edges, with the edge's src_id."""
    e = edges.withColumnRenamed("dst_id", node_key)
    return e.join(nodes, [c for c in ("tenant_id", node_key) if c in e.columns and c in nodes.columns], how)


def top(df: DataFrame, order: list[Column], n: int, by: list[str] | None = None) -> DataFrame:
    """The first n rows, of all or of each group; Spark limits each group before the exchange."""
    if not by:
        return df.orderBy(*order).limit(n)
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")


def ranked(df: DataFrame, order: list[Column], by: list[str], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))


def latest(df: DataFrame, key: list[str], version: str) -> DataFrame:
    """The row of the highest version of each key, by one aggregation."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), version).alias("_r")).select(*key, "_r.*")


def intervals(versions: DataFrame, key: list[str], version: str, start: str, until: str) -> DataFrame:
    """Proper validity: each version starts where the one before it ended."""
    w = Window.partitionBy(*key).orderBy(version)
    return versions.withColumn("effective_from", F.coalesce(F.lag(until).over(w), F.col(start))).withColumn("effective_until", F.col(until))


def as_of(versions: DataFrame, when: Column, start: str = "effective_from", until: str = "effective_until") -> DataFrame:
    """Versions valid at a time (an extension)."""
    return versions.where((F.col(start) <= when) & (F.col(until).isNull() | (when < F.col(until))))


def children(parents: DataFrame, rows: DataFrame, on: list[str], fields: list[str], name: str) -> DataFrame:
    """Parents with a list of child structs; one with no child keeps one element of nulls."""
    return parents.join(rows.groupBy(*on).agg(F.collect_list(F.struct(*fields)).alias(name)), on, "left").withColumn(name, F.coalesce(name, F.array(F.struct(*[F.lit(None).cast(rows.schema[f].dataType).alias(f) for f in fields]))))


def linked_once(nodes: DataFrame, links: DataFrame, on: list[str]) -> DataFrame:
    """Distinct nodes that have a link (RETURN DISTINCT as a semi join)."""
    return nodes.join(links.select(*on), on, "left_semi")


def counted(parents: DataFrame, rows: DataFrame, on: list[str], name: str = "n") -> DataFrame:
    """Parents with their number of rows, 0 if none; rows are counted before the join."""
    return parents.join(rows.groupBy(*on).agg(F.count("*").alias(name)), on, "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))


def node_counts(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, [d.agg(F.count("*").alias("n")).select(F.lit(k).alias("label"), "n") for k, d in tables.items()])


def reconcile(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Counts of two stores side by side."""
    both = a.withColumnRenamed("n", "n_a").join(b.withColumnRenamed("n", "n_b"), key, "full")
    both = both.withColumn("n_a", F.coalesce("n_a", F.lit(0).cast("long"))).withColumn("n_b", F.coalesce("n_b", F.lit(0).cast("long")))
    return both.withColumn("matches", F.col("n_a") == F.col("n_b"))


def convergence(a: Column, b: Column) -> Column:
    """Whether both pipelines have left their counter on an interaction."""
    return F.when(a.isNotNull() & b.isNotNull(), "PASS").when(a.isNotNull() | b.isNotNull(), "PARTIAL").otherwise("FAIL")


def mentions(words: list[str], *columns: str) -> Column:
    """Any of the words in the texts, in any case."""
    text = F.lower(F.concat_ws(" ", *columns))
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w.lower())) for w in words])


def in_order(rows: DataFrame, by: list[str], index: str, value: str, name: str = "outputs") -> DataFrame:
    """Values of each group as a list in the order of their index, however they came; a group is one batch."""
    return rows.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct(index, value))), lambda x: x[value]).alias(name))


def durations(steps: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """Milliseconds of all steps of each group, and of the longest; a step that has not ended counts nothing."""
    ms = (F.unix_micros(end) - F.unix_micros(start)) / 1000
    return steps.groupBy(*by).agg(F.count(end).alias("steps"), F.coalesce(F.sum(ms), F.lit(0.0)).alias("total_ms"), F.max(ms).alias("longest_ms"))
