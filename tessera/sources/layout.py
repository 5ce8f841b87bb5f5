"""A stored layout for pending items: bucketed by tenant and account, so that joins and top lists by account need no
exchange on the items' side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.graph import top

#: What a pending list is asked by, and which statuses are pending.
KEYS, PENDING = ["tenant_id", "account_id"], ["open", "in_progress"]


def write_pending(items: DataFrame, table: str, buckets: int, keys: list[str] | None = None) -> None:
    """Save the items whose status is pending as a table of ``buckets`` buckets by the keys, sorted by them in each file.
    Each bucket is one file, so choose ``buckets`` for the size of the table (an eighth of a gigabyte each)."""
    keys = keys or KEYS
    rows = items.where(F.col("status").isin(PENDING)).repartition(buckets, *keys)
    rows.write.bucketBy(buckets, *keys).sortBy(*keys).format("parquet").mode("overwrite").saveAsTable(table)


def pending(spark: SparkSession, table: str, orders: list[Column], n: int, keys: list[str] | None = None) -> DataFrame:
    """The first n pending items of each account in the given order."""
    return top(spark.table(table), orders, n, keys or KEYS)
