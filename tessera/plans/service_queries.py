"""Registered queries of the parts around the tables: the index in cells, model calls, the event sink, figures of a run
and the bucketed layout. Beside each the SQL that says the same of the given tables."""

from __future__ import annotations

import atexit
import contextlib
import hashlib
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.models import ask, extraction
from tessera.operators import cells
from tessera.operators import figures as R
from tessera.plans import catalog
from tessera.plans.catalog import ITEMS, TOPK, Data
from tessera.scratch import folder
from tessera.shipping import ship
from tessera.sources import formats, layout

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


@query(TOPK)
def v2_cell_index(spark, sf):
    """The top k of v2_topk_search from an index in cells."""
    d = Data(spark, sf)
    path = folder(spark, "index")
    cells.build(d.vectors(), path, 32)
    return cells.nearest(d.probes(), path, 10, 0.1, ["label"])


class StandIn:
    """A service that answers with a digest: its first call fails, it answers backwards, and it leaves out what comes
    last at the second."""

    def __init__(self):
        self.calls = 0

    def __call__(self, texts: list[str]) -> Iterator[tuple[int, str]]:
        self.calls += 1
        if self.calls == 1:
            raise ConnectionError("not yet")
        for n in reversed(range(len(texts) - (self.calls == 2 and len(texts) > 1))):
            yield n, hashlib.md5(texts[n].encode()).hexdigest()


@query("SELECT conv_id, turn, CASE WHEN trim(text) <> '' THEN md5(text) END AS answer, NULL::VARCHAR AS error FROM conversations")
def v14_model_calls(spark, sf):
    return ask(Data(spark, sf).conversations, "text", StandIn, "string", pause=0.0).select("conv_id", "turn", "answer", "error")


class Words:
    """A service that extracts the numbers of a text, in their order."""

    def __call__(self, texts: list[str]) -> Iterator[tuple[int, list[str]]]:
        import re

        for n, text in enumerate(texts):
            yield n, re.findall("[0-9]+", text)


@query("SELECT o_orderkey::VARCHAR AS id, idx - 1 AS idx, item, NULL::VARCHAR AS error FROM (SELECT o_orderkey, items, unnest(range(1, len(items) + 1))::INT AS idx, unnest(items) AS item FROM (SELECT o_orderkey, regexp_extract_all(o_orderdate::DATE::VARCHAR || ' ' || o_custkey, '[0-9]+') AS items FROM orders))")
def v14_extraction(spark, sf):
    """Many rows of one text, by a table function of SQL."""
    ship(spark)
    spark.udtf.register("extract_numbers", extraction(Words))
    texts = Data(spark, sf).orders.select(F.col("o_orderkey").cast("string").alias("id"), F.concat_ws(" ", F.col("o_orderdate").cast("date"), "o_custkey").alias("text"))
    return spark.sql("SELECT * FROM extract_numbers(TABLE({texts}))", texts=texts)


@query(catalog.ORACLES["s14_deal_events"])
def s14_event_sink(spark, sf):
    """The events of s14_deal_events through the sink and back."""
    formats.register(spark)
    path = folder(spark, "events")
    catalog.QUERIES["s14_deal_events"](spark, sf).write.format("tessera_events").mode("append").save(path)
    return spark.read.format("tessera_events").load(path)


@query(f"WITH {ITEMS} SELECT count(*) AS n, count_if(status = 'open') AS open, count_if(status = 'completed') AS completed, count_if(status NOT IN ('open', 'completed')) AS other, round(sum(priority_score), 3) AS score FROM items")
def f3_run_figures(spark, sf):
    """Figures of the items that are taken while they are written."""
    path = folder(spark, "figures")
    figures = R.by_value(F.col("status"), ["open", "completed"]) | {"n": F.count(F.lit(1)), "score": F.round(F.sum("priority_score"), 3)}
    seen = R.measured(Data(spark, sf).items(), lambda df: df.write.parquet(path), figures)
    return spark.createDataFrame([tuple(seen[c] for c in ("n", "open", "completed", "other", "score"))], "n long, open long, completed long, other long, score double")


#: Buckets of the registered layout.
BUCKETS = 16


@query(f"WITH {ITEMS} SELECT account_id, item_id, status, priority_score, c_mktsegment AS segment FROM items JOIN customer ON c_custkey = account_id WHERE status IN ('open', 'in_progress') QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY priority_score DESC NULLS LAST, item_id) <= 20")
def s18_pending_layout(spark, sf):
    """Top lists of a bucketed table, joined to accounts that are bucketed alike."""
    d = Data(spark, sf)
    name = f"tessera_pending_{uuid.uuid4().hex}"
    layout.write_pending(d.items(), name, BUCKETS, ["account_id"])
    atexit.register(dropped, spark, name)
    lists = layout.pending(spark, name, [F.col("priority_score").desc_nulls_last(), F.col("item_id").asc()], 20, ["account_id"])
    return lists.join(d.customer.select(F.col("c_custkey").alias("account_id"), F.col("c_mktsegment").alias("segment")), "account_id").select("account_id", "item_id", "status", "priority_score", "segment")


def dropped(spark: SparkSession, table: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone
        spark.sql(f"DROP TABLE IF EXISTS {table}")
