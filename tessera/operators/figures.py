"""Figures of a run, taken while it runs: counts by Observation as rows pass to their writer, and a listener that keeps
what each micro-batch of a stream observed. Neither reads anything a second time."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def by_value(column: Column, values: list[str], prefix: str = "") -> dict[str, Column]:
    """A count for each of the given values, and one named ``other`` for all else, nulls too."""
    out = {f"{prefix}{v}": F.count_if(column == v) for v in values}
    return out | {f"{prefix}other": F.count_if(~F.coalesce(column.isin(values), F.lit(False)))}


def measured(df: DataFrame, write: Callable[[DataFrame], Any], figures: dict[str, Column]) -> dict[str, Any]:
    """Write ``df`` by ``write`` and give its figures and the ``seconds`` it took. ``write`` must run the rows through once:
    figures are those of the first run that ends."""
    if clash := {"seconds"} & set(figures):
        raise ValueError(f"the figures {sorted(clash)} are made here")
    seen = Observation()
    began = time.monotonic()
    write(df.observe(seen, *[c.alias(name) for name, c in figures.items()]))
    return seen.get | {"seconds": time.monotonic() - began}


class BatchFigures(StreamingQueryListener):
    """Keeps, for each micro-batch of each query, its rows, its milliseconds by phase and what it observed, as (query,
    batch, rows, durations, observed) in the order of progress; of each query the last ``keep``."""

    def __init__(self, keep: int = 1000):
        self.keep, self.batches, self.ended = keep, {}, {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.batches.setdefault(str(event.id), [])

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        observed = {name: row.asDict() for name, row in p.observedMetrics.items()}
        rows = self.batches.setdefault(str(p.id), [])
        rows.append({"batch": p.batchId, "rows": p.numInputRows, "durations": dict(p.durationMs), "observed": observed})
        del rows[: -self.keep]

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.ended[str(event.id)] = event.exception

    def table(self, spark) -> DataFrame:
        rows = [(q, b["batch"], b["rows"], json.dumps(b["durations"]), json.dumps(b["observed"], default=str)) for q, bs in self.batches.items() for b in bs]
        return spark.createDataFrame(rows, "query string, batch long, rows long, durations string, observed string")
