"""Calls of a model service from inside tasks: one client a task, texts in batches, failed batches again, answers put back
in order. As a function of DataFrames, and as a table function for SQL that makes many rows of one text."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera import schemas as S
from tessera.shipping import ship

#: A client takes a list of texts and gives (place in the list, answer) in any order; a place without an answer failed.
Client = Callable[[list[str]], Iterable[tuple[int, Any]]]
#: Texts of a call, tries of a call, seconds before the second try (doubled for each further one).
BATCH, TRIES, PAUSE = 64, 3, 0.5


def answers(client: Client, texts: list[str], tries: int = TRIES, pause: float = PAUSE, sleep: Callable[[float], None] = time.sleep) -> list[tuple[Any, str | None]]:
    """(answer, error) of each text, in the texts' order. A call that raises, or leaves texts without an answer, is made
    again for those that have none; when the tries are over they are halved, so that only what fails alone has an error."""
    out: dict[int, Any] = {}
    error = "no answer"
    for n in range(tries):
        left = [i for i in range(len(texts)) if i not in out]
        if not left:
            break
        if n:
            sleep(pause * 2 ** (n - 1))
        try:
            for place, answer in client([texts[i] for i in left]):
                out[left[place]] = answer
        except Exception as e:  # noqa: BLE001  whatever a service raises, it is asked again
            error = (str(e) or type(e).__name__)[:1000]
    left = [i for i in range(len(texts)) if i not in out]
    if len(left) < 2:
        return [(out.get(i), error if i in left else None) for i in range(len(texts))]
    half = len(left) // 2
    again = answers(client, [texts[i] for i in left[:half]], tries, pause, sleep) + answers(client, [texts[i] for i in left[half:]], tries, pause, sleep)
    told = dict(zip(left, again, strict=True))
    return [told.get(i, (out.get(i), None)) for i in range(len(texts))]


def ask(df: DataFrame, text: str, make: Callable[[], Client], returns: str, batch: int = BATCH, tries: int = TRIES, pause: float = PAUSE) -> DataFrame:
    """``df`` with ``answer`` (of type ``returns``) and ``error``. ``make`` gives a task its client. Equal texts of an Arrow
    batch are asked once; a null or blank text is not asked and has neither. A failed text does not stop the others. A
    column that is already named ``answer`` or ``error`` raises."""
    if clash := {"answer", "error"} & set(df.columns):
        raise ValueError(f"the columns {sorted(clash)} are made here")
    schema = S.struct(f"answer {returns}, error string")
    kind = to_arrow_type(schema["answer"].dataType)

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = None
        for t in batches:
            texts = t["_text"].to_pylist()
            asked = list(dict.fromkeys(x for x in texts if x is not None and x.strip()))
            told: dict[str, tuple[Any, str | None]] = {}
            for n in range(0, len(asked), batch):
                client = client or make()
                part = asked[n : n + batch]
                told |= zip(part, answers(client, part, tries, pause), strict=True)
            both = [told.get(x, (None, None)) for x in texts]
            rest = t.drop_columns(["_text"])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array([a for a, _ in both], kind), pa.array([e for _, e in both], pa.string())], [*rest.schema.names, "answer", "error"])

    ship(df.sparkSession)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in [*df.schema, *schema])
    return df.withColumn("_text", F.col(text).cast("string")).mapInArrow(call, fields)


def extraction(make: Callable[[], Client], batch: int = BATCH, tries: int = TRIES, pause: float = PAUSE):
    """A table function to register: of TABLE(id string, text string) it makes (id, idx, item, error), one row an item in
    the client's order, one row with an error for a text that failed, none for a text without items."""

    class Extract:
        def __init__(self):
            self.client, self.rows = None, []

        def told(self):
            self.client = self.client or make()
            for (key, _), (items, error) in zip(self.rows, answers(self.client, [t for _, t in self.rows], tries, pause), strict=True):
                if error is not None:
                    yield key, None, None, error
                yield from ((key, n, item, None) for n, item in enumerate(items or []))
            self.rows = []

        def eval(self, row):
            if row["text"] is not None and row["text"].strip():
                self.rows.append((row["id"], row["text"]))
            if len(self.rows) >= batch:
                yield from self.told()

        def terminate(self):
            if self.rows:
                yield from self.told()

    return F.udtf(Extract, returnType="id string, idx int, item string, error string")
