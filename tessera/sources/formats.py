"""Python data sources: SQLite tables in ranges of rows, a queue folder as a stream, an event sink that never doubles.

Paths must be reached by driver and executors alike. ``register`` makes the three formats known to a session.
"""

from __future__ import annotations

import json
import sqlite3
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as afs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from tessera.shipping import ship

#: Rows of SQLite that a task reads, rows of an Arrow batch, files of a queue that a task reads.
ROWS, ARROW_ROWS, FILES = 200_000, 10_000, 16


def located(path: str) -> tuple[afs.FileSystem, str]:
    if path.startswith("file:") and not path.startswith("file://"):
        path = path[5:]
    return afs.FileSystem.from_uri(path)


def names(path: str, suffix: str) -> list[str]:
    """The files of a folder that end so, in the order of their names; none if there is no folder."""
    fs, root = located(path)
    found = fs.get_file_info(afs.FileSelector(root, allow_not_found=True))
    return sorted(f.base_name for f in found if f.is_file and f.base_name.endswith(suffix) and not f.base_name.startswith((".", "_")))


def taken(path: str) -> str:
    fs, p = located(path)
    with fs.open_input_stream(p) as f:
        return f.read().decode()


def put(path: str, text: str) -> None:
    """Write a whole file under another name and move it to its own, so that nobody reads half of it."""
    fs, p = located(path)
    parent, _, name = p.rpartition("/")
    fs.create_dir(parent, recursive=True)
    draft = f"{parent}/.{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(draft) as f:
        f.write(text.encode())
    fs.move(draft, p)


@dataclass
class Range(InputPartition):
    path: str
    first: int
    last: int


class Sqlite(DataSource):
    """A table of one SQLite file, or of every *.db file of a folder, as ``spark.read.format("tessera_sqlite")`` with the
    options ``path``, ``table`` and ``rows`` (of a task). Ranges of the row id are the partitions; files are local paths."""

    @classmethod
    def name(cls) -> str:
        return "tessera_sqlite"

    def files(self) -> list[str]:
        _, p = located(self.options["path"])
        return [p] if p.endswith(".db") else [f"{p}/{n}" for n in names(p, ".db")]

    def schema(self) -> str:
        files = self.files()
        if not files:
            raise ValueError("no *.db file in " + self.options["path"])
        with opened(files[0]) as con:
            columns = con.execute(f"PRAGMA table_info({identifier(self.options['table'])})").fetchall()
        if not columns:
            raise ValueError("no table " + self.options["table"])
        kind = lambda t: "bigint" if "INT" in t.upper() else "double" if any(k in t.upper() for k in ("REAL", "FLOA", "DOUB")) else "binary" if "BLOB" in t.upper() else "string"
        return ", ".join(f"`{c[1]}` {kind(c[2] or '')}" for c in columns)

    def reader(self, schema: StructType) -> DataSourceReader:
        return SqliteReader(self.files(), self.options["table"], schema, int(self.options.get("rows", ROWS)))


def identifier(text: str) -> str:
    return '"' + text.replace('"', '""') + '"'


class opened:  # noqa: N801
    """A SQLite file, opened for reading only, closed after use."""

    def __init__(self, path: str):
        self.con = sqlite3.connect(f"file:{path}?mode=ro", uri=True)

    def __enter__(self) -> sqlite3.Connection:
        return self.con

    def __exit__(self, *_) -> None:
        self.con.close()


class SqliteReader(DataSourceReader):
    def __init__(self, files: list[str], table: str, schema: StructType, rows: int):
        self.files, self.table, self.schema, self.rows = files, identifier(table), schema, rows

    def partitions(self) -> list[Range]:
        out = []
        for path in self.files:
            with opened(path) as con:
                low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {self.table}").fetchone()
            if low is not None:
                out += [Range(path, n, min(high, n + self.rows - 1)) for n in range(low, high + 1, self.rows)]
        return out or [Range("", 0, -1)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        if not partition.path:
            return
        columns, kind = ", ".join(identifier(f.name) for f in self.schema), to_arrow_schema(self.schema)
        with opened(partition.path) as con:
            rows = con.execute(f"SELECT {columns} FROM {self.table} WHERE rowid BETWEEN ? AND ?", (partition.first, partition.last))
            while part := rows.fetchmany(ARROW_ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), kind, strict=True)], schema=kind)


@dataclass
class Files(InputPartition):
    paths: list[str]


class Queue(DataSource):
    """A folder of *.jsonl files as ``spark.readStream.format("tessera_queue")`` with the options ``path`` and ``files`` (of
    a task): a row of (file, line, body) for each line that is not blank. The offset is the name of the last file, so
    names must grow as files come and a file must come whole (written elsewhere and moved in)."""

    @classmethod
    def name(cls) -> str:
        return "tessera_queue"

    def schema(self) -> str:
        return "file string, line int, body string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return QueueReader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return QueueStream(self.options)


def lines(partition: Files) -> Iterator[tuple[str, int, str]]:
    for path in partition.paths:
        for n, body in enumerate(taken(path).split("\n")):
            if body.strip():
                yield path.rpartition("/")[2], n, body


def shared(root: str, files: list[str], each: int) -> list[Files]:
    return [Files([f"{root}/{n}" for n in files[i : i + each]]) for i in range(0, len(files), each)] or [Files([])]


class QueueReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.each = options["path"].rstrip("/"), int(options.get("files", FILES))

    def partitions(self) -> list[Files]:
        return shared(self.root, names(self.root, ".jsonl"), self.each)

    def read(self, partition: Files) -> Iterator[tuple]:
        return lines(partition)


class QueueStream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.root, self.each = options["path"].rstrip("/"), int(options.get("files", FILES))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"file": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"file": max(names(self.root, ".jsonl"), default="")}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        return shared(self.root, [n for n in names(self.root, ".jsonl") if start["file"] < n <= end["file"]], self.each)

    def read(self, partition: Files) -> Iterator[tuple]:
        return lines(partition)


@dataclass
class Written(WriterCommitMessage):
    file: str
    rows: int


class Events(DataSource):
    """A sink of events (key string, value string), and the source that reads them: ``format("tessera_events")`` with the
    option ``path``. Each task attempt writes a file of its own; one list of files is published when all tasks are done,
    and only listed files are read, so a task that runs twice tells nothing twice. A stream's list bears the number of
    its batch: a batch that is made again takes the place of its first writing."""

    @classmethod
    def name(cls) -> str:
        return "tessera_events"

    def schema(self) -> str:
        return "key string, value string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("events can only be appended")
        return EventWriter(self.options["path"].rstrip("/"), schema.names)

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamWriter:  # noqa: N802
        return EventStream(self.options["path"].rstrip("/"), schema.names)

    def reader(self, schema: StructType) -> DataSourceReader:
        return EventReader(self.options["path"].rstrip("/"))


class EventFiles:
    """What both writers do."""

    def __init__(self, root: str, columns: list[str]):
        if missing := {"key", "value"} - set(columns):
            raise ValueError(f"events need the columns {sorted(missing)}")
        self.root, self.list = root, uuid.uuid4().hex

    def write(self, iterator: Iterator) -> Written:
        fs, root = located(self.root)
        fs.create_dir(f"{root}/files", recursive=True)
        name, n = f"{uuid.uuid4().hex}.jsonl", 0
        with fs.open_output_stream(f"{root}/files/{name}") as f:
            for row in iterator:
                f.write((json.dumps([row["key"], row["value"]]) + "\n").encode())
                n += 1
        return Written(name, n)

    def publish(self, name: str, messages: list) -> None:
        put(f"{self.root}/lists/{name}.json", json.dumps([m.file for m in messages if m is not None and m.rows]))

    def forget(self, messages: list) -> None:
        fs, root = located(self.root)
        for m in messages:
            if m is not None:
                fs.delete_file(f"{root}/files/{m.file}")


class EventWriter(EventFiles, DataSourceWriter):
    def commit(self, messages: list) -> None:
        self.publish(f"job-{self.list}", messages)

    def abort(self, messages: list) -> None:
        self.forget(messages)


class EventStream(EventFiles, DataSourceStreamWriter):
    def commit(self, messages: list, batchId: int) -> None:  # noqa: N803
        self.publish(f"batch-{batchId:020d}", messages)

    def abort(self, messages: list, batchId: int) -> None:  # noqa: N803
        self.forget(messages)


class EventReader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self) -> list[Files]:
        files = [f for n in names(f"{self.root}/lists", ".json") for f in json.loads(taken(f"{self.root}/lists/{n}"))]
        return shared(f"{self.root}/files", files, FILES)

    def read(self, partition: Files) -> Iterator[tuple]:
        for _, _, body in lines(partition):
            yield tuple(json.loads(body))


def register(spark: SparkSession) -> None:
    """Make the formats known to the session and their module to its executors."""
    ship(spark)
    for source in (Sqlite, Queue, Events):
        spark.dataSource.register(source)
