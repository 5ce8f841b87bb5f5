"""Shared pieces of the corpus operators: scratch tables, folds, word splitting and 64-bit hashing.

Word hashing is done on whole byte buffers with numpy: the bytes of a text are summed as a polynomial
modulo 2**64, so that the hash of any slice comes from two prefix sums and one multiplication.
"""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.shipping import ship

U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15 | 1)
#: ASCII white space that separates words: space and 0x09 to 0x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: A-Z to a-z, every other byte to itself.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: As LOWER, with every ASCII byte that is neither digit nor letter turned into a space.
ALNUM = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where it is unset and all runs on one
    machine, a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path on whatever file system holds it; a stopped session is no error."""
    try:
        jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
    except Exception:  # noqa: BLE001  the session or its JVM is gone
        return


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again: cuts lineage and survives lost executors."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete scratch tables of ``saved`` that nothing reads any more."""
    for df in frames:
        remove(df.sparkSession, df._scratch)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that are done; it does so when the driver collects its garbage."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def trim() -> None:
    """Give freed memory back to the system, so that what one task needed does not weigh on the next one."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return


def in_chunks(df: DataFrame, step: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, rows: int = 1000) -> DataFrame:
    """Narrow Arrow pass: ``step`` makes one output batch of each slice of at most ``rows`` input rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, rows):
                if (out := step(batch.slice(i, rows))) is not None:
                    yield out
        trim()

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold(key: Column, parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts``; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % parts


def hash_sample(df: DataFrame, rows: int) -> DataFrame:
    """About ``rows`` rows of ``df`` (all, if it has no more), chosen by a hash of their columns."""
    n = df.count()
    if n <= rows:
        return df
    top = 1 << 40
    return df.where(F.pmod(F.xxhash64(*df.columns), F.lit(top)) < int(top * rows / n))


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null gives empty bytes."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the word (splitmix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(n: int, base: np.uint64 = BASE) -> np.ndarray:
    out = np.full(n + 1, base, dtype=U64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Rolling:
    """Hashes of slices of integer sequences, by prefix sums of a polynomial modulo 2**64."""

    def __init__(self, base: np.uint64 = BASE):
        self.base, self.inverse = base, U64(pow(int(base), -1, 1 << 64))
        self.up, self.down = powers(1024, self.base), powers(1024, self.inverse)

    def _grow(self, n: int) -> None:
        if n >= len(self.up):
            n = max(n, 2 * len(self.up))
            self.up, self.down = powers(n, self.base), powers(n, self.inverse)

    def slices(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of values[s:e] for each pair; equal content gives equal hashes wherever it stands."""
        n = len(values)
        self._grow(n + 1)
        total = np.zeros(n + 1, dtype=U64)
        np.cumsum((values + U64(1)) * self.up[:n], out=total[1:])
        # divide by base ** start (the base is odd, so it has an inverse): a slice counts from its own start
        return mix((total[ends] - total[starts]) * self.down[starts] + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))

    def windows(self, values: np.ndarray, k: int) -> np.ndarray:
        """Hash of every run of k values."""
        n = len(values) - k + 1
        if n <= 0:
            return np.zeros(0, dtype=U64)
        at = np.arange(n)
        return self.slices(values, at, at + k)


BYTES, WORDS, WORDS2 = Rolling(), Rolling(U64(0xC2B2AE3D27D4EB4F)), Rolling(U64(0x165667B19E3779F9))


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes as uint8, starts, ends) of the words of a text, split at ASCII white space."""
    raw = np.frombuffer(data, dtype=np.uint8)
    edge = np.flatnonzero(np.diff(SPACE[raw].astype(np.int8), prepend=1, append=1))
    return raw, edge[0::2], edge[1::2]


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(64-bit hash, start, end) of each word."""
    raw, starts, ends = word_spans(data)
    if not len(starts):
        return np.zeros(0, dtype=U64), starts, ends
    return BYTES.slices(raw.astype(U64), starts, ends), starts, ends


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def arrow(schema: str | None = None, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns))
