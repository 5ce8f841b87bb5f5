"""Tables that change together: a batch adds the rows that it changes to every table, and all are seen at once.

A table is plain Parquet under root/name, partitioned by batch; its current state is the last row of each key up to the
last commit. Commits are empty files under root/_commits, made after all of a batch's rows are written, so a failure in
between leaves readers on the state before. A batch writes only its own rows, sorted by tenant, so that a reader of one
tenant skips the others by the files' statistics. ``compact`` writes the whole state as one batch; reads start there.
There is one writer at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import schemas as S

#: The tag of a commit that changes nothing.
COMPACT = "compact"


class Batch:
    """The rows of one batch, unseen until ``commit``."""

    def __init__(self, tables: Tables, number: int, tag: str):
        self.tables, self.number, self.tag = tables, number, tag
        for name in tables.schemas:  # what an attempt left that failed
            self.drop(name)

    def _at(self, name: str) -> str:
        return f"{self.tables.root}/{name}/batch={self.number}"

    def write(self, name: str, df: DataFrame) -> None:
        fields = S.struct(self.tables.schemas[name])
        df.select(*[F.col(f.name).cast(f.dataType) for f in fields]).sortWithinPartitions("tenant_id").write.mode("overwrite").parquet(self._at(name))

    def drop(self, name: str) -> None:
        fs, path = self.tables._path(self._at(name))
        fs.delete(path, True)

    def commit(self, full: bool = False) -> None:
        fs, path = self.tables._path(f"{self.tables.root}/_commits/{self.number:012d}.{self.tag}.{'full' if full else 'rows'}")
        fs.create(path, False).close()


class Tables:
    """``schemas`` and ``keys`` by table; every table has a tenant_id."""

    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, str], keys: dict[str, list[str]]):
        self.spark, self.root, self.schemas, self.keys = spark, root.rstrip("/"), schemas, keys

    def _path(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def commits(self) -> list[tuple[int, str, bool]]:
        """(number, tag, whole state) of each commit, ascending."""
        fs, path = self._path(f"{self.root}/_commits")
        if not fs.exists(path):
            return []
        names = [x.getPath().getName() for x in fs.listStatus(path)]
        return sorted((int(n.partition(".")[0]), n.partition(".")[2].rpartition(".")[0], n.endswith(".full")) for n in names if not n.startswith("."))

    def has(self, tag: str) -> bool:
        return any(t == tag for _, t, _ in self.commits())

    def begin(self, tag: str) -> Batch:
        done = self.commits()
        return Batch(self, done[-1][0] + 1 if done else 0, tag)

    def changes(self, name: str) -> DataFrame:
        """The committed rows of a table with their batch, from the last whole state on."""
        done = self.commits()
        fs, path = self._path(f"{self.root}/{name}")
        if not done or not fs.exists(path):
            return self.spark.createDataFrame([], S.struct(f"{self.schemas[name]}, batch int"))
        base = max([n for n, _, full in done if full], default=0)
        rows = self.spark.read.schema(S.struct(f"{self.schemas[name]}, batch int")).parquet(f"{self.root}/{name}")
        return rows.where(F.col("batch").between(base, done[-1][0]))

    def read(self, name: str) -> DataFrame:
        """The current state."""
        key = self.keys[name]
        names = [f.name for f in S.struct(self.schemas[name])]
        rest = [c for c in names if c not in key]
        last = self.changes(name).groupBy(*key).agg(F.max_by(F.struct(*rest), "batch").alias("_r"))
        return last.select(*[F.col(c) if c in key else F.col("_r").getField(c).alias(c) for c in names])

    def compact(self) -> None:
        """Write the current state as one batch, and delete what came before the whole state before it."""
        done = self.commits()
        batch = self.begin(COMPACT)
        for name in self.schemas:
            batch.write(name, self.read(name))
        batch.commit(full=True)
        old = max([n for n, _, full in done if full], default=0)
        for n, tag, full in done:
            if n < old:
                for name in self.schemas:
                    fs, path = self._path(f"{self.root}/{name}/batch={n}")
                    fs.delete(path, True)
                fs, path = self._path(f"{self.root}/_commits/{n:012d}.{tag}.{'full' if full else 'rows'}")
                fs.delete(path, False)
