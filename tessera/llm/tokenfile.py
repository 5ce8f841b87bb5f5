"""Token-id files: fixed-size blocks of ids, split into byte or bit planes, each plane compressed with zstandard.

A file is a Parquet table whose rows are shards. A shard holds whole documents in ascending id order; its ids are
cut into blocks of a fixed number of ids, each block is transposed into planes (plane j holds byte or bit j of every
id) and each plane is compressed by itself. ``index`` gives the end of every plane in ``blob``, block by block, so
one block can be read without the others. ``before`` counts the ids ahead of the shard in its part; a part is one
write task, and the ids before a part are the sum of the earlier parts.

Edge cases: a null text counts as empty and yields only its end id; rows of equal or null id are all kept (null
first), ordered by their text; a text longer than a shard makes a longer shard; other columns are not read and not
returned; an empty table yields no shard and no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bpe import encoder, vocabulary
from tessera.llm.common import new_path
from tessera.shipping import ship

SHARD = "part int, seq int, first_doc long, before long, n_ids long, width int, planes string, block int, doc_ids array<long>, sizes array<int>, index array<int>, blob binary"


def to_planes(ids: np.ndarray, planes: str) -> list[bytes]:
    """The planes of one block; ids are unsigned little-endian integers."""
    raw = np.ascontiguousarray(ids).view(np.uint8).reshape(len(ids), ids.itemsize)
    if planes == "byte":
        return [raw[:, j].tobytes() for j in range(raw.shape[1])]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(bits[:, j]).tobytes() for j in range(bits.shape[1])]


def from_planes(parts: list[bytes], n: int, width: int, planes: str) -> np.ndarray:
    """The ids of one block from its planes."""
    if planes == "byte":
        raw = np.stack([np.frombuffer(p, dtype=np.uint8) for p in parts], axis=1)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(p, dtype=np.uint8))[:n] for p in parts], axis=1)
        raw = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(raw).view(f"<u{width}").reshape(n)


def pack_shard(ids: np.ndarray, block: int, planes: str, level: int = 3) -> tuple[list[int], bytes]:
    """(plane ends, compressed planes) of a shard's ids."""
    packer, ends, out, at = zstandard.ZstdCompressor(level=level), [], [], 0
    for i in range(0, len(ids), block):
        for plane in to_planes(ids[i : i + block], planes):
            out.append(packer.compress(plane))
            at += len(out[-1])
            ends.append(at)
    return ends, b"".join(out)


def read_block(k: int, n: int, block: int, width: int, planes: str, index: list[int], blob: bytes) -> np.ndarray:
    """Block k of a shard of n ids, without touching the others."""
    each = width if planes == "byte" else 8 * width
    unpacker, ends = zstandard.ZstdDecompressor(), [0, *index]
    size = min(block, n - k * block)
    parts = [unpacker.decompress(blob[ends[k * each + j] : ends[k * each + j + 1]]) for j in range(each)]
    return from_planes(parts, size, width, planes)


def read_shard(n: int, block: int, width: int, planes: str, index: list[int], blob: bytes) -> np.ndarray:
    return np.concatenate([read_block(k, n, block, width, planes, index, blob) for k in range(-(-n // block))] or [np.zeros(0, f"<u{width}")])


def write(df: DataFrame, path: str, vocab: str | None = None, end_id: int = 2, block: int = 8192, shard_ids: int = 1 << 18, planes: str = "byte") -> None:
    """Encode (doc_id, text) of ``df`` and write the shards, in ascending doc_id order, to ``path``.

    One range exchange orders the documents; each task then streams its range, holding one shard at a time
    (``shard_ids`` ids, or one longer document).
    """
    vocab = vocab or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, before = TaskContext.get().partitionId(), 0, 0
        docs: list[int | None] = []
        parts: list[np.ndarray] = []
        held = 0

        def shard() -> pa.RecordBatch:
            ids = np.concatenate(parts)
            ids = ids.astype("<u2") if ids.dtype == np.uint16 else ids.astype("<u4")
            ends, blob = pack_shard(ids, block, planes)
            row = {"part": part, "seq": seq, "first_doc": docs[0], "before": before, "n_ids": len(ids), "width": ids.itemsize, "planes": planes, "block": block, "doc_ids": docs, "sizes": [len(x) for x in parts], "index": ends, "blob": blob}
            return pa.RecordBatch.from_pylist([row], schema=ARROW)

        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                some = batch.slice(i, 256)
                for doc, ids in zip(some.column(0).to_pylist(), encoder(vocab).encode(some.column(1).to_pylist()), strict=True):
                    docs.append(doc)
                    parts.append(np.append(ids, ids.dtype.type(end_id)))
                    held += len(parts[-1])
                    if held >= shard_ids:
                        yield shard()
                        seq, before, docs, parts, held = seq + 1, before + held, [], [], 0
        if docs:
            yield shard()

    ship(df.sparkSession)
    ordered = df.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, SHARD).write.option("compression", "none").parquet(path)


ARROW = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("first_doc", pa.int64()), ("before", pa.int64()), ("n_ids", pa.int64()), ("width", pa.int32()), ("planes", pa.string()), ("block", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("index", pa.list_(pa.int32())), ("blob", pa.binary())])


def read(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a file: doc_id, start, n_tokens, and their ids as little-endian unsigned 32-bit bytes."""
    shards = spark.read.schema(SHARD).parquet(path)
    # one row for each write task: its number, and its ids in all
    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    base, at = {}, 0
    for row in totals:
        base[row["part"]] = at
        at += row["n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch.column(i)[k].as_py() for i, n in enumerate(batch.schema.names)}
                ids = read_shard(row["n_ids"], row["block"], row["width"], row["planes"], row["index"], row["blob"]).astype("<u4")
                ends = np.cumsum(row["sizes"])
                starts = ends - row["sizes"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(starts + base[row["part"]] + row["before"], pa.int64()), pa.array(row["sizes"], pa.int64()), pa.array([ids[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    ship(spark)
    return shards.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def checksum(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "ids")
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return checksum(read(spark, path))
