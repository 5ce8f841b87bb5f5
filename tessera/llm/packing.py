"""Packing into fixed-length sequences as vector bin packing with a dot-product heuristic.

Every piece needs tokens, one segment and its loss-bearing tokens; a sequence has a limit on each. A document longer
than the sequence is cut into full pieces; what remains goes to a pool. A sequence is filled by always taking, of
the pieces that still fit, the one whose need has the largest dot product with the room left. When none fits and
tokens are left, the largest piece that another limit does not forbid is cut to fill them. The last sequence of a
task is divided into powers of two, which need no padding. Tasks pack on their own, so packing needs no exchange.

Instruction data has a prompt column: a document is then its prompt and its text, and the prompt's tokens bear no loss.

Edge cases: a null text or prompt counts as empty, a null text yields its end id alone; very long texts are cut into
full sequences; repeated rows are packed each; null ids are kept; of equally good pieces the one pooled first is taken;
other columns are not read and not returned, whatever their names; an empty table yields no rows. Sequence ids are
unique, not dense: the task number in the high bits.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bpe import encoder, vocabulary
from tessera.shipping import ship

OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


class Packer:
    """Packs (key, ids, loss_from) into sequences; rows of OUT come from ``add`` and ``finish``."""

    def __init__(self, size: int = 2048, max_segments: int = 128, max_loss: int | None = None, first_id: int = 0, pool: int = 512):
        self.limits = np.array([size, max_segments, max_loss or size], dtype=np.int64)
        self.size, self.pool_size, self.next_id = size, pool, first_id
        self.ids: list[np.ndarray] = []  # of each pooled piece's document
        self.meta: list[list] = []  # doc id, start, loss_from
        self.need = np.zeros((0, 3), dtype=np.int64)
        self.out: list[tuple] = []

    def _loss(self, start: int, length: int, loss_from: int) -> int:
        return max(0, start + length - max(start, loss_from))

    def _emit(self, doc, ids: np.ndarray, start: int, length: int, loss_from: int, offset: int) -> None:
        crc = zlib.crc32(ids[start : start + length].astype("<u4").tobytes())
        self.out.append((doc, start, length, crc, len(ids), self.next_id, offset, self._loss(start, length, loss_from)))

    def add(self, docs: list, ids: list[np.ndarray], loss_from: list[int]) -> list[tuple]:
        """Take documents in; give the rows of the sequences that are now full."""
        need = []
        for doc, x, free in zip(docs, ids, loss_from, strict=True):
            at = 0
            while len(x) - at >= self.size and self._loss(at, self.size, free) <= self.limits[2]:
                self._emit(doc, x, at, self.size, free, 0)
                self.next_id += 1
                at += self.size
            while at < len(x):
                # the longest piece within the token and the loss limits
                length = min(len(x) - at, self.size, max(0, free - at) + int(self.limits[2]))
                self.ids.append(x)
                self.meta.append([doc, at, free])
                need.append((length, 1, self._loss(at, length, free)))
                at += length
        if need:
            self.need = np.concatenate([self.need, np.array(need, dtype=np.int64)])
        while len(self.need) > self.pool_size:
            self._fill()
        return self._taken()

    def finish(self) -> list[tuple]:
        """The rest."""
        while len(self.need):
            self._fill(last=True)
        return self._taken()

    def _taken(self) -> list[tuple]:
        out, self.out = self.out, []
        return out

    def _fill(self, last: bool = False) -> None:
        """One sequence from the pool."""
        need, live = self.need, np.ones(len(self.need), dtype=bool)
        scale = 1.0 / self.limits
        room, chosen = self.limits.copy(), []
        while True:
            fits = live & (need <= room).all(axis=1)
            if fits.any():
                score = np.where(fits, (need * scale) @ (room * scale), -1.0)
                k = int(np.argmax(score))
                chosen.append((k, int(need[k, 0])))
                room -= need[k]
                live[k] = False
                continue
            if room[0] > 0 and room[1] > 0 and live.any():
                # nothing fits whole: cut the largest piece whose first tokens fit every limit
                order = np.argsort(np.where(live, -need[:, 0], 1), kind="stable")[: int(live.sum())]
                for k in order:
                    doc, start, free = self.meta[k]
                    length = min(int(room[0]), int(need[k, 0]) - 1, max(0, free - start) + int(room[2]))
                    if length > 0:
                        chosen.append((int(k), length))
                        room -= [length, 1, self._loss(start, length, free)]
                        live[k] = False  # its rest waits for the next sequence
                        break
                else:
                    break
                continue
            break
        cut = [(k, n) for k, n in chosen if n < need[k, 0]]
        self._write(chosen, int(self.size - room[0]), last and not cut and not live.any())
        for k, n in cut:
            doc, start, free = self.meta[k]
            self.meta[k] = [doc, start + n, free]
            rest = int(need[k, 0]) - n
            need[k] = (rest, 1, self._loss(start + n, rest, free))
            live[k] = True
        keep = np.flatnonzero(live)
        self.ids, self.meta, self.need = [self.ids[i] for i in keep], [self.meta[i] for i in keep], need[keep]

    def _write(self, chosen: list[tuple[int, int]], total: int, divide: bool) -> None:
        """Emit a sequence; the very last one is divided into powers of two."""
        sizes = [1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1] if divide else [total]
        left, offset = sizes.pop(0), 0
        for k, n in chosen:
            doc, start, free = self.meta[k]
            while n:
                take = min(n, left)
                self._emit(doc, self.ids[k], start, take, free, offset)
                start, n, left, offset = start + take, n - take, left - take, offset + take
                if not left and sizes:
                    left, offset = sizes.pop(0), 0
                    self.next_id += 1
        self.next_id += 1


def pack(df: DataFrame, vocab: str | None = None, end_id: int = 1, size: int = 2048, max_segments: int = 128, max_loss: int | None = None, prompt: str | None = None) -> DataFrame:
    """Pieces of (doc_id, text) in sequences of at most ``size`` tokens, ``max_segments`` pieces and ``max_loss`` (null:
    ``size``) loss-bearing tokens; ``prompt`` names a column of text that goes before and bears no loss."""
    vocab = vocab or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(size, max_segments, max_loss, first_id=TaskContext.get().partitionId() << 36)
        encode = encoder(vocab).encode
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                some = batch.slice(i, 256)
                ids = [np.append(x, x.dtype.type(end_id)) for x in encode(some.column(1).to_pylist())]
                free = [0] * len(ids)
                if prompt:
                    heads = encode(some.column(2).to_pylist())
                    free = [len(x) for x in heads]
                    ids = [np.concatenate(x) for x in zip(heads, ids, strict=True)]
                if rows := packer.add(some.column(0).to_pylist(), ids, free):
                    yield table(rows)
        if rows := packer.finish():
            yield table(rows)

    ship(df.sparkSession)
    return df.select("doc_id", "text", *[F.col(f"`{prompt}`").cast("string").alias("prompt")][: bool(prompt)]).mapInArrow(run, OUT)


def answers(turns: DataFrame) -> DataFrame:
    """(doc_id, prompt, text) of conversations (conv_id, turn, role, text): each assistant turn with the turn before it
    as its prompt; the id is made of conversation and turn."""
    reply = turns.where("role = 'assistant'").select("conv_id", "turn", "text")
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("prompt"))
    return reply.join(before, ["conv_id", "turn"], "left").select(F.xxhash64("conv_id", "turn").alias("doc_id"), "prompt", "text")


def table(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=[c.split()[0] for c in OUT.split(", ")])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
