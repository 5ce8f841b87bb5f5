"""Media columns: WAV bytes beside the rows, short-time Fourier transforms and spectral-peak pair fingerprints.

``encode`` stores a payload losslessly as unsigned 8-bit mono samples in a WAV column; ``fingerprint`` reads the
stored bytes back with the wave module. Each frame's strongest local maxima are peaks; each peak pairs with the
peaks of the next frames; a pair is kept as its time code (frame) and a hash of both bins and their distance.
Magnitudes are compared as rounded log levels, lower bin first on ties, so equal payloads give equal fingerprints.

Edge cases: a null text counts as empty; the payload is padded with bytes 255 to a positive multiple of 576, so it is
never empty; very long texts are transformed whole, 512 frames at a time; null ids, repeated rows and extra columns pass
through, but for columns named like one that is made here, which the new one replaces; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import as_bytes, in_chunks, saved

#: Samples of the padding unit, the hop and a frame; rate; frames transformed at once.
UNIT, HOP, FRAME, RATE, BLOCK = 576, 96, 192, 8000, 512
WINDOW = np.hanning(FRAME)


def pad(data: bytes, unit: int = UNIT) -> bytes:
    """``data`` with bytes 255 up to a positive multiple of ``unit``."""
    return data + b"\xff" * (max(1, -(-len(data) // unit)) * unit - len(data))


def to_wav(samples: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(samples)
    return out.getvalue()


def from_wav(media: bytes) -> tuple[bytes, int]:
    """(samples, rate) of 8-bit mono WAV bytes."""
    with wave.open(io.BytesIO(media), "rb") as w:
        if w.getnchannels() != 1 or w.getsampwidth() != 1:
            raise ValueError("only 8-bit mono samples are stored")
        return w.readframes(w.getnframes()), w.getframerate()


def levels(samples: np.ndarray) -> np.ndarray:
    """Log levels of the short-time Fourier transform, one row a frame; a short signal gives one padded frame."""
    if len(samples) < FRAME:
        samples = np.concatenate([samples, np.full(FRAME - len(samples), 128, dtype=np.uint8)])
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    out = [np.rint(8 * np.log2(1 + np.abs(np.fft.rfft((frames[i : i + BLOCK].astype(np.float64) - 128) * WINDOW, axis=1)))).astype(np.int16) for i in range(0, len(frames), BLOCK)]
    return np.concatenate(out)


def peaks(level: np.ndarray, per_frame: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(frame, bin) of the strongest local maxima of each frame, in time and then bin order."""
    inner = level[:, 1:-1].astype(np.int32)
    top = (inner > level[:, :-2]) & (inner >= level[:, 2:])
    bins = inner.shape[1]
    rank = np.where(top, inner * bins + (bins - 1 - np.arange(bins)), -1)
    best = -np.sort(-np.partition(rank, bins - per_frame, axis=1)[:, bins - per_frame :], axis=1)
    frame, k = np.nonzero(best >= 0)
    found = bins - best[frame, k] % bins
    order = np.lexsort((found, frame))
    return frame[order], found[order]


def pairs(frame: np.ndarray, bins: np.ndarray, reach: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(time code, pair hash) of every peak with every peak of the next ``reach`` frames."""
    n = len(frame)
    first, end = np.searchsorted(frame, frame, side="right"), np.searchsorted(frame, frame + reach, side="right")
    count = end - first
    a = np.repeat(np.arange(n), count)
    b = np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count) + first[a]
    code = (bins[a].astype(np.int64) << 20) | (bins[b].astype(np.int64) << 8) | (frame[b] - frame[a])
    return frame[a].astype(np.int32), code


def encode(df: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """``df`` without its text, with the WAV column added and the payload's unpadded size."""
    kept = [c for c in df.columns if c not in (text, media, "n_bytes")]
    df = df.select(*kept, text)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        data = as_bytes(batch.column(len(kept)))
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([len(x) for x in data], pa.int64()), pa.array([to_wav(pad(x)) for x in data], pa.binary())], names=[*kept, "n_bytes", media])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema[:-1])
    return in_chunks(df, step, f"{fields}n_bytes long, `{media}` binary")


def fingerprint(df: DataFrame, media: str = "media") -> DataFrame:
    """Reads the WAV column back: payload figures, a digest of the fingerprint (feature), and the fingerprint itself:
    the pairs' time codes (times) and hashes (codes)."""
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "times", "codes"]
    kept = [c for c in df.columns if c != media and c not in names]
    df = df.select(*kept, media)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for stored in as_bytes(batch.column(len(kept))):
            payload, _ = from_wav(stored)
            level = levels(np.frombuffer(payload, dtype=np.uint8))
            t, code = pairs(*peaks(level))
            mark = hashlib.blake2b(t.tobytes() + code.tobytes(), digest_size=12).hexdigest()
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), f"{len(level)}f{len(code)}p{mark}", t, code))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=[*kept, *names])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema[:-1])
    return in_chunks(df, step, f"{fields}payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, times array<int>, codes array<long>", rows=250)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return fingerprint(saved(encode(docs), "media"))
