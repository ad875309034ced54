"""Media columns: text bytes as WAV samples, and spectral-peak pair fingerprints of them."""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vantage.llm.storage import documents, materialise

UNIT = 576
RATE = 8000
BANDS = ((1, 12), (12, 36), (36, 96), (96, 289))
FAN_OUT = 2


def encode_wav(payload: bytes, rate: int = RATE) -> bytes:
    """One channel of unsigned 8-bit samples, one sample a byte."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def decode_wav(stored: bytes) -> bytes:
    with wave.open(io.BytesIO(stored), "rb") as w:
        return w.readframes(w.getnframes())


def spectrum(payload: bytes, unit: int = UNIT) -> np.ndarray:
    """Short-time Fourier power: frames of ``unit`` samples, half overlapping, under a Hann window."""
    x = np.frombuffer(payload, np.uint8).astype(np.float32) - 128
    hop = unit // 2
    frames = np.lib.stride_tricks.sliding_window_view(x, unit)[::hop]
    f = np.fft.rfft(frames * np.hanning(unit).astype(np.float32), axis=1)
    return f.real**2 + f.imag**2


def peaks(power: np.ndarray) -> np.ndarray:
    """The strongest bin of each band and frame."""
    return np.stack([a + power[:, a:b].argmax(axis=1) for a, b in BANDS], axis=1)


def fingerprints(payload: bytes, unit: int = UNIT, chunk: int = 4096) -> np.ndarray:
    """Time-coded pairs of peaks, ascending in time.

    A code is ``frame << 32 | band << 28 | bin << 16 | later bin << 4 | distance``: a peak and the peak of the
    same band one to ``FAN_OUT`` frames later. Long payloads go through in chunks of frames.
    """
    hop = unit // 2
    n = (len(payload) - unit) // hop + 1
    parts = [peaks(spectrum(payload[a * hop : (min(a + chunk, n) - 1) * hop + unit], unit)) for a in range(0, n, chunk)]
    top = np.concatenate(parts).astype(np.int64)
    codes = []
    for d in range(1, FAN_OUT + 1):
        if n > d:
            t = np.arange(n - d, dtype=np.int64)[:, None]
            codes.append((t << 32 | np.arange(len(BANDS)) << 28 | top[:-d] << 16 | top[d:] << 4 | d).ravel())
    return np.sort(np.concatenate(codes)) if codes else np.zeros(0, np.int64)


def store(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: int = UNIT) -> DataFrame:
    """``(doc_id, n_bytes, media)``: each text's UTF-8 bytes, padded with 255 to a positive multiple of ``unit``, as WAV.

    Null counts as empty: a payload of ``unit`` bytes 255. Rows repeat as they come; other columns are left out.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(0, batch.num_rows, 256):
                part = batch.slice(row, 256)
                raw = [(t or "").encode() for t in part.column(1).to_pylist()]
                media = [encode_wav(b + b"\xff" * ((max(1, -(-len(b) // unit)) * unit) - len(b))) for b in raw]
                yield pa.record_batch([part.column(0), pa.array([len(b) for b in raw], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    kind = texts.schema[id_col].dataType.simpleString()
    return texts.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(encode, f"doc_id {kind}, n_bytes long, media binary")


def features(stored: DataFrame, unit: int = UNIT) -> DataFrame:
    """Digests of the payload read back from each WAV, and its fingerprints.

    ``feature`` names the fingerprint array: pairs, frames and the CRC-32 of the codes. ``fingerprint`` is the array.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "fingerprint"]
        for batch in batches:
            for row in range(0, batch.num_rows, 128):
                part = batch.slice(row, 128)
                rows = []
                for media in part.column(2).to_pylist():
                    payload = decode_wav(media)
                    codes = fingerprints(payload, unit)
                    label = f"{len(codes)}:{(len(payload) - unit) // (unit // 2) + 1}:{zlib.crc32(codes.tobytes()):08x}"
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), label, codes))
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64())]
                yield pa.record_batch([part.column(0), part.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names)

    kind = stored.schema["doc_id"].dataType.simpleString()
    return stored.mapInArrow(read, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, fingerprint array<long>")


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as WAV in the shared folder, read back, and fingerprinted."""
    return features(materialise(store(documents(spark, sf_dir))))
