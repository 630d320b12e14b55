"""Media columns: payload bytes kept as WAV, read by the wave module, and fingerprinted.

A payload is stored as an 8-bit mono WAV. From the samples read back, a short-time Fourier transform
(frames of 576 samples, half overlapping) gives the strongest bin of each of four bands per frame;
bins that top their band's neighbours in time are peaks, each peak is paired with the next two, and
the pairs (bin, bin, frames between) are stored with their time as one array of codes,
``time << 32 | bin1 << 20 | bin2 << 8 | distance``.

Defined results: null text is the empty text; the empty text is one payload unit of 255; equal texts
give equal values in every column; rows and ids are kept as they are (nulls and repeats too); long
texts are transformed in blocks of frames, so memory follows the block and the text itself.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import bounded, parts_of, table

UNIT, PAD, RATE = 576, 255, 8000
FRAME, HOP, BLOCK = 576, 288, 2048
#: Bin ranges of the bands; bin 0 (the mean) is in none.
BANDS = [(1, 24), (24, 64), (64, 136), (136, 289)]
FAN, FAR = 2, 255


def payload_of(data: bytes) -> bytes:
    return data + bytes([PAD]) * ((-len(data)) % UNIT if data else UNIT)


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def spectrum_peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Strongest bin of each band and its power, per frame."""
    x = samples.astype(np.float32)
    x -= 128
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    bins, power = [], []
    for at in range(0, len(frames), BLOCK):
        z = np.fft.rfft(frames[at : at + BLOCK], axis=1)
        p = z.real**2 + z.imag**2
        best = [p[:, a:b].argmax(axis=1) + a for a, b in BANDS]
        bins.append(np.stack(best, axis=1))
        power.append(np.take_along_axis(p, bins[-1], axis=1))
    return np.concatenate(bins), np.concatenate(power)


def fingerprint(payload: bytes) -> np.ndarray:
    """Codes of the peak pairs in order of time."""
    bins, power = spectrum_peaks(np.frombuffer(payload, np.uint8))
    before, after = np.zeros_like(power), np.zeros_like(power)
    before[1:], after[:-1] = power[:-1], power[1:]
    when, band = np.nonzero((power >= before) & (power > after))
    tops = bins[when, band]
    codes = []
    for step in range(1, FAN + 1):
        d = when[step:] - when[:-step]
        near = d <= FAR
        codes.append(((when[:-step] << 32) | (tops[:-step] << 20) | (tops[step:] << 8) | d)[near])
    return np.sort(np.concatenate(codes)).astype(np.int64)


SCHEMA = "doc_id long, n_bytes long, media binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, fingerprint array<long>"


def media_columns(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep_media: bool = True) -> DataFrame:
    """One row per document: the WAV (``media``; null unless kept), what is read back from it, and
    its fingerprint."""

    bounded(docs.sparkSession)
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts_of(batches):
            rows = []
            for data in b.column("data").to_pylist():
                media = to_wav(payload_of(data))
                back = from_wav(media)
                rows.append((len(data), media if keep_media else None, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), fingerprint(back)))
            kinds = [pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), *columns], [x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("data")).mapInArrow(made, SCHEMA)


def op1_media_columns(spark, sf_dir: str) -> DataFrame:
    out = media_columns(table(spark, sf_dir, "documents"), keep_media=False)
    codes = F.array_join(F.transform("fingerprint", lambda c: F.hex(c)), " ")
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", F.sha2(codes.cast("binary"), 256).alias("feature"), F.size("fingerprint").cast("long").alias("n_pairs"), "fingerprint")
