"""Media columns: payloads stored as WAV bytes, and spectral-peak pair fingerprints of what is read back.

The payload is one 8-bit mono track, written and read by the standard ``wave`` module. Its short-time Fourier transform
gives magnitudes; a peak is the strongest of its frequency band within a window of frames; each peak is paired with the
peaks that follow it shortly, and a pair is coded as (frequency, frequency, frames between) at the time of the first.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scribelake.llm.common import add_columns, utf8


@dataclass(frozen=True)
class Spectrum:
    """Frames of ``window`` samples every ``hop``; one peak at most in each of ``bands`` bands of ``span`` frames; pairs
    with peaks at most ``reach`` spans later."""

    rate: int = 8000
    window: int = 256
    hop: int = 128
    bands: int = 4
    span: int = 8
    reach: int = 3
    block: int = 1024  # spans that are transformed at once, which bounds memory whatever the track's length


def payload(text: bytes, multiple: int = 192) -> bytes:
    """With spaces up to a positive multiple."""
    return text + b" " * (max(1, -(-len(text) // multiple)) * multiple - len(text))


def store(data: bytes, rate: int = Spectrum.rate) -> bytes:
    """As a mono WAV of 8-bit samples, one byte each, without loss."""
    out = io.BytesIO()
    with wave.open(out, "wb") as track:
        track.setnchannels(1)
        track.setsampwidth(1)
        track.setframerate(rate)
        track.writeframes(data)
    return out.getvalue()


def read(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as track:
        return track.readframes(track.getnframes())


def peaks(samples: bytes, s: Spectrum = Spectrum()) -> tuple[np.ndarray, np.ndarray]:
    """(frame, bin) of each peak, by span and band. Blocks are whole spans, so they don't change the result."""
    sound = np.frombuffer(samples, np.uint8).astype(np.float32) - 128.0
    frames = max(0, -(-(len(sound) - s.window) // s.hop)) + 1  # the last one is filled up with silence
    sound = np.concatenate([sound, np.zeros(s.window + (frames - 1) * s.hop - len(sound), np.float32)])
    views = np.lib.stride_tricks.sliding_window_view(sound, s.window)[:: s.hop][:frames]
    shape = np.hanning(s.window).astype(np.float32)
    width = s.window // 2 // s.bands
    at, bins = [], []
    for start in range(0, frames, s.span * s.block):
        power = np.abs(np.fft.rfft(views[start : start + s.span * s.block] * shape, axis=1))[:, 1 : 1 + width * s.bands]  # without the constant part
        n = len(power)
        spans = -(-n // s.span)
        full = np.full((spans * s.span, power.shape[1]), -1.0, np.float32)
        full[:n] = power
        best = full.reshape(spans, s.span, s.bands, width).transpose(0, 2, 1, 3).reshape(spans, s.bands, s.span * width).argmax(axis=2)
        at.append(start + np.arange(spans)[:, None] * s.span + best // width)
        bins.append(1 + np.arange(s.bands)[None, :] * width + best % width)
    return np.concatenate(at).astype(np.int64), np.concatenate(bins).astype(np.int64)


def landmarks(samples: bytes, s: Spectrum = Spectrum()) -> tuple[np.ndarray, np.ndarray]:
    """Time-coded pairs: (frame of the first peak, code), by frame and code.

    A code is first bin << 20 | second bin << 8 | frames between. A track with one span still pairs its bands.
    """
    at, bins = peaks(samples, s)
    times, codes = [], []
    for later in range(s.reach + 1):
        for a in range(s.bands):
            for b in range(s.bands):
                if later == 0 and a >= b or later >= len(at):
                    continue
                t0, t1, f0, f1 = at[: len(at) - later, a], at[later:, b], bins[: len(at) - later, a], bins[later:, b]
                swap = t1 < t0  # within one span the later band can peak first
                t0, t1, f0, f1 = np.where(swap, t1, t0), np.where(swap, t0, t1), np.where(swap, f1, f0), np.where(swap, f0, f1)
                times.append(t0)
                codes.append(f0 << 20 | f1 << 8 | (t1 - t0))
    times, codes = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((codes, times))
    return times[order], codes[order]


MEDIA = T.StructType([T.StructField("media", T.BinaryType()), T.StructField("landmark_times", T.ArrayType(T.IntegerType())), T.StructField("landmark_codes", T.ArrayType(T.IntegerType()))])
DIGESTS = T.StructType([T.StructField(n, k) for n, k in (("n_bytes", T.LongType()), ("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType()), ("n_landmarks", T.LongType()))])


def media_columns(docs: DataFrame, *, text_col: str = "text", spectrum: Spectrum = Spectrum(), multiple: int = 192) -> DataFrame:
    """``docs`` with ``media`` (the WAV) and its landmarks as two arrays, times and codes. A null text is empty: one
    payload of spaces; a very long one is stored whole, in memory in proportion to it. Rows are on their own; columns that have
    these names already are replaced."""

    def make(cols: dict[str, pa.Array]) -> list[pa.Array]:
        media = [store(payload(t, multiple), spectrum.rate) for t in utf8(cols[text_col])]
        pairs = [landmarks(read(m), spectrum) for m in media]
        return [pa.array(media, pa.binary()), *(pa.array([p[i].astype(np.int32) for p in pairs], pa.list_(pa.int32())) for i in (0, 1))]

    return add_columns(docs, MEDIA, make, [text_col])


def media_digests(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", spectrum: Spectrum = Spectrum(), multiple: int = 192) -> DataFrame:
    """One row per row of ``docs``: id, sizes and digests of payload, stored form and landmarks (``feature`` is the
    SHA-256 of the times and codes as little-endian 32-bit integers). The payload's digests are of what is read back.

    Media stay in the worker. Null, empty, very long and repeated texts and ids: as ``media_columns``. An empty table gives an
    empty result; extra columns are ignored.
    """

    def make(cols: dict[str, pa.Array]) -> list[pa.Array]:
        rows = []
        for text in utf8(cols["text"]):
            media = store(payload(text, multiple), spectrum.rate)
            back = read(media)
            times, codes = landmarks(back, spectrum)
            feature = hashlib.sha256(times.astype("<i4").tobytes() + codes.astype("<i4").tobytes()).hexdigest()
            rows.append((len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature, len(times)))
        return [pa.array(list(c), pa.string() if isinstance(f.dataType, T.StringType) else pa.int64()) for c, f in zip(zip(*rows, strict=True), DIGESTS, strict=True)] if rows else [pa.array([], pa.string() if isinstance(f.dataType, T.StringType) else pa.int64()) for f in DIGESTS]

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return add_columns(rows, DIGESTS, make, ["text"]).withColumnRenamed("id", id_col).select(id_col, *DIGESTS.names)
