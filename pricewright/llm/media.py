"""Media columns: bytes kept as 8-bit WAV, and spectral-peak fingerprints of them.

``to_wav`` and ``read_wav`` go through the standard ``wave`` module. A clip's fingerprint is the array of pairs of
spectral peaks of its short-time Fourier transform: each peak with the next peaks after it, as
``time << 32 | f1 << 20 | f2 << 8 | distance``, in order of time.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import table

UNIT, FILL, RATE = 576, 255, 8000
FRAME, HOP = 576, 288
#: Edges of the frequency bands, in bins of the transform; each frame has one peak a band at most.
BANDS = (1, 12, 24, 48, 96, 160, 288)
#: A peak is paired with this many next peaks, at most so many frames on.
FAN_OUT, REACH = 3, 32
FRAMES_AT_ONCE = 2048
WINDOW = np.hanning(FRAME).astype(np.float32)


def payload_of(text: str | None) -> bytes:
    """The text as UTF-8, filled up with bytes 255 to a positive multiple of 576."""
    raw = (text or "").encode()
    return raw + bytes([FILL]) * (max(1, -(-len(raw) // UNIT)) * UNIT - len(raw))


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def read_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("only 8-bit mono is read")
        return w.readframes(w.getnframes())


def spectral_peaks(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(frame, bin) of the peaks in order of time: each band's largest magnitude, where it is over the frame's mean band peak.

    All frames count; they are transformed some at a time, so memory doesn't grow with the clip.
    """
    x = np.frombuffer(samples, np.uint8)
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP] if len(x) >= FRAME else np.zeros((0, FRAME), np.uint8)
    times, bins = [], []
    for a in range(0, len(frames), FRAMES_AT_ONCE):
        spectrum = np.abs(np.fft.rfft((frames[a : a + FRAMES_AT_ONCE].astype(np.float32) - np.float32(128)) * WINDOW, axis=1))
        tops = np.stack([spectrum[:, lo:hi].argmax(axis=1) + lo for lo, hi in zip(BANDS, BANDS[1:], strict=False)], axis=1)
        values = np.take_along_axis(spectrum, tops, axis=1)
        t, band = np.nonzero(values >= values.mean(axis=1, keepdims=True))
        times.append(t + a)
        bins.append(tops[t, band])
    return (np.concatenate(times), np.concatenate(bins)) if times else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def fingerprints(samples: bytes) -> np.ndarray:
    """Time-coded peak pairs, ascending."""
    t, f = spectral_peaks(samples)
    found = []
    for k in range(1, FAN_OUT + 1):
        dt = t[k:] - t[:-k]
        ok = dt <= REACH
        found.append(t[:-k][ok] << 32 | f[:-k][ok] << 20 | f[k:][ok] << 8 | dt[ok])
    return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)


def feature_of(codes: np.ndarray) -> str:
    """A short name of a whole fingerprint: its number of pairs and a digest of them."""
    return f"{len(codes)}:{hashlib.blake2b(codes.astype('<i8').tobytes(), digest_size=12).hexdigest()}"


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, fingerprint array<long>"


def media_table(docs: DataFrame, keep_media: bool = False) -> DataFrame:
    """Stores each whole text (null: empty) as a WAV clip, reads it back and describes what was read.

    Needs ``doc_id`` and ``text``; other columns are left aside. ``keep_media`` adds the clip as column ``media``.
    Repeated rows and null ids stay; equal texts give equal values. No shuffle; a task holds a few clips at a time.
    """

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                rows = []
                part = batch.slice(a, 64)
                for text in part.column("text").to_pylist():
                    media = to_wav(payload_of(text))
                    payload = read_wav(media)
                    codes = fingerprints(payload)
                    n = len((text or "").encode())
                    rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(codes), codes, media))
                cols = list(zip(*rows, strict=True))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(c) for c in cols[7]])]), pa.int32()), pa.array(np.concatenate(cols[7]), pa.int64()))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                arrays = [part.column("doc_id").cast(pa.int64()), *(pa.array(c, k) for c, k in zip(cols[:7], kinds, strict=True)), lists]
                names = [c.split()[0] for c in SCHEMA.split(", ")]
                if keep_media:
                    arrays, names = [*arrays, pa.array(cols[8], pa.binary())], [*names, "media"]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA + ", media binary" * keep_media)


def op7_media(spark, sf_dir: str) -> DataFrame:
    return media_table(table(spark, sf_dir, "documents"))
