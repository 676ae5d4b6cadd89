"""Media columns: WAV audio, short-time Fourier transforms and spectral-peak fingerprints.

Audio is a binary column of WAV files, read with the standard ``wave`` module. A
fingerprint is made of pairs of spectral peaks: (frequency of one, frequency of
the other, time between them) is packed into an integer, stored beside the time
of the first as an array of (t, hash), so that clips of one recording share
hashes at a constant offset.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RATE = 8000
FRAME, HOP = 512, 256
PEAKS = 5  # strongest local maxima of a frame
#: A peak is paired with the strongest one so many frames later, so that one disturbed frame spoils few pairs.
AFTER = (1, 2, 4, 8, 16)
BLOCK = 2048  # frames that are transformed together
_FLOOR = 1e-4  # of full scale
_WINDOW = np.hanning(FRAME)

# -------- audio


def to_wav(samples: np.ndarray, rate: int = RATE) -> bytes:
    """Mono 16-bit WAV of samples in -1..1."""
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes((np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def _decoded(raw: bytes, width: int, channels: int) -> np.ndarray:
    if width == 1:
        x = np.frombuffer(raw, np.uint8).astype(np.float64) / 128 - 1
    elif width == 3:
        b = np.frombuffer(raw[: len(raw) // 3 * 3], np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8) / float(1 << 23)
    else:
        x = np.frombuffer(raw[: len(raw) // width * width], "<i2" if width == 2 else "<i4") / float(1 << (8 * width - 1))
    return x[: len(x) // channels * channels].reshape(-1, channels).mean(1)


def read_wav(data: bytes) -> tuple[np.ndarray, int]:
    """Samples in -1..1, channels averaged, and the rate. 8, 16, 24 and 32 bits."""
    with wave.open(io.BytesIO(data), "rb") as f:
        return _decoded(f.readframes(f.getnframes()), f.getsampwidth(), f.getnchannels()), f.getframerate()


def sample_blocks(data: bytes) -> tuple[int, Iterator[np.ndarray]]:
    """The rate of a file, and its samples in blocks of BLOCK frames' steps, as :func:`read_wav` has them together."""
    f = wave.open(io.BytesIO(data), "rb")
    width, channels, rate = f.getsampwidth(), f.getnchannels(), f.getframerate()
    if width not in (1, 2, 3, 4) or channels < 1:
        raise wave.Error("unknown samples")

    def blocks() -> Iterator[np.ndarray]:
        with f:
            while raw := f.readframes(BLOCK * HOP):
                yield _decoded(raw, width, channels)

    return rate, blocks()


def stft(x: np.ndarray) -> np.ndarray:
    """Magnitudes, (frames, FRAME / 2 + 1); the last frame is padded with silence."""
    if not len(x):
        return np.zeros((0, FRAME // 2 + 1))
    n = 1 + max(0, -(-(len(x) - FRAME) // HOP))
    padded = np.zeros((n - 1) * HOP + FRAME)
    padded[: len(x)] = x
    frames = np.lib.stride_tricks.sliding_window_view(padded, FRAME)[::HOP]
    return np.abs(np.fft.rfft(frames * _WINDOW, axis=1)) / (FRAME / 4)


def peaks(mags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frame, bin) of the strongest local maxima of each frame, by frame and then bin; of equal ones the lower."""
    if not len(mags):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    mid = np.round(mags[:, 1:-1], 9)
    local = (mid > np.round(mags[:, :-2], 9)) & (mid >= np.round(mags[:, 2:], 9)) & (mid > _FLOOR)
    value = np.where(local, mid, -1.0)
    best = np.argsort(-value, axis=1, kind="stable")[:, :PEAKS]
    found = np.sort(np.where(np.take_along_axis(value, best, 1) > 0, best + 1, 1 << 30), axis=1)
    t, k = np.nonzero(found < 1 << 30)
    return t, found[t, k]


def _block_peaks(blocks: Iterable[np.ndarray]) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Number of samples, (frame, bin) of all peaks, and the bin of each frame's strongest, -1 for none. Each block is transformed for itself."""
    held, total, at = np.zeros(0), 0, 0
    ts, fs, tops = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def take(x: np.ndarray) -> None:
        nonlocal at
        mags = stft(x)
        t, f = peaks(mags)
        top = np.full(len(mags), -1)
        if len(t):
            order = np.lexsort((-f, np.round(mags[t, f], 9), t))  # the last of a frame is its strongest, of equal ones the lower
            ends = np.flatnonzero(np.append(t[order][1:] != t[order][:-1], True))
            top[t[order][ends]] = f[order][ends]
        ts.append(t + at)
        fs.append(f)
        tops.append(top)
        at += len(mags)

    for x in blocks:
        total += len(x)
        held = np.concatenate([held, x])
        whole = (len(held) - FRAME) // HOP  # leave one more frame for the end
        if whole > 0:
            take(held[: (whole - 1) * HOP + FRAME])
            held = held[whole * HOP :]
    if len(held) and not (total > FRAME and len(held) <= FRAME - HOP):
        take(held)
    return total, *(np.concatenate(x) for x in (ts, fs, tops))


def fingerprint(x: np.ndarray | Iterable[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(t, hash) of samples, or of blocks of them: each peak with the strongest of the frames AFTER it. hash = bin, bin, time between: 9, 9 and 6 bits."""
    return _paired(*_block_peaks([x] if isinstance(x, np.ndarray) else x)[1:])


def _paired(t: np.ndarray, f: np.ndarray, top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ts, hs = [], []
    for d in AFTER:
        other = np.append(top, np.full(d, -1))[t + d]
        ok = other >= 0
        ts.append(t[ok])
        hs.append(f[ok] << 15 | other[ok] << 6 | d)
    ts, hs = np.concatenate(ts), np.concatenate(hs)
    order = np.lexsort((hs, ts))
    return ts[order], hs[order]


def _notes(vectors: np.ndarray) -> np.ndarray:
    """One second of sound for each vector: 16 steps of four tones whose pitches are its values."""
    n = len(vectors)
    v = vectors.reshape(n, 16, 4)
    pitch = 250 + 3400 * (0.5 + np.arctan(3 * v) / np.pi)
    t = np.arange(RATE // 16) / RATE
    tone = np.sin(2 * np.pi * pitch[..., None] * t) * np.array([0.3, 0.25, 0.2, 0.15])[:, None]
    return tone.sum(2).reshape(n, 16 * len(t))


# -------- on Spark

_FRAMES = pa.struct([("t", pa.int32()), ("hash", pa.int32())])


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 64):
            part = batch.slice(a, 64)
            out = []
            for x in part.column(1).to_pylist():
                if x is None:
                    out.append(None)
                    continue
                whole = np.array([0.0 if y is None or not np.isfinite(y) else y for y in x])
                whole = np.pad(whole, (0, -len(whole) % 64)).reshape(-1, 64)
                out.append(to_wav(_notes(whole).ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.binary())], names=["media_id", "wav"])


def render(embeddings: DataFrame) -> DataFrame:
    """``embeddings`` (vec_id, embedding) as a media column (media_id, wav): a second of sound for each 64 values.

    A null embedding gives null, an empty one a file without samples; null and
    infinite values count as 0; a last group of fewer than 64 values is filled with 0.
    """
    rows = embeddings.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    return rows.mapInArrow(_render, "media_id long, wav binary")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for data in batch.column(1):
            raw = data.as_py()
            row = (None, None, None, None)
            if raw is not None:
                try:
                    rate, blocks = sample_blocks(raw)
                    total, *found_peaks = _block_peaks(blocks)
                    row = (rate, total, *_paired(*found_peaks))
                except (wave.Error, EOFError, ValueError, ZeroDivisionError):
                    pass  # not a WAV file
            found.append(row)
        none = pa.array([x[2] is None for x in found])
        sizes = [0 if x[2] is None else len(x[2]) for x in found]
        offsets = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
        flat = [np.concatenate([np.zeros(0, np.int64), *(x[k] for x in found if x[k] is not None)]).astype(np.int32) for k in (2, 3)]
        pairs = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(flat[0]), pa.array(flat[1])], fields=list(_FRAMES)), mask=none)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([x[0] for x in found], pa.int32()), pa.array([x[1] for x in found], pa.int64()), pairs], names=["media_id", "rate", "samples", "fingerprint"]
        )


def fingerprints(media: DataFrame) -> DataFrame:
    """(media_id, rate, samples, fingerprint) of a media column (media_id, wav); fingerprint is an array of (t, hash) in order of time.

    A null or unreadable file has null in all three; silence and a file without
    samples have an empty array. A long file is read whole, in blocks, and gives
    the same as at once. Equal rows give equal rows; extra columns are ignored,
    whatever their names; an empty table gives an empty result.
    """
    rows = media.select(F.col("media_id").cast("long"), F.col("wav").cast("binary"))
    return rows.mapInArrow(_fingerprints, "media_id long, rate int, samples long, fingerprint array<struct<t:int,hash:int>>")
