"""Features of real audio sizes in one Arrow pass: frames, FFT, bands, loudness, crossings.

Samples are dealt by (recording, block of frames), each block with the overlap that its
last frame needs, so a long recording spreads over tasks and a group is bounded.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def filterbank(n_mels: int, fft: int, sample_rate: float, fmin: float = 0.0, fmax: float | None = None) -> np.ndarray:
    """(fft/2 + 1) x n_mels triangular weights on mel-equispaced points, not normalised by area."""
    mel, hz = lambda f: 2595 * np.log10(1 + f / 700), lambda m: 700 * (10 ** (m / 2595) - 1)
    low, high = mel(fmin), mel(fmax or sample_rate / 2)
    points = hz(low + np.arange(n_mels + 2) / (n_mels + 1) * (high - low))
    f = np.arange(fft // 2 + 1)[:, None] * (sample_rate / fft)
    lower, centre, upper = points[:-2], points[1:-1], points[2:]
    width = lambda x: np.where(x == 0, 1e-9, x)
    rising, falling = (f - lower) / width(centre - lower), (upper - f) / width(upper - centre)
    return np.where((f >= lower) & (f <= centre), rising, np.where((f >= centre) & (f <= upper), falling, 0.0))


def of_frames(framed: np.ndarray, fft: int, sample_rate: float, bank: np.ndarray) -> tuple[np.ndarray, ...]:
    """frames x fft samples -> mel energies, rms, centroid, zcr of each Hann-windowed frame."""
    x = framed * (np.hanning(fft) if fft > 1 else 1.0)
    mag = np.abs(np.fft.rfft(x, axis=1))
    mag = np.where(np.isfinite(mag), mag, 0.0)
    mass = mag.sum(axis=1)
    moment = mag @ (np.arange(fft // 2 + 1) * (sample_rate / fft))
    centroid = np.divide(moment, mass, out=np.zeros(len(x)), where=mass > 0)
    up = x >= 0
    return mag @ bank, np.sqrt((x * x).mean(axis=1)), centroid, (up[:, 1:] != up[:, :-1]).sum(axis=1) / fft


def extract(signal: DataFrame, fft: int = 2048, hop: int = 512, n_mels: int = 64, sample_rate: float = 44_100.0, block: int = 256) -> DataFrame:
    """(rec_id, idx gapless from 0, v) -> rec_id, frame, time_sec, mel, rms, centroid, zcr of every whole frame.

    fft is a power of two. A recording shorter than a frame has none. A null or non-finite
    sample makes the values of its frames that depend on it zero or NaN, as sums do.
    """
    if fft & (fft - 1) or fft < 1:
        raise ValueError(f"fft must be a power of two, got {fft}")
    step, bank = block * hop, filterbank(n_mels, fft, sample_rate)
    first = F.greatest(F.lit(0), F.ceil((F.col("idx") - (step - hop + fft) + 1) / step)).cast("long")
    last = F.floor(F.col("idx") / step).cast("long")
    # where hop is longer than a frame, samples between frames belong to none
    dealt = signal.where(first <= last).select("rec_id", "idx", F.col("v").cast("double").alias("v"), F.explode(F.sequence(first, last)).alias("block"))

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rec, b = key
        order = np.argsort(table.column("idx").to_numpy(), kind="stable")
        v = table.column("v").to_numpy()[order]
        frames = min(block, (v.size - fft) // hop + 1) if v.size >= fft else 0
        out = [np.empty((0, n_mels)), *[np.empty(0)] * 3]
        if frames > 0:
            framed = np.lib.stride_tricks.sliding_window_view(v, fft)[::hop][:frames]
            out = of_frames(framed, fft, sample_rate, bank)
        at = b.as_py() * block + np.arange(max(0, frames))
        mel = pa.ListArray.from_arrays(pa.array(np.arange(at.size + 1) * n_mels, pa.int32()), pa.array(out[0].ravel()))
        columns = [pa.array([rec.as_py()] * at.size, rec.type), pa.array(at, pa.int64()), pa.array(at * (hop / sample_rate)), mel, *map(pa.array, out[1:])]
        return pa.Table.from_arrays(columns, ["rec_id", "frame", "time_sec", "mel", "rms", "centroid", "zcr"])

    kind = signal.schema["rec_id"].dataType.simpleString()
    return dealt.groupBy("rec_id", "block").applyInArrow(run, f"rec_id {kind}, frame long, time_sec double, mel array<double>, rms double, centroid double, zcr double")
