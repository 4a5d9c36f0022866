"""Streams of sample chunks: framing that continues over chunk borders, and windows over late events."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "frame long, next_chunk long, tail array<double>, waiting_seq array<long>, waiting array<array<double>>"


def frame_levels(chunks: DataFrame, fft: int, hop: int, idle_ms: int | None = None) -> DataFrame:
    """(rec_id, seq, samples array<double>) stream -> rec_id, frame, rms of each Hann-windowed frame.

    Chunks of a recording are numbered from 0 and may come late or twice. The state of a
    recording is the samples that the next frame needs, and chunks that came too early.
    idle_ms: a recording without a chunk for so long has ended. What still waits behind a
    lost chunk is framed then, each run of chunks by itself, with frame numbers that go on;
    the state goes, and a later chunk opens a recording anew.
    """
    window = np.hanning(fft) if fft > 1 else np.ones(1)

    def framed(x: np.ndarray, frame: int, key: tuple) -> tuple[np.ndarray, int, list[tuple]]:
        out = []
        while len(x) >= fft:
            out.append((key[0], frame, float(np.sqrt(np.mean((x[:fft] * window) ** 2)))))
            x, frame = x[hop:], frame + 1
        return x, frame, out

    def ended(key: tuple, frame: int, waiting: dict[int, list[float]]) -> list[tuple]:
        out, x, before = [], np.zeros(0), None
        for seq in sorted(waiting):
            if before is None or seq != before + 1:
                x = np.zeros(0)  # a frame doesn't reach over a gap
            x, frame, found = framed(np.concatenate((x, waiting[seq])), frame, key)
            out, before = out + found, seq
        return out

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        frame, after, tail, seqs, held = state.get if state.exists else (0, 0, [], [], [])
        waiting = dict(zip(seqs, held))
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame(ended(key, frame, waiting), columns=["rec_id", "frame", "rms"])
            return
        for part in parts:
            for seq, samples in zip(part["seq"], part["samples"]):
                if seq >= after:
                    waiting.setdefault(int(seq), [float(x) for x in samples])
        ready = [np.asarray(tail, float)]
        while after in waiting:
            ready.append(np.asarray(waiting.pop(after), float))
            after += 1
        x, frame, out = framed(np.concatenate(ready), frame, key)
        state.update((frame, after, x.tolist(), list(waiting), list(waiting.values())))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["rec_id", "frame", "rms"])

    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return chunks.groupBy("rec_id").applyInPandasWithState(run, "rec_id long, frame long, rms double", STATE, "append", timeout)


def event_windows(events: DataFrame, width: str = "10 minutes", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """(ts, event_type, value) stream -> counts and means per window and type; events later than `late` are left out."""
    timed = events.withWatermark("ts", late)
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return timed.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select("w.start", "w.end", "event_type", "n", "mean")


def activity_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(ts, user_id) stream -> each user's runs of events without a silence of `gap`."""
    timed = events.withWatermark("ts", late)
    return timed.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", "w.start", "w.end", "n")
