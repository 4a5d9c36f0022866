"""WAV files as a source and a sink: 16-bit PCM, one Arrow batch at a time in the tasks."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def pcm_bytes(samples: np.ndarray) -> bytes:
    """Clamped to [-1, 1], scaled by 32768 below zero and 32767 above, truncated; NaN counts as 0."""
    x = np.clip(np.nan_to_num(np.asarray(samples, float), nan=0.0), -1, 1)
    return np.trunc(np.where(x < 0, x * 32768, x * 32767)).astype("<i2").tobytes()


def wav_bytes(samples: np.ndarray, sample_rate: int) -> bytes:
    """A mono file: a header of 44 bytes and the samples."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(sample_rate)
        w.writeframes(pcm_bytes(samples))
    return out.getvalue()


def encoded(signals: DataFrame) -> DataFrame:
    """(rec_id, sample_rate int, samples array<double>) -> rec_id, wav binary; null samples make an empty file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rates, samples = batch.column("sample_rate").to_pylist(), batch.column("samples").to_pylist()
            files = [wav_bytes(np.array(s or [], float), r) for s, r in zip(samples, rates)]
            yield pa.RecordBatch.from_arrays([batch.column("rec_id"), pa.array(files, pa.binary())], ["rec_id", "wav"])

    rows = signals.select(F.col("rec_id").cast("long"), "sample_rate", F.expr("transform(samples, x -> cast(x as double))").alias("samples"))
    return rows.mapInArrow(run, "rec_id long, wav binary")


DECODED = "sample_rate int, samples array<float>, problem string"


def decoded(files: DataFrame, content: str = "content") -> DataFrame:
    """files with sample_rate, samples (the first channel, in [-1, 1)) and problem: why a file can't be read, else null."""
    names = [c for c in files.columns if c != content]

    def read(raw: bytes | None) -> tuple[int | None, list[float] | None, str | None]:
        try:
            with wave.open(io.BytesIO(raw or b"")) as w:
                if w.getsampwidth() != 2:
                    return None, None, f"{8 * w.getsampwidth()} bits a sample"
                frames = np.frombuffer(w.readframes(w.getnframes()), "<i2")
                return w.getframerate(), (frames[:: w.getnchannels()] / 32768).tolist(), None
        except (wave.Error, EOFError) as error:
            return None, None, str(error) or "not a WAV file"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(zip(*map(read, batch.column(content).to_pylist()))) or [(), (), ()]
            kinds = (pa.int32(), pa.list_(pa.float32()), pa.string())
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], *[pa.array(c, k) for c, k in zip(found, kinds)]], [*names, "sample_rate", "samples", "problem"])

    schema = ", ".join([*[f"`{n}` {files.schema[n].dataType.simpleString()}" for n in names], DECODED])
    return files.mapInArrow(run, schema)


def read(spark: SparkSession, path: str) -> DataFrame:
    """WAV files under path -> path, sample_rate, samples, problem."""
    return decoded(spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path).select("path", "content"))
