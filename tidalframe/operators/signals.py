"""Signals in long form - rec_id, idx (from 0), v - to frames, spectra and features.

A recording is never gathered in one row or task: frames, bins and bands are rows, and
sums over them are grouped aggregates that Spark combines before it shuffles. For real
audio sizes `features.extract` does the same per block of frames with numpy's FFT.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidalframe.functions.signal import finite, hann, hz_to_mel, mel_to_hz, or_zero, soft_limit
from tidalframe.sources.work import written


def lengths(signal: DataFrame) -> DataFrame:
    return signal.groupBy("rec_id").agg(F.count("*").alias("n"))


def frame_count(n: Column, fft: int, hop: int, at_least_one: bool = False) -> Column:
    """Whole frames in n samples; the tail is dropped. at_least_one: a short signal has one (zero-padded) frame."""
    return F.greatest(F.lit(int(at_least_one)), F.floor((n - fft) / hop) + 1).cast("long")


def frames(signal: DataFrame, fft: int, hop: int, at_least_one: bool = False) -> DataFrame:
    """-> rec_id, frame, k (place in the frame), v. Frames overlap when hop < fft; missing rows of a padded frame are zeros."""
    counted = signal.join(lengths(signal), "rec_id")
    first = F.greatest(F.lit(0), F.ceil((F.col("idx") - fft + 1) / hop)).cast("long")
    last = F.least(F.floor(F.col("idx") / hop), frame_count(F.col("n"), fft, hop, at_least_one) - 1)
    dealt = counted.where(first <= last).select("rec_id", "idx", "v", F.explode(F.sequence(first, last)).alias("frame"))
    return dealt.select("rec_id", "frame", (F.col("idx") - F.col("frame") * hop).cast("int").alias("k"), "v")


def windowed(framed: DataFrame, fft: int) -> DataFrame:
    return framed.withColumn("v", F.col("v") * hann(F.col("k"), fft))


def frame_rms(framed: DataFrame, fft: int) -> DataFrame:
    """Root mean square of each Hann-windowed frame."""
    return windowed(framed, fft).groupBy("rec_id", "frame").agg(F.sqrt(F.sum(F.col("v") * F.col("v")) / fft).alias("rms"))


def frame_zcr(framed: DataFrame, fft: int) -> DataFrame:
    """Sign changes within the windowed frame (0 counts as positive) over its length."""
    # a frame has fft samples: its signs fit one small array, so no sort of whole recordings is needed
    signs = windowed(framed, fft).groupBy("rec_id", "frame").agg(F.array_sort(F.collect_list(F.struct("k", (F.col("v") >= 0).alias("up")))).alias("s"))
    changes = F.expr("size(filter(sequence(1, size(s) - 1), i -> s[i].up <> s[i - 1].up))")
    return signs.select("rec_id", "frame", F.when(F.size("s") > 1, changes / F.lit(fft)).otherwise(0.0).alias("zcr"))


def spectrum(framed: DataFrame, fft: int, at_once: int = 16) -> DataFrame:
    """Magnitudes of bins 0..fft/2 of each windowed frame, by the transform's definition.

    For short frames; a sample meets `at_once` bins in one row, whose sums are columns, so a
    frame is one group for that many bins.
    """
    bins = fft // 2 + 1
    width = min(bins, at_once)
    dealt = windowed(framed, fft).withColumn("first", F.explode(F.sequence(F.lit(0), F.lit(bins - 1), F.lit(width))))
    angle = lambda j: (F.col("k") * (F.col("first") + j) % fft) * (2 * math.pi / fft)
    sums = [F.sum(F.col("v") * f(angle(j))).alias(f"{n}{j}") for j in range(width) for n, f in (("re", F.cos), ("im", F.sin))]
    mags = F.array(*[F.sqrt(F.col(f"re{j}") * F.col(f"re{j}") + F.col(f"im{j}") * F.col(f"im{j}")) for j in range(width)])
    rows = dealt.groupBy("rec_id", "frame", "first").agg(*sums).select("rec_id", "frame", "first", F.posexplode(mags).alias("j", "mag"))
    return rows.select("rec_id", "frame", (F.col("first") + F.col("j")).alias("bin"), or_zero(F.col("mag")).alias("mag")).where(F.col("bin") < bins)


def mel_filters_by_rate(rates: DataFrame, n_mels: int, fft: int, fmin: float = 0.0, fmax: float | None = None) -> DataFrame:
    """Triangular filters on mel-equispaced points for each row of rates (sample_rate): sample_rate, mel, bin,
    weight > 0. n_mels * (fft/2 + 1) rows a rate at most; fmax None: half the rate. A null rate has none."""
    rate = F.col("sample_rate").cast("double")
    low, high = hz_to_mel(F.lit(fmin)), hz_to_mel(rate / 2 if fmax is None else F.lit(fmax))
    point = lambda i: mel_to_hz(low + i / (n_mels + 1) * (high - low))
    every = lambda last: F.explode(F.sequence(F.lit(0), F.lit(last)))
    table = rates.select("sample_rate", every(n_mels - 1).alias("mel")).select("*", every(fft // 2).alias("bin"))
    lower, centre, upper = point(F.col("mel")), point(F.col("mel") + 1), point(F.col("mel") + 2)
    f = F.col("bin") * (rate / fft)
    width = lambda x: F.when(x == 0, 1e-9).otherwise(x)
    weight = F.when((f >= lower) & (f <= centre), (f - lower) / width(centre - lower)).when((f >= centre) & (f <= upper), (upper - f) / width(upper - centre)).otherwise(0.0)
    return table.select("sample_rate", "mel", "bin", weight.alias("weight")).where("weight > 0")


def mel_filters(spark: SparkSession, n_mels: int, fft: int, sample_rate: float, fmin: float = 0.0, fmax: float | None = None) -> DataFrame:
    """The filters of one rate: mel, bin, weight > 0."""
    rate = spark.range(1).select(F.lit(float(sample_rate)).alias("sample_rate"))
    return mel_filters_by_rate(rate, n_mels, fft, fmin, fmax or None).drop("sample_rate")


def mel_energies(spectra: DataFrame, filters: DataFrame) -> DataFrame:
    """Filters times magnitudes. The filter table has a fixed size, so it is broadcast."""
    return spectra.join(F.broadcast(filters), "bin").groupBy("rec_id", "frame", "mel").agg(F.sum(F.col("mag") * F.col("weight")).alias("energy"))


def spectral_centroid(spectra: DataFrame, fft: int, sample_rate: float) -> DataFrame:
    """Magnitude-weighted mean frequency of each frame, 0 without magnitude."""
    mass = F.sum("mag")
    return spectra.groupBy("rec_id", "frame").agg(F.when(mass > 0, F.sum(F.col("bin") * (sample_rate / fft) * F.col("mag")) / mass).otherwise(0.0).alias("centroid"))


def features(signal: DataFrame, fft: int, hop: int, n_mels: int, sample_rate: float) -> DataFrame:
    """-> rec_id, frame, time_sec, mel (array of n_mels), rms, centroid, zcr of every frame."""
    framed = frames(signal, fft, hop)
    spectra = spectrum(framed, fft)
    mel = mel_energies(spectra, mel_filters(signal.sparkSession, n_mels, fft, sample_rate))
    by_band = mel.groupBy("rec_id", "frame").agg(F.map_from_entries(F.collect_list(F.struct("mel", "energy"))).alias("m"))
    vector = F.transform(F.sequence(F.lit(0), F.lit(n_mels - 1)), lambda i: F.coalesce(F.try_element_at(F.col("m"), i), F.lit(0.0)))
    keys = ["rec_id", "frame"]
    joined = spectral_centroid(spectra, fft, sample_rate).join(frame_rms(framed, fft), keys).join(frame_zcr(framed, fft), keys).join(by_band, keys, "left")
    return joined.select(*keys, (F.col("frame") * (hop / sample_rate)).alias("time_sec"), F.coalesce(vector, F.array_repeat(F.lit(0.0), n_mels)).alias("mel"), "rms", "centroid", "zcr")


def scaled(cells: DataFrame, value: str, dynamic_range: float = 80.0, log: bool = True) -> DataFrame:
    """A value of each recording's cells in [0, 1], as column `scaled`.

    log: decibels against the recording's maximum, floor at the dynamic range; else min-max.
    """
    cells = written(cells, "cells")  # read three times, computed once
    top = cells.groupBy("rec_id").agg(F.max(F.greatest(F.col(value), F.lit(0.0))).alias("peak"))
    level = cells.join(top, "rec_id")
    if log:
        ref = F.when(F.col("peak") > 0, F.col("peak")).otherwise(1.0)
        level = level.withColumn("level", 20 * F.log10(F.greatest(F.col(value), F.lit(1e-10)) / ref))
    else:
        level = level.withColumn("level", F.col(value))
    fine = F.when(finite(F.col("level")), F.col("level"))
    span = level.groupBy("rec_id").agg(F.min(fine).alias("lo"), F.max(fine).alias("hi"))
    both = level.join(span, "rec_id")
    bottom = F.greatest(F.col("hi") - dynamic_range, F.col("lo")) if log else F.col("lo")
    width = F.col("hi") - bottom
    x = (F.col("level") - bottom) / F.when(width == 0, 1e-6).otherwise(width)
    return both.select(*cells.columns, F.when(F.col("lo").isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), or_zero(x)))).alias("scaled"))


def raster(cells: DataFrame, width: int | None = None, height: int | None = None, lerp: bool = True) -> DataFrame:
    """rec_id, frame, mel, value -> rec_id, x, y, value of an image.

    By default 200..1200 wide by frames, 100..512 high by bands. Along x neighbouring
    frames are blended (lerp) or the frame at or before is taken; along y the nearest band below.
    """
    shape = cells.groupBy("rec_id").agg((F.max("frame") + 1).alias("frames"), (F.max("mel") + 1).alias("mels"))
    clip = lambda x, a, b: F.greatest(F.lit(a), F.least(F.lit(b), x))
    w = F.lit(width) if width else clip(F.col("frames"), 200, 1200)
    h = F.lit(height) if height else clip(F.col("mels"), 100, 512)
    shape = shape.select("*", w.cast("int").alias("w"), h.cast("int").alias("h"))
    columns = shape.withColumn("x", F.explode(F.expr("sequence(0, w - 1)")))
    if lerp:
        fx = F.when(F.col("w") > 1, F.col("x") * (F.col("frames") - 1) / (F.col("w") - 1)).otherwise(0.0)
    else:
        fx = F.floor(F.col("x") * F.col("frames") / F.col("w")).cast("double")
    columns = columns.withColumn("frame", F.floor(fx)).withColumn("part", fx - F.floor(fx)).withColumn("next", F.least(F.col("frames") - 1, F.col("frame") + 1))
    grid = columns.withColumn("y", F.explode(F.expr("sequence(0, h - 1)"))).withColumn("mel", F.floor((1 - F.col("y") / F.col("h")) * (F.col("mels") - 1)).cast("int"))
    here = cells.select("rec_id", F.col("frame").cast("long").alias("frame"), "mel", F.col("value").alias("a"))
    there = cells.select("rec_id", F.col("frame").cast("long").alias("next"), "mel", F.col("value").alias("b"))
    joined = grid.join(here, ["rec_id", "frame", "mel"], "left").join(there, ["rec_id", "next", "mel"], "left")
    a, b = F.coalesce("a", F.lit(0.0)), F.coalesce("b", F.lit(0.0))
    return joined.select("rec_id", "x", "y", (a + (b - a) * F.col("part") if lerp else a).alias("value"))


def waveform(signal: DataFrame, width: int) -> DataFrame:
    """Minimum and maximum of each of `width` buckets of samples; never above 1 or below -1 respectively."""
    n = F.col("n")
    step = F.greatest(F.lit(1), F.floor(n / width)).cast("long")
    bucket = F.floor(F.col("idx") / step).cast("int")
    rows = signal.join(lengths(signal), "rec_id").withColumn("bucket", bucket).where(F.col("bucket") < width)
    return rows.groupBy("rec_id", "bucket").agg(F.least(F.min("v"), F.lit(1.0)).alias("low"), F.greatest(F.max("v"), F.lit(-1.0)).alias("high"))


def gain(signal: DataFrame, target: float = 0.08, max_gain: float = 8.0) -> DataFrame:
    """rec_id, gain: what brings the recording's RMS to the target, at most max_gain; 1 where that is no positive number."""
    rms = F.sqrt(F.avg(F.col("v") * F.col("v")))
    g = target / (rms + 1e-8)
    return signal.groupBy("rec_id").agg(F.least(F.lit(max_gain), F.when(finite(g) & (g > 0), g).otherwise(1.0)).alias("gain"))


def agc(signal: DataFrame, target: float = 0.08, max_gain: float = 8.0, limiter: float = 0.99) -> DataFrame:
    """Gain per recording, then the soft limiter."""
    return signal.join(gain(signal, target, max_gain), "rec_id").select("rec_id", "idx", soft_limit(F.col("v") * F.col("gain"), limiter).alias("v"))


def fade_in(signal: DataFrame, sample_rate: float, ms: float = 20.0) -> DataFrame:
    """Linear from 0 over floor(ms/1000 * sample_rate) samples."""
    n = math.floor(ms / 1000 * sample_rate)
    return signal.withColumn("v", F.when(F.col("idx") < n, F.col("v") * F.col("idx") / max(1, n)).otherwise(F.col("v")))


def chunk_rms(signal: DataFrame, chunk: int) -> DataFrame:
    """RMS of consecutive chunks; the last may be shorter."""
    return signal.groupBy("rec_id", F.floor(F.col("idx") / chunk).alias("chunk")).agg(F.sqrt(F.sum(F.col("v") * F.col("v")) / F.count("*")).alias("rms"))
