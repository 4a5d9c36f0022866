"""Feature vectors for training and serving: scaling, context, z-scores.

A feature row has mel (array), rms, centroid, zcr; a vector is mel + [rms, centroid, zcr].
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidalframe.functions.signal import clamp, or_zero
from tidalframe.operators.ranges import with_neighbours


def vector() -> Column:
    return F.concat("mel", F.array("rms", "centroid", "zcr"))


def mel_sum(mel: Column) -> Column:
    """Sum of a row's positive, finite bands."""
    return F.aggregate(mel, F.lit(0.0), lambda a, x: a + F.greatest(or_zero(x), F.lit(0.0)))


def log_mel(mel: Column) -> Column:
    """log1p of each band, negative and non-finite ones as 0."""
    return F.transform(mel, lambda x: F.log1p(F.greatest(or_zero(x), F.lit(0.0))))


def training_vector(mel: Column, rms: Column, centroid: Column, zcr: Column, peak_rms: Column, sample_rate: float, limit: float = 1000.0) -> Column:
    """Log bands, rms over the recording's largest, centroid over Nyquist, zcr; all clamped."""
    rest = F.array(or_zero(rms) / F.greatest(peak_rms, F.lit(1e-12)), or_zero(centroid) / max(1e-6, sample_rate / 2), or_zero(zcr))
    return F.transform(F.concat(log_mel(mel), rest), lambda x: clamp(x, limit))


def serving_vector(mel: Column, rms: Column, centroid: Column, zcr: Column, sample_rate: float, peak_rms: Column | None = None) -> Column:
    """What a model is applied to. With peak_rms it equals the training vector; without it rms
    stays as it is, as models trained elsewhere may expect."""
    loud = or_zero(rms) if peak_rms is None else or_zero(rms) / F.greatest(peak_rms, F.lit(1e-12))
    return F.concat(log_mel(mel), F.array(loud, or_zero(centroid) / max(1e-6, sample_rate / 2), or_zero(zcr)))


def diagnostic_vector(mel: Column, rms: Column, centroid: Column, zcr: Column, sample_rate: float) -> Column:
    """serving_vector() with every negative value as 0."""
    return F.transform(serving_vector(mel, rms, centroid, zcr, sample_rate), lambda x: F.greatest(x, F.lit(0.0)))


def mel_index_centroid(mel: Column) -> Column:
    """Mean band index weighted by positive bands; half the number of bands if there are none."""
    positive = F.transform(mel, lambda x: F.greatest(or_zero(x), F.lit(0.0)))
    mass = F.aggregate(positive, F.lit(0.0), lambda a, x: a + x)
    moment = F.aggregate(F.transform(positive, lambda x, i: x * i), F.lit(0.0), lambda a, x: a + x)
    return F.when(mass > 0, moment / mass).otherwise(F.size(mel) / 2)


def context_stack(rows: DataFrame, vec: str, c: int, block: int = 4096) -> DataFrame:
    """Replace vec by the vectors of frames t-c..t+c side by side, zeros beyond the ends. Normalise first, then stack."""
    zeros = F.transform(F.col(vec), lambda x: x * 0)
    at = lambda d, w: F.col(vec) if d == 0 else F.coalesce(F.lag(vec, -d).over(w) if d < 0 else F.lead(vec, d).over(w), zeros)
    return with_neighbours(rows, ["rec_id"], ["frame"], c, {vec: lambda w: F.concat(*[at(d, w) for d in range(-c, c + 1)])}, block)


def dimension_stats(rows: DataFrame, vec: str) -> DataFrame:
    """dim, n, mean, var (sample), var_pop, low, high of each place of vec; non-finite cells count as 0."""
    cells = rows.select(F.posexplode(vec).alias("dim", "x")).withColumn("x", or_zero(F.col("x")))
    stats = [F.count("*").alias("n"), F.avg("x").alias("mean"), F.var_samp("x").alias("var"), F.var_pop("x").alias("var_pop"), F.min("x").alias("low"), F.max("x").alias("high")]
    return cells.groupBy("dim").agg(*stats)


def scaler(rows: DataFrame, vec: str, scope: str = "all", n_mels: int | None = None) -> DataFrame:
    """One row: arrays `mean` and `std` (at least 1e-6). scope 'mel' leaves places from n_mels on as they are."""
    stats = dimension_stats(rows, vec)
    inside = F.lit(True) if scope == "all" else F.col("dim") < n_mels
    mean, std = F.when(inside, F.col("mean")).otherwise(0.0), F.when(inside, F.sqrt(F.greatest(F.coalesce("var", F.lit(0.0)), F.lit(1e-12)))).otherwise(1.0)
    ordered = F.array_sort(F.collect_list(F.struct("dim", mean.alias("mean"), std.alias("std"))))
    return stats.agg(ordered.alias("s")).select(F.expr("transform(s, x -> x.mean)").alias("mean"), F.expr("transform(s, x -> x.std)").alias("std"))


def zscored(rows: DataFrame, vec: str, fitted: DataFrame) -> DataFrame:
    """(x - mean) / std with a scaler's one row, which is broadcast; keep the scaler with the model it trains."""
    scale = F.broadcast(fitted.withColumnsRenamed({"mean": "_mean", "std": "_std"}))
    z = F.transform(F.arrays_zip(F.col(vec).alias("x"), F.col("_mean").alias("m"), F.col("_std").alias("s")), lambda t: (or_zero(t["x"]) - t["m"]) / t["s"])
    return rows.join(scale).withColumn(vec, z).drop("_mean", "_std")
