"""Checks of feature tables before and after training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidalframe.functions.signal import finite, or_zero
from tidalframe.operators.normalise import dimension_stats
from tidalframe.operators.pca import Model, project
from tidalframe.operators.ranges import ranked

#: Rms levels whose shares are reported.
LEVELS = (0.001, 0.005, 0.01, 0.02)


def before_training(frames: DataFrame) -> DataFrame:
    """One row over frames (rms, mel_sum): ranges, means and the percentage under each level (two places)."""
    under = [F.round(F.count_if(F.col("rms") < t) * 100 / F.count("*"), 2).alias(f"under_{t:g}".replace(".", "_")) for t in LEVELS]
    ranges = [f(c).alias(f"{c}_{n}") for c in ("rms", "mel_sum") for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))]
    return frames.agg(F.count("*").alias("frames"), *ranges, *under)


def warnings(quiet: Column, mel_mean: Column, zero_variance: Column) -> Column:
    """Array of texts: over 40 % quiet frames, hardly any band energy, dimensions without variance."""
    found = F.array(
        F.when(quiet > 40, F.lit("over 40 % of frames are quiet")),
        F.when(mel_mean < 1e-4, F.lit("band energy is very low")),
        F.when(zero_variance > 0, F.concat(zero_variance.cast("string"), F.lit(" dimensions without variance"))),
    )
    return F.array_compact(found)


def ranked_dimensions(stats: DataFrame, k: int, by: str = "var", lowest: bool = False) -> DataFrame:
    """The k dimensions with the largest variance, or the smallest non-zero one; ties go to the lower dimension."""
    rows = stats.where(F.col(by) > 0) if lowest else stats
    order = F.asc(by) if lowest else F.desc(by)
    return rows.orderBy(order, "dim").limit(k)


def invalid_cells(rows: DataFrame, vec: str) -> DataFrame:
    """cells, nan_cells, infinite_cells, invalid_percent over every cell."""
    cells = rows.select(F.explode(vec).alias("x")).withColumn("x", F.col("x").cast("double"))
    nan, inf = F.count_if(F.isnan("x") | F.col("x").isNull()), F.count_if(F.abs("x") == float("inf"))
    n = F.count("*")
    return cells.agg(n.alias("cells"), nan.alias("nan_cells"), inf.alias("infinite_cells"), F.when(n > 0, (nan + inf) / n * 100).otherwise(0.0).alias("invalid_percent"))


def checked_recordings(frames: DataFrame, quiet: float = 0.005) -> DataFrame:
    """Per recording of frames (rec_id, rms, mel_sum): frames, mel_sum_mean, quiet_percent (a missing or
    unfinished rms is quiet, such a band sum counts as 0), and the warnings about them."""
    low = F.count_if(~finite(F.col("rms").cast("double")) | (F.col("rms") < quiet)) * 100 / F.count("*")
    out = frames.groupBy("rec_id").agg(F.count("*").alias("frames"), F.avg(or_zero(F.col("mel_sum").cast("double"))).alias("mel_sum_mean"), low.alias("quiet_percent"))
    return out.withColumn("warnings", warnings(F.col("quiet_percent"), F.col("mel_sum_mean"), F.lit(0)))


def after_training(rows: DataFrame, vec: str, model: Model, small: float = 1e-8) -> DataFrame:
    """The first, middle and last frame of each recording on a model's components: rec_id, frame, which, z,
    and all_small, whether the squares of each of the recording's samples sum up to at most `small`.

    rows (rec_id, frame, vec) are normalised as for training. A component without length
    gives zeros; what is wrong with the components themselves tells pca.diagnosis().
    """
    size = F.aggregate("z", F.lit(0.0), lambda a, x: a + x * x)
    z = F.transform(project(vec, model.mean.tolist(), model.components.tolist(), len(model.mean)), or_zero)
    sampled = sample_frames(rows, ["frame"]).select("rec_id", "frame", "which", z.alias("z"))
    return sampled.withColumn("all_small", F.bool_and(size <= small).over(Window.partitionBy("rec_id")))  # three rows each


def sample_frames(frames: DataFrame, order: list[str]) -> DataFrame:
    """First, middle (floor(n / 2), from 0) and last frame of each recording, in column `which`."""
    rows = ranked(frames, ["rec_id"], order)
    marks = F.array(F.when(F.col("_i") == 0, "first"), F.when(F.col("_i") == F.floor(F.col("_n") / 2), "middle"), F.when(F.col("_i") == F.col("_n") - 1, "last"))
    return rows.withColumn("which", F.explode(F.array_compact(marks))).drop("_i", "_n")


def validated(rows: DataFrame, vec: str) -> DataFrame:
    """dim, mean, low, high, var, and whether the column is valid (finite everywhere)."""
    good = rows.select(F.posexplode(vec).alias("dim", "x")).groupBy("dim").agg(F.bool_and(finite(F.col("x").cast("double"))).alias("valid"))
    return dimension_stats(rows, vec).join(good, "dim")


def summary(frames: DataFrame) -> DataFrame:
    """Per recording: frames, mean mel_sum, mean rms and the first six times."""
    times = F.slice(F.array_sort(F.collect_list(F.when(F.col("frame") < 6, F.col("time_sec")))), 1, 6)
    return frames.groupBy("rec_id").agg(F.count("*").alias("frames"), F.avg("mel_sum").alias("mel_sum_mean"), F.avg("rms").alias("rms_mean"), times.alias("first_times"))


def variance_report(rows: DataFrame, vec: str, k: int = 5, most: int = 15) -> DataFrame:
    """One row: mean_variance, the k dimensions of largest and of smallest non-zero variance, and the
    first `most` dimensions without variance (arrays of dim). There is one row per dimension to sort."""
    stats = dimension_stats(rows, vec).select("dim", "var_pop").withColumn("flat", F.col("var_pop") <= 1e-12)
    pick = lambda keep, sign: F.transform(F.slice(F.array_sort(F.collect_list(F.when(keep, F.struct((sign * F.col("var_pop")).alias("v"), "dim")))), 1, k), lambda x: x["dim"])
    none = F.slice(F.array_sort(F.collect_list(F.when(F.col("flat"), F.col("dim")))), 1, most)
    return stats.agg(F.avg("var_pop").alias("mean_variance"), pick(F.lit(True), -1).alias("largest"), pick(~F.col("flat"), 1).alias("smallest"), none.alias("without"), F.count_if("flat").alias("n_without"))
