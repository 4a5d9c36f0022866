"""Filters and deterministic samples of frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidalframe.operators.ranges import joined, quantiles, ranked
from tidalframe.sources.work import written


def energy_filter(frames: DataFrame, ratio: float, least: float) -> DataFrame:
    """rms >= max(ratio * largest rms of all recordings, least). The maximum is one row, so it is broadcast."""
    top = frames.agg(F.max("rms").alias("_top"))
    return frames.join(F.broadcast(top)).where(F.col("rms") >= F.greatest(ratio * F.col("_top"), F.lit(least))).drop("_top")


def mel_sum_filter(frames: DataFrame, ratio: float) -> DataFrame:
    """mel_sum >= ratio * the recording's largest."""
    top = frames.groupBy("rec_id").agg(F.max("mel_sum").alias("_top"))
    return frames.join(top, "rec_id").where(F.col("mel_sum") >= ratio * F.col("_top")).drop("_top")


def not_silent(frames: DataFrame, least: float = 1e-9) -> DataFrame:
    """Frames of recordings whose largest rms is over `least`."""
    loud = frames.groupBy("rec_id").agg(F.max("rms").alias("_top")).where(F.col("_top") > least).select("rec_id")
    return frames.join(loud, "rec_id", "left_semi")


def finite_vectors(df: DataFrame, vector: str) -> DataFrame:
    return df.where(~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))


def same_width(df: DataFrame, pool: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is as long as that of the pool's first recording (pos, rec_id)."""
    widths = df.join(pool, "rec_id").agg(F.min_by(F.size(vector), F.struct("pos")).alias("_w"))
    return df.join(F.broadcast(widths)).where(F.size(vector) == F.col("_w")).drop("_w")


def _picked(i: Column, n: Column, cap: Column) -> Column:
    """True if i is floor(j * (n / cap)) for some j < cap: what a stride of n / cap (in doubles) takes."""
    step = n / cap
    j = F.ceil(i / step)
    hit = lambda x: (F.floor(x * step) == i) & (x < cap) & (x >= 0)
    return hit(j) | hit(j - 1) | hit(j + 1)


def stride_cap(df: DataFrame, by: list[str], order: list[str | Column], cap: int) -> DataFrame:
    """At most cap rows per group, at fractional strides; all rows of smaller groups."""
    rows = ranked(df, by, order)
    return rows.where((F.col("_n") <= cap) | _picked(F.col("_i"), F.col("_n"), F.lit(cap))).drop("_i", "_n")


def step_cap(df: DataFrame, by: list[str], order: list[str | Column], cap: int) -> DataFrame:
    """Every ceil(n / cap)-th row of a group, from the first."""
    rows = ranked(df, by, order)
    return rows.where(F.col("_i") % F.greatest(F.lit(1), F.ceil(F.col("_n") / cap)) == 0).drop("_i", "_n")


def preview(df: DataFrame, order: list[str | Column], most: int, n: int) -> DataFrame:
    """Rows 0, step, 2 step ... of a total order, step = max(1, floor(n / min(n, most))); may exceed `most`.

    n is the row count. Ranks come from range partitions and their offsets, not from one task.
    """
    step = max(1, n // max(1, min(n, most)))
    return positions(df, order).where(F.col("pos") % step == 0)


def positions(df: DataFrame, order: list[str | Column], name: str = "pos") -> DataFrame:
    """Adds `name`, the row's place (from 0) in the total order; no task sees all rows.

    Rows are dealt by ranges, sorted and numbered within their range, and written with those
    numbers; each range's size, a row per range, is read off the written table. Both sides of
    the join thus see the same ranges: dealt twice, rows may fall into other ones.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id())
    rows = written(dealt, "ranges").withColumn("_part", F.shiftright("_row", 33))
    before = F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = rows.groupBy("_part").agg(F.count("*").alias("_size")).select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    placed = rows.join(F.broadcast(offsets), "_part")  # one row per partition
    return placed.withColumn(name, F.col("_before") + F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))).drop("_row", "_part", "_before")


def keep_silence(frames: DataFrame, fraction: float) -> DataFrame:
    """labelled frames: all speech, and floor(fraction * frames) silent frames per recording at even strides."""
    want = frames.groupBy("rec_id").agg(F.floor(fraction * F.count("*")).alias("_want")).where("_want > 0")
    silent = ranked(frames.where("type = 'silence'"), ["rec_id"], ["frame"])
    chosen = joined(silent, want, ["rec_id"]).where(_picked(F.col("_i"), F.col("_n"), F.col("_want")))
    return frames.where("type <> 'silence'").unionByName(chosen.select(*frames.columns))


def total_limit(df: DataFrame, by: str, pool: DataFrame, order: list[str | Column], limit: int) -> DataFrame:
    """The first `limit` rows in pool order (pos, by), then `order`.

    Counts per recording and their running sum, a small table, give each recording its
    share; no global sort of the rows.
    """
    sizes = df.groupBy(by).agg(F.count("*").alias("_n")).join(pool, by)
    before = F.sum("_n").over(Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    share = sizes.withColumn("_share", F.lit(limit) - F.coalesce(before, F.lit(0))).where("_share > 0").select(by, "_share")
    return ranked(df.join(share, by), [by], order).where("_i < _share").drop("_i", "_n", "_share")


def loudest(frames: DataFrame, q: float) -> DataFrame:
    """Speech frames at or over the q-quantile of their recording's speech rms."""
    speech = frames.where("type = 'speech'")
    return joined(speech, quantiles(speech, ["rec_id"], "rms", q), ["rec_id"]).where("rms >= quantile").drop("quantile")


def in_window(df: DataFrame, t0: float | Column, t1: float | Column) -> DataFrame:
    return df.where(F.col("time_sec").between(t0, t1))


def click_window(t: Column, v0: Column, v1: Column, half: float = 2.0) -> tuple[Column, Column]:
    return F.greatest(v0, t - half), F.least(v1, t + half)


def reservoir(df: DataFrame, by: list[str], key: list[str], limit: int, seed: int = 0, weight: str | None = None) -> DataFrame:
    """`limit` rows of each group, the same ones every time; all rows of smaller groups.

    A row's number comes from a seeded hash of its key, so it doesn't depend on the order of
    rows: the smallest are a sample without repeats that merges. With weight (over 0, else
    the row takes no part) the number is an exponential one over the weight, so heavier
    rows are likelier. Each task keeps `limit` rows a group before any is moved.
    """
    text = F.concat_ws("-", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key])
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), text), 256)
    rows = df
    if weight is not None:
        rows = df.where(F.col(weight) > 0)
        uniform = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(2.0**52)
        digest = F.struct((-F.log(uniform) / F.col(weight)).alias("number"), digest.alias("digest"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy("_digest", *key))
    return rows.withColumn("_digest", digest).withColumn("_place", place).where(F.col("_place") <= limit).drop("_digest", "_place")


def hashed_sample(df: DataFrame, key: str, limit: int, seed: int = 0) -> DataFrame:
    """`limit` rows of all, the same ones every time; all if there are fewer."""
    return reservoir(df.withColumn("_all", F.lit(0)), ["_all"], [key], limit, seed).drop("_all")


def few_frames(frames: DataFrame, least: int = 4) -> DataFrame:
    """Recordings with fewer than `least` frames."""
    return frames.groupBy("rec_id").agg(F.count("*").alias("n")).where(F.col("n") < least)
