"""The tables read as signals, matrices and documents; and the same as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FFT, HOP, RATE, MELS = 16, 8, 16.0, 4

SIG = "sig as (select user_id as rec_id, row_number() over (partition by user_id order by ts, event_id) - 1 as idx, (value - 50) / 100 as v from events)"
LEN = "len as (select rec_id, count(*) as n from sig group by rec_id)"


def spectral(fft: int, hop: int, mels: int, rate: float) -> dict[str, str]:
    """The feature extractor's steps as SQL: frames, windowed frames, spectra, mel points, filters, bands, loudness, crossings, centroids."""
    nyquist, bins, width = rate / 2, fft // 2 + 1, rate / fft
    return {
        "fr": f"fr as (select s.rec_id, f.frame, s.idx - f.frame * {hop} as k, s.v from (select rec_id, unnest(range(0, greatest(0, floor((n - {fft}) / {hop}.0)::bigint + 1))) as frame from len) f "
        f"join sig s on s.rec_id = f.rec_id and s.idx between f.frame * {hop} and f.frame * {hop} + {fft - 1})",
        "win": f"win as (select rec_id, frame, k, v * (0.5 * (1 - cos(k * (2 * pi() / {fft - 1})))) as v from fr)",
        "spec": f"spec as (select rec_id, frame, bin, sqrt(re * re + im * im) as mag from (select rec_id, frame, bin, sum(v * cos((k * bin % {fft}) * (2 * pi() / {fft}))) as re, "
        f"sum(v * sin((k * bin % {fft}) * (2 * pi() / {fft}))) as im from win cross join range(0, {bins}) b(bin) group by all))",
        "mp": f"mp as (select i, 700 * (pow(10.0, (i / {mels + 1}.0 * (2595 * log10(1 + {nyquist} / 700))) / 2595) - 1) as hz from range(0, {mels + 2}) t(i))",
        "filt": f"filt as (select a.i as mel, bin, case when bin * {width}::double between a.hz and b.hz then (bin * {width}::double - a.hz) / (b.hz - a.hz) when bin * {width}::double between b.hz and c.hz then (c.hz - bin * {width}::double) / (c.hz - b.hz) else 0 end as weight "
        f"from mp a join mp b on b.i = a.i + 1 join mp c on c.i = a.i + 2 cross join range(0, {bins}) t(bin))",
        "melt": "melt as (select rec_id, frame, mel, sum(mag * weight) as energy from spec join filt using (bin) where weight > 0 group by all)",
        "rms": f"rms as (select rec_id, frame, sqrt(sum(v * v) / {fft}) as rms from win group by all)",
        "zcr": f"zcr as (select rec_id, frame, sum(case when (v >= 0) <> (before >= 0) then 1 else 0 end) / {fft}.0 as zcr from (select *, lag(v) over (partition by rec_id, frame order by k) as before from win) group by all)",
        "cent": f"cent as (select rec_id, frame, case when sum(mag) > 0 then sum(bin * {width}::double * mag) / sum(mag) else 0 end as centroid from spec group by all)",
    }


FR, WIN, SPEC, MELPTS, FILT, MEL, RMS, ZCR, CENT = spectral(FFT, HOP, MELS, RATE).values()


def sql(*ctes: str, select: str) -> str:
    return f"with {', '.join(ctes)} {select}"


def r6(x: Column | str) -> Column:
    """Rounded to six places, and never minus zero."""
    return F.round(F.col(x) if isinstance(x, str) else x, 6) + F.lit(0.0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as a signal."""
    e = table(spark, sf_dir, "events")
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.select(F.col("user_id").alias("rec_id"), place.cast("long").alias("idx"), ((F.col("value") - 50) / 100).alias("v"))
