"""The composed steps: a training matrix from a pool of recordings, projected points, and the choice of K."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidalframe import config
from tidalframe.functions.signal import or_zero
from tidalframe.operators import cluster, normalise, pca, sampling, segments
from tidalframe.sources.work import written


@dataclass
class Prepared:
    rows: DataFrame  # rec_id, frame, time_sec, vec
    scaler: DataFrame | None  # one row: mean, std; None if vec is unscaled
    summary: DataFrame  # a row per recording


def prepare(frames: DataFrame, pool: DataFrame, sample_rate: float, min_silence: int = 5, min_speech: int = 3, **options: Any) -> Prepared:
    """frames (rec_id, frame, time_sec, mel, rms, centroid, zcr) of the recordings in pool
    (pos, rec_id; each once) -> the rows to train on.

    Recordings of another width than the pool's first are left out. Vectors are normalised,
    then stacked with their neighbours. Taken are speech and a fraction of silence, if over
    rms_ratio of the pool's largest rms, min_rms, and mel_ratio of the recording's largest
    band sum; of each recording per_recording at even strides, and of all the first `total`
    in pool order. Silent recordings have a summary of zeros.
    """
    o = config.options("prep", **options)
    own = sampling.same_width(frames.join(pool.select("rec_id"), "rec_id", "left_semi"), pool, "mel")
    own = own.withColumn("rms", or_zero(F.col("rms"))).withColumn("mel_sum", normalise.mel_sum(F.col("mel")))
    own = written(own, "frames")  # features are computed once, whatever reads them
    tops = own.groupBy("rec_id").agg(F.max("rms").alias("peak"), F.max("mel_sum").alias("mel_top"), F.count("*").alias("n"))
    loud = own.join(tops.where("peak > 1e-9").drop("n"), "rec_id")
    vec = normalise.training_vector(F.col("mel"), F.col("rms"), F.col("centroid"), F.col("zcr"), F.col("peak"), sample_rate, o["clamp"])
    rows = segments.labelled(loud.withColumn("n_mels", F.size("mel")).withColumn("vec", vec), o["rms_ratio"], min_silence, min_speech, F.col("peak"))
    if o["context"]:
        rows = normalise.context_stack(rows, "vec", o["context"])
    chosen = sampling.keep_silence(rows, o["keep_silence"])
    top = F.broadcast(own.agg(F.greatest(F.coalesce(F.max("rms"), F.lit(0.0)), F.lit(1e-12)).alias("top")))  # one row
    enough = (F.col("rms") >= F.greatest(o["rms_ratio"] * F.col("top"), F.lit(o["min_rms"]))) & (F.col("mel_sum") >= o["mel_ratio"] * F.when(F.col("mel_top") > 0, F.col("mel_top")).otherwise(1.0))
    taken = sampling.stride_cap(chosen.join(top).where(enough), ["rec_id"], ["frame"], max(1, int(o["per_recording"])))
    taken = sampling.total_limit(sampling.finite_vectors(taken, "vec"), "rec_id", pool, ["frame"], o["total"])
    marks = taken.select("rec_id", "frame", F.lit(True).alias("taken"))
    kept = chosen.where("type = 'silence'").select("rec_id", "frame", F.lit(True).alias("kept"))
    marked = rows.join(marks, ["rec_id", "frame"], "left").join(kept, ["rec_id", "frame"], "left")
    summed = segments.summary(marked, F.coalesce("taken", F.lit(False)), F.coalesce("kept", F.lit(False)))
    counts = {c: "long" for c in ("speech_segments", "silence_segments", "speech_frames", "selected_frames", "kept_silence_frames")}
    silent = tops.where("peak <= 1e-9").select("rec_id", F.col("n").alias("silence_frames"), *[F.lit(0).cast(k).alias(c) for c, k in counts.items()], *[F.lit(0.0).alias(c) for c in ("percent_of_speech", "percent_of_total")])
    out = taken.select("rec_id", "frame", "time_sec", "vec", "n_mels")
    if not o["zscore"]:
        return Prepared(out.drop("n_mels"), None, summed.unionByName(silent))
    width = (out.agg(F.max("n_mels")).first()[0] or 0) * (2 * o["context"] + 1)
    scaler = normalise.scaler(out, "vec", o["zscore"], width)
    return Prepared(normalise.zscored(out.drop("n_mels"), "vec", scaler), scaler, summed.unionByName(silent))


def projected(frames: DataFrame, pool: DataFrame, model: pca.Model, sample_rate: float, dims: int = 3, quantile: float = 0.15, points: int = 5000, silence_ratio: float = 0.06, min_silence: int = 5, min_speech: int = 3) -> DataFrame:
    """rec_id, frame, time_sec, z: the pool's speech frames at or over the quantile of their
    recording's speech rms, every step-th beyond the cap of points over recordings (100 at
    least), normalised as for serving and projected on the first dims components."""
    n = pool.count()
    own = segments.labelled(frames.join(pool.select("rec_id"), "rec_id", "left_semi").withColumn("rms", or_zero(F.col("rms"))), silence_ratio, min_silence, min_speech)
    loud = sampling.loudest(own, quantile) if quantile else own.where("type = 'speech'")
    taken = sampling.step_cap(loud, ["rec_id"], ["frame"], max(100, -(-points // max(1, n))))
    vec = normalise.serving_vector(F.col("mel"), F.col("rms"), F.col("centroid"), F.col("zcr"), sample_rate)
    axes = model.components[: max(2, min(dims, len(model.components)))]
    return taken.select("rec_id", "frame", "time_sec", pca.project(vec, model.mean.tolist(), axes.tolist()).alias("z"))


def point_set(frames: DataFrame, model: pca.Model, sample_rate: float, speech_only: bool = True, silence_ratio: float = 0.05, min_silence: int = 5, min_speech: int = 3) -> DataFrame:
    """rec_id, frame, time_sec, pc1, pc2: every frame on the first two components, or those of speech, which
    is measured against the loudest frame of all recordings."""
    rows = frames.withColumn("rms", or_zero(F.col("rms")))
    if speech_only:
        top = F.broadcast(rows.agg(F.greatest(F.coalesce(F.max("rms"), F.lit(0.0)), F.lit(1e-12)).alias("_top")))  # one row
        rows = segments.labelled(rows.join(top), silence_ratio, min_silence, min_speech, F.col("_top")).where("type = 'speech'")
    vec = normalise.serving_vector(F.col("mel"), F.col("rms"), F.col("centroid"), F.col("zcr"), sample_rate)
    scored = rows.select("rec_id", "frame", "time_sec", pca.project(vec, model.mean.tolist(), model.components[:2].tolist(), len(model.mean)).alias("z"))
    return scored.select("rec_id", "frame", "time_sec", F.col("z")[0].alias("pc1"), F.col("z")[1].alias("pc2"))


def auto_k(rows: DataFrame, vec: str, key: str, k_min: int = 3, k_max: int = 10, n_init: int = 10, iterations: int = 200, tol: float = 1e-4, sample: int | None = 1500) -> tuple[list[dict], DataFrame]:
    """The sweep's results, and at most three recommended K in order (pick, K, silhouette)."""
    results = cluster.sweep(rows, vec, key, max(3, k_min), k_max, n_init, iterations, tol, sample)
    table = rows.sparkSession.createDataFrame([(r["K"], r["inertia"], r["silhouette"]) for r in results], "K long, inertia double, silhouette double")
    return results, cluster.recommended(table)


def applied(result: dict) -> dict:
    """The chosen result as a model to store: its centroids, sizes and inertia."""
    return {"k": result["K"], "dim": len(result["centroids"][0]), "centroids": result["centroids"], "sizes": result["sizes"], "inertia": result["inertia"]}
