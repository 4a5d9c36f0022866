"""Silence and speech: smoothing, segmentation, and the trims that rest on it.

Frames are rows (rec_id, frame, rms). Ordered steps run over blocks of a recording, so a
long recording is many tasks' work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidalframe.functions.signal import finite
from tidalframe.operators.ranges import joined, with_neighbours
from tidalframe.sources.work import written

BLOCK = 65_536


def smoothed(df: DataFrame, value: str, width: int, block: int = BLOCK) -> DataFrame:
    """Centred moving average, cut off at both ends; an even width counts as the next odd one."""
    if width <= 1:
        return df
    half = width // 2
    return with_neighbours(df, ["rec_id"], ["frame"], half, {value: lambda w: F.avg(value).over(w.rowsBetween(-half, half))}, max(block, 1))


def labelled(df: DataFrame, silence_ratio: float = 0.12, min_silence: int = 5, min_speech: int = 3, peak: Column | None = None, block: int = BLOCK) -> DataFrame:
    """Adds `segment` (its first frame) and `type`, silence or speech.

    A frame below silence_ratio * peak (default: the recording's largest RMS) is
    silence. Runs shorter than their type's minimum are absorbed: repeatedly the
    leftmost one goes to its predecessor, or, at the start, to its successor. Done as
    sets: the first run whose cumulative length reaches its minimum is kept and starts
    at frame 0; after it exactly the runs that are long enough by themselves are kept,
    each up to the next kept one. Neighbours of one type stay apart. If no run is long
    enough the recording is one segment of the last run's type.

    A recording is cut into blocks of frames. Each block's runs are found by themselves; a
    row for each block (its length, first and last run, last kept run) tells where the runs
    that cross its borders begin and end, and which kept run goes on into it. Only these
    rows are ordered within a recording.
    """
    rows = df
    if peak is None:
        tops = df.groupBy("rec_id").agg(F.max(F.when(finite(F.col("rms")), F.col("rms"))).alias("_peak"))
        rows, peak = joined(df, tops, ["rec_id"]), F.col("_peak")
    kind = F.when(F.col("rms") < silence_ratio * peak, "silence").otherwise("speech")
    inside = Window.partitionBy("rec_id", "_block").orderBy("frame")
    rows = rows.withColumn("_kind", kind).withColumn("_block", F.floor(F.col("frame") / block))
    turn = F.coalesce(F.col("_kind") != F.lag("_kind").over(inside), F.lit(True))
    rows = rows.withColumn("_turn", turn.cast("int")).withColumn("_run", F.sum("_turn").over(inside)).drop("_turn")
    rows = written(rows, "frames")  # what they come from is computed once
    runs = rows.groupBy("rec_id", "_block", "_run").agg(F.min("_kind").alias("kind"), F.min("frame").alias("at"), F.count("*").alias("len"))
    runs = _whole_runs(written(runs, "runs"))
    least = F.when(F.col("kind") == "silence", min_silence).otherwise(min_speech)
    # from the first run on whose cumulative length is enough, runs count by their own length
    first = runs.groupBy("rec_id").agg(F.min(F.when(F.col("end") >= least, F.col("start.pos"))).alias("first"))
    runs = joined(runs, first, ["rec_id"])
    kept = (F.col("start.pos") == F.col("first")) | ((F.col("start.pos") > F.col("first")) & (F.col("end") - F.col("start.pos") >= least))
    runs = runs.withColumn("head", F.when(kept, F.struct("start.pos", F.col("start.frame").alias("frame"), "kind")))
    over = Window.partitionBy("rec_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # a row per block
    carried = runs.groupBy("rec_id", "_block").agg(F.max("head").alias("head")).select("rec_id", "_block", F.last("head", ignorenulls=True).over(over).alias("carried"))
    edges = runs.groupBy("rec_id").agg(F.min("head").alias("zero"), F.max_by("kind", "start.pos").alias("last"), F.min("at").alias("begin"))
    runs = joined(joined(runs, carried, ["rec_id", "_block"]), edges, ["rec_id"])
    own = F.last("head", ignorenulls=True).over(Window.partitionBy("rec_id", "_block").orderBy("_run"))
    runs = runs.withColumn("seg", F.coalesce(own, "carried"))
    at = F.when(F.col("seg").isNull() | (F.col("seg.frame") == F.col("zero.frame")), F.col("begin")).otherwise(F.col("seg.frame"))
    ends = runs.select("rec_id", "_block", "_run", at.alias("_segment"), F.coalesce("seg.kind", "zero.kind", "last").alias("_type"))
    return joined(rows, ends, ["rec_id", "_block", "_run"]).select(*df.columns, F.col("_segment").alias("segment"), F.col("_type").alias("type"))


def _whole_runs(runs: DataFrame) -> DataFrame:
    """Runs of blocks (rec_id, _block, _run, kind, at, len) with `start` (pos, frame) and `end` (a position) of
    the whole run that each is a part of; positions count a recording's frames from 0."""
    run, over = F.struct("kind", "at", "len"), Window.partitionBy("rec_id").orderBy("_block")  # a row per block
    blocks = runs.groupBy("rec_id", "_block").agg(F.sum("len").alias("n"), F.count("*").alias("runs"), F.min_by(run, "_run").alias("a"), F.max_by(run, "_run").alias("z"))
    blocks = blocks.withColumn("before", F.coalesce(F.sum("n").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    blocks = blocks.withColumn("goes_on", F.coalesce(F.lag("z.kind").over(over) == F.col("a.kind"), F.lit(False))).withColumn("stays", F.coalesce(F.lead("a.kind").over(over) == F.col("z.kind"), F.lit(False)))
    begins = F.when((F.col("runs") > 1) | ~F.col("goes_on"), F.struct((F.col("before") + F.col("n") - F.col("z.len")).alias("pos"), F.col("z.at").alias("frame")))
    blocks = blocks.withColumn("begins", begins).withColumn("stops", F.when((F.col("runs") > 1) | ~F.col("stays"), F.col("before") + F.col("a.len")))
    earlier = F.last("begins", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1))
    later = F.first("stops", ignorenulls=True).over(over.rowsBetween(1, Window.unboundedFollowing))
    first_start = F.when(F.col("goes_on"), earlier).otherwise(F.struct(F.col("before").alias("pos"), F.col("a.at").alias("frame")))
    last_end = F.when(F.col("stays"), later).otherwise(F.col("before") + F.col("n"))
    blocks = blocks.select("rec_id", "_block", "before", "runs", first_start.alias("first_start"), last_end.alias("last_end"))
    inside = Window.partitionBy("rec_id", "_block").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    rows = joined(runs.withColumn("skip", F.coalesce(F.sum("len").over(inside), F.lit(0))), blocks, ["rec_id", "_block"])
    pos = F.col("before") + F.col("skip")
    start = F.when(F.col("_run") == 1, F.col("first_start")).otherwise(F.struct(pos.alias("pos"), F.col("at").alias("frame")))
    end = F.when(F.col("_run") == F.col("runs"), F.col("last_end")).otherwise(pos + F.col("len"))
    return rows.select("rec_id", "_block", "_run", "kind", "at", start.alias("start"), end.alias("end"))


def segments(frames: DataFrame) -> DataFrame:
    """labelled frames -> rec_id, start_frame, end_frame (inclusive), type."""
    return frames.groupBy("rec_id", "segment").agg(F.max("frame").alias("end_frame"), F.first("type").alias("type")).select("rec_id", F.col("segment").alias("start_frame"), "end_frame", "type")


def expanded(segs: DataFrame) -> DataFrame:
    """Segments back to one row per frame, without a range join."""
    return segs.select("rec_id", F.explode(F.sequence("start_frame", "end_frame")).alias("frame"), "type")


def _percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole * 100).otherwise(0.0)


def summary(frames: DataFrame, selected: Column, kept_silence: Column | None = None) -> DataFrame:
    """Counts per recording from labelled frames; `selected` marks frames that were taken."""
    speech, took = F.col("type") == "speech", F.count_if(selected)
    n = F.count("*")
    kept = F.count_if(kept_silence) if kept_silence is not None else F.count_if(selected & ~speech)
    counts = [
        F.countDistinct(F.when(speech, F.col("segment"))).alias("speech_segments"),
        F.countDistinct(F.when(~speech, F.col("segment"))).alias("silence_segments"),
        F.count_if(speech).alias("speech_frames"),
        F.count_if(~speech).alias("silence_frames"),
        took.alias("selected_frames"),
        kept.alias("kept_silence_frames"),
        _percent(took, F.count_if(speech)).alias("percent_of_speech"),
        _percent(took, n).alias("percent_of_total"),
    ]
    return frames.groupBy("rec_id").agg(*counts)


def with_totals(summed: DataFrame) -> DataFrame:
    """A summary with a grand-total row (rec_id null)."""
    counts = ["speech_segments", "silence_segments", "speech_frames", "silence_frames", "selected_frames", "kept_silence_frames"]
    rolled = summed.rollup("rec_id").agg(*[F.sum(c).alias(c) for c in counts])
    share = _percent(F.col("selected_frames"), F.col("speech_frames") + F.col("silence_frames"))
    return rolled.select("rec_id", *counts, _percent(F.col("selected_frames"), F.col("speech_frames")).alias("percent_of_speech"), share.alias("percent_of_total"))


def leading_silence(chunks: DataFrame, n_samples: DataFrame, sample_rate: float, chunk: int, threshold: float = 0.01, confirm: int = 5, padding: int = 0) -> DataFrame:
    """rec_id, silence_end (seconds): where sound sets in.

    The first chunk over the threshold whose next confirm - 1 chunks, as far as there
    are, are all over it; minus padding samples. Without one, the whole duration.
    """
    ahead = {"low": lambda w: F.min("rms").over(w.rowsBetween(0, confirm - 1))}
    sound = with_neighbours(chunks, ["rec_id"], ["chunk"], confirm - 1, ahead).where(F.col("low") > threshold).groupBy("rec_id").agg(F.min("chunk").alias("chunk"))
    duration = F.col("n") / sample_rate
    start = F.greatest(F.lit(0), F.col("chunk") * chunk - padding) / sample_rate
    return n_samples.join(sound, "rec_id", "left").select("rec_id", F.when(F.col("chunk").isNull(), duration).otherwise(F.least(duration, start)).alias("silence_end"))


def trim_regions(frames: DataFrame, n_samples: DataFrame, sample_rate: float, hop: int, pre_roll: float = 0.0, post_roll: float = 0.0, pre_fraction: float = 0.0, post_fraction: float = 0.0) -> DataFrame:
    """rec_id, start_sec, end_sec, strategy from labelled frames: first speech to last speech plus one hop, with rolls.

    A roll is the larger of seconds and fraction of the duration. Without speech, or without frames, the whole clip.
    """
    speech = F.col("type") == "speech"
    found = frames.groupBy("rec_id").agg(F.min(F.when(speech, F.col("frame"))).alias("first"), F.max(F.when(speech, F.col("frame"))).alias("last"), F.lit(True).alias("any"))
    rows = n_samples.join(found, "rec_id", "left").withColumn("duration", F.col("n") / sample_rate)
    step = hop / sample_rate
    start = F.greatest(F.lit(0.0), F.col("first") * step - F.greatest(F.lit(pre_roll), F.col("duration") * pre_fraction))
    end = F.least(F.col("duration"), F.col("last") * step + step + F.greatest(F.lit(post_roll), F.col("duration") * post_fraction))
    end = F.when(end < start, F.least(F.col("duration"), start + step)).otherwise(end)
    none = F.col("first").isNull()
    return rows.select(
        "rec_id",
        F.when(none, 0.0).otherwise(start).alias("start_sec"),
        F.when(none, F.col("duration")).otherwise(end).alias("end_sec"),
        F.when(F.col("any").isNull(), "no-frames").when(none, "no-speech").otherwise("segmenter").alias("strategy"),
    )


def trimmed(signal: DataFrame, regions: DataFrame, sample_rate: float) -> DataFrame:
    """Samples of [floor(start * rate), floor(end * rate)), numbered from 0 again."""
    cut = signal.join(regions, "rec_id").withColumn("from", F.floor(F.col("start_sec") * sample_rate))
    inside = (F.col("idx") >= F.col("from")) & (F.col("idx") < F.floor(F.col("end_sec") * sample_rate))
    return cut.where(inside).select("rec_id", (F.col("idx") - F.col("from")).alias("idx"), "v")


def durations(frames: DataFrame, fallback: float = 0.02) -> DataFrame:
    """Adds `duration`: time to the next frame; the last repeats the gap before it, or the fallback."""
    after, before = lambda w: F.lead("time_sec").over(w) - F.col("time_sec"), lambda w: F.col("time_sec") - F.lag("time_sec").over(w)
    return with_neighbours(frames, ["rec_id"], ["time_sec"], 1, {"duration": lambda w: F.coalesce(after(w), before(w), F.lit(fallback))})
