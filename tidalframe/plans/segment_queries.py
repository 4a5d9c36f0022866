"""Segmentation, trims, filters and samples over frames of users' events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidalframe.operators import sampling, segments, signals
from tidalframe.plans.adapters import FFT, FR, HOP, LEN, RATE, RMS, SIG, WIN, r6, signal, sql

RATIO = 0.8137  # between data values, so that neither engine's rounding flips a frame


def _rms(spark, sf_dir):
    return signals.frame_rms(signals.frames(signal(spark, sf_dir), FFT, HOP), FFT)


def _labelled(spark, sf_dir):
    return segments.labelled(_rms(spark, sf_dir), RATIO, 2, 2)


def moving_average(spark, sf_dir):
    return segments.smoothed(_rms(spark, sf_dir), "rms", 3).select("rec_id", "frame", r6("rms").alias("rms"))


def segment_silence(spark, sf_dir):
    return segments.segments(_labelled(spark, sf_dir)).select("rec_id", "start_frame", "end_frame", "type")


def segment_expand(spark, sf_dir):
    return segments.expanded(segments.segments(_labelled(spark, sf_dir)))


def segments_summary(spark, sf_dir):
    out = segments.summary(_labelled(spark, sf_dir), F.col("type") == "speech")
    return out.withColumns({c: r6(c) for c in ("percent_of_speech", "percent_of_total")})


def segments_rollup(spark, sf_dir):
    out = segments.with_totals(segments.summary(_labelled(spark, sf_dir), (F.col("type") == "speech") & (F.col("frame") % 2 == 0)))
    return out.withColumns({c: r6(c) for c in ("percent_of_speech", "percent_of_total")})


def leading_silence(spark, sf_dir):
    s = signal(spark, sf_dir)
    out = segments.leading_silence(signals.chunk_rms(s, 4), signals.lengths(s), RATE, 4, 0.2513, 3, 2)
    return out.select("rec_id", r6("silence_end").alias("silence_end"))


def _regions(spark, sf_dir):
    return segments.trim_regions(_labelled(spark, sf_dir), signals.lengths(signal(spark, sf_dir)), RATE, HOP, 0.25, 0.125)


def trim_regions(spark, sf_dir):
    return _regions(spark, sf_dir).select("rec_id", r6("start_sec").alias("start_sec"), r6("end_sec").alias("end_sec"), "strategy")


def trim_slice(spark, sf_dir):
    return segments.trimmed(signal(spark, sf_dir), _regions(spark, sf_dir), RATE).select("rec_id", "idx", r6("v").alias("v"))


def frame_durations(spark, sf_dir):
    frames = _rms(spark, sf_dir).withColumn("time_sec", F.col("frame") * F.col("frame") / 16)
    return segments.durations(frames).select("rec_id", "frame", r6("duration").alias("duration"))


def energy_filter(spark, sf_dir):
    return sampling.energy_filter(_rms(spark, sf_dir), 0.7131, 0.1).select("rec_id", "frame", r6("rms").alias("rms"))


def rms_quantile_filter(spark, sf_dir):
    # ranks by value: rounded first, so that equal values are equal in every engine
    frames = _labelled(spark, sf_dir).withColumn("rms", F.round("rms", 6))
    return sampling.loudest(frames, 0.25).select("rec_id", "frame", r6("rms").alias("rms"))


def keep_silence(spark, sf_dir):
    return sampling.keep_silence(_labelled(spark, sf_dir), 0.3).select("rec_id", "frame", "type")


def drop_silent_recordings(spark, sf_dir):
    return sampling.not_silent(_rms(spark, sf_dir), 0.4017).select("rec_id", "frame", r6("rms").alias("rms"))


def stride_fraction_cap(spark, sf_dir):
    return sampling.stride_cap(signal(spark, sf_dir), ["rec_id"], ["idx"], 22).select("rec_id", "idx", r6("v").alias("v"))


def stride_int_cap(spark, sf_dir):
    return sampling.step_cap(signal(spark, sf_dir), ["rec_id"], ["idx"], 22).select("rec_id", "idx", r6("v").alias("v"))


def sample_limit(spark, sf_dir):
    s = signal(spark, sf_dir)
    pool = s.select("rec_id").distinct().select("rec_id", (-F.col("rec_id")).alias("pos"))
    return sampling.total_limit(s, "rec_id", pool, ["idx"], 3333).select("rec_id", "idx", r6("v").alias("v"))


def preview_sample(spark, sf_dir):
    s = signal(spark, sf_dir)
    return sampling.preview(s, ["rec_id", "idx"], 700, s.count()).select("rec_id", "idx", "pos", r6("v").alias("v"))


def time_window(spark, sf_dir):
    frames = _rms(spark, sf_dir).withColumn("time_sec", F.col("frame") * HOP / RATE)
    return sampling.in_window(frames, 0.5, 2.0).select("rec_id", "frame", r6("time_sec").alias("time_sec"))


def click_window(spark, sf_dir):
    n = signals.lengths(signal(spark, sf_dir))
    t0, t1 = sampling.click_window(F.col("n") / 40, F.lit(0.5), F.col("n") / RATE)
    return n.select("rec_id", r6(t0).alias("t0"), r6(t1).alias("t1"))


def low_sample_recordings(spark, sf_dir):
    return sampling.few_frames(_rms(spark, sf_dir), 7)


BASE = (SIG, LEN, FR, WIN, RMS)


def _lab(ratio: float, of: str = "partition by rec_id") -> tuple[str, ...]:
    """Frames with their segment and type, from `rms`; of: the rows whose largest rms counts."""
    return (
        f"l0 as (select rec_id, frame, rms, case when rms < {ratio} * max(rms) over ({of}) then 'silence' else 'speech' end as kind from rms)",
        "l1 as (select *, sum(st) over (partition by rec_id order by frame) as run, row_number() over (partition by rec_id order by frame) as n from "
        "(select *, case when kind is distinct from lag(kind) over (partition by rec_id order by frame) then 1 else 0 end as st from l0))",
        "l2 as (select *, count(*) over (partition by rec_id, run) as ln, max(n) over (partition by rec_id, run) as upto from l1)",
        "l3 as (select *, min(case when upto >= 2 then run end) over (partition by rec_id) as fr from l2)",
        "l4 as (select *, case when st = 1 and (run = fr or (run > fr and ln >= 2)) then frame end as hd from l3)",
        "l5 as (select *, last_value(hd ignore nulls) over (partition by rec_id order by frame) as sg, min(hd) over (partition by rec_id) as z, last_value(kind) over (partition by rec_id order by frame rows between unbounded preceding and unbounded following) as lk from l4)",
        "lab as (select a.rec_id, a.frame, a.rms, case when a.sg is null or a.sg = a.z then 0 else a.sg end as segment, coalesce(b.kind, a.lk) as type from l5 a left join l5 b on a.rec_id = b.rec_id and b.frame = coalesce(a.sg, a.z))",
    )


LAB = (*BASE, *_lab(RATIO))
SUM = (
    "sm as (select rec_id, count(distinct segment) filter (where type = 'speech') as speech_segments, count(distinct segment) filter (where type <> 'speech') as silence_segments, count(*) filter (where type = 'speech') as speech_frames, "
    "count(*) filter (where type <> 'speech') as silence_frames, count(*) filter (where {0}) as selected_frames, 0::bigint as kept_silence_frames from lab group by rec_id)"
)
PCT = "round(case when speech_frames > 0 then selected_frames / speech_frames * 100 else 0 end, 6) as percent_of_speech, round(selected_frames / (speech_frames + silence_frames) * 100, 6) as percent_of_total"
TRIM = (
    "tr as (select len.rec_id, n / 16.0 as d, min(frame) filter (where type = 'speech') as a, max(frame) filter (where type = 'speech') as b, count(frame) as c from len left join lab using (rec_id) group by len.rec_id, n)",
    "reg as (select rec_id, case when a is null then 0.0::double else greatest(0, a * 0.5::double - 0.25) end as start_sec, case when a is null then d else least(d, b * 0.5::double + 0.5 + 0.125) end as end_sec, case when c = 0 then 'no-frames' when a is null then 'no-speech' else 'segmenter' end as strategy from tr)",
)
RANK = "rk as (select *, idx as i, count(*) over (partition by rec_id) as n from sig)"

SQL = {
    "moving_average": sql(*BASE, select="select rec_id, frame, round(avg(rms) over (partition by rec_id order by frame rows between 1 preceding and 1 following), 6) as rms from rms"),
    "segment_silence": sql(*LAB, select="select rec_id, segment as start_frame, max(frame) as end_frame, min(type) as type from lab group by rec_id, segment"),
    "segment_expand": sql(*LAB, select="select rec_id, frame, type from lab"),
    "segments_summary": sql(*LAB, SUM.format("type = 'speech'"), select=f"select *, {PCT} from sm"),
    "segments_rollup": sql(
        *LAB, SUM.format("type = 'speech' and frame % 2 = 0"),
        "ro as (select rec_id, sum(speech_segments)::bigint as speech_segments, sum(silence_segments)::bigint as silence_segments, sum(speech_frames)::bigint as speech_frames, sum(silence_frames)::bigint as silence_frames, "
        "sum(selected_frames)::bigint as selected_frames, sum(kept_silence_frames)::bigint as kept_silence_frames from sm group by rollup (rec_id))",
        select=f"select *, {PCT} from ro",
    ),
    "leading_silence": sql(
        SIG, LEN, "ch as (select rec_id, idx // 4 as chunk, sqrt(sum(v * v) / count(*)) as rms from sig group by all)",
        "lo as (select rec_id, chunk, min(rms) over (partition by rec_id order by chunk rows between current row and 2 following) as low from ch)",
        "so as (select rec_id, min(chunk) as chunk from lo where low > 0.2513 group by rec_id)",
        select="select rec_id, round(case when chunk is null then n / 16.0 else least(n / 16.0, greatest(0, chunk * 4 - 2) / 16.0) end, 6) as silence_end from len left join so using (rec_id)",
    ),
    "trim_regions": sql(*LAB, *TRIM, select="select rec_id, round(start_sec, 6) as start_sec, round(end_sec, 6) as end_sec, strategy from reg"),
    "trim_slice": sql(*LAB, *TRIM, select="select rec_id, idx - floor(start_sec * 16)::bigint as idx, round(v, 6) + 0.0 as v from sig join reg using (rec_id) where idx >= floor(start_sec * 16) and idx < floor(end_sec * 16)"),
    "frame_durations": sql(
        *BASE, "t as (select rec_id, frame, frame * frame / 16.0 as t from rms)",
        select="select rec_id, frame, round(coalesce(lead(t) over w - t, t - lag(t) over w, 0.02), 6) as duration from t window w as (partition by rec_id order by t)",
    ),
    "energy_filter": sql(*BASE, select="select rec_id, frame, round(rms, 6) as rms from rms where rms >= greatest(0.7131 * (select max(rms) from rms), 0.1)"),
    "rms_quantile_filter": sql(
        *LAB, "sp as (select rec_id, frame, round(rms, 6) as rms from lab where type = 'speech')", "q as (select rec_id, quantile_cont(rms, 0.25) as bar from sp group by rec_id)",
        select="select rec_id, frame, rms from sp join q using (rec_id) where rms >= bar",
    ),
    "keep_silence": sql(
        *LAB, "ct as (select rec_id, count(*) as total, count(*) filter (where type = 'silence') as n from lab group by rec_id)",
        "pk as (select rec_id, floor(j * (n / greatest(1, floor(0.3 * total))))::bigint as i from (select rec_id, n, total, unnest(range(0, floor(0.3 * total)::bigint)) as j from ct where n > 0))",
        "sl as (select *, row_number() over (partition by rec_id order by frame) - 1 as i from lab where type = 'silence')",
        select="select rec_id, frame, type from lab where type = 'speech' union all select rec_id, frame, type from sl semi join pk using (rec_id, i)",
    ),
    "drop_silent_recordings": sql(*BASE, select="select rec_id, frame, round(rms, 6) as rms from rms where rec_id in (select rec_id from rms group by rec_id having max(rms) > 0.4017)"),
    "stride_fraction_cap": sql(
        SIG, RANK, "pk as (select rec_id, floor(j * (n / 22))::bigint as i from (select distinct rec_id, n from rk where n > 22) cross join range(0, 22) t(j))",
        select="select rec_id, idx, round(v, 6) + 0.0 as v from rk where n <= 22 union all select rec_id, idx, round(v, 6) + 0.0 from rk semi join pk using (rec_id, i)",
    ),
    "stride_int_cap": sql(SIG, RANK, select="select rec_id, idx, round(v, 6) + 0.0 as v from rk where i % greatest(1, ceil(n / 22)::bigint) = 0"),
    "sample_limit": sql(SIG, "rk as (select *, row_number() over (order by -rec_id, idx) as r from sig)", select="select rec_id, idx, round(v, 6) + 0.0 as v from rk where r <= 3333"),
    "preview_sample": sql(SIG, "rk as (select *, row_number() over (order by rec_id, idx) - 1 as pos, count(*) over () as n from sig)", select="select rec_id, idx, pos, round(v, 6) + 0.0 as v from rk where pos % greatest(1, n // least(n, 700)) = 0"),
    "time_window": sql(*BASE, select="select rec_id, frame, round(frame * 8 / 16.0, 6) as time_sec from rms where frame * 8 / 16.0 between 0.5 and 2.0"),
    "click_window": sql(SIG, LEN, select="select rec_id, round(greatest(0.5, n / 40 - 2), 6) as t0, round(least(n / 16.0, n / 40 + 2), 6) as t1 from len"),
    "low_sample_recordings": sql(*BASE, select="select rec_id, count(*) as n from rms group by rec_id having count(*) < 7"),
}

QUERIES = {name: globals()[name] for name in SQL}
