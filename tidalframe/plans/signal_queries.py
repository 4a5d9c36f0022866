"""Signal operators over users' event series."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidalframe.functions.signal import colour, decibels, hz_to_mel, pcm16, soft_limit
from tidalframe.operators import features, signals
from tidalframe.plans.adapters import CENT, FFT, FILT, FR, HOP, LEN, MEL, MELPTS, MELS, RATE, RMS, SIG, SPEC, WIN, ZCR, r6, signal, spectral, sql

BASE = (SIG, LEN, FR)
SPECTRA = (*BASE, WIN, SPEC)
BANDS = (*SPECTRA, MELPTS, FILT, MEL)


def _frames(spark, sf_dir):
    return signals.frames(signal(spark, sf_dir), FFT, HOP)


def _spectra(spark, sf_dir):
    return signals.spectrum(_frames(spark, sf_dir), FFT)


def _bands(spark, sf_dir):
    return signals.mel_energies(_spectra(spark, sf_dir), signals.mel_filters(spark, MELS, FFT, RATE))


def frame_signal(spark, sf_dir):
    return _frames(spark, sf_dir).select("rec_id", "frame", F.col("k").cast("long").alias("k"), r6("v").alias("v"))


def frame_signal_padded(spark, sf_dir):
    framed = signals.frames(signal(spark, sf_dir), FFT, HOP, at_least_one=True)
    return framed.groupBy("rec_id", "frame").agg(F.count("*").alias("samples"), r6(F.sum("v")).alias("total"))


def hann_frames(spark, sf_dir):
    return signals.windowed(_frames(spark, sf_dir), FFT).select("rec_id", "frame", F.col("k").cast("long").alias("k"), r6("v").alias("v"))


def frame_rms(spark, sf_dir):
    return signals.frame_rms(_frames(spark, sf_dir), FFT).select("rec_id", "frame", r6("rms").alias("rms"))


def frame_zcr(spark, sf_dir):
    return signals.frame_zcr(_frames(spark, sf_dir), FFT).select("rec_id", "frame", r6("zcr").alias("zcr"))


def dft_magnitude(spark, sf_dir):
    return _spectra(spark, sf_dir).select("rec_id", "frame", F.col("bin").cast("long").alias("bin"), r6("mag").alias("mag"))


def mel_filterbank(spark, sf_dir):
    """A filter bank for each rate in the table: a user's samples are taken as those of one second."""
    rates = signals.lengths(signal(spark, sf_dir)).select(F.col("n").alias("sample_rate")).distinct()
    return signals.mel_filters_by_rate(rates, MELS, FFT).select("sample_rate", F.col("mel").cast("long").alias("mel"), F.col("bin").cast("long").alias("bin"), r6("weight").alias("weight"))


def mel_energy(spark, sf_dir):
    return _bands(spark, sf_dir).select("rec_id", "frame", F.col("mel").cast("long").alias("mel"), r6("energy").alias("energy"))


def spectral_centroid(spark, sf_dir):
    return signals.spectral_centroid(_spectra(spark, sf_dir), FFT, RATE).select("rec_id", "frame", r6("centroid").alias("centroid"))


def feature_frames(spark, sf_dir):
    f = features.extract(signal(spark, sf_dir), FFT, HOP, MELS, RATE)
    return f.select("rec_id", "frame", r6("time_sec").alias("time_sec"), *[r6(F.col("mel")[i]).alias(f"mel_{i}") for i in range(MELS)], r6("rms").alias("rms"), r6("centroid").alias("centroid"), r6("zcr").alias("zcr"))


def feature_frames_grouped(spark, sf_dir):
    """The same as feature_frames, by grouped aggregates."""
    f = signals.features(signal(spark, sf_dir), FFT, HOP, MELS, RATE)
    return f.select("rec_id", "frame", r6("time_sec").alias("time_sec"), *[r6(F.col("mel")[i]).alias(f"mel_{i}") for i in range(MELS)], r6("rms").alias("rms"), r6("centroid").alias("centroid"), r6("zcr").alias("zcr"))


def feature_frames_64(spark, sf_dir):
    """64 bands of frames of 64 samples."""
    f = features.extract(signal(spark, sf_dir), 64, 16, 64, RATE, block=2)
    bands = F.posexplode("mel").alias("mel", "energy")
    return f.select("rec_id", "frame", bands, "rms", "centroid", "zcr").select("rec_id", "frame", F.col("mel").cast("long").alias("mel"), *[r6(c).alias(c) for c in ("energy", "rms", "centroid", "zcr")])


def to_db(spark, sf_dir):
    return _bands(spark, sf_dir).select("rec_id", "frame", F.col("mel").cast("long").alias("mel"), r6(decibels(F.col("energy"))).alias("db"))


def hz_mel(spark, sf_dir):
    from tidalframe.functions.signal import mel_to_hz
    from tidalframe.plans.adapters import table

    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("hz"))
    return p.select("p_partkey", r6(hz_to_mel(F.col("hz"))).alias("mel"), r6(mel_to_hz(hz_to_mel(F.col("hz")))).alias("back"))


def spec_normalize(spark, sf_dir):
    out = signals.scaled(_bands(spark, sf_dir), "energy", 30.0)
    return out.select("rec_id", "frame", F.col("mel").cast("long").alias("mel"), r6("scaled").alias("scaled"))


def spec_normalize_linear(spark, sf_dir):
    out = signals.scaled(_bands(spark, sf_dir), "energy", log=False)
    return out.select("rec_id", "frame", F.col("mel").cast("long").alias("mel"), r6("scaled").alias("scaled"))


def _cells(spark, sf_dir):
    return _bands(spark, sf_dir).select("rec_id", "frame", "mel", F.col("energy").alias("value"))


def raster_lerp(spark, sf_dir):
    return signals.raster(_cells(spark, sf_dir), 12, 8).select("rec_id", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), r6("value").alias("value"))


def raster_nearest(spark, sf_dir):
    return signals.raster(_cells(spark, sf_dir), 12, 8, lerp=False).select("rec_id", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), r6("value").alias("value"))


def colormap(spark, sf_dir):
    from tidalframe.plans.adapters import table

    c = table(spark, sf_dir, "customer").select("c_custkey", (F.floor(F.col("c_acctbal")) / 8192).alias("v"))
    r, g, b = colour(F.col("v"))
    return c.select("c_custkey", r.cast("long").alias("r"), g.cast("long").alias("g"), b.cast("long").alias("b"))


def waveform_minmax(spark, sf_dir):
    return signals.waveform(signal(spark, sf_dir), 20).select("rec_id", F.col("bucket").cast("long").alias("bucket"), r6("low").alias("low"), r6("high").alias("high"))


def agc_gain(spark, sf_dir):
    return signals.agc(signal(spark, sf_dir), target=0.4).select("rec_id", "idx", r6("v").alias("v"))


def soft_limiter(spark, sf_dir):
    return signal(spark, sf_dir).select("rec_id", "idx", r6(soft_limit(F.col("v") * 3, 0.7)).alias("v"))


def fade_in(spark, sf_dir):
    return signals.fade_in(signal(spark, sf_dir), 1000.0, 20.0).select("rec_id", "idx", r6("v").alias("v"))


def pcm_16(spark, sf_dir):
    return signal(spark, sf_dir).select("rec_id", "idx", pcm16(F.col("v") * 2).cast("long").alias("pcm"))


def chunk_rms(spark, sf_dir):
    return signals.chunk_rms(signal(spark, sf_dir), 10).select("rec_id", "chunk", r6("rms").alias("rms"))


SHAPE = "shape as (select rec_id, max(frame) + 1 as frames, 4 as mels from melt group by rec_id), grid as (select rec_id, frames, x, y, floor((1 - y / 8.0) * 3)::bigint as mel from shape cross join range(0, 12) a(x) cross join range(0, 8) b(y))"

SQL = {
    "frame_signal": sql(*BASE, select="select rec_id, frame, k, round(v, 6) + 0.0 as v from fr"),
    "frame_signal_padded": sql(
        SIG,
        "l2 as (select rec_id, greatest(1, floor((count(*) - 16) / 8.0) + 1)::bigint as f from sig group by rec_id)",
        "f2 as (select rec_id, unnest(range(0, f)) as frame from l2)",
        select="select f2.rec_id, frame, count(*) as samples, round(sum(v), 6) + 0.0 as total from f2 join sig s2 on s2.rec_id = f2.rec_id and idx between frame * 8 and frame * 8 + 15 group by all",
    ),
    "hann_frames": sql(*BASE, WIN, select="select rec_id, frame, k, round(v, 6) + 0.0 as v from win"),
    "frame_rms": sql(*BASE, WIN, RMS, select="select rec_id, frame, round(rms, 6) as rms from rms"),
    "frame_zcr": sql(*BASE, WIN, ZCR, select="select rec_id, frame, round(zcr, 6) as zcr from zcr"),
    "dft_magnitude": sql(*SPECTRA, select="select rec_id, frame, bin, round(mag, 6) as mag from spec"),
    "mel_filterbank": sql(
        SIG, LEN, "rt as (select distinct n as sample_rate from len)",
        "mp as (select sample_rate, i, 700 * (pow(10.0, (i / 5.0 * (2595 * log10(1 + sample_rate / 2 / 700))) / 2595) - 1) as hz from rt cross join range(0, 6) t(i))",
        "f as (select sample_rate, a.i as mel, bin, bin * (sample_rate / 16)::double as hz, a.hz as lower, b.hz as centre, c.hz as upper from mp a join mp b using (sample_rate) join mp c using (sample_rate) cross join range(0, 9) t(bin) where b.i = a.i + 1 and c.i = a.i + 2)",
        "w as (select *, case when hz between lower and centre then (hz - lower) / (centre - lower) when hz between centre and upper then (upper - hz) / (upper - centre) else 0 end as weight from f)",
        select="select sample_rate, mel, bin, round(weight, 6) as weight from w where weight > 0",
    ),
    "mel_energy": sql(*BANDS, select="select rec_id, frame, mel, round(energy, 6) as energy from melt"),
    "spectral_centroid": sql(*SPECTRA, CENT, select="select rec_id, frame, round(centroid, 6) as centroid from cent"),
    "feature_frames": sql(
        *BANDS, RMS, ZCR, CENT,
        select="select rec_id, frame, round(frame * 8 / 16.0, 6) as time_sec, round(coalesce(max(energy) filter (where mel = 0), 0), 6) as mel_0, round(coalesce(max(energy) filter (where mel = 1), 0), 6) as mel_1, "
        "round(coalesce(max(energy) filter (where mel = 2), 0), 6) as mel_2, round(coalesce(max(energy) filter (where mel = 3), 0), 6) as mel_3, round(max(rms), 6) as rms, round(max(centroid), 6) as centroid, round(max(zcr), 6) as zcr "
        "from rms join zcr using (rec_id, frame) join cent using (rec_id, frame) left join melt using (rec_id, frame) group by rec_id, frame",
    ),
    "feature_frames_64": sql(
        SIG, LEN, *spectral(64, 16, 64, RATE).values(),
        select="select rms.rec_id, rms.frame, b.mel, round(coalesce(energy, 0), 6) as energy, round(rms, 6) as rms, round(centroid, 6) as centroid, round(zcr, 6) as zcr "
        "from rms join zcr using (rec_id, frame) join cent using (rec_id, frame) cross join range(0, 64) b(mel) left join melt m on m.rec_id = rms.rec_id and m.frame = rms.frame and m.mel = b.mel",
    ),
    "to_db": sql(*BANDS, select="select rec_id, frame, mel, round(20 * log10(greatest(energy, 1e-10)), 6) + 0.0 as db from melt"),
    "hz_mel": "select p_partkey, round(2595 * log10(1 + p_retailprice / 700), 6) as mel, round(700 * (pow(10.0, log10(1 + p_retailprice / 700)) - 1), 6) as back from part",
    "spec_normalize": sql(
        *BANDS,
        "lv as (select *, 20 * log10(greatest(energy, 1e-10) / case when max(energy) over (partition by rec_id) > 0 then max(energy) over (partition by rec_id) else 1 end) as level from melt)",
        "sp as (select *, greatest(max(level) over (partition by rec_id) - 30, min(level) over (partition by rec_id)) as bottom, max(level) over (partition by rec_id) as top from lv)",
        select="select rec_id, frame, mel, round(greatest(0, least(1, (level - bottom) / case when top = bottom then 1e-6 else top - bottom end)), 6) + 0.0 as scaled from sp",
    ),
    "spec_normalize_linear": sql(
        *BANDS,
        "sp as (select *, min(energy) over (partition by rec_id) as bottom, max(energy) over (partition by rec_id) as top from melt)",
        select="select rec_id, frame, mel, round(greatest(0, least(1, (energy - bottom) / case when top = bottom then 1e-6 else top - bottom end)), 6) + 0.0 as scaled from sp",
    ),
    "raster_lerp": sql(
        *BANDS, SHAPE,
        "pt as (select *, floor(x * (frames - 1) / 11.0)::bigint as frame, x * (frames - 1) / 11.0 - floor(x * (frames - 1) / 11.0) as part from grid)",
        select="select pt.rec_id, x, y, round(coalesce(a.energy, 0) + (coalesce(b.energy, 0) - coalesce(a.energy, 0)) * part, 6) + 0.0 as value from pt left join melt a on a.rec_id = pt.rec_id and a.frame = pt.frame and a.mel = pt.mel "
        "left join melt b on b.rec_id = pt.rec_id and b.frame = least(pt.frames - 1, pt.frame + 1) and b.mel = pt.mel",
    ),
    "raster_nearest": sql(
        *BANDS, SHAPE,
        select="select g.rec_id, x, y, round(coalesce(a.energy, 0), 6) as value from grid g left join melt a on a.rec_id = g.rec_id and a.frame = floor(x * frames / 12.0)::bigint and a.mel = g.mel",
    ),
    "colormap": """with c as (select c_custkey, greatest(0, least(1, floor(c_acctbal) / 8192)) * 4 as t from customer),
        p as (select c_custkey, t, floor(t)::int as i, least(floor(t)::int + 1, 4) as j, [68,59,33,94,253] as r, [1,82,144,201,231] as g, [84,139,140,98,37] as b from c)
        select c_custkey, floor(r[i+1] + (r[j+1] - r[i+1]) * (t - i) + 0.5)::bigint as r, floor(g[i+1] + (g[j+1] - g[i+1]) * (t - i) + 0.5)::bigint as g, floor(b[i+1] + (b[j+1] - b[i+1]) * (t - i) + 0.5)::bigint as b from p""",
    "waveform_minmax": sql(SIG, LEN, "b as (select rec_id, idx // greatest(1, n // 20) as bucket, v from sig join len using (rec_id))", select="select rec_id, bucket, round(least(min(v), 1), 6) + 0.0 as low, round(greatest(max(v), -1), 6) + 0.0 as high from b where bucket < 20 group by all"),
    "agc_gain": sql(
        SIG, "g as (select rec_id, least(8.0, 0.4 / (sqrt(avg(v * v)) + 1e-8)) as gain from sig group by rec_id)", "a as (select rec_id, idx, v * gain as v from sig join g using (rec_id))",
        select="select rec_id, idx, round(greatest(-1, least(1, case when v > 0.99 then 1.99 - exp(-(v - 0.99)) when v < -0.99 then -(1.99 - exp(-(-v - 0.99))) else v end)), 6) + 0.0 as v from a",
    ),
    "soft_limiter": sql(SIG, "a as (select rec_id, idx, v * 3 as v from sig)", select="select rec_id, idx, round(greatest(-1, least(1, case when v > 0.7 then 1.7 - exp(-(v - 0.7)) when v < -0.7 then -(1.7 - exp(-(-v - 0.7))) else v end)), 6) + 0.0 as v from a"),
    "fade_in": sql(SIG, select="select rec_id, idx, round(case when idx < 20 then v * idx / 20 else v end, 6) + 0.0 as v from sig"),
    "pcm_16": sql(SIG, "c as (select rec_id, idx, greatest(-1, least(1, v * 2)) as c from sig)", select="select rec_id, idx, trunc(case when c < 0 then c * 32768 else c * 32767 end)::bigint as pcm from c"),
    "chunk_rms": sql(SIG, select="select rec_id, idx // 10 as chunk, round(sqrt(sum(v * v) / count(*)), 6) as rms from sig group by all"),
}

SQL["feature_frames_grouped"] = SQL["feature_frames"]

QUERIES = {name: globals()[name] for name in SQL}
