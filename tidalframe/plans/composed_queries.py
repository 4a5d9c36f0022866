"""Composed steps over the tables. Iterations and seeded choices have no SQL; tests compare them, and the others, with plain versions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tidalframe.operators import documents, features, pca, segments, signals, training
from tidalframe.plans import document_queries, matrix_queries, segment_queries
from tidalframe.plans.adapters import CENT, FFT, FILT, HOP, MEL, MELPTS, MELS, RATE, SPEC, ZCR, r6, signal, sql, table
from tidalframe.sources.work import written

PREP = {"min_silence": 2, "min_speech": 2, "rms_ratio": 0.6, "context": 1, "keep_silence": 0.25, "per_recording": 6}


def _frames(spark, sf_dir):
    return written(features.extract(signal(spark, sf_dir), FFT, HOP, MELS, RATE), "features")  # computed once, read several times


def _pool(spark, sf_dir):
    """Every user, the largest id first."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("rec_id")).distinct().select((-F.col("rec_id")).alias("pos"), "rec_id")


def prepared_vectors(spark, sf_dir):
    out = training.prepare(_frames(spark, sf_dir), _pool(spark, sf_dir), RATE, **PREP).rows
    return matrix_queries.long(out, "rec_id", "frame")


def prepared_summary(spark, sf_dir):
    out = training.prepare(_frames(spark, sf_dir), _pool(spark, sf_dir), RATE, **PREP).summary
    return out.withColumns({c: r6(c) for c in ("percent_of_speech", "percent_of_total")})


def pca_components(spark, sf_dir):
    out = pca.fit_table(matrix_queries.rows(spark, sf_dir), "vec", 8)
    return out.select("component", "place", *[r6(c).alias(c) for c in ("loading", "eigenvalue", "explained")])


def _projected(spark, sf_dir):
    frames = _frames(spark, sf_dir)
    prepared = training.prepare(frames, _pool(spark, sf_dir), RATE, min_silence=2, min_speech=2, zscore="")
    model = pca.fit(pca.gather(prepared.rows, "vec"), 3)
    return training.projected(frames, _pool(spark, sf_dir), model, RATE, min_silence=2, min_speech=2)


def projected_points(spark, sf_dir):
    return matrix_queries.long(_projected(spark, sf_dir), "rec_id", "frame", vec="z")


MEAN7 = [0.4, 0.5, 0.3, 0.2, 0.25, 0.5, 0.3]
AXES7 = [[0.5, 0.5, 0.5, 0.5, 0.0, 0.0, 0.0], [0.1, -0.2, 0.3, -0.4, 0.5, -0.6, 0.2]]


def point_set(spark, sf_dir):
    model = pca.Model(np.array(MEAN7), np.array(AXES7), np.ones(2), np.ones(2) / 2)
    out = training.point_set(_frames(spark, sf_dir), model, RATE, silence_ratio=0.4037, min_silence=2, min_speech=2)
    return out.select("rec_id", "frame", r6("pc1").alias("pc1"), r6("pc2").alias("pc2"))


def k_sweep(spark, sf_dir):
    results, _ = training.auto_k(matrix_queries.rows(spark, sf_dir), "vec", "vec_id", 3, 6, n_init=3, iterations=20, sample=None)
    rows = [(r["K"], c, r["inertia"], r["silhouette"], r["ch"], r["db"], n, centroid) for r in results for c, (n, centroid) in enumerate(zip(r["sizes"], r["centroids"]))]
    return spark.createDataFrame(rows, "K long, cluster long, inertia double, silhouette double, ch double, db double, n long, centroid array<double>")


def auto_k(spark, sf_dir):
    _, recommended = training.auto_k(matrix_queries.rows(spark, sf_dir), "vec", "vec_id", 3, 6, n_init=3, iterations=20, sample=None)
    return recommended.select(F.col("pick").cast("long").alias("pick"), "K", r6("silhouette").alias("silhouette"))


def _backup(spark, sf_dir):
    """Every document is there; all come in again under other ids, and once more with other content.
    Even conversations are there; all come in, their turns referring to documents."""
    r = document_queries.recordings(spark, sf_dir).where("id is not null")
    other = r.select((F.col("id") + 2_000_000).alias("id"), "name", F.encode(F.concat(F.coalesce(F.decode("blob", "utf-8"), F.lit("")), F.lit("!")), "utf-8").alias("blob"))
    c = table(spark, sf_dir, "conversations")
    refs = c.select(F.col("conv_id").alias("session"), F.col("turn").alias("pos"), F.col("conv_id").alias("recording"))
    incoming_refs = refs.withColumn("session", F.col("session") + 1_000_000).withColumn("recording", F.col("recording") + 1_000_000)
    return r, refs.where("session % 2 = 0"), r.withColumn("id", F.col("id") + 1_000_000).unionByName(other), incoming_refs


def import_backup_recordings(spark, sf_dir):
    added, _ = documents.import_backup(*_backup(spark, sf_dir))
    return added.select("id", "name", F.decode("blob", "utf-8").alias("text"))


def import_backup_refs(spark, sf_dir):
    return documents.import_backup(*_backup(spark, sf_dir))[1].select("session", "pos", "recording")


def trimmed_copies(spark, sf_dir):
    s = signal(spark, sf_dir)
    regions = segments.trim_regions(segment_queries._labelled(spark, sf_dir), signals.lengths(s), RATE, HOP, 0.25, 0.125)
    users = s.select(F.col("rec_id").alias("id"), F.concat(F.lit("user "), (F.col("rec_id") % 5).cast("string")).alias("name")).distinct()
    return documents.trimmed_copies(users, segments.trimmed(s, regions, RATE))[0]


QUERIES = {
    f.__name__: f
    for f in (prepared_vectors, prepared_summary, pca_components, projected_points, point_set, k_sweep, auto_k, import_backup_recordings, import_backup_refs, trimmed_copies)
}

_PICKED = "select rec_id, floor(j * (n / {0}))::bigint as i from (select rec_id, n, unnest(range(0, {0}::bigint)) as j from {1})"
_PREPARED = (
    *segment_queries.BASE, SPEC, MELPTS, FILT, MEL, ZCR, CENT, *segment_queries._lab(PREP["rms_ratio"]),
    "ms as (select rec_id, frame, list(coalesce(energy, 0) order by mel) as mel, sum(greatest(coalesce(energy, 0), 0)) as mel_sum from rms cross join range(0, 4) t(mel) left join melt using (rec_id, frame, mel) group by all)",
    "fe as (select lab.*, ms.mel, mel_sum, zcr, centroid, max(lab.rms) over (partition by lab.rec_id) as peak, max(mel_sum) over (partition by lab.rec_id) as mt, max(lab.rms) over () as top, count(*) over (partition by lab.rec_id) as total from lab join ms using (rec_id, frame) join zcr using (rec_id, frame) join cent using (rec_id, frame))",
    "vc as (select *, list_concat(list_transform(mel, lambda x: ln(1 + greatest(x, 0))), [rms / peak, centroid / 8, zcr]) as v from fe)",
    "vs as (select *, list_concat(list_concat(coalesce(lag(v) over w, [0, 0, 0, 0, 0, 0, 0]::double[]), v), coalesce(lead(v) over w, [0, 0, 0, 0, 0, 0, 0]::double[])) as vec from vc window w as (partition by rec_id order by frame))",
    "sn as (select rec_id, max(floor(0.25 * total)) as want, count(*) as n from vs where type = 'silence' group by rec_id having want > 0)",
    f"sp as ({_PICKED.format('want', '(select rec_id, n, want from sn)').replace('select rec_id, n, unnest', 'select rec_id, n, want, unnest')})",
    "kp as (select rec_id, frame from (select rec_id, frame, row_number() over (partition by rec_id order by frame) - 1 as i from vs where type = 'silence') semi join sp using (rec_id, i))",
    "ch as (select * from vs where type = 'speech' union all select * from vs semi join kp using (rec_id, frame))",
    "en as (select *, row_number() over (partition by rec_id order by frame) - 1 as i, count(*) over (partition by rec_id) as n from ch where rms >= greatest(0.6 * top, 0.002) and mel_sum >= 0.02 * (case when mt > 0 then mt else 1 end))",
    f"pk as ({_PICKED.format('6', '(select distinct rec_id, n from en where n > 6)')})",
    "tk as (select * from en where n <= 6 union all select * from en semi join pk using (rec_id, i))",
)
_IMPORTED = (
    "hv as (select doc_id as id, coalesce(source, '') as name, text, sha256(text) as h from documents where doc_id is not null)",
    "nw as (select id + 1000000 as id, name, text, h from hv union all select id + 2000000, name, text || '!', sha256(text || '!') from hv)",
    "kn as (select h, min(id) as known from hv group by h)",
    "fr as (select h, min(id) as first from nw where h not in (select h from hv) group by h)",
)

_SCORE = "list_sum(list_transform(list_zip(v, {0}, {1}), lambda p: (p[1] - p[2]) * p[3]))"

SQL = {
    "point_set": sql(
        *segment_queries.BASE, SPEC, MELPTS, FILT, MEL, ZCR, CENT, *segment_queries._lab(0.4037, ""),
        "ms as (select rec_id, frame, list(coalesce(energy, 0) order by mel) as mel from rms cross join range(0, 4) t(mel) left join melt using (rec_id, frame, mel) group by all)",
        "vc as (select rec_id, frame, list_concat(list_transform(mel, lambda x: ln(1 + greatest(x, 0))), [lab.rms, centroid / 8, zcr]) as v from lab join ms using (rec_id, frame) join zcr using (rec_id, frame) join cent using (rec_id, frame) where type = 'speech')",
        select=f"select rec_id, frame, round({_SCORE.format(MEAN7, AXES7[0])}, 6) + 0.0 as pc1, round({_SCORE.format(MEAN7, AXES7[1])}, 6) + 0.0 as pc2 from vc",
    ),
    "prepared_vectors": sql(
        *_PREPARED, "cl as (select rec_id, frame, place - 1 as place, vec[place] as x from tk cross join range(1, 22) t(place))",
        "st as (select place, avg(x) as mean, greatest(coalesce(var_samp(x), 0), 1e-12) as var from cl group by place)",
        select="select rec_id, frame, place, round((x - mean) / sqrt(var), 6) + 0.0 as x from cl join st using (place)",
    ),
    "prepared_summary": sql(
        *_PREPARED, "mk as (select vs.rec_id, vs.frame, vs.segment, vs.type, tk.frame is not null as taken, kp.frame is not null as kept from vs left join tk on tk.rec_id = vs.rec_id and tk.frame = vs.frame left join kp on kp.rec_id = vs.rec_id and kp.frame = vs.frame)",
        "sm as (select rec_id, count(distinct segment) filter (where type = 'speech') as speech_segments, count(distinct segment) filter (where type <> 'speech') as silence_segments, count(*) filter (where type = 'speech') as speech_frames, "
        "count(*) filter (where type <> 'speech') as silence_frames, count(*) filter (where taken) as selected_frames, count(*) filter (where kept) as kept_silence_frames from mk group by rec_id)",
        select=f"select *, {segment_queries.PCT} from sm",
    ),
    "import_backup_recordings": sql(*_IMPORTED, select="select first as id, arg_min(nullif(name, ''), id) as name, any_value(text) as text from nw join fr using (h) group by first"),
    "import_backup_refs": sql(
        *_IMPORTED, "mp as (select nw.id as old_id, coalesce(known, first) as new_id from nw left join kn using (h) left join fr using (h))",
        "er as (select conv_id as session, turn as pos, conv_id as recording from conversations where conv_id % 2 = 0)",
        "ir as (select conv_id + 1000000 as session, turn as pos, conv_id + 1000000 as recording from conversations)",
        "ep as (select session, list_sort(list(name || '|' || h)) as p from er join hv on id = recording group by session)", "ip as (select session, list_sort(list(name || '|' || h)) as p from ir join nw on id = recording group by session)",
        "fs as (select p, min(session) as session from ip where p not in (select p from ep) group by p)",
        select="select ir.session, pos, coalesce(new_id, recording) as recording from ir join fs using (session) left join mp on old_id = recording",
    ),
    "trimmed_copies": sql(
        *segment_queries.LAB, *segment_queries.TRIM, "tr1 as (select distinct rec_id from sig join reg using (rec_id) where idx >= floor(start_sec * 16) and idx < floor(end_sec * 16))",
        select="select (select max(rec_id) from sig) + row_number() over (order by rec_id) as id, 'user ' || (rec_id % 5) || ' Trimmed ' || row_number() over (partition by rec_id % 5 order by rec_id) as name from tr1",
    ),
}
