"""Stores, reports and files of a trained model: migration, checks before and after training, CSV and model sinks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tidalframe.operators import cluster, diagnostics, documents, pca, training
from tidalframe.plans import composed_queries, matrix_queries, segment_queries
from tidalframe.plans.adapters import CENT, FILT, MEL, MELPTS, RATE, RMS, SPEC, ZCR, r6, sql
from tidalframe.plans.composed_queries import AXES7, MEAN7, point_set
from tidalframe.plans.document_queries import recordings
from tidalframe.plans.matrix_queries import AXES, D, MEAN, M, Z
from tidalframe.sources import tables
from tidalframe.sources.work import work_path
from tidalframe.streaming.classify import classified

GROUPS = [[0.0, 0.1], [-0.1, 0.0], [0.1, -0.1]]


def _migrated(spark, sf_dir):
    """Each document is a session: a reference to itself, its content once more as an embedded recording, and an empty entry."""
    r = recordings(spark, sf_dir)
    entry = lambda id, name, blob: F.struct(id.cast("long").alias("id"), name.cast("string").alias("name"), blob.cast("binary").alias("blob"))
    none = F.lit(None)
    sessions = r.select(F.col("id").alias("session"), F.array(entry(none, none, none), entry(F.col("id"), none, none), entry(none, F.col("name"), F.col("blob"))).alias("recordings"))
    return documents.migrated(r, sessions)


def migrated_recordings(spark, sf_dir):
    return _migrated(spark, sf_dir)[0].select("id", "name", F.decode("blob", "utf-8").alias("text"))


def migrated_refs(spark, sf_dir):
    return _migrated(spark, sf_dir)[1].select("session", F.col("pos").cast("long").alias("pos"), "recording")


def checked_recordings(spark, sf_dir):
    out = diagnostics.checked_recordings(matrix_queries._frames(spark, sf_dir))
    return out.select("rec_id", "frames", r6("mel_sum_mean").alias("mel_sum_mean"), r6("quiet_percent").alias("quiet_percent"), F.size("warnings").cast("long").alias("n_warnings"))


def post_diagnostics(spark, sf_dir):
    model = pca.Model(np.array(MEAN), np.array(AXES), np.ones(2), np.ones(2) / 2)
    out = diagnostics.after_training(matrix_queries.rows(spark, sf_dir), "vec", model, small=0.05)
    return out.select("rec_id", "frame", "which", r6(F.col("z")[0]).alias("pc1"), r6(F.col("z")[1]).alias("pc2"), "all_small")


def projected_speech(spark, sf_dir):
    """Loud speech of every user on given components; loudness is rounded first, as ranks go by it."""
    model = pca.Model(np.array(MEAN7), np.array(AXES7), np.ones(2), np.ones(2) / 2)
    frames = composed_queries._frames(spark, sf_dir).withColumn("rms", F.round("rms", 6))
    out = training.projected(frames, composed_queries._pool(spark, sf_dir), model, RATE, silence_ratio=0.4037, min_silence=2, min_speech=2)
    return out.select("rec_id", "frame", r6(F.col("z")[0]).alias("pc1"), r6(F.col("z")[1]).alias("pc2"))


def csv_points(spark, sf_dir):
    """The users' points, with names that hold quotes and line ends and with their clusters, written as CSV and read back."""
    points = cluster.assigned(point_set(spark, sf_dir).withColumn("z", F.array("pc1", "pc2")), "z", GROUPS)
    name = F.concat(F.lit('user "'), F.col("rec_id").cast("string"), F.lit('",\n'))
    named = {"recordingId": F.col("rec_id"), "recordingName": name, "frameIndex": F.col("frame"), "timeSec": F.col("frame") * 0.5, "PC1": F.col("pc1"), "PC2": F.col("pc2"), "cluster": F.nullif("cluster", F.lit(2))}
    path = work_path(spark, "csv")
    tables.write_csv(points.select(*[c.alias(n) for n, c in named.items()]), path)
    kinds = dict.fromkeys(("recordingId", "frameIndex", "cluster"), "long") | dict.fromkeys(("timeSec", "PC1", "PC2"), "double")
    return tables.read_csv(spark, path).select(*[F.col(c).cast(kinds.get(c, "string")).alias(c) for c in tables.PROJECTIONS])


def stored_model(spark, sf_dir):
    """All vectors classified by the model that is active in a store, which has held others too."""
    store = tables.ModelStore(spark, work_path(spark, "models"))
    components = pca.to_json(pca.Model(np.array(MEAN), np.array(AXES), np.ones(2), np.ones(2) / 2))
    groups = {"k": len(GROUPS), "dim": 2, "centroids": GROUPS}
    gone = store.save("first", components, groups | {"centroids": GROUPS[::-1]})
    kept = store.save("second", components, groups)
    for step in (lambda: store.activate(gone), lambda: store.delete(gone), lambda: store.activate(kept), lambda: store.rename(kept, "kept")):
        step()
    model = store.load(store.active())
    out = classified(matrix_queries.rows(spark, sf_dir), "vec", model)
    return out.select("vec_id", F.col("cluster").cast("long").alias("cluster"), F.lit(model["name"]).alias("model"), F.lit(store.models().count()).cast("long").alias("models"))


_NEAR = "list_transform([" + ", ".join(f"[{x}, {y}]" for x, y in GROUPS) + "], lambda g: ({0} - g[1]) * ({0} - g[1]) + ({1} - g[2]) * ({1} - g[2]))"
_PLACED = "list_position({0}, list_min({0})) - 1"

SQL = {
    "migrated_recordings": "select doc_id as id, source as name, text from documents union all "
    "select (select max(doc_id) from documents) + row_number() over (order by doc_id), coalesce(source, ''), text from documents where text is not null",
    "migrated_refs": "select doc_id as session, 0::bigint as pos, doc_id as recording from documents union all "
    "select doc_id, 1, (select max(doc_id) from documents) + row_number() over (order by doc_id) from documents where text is not null",
    "checked_recordings": sql(
        M, matrix_queries.FRAMES, "c as (select rec_id, count(*) as frames, avg(mel_sum) as ms, count(*) filter (where rms < 0.005) * 100 / count(*) as q from fr group by rec_id)",
        select="select rec_id, frames, round(ms, 6) as mel_sum_mean, round(q, 6) as quiet_percent, (q > 40)::bigint + (ms < 0.0001)::bigint as n_warnings from c",
    ),
    "post_diagnostics": sql(
        M, Z, "s as (select rec_id, frame, which, z from (select *, count(*) over (partition by rec_id) as n from z) cross join (values ('first'), ('middle'), ('last')) t(which) where frame = case which when 'first' then 0 when 'middle' then n // 2 else n - 1 end)",
        select="select rec_id, frame, which, round(z[1], 6) + 0.0 as pc1, round(z[2], 6) + 0.0 as pc2, bool_and(z[1] * z[1] + z[2] * z[2] <= 0.05) over (partition by rec_id) as all_small from s",
    ),
    "projected_speech": sql(
        *segment_queries.BASE[:-1], RMS.replace("rms as (select rec_id, frame, sqrt(sum(v * v) / 16) as rms", "rms as (select rec_id, frame, round(sqrt(sum(v * v) / 16), 6) as rms"),
        SPEC, MELPTS, FILT, MEL, ZCR, CENT, *segment_queries._lab(0.4037),
        "ms as (select rec_id, frame, list(coalesce(energy, 0) order by mel) as mel from rms cross join range(0, 4) t(mel) left join melt using (rec_id, frame, mel) group by all)",
        "sp as (select *, quantile_cont(rms, 0.15) over (partition by rec_id) as bar from lab where type = 'speech')",
        "cp as (select greatest(100, ceil(5000 / count(distinct rec_id))) as cap from sig)",
        "ld as (select *, row_number() over (partition by rec_id order by frame) - 1 as i, count(*) over (partition by rec_id) as n from sp where rms >= bar)",
        "tk as (select rec_id, frame, rms from ld cross join cp where i % greatest(1, ceil(n / cap))::bigint = 0)",
        "vc as (select rec_id, frame, list_concat(list_transform(mel, lambda x: ln(1 + greatest(x, 0))), [rms, centroid / 8, zcr]) as v from tk join ms using (rec_id, frame) join zcr using (rec_id, frame) join cent using (rec_id, frame))",
        select=f"select rec_id, frame, round({composed_queries._SCORE.format(MEAN7, AXES7[0])}, 6) + 0.0 as pc1, round({composed_queries._SCORE.format(MEAN7, AXES7[1])}, 6) + 0.0 as pc2 from vc",
    ),
    "csv_points": sql(
        f"p as ({composed_queries.SQL['point_set']})", f"c as (select *, {_NEAR.format('pc1', 'pc2')} as d from p)",
        select="select rec_id as \"recordingId\", 'user \"' || rec_id || '\",' || chr(10) as \"recordingName\", frame as \"frameIndex\", frame * 0.5::double as \"timeSec\", pc1 as \"PC1\", pc2 as \"PC2\", "
        f"nullif({_PLACED.format('d')}, 2)::bigint as cluster from c",
    ),
    "stored_model": sql(M, Z, f"c as (select vec_id, {_NEAR.format('z[1]', 'z[2]')} as d from z)", select=f"select vec_id, ({_PLACED.format('d')})::bigint as cluster, 'kept' as model, 1::bigint as models from c"),
}

QUERIES = {name: globals()[name] for name in SQL}
