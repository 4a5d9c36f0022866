"""Scaling, statistics, components and clusters over the embeddings, each with its SQL.

A vector is a whole embedding; its label is the recording it belongs to.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from tidalframe.operators import cluster, diagnostics, normalise, pca, sampling
from tidalframe.plans.adapters import r6, sql, table

D = 64
CENTROIDS = [[round(0.13 * math.cos((c + 1) * (i + 1)), 3) for i in range(D)] for c in range(3)]
MEAN = [round(0.03 * math.sin(i), 3) for i in range(D)]
AXES = [[0.125] * D, [round(0.17 * math.cos(2 * i + 1), 3) for i in range(D)]]


def rows(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").where("embedding is not null")
    frame = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    vec = F.transform("embedding", lambda x: x.cast("double"))
    return e.select("vec_id", F.col("label").cast("long").alias("rec_id"), frame.cast("long").alias("frame"), vec.alias("vec"))


def assigned(spark, sf_dir):
    return cluster.assigned(rows(spark, sf_dir), "vec", CENTROIDS)


def long(df, *keys: str, vec: str = "vec"):
    """One row per place of vec."""
    cells = df.select(*keys, F.posexplode(vec).alias("place", "x"))
    return cells.select(*keys, F.col("place").cast("long").alias("place"), r6("x").alias("x"))


def nearest_centroid(spark, sf_dir):
    return assigned(spark, sf_dir).select("vec_id", F.col("cluster").cast("long").alias("cluster"), r6("d2").alias("d2"))


def nearest_2d(spark, sf_dir):
    return cluster.assigned(rows(spark, sf_dir), "vec", CENTROIDS, dims=2).select("vec_id", F.col("cluster").cast("long").alias("cluster"), r6("d2").alias("d2"))


def inertia(spark, sf_dir):
    return assigned(spark, sf_dir).agg(r6(F.sum("d2")).alias("inertia"))


def cluster_sizes(spark, sf_dir):
    return cluster.sizes(assigned(spark, sf_dir), 3).select(F.col("cluster").cast("long").alias("cluster"), "n")


def cluster_pivot(spark, sf_dir):
    return cluster.pivot(assigned(spark, sf_dir), 3)


def _centroids(spark, found):
    cells = [(c, d, float(x)) for c, row in enumerate(found) for d, x in enumerate(row)]
    return spark.createDataFrame(cells, "cluster long, place long, x double").withColumn("x", r6("x"))


def lloyd_step(spark, sf_dir):
    return _centroids(spark, cluster.step(rows(spark, sf_dir), "vec", CENTROIDS))


def lloyd_two_steps(spark, sf_dir):
    return _centroids(spark, cluster.lloyd(rows(spark, sf_dir), "vec", CENTROIDS, iterations=2, tol=0.0).centroids)


def online_kmeans_compat(spark, sf_dir):
    labelled, _ = cluster.first_rows_kmeans(rows(spark, sf_dir), "vec", ["vec_id"], 3)
    found = cluster.means(labelled, "vec")
    return found.select(F.col("cluster").cast("long").alias("cluster"), F.col("dim").cast("long").alias("place"), r6("mean").alias("x"), F.col("size").alias("count"))


def calinski_harabasz(spark, sf_dir):
    return cluster.calinski_harabasz(assigned(spark, sf_dir), "vec", CENTROIDS).select(r6("ch").alias("ch"))


def davies_bouldin(spark, sf_dir):
    return cluster.davies_bouldin(assigned(spark, sf_dir), "vec", CENTROIDS).select(r6("db").alias("db"))


def silhouette(spark, sf_dir):
    return cluster.silhouette(assigned(spark, sf_dir), "vec", "vec_id").select(r6("silhouette").alias("silhouette"))


def _sweep(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").cast("long").alias("K"))
    return items.agg(F.sum("l_quantity").alias("inertia"), r6(F.avg("l_discount")).alias("silhouette"))


def recommend_k_bend(spark, sf_dir):
    return cluster.recommended(_sweep(spark, sf_dir), "bend").select(F.col("pick").cast("long").alias("pick"), "K", "silhouette")


def _scatter(spark, sf_dir):
    return rows(spark, sf_dir).select("rec_id", pca.project("vec", MEAN, AXES, D).alias("z")).select("rec_id", F.col("z")[0].alias("a"), F.col("z")[1].alias("b"))


def scatter_box(spark, sf_dir):
    box = cluster.bounding_box(_scatter(spark, sf_dir), "a", "b")
    return box.select(*[r6(c).alias(c) for c in box.columns])


def point_counts(spark, sf_dir):
    return _scatter(spark, sf_dir).groupBy("rec_id").agg(F.count("*").alias("n"))


def zscore_projected(spark, sf_dir):
    z = rows(spark, sf_dir).select("vec_id", pca.project("vec", MEAN, AXES, D).alias("z"))
    return long(normalise.zscored(z, "z", normalise.scaler(z, "z")), "vec_id", vec="z")


def diagnostic_vectors(spark, sf_dir):
    vec = normalise.diagnostic_vector(*_parts(), 32.0)
    return long(_feature_row(spark, sf_dir).select("vec_id", vec.alias("vec")), "vec_id")


def mel_sum_filter(spark, sf_dir):
    return sampling.mel_sum_filter(_frames(spark, sf_dir), 0.75).select("rec_id", "frame", r6("mel_sum").alias("mel_sum"))


def variance_report(spark, sf_dir):
    out = diagnostics.variance_report(rows(spark, sf_dir), "vec")
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return out.select(r6("mean_variance").alias("mean_variance"), joined("largest"), joined("smallest"), "n_without")


def flat_dimensions(spark, sf_dir):
    """The dimensions without variance, of vectors with two constant places before and one after their own."""
    wider = rows(spark, sf_dir).withColumn("vec", F.concat(F.array(F.lit(0.0), F.lit(2.5)), "vec", F.array(F.lit(-1.0))))
    out = diagnostics.variance_report(wider, "vec")
    return out.select(F.array_join(F.col("without").cast("array<string>"), ",").alias("without"), "n_without")


def diagnostic_warnings(spark, sf_dir):
    quiet = F.col("under_0_005") * 3
    stats = diagnostics.before_training(_frames(spark, sf_dir)).join(F.broadcast(diagnostics.variance_report(rows(spark, sf_dir), "vec")))
    return stats.select(F.array_join(diagnostics.warnings(quiet, F.col("mel_sum_mean"), F.col("n_without")), "; ").alias("warnings"))


def elbow_bend(spark, sf_dir):
    return cluster.elbow_by_bend(_sweep(spark, sf_dir))


def elbow_chord(spark, sf_dir):
    return cluster.elbow_by_chord(_sweep(spark, sf_dir))


def recommend_k(spark, sf_dir):
    return cluster.recommended(_sweep(spark, sf_dir)).select(F.col("pick").cast("long").alias("pick"), "K", "silhouette")


def column_means(spark, sf_dir):
    return normalise.dimension_stats(rows(spark, sf_dir), "vec").select(F.col("dim").cast("long").alias("place"), r6("mean").alias("x"))


def dim_stats(spark, sf_dir):
    out = normalise.dimension_stats(rows(spark, sf_dir), "vec")
    return out.select(F.col("dim").cast("long").alias("place"), "n", *[r6(c).alias(c) for c in ("mean", "var", "var_pop", "low", "high")])


def validate_dims(spark, sf_dir):
    out = diagnostics.validated(_holed(spark, sf_dir), "vec")
    return out.select(F.col("dim").cast("long").alias("place"), r6("mean").alias("mean"), r6("var").alias("var"), "valid")


def top_variance_dims(spark, sf_dir):
    return diagnostics.ranked_dimensions(normalise.dimension_stats(rows(spark, sf_dir), "vec"), 2).select(F.col("dim").cast("long").alias("place"), r6("var").alias("var"))


def low_variance_dims(spark, sf_dir):
    return diagnostics.ranked_dimensions(normalise.dimension_stats(rows(spark, sf_dir), "vec"), 2, "var_pop", lowest=True).select(F.col("dim").cast("long").alias("place"), r6("var_pop").alias("var_pop"))


def covariance(spark, sf_dir):
    return pca.covariance_table(rows(spark, sf_dir), "vec").select("i", "j", r6("cov").alias("cov"))


def total_variance(spark, sf_dir):
    state = pca.gather(rows(spark, sf_dir), "vec")
    return spark.createDataFrame([(state.n, float(state.covariance.trace()))], "n long, trace double").withColumn("trace", r6("trace"))


def pca_project_fixed(spark, sf_dir):
    scored = rows(spark, sf_dir).select("vec_id", pca.project("vec", MEAN, AXES, D).alias("z"))
    return long(scored, "vec_id", vec="z")


def explained_variance_fixed(spark, sf_dir):
    out = pca.explained_variance(rows(spark, sf_dir), "vec", MEAN, AXES)
    return out.select(F.col("component").cast("long").alias("component"), *[r6(c).alias(c) for c in ("variance", "ratio", "cumulative")])


def classify_projected(spark, sf_dir):
    scored = rows(spark, sf_dir).select("vec_id", "rec_id", "frame", pca.project("vec", MEAN, AXES, D).alias("z"))
    window = sampling.in_window(scored.withColumn("time_sec", F.col("frame") / 4), 1.0, 9.0)
    out = cluster.assigned(window, "z", [[0.0, 0.1], [-0.1, 0.0], [0.1, -0.1]])
    return out.select("vec_id", "frame", F.col("cluster").cast("long").alias("cluster"))


def _feature_row(spark, sf_dir):
    v = F.col("vec")
    rms, centroid, zcr = (F.abs(v[D - k]) for k in (3, 2, 1))
    out = rows(spark, sf_dir).select("vec_id", "rec_id", F.slice(v, 1, D - 3).alias("mel"), rms.alias("rms"), (centroid * 100).alias("centroid"), zcr.alias("zcr"))
    return out.withColumn("peak", F.max("rms").over(Window.partitionBy("rec_id")))


def _parts() -> list[Column]:
    return [F.col(c) for c in ("mel", "rms", "centroid", "zcr")]


def log1p_mel(spark, sf_dir):
    return long(_feature_row(spark, sf_dir).select("vec_id", normalise.log_mel(F.col("mel")).alias("vec")), "vec_id")


def mel_index_centroid(spark, sf_dir):
    return rows(spark, sf_dir).select("vec_id", r6(normalise.mel_index_centroid(F.col("vec"))).alias("centroid"))


def mel_sum(spark, sf_dir):
    return rows(spark, sf_dir).select("vec_id", r6(normalise.mel_sum(F.col("vec"))).alias("mel_sum"))


def training_vectors(spark, sf_dir):
    vec = normalise.training_vector(*_parts(), F.col("peak"), 32.0)
    return long(_feature_row(spark, sf_dir).select("vec_id", vec.alias("vec")), "vec_id")


def serving_vectors(spark, sf_dir):
    vec = normalise.serving_vector(*_parts(), 32.0)
    return long(_feature_row(spark, sf_dir).select("vec_id", vec.alias("vec")), "vec_id")


def context_stack(spark, sf_dir):
    return long(normalise.context_stack(rows(spark, sf_dir), "vec", 1), "rec_id", "frame")


def _zscored(spark, sf_dir, scope):
    r = rows(spark, sf_dir)
    return long(normalise.zscored(r, "vec", normalise.scaler(r, "vec", scope, D - 3)), "vec_id")


def zscore_all(spark, sf_dir):
    return _zscored(spark, sf_dir, "all")


def zscore_mel(spark, sf_dir):
    return _zscored(spark, sf_dir, "mel")


def _frames(spark, sf_dir):
    v = F.col("vec")
    return rows(spark, sf_dir).select("rec_id", "frame", (F.abs(v[0]) / 20).alias("rms"), normalise.mel_sum(v).alias("mel_sum"), (F.col("frame") / 4).alias("time_sec"))


def pre_diagnostics(spark, sf_dir):
    out = diagnostics.before_training(_frames(spark, sf_dir))
    return out.select("frames", *[r6(c).alias(c) for c in out.columns if c != "frames"])


def recording_summary(spark, sf_dir):
    out = diagnostics.summary(_frames(spark, sf_dir))
    times = F.array_join(F.transform("first_times", lambda x: F.format_string("%.2f", x)), ",")
    return out.select("rec_id", "frames", r6("mel_sum_mean").alias("mel_sum_mean"), r6("rms_mean").alias("rms_mean"), times.alias("first_times"))


def sample_frames(spark, sf_dir):
    return diagnostics.sample_frames(_frames(spark, sf_dir), ["frame"]).select("rec_id", "frame", "which")


def _holed(spark, sf_dir):
    """Some cells, at any place, are NaN or infinite."""
    hole = F.when(F.col("vec_id") % 7 == 0, float("nan")).when(F.col("vec_id") % 11 == 0, float("inf"))
    return rows(spark, sf_dir).withColumn("vec", F.transform("vec", lambda x, i: F.when(i == F.col("vec_id") % D, F.coalesce(hole, x)).otherwise(x)))


def nan_inf_count(spark, sf_dir):
    out = diagnostics.invalid_cells(_holed(spark, sf_dir), "vec")
    return out.withColumn("invalid_percent", r6("invalid_percent"))


def finite_vectors(spark, sf_dir):
    return sampling.finite_vectors(_holed(spark, sf_dir), "vec").select("vec_id")


def quantile_linear(spark, sf_dir):
    p = F.percentile("l_extendedprice", 0.37)
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(r6(p).alias("q"))


def _list(values) -> str:
    return "[" + ", ".join(f"{float(x)!r}::double" for x in values) + "]"


def _d2(a: str, b: str) -> str:
    return f"pow(list_distance({a}, {b}), 2)"


M = "m as (select vec_id, label::bigint as rec_id, row_number() over (partition by label order by vec_id) - 1 as frame, list_transform(embedding, lambda x: x::double) as vec from embeddings where embedding is not null)"
C0 = f"c0 as (select * from (values {', '.join(f'({i}::bigint, {_list(c)})' for i, c in enumerate(CENTROIDS))}) t(c, cv))"
NEAR = "{0} as (select vec_id, rec_id, vec, c as cluster, d2 from (select *, row_number() over (partition by vec_id order by d2, c) as r from (select vec_id, rec_id, vec, c, {2} as d2 from m cross join {1})) where r = 1)"
N0 = NEAR.format("n0", "c0", _d2("vec", "cv"))
CELLS = "cells as (select vec_id, rec_id, i - 1 as place, vec[i] as x from m cross join range(1, 65) t(i))"
ROUND = "round({0}, 6) + 0.0"
MEANS = "select cluster, i - 1 as place, avg(vec[i]) as x, count(*) as n from {0} cross join range(1, 65) t(i) group by all"
STATS = "st as (select place, count(*) as n, avg(x) as mean, var_samp(x) as var, var_pop(x) as var_pop, min(x) as low, max(x) as high from cells group by place)"
SWEEP = "sw as (select l_linenumber::bigint as K, sum(l_quantity) as inertia, round(avg(l_discount), 6) as silhouette from lineitem group by 1)"
CHORD = "ch as (select arg_min(sw.K, (-abs((sw.K - a.K) * (z.inertia - a.inertia) - (sw.inertia - a.inertia) * (z.K - a.K)), sw.K)) as K from sw, (select * from sw order by K limit 1) a, (select * from sw order by K desc limit 1) z where sw.K <> a.K and sw.K <> z.K)"
CENTRED = f"list_transform(vec, lambda x, i: x - {_list(MEAN)}[i])"
Z = "z as (select vec_id, rec_id, frame, vec, [" + ", ".join(f"list_inner_product({CENTRED}, {_list(axis)})" for axis in AXES) + "] as z from m)"
FEAT = "ft as (select vec_id, rec_id, vec[1:61] as mel, abs(vec[62]) as rms, abs(vec[63]) * 100 as centroid, abs(vec[64]) as zcr, max(abs(vec[62])) over (partition by rec_id) as peak from m)"
LOGS = "list_transform(mel, lambda x: ln(1 + greatest(x, 0)))"
FRAMES = "fr as (select rec_id, frame, abs(vec[1]) / 20 as rms, list_sum(list_transform(vec, lambda x: greatest(x, 0))) as mel_sum, frame / 4 as time_sec from m)"
HOLED = "hl as (select vec_id, place, case when place = vec_id % 64 and vec_id % 7 = 0 then 'nan'::double when place = vec_id % 64 and vec_id % 11 = 0 then 'inf'::double else x end as x from cells)"
ZS = "select vec_id, place, " + ROUND.format("case when {0} then (x - mean) / sqrt(greatest(var, 1e-12)) else x end") + " as x from cells join st using (place)"


def _unnested(column: str, keys: str, source: str, n: int) -> str:
    return f"select {keys}, i - 1 as place, {ROUND.format(f'({column})[i]')} as x from {source} cross join range(1, {n + 1}) t(i)"


SQL = {
    "nearest_centroid": sql(M, C0, N0, select="select vec_id, cluster, round(d2, 6) as d2 from n0"),
    "nearest_2d": sql(M, C0, NEAR.format("n2", "c0", _d2("vec[1:2]", "cv[1:2]")), select="select vec_id, cluster, round(d2, 6) as d2 from n2"),
    "inertia": sql(M, C0, N0, select="select round(sum(d2), 6) as inertia from n0"),
    "cluster_sizes": sql(M, C0, N0, select="select c as cluster, count(vec_id) as n from c0 left join n0 on c = cluster group by c"),
    "cluster_pivot": sql(M, C0, N0, select="select rec_id, " + ", ".join(f"count(*) filter (where cluster = {c}) as c{c}" for c in range(3)) + " from n0 group by rec_id"),
    "lloyd_step": sql(M, C0, N0, select=f"select c as cluster, i - 1 as place, {ROUND.format('coalesce(x, cv[i])')} as x from c0 cross join range(1, 65) t(i) left join ({MEANS.format('n0')}) q on q.cluster = c and q.place = i - 1"),
    "lloyd_two_steps": sql(
        M, C0, N0, f"c1 as (select c, list(coalesce(x, cv[i]) order by i) as cv from c0 cross join range(1, 65) t(i) left join ({MEANS.format('n0')}) q on q.cluster = c and q.place = i - 1 group by c)",
        NEAR.format("n1", "c1", _d2("vec", "cv")),
        select=f"select c as cluster, i - 1 as place, {ROUND.format('coalesce(x, cv[i])')} as x from c1 cross join range(1, 65) t(i) left join ({MEANS.format('n1')}) q on q.cluster = c and q.place = i - 1",
    ),
    "online_kmeans_compat": sql(M, "cf as (select row_number() over (order by vec_id) - 1 as c, vec as cv from m order by vec_id limit 3)", NEAR.format("nf", "cf", _d2("vec", "cv")), select=f"select cluster, place, {ROUND.format('x')} as x, n as count from ({MEANS.format('nf')})"),
    "calinski_harabasz": sql(
        M, C0, N0, "g as (select list(a order by i) as gm from (select i, avg(vec[i]) as a from m cross join range(1, 65) t(i) group by i))", "s as (select c, cv, count(*) as n, sum(d2) as w from n0 join c0 on c = cluster group by all)",
        select=f"select round(sum(n * ({_d2('cv', 'gm')})) * (sum(n) - 3) / (sum(w) * 2), 6) as ch from s cross join g",
    ),
    "davies_bouldin": sql(
        M, C0, N0, "s as (select c, cv, coalesce(avg(sqrt(d2)), 0) as s from c0 left join n0 on c = cluster group by all)",
        select=f"select round(sum(r) / 3, 6) as db from (select a.c, max((a.s + b.s) / sqrt({_d2('a.cv', 'b.cv')})) as r from s a join s b on a.c <> b.c group by a.c)",
    ),
    "silhouette": sql(
        M, C0, N0, f"p as (select a.vec_id, a.cluster, b.cluster as other, avg(sqrt({_d2('a.vec', 'b.vec')})) as d from n0 a join n0 b on a.vec_id <> b.vec_id group by all)",
        "q as (select vec_id, coalesce(max(d) filter (where cluster = other), 0) as a, min(d) filter (where cluster <> other) as b from p group by vec_id)", select="select round(avg((b - a) / greatest(a, b, 1e-12)), 6) as silhouette from q where b is not null",
    ),
    "elbow_bend": sql(SWEEP, select="select K from (select K, lag(inertia) over w - 2 * inertia + lead(inertia) over w as bend from sw window w as (order by K)) order by bend desc nulls last, K limit 1"),
    "elbow_chord": sql(SWEEP, CHORD, select="select K from ch"),
    "recommend_k": sql(
        SWEEP, CHORD, "rk as (select K, silhouette, row_number() over (order by silhouette desc, K) as r from sw)",
        "tw as (select arg_min(K, ((abs(K - (select K from rk where r = 1)) < 2)::int, r)) as k2 from rk where r > 1)",
        "pk as (select K, silhouette, row_number() over (order by case when r = 1 then 1 when K = (select k2 from tw) then 2 when K = (select K from ch) then 3 else 4 end, r) as pick from rk)",
        select="select pick, K, silhouette from pk where pick <= 3",
    ),
    "recommend_k_bend": sql(
        SWEEP, "be as (select K from (select K, lag(inertia) over w - 2 * inertia + lead(inertia) over w as bend from sw window w as (order by K)) order by bend desc nulls last, K limit 1)",
        "rk as (select K, silhouette, row_number() over (order by silhouette desc, K) as r from sw)",
        "tw as (select arg_min(K, ((abs(K - (select K from rk where r = 1)) < 2)::int, r)) as k2 from rk where r > 1)",
        "pk as (select K, silhouette, row_number() over (order by case when r = 1 then 1 when K = (select k2 from tw) then 2 when K = (select K from be) then 3 else 4 end, r) as pick from rk)",
        select="select pick, K, silhouette from pk where pick <= 3",
    ),
    "scatter_box": sql(M, Z, select="select " + ", ".join(f"round({f}(z[{i}]), 6) as {n}" for i, f, n in ((1, "min", "x_low"), (1, "max", "x_high"), (2, "min", "y_low"), (2, "max", "y_high"))) + " from z"),
    "point_counts": sql(M, Z, select="select rec_id, count(*) as n from z group by rec_id"),
    "zscore_projected": sql(M, Z, "zs as (select i, avg(z[i]) as mean, sqrt(greatest(var_samp(z[i]), 1e-12)) as sd from z cross join range(1, 3) t(i) group by i)", select="select vec_id, i - 1 as place, round((z[i] - mean) / sd, 6) + 0.0 as x from z cross join zs"),
    "diagnostic_vectors": sql(M, FEAT, select=_unnested(f"list_transform(list_concat({LOGS}, [rms, centroid / 16, zcr]), lambda x: greatest(x, 0))", "vec_id", "ft", 64)),
    "mel_sum_filter": sql(M, FRAMES, select="select rec_id, frame, round(mel_sum, 6) as mel_sum from (select *, max(mel_sum) over (partition by rec_id) as top from fr) where mel_sum >= 0.75 * top"),
    "variance_report": sql(
        M, CELLS, STATS,
        select="select round(avg(var_pop), 6) as mean_variance, (select string_agg(place::varchar, ',' order by r) from (select place, row_number() over (order by st.var_pop desc, place) as r from st) where r <= 5) as largest, "
        "(select string_agg(place::varchar, ',' order by r) from (select place, row_number() over (order by st.var_pop, place) as r from st where st.var_pop > 1e-12) where r <= 5) as smallest, count(*) filter (where var_pop <= 1e-12) as n_without from st",
    ),
    "flat_dimensions": sql(
        M, "w as (select list_concat([0, 2.5], vec, [-1]) as vec from m)", "c as (select i - 1 as place, vec[i] as x from w cross join range(1, 68) t(i))", "f as (select place from c group by place having var_pop(x) <= 1e-12)",
        select="select string_agg(place::varchar, ',' order by place) as without, count(*) as n_without from f",
    ),
    "diagnostic_warnings": sql(
        M, FRAMES, CELLS, STATS,
        select="select concat_ws('; ', case when (select round(count(*) filter (where rms < 0.005) * 100 / count(*), 2) * 3 from fr) > 40 then 'over 40 % of frames are quiet' end, "
        "case when (select avg(mel_sum) from fr) < 1e-4 then 'band energy is very low' end, case when (select count(*) from st where st.var_pop <= 1e-12) > 0 then (select count(*) from st where st.var_pop <= 1e-12) || ' dimensions without variance' end) as warnings",
    ),
    "column_means": sql(M, CELLS, select="select place, round(avg(x), 6) + 0.0 as x from cells group by place"),
    "dim_stats": sql(M, CELLS, STATS, select="select place, n, " + ", ".join(f"{ROUND.format(c)} as {c}" for c in ("mean", "var", "var_pop", "low", "high")) + " from st"),
    "validate_dims": sql(M, CELLS, HOLED, select="select place, round(avg(case when isfinite(x) then x else 0 end), 6) + 0.0 as mean, round(var_samp(case when isfinite(x) then x else 0 end), 6) + 0.0 as var, bool_and(isfinite(x)) as valid from hl group by place"),
    "top_variance_dims": sql(M, CELLS, STATS, select="select place, round(var, 6) as var from st order by st.var desc, place limit 2"),
    "low_variance_dims": sql(M, CELLS, STATS, select="select place, round(var_pop, 6) as var_pop from st where st.var_pop > 0 order by st.var_pop, place limit 2"),
    "covariance": sql(M, select="select i - 1 as i, j - 1 as j, round(covar_samp(vec[i], vec[j]), 6) + 0.0 as cov from m cross join range(1, 65) a(i) cross join range(1, 65) b(j) where i <= j group by all"),
    "total_variance": sql(M, CELLS, STATS, select="select min(n) as n, round(sum(var), 6) as trace from st"),
    "pca_project_fixed": sql(M, Z, select=_unnested("z", "vec_id", "z", 2)),
    "explained_variance_fixed": sql(
        M, Z, "v as (select i - 1 as component, var_samp(z[i]) as variance from z cross join range(1, 3) t(i) group by i)",
        f"t as (select sum({_d2('vec', _list(MEAN))}) / (count(*) - 1) as total from m)",
        select="select component, round(variance, 6) as variance, round(variance / total, 6) as ratio, round(sum(variance / total) over (order by component), 6) as cumulative from v cross join t",
    ),
    "classify_projected": sql(
        M, Z, "c as (select * from (values (0::bigint, [0.0::double, 0.1::double]), (1, [-0.1::double, 0.0::double]), (2, [0.1::double, -0.1::double])) t(c, cv))",
        select="select vec_id, frame, c as cluster from (select *, row_number() over (partition by vec_id order by (z[1] - cv[1]) ** 2 + (z[2] - cv[2]) ** 2, c) as r from z cross join c where frame / 4 between 1 and 9) where r = 1",
    ),
    "log1p_mel": sql(M, FEAT, select=_unnested(LOGS, "vec_id", "ft", 61)),
    "mel_index_centroid": sql(M, "p as (select vec_id, list_transform(vec, lambda x: greatest(x, 0)) as p from m)", select="select vec_id, round(case when list_sum(p) > 0 then list_sum(list_transform(p, lambda x, i: x * (i - 1))) / list_sum(p) else 32 end, 6) as centroid from p"),
    "mel_sum": sql(M, select="select vec_id, round(list_sum(list_transform(vec, lambda x: greatest(x, 0))), 6) as mel_sum from m"),
    "training_vectors": sql(M, FEAT, select=_unnested(f"list_concat({LOGS}, [rms / greatest(peak, 1e-12), centroid / 16, zcr])", "vec_id", "ft", 64)),
    "serving_vectors": sql(M, FEAT, select=_unnested(f"list_concat({LOGS}, [rms, centroid / 16, zcr])", "vec_id", "ft", 64)),
    "context_stack": sql(
        M, "s as (select rec_id, frame, list_concat(coalesce(lag(vec) over w, list_transform(vec, lambda x: 0.0)), vec, coalesce(lead(vec) over w, list_transform(vec, lambda x: 0.0))) as v from m window w as (partition by rec_id order by frame))", select=_unnested("v", "rec_id, frame", "s", 192)
    ),
    "zscore_all": sql(M, CELLS, STATS, select=ZS.format("true")),
    "zscore_mel": sql(M, CELLS, STATS, select=ZS.format("place < 61")),
    "pre_diagnostics": sql(
        M, FRAMES,
        select="select count(*) as frames, " + ", ".join(f"round({f}({c}), 6) + 0.0 as {c}_{n}" for c in ("rms", "mel_sum") for n, f in (("min", "min"), ("max", "max"), ("mean", "avg"))) + ", "
        + ", ".join(f"round(count(*) filter (where rms < {t}) * 100 / count(*), 2) as under_{f'{t:g}'.replace('.', '_')}" for t in diagnostics.LEVELS) + " from fr",
    ),
    "recording_summary": sql(M, FRAMES, select="select rec_id, count(*) as frames, round(avg(mel_sum), 6) as mel_sum_mean, round(avg(rms), 6) as rms_mean, string_agg(printf('%.2f', time_sec::double), ',' order by frame) filter (where frame < 6) as first_times from fr group by rec_id"),
    "sample_frames": sql(
        M, "n as (select rec_id, count(*) as n from m group by rec_id)",
        select="select rec_id, frame, which from m join n using (rec_id) cross join (values ('first'), ('middle'), ('last')) t(which) where frame = case which when 'first' then 0 when 'middle' then n // 2 else n - 1 end",
    ),
    "nan_inf_count": sql(M, CELLS, HOLED, select="select count(*) as cells, count(*) filter (where isnan(x)) as nan_cells, count(*) filter (where isinf(x)) as infinite_cells, round(count(*) filter (where not isfinite(x)) / count(*) * 100, 6) as invalid_percent from hl"),
    "finite_vectors": sql(M, CELLS, HOLED, select="select vec_id from hl group by vec_id having bool_and(isfinite(x))"),
    "quantile_linear": "select l_returnflag, round(quantile_cont(l_extendedprice, 0.37), 6) as q from lineitem group by l_returnflag",
}

QUERIES = {name: globals()[name] for name in SQL}
