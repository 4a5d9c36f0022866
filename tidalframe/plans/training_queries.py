"""Training that grows and starts from all rows: merged bases, wide components, redrawn clusters, samples."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tidalframe.operators import cluster, normalise, pca_incremental, ranges, sampling
from tidalframe.plans.adapters import r6, sql, table
from tidalframe.plans.matrix_queries import C0, CENTROIDS, D, M, N0, MEANS, ROUND, _centroids, rows

BATCHES = 5
FAR = [100.0] * D  # no vector is nearest to it


def _merged(spark, sf_dir):
    """Every vector, in batches that come one after the other."""
    found = None
    for batch in range(BATCHES):
        new = pca_incremental.gather_basis(rows(spark, sf_dir).where(F.pmod("vec_id", F.lit(BATCHES)) == batch), "vec")
        found = new if found is None else found.merged(new)
    return found


def incremental_covariance(spark, sf_dir):
    cov = _merged(spark, sf_dir).covariance
    cells = [(i, j, float(cov[i, j])) for i in range(len(cov)) for j in range(i, len(cov))]
    return spark.createDataFrame(cells, "i long, j long, cov double").select("i", "j", r6("cov").alias("cov"))


def _components(spark, model):
    cells = [(c, i, float(x), float(model.eigenvalues[c]), float(model.explained[c])) for c, axis in enumerate(model.components) for i, x in enumerate(axis)]
    out = spark.createDataFrame(cells, "component long, place long, loading double, eigenvalue double, explained double")
    return out.select("component", "place", *[r6(c).alias(c) for c in ("loading", "eigenvalue", "explained")])


def pca_incremental_components(spark, sf_dir):
    return _components(spark, _merged(spark, sf_dir).model(8))


def pca_wide_components(spark, sf_dir):
    """Vectors with their two neighbours on either side: five times as wide."""
    return _components(spark, pca_incremental.wide_components(normalise.context_stack(rows(spark, sf_dir), "vec", 2), "vec", 8))


def farthest_vectors(spark, sf_dir):
    found = cluster.farthest(rows(spark, sf_dir), "vec", {0: np.array(CENTROIDS)}, {0: 20})[0]
    cells = [(p, i, x) for p, v in enumerate(found) for i, x in enumerate(v)]
    return spark.createDataFrame(cells, "nth long, place long, x double").withColumn("x", r6("x"))


def lloyd_redrawn(spark, sf_dir):
    """A step from centroids of which one is empty, and the inertia of its assignment against what it led to."""
    model = cluster.lloyd(rows(spark, sf_dir), "vec", [*CENTROIDS, FAR], iterations=1)
    sizes = spark.createDataFrame([(c, n) for c, n in enumerate(model.sizes)], "cluster long, n long")
    return _centroids(spark, model.centroids).join(sizes, "cluster").select("cluster", "place", "x", "n", r6(F.lit(model.inertia)).alias("inertia"))


def reservoir_sample(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    return sampling.reservoir(items, ["l_returnflag"], ["l_orderkey", "l_linenumber"], 50, 7).select("l_returnflag", "l_orderkey", "l_linenumber")


def weighted_sample(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    return sampling.reservoir(items, ["l_linestatus"], ["l_orderkey", "l_linenumber"], 50, 7, "l_quantity").select("l_linestatus", "l_orderkey", "l_linenumber")


def group_ranks(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_shipdate", "l_orderkey", "l_linenumber")
    out = ranges.ranked(items, ["l_returnflag"], [F.desc("l_shipdate"), "l_orderkey", "l_linenumber"], "place", "n")
    return out.select("l_returnflag", "l_orderkey", "l_linenumber", "place", "n")


def group_quantiles(spark, sf_dir):
    return ranges.quantiles(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", 0.37).select("l_returnflag", "l_linestatus", r6("quantile").alias("quantile"))


QUERIES = {f.__name__: f for f in (incremental_covariance, farthest_vectors, lloyd_redrawn, reservoir_sample, weighted_sample, group_ranks, group_quantiles)}
#: Components have no SQL; tests compare them with numpy's eigenvectors.
COMPOSED = {f.__name__: f for f in (pca_incremental_components, pca_wide_components)}

_DIGEST = "sha256('7:' || l_orderkey || '-' || l_linenumber)"

SQL = {
    "reservoir_sample": f"select l_returnflag, l_orderkey, l_linenumber from lineitem qualify row_number() over (partition by l_returnflag order by {_DIGEST}) <= 50",
    "weighted_sample": f"select l_linestatus, l_orderkey, l_linenumber from lineitem where l_quantity > 0 qualify row_number() over (partition by l_linestatus order by -ln((('0x' || {_DIGEST}[1:13])::bigint + 0.5::double) / 4503599627370496) / l_quantity) <= 50",
    "group_ranks": "select l_returnflag, l_orderkey, l_linenumber, row_number() over (partition by l_returnflag order by l_shipdate desc, l_orderkey, l_linenumber) - 1 as place, count(*) over (partition by l_returnflag) as n from lineitem",
    "group_quantiles": "select l_returnflag, l_linestatus, round(quantile_cont(l_extendedprice, 0.37), 6) as quantile from lineitem group by all",
    "incremental_covariance": sql(
        M, "cells as (select vec_id, i, vec[i] as x from m cross join range(1, 65) t(i))",
        select="select a.i - 1 as i, b.i - 1 as j, round(covar_samp(a.x, b.x), 6) + 0.0 as cov from cells a join cells b on a.vec_id = b.vec_id and a.i <= b.i group by all",
    ),
    "farthest_vectors": sql(M, C0, N0, "f as (select row_number() over (order by d2 desc) - 1 as nth, vec from n0 order by nth limit 20)", select=f"select nth, i - 1 as place, {ROUND.format('vec[i]')} as x from f cross join range(1, 65) t(i)"),
    "lloyd_redrawn": sql(
        M, C0, N0, f"q as ({MEANS.format('n0')})", "z as (select cluster, list(x order by place) as cv, any_value(n) as n from q group by cluster)",
        "e as (select sum(list_sum(list_transform(list_zip(vec, cv), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) as inertia from n0 join z using (cluster))",
        "far as (select vec from n0 order by d2 desc limit 1)",
        "w as (select cluster, cv, n from z union all select 3, vec, 0 from far)",
        select=f"select cluster::bigint as cluster, i - 1 as place, {ROUND.format('cv[i]')} as x, n, round(inertia, 6) as inertia from w cross join e cross join range(1, 65) t(i)",
    ),
}
