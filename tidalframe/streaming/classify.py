"""Streams of vectors classified by whichever model is active."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidalframe.operators import cluster, pca
from tidalframe.sources.tables import ModelStore


def classified(rows: DataFrame, vec: str, body: dict) -> DataFrame:
    """rows with `cluster` by a stored model: scaled as it was trained, projected on its components, and given
    to the nearest centroid in as many of them as the clusters have. Vectors of another width are an error."""
    axes, groups = pca.from_json(body["pca"]), cluster.from_json(body["kmeans"])
    x: Column = F.col(vec)
    if axes.scaler is not None:
        mean, std = (F.array(*[F.lit(float(v)) for v in part]) for part in axes.scaler)
        x = F.zip_with(F.zip_with(x, mean, lambda a, m: a.cast("double") - m), std, lambda a, s: a / s)
    dims = len(groups.centroids[0])
    scored = rows.withColumn("_z", F.slice(pca.project(x, axes.mean.tolist(), axes.components.tolist(), len(axes.mean)), 1, dims))
    return scored.withColumn("cluster", cluster.nearest("_z", groups.centroids)["cluster"]).drop("_z")


class LiveClassifier:
    """A sink for foreachBatch. The store is asked for its active model at every batch, so a model that is
    activated in mid-stream takes over with the next batch, without a restart.

    A batch is written as one folder under its number; if it comes again after a failure it
    replaces what it wrote, and is wholly of one model. Without an active model cluster and
    model are null.
    """

    def __init__(self, store: ModelStore, path: str, vec: str = "vec"):
        self.store, self.path, self.vec = store, path.rstrip("/"), vec

    def __call__(self, batch: DataFrame, number: int) -> None:
        model = self.store.active()
        found = batch.withColumn("cluster", F.lit(None).cast("int")) if model is None else classified(batch, self.vec, self.store.load(model))
        found.withColumn("model", F.lit(model).cast("string")).write.mode("overwrite").parquet(f"{self.path}/batch={number}")
