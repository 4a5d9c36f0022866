"""Principal components from sums that merge: counts, sums and products of places.

Work on rows is one Arrow pass that leaves a d x d block per task; blocks are added up in
Spark, and only the sum, whose size doesn't depend on the rows, reaches the driver. A
state can be saved, and states of old and new data merge exactly, so training is
incremental without an order of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass
class State:
    """n, sum and sum of products of vectors shifted by `shift` (any vector near the mean keeps digits)."""

    shift: np.ndarray
    n: int
    total: np.ndarray
    products: np.ndarray

    @property
    def mean(self) -> np.ndarray:
        return self.shift + self.total / max(1, self.n)

    @property
    def covariance(self) -> np.ndarray:
        """Sample covariance, over max(1, n - 1)."""
        return (self.products - np.outer(self.total, self.total) / max(1, self.n)) / max(1, self.n - 1)

    def merged(self, other: State) -> State:
        """The state of both data sets."""
        d = other.shift - self.shift
        total = other.total + other.n * d
        products = other.products + np.outer(d, other.total) + np.outer(other.total, d) + other.n * np.outer(d, d)
        return State(self.shift, self.n + other.n, self.total + total, self.products + products)


def gather(rows: DataFrame, vec: str, shift: np.ndarray | None = None) -> State:
    """The state of all rows; non-finite cells count as 0 (as the mean of centred data does)."""
    d = rows.select(F.max(F.size(vec)).alias("d")).first()["d"] or 0
    if shift is None:
        first = rows.select(F.transform(vec, lambda x: x.cast("double")).alias("x")).limit(1).collect()
        shift = np.nan_to_num(np.array(first[0]["x"], float)) if first else np.zeros(d)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, products = 0, np.zeros(d), np.zeros((d, d))
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d)
            x = np.where(np.isfinite(x), x, 0.0) - shift
            n, total, products = n + len(x), total + x.sum(axis=0), products + x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([np.concatenate((total, products.ravel())).tolist()], pa.list_(pa.float64()))], ["n", "sums"])

    parts = rows.where(F.size(vec) == d).select(F.transform(vec, lambda x: x.cast("double")).alias("x")).mapInArrow(partial, "n long, sums array<double>")
    cells = parts.select("n", F.posexplode("sums").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    got = cells.orderBy("i").collect()  # d * (d + 1) numbers
    sums = np.array([r["x"] for r in got]) if got else np.zeros(d * (d + 1))
    return State(shift, got[0]["n"] if got else 0, sums[:d], sums[d:].reshape(d, d))


@dataclass
class Model:
    mean: np.ndarray
    components: np.ndarray  # k x d, rows of length 1
    eigenvalues: np.ndarray
    explained: np.ndarray
    n: int = 0
    warnings: list[str] = field(default_factory=list)
    scaler: tuple[list[float], list[float]] | None = None

    @property
    def cumulative(self) -> np.ndarray:
        return np.cumsum(self.explained)


def fit(state: State, k: int = 8, enough_rows: int = 200) -> Model:
    """The k strongest components; each points where its largest loading is positive."""
    if state.n == 0:
        raise ValueError("no rows to train on")
    values, vectors = np.linalg.eigh(state.covariance)
    order = np.argsort(values)[::-1][: min(k, len(values))]
    values, vectors = np.maximum(values[order], 0), vectors[:, order].T
    signs = np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(axis=1)])
    trace = float(np.trace(state.covariance))
    explained = values / trace if trace > 1e-12 else np.zeros(len(values))
    return Model(state.mean, vectors * signs[:, None], values, explained, state.n, [f"few rows: {state.n}"] if state.n < enough_rows else [])


def project(vec: str | Column, mean: list[float], components: list[list[float]], width: int | None = None) -> Column:
    """(x - mean) . component for each component; non-finite cells of x count as 0. width: raise an error on others."""
    column = F.col(vec) if isinstance(vec, str) else vec
    finite = lambda x: F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x.cast("double"))
    weights = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in components])
    offset = F.array(*[F.lit(float(np.dot(mean, c))) for c in components])
    dot = lambda c: F.aggregate(F.zip_with(column, c, lambda x, w: finite(x) * w), F.lit(0.0), lambda a, x: a + x)
    scores = F.transform(weights, lambda c, i: dot(c) - F.get(offset, i))
    if width is None:
        return scores
    return F.when(F.size(column) == width, scores).otherwise(F.raise_error(F.concat(F.lit(f"a vector of {width} expected, got "), F.size(column).cast("string"))))


def explained_variance(rows: DataFrame, vec: str, mean: list[float], components: list[list[float]]) -> DataFrame:
    """component, variance, ratio, cumulative: of given axes, against the total variance around the given mean."""
    scores = rows.select(F.posexplode(project(vec, mean, components)).alias("component", "z")).groupBy("component").agg(F.var_samp("z").alias("variance"))
    centre = F.array(*[F.lit(float(m)) for m in mean])
    square = F.aggregate(F.zip_with(F.col(vec), centre, lambda x, m: (x.cast("double") - m) * (x.cast("double") - m)), F.lit(0.0), lambda a, x: a + x)
    total = rows.agg((F.sum(square) / F.greatest(F.lit(1), F.count("*") - 1)).alias("total"))
    running = F.sum("ratio").over(Window.orderBy("component").rowsBetween(Window.unboundedPreceding, 0))  # k rows
    return scores.join(F.broadcast(total)).withColumn("ratio", F.when(F.col("total") > 1e-12, F.col("variance") / F.col("total")).otherwise(0.0)).select("component", "variance", "ratio").withColumn("cumulative", running)


def covariance_table(rows: DataFrame, vec: str) -> DataFrame:
    """i, j, cov for i <= j: d (d + 1) / 2 rows, from the merged state of all rows."""
    cov = gather(rows, vec).covariance
    cells = [(i, j, float(cov[i, j])) for i in range(len(cov)) for j in range(i, len(cov))]
    return rows.sparkSession.createDataFrame(cells, "i long, j long, cov double")


def diagnosis(model: Model, degenerate: float = 1e-6) -> dict:
    """Norms, degenerate axes, explained sum and warnings of a model."""
    norms = np.linalg.norm(model.components, axis=1)
    bad = np.flatnonzero(norms < degenerate).tolist()
    total = float(model.explained.sum())
    warnings = list(model.warnings) + [f"degenerate components: {bad}"] * bool(bad) + ["explained variance is near zero"] * (total < 1e-6)
    return {"norm_min": float(norms.min()), "norm_max": float(norms.max()), "norm_mean": float(norms.mean()), "degenerate": bad, "explained_sum": total, "warnings": warnings}


def orthogonal(w: np.ndarray, seed: int = 0) -> np.ndarray:
    """Gram-Schmidt over rows; a row that vanishes is drawn anew."""
    rng, out = np.random.default_rng(seed), []
    for row in np.asarray(w, float):
        for _ in range(50):
            for q in out:
                row = row - (row @ q) * q
            if (norm := np.linalg.norm(row)) > 1e-12:
                break
            row = rng.normal(size=row.size)
        out.append(row / norm)
    return np.array(out)


def to_json(model: Model) -> dict:
    """A model as the store keeps it."""
    arrays = {c: getattr(model, c).tolist() for c in ("mean", "components", "eigenvalues", "explained")}
    return {**arrays, "n": model.n, "warnings": model.warnings, "scaler": model.scaler and [list(x) for x in model.scaler]}


def from_json(body: dict) -> Model:
    """to_json() undone; the model projects as before."""
    mean, components = np.array(body["mean"], float), np.array(body["components"], float)
    if components.ndim != 2 or components.shape[1] != mean.size:
        raise ValueError("components don't fit the mean")
    scaler = body.get("scaler")
    return Model(mean, components, np.array(body["eigenvalues"], float), np.array(body["explained"], float), body.get("n", 0), list(body.get("warnings", [])), scaler and tuple(scaler))


def fit_table(rows: DataFrame, vec: str, k: int = 8) -> DataFrame:
    """component, place, loading, eigenvalue, explained: fit() over all rows; at most k x d rows."""
    m = fit(gather(rows, vec), k)
    cells = [(c, i, float(x), float(m.eigenvalues[c]), float(m.explained[c])) for c, axis in enumerate(m.components) for i, x in enumerate(axis)]
    return rows.sparkSession.createDataFrame(cells, "component long, place long, loading double, eigenvalue double, explained double")
