"""Principal components that grow with the data: bases that merge, and wide vectors without a d x d matrix.

A `Basis` holds a few rows that have the same products as the centred vectors they stand
for. Two bases merge by one QR decomposition of their stacked rows and the step between
their means, so a task folds its rows block by block, tasks merge in levels, and a stream
merges each micro-batch into the stored model. With all rows kept (at most d) a merged
basis is exact whatever the order and the split; with `rank` rows kept it is the best of
that rank, and what was cut off still counts in the total variance.

`wide_components` never forms a product matrix: each pass over the vectors multiplies a
block of d x b numbers, and the axes come from the space of all such blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidalframe.operators.pca import Model, gather
from tidalframe.operators.pca import fit as fit_batch
from tidalframe.sources.work import written


@dataclass
class Basis:
    """n vectors around `mean`; rows.T @ rows are the products of the centred vectors, but for `lost`, the
    squares that were cut off."""

    n: int
    mean: np.ndarray
    rows: np.ndarray
    lost: float = 0.0

    @staticmethod
    def of(x: np.ndarray, rank: int | None = None) -> Basis:
        """Of the vectors themselves; non-finite cells count as 0."""
        x = np.where(np.isfinite(x), x, 0.0)
        mean = x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
        return Basis(len(x), mean, x - mean).cut(rank)

    def cut(self, rank: int | None = None) -> Basis:
        """The same with at most `rank` rows (None: as many as it takes)."""
        rows = np.linalg.qr(self.rows, mode="r") if len(self.rows) > self.mean.size else self.rows
        if rank is None or len(rows) <= rank:
            return Basis(self.n, self.mean, rows, self.lost)
        _, s, v = np.linalg.svd(rows, full_matrices=False)
        return Basis(self.n, self.mean, s[:rank, None] * v[:rank], self.lost + float((s[rank:] ** 2).sum()))

    def merged(self, other: Basis, rank: int | None = None) -> Basis:
        """The basis of both sets of vectors."""
        if not self.n or not other.n:
            return (self if self.n else other).cut(rank)
        n, step = self.n + other.n, other.mean - self.mean
        rows = np.vstack((self.rows, other.rows, np.sqrt(self.n * other.n / n) * step))
        return Basis(n, self.mean + other.n / n * step, rows, self.lost + other.lost).cut(rank)

    @property
    def covariance(self) -> np.ndarray:
        """Sample covariance, of what is kept."""
        return self.rows.T @ self.rows / max(1, self.n - 1)

    def model(self, k: int = 8, enough_rows: int = 200) -> Model:
        """The k strongest components; each points where its largest loading is positive."""
        if not self.n:
            raise ValueError("no rows to train on")
        k = min(k, self.mean.size)
        _, s, v = np.linalg.svd(np.vstack((self.rows, np.zeros((k, self.mean.size)))), full_matrices=True)
        values = (np.pad(s, (0, self.mean.size))[:k] ** 2) / max(1, self.n - 1)
        trace = float((s**2).sum() + self.lost) / max(1, self.n - 1)
        return _model(self.mean, v[:k], values, trace, self.n, enough_rows)


def _model(mean: np.ndarray, axes: np.ndarray, values: np.ndarray, trace: float, n: int, enough_rows: int) -> Model:
    signs = np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])
    explained = values / trace if trace > 1e-12 else np.zeros(len(values))
    return Model(mean, axes * signs[:, None], values, explained, n, [f"few rows: {n}"] if n < enough_rows else [])


PART = "n long, lost double, mean array<double>, rows array<double>"


def _row(b: Basis) -> tuple:
    return b.n, b.lost, b.mean.tolist(), b.rows.ravel().tolist()


def _basis(n: int, lost: float, mean: list[float], rows: list[float]) -> Basis:
    mean = np.array(mean, float)
    return Basis(n, mean, np.array(rows, float).reshape(-1, mean.size) if mean.size else np.zeros((0, 0)), lost)


def gather_basis(rows: DataFrame, vec: str, rank: int | None = None, fan_in: int = 16, block: int = 1024) -> Basis:
    """The basis of all rows. A task leaves at most d (or `rank`) x d numbers; tasks merge in levels of
    `fan_in`, so no task and not the driver holds more bases than that at a time. Vectors of another length
    than the longest take no part."""
    d = rows.select(F.max(F.size(vec)).alias("d")).first()["d"] or 0

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Basis(0, np.zeros(d), np.zeros((0, d)))
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            for a in range(0, len(x), block):
                found = found.merged(Basis.of(x[a : a + block], rank), rank)
        if found.n:
            yield _batch([found])

    def level(group: pa.Table) -> pa.Table:
        found = None
        for r in group.to_pylist():
            b = _basis(r["n"], r["lost"], r["mean"], r["rows"])
            found = b if found is None else found.merged(b, rank)
        return pa.Table.from_batches([_batch([found])])

    numbers = F.transform(vec, lambda x: x.cast("double")).alias("x")
    parts = written(rows.where(F.size(vec) == d).select(numbers).mapInArrow(fold, PART), "bases") if d else rows.sparkSession.createDataFrame([], PART)
    while (n := parts.count()) > fan_in:
        groups = -(-n // fan_in)
        numbered = parts.withColumn("g", F.pmod(F.xxhash64("mean", "n"), F.lit(groups)))
        parts = written(numbered.groupBy("g").applyInArrow(lambda t: level(t.drop_columns(["g"])), PART), "bases")
    found = Basis(0, np.zeros(d), np.zeros((0, d)))
    for r in parts.collect():  # at most fan_in of them
        found = found.merged(_basis(*r), rank)
    return found


def _batch(found: list[Basis]) -> pa.RecordBatch:
    columns = zip(*map(_row, found))
    kinds = (pa.int64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64()))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["n", "lost", "mean", "rows"])


def with_sound_axes(model: Model, batch: Model, degenerate: float = 1e-6) -> Model:
    """The model, or that of the batch with a warning if an axis has no length or no finite number."""
    norms = np.linalg.norm(np.where(np.isfinite(model.components), model.components, 0.0), axis=1)
    bad = np.flatnonzero((norms < degenerate) | ~np.isfinite(model.components).all(axis=1))
    if not bad.size:
        return model
    notes = [*model.warnings, f"degenerate components: {bad.size}/{len(norms)}", "replaced by the components of all rows"]
    return Model(batch.mean, batch.components, batch.eigenvalues, batch.explained, batch.n, notes, model.scaler)


def train(rows: DataFrame, vec: str, k: int = 8, rank: int | None = None, few: int = 30, enough_rows: int = 200) -> Model:
    """k components by merging bases of `rank` rows; of at most `few` rows, by the sums of all of them."""
    found = gather_basis(rows, vec, None if rank is None else max(rank, k))
    if found.n <= few:
        return fit_batch(gather(rows, vec), k, enough_rows)
    return found.model(k, enough_rows)


class Incremental:
    """A basis that is kept in a folder which all machines see, and grows batch by batch.

    Each batch is one written version, named by its number: a batch that comes again after a
    failure is merged into its predecessor again, so it counts once, and a stream that stops
    goes on from the last version. Old versions go after `keep` newer ones.
    """

    VERSION = f"batch long, {PART}"

    def __init__(self, spark: SparkSession, path: str, rank: int | None = None, keep: int = 3):
        self.spark, self.path, self.rank, self.keep = spark, path.rstrip("/"), rank, keep
        self._folder = spark._jvm.org.apache.hadoop.fs.Path(self.path)

    def _store(self):
        return self._folder.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Numbers of the whole versions, ascending."""
        if not self._store().exists(self._folder):
            return []
        names = [str(f.getPath().getName()) for f in self._store().listStatus(self._folder)]
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(int(n[6:]) for n in names if n.startswith("batch=") and self._store().exists(path(f"{self.path}/{n}/_SUCCESS")))

    def basis(self, before: int | None = None) -> Basis | None:
        """The newest version, or the newest before a batch; None if there is none."""
        known = [v for v in self.versions() if before is None or v < before]
        if not known:
            return None
        row = self.spark.read.schema(self.VERSION).parquet(f"{self.path}/batch={known[-1]}").first()
        return _basis(row["n"], row["lost"], row["mean"], row["rows"])

    def update(self, rows: DataFrame, batch: int, vec: str = "vec") -> Basis:
        """Merges a batch; as a stream: writeStream.foreachBatch(model.update)."""
        found, old = gather_basis(rows, vec, self.rank), self.basis(batch)
        if old is not None and found.n and old.mean.size != found.mean.size:
            raise ValueError(f"vectors of {old.mean.size} expected, got {found.mean.size}")
        new = found if old is None else old.merged(found, self.rank) if found.n else old
        self.spark.createDataFrame([(batch, *_row(new))], self.VERSION).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
        for v in self.versions()[: -self.keep]:
            self._store().delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/batch={v}"), True)
        return new


def wide_components(rows: DataFrame, vec: str, k: int = 8, extra: int = 8, passes: int = 40, tol: float = 1e-9, enough_rows: int = 200) -> Model:
    """The k strongest components of wide vectors by block Lanczos passes.

    A pass sends d x (k + extra) numbers to each task and gets as many back, added up in
    Spark; the driver keeps the blocks of all passes and takes the best axes of the space
    they span. It ends when the axes' residuals are below tol times the largest
    eigenvalue, or when the space has all d dimensions, which makes it exact.
    """
    d = rows.select(F.max(F.size(vec)).alias("d")).first()["d"] or 0
    # written once, as every pass reads them
    points = written(rows.where(F.size(vec) == d).select(F.transform(vec, lambda x: x.cast("double")).alias("x")), "points")

    def summed(run) -> np.ndarray:
        """The sum of run(block of vectors) over all blocks, which is one row of numbers a task."""

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                for a in range(0, len(x), 1024):
                    got = run(np.where(np.isfinite(x[a : a + 1024]), x[a : a + 1024], 0.0))
                    total = got if total is None else total + got
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["sums"])

        cells = points.mapInArrow(partial, "sums array<double>").select(F.posexplode("sums").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"))
        return np.array([r["x"] for r in cells.orderBy("i").collect()])  # d x b numbers

    sums = summed(lambda x: np.append(x.sum(axis=0), len(x))) if d else np.zeros(0)
    if not sums.size:
        raise ValueError("no rows to train on")
    n, mean = int(sums[-1]), sums[:-1] / sums[-1]
    trace = float(summed(lambda x: np.array([((x - mean) ** 2).sum()]))[0]) / max(1, n - 1)
    k = min(k, d)
    q = np.linalg.qr(np.random.default_rng(0).normal(size=(d, min(d, k + extra))))[0]
    space, images = np.zeros((d, 0)), np.zeros((d, 0))
    for _ in range(max(1, passes)):
        images = np.hstack((images, (summed(lambda x: (x - mean).T @ ((x - mean) @ q)) / max(1, n - 1)).reshape(d, -1)))
        space = np.hstack((space, q))
        inner = space.T @ images
        values, turns = np.linalg.eigh((inner + inner.T) / 2)
        turns, values = turns[:, ::-1][:, :k], np.maximum(values[::-1][:k], 0.0)
        off = np.linalg.norm(images @ turns - space @ turns * values, axis=0)
        if off.max() <= tol * max(values[0], 1e-300) or space.shape[1] >= d:
            break
        rest = images[:, -q.shape[1] :]
        for _ in range(2):  # twice is enough for orthogonal blocks
            rest = rest - space @ (space.T @ rest)
        u, s, _ = np.linalg.svd(rest, full_matrices=False)
        q = u[:, s > 1e-12 * max(s[0], 1e-300)][:, : d - space.shape[1]] if s[0] > 1e-13 * max(values[0], 1e-300) else u[:, :0]
        if not q.shape[1]:
            break  # the space holds all that the vectors span
    axes = (space @ turns).T
    return _model(mean, axes / np.linalg.norm(axes, axis=1)[:, None], values, trace, n, enough_rows)
