"""K-means and its measures over vector columns.

Centroids are small (k x d) and go into the plan as literals; each Lloyd step is one
grouped aggregate and brings k sums to the driver, so plans don't grow with iterations.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidalframe.sources import files
from tidalframe.sources.work import work_path

Centroids = Sequence[Sequence[float]]


def distance2(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)


def _literal(centroids: Centroids) -> Column:
    return F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in centroids])


def nearest(vec: str, centroids: Centroids, dims: int | None = None) -> Column:
    """struct(d2, cluster) of the nearest centroid; of equally near ones the lowest. dims: only the first places count."""
    column = F.col(vec) if dims is None else F.slice(vec, 1, dims)
    table = _literal([c[:dims] for c in centroids])
    return F.array_min(F.transform(table, lambda c, i: F.struct(distance2(column, c).alias("d2"), i.alias("cluster"))))


def assigned(rows: DataFrame, vec: str, centroids: Centroids, dims: int | None = None) -> DataFrame:
    """rows with `cluster` and `d2`."""
    found = rows.withColumn("_near", nearest(vec, centroids, dims))
    return found.select("*", F.col("_near.cluster").alias("cluster"), F.col("_near.d2").alias("d2")).drop("_near")


def means(labelled: DataFrame, vec: str) -> DataFrame:
    """cluster, dim, mean, size."""
    return labelled.select("cluster", F.posexplode(vec).alias("dim", "x")).groupBy("cluster", "dim").agg(F.avg(F.col("x").cast("double")).alias("mean"), F.count("*").alias("size"))


def step(rows: DataFrame, vec: str, centroids: Centroids) -> list[list[float]]:
    """One Lloyd step; an empty cluster keeps its centroid."""
    out = [list(map(float, c)) for c in centroids]
    for r in means(assigned(rows, vec, centroids), vec).collect():  # k * d numbers
        out[r["cluster"]][r["dim"]] = r["mean"]
    return out


@dataclass
class Model:
    """inertia and sizes are those of the last assignment, inertia against the centroids that it led to."""

    centroids: list[list[float]]
    inertia: float
    sizes: list[int]
    iterations: int


def inertia(rows: DataFrame, vec: str, centroids: Centroids) -> float:
    return rows.agg(F.sum(nearest(vec, centroids)["d2"]).alias("s")).first()["s"] or 0.0


def lloyd(rows: DataFrame, vec: str, centroids: Centroids, iterations: int = 200, tol: float = 1e-4) -> Model:
    """Steps until the centroids together move less than tol (squared) or iterations are used up."""
    return lloyd_all(rows, vec, [centroids], iterations, tol)[0]


def _vectors(rows: DataFrame, vec: str) -> DataFrame:
    return rows.select(F.transform(vec, lambda x: x.cast("double")).alias("x"))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _squares(x: np.ndarray, c: np.ndarray, cells: int = 1 << 22) -> np.ndarray:
    """Squared distances of all x (n x d) from all c (k x d), by differences, a bounded block at a time."""
    step = max(1, cells // max(1, c.size))
    return np.concatenate([((x[a : a + step, None, :] - c) ** 2).sum(axis=2) for a in range(0, len(x), step)]) if len(x) else np.zeros((0, len(c)))


def farthest(rows: DataFrame, vec: str, runs: dict[int, np.ndarray], most: dict[int, int]) -> dict[int, list[list[float]]]:
    """For each run (its centroids) the `most` different vectors that lie farthest from their nearest centroid.

    A task keeps that many of its own; they are ranked by (run) after that, so it is a few rows a task.
    """
    kinds = (pa.int32(), pa.float64(), pa.list_(pa.float64()))

    def far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[float, list[float]]]] = {r: [] for r in runs}
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch)
                for r, c in runs.items():
                    d2 = _squares(x, c).min(axis=1)
                    if d2.size > 4 * most[r]:  # ties at the border stay, they are told apart by their places
                        spot = np.flatnonzero(d2 >= np.partition(d2, -4 * most[r])[-4 * most[r]])
                    else:
                        spot = np.arange(d2.size)
                    seen = {tuple(v): d for d, v in held[r]} | {tuple(x[i].tolist()): float(d2[i]) for i in spot}
                    held[r] = [(d, list(v)) for v, d in sorted(seen.items(), key=lambda e: (-e[1], e[0]))[: most[r]]]
        out = [(r, d, v) for r, pairs in held.items() for d, v in pairs]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 3, kinds)], ["run", "d2", "v"])

    found = _vectors(rows, vec).mapInArrow(far, "run int, d2 double, v array<double>").where("d2 > 0").groupBy("run", "d2", "v").agg(F.lit(1).alias("_"))
    place = F.row_number().over(Window.partitionBy("run").orderBy(F.desc("d2"), "v"))
    out: dict[int, list[list[float]]] = {r: [] for r in runs}
    for row in found.withColumn("place", place).where(F.col("place") <= max(most.values())).orderBy("run", "place").collect():  # at most k a run
        if row["place"] <= most[row["run"]]:
            out[row["run"]].append(row["v"])
    return out


def lloyd_all(rows: DataFrame, vec: str, starts: Sequence[Centroids], iterations: int = 200, tol: float = 1e-4) -> list[Model]:
    """lloyd() from many starts at once: each iteration is one pass for all runs that still move.

    A task leaves a row of sums per run and cluster; Spark adds them up, and only
    runs x clusters rows reach the driver. Empty clusters are drawn anew from the vectors
    farthest from their centroids, the farthest first; if there are none, they stay. The
    inertia against moved centroids follows from the sums, without another pass.
    """
    now = [np.array(c, float) for c in starts]
    points, shared = _vectors(rows, vec), rows.sparkSession.sparkContext

    def sums(runs: list[int]) -> dict[tuple[int, int], tuple[int, float, np.ndarray]]:
        sent = shared.broadcast({r: now[r] for r in runs})

        def partial(batches):
            total: dict = {}
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = _matrix(batch)
                for r, c in sent.value.items():
                    d2 = _squares(x, c)
                    label, least = d2.argmin(axis=1), d2.min(axis=1)
                    for k in range(len(c)):
                        mine = label == k
                        n, s, v = total.get((r, k), (0, 0.0, 0.0))
                        # steps from the centroid instead of sums keep digits
                        total[r, k] = n + int(mine.sum()), s + float(least[mine].sum()), v + (x[mine] - c[k]).sum(axis=0)
            out = [(r, k, n, s, np.asarray(v, float).tolist()) for (r, k), (n, s, v) in total.items()]
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 5, kinds)], ["run", "cluster", "n", "d2", "v"])

        parts = points.mapInArrow(partial, "run int, cluster int, n long, d2 double, v array<double>")
        cells = parts.select("run", "cluster", "n", "d2", F.posexplode("v").alias("dim", "x")).groupBy("run", "cluster", "dim").agg(F.sum("n").alias("n"), F.sum("d2").alias("d2"), F.sum("x").alias("x"))
        found: dict = {}
        for r in cells.collect():  # runs x clusters x dimensions numbers
            _, _, v = found.setdefault((r["run"], r["cluster"]), [r["n"], r["d2"], np.zeros(now[r["run"]].shape[1])])
            v[r["dim"]] = r["x"]
        return found

    moving, done, models = list(range(len(now))), 0, [Model(c.tolist(), 0.0, [0] * len(c), 0) for c in now]
    while moving:
        found, still = sums(moving), []
        cell = lambda r, k: found.get((r, k), (0, 0.0, None))
        bare = {r: sum(cell(r, k)[0] == 0 for k in range(len(now[r]))) for r in moving}
        drawn = farthest(rows, vec, {r: now[r] for r in moving if bare[r]}, {r: m for r, m in bare.items() if m}) if any(bare.values()) and done < iterations else {}
        for r in moving:
            new, total, sizes = now[r].copy(), 0.0, []
            for k in range(len(new)):
                n, d2, v = cell(r, k)
                sizes.append(n)
                if n and done < iterations:
                    new[k] += v / n
                    total += max(0.0, d2 - float(v @ v) / n)
                elif n:
                    total += d2
                elif drawn.get(r):
                    new[k] = drawn[r].pop(0)
            moved, now[r] = float(((new - now[r]) ** 2).sum()), new
            models[r] = Model(new.tolist(), total, sizes, min(done + 1, iterations))
            if moved >= tol and done + 1 < iterations:
                still.append(r)
        moving, done = still, done + 1
    return models


def spread_seeds(points: np.ndarray, k: int, seed: int, weights: np.ndarray | None = None) -> np.ndarray:
    """k-means++ over points held by the driver, which may count several times; k may not exceed the points."""
    if len(points) < k:
        raise ValueError(f"{len(points)} points can't seed {k} clusters")
    rng, w = np.random.default_rng(seed), np.ones(len(points)) if weights is None else weights
    draw = lambda p: min(int(np.searchsorted(np.cumsum(p), rng.random() * p.sum(), side="right")), len(points) - 1)
    chosen = [draw(w)]
    d2 = ((points - points[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < k:
        pick = draw(w * d2) if (w * d2).sum() > 0 else int(rng.integers(len(points)))
        chosen.append(pick)
        d2 = np.minimum(d2, ((points - points[pick]) ** 2).sum(axis=1))
    return points[chosen]


@dataclass
class Candidates:
    """Vectors that stand for all rows when clusters are seeded: each counts for the rows nearest to it."""

    points: np.ndarray
    weights: np.ndarray

    def seeds(self, k: int, seed: int, rounds: int = 10) -> np.ndarray:
        """k starts: weighted k-means++ over the candidates, then weighted Lloyd rounds over them."""
        if self.weights.sum() < k:
            raise ValueError(f"{int(self.weights.sum())} points can't seed {k} clusters")
        if len(self.points) < k:  # fewer different rows than clusters: some are taken twice
            return self.points[np.arange(k) % len(self.points)]
        c = spread_seeds(self.points, k, seed, self.weights)
        for _ in range(rounds):
            label = _squares(self.points, c).argmin(axis=1)
            n = np.bincount(label, self.weights, k)
            sums = np.stack([np.bincount(label, self.weights * x, k) for x in self.points.T], axis=1)
            c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        return c


def candidates(rows: DataFrame, vec: str, key: str, k: int, runs: int = 1, rounds: int = 5, oversample: float = 2.0, seed: int = 0) -> list[Candidates]:
    """Candidates of `runs` independent draws, from all rows, for up to k clusters.

    The first is the row with the smallest hash. Each round adds oversample * k rows, drawn
    without repeats in proportion to their squared distance from the candidates so far: every
    row has an exponential number over that distance, made from a hash of its key, and the
    smallest go. A task keeps that many of its own, all runs share their passes, and one more
    pass counts the rows nearest to each candidate. A null key is a key of its own.
    """
    spark, most = rows.sparkSession, max(1, round(oversample * k))
    hashes = F.array(*[F.xxhash64(F.lit(seed), F.lit(run), F.lit(r), F.coalesce(F.col(key).cast("string"), F.lit(""))) for run in range(runs) for r in range(rounds + 1)])
    points = rows.select(hashes.alias("h"), F.transform(vec, lambda x: x.cast("double")).alias("x"))
    chosen: list[list[list[float]]] = [[] for _ in range(runs)]
    kinds = (pa.int32(), pa.float64(), pa.list_(pa.float64()))

    for at in range(rounds + 1):
        sent = spark.sparkContext.broadcast([np.array(c, float) for c in chosen])

        def draw(batches: Iterator[pa.RecordBatch], at: int = at) -> Iterator[pa.RecordBatch]:
            held: list[list[tuple[float, tuple]]] = [[] for _ in range(runs)]
            limit = 1 if at == 0 else most
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = _matrix(batch)
                drawn = batch.column("h").flatten().to_numpy().reshape(batch.num_rows, runs, rounds + 1)[:, :, at]
                uniform = (drawn.astype(np.uint64) >> np.uint64(11)).astype(float) / 2.0**53
                for run in range(runs):
                    if at == 0:
                        number = uniform[:, run]
                    else:
                        d2 = _squares(x, sent.value[run]).min(axis=1)
                        with np.errstate(divide="ignore"):
                            number = np.where(d2 > 0, -np.log1p(-uniform[:, run]) / d2, np.inf)
                    spot = np.flatnonzero(np.isfinite(number))
                    if spot.size > limit:
                        spot = spot[number[spot] <= np.partition(number[spot], limit - 1)[limit - 1]]
                    held[run] = sorted([*held[run], *((float(number[i]), tuple(x[i].tolist())) for i in spot)])[:limit]
            out = [(run, number, v) for run, pairs in enumerate(held) for number, v in pairs]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(list(zip(*out)) or [()] * 3, kinds)], ["run", "number", "v"])

        place = F.row_number().over(Window.partitionBy("run").orderBy("number", "v"))
        found = points.mapInArrow(draw, "run int, number double, v array<double>").withColumn("place", place)
        for r in found.where(F.col("place") <= (1 if at == 0 else most)).orderBy("run", "place").collect():  # runs x most rows
            if r["v"] not in chosen[r["run"]]:
                chosen[r["run"]].append(r["v"])
    if not chosen[0]:
        return [Candidates(np.zeros((0, 0)), np.zeros(0)) for _ in range(runs)]
    counted = lloyd_all(rows, vec, chosen, iterations=0)
    return [Candidates(np.array(c, float), np.array(m.sizes, float)) for c, m in zip(chosen, counted)]


def sweep(rows: DataFrame, vec: str, key: str, k_min: int = 2, k_max: int = 8, n_init: int = 5, iterations: int = 200, tol: float = 1e-4, sample: int | None = 1500) -> list[dict]:
    """For each K the best of n_init runs by inertia (the first of equals), with silhouette, CH and DB.

    All runs share their passes; the i-th run of every K is seeded from the i-th draw of
    candidates. sample: rows that the silhouette takes, None for all.
    """
    stand, out = candidates(rows, vec, key, k_max, n_init), []
    n = int(stand[0].weights.sum()) if stand else 0
    every = [(k, stand[i].seeds(k, 1000 * k + i).tolist()) for k in range(max(2, k_min), min(k_max, n) + 1) for i in range(n_init)]
    models = lloyd_all(rows, vec, [start for _, start in every], iterations, tol)
    chosen = {k: min((m for (at, _), m in zip(every, models) if at == k), key=lambda m: m.inertia) for k in dict.fromkeys(k for k, _ in every)}
    if not chosen:
        return out
    marked = rows.select(key, vec, *[nearest(vec, m.centroids)["cluster"].alias(f"_{k}") for k, m in chosen.items()])
    shapes = silhouettes(marked, vec, key, [f"_{k}" for k in chosen], sample).first()["silhouettes"]
    for (k, best), shape in zip(chosen.items(), shapes):
        labelled = assigned(rows, vec, best.centroids)
        out.append(
            {
                "K": k,
                "inertia": best.inertia,
                "silhouette": shape,
                "ch": calinski_harabasz(labelled, vec, best.centroids).first()["ch"],
                "db": davies_bouldin(labelled, vec, best.centroids).first()["db"],
                "centroids": best.centroids,
                "sizes": best.sizes,
                "n": sum(best.sizes),
            }
        )
    return out


def first_rows_kmeans(rows: DataFrame, vec: str, order: list[str], k: int) -> tuple[DataFrame, Centroids]:
    """Compatibility mode of online training: rows are labelled by the nearest of the first k
    rows, and centroids are their groups' means: one pass, whatever the number of epochs, as
    later epochs only count the same rows again. -> labelled rows, the k seeds."""
    seeds = [list(map(float, r[vec])) for r in rows.orderBy(*order).limit(k).collect()]
    if len(seeds) < k:
        raise ValueError(f"{len(seeds)} rows for {k} clusters")
    return assigned(rows, vec, seeds), seeds


def sizes(labelled: DataFrame, k: int) -> DataFrame:
    """cluster, n for every cluster, empty ones too."""
    every = labelled.sparkSession.range(k).select(F.col("id").cast("int").alias("cluster"))
    return every.join(labelled.groupBy("cluster").agg(F.count("*").alias("n")), "cluster", "left").select("cluster", F.coalesce("n", F.lit(0)).alias("n"))


def pivot(labelled: DataFrame, k: int) -> DataFrame:
    """rec_id, c0..c(k-1): rows of each recording per cluster."""
    return labelled.groupBy("rec_id").agg(*[F.count_if(F.col("cluster") == c).alias(f"c{c}") for c in range(k)])


def calinski_harabasz(labelled: DataFrame, vec: str, centroids: Centroids) -> DataFrame:
    """ch = B (n - k) / (W (k - 1)); 0 if W is 0, k is 1 or n is k."""
    k = len(centroids)
    mean = labelled.select(F.posexplode(vec).alias("dim", "x")).groupBy("dim").agg(F.avg(F.col("x").cast("double")).alias("m"))
    mean = mean.agg(F.expr("transform(array_sort(collect_list(struct(dim, m))), s -> s.m)").alias("mean"))
    counts = labelled.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("d2").alias("w"))
    between = distance2(F.element_at(_literal(centroids), F.col("cluster") + 1), F.col("mean"))
    sums = counts.join(F.broadcast(mean)).agg(F.sum(F.col("n") * between).alias("b"), F.sum("w").alias("w"), F.sum("n").alias("n"))
    flat = (F.col("w") == 0) | (F.lit(k) == 1) | (F.col("n") == k)
    return sums.select(F.when(flat, 0.0).otherwise(F.try_divide(F.col("b") * (F.col("n") - k), F.col("w") * max(1, k - 1))).alias("ch"))


def davies_bouldin(labelled: DataFrame, vec: str, centroids: Centroids) -> DataFrame:
    """db = mean over clusters of the worst (S_i + S_j) / d_ij, S the mean distance to the centroid; d_ij = 0 is passed over."""
    spark, k = labelled.sparkSession, len(centroids)
    c = np.array(centroids, float)
    pairs = [(i, j, float(np.sqrt(((c[i] - c[j]) ** 2).sum()))) for i in range(k) for j in range(k) if i != j]
    spread = sizes(labelled, k).select("cluster").join(labelled.groupBy("cluster").agg(F.avg(F.sqrt("d2")).alias("s")), "cluster", "left").select("cluster", F.coalesce("s", F.lit(0.0)).alias("s"))
    gaps = spark.createDataFrame([p for p in pairs if p[2] > 0] or [(0, 0, 1.0)], "i int, j int, d double").where("i <> j")
    a, b = spread.select(F.col("cluster").alias("i"), F.col("s").alias("si")), spread.select(F.col("cluster").alias("j"), F.col("s").alias("sj"))
    worst = gaps.join(a, "i").join(b, "j").groupBy("i").agg(F.max((F.col("si") + F.col("sj")) / F.col("d")).alias("r"))
    return worst.agg((F.coalesce(F.sum("r"), F.lit(0.0)) / k).alias("db"))


def silhouette(labelled: DataFrame, vec: str, key: str, limit: int | None = None, block: int = 2048) -> DataFrame:
    """Mean silhouette (plain Euclidean) of all rows, or of a repeatable sample of at most `limit`."""
    return silhouettes(labelled, vec, key, ["cluster"], limit, block).select(F.col("silhouettes")[0].alias("silhouette"))


def silhouettes(labelled: DataFrame, vec: str, key: str, labels: list[str], limit: int | None = None, block: int = 2048) -> DataFrame:
    """silhouettes: for each of the label columns the mean silhouette of the rows; distances are measured once for all.

    A single member has a = 0; without another cluster a point is passed over. The rows are
    written once. A task holds a few blocks of about `block` of them and reads the whole table
    past them, a batch at a time, so its sums are complete when the table ends: work is
    quadratic in the rows, but each is shuffled once, and no pairs or partial sums are.
    """
    spark = labelled.sparkSession
    points = labelled.select(F.col(key).alias("key"), F.array(*[F.col(c).cast("int") for c in labels]).alias("clusters"), F.transform(vec, lambda x: x.cast("double")).alias("v"))
    if limit is not None:
        points = points.orderBy(F.xxhash64(F.lit(0), F.col("key")), "key").limit(limit)
    path = work_path(spark, "points")
    points.select(F.monotonically_increasing_id().alias("row"), "clusters", "v").write.parquet(path)
    points = spark.read.schema("row long, clusters array<int>, v array<double>").parquet(path)
    counts = points.select(F.posexplode("clusters").alias("run", "cluster")).groupBy("run", "cluster").agg(F.count("*").alias("n")).orderBy("run", "cluster").collect()  # k numbers a run
    members = [{r["cluster"]: r["n"] for r in counts if r["run"] == i} for i in range(len(labels))]
    n = sum(members[0].values())
    if not n:
        return spark.createDataFrame([([0.0] * len(labels),)], "silhouettes array<double>")
    ends = np.cumsum([0, *map(len, members)])  # a run's clusters are columns of one matrix
    found = files.listed(path, ".parquet")

    def read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return batch.column("row").to_numpy(), batch.column("clusters").flatten().to_numpy().reshape(batch.num_rows, -1), batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1)

    def columns(clusters: np.ndarray) -> np.ndarray:
        """Each row's column in every run."""
        return np.stack([ends[i] + np.searchsorted(list(m), clusters[:, i]) for i, m in enumerate(members)], axis=1)

    def table() -> Iterator[tuple[np.ndarray, ...]]:
        store = files.opened(path)[0]
        for name, _ in found:
            with store.open_input_file(name) as source:
                for batch in pq.ParquetFile(source).iter_batches(batch_size=block):
                    row, clusters, z = read(batch)
                    mark = np.zeros((len(row), ends[-1]))
                    mark[np.arange(len(row))[:, None], columns(clusters)] = 1
                    order = np.argsort(row)
                    yield row[order], mark[order], z[order]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [read(b) for b in batches if b.num_rows]
        row, clusters, x = map(np.concatenate, zip(*held)) if held else ((),) * 3
        own, sums = columns(clusters) if held else (), np.zeros((len(row), ends[-1]))
        slices = [slice(at, at + min(block, 1024)) for at in range(0, len(row), min(block, 1024))]
        centres = [x[part].mean(axis=0) for part in slices]  # near the points, products keep their digits
        for there, mark, z in table() if held else ():
            for part, centre in zip(slices, centres):
                a, b = x[part] - centre, z - centre
                d = a @ (-2 * b).T
                d += (a**2).sum(axis=1)[:, None]
                d += (b**2).sum(axis=1)
                spot = np.minimum(np.searchsorted(there, row[part]), len(there) - 1)
                self = np.flatnonzero(there[spot] == row[part])
                d[self, spot[self]] = 0.0
                sums[part] += np.sqrt(np.maximum(d, 0.0, out=d), out=d) @ mark
        out = []
        for i, m in enumerate(members):
            size, mine = np.array(list(m.values())), np.arange(ends[i], ends[i + 1]) == (own[:, i, None] if held else np.zeros((0, 1)))
            if len(m) > 1:
                of = sums[:, ends[i] : ends[i + 1]]
                near = np.where(mine, of / np.maximum(size - 1, 1), 0.0).sum(axis=1)
                far = np.where(mine, np.inf, of / size).min(axis=1)
                out.append((far - near) / np.maximum(np.maximum(near, far), 1e-12))
            else:
                out.append(np.full(len(row), None))
        yield pa.RecordBatch.from_arrays([pa.array(list(map(list, zip(*out))), pa.list_(pa.float64()))], ["s"])

    tasks = -(-n // max(block, min(4 * block, n // (2 * spark.sparkContext.defaultParallelism))))
    each = points.repartition(tasks).mapInArrow(measure, "s array<double>")
    return each.agg(F.array(*[F.coalesce(F.avg(F.col("s")[i]), F.lit(0.0)) for i in range(len(labels))]).alias("silhouettes"))


def elbow_by_bend(results: DataFrame) -> DataFrame:
    """K with the largest second difference of inertia, the first such; with under three rows the first K."""
    w = Window.orderBy("K")  # one row per K
    bend = F.lag("inertia").over(w) - 2 * F.col("inertia") + F.lead("inertia").over(w)
    rows = results.select("K", bend.alias("bend"))
    return rows.agg(F.min_by("K", F.struct(F.col("bend").isNull(), -F.col("bend"), "K")).alias("K"))


def elbow_by_chord(results: DataFrame) -> DataFrame:
    """K farthest from the line through the first and last (K, inertia); null with under three rows."""
    ends = results.agg(F.min_by(F.struct("K", "inertia"), "K").alias("a"), F.max_by(F.struct("K", "inertia"), "K").alias("z"), F.count("*").alias("n"))
    rows = results.join(F.broadcast(ends)).where((F.col("K") != F.col("a.K")) & (F.col("K") != F.col("z.K")) & (F.col("n") >= 3))
    dx, dy = F.col("z.K") - F.col("a.K"), F.col("z.inertia") - F.col("a.inertia")
    off = F.abs((F.col("K") - F.col("a.K")) * dy - (F.col("inertia") - F.col("a.inertia")) * dx) / F.sqrt(dx * dx + dy * dy)
    return rows.agg(F.min_by("K", F.struct(-off, F.col("K"))).alias("K"))


def recommended(results: DataFrame, elbow: str = "chord") -> DataFrame:
    """At most three K with their order: the best silhouette; the best of those at least 2 away
    from it, else the second best; the elbow (by "chord" or "bend") if it is new; then by
    silhouette. Ties go to the lower K."""
    w = Window.orderBy(F.desc("silhouette"), "K")
    ranked = results.select("K", "silhouette", F.row_number().over(w).alias("r"))
    first = F.broadcast(ranked.where("r = 1").select(F.col("K").alias("k1")))
    far = ranked.join(first).where("r > 1").withColumn("near", F.abs(F.col("K") - F.col("k1")) < 2)
    second = far.agg(F.min_by("K", F.struct("near", "r")).alias("k2"))
    third = (elbow_by_chord if elbow == "chord" else elbow_by_bend)(results).withColumnRenamed("K", "k3")
    rows = ranked.join(F.broadcast(second)).join(F.broadcast(third))
    place = F.when(F.col("r") == 1, 1).when(F.col("K") == F.col("k2"), 2).when(F.col("K") == F.col("k3"), 3).otherwise(4)
    return rows.withColumn("pick", F.row_number().over(Window.orderBy(place, "r"))).where("pick <= 3").select("pick", "K", "silhouette")


def bounding_box(points: DataFrame, x: str, y: str) -> DataFrame:
    """One row: x_low, x_high, y_low, y_high of the finite points; a side without extent is from -1 to 1."""
    good = points.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y) & (F.abs(x) < float("inf")) & (F.abs(y) < float("inf")))
    b = good.agg(*[f(c).alias(f"{c}{n}") for c in (x, y) for n, f in (("_a", F.min), ("_z", F.max))])
    side = lambda c: F.coalesce(F.col(f"{c}_a") == F.col(f"{c}_z"), F.lit(True))
    return b.select(*[F.when(side(c), v).otherwise(F.col(f"{c}{n}")).alias(f"{name}{end}") for c, name in ((x, "x"), (y, "y")) for n, end, v in (("_a", "_low", -1.0), ("_z", "_high", 1.0))])


def from_json(body: dict) -> Model:
    """A model as the store keeps it, ready for assigned()."""
    centroids = [list(map(float, c)) for c in body["centroids"]]
    if any(len(c) != body["dim"] for c in centroids) or len(centroids) != body["k"]:
        raise ValueError("centroids don't fit k and dim")
    return Model(centroids, float(body.get("inertia", 0.0)), list(body.get("sizes", [0] * len(centroids))), 0)
