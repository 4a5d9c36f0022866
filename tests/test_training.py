"""Merged bases, wide components, seeds and redrawn clusters against plain versions."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidalframe.operators import cluster, diagnostics, documents, pca, pca_incremental, sampling
from tidalframe.operators.pca_incremental import Basis, Incremental
from tidalframe.plans import composed_queries, matrix_queries, training_queries

KIND = "id long, vec array<double>"


def frame(spark, x, parts=4):
    return spark.createDataFrame([(i, row) for i, row in enumerate(np.asarray(x).tolist())], KIND).repartition(parts)


def axes_of(x, k):
    values, vectors = np.linalg.eigh(np.atleast_2d(np.cov(x.T)))
    axes = vectors[:, ::-1][:, :k].T
    return values[::-1][:k], axes * np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])[:, None]


def decaying(n, d, seed=0):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n, d)) * 0.8 ** np.arange(d) @ np.linalg.qr(rng.normal(size=(d, d)))[0] + rng.normal(size=d)


@pytest.mark.parametrize("cuts", [[], [1], [1, 2, 3], [100], [7, 50, 51, 200, 299], list(range(1, 300))])
def test_any_split_gives_the_batch_basis(cuts):
    x = decaying(300, 12)
    found = None
    for part in np.split(x, cuts):
        new = Basis.of(part)
        found = new if found is None else found.merged(new)
    values, axes = axes_of(x, 8)
    model = found.model(8)
    assert np.allclose(found.covariance, np.cov(x.T), atol=1e-9) and np.allclose(found.mean, x.mean(axis=0)) and found.n == 300 and len(found.rows) <= 12
    assert np.allclose(model.eigenvalues, values, atol=1e-6) and np.allclose(model.components, axes, atol=1e-6)
    assert np.allclose(model.explained, values / np.trace(np.cov(x.T)))


def test_truncated_bases_keep_the_total_and_find_strong_axes():
    x = decaying(500, 30)
    found = Basis(0, np.zeros(30), np.zeros((0, 30)))
    for part in np.split(x, 10):
        found = found.merged(Basis.of(part, 14), 14)
        assert len(found.rows) <= 14
    values, axes = axes_of(x, 4)
    model = found.model(4)
    assert np.allclose(model.eigenvalues, values, rtol=1e-2) and np.abs((model.components * axes).sum(axis=1)).min() > 0.99
    assert model.explained.sum() == pytest.approx(values.sum() / np.trace(np.cov(x.T)), rel=1e-2)


def test_bases_of_few_empty_and_unfinished_vectors():
    none = Basis(0, np.zeros(3), np.zeros((0, 3)))
    one = Basis.of(np.array([[1.0, np.nan, np.inf]]))
    assert none.merged(one).mean.tolist() == [1.0, 0.0, 0.0] and none.merged(none).n == 0
    assert one.model(3).components.shape == (3, 3) and np.allclose(one.model(3).eigenvalues, 0) and one.model(3).explained.tolist() == [0, 0, 0]
    with pytest.raises(ValueError):
        none.model()


@pytest.mark.parametrize("fan_in", [2, 16])
def test_tasks_merge_in_levels(spark, fan_in):
    x = decaying(400, 10)
    x[5, 3] = np.nan
    found = pca_incremental.gather_basis(frame(spark, x, 11), "vec", fan_in=fan_in, block=17)
    x[5, 3] = 0.0
    assert np.allclose(found.covariance, np.cov(x.T)) and found.n == 400
    assert pca_incremental.gather_basis(frame(spark, x).where("false"), "vec").n == 0


def test_incremental_query_equals_numpy(spark, sf_dir):
    x = np.array([r["vec"] for r in matrix_queries.rows(spark, sf_dir).collect()])
    values, axes = axes_of(x, 8)
    got = np.array([(r["component"], r["place"], r["loading"], r["eigenvalue"]) for r in training_queries.pca_incremental_components(spark, sf_dir).orderBy("component", "place").collect()])
    assert np.allclose(got[:, 2].reshape(8, 64), axes, atol=2e-6) and np.allclose(got[::64, 3], values, atol=2e-6)


def test_wide_query_equals_numpy(spark, sf_dir):
    from tidalframe.operators import normalise

    x = np.array([r["vec"] for r in normalise.context_stack(matrix_queries.rows(spark, sf_dir), "vec", 2).collect()])
    values, axes = axes_of(x, 8)
    got = np.array([(r["loading"], r["eigenvalue"], r["explained"]) for r in training_queries.pca_wide_components(spark, sf_dir).orderBy("component", "place").collect()])
    assert x.shape[1] == 320 and np.allclose(got[:, 0].reshape(8, 320), axes, atol=1e-5) and np.allclose(got[::320, 1], values, atol=2e-6)
    assert np.allclose(got[::320, 2], values / np.trace(np.cov(x.T)), atol=2e-6)


def test_wide_components_are_exact_at_64_and_find_planted_axes_at_5000(spark):
    x = np.random.default_rng(1).normal(size=(300, 64))
    model = pca_incremental.wide_components(frame(spark, x), "vec", 8)
    values, axes = axes_of(x, 8)
    assert np.allclose(model.eigenvalues, values) and np.allclose(model.components, axes, atol=1e-6) and model.n == 300
    rng = np.random.default_rng(2)
    hidden = np.linalg.qr(rng.normal(size=(5000, 3)))[0].T * np.array([[9.0], [6.0], [4.0]])
    wide = rng.normal(size=(60, 3)) @ hidden + rng.normal(size=(60, 5000)) * 0.01
    model = pca_incremental.wide_components(frame(spark, wide), "vec", 3)
    centred = wide - wide.mean(axis=0)
    _, s, v = np.linalg.svd(centred, full_matrices=False)
    assert np.allclose(model.eigenvalues, s[:3] ** 2 / 59) and np.allclose(np.abs((model.components * v[:3]).sum(axis=1)), 1)
    assert model.explained.sum() == pytest.approx((s[:3] ** 2).sum() / (s**2).sum())


def test_wide_components_of_flat_and_missing_data(spark):
    flat = pca_incremental.wide_components(frame(spark, np.ones((5, 4))), "vec", 2)
    assert np.allclose(flat.eigenvalues, 0) and flat.explained.tolist() == [0, 0]
    with pytest.raises(ValueError):
        pca_incremental.wide_components(frame(spark, np.ones((1, 4))).where("false"), "vec")


def test_a_stream_that_stops_and_goes_on_gives_the_batch_components(spark, tmp_path):
    x, source = decaying(240, 9), str(tmp_path / "in")
    model = Incremental(spark, str(tmp_path / "model"))
    for i, part in enumerate(np.split(x, 6)):
        frame(spark, part, 1).write.mode("append").parquet(source)
        if i in (2, 5):  # three files, then a restart with the rest
            stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(source).writeStream
            stream.foreachBatch(lambda rows, batch: model.update(rows, batch) and None).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()
            model = Incremental(spark, str(tmp_path / "model"))
    assert model.basis().n == 240 and np.allclose(model.basis().covariance, np.cov(x.T)) and len(model.versions()) <= 3
    last = model.versions()[-1]
    model.update(frame(spark, np.split(x, 6)[5]), last)  # the batch comes once more
    assert model.basis().n == 240
    assert Incremental(spark, str(tmp_path / "none")).basis() is None
    with pytest.raises(ValueError):
        model.update(frame(spark, np.ones((3, 4))), last + 1)


def test_few_rows_and_degenerate_axes_take_the_batch(spark):
    x = decaying(25, 6)
    few, batch = pca_incremental.train(frame(spark, x), "vec", 3), pca.fit(pca.gather(frame(spark, x), "vec"), 3)
    assert np.allclose(few.components, batch.components) and few.warnings == ["few rows: 25"]
    many = pca_incremental.train(frame(spark, decaying(60, 6)), "vec", 3, rank=5)
    assert (many.components * axes_of(decaying(60, 6), 3)[1]).sum(axis=1).min() > 0.99
    broken = pca.from_json(pca.to_json(batch) | {"components": [[1.0] + [0.0] * 5, [0.0] * 6, [1e-8] * 6]})
    mended = pca_incremental.with_sound_axes(broken, batch)
    assert mended.components is batch.components and mended.warnings[-2:] == ["degenerate components: 2/3", "replaced by the components of all rows"]
    assert pca_incremental.with_sound_axes(batch, batch) is batch


def planted(n=900, k=9, d=4, seed=3):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(k, d)) * 8)[rng.integers(0, k, n)] + rng.normal(size=(n, d)) * 0.3


def cost(x, c):
    return ((x[:, None] - c) ** 2).sum(axis=2).min(axis=1).sum()


def test_seeds_come_from_all_rows_and_are_as_good_as_plain_seeding(spark):
    x = planted()
    x[0] = 500.0  # a row that a small sample would miss
    found = cluster.candidates(frame(spark, x), "vec", "id", 10, runs=4)
    assert len(found) == 4 and all(c.weights.sum() == len(x) and len(c.points) <= 1 + 5 * 20 for c in found)
    assert all((c.points == 500.0).all(axis=1).any() for c in found)
    mine = [cost(x, c.seeds(10, 1)) for c in found]
    plain = [cost(x, cluster.spread_seeds(x, 10, s)) for s in range(8)]
    assert np.median(mine) <= np.median(plain)


def test_seeds_do_not_depend_on_partitions(spark):
    x = planted(200)
    one, other = (cluster.candidates(frame(spark, x, parts), "vec", "id", 4)[0] for parts in (1, 7))
    assert one.points.tolist() == other.points.tolist() and one.weights.tolist() == other.weights.tolist()


def test_seeds_of_repeated_and_few_rows(spark):
    same = cluster.candidates(frame(spark, np.ones((5, 2))), "vec", "id", 3)[0]
    assert same.points.tolist() == [[1.0, 1.0]] and same.seeds(3, 0).tolist() == [[1.0, 1.0]] * 3
    with pytest.raises(ValueError):
        same.seeds(6, 0)
    with pytest.raises(ValueError):
        cluster.candidates(frame(spark, np.ones((1, 2))).where("false"), "vec", "id", 3)[0].seeds(1, 0)


def plain_lloyd(x, c, iterations, tol):
    """Assign, move, draw empty clusters from the farthest different vectors; inertia of the last labels."""
    c, done = np.array(c, float), 0
    while True:
        d2 = ((x[:, None] - c) ** 2).sum(axis=2)
        label, least = d2.argmin(axis=1), d2.min(axis=1)
        far = sorted({(-d, tuple(v)) for d, v in zip(least, x.tolist()) if d > 0})
        new, far = c.copy(), [v for _, v in far]
        for k in range(len(c)):
            if (label == k).any():
                new[k] = x[label == k].mean(axis=0)
            elif far:
                new[k] = far.pop(0)
        moved, c, done = ((new - c) ** 2).sum(), new, done + 1
        if moved < tol or done >= iterations:
            return c, ((x - c[label]) ** 2).sum(), np.bincount(label, minlength=len(c)).tolist(), done


@pytest.mark.parametrize("start", [[[0.0] * 4, [1e3] * 4, [2e3] * 4, [1.0] * 4], [[5.0] * 4] * 3, [[0.0] * 4, [3.0] * 4]])
@pytest.mark.parametrize("iterations", [1, 2, 30])
def test_empty_clusters_are_drawn_from_the_farthest(spark, start, iterations):
    x = np.concatenate((planted(150), planted(150)[:10]))
    got = cluster.lloyd(frame(spark, x), "vec", start, iterations, 1e-4)
    c, inertia, sizes, done = plain_lloyd(x, start, iterations, 1e-4)
    assert np.allclose(got.centroids, c) and got.inertia == pytest.approx(inertia) and got.sizes == sizes and got.iterations == done


def test_a_sweep_gives_the_reference_inertia(spark, sf_dir):
    x = np.array([r["vec"] for r in matrix_queries.rows(spark, sf_dir).orderBy("vec_id").collect()])
    df = matrix_queries.rows(spark, sf_dir)
    best = min(plain_lloyd(x, c.seeds(3, 3000 + i), 6, 1e-4)[1] for i, c in enumerate(cluster.candidates(df, "vec", "vec_id", 3, 2)))
    result = cluster.sweep(df, "vec", "vec_id", 3, 3, 2, 6)[0]
    assert result["inertia"] == pytest.approx(best) and result["n"] == len(x)


def test_one_cluster_for_each_of_equal_vectors(spark):
    got = cluster.lloyd(frame(spark, np.ones((6, 2))), "vec", [[0.0, 0.0], [9.0, 9.0]], 5)
    assert got.centroids == [[1.0, 1.0], [1.0, 1.0]] and got.sizes == [6, 0] and got.inertia == 0


def plain_silhouette(x, label):
    far, out = np.sqrt(((x[:, None] - x) ** 2).sum(axis=2)), []
    for i in range(len(x)):
        own = (label == label[i]) & (np.arange(len(x)) != i)
        others = [far[i, label == c].mean() for c in set(label.tolist()) - {label[i]}]
        if others:
            a = far[i, own].mean() if own.any() else 0.0
            out.append((min(others) - a) / max(a, min(others), 1e-12))
    return np.mean(out) if out else 0.0


@pytest.mark.parametrize("block", [9, 2048])
def test_silhouette_tiles_equal_the_plain_measure(spark, block):
    x = np.concatenate((planted(60, 4), planted(60, 4)[:3] + 1e5))
    label = np.array([0, 1, 7] * 21)
    label[5] = 4  # alone
    df = spark.createDataFrame([(i % 50, int(c), v) for i, (c, v) in enumerate(zip(label, x.tolist()))], "id long, cluster int, vec array<double>").repartition(3)
    assert cluster.silhouette(df, "vec", "id", block=block).first()["silhouette"] == pytest.approx(plain_silhouette(x, label), abs=1e-9)
    assert cluster.silhouette(df.where("cluster = 7"), "vec", "id", block=block).first()["silhouette"] == 0.0
    assert cluster.silhouette(df.where("false"), "vec", "id").first()["silhouette"] == 0.0


def test_silhouette_deals_no_pairs_of_blocks(spark):
    x, label = planted(60, 4), np.arange(60) % 3
    df = spark.createDataFrame([(i, int(c), v) for i, (c, v) in enumerate(zip(label, x.tolist()))], "id long, cluster int, vec array<double>")
    plan = cluster.silhouette(df, "vec", "id", block=9)._jdf.queryExecution().toString()
    assert "Generate" not in plan and "FlatMapGroups" not in plan and "Join" not in plan


def test_silhouettes_of_several_labels_share_their_distances(spark):
    x = planted(50, 4)
    labels = {"a": np.arange(50) % 3, "b": np.arange(50) // 20 * 5, "c": np.zeros(50, int)}
    df = spark.createDataFrame([(i, *(int(c[i]) for c in labels.values()), v) for i, v in enumerate(x.tolist())], "id long, a int, b int, c int, vec array<double>")
    got = cluster.silhouettes(df, "vec", "id", list(labels), block=7).first()["silhouettes"]
    assert got == pytest.approx([plain_silhouette(x, c) for c in labels.values()], abs=1e-9) and got[2] == 0.0


def test_sweep_measures_all_k_in_one_pass(spark, monkeypatch):
    calls, plain = [], cluster.silhouettes
    monkeypatch.setattr(cluster, "silhouettes", lambda *a, **k: calls.append(a[3]) or plain(*a, **k))
    df = frame(spark, planted(40, 3))
    found = cluster.sweep(df, "vec", "id", 2, 4, 1, 4)
    assert len(calls) == 1 and len(calls[0]) == 3
    for r in found:
        assert r["silhouette"] == pytest.approx(cluster.silhouette(cluster.assigned(df, "vec", r["centroids"]), "vec", "id", 1500).first()["silhouette"], abs=1e-12)


def test_number_formats_round_the_exact_value(spark):
    values = [0.0625, 1.125e-15, 0.1125, 921.6 / 8192, 1.005, -1.005, 2.5e10, 9.996, -1e-10, 0.0, -0.0, 1e22, 5e-324, float("nan"), float("inf"), float("-inf"), None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, v double").orderBy("id")
    assert [r[0] for r in df.select(documents.fixed(F.col("v"), 2)).collect()] == ["0.06", "0.00", "0.11", "0.11", "1.00", "-1.00", "25000000000.00", "10.00", "-0.00", "0.00", "0.00", "10000000000000000000000.00", "0.00", "NaN", "Infinity", "-Infinity", None]
    assert [r[0] for r in df.select(documents.fixed(F.col("v"), 3)).limit(1).collect()] == ["0.063"]
    assert [r[0] for r in df.select(documents.exponential(F.col("v"), 2)).collect()] == ["6.25e-2", "1.12e-15", "1.13e-1", "1.13e-1", "1.00e+0", "-1.00e+0", "2.50e+10", "1.00e+1", "-1.00e-10", "0.00e+0", "0.00e+0", "1.00e+22", "4.94e-324", "NaN", "Infinity", "-Infinity", None]


def test_levels_of_loudness_are_the_fixed_ones(spark):
    rows = [(v, 1.0) for v in (0.0005, 0.001, 0.004, 0.005, 0.009, 0.01, 0.015, 0.02, 0.5, 0.6)]
    got = diagnostics.before_training(spark.createDataFrame(rows, "rms double, mel_sum double")).first()
    assert (got["under_0_001"], got["under_0_005"], got["under_0_01"], got["under_0_02"]) == (10.0, 30.0, 50.0, 70.0)
    assert "under_0_002" not in got


def test_sweep_query_reports_its_own_rows(spark, sf_dir):
    rows = composed_queries.k_sweep(spark, sf_dir).collect()
    n = matrix_queries.rows(spark, sf_dir).count()
    assert {r["K"] for r in rows} == {3, 4, 5, 6} and all(sum(r["n"] for r in rows if r["K"] == k) == n for k in (3, 4, 5, 6))


def test_recordings_of_another_width_are_passed_over(spark):
    rows = spark.createDataFrame([(1, 0, [1.0, 2.0]), (1, 1, [1.0, 2.0]), (2, 0, [1.0, 2.0, 3.0]), (3, 0, [5.0, 6.0])], "rec_id int, frame int, mel array<double>")
    pool = spark.createDataFrame([(0, 3), (1, 2), (2, 1)], "pos int, rec_id int")
    assert sorted((r["rec_id"], r["frame"]) for r in sampling.same_width(rows, pool, "mel").collect()) == [(1, 0), (1, 1), (3, 0)]
    wide_first = spark.createDataFrame([(0, 2), (1, 3)], "pos int, rec_id int")
    assert [r["rec_id"] for r in sampling.same_width(rows, wide_first, "mel").collect()] == [2]
