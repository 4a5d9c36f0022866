"""The composed steps against plain versions."""

from __future__ import annotations

import math
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidalframe.operators import cluster, documents, features, pca, training
from tidalframe.plans import composed_queries, matrix_queries

from test_operators import merged_by_steps


@pytest.mark.parametrize("fft,hop,n_mels,n", [(2048, 512, 64, 9000), (16, 8, 4, 700), (64, 64, 8, 63), (8, 12, 3, 100)])
def test_features_equal_numpy(spark, fft, hop, n_mels, n):
    x, rate = np.random.default_rng(5).normal(size=n), 16_000.0
    rows = spark.createDataFrame([(9, i, float(v)) for i, v in enumerate(x)], "rec_id long, idx long, v double").repartition(5)
    got = features.extract(rows, fft, hop, n_mels, rate, block=3).orderBy("frame").collect()
    count = max(0, (n - fft) // hop + 1)
    assert [r["frame"] for r in got] == list(range(count))
    points = 700 * (10 ** (np.linspace(0, 2595 * math.log10(1 + rate / 2 / 700), n_mels + 2) / 2595) - 1)
    for r in got:
        frame = x[r["frame"] * hop :][:fft] * np.hanning(fft)
        mag = np.abs(np.fft.rfft(frame))
        freq = np.arange(fft // 2 + 1) * rate / fft
        mel = [sum(m * np.interp(f, points[k : k + 3], [0, 1, 0]) for f, m in zip(freq, mag)) for k in range(n_mels)]
        assert r["mel"] == pytest.approx(mel, abs=1e-6)
        assert r["rms"] == pytest.approx(math.sqrt((frame**2).mean())) and r["centroid"] == pytest.approx((freq * mag).sum() / mag.sum())
        assert r["zcr"] == sum((a >= 0) != (b >= 0) for a, b in zip(frame, frame[1:])) / fft
        assert r["time_sec"] == pytest.approx(r["frame"] * hop / rate)


def test_features_want_a_power_of_two(spark):
    with pytest.raises(ValueError):
        features.extract(spark.createDataFrame([], "rec_id long, idx long, v double"), 12)


def plain_prepare(frames, pool, rate, o):
    """Recording by recording, as one would write it for lists; vectors are normalised before they are stacked."""
    by = defaultdict(list)
    for f in frames:
        by[f["rec_id"]].append(f)
    top = max(f["rms"] for f in frames)
    out, summary = [], {}
    for rec in pool:
        mine = sorted(by[rec], key=lambda f: f["frame"])
        if not mine:
            continue
        peak = max(f["rms"] for f in mine)
        if peak <= 1e-9:
            summary[rec] = (0, len(mine), 0, 0)
            continue
        sums = [sum(max(0, m) for m in f["mel"]) for f in mine]
        kinds = ["silence" if f["rms"] < o["rms_ratio"] * peak else "speech" for f in mine]
        kinds = [k for a, b, k in merged_by_steps(kinds, {"silence": o["min_silence"], "speech": o["min_speech"]}) for _ in range(a, b + 1)]
        silent = [i for i, k in enumerate(kinds) if k == "silence"]
        keep = math.floor(o["keep_silence"] * len(mine)) if silent else 0
        kept = [silent[math.floor(i * (len(silent) / keep))] for i in range(keep)]
        chosen = sorted([i for i, k in enumerate(kinds) if k == "speech"] + kept)
        chosen = [i for i in dict.fromkeys(chosen) if mine[i]["rms"] >= max(o["rms_ratio"] * top, 0.002) and sums[i] >= 0.02 * (max(sums) or 1)]
        if len(chosen) > o["per_recording"]:
            chosen = [chosen[math.floor(i * (len(chosen) / o["per_recording"]))] for i in range(o["per_recording"])]
        vec = [[math.log1p(max(0, m)) for m in f["mel"]] + [f["rms"] / peak, f["centroid"] / (rate / 2), f["zcr"]] for f in mine]
        zero = [0.0] * len(vec[0])
        for i in chosen:
            out.append((rec, mine[i]["frame"], (vec[i - 1] if i else zero) + vec[i] + (vec[i + 1] if i + 1 < len(vec) else zero)))
        summary[rec] = (kinds.count("speech"), kinds.count("silence"), len(chosen), len(set(kept)))
    x = np.array([v for _, _, v in out])
    z = (x - x.mean(axis=0)) / np.sqrt(np.maximum(x.var(axis=0, ddof=1), 1e-12))
    return {(r, f): v for (r, f, _), v in zip(out, z)}, summary


def test_preparation_equals_the_plain_steps(spark, sf_dir):
    frames = [r.asDict() for r in composed_queries._frames(spark, sf_dir).collect()]
    frames += [{"rec_id": -1, "frame": i, "time_sec": 0.0, "mel": [0.0] * 4, "rms": 0.0, "centroid": 0.0, "zcr": 0.0} for i in range(3)]
    table = spark.createDataFrame(frames, "rec_id long, frame long, time_sec double, mel array<double>, rms double, centroid double, zcr double")
    pool = sorted({f["rec_id"] for f in frames}, reverse=True)
    got = training.prepare(table, spark.createDataFrame(list(enumerate(pool)), "pos long, rec_id long"), 16.0, **composed_queries.PREP)
    want, summary = plain_prepare(frames, pool, 16.0, composed_queries.PREP)
    rows = {(r["rec_id"], r["frame"]): r["vec"] for r in got.rows.collect()}
    assert set(rows) == set(want) and all(rows[k] == pytest.approx(want[k].tolist(), abs=1e-6) for k in want)
    found = {r["rec_id"]: (r["speech_frames"], r["silence_frames"], r["selected_frames"], r["kept_silence_frames"]) for r in got.summary.collect()}
    assert found == summary
    limited = training.prepare(table, spark.createDataFrame(list(enumerate(pool)), "pos long, rec_id long"), 16.0, **composed_queries.PREP, total=7, zscore="")
    order = sorted(want, key=lambda k: (pool.index(k[0]), k[1]))
    assert {(r["rec_id"], r["frame"]) for r in limited.rows.collect()} == set(order[:7]) and limited.scaler is None


def test_components_query_equals_numpy(spark, sf_dir):
    x = np.array([r["vec"] for r in matrix_queries.rows(spark, sf_dir).collect()])
    values, vectors = np.linalg.eigh(np.cov(x.T))
    got = composed_queries.pca_components(spark, sf_dir).collect()
    for c in range(8):
        mine = sorted((r for r in got if r["component"] == c), key=lambda r: r["place"])
        axis = vectors[:, -1 - c] * np.sign(vectors[np.abs(vectors[:, -1 - c]).argmax(), -1 - c])
        assert [r["loading"] for r in mine] == pytest.approx(axis.tolist(), abs=1e-5)
        assert mine[0]["eigenvalue"] == pytest.approx(values[-1 - c], abs=1e-5) and mine[0]["explained"] == pytest.approx(values[-1 - c] / values.sum(), abs=1e-5)


def test_projected_points_are_loud_speech(spark, sf_dir):
    rows = composed_queries._projected(spark, sf_dir).collect()
    assert rows and all(len(r["z"]) == 3 and all(map(math.isfinite, r["z"])) for r in rows)


def test_runs_that_share_passes_equal_single_runs(spark):
    x = np.random.default_rng(3).normal(size=(150, 3))
    df = spark.createDataFrame([(i, row) for i, row in enumerate(x.tolist())], "id long, vec array<double>").repartition(3)
    starts = [cluster.spread_seeds(x, k, s).tolist() for k, s in ((2, 1), (4, 2), (5, 3))] + [[[0.0] * 3, [100.0] * 3]]
    for together, start in zip(cluster.lloyd_all(df, "vec", starts, 6, 1e-4), starts):
        alone = cluster.lloyd(df, "vec", start, 6, 1e-4)
        assert np.allclose(together.centroids, alone.centroids) and together.sizes == alone.sizes and together.iterations == alone.iterations
        assert together.inertia == pytest.approx(alone.inertia)


def test_sweep_measures_equal_numpy(spark, sf_dir):
    x = np.array([r["vec"] for r in matrix_queries.rows(spark, sf_dir).collect()])
    results = defaultdict(list)
    for r in composed_queries.k_sweep(spark, sf_dir).orderBy("K", "cluster").collect():
        results[r["K"]].append(r)
    assert set(results) == {3, 4, 5, 6}
    for k, rows in results.items():
        c = np.array([r["centroid"] for r in rows])
        d2 = ((x[:, None] - c) ** 2).sum(axis=2)
        label = d2.argmin(axis=1)
        # sizes and inertia are of the last assignment (test_training has them exactly); after it centroids hardly move
        assert rows[0]["inertia"] == pytest.approx(d2.min(axis=1).sum(), rel=0.01) and sum(r["n"] for r in rows) == len(x)
        far, s = np.sqrt(((x[:, None] - x) ** 2).sum(axis=2)), []
        for i in range(len(x)):
            mean = [far[i, (label == j) & (np.arange(len(x)) != i)].mean() for j in range(k) if ((label == j) & (np.arange(len(x)) != i)).any() or j == label[i]]
            own = far[i, (label == label[i]) & (np.arange(len(x)) != i)]
            a = own.mean() if own.size else 0.0
            b = min(far[i, label == j].mean() for j in set(label.tolist()) - {label[i]})
            s.append((b - a) / max(a, b, 1e-12))
        assert rows[0]["silhouette"] == pytest.approx(np.mean(s), abs=1e-6)


def test_projected_points_extract_their_frames_once(spark, sf_dir, monkeypatch):
    made, plain = [], features.extract
    monkeypatch.setattr(features, "extract", lambda *a, **k: made.append(1) or plain(*a, **k))
    plan = composed_queries.projected_points(spark, sf_dir)._jdf.queryExecution().toString()
    assert len(made) == 1 and "FlatMapGroupsInArrow" not in plan
    assert "FlatMapGroupsInArrow" not in composed_queries._frames(spark, sf_dir)._jdf.queryExecution().toString()


def test_auto_k_recommends_from_the_sweep(spark, sf_dir):
    picks = composed_queries.auto_k(spark, sf_dir).orderBy("pick").collect()
    sweep = {r["K"]: r["silhouette"] for r in composed_queries.k_sweep(spark, sf_dir).collect()}
    assert picks[0]["K"] == max(sweep, key=lambda k: (sweep[k], -k)) and 1 < len(picks) <= 3
    model = cluster.from_json(training.applied({"K": 2, "centroids": [[0, 1], [2, 3]], "sizes": [1, 2], "inertia": 0.5}))
    assert model.centroids == [[0.0, 1.0], [2.0, 3.0]] and model.sizes == [1, 2]
    with pytest.raises(ValueError):
        cluster.from_json({"k": 3, "dim": 2, "centroids": [[0, 1]]})


def test_models_come_back_from_json(spark):
    x = np.random.default_rng(2).normal(size=(60, 5))
    df = spark.createDataFrame([(i, row) for i, row in enumerate(x.tolist())], "id long, vec array<double>")
    model = pca.fit(pca.gather(df, "vec"), 3)
    model.scaler = ([0.0] * 5, [1.0] * 5)
    again = pca.from_json(pca.to_json(model))
    score = lambda m: [r["z"] for r in df.orderBy("id").select(pca.project("vec", m.mean.tolist(), m.components.tolist()).alias("z")).collect()]
    assert score(again) == score(model) and again.warnings == model.warnings and again.n == 60
    with pytest.raises(ValueError):
        pca.from_json(pca.to_json(model) | {"mean": [0.0]})


def test_backup_import_adds_only_what_is_new(spark):
    rec, ref = "id long, name string, blob binary", "session long, pos long, recording long"
    have = spark.createDataFrame([(1, "a", b"x"), (2, "b", b"y")], rec)
    have_refs = spark.createDataFrame([(10, 0, 1), (10, 1, 2)], ref)
    new = spark.createDataFrame([(1, "c", b"z"), (5, "a", b"x"), (6, "b", b"y"), (7, "e", b"z")], rec)
    new_refs = spark.createDataFrame([(20, 0, 6), (20, 1, 5), (21, 0, 1), (21, 1, 99), (22, 0, 7), (23, 0, 7)], ref)
    added, refs = documents.import_backup(have, have_refs, new, new_refs)
    assert [(r["id"], r["name"], bytes(r["blob"])) for r in added.collect()] == [(8, "c", b"z")]
    # 20 is known under other ids, 23 is 22 again
    assert sorted((r["session"], r["pos"], r["recording"]) for r in refs.collect()) == [(21, 0, 8), (21, 1, 99), (22, 0, 8)]


def test_backup_queries_add_each_content_once(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id is not null").collect()
    contents = {(r["text"] or "") + "!" for r in docs} - {r["text"] for r in docs}
    got = composed_queries.import_backup_recordings(spark, sf_dir).collect()
    assert sorted(r["text"] for r in got) == sorted(contents) and len({r["id"] for r in got}) == len(got)
    refs = composed_queries.import_backup_refs(spark, sf_dir).collect()
    ids = {r["doc_id"] for r in docs}
    by_text = {}
    for r in sorted(docs, key=lambda r: r["doc_id"]):
        by_text.setdefault(r["text"], r["doc_id"])
    text = {r["doc_id"]: r["text"] for r in docs}
    assert refs and all(r["recording"] == (by_text[text[r["recording"]]] if r["recording"] in ids else r["recording"]) for r in refs)


def test_sessions_of_a_backup_meet_hashes_instead_of_bytes(spark):
    recs = spark.createDataFrame([(1, "a", b"x"), (2, None, b"y"), (3, "c", None)], "id long, name string, blob binary")
    refs = spark.createDataFrame([(7, 0, 1), (7, 1, 2), (8, 0, 3)], "session long, pos int, recording long")
    incoming = recs.withColumn("id", F.col("id") + 10)
    other = spark.createDataFrame([(17, 0, 12), (17, 1, 11), (18, 0, 11), (19, 0, 11)], "session long, pos int, recording long")
    found = documents.import_backup(recs, refs, incoming, other)[1]
    assert [tuple(r) for r in found.select("session", "pos", "recording").collect()] == [(18, 0, 1)]
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not [x for x in plan if "Project [" in x and re.search(r"(\[|, )blob#\d+(,|\])", x)]
    entries = refs.join(recs.withColumnRenamed("id", "recording"), "recording").withColumn("date", F.lit("d"))
    assert sorted(map(tuple, documents.fingerprints(documents.marks(entries, "session")).collect())) == sorted(map(tuple, documents.fingerprints(entries).collect()))


def test_trimmed_copies_get_the_next_free_names(spark):
    recs = spark.createDataFrame([(1, "a"), (2, "A trimmed 4"), (3, "b Trimmed"), (9, "c")], "id long, name string")
    cut = spark.createDataFrame([(1, 0, 0.5), (2, 0, 0.25), (3, 0, 1.0), (3, 1, 2.0)], "rec_id long, idx long, v double")
    new, samples = documents.trimmed_copies(recs, cut)
    assert sorted((r["id"], r["name"].lower()) for r in new.collect()) == [(10, "a trimmed 5"), (11, "a trimmed 6"), (12, "b trimmed 2")]
    assert sorted((r["rec_id"], r["idx"], r["v"]) for r in samples.collect()) == [(10, 0, 0.5), (11, 0, 0.25), (12, 0, 1.0), (12, 1, 2.0)]
