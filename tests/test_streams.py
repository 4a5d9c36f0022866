"""Streams whose model changes, and streams that lose a chunk."""

from __future__ import annotations

import time

import numpy as np

from tidalframe.operators import cluster, pca
from tidalframe.sources.tables import ModelStore
from tidalframe.streaming import classify, frames

KIND = "id long, vec array<double>"


def model(x, centroids, scaler=None):
    axes = pca.Model(x.mean(axis=0), np.eye(3)[:2], np.ones(2), np.ones(2) / 2, len(x), [], scaler)
    return pca.to_json(axes), {"k": len(centroids), "dim": len(centroids[0]), "centroids": centroids, "sizes": [0] * len(centroids), "inertia": 0.0}


def test_a_new_model_takes_over_in_mid_stream(spark, tmp_path):
    x = np.random.default_rng(1).normal(size=(60, 3))
    store, source = ModelStore(spark, str(tmp_path / "models")), str(tmp_path / "in")
    first = store.save("first", *model(x, [[0.0, 0.0], [1.0, 1.0]]))
    second = store.save("second", *model(x, [[-1.0], [1.0], [5.0]], ([0.5] * 3, [2.0] * 3)))

    def arrive(part):
        spark.createDataFrame([(int(i), x[i].tolist()) for i in part], KIND).coalesce(1).write.mode("append").parquet(source)

    arrive(range(20))
    sink = classify.LiveClassifier(store, str(tmp_path / "out"))
    stream = spark.readStream.schema(KIND).parquet(source).writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "log")).start()
    try:
        stream.processAllAvailable()
        store.activate(first)
        arrive(range(20, 40))
        stream.processAllAvailable()
        store.activate(second)
        arrive(range(40, 60))
        stream.processAllAvailable()
    finally:
        stream.stop()
    got = {r["id"]: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert sorted(got) == list(range(60))
    assert {(r["model"], r["cluster"]) for i, r in got.items() if i < 20} == {(None, None)}
    centred = x - x.mean(axis=0)
    scaled = (x - 0.5) / 2 - x.mean(axis=0)
    near = lambda z, c: int(((z - np.array(c)) ** 2).sum(axis=1).argmin())
    assert all((r["model"], r["cluster"]) == (first, near(centred[i, :2], [[0.0, 0.0], [1.0, 1.0]])) for i, r in got.items() if 20 <= i < 40)
    assert all((r["model"], r["cluster"]) == (second, near(scaled[i, :1], [[-1.0], [1.0], [5.0]])) for i, r in got.items() if i >= 40)
    before = sink.store.load(first)
    assert cluster.from_json(before["kmeans"]).centroids == [[0.0, 0.0], [1.0, 1.0]]


def test_a_lost_chunk_ends_with_its_recording(spark, tmp_path):
    chunk, source = [float(i % 5 - 2) for i in range(16)], str(tmp_path / "in")
    kind = "rec_id long, seq long, samples array<double>"
    rows = [(1, 0, chunk), (1, 2, chunk), (1, 3, chunk), (1, 6, chunk), (2, 0, chunk), (2, 1, chunk)]
    spark.createDataFrame(rows, kind).coalesce(1).write.parquet(source)
    out = frames.frame_levels(spark.readStream.schema(kind).parquet(source), 8, 4, idle_ms=1000)
    stream = out.writeStream.format("memory").queryName("levels").outputMode("append").option("checkpointLocation", str(tmp_path / "log")).trigger(processingTime="300 milliseconds").start()
    try:
        until = time.time() + 60
        while time.time() < until and spark.table("levels").where("rec_id = 1").count() < 13:
            time.sleep(0.5)
    finally:
        stream.stop()
    got = sorted((r["rec_id"], r["frame"], round(r["rms"], 9)) for r in spark.table("levels").collect())

    def plain(*runs):
        return [round(float(np.sqrt(np.mean((np.array(x[a : a + 8]) * np.hanning(8)) ** 2))), 9) for x in runs for a in range(0, len(x) - 7, 4)]

    assert got == [(1, f, v) for f, v in enumerate(plain(chunk, chunk * 2, chunk))] + [(2, f, v) for f, v in enumerate(plain(chunk * 2))]
