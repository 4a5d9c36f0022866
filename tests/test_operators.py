from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidalframe import config
from tidalframe.operators import cluster, documents, pca, sampling, segments, signals
from tidalframe.sources import tables, wav
from tidalframe.streaming import frames as streams


def merged_by_steps(kinds, least):
    """Runs, the leftmost short one absorbed by its predecessor, else by its successor, until none is short."""
    runs = []
    for i, k in enumerate(kinds):
        if runs and runs[-1][2] == k:
            runs[-1][1] = i
        else:
            runs.append([i, i, k])
    while len(runs) > 1:
        short = next((i for i, (a, b, k) in enumerate(runs) if b - a + 1 < least[k]), None)
        if short is None:
            break
        if short:
            runs[short - 1][1] = runs[short][1]
        else:
            runs[1][0] = runs[0][0]
        del runs[short]
    return [tuple(r) for r in runs]


def test_segmentation_equals_the_stepwise_rule(spark):
    rng, rows, want = random.Random(8), [], {}
    for rec in range(150):
        kinds, n = [], rng.randint(1, 40)
        while len(kinds) < n:
            kinds += [rng.choice(["silence", "speech"])] * rng.randint(1, 7)
        kinds = kinds[:n]
        rows += [(rec, i, 1.0 if k == "speech" else 0.01) for i, k in enumerate(kinds)]
        if "speech" in kinds:
            want[rec] = merged_by_steps(kinds, {"silence": 5, "speech": 3})
    df = spark.createDataFrame(rows, "rec_id long, frame long, rms double")
    got = {}
    for r in segments.segments(segments.labelled(df, 0.5, 5, 3)).orderBy("start_frame").collect():
        got.setdefault(r["rec_id"], []).append((r["start_frame"], r["end_frame"], r["type"]))
    assert {rec: got[rec] for rec in want} == want
    assert all(s[0][0] == 0 and all(a[1] + 1 == b[0] for a, b in zip(s, s[1:])) for s in got.values())


@pytest.mark.parametrize("n,count", [(0, 0), (15, 0), (16, 1), (23, 1), (24, 2)])
def test_frame_counts(spark, n, count):
    rows = spark.createDataFrame([(1, i, float(i)) for i in range(n)], "rec_id long, idx long, v double")
    assert signals.frames(rows, 16, 8).select("frame").distinct().count() == count


def test_spectrum_equals_numpy(spark):
    x = np.random.default_rng(1).normal(size=64)
    rows = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "rec_id long, idx long, v double")
    got = {(r["frame"], r["bin"]): r["mag"] for r in signals.spectrum(signals.frames(rows, 16, 8), 16).collect()}
    for f in range(7):
        want = np.abs(np.fft.rfft(x[8 * f : 8 * f + 16] * np.hanning(16)))
        assert [got[f, b] for b in range(9)] == pytest.approx(want.tolist(), abs=1e-9)


def test_components_equal_numpy_and_merge(spark):
    x = np.random.default_rng(2).normal(size=(300, 6)) @ np.diag([5, 4, 3, 2, 1, 0.5]) + 1000
    df = spark.createDataFrame([(i, row) for i, row in enumerate(x.tolist())], "id long, vec array<double>")
    state = pca.gather(df, "vec")
    assert state.covariance == pytest.approx(np.cov(x.T), abs=1e-8)
    model = pca.fit(state, 3)
    values = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    assert model.eigenvalues == pytest.approx(values[:3]) and model.explained.sum() <= 1
    halves = [pca.gather(df.where(f"id % 2 = {i}"), "vec") for i in (0, 1)]
    assert halves[0].merged(halves[1]).covariance == pytest.approx(state.covariance, abs=1e-6)
    scores = np.array([r["z"] for r in df.orderBy("id").select(pca.project("vec", model.mean.tolist(), model.components.tolist()).alias("z")).collect()])
    assert scores.mean(axis=0) == pytest.approx(0, abs=1e-8)
    assert np.abs(pca.orthogonal(np.ones((3, 4))) @ pca.orthogonal(np.ones((3, 4))).T - np.eye(3)).max() < 1e-9


def test_lloyd_never_gets_worse(spark):
    x = np.random.default_rng(3).normal(size=(120, 3))
    df = spark.createDataFrame([(i, row) for i, row in enumerate(x.tolist())], "id long, vec array<double>").cache()
    seeds = cluster.spread_seeds(x, 4, 1).tolist()
    steps = [cluster.lloyd(df, "vec", seeds, i, 0.0).inertia for i in range(4)]
    assert steps == sorted(steps, reverse=True)
    best = cluster.sweep(df, "vec", "id", 2, 3, n_init=1, iterations=3)
    assert [r["K"] for r in best] == [2, 3] and all(-1 <= r["silhouette"] <= 1 for r in best)
    with pytest.raises(ValueError):
        cluster.spread_seeds(x[:2], 3, 0)


def test_silhouette_of_single_points(spark):
    df = spark.createDataFrame([(1, [0.0], 0, 0.0), (2, [5.0], 1, 0.0)], "id long, vec array<double>, cluster int, d2 double")
    assert cluster.silhouette(df, "vec", "id").first()["silhouette"] == 1.0
    assert cluster.silhouette(df.where("id = 1"), "vec", "id").first()["silhouette"] == 0.0


def test_fractional_stride_is_in_doubles(spark):
    df = spark.createDataFrame([(1, i) for i in range(30)], "rec_id long, idx long")
    got = sorted(r["idx"] for r in sampling.stride_cap(df, ["rec_id"], ["idx"], 22).collect())
    assert got == [int(i * (30 / 22)) for i in range(22)]


def test_imports_do_not_double(spark):
    rec = "id long, name string, date string, blob binary"
    have = spark.createDataFrame([(1, "a", None, b"x"), (2, "b", None, b"y")], rec)
    new = spark.createDataFrame([(1, "c", None, b"z"), (5, "d", None, b"x"), (6, "e", None, b"z"), (7, "f", None, None)], rec)
    got = {r["old_id"]: (r["new_id"], r["is_new"]) for r in documents.import_map(have, new).collect()}
    assert got[5] == (1, False) and got[1] == got[6] == (8, True) and got[7] == (7, True) or got[7][1]
    refs = spark.createDataFrame([(1, 5), (2, 9)], "pos int, recording long")
    assert {r["recording"] for r in documents.remapped(refs, documents.import_map(have, new)).collect()} == {1, 9}


def test_export_then_import_is_the_same(spark):
    sessions = spark.createDataFrame([(1, "one"), (2, "empty")], "session long, name string")
    recs = spark.createDataFrame([(1, "a", bytes(range(256)) * 3), (2, "b", b"")], "id long, name string, blob binary")
    refs = spark.createDataFrame([(1, 0, 2), (1, 1, 1), (1, 2, 99)], "session long, pos int, recording long")
    names, rows = documents.import_sessions(documents.export_sessions(sessions, refs, recs))
    assert {r["name"] for r in names.collect()} == {"one", "empty"}
    assert [(r["id"], bytes(r["blob"])) for r in rows.orderBy("pos").collect()] == [(2, b""), (1, bytes(range(256)) * 3)]


def test_trimmed_names(spark):
    names = spark.createDataFrame([("X",), ("X Trimmed",), ("x trimmed 7",), ("Y",)], "name string")
    assert {r["next_name"] for r in documents.next_trimmed_name(names).collect()} == {"X Trimmed 8", "Y Trimmed 1"}


def test_embedded_recordings_are_split_off(spark):
    s = spark.createDataFrame([(1, [(5, "a", None), (None, "b", b"q")])], "session long, recordings array<struct<id:long,name:string,blob:binary>>")
    refs, embedded = documents.split_embedded(s)
    assert [r["recording"] for r in refs.collect()] == [5] and [(r["pos"], bytes(r["blob"])) for r in embedded.collect()] == [(1, b"q")]


def test_wav_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, 8000, [0.0, 0.5, -0.5, 2.0, -2.0]), (2, 8000, None)], "rec_id long, sample_rate int, samples array<float>")
    files = wav.encoded(rows).collect()
    assert len(files[0]["wav"]) == 44 + 10
    for r in files:
        (tmp_path / f"{r['rec_id']}.wav").write_bytes(bytes(r["wav"]))
    (tmp_path / "bad.wav").write_bytes(b"no")
    got = {r["path"].rsplit("/", 1)[1]: r for r in wav.read(spark, str(tmp_path)).collect()}
    assert got["1.wav"]["samples"] == pytest.approx([0.0, 16383 / 32768, -0.5, 32767 / 32768, -1.0]) and got["bad.wav"]["problem"]
    assert got["2.wav"]["samples"] == []


def test_csv_quotes_every_field(spark, tmp_path):
    df = spark.createDataFrame([(1.5, 3, None), (2.0, 4, 'a"b')], "timeSec double, frameIndex int, cluster string").coalesce(1)
    tables.write_csv(df, str(tmp_path / "c"), tables.TIMELINE)
    lines = next((tmp_path / "c").glob("part-*.csv")).read_text().splitlines()
    assert lines[0] == '"timeSec","frameIndex","cluster"' and '"2.0","4","a""b"' in lines and len(lines) == 3


def test_model_store(spark, tmp_path):
    store = tables.ModelStore(spark, str(tmp_path / "models"))
    a, b = store.save("first", pca={"k": 2}), store.save("second", kmeans={"k": 3}, meta={"x": 1})
    store.rename(a, "renamed"), store.activate(b)
    assert store.active() == b and store.load(a)["name"] == "renamed" and store.load(b)["kmeans"] == {"k": 3}
    assert {(r["id"], r["has_pca"], r["has_kmeans"]) for r in store.models().collect()} == {(a, True, False), (b, False, True)}
    store.delete(b)
    assert store.active() is None
    with pytest.raises(KeyError):
        store.load(b)


def test_stream_frames_continue_over_chunks(spark, tmp_path):
    x = np.random.default_rng(6).normal(size=100)
    cuts = [0, 7, 30, 31, 77, 100]
    parts = [(1, i, x[a:b].tolist()) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    schema = "rec_id long, seq long, samples array<double>"
    for i in (1, 0, 2, 4, 3):  # late ones too
        spark.createDataFrame([parts[i]], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streams.frame_levels(stream, 16, 8).writeStream.format("memory").queryName("levels").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = [r["rms"] for r in spark.table("levels").orderBy("frame").collect()]
    want = [float(np.sqrt(np.mean((x[8 * f : 8 * f + 16] * np.hanning(16)) ** 2))) for f in range(11)]
    assert got == pytest.approx(want)


def test_stream_windows(spark, tmp_path, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "e"))
    for name, df in (("windows", streams.event_windows(stream, "1 day")), ("sessions", streams.activity_sessions(stream))):
        q = df.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert spark.table(name).agg(F.sum("n")).first()[0] == e.count()


def test_options_treat_none_as_default():
    assert config.options("segment", silence_ratio=0, smoothing=None) == config.DEFAULTS["segment"] | {"silence_ratio": 0}
    with pytest.raises(ValueError):
        config.options("segment", nothing=1)


def test_a_frame_is_one_group_of_its_bins(spark):
    rng = np.random.default_rng(5)
    samples = [(1, i, float(v)) for i, v in enumerate(rng.normal(size=80))]
    framed = signals.frames(spark.createDataFrame(samples, "rec_id long, idx long, v double"), 64, 16)
    want = np.abs(np.fft.rfft(np.array([v for *_, v in samples])[:64] * np.hanning(64)))
    for at_once in (5, 16, 99):
        found = signals.spectrum(framed, 64, at_once)
        got = {r["bin"]: r["mag"] for r in found.where("frame = 0").collect()}
        assert set(got) == set(range(33)) and np.allclose([got[b] for b in range(33)], want, atol=1e-9)
    assert "HashAggregate(keys=[rec_id" in (plan := found._jdf.queryExecution().executedPlan().toString()) and ", bin#" not in "".join(x for x in plan.splitlines() if "HashAggregate" in x)


def test_scaled_computes_its_cells_once(spark):
    cells = spark.range(20).select((F.col("id") % 3).alias("rec_id"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("mel"), (F.col("id") * 1.5).alias("energy"))
    for log in (True, False):
        assert "Generate" not in signals.scaled(cells, "energy", log=log)._jdf.queryExecution().executedPlan().toString()


def test_silhouette_measures_every_row(spark):
    rng = np.random.default_rng(12)
    x, c = rng.normal(size=(1700, 3)), rng.integers(0, 3, 1700)
    x[:, 0] += c * rng.random(1700)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    n = np.array([(c == k).sum() for k in range(3)])
    sums = np.stack([d[:, c == k].sum(axis=1) for k in range(3)], axis=1)
    own = np.arange(3)[None] == c[:, None]
    a, b = (sums[own] / (n[c] - 1)), np.where(own, np.inf, sums / n).min(axis=1)
    want = ((b - a) / np.maximum(a, b)).mean()
    df = spark.createDataFrame([(i, int(k), v.tolist()) for i, (k, v) in enumerate(zip(c, x))], "id long, cluster int, vec array<double>")
    assert cluster.silhouette(df, "vec", "id").first()["silhouette"] == pytest.approx(want, abs=1e-9)
    assert cluster.silhouette(df, "vec", "id", limit=1500).first()["silhouette"] != pytest.approx(want, abs=1e-9)


def test_a_long_session_is_exported_line_by_line(spark):
    sessions = spark.createDataFrame([(1, "long"), (2, "short")], "session long, name string")
    refs = spark.range(20_000).selectExpr("if(id % 1000 = 0, 2, 1) as session", "id as pos", "id as recording")
    recs = spark.range(20_000).where("id % 7 <> 0").selectExpr("id", "concat('r', id) as name", "encode(repeat(id, 20), 'utf-8') as blob")
    out = documents.export_sessions(sessions, refs, recs).cache()
    kept = [i for i in range(20_000) if i % 7]
    assert out.count() == len(kept) + 2 and out.agg(F.max(F.length("json"))).first()[0] < 300
    names, rows = documents.import_sessions(out)
    assert {(r["session"], r["name"]) for r in names.collect()} == {(1, "long"), (2, "short")}
    for session in (1, 2):
        mine = [i for i in kept if (i % 1000 == 0) == (session == 2)]
        assert [(r["pos"], r["id"], bytes(r["blob"]).decode()) for r in rows.where(F.col("session") == session).orderBy("pos").collect()] == [(n, i, str(i) * 20) for n, i in enumerate(mine)]


def test_short_signals_have_one_padded_frame(spark):
    rows = spark.createDataFrame([(r, i, 1.0) for r, n in ((1, 1), (2, 15), (3, 16), (4, 24)) for i in range(n)], "rec_id long, idx long, v double")
    got = signals.frames(rows, 16, 8, at_least_one=True).groupBy("rec_id", "frame").count().collect()
    assert {(r["rec_id"], r["frame"]): r["count"] for r in got} == {(1, 0): 1, (2, 0): 15, (3, 0): 16, (4, 0): 16, (4, 1): 16}


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_numbers_have_no_gaps_and_lose_no_row(spark, adaptive):
    """Wide rows over many ranges: every row keeps its place, and all of them are there."""
    n, before = 250_000, spark.conf.get("spark.sql.shuffle.partitions")
    rows = spark.range(0, n, 1, 16).selectExpr("(id * 7919) % 250007 as k", "repeat(md5(cast(id as string)), 6) as wide", "id as other")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        for got in (documents.numbered(rows, "k", "place"), sampling.positions(rows, [F.desc("k")], "place").withColumn("place", n - F.col("place"))):
            r = got.selectExpr("count(*) as n", "count(distinct place) as d", "min(place) as a", "max(place) as z", "count(distinct k) as keys").first()
            assert (r["n"], r["d"], r["a"], r["z"], r["keys"]) == (n, n, 1, n, n)
            wrong = got.withColumn("k2", F.lead("k").over(Window.partitionBy((F.col("place") / 50).cast("long")).orderBy("place"))).where("k2 <= k")
            assert wrong.count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_upsert_keeps_one_row_per_key(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "id long, name string")
    changes = spark.createDataFrame([(2, "x", 5), (2, "y", 9), (2, "z", 1), (3, "new", 0), (3, "new", 0)], "id long, name string, at int")
    got = lambda df: sorted((r["id"] or 0, r["name"]) for r in df.collect())
    assert got(documents.upsert(table, changes, order="at")) == [(0, "n"), (1, "a"), (2, "y"), (3, "new")]
    assert got(documents.upsert(table, changes)) == [(0, "n"), (1, "a"), (2, "z"), (3, "new")]


def test_fingerprints_ignore_order_but_not_repeats(spark):
    rows = [(1, "a", None, b"x"), (1, "b", None, b"y"), (2, "b", None, b"y"), (2, "a", None, b"x"), (3, "a", None, b"x"), (4, "a", None, b"x"), (4, "a", None, b"x"), (5, None, None, None)]
    df = spark.createDataFrame(rows, "session long, name string, date string, blob binary")
    got = {r["session"]: r["fingerprint"] for r in documents.fingerprints(df).collect()}
    assert got[1] == got[2] and len({got[i] for i in (1, 3, 4, 5)}) == 4


def test_inserted_rows_get_keys_after_the_largest(spark):
    table = spark.createDataFrame([(4, "a"), (9, "b")], "id long, name string")
    rows = spark.createDataFrame([(1, "y"), (1, "x"), (1, "x"), (None, None)], "id long, name string").repartition(3)
    assert {tuple(r) for r in documents.inserted(table, rows, ["name"]).collect()} == {(4, "a"), (9, "b"), (10, None), (11, "x"), (12, "x"), (13, "y")}
    assert sorted(r["id"] for r in documents.inserted(table.where("id < 0"), rows, ["name"]).collect()) == [1, 2, 3, 4]
    assert documents.inserted(table, rows.where("id > 1"), ["name"]).count() == 2


def test_removed_recordings_leave_no_gap_in_a_session(spark):
    refs = spark.createDataFrame([(1, 0, 7), (1, 1, 8), (1, 2, 7), (1, 3, 9), (2, 5, 7), (3, 0, 7), (4, 0, None)], "session long, pos int, recording long")
    removed = spark.createDataFrame([(1, 7), (1, 7), (3, 7), (2, 8), (4, None)], "session long, recording long")
    assert {tuple(r) for r in documents.without(refs, removed).collect()} == {(1, 0, 8), (1, 1, 9), (2, 0, 7), (4, 0, None)}
