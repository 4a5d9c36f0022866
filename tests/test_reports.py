"""Migration of embedded recordings, checks of recordings and models, CSV files that come back, caps of projected frames."""

from __future__ import annotations

import math

import numpy as np
import pytest

from tidalframe import config
from tidalframe.operators import diagnostics, documents, pca, signals, training
from tidalframe.sources import tables

ENTRY = "array<struct<id: long, name: string, blob: binary>>"


def test_embedded_recordings_become_references(spark):
    recordings = spark.createDataFrame([(4, "a", b"x"), (9, None, None)], "id long, name string, blob binary")
    sessions = spark.createDataFrame(
        [
            (1, [(None, "in", b"1"), (4, None, None), (None, None, None), (7, "both", b"2")]),
            (2, []),
            (3, None),
            (None, [(None, None, b"")]),
            (5, [(9, None, None), (9, None, None)]),
        ],
        f"session long, recordings {ENTRY}",
    )
    rows, refs = documents.migrated(recordings, sessions)
    got = {r["id"]: (r["name"], r["blob"] and bytes(r["blob"])) for r in rows.collect()}
    assert got.pop(4) == ("a", b"x") and got.pop(9) == (None, None)
    places = {(r["session"], r["pos"]): r["recording"] for r in refs.collect()}
    # nulls stand first, so the session without a number has the first new id
    assert got.keys() == {10, 11, 12} and places == {(None, 0): 10, (1, 0): 11, (1, 1): 4, (1, 2): 12, (5, 0): 9, (5, 1): 9}
    assert got[11] == ("in", b"1") and got[12] == ("both", b"2") and got[10][0] == ""


def test_migration_of_empty_tables(spark):
    rows, refs = documents.migrated(spark.createDataFrame([], "id long, name string, blob binary"), spark.createDataFrame([], f"session long, recordings {ENTRY}"))
    assert rows.count() == refs.count() == 0
    rows, refs = documents.migrated(spark.createDataFrame([], "id long, name string, blob binary"), spark.createDataFrame([(1, [(None, "a", b"b")])], f"session long, recordings {ENTRY}"))
    assert [r["id"] for r in rows.collect()] == [1] and refs.first()["recording"] == 1


def test_a_quiet_recording_is_warned_about(spark):
    frames = [(1, 0.001, 5.0), (1, None, 5.0), (1, math.nan, math.inf), (1, 0.5, None), (2, 0.005, 1e-5), (2, 1.0, 1e-5)]
    got = {r["rec_id"]: r for r in diagnostics.checked_recordings(spark.createDataFrame(frames, "rec_id long, rms double, mel_sum double")).collect()}
    assert (got[1]["frames"], got[1]["quiet_percent"], got[1]["mel_sum_mean"]) == (4, 75.0, 2.5) and got[1]["warnings"] == ["over 40 % of frames are quiet"]
    assert got[2]["quiet_percent"] == 0 and got[2]["warnings"] == ["band energy is very low"]


def test_samples_on_the_components(spark):
    rows = spark.createDataFrame([(1, f, [float(f), math.nan]) for f in range(5)] + [(2, 0, [0.0, 0.0])], "rec_id long, frame long, vec array<double>")
    model = pca.Model(np.zeros(2), np.array([[1.0, 0.0], [0.0, 0.0]]), np.ones(2), np.ones(2) / 2)
    got = sorted((r["rec_id"], r["frame"], r["which"], *r["z"], r["all_small"]) for r in diagnostics.after_training(rows, "vec", model).collect())
    assert got == [(1, 0, "first", 0, 0, False), (1, 2, "middle", 2, 0, False), (1, 4, "last", 4, 0, False), *((2, 0, w, 0, 0, True) for w in ("first", "last", "middle"))]
    assert pca.diagnosis(model)["degenerate"] == [1]
    with pytest.raises(Exception, match="a vector of 3 expected"):
        diagnostics.after_training(rows, "vec", pca.Model(np.zeros(3), np.eye(3), np.ones(3), np.ones(3))).collect()


@pytest.mark.parametrize("text", ['a "quoted", name', "two\nlines", " blanks at both ends \n", "", None, "\\", 'ends with "'])
def test_csv_files_come_back(spark, tmp_path, text):
    tables.write_csv(spark.createDataFrame([(text, 1.5)], "a string, b double"), str(tmp_path / "csv"), ["a", "b"])
    (row,) = tables.read_csv(spark, str(tmp_path / "csv"), ["a", "b"]).collect()
    assert (row["a"] or None, row["b"]) == (text or None, "1.5")


def test_projected_frames_are_capped_over_the_pool(spark):
    """Two recordings of loud frames: of each at most ceil(cap / 2), or 100, are taken, at even steps."""
    frames = [(r, f, f / 2, [1.0, 2.0], 1.0 + f / 1000, 4.0, 0.5) for r, n in ((1, 450), (2, 90)) for f in range(n)]
    table = spark.createDataFrame(frames, "rec_id long, frame long, time_sec double, mel array<double>, rms double, centroid double, zcr double")
    pool = spark.createDataFrame([(0, 1), (1, 2)], "pos long, rec_id long")
    axes = np.eye(5)[:3]
    model = pca.Model(np.full(5, 0.25), axes, np.ones(3), np.ones(3))
    for points, cap in ((5000, 2500), (300, 150), (10, 100)):
        got = {(r["rec_id"], r["frame"]): r["z"] for r in training.projected(table, pool, model, 16.0, dims=2, quantile=0.15, points=points).collect()}
        want = {}
        for rec, n in ((1, 450), (2, 90)):
            loud = [f for f in range(n) if f >= 0.15 * (n - 1)]
            want |= {(rec, f): [math.log1p(1.0) - 0.25, math.log1p(2.0) - 0.25] for f in loud[:: max(1, -(-len(loud) // cap))]}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_each_rate_has_its_own_filters(spark):
    rates = spark.createDataFrame([(16.0,), (44.1,), (None,)], "sample_rate double")
    got = signals.mel_filters_by_rate(rates, 4, 16).collect()
    assert {r["sample_rate"] for r in got} == {16.0, 44.1}
    for rate in (16.0, 44.1):
        alone = {(r["mel"], r["bin"]): r["weight"] for r in signals.mel_filters(spark, 4, 16, rate).collect()}
        assert alone == {(r["mel"], r["bin"]): r["weight"] for r in got if r["sample_rate"] == rate}


def test_layers_of_options():
    assert config.merged({"a": {"x": 1, "y": 2}}, {"a": {"y": 3}, "b": {"z": 0}}, {}) == {"a": {"x": 1, "y": 3}, "b": {"z": 0}}
