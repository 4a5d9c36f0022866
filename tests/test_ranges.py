"""Places, neighbours, quantiles, samples and segments over blocks, against plain versions."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidalframe.operators import normalise, ranges, sampling, segments

from test_operators import merged_by_steps


def test_places_in_groups_equal_sorted_lists(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, "a", "hot", "hot", "hot", "b"]), rng.randrange(50), i) for i in range(500)] + [("one", 1, 999)]
    df = spark.createDataFrame(rows, "g string, x int, id int").repartition(5)
    got = ranges.ranked(df, ["g"], [F.desc("x"), "id"]).collect()
    lists = defaultdict(list)
    for g, x, i in rows:
        lists[g].append((-x, i))
    want = {i: (place, len(v)) for v in lists.values() for place, (_, i) in enumerate(sorted(v))}
    assert {r["id"]: (r["_i"], r["_n"]) for r in got} == want and len(got) == len(rows)
    assert ranges.ranked(df.where("false"), ["g"], ["x"]).count() == 0


def test_a_hot_group_of_equal_rows_spreads_and_is_numbered(spark):
    df = spark.range(4000).select(F.lit("hot").alias("g"), F.lit(1).alias("x"))
    got = ranges.ranked(df, ["g"], ["x"])
    assert sorted(r["_i"] for r in got.collect()) == list(range(4000))


@pytest.mark.parametrize("q", [-1.0, 0.0, 0.15, 0.5, 0.999, 1.0, 2.0])
def test_quantiles_are_linear_between_neighbours(spark, q):
    rng = np.random.default_rng(3)
    rows = [(g, float(v)) for g, n in ((1, 1), (2, 2), (3, 57), (None, 30)) for v in np.round(rng.normal(size=n), 1)] + [(1, None), (9, None)]
    got = {r["g"]: r["quantile"] for r in ranges.quantiles(spark.createDataFrame(rows, "g int, v double"), ["g"], "v", q).collect()}
    assert set(got) == {1, 2, 3, None}
    for g, value in got.items():
        assert value == pytest.approx(np.quantile([v for k, v in rows if k == g and v is not None], min(max(q, 0), 1)))


SIZES = [0, 1, 2, 5, 6, 7, 20, 41]


@pytest.mark.parametrize("block", [1, 2, 3, 7, 65_536])
@pytest.mark.parametrize("width", [1, 2, 3, 8])
def test_moving_means_do_not_depend_on_blocks(spark, block, width):
    rng = np.random.default_rng(4)
    series = {r: rng.normal(size=n).tolist() for r, n in enumerate(SIZES)}
    df = spark.createDataFrame([(r, 3 * f, v) for r, s in series.items() for f, v in enumerate(s)], "rec_id int, frame int, rms double").repartition(4)
    got = {(r["rec_id"], r["frame"] // 3): r["rms"] for r in segments.smoothed(df, "rms", width, block).collect()}
    half = width // 2 if width > 1 else 0
    assert got == {(r, f): pytest.approx(np.mean(s[max(0, f - half) : f + half + 1])) for r, s in series.items() for f in range(len(s))}


@pytest.mark.parametrize("block", [1, 2, 7, 4096])
def test_context_does_not_depend_on_blocks(spark, block):
    rows = [(r, f, [float(100 * r + f), 1.0]) for r, n in enumerate(SIZES) for f in range(n)]
    df = spark.createDataFrame(rows, "rec_id int, frame int, vec array<double>").repartition(3)
    got = {(r["rec_id"], r["frame"]): r["vec"] for r in normalise.context_stack(df, "vec", 2, block).collect()}
    have = {(r, f): v for r, f, v in rows}
    assert got == {(r, f): sum((have.get((r, f + d), [0.0, 0.0]) for d in range(-2, 3)), []) for r, f in have}


def recordings():
    """Loudness of recordings with runs of all lengths, also across many blocks, and without a long enough run."""
    rng = random.Random(8)
    out = [[k] * n for k, n in ((0, 40), (1, 40))] + [[0, 1] * 20, [1] * 2 + [0] * 33 + [1] * 2, [0] * 4 + [1] * 2, [0], [1]]
    for i in range(60):
        s = []
        while len(s) < rng.randrange(1, 45):
            s += [rng.randrange(2)] * rng.choice([1, 1, 2, 3, 4, 5, 6, 11, 20])
        out.append(s)
    return out


@pytest.mark.parametrize("block", [1, 2, 3, 5, 16, 65_536])
def test_segments_do_not_depend_on_blocks(spark, block):
    series = recordings()
    df = spark.createDataFrame([(r, f, 0.01 if k == 0 else 1.0, "x") for r, s in enumerate(series) for f, k in enumerate(s)], "rec_id int, frame int, rms double, head string").repartition(4)
    got = {(r["rec_id"], r["frame"]): (r["segment"], r["type"]) for r in segments.labelled(df, 0.5, peak=F.lit(1.0), block=block).collect()}
    assert len(got) == sum(map(len, series))
    for r, s in enumerate(series):
        kinds = ["silence" if k == 0 else "speech" for k in s]
        want = [(a, k) for a, b, k in merged_by_steps(kinds, {"silence": 5, "speech": 3}) for _ in range(a, b + 1)]
        assert [got[r, f] for f in range(len(s))] == want, (r, s)


def test_segments_of_null_recordings_and_unfinished_loudness(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(None, f, v) for f, v in enumerate([1.0] * 6 + [0.0] * 6)] + [(1, f, v) for f, v in enumerate([nan] * 4 + [0.0] * 6 + [inf] * 4 + [2.0])]
    got = segments.labelled(spark.createDataFrame(rows, "rec_id int, frame int, rms double"), 0.5, block=4)
    found = {(r["rec_id"], r["frame"]): r["type"] for r in got.collect()}
    assert [found[None, f] for f in range(12)] == ["speech"] * 6 + ["silence"] * 6
    assert [found[1, f] for f in range(15)] == ["speech"] * 4 + ["silence"] * 6 + ["speech"] * 5
    assert got.where("false").count() == 0


def test_samples_are_repeatable_and_weighted(spark):
    df = spark.createDataFrame([(i % 3 if i % 7 else None, i, float(i % 10)) for i in range(900)], "g int, id int, w double")
    one, other = (sorted(r["id"] for r in sampling.reservoir(df.repartition(n), ["g"], ["id"], 40).collect()) for n in (1, 6))
    assert one == other and len(one) == 160
    assert one != sorted(r["id"] for r in sampling.reservoir(df, ["g"], ["id"], 40, seed=1).collect())
    assert sampling.reservoir(df, ["g"], ["id"], 1000).count() == 900
    heavy = Counter(r["w"] for r in sampling.reservoir(df, ["g"], ["id"], 60, weight="w").collect())
    assert 0.0 not in heavy and sum(heavy[w] for w in (7.0, 8.0, 9.0)) > 2 * sum(heavy[w] for w in (1.0, 2.0, 3.0))
    everyone = df.withColumn("_all", F.lit("kept"))
    assert sampling.hashed_sample(df, "id", 25).count() == 25 and sampling.hashed_sample(df, "id", 25).columns == df.columns
    assert sampling.reservoir(everyone, ["g"], ["id"], 5).columns == everyone.columns
