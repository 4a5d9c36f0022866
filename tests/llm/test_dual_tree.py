from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

import oracle
from tidalframe.llm import dual_tree


def brute(rows, k, rounds, width):
    """The contract in Python's integers."""
    kept = [(i, [math.floor(256 * float(x)) for x in e]) for i, e in rows if e is not None and len(e) == width and all(x is not None and math.isfinite(x) for x in e)]
    first = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), e) for i, e in kept if i is not None)[:k]
    centroids = [e for _, e in first]
    d2 = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    label = lambda e: min(range(len(centroids)), key=lambda c: (d2(e, centroids[c]), c))
    for _ in range(rounds):
        labels = [label(e) for _, e in kept]
        for c in range(len(centroids)):
            mine = [e for (_, e), at in zip(kept, labels) if at == c]
            if mine:
                centroids[c] = [sum(x) // len(mine) for x in zip(*mine)]
    if not centroids:
        return []
    out = [(i, c := label(e), d2(e, centroids[c])) for i, e in kept]
    per = {c: sum(d for _, at, d in out if at == c) for c in range(len(centroids))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, per[c], sum(per.values()), digest[c]) for i, c, d in out), key=str)


def rows_of(df):
    return sorted(((r["vec_id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("block", [7, 4096])
def test_clusters_equal_brute_force(spark, block):
    rng = np.random.default_rng(4)
    near = rng.normal(size=(6, 5))[rng.integers(0, 6, 150)] + rng.normal(size=(150, 5)) * 0.05
    rows = [(i, v) for i, v in enumerate(near.astype(np.float32).tolist())]
    rows += [(300, None), (301, []), (302, [None] * 5), (303, [math.nan] * 5), (304, [math.inf] * 5), (305, [1.0] * 4), (None, rows[3][1]), (306, [0.0] * 5), (306, [0.0] * 5), (307, rows[3][1]), (308, rows[3][1]), (309, [-1e5] * 5)]
    table = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, cluster int, v int").repartition(3)
    assert rows_of(dual_tree.clustered(table, 9, 4, 5, block)) == brute(rows, 9, 4, 5)
    assert rows_of(dual_tree.clustered(table, 400, 2, 5, block)) == brute(rows, 400, 2, 5)  # fewer vectors than clusters, and equal starts
    assert dual_tree.clustered(table.where("vec_id is null"), 9, 4, 5).count() == 0
    assert dual_tree.clustered(table.where("false"), 9, 4, 5).count() == 0


def test_components_beyond_exact_distances_are_an_error(spark):
    table = spark.createDataFrame([(1, [1e9, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        dual_tree.clustered(table, 1, 1, 2).count()


def descendants(tree, node):
    return tree.order[tree.start[node] : tree.stop[node]]


@pytest.mark.parametrize("kind", ["spread", "clusters", "line", "equal"])
def test_tree_covers_and_separates(kind):
    rng = np.random.default_rng(1)
    points = {"spread": rng.normal(size=(600, 64)), "clusters": rng.normal(size=(8, 6))[rng.integers(0, 8, 600)] + rng.normal(size=(600, 6)) * 0.02, "line": np.arange(600)[:, None] * 1.0, "equal": np.ones((600, 3))}[kind]
    tree = dual_tree.cover_tree(points, 4)
    assert sorted(tree.order.tolist()) == list(range(600))
    for node in range(tree.centre.size):
        mine = points[descendants(tree, node)]
        assert tree.centre[node] in descendants(tree, node)
        assert np.sqrt(((mine - points[tree.centre[node]]) ** 2).sum(axis=1)).max() <= tree.radius[node] + 1e-9
        children = range(tree.first[node], tree.last[node])
        if len(children):
            assert sum(tree.stop[c] - tree.start[c] for c in children) == tree.stop[node] - tree.start[node]
            centres = points[tree.centre[children.start : children.stop]]
            apart = np.sqrt(((centres[:, None] - centres) ** 2).sum(axis=2)) + np.eye(len(centres)) * 1e9
            assert apart.min() > tree.radius[node] / 2 - 1e-9 and all(tree.radius[c] <= tree.radius[node] / 2 + 1e-9 for c in children)
    if kind in ("clusters", "line"):
        assert tree.centre.size > 50


@pytest.mark.parametrize("spread", [0.3, 5.0, 60.0])
def test_pruned_walk_finds_the_nearest(spread):
    rng = np.random.default_rng(2)
    points = np.round(rng.normal(size=(12, 8))[rng.integers(0, 12, 900)] * 100 + rng.normal(size=(900, 8)) * spread).astype(np.int64)
    centroids = np.concatenate((points[:20], points[:3], points[100:110] + 1))
    tree = dual_tree.cover_tree(points)
    ordered = points[tree.order]
    spot = np.empty(900, np.int64)
    spot[tree.order] = np.arange(900)
    tree.centre, tree.order = spot[tree.centre], np.arange(900)
    exact = ((ordered[:, None] - centroids) ** 2).sum(axis=2).argmin(axis=1)
    assert dual_tree.nearest(ordered, tree, centroids, dual_tree.cover_tree(centroids, 1, 1)).tolist() == exact.tolist()


def test_node_pairs_of_other_clusters_are_pruned(monkeypatch):
    """Vectors of 20 far groups against a centroid in each: leaves meet hardly any centroid but their own."""
    rng = np.random.default_rng(5)
    centroids = rng.integers(-5000, 5000, (20, 16))
    points = centroids[rng.integers(0, 20, 1000)] + rng.integers(-20, 21, (1000, 16))
    tree, ctree, compared = dual_tree.cover_tree(points), dual_tree.cover_tree(centroids, 1, 1), [0]
    assert ctree.centre.size > 20  # down to single centroids
    ordered, spot, plain = points[tree.order], np.empty(1000, np.int64), dual_tree._apart
    spot[tree.order] = np.arange(1000)
    tree.centre, tree.order = spot[tree.centre], np.arange(1000)

    def counted(some, centre):
        compared[0] += len(some)
        return plain(some, centre)

    monkeypatch.setattr(dual_tree, "_apart", counted)
    got = dual_tree.nearest(ordered, tree, centroids, ctree)
    assert got.tolist() == ((ordered[:, None] - centroids) ** 2).sum(axis=2).argmin(axis=1).tolist()
    assert compared[0] < 1000 * 20 / 10


def test_clusters_equal_their_sql(spark, sf_dir):
    assert not oracle.differences(dual_tree.query(spark, sf_dir), oracle.connection(sf_dir), dual_tree.SQL)
