"""Operator 12: centroid clustering by dual-tree Lloyd rounds.

1. A task gathers the vectors it reads into blocks of bounded size and builds a cover tree
   over each: a node is a vector with the distance to its farthest descendant; its
   children cover what it covers at a smaller scale and lie farther apart than that scale.
   Blocks with their trees are written once and read in every round.
2. Each round builds such a tree over the centroids and walks both: a vector node carries
   the centroid nodes that can still be nearest to one of its vectors. A pair of nodes is
   dropped if even their closest members lie farther apart than the vector node's farthest
   member from the best centroid known. A node left with one centroid gives it all its
   vectors; in leaves, the centroids that are left are compared exactly, in integers.
3. A task adds up its vectors per cluster; Spark adds up those sums, and k x d numbers
   reach the driver, which takes exact floors.

Distances bound the walk in doubles with a margin over their rounding; labels, sums,
distances and inertia are integers.

Nulls and edges: a vector that is null, of another length, or with null or non-finite
components takes no part. Rows that share a vec_id are rows of their own; the one whose
components are smaller comes first as a start. A null vec_id is no start, but is assigned.
Equal distances go to the smaller number, so of equal centroids the later one stays empty
and keeps its place. With fewer vectors than k there are as many clusters as starts;
without starts there are no rows. A component of 2**27 or more raises an error: squared
distances could not fit a long. Extra columns take no part, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidalframe.llm.common import written

LIMIT = 1 << 27


def integral(vector: str, width: int, scale: int = 256) -> Column:
    """floor(scale * x) of each component as int; null unless there are `width` finite numbers."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    usable = (F.size(vector) == width) & ~F.exists(vector, bad)
    value = lambda x: F.floor(x.cast("double") * scale)
    fits = lambda x: F.when(F.abs(x.cast("double") * scale) < LIMIT, value(x).cast("int")).otherwise(F.raise_error(F.lit("a component is too large for exact distances")).cast("int"))
    return F.when(usable, F.transform(vector, fits))


@dataclass
class Tree:
    """A cover tree: node i is point centre[i] with the points start[i]:stop[i] of `order`, none of them
    farther from it than radius[i]; its children are the nodes first[i]:last[i], none of a leaf."""

    order: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    first: np.ndarray
    last: np.ndarray


def _apart(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.sqrt(((points - centre) ** 2).sum(axis=1))


def cover_tree(points: np.ndarray, leaf: int = 16, least: int = 2) -> Tree:
    """The tree over rows of points. A node is a leaf if it has at most `leaf` points, if they are all
    equal, or if a smaller scale would not bring them together: its children would have fewer than `least`
    points on average. Centroids lie apart, so their tree goes down to single points (leaf = least = 1)."""
    points = np.asarray(points, float)
    order = np.arange(len(points))
    nodes, at = [[0, 0.0, 0, len(points), 0, 0]], 0
    while at < len(nodes):
        centre, _, start, stop, _, _ = nodes[at]
        mine = order[start:stop]
        far = _apart(points[mine], points[centre])
        nodes[at][1] = float(far.max(initial=0.0))
        parts: list[np.ndarray] = []
        if stop - start > leaf and nodes[at][1] > 0:
            scale, left, gone = nodes[at][1] / 2, mine, far
            while left.size:
                near = gone <= scale
                parts.append(left[near] if not parts else np.concatenate((head, left[near & (left != head[0])])))
                left = left[~near]
                if len(parts) * least > stop - start:
                    parts = []
                    break
                if left.size:
                    head = left[:1]
                    gone = _apart(points[left], points[head[0]])
        if len(parts) > 1:
            nodes[at][4:] = [len(nodes), len(nodes) + len(parts)]
            for i, part in enumerate(parts):
                order[start : start + part.size] = part
                nodes.append([centre if i == 0 else int(part[0]), 0.0, start, start + part.size, 0, 0])
                start += part.size
        at += 1
    columns = [np.array(c) for c in zip(*nodes)]
    return Tree(order, columns[0], columns[1].astype(float), *columns[2:])


def nearest(points: np.ndarray, tree: Tree, centroids: np.ndarray, ctree: Tree) -> np.ndarray:
    """The label of each point, points being integers in the order of their tree (order = 0, 1, ...)."""
    labels = np.zeros(len(points), np.int64)
    if not len(points):
        return labels
    places = centroids.astype(float)
    stack = [(0, np.zeros(1, np.int64))]
    while stack:
        node, rivals = stack.pop()
        centre, radius = points[tree.centre[node]].astype(float), tree.radius[node]
        leaf = tree.first[node] == tree.last[node]
        while True:
            apart = _apart(places[ctree.centre[rivals]], centre)
            reach = (apart.min() + radius) * (1 + 1e-9) + 1e-6  # no vector here lies farther from its centroid
            keep = apart - radius - ctree.radius[rivals] <= reach
            rivals = rivals[keep]
            # split the wider side: centroid nodes at least as wide as this node, all of them at a leaf
            opened = (ctree.first[rivals] < ctree.last[rivals]) & (leaf | (ctree.radius[rivals] >= radius))
            if not opened.any():
                break
            rivals = np.concatenate([rivals[~opened], *[np.arange(ctree.first[r], ctree.last[r]) for r in rivals[opened]]])
        start, stop = tree.start[node], tree.stop[node]
        if rivals.size == 1 and ctree.stop[rivals[0]] - ctree.start[rivals[0]] == 1:
            labels[start:stop] = ctree.order[ctree.start[rivals[0]]]
        elif leaf:
            left = np.sort(np.concatenate([ctree.order[ctree.start[r] : ctree.stop[r]] for r in rivals]))
            d2 = np.stack([((points[start:stop] - centroids[c]) ** 2).sum(axis=1) for c in left], axis=1)
            labels[start:stop] = left[d2.argmin(axis=1)]
        else:
            stack += [(child, rivals) for child in range(tree.first[node], tree.last[node])]
    return labels


_ARRAYS = {"radius": "array<double>"} | {c: "array<int>" for c in ("centre", "start", "stop", "first", "last")}
BLOCKS = "ids array<long>, points array<int>, " + ", ".join(f"{c} {kind}" for c, kind in _ARRAYS.items())


def blocks(vectors: DataFrame, width: int, size: int = 4096) -> DataFrame:
    """(vec_id, v array<int> of width) -> written rows of at most `size` vectors in the order of their cover tree."""

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(held: pa.Table) -> pa.RecordBatch:
            points = held.column("v").combine_chunks().flatten().to_numpy().reshape(-1, width)
            tree = cover_tree(points)
            spot = np.empty(tree.order.size, np.int64)  # points are stored in the tree's order
            spot[tree.order] = np.arange(tree.order.size)
            ids = held.column("vec_id").combine_chunks().take(pa.array(tree.order))
            listed = lambda x, kind: pa.array([x.tolist()], pa.list_(kind))
            arrays = [listed(spot[tree.centre] if c == "centre" else getattr(tree, c), pa.float64() if c == "radius" else pa.int32()) for c in _ARRAYS]
            body = pa.ListArray.from_arrays(pa.array([0, points.size], pa.int32()), pa.array(points[tree.order].ravel(), pa.int32()))
            return pa.RecordBatch.from_arrays([pa.array([ids.to_pylist()], pa.list_(pa.int64())), body, *arrays], ["ids", "points", *_ARRAYS])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            for a in range(0, batch.num_rows, size):
                held.append(batch.slice(a, size))
                table = pa.Table.from_batches(held)
                held = table.to_batches()
                while table.num_rows >= size:
                    yield block(table.slice(0, size))
                    table = table.slice(size)
                    held = table.to_batches()
        if sum(b.num_rows for b in held):
            yield block(pa.Table.from_batches(held))

    return written(vectors.select("vec_id", "v").mapInArrow(built, BLOCKS), "trees")


def _labelled(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Of each block: ids, points, labels."""
    ctree = cover_tree(centroids, leaf=1, least=1)
    for batch in batches:
        for i in range(batch.num_rows):
            points = batch.column("points")[i].values.to_numpy().astype(np.int64).reshape(-1, centroids.shape[1])
            parts = {c: batch.column(c)[i].values.to_numpy() for c in _ARRAYS}
            yield batch.column("ids")[i].values, points, nearest(points, Tree(np.arange(len(points)), **parts), centroids, ctree)


def moved(stored: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: each centroid goes to the floor of its vectors' mean; an empty one stays."""
    k, width = centroids.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
        for _, points, labels in _labelled(batches, centroids):
            n += np.bincount(labels, minlength=k)
            order = np.argsort(labels, kind="stable")
            some = np.flatnonzero(np.bincount(labels, minlength=k))
            total[some] += np.add.reduceat(points[order], np.searchsorted(labels[order], some), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), pa.array(n), pa.array(total.tolist(), pa.list_(pa.int64()))], ["cluster", "n", "v"])

    parts = stored.mapInArrow(sums, "cluster int, n long, v array<long>").where("n > 0")
    cells = parts.select("cluster", "n", F.posexplode("v").alias("dim", "x")).groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(20,0)")).alias("x"))
    out = centroids.copy()
    for r in cells.collect():  # k x width numbers
        out[r["cluster"], r["dim"]] = int(r["x"]) // r["n"]
    return out


def starts(vectors: DataFrame, k: int, width: int) -> np.ndarray:
    """The k vectors whose id has the smallest hash, in the order of the hash."""
    key = F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")), 256)
    first = vectors.where("vec_id is not null").select(key.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r["v"] for r in first], np.int64).reshape(-1, width)


def clustered(vectors: DataFrame, k: int = 40, rounds: int = 5, width: int = 64, block: int = 4096) -> DataFrame:
    """vectors (vec_id, embedding) -> vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    spark = vectors.sparkSession
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), integral("embedding", width).alias("v")).where("v is not null")
    centroids = starts(kept, k, width)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    stored = blocks(kept, width, block)
    for _ in range(rounds):
        centroids = moved(stored, centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, points, labels in _labelled(batches, centroids):
            d2 = ((points - centroids[labels]) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays([ids, pa.array(labels.astype(np.int32)), pa.array(d2)], ["vec_id", "cluster", "distance"])

    labelled = written(stored.mapInArrow(assign, "vec_id long, cluster int, distance long"), "labels")
    sums = {r["cluster"]: r["s"] for r in labelled.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k numbers
    digest = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    rows = [(c, s, sum(sums.values()), digest(centroids[c])) for c, s in sorted(sums.items())]
    per = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return labelled.join(F.broadcast(per), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _round(i: int) -> str:
    """Round i as SQL: labels by centroids c<i-1>, and centroids c<i>, whose components are exact floors."""
    apart = "list_sum(list_transform(list_zip(v.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    out = f"l{i} as (select r, arg_min(k, (d, k)) as k, min(d) as d from (select v.r, c.k, {apart}::bigint as d from v, c{i - 1} c) group by r)"
    if i > 5:
        return out
    sums = f"s{i} as (select l.k, p, sum(v.e[p])::hugeint as s, count(*)::hugeint as n from l{i} l join v using (r), range(1, 65) t(p) group by l.k, p)"
    mean = f"m{i} as (select k, list(((s - ((s % n) + n) % n) // n)::bigint order by p) as e from s{i} group by k)"
    return f"{out}, {sums}, {mean}, c{i} as materialized (select c.k, coalesce(m.e, c.e) as e from c{i - 1} c left join m{i} m using (k))"


SQL = f"""
with v as materialized (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as e from embeddings
           where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
c0 as materialized (select row_number() over (order by sha256('2:' || vec_id), e) - 1 as k, e from v where vec_id is not null qualify k < 40),
{", ".join(map(_round, range(1, 7)))}
select v.vec_id, l.k::int as cluster, l.d as distance, (sum(l.d) over (partition by l.k))::bigint as cluster_inertia, (sum(l.d) over ())::bigint as inertia,
       sha256(array_to_string(c5.e, ',')) as centroid_sha256
from v join l6 l using (r) join c5 on c5.k = l.k
"""
