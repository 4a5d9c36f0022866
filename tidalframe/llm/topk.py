"""Operator 7: exact top-k inner-product search by columnar branch and bound.

Candidates and queries are cut into blocks by row number, so no key can make a block
large. Each (candidate block, query block) pair is one group: the candidates lie in
vertical layout (a row per dimension), dimensions with the most mass first, and each
candidate's remaining mass (the norm over the dimensions not yet seen) after each block
of dimensions is computed once for all queries. A batch of queries adds up its scores
one block of dimensions after the other; after each, only those candidates stay that
for some query of the batch can still reach its k-th best, by partial score plus the
product of remaining masses; the survivors are compacted. The k-th best so far comes
from candidates scored in full at the start. Integers are summed in doubles, which is
exact below 2**53; beyond, in Python integers.

Then each query's best of all blocks are ranked. Ties go to the smaller vec_id.

Nulls and edges: a vector that is null, empty or has null or non-finite components
takes no part; vectors meet only those of their own length. Rows that share a vec_id
are rows of their own: a query skips only its own row. A null vec_id is no query, and
as a candidate loses ties. A score that a long can't hold raises an error. Extra columns
take no part, whatever their names; without queries or candidates there are no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidalframe.llm.common import written

EXACT = 2.0**53


def integral(vector: str, scale: int = 256) -> Column:
    """floor(scale * x) of each component as double; null unless all are finite numbers."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    usable = F.size(vector) > 0
    usable &= ~F.exists(vector, bad)
    return F.when(usable, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("double")))


def best_of_block(layout: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int, rank: np.ndarray, step: int = 16, batch: int = 32, seeds: int = 64) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query (places, scores) of the k best columns of layout (dimensions x candidates), without its column `own` (-1: none).

    rank orders candidates with equal scores.
    """
    dims, n = layout.shape
    order = np.argsort(-(queries**2).sum(axis=0), kind="stable")
    layout, queries, cuts = layout[order], queries[:, order], range(0, dims, step)
    # masses over the dimensions from each cut on: of all candidates, and of all queries
    tails = lambda squares: np.sqrt(np.array([squares[a:].sum(axis=0) for a in cuts]))
    masses, asked = tails(layout**2), tails(queries.T**2)
    first, out = np.arange(0, n, max(1, n // seeds)), []
    for at in range(0, len(queries), batch):
        some, mine = queries[at : at + batch], own[at : at + batch]
        full = np.where(first == mine[:, None], -np.inf, some @ layout[:, first])
        reach = np.partition(full, -k, axis=1)[:, -k] if first.size >= k else np.full(len(some), -np.inf)
        alive, partial, rows = np.arange(n), np.zeros((len(some), n)), layout
        for i, a in enumerate(cuts):
            partial += some[:, a : a + step] @ rows[a : a + step]
            if i + 1 < len(cuts):
                # a little slack: roots are rounded, integer scores are not
                bound = partial + asked[i + 1, at : at + batch, None] * masses[i + 1, alive] * (1 + 1e-9) + 1e-6
                keep = (bound >= reach[:, None]).any(axis=0)
                if keep.sum() * 2 < alive.size:
                    alive, partial, rows = alive[keep], partial[:, keep], rows[:, keep]
        partial[alive == mine[:, None]] = -np.inf
        for scores in partial:
            last = np.partition(scores, -k)[-k] if scores.size > k else -np.inf
            places = np.flatnonzero((scores >= last) & (scores > -np.inf))
            top = places[np.lexsort((rank[alive[places]], -scores[places]))][:k]
            out.append((alive[top], scores[top]))
    return out


def _exact_block(layout: np.ndarray, query: np.ndarray, own: int, k: int, rank: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """The same in Python integers, where sums may pass 2**53."""
    alive = [i for i in range(layout.shape[1]) if i != own]
    scores = {i: sum(int(a) * int(b) for a, b in zip(layout[:, i].tolist(), query.tolist())) for i in alive}
    top = sorted(alive, key=lambda i: (-scores[i], rank[i]))[:k]
    return np.array(top, np.int64), [scores[i] for i in top]


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, candidate_block: int = 32_768, query_block: int = 2_048) -> DataFrame:
    """vectors (vec_id long, embedding) -> (query_row, query_id, rank, vec_id, score) of the rows that fulfil is_query.

    The data that moves is (candidates x query blocks + queries x candidate blocks) / block
    count; the work is the product of both, as an exact search of a stated query set needs.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), integral("embedding").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = written(rows.where("v is not null").withColumn("row", F.monotonically_increasing_id()), "vectors")
    n, n_queries = rows.agg(F.count("*"), F.count_if("q")).first()
    blocks, query_blocks = max(1, -(-n // candidate_block)), max(1, -(-n_queries // query_block))
    # a block is a residue of a mixed row number: even blocks whatever the ids
    block = lambda of: F.pmod(F.xxhash64("row"), F.lit(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    candidates = rows.select("row", "vec_id", "v", block(blocks).alias("c"), every(query_blocks).alias("b"))
    queries = rows.where("q").select("row", "vec_id", "v", block(query_blocks).alias("b"), every(blocks).alias("c"))

    def matrix(table: pa.Table, width: int) -> np.ndarray:
        return table.column("v").combine_chunks().flatten().to_numpy().reshape(-1, width)

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"query_row": [], "query_id": [], "vec_id": [], "score": []}
        if left.num_rows and right.num_rows:
            ids = left.column("vec_id").combine_chunks()
            rank = np.where(ids.is_null().to_numpy(zero_copy_only=False), np.iinfo(np.int64).max, ids.fill_null(0).to_numpy())
            width = pa.compute.list_value_length(left.column("v"))
            for size in pa.compute.unique(width).to_pylist():  # vectors meet only those of their length
                some, asked = left.filter(pa.compute.equal(width, size)), right.filter(pa.compute.equal(pa.compute.list_value_length(right.column("v")), size))
                if not asked.num_rows:
                    continue
                layout = np.ascontiguousarray(matrix(some, size).T)
                place = {r: i for i, r in enumerate(some.column("row").to_pylist())}
                order = rank[pa.compute.equal(width, size).to_numpy()]
                names = some.column("vec_id").to_pylist()
                wants = matrix(asked, size)
                small = size * float(np.abs(layout).max()) * float(np.abs(wants).max()) < EXACT and size * float(np.abs(layout).max()) ** 2 < EXACT
                own = np.array([place.get(r, -1) for r in asked.column("row").to_pylist()])
                best = best_of_block(layout, wants, own, k, order) if small else [_exact_block(layout, w, o, k, order) for w, o in zip(wants, own)]
                for row, name, (found, scores) in zip(asked.column("row").to_pylist(), asked.column("vec_id").to_pylist(), best):
                    out["query_row"] += [row] * len(found)
                    out["query_id"] += [name] * len(found)
                    out["vec_id"] += [names[i] for i in found]
                    out["score"] += [int(x) for x in scores]
        return pa.table({c: pa.array(x, pa.int64()) for c, x in out.items()})

    found = candidates.groupBy("c", "b").cogroup(queries.groupBy("c", "b")).applyInArrow(search, "query_row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def query(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, F.col("vec_id") % 50 == 0).select("query_id", "rank", "vec_id", "score")


SQL = """
with v as (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
           where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.r, q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e)::bigint as score from v q join v c on q.r <> c.r where q.vec_id % 50 = 0),
r as (select query_id, row_number() over (partition by r order by score desc, vec_id)::int as rank, vec_id, score from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""
