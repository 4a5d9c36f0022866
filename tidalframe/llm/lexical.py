"""Operator 11: ranked lexical search, a document at a time.

1. `build` cuts the documents that a task reads into shards of bounded text. In a shard
   documents are numbered in the order of their ids; each term has a row with its
   postings: gaps of those numbers and frequencies as variable-length integers. A row
   without a term holds the shard's ids and lengths.
2. Counts of documents and terms, and document frequencies of the asked terms, are sums
   over those rows.
3. For each (shard, block of queries) one task merges the postings of all asked terms
   with a heap of cursors, keyed by the next document. What a document gains from its
   terms is added up for every query of the block at once, and each query keeps its k
   best in a bounded heap keyed by score, then id.
4. The shards' best are merged by rank.

No text moves: only postings of asked terms do, and a shard's group is bounded by its text
whatever terms are frequent.

Nulls and edges: a null or blank text has no terms and isn't counted; rows that share an
id are documents of their own; a null id comes after all others of its score; a query
without terms, or whose terms no document has, has no rows; repeated queries are ranked
each; a long text is a shard of its own. Extra columns take no part, whatever their names;
without documents or queries there are no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidalframe.llm.common import lean, slices, written

#: What a byte counts as: ASCII letters and digits as themselves in lower case, bytes of other characters as they are, the rest as a space.
FOLDED = bytes(ord(c.lower()) if (c := chr(b)).isalnum() else 32 for b in range(128)) + bytes(range(128, 256))
#: The same as a pattern of terms.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

INDEX = "shard long, term string, df long, total long, postings binary, ids array<long>, lengths array<long>"


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLDED).split()


def packed(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Variable-length bytes of non-negative numbers, 7 bits each, lowest first; and how many bytes each takes."""
    sizes = np.ones(numbers.size, np.int64)
    for bits in range(7, 63, 7):
        sizes += numbers >= (1 << bits)
    out, starts = np.empty(int(sizes.sum()), np.uint8), np.cumsum(sizes) - sizes
    for j in range(int(sizes.max(initial=0))):
        on = sizes > j
        out[starts[on] + j] = ((numbers[on] >> (7 * j)) & 127) | ((sizes[on] > j + 1) << 7)
    return out, sizes


def unpacked(raw: np.ndarray) -> np.ndarray:
    """The numbers of packed() bytes."""
    if not raw.size:
        return np.zeros(0, np.int64)
    stops = np.flatnonzero(raw < 128)
    starts = np.concatenate(([0], stops[:-1] + 1))
    shift = 7 * (np.arange(raw.size) - np.repeat(starts, stops - starts + 1))
    return np.add.reduceat((raw & 127).astype(np.int64) << shift, starts)


def shard_rows(shard: int, ids: pa.Array, texts: pa.Array) -> pa.RecordBatch | None:
    """One shard's rows of the index; None if no text has a term."""
    raw = pc.fill_null(texts, "").cast(pa.large_binary())
    stops = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    folded = pa.LargeStringArray.from_buffers(len(raw), pa.py_buffer((stops - stops[0]).tobytes()), pa.py_buffer(raw.buffers()[2][stops[0] : stops[-1]].to_pybytes().translate(FOLDED)))
    lists = pc.split_pattern(folded, " ")
    pieces = lists.flatten().dictionary_encode()
    text, codes = np.repeat(np.arange(len(raw)), pc.list_value_length(lists).to_numpy()), pieces.indices.to_numpy()
    real = pc.greater(pc.binary_length(pieces.dictionary), 0).to_numpy(zero_copy_only=False)[codes]
    text, codes = text[real], codes[real]
    if not text.size:
        return None
    lengths = np.bincount(text, minlength=len(raw))
    # documents with terms, numbered by id, null ids last
    order = np.lexsort((pc.fill_null(ids, 0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), lengths == 0))
    order = order[: int((lengths > 0).sum())]
    place = np.empty(len(raw), np.int64)
    place[order] = np.arange(order.size)
    pairs, tf = np.unique(codes.astype(np.int64) * order.size + place[text], return_counts=True)
    code, doc = pairs // order.size, pairs % order.size
    first = np.concatenate(([True], code[1:] != code[:-1]))
    gap = np.where(first, doc, np.concatenate(([0], doc[:-1])))
    gap = np.where(first, doc, doc - gap - 1)
    body, sizes = packed(np.column_stack((gap, tf - 1)).ravel())
    at = np.flatnonzero(first)
    ends = np.append(np.cumsum(sizes.reshape(-1, 2).sum(axis=1))[np.append(at[1:], pairs.size) - 1], [])
    df = np.diff(np.append(at, pairs.size))
    postings = pa.LargeBinaryArray.from_buffers(pa.large_binary(), df.size, [None, pa.py_buffer(np.concatenate(([0], ends)).astype(np.int64).tobytes()), pa.py_buffer(body.tobytes())])
    names = pieces.dictionary.take(pa.array(code[at])).cast(pa.string())
    n, header = df.size + 1, lambda x, kind: pa.array([None] * df.size + [x], kind)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(n, shard)),
            pa.concat_arrays([names, pa.nulls(1, pa.string())]),
            pa.array(np.append(df, order.size)),
            header(int(lengths.sum()), pa.int64()),
            pa.concat_arrays([postings.cast(pa.binary()), pa.nulls(1, pa.binary())]),
            header(ids.take(pa.array(order)).to_pylist(), pa.list_(pa.int64())),
            header(lengths[order].tolist(), pa.list_(pa.int64())),
        ],
        ["shard", "term", "df", "total", "postings", "ids", "lengths"],
    )


def build(docs: DataFrame, shard_bytes: int = 8 << 20) -> DataFrame:
    """docs (doc_id, text) -> the index, every row of docs in it, as a written table."""

    @lean
    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32
        for batch in slices(batches, "text", shard_bytes):
            rows = shard_rows(shard, batch.column("doc_id"), batch.column("text"))
            shard += 1
            if rows is not None:
                yield rows

    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(indexed, INDEX), "index")


def best_of_shard(lists: list[np.ndarray], gains: list[np.ndarray], wanted: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
    """For each query (a column of wanted: terms x queries of 0 and 1) its k best (score, document) over 0.

    lists: the ascending documents of each term; gains: what each of them gains there.
    """
    n, end = len(lists), 1 << 62
    cursors = [iter((docs * n + t).tolist()) for t, docs in enumerate(lists)]
    amounts = [iter(g.tolist()) for g in gains]
    heap = [next(c, end) for c in cursors]
    heapq.heapify(heap)
    best: list[list[tuple[int, int]]] = [[] for _ in range(wanted.shape[1])]
    least = np.zeros(wanted.shape[1], np.int64)
    while heap and heap[0] < end:
        doc = heap[0] // n
        here, after, found, got = doc * n, (doc + 1) * n, [], []
        while (key := heap[0]) < after:  # every cursor that stands at this document moves on
            t = key - here
            found.append(t)
            got.append(next(amounts[t]))
            heapq.heapreplace(heap, next(cursors[t], end))
        scores = np.array(got, np.int64) @ wanted[found]
        for q in np.flatnonzero(scores > least).tolist():
            entry, held = (int(scores[q]), -doc), best[q]
            if len(held) < k:
                heapq.heappush(held, entry)
            else:
                heapq.heapreplace(held, entry)
            if len(held) == k:
                least[q] = held[0][0]  # a later document must score more: its id is larger
    return [sorted(((s, -d) for s, d in held), key=lambda x: (-x[0], x[1])) for held in best]


def search(spark: SparkSession, index: DataFrame, queries: DataFrame, k: int = 10, block: int = 256, block_terms: int = 200_000) -> DataFrame:
    """queries (item_id, text) -> item_id, rank, doc_id, score: each one's k best documents of the index.

    block, block_terms: about how many queries, and terms of queries, meet a shard at a time.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted({t.decode() for t in terms(x)}) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("item"), batch.column("item_id"), pa.array(found, pa.list_(pa.string()))], ["item", "item_id", "terms"])

    items = queries.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long").alias("item_id"), "text")
    items = written(items.mapInArrow(split, "item long, item_id long, terms array<string>"), "queries")
    n_items, n_terms = items.agg(F.count("*"), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    n_docs, total = index.where("term is null").agg(F.coalesce(F.sum("df"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    blocks = max(1, -(-n_items // block), -(-n_terms // block_terms))
    asked = items.select("item", F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int").alias("block"), F.explode("terms").alias("term"))
    wanted = asked.groupBy("term", "block").agg(F.array_sort(F.collect_list("item")).alias("items"))
    postings = index.where("term is not null")
    df = postings.join(asked.select("term").distinct(), "term").groupBy("term").agg(F.sum("df").alias("n"))
    weight = F.floor(1000 * F.log(F.lit(float(2 * n_docs + 2)) / (2 * F.col("n") + 1)))
    wanted = written(wanted.join(df, "term").select("term", "block", "items", weight.alias("w")), "wanted")
    hits = postings.select("shard", "term", "postings").join(wanted, "term").select("shard", "block", "items", "w", "postings", F.lit(None).cast("array<long>").alias("ids"), F.lit(None).cast("array<long>").alias("lengths"))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    heads = index.where("term is null").select("shard", every.alias("block"), F.lit(None).cast("array<long>").alias("items"), F.lit(None).cast("long").alias("w"), F.lit(None).cast("binary").alias("postings"), "ids", "lengths")

    def ranked(group: pa.Table) -> pa.Table:
        is_head = pc.is_valid(group.column("ids"))
        head, rows = group.filter(is_head), group.filter(pc.invert(is_head))
        out: dict[str, list] = {"item": [], "doc_id": [], "score": []}
        if rows.num_rows:
            ids = head.column("ids")[0].as_py()
            m = np.array([100 - 90 + 90 * n * n_docs // total for n in head.column("lengths")[0].as_py()], np.int64)
            lists, gains = [], []
            for w, raw in zip(rows.column("w").to_pylist(), rows.column("postings").to_pylist()):
                gap, tf = unpacked(np.frombuffer(raw, np.uint8)).reshape(-1, 2).T
                docs, tf = np.cumsum(gap + 1) - 1, tf + 1
                lists.append(docs)
                gains.append(w * (1_000_000_000 * tf // (1000 * tf + 8 * m[docs])))
            named = rows.column("items").combine_chunks()
            items, where = np.unique(named.flatten().to_numpy(), return_inverse=True)
            takes = np.zeros((rows.num_rows, items.size), np.int64)
            takes[np.repeat(np.arange(rows.num_rows), pc.list_value_length(named).to_numpy()), where] = 1
            for item, found in zip(items.tolist(), best_of_shard(lists, gains, takes, k)):
                out["item"] += [item] * len(found)
                out["doc_id"] += [ids[d] for _, d in found]
                out["score"] += [s for s, _ in found]
        return pa.table({c: pa.array(x, pa.int64()) for c, x in out.items()})

    found = hits.unionByName(heads).groupBy("shard", "block").applyInArrow(ranked, "item long, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.join(items.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def weight(n_docs: int, df: int) -> int:
    """A term's weight, as the search gives it."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = build(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return search(spark, index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_FOLD = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL = f"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all({_FOLD}, '{TERM}') as t from documents where text is not null),
docs as (select r, doc_id, len(t) as n from d where len(t) > 0),
g as (select count(*) as nn, sum(n)::bigint as ll from docs),
q as (select row_number() over () as i, item_id, list_distinct(regexp_extract_all({_FOLD}, '{TERM}')) as t from benchmark where text is not null),
qt as (select i, item_id, unnest(t) as term from q),
tf as (select r, term, count(*) as tf from (select r, unnest(t) as term from d) where term in (select term from qt) group by r, term),
w as (select term, floor(1000 * ln((2 * nn + 2)::double / (2 * df + 1)))::bigint as w from (select term, count(*) as df from tf group by term), g),
s as (select qt.i, qt.item_id, docs.doc_id, docs.r, sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (100 - 90 + (90 * docs.n * g.nn) // g.ll))))::bigint as score
      from qt join tf on qt.term = tf.term join w on w.term = qt.term join docs on docs.r = tf.r, g group by all),
k as (select item_id, row_number() over (partition by i order by score desc, doc_id, r)::int as rank, doc_id, score from s where score > 0)
select item_id, rank, doc_id, score from k where rank <= 10
"""
