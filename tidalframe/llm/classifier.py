"""Operator 9: a quality classifier on random-indexing word vectors.

Words: runs of letters and digits, and runs of other signs, each hashed to one of
`buckets` rows; an all-capitals word also counts as the word <upper>. Every bucket has
a fixed sparse random index vector; its context vector is the sum of the index vectors
of its neighbours in all texts (labels take no part in it), gathered in Spark as integer
sums, so the order of tasks doesn't matter. A text's vector pools its words' index and context
vectors: their mean over all words and over the distinct ones, with the text's length,
how far few words make it up and how often neighbours agree. A two-layer numpy network turns it into a score; a temperature fitted
on rows the network hasn't seen calibrates it.

The network's fit uses at most about `max_rows` labelled documents (chosen by a hash of the
id) with their whole texts; every text is scored. Labels, language, source and id are no
inputs.

Nulls and edges: a null or empty text has the zero vector and still gets a score. A
document labelled more than once counts with its lowest label, and one whose rows repeat
with its first text in order, once; null labels are no labels. Without rows of both
labels the score is the share of label 1 (1/2 if none); an empty table gives none. Equal
texts get equal scores; a long text is pooled whole; columns besides the text go along.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidalframe.llm.common import as_bytes, lean, remainder, sampled, slices, written

_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^\s0-9A-Za-z\x80-\xff]+")


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 14
    dims: int = 48
    nonzero: int = 6
    window: int = 2
    hidden: int = 32
    epochs: int = 60
    max_rows: int = 6000
    seed: int = 7


class Words(dict):
    """word -> bucket, remembered."""

    def __init__(self, buckets: int):
        self.buckets = buckets

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        found = self[word] = xxhash.xxh32_intdigest(word) % self.buckets
        return found


def buckets_of(text: bytes, words: Words) -> np.ndarray:
    found = _WORD.findall(text)
    ids = [words[w] for w in found]
    upper = sum(1 for w in found if len(w) > 1 and w.isupper())
    return np.array(ids + [words[b"<upper>"]] * upper, dtype=np.int64)


def index_vectors(s: Settings) -> np.ndarray:
    """For each bucket a sparse vector of `nonzero` places with +1 or -1."""
    rng = np.random.default_rng(s.seed)
    out = np.zeros((s.buckets, s.dims), np.int8)
    places = rng.random((s.buckets, s.dims)).argsort(axis=1)[:, : s.nonzero]
    np.put_along_axis(out, places, rng.choice(np.array([-1, 1], np.int8), places.shape), axis=1)
    return out


_BLOCK = 1024
_FAN, _LEVELS = 96, 3


def neighbour_sums(ids: np.ndarray, gaps: np.ndarray, index: np.ndarray, s: Settings) -> np.ndarray:
    """For each bucket the sum of its neighbours' index vectors; ids: buckets, text after text; gaps: the number of each id's text."""
    pairs = []
    for k in range(1, s.window + 1):
        together = np.flatnonzero(gaps[k:] == gaps[:-k])
        pairs.append(ids[together] * s.buckets + ids[together + k])
    pairs, n = np.unique(np.concatenate(pairs), return_counts=True)
    out = np.zeros(s.buckets * s.dims, np.int64)
    places = np.argsort(index == 0, axis=1, kind="stable")[:, : s.nonzero]
    signs = np.take_along_axis(index, places, axis=1)
    for one, other in ((pairs // s.buckets, pairs % s.buckets), (pairs % s.buckets, pairs // s.buckets)):
        for j in range(s.nonzero):
            out += np.bincount(one * s.dims + places[other, j], weights=n * signs[other, j], minlength=out.size).astype(np.int64)
    return out.reshape(s.buckets, s.dims)


def context_vectors(docs: DataFrame, s: Settings) -> np.ndarray:
    """The neighbours' index vectors of each bucket, summed over all texts and brought to length 1."""

    @lean
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, words = index_vectors(s), Words(s.buckets)
        total = np.zeros((s.buckets, s.dims), np.int64)
        for batch in slices(batches, "text", 1 << 20):
            found = [buckets_of(text, words) for text in as_bytes(batch.column("text"))]
            if found:
                total += neighbour_sums(np.concatenate(found), np.repeat(np.arange(len(found)), [x.size for x in found]), index, s)
        used = [b for b in range(0, s.buckets, _BLOCK) if total[b : b + _BLOCK].any()]
        small = np.int32 if np.abs(total).max() < 2**31 else np.int64
        rows = [used, [TaskContext.get().partitionId()] * len(used), [small(0).nbytes] * len(used), [total[b : b + _BLOCK].astype(small).tobytes() for b in used]]
        yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int32()) for x in rows[:3]), pa.array(rows[3], pa.binary())], ["block", "part", "width", "sums"])

    def merge(table: pa.Table) -> pa.Table:
        total = np.zeros((), np.int64)
        for part in table.to_batches(max_chunksize=64):
            for width, sums in zip(part.column("width").to_pylist(), part.column("sums").to_pylist()):
                total = total + np.frombuffer(sums, f"<i{width}")
        first = {c: table.column(c)[:1].combine_chunks() for c in ("block", "part")}
        return pa.table(first | {"width": pa.array([8], pa.int32()), "sums": pa.array([total.astype(np.int64).tobytes()], pa.binary())})

    # a task leaves at most buckets x dims numbers, however many texts it has; so do all of them together
    # and the sums of _FAN tasks at a time are merged, in levels, so no group grows with the number of tasks
    kinds = "block int, part int, width int, sums binary"
    parts = docs.select("text").mapInArrow(partial, kinds)
    for _ in range(_LEVELS):
        parts = parts.withColumn("part", F.floor(F.col("part") / _FAN).cast("int")).groupBy("block", "part").applyInArrow(merge, kinds)
    out = np.zeros((s.buckets, s.dims))
    for row in parts.collect():  # one row a block, or a few beyond _FAN ** _LEVELS tasks
        block = np.frombuffer(row["sums"], np.int64).reshape(-1, s.dims)
        out[row["block"] : row["block"] + len(block)] += block
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-6)).astype(np.float32)


LAGS = (1, 2)


def width(table: np.ndarray) -> int:
    return 2 * table.shape[1] + 2 + len(LAGS)


def pooled(text: bytes, table: np.ndarray, words: Words) -> np.ndarray:
    """Mean of the words' rows and mean of the distinct words' rows, how far a few words
    make up the text (root of the sum of squared shares), its length (log), and how often
    words agree with their neighbours."""
    found = buckets_of(text, words)
    if not found.size:
        return np.zeros(width(table), np.float32)
    alike = [(found[k:] == found[:-k]).mean() if found.size > k else 0.0 for k in LAGS]
    counts = Counter(found.tolist())
    ids = np.fromiter(counts, np.int64, len(counts))
    shares = np.fromiter(counts.values(), np.float32, len(counts))
    n = shares.sum()
    shares /= n
    weights = np.stack((shares, np.full(len(ids), 1 / len(ids), np.float32)))
    return np.concatenate(((weights @ table[ids]).ravel(), [np.sqrt((shares**2).sum()), np.log1p(n), *alike])).astype(np.float32)


@dataclass
class Model:
    """What a worker needs to score a text: the word table and a two-layer network."""

    settings: Settings
    table: np.ndarray | None
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    w1: np.ndarray | None = None
    b1: np.ndarray | None = None
    w2: np.ndarray | None = None
    b2: float = 0.0
    temperature: float = 1.0
    constant: float | None = None

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))


def train_network(model: Model, x: np.ndarray, y: np.ndarray) -> None:
    """Full passes of Adam over shuffled mini-batches, log loss with a little weight decay."""
    s, rng = model.settings, np.random.default_rng(model.settings.seed)
    model.mean, model.scale = x.mean(axis=0), x.std(axis=0) + 1e-4
    z = (x - model.mean) / model.scale
    d, h = z.shape[1], s.hidden
    params = [rng.normal(0, (2 / d) ** 0.5, (d, h)), np.zeros(h), rng.normal(0, (1 / h) ** 0.5, h), np.zeros(1)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    step = 0
    for _ in range(s.epochs):
        order = rng.permutation(len(z))
        for at in range(0, len(z), 128):
            rows = order[at : at + 128]
            a, t = z[rows], y[rows]
            hidden = np.maximum(a @ params[0] + params[1], 0)
            error = (1 / (1 + np.exp(-np.clip(hidden @ params[2] + params[3], -60, 60))) - t) / len(rows)
            back = np.outer(error, params[2]) * (hidden > 0)
            grads = [a.T @ back + 1e-4 * params[0], back.sum(axis=0), hidden.T @ error + 1e-4 * params[2], error.sum(keepdims=True)]
            step += 1
            for p, g, (m, v) in zip(params, grads, moments):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= 0.003 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    model.w1, model.b1, model.w2, model.b2 = *params[:3], float(params[3][0])


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits with the least log loss on rows that the network hasn't seen."""
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
    loss = [np.mean(np.logaddexp(0, np.where(y > 0, -1, 1) * logits / t)) for t in grid]
    return float(grid[int(np.argmin(loss))])


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Model:
    """Learn from labelled rows of docs (doc_id, text); held-out rows must not be among labels."""
    labels = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = written(labels.where(sampled("doc_id", s.max_rows, labels.count())), "labels")
    # about max_rows ids: the planner sees the written size before it broadcasts them
    train = docs.select("doc_id", "text").join(chosen, "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    train = written(train, "training")
    context = context_vectors(docs, s)
    model = Model(s, np.concatenate((index_vectors(s).astype(np.float32) / s.nonzero**0.5, context), axis=1))
    shared = train.sparkSession.sparkContext.broadcast(model.table)

    @lean
    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(s.buckets)
        for batch in batches:
            x = [pooled(t, shared.value, words).astype(np.float32).tobytes() for t in as_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(x, pa.binary())], ["doc_id", "quality", "x"])

    key = train.schema["doc_id"].dataType.simpleString()
    rows = sorted(train.mapInArrow(vectors, f"doc_id {key}, quality int, x binary").collect(), key=lambda r: (r["doc_id"], r["x"]))
    x = np.array([np.frombuffer(r["x"], np.float32) for r in rows], np.float64).reshape(len(rows), width(model.table))
    y = np.array([float(r["quality"] > 0) for r in rows])
    if len(set(y.tolist())) < 2:
        model.constant = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
        return model
    unseen = np.arange(len(y)) % 5 == 4
    if len(set(y[~unseen].tolist())) < 2 or not unseen.any():
        unseen[:] = False
    train_network(model, x[~unseen], y[~unseen])
    if unseen.any():
        model.temperature = fit_temperature(model.logits(x[unseen]), y[unseen])
    return model


def score(docs: DataFrame, model: Model, text: str | Column = "text") -> Column:
    """A column of calibrated scores; the model (some MB, whatever the input) is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    @lean
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model, words = shared.value, Words(shared.value.settings.buckets)
        for texts in batches:
            x = np.array([pooled(t, model.table, words) for t in as_bytes(texts)], np.float64).reshape(len(texts), width(model.table))
            yield pa.array(model.scores(x), pa.float64())

    return scored(text if isinstance(text, Column) else F.col(text))


def training_labels(labels: DataFrame) -> DataFrame:
    """Labels that may be learned from: those outside the held-out quarter."""
    return labels.where(remainder("doc_id", 4) != 2)


THRESHOLD = 0.7


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, training_labels(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    out = docs.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), score(docs, model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier doesn't reject, with the columns of docs."""
    return docs.where(score(docs, fit(docs, training_labels(labels))) >= THRESHOLD)
