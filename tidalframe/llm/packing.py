"""Operator 6: order-preserving packing of documents into sequences by dynamic programming.

Documents follow one another in the order of their rows in each partition. A sequence
is a run of at most `capacity` tokens. Cuts may fall at document ends, at sentence ends
and, inside a stretch without either, every `grid` tokens. Over all cut points j,

    f(j) = penalty(j) + sequence_cost + min over i of f(i) + padding(j - i)

padding(n) is 0 where n is a power of two (such a sequence is not padded), else
capacity - n. The second is linear in i, so its minimum over the last `capacity` tokens
is the front of a monotone queue of f(i) + i; powers of two are ten more transitions.
Cut points are tens of tokens apart, so this is a small share of the tokenizer's time.

Nothing is shuffled: tasks stream Arrow batches and pack `chunk` tokens at a time, so
memory doesn't grow with the partition. A sequence's id is its task's partition number,
shifted, plus a count, and a task that runs again gives the same ids.

Nulls and edges: a null text counts as empty, and an empty document is its end token
alone. A null id is passed on. Repeated rows are packed each for itself. Other columns
of docs, whatever their names, take no part; an empty table has no pieces; a long text
is a batch of its own and may fill many sequences. What spells a special token is
ordinary text unless `special_strings` is set.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidalframe.llm.common import give_back, lean, slices
from tidalframe.llm.tokens import cached_encoder, with_end


@dataclass(frozen=True)
class Settings:
    tokenizer: str = public_tokenizers.path("byte_bpe_50k.json")
    end_id: int = 0
    capacity: int = 1024
    sentence_penalty: float = 4.0
    hard_penalty: float = 16.0
    sequence_cost: float = 8.0
    grid: int = 64
    chunk: int = 1 << 19
    slice_bytes: int = 10 << 20
    remembered: int = 400_000  # words of the encoder
    thrifty: bool = False  # give freed memory back after every chunk, not just at the end
    special_strings: bool = False


def cut_points(ends: np.ndarray, sentences: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Places where a sequence may end, ascending, and the penalty of each; place 0 comes first."""
    soft = np.union1d(ends, sentences)
    before = np.concatenate(([0], soft[:-1]))
    wide = np.flatnonzero(soft - before > 2 * s.grid)
    hard = np.concatenate([np.arange(a + s.grid, b, s.grid) for a, b in zip(before[wide], soft[wide])] or [np.empty(0, np.int64)])
    points = np.concatenate(([0], soft, hard)).astype(np.int64)
    penalty = np.concatenate(([0.0], np.where(np.isin(soft, ends), 0.0, s.sentence_penalty), np.full(hard.size, s.hard_penalty)))
    order = np.argsort(points, kind="stable")
    return points[order], penalty[order]


def best_cuts(points: np.ndarray, penalty: np.ndarray, s: Settings) -> list[int]:
    """Indices into points where the cheapest packing cuts, the last point included."""
    n = points.size
    powers = [1 << k for k in range(s.capacity.bit_length())]
    before = [np.searchsorted(points, points - length) for length in powers]
    hits = [np.flatnonzero(points[at] == points - length) for at, length in zip(before, powers)]
    to, source = np.concatenate(hits), np.concatenate([at[h] for at, h in zip(before, hits)])
    order = np.argsort(to, kind="stable")
    ahead = np.searchsorted(to[order], np.arange(n + 1)).tolist()  # the power-of-two transitions into j
    source = source[order].tolist()
    place, extra = points.tolist(), (penalty + s.sequence_cost).tolist()
    cost, back = [0.0] * n, [0] * n
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])
    for j in range(1, n):
        p = place[j]
        while place[queue[0][1]] < p - s.capacity:
            queue.popleft()
        least, i = queue[0]
        least += s.capacity - p
        for x in source[ahead[j] : ahead[j + 1]]:
            if cost[x] < least:
                least, i = cost[x], x
        cost[j] = least = least + extra[j]
        back[j] = i
        least += p
        while queue and queue[-1][0] > least:
            queue.pop()
        queue.append((least, j))
    cuts, j = [], n - 1
    while j:
        cuts.append(j)
        j = back[j]
    return cuts[::-1]


def pack(lengths: np.ndarray, is_sentence_end: np.ndarray, s: Settings) -> tuple[np.ndarray, ...]:
    """Token counts of documents, and for each token whether a sentence ends with it
    -> document, start in it, length, sequence and offset of each piece."""
    ends = np.cumsum(lengths)
    points, penalty = cut_points(ends, np.flatnonzero(is_sentence_end) + 1, s)
    windows = points[best_cuts(points, penalty, s)]
    stops = np.union1d(windows, ends)
    starts = np.concatenate(([0], stops[:-1]))
    doc, window = np.searchsorted(ends, starts, "right"), np.searchsorted(windows, starts, "right")
    doc_start = ends - lengths
    window_start = np.concatenate(([0], windows[:-1]))
    return doc, starts - doc_start[doc], stops - starts, window, starts - window_start[window]


PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def packed(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """docs (doc_id, text) -> one row per piece: doc_id and the columns of PIECES."""
    docs = docs.select("doc_id", "text")
    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL(PIECES).fields])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = cached_encoder(s.tokenizer, False, s.special_strings, s.remembered)
        ends_sentence = np.zeros(encoder.width.size, bool)
        for token, i in encoder.tokenizer.get_vocab(with_added_tokens=False).items():
            ends_sentence[i] = token[-1] in ".!?Ċ"  # the last is the vocabulary's newline
        base, used = TaskContext.get().partitionId() << 40, 0
        names: list[pa.Array] = []
        ids: list[np.ndarray] = []
        counts: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            nonlocal used
            lengths, tokens = np.concatenate(counts), np.concatenate(ids)
            stream = memoryview(tokens.astype("<u4", copy=False)).cast("B")
            doc, start, length, window, offset = pack(lengths, ends_sentence[tokens], s)
            at = ((np.cumsum(lengths) - lengths)[doc] + start) * 4
            crc = [zlib.crc32(stream[a:b]) for a, b in zip(at.tolist(), (at + length * 4).tolist())]
            columns = [pa.concat_arrays(names).take(pa.array(doc)), start, length, np.array(crc, np.int64), lengths[doc], base + used + window, offset]
            used += int(window[-1]) + 1
            names.clear(), ids.clear(), counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], schema.names)

        for batch in slices(batches, "text", s.slice_bytes):
            found, n = with_end(*encoder.encode(batch.column("text")), s.end_id)
            names.append(batch.column("doc_id")), ids.append(found), counts.append(n)
            if sum(x.size for x in ids) >= s.chunk:
                yield flush()
                if s.thrifty:
                    give_back()
        if names:
            yield flush()

    return docs.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
