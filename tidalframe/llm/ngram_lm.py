"""Operator 10: language-model scores from an Elias-Fano n-gram trie.

The model is a word trigram model: every word of the training texts is a context and a
successor of its own, so what is counted grows with the input. Two STARTs stand before a
text. With training counts c, N tokens and V distinct ones,

    P1(w)      = (c(w) + 0.5) / (N + 0.5 (V + 1)), also for the one unknown word
    P2(w | v)  = (c(v, w) + mu2 P1(w)) / (c(v) + mu2)
    P(w | u v) = (c(u, v, w) + mu3 P2(w | v)) / (c(u, v) + mu3)

so every context's probabilities sum to one.

Plan. A first pass finds the hot words: those that make up at least 1 / hot_share of the
corpus. The second packs, for a run of texts (a batch), the distinct n-grams with their
training counts, one row per shard; words are dealt by their hash, bigrams by theirs, and
a trigram lies with its first two words, its context. A context of two hot words is
split by its successors into parts, each an entry of its own, as many as its share of the
shards can be. Keys stand once per batch and shard, so no word, bigram or context is hot.
A shard adds up the counts, builds its trie in a memory-mapped scratch file, and answers
every batch's row in its order. A batch's texts come along as places in its list of
words; with all shards' answers they are scored text by text.

Trie of a shard: words and contexts are Elias-Fano sequences of hashes, with exact counts
as Elias-Fano sequences of running sums. A monotone pointer leads from each context to its
successors, which are stored relative to it (context's place, then 32 bits of the word's
hash) with a 16-bit code of the smoothed share c(u, v, w) / (c + mu3), c the context's or
part's count. A question looks up the context, and searches its successors only, between
its pointer and the next.

`fit` stores the tries of all shards as a table, and `score` applies it to other texts;
`scored`, which the query uses, does both in one exchange and stores nothing.

Words and bigrams are told apart by 20 bits of hash more than the number of tokens has, in
whole bytes (so that at any size about one question in a million could meet a stranger's
count), a context's successors by 32. Nulls and edges: a null text counts as empty and has the end token only; a null id's remainder is
that of empty text; repeated rows are scored each; an empty table gives one; other columns
of docs, whatever their names, take no part. Without training texts every token is unknown.
A long text is a batch of its own, so a task must hold its tokens.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidalframe.llm.common import mixed, remainder, slices, token_codes, written
from tidalframe.llm.elias_fano import EliasFano, mapped

START_KEY = np.uint64(xxhash.xxh64_intdigest(b"\n\n"))
RELATIVE = 32  # bits of a successor's hash


@dataclass(frozen=True)
class Settings:
    mu2: float = 100.0
    mu3: float = 20.0
    batch_bytes: int = 8 << 20
    shard_tokens: int = 1 << 20
    hot_share: int = 1 << 14
    lowest: float = -12.0


def _packed(*columns: tuple[np.ndarray, int]) -> bytes:
    """(unsigned integers, bytes of each that count) -> their bytes, all first ones, then all second ones, ..., compressed."""
    raw = [np.ascontiguousarray(v.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)[:, :w].T).tobytes() for v, w in columns]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(raw))


def _unpacked(body: bytes, *columns: tuple[int, int]) -> list[np.ndarray]:
    """_packed() undone; columns: (how many, bytes of each)."""
    raw, out, at = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8), [], 0
    for n, w in columns:
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :w] = raw[at : at + n * w].reshape(w, n).T
        out.append(wide.view("<u8").ravel())
        at += n * w
    return out


def _ordered(values: np.ndarray, bits: int) -> np.ndarray:
    """np.argsort of integers below 2**bits; values and places are sorted as one number where that fits."""
    room = max(1, values.size - 1).bit_length()
    if bits + room > 63:
        return np.argsort(values, kind="stable")
    return np.sort(values.astype(np.int64) << room | np.arange(values.size)) & ((1 << room) - 1)


def _distinct(values: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray]:
    """np.unique with the inverse."""
    order = _ordered(values, below.bit_length())
    ascending = values[order]
    new = np.append(True, ascending[1:] != ascending[:-1])[: values.size]
    inverse = np.empty(values.size, np.int32)
    inverse[order] = np.cumsum(new, dtype=np.int32) - 1
    return ascending[new], inverse


@dataclass
class Deal:
    """What all tasks know: how many shards there are, how long keys are, and the hot words (at
    most 2 * hot_share) with their shares."""

    shards: int
    width: int  # bytes of a word's or bigram's key, the first ones of its hash
    hot: np.ndarray  # ascending keys
    share: np.ndarray  # of all tokens, at most

    @property
    def bits(self) -> int:
        return 8 * self.width

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        return hashes >> np.uint64(64 - self.bits)

    def shares(self, words: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hot, words), max(0, self.hot.size - 1))
        return np.where(self.hot[at] == words, self.share[at], 0.0) if self.hot.size else np.zeros(words.size)

    def home(self, keys: np.ndarray) -> np.ndarray:
        """The shard of each key; ascends with the keys."""
        return (((keys >> np.uint64(self.bits - 32)) * np.uint64(self.shards)) >> np.uint64(32)).astype(np.int64)


def dealt(docs: DataFrame, s: Settings) -> Deal:
    """Counts, batch by batch, the words that make up 1 / hot_share of it: their sums miss less than that share of the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", s.batch_bytes):
            words, at, _ = token_codes(batch.column("text"))
            n = np.bincount(at)
            often = n * s.hot_share >= at.size
            names = pa.array([None, *words[often].view(np.int64).tolist()], pa.int64())
            yield pa.RecordBatch.from_arrays([names, pa.array([at.size, *n[often].tolist()], pa.int64())], ["key", "n"])

    sums = written(docs.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "hot-words")
    tokens = sums.where("key is null").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    rows = sums.where(F.col("key").isNotNull() & (F.col("n") * (2 * s.hot_share) >= tokens)).collect()  # at most 2 * hot_share
    hot = np.array([r["key"] for r in rows], np.int64).view(np.uint64)
    share = np.array([r["n"] for r in rows]) / max(1, tokens) + 1 / s.hot_share
    order = np.argsort(hot)
    shards = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-tokens // s.shard_tokens))
    deal = Deal(shards, min(8, max(5, -(-(tokens.bit_length() + 20) // 8))), hot[order], share[order])
    deal.hot = deal.keys(deal.hot)
    return deal


@dataclass
class Grams:
    """The distinct n-grams of a batch in the order in which they are dealt, and where each position's are."""

    last: np.ndarray  # per position: the word before it, as a place in words; their number for START
    entries: np.ndarray  # keys of bigrams, and of the parts of split contexts; they ascend in their first 40 bits
    start: int  # the entry of the context START START
    bigram: np.ndarray  # per position: the entry of its bigram
    context: np.ndarray  # per position: the entry of the bigram before it
    holder: np.ndarray  # per position: the entry that its trigram lies with, the context or its part
    trigram: np.ndarray  # per position: its place in successors
    fan: np.ndarray  # successors of each entry
    successors: np.ndarray  # their hashes' first bits, ascending within an entry


def grams(words: np.ndarray, at: np.ndarray, counts: np.ndarray, deal: Deal) -> Grams:
    """words: ascending keys; at: places in words, text after text; counts: of tokens."""
    d, first = words.size, np.cumsum(counts) - counts
    last = np.concatenate(([d], at[:-1])).astype(np.int32)
    last[first] = d
    pairs, pair = _distinct(last.astype(np.int64) * (d + 1) + at, (d + 1) ** 2)
    context = np.concatenate(([0], pair[:-1])).astype(np.int32)
    context[first] = pairs.size
    hashes, shares = np.append(words, deal.keys(START_KEY)), np.append(deal.shares(words), 1.0)
    u, v = np.append(pairs // (d + 1), d).astype(np.int32), np.append(pairs % (d + 1), d).astype(np.int32)
    keys = deal.keys(mixed(hashes[u], hashes[v]))
    parts = np.minimum(deal.shards, np.ceil(2 * deal.shards * np.minimum(shares[u], shares[v]))).astype(np.int32)
    del u, v, pairs
    threes, three = _distinct(context.astype(np.int64) * d + at, keys.size * d)
    holder, w = (threes // d).astype(np.int32), (threes % d).astype(np.int32)
    start, homes = keys.size - 1, keys.size
    del threes
    split = np.flatnonzero(parts[holder] > 1)
    if split.size:
        salt = (mixed(hashes[w[split]], hashes[w[split]]) % parts[holder[split]].astype(np.uint64)).astype(np.int64)
        pieces, piece = _distinct(holder[split].astype(np.int64) * deal.shards + salt, homes * deal.shards)
        holder[split] = homes + piece
        keys = np.append(keys, deal.keys(mixed(keys[pieces // deal.shards], (pieces % deal.shards).astype(np.uint64))))
    # a few bits fewer than the keys have, so that numbers and places sort together; ties may stand in any order
    order = _ordered(keys >> np.uint64(deal.bits - 40), 40)
    rank = np.empty(order.size, np.int32)
    rank[order] = np.arange(order.size)
    holder = rank[holder]
    by = _ordered(holder, keys.size.bit_length())  # words ascend within a context already
    place = np.empty(by.size, np.int32)
    place[by] = np.arange(by.size)
    fan = np.bincount(holder, minlength=keys.size)
    return Grams(last, keys[order], int(rank[start]), rank[pair], rank[context], holder[three], place[three], fan, hashes[w[by]] >> np.uint64(deal.bits - RELATIVE))


PACKED = "shard int, batch long, texts int, words int, tokens long, entries int, successors int, body binary"
_LOCAL = -1  # the shard of a row that a batch sends itself


def _asked(docs: DataFrame, shared, s: Settings) -> DataFrame:
    """docs (doc_id, training, text) -> rows of PACKED: of each batch one for every shard, and its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deal, number = shared.value, TaskContext.get().partitionId() << 32
        for batch in slices(batches, "text", s.batch_bytes):
            words, at, counts = token_codes(batch.column("text"))
            words = deal.keys(words)
            g = grams(words, at, counts, deal)
            training = batch.column("training").to_numpy(zero_copy_only=False).astype(bool)
            learned = np.repeat(training, counts)
            sums = lambda where, n, of: np.bincount(where, weights=of, minlength=n).astype(np.uint64)
            away = g.holder != g.context
            trained = sums(g.bigram, g.entries.size, learned) + sums(g.holder[away], g.entries.size, learned[away])
            trained[g.start] = training.sum()
            of_words, of_threes = sums(at, words.size, learned), sums(g.trigram, g.successors.size, learned)
            every, ends = np.arange(deal.shards + 1), np.concatenate(([0], np.cumsum(g.fan)))
            a, b = np.searchsorted(deal.home(words), every), np.searchsorted(deal.home(g.entries), every)
            ids = batch.column("doc_id")
            flags = ids.is_null().to_numpy(zero_copy_only=False) + 2 * training
            own = _packed((ids.fill_null(0).to_numpy().view(np.uint64), 8), (flags, 1), (counts, 5), *((x, 4) for x in _by_use(at, words.size)))
            rows = [(_LOCAL, number, counts.size, words.size, at.size, 0, 0, own)]
            for i in range(deal.shards):
                w, e = slice(a[i], a[i + 1]), slice(b[i], b[i + 1])
                f = slice(ends[b[i]], ends[b[i + 1]])
                body = _packed((words[w], 8), (of_words[w], 5), (g.entries[e], 8), (trained[e], 5), (g.fan[e], 4), (g.successors[f], 4), (of_threes[f], 5))
                rows.append((i, number, 0, w.stop - w.start, 0, e.stop - e.start, f.stop - f.start, body))
                if len(rows) == 256:
                    yield _rows(rows, PACKED)
                    rows = []
            if rows:
                yield _rows(rows, PACKED)
            number += 1

    return docs.mapInArrow(run, PACKED)


def _by_use(at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """How often each of n words is used, and the words' ranks by use at each place: small numbers."""
    uses = np.bincount(at, minlength=n)
    rank = np.empty(n, np.int32)
    rank[np.argsort(-uses, kind="stable")] = np.arange(n)
    return uses, rank[at]


_ARROW = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}


def _rows(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    names, kinds = zip(*(c.split() for c in ddl.split(", ")))
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array([int(x) if k != "binary" else x for x in c], _ARROW[k]) for c, k in zip(columns, kinds)], list(names))


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct keys with their summed counts, without those never counted."""
    keys, counts = keys[counts > 0], counts[counts > 0].astype(np.int64)
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: keys.size])
    return keys[first], np.add.reduceat(counts[order], first) if first.size else counts


class Trie:
    """A shard's words, contexts and successors; see the module's text."""

    SEQUENCES = ("words", "word_sums", "contexts", "context_sums", "pointers", "successors")

    def __init__(self, words: tuple[np.ndarray, np.ndarray], contexts: tuple[np.ndarray, np.ndarray], s: Settings):
        """words and contexts: keys and training counts; learn() adds the successors."""
        self.s = s
        running = lambda counts: EliasFano(np.concatenate(([0], np.cumsum(counts))))
        (w, n), (c, m) = _summed(*words), _summed(*contexts)
        if c.size >= 1 << (64 - RELATIVE):
            raise ValueError(f"{c.size} contexts in a shard: lower shard_tokens")
        self.words, self.word_sums, self.contexts, self.context_sums = EliasFano(w), running(n), EliasFano(c), running(m)
        self.total, self.distinct = int(n.sum()), w.size

    @staticmethod
    def _counts(level: EliasFano, sums: EliasFano, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each key in a level (-1 if it isn't there) and its training count."""
        level.direct()
        at, there = level.successor(keys)
        counts = np.append(np.diff(sums.values()), 0).astype(np.int64)  # a shard's questions ask for most of them
        return np.where(there, at, -1), np.where(there, counts[np.where(there, at, -1)], 0)

    def word_counts(self, keys: np.ndarray) -> np.ndarray:
        return self._counts(self.words, self.word_sums, keys)[1]

    def context_counts(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self._counts(self.contexts, self.context_sums, keys)

    @staticmethod
    def relative(context: np.ndarray, word: np.ndarray) -> np.ndarray:
        return context.astype(np.uint64) << np.uint64(RELATIVE) | word

    def learn(self, context: np.ndarray, word: np.ndarray, counts: np.ndarray) -> None:
        """context: places (-1: none); word: the first bits of a hash."""
        known = context >= 0
        keys, n = _summed(self.relative(context[known], word[known]), counts[known])
        owner = (keys >> np.uint64(RELATIVE)).astype(np.int64)
        self.pointers, self.successors = EliasFano(np.searchsorted(owner, np.arange(self.contexts.n + 1))), EliasFano(keys)
        sizes = np.diff(self.context_sums.values()).astype(np.int64)
        share = np.log10(n / (sizes[owner] + self.s.mu3))
        self.codes = (1 + np.clip(np.round((share - self.s.lowest) / -self.s.lowest * 65534), 0, 65534)).astype(np.uint16)
        self.map()

    def map(self) -> None:
        (self.codes,) = mapped([getattr(self, x) for x in self.SEQUENCES], [self.codes])

    def shares(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The code of each word after its context (a place, -1: none), 0 if it was never seen there.

        Only the context's own successors are searched, between its pointer and the next.
        """
        out, asked = np.zeros(context.size, np.uint16), np.flatnonzero(context >= 0)
        pointers = self.pointers.values().astype(np.int64)
        self.successors.direct()
        at, there = self.successors.successor(self.relative(context[asked], word[asked]), pointers[context[asked]], pointers[context[asked] + 1])
        out[asked[there]] = self.codes[at[there]]
        return out

    def saved(self) -> bytes:
        out = io.BytesIO()
        arrays = {f"{x}.{p}": v for x in self.SEQUENCES for p, v in getattr(self, x).saved().items()}
        np.savez(out, codes=self.codes, total=self.total, distinct=self.distinct, **arrays)
        return zstandard.ZstdCompressor(level=1).compress(out.getvalue())

    @classmethod
    def loaded(cls, body: bytes, s: Settings) -> Trie:
        out = cls.__new__(cls)
        with np.load(io.BytesIO(zstandard.ZstdDecompressor().decompress(body))) as saved:
            for x in cls.SEQUENCES:
                setattr(out, x, EliasFano.loaded({p: saved[f"{x}.{p}"] for p in (*EliasFano.PARTS, "n", "width", "top")}))
            out.s, out.codes, out.total, out.distinct = s, saved["codes"], int(saved["total"]), int(saved["distinct"])
        out.map()
        return out


ANSWER = "batch long, shard int, total long, distinct long, texts int, words int, tokens long, entries int, successors int, body binary"
MODEL = "shard int, body binary"


def _questions(table: pa.Table) -> tuple[list[dict], dict[str, np.ndarray]]:
    """A shard's rows without their bodies, and the bodies' columns, all rows' one after the other."""
    rows, columns = [], {x: [np.empty(0, np.uint64)] for x in ("words", "word_n", "entries", "entry_n", "fan", "successors", "successor_n")}
    for r in (x for part in table.to_batches(max_chunksize=64) for x in part.to_pylist()):
        n, m, k = r["words"], r["entries"], r["successors"]
        found = _unpacked(r.pop("body"), (n, 8), (n, 5), (m, 8), (m, 5), (m, 4), (k, 4), (k, 5))
        for column, values in zip(columns.values(), found):
            column.append(values)
        rows.append(r)
    return rows, {x: np.concatenate(v) for x, v in columns.items()}


def _trie(q: dict[str, np.ndarray], s: Settings) -> Trie:
    trie = Trie((q["words"], q["word_n"]), (q["entries"], q["entry_n"]), s)
    q["place"], q["contexts"] = trie.context_counts(q["entries"])
    q["owner"] = np.repeat(q["place"], q["fan"].astype(np.int64))
    trie.learn(q["owner"], q["successors"], q["successor_n"])
    return trie


def _answers(table: pa.Table, s: Settings, trie: Trie | None = None) -> pa.Table:
    """Answers to a shard's rows, by a trie of their own training counts unless one is given."""
    if table.num_rows and table.column("shard")[0].as_py() == _LOCAL:
        own = [(r["batch"], _LOCAL, 0, 0, r["texts"], r["words"], r["tokens"], 0, 0, r["body"]) for r in table.to_pylist()]
        return pa.Table.from_batches([_rows(own, ANSWER)])
    rows, q = _questions(table)
    if trie is None:
        trie = _trie(q, s)
    else:
        place, q["contexts"] = trie.context_counts(q["entries"])
        q["owner"] = np.repeat(place, q["fan"].astype(np.int64))
    words, codes = trie.word_counts(q["words"]), trie.shares(q["owner"], q["successors"])
    out, a, b, c = [], 0, 0, 0
    for r in rows:
        n, m, k = r["words"], r["entries"], r["successors"]
        body = _packed((q["words"][a : a + n], 8), (words[a : a + n], 6), (q["contexts"][b : b + m], 6), (codes[c : c + k], 2))
        out.append((r["batch"], r["shard"], trie.total, trie.distinct, 0, n, 0, m, k, body))
        a, b, c = a + n, b + m, c + k
    return pa.Table.from_batches([_rows(out, ANSWER)])


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scores(table: pa.Table, deal: Deal, s: Settings) -> pa.Table:
    """A batch's texts, from its own row and all shards' answers."""
    rows = sorted(table.to_pylist(), key=lambda r: r["shard"])
    own, rows = rows[0], rows[1:]
    ids, flags, counts, uses, at = _unpacked(own["body"], (own["texts"], 8), (own["texts"], 1), (own["texts"], 5), (own["words"], 4), (own["tokens"], 4))
    counts, at = counts.astype(np.int64), np.argsort(-uses.astype(np.int64), kind="stable")[at]  # ranks by use to places
    total, distinct = sum(r["total"] for r in rows), sum(r["distinct"] for r in rows)
    found = [_unpacked(r["body"], (r["words"], 8), (r["words"], 6), (r["entries"], 6), (r["successors"], 2)) for r in rows]
    words, *others = (np.concatenate(x) for x in zip(*found))
    of_words, of_entries, codes = (x.astype(np.int64) for x in others)
    g = grams(words, at, counts, deal)
    p1 = (of_words + 0.5) / (total + 0.5 * (distinct + 1))
    before = np.append(of_words, of_entries[g.start])[g.last]
    p2 = (of_entries[g.bigram] + s.mu2 * p1[at]) / (before + s.mu2)
    code = codes[g.trigram]
    seen = np.where(code > 0, 10 ** (s.lowest - s.lowest / 65534 * (code - 1)), 0.0) * (of_entries[g.holder] + s.mu3)
    p3 = (seen + s.mu3 * p2) / (of_entries[g.context] + s.mu3)
    text = np.repeat(np.arange(counts.size), counts)
    per_text = lambda x: np.bincount(text, weights=x, minlength=counts.size)
    return pa.table(
        {
            "doc_id": pa.array(ids.view(np.int64), mask=(flags & np.uint64(1)) > 0),
            "held_out": pa.array(flags < 2),
            "n_tokens": pa.array(counts),
            "n_known": pa.array(per_text(of_words[at] > 0).astype(np.int64)),
            "train_tokens": pa.array(np.full(counts.size, total)),
            "base_score": pa.array(per_text(np.log10(p1)[at])),
            "score": pa.array(per_text(np.log10(p3))),
        }
    )


def _light(docs: DataFrame, is_training: Column) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(is_training, F.lit(False)).alias("training"), "text")


def _by_batch(answers: DataFrame, shared, s: Settings) -> DataFrame:
    return answers.repartition(shared.value.shards, "batch").groupBy("batch").applyInArrow(lambda table: _scores(table, shared.value, s), SCORES)


def scored(docs: DataFrame, is_training: Column, s: Settings = Settings()) -> DataFrame:
    """docs (doc_id, text), learning from the rows that fulfil is_training -> one row of SCORES per row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(dealt(docs, s))
    # a batch's own row goes to a group of its own, on its way to the others of the batch
    group = F.when(F.col("shard") == _LOCAL, -1 - F.col("batch")).otherwise(F.col("shard").cast("long"))
    asked = _asked(_light(docs, is_training), shared, s).withColumn("to", group)
    # as many partitions as shards, so that a task's share doesn't grow with the input
    asked = asked.repartition(shared.value.shards, "to").groupBy("to")
    return _by_batch(asked.applyInArrow(lambda key, table: _answers(table, s), ANSWER), shared, s)


def fit(docs: DataFrame, path: str, s: Settings = Settings()) -> None:
    """Learn from docs (text) and store the model at path: how n-grams are dealt, and a trie per shard."""
    deal = dealt(docs, s)
    shared = docs.sparkSession.sparkContext.broadcast(deal)
    rows = docs.select(F.lit(None).cast("long").alias("doc_id"), F.lit(True).alias("training"), "text")
    asked = _asked(rows, shared, s).where(F.col("shard") != _LOCAL)

    def stored(table: pa.Table) -> pa.Table:
        body = _trie(_questions(table)[1], s).saved()
        return pa.table({"shard": table.column("shard")[:1].combine_chunks(), "body": pa.array([body], pa.binary())})

    asked.repartition(deal.shards, "shard").groupBy("shard").applyInArrow(stored, MODEL).write.parquet(f"{path}/tries")
    head = {"shards": [deal.shards], "width": [deal.width], "hot": [deal.hot.view(np.int64).tolist()], "share": [deal.share.tolist()], **{k: [v] for k, v in asdict(s).items()}}
    kinds = ", ".join(f"{k} {'double' if isinstance(v, float) else 'long'}" for k, v in asdict(s).items())
    docs.sparkSession.createDataFrame(list(zip(*head.values())), f"shards long, width long, hot array<long>, share array<double>, {kinds}").write.parquet(f"{path}/head")


def score(docs: DataFrame, path: str) -> DataFrame:
    """docs (doc_id, text) by the model that fit() stored at path -> rows of SCORES, all held out."""
    spark: SparkSession = docs.sparkSession
    head = spark.read.parquet(f"{path}/head").first().asDict()
    deal = Deal(head.pop("shards"), head.pop("width"), np.array(head.pop("hot"), np.int64).view(np.uint64), np.array(head.pop("share"), float))
    s = Settings(**head)
    shared = spark.sparkContext.broadcast(deal)
    asked = _asked(_light(docs, F.lit(False)), shared, s)
    own = asked.where(F.col("shard") == _LOCAL).selectExpr("batch", "shard", "0L as total", "0L as distinct", "texts", "words", "tokens", "entries", "successors", "body")
    tries = spark.read.parquet(f"{path}/tries").groupBy("shard")

    def answered(questions: pa.Table, tries: pa.Table) -> pa.Table:
        if not questions.num_rows:
            return pa.Table.from_batches([_rows([], ANSWER)])
        body = tries.column("body")[0].as_py() if tries.num_rows else None  # no shard is missing unless nothing was learned
        return _answers(questions, s, Trie.loaded(body, s) if body else None)

    answers = asked.where(F.col("shard") != _LOCAL).groupBy("shard").cogroup(tries).applyInArrow(answered, ANSWER)
    return _by_batch(own.unionByName(answers), shared, s)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scored(docs, remainder("doc_id", 5) != 1)
