"""Operator 13: document fingerprints from invertible Bloom lookup sketches of paragraphs.

A text is cut after every line, and within a line where its own words say so (about every
fourth word), so that an edit changes only the pieces around it. A piece's digest, with the
number of its occurrence, is put into one cell of each third of a sketch: a cell counts its
digests and holds the exclusive-or of them and of their checks. A sketch's size doesn't
depend on its text.

Two versions are compared by subtracting cells: what both have cancels out, and peeling
cells that hold one digest recovers the digests that only one version has. Where a sketch
is too small for the difference, it is made again four times as large, with other places.
Likeness is the share of both versions' pieces that they have in common, 1 for two empty
texts.

Texts and their edited texts (the last quarter replaced by the beginning of the document
with the next id) are compared in one pass over ranges of ids: a range's last text meets
the first one of the next range in a small second step. All documents of a batch are
peeled together, so work is in array operations.

Nulls and edges: a null text counts as empty, which has no pieces; null ids come last;
rows that share an id follow each other by their text's hash; repeated rows are each
other's next; one row alone is its own next. A long text is a batch of its own. Extra
columns take no part, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidalframe.llm.common import lean, mixed, slices, written

CELLS = 12
_SPACES = np.isin(np.arange(256), np.frombuffer(b" \t\n\v\f\r", np.uint8))


def cuts(raw: np.ndarray) -> np.ndarray:
    """Ends of the pieces of UTF-8 bytes: after each newline, and after the white space that follows a
    word whose last three bytes hash to a quarter of all values."""
    if not raw.size:
        return np.zeros(0, np.int64)
    space = _SPACES[raw]
    at = np.flatnonzero(space[:-1] & ~space[1:]) + 1  # where a word begins after white space
    word = np.flatnonzero(~space[:-1] & space[1:])  # its predecessor's last byte, if there is one
    if not word.size:
        marks = np.zeros(0, np.int64)
    else:
        before = np.searchsorted(word, at) - 1
        last = word[np.maximum(before, 0)]
        tail = sum(raw[np.maximum(last - i, 0)].astype(np.int64) << (8 * i) for i in range(3))
        marks = at[(before >= 0) & ((tail * 0x9E3779B1 >> 13) % 4 == 0)]
    return np.union1d(marks, np.append(np.flatnonzero(raw == 10) + 1, raw.size))


@dataclass
class Keys:
    """Digests of many texts: text[i] is the place of the text that has key[i]; n is the number of texts."""

    text: np.ndarray
    key: np.ndarray
    n: int

    @property
    def counts(self) -> np.ndarray:
        return np.bincount(self.text, minlength=self.n)

    def of(self, texts: np.ndarray) -> Keys:
        """Those of some texts, which are numbered anew."""
        place = np.full(self.n, -1)
        place[texts] = np.arange(texts.size)
        mine = place[self.text] >= 0
        return Keys(place[self.text[mine]], self.key[mine], texts.size)


def keys_of(texts: list[bytes]) -> Keys:
    """A digest for each piece of each text; equal pieces of a text differ by their occurrence."""
    found, sizes = [], []
    for raw in texts:
        ends = cuts(np.frombuffer(raw, np.uint8)).tolist()
        found += [xxhash.xxh64_intdigest(raw[a:b]) for a, b in zip([0, *ends], ends)]
        sizes.append(len(ends))
    text, key = np.repeat(np.arange(len(texts)), sizes), np.array(found, np.uint64)
    order = np.lexsort((key, text))
    text, key = text[order], key[order]
    first = np.ones(key.size, bool)
    first[1:] = (text[1:] != text[:-1]) | (key[1:] != key[:-1])
    spot = np.arange(key.size)
    nth = spot - np.maximum.accumulate(np.where(first, spot, 0))
    return Keys(text, np.where(nth > 0, mixed(key, nth.astype(np.uint64)), key), len(texts))


@dataclass
class Sketches:
    """One sketch of `cells` cells for each text: counts, exclusive-ors of digests and of their checks."""

    cells: int
    count: np.ndarray
    key: np.ndarray
    check: np.ndarray

    def minus(self, other: Sketches) -> Sketches:
        return Sketches(self.cells, self.count - other.count, self.key ^ other.key, self.check ^ other.check)

    def to_bytes(self) -> list[bytes]:
        """Per text: each cell's exclusive-ors and count, little-endian."""
        rows = np.empty((self.count.size // self.cells, self.cells), [("key", "<u8"), ("check", "<u8"), ("count", "<i4")])
        for c in ("key", "check", "count"):
            rows[c] = getattr(self, c).reshape(rows.shape)
        return [r.tobytes() for r in rows]


def _check(key: np.ndarray) -> np.ndarray:
    return mixed(key, np.full(key.size, 0xC4CEB9FE1A85EC53, np.uint64))


def _places(text: np.ndarray, key: np.ndarray, cells: int) -> np.ndarray:
    """The cells of each digest, one in each third: 3 rows."""
    third = cells // 3
    spots = [mixed(key, np.full(key.size, cells * 3 + i, np.uint64)) % np.uint64(third) for i in range(3)]
    return np.stack([text * cells + i * third + s.astype(np.int64) for i, s in enumerate(spots)])


def sketched(keys: Keys, cells: int) -> Sketches:
    out = Sketches(cells, np.zeros(keys.n * cells, np.int64), np.zeros(keys.n * cells, np.uint64), np.zeros(keys.n * cells, np.uint64))
    check = _check(keys.key)
    for at in _places(keys.text, keys.key, cells):
        out.count += np.bincount(at, minlength=out.count.size)
        np.bitwise_xor.at(out.key, at, keys.key)
        np.bitwise_xor.at(out.check, at, check)
    return out


def peeled(gap: Sketches) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """text, digest and side (1: only the left version has it, -1: only the right one) of what could be
    recovered, and whether that is all, for each text."""
    texts, keys, sides = [], [], []
    near = np.flatnonzero(np.abs(gap.count) == 1)
    while near.size:
        near = near[(np.abs(gap.count[near]) == 1) & (_check(gap.key[near]) == gap.check[near])]
        text, key, side = near // gap.cells, gap.key[near], gap.count[near]
        order = np.lexsort((key, text))
        text, key, side = text[order], key[order], side[order]
        new = np.ones(key.size, bool)
        new[1:] = (text[1:] != text[:-1]) | (key[1:] != key[:-1])
        text, key, side = text[new], key[new], side[new]
        touched = _places(text, key, gap.cells)
        for at in touched:
            np.subtract.at(gap.count, at, side)
            np.bitwise_xor.at(gap.key, at, key)
            np.bitwise_xor.at(gap.check, at, _check(key))
        texts.append(text), keys.append(key), sides.append(side)
        near = np.unique(touched)
        near = near[np.abs(gap.count[near]) == 1]
    whole = ~((gap.count != 0) | (gap.key != 0) | (gap.check != 0)).reshape(-1, gap.cells).any(axis=1)
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    return join(texts, np.int64), join(keys, np.uint64), join(sides, np.int64), whole


def differences(left: Keys, right: Keys, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """text, digest, side of everything that only one of two versions has, for each text."""
    out: list[tuple] = []
    todo = np.arange(left.n)
    while todo.size:
        text, key, side, whole = peeled(sketched(left.of(todo), cells).minus(sketched(right.of(todo), cells)))
        good = whole[text]
        out.append((todo[text[good]], key[good], side[good]))
        todo, cells = todo[~whole], cells * 4
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))


def likeness(left: Keys, right: Keys) -> np.ndarray:
    """The share of both versions' digests that both have, for each text; 1 if neither has any."""
    both, apart = left.counts + right.counts, np.bincount(differences(left, right)[0], minlength=left.n)
    return np.where(both > 0, (both - apart) / np.maximum(both, 1), 1.0)


def edited(text: str, following: str) -> str:
    """The text with its last quarter of code points replaced by the first as many of the following text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


COLUMNS = "doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def compared(ids: list[int | None], texts: list[str], following: list[str] | None = None) -> dict[str, pa.Array]:
    """The result's columns of texts; the text after the last is the last of `texts` if following is
    None (then it has no row), else each has its own following text."""
    n = len(ids)
    after = texts[1:] if following is None else following
    new = [edited(a, b) for a, b in zip(texts[:n], after)]
    raw = [t.encode() for t in texts]
    changed = [t.encode() for t in new]
    own, other = keys_of(raw), keys_of(changed)
    if following is None:
        before, nexts = own.of(np.arange(n)), own.of(np.arange(1, n + 1))
    else:
        before, nexts = own, keys_of([t.encode() for t in following])
    prints = lambda keys: pa.array(sketched(keys, CELLS).to_bytes(), pa.binary())
    return {
        "doc_id": pa.array(ids, pa.int64()),
        "n_chars": pa.array([len(t) for t in texts[:n]], pa.int64()),
        "edited_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in changed], pa.string()),
        "fingerprint": prints(before),
        "edited_fingerprint": prints(other),
        "near_edited": pa.array(likeness(before, other)),
        "near_next": pa.array(likeness(before, nexts)),
    }


def fingerprinted(docs: DataFrame, slice_bytes: int = 1 << 20) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""

    @lean
    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each text but the range's last; its first and last text as they are."""
        part, held = TaskContext.get().partitionId(), None

        def ends(kind: str, doc_id: int | None, text: str) -> pa.RecordBatch:
            columns = {"doc_id": [doc_id], "part": [part], "kind": [kind], "text": [text]}
            return pa.RecordBatch.from_arrays([pa.array(columns.get(c, [None]), k) for c, k in kinds.items()], list(kinds))

        for batch in slices(batches, "text", slice_bytes):
            ids, texts = batch.column("doc_id").to_pylist(), [t or "" for t in batch.column("text").to_pylist()]
            if held is None:
                yield ends("first", ids[0], texts[0])
            else:
                ids, texts = [held[0], *ids], [held[1], *texts]
            held = ids[-1], texts[-1]
            if len(ids) > 1:
                rows = compared(ids[:-1], texts)
                rows |= {"part": pa.array([part] * (len(ids) - 1), pa.int32()), "kind": pa.array(["row"] * (len(ids) - 1)), "text": pa.nulls(len(ids) - 1, pa.string())}
                yield pa.RecordBatch.from_arrays([rows[c] for c in kinds], list(kinds))
        if held is not None:
            yield ends("last", *held)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", slice_bytes):
            rows = compared(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("following").to_pylist())
            yield pa.RecordBatch.from_pydict(rows)

    kinds = {"doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.binary(), "edited_fingerprint": pa.binary(), "near_edited": pa.float64(), "near_next": pa.float64()}
    kinds |= {"part": pa.int32(), "kind": pa.string(), "text": pa.string()}
    # the last key parts rows that share id and text, so that no range has to hold them all
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"), F.rand(7).alias("r"))
    order = [F.col("doc_id").asc_nulls_last(), "h", "r"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    done = written(dealt.mapInArrow(ranges, f"{COLUMNS}, part int, kind string, text string"), "fingerprints")
    # a row per range from here on; written, so that their size is known
    heads = done.where("kind = 'first'").select("part", F.col("text").alias("following"))
    parts = Window.orderBy("part")
    turn = heads.select("part", F.coalesce(F.lead("part").over(parts), F.first("part").over(parts)).alias("after"))
    last = done.where("kind = 'last'").select("part", "doc_id", "text").join(turn, "part")
    paired = last.join(heads.withColumnRenamed("part", "after"), "after").select("doc_id", "text", "following")
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    return done.where("kind = 'row'").select(*names).unionByName(paired.mapInArrow(pairs, COLUMNS))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fingerprinted(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})
