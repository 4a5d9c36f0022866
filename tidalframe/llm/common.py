"""Helpers that several operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidalframe.sources.work import work_path, written

__all__ = ["END", "as_bytes", "fresh", "give_back", "lean", "mixed", "picked", "remainder", "sampled", "slices", "token_codes", "work_path", "written"]

END = b"\n"  # no word has a newline


def fresh(df: DataFrame, name: str) -> str:
    """name, with underscores in front until df has no such column."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def remainder(id_column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def sampled(id_column: str, bound: int, n_rows: int) -> Column:
    """A deterministic predicate that about `bound` of n_rows ids fulfil; all if there are fewer."""
    share = 1.0 if n_rows <= bound else bound / n_rows
    return F.pmod(F.xxhash64(F.lit("sample"), F.col(id_column)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))


#: Words of row numbers that travel to all tasks: 64 MB, of some 128 million rows.
_WORDS = 1 << 21


def picked(docs: DataFrame, row: str, chosen: DataFrame, inside: bool = True) -> DataFrame:
    """The rows of docs whose number `row` is among those of chosen (its only column), or isn't; docs isn't shuffled.

    64 numbers in a row are one word of bits, so it takes half a byte a row of docs to tell all
    tasks who is chosen, at most. Where there are over _WORDS words the planner decides, and
    docs is shuffled once. Repeated numbers count once; null ones are never chosen.
    """
    n = F.col(chosen.columns[0])
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(n, F.lit(64)).cast("int"))
    words = written(chosen.where(n.isNotNull()).groupBy(F.shiftright(n, 6).alias("word")).agg(F.bit_or(bit).alias("bits")), "picked")
    if words.count() <= _WORDS:
        words = F.broadcast(words)
    marked = docs.join(words, F.shiftright(docs[row], 6) == words["word"], "left")
    found = F.coalesce(F.getbit(words["bits"], F.pmod(docs[row], F.lit(64)).cast("int")) == 1, F.lit(False))
    return marked.where(found if inside else ~found).select(docs["*"])


def give_back() -> None:
    """Hand the memory that Arrow and numpy have freed back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, giving its memory back at the end: Spark keeps Python workers for the tasks that follow."""

    @wraps(run)
    def then_give_back(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return then_give_back


def as_bytes(column: pa.Array, step: int = 256) -> Iterator[bytes]:
    """UTF-8 bytes of each text, of which a few are held at a time; null counts as empty."""
    raw = column.cast(pa.binary())
    for a in range(0, len(raw), step):
        for x in raw.slice(a, step).to_pylist():
            yield b"" if x is None else x


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose text column holds at most about `limit` bytes (one row at least)."""
    for batch in batches:
        sizes = [x or 0 for x in pc.binary_length(batch.column(column)).to_pylist()]
        start = held = 0
        for i, size in enumerate(sizes):
            if held and held + size > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)


def token_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ascending hashes of the distinct tokens of all texts; each token's place among
    them, text after text, the end token last in each; and how many tokens each text has."""
    lowered = pc.ascii_lower(pc.fill_null(texts, ""))
    for other in "\t\n\v\f\r":
        lowered = pc.replace_substring(lowered, other, " ")
    lists = pc.split_pattern(lowered, " ")
    pieces = lists.flatten().dictionary_encode()
    names = pieces.dictionary.cast(pa.binary()).to_pylist()
    hashes = np.array([*map(xxhash.xxh64_intdigest, names), xxhash.xxh64_intdigest(END)], np.uint64)
    sizes = pc.list_value_length(lists).to_numpy()
    text = np.repeat(np.arange(sizes.size), sizes)
    codes, real = pieces.indices.to_numpy(), np.array([*map(len, names)], np.int64) > 0
    if not real.all():  # between two spaces there is no word
        text, codes = text[real[codes]], codes[real[codes]]
    counts = np.bincount(text, minlength=sizes.size) + 1
    order = np.argsort(hashes[np.append(real, True)])
    rank = np.empty(hashes.size, np.int64)
    rank[np.flatnonzero(np.append(real, True))[order]] = np.arange(order.size)
    return hashes[np.append(real, True)][order], np.insert(rank[codes], np.cumsum(counts - 1), rank[-1]), counts


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each pair."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))
