"""A backup as one JSON document: written in ordered parts, read in byte ranges.

The document is {"meta": {...}, "<section>": [record, ...], ...}. Whether a byte in its
middle lies in a string, and how deep, depends on all bytes before it; but what a range
does to that is a few numbers that add up: its quotes that open or close a string (odd or
even), and its change of depth if it starts outside or inside a string. Sums of these
over the ranges before give each range its start, and ranges then read their records alone.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidalframe.operators.sampling import positions
from tidalframe.sources import files
from tidalframe.sources.work import written

BLOCK = 1 << 20
QUOTE, SLASH = b'"\\'
SIGNS = np.zeros(256, bool)
SIGNS[list(b'"\\[]{}')] = True
RANGE = "range long, odd int, out_delta long, out_low long, in_delta long, in_low long"


class Document:
    """The bytes of files, one after the other, as one text."""

    def __init__(self, path: str, found: list[tuple[str, int]]):
        self.path, self.found = path, [x for x in found if x[1]]
        self.starts = np.cumsum([0, *[size for _, size in self.found]]).tolist()
        self.size = self.starts[-1]

    def read(self, at: int, n: int) -> bytes:
        """n bytes from `at`, fewer at the end."""
        store, out = files.opened(self.path)[0], []
        i = int(np.searchsorted(self.starts, at, "right")) - 1
        while n > 0 and i < len(self.found):
            with store.open_input_file(self.found[i][0]) as file:
                file.seek(at - self.starts[i])
                out.append(file.read(min(n, self.starts[i + 1] - at)))
            at, n, i = at + len(out[-1]), n - len(out[-1]), i + 1
        return b"".join(out)

    def slashes_before(self, at: int) -> int:
        """The length of the run of backslashes that ends before `at`."""
        n = 0
        while at > 0:
            raw = self.read(max(0, at - 4096), min(at, 4096))
            run = len(raw) - len(raw.rstrip(b"\\"))
            n, at = n + run, at - len(raw)
            if run < len(raw):
                break
        return n

    def blocks(self, start: int, end: int) -> Iterator[tuple[int, bytes, np.ndarray, np.ndarray, np.ndarray]]:
        """(first byte, bytes, places of quotes, backslashes and brackets, those signs, true at quotes that no
        backslash escapes) of a range, block by block."""
        run = self.slashes_before(start)
        for at in range(start, end, BLOCK):
            raw = self.read(at, min(BLOCK, end - at))
            every = np.frombuffer(raw, np.uint8)
            places = np.flatnonzero(SIGNS[every])
            signs, nth = every[places], np.arange(len(places))
            slash = signs == SLASH
            follows = np.concatenate(([False], slash[:-1] & (np.diff(places) == 1)))[: len(places)]  # right after a backslash
            first = np.maximum.accumulate(np.where(follows & slash, 0, nth))  # where the run of backslashes began
            runs = nth - first + 1 + np.where(places[first] == 0, run, 0)
            before = np.where(follows, np.concatenate(([0], runs[:-1]))[: len(places)], np.where(places == 0, run, 0))
            yield at, raw, places, signs, (signs == QUOTE) & (before % 2 == 0)
            ends = len(places) and slash[-1] and places[-1] == len(raw) - 1
            run = int(runs[-1]) if ends else 0


def _steps(signs: np.ndarray) -> np.ndarray:
    """1 where a bracket opens, -1 where one closes."""
    return ((signs == ord("{")) | (signs == ord("["))).astype(np.int64) - ((signs == ord("}")) | (signs == ord("]")))


def _scanned(doc: Document, start: int, end: int) -> tuple[int, ...]:
    """What a range changes: quotes modulo two; change and lowest point of the depth if it starts outside of strings, and inside."""
    odd, deltas, lows = 0, [0, 0], [0, 0]
    for _, _, places, signs, quotes in doc.blocks(start, end):
        if not len(places):
            continue
        inside, steps = (np.cumsum(quotes) + odd) % 2, _steps(signs)
        for state in (0, 1):
            depth = np.cumsum(np.where(inside == state, steps, 0))
            lows[state] = min(lows[state], deltas[state] + int(depth.min()))
            deltas[state] += int(depth[-1])
        odd = int(inside[-1])
    return odd, deltas[0], lows[0], deltas[1], lows[1]


def _is_key(doc: Document, at: int) -> str | None:
    """The string that opens at `at`, if a colon follows."""
    n = 256
    while True:
        text = doc.read(at, n)
        try:
            name, end = json.JSONDecoder().raw_decode(text.decode("utf-8", "ignore"))
            rest = text.decode("utf-8", "ignore")[end:].lstrip()
        except ValueError:
            rest = ""
        if rest or len(text) < n:
            return name if rest[:1] == ":" else None
        n *= 4


def _events(doc: Document, start: int, end: int, inside: int, depth: int) -> Iterator[tuple[int, bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks with the places where strings open at depth 1, records open (depth 3) and records close."""
    for at, raw, places, signs, quotes in doc.blocks(start, end):
        within = (np.cumsum(quotes) + inside) % 2
        steps = np.where(within == 0, _steps(signs), 0)
        deep = depth + np.cumsum(steps)
        yield at, raw, places[quotes & (within == 1) & (deep == 1)], places[(steps == 1) & (deep == 3)], places[(steps == -1) & (deep == 2)]
        if len(places):
            inside, depth = int(within[-1]), int(deep[-1])


def _last_key(doc: Document, start: int, end: int, inside: int, depth: int) -> str | None:
    key = None
    for at, _, strings, _, _ in _events(doc, start, end, inside, depth):
        for place in strings:
            key = _is_key(doc, at + int(place)) or key
    return key


def _records(doc: Document, start: int, end: int, inside: int, depth: int, key: str | None) -> Iterator[tuple[str | None, int, bytes]]:
    """(section, first byte, record) of the records that open in a range; the last one may end beyond it."""
    held, opened = None, 0
    for at, raw, strings, opens, closes in _events(doc, start, doc.size, inside, depth):
        if at >= end and held is None:
            return
        done = 0
        for place, kind in sorted([*((int(p), "key") for p in strings), *((int(p), "open") for p in opens), *((int(p), "close") for p in closes)]):
            if kind == "close" and held is not None:
                yield key, opened, b"".join([*held, raw[done : place + 1]])
                held = None
            elif at + place >= end:
                if held is None:
                    return
            elif kind == "key":
                key = _is_key(doc, at + place) or key
            elif kind == "open":
                held, opened, done = [], at + place, place
        if held is not None:
            held.append(raw[done:])


def _mapped(rows: DataFrame, schema: str, size: int, doc: Document, run) -> DataFrame:
    """run(doc, start, end, ...) for each row (range, ...) -> rows of schema, a few megabytes a batch."""
    names = [x.split()[0] for x in schema.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, weight = [], 0
        types = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
        kinds = [types[x.split()[1]] for x in schema.split(", ")]
        ready = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)
        for batch in batches:
            for r, *state in zip(*[c.to_pylist() for c in batch.columns]):
                for row in run(doc, r, r * size, min(doc.size, (r + 1) * size), *state):
                    held.append(row)
                    weight += len(row[-1] or "") if isinstance(row[-1], str) else 64
                    if weight > 4 * BLOCK:
                        yield ready()
                        held, weight = [], 0
        if held:
            yield ready()

    return rows.mapInArrow(work, schema)


TASKS = 10_000


def _starts(spark: SparkSession, doc: Document, size: int) -> DataFrame:
    """range, inside, depth, key: the state in which each range of the document starts."""
    n = -(-doc.size // size)
    scan = lambda doc, r, start, end: [(r, *_scanned(doc, start, end))]
    found = written(_mapped(spark.range(0, n, 1, max(1, min(n, TASKS))), RANGE, size, doc, scan), "backup")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row of numbers a range
    total = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    rows = found.withColumn("inside", (total("odd") % 2).cast("int"))
    pick = lambda what: F.when(F.col("inside") == 1, F.col(f"in_{what}")).otherwise(F.col(f"out_{what}"))
    rows = rows.select("range", "odd", "inside", pick("delta").alias("delta"), pick("low").alias("low")).withColumn("depth", total("delta"))
    rows = written(rows, "backup")
    odd, depth = rows.agg(F.coalesce(F.sum("odd"), F.lit(0)) % 2, F.coalesce(F.sum("delta"), F.lit(0))).first()
    if odd or depth:
        raise ValueError(f"not a whole JSON document: it ends {'in a string' if odd else f'at depth {depth}'}")
    # only ranges that come up to the sections' level have names of sections
    last = lambda doc, r, start, end, inside, depth: [(r, _last_key(doc, start, end, inside, depth))]
    high = rows.where(F.col("depth") + F.col("low") <= 1).select("range", "inside", "depth")
    keys = _mapped(high, "range long, last string", size, doc, last)
    return rows.join(keys, "range", "left").select("range", "inside", "depth", F.last("last", ignorenulls=True).over(before).alias("key"))


def read_backup(spark: SparkSession, path: str, sections: list[str] | None = None, size: int = 16 * BLOCK) -> DataFrame:
    """section, at, json: the objects and arrays that are elements of a document's sections, each by itself.

    path: a file, or a folder of files that are one document in the order of their paths.
    The document may be laid out in any way, all in one line, too. at: the record's first
    byte, which gives the order. A task takes `size` bytes and what its last record has
    beyond them. Other elements (numbers, texts, nulls) are passed over; a section that
    stands twice is read twice; no bytes: no rows. A document that ends early raises an
    error, and so does one without JSON's quotes and brackets in balance.
    """
    doc = Document(path, files.listed(path))

    def read(doc: Document, r: int, start: int, end: int, inside: int, depth: int, key: str | None):
        for section, at, raw in _records(doc, start, end, inside, depth, key):
            if sections is None or section in sections:
                yield section, at, raw.decode("utf-8")

    starts = _starts(spark, doc, size)
    n = max(1, min(-(-doc.size // size), TASKS))
    return _mapped(starts.repartition(n), "section string, at long, json string", size, doc, read)


def write_backup(path: str, sections: dict[str, tuple[DataFrame, list[str]]], meta: dict[str, Any] | None = None) -> None:
    """sections: name -> (rows with a column json, the columns that order them, nulls first).

    The files' contents, one after the other in the order of their paths, are one document;
    each record is a line. Rows without json are written as null, of equal rows each is
    written. A section without rows is an empty list.
    """
    spark, nth = next(iter(sections.values()))[0].sparkSession, iter(range(2 * len(sections) + 1))

    def put(lines: DataFrame) -> None:
        lines.write.text(f"{path}/{next(nth):03}")

    head = lambda text: put(spark.createDataFrame([(text,)], "line string").coalesce(1))
    for s, (name, (df, order)) in enumerate(sections.items()):
        head(("{" + f'"meta":{json.dumps(meta or {})},' if s == 0 else "],") + f"{json.dumps(name)}:[")
        # the first record has no comma before it: rows that share its place, mostly one, are numbered
        first = df.agg(F.min(F.struct(*order))).first()[0]
        leads = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.lit(None if first is None else first[c])) for c in order])
        lead = positions(df.where(leads), order, "_pos")
        rows = df.where(~leads).withColumn("_pos", F.lit(None).cast("long")).unionByName(lead.select(*df.columns, "_pos"))
        comma = F.when(F.col("_pos") == 0, "").otherwise(",")
        put(rows.orderBy(*order, "_pos").select(F.concat(comma, F.coalesce("json", F.lit("null"))).alias("line")))
    head("]}")
