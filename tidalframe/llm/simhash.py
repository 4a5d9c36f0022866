"""Operator 3: SimHash near-duplicate detection by tiled exact comparison.

1. Each text gets a 64-bit fingerprint from its word shingles (Arrow batches).
2. Equal fingerprints collapse, so a group of copies is one row from here on.
3. A fingerprint is dealt to one bucket per 16-bit block (radius + 1 blocks). Two
   fingerprints that differ in at most `radius` bits agree in a whole block, so no
   link is lost. The rows of a bucket over `hot` rows are dealt on in the same way by
   the bits that its block doesn't have: a link differs in at most `radius` of those
   too. Rows thus grow by a factor a level, not with the square of a bucket.
4. A task gathers whole buckets, sorts them by bit count, cuts tiles and compares
   tile pairs by exclusive-or and bit counts; tile pairs whose bit counts lie more
   than the radius apart are skipped. Only a spanning forest of the links leaves it.
5. Components of the forest are the groups.

`near_duplicates` is that for 3-word shingles and 64 bits. `one_of_each` takes near copies
of 0.8 and more on 5-word shingles. At such a distance 64 bits are too few, so it gives
each text 448, compares in tiles those that agree in some block, and then compares the
shingles of what is near: only pairs that share 0.8 of theirs become links. Texts without
a near one are not shuffled.

Nulls and edges: a null text counts as empty; texts without words have fingerprint zero
and link like any other. A null id stays in the result; a group's id is its smallest
non-null id. Repeated rows are rows of their own, of one group; an empty table has none;
a long text is hashed in blocks. Extra columns take no part, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidalframe.llm.common import as_bytes, fresh, give_back, lean, mixed, picked, slices, token_codes, written
from tidalframe.llm.graph import components

BITS = 64
_CHUNK = 100_000


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """Bit b is 1 if it is set in over half the shingles' XXH64 (seed 42)."""
    words = text.lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    widths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(widths + 1) - 1
    k = min(shingle, len(words))
    starts, ends = (ends - widths)[: len(words) - k + 1], ends[k - 1 :]
    ones = np.zeros(BITS, np.int64)
    for at in range(0, starts.size, _CHUNK):
        spans = zip(starts[at : at + _CHUNK].tolist(), ends[at : at + _CHUNK].tolist())
        hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in spans], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > starts.size, bitorder="little").view("<u8")[0])


def fingerprints(shingle: int = 3):
    """An Arrow function: texts -> signed 64-bit fingerprints."""

    @F.arrow_udf("long")
    @lean
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = np.array([fingerprint(t, shingle) for t in as_bytes(texts)], dtype=np.uint64)
            yield pa.array(found.view(np.int64))

    return of


def _roots(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    while True:
        up = parent[x]
        if (up == x).all():
            return x
        parent[x] = parent[up]
        x = up


def _unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    while a.size:
        ra, rb = _roots(parent, a), _roots(parent, b)
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))


def tile_forest(values: np.ndarray, radius: int = 3, tile: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """(member, root): places of every value that some chain of links joins to another one.

    values: 64-bit numbers, or rows of them. Tiles whose bit counts lie more than the radius
    apart are skipped, and so are tiles that are of one group already, so a large group of
    near copies takes about one comparison with its first tile.
    """
    wide = values.reshape(len(values), -1)
    ones = np.bitwise_count(wide).sum(axis=1, dtype=np.int64)
    order = np.argsort(ones, kind="stable")
    wide, ones, n = wide[order], ones[order], len(wide)
    parent = np.arange(n)
    for i in range(0, n, tile):
        left, mine = wide[i : i + tile], np.arange(i, min(i + tile, n))
        highest = ones[mine[-1]]
        for j in range(i, n, tile):
            if ones[j] - highest > radius:
                break
            theirs = np.arange(j, min(j + tile, n))
            groups = _roots(parent, np.concatenate((mine, theirs)))
            if j > i and (groups == groups[0]).all():
                continue
            apart = np.zeros((mine.size, theirs.size), np.uint16)
            for k in range(wide.shape[1]):
                apart += np.bitwise_count(left[:, None, k] ^ wide[None, j : j + tile, k])
            near = apart <= radius
            if i == j:
                near = np.triu(near, 1)
            rows, columns = np.nonzero(near)
            _unite(parent, rows + i, columns + j)
    root = _roots(parent, np.arange(n))
    joined = np.flatnonzero(root != np.arange(n))
    return order[joined], order[root[joined]]


def _forests(radius: int, tile: int, least: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (bucket, node, fp) come sorted by bucket; whole buckets are gathered until there are
        `least` rows. fp is a number or a list of numbers; nodes are its distinct values' names."""

        def linked(keys: np.ndarray, nodes: np.ndarray, values: np.ndarray) -> Iterator[pa.RecordBatch]:
            cuts = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1, append=keys[-1] + 1))
            for a, b in zip(cuts, cuts[1:]) if values.shape[1] > 1 else [(0, keys.size)]:
                if b - a > 1:  # a narrow value's buckets are compared together: they are small and agree in few bits
                    mine, at = np.unique(nodes[a:b], return_index=True)
                    member, root = tile_forest(values[a:b][at], radius, tile)
                    yield pa.RecordBatch.from_arrays([pa.array(mine[member]), pa.array(mine[root])], ["u", "v"])

        keys, nodes, values = np.empty(0, np.int64), np.empty(0, np.int64), None
        for batch in batches:
            fp = batch.column("fp")
            flat = fp.flatten() if pa.types.is_list(fp.type) else fp
            now = flat.to_numpy(zero_copy_only=False).view(np.uint64).reshape(batch.num_rows, -1)
            keys = np.concatenate((keys, batch.column("bucket").to_numpy(zero_copy_only=False)))
            nodes = np.concatenate((nodes, batch.column("node").to_numpy(zero_copy_only=False)))
            values = now if values is None else np.concatenate((values, now))
            if keys.size >= least:
                whole = int(np.searchsorted(keys, keys[-1]))  # where the last, perhaps unfinished, bucket starts
                if whole:
                    yield from linked(keys[:whole], nodes[:whole], values[:whole])
                    keys, nodes, values = keys[whole:], nodes[whole:], values[whole:]
        if keys.size:
            yield from linked(keys, nodes, values)

    return run


def _block_masks(bits: tuple[int, ...], blocks: int) -> list[tuple[int, tuple[int, ...]]]:
    """bits cut into blocks: (mask of the block as a signed 64-bit number, the other bits) of each."""
    cut = [len(bits) * i // blocks for i in range(blocks + 1)]
    parts = [bits[a:b] for a, b in zip(cut, cut[1:])]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [(signed(sum(1 << i for i in part)), tuple(i for i in bits if i not in part)) for part in parts]


def links(distinct: DataFrame, radius: int = 3, tile: int = 512, hot: int = 16_384, levels: int = 4) -> DataFrame:
    """distinct (fp long) -> (u, v) links that join exactly what pairs within the radius join.

    After `levels` blocks a bucket's fingerprints agree in over half their bits; what is
    still together there is compared as it is.
    """
    blocks, paths = radius + 1, [tuple(range(BITS))]
    rows, ready = distinct.select("fp", F.lit(0).cast("long").alias("bucket"), F.lit(0).alias("path")), []
    for level in range(levels):
        masks = [_block_masks(bits, blocks) for bits in paths]
        paths = [rest for cut in masks for _, rest in cut]
        of_path = F.array(*[F.array(*[F.lit(mask) for mask, _ in cut]) for cut in masks])
        dealt = rows.select("fp", "bucket", "path", F.posexplode(F.get(of_path, F.col("path"))).alias("b", "mask"))
        step = F.col("path") * blocks + F.col("b")
        rows = dealt.select("fp", F.xxhash64("bucket", step, F.col("fp").bitwiseAND(F.col("mask"))).alias("bucket"), step.alias("path"))
        over = written(rows.groupBy("bucket").count().where(F.col("count") > hot).select("bucket"), "hot-blocks")
        if level == levels - 1 or over.isEmpty():
            break
        ready.append(rows.join(over, "bucket", "left_anti").select("fp", "bucket"))
        rows = rows.join(over, "bucket", "left_semi")
    sorted_in = reduce(DataFrame.unionByName, ready, rows.select("fp", "bucket")).repartition("bucket").sortWithinPartitions("bucket")
    return sorted_in.select("bucket", F.col("fp").alias("node"), "fp").mapInArrow(_forests(radius, tile, 8 * tile), "u long, v long")


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 3, radius: int = 3
) -> DataFrame:
    """-> (doc_id, fp, component_id), one row per row of docs; see the module's text."""
    marked = written(
        docs.select(F.col(id_column).cast("long").alias("doc_id"), fingerprints(shingle)(F.col(text_column)).alias("fp")), "fingerprints"
    )
    first = written(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    joined = components(links(first.select("fp"), radius)).withColumnRenamed("node", "fp")
    rooted = first.join(joined, "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    labels = rooted.join(smallest, "root").select("fp", "component_id")
    return marked.join(labels, "fp").select("doc_id", "fp", "component_id")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@dataclass(frozen=True)
class Similar:
    """What counts as a near copy: texts whose distinct word shingles are alike by `similarity` (Jaccard).

    With so high a similarity, a bit of a fingerprint differs with the probability that the
    angle between the sets gives; the radius is its mean plus `slack` standard deviations. A
    fingerprint is dealt by 12-bit blocks, five of each 64 bits: two texts at 0.8 share one of
    35 blocks with a probability of 0.995, closer ones more surely.
    """

    shingle: int = 5
    similarity: float = 0.8
    words: int = 7  # 64-bit numbers of a fingerprint
    slack: float = 2.0
    block: int = 12

    @property
    def radius(self) -> int:
        p, n = math.acos(2 * self.similarity / (1 + self.similarity)) / math.pi, BITS * self.words
        return math.floor(n * p + self.slack * math.sqrt(n * p * (1 - p)))


_LANES = np.uint64(0x0101010101010101)


def majority(hashes: np.ndarray) -> np.ndarray:
    """rows of 64-bit numbers -> one row: each bit that is set in over half of them."""
    n, w = hashes.shape
    padded = np.concatenate((hashes, np.zeros((-n % 255, w), np.uint64))).reshape(-1, 255, w)
    ones = np.empty((w, 8, 8), np.int64)
    for bit in range(8):  # eight counters of a byte in each number; 255 rows can't overflow them
        lanes = ((padded >> np.uint64(bit)) & _LANES).sum(axis=1, dtype=np.uint64)
        ones[:, :, bit] = np.ascontiguousarray(lanes).view(np.uint8).reshape(-1, w, 8).sum(axis=0, dtype=np.int64)
    return np.packbits((ones * 2 > n).reshape(w, 64), axis=1, bitorder="little").view("<u8").ravel()


def shingles(texts: pa.Array, s: Similar = Similar()) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingles as ascending 64-bit hashes, one text after the other, and how many it has."""
    words, at, counts = token_codes(texts)  # an end token closes each text
    hashes, sizes = words[at], counts - 1
    size = np.minimum(s.shingle, sizes)
    starts = np.where(sizes > 0, sizes - size + 1, 0)
    owner = np.repeat(np.arange(counts.size), starts)
    start = np.arange(owner.size) + np.repeat(np.cumsum(counts) - counts - (np.cumsum(starts) - starts), starts)
    found = np.zeros(owner.size, np.uint64)
    for k in range(s.shingle):
        inside = np.flatnonzero(size[owner] > k)
        found[inside] = mixed(found[inside], hashes[start[inside] + k])
    order = np.lexsort((found, owner))
    owner, found = owner[order], found[order]
    new = np.ones(found.size, bool)
    new[1:] = (owner[1:] != owner[:-1]) | (found[1:] != found[:-1])
    return found[new], np.bincount(owner[new], minlength=counts.size)


def wide_fingerprints(texts: pa.Array, s: Similar = Similar()) -> np.ndarray:
    """A row of s.words numbers for each text, from its distinct shingles; zeros without words."""
    distinct, sizes = shingles(texts, s)
    ends = np.concatenate(([0], np.cumsum(sizes)))
    out = np.zeros((sizes.size, s.words), np.uint64)
    for t, (a, b) in enumerate(zip(ends.tolist(), ends[1:].tolist())):
        if a < b:
            part = distinct[a:b]
            out[t] = majority(np.stack([mixed(part, np.full(1, k + 1, np.uint64)) for k in range(s.words)], axis=1))
    return out


def block_values(wide: np.ndarray, s: Similar) -> np.ndarray:
    """The value of each block of each fingerprint."""
    return np.concatenate([(wide[:, w : w + 1] >> np.arange(0, BITS - s.block + 1, s.block, dtype=np.uint64)) & np.uint64((1 << s.block) - 1) for w in range(s.words)], axis=1).astype(np.int32)


def _near(left: np.ndarray, right: np.ndarray, radius: int) -> np.ndarray:
    apart = np.zeros((len(left), len(right)), np.uint16)
    for k in range(left.shape[1]):
        apart += np.bitwise_count(left[:, None, k] ^ right[None, :, k])
    return apart <= radius


def with_near_ones(wide: np.ndarray, block: int, s: Similar, tile: int = 256) -> np.ndarray:
    """Which of a bucket's fingerprints have a near one whose first block in common is this bucket's:
    a near pair thus counts in one bucket only. Tiles whose bit counts differ by more than the radius,
    and tiles of fingerprints that are all marked, are skipped."""
    order = np.argsort(np.bitwise_count(wide).sum(axis=1, dtype=np.int64), kind="stable")
    wide = wide[order]
    ones, values = np.bitwise_count(wide).sum(axis=1, dtype=np.int64), block_values(wide, s)
    marked = np.zeros(len(wide), bool)
    for i in range(0, len(wide), tile):
        for j in range(i, len(wide), tile):
            if ones[j] - ones[min(i + tile, len(wide)) - 1] > s.radius:
                break
            if marked[i : i + tile].all() and marked[j : j + tile].all():
                continue
            near = _near(wide[i : i + tile], wide[j : j + tile], s.radius)
            a, z = np.nonzero(np.triu(near, 1) if i == j else near)
            a, z = a + i, z + j
            first = (values[a] == values[z]).argmax(axis=1) == block
            marked[a[first]] = marked[z[first]] = True
    out = np.zeros(len(wide), bool)
    out[order] = marked
    return out


def verified_forest(wide: np.ndarray, sets: np.ndarray, sizes: np.ndarray, s: Similar) -> tuple[np.ndarray, np.ndarray]:
    """(member, root) places of a bucket's texts that chains of pairs join which are near by their
    fingerprints and share `similarity` of their shingles (sets: those of all texts, one after the other).

    A text is compared with all near ones at once that it isn't joined with already, by marking its
    shingles and counting marks; near copies of one text take about one comparison with it.
    """
    n, ends = len(wide), np.concatenate(([0], np.cumsum(sizes)))
    codes = np.unique(sets, return_inverse=True)[1]
    parent, mark = np.arange(n), np.zeros(int(codes.max(initial=0)) + 1, bool)
    for i in range(n - 1):
        rivals = np.flatnonzero(_near(wide[i : i + 1], wide[i + 1 :], s.radius)[0]) + i + 1
        rivals = rivals[_roots(parent, rivals) != _roots(parent, np.array([i]))]
        if not rivals.size:
            continue
        mine = codes[ends[i] : ends[i + 1]]
        mark[mine] = True
        shared = np.array([np.count_nonzero(mark[codes[ends[j] : ends[j + 1]]]) for j in rivals.tolist()])
        mark[mine] = False
        alike = shared >= s.similarity * (sizes[i] + sizes[rivals] - shared) - 1e-9
        _unite(parent, np.full(int(alike.sum()), i), rivals[alike])
    root = _roots(parent, np.arange(n))
    joined = np.flatnonzero(root != np.arange(n))
    return joined, root[joined]


def _buckets(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[pa.Table]:
    """Rows that come sorted by bucket, a whole bucket at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        keys = batch.column("bucket").to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)] if len(keys) else [0]
        for a, b in zip(cuts, cuts[1:]):
            if held and keys[a] != last:
                yield pa.Table.from_batches(held).select(columns)
                held = []
            held.append(batch.slice(a, b - a))
            last = keys[a]
    if held:
        yield pa.Table.from_batches(held).select(columns)


def _wide(column: pa.ChunkedArray, s: Similar) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, s.words)


def similar(docs: DataFrame, s: Similar = Similar()) -> DataFrame:
    """docs (row long, text) -> row, component: the smallest row that chains of near copies reach."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            found = wide_fingerprints(batch.column("text"), s).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * s.words, pa.int32()), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("row"), lists], ["row", "fp"])

    @lean
    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket in _buckets(batches, ["bucket", "node", "fp"]):
            if bucket.num_rows > 1:
                some = bucket.filter(pa.array(with_near_ones(_wide(bucket.column("fp"), s), bucket.column("bucket")[0].as_py() >> s.block, s)))
                if some.num_rows:
                    yield from some.combine_chunks().to_batches()

    def with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 19):
            found, sizes = shingles(batch.column("text"), s)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(found.view(np.int64)))
            yield pa.RecordBatch.from_arrays([*map(batch.column, ("bucket", "node", "fp")), lists], ["bucket", "node", "fp", "shingles"])
            give_back()

    @lean
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket in _buckets(with_sets(batches), ["node", "fp", "shingles"]):
            nodes, lists = bucket.column("node").to_numpy(), bucket.column("shingles").combine_chunks()
            member, root = verified_forest(_wide(bucket.column("fp"), s), lists.flatten().to_numpy(), pa.compute.list_value_length(lists).to_numpy().astype(np.int64), s)
            yield pa.RecordBatch.from_arrays([pa.array(nodes[member]), pa.array(nodes[root])], ["u", "v"])

    marked = written(docs.select("row", "text").mapInArrow(run, "row long, fp array<long>"), "wide-fingerprints")
    # equal fingerprints are one node from here on
    nodes = written(marked.groupBy("fp").agg(F.min("row").alias("node")), "distinct-fingerprints")
    values = [F.shiftrightunsigned(F.col("fp")[w], k * s.block).bitwiseAND(F.lit((1 << s.block) - 1)) for w in range(s.words) for k in range(BITS // s.block)]
    dealt = nodes.select("node", "fp", F.posexplode(F.array(*values)).alias("b", "value"))
    dealt = dealt.select(F.shiftleft(F.col("b").cast("long"), s.block).bitwiseOR(F.col("value")).alias("bucket"), "node", "fp")
    pairs = written(dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(near, "bucket long, node long, fp array<long>"), "near-ones")
    # only texts that have a near one move, as they are: their shingles take more room
    wanted = picked(docs.select("row", "text"), "row", pairs.select("node"))
    compared = pairs.join(wanted, pairs["node"] == wanted["row"]).select("bucket", "node", "fp", "text").repartition("bucket").sortWithinPartitions("bucket")
    found = components(compared.mapInArrow(link, "u long, v long"))
    rooted = nodes.join(found, "node", "left").select("fp", F.coalesce("root", "node").alias("component"))
    return marked.join(rooted, "fp").select("row", "component")


def one_of_each(docs: DataFrame, s: Similar = Similar()) -> DataFrame:
    """docs without near copies: of each group the row with the smallest id stays, whole.

    A row without an id goes if its group has one with an id. Copies that also share
    the id are told apart by their place in the scan. Null and blank texts are copies of
    each other. Extra columns are kept, whatever their names; an empty table gives one.
    """
    row = fresh(docs, "row_number")
    docs = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = similar(docs.select(F.col(row).alias("row"), "text"), s)
    ids = docs.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("id"))
    # groups are named by a row number here; the smallest document id decides who stays
    rows = written(found.join(ids, "row"), "groups")
    first = F.min(F.struct(F.col("id").isNull(), "id", "row"))["row"].alias("stays")
    kept = rows.groupBy("component").agg(first).select(F.col("stays").alias("row"), F.lit(True).alias("kept"))
    gone = rows.join(kept, "row", "left").where("kept is null").select("row")
    return picked(docs, row, gone, inside=False).select(*[c for c in docs.columns if c != row])
