"""Operator 2: token ids of documents in ORC files.

Layout: documents ascend by id over the files and within each. A row is (doc_id, part,
local_start, n_tokens, ids): ids is a list of integers, which ORC stores run-length
encoded; part numbers the range of ids that a task wrote and local_start counts the ids
before the row in its part. Each file has stripes of bounded size, so Spark reads
stripes in parallel, row indexes every `index_stride` rows, and Bloom filters on doc_id:
`lookup` reads only stripes and row groups that can hold the wanted ids.

The text is dealt by ranges of (id, text hash, a seeded number) before it is encoded, so
the ids, which are larger, are never shuffled, and many rows with one id, even with one
text, still spread over tasks.

Nulls and edges: a null text counts as empty and has the end token only; null ids come
first; repeated rows are stored each. Other columns of docs, whatever their names, take
no part; an empty table is stored as one; a long text is a batch and a row of its own.
What spells a special token is ordinary text unless `special_strings` is set.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidalframe.llm.common import lean, slices, work_path, written
from tidalframe.llm.tokens import cached_encoder, with_end


@dataclass(frozen=True)
class Settings:
    tokenizer: str = public_tokenizers.path("word_bpe_49k.json")
    end_id: int = 2
    stripe_bytes: int = 16 << 20
    index_stride: int = 1000
    bloom_fpp: float = 0.01
    slice_bytes: int = 10 << 20
    special_strings: bool = False


STORED = "doc_id long, part int, local_start long, n_tokens long, ids array<int>"


def write(docs: DataFrame, path: str, s: Settings = Settings()) -> None:
    """Encode docs (doc_id, text) and write the ids to path."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seen = cached_encoder(s.tokenizer, True, s.special_strings, 400_000), TaskContext.get().partitionId(), 0
        for batch in slices(batches, "text", s.slice_bytes):
            found, counts = with_end(*encoder.encode(batch.column("text")), s.end_id)
            stops = np.cumsum(counts)
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], stops)).astype(np.int32)), pa.array(found.view(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.full(counts.size, part, np.int32)), pa.array(seen + stops - counts), pa.array(counts), ids],
                ["doc_id", "part", "local_start", "n_tokens", "ids"],
            )
            seen += int(stops[-1])

    # the third key parts rows that share id and text; it decides nothing else, as such rows are alike
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"), F.rand(7).alias("r"))
    rows = keyed.repartitionByRange("doc_id", "h", "r").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text").mapInArrow(lean(encoded), STORED)
    (
        rows.write.option("orc.stripe.size", s.stripe_bytes)
        .option("orc.row.index.stride", s.index_stride)
        .option("orc.create.index", True)
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", s.bloom_fpp)
        .option("compression", "zstd")
        .orc(path)
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """The stored rows with `start`, the ids of all documents before each."""
    rows = spark.read.schema(STORED).orc(path)
    totals = spark.read.schema(STORED).orc(path).groupBy("part").agg(F.sum("n_tokens").alias("n"))  # one row per file
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # written, so its few bytes are known before the join with the ids is planned
    base = written(totals.select("part", F.coalesce(before, F.lit(0)).alias("base")), "parts")
    return rows.join(base, "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def lookup(spark: SparkSession, path: str, wanted: list[int]) -> DataFrame:
    """Rows of the wanted ids; the condition is pushed to stripes, row groups and Bloom filters."""
    return spark.read.schema(STORED).orc(path).where(F.col("doc_id").isin(wanted)).select("doc_id", "n_tokens", "ids")


def ids_crc32():
    """An Arrow function: unsigned crc32 of each list of ids as little-endian unsigned 32-bit integers."""

    @F.arrow_udf("long")
    def crc(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for ids in batches:
            raw = ids.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False).view(np.uint8)
            at = (ids.offsets.to_numpy().astype(np.int64) * 4).tolist()
            yield pa.array([zlib.crc32(raw[a:b]) for a, b in zip(at, at[1:])], pa.int64())

    return crc


def query(spark, sf_dir: str) -> DataFrame:
    path = work_path(spark, "tokens")
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read(spark, path).select("doc_id", "start", "n_tokens", ids_crc32()("ids").alias("ids_crc32"))
