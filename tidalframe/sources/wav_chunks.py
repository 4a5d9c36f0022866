"""WAV files as a data source: long files are read in byte ranges, written files appear when the job commits.

    register(spark)
    spark.read.format("wav").load(folder)        # path, sample_rate, start, samples, problem
    write_recordings(chunks, folder)             # (rec_id, sample_rate, start, samples)
    read_recordings(spark, folder)
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from tidalframe.sources import files
from tidalframe.sources.wav import pcm_bytes

CHUNKS = "path string, sample_rate int, start long, samples array<float>, problem string"
ARROW = pa.schema([("path", pa.string()), ("sample_rate", pa.int32()), ("start", pa.int64()), ("samples", pa.list_(pa.float32())), ("problem", pa.string())])
PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE
BATCH = 1 << 20  # samples


@dataclass
class Header:
    rate: int
    kind: int
    width: int  # bytes of a sample of one channel
    align: int  # bytes of the samples of all channels
    data: int  # the first byte of samples
    end: int


def header(file, size: int) -> Header:
    """What the chunks before the samples say; ValueError where these can't be read."""
    if file.read(12)[:4] != b"RIFF":
        raise ValueError("not a WAV file")
    fmt, at = None, 12
    while True:
        file.seek(at)
        head = file.read(8)
        if len(head) < 8:
            raise ValueError("no samples")
        name, length = head[:4], struct.unpack("<I", head[4:])[0]
        if name == b"data":
            break
        if name == b"fmt ":
            fmt = file.read(min(length, 40))
        at += 8 + length + length % 2
    if fmt is None or len(fmt) < 16:
        raise ValueError("no format before the samples")
    kind, channels, rate, _, align, bits = struct.unpack("<HHIIHH", fmt[:16])
    if kind == EXTENSIBLE and len(fmt) >= 26:
        kind = struct.unpack("<H", fmt[24:26])[0]
    if (kind, bits) not in ((PCM, 8), (PCM, 16), (PCM, 24), (PCM, 32), (FLOAT, 32), (FLOAT, 64)) or channels < 1 or align != channels * bits // 8:
        raise ValueError(f"format {kind}, {channels} channels of {bits} bits")
    data = at + 8
    # a recorder that was cut off leaves a length of 0 or more than there is
    whole = size - data if length == 0 or data + length > size else length
    return Header(rate, kind, bits // 8, align, data, data + whole - whole % align)


def first_channel(raw: bytes, h: Header) -> np.ndarray:
    """Samples in [-1, 1) of whole numbers, floating ones as they are."""
    x = np.frombuffer(raw, np.uint8).reshape(-1, h.align)[:, : h.width]
    if h.kind == FLOAT:
        return np.ascontiguousarray(x).view(f"<f{h.width}")[:, 0].astype(np.float32)
    if h.width == 1:
        return ((x[:, 0].astype(np.float32)) - 128) / 128
    wide = np.zeros((len(x), 4), np.uint8)
    wide[:, 4 - h.width :] = x
    return (wide.view("<i4")[:, 0] / 2147483648).astype(np.float32)


@dataclass
class Pieces(InputPartition):
    found: list[tuple[str, int, int]]


class WavReader(DataSourceReader):
    def __init__(self, path: str, piece: int, chunk: int):
        self.path, self.piece, self.chunk = path, piece, chunk
        self.sizes = dict(files.listed(path, ".wav"))

    def partitions(self) -> list[InputPartition]:
        return [Pieces(x) for x in files.pieces(list(self.sizes.items()), self.piece)] or [Pieces([])]

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        held, weight = [], 0
        for row in self._rows(partition):
            held.append(row)
            weight += len(row[3]) if row[3] is not None else 0
            if weight >= BATCH or len(held) >= 4096:
                yield self._batch(held)
                held, weight = [], 0
        if held:
            yield self._batch(held)

    def _rows(self, partition: Pieces) -> Iterator[tuple]:
        store = files.opened(self.path)[0]
        for path, start, end in partition.found:
            with store.open_input_file(path) as file:
                try:
                    h = header(file, self.sizes[path])
                except ValueError as problem:
                    if start == 0:  # said once a file
                        yield path, None, None, None, str(problem)
                    continue
                # the samples whose first byte lies in this range
                low, high = (-(-(min(max(x, h.data), h.end) - h.data) // h.align) for x in (start, end))
                if start == 0 and h.data == h.end:
                    yield path, h.rate, 0, np.zeros(0, np.float32), None
                for at in range(low, high, self.chunk):
                    file.seek(h.data + at * h.align)
                    yield path, h.rate, at, first_channel(file.read(min(self.chunk, high - at) * h.align), h), None

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), ARROW)], schema=ARROW)


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class WavWriter(DataSourceArrowWriter):
    """Tasks write below _staging; commit() moves whole files to their place, abort() removes what there is."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def _staging(self, root: str) -> str:
        return f"{root.rstrip('/')}/_staging/{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = files.opened(self.path)
        folder = f"{self._staging(root)}/{uuid.uuid4().hex}"  # a repeated task has a folder of its own
        store.create_dir(folder)
        names, out, key, at = [], None, None, 0
        for batch in iterator:
            samples = batch.column("samples")
            for i, (rec, first, rate, start, n) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("rec_id", "first", "sample_rate", "start", "n")])):
                if (rec, first) != key:
                    if out is not None:
                        out.close()
                    key, at = (rec, first), first
                    names.append(f"{folder}/{rec}-{first}.wav")
                    out = store.open_output_stream(names[-1])
                    out.write(struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + 2 * n, b"WAVE", b"fmt ", 16, PCM, 1, rate, 2 * rate, 2, 16, b"data", 2 * n))
                x = samples[i].values.to_numpy(zero_copy_only=False)
                if start > at:
                    out.write(bytes(2 * (start - at)))
                    at = start
                rest = x[at - start :]  # what other chunks haven't said
                out.write(pcm_bytes(rest))
                at += len(rest)
        if out is not None:
            out.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = files.opened(self.path)
        if self.overwrite:
            for old, _ in files.listed(self.path, ".wav"):
                store.delete_file(old)
        for message in messages:
            for name in message.names if message else []:
                store.move(name, f"{root.rstrip('/')}/{name.rsplit('/', 1)[1]}")
        store.delete_dir(self._staging(root))

    def abort(self, messages: list[Written | None]) -> None:
        store, root = files.opened(self.path)
        if store.get_file_info(self._staging(root)).type != files.fs.FileType.NotFound:
            store.delete_dir(self._staging(root))


class WavSource(DataSource):
    """Options: piece (bytes a reading task takes, 64 MB), chunk (samples a row has at most, 65,536)."""

    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return CHUNKS

    def reader(self, schema) -> WavReader:
        return WavReader(self.options["path"], int(self.options.get("piece", 64 << 20)), int(self.options.get("chunk", 1 << 16)))

    def writer(self, schema, overwrite: bool) -> WavWriter:
        return WavWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WavSource)


def write_recordings(chunks: DataFrame, path: str, part: int = 1 << 22, default_rate: int = 48_000, mode: str = "append") -> None:
    """(rec_id long, sample_rate int, start long, samples array<double>) -> mono files of 16 bits, `<rec_id>-<first sample>.wav`.

    A file has at most `part` samples, so a long recording is the work of many tasks. Of
    chunks that overlap the one that starts first counts (of equal starts the longest);
    samples that no chunk has are silence, as are null and NaN. Chunks without recording,
    start or samples are left out. A file that is there already is replaced by one of its
    name; mode "overwrite" removes all others. Nothing appears of a job that fails.
    """
    register(chunks.sparkSession)
    end = F.col("start") + F.size("samples")
    rows = chunks.select(F.col("rec_id").cast("long"), F.col("sample_rate").cast("int"), F.col("start").cast("long"), F.expr("transform(samples, x -> cast(x as double))").alias("samples"))
    rows = rows.where("rec_id is not null and start >= 0 and size(samples) > 0")
    touched = F.sequence(F.floor(F.col("start") / part), F.floor((end - 1) / part))
    rows = rows.withColumn("first", F.explode(touched)).withColumn("first", F.col("first") * part)
    low, high = F.greatest("start", "first"), F.least(end, F.col("first") + part)
    rows = rows.select("rec_id", "first", "sample_rate", low.alias("start"), F.slice("samples", (low - F.col("start") + 1).cast("int"), (high - low).cast("int")).alias("samples"))
    file = Window.partitionBy("rec_id", "first")
    rows = rows.select("rec_id", "first", F.coalesce(F.max("sample_rate").over(file), F.lit(default_rate)).alias("sample_rate"), "start", (F.max(end).over(file) - F.col("first")).alias("n"), "samples")
    ordered = rows.sortWithinPartitions("rec_id", "first", "start", F.size("samples").desc())
    ordered.write.format("wav").option("path", path).mode(mode).save()


def read_recordings(spark: SparkSession, path: str, **options: int) -> DataFrame:
    """Files that write_recordings() named -> rec_id, sample_rate, start (in the recording), samples. Other files are passed over."""
    register(spark)
    rows = spark.read.format("wav").options(**options).load(path)
    place = lambda n: F.regexp_extract("path", "(-?\\d+)-(\\d+)\\.wav$", n)
    named = rows.where("problem is null").where(place(1) != "")
    return named.select(place(1).cast("long").alias("rec_id"), "sample_rate", (F.col("start") + place(2).cast("long")).alias("start"), "samples")


def chunked(signal: DataFrame, size: int = 4096) -> DataFrame:
    """(rec_id, idx, v) -> rec_id, start, samples of `size` places at most; a place without a row is silence, of repeated places the smallest value counts."""
    start = F.floor(F.col("idx") / size) * size
    held = signal.where("idx is not null").groupBy("rec_id", "idx").agg(F.min("v").cast("double").alias("v"))
    rows = held.groupBy("rec_id", start.alias("start")).agg(F.array_sort(F.collect_list(F.struct((F.col("idx") - start).alias("k"), "v"))).alias("at"))
    before = lambda i: F.when(i > 0, F.col("at")[i - 1]["k"]).otherwise(-1)
    filled = F.flatten(F.transform("at", lambda x, i: F.concat(F.array_repeat(F.lit(None).cast("double"), (x["k"] - before(i) - 1).cast("int")), F.array(x["v"]))))
    return rows.select("rec_id", "start", filled.alias("samples"))


def samples(chunks: DataFrame) -> DataFrame:
    """(rec_id, start, samples) -> rec_id, idx, v."""
    return chunks.select("rec_id", "start", F.posexplode("samples").alias("_k", "v")).select("rec_id", (F.col("start") + F.col("_k")).alias("idx"), F.col("v").cast("double").alias("v"))
