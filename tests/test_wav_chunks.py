from __future__ import annotations

import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidalframe.sources import files, wav_chunks
from tidalframe.sources.wav import pcm_bytes


def saved(path, samples, rate=8000, channels=1, width=2):
    with wave.open(str(path), "wb") as w:
        w.setnchannels(channels), w.setsampwidth(width), w.setframerate(rate)
        w.writeframes(samples)


def by_file(rows):
    out = {}
    for r in rows.orderBy("path", "start").collect():
        out.setdefault(r["path"].rsplit("/", 1)[1], []).append(r)
    return out


@pytest.mark.parametrize("piece", [50, 1000, 1 << 20])
def test_ranges_of_a_file_give_every_sample_once(spark, tmp_path, piece):
    x = np.random.default_rng(3).uniform(-1, 1, 1501)
    saved(tmp_path / "long.wav", pcm_bytes(x))
    two = np.stack([x, np.zeros_like(x)], 1)
    saved(tmp_path / "two.wav", pcm_bytes(two.ravel()), channels=2)
    saved(tmp_path / "none.wav", b"")
    (tmp_path / "text.wav").write_bytes(b"no sound" * 100)
    (tmp_path / "_hidden.wav").write_bytes(b"")
    wav_chunks.register(spark)
    read = spark.read.format("wav").option("piece", piece).option("chunk", 64).load(str(tmp_path))
    found = by_file(read)
    want = np.frombuffer(pcm_bytes(x), "<i2") / 32768
    for name in ("long.wav", "two.wav"):
        rows = found[name]
        assert [r["start"] for r in rows] == list(np.cumsum([0, *[len(r["samples"]) for r in rows[:-1]]]))
        assert np.array_equal(np.concatenate([r["samples"] for r in rows]), want) and {r["sample_rate"] for r in rows} == {8000}
    assert [(r["start"], r["samples"]) for r in found["none.wav"]] == [(0, [])]
    assert [r["problem"] for r in found["text.wav"]] == ["not a WAV file"] and set(found) == {"long.wav", "two.wav", "none.wav", "text.wav"}
    if piece == 50:
        assert read.rdd.getNumPartitions() > 50


def test_sample_formats_and_cut_off_files(spark, tmp_path):
    x = np.array([0, 0.5, -0.5, -1])
    saved(tmp_path / "8.wav", (x * 128 + 128).astype(np.uint8).tobytes(), width=1)
    saved(tmp_path / "24.wav", b"".join(struct.pack("<i", int(v * 2**23))[:3] for v in x), width=3)
    saved(tmp_path / "32.wav", (x * 2**31).astype("<i4").tobytes(), width=4)
    fmt = struct.pack("<4sI4s4sIHHIIHH", b"RIFF", 0, b"WAVE", b"fmt ", 16, 3, 1, 8000, 32000, 4, 32)
    extra = struct.pack("<4sI", b"LIST", 3) + b"abc\0"  # chunks of odd length are padded
    (tmp_path / "float.wav").write_bytes(fmt + extra + struct.pack("<4sI", b"data", 0) + x.astype("<f4").tobytes() + b"\0")
    (tmp_path / "law.wav").write_bytes(fmt[:20] + struct.pack("<H", 7) + fmt[22:] + struct.pack("<4sI", b"data", 0))
    (tmp_path / "head.wav").write_bytes(fmt[:14])
    wav_chunks.register(spark)
    found = by_file(spark.read.format("wav").load(str(tmp_path)))
    for name in ("8.wav", "24.wav", "32.wav", "float.wav"):
        assert found[name][0]["samples"] == list(x), name
    assert "format 7" in found["law.wav"][0]["problem"] and found["head.wav"][0]["problem"]


def test_a_long_recording_is_written_in_parts(spark, tmp_path):
    x = np.random.default_rng(4).uniform(-1, 1, 2500)
    rows = [(1, 16000, i, x[i : i + 300].tolist()) for i in range(0, 2500, 300)]
    rows += [(1, 16000, 100, x[100:150].tolist()), (-2, None, 10, [0.5, None]), (-2, None, 20, [float("nan"), 2.0]), (3, 8000, 0, []), (None, 8000, 0, [1.0]), (4, 8000, None, [1.0]), (5, 8000, 0, None)]
    chunks = spark.createDataFrame(rows, "rec_id long, sample_rate int, start long, samples array<double>").repartition(5)
    wav_chunks.write_recordings(chunks, str(tmp_path), part=1000)
    assert [p.rsplit("/", 1)[1] for p, _ in files.listed(str(tmp_path))] == ["-2-0.wav", "1-0.wav", "1-1000.wav", "1-2000.wav"]
    with wave.open(str(tmp_path / "1-2000.wav")) as w:
        assert (w.getnframes(), w.getframerate(), w.getsampwidth()) == (500, 16000, 2)
    got = wav_chunks.samples(wav_chunks.read_recordings(spark, str(tmp_path), chunk=128))
    one = [r["v"] for r in got.where("rec_id = 1").orderBy("idx").collect()]
    assert np.array_equal(one, np.frombuffer(pcm_bytes(x), "<i2") / 32768)
    other = {r["idx"]: r["v"] for r in got.where("rec_id = -2").collect()}
    assert len(other) == 22 and {k: v for k, v in other.items() if v} == {10: 16383 / 32768, 21: 32767 / 32768}
    assert not (tmp_path / "_staging").exists() or not list((tmp_path / "_staging").iterdir())


def test_nothing_is_left_of_a_job_that_fails(spark, tmp_path):
    chunks = spark.createDataFrame([(i, 8000, 0, [0.1] * 10) for i in range(20)], "rec_id long, sample_rate int, start long, samples array<double>")
    wav_chunks.write_recordings(chunks.where("rec_id = 0"), str(tmp_path))
    before = files.listed(str(tmp_path))
    bad = chunks.withColumn("samples", F.expr("if(rec_id = 13, array(raise_error('lost')), samples)"))
    with pytest.raises(Exception, match="lost"):
        wav_chunks.write_recordings(bad, str(tmp_path))
    assert files.listed(str(tmp_path)) == before and not [p for p in tmp_path.rglob("*") if p.is_file() and "_staging" in str(p)]
    wav_chunks.write_recordings(chunks.where("rec_id > 17"), str(tmp_path), mode="overwrite")
    assert [p.rsplit("/", 1)[1] for p, _ in files.listed(str(tmp_path))] == ["18-0.wav", "19-0.wav"]


def test_places_without_a_row_are_silence(spark):
    signal = spark.createDataFrame([(1, 0, 0.25), (1, 5, 0.5), (1, 5, 0.75), (1, 9, None), (2, 12, 1.0), (2, None, 1.0)], "rec_id long, idx long, v double")
    got = {(r["rec_id"], r["start"]): r["samples"] for r in wav_chunks.chunked(signal, 8).collect()}
    assert got == {(1, 0): [0.25, None, None, None, None, 0.5], (1, 8): [None, None], (2, 8): [None] * 4 + [1.0]}
