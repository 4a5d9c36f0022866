from __future__ import annotations

import base64
import glob
import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import pyarrow as pa
from tidalframe.llm import byte_bpe, packing, token_store
from tidalframe.llm.tokens import cached_encoder

SCHEMA = "doc_id long, text string, ids string, part int, n_tokens string"
TEXTS = [
    None, "", " ", "\n\n", "Hello, world!  Two  spaces.", "<|endoftext|> and <|startoftext|>", "naïve café — “quoted”… 東京 🙂🙃 e\u0301", "tabs\tand\r\nlines\n\n\nend ",
    "aaaaaaaaaaaaa aaaaa aaa", "don't we'll I'M", "a.b,c;d:e!f?", "x" * 40_000, "word " * 20_000, "\u00a0\u2003 \u3000x", "İstanbul ŉ ſ ß", "١٢٣ 123456789", "#$%&|*(){}[]<>", "\x00\x1c\x85",
]


def table(spark, texts=TEXTS):
    rows = [(i * 3, t, "clash", 1, "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[4], rows[4], (None, "no id", "", 1, "")], SCHEMA)


def library(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def own_tiktoken():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("name,word_mode", [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_encoder_equals_the_library(name, word_mode, spark, sf_dir):
    texts = TEXTS + [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    flat, counts = cached_encoder(public_tokenizers.path(name), word_mode).encode(pa.array(texts, pa.string()))
    plain = library(name)
    for text, ids in zip(texts, np.split(flat, np.cumsum(counts)[:-1])):
        assert ids.tolist() == plain(text), repr((text or "")[:80])


alphabet = st.lists(st.sampled_from([*"ab A.,'!\n\t é—🙂1_<|>sS", "\u00a0", "ß", "e\u0301", "\u2009", " the", "'s"]), max_size=60).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(alphabet, min_size=1, max_size=4))
def test_encoders_equal_the_libraries_on_odd_texts(texts):
    for name, word_mode in (("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)):
        flat, counts = cached_encoder(public_tokenizers.path(name), word_mode).encode(pa.array(texts, pa.string()))
        assert [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])] == [LIBRARY[name](t) for t in texts]
    flat, counts = byte_bpe.encoder(byte_bpe.Settings()).encode(pa.array(texts, pa.string()))
    assert [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])] == [TIKTOKEN.encode_ordinary(t) for t in texts]


@pytest.mark.parametrize("name,word_mode", [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
@pytest.mark.parametrize("special", [False, True])
def test_special_strings_are_text_or_tokens(name, word_mode, special):
    plain = Tokenizer.from_file(public_tokenizers.path(name))
    plain.encode_special_tokens = not special
    rng = random.Random(6)
    parts = ["a", " ", "  ", "\n", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|", "|>", "é", ".", "x<|endoftext|>y "]
    texts = [None, "", *("".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(400))]
    flat, counts = cached_encoder(public_tokenizers.path(name), word_mode, special).encode(pa.array(texts, pa.string()))
    assert [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])] == [plain.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_token_store_parts_rows_that_are_alike(spark, tmp_path):
    rows = spark.range(0, 4000, 1, 8).selectExpr("7L as doc_id", "repeat('same text ', 50) as text")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the table is small
    try:
        token_store.write(rows, str(tmp_path / "t"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    stored = spark.read.orc(str(tmp_path / "t"))
    assert stored.count() == 4000 and stored.select("part").distinct().count() > 1


LIBRARY = {name: library(name) for name in ("word_bpe_49k.json", "byte_bpe_50k.json")}
TIKTOKEN = own_tiktoken()


def test_byte_bpe_equals_tiktoken_and_decodes(spark):
    rng = random.Random(4)
    odd = ["".join(rng.choice("aáb 東🙂\n.") for _ in range(rng.randint(1, 90))) for _ in range(200)]
    docs = table(spark, TEXTS + odd)
    got = byte_bpe.encoded(docs, decoded=True).collect()
    assert len(got) == docs.count()
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in got:
        text = texts[r["doc_id"]]
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert ids == TIKTOKEN.encode_ordinary(text) and r["n_tokens"] == len(ids)
        assert bytes(r["decoded"]).decode() == text
        sizes = [len(TIKTOKEN.decode_single_token_bytes(i)) for i in ids]
        assert np.frombuffer(r["byte_ends"], "<u4").tolist() == np.cumsum(sizes).tolist()


def test_byte_bpe_decodes_split_characters(spark):
    ids = TIKTOKEN.encode_ordinary("🙂 東京")
    cut = spark.createDataFrame([(np.array(x, "<u4").tobytes(),) for x in (ids, ids[:1], [], ids[1:])], "ids binary")
    got = [r["t"] for r in cut.select(byte_bpe.decode(kind="string")("ids").alias("t")).collect()]
    assert got[0] == "🙂 東京" and got[2] == "" and "\ufffd" in got[1]


def test_byte_bpe_query(spark, sf_dir):
    got = {r["doc_id"]: r for r in byte_bpe.query(spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids = TIKTOKEN.encode_ordinary(r["text"] or "")
        x = got[r["doc_id"]]
        ends = np.cumsum([len(TIKTOKEN.decode_single_token_bytes(i)) for i in ids], dtype=np.int64).astype("<u4")
        assert x["byte_ends_sha256"] == hashlib.sha256(ends.tobytes()).hexdigest()
        assert (x["n_tokens"], x["ids_sha256"], x["decoded_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest())


def test_byte_bpe_edges(spark):
    assert byte_bpe.encoded(table(spark).where("false"), decoded=True).count() == 0
    twice = spark.createDataFrame([(None, None, 1), (None, None, 1), (5, "", 1), (5, "same", 1), (5, "same", 1)], "doc_id long, text string, n_tokens int")
    got = byte_bpe.encoded(twice).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in got) == [(0, 0), (0, 0), (5, 0), (5, 1), (5, 1)]
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        assert byte_bpe.byte_table(byte_bpe.Settings()) == [base64.b64decode(line.split()[0]) for line in f]


def test_token_store_round_trip(spark, tmp_path):
    docs, path = table(spark), str(tmp_path / "tokens")
    token_store.write(docs, path)
    plain = library("word_bpe_49k.json")
    got = token_store.read(spark, path).orderBy("start").collect()
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0)) and len(got) == docs.count()
    want = defaultdict(list)
    for r in docs.collect():
        want[r["doc_id"]].append([*plain(r["text"]), 2])
    at = 0
    for r in got:
        assert r["start"] == at and r["ids"] in want[r["doc_id"]] and r["n_tokens"] == len(r["ids"])
        at += r["n_tokens"]
    found = token_store.lookup(spark, path, [12, 15]).collect()
    assert sorted(r["doc_id"] for r in found) == [12, 12, 12, 15]
    token_store.write(docs.where("false"), path + "-empty")
    assert token_store.read(spark, path + "-empty").count() == 0


def test_token_store_pushes_the_lookup_down(spark, tmp_path):
    token_store.write(table(spark), str(tmp_path / "t"))
    plan = token_store.lookup(spark, str(tmp_path / "t"), [12])._jdf.queryExecution().toString()
    assert "EqualTo(doc_id,12)]" in plan


def test_token_files_hold_indexes_filters_and_run_lengths(spark, tmp_path):
    token_store.write(table(spark), str(tmp_path / "t"))
    orc, seen = spark._jvm.org.apache.orc, 0
    for file in glob.glob(str(tmp_path / "t" / "*.orc")):
        reader = orc.OrcFile.createReader(spark._jvm.org.apache.hadoop.fs.Path(file), orc.OrcFile.readerOptions(spark._jsc.hadoopConfiguration()))
        names, rows = list(reader.getSchema().getFieldNames()), reader.rows()
        doc_id, ids = names.index("doc_id") + 1, reader.getSchema().findSubtype("ids").getMaximumId()
        for stripe in reader.getStripes():
            footer = rows.readStripeFooter(stripe)
            streams = {(x.getColumn(), x.getKind().toString()) for x in footer.getStreamsList()}
            assert {(doc_id, "ROW_INDEX"), (doc_id, "BLOOM_FILTER_UTF8"), (ids, "ROW_INDEX")} <= streams
            assert {c for c, kind in streams if kind.startswith("BLOOM")} == {doc_id}
            assert footer.getColumns(ids).getKind().toString() == footer.getColumns(doc_id).getKind().toString() == "DIRECT_V2"
            seen += 1
        rows.close()
    assert seen


def test_token_store_query(spark, sf_dir):
    plain, at = library("word_bpe_49k.json"), 0
    got = {r["doc_id"]: r for r in token_store.query(spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect():
        ids = [*plain(r["text"]), 2]
        x = got[r["doc_id"]]
        assert (x["start"], x["n_tokens"], x["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def check_packed(rows, texts, capacity=1024):
    """Each id in one piece, gapless sequences; -> share of padding."""
    plain, pieces, sequences = library("byte_bpe_50k.json"), defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r), sequences[r["sequence_id"]].append(r)
    assert set(pieces) == set(texts)
    for doc, mine in pieces.items():
        ids, at = [*plain(texts[doc]), 0], 0
        for r in sorted(mine, key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    padding = total = 0
    for mine in sequences.values():
        at = 0
        for r in sorted(mine, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
        total += at
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding / total


def test_packing_covers_every_id_with_little_padding(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    share = check_packed(packing.query(spark, sf).collect(), {r["doc_id"]: r["text"] for r in docs.collect()})
    assert share < 0.02


def test_packing_edges(spark):
    texts = [(i, t, "c", 1, "c") for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(texts, SCHEMA)
    check_packed(packing.packed(docs).collect(), dict(enumerate(TEXTS)))
    assert packing.packed(docs.where("false")).count() == 0
    twice = spark.createDataFrame([(1, "same text", "", 1, "")] * 3 + [(None, None, "", 1, "")], SCHEMA)
    got = packing.packed(twice).collect()
    assert sorted((r["doc_id"] is None, r["length"]) for r in got)[-1] == (True, 1) and len({(r["sequence_id"], r["offset"]) for r in got}) == 4


def test_packing_finds_the_cheapest_cuts():
    rng = random.Random(2)
    s = packing.Settings(capacity=16, grid=4)
    for _ in range(200):
        lengths = np.array([rng.randint(1, 30) for _ in range(rng.randint(1, 6))])
        ends = np.cumsum(lengths)
        sentences = np.flatnonzero(np.array([rng.random() < 0.2 for _ in range(ends[-1])])) + 1
        points, penalty = packing.cut_points(ends, sentences, s)
        cuts = packing.best_cuts(points, penalty, s)

        def cost(i, j):
            n = points[j] - points[i]
            return penalty[j] + s.sequence_cost + (0 if n & (n - 1) == 0 else s.capacity - n)

        best = [0.0]
        for j in range(1, points.size):
            best.append(min(best[i] + cost(i, j) for i in range(j) if points[j] - points[i] <= s.capacity))
        assert sum(cost(i, j) for i, j in zip([0, *cuts], cuts)) == pytest.approx(best[-1]) and cuts[-1] == points.size - 1


def test_stored_tokens_give_memory_back_after_each_task(spark, tmp_path, monkeypatch):
    wrapped, plain = [], token_store.lean
    monkeypatch.setattr(token_store, "lean", lambda run: wrapped.append(run) or plain(run))
    path = str(tmp_path / "tokens")
    token_store.write(spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string"), path)
    rows = token_store.read(spark, path).select("doc_id", "ids", token_store.ids_crc32()("ids").alias("crc")).collect()
    assert len(wrapped) == 1 and len(rows) == 2
    assert all(r["crc"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in rows)
    assert token_store.read(spark, path).where("false").select(token_store.ids_crc32()("ids")).collect() == []
