from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pytest

from tidalframe.llm import paragraph_sketch as sketch


def pieces(text):
    raw = text.encode()
    ends = sketch.cuts(np.frombuffer(raw, np.uint8)).tolist()
    return [raw[a:b] for a, b in zip([0, *ends], ends)]


def share(a, b):
    """The common share of two texts' pieces, counted with repeats."""
    a, b = Counter(pieces(a)), Counter(pieces(b))
    both = a.total() + b.total()
    return 1 - ((a - b).total() + (b - a).total()) / both if both else 1.0


def test_pieces_are_the_text_and_keep_apart_from_edits(sf_dir, spark):
    texts = [r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()] + ["", " ", "a", "\n\n\n", "é" * 999, "no end " * 999, " ퟿\U0001f600 x"]
    for t in texts:
        assert b"".join(pieces(t)) == t.encode() and all(pieces(t))
        assert pieces("a new beginning.\n" + t)[-len(pieces(t)) + 1 :] == pieces(t)[1:] or len(pieces(t)) < 2
    words = [len(p.split()) for t in texts for p in pieces(t)]
    assert 2 < np.mean(words) < 8


def test_differences_recover_the_digests():
    rng = np.random.default_rng(5)
    sets = [(rng.integers(1, 2**62, a), rng.integers(1, 2**62, b), rng.integers(1, 2**62, c)) for a, b, c in [(0, 0, 0), (5, 0, 0), (0, 3, 0), (0, 0, 4), (40, 2, 1), (40, 9, 0), (1000, 300, 400), (0, 2000, 1)]]
    keys = lambda parts: sketch.Keys(np.repeat(np.arange(len(parts)), [p.size for p in parts]), np.concatenate(parts).astype(np.uint64), len(parts))
    left, right = keys([np.concatenate((s, a)) for s, a, _ in sets]), keys([np.concatenate((b, s)) for s, _, b in sets])
    text, key, side = sketch.differences(left, right, 3)
    got = {(t, k, s) for t, k, s in zip(text.tolist(), key.tolist(), side.tolist())}
    assert got == {(i, k, s) for i, (_, a, b) in enumerate(sets) for s, part in ((1, a), (-1, b)) for k in part.tolist()} and text.size == len(got)


def test_a_small_sketch_says_that_it_fails():
    keys = sketch.Keys(np.array([0] * 200 + [1]), np.arange(1, 202).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 2)
    none = sketch.Keys(np.zeros(0, np.int64), np.zeros(0, np.uint64), 2)
    _, _, _, whole = sketch.peeled(sketch.sketched(keys, 12).minus(sketch.sketched(none, 12)))
    assert whole.tolist() == [False, True]


@pytest.mark.parametrize("parts,slice_bytes", [(1, 1 << 20), (5, 300)])
def test_rows_equal_the_plain_steps(spark, parts, slice_bytes):
    long = "The tide comes in and goes out again, as it always did. " * 400
    rows = [(5, "a b c d e f g h\ni j"), (2, None), (2, ""), (9, long), (11, long), (7, "kurz"), (-3, "ümlaut " * 30), (40, "x\ny\nz\n" * 50), (41, "x\ny\nz\n" * 50 + "tail"), (None, "the last of all")]
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, r int, kind string").repartition(parts)
    got = sketch.fingerprinted(df, slice_bytes).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    want = {}
    for (i, t), (_, after) in zip(order, [*order[1:], order[0]]):
        t, after = t or "", after or ""
        k = len(t) // 4
        new = t[: len(t) - k] + after[:k]
        want.setdefault(i, []).append((len(t), hashlib.sha256(new.encode()).hexdigest(), share(t, new), share(t, after)))
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows)
    for r in got:
        mine = (r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"])
        assert any(mine[:2] == w[:2] and mine[2:] == pytest.approx(w[2:]) for w in want[r["doc_id"]])
    prints = {r["doc_id"]: bytes(r["fingerprint"]) for r in got}
    assert prints[9] == prints[11] and len(set(prints.values())) == len(prints) - 1


def test_one_row_empty_tables_and_repeated_rows(spark):
    kind = "doc_id long, text string"
    assert sketch.fingerprinted(spark.createDataFrame([], kind)).count() == 0
    one = sketch.fingerprinted(spark.createDataFrame([(1, "abcd efgh")], kind)).collect()
    assert len(one) == 1 and one[0]["edited_sha256"] == hashlib.sha256(b"abcd efab").hexdigest() and one[0]["near_next"] == 1.0
    same = sketch.fingerprinted(spark.createDataFrame([(1, "abcd efgh")] * 40, kind).repartition(4)).collect()
    assert len(same) == 40 and {(r["edited_sha256"], r["near_next"]) for r in same} == {(one[0]["edited_sha256"], 1.0)}


def test_query_covers_every_document_and_tells_edits_from_strangers(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in sketch.query(spark, sf_dir).collect()}
    ids = sorted(docs)
    assert sorted(got) == ids
    for i, after in zip(ids, [*ids[1:], ids[0]]):
        k = len(docs[i]) // 4
        new = docs[i][: len(docs[i]) - k] + docs[after][:k]
        assert got[i]["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest() and got[i]["n_chars"] == len(docs[i])
        assert got[i]["near_edited"] == pytest.approx(share(docs[i], new)) and got[i]["near_next"] == pytest.approx(share(docs[i], docs[after]))
    by_text = {}
    for i in ids:
        by_text.setdefault(docs[i], set()).add(got[i]["fingerprint"])
    assert all(len(p) == 1 for p in by_text.values())
    assert np.mean([r["near_edited"] > r["near_next"] for r in got.values()]) > 0.9
