from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidalframe.llm import ngram_lm
from tidalframe.llm.common import remainder
from tidalframe.llm.elias_fano import EliasFano


def tokens(text):
    return [*(text or "").encode().lower().split(), b"\n"]


def held(doc_id):
    return zlib.crc32(str(doc_id).encode() if doc_id is not None else b"") % 5 == 1


def model(rows, mu2=100.0, mu3=20.0, held=held):
    """(c, N, p1, score): the trigram model counted plainly; every training word is a context and a successor."""
    train = [tokens(t) for i, t in rows if not held(i)]
    c, two, three, before, before2 = Counter(w for t in train for w in t), Counter(), Counter(), Counter(), Counter()
    for t in train:
        padded = ["START", "START", *t]
        for u, v, w in zip(padded, padded[1:], t):
            two[v, w] += 1
            three[u, v, w] += 1
            before[v] += 1
            before2[u, v] += 1
    n, v = sum(c.values()), len(c)
    p1 = lambda w: (c[w] + 0.5) / (n + 0.5 * (v + 1))

    def score(text):
        padded, total = ["START", "START", *tokens(text)], 0.0
        for u, v, w in zip(padded, padded[1:], padded[2:]):
            p2 = (two[v, w] + mu2 * p1(w)) / (before[v] + mu2)
            total += math.log10((three[u, v, w] + mu3 * p2) / (before2[u, v] + mu3))
        return total

    return c, n, p1, score


def corpus(seed=1, n=300):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.6)) % 900}" for _ in range(4000)]
    out = []
    for i in range(n):
        at = rng.randrange(3500)
        out.append((i, " ".join(words[at : at + rng.randint(0, 200)]).upper() if i % 2 else " ".join(words[at : at + rng.randint(0, 200)])))
    return [*out, (1000, None), (1001, ""), (1002, " \n\t"), (1003, "é É unseen🙂 " * 5), (1003, "é É unseen🙂 " * 5), (None, "no id"), (1004, "w1 " * 50_000)]


def check(got, rows, held=held, mu3=20.0):
    c, n, p1, score = model(rows, mu3=mu3, held=held)
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    for i, t in rows:
        r, mine = by[i], tokens(t)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(mine), sum(c[w] > 0 for w in mine), n)
        assert r["base_score"] == pytest.approx(sum(math.log10(p1(w)) for w in mine), rel=1e-9)
        assert r["score"] == pytest.approx(score(t), abs=0.0002 * (1 + len(mine)))


@pytest.mark.parametrize("hot_share", [1, 8, 1 << 14])
def test_scores_equal_a_plain_model(spark, hot_share):
    """However many words count as hot, and so however many contexts are split, nothing changes."""
    rng = random.Random(4)
    rows = [*corpus(), *[(2000 + i, f"once{i} twice{i} once{i} odd{rng.randrange(9)}") for i in range(200)]]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, training string, shard int")
    s = ngram_lm.Settings(batch_bytes=20_000, hot_share=hot_share, shard_tokens=20_000)
    got = ngram_lm.scored(docs, remainder("doc_id", 5) != 1, s).collect()
    check(got, rows)
    assert all(r["held_out"] == held(r["doc_id"]) for r in got)


def test_a_stored_model_scores_other_texts(spark, tmp_path):
    rows, new = corpus(3), [(i, t) for i, t in corpus(5, 40)]
    s = ngram_lm.Settings(batch_bytes=20_000, shard_tokens=20_000)
    ngram_lm.fit(spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "m"), s)
    got = ngram_lm.score(spark.createDataFrame(new, "doc_id long, text string"), str(tmp_path / "m")).collect()
    _, n, _, score = model(rows, held=lambda i: False)
    assert len(got) == len(new) and {r["train_tokens"] for r in got} == {n}
    texts = dict(new)
    for r in got:
        assert r["score"] == pytest.approx(score(texts[r["doc_id"]]), abs=0.0002 * (1 + r["n_tokens"]))


def test_a_search_stays_within_its_context():
    """Contexts that share successors, and asked for words that only a neighbour has."""
    s = ngram_lm.Settings()
    contexts, words = np.array([5, 9, 12], np.uint64), np.array([3, 7, 8, 1 << 39], np.uint64)
    pairs = {(0, 3): 2, (0, 7): 1, (1, 3): 4, (2, 7): 1, (2, 8): 3}
    trie = ngram_lm.Trie((words, np.ones(4, np.uint64)), (contexts, np.array([3, 4, 4], np.uint64)), s)
    owner, word = (np.array(x) for x in zip(*pairs))
    trie.learn(owner, word.astype(np.uint64), np.array(list(pairs.values()), np.uint64))
    loaded = ngram_lm.Trie.loaded(trie.saved(), s)
    for t in (trie, loaded):
        for c, size in enumerate((3, 4, 4)):
            codes = t.shares(np.full(4, c), words)
            for w, code in zip(words.tolist(), codes.tolist()):
                want = pairs.get((c, w), 0)
                share = 0 if code == 0 else 10 ** (s.lowest - s.lowest / 65534 * (code - 1))
                assert share == pytest.approx(want / (size + s.mu3), rel=1e-3)
        assert t.shares(np.array([-1]), words[:1]).tolist() == [0]
        assert t.context_counts(np.array([5, 6, 12], np.uint64))[1].tolist() == [3, 0, 4]


def test_probabilities_of_each_context_sum_to_one():
    _, n, p1, score = model(corpus(7, 60))
    words = {w for i, t in corpus(7, 60) if not held(i) for w in tokens(t)}
    single = sum(p1(w) for w in words) + 0.5 / (n + 0.5 * (len(words) + 1))
    assert single == pytest.approx(1)


def test_twice_occurring_texts_score_apart(spark):
    rng = random.Random(12)
    rows = [(i, " ".join(f"v{rng.randrange(3000)}" for _ in range(150))) for i in range(300)]
    rows += [(1000 + i, t) for i, t in rows[:60]]
    got = {r["doc_id"]: r["score"] / r["n_tokens"] for r in ngram_lm.scored(spark.createDataFrame(rows, "doc_id long, text string"), F.lit(True)).collect()}
    once = sorted(x for i, x in got.items() if 60 <= i < 1000)
    bar = once[int(0.9 * len(once))]
    assert sum(got[i] > bar for i in range(60)) > 55


def test_no_training_text_and_no_text(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = ngram_lm.scored(docs, F.lit(False)).collect()
    assert {r["n_known"] for r in got} == {0} and all(math.isfinite(r["score"]) for r in got)
    assert ngram_lm.scored(docs.where("false"), F.lit(True)).count() == 0


def test_it_beats_the_base_on_unseen_text(spark, sf_dir):
    r = ngram_lm.query(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert r["b"] < r["s"] < 0


@pytest.mark.parametrize("high", [50, 10_000, 1 << 63])
def test_elias_fano_holds_its_values(high):
    rng = np.random.default_rng(9)
    for n in (0, 1, 2, 700, 5000):
        values = np.sort(rng.integers(0, high, n).astype(np.uint64))
        ef = EliasFano(values)
        if n:
            assert (ef.get(np.arange(n)) == values).all()
        distinct = np.unique(values)
        asked = np.concatenate((distinct, rng.integers(0, high, 300).astype(np.uint64)))
        at, there = EliasFano(distinct).successor(asked)
        assert (there == np.isin(asked, distinct)).all()
        if distinct.size:
            assert (at[there] == np.searchsorted(distinct, asked)[there]).all()


def test_elias_fano_searches_between_bounds():
    rng = np.random.default_rng(3)
    values = np.unique(rng.integers(0, 5000, 900).astype(np.uint64))
    ef, asked = EliasFano(values), rng.integers(0, 5200, 2000).astype(np.uint64)
    begin = rng.integers(0, values.size, 2000)
    end = np.minimum(values.size, begin + rng.integers(0, 50, 2000))
    at, there = ef.successor(asked, begin, end)
    for x, a, z, i, same in zip(asked, begin, end, at, there):
        want = a + np.searchsorted(values[a:z], x)
        assert i == want and same == (want < z and values[want] == x)


def test_the_query_equals_a_plain_model(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    check(ngram_lm.query(spark, sf_dir).collect(), rows)
