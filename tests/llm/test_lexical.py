from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import oracle
from tidalframe.llm import lexical


def terms(text):
    return re.findall(lexical.TERM, re.sub("[A-Z]", lambda x: x[0].lower(), text or ""))


def brute(docs, items, k):
    """Every score by the formula, in Python's integers; null ids last."""
    found = [(i, c) for i, c in ((i, Counter(terms(t))) for i, t in docs) if c]
    n_docs, total = len(found), sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in found:
            m = 100 - 90 + (90 * sum(c.values()) * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(terms(text)) & set(c))
            if s > 0:
                scored.append((-s, math.inf if i is None else i))
        out += [(item, r + 1, None if i == math.inf else i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


DOCS = [(1, None), (2, ""), (3, "--- ,,, \x7f\t"), (4, "Tide TIDE tide. ebb"), (5, "tide tide ebb flow"), (5, "tide tide ebb flow"), (6, "tide tide ebb flow"), (None, "tide tide ebb flow"), (-7, "ÉBB ébb  x  x1"), (8, "rare " + "filler " * 3000), (9, "filler " * 20_000 + "tide"), (10, "a"), (11, "a-b_c 12,5")]
ITEMS = [(1, "tide"), (1, "tide"), (2, "TIDE tide ebb"), (3, None), (4, "..."), (5, "unheard"), (6, "Ébb ébb x"), (7, "filler rare tide a b c 12"), (None, "flow")]


@pytest.mark.parametrize("shard,block,block_terms", [(64, 2, 200_000), (1 << 20, 256, 200_000), (200, 256, 3)])
def test_search_equals_brute_force(spark, shard, block, block_terms):
    docs = spark.createDataFrame([(i, t, 0) for i, t in DOCS], "doc_id long, text string, term int").repartition(3)
    items = spark.createDataFrame([(i, t, 0) for i, t in ITEMS], "item_id long, text string, item int")
    index = lexical.build(docs, shard)
    got = lexical.search(spark, index, items, 3, block, block_terms)
    assert sorted((tuple(r) for r in got.select("item_id", "rank", "doc_id", "score").collect()), key=str) == brute(DOCS, ITEMS, 3)
    assert lexical.search(spark, index, items.where("false")).count() == 0


def test_search_of_no_documents(spark):
    items = spark.createDataFrame([(1, "tide")], "item_id long, text string")
    for docs in ([], [(1, None), (2, "  ")]):
        assert lexical.search(spark, lexical.build(spark.createDataFrame(docs, "doc_id long, text string")), items).count() == 0


def test_every_document_is_in_the_index(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    index = lexical.build(docs, 20_000)
    assert index.where("term is null").count() > 3
    ids = [r["id"] for r in index.where("term is null").select(F.explode("ids").alias("id")).collect()]
    assert sorted(ids) == sorted(r["doc_id"] for r in docs.collect() if terms(r["text"]))
    df = {r["term"]: r["n"] for r in index.where("term is not null").groupBy("term").agg(F.sum("df").alias("n")).collect()}
    assert df == dict(Counter(t for r in docs.collect() for t in set(terms(r["text"]))))


def test_numbers_come_back_from_bytes():
    x = np.array([0, 1, 127, 128, 16_383, 16_384, 2**31, 2**40 + 5, 2**61, 3] * 7)
    raw, sizes = lexical.packed(x)
    assert lexical.unpacked(raw).tolist() == x.tolist() and sizes.sum() == raw.size
    assert lexical.unpacked(lexical.packed(np.zeros(0, np.int64))[0]).size == 0


def test_merge_keeps_the_first_of_equal_scores():
    lists, gains = [np.arange(50), np.array([3, 7])], [np.full(50, 2), np.array([5, 0])]
    assert lexical.best_of_shard(lists, gains, np.array([[1, 0, 1], [0, 1, 1]]), 3) == [[(2, 0), (2, 1), (2, 2)], [(5, 3)], [(7, 3), (2, 0), (2, 1)]]
    assert lexical.best_of_shard([], [], np.zeros((0, 1), int), 3) == [[]]


def test_search_equals_its_sql(spark, sf_dir):
    assert not oracle.differences(lexical.query(spark, sf_dir), oracle.connection(sf_dir), lexical.SQL)
