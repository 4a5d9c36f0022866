from __future__ import annotations

import math
import re

import pytest
from pyspark.sql import functions as F

import oracle
from tidalframe.llm import classifier, quality_rules

WORD = re.compile("[^\x20\x09-\x0d]+")
DOCS = "doc_id long, text string, lang string, source string, words string, rule_measures int, score string"
TEXTS = [None, "", " \n\t ", "a b c d e f g h i j", "x y z u v " * 6, "same line\nsame line\n\nother * # $", "é" * 5000 + " ñ", "one\x0btwo\x0cthree four\rfive", "w " * 3000 + "end"]


def rows_of(spark, texts):
    rows = [(i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else "web", "clash", 1, "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[3], rows[3], (None, "no id at all here", "en", "web", "c", 1, "c")], DOCS)


def base(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)} if len(windows) < 500 or len(set(windows)) > 1 else set()
    if len(windows) >= 500:
        inside = {i + k for i, w in enumerate(windows) for k in range(5) if windows[0] == w}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside)


def test_rule_measures_equal_a_plain_count(spark):
    docs = rows_of(spark, TEXTS)
    got = quality_rules.judged(quality_rules.measured(docs), "_rule_measures").collect()
    assert len(got) == docs.count()
    for r in got:
        m = r["_rule_measures"]
        want = base(r["text"])
        assert (m["n_words"], m["word_chars"], m["n_symbols"], m["n_dup_lines"], m["n_repeat_words"]) == want
        verdict = r["rule_verdict"]
        assert verdict["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (verdict["base_failed"] and verdict["kept"])


def test_rules_keep_columns_and_take_empty_tables(spark):
    docs = rows_of(spark, TEXTS)
    assert quality_rules.kept_only(docs).columns == docs.columns
    assert quality_rules.kept_only(docs.where("false")).count() == 0


def test_a_group_with_other_habits_gets_its_own_fence(spark):
    plain = [(i, "word " * 4 + " ".join(f"t{i}{k}" for k in range(30)), "en", "web", "", 1, "") for i in range(300)]
    signs = [(1000 + i, " ".join(f"a{i}{k} * # $" for k in range(30)), "en", "code", "", 1, "") for i in range(300)]
    odd = [(5000, " ".join(f"b{k} * # $" for k in range(30)), "en", "web", "", 1, "")]
    kept = {r["doc_id"] for r in quality_rules.kept_only(spark.createDataFrame(plain + signs + odd, DOCS)).collect()}
    assert kept == set(range(300)) | set(range(1000, 1300))


def test_rules_equal_their_sql(spark, sf_dir):
    assert not oracle.differences(quality_rules.query(spark, sf_dir), oracle.connection(sf_dir), quality_rules.SQL)


def test_sketches_merge_to_within_a_bin(spark):
    values = [((i * 7919) % 100_003) // 7 for i in range(4000)]
    rows = spark.createDataFrame([("l", "s", v, v, v, 5) for v in values], "lang string, source string, symbol_rate long, dup_line_rate long, char_rate long, step long")
    sketch = quality_rules.sketches(rows)
    got = quality_rules.fences(sketch, ["lang"], dict.fromkeys(quality_rules.RATES, 0)).first()
    exact = sorted(values)[len(values) // 2 - 1]
    assert exact <= got["symbol_rate"] <= exact * (1 + 1 / 512) + 1


def exact_bin(x):
    shift = max(x.bit_length() - 10, 0)
    return (x >> shift) << shift, ((x >> shift) + 1 << shift) - 1


def test_fences_come_from_each_groups_own_quantiles(spark):
    """Brute force over all rows of documents: no cutoff but what the group's own rates give."""
    rows = quality_rules.query(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "lang", "source"), "doc_id").toPandas()
    found = set()
    for r, (measure, k) in quality_rules.RATES.items():
        rows[r] = [v * 1000 // n if n else 0 for v, n in zip(rows[measure].tolist(), rows["n_words"].tolist())]
        groups = [rows[rows.lang == lang] for lang in set(rows.lang)]
        groups = [g for big in groups for g in [*[x for _, x in big.groupby("source") if len(x) >= 50], big[big.groupby("source")["doc_id"].transform("size") < 50]] if len(g)]
        for g in groups:
            of = g if g.source.nunique() == 1 and len(g) >= 50 else rows[rows.lang == g.lang.iloc[0]]
            at = lambda ordered, q: ordered[math.ceil(q * len(ordered)) - 1]
            low, last = exact_bin(at(sorted(of[r].tolist()), 0.5))
            step = exact_bin(at(sorted(1_000_000 // n for n in of["n_words"].tolist() if n), 0.75))[0] / 1000
            fence = last + k * max(exact_bin(at(sorted(of[r].tolist()), 0.75))[0] - low, step)
            assert g[f"fence_{r}"].nunique() == 1 and g[f"fence_{r}"].iloc[0] == pytest.approx(fence)
            found.add((r, round(fence, 6)))
    for r, (_, k) in quality_rules.RATES.items():
        assert len({f for name, f in found if name == r}) > 20 and float(k) not in {f for name, f in found if name == r}


def test_adaptive_fences_tell_labelled_documents_apart(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    out = quality_rules.query(spark, sf).where("not base_failed").join(labels, "doc_id")
    share = {r["quality"]: r["k"] for r in out.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert share[1] > 0.99 and share[0] < 0.1


def test_a_char_rate_outlier_goes(spark):
    plain = [(i, " ".join(f"word{k}" + "x" * ((k + i) % 3) for k in range(40 + i % 5)), "en", "web", "", 1, "") for i in range(300)]
    odd = [(900, " ".join(f"k{k}" + "y" * 40 for k in range(40)), "en", "web", "", 1, "")]
    assert {r["doc_id"] for r in quality_rules.kept_only(spark.createDataFrame(plain + odd, DOCS)).collect()} == set(range(300))


def test_classifier_tells_held_out_documents_apart(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    out = classifier.query(spark, sf)
    got = out.where("held_out").join(labels, "doc_id").groupBy("quality").agg(F.avg("predicted").alias("p")).collect()
    share = {r["quality"]: r["p"] for r in got}
    assert share[1] > 0.98 and share[0] < 0.2


def test_classifier_scores_every_row(spark, sf_dir):
    docs = rows_of(spark, TEXTS)
    labels = spark.createDataFrame([(3, 1), (4, 0), (4, None), (5, 0), (7, 1), (8, 0), (None, 1)], "doc_id long, quality int")
    model = classifier.fit(docs, labels)
    got = docs.select("doc_id", classifier.score(docs, model).alias("p")).collect()
    assert len(got) == docs.count() and all(0 <= r["p"] <= 1 for r in got)
    alone = classifier.fit(docs, labels.where("quality = 1"))
    assert alone.constant == pytest.approx((2 + 1) / (2 + 2))  # documents 3 and 7; 3 stands there thrice
    assert classifier.fit(docs.where("false"), labels).constant == 0.5
    assert classifier.accepted(docs, labels).columns == docs.columns


def test_classifier_gives_the_same_scores_again(spark, sf_dir):
    first = {r["doc_id"]: r["score"] for r in classifier.query(spark, sf_dir).collect()}
    assert first == {r["doc_id"]: r["score"] for r in classifier.query(spark, sf_dir).collect()}


@pytest.mark.parametrize("fan", [2, 96])
def test_context_vectors_equal_plain_sums(spark, monkeypatch, fan):
    monkeypatch.setattr(classifier, "_FAN", fan)
    """Every neighbour within the window, in all texts, added up one by one."""
    s = classifier.Settings(buckets=256, dims=12, nonzero=4, window=2)
    texts = [t for t in TEXTS if t != "w " * 3000 + "end"] + ["One TWO two, three! ÉÉ"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    index, words, want = classifier.index_vectors(s), classifier.Words(s.buckets), [[0] * s.dims for _ in range(s.buckets)]
    for t in texts:
        ids = classifier.buckets_of((t or "").encode(), words).tolist()
        for i, a in enumerate(ids):
            for j, b in enumerate(ids):
                if 0 < abs(i - j) <= s.window:
                    want[a] = [x + int(y) for x, y in zip(want[a], index[b])]
    norm = [math.sqrt(sum(x * x for x in v)) or 1 for v in want]
    got = classifier.context_vectors(docs, s)
    assert all(got[b].tolist() == pytest.approx([x / norm[b] for x in want[b]], abs=1e-6) for b in range(s.buckets))


def test_pooling_and_network_equal_plain_ones():
    rng = __import__("numpy").random.default_rng(1)
    table, words, n = rng.normal(size=(64, 5)).astype("float32"), classifier.Words(64), None
    text = "one two two THREE, one four".encode()
    ids = classifier.buckets_of(text, words).tolist()
    n, kinds = len(ids), sorted(set(ids))
    share = {k: ids.count(k) / n for k in kinds}
    mean = [sum(share[k] * table[k][d] for k in kinds) for d in range(5)]
    flat = [sum(table[k][d] for k in kinds) / len(kinds) for d in range(5)]
    alike = [sum(a == b for a, b in zip(ids, ids[k:])) / (n - k) for k in classifier.LAGS]
    x = classifier.pooled(text, table, words)
    assert x.tolist() == pytest.approx([*mean, *flat, math.sqrt(sum(v * v for v in share.values())), math.log1p(n), *alike], rel=1e-5)
    m = classifier.Model(classifier.Settings(), table, *(rng.normal(size=k) for k in (14, 14)), rng.normal(size=(14, 3)), rng.normal(size=3), rng.normal(size=3), 0.3, 1.7)
    hidden = [max(0.0, sum((x[i] - m.mean[i]) / m.scale[i] * m.w1[i][h] for i in range(14)) + m.b1[h]) for h in range(3)]
    logit = sum(a * b for a, b in zip(hidden, m.w2)) + m.b2
    assert m.scores(x[None].astype(float))[0] == pytest.approx(1 / (1 + math.exp(-logit / 1.7)))


def test_network_training_lowers_the_loss_and_the_temperature_is_the_best_of_its_grid():
    np = __import__("numpy")
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 14))
    y = (x[:, 0] - x[:, 1] + rng.normal(0, 0.5, 400) > 0).astype(float)
    m = classifier.Model(classifier.Settings(epochs=20), np.zeros((1, 5), np.float32))
    classifier.train_network(m, x[:300], y[:300])
    loss = lambda t: np.mean(np.logaddexp(0, np.where(y[300:] > 0, -1, 1) * m.logits(x[300:]) / t))
    best = classifier.fit_temperature(m.logits(x[300:]), y[300:])
    assert loss(best) < 0.5 and all(loss(best) <= loss(t) + 1e-12 for t in np.exp(np.linspace(np.log(0.25), np.log(8), 60)))
