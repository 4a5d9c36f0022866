from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import xxhash

import pytest

from tidalframe.llm import common, simhash
from tidalframe.llm.graph import components


def plain(text):
    words = [w.decode() for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(values, radius=3):
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if bin(values[i] ^ values[j]).count("1") <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def texts(seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["É", "ñandú"]
    out = [None, "", " \n", "one", "One", "two words", "ONE\ttwo three"]
    for _ in range(60):
        text = [rng.choice(words) for _ in range(rng.randint(20, 400))]
        out.append(" ".join(text))
        for _ in range(rng.randint(0, 3)):
            changed = text[:]
            changed[rng.randrange(len(text))] = "changed"
            out.append(" ".join(changed))
    return out + out[10:14] + ["long " * 30_000]


def test_fingerprints_and_components_equal_brute_force(spark):
    all_texts = texts()
    docs = spark.createDataFrame([(1000 - i, t, 1, "x") for i, t in enumerate(all_texts)], "doc_id long, text string, fp int, root string")
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    assert len(got) == len(all_texts)
    values = [plain(t) for t in all_texts]
    assert [got[1000 - i]["fp"] % (1 << 64) for i in range(len(values))] == values
    members = defaultdict(list)
    for i, g in enumerate(groups(values)):
        members[g].append(1000 - i)
    for ids in members.values():
        assert {got[i]["component_id"] for i in ids} == {min(ids)}


def test_hot_blocks_lose_no_link(spark):
    rng = np.random.default_rng(5)
    centre = rng.integers(0, 1 << 62, 6)
    near = [int(c) ^ int(np.bitwise_or.reduce(1 << rng.choice(48, rng.integers(0, 4), replace=False).astype(np.int64))) if k else int(c) for c in centre for k in range(60)]
    values = sorted({*near, *[v & ~0xFFFF for v in near]})
    rows = spark.createDataFrame([(v,) for v in values], "fp long")
    want = groups(values)
    for levels in (1, 2, 4):
        found = {r["node"]: r["root"] for r in components(simhash.links(rows, hot=20, levels=levels)).collect()}
        assert all((found.get(values[i], values[i]) == found.get(values[j], values[j])) == (want[i] == want[j]) for i in range(len(values)) for j in range(i))


def test_blocks_cover_all_bits_of_every_path():
    paths = [tuple(range(64))]
    for _ in range(4):
        cuts = [simhash._block_masks(bits, 4) for bits in paths]
        for bits, cut in zip(paths, cuts):
            assert sum(mask % (1 << 64) for mask, _ in cut) == sum(1 << i for i in bits)
        paths = [rest for cut in cuts for _, rest in cut]
    assert all(len(rest) < 32 for rest in paths)


def test_near_duplicates_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0


def test_one_of_each_keeps_the_smallest_id_and_all_columns(spark):
    rows = [(5, "a b c d e", "x"), (2, "a b c d e", "y"), (2, "a b c d e", "z"), (None, "a b c d e", "n"), (9, "other words than these", "x"), (7, None, "x"), (8, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row_number string")
    out = simhash.one_of_each(docs)
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] for r in out.collect()) == [2, 7, 9]
    assert simhash.one_of_each(docs.where("false")).count() == 0


def test_tiles_skip_only_what_cannot_link():
    rng = np.random.default_rng(1)
    values = np.unique(np.concatenate([rng.integers(0, 1 << 63, 300).astype(np.uint64), (np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64)) | (np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64))]))
    member, root = simhash.tile_forest(values, 3, tile=16)
    parent = dict(zip(values[member].tolist(), values[root].tolist()))
    want = groups(values.tolist())
    assert all((parent.get(a, a) == parent.get(b, b)) == (want[i] == want[j]) for i, a in enumerate(values.tolist()) for j, b in enumerate(values.tolist()[:i]))


def shingles(text, k=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def test_majority_counts_bits():
    rng = np.random.default_rng(2)
    for n in (1, 2, 254, 255, 256, 1000):
        rows = rng.integers(0, 1 << 63, (n, 3)).astype(np.uint64) | (rng.integers(0, 2, (n, 3)).astype(np.uint64) << np.uint64(63))
        bits = (rows[:, :, None] >> np.arange(64).astype(np.uint64)) & np.uint64(1)
        want = (bits.sum(axis=0) * 2 > n).astype(np.uint64)
        assert (simhash.majority(rows) == (want << np.arange(64).astype(np.uint64)).sum(axis=1, dtype=np.uint64)).all()


def test_near_copies_of_five_word_shingles_go(spark):
    """Planted near copies of 0.8 and more, of texts of all lengths, and pairs below 0.6, by brute force."""
    rng = random.Random(9)
    out = []
    for i in range(220):
        text = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([30, 60, 150, 600, 2500]))]
        out.append(text)
        changed = text[:]
        for _ in range(max(1, len(text) // 60) if i % 3 else max(4, len(text) // 7)):
            changed[rng.randrange(len(text))] = "changed"
        out.append(changed)
    docs = [(i, " ".join(t), "x") for i, t in enumerate(out)]
    sets = [shingles(t) for _, t, _ in docs]
    stays = {r["doc_id"] for r in simhash.one_of_each(spark.createDataFrame(docs, "doc_id long, text string, row_number string")).collect()}
    near = [i for i in range(0, len(out), 2) if jaccard(sets[i], sets[i + 1]) >= 0.8]
    far = [i for i in range(0, len(out), 2) if jaccard(sets[i], sets[i + 1]) < 0.6]
    assert len(near) > 100 and len(far) > 20
    assert sum(i + 1 not in stays for i in near) >= 0.98 * len(near)
    assert all(i in stays and i + 1 in stays for i in far)


def test_stage_finds_the_near_copies_of_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    found = {r["row"]: r["component"] for r in simhash.similar(spark.createDataFrame(rows, "row long, text string")).collect()}
    sets, holders = {i: shingles(t) for i, t in rows}, defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    pairs = {(a, b) for ids in holders.values() if len(ids) > 1 for a in ids for b in ids if a < b}
    alike = {p: jaccard(sets[p[0]], sets[p[1]]) for p in pairs}
    near = [p for p, j in alike.items() if j >= 0.8]
    assert near and sum(found[a] == found[b] for a, b in near) >= 0.98 * len(near)
    assert not strangers(found, sets)


def strangers(found, sets):
    """Texts without a neighbour of 0.8 in their own group."""
    members = defaultdict(list)
    for i, c in found.items():
        members[c].append(i)
    return [i for ids in members.values() if len(ids) > 1 for i in ids if not any(j != i and jaccard(sets[i], sets[j]) >= 0.8 for j in ids)]


def test_no_document_of_a_group_lacks_a_near_copy_in_it(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").collect()]
    found = {r["row"]: r["component"] for r in simhash.similar(spark.createDataFrame(rows, "row long, text string").repartition(6)).collect()}
    sets = {i: shingles(t) for i, t in rows}
    assert len(found) == len(rows) and len(rows) - len(set(found.values())) > 500
    assert not strangers(found, sets)


def test_marked_ones_are_those_of_near_pairs_with_this_first_block():
    rng, s = np.random.default_rng(6), simhash.Similar()
    base = rng.integers(0, 1 << 62, (6, s.words)).astype(np.uint64)
    wide = np.repeat(base, 30, axis=0)
    flips = rng.random((len(wide), s.words, 64)) < rng.choice([0.0, 0.04, 0.12], (len(wide), 1, 1))
    wide = wide ^ (flips.astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=2, dtype=np.uint64)
    values = simhash.block_values(wide, s)
    assert values.shape[1] == 35
    apart = np.bitwise_count(wide[:, None] ^ wide[None]).sum(axis=2, dtype=np.int64)
    for block in (0, 1, 4, 20):
        want = [any(i != j and apart[i, j] <= s.radius and (values[i] == values[j]).any() and (values[i] == values[j]).argmax() == block for j in range(len(wide))) for i in range(len(wide))]
        # a bucket holds those that agree in its block
        for v in set(values[:, block].tolist()):
            here = np.flatnonzero(values[:, block] == v)
            got = simhash.with_near_ones(wide[here], block, s, tile=16)
            mine = [any(i != j and apart[i, j] <= s.radius and (values[i] == values[j]).argmax() == block for j in here) for i in here]
            assert got.tolist() == mine
        assert any(want) == any((values[i] == values[j]).argmax() == block and apart[i, j] <= s.radius for i in range(len(wide)) for j in range(i) if (values[i] == values[j]).any())


def test_verified_links_share_their_shingles():
    s = simhash.Similar()
    sets = [set(range(100)), set(range(5, 100)), set(range(30, 100)), set(range(100, 103)), set(), set(range(12, 100)), {1000}]
    wide = np.zeros((len(sets), s.words), np.uint64)  # all near by their fingerprints
    member, root = simhash.verified_forest(wide, np.concatenate([np.array(sorted(x), np.int64) for x in sets]), np.array([len(x) for x in sets]), s)
    assert dict(zip(member.tolist(), root.tolist())) == {1: 0, 5: 0}


def shuffled(spark):
    """Bytes that the application has shuffled so far."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    found = spark.sparkContext._jsc.sc().statusStore().executorList(True)
    return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))


def test_texts_without_near_ones_stay_where_they_are(spark, tmp_path):
    """Also where no table is small enough for the planner to broadcast it, as in large runs."""
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(60_000)]
    alone = [" ".join(rng.choices(words, k=3000)) for _ in range(200)]
    rows = [(i, t) for i, t in enumerate([*alone, *alone[:8]])]
    rows += [(1000 + i, " ".join(["changed", *alone[i].split(" ")[1:]])) for i in range(4)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled(spark)
        simhash.one_of_each(spark.read.parquet(str(tmp_path / "docs"))).write.parquet(str(tmp_path / "out"))
        moved = shuffled(spark) - before
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(r["doc_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(200))
    assert 0 < moved < 0.25 * sum(len(t) for _, t in rows)


@pytest.mark.parametrize("most", [common._WORDS, 0])
def test_picked_rows_are_those_of_a_join(spark, monkeypatch, most):
    monkeypatch.setattr(common, "_WORDS", most)
    numbers = [*range(-130, 300), 1 << 33, (1 << 33) + 63, (1 << 40) - 1, -(1 << 40), None]
    docs = spark.createDataFrame([(n, f"t{n}", 1) for n in numbers], "row long, word string, bits int")
    chosen = [-130, -129, -65, -64, -1, 0, 1, 62, 63, 64, 127, 128, 191, 299, 5000, 1 << 33, (1 << 40) - 1, -(1 << 40), None, 0]
    rows = spark.createDataFrame([(n,) for n in chosen], "row long")
    for inside, how in ((True, "left_semi"), (False, "left_anti")):
        got = common.picked(docs, "row", rows, inside)
        assert got.columns == docs.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, docs.join(rows, "row", how).select(docs.columns).collect()))
    assert common.picked(docs, "row", rows.where("false")).count() == 0
    assert common.picked(docs, "row", rows.where("false"), False).count() == len(numbers)
