from __future__ import annotations

import json

import pytest
from tidalframe.sources import backup

TRICKY = ['plain', 'quote " and \\ slash', '\\\\"', '{"id": [1, 2]}', 'line\nbreak', '\\' * 9, '"}],"sessions":[{', 'é漢😀', '', ']' * 30]
RECORDS = [{"id": i, "name": t, "more": {"a": [t, {"b": [i]}], "recordings": t}} for i, t in enumerate(TRICKY)]
SESSIONS = [{"id": i, "recordings": [{"id": j} for j in range(i)]} for i in range(4)]
DOC = {"meta": {"version": 1, "note": 'a "meta": [{', "list": [{"no": 1}]}, "kind": "recordings", "recordings": RECORDS, "empty": [], "sessions": [*SESSIONS, 7, "text", None, [1, [2]]], "end": "]}"}


def pairs(rows):
    return [(r["section"], json.loads(r["json"])) for r in rows.orderBy("at").collect()]


@pytest.mark.parametrize("block", [5, 1 << 20])
@pytest.mark.parametrize("indent", [None, 3])
@pytest.mark.parametrize("size", [7, 64, 1 << 20])
def test_every_range_finds_its_records(tmp_path, monkeypatch, size, indent, block):
    """The steps of the reader, range by range, without Spark."""
    monkeypatch.setattr(backup, "BLOCK", block)
    text = json.dumps(DOC, indent=indent, ensure_ascii=False).encode()
    (tmp_path / "b.json").write_bytes(text)
    doc = backup.Document(str(tmp_path), backup.files.listed(str(tmp_path)))
    inside = depth = 0
    key, found = None, []
    for start in range(0, len(text), size):
        end = min(len(text), start + size)
        found += [(k, json.loads(raw)) for k, _, raw in backup._records(doc, start, end, inside, depth, key)]
        key = backup._last_key(doc, start, end, inside, depth) or key
        odd, *changes = backup._scanned(doc, start, end)
        depth += changes[2 * inside]
        inside = (inside + odd) % 2
    assert (inside, depth) == (0, 0)
    assert [x for x in found if x[0] != "meta"] == [*(("recordings", r) for r in RECORDS), *(("sessions", s) for s in [*SESSIONS, [1, [2]]])]


@pytest.mark.parametrize("size", [61, 1 << 20])
def test_a_document_in_one_line_or_many_files_is_read_in_ranges(spark, tmp_path, size):
    text = json.dumps(DOC, ensure_ascii=False).encode()
    for i, at in enumerate(range(0, len(text), 200)):
        (tmp_path / f"part-{i:03}").write_bytes(text[at : at + 200])
    (tmp_path / "_SUCCESS").write_bytes(b"")
    got = pairs(backup.read_backup(spark, str(tmp_path), ["recordings", "sessions"], size))
    assert got == [*(("recordings", r) for r in RECORDS), *(("sessions", s) for s in [*SESSIONS, [1, [2]]])]


def test_broken_and_empty_documents(spark, tmp_path):
    (tmp_path / "cut.json").write_text(json.dumps(DOC)[:-1])
    (tmp_path / "text.json").write_text(json.dumps(DOC)[:-3])
    (tmp_path / "none.json").write_text("")
    with pytest.raises(ValueError, match="depth 1"):
        backup.read_backup(spark, str(tmp_path / "cut.json"))
    with pytest.raises(ValueError, match="in a string"):
        backup.read_backup(spark, str(tmp_path / "text.json"))
    assert backup.read_backup(spark, str(tmp_path / "none.json")).count() == 0
    with pytest.raises(FileNotFoundError):
        backup.read_backup(spark, str(tmp_path / "nowhere"))


def test_what_is_written_is_one_document(spark, tmp_path):
    rows = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(RECORDS)] + [(0, json.dumps({"id": 0})), (99, None)], "id long, json string").repartition(6)
    none = rows.where("id < 0")
    backup.write_backup(str(tmp_path / "b"), {"recordings": (rows.where("id < 90"), ["id"]), "sessions": (none, ["id"]), 'odd "name"': (rows.where("id = 3"), ["id"])}, {"version": 2})
    nulls = spark.createDataFrame([(None, "[1]"), (None, "[1]"), (0, None), (None, None), (3, "{}")], "id long, json string").repartition(4)
    backup.write_backup(str(tmp_path / "n"), {"x": (nulls, ["id"])})
    x = json.loads("".join(p.read_text() for p in sorted((tmp_path / "n").rglob("part-*"))))["x"]
    assert sorted(map(str, x[:3])) == ["None", "[1]", "[1]"]
    assert x[3:] == [None, {}] and backup.read_backup(spark, str(tmp_path / "n"), ["x"]).count() == 3
    text = "".join(p.read_text() for p in sorted((tmp_path / "b").rglob("part-*")))
    want = json.loads(text)
    assert want["meta"] == {"version": 2} and want["sessions"] == [] and want['odd "name"'] == [RECORDS[3]]
    assert [r["id"] for r in want["recordings"]] == [0, *range(len(RECORDS))] and all(r in want["recordings"] for r in RECORDS)
    got = pairs(backup.read_backup(spark, str(tmp_path / "b"), None, 50))
    assert got == [*(("recordings", r) for r in want["recordings"]), ('odd "name"', RECORDS[3])]
