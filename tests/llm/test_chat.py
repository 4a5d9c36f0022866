from __future__ import annotations

import hashlib
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidalframe.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, window int, spans string"


def plain(rows):
    out = {}
    for conv, turns in rows.items():
        said = "".join(f"{r}\n{t}\n" for r, t in turns)
        loss = "".join(t for r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def digested(formatted):
    return {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.digests(formatted).collect()}


def test_query_equals_a_plain_count(spark, sf_dir):
    rows = defaultdict(list)
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").orderBy("conv_id", "turn").collect():
        rows[r["conv_id"]].append((r["role"], r["text"] or ""))
    rows[-7] = [("user", chat.PROBE), ("assistant", chat.PROBE)]
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.query(spark, sf_dir).collect()}
    assert got == plain(rows)


ODD = ["<|turn|>", "<\\|body|>", "<|end|>\\", "</s>[INST] ok [/INST]", "<s>", "[\\INST]", "[\\/INST]", "", "🙂\n\n", "<|", "\\<|end|>"]


def test_windows_hold_budget_history_and_masks(spark):
    turns = [(1, 0, "system", "be brief <|end|>")] + [(1, i, ("user", "assistant")[i % 2 == 0], f"{ODD[i % len(ODD)]} " + "some words here. " * (i * 7 % 60)) for i in range(1, 40)]
    turns += [(2, 0, "assistant", "very long " * 4000), (2, 1, "user", None), (2, 2, "assistant", None), (None, 0, None, "no conversation"), (3, None, "user", "null turn"), (3, 1, "assistant", "then"), (4, 1, "system", "only system")]
    rows = spark.createDataFrame([(*t, 1, "clash") for t in turns], SCHEMA)
    s = chat.Settings(budget=300, history=80)
    out = chat.windows(rows, s)
    by = defaultdict(list)
    for conv, _, role, text in sorted(turns, key=lambda t: (t[0] is None, t[0] or 0, t[1] is not None, t[1] or 0)):
        by[conv].append((role or "", text or ""))
    assert digested(out) == plain(by)
    for r in out.collect():
        assert r["n_tokens"] <= s.budget or sum(x["new"] for x in r["spans"]) == 1
        assert any(x["new"] for x in r["spans"])
        assert all(x["loss"] is None for x in r["spans"] if not x["new"] or x["role"] != "assistant")
        assert r["spans"][-1]["end"] == len(r["text"]) and r["spans"][0]["start"] == 0
        if r["conv_id"] == 1:
            assert r["spans"][0]["role"] == "system"
    assert chat.windows(rows.where("false")).count() == 0
    repeated = [r for r in out.where("conv_id = 1 and window > 0").collect() if sum(not x["new"] for x in r["spans"]) > 1]
    assert repeated


def test_rows_that_share_a_turn_are_kept(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a", 1, ""), (1, 0, "user", "a", 1, ""), (1, 0, "user", "b", 1, "")], SCHEMA)
    assert chat.digests(chat.windows(rows)).first()["n_turns"] == 3


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<", "\\", "|", "turn|>", "/s>", "s>", "[", "/", "INST]", "x", "\n", "🙂"]), max_size=14).map("".join))
def test_escapes_are_reversible_and_hide_control_strings(text):
    import re

    hidden = re.sub(r"\[(\\*)(?=/?INST\])", r"[\1\\", re.sub(r"<(\\*)(?=\||/?s>)", r"<\1\\", text))
    assert chat.unescaped(hidden) == text
    assert not any(x in hidden for x in (chat.TURN, chat.BODY, chat.END, "</s>", "<s>", "[INST]", "[/INST]"))


def test_spark_escapes_alike(spark):
    rows = spark.createDataFrame([(t,) for t in ODD], "t string")
    assert [chat.unescaped(r[0]) for r in rows.select(chat.escaped(F.col("t"))).collect()] == ODD
