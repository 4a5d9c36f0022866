"""Operator 4: chat formatting in budgeted, turn-aligned windows.

1. Every turn is written between marks of its role; the control strings are escaped
   inside texts, so a formatted window can be parsed back. Its tokens are counted.
2. Prefix sums of a conversation's turn tokens choose spans: a window takes the leading
   system turn, at most `history` tokens of whole turns that earlier windows had, and
   then new turns up to the budget (one at least, so a long turn gets a window of its
   own). Only (turn number, tokens, role) of a conversation come together, in order and
   as a stream; texts don't.
3. Turns are dealt to their windows and each window is put together: its text, and
   spans (start, end, role, new, loss), in characters. loss is the range of an
   assistant's new text, without its marks; repeated turns have none, so they are masked.

A turn is new in exactly one window. Nulls and edges: a null text or role counts as
empty; a null conversation is one of its own; null turns come first; rows that share a
turn number are turns of their own, ordered by role and a hash of the text. Only a first turn of role
system is retained; later ones are turns like others. A very long text is formatted whole, in a
window of its own. Extra columns take no part, whatever their names; an empty table has no windows.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import public_tokenizers
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidalframe.llm.common import written
from tidalframe.llm.tokens import cached_encoder


@dataclass(frozen=True)
class Settings:
    tokenizer: str = public_tokenizers.path("byte_bpe_50k.json")
    budget: int = 1024
    history: int = 256


#: Control strings of the template. A role stands between the first and the second.
TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"


def escaped(text: Column) -> Column:
    """The text with one more backslash in each thing that looks like a control string, escaped ones included."""
    return F.regexp_replace(F.regexp_replace(text, r"<(\\*)(?=\||/?s>)", r"<$1\\"), r"\[(\\*)(?=/?INST\])", r"[$1\\")


def unescaped(text: str) -> str:
    return re.sub(r"\[(\\*)\\(?=/?INST\])", r"[\1", re.sub(r"<(\\*)\\(?=\||/?s>)", r"<\1", text))


def _token_counts(s: Settings):
    @F.arrow_udf("long")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = cached_encoder(s.tokenizer, False)
        for texts in batches:
            yield pa.array(encoder.encode(texts)[1])

    return run


class Spans:
    """Chooses the windows of one conversation, turn by turn; holds the history's turns only."""

    def __init__(self, s: Settings):
        self.s, self.window, self.total = s, -1, 0  # total: tokens before the next turn, the prefix sum
        self.system: tuple[int, int] | None = None
        self.room = 0
        self.recent: deque[tuple[int, int, int]] = deque()  # (turn, prefix sum before it, tokens)

    def add(self, turn: int, role: str, tokens: int) -> list[tuple[int, int, bool]]:
        """(window, turn, new) rows that this turn causes."""
        out: list[tuple[int, int, bool]] = []
        if turn == 0 and role == "system":
            self.system = (turn, tokens)
            self.window, self.room = 0, self.s.budget - tokens
            out.append((0, turn, True))
            return out
        if self.window < 0 or tokens > self.room:
            fresh = self.window >= 0 and not self.recent and self.system is not None and self.total == 0
            if not fresh:  # else the window holds the system turn only: the long turn joins it
                self.window += 1
                self.room = self.s.budget - (self.system[1] if self.system else 0)
                if self.window and self.system:
                    out.append((self.window, self.system[0], False))
                allowed = min(self.s.history, max(0, self.room - tokens))
                while self.recent and self.total - self.recent[0][1] > allowed:
                    self.recent.popleft()
                out += [(self.window, t, False) for t, _, _ in self.recent]
                self.room -= self.total - self.recent[0][1] if self.recent else 0
        out.append((self.window, turn, True))
        self.room -= tokens
        self.recent.append((turn, self.total, tokens))
        self.total += tokens
        while self.recent and self.total - self.recent[0][1] - self.recent[0][2] >= self.s.history:
            self.recent.popleft()
        return out


def windows(conversations: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(conv_id, turn, role, text) -> conv_id, window, text, spans, n_tokens; one row per window."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "role"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    body = F.concat(F.lit(TURN), escaped(F.col("role")), F.lit(BODY), escaped(F.col("text")), F.lit(END))
    rows = rows.withColumn("row", F.monotonically_increasing_id()).withColumn("said", body)
    rows = written(rows.withColumn("tokens", _token_counts(s)("said")).withColumn("h", F.xxhash64("text")), "turns")

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come conversation by conversation in turn order; what is held is one window's history."""
        now: object = spans
        for batch in batches:
            found: list[tuple[int, int, int, bool, int]] = []
            for conv, row, role, tokens in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "row", "role", "tokens"))):
                if conv != now:
                    now, chosen, number, named = conv, Spans(s), 0, {}
                named[number] = row
                for window, turn, new in chosen.add(number, role, tokens):
                    found.append((conv, window, named[turn], new, turn))
                keep = {t for t, _, _ in chosen.recent} | ({chosen.system[0]} if chosen.system else set())
                named = {t: r for t, r in named.items() if t in keep}
                number += 1
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64())
            columns = list(zip(*found)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["conv", "window", "row", "new", "place"])

    light = rows.select("conv_id", "turn", "role", "tokens", "row", "h").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "h", "row")
    dealt = light.mapInArrow(spans, "conv long, window long, row long, new boolean, place long")
    turns = dealt.join(rows.select("row", "said", "role", "text", "tokens"), "row")
    # a window's turns are bounded by the budget
    gathered = turns.groupBy("conv", "window").agg(
        F.array_sort(F.collect_list(F.struct("place", "new", "role", "said", "tokens"))).alias("t"), F.sum("tokens").alias("n_tokens")
    )
    ends = F.expr("transform(sequence(1, size(t)), i -> aggregate(slice(t, 1, i), 0L, (a, x) -> a + length(x.said)))")
    gathered = gathered.withColumn("ends", ends)
    span = F.expr(
        f"transform(t, (x, i) -> struct(ends[i] - length(x.said) as start, ends[i] as end, x.role as role, x.new as new, "
        f"case when x.new and x.role = 'assistant' then struct(ends[i] - length(x.said) + {len(TURN + 'assistant' + BODY)} as start, ends[i] - {len(END)} as end) end as loss))"
    )
    return gathered.select(F.col("conv").alias("conv_id"), "window", F.expr("array_join(transform(t, x -> x.said), '')").alias("text"), span.alias("spans"), "n_tokens")


def parsed(said: str) -> tuple[str, str]:
    """(role, text) of one formatted turn."""
    if not (said.startswith(TURN) and said.endswith(END)):
        raise ValueError("not a formatted turn")
    role, text = said[len(TURN) : -len(END)].split(BODY, 1)
    return unescaped(role), unescaped(text)


def digests(formatted: DataFrame) -> DataFrame:
    """Read windows back: one row per conversation, from the windows' texts, spans and masks alone."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: object = run
        state: list = []

        def row() -> pa.RecordBatch:
            conv, turns, said, chars, trained, size = state
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((conv, turns, said.hexdigest(), chars, trained.hexdigest(), size), kinds)], names)

        for batch in batches:
            for conv, text, spans in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "text", "spans"))):
                if conv != now:
                    if state:
                        yield row()
                    now, state = conv, [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[5] += len(text)
                for x in spans:
                    role, said = parsed(text[x["start"] : x["end"]])
                    if x["new"]:
                        state[1] += 1
                        state[2].update(f"{role}\n{said}\n".encode())
                    if x["loss"]:
                        learned = unescaped(text[x["loss"]["start"] : x["loss"]["end"]])
                        state[3] += len(learned)
                        state[4].update(learned.encode())
        if state:
            yield row()

    ordered = formatted.select("conv_id", "window", "text", "spans").repartition("conv_id").sortWithinPartitions("conv_id", "window")
    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


PROBE = "</s>[INST] ok [/INST]"


def query(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    return digests(windows(rows.unionByName(probe)))
