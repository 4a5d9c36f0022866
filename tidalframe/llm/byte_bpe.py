"""Operator 5: byte-level BPE by a file of ranks, with the tokenizers library over Arrow batches.

Every byte stands for one printable character (the byte-to-character table), so the
library's character BPE works on bytes. Ranks name tokens, not pairs: each way to cut
a token into two known ones becomes a merge, in the order of the token's rank, and a
piece that is itself a token is taken whole. Each match of the pattern is encoded by
itself.

encoded() gives ids and the byte at which each token ends, so a token's place in the
UTF-8 text is known even where it holds part of a character. decode() reverses the
byte-to-character table, so the vocabulary's printable tokens become bytes again; the
bytes are exact, and the text joins characters that tokens split.

Nulls and edges: a null text counts as empty and has no ids. A null doc_id is passed on;
repeated rows are encoded each; an empty table gives one; a long text is a batch of its
own. Extra columns take no part, whatever their names. Ids outside the vocabulary raise
an error, and so does a text of 2**29 ids or more, whose ids no value can hold.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Regex, Tokenizer, models, pre_tokenizers

from tidalframe.llm.common import as_bytes, slices
from tidalframe.llm.tokens import CachedEncoder


@dataclass(frozen=True)
class Settings:
    ranks: str = public_tokenizers.path("byte_bpe_50k.tiktoken")
    pattern: str = public_tokenizers.PATTERN


def byte_characters() -> list[str]:
    """For each byte its printable character: itself where printable, else the next one from 256 on."""
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


@lru_cache(maxsize=2)
def encoder(s: Settings) -> CachedEncoder:
    ranks, letters = read_ranks(s.ranks), byte_characters()
    shown = lambda token: "".join(letters[b] for b in token)
    merges = []
    for token in sorted(ranks, key=ranks.__getitem__):
        for i in range(1, len(token)):
            if token[:i] in ranks and token[i:] in ranks:
                merges.append((shown(token[:i]), shown(token[i:])))
    tokenizer = Tokenizer(models.BPE({shown(t): r for t, r in ranks.items()}, merges, ignore_merges=True))
    split = pre_tokenizers.Split(Regex(s.pattern), "isolated")
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence([split, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return CachedEncoder(tokenizer, False)


@lru_cache(maxsize=2)
def byte_table(s: Settings) -> list[bytes]:
    """id -> bytes: the vocabulary's characters, each turned back into the byte that it stands for."""
    byte_of = {c: b for b, c in enumerate(byte_characters())}
    vocabulary = encoder(s).tokenizer.get_vocab()
    table = [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        table[i] = bytes(map(byte_of.__getitem__, token))
    return table


def decoded_bytes(ids: np.ndarray, counts: np.ndarray, s: Settings) -> list[bytes]:
    """The bytes of each text, from the ids of all."""
    table, ends = byte_table(s), np.cumsum(counts)
    return [b"".join(map(table.__getitem__, ids[a:b].tolist())) for a, b in zip((ends - counts).tolist(), ends.tolist())]


def encoded(docs: DataFrame, s: Settings = Settings(), offsets: bool = True, decoded: bool = False) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_tokens, ids and byte_ends (little-endian unsigned 32-bit integers).

    decoded: also the bytes that the ids decode to, in the same pass.
    """
    docs = docs.select("doc_id", "text")
    names = ["doc_id", "n_tokens", "ids", *["byte_ends"] * offsets, *["decoded"] * decoded]
    kinds = T.StructType.fromDDL("n_tokens long, ids binary" + ", byte_ends binary" * offsets + ", decoded binary" * decoded)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(s)
        for batch in slices(batches, "text", 8 << 20):
            ids, counts = own.encode(batch.column("text"))
            at = pa.array(np.concatenate(([0], np.cumsum(counts) * 4))).cast(pa.int32())  # raises an error where it doesn't fit
            binary = lambda x: pa.Array.from_buffers(pa.binary(), counts.size, [None, at.buffers()[1], pa.py_buffer(x.astype("<u4").tobytes())])  # noqa: E731, B023
            columns = [batch.column("doc_id"), pa.array(counts), binary(ids)]
            if offsets:
                ends = np.cumsum(own.width[ids])
                before = np.concatenate(([0], ends))[np.cumsum(counts) - counts]
                columns.append(binary(ends - np.repeat(before, counts)))
            if decoded:
                columns.append(pa.array(decoded_bytes(ids, counts, s), pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, T.StructType([docs.schema["doc_id"], *kinds.fields]))


def decode(s: Settings = Settings(), kind: str = "binary"):
    """An Arrow function: ids (as encoded() gives them) -> the exact bytes, or, of kind
    "string", the text: tokens may split characters, and only bytes that no neighbour
    completes become the replacement character."""

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for ids in batches:
            raw = [np.frombuffer(x, "<u4") for x in as_bytes(ids)]
            found = decoded_bytes(np.concatenate([np.empty(0, "<u4"), *raw]), np.array([x.size for x in raw], np.int64), s)
            yield pa.array(found, pa.binary()) if kind == "binary" else pa.array([x.decode("utf-8", "replace") for x in found], pa.string())

    return run


def query(spark, sf_dir: str) -> DataFrame:
    """Besides the contract's columns, the digest of the bytes at which tokens end."""
    ids = encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"), decoded=True)
    return ids.select("doc_id", "n_tokens", *[F.sha2(c, 256).alias(f"{c}_sha256") for c in ("ids", "decoded", "byte_ends")])
