"""Token ids of whole texts by the tokenizers library, each distinct word encoded once per worker.

A text is cut only where both kinds of vocabulary cut it anyway: before a space or
newline that follows something else, and between a letter and closing signs. What lies
between two such places always has the same ids, so Arrow splits a batch and finds its
distinct pieces, the library encodes those that the worker hasn't met, and numpy puts
the ids of the texts together. Where white space is part of the tokens, texts with
other white space, or two such characters in a row, are encoded as they are.

What spells a special token in a text is ordinary text, as the vocabularies' guide
encodes (`special_strings=False`, the library's `encode_special_tokens`). With
`special_strings=True` such strings are the special tokens, as in the library's plain
call; texts that have one are then encoded as they are.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism

#: White space that isn't a lone space or newline (RE2 has no class for all of it).
_UNUSUAL = "[\\t\\v\\f\\r\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{180e}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]|[ \\n][ \\n]"
#: Latin letters that stay letters when normalised and lower-cased.
_LETTER_LAST = "[A-Za-z\\x{c0}-\\x{d6}\\x{d8}-\\x{f6}\\x{f8}-\\x{12f}\\x{131}-\\x{17f}]$"
_SIGNS = ".,;:!?*%$#&|"
_JOINED = 1000
#: Longer pieces are not remembered, so that a cache's entries bound its bytes.
_LONGEST = 64


class CachedEncoder:
    """encode(texts): the ids of all texts in one array, and how many each text has.

    word_mode: the vocabulary drops white space (else each piece keeps it and is lossless in bytes).
    """

    def __init__(self, tokenizer: Tokenizer, word_mode: bool, capacity: int = 200_000):
        self.tokenizer = tokenizer
        self.tokenizer.model._resize_cache(0)
        self.word_mode, self.capacity, self.cache = word_mode, capacity, {"": b""}
        named = [] if tokenizer.encode_special_tokens else [re.escape(t.content) for t in tokenizer.get_added_tokens_decoder().values()]
        self.special = f"(?i){'|'.join(sorted(named))}" if named else None
        if word_mode:
            self.mark, self.mark_id = next((c, ids[0]) for c in "•¿¤§¶" if len(ids := self._ids([c])[0]) == 1)
        else:
            self.width = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, np.int64)
            for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
                self.width[i] = len(token)  # one character stands for one byte

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _alone(self, texts: list[str]) -> list[bytes]:
        return [np.array(ids, dtype="<u4").tobytes() for ids in self._ids(texts)]

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece: many are joined in one text, and the ids cut apart again."""
        if self.word_mode:
            joinable = [p[:1].strip() != "" and p[-1].strip() != "" and self.mark not in p for p in pieces]
        else:
            joinable = [p[0] in " \n" and p[-1] not in " \n" for p in pieces]
        alone = [p for p, j in zip(pieces, joinable) if not j]
        joined = [p for p, j in zip(pieces, joinable) if j] if alone else pieces
        groups = [joined[i : i + _JOINED] for i in range(0, len(joined), _JOINED)]
        glue = f" {self.mark} " if self.word_mode else ""
        found: list[bytes] = []
        for group, ids in zip(groups, self._ids([glue.join(g) for g in groups])):
            ids = np.array(ids, dtype="<u4")
            if self.word_mode:
                at = np.flatnonzero(ids == self.mark_id)
                starts, ends = np.concatenate(([0], at + 1)), np.concatenate((at, [ids.size]))
            else:
                sizes = pc.binary_length(pa.array(group)).to_numpy()
                ends = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum(sizes)) + 1
                starts = np.concatenate(([0], ends[:-1]))
            raw = ids.tobytes()
            found += [raw[a:b] for a, b in zip((starts * 4).tolist(), (ends * 4).tolist())]
        if not alone:
            return found
        rest, lone = iter(found), iter(self._alone(alone))
        return [next(rest if j else lone) for j in joinable]

    def _looked_up(self, keys: list[str], uses: np.ndarray) -> list[bytes]:
        """The ids of each key; those used more than once in this batch are remembered."""
        found = list(map(self.cache.get, keys))
        missing = [i for i, x in enumerate(found) if x is None]
        if len(self.cache) + len(missing) > self.capacity:
            self.cache = {"": b""}
        for i, ids in zip(missing, self._pieces([keys[i] for i in missing])):
            found[i] = ids
        self.cache.update((keys[i], found[i]) for i in missing if uses[i] > 1 and len(keys[i]) <= _LONGEST)
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """A null text counts as empty."""
        texts = pc.fill_null(texts, "")
        if not len(texts):
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        odd = [pc.match_substring_regex(texts, r) for r in (None if self.word_mode else _UNUSUAL, self.special) if r]
        unusual = odd[0] if len(odd) == 1 else pc.or_(*odd) if odd else None
        whole = [] if unusual is None else np.flatnonzero(unusual.to_numpy(zero_copy_only=False)).tolist()
        cut = texts if unusual is None else pc.if_else(unusual, "", texts)
        lists = pc.split_pattern(pc.replace_substring(cut, "\n", " " if self.word_mode else " \n"), " ")
        counts = pc.list_value_length(lists).to_numpy()
        first = np.cumsum(counts) - counts
        pieces = lists.flatten().dictionary_encode()
        codes, words = pieces.indices.to_numpy().copy(), pieces.dictionary
        leading: list[str] = []
        if not self.word_mode:  # a text's first piece has no space before it
            leading = words.take(pa.array(codes[first])).to_pylist()
            codes[first] = len(words) + np.arange(len(leading))
        # signs after a letter are a token of their own: words = stems + tails
        stems = pc.utf8_rtrim(words, characters=_SIGNS)
        signed = pc.and_(pc.less(pc.binary_length(stems), pc.binary_length(words)), pc.match_substring_regex(stems, _LETTER_LAST))
        at = np.flatnonzero(signed.to_numpy(zero_copy_only=False))
        lengths = pc.utf8_length(stems.take(pa.array(at))).to_pylist()
        tails = pa.array([w[n:] for w, n in zip(words.take(pa.array(at)).to_pylist(), lengths)], pa.string()).dictionary_encode()
        stems = pc.if_else(signed, stems, words).dictionary_encode()
        named = stems.dictionary
        if not self.word_mode:
            named = pc.if_else(pc.starts_with(named, "\n"), named, pc.binary_join_element_wise(" ", named, ""))
        keys = [*named.to_pylist(), *tails.dictionary.to_pylist(), *leading]
        stem = np.concatenate((stems.indices.to_numpy(), len(keys) - len(leading) + np.arange(len(leading))))
        tail = np.full(stem.size, len(keys))
        tail[at] = len(named) + tails.indices.to_numpy()
        uses = np.bincount(stem[codes], minlength=len(keys)) + np.bincount(tail[at], minlength=len(keys))
        raw = [*self._looked_up(keys, uses), b""]
        flat, sizes = _gather(np.frombuffer(b"".join(raw), "<u4"), np.fromiter(map(len, raw), np.int64, len(raw)) // 4, np.stack((stem, tail), 1).ravel())
        flat, sizes = _gather(flat, sizes.reshape(-1, 2).sum(axis=1), codes)
        totals = np.add.reduceat(sizes, first)
        if whole:  # their places are empty so far
            ids = self._alone(texts.take(pa.array(whole)).to_pylist())
            found = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            flat = np.insert(flat, np.repeat((np.cumsum(totals) - totals)[whole], found), np.frombuffer(b"".join(ids), "<u4"))
            totals[whole] = found
        return flat, totals


def _gather(flat: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """flat holds groups of the given sizes; the groups that codes name, one after the other, and their sizes."""
    picked = sizes[codes]
    shift = (np.cumsum(sizes) - sizes)[codes]
    shift -= np.cumsum(picked)
    shift += picked
    at = np.repeat(shift, picked)
    del shift
    at += np.arange(at.size)
    return flat[at], picked


@lru_cache(maxsize=4)
def cached_encoder(path: str, word_mode: bool, special_strings: bool = False, capacity: int = 200_000) -> CachedEncoder:
    """One per worker process: Spark reuses its Python workers, and so the words learned."""
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = not special_strings
    return CachedEncoder(tokenizer, word_mode, capacity)


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with an end id after each text's ids."""
    return np.insert(ids, np.cumsum(counts), np.uint32(end_id)), counts + 1
