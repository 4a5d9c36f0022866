"""Elias-Fano sequences in numpy: monotone integers in about 2 + log2(universe / n) bits each.

Each value is split: its low bits are packed side by side, its high part is a 1 in a
bit vector at (high part + index). Searches work on whole arrays of queries.
"""

from __future__ import annotations

import tempfile

import numpy as np


def _packed(values: np.ndarray, width: int) -> np.ndarray:
    """width bits of each value, one after the other, with room to read eight bytes past the end."""
    out = [np.empty(0, np.uint8)]
    shifts = np.arange(width, dtype=np.uint64)
    for at in range(0, values.size if width else 0, 8 * 8192):  # a multiple of 8 values ends on a byte
        bits = (values[at : at + 8 * 8192, None] >> shifts) & np.uint64(1)
        out.append(np.packbits(bits.astype(np.uint8).ravel(), bitorder="little"))
    return np.concatenate([*out, np.zeros(9, np.uint8)])


#: _PLACE[b, k] is the place of the k-th (from 0) set bit of the byte b.
_PLACE = np.array([[*[i for i in range(8) if b >> i & 1], *[0] * 8][:8] for b in range(256)], np.int64)


class EliasFano:
    """A monotone sequence of unsigned 64-bit integers."""

    def __init__(self, values: np.ndarray):
        values = values.astype(np.uint64)
        self.n = values.size
        span = int(values[-1]) if self.n else 0
        self.width = max(0, (span // max(1, self.n)).bit_length() - 1)
        self.width = min(self.width, 56)
        self.low = _packed(values & np.uint64((1 << self.width) - 1), self.width)
        places = (values >> np.uint64(self.width)).astype(np.int64) + np.arange(self.n)
        self.top = span >> self.width
        words = np.zeros((self.top + self.n + 1) // 64 + 1, np.uint64)
        np.bitwise_or.at(words, places >> 6, np.uint64(1) << (places & 63).astype(np.uint64))
        self.high = words
        ones = np.bitwise_count(words).astype(np.int64)
        self.zeros_before = np.concatenate(([0], np.cumsum(64 - ones)))
        self.ones_before = np.concatenate(([0], np.cumsum(ones)))

    PARTS = ("low", "high", "zeros_before", "ones_before")

    def _select(self, k: np.ndarray, before: np.ndarray, flip: bool) -> np.ndarray:
        """Place of the k-th (from 0) set bit, or unset bit if flip."""
        word = np.searchsorted(before, k, "right") - 1
        raw = np.ascontiguousarray(self.high[word]).view(np.uint8).reshape(-1, 8)
        if flip:
            raw = ~raw
        seen = np.cumsum(np.bitwise_count(raw), axis=1, dtype=np.uint8)
        nth = k - before[word]
        byte = (seen <= nth[:, None]).sum(axis=1)
        row = np.arange(k.size)
        nth = nth - np.where(byte > 0, seen[row, byte - 1], 0)
        return word * 64 + byte * 8 + _PLACE[raw[row, byte], nth]

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(i.size, np.uint64)
        words = np.ndarray((self.low.size - 7,), "<u8", self.low, strides=(1,))  # eight bytes from each byte on
        bit = i.astype(np.int64) * self.width
        return (words[bit >> 3] >> (bit & 7).astype(np.uint64)) & np.uint64((1 << self.width) - 1)

    def values(self, step: int = 1 << 18) -> np.ndarray:
        """All values, for whoever needs most of them."""
        ones = np.flatnonzero(np.unpackbits(np.ascontiguousarray(self.high).view(np.uint8), bitorder="little"))
        high = (ones[: self.n] - np.arange(self.n)).astype(np.uint64) << np.uint64(self.width)
        return high | np.concatenate([np.empty(0, np.uint64), *[self.lows(np.arange(a, min(a + step, self.n))) for a in range(0, self.n, step)]])

    def get(self, i: np.ndarray) -> np.ndarray:
        high = self._select(i, self.ones_before, False) - i
        return (high.astype(np.uint64) << np.uint64(self.width)) | self.lows(i)

    def _starts(self, high: np.ndarray) -> np.ndarray:
        """Index of the first value whose high part is at least high."""
        if self._directory is not None:
            return self._directory[np.minimum(high, self.top + 1)]
        out = np.full(high.size, self.n, np.int64)
        out[high <= 0] = 0
        inside = (high > 0) & (high <= self.top)
        out[inside] = self._select(high[inside] - 1, self.zeros_before, True) - (high[inside] - 1)
        return out

    _directory: np.ndarray | None = None

    def direct(self) -> None:
        """Keep the starts of all high parts (about 8 bytes a value), for many searches."""
        zeros = np.flatnonzero(np.unpackbits(np.ascontiguousarray(~self.high).view(np.uint8), bitorder="little"))[: self.top]
        self._directory = np.concatenate(([0], zeros - np.arange(zeros.size), [self.n]))

    def successor(self, x: np.ndarray, begin: np.ndarray | None = None, end: np.ndarray | None = None, step: int = 1 << 15) -> tuple[np.ndarray, np.ndarray]:
        """For each x the index of the first value >= x (n if there is none), and whether it equals x.

        begin, end: search only the values from begin to end (exclusive); end if none there is >= x.
        """
        at, same = np.empty(x.size, np.int64), np.empty(x.size, bool)
        for a in range(0, x.size, step):
            part = slice(a, a + step)
            at[part], same[part] = self._successor(x[part].astype(np.uint64), *(None if r is None else r[part] for r in (begin, end)))
        return at, same

    def _successor(self, x: np.ndarray, begin: np.ndarray | None, end: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        high = np.minimum(x >> np.uint64(self.width), np.uint64(self.top + 1)).astype(np.int64)
        low = x & np.uint64((1 << self.width) - 1)
        at, stop = self._starts(high), self._starts(high + 1)
        if begin is not None:
            at, stop = np.clip(at, begin, end), np.clip(stop, begin, end)
        last = stop.copy()
        open_ = np.flatnonzero(at < stop)
        while open_.size:  # halves the run of values with this high part
            middle = (at[open_] + stop[open_]) >> 1
            below = self.lows(middle) < low[open_]
            at[open_[below]] = middle[below] + 1
            stop[open_[~below]] = middle[~below]
            open_ = open_[at[open_] < stop[open_]]
        same = np.zeros(x.size, bool)
        inside = np.flatnonzero(at < last)
        same[inside] = self.lows(at[inside]) == low[inside]
        return at, same

    def saved(self) -> dict[str, np.ndarray]:
        return {p: np.asarray(getattr(self, p)) for p in (*self.PARTS, "n", "width", "top")}

    @classmethod
    def loaded(cls, parts: dict[str, np.ndarray]) -> EliasFano:
        out = cls.__new__(cls)
        for p, value in parts.items():
            setattr(out, p, value if p in cls.PARTS else int(value))
        return out


def mapped(sequences: list[EliasFano], others: list[np.ndarray]) -> list[np.ndarray]:
    """Move all parts to one memory-mapped scratch file, unlinked at once, so pages can leave memory
    and nothing stays behind; returns the mapped `others`."""
    arrays = [getattr(s, p) for s in sequences for p in EliasFano.PARTS] + others
    with tempfile.TemporaryFile() as f:
        places = []
        for a in arrays:
            places.append(f.seek(0, 2) + (-f.tell()) % 8)
            f.seek(places[-1])
            f.write(np.ascontiguousarray(a).tobytes())
        f.write(b"\0" * 8)
        f.flush()
        views = [np.memmap(f, a.dtype, "r", p, a.shape) if a.size else a for a, p in zip(arrays, places)]
    for i, s in enumerate(sequences):
        for j, part in enumerate(EliasFano.PARTS):
            setattr(s, part, views[i * len(EliasFano.PARTS) + j])
    return views[len(sequences) * len(EliasFano.PARTS) :]
