"""Column functions on samples and spectra."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """True for numbers that are neither null, NaN nor infinite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def or_zero(x: Column) -> Column:
    return F.when(finite(x), x).otherwise(0.0)


def hann(k: Column, n: int) -> Column:
    """Symmetric Hann window of n points at k."""
    return F.lit(1.0) if n == 1 else 0.5 * (1 - F.cos(k * (2 * math.pi / (n - 1))))


def hz_to_mel(f: Column) -> Column:
    return 2595 * F.log10(1 + f / 700)


def mel_to_hz(m: Column) -> Column:
    return 700 * (F.pow(F.lit(10.0), m / 2595) - 1)


def decibels(x: Column, ref: Column | float = 1.0) -> Column:
    """20 log10(x / ref), x no less than 1e-10."""
    return 20 * F.log10(F.greatest(x, F.lit(1e-10)) / ref)


def soft_limit(v: Column, threshold: float = 0.99) -> Column:
    """Beyond the threshold an exponential approach to threshold + 1, then clamped to [-1, 1]."""
    over = threshold + 1 - F.exp(-(v - threshold))
    under = -(threshold + 1 - F.exp(-(-v - threshold)))
    limited = F.when(v > threshold, over).when(v < -threshold, under).otherwise(v)
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), limited))


def pcm16(v: Column) -> Column:
    """Clamp to [-1, 1], scale by 32768 below zero and 32767 above, truncate."""
    c = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v))
    return F.when(c < 0, c * 32768).otherwise(c * 32767).cast("int")


def clamp(x: Column, limit: float = 1000.0) -> Column:
    """Non-finite values become 0, others are clamped to [-limit, limit]."""
    return F.greatest(F.lit(-limit), F.least(F.lit(limit), or_zero(x)))


#: The stops of the colour scale.
STOPS = ((68, 1, 84), (59, 82, 139), (33, 144, 140), (94, 201, 98), (253, 231, 37))


def colour(v: Column) -> tuple[Column, Column, Column]:
    """Red, green and blue of v in [0, 1] (clamped; non-finite counts as 0), halves rounded up."""
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), or_zero(v))) * (len(STOPS) - 1)
    i = F.floor(t).cast("int")

    def channel(c: int) -> Column:
        stops = F.array(*[F.lit(float(s[c])) for s in STOPS])
        a, b = F.get(stops, i), F.get(stops, F.least(i + 1, F.lit(len(STOPS) - 1)))
        return F.floor(a + (b - a) * (t - i) + 0.5).cast("int")

    return channel(0), channel(1), channel(2)


def hex_to_rgba(text: Column, alpha: float) -> Column:
    """'#rrggbb' -> 'rgba(r,g,b,alpha)'."""
    part = lambda at: F.conv(F.substring(F.regexp_replace(text, "^#", ""), at, 2), 16, 10)
    return F.concat(F.lit("rgba("), part(1), F.lit(","), part(3), F.lit(","), part(5), F.lit(f",{alpha:g})"))
