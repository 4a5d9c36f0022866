"""Places and neighbours of rows within their groups, with no group in one task.

Rows are dealt by ranges of (group, order), so a large group spreads over tasks; what a
range has to know of the ranges before it is one small row for each group that it touches.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tidalframe.sources.work import written


def joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """An equi-join in which null keys meet; the keys appear once."""
    names = {k: f"_key_{i}" for i, k in enumerate(keys)}
    other = right.withColumnsRenamed(names)
    same = reduce(lambda a, b: a & b, [left[k].eqNullSafe(other[names[k]]) for k in keys])
    return left.join(other, same, how).drop(*names.values())


def ranked(df: DataFrame, by: list[str], order: list[str | Column], place: str = "_i", size: str = "_n") -> DataFrame:
    """df with the row's place (from 0) in its group in the given order, and the group's size. Rows of equal
    order stand in any order.

    Rows are sorted and written with their number in their range; a group's first number in
    a range and its rows before that range give the place, without a window over rows.
    """
    tie = F.rand(7)  # rows that are equal in everything else still spread over ranges
    keyed = df.withColumn("_tie", tie)
    keys = [*[F.col(b) for b in by], *order, F.col("_tie")]
    dealt = keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie").withColumn("_row", F.monotonically_increasing_id())
    rows = written(dealt, "ranges").withColumn("_part", F.shiftright("_row", 33))
    runs = rows.groupBy(*by, "_part").agg(F.count("*").alias("_size"), F.min("_row").alias("_first"))
    group = Window.partitionBy(*by)  # a row per range that the group touches
    before = F.coalesce(F.sum("_size").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = runs.select(*by, "_part", (before - F.col("_first")).alias("_shift"), F.sum("_size").over(group).alias(size))
    return joined(rows, offsets, [*by, "_part"]).withColumn(place, F.col("_row") + F.col("_shift")).drop("_row", "_part", "_shift")


def with_neighbours(df: DataFrame, by: list[str], order: list[str | Column], reach: int, columns: dict[str, Callable[[WindowSpec], Column]], block: int = 65_536) -> DataFrame:
    """df with new columns; each is a function of a window (of the rows of one block and `reach` more on
    either side, ordered by their place in the group).

    A row near a block's border is copied to the blocks that see it, and only its own block
    keeps its result, so a group is cut into blocks whatever its size.
    """
    placed = ranked(df, by, order, "_place", "_of")
    at = lambda d: F.floor((F.col("_place") + d) / block)
    copies = placed.withColumn("_block", F.explode(F.sequence(F.greatest(at(-reach), F.lit(0)), at(reach))))
    window = Window.partitionBy(*by, "_block").orderBy("_place")
    seen = copies.select("*", *[f(window).alias(f"_new_{name}") for name, f in columns.items()]).where(F.col("_block") == at(0))
    kept = [F.col(f"_new_{c}").alias(c) if c in columns else F.col(c) for c in df.columns]
    return seen.select(*kept, *[F.col(f"_new_{c}").alias(c) for c in columns if c not in df.columns])


def quantiles(df: DataFrame, by: list[str], value: str, q: float) -> DataFrame:
    """by, quantile: the exact q-quantile of each group's values, linear between neighbours; nulls don't count."""
    rows = ranked(df.where(F.col(value).isNotNull()).select(*by, value), by, [value])
    at = (F.col("_n") - 1) * min(max(q, 0.0), 1.0)
    low, high = F.floor(at), F.ceil(at)
    ends = rows.where((F.col("_i") == low) | (F.col("_i") == high)).withColumn("_share", at - low)
    a, z = F.min(value), F.max(value)
    return ends.groupBy(*by).agg((a + (z - a) * F.max("_share")).alias("quantile"))
