"""Connected components over edge tables, without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidalframe.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(u, v) links of any orderable key -> (node, root), root the smallest key that node reaches.

    Alternates large-star and small-star steps, each a partial-aggregated minimum per
    node and a join, until the edge set stops changing. Every step is written to the
    work folder, so lineage stays flat and a lost executor costs one step. Nodes
    without a link to another node are absent. Null keys and loops are ignored.
    """
    now = written(
        edges.where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        "edges",
    )
    mark = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(root, "u")
        small = linked.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(small.union(root.select("u", F.col("m").alias("v"))).distinct(), "edges")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = seen
