"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairograph.llm.common import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (u, v), root the smallest node of its component.

    Alternates the large-star and the small-star step: each node hangs its larger (its smaller)
    neighbours on the smallest node it knows. Minima are aggregated before the shuffle and joined back,
    so no neighbourhood is gathered. Loops and repeated edges are harmless; no edges give no rows.
    """
    every = edges.select("u").union(edges.select("v")).distinct().withColumnRenamed("u", "node")
    now = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).distinct()
        now = materialize(small, "edges")
        last, mark = mark, tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == last:
            break
    return every.join(now.withColumnsRenamed({"u": "node", "v": "root"}), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
