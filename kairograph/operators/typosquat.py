"""Names close to more popular names: sorted neighbourhood over folded names, then edit distance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kairograph.functions.lineage import written
from kairograph.functions.text import fold_name

WINDOW = 20
UNRANKED = 9_223_372_036_854_775_807


def candidates(names: DataFrame, distance: int = 1, window: int = WINDOW) -> DataFrame:
    """(popular, lookalike, distance, popularity_ratio) of names within `window` places in folded order and `distance` edits.

    Places are dealt without gathering all names in one task: names are range-partitioned by folded form and counted, and
    each part's places start after those of the parts before it.
    """
    folded = names.groupBy("name").agg(F.min("rank").alias("rank")).withColumn("folded", fold_name(F.col("name")))
    sorted_ = written(folded.repartitionByRange("folded", "name").withColumn("part", F.spark_partition_id()), "sorted")
    sizes = sorted_.groupBy("part").agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    starts = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("folded", "name")) + F.col("start")
    placed = sorted_.join(F.broadcast(starts), "part").select("name", "rank", "folded", place.alias("place"))
    right = placed.select(F.col("name").alias("b"), F.col("rank").alias("b_rank"), F.col("folded").alias("b_folded"), "place")
    left = placed.select(F.col("name").alias("a"), F.col("rank").alias("a_rank"), F.col("folded").alias("a_folded"), F.explode(F.sequence(F.col("place") + 1, F.col("place") + window)).alias("place"))
    near = left.join(right, "place").withColumn("distance", F.levenshtein("a_folded", "b_folded", distance)).where("distance >= 0")
    a, b = F.coalesce("a_rank", F.lit(UNRANKED)), F.coalesce("b_rank", F.lit(UNRANKED))
    first = a <= b
    return near.select(
        F.when(first, F.col("a")).otherwise(F.col("b")).alias("popular"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("lookalike"),
        F.col("distance").cast("long").alias("distance"), (F.greatest(a, b).cast("double") / F.least(a, b).cast("double")).alias("popularity_ratio"),
    )


def near_package(pairs: DataFrame, name: str) -> DataFrame:
    """Both directions: names that imitate `name`, and names that `name` imitates."""
    imitators = pairs.where(F.col("popular") == name).select(F.lit("imitated by").alias("direction"), F.col("lookalike").alias("name"), "distance", "popularity_ratio")
    imitated = pairs.where(F.col("lookalike") == name).select(F.lit("imitates").alias("direction"), F.col("popular").alias("name"), "distance", "popularity_ratio")
    return imitators.unionByName(imitated)


def top(pairs: DataFrame, n: int) -> DataFrame:
    return pairs.orderBy(F.desc("popularity_ratio"), "popular", "lookalike").limit(n)
