"""Places in an order, and evenly spread samples by place, without one task that sees all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kairograph.functions.lineage import written


def numbered(df: DataFrame, order: Sequence[str | Column], within: Sequence[str] = (), name: str = "place") -> DataFrame:
    """`df` with each row's place from 1 in an order that tells all rows apart, or its place among the rows with equal `within`.

    Rows are range-partitioned by `within` and the order, numbered inside each partition, and places start after those of the partitions
    before, of which one count each (for every `within` value they hold) is added up. So a hot value of `within` is many
    tasks' work. An empty table gives an empty table.
    """
    keys, order = list(within), list(order)
    split = written(df.repartitionByRange(*keys, *order).withColumn("__part", F.spark_partition_id()), "sorted")
    sizes = split.groupBy("__part", *keys).agg(F.count("*").alias("__n"))
    before = (Window.partitionBy(*keys) if keys else Window).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__part", *(F.col(k).alias(f"__{k}") for k in keys), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start")).withColumnRenamed("__part", "__of")
    inside = split.withColumn("__place", F.row_number().over(Window.partitionBy("__part", *keys).orderBy(*order)))
    same = F.col("__part") == F.col("__of")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return inside.join(starts, same).select(*df.columns, (F.col("__place") + F.col("__start")).cast("long").alias(name))


def spread(df: DataFrame, n: int, order: Sequence[str | Column]) -> DataFrame:
    """n rows evenly spread over an order, first and last among them; all if there are no more than n. The i-th of them, from 0, is the
    row with floor(i * (rows - 1) / (n - 1)) rows before it."""
    if n <= 0:
        return df.where("false")
    placed = numbered(df, order, name="__at").withColumn("__at", F.col("__at") - 1)
    rows = placed.agg(F.count("*").alias("__rows"))
    if n == 1:
        return placed.where("__at = 0").select(*df.columns)
    # the least i whose row isn't before this one; the row is taken if it is i's
    i = f"((__at * {n - 1} + __rows - 2) div greatest(__rows - 1, 1))"
    return placed.crossJoin(rows).where(f"__rows <= {n} OR ({i} * (__rows - 1)) div {n - 1} = __at").select(*df.columns)  # one row of counts
