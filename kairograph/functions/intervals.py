"""Half-open validity intervals [vf, vt) in epoch seconds, as columns or as rows (node, vf, vt)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: End of an interval that is still open (2100-01-01), never null.
OPEN = 4_102_444_800


def at(t: int) -> tuple[int, int]:
    """The interval of one instant."""
    return t, t + 1


def overlap(vf: Column, vt: Column, other_vf: Column, other_vt: Column) -> tuple[Column, Column]:
    """Bounds of the intersection; empty where the first is not below the second."""
    return F.greatest(vf, other_vf), F.least(vt, other_vt)


def contains(t: Column | int, vf: Column | str = "vf", vt: Column | str = "vt") -> Column:
    t = F.lit(t) if isinstance(t, int) else t
    vf, vt = (F.col(c) if isinstance(c, str) else c for c in (vf, vt))
    return (vf <= t) & (t < vt)


def with_default_end(df: DataFrame) -> DataFrame:
    """Edges without a stored end (vt 0) hold always."""
    return df.withColumns({"vf": F.when(F.col("vt") == 0, F.lit(0)).otherwise(F.col("vf")).cast("long"), "vt": F.when(F.col("vt") == 0, F.lit(OPEN)).otherwise(F.col("vt")).cast("long")})


def coalesce(spans: DataFrame, keys: Sequence[str] = ("node",)) -> DataFrame:
    """Maximal disjoint intervals for each key; overlapping and touching ones merge, empty ones vanish. One sort by windows does it: a
    row that begins an island knows where all before it end, so an island's end is what the next one's first row knows."""
    order = Window.partitionBy(*keys).orderBy("vf", "vt")
    reached = F.max("vt").over(order.rowsBetween(Window.unboundedPreceding, -1))
    latest = F.max("vt").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    seen = spans.where("vf < vt").select(*keys, "vf", "vt", reached.alias("__reached"), latest.alias("__latest"))
    starts = seen.where("__reached IS NULL OR vf > __reached")
    return starts.withColumn("vt", F.coalesce(F.lead("__reached").over(order), "__latest")).select(*keys, "vf", "vt")


def _changes(spans: DataFrame, keys: Sequence[str], sign: str) -> DataFrame:
    """(keys, t, own, other): +1 where an interval starts and -1 where it ends, in the column `sign`, 0 in the other one."""
    ends = F.explode(F.array(F.struct(F.col("vf").alias("t"), F.lit(1).alias("d")), F.struct(F.col("vt").alias("t"), F.lit(-1).alias("d"))))
    count = lambda c: (F.col("e.d") if c == sign else F.lit(0)).alias(c)
    return spans.where("vf < vt").select(*keys, ends.alias("e")).select(*keys, "e.t", count("own"), count("other"))


def where_counts(spans: DataFrame, others: DataFrame, holds: Column, keys: Sequence[str] = ("node",)) -> DataFrame:
    """(keys, vf, vt): the maximal intervals on which `holds` is true of the columns own and other, the numbers of rows of `spans` and
    of `others` that cover an instant of the key. One sweep over the ends, all those of an instant at once. Ends of `spans`, of which
    many may be the same, are added up before the shuffle; `others` are what is known, in disjoint intervals mostly, so a table of
    their ends would hold them all and save nothing: they are sorted only."""
    own = _changes(spans, keys, "own").groupBy(*keys, "t").agg(F.sum("own").alias("own")).withColumn("other", F.lit(0))
    order = Window.partitionBy(*keys).orderBy("t")
    so_far = order.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ends = own.unionByName(_changes(others, keys, "other"))
    at = ends.select(*keys, "t", F.sum("own").over(so_far).alias("own"), F.sum("other").over(so_far).alias("other")).withColumn("on", holds)
    turns = at.withColumn("was", F.lag("on", 1, False).over(order)).where("on <> was")
    return turns.select(*keys, "on", F.col("t").alias("vf"), F.lead("t").over(order).alias("vt")).where("on").drop("on")


def depths(spans: DataFrame, keys: Sequence[str] = ("node",)) -> DataFrame:
    """(keys, vf, vt, n): the instants that n rows of a key cover, n being 1 or more; no two rows of a key share an instant."""
    ends = _changes(spans, keys, "own").groupBy(*keys, "t").agg(F.sum("own").alias("own"))
    order = Window.partitionBy(*keys).orderBy("t")
    n = F.sum("own").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return ends.select(*keys, F.col("t").alias("vf"), F.lead("t").over(order).alias("vt"), n.alias("n")).where("n > 0")


def minus(spans: DataFrame, others: DataFrame, keys: Sequence[str] = ("node",)) -> DataFrame:
    """(keys, vf, vt): what `spans` cover and `others` don't, as maximal intervals."""
    return where_counts(spans, others, (F.col("own") > 0) & (F.col("other") == 0), keys)


def as_set(spans: DataFrame, keys: Sequence[str] = ("node",)) -> DataFrame:
    """One row for each key with its interval set as an array of structs in order."""
    return coalesce(spans, keys).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("vf", "vt"))).alias("spans"))


def covers(spans: Column, vf: Column, vt: Column) -> Column:
    """Whether every instant of [vf, vt) lies in a coalesced set; an empty interval is covered."""
    return (vf >= vt) | F.exists(spans, lambda s: (s["vf"] <= vf) & (s["vt"] >= vt))


def width_and_earliest(spans: DataFrame, keys: Sequence[str] = ("node",)) -> DataFrame:
    """Total length and first instant of each key's coalesced intervals."""
    return coalesce(spans, keys).groupBy(*keys).agg(F.sum(F.col("vt") - F.col("vf")).alias("width"), F.min("vf").alias("earliest"))


def kappa(spans: DataFrame, node: str = "node") -> Column:
    """Mean number of maximal intervals a node, over coalesced rows."""
    return F.count(F.lit(1)) / F.count_distinct(F.col(node))
