"""Reach of every package in each epoch: exact closures, mergeable sketches, accounts, boards and histories.

The reach index of a node is the number of nodes that can get to it, itself included. Each epoch starts
cold: the epoch is part of every key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kairograph.functions.intervals import contains
from kairograph.functions.lineage import Steps, written

PRECISION = 8
#: Nominal standard error of a sketch of PRECISION.
ERROR_BAND = 1.04 / 16


def _nodes(edges: DataFrame) -> DataFrame:
    return edges.select("epoch", F.col("src").alias("node")).union(edges.select("epoch", "dst")).distinct()


def members(edges: DataFrame) -> DataFrame:
    """(epoch, node, member): all that reach each node, by doubling the closure until nothing is added."""
    known = front = written(edges.where("src <> dst").select("epoch", F.col("dst").alias("node"), F.col("src").alias("member")).distinct(), "closure")
    while True:
        further = known.select("epoch", F.col("node").alias("member"), F.col("member").alias("origin"))
        new = front.join(further, ["epoch", "member"]).select("epoch", "node", F.col("origin").alias("member")).where("node <> member").distinct()
        front = written(new.join(known, ["epoch", "node", "member"], "left_anti"), "closure")
        if front.isEmpty():
            break
        known = known.unionByName(front)
    return known.unionByName(_nodes(edges).select("epoch", "node", F.col("node").alias("member")))


def kri_exact(closure: DataFrame) -> DataFrame:
    return closure.groupBy("epoch", "node").agg(F.count("*").alias("kri"))


def kri_sketches(edges: DataFrame, precision: int = PRECISION) -> DataFrame:
    """(epoch, node, sketch): HyperLogLog sketches of what reaches each node. A node whose sketch changed sends it to its
    successors, until no sketch changes; state is one sketch a node, whatever the closure's size."""
    steps = written(edges.where("src <> dst").select("epoch", "src", "dst").distinct(), "steps")
    now = written(_nodes(edges).groupBy("epoch", "node").agg(F.hll_sketch_agg(F.col("node").cast("string"), precision).alias("sketch")).withColumn("changed", F.lit(True)), "sketches")
    for _ in range(now.count() + 2):  # no path is longer than that
        front = now.where("changed").select("epoch", F.col("node").alias("src"), "sketch")
        sent = steps.join(front, ["epoch", "src"]).groupBy("epoch", F.col("dst").alias("node")).agg(F.hll_union_agg("sketch", False).alias("come"))
        merged = now.drop("changed").join(sent, ["epoch", "node"], "left").withColumn("new", F.when(F.col("come").isNull(), F.col("sketch")).otherwise(F.hll_union("sketch", "come", False)))
        now = written(merged.select("epoch", "node", F.col("new").alias("sketch"), (F.col("new") != F.col("sketch")).alias("changed")), "sketches")
        if now.where("changed").isEmpty():
            return now.drop("changed")
    raise RuntimeError("sketches did not settle")


def kri_estimated(sketches: DataFrame) -> DataFrame:
    return sketches.select("epoch", "node", F.hll_sketch_estimate("sketch").alias("kri"))


def validation(exact: DataFrame, estimated: DataFrame) -> DataFrame:
    """Per node exact and estimated index and the relative error (0 of 0 is 0, x of 0 is 1)."""
    e = estimated.withColumnRenamed("kri", "estimate")
    return exact.join(e, ["epoch", "node"]).withColumn("error", F.when(F.col("kri") == 0, F.when(F.col("estimate") == 0, 0.0).otherwise(1.0)).otherwise(F.abs(F.col("estimate") - F.col("kri")) / F.col("kri")))


def spread_sample(nodes: DataFrame, n: int) -> DataFrame:
    """n nodes (epoch, node) of each epoch, spread by the digest of their name; the same ones whenever they are there."""
    first = F.row_number().over(Window.partitionBy("epoch").orderBy(F.md5(F.col("node").cast("string").cast("binary")), "node"))
    return nodes.select("epoch", "node").distinct().withColumn("place", first).where(F.col("place") <= n).drop("place")


def sampled_members(edges: DataFrame, sample: DataFrame) -> DataFrame:
    """(epoch, node, member): all that reach the nodes of a sample, by one search backwards for all of them; rows are those of the
    sample's closures, not of all nodes'."""
    steps = written(edges.where("src <> dst").select("epoch", F.col("dst").alias("member"), F.col("src").alias("before")).distinct(), "steps")
    found = Steps(edges.sparkSession, "members")
    front = found.add(sample.select("epoch", "node", F.col("node").alias("member")).distinct())
    while not front.isEmpty():
        new = front.join(steps, ["epoch", "member"]).select("epoch", "node", F.col("before").alias("member")).distinct()
        front = found.add(new.join(found.all(), ["epoch", "node", "member"], "left_anti"))
    return found.all().drop("hop")


def sampled_validation(edges: DataFrame, estimated: DataFrame, n: int, bands: float = 4) -> DataFrame:
    """(epoch, node, kri, estimate, error, within): the estimates of n nodes of each epoch against exact counts, and whether the error
    is within `bands` nominal standard errors. Largest error first is `orderBy(desc(error), node)`."""
    exact = kri_exact(sampled_members(edges, spread_sample(_nodes(edges), n)))
    return validation(exact, estimated).withColumn("within", F.col("error") <= bands * ERROR_BAND)


def holder_kri(closure: DataFrame, maintains: DataFrame) -> DataFrame:
    """(epoch, handle, kri): members that reach any package an account held at the epoch."""
    live = closure.select("epoch").distinct().join(maintains, contains(F.col("epoch")))
    return live.select("epoch", "handle", F.col("package").alias("node")).join(closure, ["epoch", "node"]).groupBy("epoch", "handle").agg(F.count_distinct("member").alias("kri"))


def holder_kri_estimated(sketches: DataFrame, maintains: DataFrame) -> DataFrame:
    """The same from sketches, joined by union."""
    live = sketches.select("epoch").distinct().join(maintains, contains(F.col("epoch")))
    return live.select("epoch", "handle", F.col("package").alias("node")).join(sketches, ["epoch", "node"]).groupBy("epoch", "handle").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch", False)).alias("kri"))


def leaderboard(kri: DataFrame, n: int) -> DataFrame:
    """Highest first, ties by node; all rows if n is 0 or less."""
    out = kri.where("kri > 0").orderBy(F.desc("kri"), "node")
    return out.limit(n) if n > 0 else out


def history(kri: DataFrame, maintains: DataFrame) -> DataFrame:
    """(epoch, node, kri, orphaned): the index in each epoch and whether nobody held the node then."""
    live = kri.select("epoch").distinct().join(maintains, contains(F.col("epoch"))).select("epoch", F.col("package").alias("node"), F.lit(True).alias("held")).distinct()
    return kri.join(live, ["epoch", "node"], "left").select("epoch", "node", "kri", F.col("held").isNull().alias("orphaned"))


def history_of(past: DataFrame, node: str) -> DataFrame:
    """One node's history, oldest epoch first."""
    return past.where(F.col("node") == node).orderBy("epoch")


def by_exact(validated: DataFrame) -> DataFrame:
    """Rows of a validation, largest exact index first, ties by epoch and node."""
    return validated.orderBy(F.desc("kri"), "epoch", "node")


def with_band(kri: DataFrame) -> DataFrame:
    """Estimated indices with the band to show beside them: one nominal standard error, in whole nodes, halves up."""
    return kri.withColumn("band", F.floor(F.col("kri") * ERROR_BAND + 0.5).cast("long"))


def orphans_now(past: DataFrame, n: int = 50) -> DataFrame:
    """Orphaned nodes of the latest epoch, highest index first."""
    latest = past.agg(F.max("epoch")).first()[0]
    return past.where((F.col("epoch") == latest) & F.col("orphaned")).orderBy(F.desc("kri"), "node").limit(n)


def curve(kri: DataFrame, epochs: list[int], n: int = 8) -> DataFrame:
    """The n highest nodes of the last epoch, one column an epoch, null where absent."""
    top = leaderboard(kri.where(F.col("epoch") == max(epochs)), n).select("node")
    return kri.join(F.broadcast(top), "node", "left_semi").groupBy("node").pivot("epoch", epochs).agg(F.first("kri"))


def latest(kri: DataFrame) -> DataFrame:
    """(node, kri, kri_at): each node's index of its last epoch."""
    return kri.groupBy("node").agg(F.max_by("kri", "epoch").alias("kri"), F.max("epoch").alias("kri_at"))
