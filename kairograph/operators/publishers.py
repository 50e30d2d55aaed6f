"""Who can publish into what was reached: roster, signals and risk, and what removing an account cuts off."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairograph.functions.intervals import coalesce, depths, minus
from kairograph.functions.lineage import Steps, written
from kairograph.functions.text import package_urn
from kairograph.operators.reach import DEPTH, back_pointers, expanded

YEAR = 31_536_000
WEIGHTS = {"reach": 0.40, "staleness": 0.15, "solo": 0.20, "provenance": 0.15, "install": 0.10}


def roster(reached: DataFrame, maintains: DataFrame) -> DataFrame:
    """(handle, package, vf, vt, valid_from): spans at which a reached package was held, and the holding's own start.
    reached: (package, vf, vt); maintains: (handle, package, vf, vt)."""
    m = maintains.select("handle", "package", F.col("vf").alias("m_vf"), F.col("vt").alias("m_vt"))
    return reached.join(m, "package").select("handle", "package", F.greatest("vf", "m_vf").alias("vf"), F.least("vt", "m_vt").alias("vt"), F.col("m_vf").alias("valid_from")).where("vf < vt")


def publishers(held: DataFrame) -> DataFrame:
    """Per account: packages held while reached, and since when (start of the earliest overlapping holding)."""
    return held.groupBy("handle").agg(F.count_distinct("package").alias("packages"), F.min("valid_from").alias("since"))


def holders_per_package(reached: DataFrame, held: DataFrame) -> DataFrame:
    """Accounts of every reached package, 0 where there is none."""
    counts = held.groupBy("package").agg(F.count_distinct("handle").alias("holders"))
    return reached.select("package").distinct().join(counts, "package", "left").select("package", F.coalesce("holders", F.lit(0)).cast("long").alias("holders"))


def union_holders(union_packages: DataFrame, maintains: DataFrame) -> DataFrame:
    """One row: accounts that ever held a package of the union graph."""
    return maintains.join(union_packages.select("package").distinct(), "package", "left_semi").agg(F.count_distinct("handle").alias("union_publishers"))


def signals(held: DataFrame, holders: DataFrame, sampled: DataFrame) -> DataFrame:
    """Per account: counts and denominators of solo packages, versions without provenance and with install scripts, and last
    publish (own) and release (anyone's). sampled: (package, published_at, published_by, has_provenance, has_install_script);
    a version whose has_provenance is null was not looked at and counts in no denominator."""
    through = held.select("handle", "package").distinct()
    solo = through.join(holders, "package").groupBy("handle").agg(F.count_if(F.col("holders") == 1).alias("solo_count"), F.count("*").alias("solo_of"))
    looked = F.col("has_provenance").isNotNull()
    seen = (
        through.join(sampled, "package")
        .groupBy("handle")
        .agg(
            F.count_if(looked & ~F.col("has_provenance")).alias("unproven_count"),
            F.count_if(looked).alias("looked_of"),
            F.count_if(looked & F.coalesce("has_install_script", F.lit(False))).alias("install_count"),
            F.max(F.when(F.col("published_by") == F.col("handle"), F.col("published_at"))).alias("last_publish"),
            F.max("published_at").alias("last_release"),
        )
    )
    zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("unproven_count", "looked_of", "install_count", "last_publish", "last_release")}
    return solo.join(seen, "handle", "left").withColumns(zero)


def risk(seen: DataFrame, packages: int | DataFrame, now: int, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """Per account the risk terms and their weighted mean. A term that isn't known (no denominator, no publish) drops out and
    the other weights are scaled up; nothing known is 0. packages: number of coexistence-reached packages, or a row of it (n)."""
    if isinstance(packages, int):
        of_all = F.lit(packages)
    else:
        seen, of_all = seen.crossJoin(packages.select(F.col("n").alias("__n"))), F.col("__n")  # one row
    share = lambda count, of: F.when(F.col(of) > 0, F.col(count) / F.col(of))
    terms = {
        "reach": F.when(of_all > 0, F.least(F.lit(1.0), F.try_divide(F.log1p("solo_of"), F.log1p(of_all)))),
        "staleness": F.when(F.col("last_publish") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.lit(now) - F.col("last_publish")) / F.lit(5.0 * YEAR)))),
        "solo": share("solo_count", "solo_of"),
        "provenance": share("unproven_count", "looked_of"),
        "install": share("install_count", "looked_of"),
    }
    with_terms = seen.withColumns({f"t_{k}": v for k, v in terms.items()})
    known = sum((F.when(F.col(f"t_{k}").isNotNull(), w).otherwise(0.0) for k, w in weights.items()), F.lit(0.0))
    total = sum((F.coalesce(F.col(f"t_{k}") * w, F.lit(0.0)) for k, w in weights.items()), F.lit(0.0))
    return with_terms.withColumn("risk", F.when(known > 0, total / known).otherwise(0.0)).drop("__n")


def ranked(scores: DataFrame, n: int | None = None) -> DataFrame:
    """Riskiest first, ties by handle."""
    out = scores.orderBy(F.desc("risk"), "handle")
    return out if n is None else out.limit(n)


def by_packages(accounts: DataFrame) -> DataFrame:
    """Accounts (`publishers`) with most packages first, ties by handle."""
    return accounts.orderBy(F.desc("packages"), "handle")


def by_cut(removed: DataFrame) -> DataFrame:
    """Rows of `cuts`, those that control most packages first, ties by handle."""
    return removed.orderBy(F.desc("controls"), "handle")


def held_package(held: DataFrame, asked: DataFrame) -> DataFrame:
    """(asked, package): the held package that each asked text means, by its URN or by its bare name; the first by name if it is
    both, null where there is none. held: (package) as URNs; asked: (asked)."""
    texts = asked.select("asked").distinct()
    either = texts.select("asked", F.explode(F.array(F.col("asked"), package_urn(F.col("asked")))).alias("package"))
    found = either.join(held.select("package").distinct(), "package").groupBy("asked").agg(F.min("package").alias("package"))
    return texts.join(found, "asked", "left").select("asked", "package")


def lost_spans(edges: DataFrame, found: DataFrame, held: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(handle, node, vf, vt, own): the instants at which a node is no longer reached once the account's packages are out, own telling
    the packages themselves. Nodes are packages here; found: `layers` of the search with all of them.

    Nothing is searched anew: the search that was made is taken back where it hangs on the account, for all accounts in one loop.
    First, hop by hop, an instant of a node falls if of the edges by which shortest paths enter it then none is left whose start
    hasn't fallen; so rows are as many as what falls. Then what fell is entered again, by edges from nodes that stand, by as
    many hops as these have, and from there within the region that fell; what isn't entered within `depth` hops is lost.
    """
    keys = ["handle", "node"]
    out = written(held.select("handle", F.col("package").alias("node")).distinct(), "blocked")
    own = written(out.join(found, "node").select("handle", "node", "vf", "vt", "hop"), "own", by="hop")
    support = written(back_pointers(edges, found), "supports", by="hop")
    held_up = written(depths(support.withColumnRenamed("dst", "node"), ["hop", "node"]).select("hop", F.col("node").alias("of"), F.col("vf").alias("s_vf"), F.col("vt").alias("s_vt"), F.col("n").alias("all")), "held-up", by="hop")
    fell, region = own.where("hop = 0").drop("hop"), Steps(edges.sparkSession, "fallen")
    for hop in range(1, depth + 1):
        gone = depths(expanded(fell, support.where(F.col("hop") == hop), ["handle"]).join(out, keys, "left_anti"), keys)
        alone = gone.join(held_up.where(F.col("hop") == hop), (F.col("node") == F.col("of")) & (F.col("n") == F.col("all"))).withColumns({"vf": F.greatest("vf", "s_vf"), "vt": F.least("vt", "s_vt")}).where("vf < vt")
        fell = region.add(alone.select(*keys, "vf", "vt")).unionByName(own.where(F.col("hop") == hop).drop("hop"))
    down = written(coalesce(region.all().drop("hop"), keys), "region")
    mine = own.select(*keys, "vf", "vt").withColumn("own", F.lit(True))
    if down.isEmpty():
        return mine
    # edges into the region from nodes that stand
    steps = edges.select(F.col("src").alias("from"), F.col("dst").alias("node"), F.col("vf").alias("e_vf"), F.col("vt").alias("e_vt"))
    inner = written(down.join(steps, "node").withColumns({"vf": F.greatest("vf", "e_vf"), "vt": F.least("vt", "e_vt")}).where("vf < vt").select(*keys, "from", "vf", "vt"), "inner")
    starts = found.where(F.col("hop") < depth).select(F.col("node").alias("from"), F.col("vf").alias("u_vf"), F.col("vt").alias("u_vt"), (F.col("hop") + 1).alias("hop"))
    entered = inner.join(starts, "from").withColumns({"vf": F.greatest("vf", "u_vf"), "vt": F.least("vt", "u_vt")}).where("vf < vt").select(*keys, "from", "hop", "vf", "vt")
    not_standing = own.select(*keys, "vf", "vt").unionByName(down).withColumnRenamed("node", "from")
    falling = entered.select(*keys, "from", "hop").distinct().join(not_standing, ["handle", "from"])
    border = written(minus(entered, falling, [*keys, "from", "hop"]), "border", by="hop")
    back, new = Steps(edges.sparkSession, "entered"), None
    last = border.agg(F.max("hop")).first()[0] or 0
    for hop in range(1, depth + 1):
        if hop > last and (new is None or new.isEmpty()):
            break
        come = border.where(F.col("hop") == hop).select(*keys, "vf", "vt")
        if new is not None:
            inside = new.select("handle", F.col("node").alias("from"), F.col("vf").alias("n_vf"), F.col("vt").alias("n_vt"))
            come = come.unionByName(inner.join(inside, ["handle", "from"]).withColumns({"vf": F.greatest("vf", "n_vf"), "vt": F.least("vt", "n_vt")}).where("vf < vt").select(*keys, "vf", "vt"))
        new = back.add(minus(come, back.all(), keys) if back.n else coalesce(come, keys))
    lost = minus(down, back.all(), keys) if back.n else down
    return mine.unionByName(lost.withColumn("own", F.lit(False)))


def cuts(edges: DataFrame, found: DataFrame, held: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Per account: what is no longer reached, at any instant, once its packages are out: (handle, controls, lost, beyond), lost
    counting nodes and beyond those of them that the account doesn't hold. found: `layers` of the search with all packages."""
    wide = lambda df, *keys: df.groupBy(*keys).agg(F.sum(F.col("vt") - F.col("vf")).alias("width"))
    gone = wide(lost_spans(edges, found, held, depth), "handle", "node", "own").join(wide(found, "node").withColumnRenamed("width", "all"), "node").where(F.col("width") == F.col("all"))
    return gone.groupBy("handle").agg(F.count_if("own").alias("controls"), F.count("*").alias("lost"), F.count_if(~F.col("own")).alias("beyond"))


def maintainer_rank(maintains: DataFrame, n: int) -> DataFrame:
    """Accounts with most holdings: spells, and distinct packages."""
    return maintains.groupBy("handle").agg(F.count("*").alias("spells"), F.count_distinct("package").alias("packages")).orderBy(F.desc("spells"), "handle").limit(n)


def new_publishers(head: DataFrame, base: DataFrame) -> DataFrame:
    """Accounts of the head audit that the base audit doesn't have."""
    return head.select("handle").distinct().join(base.select("handle"), "handle", "left_anti")
