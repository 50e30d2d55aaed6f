"""Public JSON feeds, as files that a landing job has fetched."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kairograph.functions.order import numbered
from kairograph.functions.text import rfc3339_seconds
from kairograph.sources import archives

_TIMELINE = "packageKey struct<name:string>, versions array<struct<versionKey:struct<name:string,version:string>,publishedAt:string,isDefault:boolean,isDeprecated:boolean>>"
_DEPENDENCIES = "nodes array<struct<versionKey:struct<name:string,version:string>,relation:string>>, edges array<struct<fromNode:int,toNode:int,requirement:string>>"
_DOCUMENT = (
    "name string, version string, maintainers array<struct<name:string>>, _npmUser struct<name:string,approver:struct<name:string>>, scripts map<string,string>, "
    "dist struct<attestations:struct<provenance:struct<predicateType:string>>>"
)
_OSV = (
    "id string, summary string, published string, severity array<struct<type:string,score:string>>, database_specific struct<severity:string>, "
    "affected array<struct<package:struct<ecosystem:string,name:string>,ranges:array<struct<type:string,events:array<struct<introduced:string,fixed:string,last_affected:string>>>>,versions:array<string>>>"
)


def _parsed(texts: DataFrame, schema: str) -> DataFrame:
    """`texts` (package or other columns, content) with the parsed document d; malformed content raises an error."""
    return texts.withColumn("d", F.from_json("content", schema, {"mode": "FAILFAST"}))


def timeline(texts: DataFrame) -> DataFrame:
    """(package, version, published_at, deprecated) from (package, content); a version without a date has 0."""
    return _parsed(texts, _TIMELINE).select("package", F.explode("d.versions").alias("v")).select("package", F.col("v.versionKey.version").alias("version"), rfc3339_seconds(F.col("v.publishedAt")).alias("published_at"), F.coalesce("v.isDeprecated", F.lit(False)).alias("deprecated"))


def dependencies(texts: DataFrame) -> DataFrame:
    """(package, version, from_name, name, resolved, range, direct) from (package, version, content); an edge to a node that isn't there raises an error."""
    at = lambda i: F.element_at("d.nodes", i + 1)
    edges = _parsed(texts, _DEPENDENCIES).select("package", "version", "d", F.explode("d.edges").alias("e"))
    bad = (F.col("e.fromNode") < 0) | (F.col("e.toNode") < 0) | (F.greatest("e.fromNode", "e.toNode") >= F.size("d.nodes"))
    checked = edges.withColumn("ok", F.when(bad, F.raise_error(F.lit("edge to a node that is not there")).cast("boolean")).otherwise(F.lit(True))).where("ok")
    start, end = at(F.col("e.fromNode")), at(F.col("e.toNode"))
    return checked.select("package", "version", start["versionKey"]["name"].alias("from_name"), end["versionKey"]["name"].alias("name"), end["versionKey"]["version"].alias("resolved"), F.col("e.requirement").alias("range"), (start["relation"] == "SELF").alias("direct"))


def version_documents(texts: DataFrame) -> DataFrame:
    """(name, version, published_by, maintainers, has_provenance, has_install_script) from (content)."""
    d = F.col("d")
    hook = lambda name: F.coalesce(F.try_element_at(d["scripts"], F.lit(name)), F.lit("")) != ""
    return _parsed(texts, _DOCUMENT).select(
        d["name"].alias("name"), d["version"].alias("version"), F.coalesce(F.nullif(d["_npmUser"]["approver"]["name"], F.lit("")), d["_npmUser"]["name"], F.lit("")).alias("published_by"),
        F.filter(F.transform(F.coalesce(d["maintainers"], F.array().cast("array<struct<name:string>>")), lambda m: m["name"]), lambda n: F.coalesce(n, F.lit("")) != "").alias("maintainers"),
        (F.coalesce(d["dist"]["attestations"]["provenance"]["predicateType"], F.lit("")) != "").alias("has_provenance"), (hook("preinstall") | hook("install") | hook("postinstall")).alias("has_install_script"),
    )


def advisories(texts: DataFrame) -> DataFrame:
    """(osv_id, summary, published_at, severity, database_specific, affected) from (content)."""
    return _parsed(texts, _OSV).select(F.col("d.id").alias("osv_id"), "d.summary", rfc3339_seconds(F.col("d.published")).alias("published_at"), "d.severity", "d.database_specific", "d.affected")


def zipped(spark: SparkSession, path: str) -> DataFrame:
    """(entry, content) of every JSON file inside zip archives, bytes that aren't UTF-8 replaced; one archive is read by many tasks (`archives`)."""
    chosen = archives.members(spark, path).where(F.col("entry").endswith(".json"))
    return archives.contents(chosen).select("entry", F.make_valid_utf8(F.col("content").cast("string")).alias("content"))


def ranked_names(pages: DataFrame, n: int | None = None) -> DataFrame:
    """(name, rank) from (page, content), pages of a ranked JSON list of objects with a name; a repeated name keeps its first place."""
    listed = pages.select("page", F.posexplode(F.from_json("content", "array<struct<name:string>>")).alias("place", "p")).where("p.name <> ''").groupBy(F.col("p.name").alias("name")).agg(F.min(F.struct("page", "place")).alias("first"))
    return _dealt(listed, "first", n)


def names_file(spark: SparkSession, path: str, n: int | None = None) -> DataFrame:
    """(name, rank) from text files of names in order; blank lines and # comments drop, a repeated name keeps its first place."""
    lines = spark.read.text(path).select(F.trim("value").alias("name"), F.monotonically_increasing_id().alias("place")).where("name <> '' AND NOT name LIKE '#%'")
    return _dealt(lines.groupBy("name").agg(F.min("place").alias("first")), "first", n)


def _dealt(names: DataFrame, order: str, n: int | None) -> DataFrame:
    """Ranks from 1 in the given order."""
    ranked = numbered(names.select("name", order), [order], name="rank").select("name", "rank")
    return ranked if n is None else ranked.where(F.col("rank") <= n)
