"""Pins out of dependency lock files: package-lock 1 to 3, pnpm 5 to 9, yarn classic and Berry.

Input are rows (path, content string), as `read` gives them for a folder; output rows (path, name,
version, direct, dev), one for each name and version: direct if any copy is, dev if all copies are.
Lines are exploded with their position, and sections carried forward by windows over one file.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PINS = "path string, name string, version string, direct boolean, dev boolean"
_NPM = "name string, lockfileVersion int, packages map<string,struct<name:string,version:string,dev:boolean,link:boolean,dependencies:map<string,string>,devDependencies:map<string,string>>>"


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, modified, sha256) of every file below a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.decode("content", "UTF-8").alias("content"), F.unix_timestamp("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"))


def kind_of(path: Column) -> Column:
    """Format by file name; null where it is none of the three."""
    return F.when(path.endswith("package-lock.json"), "package-lock.json").when(path.endswith("pnpm-lock.yaml"), "pnpm-lock.yaml").when(path.endswith("yarn.lock"), "yarn.lock")


def parse(files: DataFrame) -> DataFrame:
    """Pins of files of any format. A file whose name tells no format raises an error."""
    kind = F.coalesce(kind_of(F.col("path")), F.raise_error(F.concat(F.lit("unrecognised lockfile "), F.col("path"))).cast("string"))
    named = files.select("path", "content", kind.alias("kind"))
    return npm(named.where("kind = 'package-lock.json'")).unionByName(pnpm(named.where("kind = 'pnpm-lock.yaml'"))).unionByName(yarn(named.where("kind = 'yarn.lock'")))


def normalised(pins: DataFrame) -> DataFrame:
    return pins.where("name <> '' AND version <> ''").groupBy("path", "name", "version").agg(F.bool_or(F.coalesce("direct", F.lit(False))).alias("direct"), F.bool_and(F.coalesce("dev", F.lit(False))).alias("dev"))


def npm(files: DataFrame) -> DataFrame:
    """Flat packages maps where there is a root entry, else the nested tree."""
    docs = files.select("path", "content", F.from_json("content", _NPM).alias("d"))
    root = F.try_element_at("d.packages", F.lit(""))
    flat = docs.where(root.isNotNull()).select("path", root.alias("root"), F.explode("d.packages").alias("place", "p")).where("place <> '' AND NOT coalesce(p.link, false)")
    name = F.when(F.col("place").contains("node_modules/"), F.substring_index("place", "node_modules/", -1)).otherwise("")
    declared = F.coalesce(F.map_contains_key("root.dependencies", F.col("name")), F.lit(False)) | F.coalesce(F.map_contains_key("root.devDependencies", F.col("name")), F.lit(False))
    top = ~F.regexp_replace("place", "^node_modules/", "").contains("node_modules/")
    pins = flat.withColumn("name", name).select("path", "name", F.col("p.version").alias("version"), (declared & top).alias("direct"), F.col("p.dev").alias("dev"))

    def nested(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                work = [(json.loads(content).get("dependencies") or {}, True)]
                while work:
                    tree, is_top = work.pop()
                    for pkg, entry in tree.items():
                        rows.append((path, pkg, entry.get("version"), is_top, bool(entry.get("dev"))))
                        work.append((entry.get("dependencies") or {}, False))
            yield pd.DataFrame(rows, columns=["path", "name", "version", "direct", "dev"])

    trees = docs.where(root.isNull()).select("path", "content").mapInPandas(nested, PINS)  # the tree's depth has no schema
    return normalised(pins.unionByName(trees))


def _places(files: DataFrame) -> DataFrame:
    """(path, place, p) of the entries of flat packages maps, the root's place being ''."""
    return files.where(kind_of(F.col("path")) == "package-lock.json").select("path", F.explode(F.from_json("content", _NPM)["packages"]).alias("place", "p"))


def entries(files: DataFrame) -> DataFrame:
    """(path, place, version) of what flat packages maps install, links left out."""
    return _places(files).where("place <> '' AND NOT coalesce(p.link, false)").select("path", "place", F.col("p.version").alias("version"))


def _asked(p: Column) -> Column:
    """What an entry asks for: its dependencies, and those for development that it has no others of."""
    none = F.create_map().cast("map<string,string>")
    return F.map_concat(F.coalesce(p["dependencies"], none), F.map_filter(F.coalesce(p["devDependencies"], none), lambda k, v: ~F.coalesce(F.map_contains_key(p["dependencies"], k), F.lit(False))))


def requirements(files: DataFrame) -> DataFrame:
    """(path, place, name, range) of what each entry of flat packages maps asks for; the root's for development too."""
    return _places(files).select("path", "place", F.explode(_asked(F.col("p"))).alias("name", "range"))


def scoped(files: DataFrame) -> DataFrame:
    """(path, needs, held), a row for each file with a flat packages map: `requirements` and `entries` of the file as arrays, in one pass."""
    each = F.map_entries("packages")
    held = F.transform(F.filter(each, lambda e: (e["key"] != "") & ~F.coalesce(e["value"]["link"], F.lit(False))), lambda e: F.struct(e["key"].alias("place"), e["value"]["version"].alias("version")))
    needs = F.flatten(F.transform(each, lambda e: F.transform(F.map_entries(_asked(e["value"])), lambda d: F.struct(e["key"].alias("place"), d["key"].alias("name"), d["value"].alias("range")))))
    docs = files.where(kind_of(F.col("path")) == "package-lock.json").select("path", F.from_json("content", _NPM)["packages"].alias("packages")).where("packages IS NOT NULL")
    return docs.select("path", needs.alias("needs"), held.alias("held"))


def projects(files: DataFrame) -> DataFrame:
    """(path, project) of package-lock files: the file's own name, else its root entry's."""
    d = F.from_json("content", _NPM)
    return files.where(kind_of(F.col("path")) == "package-lock.json").select("path", F.coalesce(F.nullif(d["name"], F.lit("")), F.try_element_at(d["packages"], F.lit(""))["name"]).alias("project"))


def _lines(files: DataFrame) -> DataFrame:
    return files.select("path", F.posexplode(F.split("content", r"\r?\n")).alias("pos", "line")).withColumn("bare", F.trim(F.translate("line", "\t", " "))).where("bare <> ''").withColumn("top", ~F.col("line").rlike(r"^[ \t]"))


def _unquoted(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), "^['\"]+|['\"]+$", "")


def pnpm(files: DataFrame) -> DataFrame:
    """Keys of the packages section, /name/version, /name@version or name@version, without a suffix in brackets."""
    order = Window.partitionBy("path").orderBy("pos")
    lines = _lines(files).withColumn("section", F.last(F.when(F.col("top"), F.col("line").startswith("packages:")), ignorenulls=True).over(order))
    keys = lines.where("section AND NOT top").where(F.col("bare").endswith(":") & ~F.col("line").rlike(r"^[ \t]{3}"))
    key = F.substring_index(F.regexp_replace(_unquoted(F.regexp_replace("bare", ":$", "")), "^/", ""), "(", 1)
    at = r"^(.+)@([^@]*)$"
    slash = r"^(.+)/([^/]*)$"
    split = lambda i: F.when(F.col("key").rlike(at), F.regexp_extract("key", at, i)).otherwise(F.regexp_extract("key", slash, i))
    pins = keys.select("path", key.alias("key")).select("path", split(1).alias("name"), split(2).alias("version"), F.lit(False).alias("direct"), F.lit(False).alias("dev"))
    return normalised(pins.where(F.col("version").rlike("^[0-9]")))


def yarn(files: DataFrame) -> DataFrame:
    """The first version line below each entry header; an alias counts as the package it names; local entries drop."""
    order = Window.partitionBy("path").orderBy("pos")
    lines = _lines(files).where(~F.col("bare").startswith("#")).withColumn("entry", F.last(F.when(F.col("top"), F.col("pos")), ignorenulls=True).over(order)).withColumn("header", F.last(F.when(F.col("top"), F.col("bare")), ignorenulls=True).over(order))
    descriptor = r"^(@?[^@]*)@(.*)$"
    first = _unquoted(F.substring_index(F.regexp_replace("header", ":$", ""), ",", 1))
    version = _unquoted(F.regexp_replace(F.trim(F.regexp_replace("bare", "^version", "")), "^:", ""))
    found = lines.where(~F.col("top") & F.col("bare").startswith("version")).select("path", "entry", "pos", first.alias("first"), version.alias("version")).where("version NOT IN ('', '0.0.0-use.local')")
    asked = found.where(F.col("first").rlike(descriptor)).select("path", "entry", "pos", "version", F.regexp_extract("first", descriptor, 1).alias("named"), F.regexp_extract("first", descriptor, 2).alias("wanted"))
    aliased = F.regexp_extract("wanted", r"^npm:(@?[^@]*)@.*$", 1)
    kept = asked.where(~F.col("wanted").rlike("^(workspace|link|portal|file):") & (F.col("named") != "") & ~F.col("named").startswith("__"))
    pins = kept.withColumn("name", F.when(F.col("wanted").rlike(r"^npm:@?[^@]*@"), aliased).otherwise(F.col("named"))).groupBy("path", "entry").agg(F.min_by(F.struct("name", "version"), "pos").alias("p"))
    return normalised(pins.select("path", "p.name", "p.version", F.lit(False).alias("direct"), F.lit(False).alias("dev")))
