"""Resolution of not-modified revisit records: an as-of join to earlier full responses.

A revisit record says that a resource had not changed since an earlier capture. Each is joined with the
latest full response (status 200) for the same canonical URL that is earlier by (ts, record_id). Then its
validators are checked: entity tags if both have one (weak tags compare by their opaque part), else
Last-Modified dates if both have one, else payload digests if both have one; without a pair to compare
the revisit (of a response without validators, say) counts as unverified, and stays resolved. A confirmed or unverified revisit gets the stored
headers, updated with its own except those that a 304 may not change.

The as-of join splits hot URLs: records are range-partitioned by (URL, ts, record_id), each partition
finds the last response before each of its records, and the last response of each earlier partition is
carried over, a row for each URL and partition.

Defined cases: rows whose kind is neither response nor revisit take no part; records with a null ts or
null URL: a revisit is unresolved, a response is never joined; ties in ts go by record_id; of equal
(URL, ts, record_id) rows one response counts; repeated revisits give repeated rows; null headers are
empty; an empty table gives an empty table; further columns are not looked at, whatever their names.
"""

from __future__ import annotations

import gzip
import io
import zlib
from collections.abc import Iterator
from warnings import warn

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kairograph.llm.common import materialize
from kairograph.sources.archives import opened

# Header fields that a 304 response doesn't update in a stored response, lower case.
KEPT_FIELDS = (
    "connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate",
    "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade",
)


def canonical_url(url: Column) -> Column:
    """Scheme, leading www, user, default port, fragment and trailing slash go; host is lower case; the query is sorted."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    parts = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?//(?:[^/?@]*@)?([^/?]*)([^?]*)\??(.*)$"
    host = F.lower(F.regexp_extract(bare, parts, 2))
    host = F.regexp_replace(F.regexp_replace(host, r":(?:80|443)?$", ""), r"^www\d*\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, parts, 3), "/+$", "")
    query = F.array_join(F.array_sort(F.filter(F.split(F.regexp_extract(bare, parts, 4), "&"), lambda p: p != "")), "&")
    whole = F.concat(host, F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(bare.rlike(parts), whole).otherwise(bare)


def _opaque(tag: Column) -> Column:
    return F.regexp_replace(F.trim(tag), "^W/", "")


def _updated(stored: Column, new: Column) -> Column:
    """Stored headers with the permitted new ones over them; names compare in lower case."""
    lower = lambda m: F.transform_keys(F.coalesce(m, F.create_map().cast("map<string,string>")), lambda k, v: F.lower(k))
    old, fresh = lower(stored), F.map_filter(lower(new), lambda k, v: ~k.isin(*KEPT_FIELDS))
    return F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(fresh, k)), fresh)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Per revisit of `records` (record_id, uri, ts, kind, status, etag, last_modified, digest, headers): record_id,
    canonical, resolved_id, verdict and merged headers (null unless resolved)."""
    events = records.where("kind IN ('response', 'revisit')").select(
        "record_id", canonical_url(F.col("uri")).alias("canonical"), "ts", "kind", "etag", "last_modified", "digest", "headers",
        ((F.col("kind") == "response") & (F.col("status") == 200) & F.col("ts").isNotNull() & F.col("uri").isNotNull()).alias("full"),
    ).where("full OR kind = 'revisit'")
    dated = materialize(
        events.where("ts IS NOT NULL AND canonical IS NOT NULL")
        .repartitionByRange("canonical", "ts", "record_id")
        .withColumn("part", F.spark_partition_id())
        .withColumn("response", F.when(F.col("full"), F.struct("ts", "record_id", "etag", "last_modified", "digest", "headers"))),
        "events",
    )
    before = Window.partitionBy("canonical").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    order = Window.partitionBy("part", "canonical").orderBy("ts", "record_id", "full")
    carried = (
        dated.groupBy("part", "canonical")
        .agg(F.max_by("response", F.when(F.col("full"), F.struct("ts", "record_id"))).alias("final"))
        .withColumn("carried", F.last("final", ignorenulls=True).over(before))
        .select("part", "canonical", "carried")
    )
    found = (
        dated.withColumn("inside", F.last("response", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
        .where("kind = 'revisit'")
        .join(carried, ["part", "canonical"], "left")
        .withColumn("match", F.coalesce("inside", "carried"))
    )
    undated = events.where("kind = 'revisit' AND (ts IS NULL OR canonical IS NULL)").withColumn("match", F.lit(None).cast(found.schema["match"].dataType))
    columns = ["record_id", "canonical", "etag", "last_modified", "digest", "headers", "match"]
    joined = found.select(*columns).unionByName(undated.select(*columns))
    old = F.col("match")
    same = F.coalesce(
        _opaque(F.col("etag")) == _opaque(old["etag"]),
        F.trim("last_modified") == F.trim(old["last_modified"]),
        F.col("digest") == old["digest"],
    )
    verdict = F.when(old.isNull(), "no earlier response").when(same.isNull(), "unverified").when(same, "confirmed").otherwise("validator mismatch")
    resolved = F.col("verdict").isin("confirmed", "unverified")
    return joined.withColumn("verdict", verdict).select(
        "record_id", "canonical", F.when(resolved, old["record_id"]).alias("resolved_id"), "verdict", F.when(resolved, _updated(old["headers"], F.col("headers"))).alias("headers")
    )


COLUMNS = ["record_id", "uri", "ts", "kind", "status", "etag", "last_modified", "digest", "headers", "body"]
BATCH_BYTES = 8 << 20


def read_warc(spark, path: str) -> DataFrame:
    """Response and revisit records of WARC files, plain or gzip by record. A task streams its files, one record at a time, and hands on
    batches of some BATCH_BYTES, so files may be of any size.

    Defined cases: an empty file has no records; of a file that is cut off, the records before the cut count, with a warning; a record without a
    number as its length is left out, and reading goes on at the next line that starts a record.
    """

    def records(frames: Iterator) -> Iterator:
        import pandas as pd

        for frame in frames:
            for where in frame["path"]:
                with opened(where) as file:
                    rows, held = [], 0
                    for row in parse_warc(file, where):
                        rows.append(row)
                        held += len(row[-1])
                        if held >= BATCH_BYTES or len(rows) == 10_000:
                            yield pd.DataFrame(rows, columns=COLUMNS)
                            rows, held = [], 0
                    if rows:
                        yield pd.DataFrame(rows, columns=COLUMNS)

    return spark.read.format("binaryFile").load(path).where("length > 0").select("path").mapInPandas(
        records, "record_id string, uri string, ts string, kind string, status int, etag string, last_modified string, digest string, headers map<string,string>, body binary"
    )


def parse_warc(file, name: str) -> Iterator[tuple]:
    """Rows of the response and revisit records of an open file."""
    zipped = file.read(2) == b"\x1f\x8b"
    file.seek(0)
    stream = gzip.GzipFile(fileobj=file) if zipped else io.BufferedReader(file)  # the former buffers what it unpacks, no further than it must

    def head() -> dict[str, str]:
        fields: dict[str, str] = {}
        while (line := stream.readline().rstrip(b"\r\n")) != b"":
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        return fields

    try:
        while line := stream.readline():
            if not line.startswith(b"WARC/"):
                continue
            own = head()
            length = own.get("content-length", "")
            if not length.isascii() or not length.isdigit():
                continue
            block = stream.read(int(length))
            if len(block) < int(length):
                raise EOFError("in a record")
            kind = own.get("warc-type", "")
            if kind not in ("response", "revisit"):
                continue
            start, _, body = block.partition(b"\r\n\r\n")
            lines = start.decode("latin-1").split("\r\n")
            status = lines[0].split(" ")[1:2] if lines[0].startswith("HTTP/") else []
            http = {n.strip().lower(): v.strip() for n, c, v in (x.partition(":") for x in lines[1:]) if c}
            yield (
                own.get("warc-record-id"), own.get("warc-target-uri"), own.get("warc-date"), kind, int(status[0]) if status and status[0].isdigit() else None,
                http.get("etag"), http.get("last-modified"), own.get("warc-payload-digest"), http, body,
            )
    except (EOFError, gzip.BadGzipFile, zlib.error) as error:
        warn(f"{name} is cut off or broken: {error}", stacklevel=1)


SHARED = "//static.example.org/site.js"


def captures(pages: DataFrame) -> DataFrame:
    """The capture log that the query resolves, six records a page, four of them of its URL and two of one resource that all pages share, so
    that one URL holds a third of all records.

    Of its URL: a full response, ten days later another with other content, and about each a revisit, some of them earlier than it and some by
    another spelling. Entity tags, Last-Modified dates and digests are there or not, and right or not, by page_id, so that
    each of them decides some revisits and some have no validator to compare. The shared resource changes every fifty days;
    every fourth page saw a full response of it.
    """
    p, day = F.col("page_id"), (F.col("page_id") * 37) % 1000
    text = F.coalesce("html", F.lit(""))
    date = lambda d: F.date_format(F.date_add(F.lit("2000-01-01").cast("date"), d.cast("int")), "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    base = pages.select(
        p, "url", day.cast("long").alias("d"), F.md5(text).alias("first"), F.md5(F.concat(text, F.lit("2"))).alias("second"), (day - day % 50).cast("long").alias("since"),
        F.when(p % 3 == 0, F.regexp_replace("url", "^http://", "https://www.")).otherwise(F.col("url")).alias("other"),
    )
    d, since = F.col("d"), F.col("since")

    def record(k: int, uri, ts, full, etag, modified, digest):
        headers = F.create_map(
            F.lit("Content-Type"), F.when(full, "text/html").otherwise("text/plain"), F.lit("Age"), F.when(full, ts.cast("string")).otherwise("0"),
            F.lit("ETag"), F.when(full, etag), F.lit("Last-Modified"), modified, F.lit("Cache-Control"), F.when(~full, "no-cache"),
        )
        return F.struct(
            (p * 6 + k).cast("long").alias("record_id"), uri.alias("uri"), ts.cast("long").alias("ts"), F.when(full, "response").otherwise("revisit").alias("kind"), F.when(full, 200).otherwise(304).alias("status"),
            etag.alias("etag"), modified.alias("last_modified"), digest.alias("digest"), F.map_filter(headers, lambda _, v: v.isNotNull()).alias("headers"),
        )

    def pair(k: int, at, content: str):
        own = F.col(content)
        return [
            record(k, F.col("url"), at, F.lit(True), quoted(own), F.when(p % 5 != 0, date(at)), F.when(p % 3 != 0, own)),
            record(
                k + 1, F.col("other"), at + p % 5 - 1, F.lit(False), F.when(p % 7 == 0, '"changed"').when(p % 2 == 0, F.concat(F.lit("W/"), quoted(own))),
                F.when(p % 13 == 0, date(F.lit(0))).when(p % 4 == 1, date(at)), F.when(p % 11 == 0, F.md5(F.lit("other"))).otherwise(own),
            ),
        ]

    version = F.concat(F.lit("v"), since)
    shared = [
        record(4, F.lit(f"http:{SHARED}"), d, p % 4 == 0, quoted(version), date(since), F.md5(version)),
        record(5, F.lit(f"https:{SHARED.replace('//', '//www.')}#x"), d, F.lit(False), F.lit(None).cast("string"), F.when(p % 2 == 0, date(since)), F.lit(None).cast("string")),
    ]
    return base.select(F.explode(F.array(*pair(0, d, "first"), *pair(2, d + 10, "second"), *shared)).alias("r")).select("r.*")
