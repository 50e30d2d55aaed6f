"""Small column functions: names, URNs, severities, dates, display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kairograph.functions.intervals import OPEN


def package_urn(name: Column) -> Column:
    return F.concat(F.lit("pkg:npm/"), name)


def version_urn(name: Column, version: Column) -> Column:
    return F.concat(F.lit("pkg:npm/"), name, F.lit("@"), version)


def escaped(name: Column) -> Column:
    """A package name as one segment of a URL's path."""
    return F.url_encode(name)


def maintainer_urn(handle: Column) -> Column:
    return F.concat(F.lit("mnt:npm/"), handle)


def advisory_urn(osv_id: Column) -> Column:
    return F.concat(F.lit("osv:"), osv_id)


def project_urn(name: Column) -> Column:
    return F.concat(F.lit("prj:local/"), name)


def package_of(urn: Column) -> Column:
    """The package part of a version URN: all before the last @ that isn't its first character; empty if there is none."""
    return F.regexp_extract(urn, r"^(.+)@[^@]*$", 1)


def version_of(urn: Column) -> Column:
    return F.regexp_extract(urn, r"^.+@([^@]*)$", 1)


def fold_name(name: Column) -> Column:
    """Name in lower case with look-alike characters folded and separators gone; a scope before / only in lower case."""
    scope = F.when(name.contains("/"), F.concat(F.lower(F.substring_index(name, "/", 1)), F.lit("/"))).otherwise("")
    rest = F.lower(F.when(name.contains("/"), F.regexp_replace(name, "^[^/]*/", "")).otherwise(name))
    folded = F.translate(rest, "013457", "oleast")
    folded = F.replace(F.replace(folded, F.lit("rn"), F.lit("m")), F.lit("vv"), F.lit("w"))
    return F.concat(scope, F.translate(folded, "-_.", ""))


def severity_rank(severity: Column) -> Column:
    s = F.upper(severity)
    return F.when(s == "CRITICAL", 0).when(s == "HIGH", 1).when(s.isin("MODERATE", "MEDIUM"), 2).when(s == "LOW", 3).otherwise(4)


def rfc3339_seconds(text: Column) -> Column:
    """Epoch seconds of an RFC 3339 time, 0 where it isn't one."""
    shaped = text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$")
    return F.coalesce(F.when(shaped, F.unix_timestamp(F.try_to_timestamp(text))), F.lit(0)).cast("long")


def day(seconds: Column) -> Column:
    """Date of an instant: - for none, now for an open end."""
    return F.when(seconds <= 0, "-").when(seconds >= OPEN, "now").otherwise(F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd"))


def day_start(text: Column) -> Column:
    """Epoch seconds of a date's midnight in UTC (the session's time zone)."""
    return F.unix_timestamp(F.to_timestamp(text, "yyyy-MM-dd"))


def percent(count: Column, of: Column) -> Column:
    return F.when(of > 0, 100.0 * count / of).otherwise(0.0)


def shortened(text: Column, n: int) -> Column:
    """At most n bytes and an ellipsis; - for an empty text."""
    cut = F.decode(F.substring(F.encode(text, "UTF-8"), 1, n), "UTF-8")
    return F.when(F.coalesce(text, F.lit("")) == "", "-").when(F.octet_length(text) > n, F.concat(cut, F.lit("..."))).otherwise(text)


def first_names(names: Column, k: int) -> Column:
    """The first k names, joined, and how many more there are."""
    more = F.size(names) - k
    return F.concat(F.array_join(F.slice(names, 1, k), ", "), F.when(more > 0, F.concat(F.lit(" and "), more, F.lit(" more"))).otherwise(""))


def spells_text(spells: Column) -> Column:
    return F.array_join(F.transform(spells, lambda s: F.concat(day(s["vf"]), F.lit(" to "), day(s["vt"]))), ", ")
