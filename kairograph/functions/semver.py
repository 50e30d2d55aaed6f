"""Semantic versions and ranges as columns.

A version is a struct whose natural order is version precedence; a range is an array (alternatives) of
arrays (comparators that all hold). Versions parse with built-in functions. Range texts parse in an
Arrow-batched function over the distinct texts only; what doesn't parse is null.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NUMBER = "(0|[1-9][0-9]{0,19})"
_VERSION = rf"^{_NUMBER}\.{_NUMBER}\.{_NUMBER}(?:-([^+]+))?(?:\+(.*))?$"
_IDENT = "struct<kind:int,num:decimal(20,0),str:string>"
KEY_TYPE = f"struct<major:decimal(20,0),minor:decimal(20,0),patch:decimal(20,0),release:int,pre:array<{_IDENT}>>"
RANGE_TYPE = "array<array<struct<op:string,major:decimal(20,0),minor:decimal(20,0),patch:decimal(20,0),pre:string>>>"
_MOST = 2**64 - 1


def _identifiers(pre: Column) -> Column:
    """Prerelease identifiers: numbers before words, numbers by value, words bytewise."""
    number = lambda s: s.rlike("^(0|[1-9][0-9]{0,18})$")
    return F.transform(
        F.split(pre, r"\."),
        lambda s: F.struct(F.when(number(s), 0).otherwise(1).alias("kind"), F.when(number(s), s.cast("decimal(20,0)")).otherwise(F.lit(0).cast("decimal(20,0)")).alias("num"), F.when(number(s), F.lit("")).otherwise(s).alias("str")),
    )


def _key(major: Column, minor: Column, patch: Column, pre: Column) -> Column:
    """pre: identifiers joined by dots, empty for a release."""
    none = F.array().cast(f"array<{_IDENT}>")
    return F.struct(major.alias("major"), minor.alias("minor"), patch.alias("patch"), F.when(pre == "", 1).otherwise(0).alias("release"), F.when(pre == "", none).otherwise(_identifiers(pre)).alias("pre"))


def version_key(text: Column) -> Column:
    """The sortable version, null where the text isn't one. A leading v, then =, and white space around are tolerated."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(text), "^v", ""), "^=", "")
    part = lambda i: F.regexp_extract(bare, _VERSION, i)
    number = lambda i: part(i).cast("decimal(20,0)")
    most = F.lit(str(_MOST)).cast("decimal(20,0)")
    small = (number(1) <= most) & (number(2) <= most) & (number(3) <= most)
    dotted = ~F.regexp_extract(bare, r"^[^+]*", 0).rlike(r"-(\.|.*\.\.|.*\.$)|-$")
    return F.when(bare.rlike(_VERSION) & small & dotted, _key(number(1), number(2), number(3), part(4)))


def is_prerelease(key: Column) -> Column:
    return key["release"] == 0


def looks_prerelease(text: Column) -> Column:
    """A hyphen before any plus sign, without parsing."""
    return F.split_part(text, F.lit("+"), F.lit(1)).contains("-")


class _Partial:
    """A version whose last parts may be missing or wildcards."""

    def __init__(self, text: str):
        text = text.strip()
        text = text.removeprefix("v").partition("+")[0]
        body, _, self.pre = text.partition("-")
        if not text:
            raise ValueError
        segments = body.split(".")
        if len(segments) > 3:
            raise ValueError
        self.numbers: list[int] = []
        for segment in segments:
            if segment in ("", "x", "X", "*"):
                break
            if not re.fullmatch("0|[1-9][0-9]*", segment) or int(segment) > _MOST:
                raise ValueError
            self.numbers.append(int(segment))

    @property
    def low(self) -> tuple:
        return (*self.numbers, *[0] * (3 - len(self.numbers)), self.pre)

    def after(self, kept: int, pre: str) -> tuple:
        """The least version beyond all that share the first `kept` numbers."""
        first = [*self.numbers, 0, 0, 0][:kept]
        first[-1] += 1
        return (*first, *[0] * (3 - kept), pre)


def _span(low: _Partial, kept: int) -> list[tuple]:
    return [(">=", *low.low), ("<", *low.after(kept, "0"))]


def _comparators(token: str) -> list[tuple]:
    if token in ("", "x", "X", "*"):
        return [(">=", 0, 0, 0, "")]
    sign = re.match(r"\^|~>|~|>=|<=|>|<|=|", token)[0]
    p = _Partial(token[len(sign) :])
    given = len(p.numbers)
    if sign == "^":
        leading = next((i for i, n in enumerate(p.numbers[:2]) if n), 2)
        return _span(p, min(leading + 1, max(1, given)))
    if sign in ("~", "~>"):
        return _span(p, 2 if given > 1 else 1)
    if given == 3:
        return [(sign or "=", *p.low)]
    kept = 2 if given == 2 else 1
    if sign in ("", "="):
        return _span(p, kept)
    if sign == ">":
        return [(">=", *p.after(kept, ""))]
    if sign == "<=":
        return [("<", *p.after(kept, "0"))]
    return [(sign, *p.low)]


def parse_range_text(text: str | None) -> list[list[tuple]] | None:
    """Alternatives of comparators (op, major, minor, patch, pre), or None."""
    if text is None:
        return None
    if text.strip() in ("", "*", "latest"):
        return [[(">=", 0, 0, 0, "")]]
    try:
        alternatives = []
        for part in text.split("||"):
            tokens = re.sub(r"(?:(?<=\s)|^)(\^|~>|~|>=|<=|>|<|=)\s+(?=\S)", r"\1", part.strip()).split()
            found, i = [], 0
            while i < len(tokens):
                if tokens[i + 1 : i + 2] == ["-"] and i + 2 < len(tokens):
                    high = _Partial(tokens[i + 2])
                    found.append((">=", *_Partial(tokens[i]).low))
                    found.append(("<=", *high.low) if len(high.numbers) == 3 else ("<", *high.after(max(1, len(high.numbers)), "0")))
                    i += 3
                else:
                    found += _comparators(tokens[i])
                    i += 1
            alternatives.append(found or [(">=", 0, 0, 0, "")])
        return alternatives
    except ValueError:
        return None


def _parsed(texts: pd.Series) -> pd.Series:
    from decimal import Decimal

    return texts.map(lambda t: None if (p := parse_range_text(t)) is None else [[{"op": c[0], "major": Decimal(c[1]), "minor": Decimal(c[2]), "patch": Decimal(c[3]), "pre": c[4]} for c in alternative] for alternative in p])


def parse_ranges(df: DataFrame, column: str, into: str = "parsed") -> DataFrame:
    """`df` with the parsed range; each distinct text is parsed once."""
    texts = df.select(column).distinct().where(F.col(column).isNotNull()).withColumn(into, F.pandas_udf(_parsed, RANGE_TYPE)(column))
    return df.join(texts, column, "left")


def is_any(parsed: Column) -> Column:
    """Whether a range is the single comparator >=0.0.0."""
    first = parsed[0][0]
    return (F.size(parsed) == 1) & (F.size(parsed[0]) == 1) & (first["op"] == ">=") & (first["major"] + first["minor"] + first["patch"] == 0) & (first["pre"] == "")


def satisfies(key: Column, parsed: Column) -> Column:
    """Whether a version is in a range. A prerelease is only if some comparator of the alternative carries one at the same numbers."""

    def holds(c: Column) -> Column:
        other = _key(c["major"], c["minor"], c["patch"], c["pre"])
        op = c["op"]
        return F.when(op == ">=", key >= other).when(op == ">", key > other).when(op == "<=", key <= other).when(op == "<", key < other).otherwise(key == other)

    def admits(alternative: Column) -> Column:
        same = lambda c: (c["pre"] != "") & (c["major"] == key["major"]) & (c["minor"] == key["minor"]) & (c["patch"] == key["patch"])
        return F.forall(alternative, holds) & ((key["release"] == 1) | F.exists(alternative, same))

    return F.exists(parsed, admits)


def max_satisfying(key: Column, text: Column, parsed: Column) -> Column:
    """Aggregate: the text of the highest version in the range."""
    return F.max_by(text, F.when(satisfies(key, parsed), key))
