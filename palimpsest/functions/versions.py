"""Release versions and validity ranges as column expressions.

A version is the pair (major, minor) of whole numbers; a range is inclusive and stays within one major.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_STRICT = r"(?U)^\s*v?(\d+)\.(\d+)(?:\.\d+)?\s*$"
_INLINE = r"(?U)(?<![\w.])v?\d+\.\d+(?:\.\d+)?(?![\w.])"


def try_parse(raw: Column) -> Column:
    """Struct(major, minor) of "1.31", "v1.31" or "1.31.4" with outer white space; null for anything else."""
    part = lambda i: F.regexp_extract(raw, _STRICT, i).try_cast("int")
    return F.when(raw.rlike(_STRICT), F.struct(part(1).alias("major"), part(2).alias("minor")))


def parse(raw: Column) -> Column:
    """As try_parse, but text that isn't a version ends the query."""
    wrong = F.raise_error(F.concat(F.lit("not a version: "), F.coalesce(raw, F.lit("null")))).cast("struct<major:int,minor:int>")
    return F.when(raw.rlike(_STRICT), try_parse(raw)).otherwise(wrong)


def label(major: Column, minor: Column) -> Column:
    return F.concat_ws(".", major.cast("string"), minor.cast("string"))


def branch(major: Column, minor: Column) -> Column:
    return F.concat(F.lit("release-"), label(major, minor))


def following(minor: Column) -> Column:
    return minor + 1


def preceding(minor: Column) -> Column:
    """The minor before; there is none before 0."""
    return F.when(minor > 0, minor - 1).otherwise(F.raise_error(F.lit("no version before a first minor")).cast("int"))


def range_label(low: Column, high: Column) -> Column:
    return F.when(low == high, low.cast("string")).otherwise(F.concat_ws("-", low.cast("string"), high.cast("string")))


def clamp(version: Column, least: Column, most: Column) -> Column:
    return F.greatest(least, F.least(most, version))


def covers(low: Column, high: Column, version: Column) -> Column:
    return (low <= version) & (version <= high)


def overlaps(low_a: Column, high_a: Column, low_b: Column, high_b: Column) -> Column:
    return (low_a <= high_b) & (low_b <= high_a)


def mentioned(text: Column) -> Column:
    """Minors of the versions 1.0 to 1.99 mentioned in a text, each once, in order of first mention."""
    found = F.transform(F.regexp_extract_all(text, F.lit(_INLINE), F.lit(0)), lambda v: F.split(F.regexp_replace(v, "^v", ""), r"\."))
    plausible = F.filter(found, lambda p: (F.element_at(p, 1).try_cast("int") == 1) & F.element_at(p, 2).try_cast("int").between(0, 99))
    return F.array_distinct(F.transform(plausible, lambda p: F.element_at(p, 2).cast("int")))
