"""Sections of Markdown as table functions.

``sections_of`` joins a table laterally with the sections of its texts. ``outlined`` takes texts that lie in a table line by line: Spark brings a
text's lines together and in order (PARTITION BY, ORDER BY), and the function keeps six heading slots and the open fence's sign between
rows, so a text of any length streams through one task's constant memory. Both follow ``chunking.sections``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions import text as fn
from .chunking import sections

_FENCE = re.compile(r"[^\S\n]*(```|~~~)")
_HEADING = re.compile(r"(#{1,6})[^\S\n]+([^\n]*)")
_SHORTCODE, _ANCHOR = re.compile(fn.SHORTCODE), re.compile(fn.ANCHOR)


@F.udtf(returnType="section int, heading_path array<string>, body string")
class Sections:
    """(section, heading_path, body) of one text; a null text has none, an empty one a single empty section."""

    def eval(self, text: str, title: str) -> Iterator:
        if text is not None:
            for i, (path, body) in enumerate(sections(text, title)):
                yield i, path, body


@F.udtf(returnType="key string, line long, section int, heading boolean, fenced boolean, heading_path array<string>, text string")
class Outline:
    """A row for each line: its section, whether it is that section's heading, whether it belongs to a fenced block, and the breadcrumb."""

    def __init__(self):
        self.slots, self.sign, self.section = [""] * 6, None, 0

    def eval(self, row: Row) -> Iterator:
        text = row["text"] if row["text"] is not None else ""
        mark, fenced, heading = _FENCE.match(text), self.sign is not None, False
        if fenced:
            if mark and mark[1] == self.sign:
                self.sign = None
        elif mark:
            self.sign, fenced = mark[1], True
        elif found := _HEADING.match(text):
            name = _ANCHOR.sub("", _SHORTCODE.sub("", found[2])).strip()
            if name:
                depth, heading = len(found[1]), True
                self.slots[depth - 1 :] = [name] + [""] * (6 - depth)
                self.section += 1
        yield row["key"], row["line"], self.section, heading, fenced, [s for s in self.slots if s], row["text"]


def sections_of(df: DataFrame, text: str, title: str | None = None) -> DataFrame:
    """df's rows with (section, heading_path, body) of each section of a column; rows without a text go."""
    named = F.col(title).outer() if title else F.lit(None).cast("string")
    return df.lateralJoin(Sections(F.col(text).outer(), named))


def outlined(lines: DataFrame, key: Column, line: Column, text: Column) -> DataFrame:
    """(key, line, section, heading, fenced, heading_path, text) of lines, in the order of ``line`` within a key; a null text is an empty
    line, equal line numbers are put in the order of their texts, and lines with a null key are one text."""
    rows = lines.select(key.cast("string").alias("key"), line.cast("long").alias("line"), text.alias("text"))
    return Outline(rows.asTable().partitionBy("key").orderBy("line", "text"))


def lines_of(df: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """Columns ``keep`` with (line, text) of each line of a column, from 0."""
    return df.select(*keep, F.posexplode(F.split(text, "\n")).alias("line", "text"))


def gathered(outline: DataFrame) -> DataFrame:
    """(key, section, heading_path, body): sections of outlined lines as texts; a section is held whole, as it becomes one value. Where a
    heading is the first line, nothing lies before it and there is no section 0."""
    body = F.array_sort(F.collect_list(F.when(~F.col("heading"), F.struct("line", F.coalesce("text", F.lit("")).alias("text")))))
    return outline.groupBy("key", "section").agg(F.max("heading_path").alias("heading_path"), F.array_join(F.transform(body, lambda s: s["text"]), "\n").alias("body"))
