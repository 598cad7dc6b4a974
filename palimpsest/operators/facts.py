"""Removal facts from a guide: releases are level-three headings, each level-four heading below starts a block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as fn

#: The sentence forms of a guide, for text whose white space is single blanks.
_API, _GONE = r"\*\*([\w./-]+)\*\* API version", r" (?:is|are) no longer served as of v(\d+\.\d+)"
_KIND = "[A-Z][A-Za-z0-9]*"
FORM_1 = f"(?i){_API}s? of (.+?){_GONE}"
FORM_2 = f"({_KIND}(?:(?:, ?| and ){_KIND})*) in the {_API}{_GONE}"
REPLACED = f"(?i){_API}, ?available since v(\\d+\\.\\d+)"


def blocks(guides: DataFrame) -> DataFrame:
    """(doc_path, ord, release, heading, body) of each block of guides (doc_path, markdown); blocks before any release are left out."""
    lines = guides.select("doc_path", F.posexplode(F.split("markdown", "\n")).alias("pos", "line"))
    release = F.regexp_extract("line", r"(?d)^###\s+v(\d+\.\d+)\s*$", 1)
    heading = F.regexp_extract("line", r"(?d)^####\s+(.+?)\s*$", 1)
    marked = lines.withColumns({"r": F.when(release != "", release), "h": F.when(heading != "", heading)})
    w = Window.partitionBy("doc_path").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = marked.withColumns(
        {
            "release": F.last("r", ignorenulls=True).over(w),
            "block": F.sum(F.when(F.col("h").isNotNull() | F.col("r").isNotNull(), 1).otherwise(0)).over(w),
        }
    )
    first = F.min_by("h", "pos")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("h").isNull(), F.struct("pos", "line")))), lambda s: s["line"]), "\n")
    out = marked.groupBy("doc_path", "block", "release").agg(first.alias("heading"), body.alias("body"))
    return out.filter("heading is not null and release is not null").select("doc_path", F.col("block").alias("ord"), "release", fn.clean_heading(F.col("heading")).alias("heading"), "body")


def _first(form1: int, form2: int) -> Column:
    one, two = F.regexp_extract("flat", FORM_1, form1), F.regexp_extract("flat", FORM_2, form2)
    return F.when(F.col("flat").rlike(FORM_1), one).when(F.col("flat").rlike(FORM_2), two)


def parsed(guides: DataFrame) -> DataFrame:
    """Blocks with api, resources, removed_in, replacement, replacement_since and ``skipped`` (a reason, null for facts).

    The version in the sentence wins over the heading's.
    """
    out = blocks(guides).withColumn("flat", F.regexp_replace("body", r"(?U)\s+", " ")).withColumns({"api": _first(1, 2), "resources": fn.resources(_first(2, 1)), "removed_in": _first(3, 3)})
    found = F.col("flat").rlike(REPLACED)
    out = out.withColumns({"replacement": F.when(found, F.regexp_extract("flat", REPLACED, 1)), "replacement_since": F.when(found, F.regexp_extract("flat", REPLACED, 2))})
    return out.drop("flat").withColumn("skipped", F.when(F.col("api").isNull(), "no removal sentence").when(F.size("resources") == 0, "no resources"))


def facts(guides: DataFrame) -> DataFrame:
    """One row a fact, the first of equal ones, with fact_id."""
    good = parsed(guides).filter("skipped is null").withColumn("fact_id", fn.fact_id(F.col("removed_in"), F.col("api"), F.col("resources")))
    w = Window.partitionBy("fact_id").orderBy("doc_path", "ord")
    return good.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "skipped", "body")


def coverage(guides: DataFrame) -> DataFrame:
    """One row: blocks, facts and their share (0 without blocks)."""
    seen = parsed(guides).agg(F.count("*").alias("blocks"))
    return seen.crossJoin(facts(guides).agg(F.count("*").alias("facts"))).withColumn("coverage", F.coalesce(F.try_divide("facts", "blocks"), F.lit(0.0)))


#: Share of blocks that become facts below which a guide's form has likely changed.
LEAST_COVERAGE = 0.9


def alerted(covered: DataFrame, least: float = LEAST_COVERAGE) -> DataFrame:
    """coverage() with ``alert``: whether there are blocks and too few of them became facts."""
    return covered.withColumn("alert", (F.col("blocks") > 0) & (F.col("coverage") < least))


def newest(guides: DataFrame) -> DataFrame:
    """The guides of the one newest version."""
    last = guides.agg(F.max("version").alias("_last"))  # one row
    return guides.join(F.broadcast(last), F.col("version") == F.col("_last"), "left_semi")
