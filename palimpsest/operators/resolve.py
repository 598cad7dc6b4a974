"""Which version a question is about: stated, inferred from removed APIs it names, or the newest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import versions as vs

#: Words before a version. The compatible form takes them anywhere; the strict one needs word ends around both.
_WORDS = r"kubernetes|k8s|cluster|version|release|upgrad\w*|running|on|to|eks|gke|aks"
CUE = {True: rf"(?iU)(?:{_WORDS})\W{{0,12}}v?(\d\.\d{{1,2}})(?:\.\d+)?", False: rf"(?iU)\b(?:{_WORDS})\b\W{{0,12}}v?(\d\.\d{{1,2}})(?:\.\d+)?(?![\w.]*\w)"}
PREFIXED = r"(?U)(?<![\w.])v(\d\.\d{1,2})(?:\.\d+)?(?![\w.])"


def stated(query: Column, compatible: bool = True) -> Column:
    """Struct(minor, evidence) of the version that a query states, or null: v-prefixed ones first, then those after a cue, then any."""
    raw = F.concat(F.regexp_extract_all(query, F.lit(PREFIXED), F.lit(1)), F.regexp_extract_all(query, F.lit(CUE[compatible]), F.lit(1)))
    cued = F.try_element_at(F.filter(raw, lambda v: v.startswith("1.")), F.lit(1))
    bare = F.try_element_at(vs.mentioned(query), F.lit(1))
    return F.when(cued.isNotNull(), F.struct(F.element_at(F.split(cued, r"\."), 2).cast("int").alias("minor"), cued.alias("evidence"))).when(
        bare.isNotNull(), F.struct(bare.alias("minor"), F.concat(F.lit("1."), bare.cast("string")).alias("evidence"))
    )


def removals(facts: DataFrame) -> DataFrame:
    """(api in lower case, first minor without it, seq of its first mention) from (api, removed, seq)."""
    return facts.groupBy(F.lower("api").alias("api")).agg(F.min("removed").alias("removed"), F.min("seq").alias("seq"))


def inferred(queries: DataFrame, facts: DataFrame, least: int, qid: str, text: str) -> DataFrame:
    """(qid, bound, api): of the APIs that a query names and that went after ``least``, the one with the lowest last version.

    Each query is matched against the list of removals as one array, whose size is that of the guide, not of the data.
    """
    known = removals(facts).filter(F.col("removed") > least)
    all_ = known.agg(F.collect_list(F.struct((F.col("removed") - 1).alias("bound"), "seq", "api")).alias("_all"))
    low = F.lower(F.col(text))
    hit = F.array_min(F.filter("_all", lambda s: F.contains(low, s["api"])))
    return queries.crossJoin(F.broadcast(all_)).withColumn("_hit", hit).filter("_hit is not null").select(qid, "_hit.bound", "_hit.api")  # one row


def resolved(queries: DataFrame, facts: DataFrame, least: int, most: int, qid: str = "query_id", text: str = "query", compatible: bool = True, param: str | None = None) -> DataFrame:
    """(qid, version, source, evidence) with the version clamped to the window; a column ``param`` overrides what the text says.

    An override is a minor number, or text like "1.31"; text that is no version ends the query, a null one overrides nothing.
    """
    fixed = F.col(param) if param else F.lit(None).cast("int")
    if param and queries.schema[param].dataType.simpleString() == "string":
        fixed = F.when(fixed.isNotNull(), vs.parse(fixed)["minor"])
    clamped = lambda c: vs.clamp(c, F.lit(least), F.lit(most))
    out = queries.withColumns({"_s": stated(F.col(text), compatible), "_p": fixed}).join(inferred(queries, facts, least, qid, text), qid, "left")
    source = F.when(F.col("_p").isNotNull() | F.col("_s").isNotNull(), "explicit").when(F.col("bound").isNotNull(), "inferred").otherwise("defaulted")
    version = clamped(F.coalesce("_p", "_s.minor", "bound", F.lit(most)))
    return out.select(qid, version.alias("version"), source.alias("source"), F.coalesce(F.when(F.col("_p").isNotNull(), F.lit("parameter")), "_s.evidence", "api", F.lit("")).alias("evidence"))
