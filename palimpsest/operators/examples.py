"""Whole examples for training and evaluation: questions, positives and negatives, put together and deduplicated.

An example is (question, version, positive_id, negatives, family, source, unanswerable, notes). Ids of positives and negatives come
from ``datasets``; negatives of several kinds are one list, a kind after the other. Which template a question takes is a portable
hash of its key, so reruns and partitions agree.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as fn
from . import corpus, datasets

REMOVED = ("Does {version} still serve {api} for {resource}?", "What do I use for {resource} in {version} instead of {api}?", "A manifest of {resource} names {api}. Will {version} accept it?")
BOUNDARY = ("Which release was the first without {api} for {resource}?", "Until when could {resource} use {api}?")
SECTION = ("Which rules hold for {topic} with {version}?", "I use {version}: where do I begin with {topic}?", "Summarise {topic} for readers on {version}.")


def rendered(templates: tuple[str, ...], key: list[Column], **slots: Column) -> Column:
    """A template, picked by hash of key, with its slots filled; a version's slot takes "1.<minor>"."""
    out = fn.picked(list(templates), *key)
    for name, value in slots.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.concat(F.lit("1."), value.cast("string")) if name == "version" else value.cast("string"))
    return out


def listed(kinds: list[DataFrame], keys: list[str], most: int) -> DataFrame:
    """keys and ``negatives``: the first ``most`` of the kinds' rows (keys, negative, place), a kind after the other, each id once."""
    rows = reduce(DataFrame.unionByName, [k.select(*keys, "negative", "place", F.lit(i).alias("_kind")) for i, k in enumerate(kinds)])
    rows = rows.groupBy(*keys, "negative").agg(F.min(F.struct("_kind", "place")).alias("_at"))
    order = Window.partitionBy(*keys).orderBy("_at", "negative")
    rows = rows.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= most)
    return rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "negative"))), lambda s: s["negative"]).alias("negatives"))  # ``most`` at most


def _example(rows: DataFrame, question: Column, source: str, notes: Column) -> DataFrame:
    return rows.select(question.alias("question"), "version", F.col("positive").alias("positive_id"), "negatives", "family", F.lit(source).alias("source"), F.lit(False).alias("unanswerable"), notes.alias("notes"))


def removals(facts: DataFrame, guide: DataFrame, passages: DataFrame, versions: DataFrame, seed: int = datasets.SEED, most: int = datasets.MOST_NEGATIVES) -> tuple[DataFrame, DataFrame]:
    """Examples of every fact from its removal on, and one about each removal itself. Those without negatives are left out.

    Negatives: passages of the positive's family that don't cover the version (not for the removal itself), then guide passages of
    other families that name a resource of the fact but not its API.
    """
    at = datasets.removal_examples(facts, guide, versions)
    own = passages.select(F.col("chunk_id").alias("positive"), "family")
    asked = at.join(own, "positive").join(facts.select("fact_id", "api", "resources", "removed"), "fact_id")
    family = datasets.family_negatives(asked.select(F.col("positive").alias("chunk_id"), "family", "version").distinct(), passages, most)
    family = at.join(family.withColumnRenamed("chunk_id", "positive"), ["positive", "version"]).select("fact_id", "version", "negative", "place")
    siblings = datasets.sibling_negatives(at, facts, guide, most)
    keys = ["fact_id", "version"]
    key = [F.col("fact_id"), F.col("version"), F.lit(seed)]
    resource = F.element_at("resources", (datasets.number(datasets.drawn(seed, *key)) % F.size("resources") + 1).cast("int"))
    every = asked.join(listed([family, siblings], keys, most), keys)
    first = asked.filter("boundary").join(listed([siblings], keys, most), keys)
    question = rendered(REMOVED, key, version=F.col("version"), api=F.col("api"), resource=resource)
    edge = rendered(BOUNDARY, key, api=F.col("api"), resource=F.element_at("resources", 1))
    notes = F.concat(F.col("api"), F.lit(" removed in 1."), F.col("removed").cast("string"))
    return _example(every, question, "deprecation", notes), _example(first, edge, "deprecation-boundary", notes)


def changed(passages: DataFrame, seed: int = datasets.SEED, most: int = datasets.MOST_NEGATIVES) -> DataFrame:
    """Examples about sections with several snapshots; passages need ``topic``. Those without negatives are left out."""
    asked = datasets.changed_sections(passages, seed)
    negatives = listed([datasets.family_negatives(asked, passages, most)], ["chunk_id", "version"], most)
    rows = asked.join(negatives, ["chunk_id", "version"]).join(passages.select("chunk_id", "topic"), "chunk_id").withColumnRenamed("chunk_id", "positive")
    question = rendered(SECTION, [F.col("positive"), F.lit(seed)], topic=F.col("topic"), version=F.col("version"))
    return _example(rows, question, "changed-section", F.lit(None).cast("string"))


def unanswerable(templates: DataFrame, versions: DataFrame, count: int, seed: int = datasets.SEED) -> DataFrame:
    """Questions without a positive: refusing them is right."""
    none = F.lit("").alias("positive_id"), F.array().cast("array<string>").alias("negatives"), F.lit("").alias("family")
    return datasets.unanswerable(templates, versions, count, seed).select("question", "version", *none, F.lit("unanswerable").alias("source"), F.lit(True).alias("unanswerable"), F.lit(None).cast("string").alias("notes"))


def build_stats(parts: list[DataFrame]) -> DataFrame:
    """(source, examples) before equal questions are folded."""
    return reduce(DataFrame.unionByName, [p.select("source") for p in parts]).groupBy("source").agg(F.count("*").alias("examples"))


def assembled(parts: list[DataFrame], seed: int = datasets.SEED) -> DataFrame:
    """All parts, the first of questions that are equal but for case and outer white space, in an order drawn by hash."""
    rows = reduce(DataFrame.unionByName, [p.withColumn("family", F.col("family").cast("string")).withColumn("_part", F.lit(i)) for i, p in enumerate(parts)])
    rows = corpus.first_wins(rows, F.lower(fn.stripped(F.col("question"))), ["_part", "positive_id", "version", "question"]).drop("_part")
    return rows.orderBy(datasets.drawn(seed, F.col("source"), F.col("question")), "source", "question")


def gold(specs: DataFrame, passages: DataFrame, most: int = datasets.GOLD_NEGATIVES, siblings: int = datasets.SIBLINGS) -> DataFrame:
    """Examples of hand-written specs (spec_id, question, want_version, want_doc, want_text, unanswerable) that bind to a passage.

    Negatives: passages of the positive's family that don't cover the version, then, if a document was asked for, the first
    ``siblings`` passages of other families in documents that match. Specs are a short list and are sent to the passages.
    """
    few = F.broadcast(specs)  # written by hand
    asked = specs.filter("not unanswerable")
    bound = datasets.bound_gold(asked, passages).withColumnRenamed("chunk_id", "positive").join(asked, "spec_id")
    versions = passages.select(F.col("family").alias("_f"), F.col("chunk_id").alias("negative"), F.col("version_low").alias("_l"), F.col("version_high").alias("_h"), F.col("doc_path").alias("_doc"))
    first = lambda df, n: df.withColumn("place", F.row_number().over(Window.partitionBy("spec_id").orderBy("negative"))).filter(F.col("place") <= n).select("spec_id", "negative", "place")
    own = F.broadcast(bound.select("spec_id", "positive", "family", "want_version", "want_doc"))  # a row a spec
    family = versions.join(own, (F.col("_f") == F.col("family")) & (F.col("negative") != F.col("positive")) & ~F.col("want_version").between(F.col("_l"), F.col("_h")))
    doc = (F.coalesce("want_doc", F.lit("")) != "") & F.contains(F.col("_doc"), F.col("want_doc")) & (F.col("_f") != F.col("family"))
    negatives = listed([first(family, most), first(versions.join(own, doc), siblings)], ["spec_id"], most)
    rows = bound.join(negatives, "spec_id", "left").select("question", F.col("want_version").alias("version"), F.col("positive").alias("positive_id"), F.coalesce("negatives", F.array().cast(negatives.schema["negatives"].dataType)).alias("negatives"), F.col("family").cast("string").alias("family"), F.lit("gold").alias("source"), F.lit(False).alias("unanswerable"))
    refused = few.filter("unanswerable").select("question", F.col("want_version").alias("version"), F.lit(None).cast(rows.schema["positive_id"].dataType).alias("positive_id"), F.array().cast(rows.schema["negatives"].dataType).alias("negatives"), F.lit("").alias("family"), F.lit("gold-unanswerable").alias("source"), F.lit(True).alias("unanswerable"))
    return rows.unionByName(refused)


def unresolved(specs: DataFrame, passages: DataFrame) -> DataFrame:
    """(spec_id, problem) of the specs with an answer that no passage fits."""
    asked = specs.filter("not unanswerable")
    bare = asked.join(datasets.bound_gold(asked, passages).select("spec_id"), "spec_id", "left_anti")
    problem = F.concat(F.lit("nothing covers 1."), F.col("want_version").cast("string"), F.lit(" with doc '"), F.coalesce("want_doc", F.lit("")), F.lit("' and text '"), F.coalesce("want_text", F.lit("")), F.lit("'"))
    return bare.select("spec_id", problem.alias("problem"))
