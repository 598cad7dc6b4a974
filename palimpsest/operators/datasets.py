"""Labelled retrieval examples from a corpus' own structure. Randomness is a portable hash of keys and a seed, so any plan agrees.

Passages are (chunk_id, family, version_low, version_high, ...). An example is (question, version, positive, family, source) and its
negatives are rows (example, place, chunk_id) until they are needed as a list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranges import range_join
from .substrings import contains_join

SEED, MOST_NEGATIVES, PER_FAMILY, GOLD_NEGATIVES, SIBLINGS = 20260805, 6, 3, 8, 6
MINED_FROM, MINED = 30, 8


def drawn(seed: int, *keys: Column) -> Column:
    """16 hex digits that order and pick rows: SHA-256 of seed and keys."""
    return F.substring(F.sha2(F.concat_ws("|", F.lit(str(seed)), *(k.cast("string") for k in keys)), 256), 1, 16)


def number(digest: Column) -> Column:
    """A whole number below 2^32 from a digest."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def changed_sections(passages: DataFrame, seed: int = SEED) -> DataFrame:
    """(chunk_id, family, version): up to PER_FAMILY passages of each family with several, each with a version from its range."""
    many = passages.withColumn("_n", F.count("*").over(Window.partitionBy("family"))).filter("_n > 1").drop("_n")
    w = Window.partitionBy("family").orderBy(drawn(seed, F.col("chunk_id")), "chunk_id")
    few = many.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= PER_FAMILY)
    at = F.col("version_low") + (number(drawn(seed + 1, F.col("chunk_id"))) % (F.col("version_high") - F.col("version_low") + 1)).cast("int")
    return few.select("chunk_id", "family", at.alias("version"))


def family_negatives(examples: DataFrame, passages: DataFrame, most: int = MOST_NEGATIVES) -> DataFrame:
    """(chunk_id, version, negative, place): other passages of the family that don't cover the version, earliest first."""
    other = passages.select("family", F.col("chunk_id").alias("negative"), F.col("version_low").alias("_l"), F.col("version_high").alias("_h"))
    rows = examples.select("chunk_id", "family", "version").join(other, "family").filter((F.col("negative") != F.col("chunk_id")) & ~F.col("version").between(F.col("_l"), F.col("_h")))
    w = Window.partitionBy("chunk_id", "version").orderBy("_l", "negative")
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most).select("chunk_id", "version", "negative", "place")


def _named(facts: DataFrame, passages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunk_id, api) and (chunk_id, resource): what each passage names, each name once, however many facts share it; (fact_id, removed, api, resource)."""
    known = facts.select("fact_id", "removed", "api", F.explode("resources").alias("resource"))
    hits = lambda c: contains_join(passages, known.select(c, F.col(c).alias("needle")).distinct(), "chunk_id", "text", c, "needle").distinct()
    return hits("api"), hits("resource"), known


def removal_examples(facts: DataFrame, passages: DataFrame, versions: DataFrame) -> DataFrame:
    """(fact_id, version, positive, boundary) of every fact and version from its removal on that a guide passage covers.

    A passage (chunk_id, seq, text, range) is a candidate if it names the API and one of the resources of a fact (fact_id, api, resources, removed); the
    first by seq that covers the version is the positive. A passage's versions are listed, so that no range is joined by a loop. The first passage is
    found for each API, resource and version, so facts that share names don't multiply passages. Spark can't tell how many names a
    passage has, so tables of passages are never sent to all tasks.
    """
    apis, resources, known = _named(facts, passages)
    found = passages.select("chunk_id", "seq", "version_low", "version_high").join(apis.hint("merge"), "chunk_id").join(resources.hint("merge"), "chunk_id")
    first = range_join(versions.select("version"), found, []).groupBy("api", "resource", "version").agg(F.min(F.struct("seq", "chunk_id")).alias("b"))
    at = first.join(known, ["api", "resource"]).filter("version >= removed").groupBy("fact_id", "removed", "version").agg(F.min("b").alias("b"))
    return at.select("fact_id", "version", F.col("b.chunk_id").alias("positive"), (F.col("version") == F.col("removed")).alias("boundary"))


def sibling_negatives(examples: DataFrame, facts: DataFrame, passages: DataFrame, most: int = MOST_NEGATIVES) -> DataFrame:
    """(fact_id, version, negative, place): guide passages of other families that name a resource of the fact but not its API.

    Passages of a family that name the same APIs are alike to every fact, so the first ``most`` of them for each resource are enough. So are the first
    ``most`` of a fact's families, and of these its first 2 * ``most``: leaving out one family leaves ``most``.
    """
    apis, resources, known = _named(facts, passages)
    first = lambda rows, n, *keys: rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("seq", "chunk_id"))).filter(F.col("place") <= n)
    sets = apis.groupBy("chunk_id").agg(F.sort_array(F.collect_set("api")).alias("apis"))  # a passage's APIs
    own = passages.select("chunk_id", "seq", "family").filter("family is not null")
    named = own.join(resources.hint("merge"), "chunk_id").join(sets.hint("merge"), "chunk_id", "left").withColumn("apis", F.coalesce("apis", F.array().cast("array<string>")))
    few = first(named, most, "resource", "apis", "family").drop("place")
    others = few.join(known, "resource").filter(~F.coalesce(F.array_contains("apis", F.col("api")), F.lit(False))).select("fact_id", "family", "seq", "chunk_id").distinct()
    others = first(first(others, most, "fact_id", "family"), 2 * most, "fact_id")
    mine = own.select(F.col("chunk_id").alias("positive"), F.col("family").alias("_own")).hint("merge")
    rows = examples.select("fact_id", "version", "positive").join(mine, "positive").join(others.drop("place"), "fact_id").filter("family <> _own")
    return first(rows, most, "fact_id", "version").select("fact_id", "version", F.col("chunk_id").alias("negative"), "place")


def unanswerable(templates: DataFrame, versions: DataFrame, count: int, seed: int = SEED) -> DataFrame:
    """``count`` distinct questions from templates (template_id, template) and versions, drawn by hash; both sides are short lists."""
    rows = templates.crossJoin(versions).withColumn("question", F.replace("template", F.lit("{version}"), F.concat(F.lit("1."), F.col("version").cast("string"))))
    return rows.withColumn("_d", drawn(seed, F.col("template_id"), F.col("version"))).orderBy("_d", "template_id", "version").limit(count).select("template_id", "version", "question")


def split_by_family(families: DataFrame, family: str, dev: float = 0.10, test: float = 0.15, seed: int = SEED) -> DataFrame:
    """(family, split): by drawn order the first whole part of dev * F families are dev, the next of test * F test, the rest train.

    Ranks come from counts of digest prefixes, whose number is fixed, and a rank within each, so no window holds all families.
    """
    rows = families.select(family).distinct().withColumn("_d", drawn(seed, F.col(family))).withColumn("_b", F.substring("_d", 1, 3))
    counts = rows.groupBy("_b").agg(F.count("*").alias("_c"))
    before = counts.select("_b", (F.sum("_c").over(Window.orderBy("_b")) - F.col("_c")).alias("_before"), F.sum("_c").over(Window.partitionBy()).alias("_all"))
    rank = F.row_number().over(Window.partitionBy("_b").orderBy("_d", family)) + F.col("_before")
    cut = F.floor(F.col("_all") * F.lit(dev)), F.floor(F.col("_all") * F.lit(test))
    ranked = rows.join(before, "_b").withColumn("_r", rank)
    return ranked.select(family, F.when(F.col("_r") <= cut[0], "dev").when(F.col("_r") <= cut[0] + cut[1], "test").otherwise("train").alias("split"))


def split_examples(examples: DataFrame, dev: float = 0.10, test: float = 0.15, seed: int = SEED) -> DataFrame:
    """examples (question, family, ...) with ``split``: by family, and those without a family (null or empty) each on its own, in the same shares.

    A question without a family has no positive that could leak, so equal questions only stay together.
    """
    attached = F.coalesce(F.col("family").cast("string"), F.lit("")) != ""
    key = F.when(attached, F.col("family").cast("string")).otherwise(F.col("question")).alias("_key")
    rows = examples.select("*", attached.alias("_attached"), key)
    by_family = split_by_family(rows.filter("_attached"), "_key", dev, test, seed).withColumn("_attached", F.lit(True))
    alone = split_by_family(rows.filter("not _attached"), "_key", dev, test, seed).withColumn("_attached", F.lit(False))
    return rows.join(by_family.unionByName(alone), ["_attached", "_key"]).drop("_attached", "_key")


def leaks(examples: DataFrame, family: str) -> DataFrame:
    """Families in more than one split."""
    return examples.groupBy(family).agg(F.count_distinct("split").alias("splits")).filter("splits > 1")


def bound_gold(specs: DataFrame, passages: DataFrame) -> DataFrame:
    """(spec_id, chunk_id, family): the shortest passage that covers a spec's version and holds its doc and text (empty: any), ties by id.

    Specs are written by hand, so their table is short.
    """
    fits = F.col("want_version").between(F.col("version_low"), F.col("version_high"))
    for want, have in (("want_doc", "doc_path"), ("want_text", "text")):
        fits = fits & ((F.coalesce(F.col(want), F.lit("")) == "") | F.contains(F.col(have), F.col(want)))
    return passages.join(specs, fits).groupBy("spec_id").agg(F.min(F.struct(F.length("text").alias("n"), "chunk_id", "family")).alias("b")).select("spec_id", "b.chunk_id", "b.family")


def mined(hits: DataFrame, positives: DataFrame, families: DataFrame, most: int = MINED) -> DataFrame:
    """(query_id, id, place): the best ranked hits of other families than the positive's."""
    own = positives.join(families.select(F.col("id").alias("positive_id"), F.col("family").alias("_own")), "positive_id").select("query_id", "_own")
    rows = hits.filter(F.col("rank") <= MINED_FROM).join(families.select("id", "family"), "id").join(own, "query_id").filter("family <> _own")
    w = Window.partitionBy("query_id").orderBy("rank")
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most).select("query_id", "id", "place")


def triplets(examples: DataFrame, negatives: DataFrame, texts: DataFrame) -> DataFrame:
    """(query_id, positive_text, negative_text): a row for each example and negative whose texts exist."""
    pos = texts.select(F.col("id").alias("positive_id"), F.col("text").alias("positive_text"))
    neg = texts.select("id", F.col("text").alias("negative_text"))
    return examples.select("query_id", "positive_id").join(pos, "positive_id").join(negatives.select("query_id", "id"), "query_id").join(neg, "id").select("query_id", "positive_text", "negative_text")


def pairs(examples: DataFrame, family: DataFrame, retriever: DataFrame, most_family: int = 4, most_retriever: int = 6, random: DataFrame | None = None, most_random: int = 2) -> DataFrame:
    """(query_id, id, label, kind): the positive, and bounded numbers of each kind of negatives (query_id, id, place)."""
    pos = examples.select("query_id", F.col("positive_id").alias("id"), F.lit(1).alias("label"), F.lit("positive").alias("kind"))
    out = pos
    for rows, most, kind in ((family, most_family, "family"), (retriever, most_retriever, "retriever"), (random, most_random, "random")):
        if rows is not None:
            out = out.unionByName(rows.filter(F.col("place") <= most).select("query_id", "id", F.lit(0).alias("label"), F.lit(kind).alias("kind")))
    return out


def shuffled(rows: DataFrame, seed: int = SEED) -> DataFrame:
    """(query_id, id, place): rows (query_id, id) in an order drawn by hash for each query."""
    w = Window.partitionBy("query_id").orderBy(drawn(seed + 9, F.concat_ws("|", F.col("query_id").cast("string"), F.col("id").cast("string"))), "id")
    return rows.select("query_id", "id", F.row_number().over(w).alias("place"))


def random_negatives(examples: DataFrame, families: DataFrame, count: int = 2, seed: int = SEED) -> DataFrame:
    """(query_id, id, place): ``count`` passages of other families for each example, or all there are.

    Passages are numbered so that a family's numbers adjoin. What is left without the example's own family is cut into ``count``
    parts, and one number of each part is drawn, so every passage can be drawn and none twice. Numbers come from counts of digest
    prefixes and a rank within each, so no window holds all passages, families or a whole family.
    """
    rows = families.filter("family is not null").select("id", "family", drawn(seed + 1, F.col("id")).alias("_d")).withColumn("_s", F.substring("_d", 1, 3))
    parts = rows.groupBy("family", "_s").agg(F.count("*").alias("_c"))
    parts = parts.withColumn("_in", F.sum("_c").over(Window.partitionBy("family").orderBy("_s")) - F.col("_c"))
    sizes = parts.groupBy("family").agg(F.sum("_c").alias("_size")).withColumn("_b", F.substring(drawn(seed, F.col("family")), 1, 3))
    counts = sizes.groupBy("_b").agg(F.sum("_size").alias("_c"))
    before = counts.select("_b", (F.sum("_c").over(Window.orderBy("_b")) - F.col("_c")).alias("_before"))
    start = F.col("_before") + F.sum("_size").over(Window.partitionBy("_b").orderBy("family")) - F.col("_size")
    sizes = sizes.join(before, "_b").select("family", "_size", start.alias("_start"))
    rank = F.row_number().over(Window.partitionBy("family", "_s").orderBy("_d", "id"))
    pool = rows.join(parts, ["family", "_s"]).withColumn("_r", rank).join(sizes, "family").select("id", (F.col("_start") + F.col("_in") + F.col("_r") - 1).alias("_at"))
    whole = counts.agg(F.coalesce(F.sum("_c"), F.lit(0)).alias("_all"))
    own = examples.filter("family is not null").select("query_id", "family").distinct().join(sizes, "family", "left").crossJoin(F.broadcast(whole))  # whole is one row
    own = own.select("query_id", F.coalesce("_start", F.lit(0)).alias("_start"), F.coalesce("_size", F.lit(0)).alias("_size"), "_all").withColumn("_rest", F.col("_all") - F.col("_size"))
    far = lambda i: F.conv(F.substring(drawn(seed + 2 + i, F.col("query_id")), 1, 15), 16, 10).cast("long")
    edge = lambda i: F.floor(F.col("_rest") * i / count)
    draws = F.array(*(F.when(edge(i + 1) > edge(i), F.struct(F.lit(i).alias("i"), (edge(i) + far(i) % (edge(i + 1) - edge(i))).alias("r"))) for i in range(count)))
    asked = own.select("query_id", "_start", "_size", F.explode(draws).alias("d")).filter("d is not null")
    asked = asked.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("d.i")))
    at = F.col("d.r") + F.when(F.col("d.r") >= F.col("_start"), F.col("_size")).otherwise(F.lit(0))
    return asked.withColumn("_at", at).join(pool, "_at").select("query_id", "id", "place")


def pair_weights(labelled: DataFrame) -> DataFrame:
    """One row: positives, negatives and the weight of a positive (at least 1)."""
    row = labelled.agg(F.count_if(F.col("label") == 1).alias("positives"), F.count_if(F.col("label") == 0).alias("negatives"))
    return row.withColumn("pos_weight", F.greatest(F.lit(1.0), F.coalesce(F.try_divide("negatives", "positives"), F.lit(1.0))))


#: Share of an example's texts that may be missing before pairs are of no use.
MOST_MISSING = 0.5


def with_texts(labelled: DataFrame, texts: DataFrame, most_missing: float = MOST_MISSING) -> DataFrame:
    """Labelled pairs (query_id, id, label, ...) with the text of each id; pairs without one are left out, and too large a share of them is an error.

    The shares are counted in one pass before anything is returned.
    """
    met = labelled.join(texts.select("id", "text"), "id", "left")
    seen = met.agg(F.count("*").alias("all"), F.count_if(F.col("text").isNull()).alias("bare")).first()
    if seen["bare"] > most_missing * seen["all"]:
        raise ValueError(f"{seen['bare']} of {seen['all']} pairs have no text: the examples are of another corpus")
    return met.filter("text is not null")


def mined_shares(mined_rows: DataFrame, positives: DataFrame, documents: DataFrame) -> DataFrame:
    """One row: mined negatives, those of the positive's own document, and their share."""
    doc = lambda name, to: documents.select(F.col("id").alias(name), F.col("doc_path").alias(to))
    rows = mined_rows.join(positives, "query_id").join(doc("id", "_a"), "id", "left").join(doc("positive_id", "_b"), "positive_id", "left")
    return rows.agg(F.count("*").alias("negatives"), F.count_if(F.col("_a") == F.col("_b")).alias("same_document")).withColumn("share", F.round(F.try_divide("same_document", "negatives"), 6))


def evaluation_documents(examples: DataFrame, negatives: DataFrame) -> DataFrame:
    """Distinct ids of positives and negatives."""
    return examples.select(F.col("positive_id").alias("id")).unionByName(negatives.select("id")).distinct()
