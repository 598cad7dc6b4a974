"""From ingested passages to split examples, mined negatives and an evaluation: what the command line runs, over folders.

OUT/chunks and OUT/facts come from ingestion. build() writes OUT/examples and OUT/splits/<split>; mine() writes the splits' examples with hard
negatives of other families as OUT/mined/<split>; evaluate() scores lexical retrieval, with and without the version filter, on a split and writes
OUT/results. Learned retrievers plug in through retrieval.Pipeline and take the same questions().
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import Settings
from ..functions import text as fn
from ..functions import versions as vs
from ..sources import files
from . import bm25, datasets, examples, metrics
from .ranges import expanded

#: Fixed value: the end of the path of the document that lists removals.
GUIDE = "deprecation-guide.md"
SPLITS = ("train", "dev", "test")
#: Questions that documentation of this kind can't answer, and how many are drawn.
BEYOND = ("What will be announced at the next conference after {version}?", "Which employer has the most maintainers of {version}?", "How much does support of {version} cost a month?", "Who should I hire to operate {version}?", "Is {version} more popular than its competitors?")
BEYOND_COUNT = 60


def _passages(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(f"{out}/chunks").withColumnRenamed("family_id", "family")


def build(spark: SparkSession, out: str, settings: Settings, guide: str = GUIDE) -> DataFrame:
    """Writes all kinds of examples, whole and by split, and returns how many each kind gave (source, examples)."""
    passages = _passages(spark, out)
    versions = spark.createDataFrame([(v,) for v in settings.versions], "version int")
    order = Window.orderBy("heading_path", "part", "version_low", "chunk_id")  # of one document
    own = passages.filter(F.col("doc_path").endswith(guide)).withColumn("seq", F.row_number().over(order))
    own = own.withColumn("text", F.concat(F.array_join("heading_path", " > "), F.lit("\n"), "text"))  # mentions count in the breadcrumb too
    known = spark.read.parquet(f"{out}/facts").withColumn("removed", vs.parse(F.col("removed_in"))["minor"])
    every, edge = examples.removals(known, own, passages, versions, settings.seed)
    sections = examples.changed(passages.withColumn("topic", fn.topic(F.col("heading_path"))), settings.seed)
    templates = spark.createDataFrame(list(enumerate(BEYOND)), "template_id int, template string")
    parts = [every, edge, sections, examples.unanswerable(templates, versions, BEYOND_COUNT, settings.seed)]
    made = examples.assembled(parts, settings.seed)
    files.write_examples(made, f"{out}/examples")
    split = datasets.split_examples(made, seed=settings.seed).persist()
    for name in SPLITS:
        files.write_examples(split.filter(F.col("split") == name), f"{out}/splits/{name}")
    leaked = datasets.leaks(split.filter("family <> ''"), "family").count()
    split.unpersist()
    if leaked:
        raise RuntimeError(f"{leaked} families are in several splits")
    return examples.build_stats(parts)


def questions(spark: SparkSession, out: str, split: str) -> DataFrame:
    """(query_id, question, version, positive_id, source, unanswerable) of a split."""
    rows = files.read_examples(spark, f"{out}/splits/{split}")
    key = F.substring(F.sha2(F.concat_ws("\x1f", "question", "target_version"), 256), 1, 16)
    return rows.select(key.alias("query_id"), "question", vs.parse(F.col("target_version"))["minor"].alias("version"), F.col("positive_chunk_id").alias("positive_id"), "source", "unanswerable")


def lexical(asked: DataFrame, passages: DataFrame, k: int, filtered: bool) -> DataFrame:
    """(query_id, id, score, rank): the k best passages, of those that cover the question's version if filtered."""
    found = bm25.scores(asked, passages, "query_id", fn.terms(F.col("question")), "chunk_id", fn.terms(F.col("text")))
    pool = expanded(passages.select("chunk_id", "version_low", "version_high")) if filtered else passages
    hits = bm25.top_k(found, asked, pool, "query_id", "chunk_id", k, "version" if filtered else None)
    return hits.select("query_id", F.col("chunk_id").alias("id"), "score", "rank")


def mine(spark: SparkSession, out: str, split: str) -> DataFrame:
    """Writes OUT/mined/<split> (question, positive_id, negatives) and returns one row: mined negatives, those of the positive's own document, share."""
    passages = _passages(spark, out)
    asked = questions(spark, out, split).filter("not unanswerable")
    families = passages.select(F.col("chunk_id").alias("id"), "family")
    rows = datasets.mined(lexical(asked, passages, datasets.MINED_FROM, True), asked.select("query_id", "positive_id"), families).persist()
    listed = rows.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda s: s["id"]).alias("negatives"))  # datasets.MINED at most
    none = F.array().cast("array<string>")
    asked.join(listed, "query_id", "left").select("question", "version", "positive_id", F.coalesce("negatives", none).alias("negatives")).write.mode("overwrite").json(f"{out}/mined/{split}")
    shares = datasets.mined_shares(rows, asked.select("query_id", "positive_id"), passages.select(F.col("chunk_id").alias("id"), "doc_path"))
    found = shares.collect()  # one row
    rows.unpersist()
    return spark.createDataFrame(found, shares.schema)


def evaluate(spark: SparkSession, out: str, split: str, k: int = 20) -> DataFrame:
    """Writes and returns (config, source, metric, value, degraded) of the two lexical configurations on a split's answerable questions."""
    passages = _passages(spark, out)
    asked = metrics.evaluable(questions(spark, out, split), passages, "chunk_id")
    ranges = passages.select(F.col("chunk_id").alias("id"), "version_low", "version_high")
    tables = []
    for config, filtered in (("bm25", False), ("bm25-filtered", True)):
        hits = lexical(asked, passages, k, filtered).join(ranges, "id")
        tables.append(metrics.long(metrics.summarised(metrics.per_query(asked, hits)), config))
    files.write_results(tables[0].unionByName(tables[1]), f"{out}/results", split)
    return files.read_results(spark, f"{out}/results").filter(F.col("split") == split).drop("split")
