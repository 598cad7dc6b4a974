"""A query on the trained encoder; no SQL can fit one, so tests hold it to brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators import dense, encoder
from ..sources import scratch
from .catalog import query, table

#: Documents of the sample that questions meet first, about.
SAMPLE = 16_384


def _halves(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the buckets of the terms at odd places, which ask, and of those at even places, which answer. Written once: terms are dear, and
    training, both encodings and the count of questions read them."""
    buckets = encoder.bucketed(fn.terms(F.col("text")), encoder.Settings().buckets)
    docs = table(spark, d, "documents").filter("text is not null").select("doc_id", F.sha2("text", 256).alias("same"), buckets.alias("t"))
    place = lambda odd: F.filter("t", lambda x, i: i % 2 == odd)
    where = scratch.folder(spark, "encoder-halves")
    docs.select("doc_id", "same", place(1).alias("q"), place(0).alias("p")).write.parquet(f"{where}/halves")
    return spark.read.parquet(f"{where}/halves")


def _written(df: DataFrame, name: str) -> DataFrame:
    """A small part of the documents, so that not all are read for it again."""
    where = scratch.folder(df.sparkSession, f"encoder-{name}")
    df.write.parquet(where)
    return df.sparkSession.read.parquet(where)


@query()
def encoder_recall(spark: SparkSession, d: str) -> DataFrame:
    """(config, questions, recall_at_1, recall_at_10, mrr_at_10) of the untrained and the trained encoder: one half of a document finds its other
    half among those of all documents. Every document whose id is divisible by 50 asks; the others, but copies of these, train.

    A question that ten documents of a sample beat has no rank up to 10; only the others are searched for among all."""
    halves = _halves(spark, d)
    asks = F.col("doc_id") % 50 == 0
    asked = _written(halves.filter(asks & F.expr("size(q) > 0 and size(p) > 0")), "asked")
    parts = -(-halves.count() // SAMPLE)
    some = _written(halves.filter(F.col("doc_id").isNotNull() & (F.pmod(F.xxhash64("doc_id"), F.lit(parts)) == 0)).limit(2 * SAMPLE).select("p"), "sample")
    tables = []
    training = halves.filter("doc_id is not null")
    for config, made in (("base", encoder.untrained()), ("tuned", encoder.trained(training, F.col("q"), F.col("p"), ready=True, text=F.col("same"), held=asks))):
        q = made.encoded(made.encoded(asked.select(F.col("doc_id").alias("query_id"), "q", "p"), F.col("q"), ready=True), F.col("p"), "own", ready=True).select("query_id", "embedding", "own", F.lit(1).alias("version"))
        q = dense.in_reach(q, "own", made.encoded(some, F.col("p"), ready=True), 10)
        p = made.encoded(halves.select(F.col("doc_id").alias("vec_id"), "p"), F.col("p"), ready=True).select("vec_id", "embedding", F.lit(1).alias("version_low"), F.lit(1).alias("version_high"))
        own = dense.top_k(q, p, 10, False).filter("query_id = vec_id").select("query_id", "rank")
        at = lambda k: F.round(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), 4)
        scored = asked.select(F.col("doc_id").alias("query_id")).join(own, "query_id", "left")
        tables.append(scored.agg(F.lit(config).alias("config"), F.count("*").alias("questions"), at(1).alias("recall_at_1"), at(10).alias("recall_at_10"), F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 4).alias("mrr_at_10")))
    return tables[0].unionByName(tables[1])
