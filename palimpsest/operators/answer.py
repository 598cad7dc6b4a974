"""What surrounds an answer: context blocks, the choice to answer or refuse, checks of its marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLOOR = 0.35


def context(hits: DataFrame, qid: str, heading: Column, text: Column) -> DataFrame:
    """(qid, context): numbered blocks of each query's hits in rank order. The number of hits a query is bounded by its ranking."""
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), heading, F.lit("\n"), text)
    listed = F.array_sort(F.collect_list(F.struct("rank", block.alias("b"))))
    return hits.groupBy(qid).agg(F.array_join(F.transform(listed, lambda s: s["b"]), "\n\n---\n\n").alias("context"))


def decision(queries: DataFrame, hits: DataFrame, qid: str, floor: float = FLOOR) -> DataFrame:
    """(qid, best, decision): no_results, low_confidence or answered, by the best score."""
    best = hits.groupBy(qid).agg(F.max("score").alias("best"))
    out = queries.select(qid).join(best, qid, "left")
    return out.withColumn("decision", F.when(F.col("best").isNull(), "no_results").when(F.col("best") < floor, "low_confidence").otherwise("answered"))


def outcome(decided: DataFrame, answers: DataFrame, qid: str) -> DataFrame:
    """decided with what became of each query: its decision, or model_declined where an answer was asked for and the model (qid, stop_reason)
    stopped by refusing."""
    refused = answers.filter("stop_reason = 'refusal'").select(qid, F.lit(True).alias("_refused")).distinct()
    out = decided.join(refused, qid, "left")
    return out.withColumn("decision", F.when((F.col("decision") == "answered") & F.col("_refused"), "model_declined").otherwise(F.col("decision"))).drop("_refused")


def scale_warning(decided: DataFrame, floor: float = FLOOR) -> DataFrame:
    """One row: whether the scores look as if they were on another scale than the floor (logits under a cosine floor, or the reverse)."""
    row = decided.agg(F.min("best").alias("least"), F.max("best").alias("most"))
    return row.withColumn("suspicious", F.coalesce((F.lit(0 < floor <= 1) & ((F.col("most") > 1) | (F.col("least") < -1))) | (F.lit(not 0 < floor <= 1) & (F.abs("most") <= 1) & (F.abs("least") <= 1)), F.lit(False)))


def accepted_requests(requests: DataFrame, question: str = "question", top_k: str = "top_k", most: int = 20) -> DataFrame:
    """Requests with 3 to 2000 code points and 1..most hits asked for."""
    return requests.filter(F.length(question).between(3, 2000) & F.col(top_k).between(1, most))
