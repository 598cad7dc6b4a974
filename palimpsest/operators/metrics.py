"""Metrics of rankings. Input is rows only: queries (query_id, positive_id, source, version) and hits (query_id, id, rank, and the
range version_low..version_high of the hit). Queries without hits count as zeros; queries without an answer don't count (evaluable).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CUTS = (1, 5, 10, 20)


def evaluable(queries: DataFrame, passages: DataFrame, id_: str) -> DataFrame:
    """The queries that count: with an answer (``unanswerable`` is no column, null or false) and a positive that passages have."""
    if "unanswerable" in queries.columns:
        queries = queries.filter(~F.coalesce("unanswerable", F.lit(False)))
    return queries.join(passages.select(F.col(id_).alias("positive_id")), "positive_id", "left_semi")


def skipped(queries: DataFrame, passages: DataFrame, id_: str) -> DataFrame:
    """One row: questions, and how many of them evaluable() leaves out as unanswerable or for want of a positive."""
    unanswerable = F.coalesce("unanswerable", F.lit(False)) if "unanswerable" in queries.columns else F.lit(False)
    known = passages.select(F.col(id_).alias("positive_id"), F.lit(1).alias("_there")).distinct()
    rows = queries.withColumn("_un", unanswerable).join(known, "positive_id", "left")
    return rows.agg(F.count("*").alias("questions"), F.count_if("_un").alias("unanswerable"), F.count_if(~F.col("_un") & F.col("_there").isNull()).alias("without_positive"))


def judged(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """A row for each query and hit (or one without a rank), with ``match`` and ``correct``."""
    q = queries.select("query_id", "positive_id", "source", "version")
    h = hits.select("query_id", F.col("id").alias("_id"), "rank", "version_low", "version_high")
    return q.join(h, "query_id", "left").withColumns(
        {"match": F.coalesce(F.col("_id") == F.col("positive_id"), F.lit(False)), "correct": F.coalesce(F.col("version").between(F.col("version_low"), F.col("version_high")), F.lit(False))}
    )


def hit_at(k: int) -> Column:
    return F.max(F.when(F.col("match") & (F.col("rank") <= k), 1.0).otherwise(0.0))


def reciprocal_rank(k: int = 10) -> Column:
    return F.coalesce(1.0 / F.min(F.when(F.col("match") & (F.col("rank") <= k), F.col("rank"))), F.lit(0.0))


def ndcg(k: int = 10) -> Column:
    """With one relevant passage a query, whose ideal gain is 1."""
    return F.sum(F.when(F.col("match") & (F.col("rank") <= k), 1.0 / F.log2(F.col("rank") + 1.0)).otherwise(0.0))


def version_correct(k: int) -> Column:
    """Share of the hits actually among the first k whose range covers the query's version; 0 without hits."""
    return F.coalesce(F.avg(F.when(F.col("rank") <= k, F.col("correct").cast("double"))), F.lit(0.0))


def recall_at(k: int) -> Column:
    """Relevant ones found among the first k over the most that could be; ``relevant`` is their number."""
    return F.coalesce(F.try_divide(F.sum(F.when(F.col("match") & (F.col("rank") <= k), 1.0).otherwise(0.0)), F.least(F.max("relevant"), F.lit(k))), F.lit(0.0))


def per_query(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """query_id, source, recall_at_1/5/10/20, mrr_at_10, ndcg_at_10, version_correct_at_1/5."""
    columns = [hit_at(k).alias(f"recall_at_{k}") for k in CUTS] + [reciprocal_rank().alias("mrr_at_10"), ndcg().alias("ndcg_at_10"), version_correct(1).alias("version_correct_at_1"), version_correct(5).alias("version_correct_at_5")]
    return judged(queries, hits).groupBy("query_id", "source").agg(*columns)


NAMES = [f"recall_at_{k}" for k in CUTS] + ["mrr_at_10", "ndcg_at_10", "version_correct_at_1", "version_correct_at_5"]


def summarised(per: DataFrame) -> DataFrame:
    """Means over all queries (source "all") and over each non-empty source, from one pass by grouping sets."""
    per = per.withColumn("source", F.coalesce("source", F.lit("")))
    columns = [F.count("*").alias("n"), *(F.round(F.avg(m), 6).alias(m) for m in NAMES)]
    out = per.groupingSets([["source"], []], "source").agg(F.grouping("source").alias("_all"), *columns)
    return out.filter("_all = 1 or source <> ''").withColumn("source", F.when(F.col("_all") == 1, "all").otherwise(F.col("source"))).drop("_all")


def long(summary: DataFrame, config: str) -> DataFrame:
    """(config, source, metric, value)."""
    return summary.unpivot(["source"], NAMES, "metric", "value").select(F.lit(config).alias("config"), "source", "metric", "value")


def best(table: DataFrame, by: list[str]) -> DataFrame:
    """Marks the best values of each metric, when there is more than one row."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(*by)
    return table.withColumn("best", (F.count("*").over(w) > 1) & (F.col("value") >= F.max("value").over(w) - 1e-9))


def markdown(rows: list[dict], names: list[str]) -> str:
    """A Markdown table of rows (config and metrics), the best of a column in bold if there are several rows."""
    most = {n: max((r[n] for r in rows if r.get(n) is not None), default=None) for n in names}

    def cell(r: dict, n: str) -> str:
        v = r.get(n)
        if v is None:
            return "-"
        return f"**{v:.3f}**" if len(rows) > 1 and v >= most[n] - 1e-9 else f"{v:.3f}"

    lines = ["| config | " + " | ".join(names) + " |", "|---|" + "---:|" * len(names)]
    return "\n".join(lines + [f"| {r['config']} | " + " | ".join(cell(r, n) for n in names) + " |" for r in rows])
