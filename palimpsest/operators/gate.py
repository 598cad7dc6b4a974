"""Checks of a run's metrics against recorded ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOLERANCE, MIGRATION_TOLERANCE = 0.01, 0.005


def regressions(baseline: DataFrame, current: DataFrame, tolerance: float = TOLERANCE, allow_degraded: bool = False) -> DataFrame:
    """(config, metric, expected, actual, reason) of what fails: values below expected - tolerance, missing metrics, each missing
    configuration once (metric "*"), and each configuration whose run is ``degraded`` (a column of current, if it has one) once. What
    only the current run has is ignored but for that."""
    have = current.select("config").distinct().withColumn("_run", F.lit(True))
    rows = baseline.withColumnRenamed("value", "expected").join(have, "config", "left").join(current.select("config", "metric", F.col("value").alias("actual")), ["config", "metric"], "left")
    reason = F.when(F.col("_run").isNull(), "missing config").when(F.col("actual").isNull(), "missing metric").when(F.col("actual") < F.col("expected") - tolerance, "regression")
    rows = rows.withColumn("reason", reason).filter("reason is not null")
    none = F.lit(None).cast("double")
    whole = lambda df, why: df.select("config").distinct().select("config", F.lit("*").alias("metric"), none.alias("expected"), none.alias("actual"), F.lit(why).alias("reason"))
    out = rows.filter("reason <> 'missing config'").select("config", "metric", "expected", "actual", "reason").unionByName(whole(rows.filter("reason = 'missing config'"), "missing config"))
    if "degraded" in current.columns and not allow_degraded:
        out = out.unionByName(whole(current.filter("degraded"), "degraded"))
    return out


def first_baseline(current: DataFrame) -> DataFrame:
    """The baseline to record where there is none yet: the run's values, without degraded configurations."""
    rows = current.filter(~F.coalesce("degraded", F.lit(False))) if "degraded" in current.columns else current
    return rows.select("config", "metric", "value")


def migration(metrics: DataFrame, incumbent: str, candidate: str, metric: str = "ndcg_at_10", tolerance: float = MIGRATION_TOLERANCE) -> DataFrame:
    """One row: both values of the metric and whether the candidate may be promoted."""
    value = lambda c: F.max(F.when((F.col("config") == c) & (F.col("metric") == metric), F.col("value")))
    row = metrics.agg(value(incumbent).alias("incumbent"), value(candidate).alias("candidate"))
    return row.withColumn("promote", F.coalesce(F.col("candidate") >= F.col("incumbent") - tolerance, F.lit(False)))
