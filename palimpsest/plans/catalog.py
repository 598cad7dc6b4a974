"""Registry of named queries: a function of (spark, folder) and, where SQL can express it, the SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


# Views over the tables: documents with versions and families are made of what the tables hold.

OBS = "obs AS (SELECT DISTINCT user_id AS family, CAST(day(ts) AS INTEGER) AS version, event_type AS content FROM events)"
OBS1 = "obs1 AS (SELECT user_id AS family, CAST(day(ts) AS INTEGER) AS version, arg_max(event_type, event_id) AS content FROM events GROUP BY 1, 2)"
SNAP = OBS1 + """, isl AS (SELECT family, content, version, version - row_number() OVER (PARTITION BY family, content ORDER BY version) AS g FROM obs1),
snap AS (SELECT family, content, CAST(min(version) AS INTEGER) AS version_low, CAST(max(version) AS INTEGER) AS version_high,
  substr(sha256(family || chr(31) || content || chr(31) || min(version)), 1, 16) AS chunk_id FROM isl GROUP BY family, content, g)"""
VEC = "vec AS (SELECT vec_id, embedding, CAST(label AS BIGINT) AS family, CAST(vec_id % 6 + 1 AS INTEGER) AS version_low, CAST(vec_id % 6 + 1 + label % 6 AS INTEGER) AS version_high FROM embeddings)"
VQ = VEC + ", vq AS (SELECT vec_id AS query_id, embedding, family, version_low, version_high, CAST((vec_id // 50) % 12 + 1 AS INTEGER) AS version FROM vec WHERE vec_id % 50 = 0)"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def observations(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(F.col("user_id").alias("family"), F.dayofmonth("ts").alias("version"), F.col("event_type").alias("content")).distinct()


def settled(spark: SparkSession, folder: str) -> DataFrame:
    """One content a family and version: the last event's."""
    e = table(spark, folder, "events")
    return e.groupBy(F.col("user_id").alias("family"), F.dayofmonth("ts").alias("version")).agg(F.max_by("event_type", "event_id").alias("content"))


def snapshots(spark: SparkSession, folder: str) -> DataFrame:
    from ..functions.text import stable_id
    from ..operators.ranges import islands

    out = islands(settled(spark, folder), ["family", "content"])
    return out.withColumn("chunk_id", stable_id(F.col("family"), F.col("content"), F.col("version_low")))


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    low = (F.col("vec_id") % 6 + 1).cast("int")
    return table(spark, folder, "embeddings").select("vec_id", "embedding", F.col("label").cast("long").alias("family"), low.alias("version_low"), (low + F.col("label") % 6).cast("int").alias("version_high"))


def vector_queries(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector whose id is divisible by 50, each asking about one version."""
    v = vectors(spark, folder).filter("vec_id % 50 = 0")
    return v.select(F.col("vec_id").alias("query_id"), "embedding", "family", "version_low", "version_high", (F.expr("(vec_id div 50) % 12") + 1).cast("int").alias("version"))


def literal(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)
