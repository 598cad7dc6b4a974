"""Queries of what is kept up to date: streamed ranges, versioned tables, ordered digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import corpus, intervals
from ..sources import scratch
from ..sources.snapshots import Snapshots
from ..streaming import ingest
from .catalog import OBS, query, table

#: Deliveries in which observations arrive.
DELIVERIES = 3


@query(f"WITH {OBS}, g AS (SELECT *, version - row_number() OVER (PARTITION BY family, content ORDER BY version) AS g FROM obs) SELECT family, content, min(version) AS version_low, max(version) AS version_high FROM g GROUP BY family, content, g")
def streamed_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Ranges of all events' observations, folded by the stream from deliveries in no order."""
    where = scratch.folder(spark, "streamed")
    seen = table(spark, d, "events").select(F.col("user_id").cast("long").alias("family"), F.col("event_type").alias("content"), F.dayofmonth("ts").alias("version"), F.lit(None).cast("string").alias("payload"))
    seen.repartition(DELIVERIES, F.xxhash64("family", "version", F.lit(7))).write.parquet(f"{where}/in")
    ingest.start(spark, f"{where}/in", f"{where}/ranges", f"{where}/checkpoint", files_a_batch=1).awaitTermination()
    return ingest.current(spark, f"{where}/ranges").drop("payload")


@query("""SELECT doc_id, 'old' AS origin, CAST(n_chars AS INTEGER) AS value FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT doc_id, 'new' AS origin, CAST(quality AS INTEGER) AS value FROM labels WHERE NOT (quality = 0 AND doc_id NOT IN (SELECT doc_id FROM documents))""")
def snapshot_merge(spark: SparkSession, d: str) -> DataFrame:
    """Documents as a versioned table, into which the labels are merged by document; labels of no document that say 0 are left out."""
    where = Snapshots(spark, scratch.folder(spark, "merged"), "doc_id", 16)
    old = table(spark, d, "documents").select("doc_id", F.lit("old").alias("origin"), F.col("n_chars").cast("int").alias("value"))
    where.replace(old)
    new = table(spark, d, "labels").select("doc_id", F.lit("new").alias("origin"), F.col("quality").cast("int").alias("value"))
    stray = new.filter("value = 0").join(old, "doc_id", "left_anti")
    where.merge(new.join(stray, "doc_id", "left_anti"), stray.select("doc_id"))
    return where.rows()


def _horner(part: str) -> str:
    return f"CAST(list_reduce(list_prepend(0::HUGEINT, list({part} ORDER BY label, vec_id)), lambda d, x: (d * {corpus.RADIX} + x) % {corpus.PRIME}) AS BIGINT)"


@query(f"""WITH h AS (SELECT label, vec_id, sha256(CAST(vec_id AS VARCHAR)) AS h FROM embeddings),
x AS (SELECT label, vec_id, CAST('0x' || substr(h, 1, 15) AS HUGEINT) AS a, CAST('0x' || substr(h, 16, 15) AS HUGEINT) AS b FROM h)
SELECT count(*) AS n, {_horner('a')} AS d0, {_horner('b')} AS d1 FROM x""")
def ordered_digest(spark: SparkSession, d: str) -> DataFrame:
    """Digest of the vectors' ids in the order of label and id."""
    return corpus.ordered_digest(table(spark, d, "embeddings"), "vec_id", ["label", "vec_id"])


@query("""SELECT a.event_id, count(*) AS followed FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 36 HOUR GROUP BY a.event_id""")
def events_within(spark: SparkSession, d: str) -> DataFrame:
    """How many events of the same user follow each event within 36 hours, itself included: intervals of 129,600,000,001 microseconds."""
    e = table(spark, d, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    spans = e.select("user_id", "event_id", F.col("at").alias("low"), (F.col("at") + 36 * 3_600_000_000).alias("high"))
    return intervals.stabbing_join(e.select("user_id", "at"), spans, ["user_id"], "at", "low", "high").groupBy("event_id").agg(F.count("*").alias("followed"))


@query("""WITH s AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, epoch_us(CAST(l_shipdate AS TIMESTAMP)) AS low, epoch_us(CAST(l_shipdate AS TIMESTAMP)) + CAST(l_quantity AS BIGINT) * 3600000000 AS high FROM lineitem)
SELECT a.l_suppkey, count(*) AS pairs FROM s a JOIN s b ON a.l_suppkey = b.l_suppkey AND a.low <= b.high AND b.low <= a.high AND (a.l_orderkey, a.l_linenumber) < (b.l_orderkey, b.l_linenumber) GROUP BY a.l_suppkey""")
def shipments_at_once(spark: SparkSession, d: str) -> DataFrame:
    """How many pairs of a supplier's shipments are on the way at once, each for as many hours as its quantity."""
    low = F.unix_micros(F.col("l_shipdate").cast("timestamp"))
    spans = table(spark, d, "lineitem").select("l_suppkey", F.struct("l_orderkey", "l_linenumber").alias("line"), low.alias("low"), (low + F.col("l_quantity").cast("long") * 3_600_000_000).alias("high"))
    return intervals.overlap_pairs(spans, ["l_suppkey"], "line", "low", "high")
