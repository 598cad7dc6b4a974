"""Statistics and maintenance of a corpus of passages."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def members(ranges: DataFrame, family: str, id_: str) -> DataFrame:
    """Ids of each family by version_low, joined by commas."""
    listed = F.array_sort(F.collect_list(F.struct("version_low", F.col(id_).cast("string").alias("id"))))
    return ranges.groupBy(family).agg(F.array_join(F.transform(listed, lambda s: s["id"]), ",").alias("members"))


def stats(ranges: DataFrame, family: str, doc: str) -> DataFrame:
    """One row: passages, documents, families, families of several passages and their share."""
    per = ranges.groupBy(family).agg(F.count("*").alias("n"), F.collect_set(doc).alias("_docs"))
    docs = ranges.agg(F.count_distinct(doc).alias("docs"))
    out = per.agg(F.sum("n").alias("chunks"), F.count("*").alias("families"), F.count_if(F.col("n") > 1).alias("changed_families"))
    return out.crossJoin(docs).withColumn("changed_share", F.round(F.try_divide("changed_families", "families"), 6))  # both have one row


def positional(rows: DataFrame, value: str) -> DataFrame:
    """One row: the elements at n div 2 and at the whole part of 0.9 n of the sorted values, and the largest.

    Ranks come from counts of equal values, so the single-row window runs over distinct values only.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = counts.withColumn("_upto", upto).withColumn("_all", F.sum("_n").over(Window.partitionBy()))
    at = lambda place: F.min(F.when(F.col("_upto") > place, F.col(value)))
    return ranked.agg(at(F.floor(F.col("_all") / 2)).alias("p50"), at(F.floor(F.col("_all") * F.lit(0.9).cast("double"))).alias("p90"), F.max(value).alias("most"))


def span_histogram(ranges: DataFrame) -> DataFrame:
    return ranges.groupBy((F.col("version_high") - F.col("version_low") + 1).alias("span")).agg(F.count("*").alias("n"))


def ingest_summary(observed: DataFrame, ranges: DataFrame, family: str) -> DataFrame:
    """One row: observations, passages, their ratio and the number of changed families."""
    before, after = observed.agg(F.count("*").alias("observations")), ranges.agg(F.count("*").alias("chunks"))
    changed = ranges.groupBy(family).count().filter("count > 1").agg(F.count("*").alias("changed_families"))
    return before.crossJoin(after).crossJoin(changed).withColumn("ratio", F.round(F.try_divide("observations", "chunks"), 6))  # one row each


def first_wins(rows: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """The first row of each key by order."""
    w = Window.partitionBy("_key").orderBy(*order)
    return rows.withColumn("_key", key).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_key", "_n")


def upserted(old: DataFrame, new: DataFrame, id_: str) -> DataFrame:
    """old with the rows of new put in by id."""
    return new.unionByName(old.join(new.select(id_), id_, "left_anti"))


def digest(rows: DataFrame, id_: str) -> DataFrame:
    """One row: count and a digest of the set of ids.

    The ids' hashes are folded by addition of four 60-bit parts, which needs no order and no list of ids.
    """
    h = F.sha2(F.col(id_).cast("string"), 256)
    parts = [F.sum(F.conv(F.substring(h, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).alias(f"d{i}") for i in range(4)]
    return rows.agg(F.count("*").alias("n"), *parts).select("n", F.sha2(F.concat_ws("-", *(F.coalesce(F.col(f"d{i}").cast("string"), F.lit("0")) for i in range(4))), 256).alias("digest"))


#: Fixed values of the ordered digest: a Mersenne prime below 2^61 and a base below it.
PRIME, RADIX = (1 << 61) - 1, 1_099_511_628_211


def ordered_digest(rows: DataFrame, id_: str, order: list[str]) -> DataFrame:
    """One row: count and a digest of the ids in their order, as two numbers modulo a prime.

    Each id's hash is a digit of a number to the base RADIX, so swapping two ids changes it. Digests of neighbouring stretches combine as
    d * RADIX^m + e, where m ids follow: each task folds its sorted range, and ranges are put together in their order, so the result doesn't
    depend on how many there are. ``order`` must be total but for rows with equal ids. Null ids count as the empty text.
    """
    h = F.sha2(F.coalesce(F.col(id_).cast("string"), F.lit("")), 256)
    digits = [F.conv(F.substring(h, 1 + 15 * i, 15), 16, 10).cast("long").alias(f"h{i}") for i in range(2)]
    dealt = rows.select(*order, *digits).repartitionByRange(*order).sortWithinPartitions(*order)

    def fold(batches: Iterator) -> Iterator:
        import pyarrow as pa

        n, d, e, at = 0, 0, 0, None
        for batch in batches:
            for place, x, y in zip(*(batch.column(c).to_pylist() for c in ("at", "h0", "h1"))):
                n, d, e, at = n + 1, (d * RADIX + x) % PRIME, (e * RADIX + y) % PRIME, place
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in (at, n, d, e)], names=["at", "n", "d", "e"])

    parts = dealt.select(F.spark_partition_id().cast("long").alias("at"), "h0", "h1").mapInArrow(fold, "at long, n long, d long, e long")
    n, d, e = 0, 0, 0
    for r in parts.orderBy("at").collect():  # a row a partition
        lift = pow(RADIX, r["n"], PRIME)
        n, d, e = n + r["n"], (d * lift + r["d"]) % PRIME, (e * lift + r["e"]) % PRIME
    return rows.sparkSession.createDataFrame([(n, d, e)], "n long, d0 long, d1 long")


def vector_facts(rows: DataFrame, id_: str, order: list[str], vector: str, model: str, most_length: int) -> dict:
    """What a vector cache was made from: its manifest. Vectors of different lengths are an error."""
    sizes = rows.agg(F.min(F.size(vector)).alias("a"), F.max(F.size(vector)).alias("b")).first()
    if sizes["a"] != sizes["b"]:
        raise ValueError(f"vectors of {sizes['a']} to {sizes['b']} numbers")
    d = ordered_digest(rows, id_, order).first()
    return {"model": model, "max_length": most_length, "dimension": sizes["a"], "count": d["n"], "digest": f"{d['d0']:016x}{d['d1']:016x}"}


def missing(requested: DataFrame, present: DataFrame, key: str) -> DataFrame:
    return requested.join(present, key, "left_anti")
