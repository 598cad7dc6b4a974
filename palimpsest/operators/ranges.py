"""Relational operators on validity ranges.

Range predicates are turned into equi-joins by listing the versions of a range (a release window is short), so that they run as
hash or sort-merge joins on (key, version) instead of nested loops.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def islands(observed: DataFrame, keys: list[str], version: str = "version") -> DataFrame:
    """Maximal runs of consecutive versions for each key: keys, version_low, version_high. Repeats count once."""
    order = Window.partitionBy(*keys).orderBy(version)
    runs = observed.select(*keys, version).distinct().withColumn("_run", F.col(version) - F.row_number().over(order))
    return runs.groupBy(*keys, "_run").agg(F.min(version).alias("version_low"), F.max(version).alias("version_high")).drop("_run")


def coalesced(observed: DataFrame, keys: list[str], payload: list[str], version: str = "version") -> DataFrame:
    """islands() with the payload of the earliest observation of each run."""
    order = Window.partitionBy(*keys).orderBy(version)
    first = observed.groupBy(*keys, version).agg(F.min(F.struct(*payload)).alias("_p"))
    runs = first.withColumn("_run", F.col(version) - F.row_number().over(order))
    out = runs.groupBy(*keys, "_run").agg(F.min(version).alias("version_low"), F.max(version).alias("version_high"), F.min_by("_p", version).alias("_p"))
    return out.select(*keys, "version_low", "version_high", "_p.*")


def overlap_count(ranges: DataFrame, family: str) -> DataFrame:
    """How many ranges of each family start before the one before them ends."""
    order = Window.partitionBy(family).orderBy("version_low", "version_high")
    late = F.lag("version_high").over(order) >= F.col("version_low")
    return ranges.withColumn("_late", F.coalesce(late.cast("int"), F.lit(0))).groupBy(family).agg(F.sum("_late").alias("overlaps"))


def expanded(ranges: DataFrame, low: str = "version_low", high: str = "version_high", to: str = "version") -> DataFrame:
    """A row for each version of each range; inverted ranges have none."""
    return ranges.filter(F.col(low) <= F.col(high)).withColumn(to, F.explode(F.sequence(low, high)))


def range_join(points: DataFrame, ranges: DataFrame, keys: list[str], version: str = "version") -> DataFrame:
    """Points with the ranges that cover them, as a hash join on (keys, version)."""
    return points.join(expanded(ranges, to=version), [*keys, version])


def overlap_join(a: DataFrame, b: DataFrame, key: str, by: list[str] | None = None) -> DataFrame:
    """Pairs (a_<key>, b_<key>) of ranges that share a version (and are equal in ``by``).

    Either b starts inside a, or a starts inside b after b's start, so both halves are hash joins on (by, version).
    """
    by = by or []
    left = a.select(*by, F.col(key).alias(f"a_{key}"), F.col("version_low").alias("a_low"), F.col("version_high").alias("a_high"))
    right = b.select(*by, F.col(key).alias(f"b_{key}"), F.col("version_low").alias("b_low"), F.col("version_high").alias("b_high"))
    one = expanded(left, "a_low", "a_high", "_v").join(right.filter("b_low <= b_high").withColumn("_v", F.col("b_low")), [*by, "_v"])
    two = expanded(right, "b_low", "b_high", "_v").join(left.filter("a_low <= a_high").withColumn("_v", F.col("a_low")), [*by, "_v"]).filter("a_low > b_low")
    return one.select(f"a_{key}", f"b_{key}").unionByName(two.select(f"a_{key}", f"b_{key}"))


def covering(points: DataFrame, ranges: DataFrame, family: str, version: str = "version") -> DataFrame:
    """The range of the family that covers each point, the earliest if several do."""
    first = Window.partitionBy(family, version).orderBy("version_low", "version_high")
    return range_join(points, ranges, [family], version).withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def same_family_outside(points: DataFrame, ranges: DataFrame, family: str, id_: str, version: str = "version") -> DataFrame:
    """Other members of each point's family that don't cover its version: (id_, version, other)."""
    others = ranges.select(F.col(family).alias("_f"), F.col(id_).alias("other"), F.col("version_low").alias("_l"), F.col("version_high").alias("_h"))
    on = (points[family] == others["_f"]) & (points[id_] != others["other"]) & ~F.col(version).between(F.col("_l"), F.col("_h"))
    return points.join(others, on).select(id_, version, "other")


def as_of(rows: DataFrame, keys: list[str], order: list[str], mark: str, value: str, out: str) -> DataFrame:
    """rows with the value of the last row at or before them for which ``mark`` holds (a boolean column)."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(out, F.last(F.when(F.col(mark), F.col(value)), ignorenulls=True).over(w))
