"""Joins of points with long intervals, and of intervals with each other, as equi-joins.

A level's blocks are 4**level points long and lie on multiples of that. An interval takes the lowest level at which it touches at most BLOCKS blocks, and
is listed under each of them, so it has two to eight rows however long it is. A point is listed once for each level that any interval
takes, which is one where intervals are of one length. Rows meet on (keys, level, block); the bounds then decide at an interval's two end blocks. A point
has one block a level, so every pair comes once. Rows shuffled stay near the input's, there is no version-by-version listing
(ranges.expanded) and no nested loop. Timestamps go in as microseconds.

Bounds are inclusive. Intervals with a null bound, or that end before they begin, hold nothing; null points lie in none; null keys match none. Values must lie
within 2**59 of zero. Repeated rows pair each time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Blocks that an interval touches at most, and levels.
BLOCKS, LEVELS = 8, 32


def stabbing_join(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, low: str, high: str) -> DataFrame:
    """Points with the intervals of the same keys that hold them: all columns of both, keys once. Other column names must differ."""
    whole = intervals.filter(F.col(low) <= F.col(high)).withColumns({"_lo": F.col(low).cast("long"), "_hi": F.col(high).cast("long")})
    level = F.expr(f"array_min(filter(sequence(0, {LEVELS - 1}), i -> shiftright(_hi, 2 * i) - shiftright(_lo, 2 * i) < {BLOCKS}))")
    listed = whole.withColumn("_level", level).withColumn("_block", F.explode(F.expr("sequence(shiftright(_lo, 2 * _level), shiftright(_hi, 2 * _level))")))
    levels = sorted(r[0] for r in whole.select(level.alias("l")).distinct().collect())  # LEVELS at most
    place = F.array(*(F.lit(i) for i in levels)) if levels else F.array().cast("array<int>")
    asked = points.withColumn("_at", F.col(at).cast("long")).withColumn("_level", F.explode(place)).withColumn("_block", F.expr("shiftright(_at, 2 * _level)"))
    met = asked.join(listed, [*keys, "_level", "_block"]).filter(F.col("_at").between(F.col("_lo"), F.col("_hi")))
    return met.drop("_level", "_block", "_at", "_lo", "_hi")


def overlapping(a: DataFrame, b: DataFrame, keys: list[str], id_: str, low: str, high: str) -> DataFrame:
    """(keys, a_<id>, b_<id>) of the intervals that share a point: b begins inside a, or a begins inside b after it."""
    bounds = lambda df, side: df.filter(F.col(low) <= F.col(high)).select(*keys, F.col(id_).alias(f"{side}_{id_}"), F.col(low).alias(f"{side}_low"), F.col(high).alias(f"{side}_high"))
    left, right = bounds(a, "a"), bounds(b, "b")
    one = stabbing_join(right, left, keys, "b_low", "a_low", "a_high")
    two = stabbing_join(left, right, keys, "a_low", "b_low", "b_high").filter("a_low > b_low")
    names = [*keys, f"a_{id_}", f"b_{id_}"]
    return one.select(*names).unionByName(two.select(*names))


def overlap_pairs(rows: DataFrame, keys: list[str], id_: str, low: str, high: str) -> DataFrame:
    """(keys, pairs): how many pairs of different ids share a point, where any do. No pair is made: of all pairs of a key those are taken off of which
    one ends before the other begins, which a running count of the ends tells, and those of equal ids."""
    whole = rows.filter(F.col(low) <= F.col(high)).dropna(subset=keys).select(*keys, F.col(id_).alias("_id"), F.col(low).alias("_low"), F.col(high).alias("_high"))

    def counted(df: DataFrame, by: list[str]) -> DataFrame:
        points = df.select(*by, F.inline(F.array(F.struct(F.col("_low").alias("_at"), F.lit(0).alias("_end")), F.struct(F.col("_high").alias("_at"), F.lit(1).alias("_end")))))
        over = F.sum("_end").over(Window.partitionBy(*by).orderBy("_at", "_end").rowsBetween(Window.unboundedPreceding, Window.currentRow))  # a start before an end at the same point
        return points.withColumn("_over", over).groupBy(*by).agg(F.expr("sum(_end) * (sum(_end) - 1) div 2 - coalesce(sum(_over) filter (where _end = 0), 0)").alias("pairs"))

    several = whole.groupBy(*keys, "_id").agg(F.count("*").alias("_c")).filter("_c > 1").select(*keys, "_id")
    same = counted(whole.join(several, [*keys, "_id"]), [*keys, "_id"]).groupBy(*keys).agg(F.sum("pairs").alias("_same"))
    out = counted(whole, keys).join(same, keys, "left")
    return out.select(*keys, (F.col("pairs") - F.coalesce("_same", F.lit(0))).alias("pairs")).filter("pairs > 0")
