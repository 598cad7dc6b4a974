"""Mixing sources to target weights by entropy balancing.

Among all rates r_d between 0 and ``MOST`` of the documents d of a source with sum r_d * size_d = target, the one nearest to
"each once" in relative entropy is r_d = min(MOST, exp(lambda * size_d / mean size)). The convex dual has one variable a source;
Newton steps, kept inside a shrinking bracket, solve all of them at once. A step sums over the table of (source, size, count),
which stands for the documents without loss, as rates depend on nothing else.

Rates become whole copies by systematic rounding: along the documents of a source, from long to short, the fractions are summed
as whole numbers and a document gets one more copy where the sum passes a whole. Sums run inside buckets of a bounded row count
and start from the buckets' prefix sums, so no source is one task. What is then left of the target goes to a few documents of
falling size, one for each power of two. Only DataFrame functions are used.

Sources go by code point with null last and weigh ``WEIGHTS`` in turn. Null and empty texts have size 0, rate 1 and take nothing.
Repeated rows are rows of their own. A source of size 0 has target 0. An empty table gives an empty result. Columns other than doc_id,
source and text are ignored, whatever their names (``mixed`` hands them on).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import joined_to_groups, shared_dir, written

MOST, WEIGHTS = 3.0, (1, 2, 3)
#: Rows that a bucket of the rounding holds on average at most; parts of a whole copy.
BUCKET_ROWS, PARTS = 4096, 1 << 30
STEPS, EXACT = 60, 1e-9


def source_key(source: Column) -> Column:
    """Text that sorts as the source by code point, null last, and joins null with null."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """(key, source_size, n, target) from (key, source_size, n), a row for each source.

    Sources whose share by weight would pass MOST times their size are the first ones by size per weight: each is compared with
    the share that remains after all before it are at their limit.
    """
    by_key = Window.orderBy("key")
    by_room = Window.orderBy("room", "key").rowsBetween(Window.unboundedPreceding, -1)
    weights = F.array(*(F.lit(float(w)) for w in WEIGHTS))
    t = sizes.withColumn("w", F.element_at(weights, ((F.row_number().over(by_key) - 1) % len(WEIGHTS) + 1).cast("int")))
    t = t.withColumn("room", MOST * F.col("source_size") / F.col("w"))
    whole = Window.partitionBy()
    left = F.sum("source_size").over(whole) - MOST * F.coalesce(F.sum("source_size").over(by_room), F.lit(0))
    t = t.withColumn("level", left / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(by_room), F.lit(0.0))))
    t = t.withColumn("free", F.col("room") >= F.col("level"))
    common = F.min_by(F.when(F.col("free"), F.col("level")), F.when(F.col("free"), F.struct("room", "key"))).over(whole)
    return t.select("key", "source_size", "n", F.when(F.col("free"), F.col("w") * common).otherwise(MOST * F.col("source_size")).alias("target"))


def tilts(histogram: DataFrame, aims: DataFrame) -> DataFrame:
    """aims with ``lam`` and ``mean``: the dual solution for each source."""
    top = F.log(F.lit(MOST))
    now = aims.filter("source_size > 0").withColumn("mean", F.col("source_size") / F.col("n"))
    now = now.withColumns({"lam": F.lit(0.0), "lo": F.lit(-1e7), "hi": top * F.col("mean") + 1.0, "off": F.lit(1.0)}).checkpoint()
    for _ in range(STEPS):
        x = F.col("lam") * F.col("size") / F.col("mean")
        rate = F.exp(F.least(x, top))
        joined = histogram.filter("size > 0").join(now, "key")
        sums = joined.groupBy("key").agg(
            F.sum(F.col("count") * F.col("size") * rate).alias("got"),
            F.sum(F.when(x < top, F.col("count") * F.col("size") * F.col("size") / F.col("mean") * rate).otherwise(0.0)).alias("slope"),
        )
        step = now.join(sums, "key").withColumn("miss", F.col("got") - F.col("target"))
        step = step.withColumns({"hi": F.when(F.col("miss") >= 0, F.least("hi", "lam")).otherwise(F.col("hi")), "lo": F.when(F.col("miss") < 0, F.greatest("lo", "lam")).otherwise(F.col("lo"))})
        newton = F.col("lam") - F.try_divide(F.col("miss"), F.col("slope"))
        inside = newton.isNotNull() & (newton > F.col("lo")) & (newton < F.col("hi"))
        done = F.abs("miss") <= EXACT * F.col("target")
        middle = F.when(F.col("lo") <= -1e7, F.least(F.col("hi") * 4, F.lit(-1.0))).otherwise((F.col("lo") + F.col("hi")) / 2)
        step = step.withColumn("lam", F.when(done, F.col("lam")).when(inside, newton).otherwise(F.greatest(middle, F.col("lo"))))
        now = step.withColumn("off", F.abs("miss") / F.col("target")).select(*now.columns).checkpoint()
        worst = now.agg(F.max(F.when(F.col("hi") - F.col("lo") > 1e-12 * F.abs("hi"), F.col("off")).otherwise(0.0)).alias("m")).first()["m"]
        if worst is None or worst <= EXACT:
            break
    return now.select("key", "source_size", "n", "target", "lam", "mean")


def with_copies(rows: DataFrame) -> DataFrame:
    """rows (rid, doc_id, key, size) with source_size, target and copies."""
    shared_dir(rows.sparkSession)
    histogram = written(rows.groupBy("key", "size").agg(F.count("*").alias("count")), "mix-histogram")
    aims = written(targets(histogram.groupBy("key").agg(F.sum(F.col("size") * F.col("count")).alias("source_size"), F.sum("count").alias("n"))), "mix-targets")
    solved = aims.join(tilts(histogram, aims).select("key", "lam", "mean"), "key", "left")
    rate = F.coalesce(F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean"), F.log(F.lit(MOST)))), F.lit(1.0))
    # a rate within rounding noise of a whole is that whole
    rate = F.least(F.lit(MOST), F.when(F.abs(rate - F.round(rate)) < 1e-9, F.round(rate)).otherwise(rate))
    step = F.when(F.col("size") > 0, F.floor(4 * F.log2(F.col("size").cast("double")))).otherwise(F.lit(-1)).cast("int")
    classes = histogram.withColumn("step", step).groupBy("key", "step").agg(F.ceil(F.sum("count") / BUCKET_ROWS).cast("int").alias("salts"))
    groups = written(classes.join(solved, "key"), "mix-groups")  # a row a source and step of sizes
    rated = joined_to_groups(rows.withColumn("step", step), groups, ["key", "step"]).withColumn("rate", rate)
    rated = rated.withColumns({"salt": F.pmod(F.xxhash64("doc_id", "size"), "salts").cast("int"), "whole": F.floor("rate").cast("long")})
    rated = rated.withColumn("part", F.round((F.col("rate") - F.col("whole")) * PARTS).cast("long"))
    rated = rated.select("rid", "doc_id", "key", "size", "source_size", "target", "step", "salt", "whole", "part")
    buckets = rated.groupBy("key", "step", "salt").agg(F.sum("part").alias("s"))
    before = Window.partitionBy("key").orderBy(F.col("step").desc(), "salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.select("key", "step", "salt", (F.coalesce(F.sum("s").over(before), F.lit(0)) + PARTS // 2).alias("start"))
    along = Window.partitionBy("key", "step", "salt").orderBy(F.col("size").desc(), "doc_id", "rid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = rated.join(starts, ["key", "step", "salt"]).withColumn("upto", F.col("start") + F.sum("part").over(along))
    more = F.floor(F.col("upto") / PARTS) - F.floor((F.col("upto") - F.col("part")) / PARTS)
    rounded = written(summed.select("rid", "doc_id", "key", "size", "source_size", "target", (F.col("whole") + more).cast("long").alias("copies")), "mix-copies")

    # the rest of each target, by single documents of falling size: one to add and one to leave out for each power of two
    twos = F.floor(F.log2(F.col("size").cast("double"))).cast("int")
    first = lambda ok: F.min(F.when(ok, F.struct(F.xxhash64("doc_id", "size").alias("h"), "size", "rid")))
    spare = rounded.filter("size > 0").groupBy("key", twos.alias("two")).agg(first(F.col("copies") < int(MOST)).alias("add"), first(F.col("copies") > 0).alias("cut"))
    spare = spare.groupBy("key").agg(F.sort_array(F.collect_list("add"), False).alias("adds"), F.sort_array(F.collect_list("cut"), False).alias("cuts"))  # at most 63 each
    missing = rounded.groupBy("key").agg((F.max("target") - F.sum(F.col("copies") * F.col("size"))).alias("missing"))
    pool = missing.join(spare, "key").select("key", F.abs("missing").alias("missing"), F.signum("missing").cast("long").alias("sign"), F.when(F.col("missing") > 0, F.col("adds")).otherwise(F.col("cuts")).alias("pool"))
    falling = F.reverse(F.array_sort(F.transform("pool", lambda p: F.struct(p["size"].alias("size"), p["rid"].alias("rid")))))
    start = F.struct(F.col("missing").alias("left"), F.array().cast("array<bigint>").alias("rids"))
    fits = lambda a, p: p["size"] <= a["left"] + p["size"] / 2  # noqa: E731  nearer with it than without
    taken = F.aggregate(falling, start, lambda a, p: F.when(fits(a, p), F.struct((a["left"] - p["size"]).alias("left"), F.concat(a["rids"], F.array(p["rid"])).alias("rids"))).otherwise(a))
    change = pool.select("sign", F.explode(taken["rids"]).alias("rid"))
    return rounded.join(change, "rid", "left").withColumn("copies", F.col("copies") + F.coalesce("sign", F.lit(0))).drop("sign")


def sized(docs: DataFrame) -> DataFrame:
    """(rid, doc_id, key, size): what mixing needs of each row, written so that rid stays."""
    return written(docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), source_key(F.col("source")).alias("key"), n_words(F.col("text")).alias("size")), "mix-sizes")


def balanced(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, copies and taken of every row."""
    return with_copies(sized(docs)).select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """docs with each row repeated as often as the mix takes it; columns stay. Rows equal in id, source and size are told apart by text.

    What is joined to the rows is how many of each such set get 3, 2 and 1 copies, so texts are moved once.
    """
    names = docs.columns
    on = ["_id", "_key", "_size"]
    id_ = F.coalesce(F.col("doc_id").cast("long"), F.lit(0))
    flag = F.when(F.col("doc_id").isNull(), "n").otherwise("i")
    some = range(int(MOST), 0, -1)
    counts = with_copies(sized(docs)).select(id_.alias("_id"), F.concat(flag, F.col("key")).alias("_key"), F.col("size").alias("_size"), "copies")
    counts = counts.groupBy(*on).agg(*(F.count_if(F.col("copies") == k).alias(f"_c{k}") for k in some))
    row = F.struct(*(F.col(f"`{n}`") for n in names)).alias("_row")
    own = docs.select(row, id_.alias("_id"), F.concat(flag, source_key(F.col("source"))).alias("_key"), n_words(F.col("text")).alias("_size"))
    place = F.row_number().over(Window.partitionBy(*on).orderBy(F.col("_row.text")))
    copies, upto = None, F.lit(0)
    for k in some:
        upto = upto + F.col(f"_c{k}")
        copies = (F if copies is None else copies).when(F.col("_place") <= upto, k)
    out = own.join(counts, on).withColumn("_place", place).withColumn("_times", copies).filter("_times is not null")
    return out.select(F.explode(F.sequence(F.lit(1), F.col("_times"))).alias("_copy"), "_row").select("_row.*")
