"""What the text operators share: words, cached word ids, splits, ordered buckets and shared scratch tables.

A word is a maximal run of bytes other than space and \\t..\\r, which is what ``bytes.split()`` yields on UTF-8.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of an Arrow batch: long texts make wide rows, so batches stay short.
BATCH_ROWS, BATCH_BYTES = 512, "16m"
#: Ranges of equal row counts from which one of equal bytes is put together.
SPLIT = 8
#: Groups that may be sent to every task; parts of a group's rows where there are more groups.
NEAR_GROUPS, GROUP_SALTS = 100_000, 32
#: Bytes of text that a range holds, about.
RANGE_BYTES = 64 << 20


@contextmanager
def batch_limits(spark: SparkSession, rows: int = BATCH_ROWS, size: str = BATCH_BYTES) -> Iterator[None]:
    """While it lasts, Arrow batches hold at most ``rows`` rows and about ``size``; the session's own settings come back after it."""
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    before = [spark.conf.get(n, None) for n in names]
    for n, v in zip(names, (str(rows), size)):
        spark.conf.set(n, v)
    try:
        yield
    finally:
        for n, v in zip(names, before):
            if v is None:
                spark.conf.unset(n)
            else:
                spark.conf.set(n, v)


def bounded_batches(df: DataFrame) -> DataFrame:
    """df, in a session whose Arrow batches stay short however long the texts are.

    Plans are executed after a function returns, so the limit is the session's until the caller sets another one.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bounded_batches(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Where the session names none, a temporary one on a single machine, an error on a cluster."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        held = sc._jsc.sc().getCheckpointDir()
        where = held.get() if held.isDefined() else None
    if not where:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
        sc.setCheckpointDir(where)
    elif not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(where)
    return where.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/scratch-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df from a table in the shared folder: cuts lineage and outlives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def merged(df: DataFrame) -> DataFrame:
    """df as a side of a merge join. Scratch tables of ids are small on disk and large in memory, so by their files' size Spark would broadcast them."""
    return df.hint("merge")


def joined_to_groups(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the columns of groups (one row for each value of keys, nulls are values), left as they are where it has none.

    The groups are sent to all tasks while they are at most NEAR_GROUPS, which is counted. Beyond that both sides are dealt by keys
    and a salt, so that one key with many rows isn't one task. That join is a merge join whatever Spark thinks of its sizes: it takes the
    copies for a table of one file's size and would send them all through the driver.
    """
    few = groups.count() <= NEAR_GROUPS
    own = groups.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    if few:
        out = rows.join(F.broadcast(own), same, "left")  # counted: NEAR_GROUPS rows at most
    else:
        dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in rows.columns)), F.lit(GROUP_SALTS)).cast("int"))
        own = own.withColumn("_s", F.explode(F.array(*(F.lit(i) for i in range(GROUP_SALTS)))))
        out = dealt.join(merged(own), same & (F.col("_salt") == F.col("_s")), "left").drop("_salt", "_s")
    return out.drop(*(f"_k{i}" for i in range(len(keys))))


def freed(run: Callable) -> Callable:
    """run, a function for mapInArrow, whose task gives Arrow's unused memory back at its end: a worker lives on, and would hold its most for later stages."""

    def done(batches: Iterator) -> Iterator:
        import pyarrow as pa

        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return done


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, mod n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(n)


class Cached(dict):
    """word -> make(word), remembered in two generations of at most ``limit`` words each, so memory is bounded and frequent words stay."""

    def __init__(self, make: Callable, limit: int = 300_000):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, word):
        value = self.old.get(word)
        if value is None:
            value = self.make(word)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[word] = value
        return value


    def fresh(self, words: set) -> tuple[dict, set]:
        """What is known of words, and the rest."""
        known, rest = {}, set()
        here, before = self.get, self.old.get
        for w in words:
            v = here(w)
            if v is None:
                v = before(w)
            if v is None:
                rest.add(w)
            else:
                known[w] = v
        return known, rest

    def learn(self, values: dict) -> None:
        if len(self) + len(values) > self.limit:
            self.old = dict(self)
            self.clear()
        if len(values) <= self.limit:
            self.update(values)


def numbers(values: Iterable, words, dtype=np.int64) -> np.ndarray:
    return np.fromiter(map(values.__getitem__, words), dtype, len(words))


def texts_of(column) -> list[str]:
    """Texts of an Arrow string column, "" for null; bytes that aren't UTF-8 become U+FFFD."""
    try:
        return [x or "" for x in column.to_pylist()]
    except UnicodeDecodeError:
        return [x.decode("utf-8", "replace") for x in raw_texts(column)]


def raw_texts(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column, b'' for null."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def ordered_cuts(df: DataFrame, key: str, parts: int) -> list[int]:
    """At most ``parts`` existing values of key, the least first, cutting df into ranges of about equal row counts. Null keys order before all."""
    parts = max(1, parts)
    got = df.agg(F.min(key).alias("a"), F.percentile_approx(key, [i / parts for i in range(1, parts)] or [0.5], max(1000, 20 * parts)).alias("p")).first()
    return [] if got["a"] is None else sorted({got["a"], *(got["p"] or [])})


def sized_cuts(df: DataFrame, key: str, text: str, most: int) -> list[int]:
    """Existing values of key that cut df into ranges of about equal bytes of ``text``, as many as there are shuffle partitions or
    more, so that a range has about ``most`` bytes at most. Ranges are put together from SPLIT times as many of equal row counts."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = F.coalesce(F.octet_length(text), F.lit(0)) + 16
    total = df.agg(F.sum(size)).first()[0] or 0
    parts = max(parts, -(-total // most))
    fine = ordered_cuts(df, key, SPLIT * parts)
    if not fine:
        return []
    held = {r["at"]: r["n"] for r in df.groupBy(range_of(F.col(key), fine).alias("at")).agg(F.sum(size).alias("n")).collect()}  # SPLIT rows a range
    cuts, room = [], 0
    for i, cut in enumerate(fine):
        if not cuts or held.get(i, 0) / 2 > room:
            cuts.append(cut)
            room = total / parts
        room -= held.get(i, 0)
    return cuts


def range_of(key: Column, cuts: list[int]) -> Column:
    """Index of the range of cuts that holds key; 0 for null and below all. Its size and its cost a row grow as the root of len(cuts)."""
    if len(cuts) < 2:
        return F.lit(0)
    step = 1 if len(cuts) <= 256 else int(len(cuts) ** 0.5)
    heads = cuts[::step]

    def split(lo: int, hi: int) -> Column:
        if hi - lo == 1:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key >= F.lit(heads[mid]), split(mid, hi)).otherwise(split(lo, mid))

    coarse = split(0, len(heads))
    if step > 1:
        groups = F.array(*(F.lit(cuts[i : i + step]) for i in range(0, len(cuts), step)))
        coarse = coarse * step + F.greatest(F.lit(0), F.size(F.filter(F.element_at(groups, coarse + 1), lambda c: c <= key)) - 1)
    return F.coalesce(F.when(key.isNotNull(), coarse), F.lit(0))


def with_next(df: DataFrame, key: str, value: str, out: str, ties: list[str] | None = None) -> DataFrame:
    """df with ``value`` of the next row by ascending ``key`` (nulls first, ties by ``ties``), the first row's after the last.

    One shuffle: rows are dealt by ranges of key whose bounds are keys that exist, and the row at each bound is sent to the
    range before as well, so that no global sort or one-task window is needed.
    """
    cuts = sized_cuts(df, key, value, RANGE_BYTES)
    first_null = df.filter(F.col(key).isNull()).limit(1).count() > 0
    n = max(1, len(cuts))
    at = range_of(F.col(key), cuts)
    starts = F.col(key).isin(cuts[1:]) if n > 1 else F.lit(False)
    first = F.col(key).isNull() if first_null or not cuts else F.col(key) == F.lit(cuts[0])
    places = F.when(first, F.array(F.struct(F.lit(0).alias("at"), F.lit(0).alias("_copy")), F.struct(F.lit(n - 1).alias("at"), F.lit(2).alias("_copy"))))
    places = places.when(F.coalesce(starts, F.lit(False)), F.array(F.struct(at.alias("at"), F.lit(0).alias("_copy")), F.struct((at - 1).alias("at"), F.lit(1).alias("_copy"))))
    places = places.otherwise(F.array(F.struct(at.alias("at"), F.lit(0).alias("_copy"))))
    dealt = df.withColumn("_place", F.explode(places)).select("*", "_place.at", "_place._copy").drop("_place")
    order = Window.partitionBy("at").orderBy(F.col("_copy"), F.col(key).asc_nulls_first(), *(F.col(t) for t in ties or []))
    return dealt.repartitionById(n, "at").withColumn(out, F.lead(value).over(order)).filter("_copy = 0").drop("at", "_copy")
