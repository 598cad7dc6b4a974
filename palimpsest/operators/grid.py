"""Exact nearest neighbours where the queries are a table too, for all vectors of a collection, say.

Both sides are dealt into full blocks of vectors that lie near the same pivot, each with its centre and radius. As q.p <= q.c + |q| r for all
p of a block (Cauchy-Schwarz), a block that can't beat a query's k-th score needn't be compared. Every query gets a first bound for that score from a
sample of SAMPLE passages, whose first PIVOTS are the pivots; both decide cost, not results. Pairs of blocks whose bound reaches it meet on a
grid: a run of query blocks and a stripe of passage blocks are one group, of bounded size. There the best blocks go first, and bounds tighten.
A group hands on k rows a query; the driver sees counts and the sample.

Rows are those of ``dense.top_k``: (query_id, vec_id, score, rank), scores rounded before ranking, ties by vec_id. Null ids, null vectors and vectors
with null elements are left out, and so are passages of another length than the query's. A null version is covered by nothing.
Repeated rows count each. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources import scratch
from .dense import TILE_QUERIES, compare, dot, slack

#: Passages of the sample; pivots among them; vectors of a block; the share of it that is filled, about, so that few rows overflow.
SAMPLE, PIVOTS, ROWS, QUERY_ROWS, FILL = 2048, 64, 4096, 1024, 0.9
#: Passage blocks of a stripe, about, and query blocks of a run: about as many vectors, so that copies of both are few.
STRIPE, RUN = 8, 32
#: Most tasks that groups are dealt to.
TASKS = 2000

_PLACED = "id long, embedding array<double>, low long, high long, width int, pivot int, bound double"
_BLOCK = "block long, width int, pivot int, n int, ids binary, matrix binary, low binary, high binary, centre array<double>, radius double, longest double, bounds binary, least double"


class Counts:
    """Pairs of blocks there are, that a bound let through to the grid, and that were compared. A task that runs again counts again."""

    def __init__(self, spark):
        self.pairs = self.met = 0
        self.compared_ = spark.sparkContext.accumulator(0)

    @property
    def compared(self) -> int:
        return self.compared_.value


def _first_bounds(matrix: np.ndarray, low: np.ndarray, high: np.ndarray, sample: tuple | None, k: int, filtered: bool, digits: int) -> np.ndarray:
    """The k-th score of each query within the sample, -inf where it has fewer."""
    if sample is None or len(sample[0]) < k:
        return np.full(len(matrix), -np.inf)
    score = np.round(matrix @ sample[0].T, digits)
    if filtered:
        score[(low[:, None] > high[:, None]) | (low[:, None] < sample[1]) | (low[:, None] > sample[2])] = -np.inf
    return np.partition(score, -k, axis=1)[:, -k]


def _bytes(matrix: np.ndarray) -> bytes:
    """A block's matrix, in single precision where that loses nothing."""
    with np.errstate(over="ignore"):
        single = matrix.astype(np.float32)
    return (single if (single == matrix).all() else matrix).tobytes()


def _matrix(content: bytes, n: int, width: int) -> np.ndarray:
    kind = np.float32 if len(content) == 4 * n * width else np.float64
    return np.frombuffer(content, kind).reshape(n, width).astype(np.float64)


def _placed(rows: DataFrame, sampled, bounds: tuple | None) -> DataFrame:
    """rows (id, embedding, low, high) with their width, their nearest pivot and, if asked for, their first bound; sampled is a broadcast of vectors
    and ranges by length."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            lengths = np.asarray(pc.list_value_length(batch.column("embedding")))
            for width in np.unique(lengths).tolist():
                part = batch.filter(pa.array(lengths == width))
                near, own = np.zeros(part.num_rows, np.int32), np.full(part.num_rows, -np.inf)
                for i in range(0, part.num_rows, TILE_QUERIES):
                    some = part.slice(i, TILE_QUERIES)
                    matrix = np.asarray(some.column("embedding").flatten(), np.float64).reshape(some.num_rows, width)
                    if width in sampled.value:
                        pivots = sampled.value[width][0][:PIVOTS]
                        near[i : i + TILE_QUERIES] = (matrix @ pivots.T - (pivots**2).sum(axis=1) / 2).argmax(axis=1)
                    if bounds:
                        low, high = (np.asarray(some.column(c), np.int64) for c in ("low", "high"))
                        own[i : i + TILE_QUERIES] = _first_bounds(matrix, low, high, sampled.value.get(width), *bounds)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(part.num_rows, width, np.int32)), pa.array(near), pa.array(own)], names=[*part.schema.names, "width", "pivot", "bound"])

    return rows.mapInArrow(run, _PLACED)


def _dealt(rows: DataFrame, most: int) -> DataFrame:
    """Placed rows, those of a block side by side: a pivot's rows are dealt by a hash into parts that ``most`` rows hold, so blocks are full however the
    rows came, and a pivot with many isn't one task."""
    sizes = rows.groupBy("width", "pivot").count()
    parts = sizes.select("width", "pivot", F.ceil(F.col("count") / (FILL * most)).alias("parts"))
    part = F.pmod(F.xxhash64("id", "low", "high"), F.col("parts"))
    dealt = rows.join(F.broadcast(parts), ["width", "pivot"]).withColumn("part", part).drop("parts")  # PIVOTS rows a width
    return dealt.repartition("width", "pivot", "part").sortWithinPartitions("width", "pivot", "part", "low", "id")


def _packed(rows: DataFrame, most: int, bounds: bool) -> DataFrame:
    """Blocks (see _BLOCK) of dealt rows."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        task, made, held = TaskContext.get().partitionId(), 0, []

        schema = pa.schema([("block", pa.int64()), ("width", pa.int32()), ("pivot", pa.int32()), ("n", pa.int32()), *((c, pa.binary()) for c in ("ids", "matrix", "low", "high")),
                            ("centre", pa.list_(pa.float64())), ("radius", pa.float64()), ("longest", pa.float64()), ("bounds", pa.binary()), ("least", pa.float64())])

        def closed(key: tuple) -> pa.RecordBatch:
            nonlocal made
            ids, matrix, low, high, own = (np.concatenate([p[i] for p in held]) for i in range(5))
            held.clear()
            centre = matrix.mean(axis=0)
            made += 1
            row = {
                "block": (task << 32) + made, "width": key[0], "pivot": key[1], "n": len(ids), "ids": ids.tobytes(), "matrix": _bytes(matrix), "low": low.tobytes(), "high": high.tobytes(),
                "centre": centre.tolist(), "radius": float(np.linalg.norm(matrix - centre, axis=1).max()), "longest": float(np.linalg.norm(matrix, axis=1).max()),
                "bounds": own.tobytes() if bounds else b"", "least": float(own.min()) if bounds else None,
            }
            return pa.RecordBatch.from_pylist([row], schema)

        last, size = None, 0
        for batch in batches:
            keys = np.stack([np.asarray(batch.column(c), np.int64) for c in ("width", "pivot", "part")], axis=1)
            starts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for begin, end in zip([0, *starts.tolist()], [*starts.tolist(), len(keys)]):
                key = tuple(keys[begin].tolist()) if end else last
                if held and key != last:
                    yield closed(last)
                    size = 0
                last = key
                while begin < end:  # fills the open block, so that none has more than most
                    n = min(end - begin, most - size)
                    some = batch.slice(begin, n)
                    matrix = np.asarray(some.column("embedding").flatten(), np.float64).reshape(n, key[0])
                    held.append((np.asarray(some.column("id"), np.int64), matrix, *(np.asarray(some.column(c), np.int64) for c in ("low", "high")), np.asarray(some.column("bound"), np.float64)))
                    begin, size = begin + n, size + n
                    if size == most:
                        yield closed(key)
                        size = 0
        if held:
            yield closed(last)

    return rows.mapInArrow(run, _BLOCK)


def _compared(k: int, filtered: bool, digits: int, counted):
    """Function of a run of query blocks and a stripe of passage blocks: the k best passages there of each query."""

    def run(left, right):
        import pyarrow as pa

        of = lambda row, name, kind=np.int64: np.frombuffer(row[name], kind)
        blocks = [(of(r, "ids"), _matrix(r["matrix"], r["n"], r["width"]), of(r, "low"), of(r, "high"), np.array(r["centre"], np.float64), r["radius"]) for r in right.to_pylist()]
        found = []
        for row in left.to_pylist() if blocks else []:
            ids, matrix, version, unset = of(row, "ids"), _matrix(row["matrix"], row["n"], row["width"]), of(row, "low"), of(row, "low") > of(row, "high")
            bound = of(row, "bounds", np.float64)
            length = np.linalg.norm(matrix, axis=1)
            reach = np.stack([matrix @ b[4] + length * b[5] for b in blocks])  # blocks x queries
            spare = slack(digits, np.abs(reach))
            score, best = np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
            for at in np.argsort(-reach.max(axis=1), kind="stable").tolist():
                asks = np.flatnonzero(reach[at] + spare[at] >= np.maximum(bound, score[:, k - 1]))
                if not len(asks):
                    continue
                counted.add(1)
                own, vectors, low, high = blocks[at][:4]
                compare((matrix, version, unset), asks, (vectors, own, low, high), score, best, filtered, digits, bound)
            keep = (score > -np.inf) & (score >= bound[:, None])
            found.append((np.repeat(ids, k).reshape(-1, k)[keep], best[keep], score[keep]))
        columns = [np.concatenate([f[i] for f in found]) if found else np.zeros(0, kind) for i, kind in enumerate((np.int64, np.int64, np.float64))]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), columns)))

    return run


def _groups(count: int, each: int) -> int:
    return max(1, -(-count // each))


def top_k(queries: DataFrame, passages: DataFrame, k: int, filtered: bool, digits: int = 6, counts: Counts | None = None) -> DataFrame:
    """(query_id, vec_id, score, rank) of queries (query_id, embedding, version) over passages (vec_id, embedding, version_low, version_high)."""
    spark = queries.sparkSession
    counts = counts or Counts(spark)
    whole = lambda df, *c: df.select(c[0].cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"), c[1].cast("long").alias("low"), c[2].cast("long").alias("high")).filter(
        F.col("id").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x))
    )
    asks = whole(queries, F.col("query_id"), F.coalesce("version", F.lit(1)), F.coalesce("version", F.lit(0)))
    pool = whole(passages, F.col("vec_id"), F.coalesce("version_low", F.lit(1 << 30)), F.coalesce("version_high", F.lit(-1)))
    by_length: dict[int, list] = {}
    for r in pool.orderBy(F.xxhash64("id"), "id", "low", "high").limit(SAMPLE).collect():
        by_length.setdefault(len(r.embedding), []).append(r)
    sent = spark.sparkContext.broadcast({n: (np.array([r.embedding for r in rs], np.float64).reshape(len(rs), n), np.array([r.low for r in rs]), np.array([r.high for r in rs])) for n, rs in by_length.items()})

    packs = scratch.folder(spark, "dense-grid")
    for name, rows, most, bounds in (("queries", asks, QUERY_ROWS, (k, filtered, digits)), ("passages", pool, ROWS, None)):
        _placed(rows, sent, bounds).write.parquet(f"{packs}/{name}-placed")
        dealt = _dealt(spark.read.parquet(f"{packs}/{name}-placed"), most)
        _packed(dealt, most, bounds is not None).write.parquet(f"{packs}/{name}")
    q, p = (spark.read.parquet(f"{packs}/{name}") for name in ("queries", "passages"))
    sizes = [dict(map(tuple, df.groupBy("width").count().collect())) for df in (q, p)]  # lengths of vectors: a model has one
    counts.pairs = sum(n * sizes[1].get(w, 0) for w, n in sizes[0].items())
    stripes = _groups(sum(sizes[1].values()), STRIPE)
    p = p.withColumn("stripe", F.pmod(F.xxhash64("block"), F.lit(stripes)).cast("int"))
    # Pivots with few blocks share a run, so that passages aren't dealt once a pivot; one with many has some of its own.
    share = q.groupBy("width", "pivot").agg(F.count("*").alias("_of"))
    share = share.withColumn("_at", F.sum("_of").over(Window.partitionBy("width").orderBy("pivot")) - F.col("_of"))  # PIVOTS rows a width
    inside = F.pmod(F.xxhash64("block"), F.col("_of"))
    q = q.join(F.broadcast(share), ["width", "pivot"]).withColumn("run", F.xxhash64("width", F.floor((F.col("_at") + inside) / RUN)))

    # Heads only: a block's centre, radius and longest vector bound all its pairs with another.
    ours = q.select("width", "run", F.col("centre").alias("a"), F.col("radius").alias("ra"), F.col("longest").alias("la"), "least", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))).alias("stripe"))
    theirs = p.select("width", "stripe", "block", F.col("centre").alias("b"), F.col("radius").alias("rb"))
    middle = dot(F.col("a"), F.col("b"))
    reach = middle + F.col("ra") * F.sqrt(dot(F.col("b"), F.col("b"))) + F.col("la") * F.col("rb")
    met = ours.join(theirs, ["width", "stripe"]).filter(F.coalesce(reach, F.lit(0.0)) + slack(digits, F.abs(F.coalesce(reach, F.lit(0.0)))) >= F.col("least"))
    met.groupBy("run", "stripe", "block").agg(F.count("*").alias("n")).write.parquet(f"{packs}/met")
    met = spark.read.parquet(f"{packs}/met")
    counts.met = met.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    runs = q.join(met.select("run", "stripe").distinct(), "run").select("run", "stripe", "width", "n", "ids", "matrix", "low", "high", "bounds")
    cells = p.join(met.select("run", "block"), "block").select("run", "stripe", "width", "n", "ids", "matrix", "low", "high", "centre", "radius")
    # A group is much work for its bytes, so groups aren't put together by their size: twice as many tasks as groups, up to TASKS.
    tasks = min(TASKS, 2 * met.select("run", "stripe").distinct().count() + 1)
    runs, cells = (df.repartition(tasks, "run", "stripe") for df in (runs, cells))
    best = runs.groupBy("run", "stripe").cogroup(cells.groupBy("run", "stripe")).applyInArrow(_compared(k, filtered, digits, counts.compared_), "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    out = scratch.folder(spark, "dense-found")
    best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).write.parquet(out)
    scratch.remove(spark, packs)
    return spark.read.parquet(out)
