"""Exact similarity search over stored vectors.

Up to ``BLOCK`` queries are sent to every task, in one pass over the passages. A task multiplies tiles of queries and passages and keeps
the k best of each query as it goes, so its memory is bounded and k rows a query and task leave it. Filters act before the cut.
More queries stay a table and meet the passages on a grid of blocks (``grid``).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Most queries that are sent to every task; queries and passages of a tile, which a task holds a few times; versions for which they are told apart.
BLOCK, TILE_QUERIES, TILE_ROWS, VERSIONS = 16_384, 256, 2048, 8


def dot(a: Column, b: Column) -> Column:
    """Product sum of two vectors in double precision; null if the lengths differ."""
    same = F.size(a) == F.size(b)
    return F.when(same, F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x))


def slack(digits: int, size: np.ndarray | float) -> np.ndarray | float:
    """What rounding of scores and of a bound itself may hide; size is about the largest product."""
    return 10.0**-digits + 1e-9 * (1.0 + size)


def take(score: np.ndarray, found: np.ndarray, rows: np.ndarray, here: np.ndarray, ids: np.ndarray, digits: int, least: np.ndarray | None = None) -> None:
    """Puts into the k best scores and ids of ``rows`` what of here (rows x ids, not rounded) beats them, ties by id. Only what may reach a row's k-th
    score, or ``least`` if that is more, is rounded and sorted: a tile is walked through, not ordered."""
    k = score.shape[1]
    bar = score[rows, k - 1]
    if least is not None:
        bar = np.maximum(bar, least)
    new = np.isneginf(bar)
    if here.shape[1] > k and new.any():
        bar[new] = np.partition(here[new], -k, axis=1)[:, -k]
    size = np.where(np.isfinite(bar), np.abs(bar), 0.0)
    reach = here >= (bar - slack(digits, size))[:, None]
    reach &= here > -np.inf
    at, column = np.nonzero(reach)
    if not len(at):
        return
    touched, at = np.unique(at, return_inverse=True)
    own = rows[touched]
    at = np.concatenate([at, np.repeat(np.arange(len(own)), k)])
    value = np.concatenate([np.round(here[touched[at[: len(column)]], column], digits) + 0.0, score[own].ravel()])
    name = np.concatenate([ids[column], found[own].ravel()])
    order = np.lexsort((name, -value, at))
    at = at[order]
    keep = order[np.arange(len(at)) - np.searchsorted(at, np.arange(len(own)))[at] < k]  # k of each row, as each had k
    score[own], found[own] = value[keep].reshape(-1, k), name[keep].reshape(-1, k)


def compare(queries: tuple, rows: np.ndarray, passages: tuple, score: np.ndarray, found: np.ndarray, filtered: bool, digits: int, least: np.ndarray | None = None) -> None:
    """The k best of ``rows`` of queries (matrix, version, unset) among passages (matrix, id, low, high), into score and found, in tiles.

    Where a tile's queries ask for few versions, each version's queries meet only the passages that cover it.
    """
    matrix, versions, unset = queries
    for q in range(0, len(rows), TILE_QUERIES):
        asks = rows[q : q + TILE_QUERIES]
        if filtered:
            asks = asks[~unset[asks]]
        kinds = np.unique(versions[asks]) if filtered else []
        for p in range(0, len(passages[0]), TILE_ROWS):
            vectors, ids, low, high = (x[p : p + TILE_ROWS] for x in passages)
            if filtered and len(kinds) <= VERSIONS:
                parts = [(asks[versions[asks] == v], np.flatnonzero((low <= v) & (v <= high))) for v in kinds]
            else:
                parts = [(asks, None)]
            for own, cover in parts:
                if not len(own) or (cover is not None and not len(cover)):
                    continue
                here = matrix[own] @ (vectors if cover is None else vectors[cover]).T
                if filtered and cover is None:
                    v = versions[own, None]
                    here[(v < low) | (v > high)] = -np.inf
                take(score, found, own, here, ids if cover is None else ids[cover], digits, None if least is None else least[own])


def _searched(block: list, passages: DataFrame, k: int, filtered: bool, digits: int) -> DataFrame:
    """(query_id, vec_id, score): the k best of each task for the queries of a block."""
    width = len(block[0][1])
    sent = passages.sparkSession.sparkContext.broadcast((np.array([r[0] for r in block], np.int64), np.array([r[1] for r in block], np.float64), np.array([-1 if r[2] is None else r[2] for r in block], np.int64), np.array([r[2] is None for r in block])))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        ids, matrix, versions, unset = sent.value
        score = np.full((len(ids), k), -np.inf)
        found = np.full((len(ids), k), np.iinfo(np.int64).max)
        rows = np.argsort(versions, kind="stable")  # a tile's queries ask for few versions
        for batch in batches:
            vectors = np.asarray(batch.column("embedding").flatten(), np.float64).reshape(batch.num_rows, width)
            compare((matrix, versions, unset), rows, (vectors, *(np.asarray(batch.column(c)) for c in ("vec_id", "version_low", "version_high"))), score, found, filtered, digits)
        keep = score > -np.inf
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, k).reshape(-1, k)[keep]), pa.array(found[keep]), pa.array(score[keep])], names=["query_id", "vec_id", "score"])

    return passages.filter(F.size("embedding") == width).mapInArrow(run, "query_id long, vec_id long, score double")


def same_length(queries: DataFrame, passages: DataFrame) -> int | None:
    """The one length of all vectors (embedding), null ones apart; an index of one model has no other, so a second length is an error."""
    sizes = lambda df: df.filter("embedding is not null").agg(F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
    found = {n for df in (queries, passages) for n in sizes(df) if n is not None}
    if len(found) > 1:
        raise ValueError(f"vectors of {min(found)} to {max(found)} numbers")
    return next(iter(found), None)


def in_reach(queries: DataFrame, own: str, sample: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """Queries whose own passage, with the vector in ``own``, may be among the k nearest: those that no k passages of a sample beat by more than rounding
    can hide. The sample (embedding) is sent to every task, a part of what is searched; it decides how many are left, not which own passages are found."""
    import pyarrow as pa

    vectors = sample.filter(F.col("embedding").isNotNull()).select("embedding").toArrow().column("embedding").combine_chunks()
    matrix = np.asarray(vectors.flatten(), np.float64).reshape(len(vectors), -1) if len(vectors) else np.zeros((0, 0))
    sent = queries.sparkSession.sparkContext.broadcast(matrix)

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            for i in range(0, batch.num_rows, TILE_QUERIES):
                some = batch.slice(i, TILE_QUERIES)
                asks, wanted = (np.asarray(some.column(c).flatten(), np.float64).reshape(some.num_rows, -1) for c in ("embedding", own))
                bar = (asks * wanted).sum(axis=1)
                bar += 2 * slack(digits, np.abs(bar))
                beaten = np.zeros(len(bar), np.int64)
                for p in range(0, len(sent.value), TILE_ROWS):
                    open_ = np.flatnonzero(beaten < k)
                    if not len(open_):
                        break
                    beaten[open_] += (asks[open_] @ sent.value[p : p + TILE_ROWS].T > bar[open_, None]).sum(axis=1)
                yield some.filter(pa.array(beaten < k))

    whole = queries.filter(F.col("embedding").isNotNull() & F.col(own).isNotNull())
    return whole.mapInArrow(run, whole.schema).drop(own)


def top_k(queries: DataFrame, passages: DataFrame, k: int, filtered: bool, digits: int = 6) -> DataFrame:
    """(query_id, vec_id, score, rank): the k passages (vec_id, embedding, version_low, version_high) nearest to each query.

    Queries are (query_id, embedding, version); with ``filtered`` only passages that cover a query's version are ranked, none for a
    null version. Scores are rounded before ranking; ties go by vec_id. Queries that nothing covers have no rows. Null embeddings,
    null elements and passages of another length than a query's are left out for it.
    """
    whole = lambda df: df.filter(F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull()))
    asks = whole(queries).select("query_id", F.col("embedding").cast("array<double>").alias("e"), "version")
    rows = asks.limit(BLOCK + 1).collect()
    if len(rows) > BLOCK:
        from . import grid

        return grid.top_k(queries, passages, k, filtered, digits)
    ready = whole(passages.select("vec_id", "embedding", F.coalesce("version_low", F.lit(1 << 30)).alias("version_low"), F.coalesce("version_high", F.lit(-1)).alias("version_high")).filter("vec_id is not null"))
    by_length = groupby(sorted(rows, key=lambda r: len(r[1])), key=lambda r: len(r[1]))
    parts = [_searched(list(block), ready, k, filtered, digits) for _, block in by_length]
    if not parts:
        return ready.sparkSession.createDataFrame([], "query_id long, vec_id long, score double, rank int")
    best = reduce(DataFrame.unionByName, parts)
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
