"""Composition of rankings: union, reranking, stages, the ladder of configurations."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Hits that a search hands on, hits of a finished ranking.
SEARCHED, SHOWN = 50, 20


@dataclass(frozen=True)
class Config:
    """One row of an ablation: its steps in order ("dense", "lexical", "rerank"), each with how many hits it gives, whether searches see only
    passages that cover the question's version, and what encodes."""

    name: str
    steps: tuple[tuple[str, int], ...] = (("dense", SEARCHED),)
    covering: bool = False
    encoder: str = "base"

    @property
    def cache_key(self) -> str:
        return "".join(c if c.isalnum() else "_" for c in self.encoder)


_DENSE, _LEXICAL, _RERANK = ("dense", SEARCHED), ("lexical", SEARCHED), ("rerank", SHOWN)
#: Each row takes one thing more than the row it builds on.
LADDER = (
    Config("bm25", (_LEXICAL,)),
    Config("dense", (_DENSE,)),
    Config("dense_filtered", (_DENSE,), True),
    Config("tuned_filtered", (_DENSE,), True, "tuned"),
    Config("reranked", (_DENSE, _RERANK), True, "tuned"),
    Config("hybrid_reranked", (_DENSE, _LEXICAL, _RERANK), True, "tuned"),
)


def resolved_model(token: str, known: dict[str, str], default: str) -> tuple[str, bool]:
    """What a configuration's encoder stands for, and whether the default had to stand in for it, which makes a run degraded."""
    return (known[token], False) if token in known else (default, token != "base")


def selected(names: list[str]) -> list[Config]:
    """Configurations by name; an unknown name is an error."""
    known = {c.name: c for c in LADDER}
    if wrong := [n for n in names if n not in known]:
        raise ValueError(f"unknown configurations: {', '.join(wrong)}")
    return [known[n] for n in names]


def union(first: DataFrame, second: DataFrame, qid: str, id_: str) -> DataFrame:
    """The first ranking, then what only the second has, in its order; scores stay as they were. Adds ``stage`` and a new ``rank``."""
    extra = second.join(first.select(qid, id_), [qid, id_], "left_anti")
    both = first.withColumn("stage", F.lit("dense")).unionByName(extra.withColumn("stage", F.lit("bm25")))
    w = Window.partitionBy(qid).orderBy(F.when(F.col("stage") == "dense", 0).otherwise(1), "rank")
    return both.withColumn("rank", F.row_number().over(w))


def reranked(hits: DataFrame, scored: DataFrame, qid: str, id_: str, k: int) -> DataFrame:
    """hits ordered by rerank_score of ``scored`` (qid, id, rerank_score), which replaces their score; ties keep their order."""
    w = Window.partitionBy(qid).orderBy(F.col("rerank_score").desc_nulls_last(), "rank")
    out = hits.join(scored, [qid, id_], "left").withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k)
    return out.select(qid, id_, F.coalesce("rerank_score", "score").alias("score"), F.col("_n").alias("rank"))


#: Ids of a block within which places are counted: a power of two.
PLACES_BITS = 12


def _placed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows (keys, _at, _mark) with ``_n``: how many of the marked ones (1, not 0) of the same keys come before by _at, null ones last. Places are
    counted in blocks of ids, so that no window holds all ids of a key."""
    rows = rows.withColumn("_block", F.coalesce(F.expr(f"shiftright(_at, {PLACES_BITS})"), F.lit((1 << 63) - 1)))
    sizes = rows.groupBy(*keys, "_block").agg(F.sum("_mark").alias("_c"))
    before = sizes.select(*keys, "_block", (F.sum("_c").over(Window.partitionBy(*keys).orderBy("_block")) - F.col("_c")).alias("_before"))
    w = Window.partitionBy(*keys, "_block").orderBy(F.col("_at").asc_nulls_last(), "_mark").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = F.sum("_mark").over(w) - F.col("_mark")
    return rows.withColumn("_own", own).join(before, [*keys, "_block"]).withColumn("_n", F.col("_before") + F.col("_own")).drop("_block", "_own", "_before")


def nearest(points: DataFrame, rows: DataFrame, keys: list[str], qid: str, id_: str, k: int, alike: Callable[[Column], Column]) -> DataFrame:
    """(qid, id): for each point those of the rows of its keys among which its k best lie, if nearer ids (to the point's own, qid) score higher
    and ties go to the smaller id. Rows are never paired with all points of their keys.

    alike(distance) is the largest distance that scores what this one does, null if there is no largest. The k best with larger ids are the k nearest. Those with
    smaller ids are the k nearest, or tie with the k-th of these: of such ties the smallest ids win, so the first k that score alike come too. A null id
    is farthest.
    """
    points = points.groupBy(*keys, qid).agg(F.count("*").alias("_times"))
    ids = rows.select(*keys, F.col(id_).alias("_at"), F.lit(1).alias("_mark"), F.lit(None).cast("long").alias(qid))
    asked = lambda df: ids.unionByName(df.select(*keys, F.col("_at"), F.lit(0).alias("_mark"), qid))
    placed = _placed(asked(points.withColumn("_at", F.col(qid))), keys)
    pool = placed.filter("_mark = 1").select(*keys, "_n", F.col("_at").alias(id_))
    spots = placed.filter("_mark = 0").select(*keys, qid, F.explode(F.sequence(F.col("_n") - k, F.col("_n") + k - 1)).alias("_n"))
    below = spots.join(pool, [*keys, "_n"]).filter(F.col(id_) < F.col(qid)).groupBy(*keys, qid).agg(F.min(id_).alias("_far"), F.count("*").alias("_c")).filter(F.col("_c") >= k)
    first = F.coalesce(F.col(qid) - alike(F.col(qid) - F.col("_far")), F.lit(-(1 << 63)))
    tied = _placed(asked(below.withColumn("_at", first).filter("_at < _far")), keys).filter("_mark = 0")
    more = tied.select(*keys, qid, F.explode(F.sequence(F.col("_n"), F.col("_n") + k - 1)).alias("_n"))
    met = spots.unionByName(more).distinct().join(pool, [*keys, "_n"]).join(points, [*keys, qid])
    return met.select(qid, id_, F.explode(F.expr("sequence(1, _times)")).alias("_time")).drop("_time")


@dataclass
class Pipeline:
    """A configuration with what it needs. dense and lexical take (k, filtered) and return (query_id, vec_id, score, rank)."""

    config: Config
    dense: Callable[[int, bool], DataFrame] | None = None
    lexical: Callable[[int, bool], DataFrame] | None = None
    scorer: Callable[[DataFrame], DataFrame] | None = None
    degraded: list[str] = field(default_factory=list)

    def hits(self, top_k: int = 0) -> DataFrame:
        """(query_id, vec_id, score, rank, stage) with at most top_k (or the configuration's number of) hits a query."""
        c, k, found = self.config, top_k or SHOWN, None
        for step, n in c.steps:
            part = {"dense": self.dense, "lexical": self.lexical, "rerank": self.scorer}[step]
            if part is None:
                raise ValueError(f"{c.name} has nothing for its step {step}")
            if step == "rerank":
                if found is None:
                    raise ValueError(f"{c.name} reranks before it searches")
                found = reranked(found, part(found), "query_id", "vec_id", top_k or n)
            elif found is None:
                found = part(n, c.covering)
            else:
                found = union(found, part(n, c.covering), "query_id", "vec_id")
            if "stage" not in found.columns or step == "rerank":
                found = found.withColumn("stage", F.lit({"lexical": "bm25"}.get(step, step)))
        if found is None:
            raise ValueError(f"{c.name} retrieves nothing")
        return found.filter(F.col("rank") <= k).select("query_id", "vec_id", "score", "rank", "stage")

    def labelled(self, table: DataFrame) -> DataFrame:
        """A table of this configuration's metrics, marked as degraded if a part stood in for another."""
        return table.withColumn("degraded", F.lit(bool(self.degraded)))
