"""Models over columns of text in batches: one model a worker, texts of like length together, every distinct input scored once.

A model is a function without arguments that loads it and returns a function from a list of inputs to a list of results, one each. It is loaded once
in a Python worker and kept for all tasks of that worker. Inputs of some Arrow batches are held together, sorted by length and packed so that a pack
has at most ``Packing.most`` inputs and its longest times their number stays within ``Packing.budget``: little padding, bounded memory. Results go back to
their rows, so order and batches don't show.

Queries get a prefix, passages none; inputs are cut to a number of words, pairs from the longer side first. A null text gives a null result
and reaches no model. Equal inputs are scored once in the whole table, also over several requests (scored_once).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Model = Callable[[], Callable[[list], list]]
_LOADED: dict = {}


@dataclass(frozen=True)
class Packing:
    """Inputs of a pack, its words with padding, and rows that are sorted together."""

    most: int = 64
    budget: int = 16_384
    window: int = 4_096


class Counts:
    """What models were asked, summed over tasks: loads, calls, inputs, words and words with padding. Tasks that run again count again."""

    NAMES = ("loads", "calls", "inputs", "words", "padded")

    def __init__(self, spark):
        for name in self.NAMES:
            setattr(self, name, spark.sparkContext.accumulator(0))

    def now(self) -> dict[str, int]:
        return {name: getattr(self, name).value for name in self.NAMES}


def loaded(name: str, model: Model, counts: Counts | None = None) -> Callable[[list], list]:
    """The worker's model of this name; a worker holds one at a time."""
    if name not in _LOADED:
        _LOADED.clear()
        _LOADED[name] = model()
        if counts:
            counts.loads.add(1)
    return _LOADED[name]


def words_of(item: str | tuple[str, str]) -> int:
    return max(1, sum(len(t.split()) for t in (item if isinstance(item, tuple) else (item,))))


def packs(lengths: list[int], p: Packing) -> Iterator[list[int]]:
    """Places of the inputs of each pack, the shortest first."""
    now: list[int] = []
    for i in sorted(range(len(lengths)), key=lengths.__getitem__):
        if now and (len(now) == p.most or lengths[i] * (len(now) + 1) > p.budget):
            yield now
            now = []
        now.append(i)
    if now:
        yield now


def answered(items: list, model: Callable[[list], list], p: Packing, counts: Counts | None = None) -> list:
    """Results of the inputs in their order; None for None."""
    asked = [i for i, x in enumerate(items) if x is not None]
    lengths = [words_of(items[i]) for i in asked]
    out: list = [None] * len(items)
    for pack in packs(lengths, p):
        found = model([items[asked[i]] for i in pack])
        if len(found) != len(pack):
            raise ValueError(f"{len(found)} results of {len(pack)} inputs")
        for i, x in zip(pack, found):
            out[asked[i]] = x
        if counts:
            counts.calls.add(1)
            counts.inputs.add(len(pack))
            counts.words.add(sum(lengths[i] for i in pack))
            counts.padded.add(max(lengths[i] for i in pack) * len(pack))
    return out


def first_words(text: Column, most: int) -> Column:
    """The text up to its ``most``-th word; white space before a word stays as it is."""
    return F.regexp_extract(text, rf"^(?:\s*\S+){{0,{most}}}", 0)


def cut_pair(a: Column, b: Column, most: int) -> tuple[Column, Column]:
    """Both texts with at most ``most`` words together: the longer one is cut first, down to the shorter, then both alike."""
    size = lambda t: F.size(F.filter(F.split(t, r"\s+"), lambda w: w != ""))
    half = most // 2
    keep_a = F.greatest(F.lit(most) - size(b), F.lit(most - half))
    keep_b = F.greatest(F.lit(most) - size(a), F.lit(half))
    at = lambda t, k: F.array_join(F.slice(F.filter(F.split(t, r"\s+"), lambda w: w != ""), F.lit(1), k), " ")
    long = size(a) + size(b) > most
    return F.when(long, at(a, keep_a)).otherwise(a), F.when(long, at(b, keep_b)).otherwise(b)


def _run(df: DataFrame, inputs: list[str], name: str, model: Model, kind: str, p: Packing, counts: Counts | None) -> DataFrame:
    """df (distinct ``inputs``) with ``_out``."""
    from pyspark.sql import types as T

    out_type = T._parse_datatype_string(kind)
    schema = T.StructType([*df.schema.fields, T.StructField("_out", out_type)])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        ask, held, n = loaded(name, model, counts), [], 0

        def done():
            t = pa.Table.from_batches(held)
            columns = [t.column(c).to_pylist() for c in inputs]
            items = list(columns[0]) if len(columns) == 1 else [None if None in x else x for x in zip(*columns)]
            got = pa.array(answered(items, ask, p, counts), to_arrow_type(out_type))
            return t.append_column("_out", got).combine_chunks().to_batches()

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= p.window:
                yield from done()
                held, n = [], 0
        if n:
            yield from done()

    return df.mapInArrow(run, schema)


def encoded(rows: DataFrame, text: str, name: str, model: Model, prefix: str = "", most_words: int | None = None, out: str = "embedding", kind: str = "array<float>", packing: Packing = Packing(), counts: Counts | None = None) -> DataFrame:
    """rows with the model's result for ``text`` (with the prefix, cut), computed once for each distinct input."""
    item = F.concat(F.lit(prefix), F.col(text))
    return scored_once({"": rows.withColumn("_a", first_words(item, most_words) if most_words else item)}, ["_a"], name, model, out, kind, packing, counts)[""].drop("_a")


def reranked_pairs(pairs: DataFrame, query: str, passage: str, name: str, model: Model, most_words: int | None = None, out: str = "rerank_score", packing: Packing = Packing(), counts: Counts | None = None) -> DataFrame:
    """pairs with the model's score of (query, passage), computed once for each distinct pair."""
    a, b = cut_pair(F.col(query), F.col(passage), most_words) if most_words else (F.col(query), F.col(passage))
    return scored_once({"": pairs.withColumns({"_a": a, "_b": b})}, ["_a", "_b"], name, model, out, "double", packing, counts)[""].drop("_a", "_b")


def scored_once(requests: dict[str, DataFrame], inputs: list[str], name: str, model: Model, out: str, kind: str, packing: Packing = Packing(), counts: Counts | None = None) -> dict[str, DataFrame]:
    """Each request's rows with ``out``, where inputs that occur in several rows or requests are scored once.

    Distinct inputs are dealt evenly by their hash, so a worker's share doesn't depend on who asks. Scores are written to the shared folder, so they
    outlive lost executors and aren't computed again by the next request.
    """
    from ..sources import scratch

    spark = next(iter(requests.values())).sparkSession
    asked = reduce(DataFrame.unionByName, (r.select(*inputs) for r in requests.values())).dropna().distinct()
    path = scratch.folder(spark, "scores")
    _run(asked, inputs, name, model, kind, packing, counts).write.parquet(path)
    scores = spark.read.parquet(path).withColumnRenamed("_out", out)
    return {k: r.join(scores, inputs, "left").select(*r.columns, out) for k, r in requests.items()}
