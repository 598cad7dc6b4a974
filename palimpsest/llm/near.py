"""Links between near copies: from an index of keys to verified pairs, without the pairs of a group.

An index lists each node (a distinct set of shingles) under several keys. Keys with up to ``DENSE`` nodes give all their pairs. A key with more takes
this way, which finds the same components:

1. All its nodes are held against two pivots, the same for all keys that these are under. In a group of near copies that mostly joins them all.
2. Keys that hold nodes of more than one component then belong to the largest of these. Their nodes outside it, the rest, are held in blocks
   against all nodes of keys that belong to it: a task keeps the sets of a block and streams the others past them, so only links leave it, never
   pairs. That goes on, with the components found meanwhile, until no key has two nodes of different components that weren't compared.

So every pair that shares a key is compared or lies within one component. Every pair is verified on whole sets of
shingle hashes (64 bits); what sketches say only spares pairs this. Values of nodes that are in many pairs are dealt in copies.
Time grows with the product of a key's nodes and its rest; the rest of a group of near copies is what is linked to none of the
others, or to few.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import freed, joined_to_groups, merged, raw_texts, written
from .graph import connected_components

#: A key with more nodes than this takes the way for dense ones; shingles in a block's sets, about; nodes that a task streams past it, about.
DENSE, BLOCK, STREAMED = 8, 2_000_000, 20_000
#: Pairs of one node that one task gets its values for.
SPREAD = 64

Hashes = Callable[[bytes], np.ndarray]
Check = Callable[[DataFrame], DataFrame]


def row_key(df: DataFrame) -> DataFrame:
    """df with ``_id`` and ``_th``, which tell rows apart by id and text without moving either."""
    return df.withColumns({"_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "_th": F.xxhash64(F.col("doc_id").isNull(), F.coalesce("text", F.lit("")))})


def with_values(pairs: DataFrame, side: str, values: DataFrame, names: dict[str, str]) -> DataFrame:
    """pairs with columns of ``values`` (node and others) for their ``side``, under new names. A node in many pairs gets copies of its values."""
    other = "b" if side == "a" else "a"
    many = pairs.groupBy(side).agg(F.ceil(F.count("*") / SPREAD).cast("int").alias("_copies")).filter("_copies > 1")
    many = written(many, "near-copies")
    dealt = joined_to_groups(pairs, many, [side]).withColumn("_part", F.pmod(F.xxhash64(other), F.coalesce("_copies", F.lit(1))).cast("int")).drop("_copies")
    own = values.select(F.col("node").alias(side), *(F.col(c).alias(n) for c, n in names.items()))
    own = joined_to_groups(own, many, [side]).withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_copies", F.lit(1)) - 1))).drop("_copies")
    return dealt.join(merged(own), [side, "_part"]).drop("_part")


def sets_of(asked: DataFrame, nodes: DataFrame, docs: DataFrame, hashes: Hashes) -> DataFrame:
    """(node, s): the sorted distinct shingle hashes of the asked nodes, from the one row of docs that ``nodes.b`` names."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            sets = [np.unique(hashes(t)).view(np.int64) for t in raw_texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.list_(pa.int64()))], names=["node", "s"])

    keys = written(asked.select("node").distinct().join(merged(nodes), "node").select("node", "b._id", "b._th"), "near-asked")
    texts = joined_to_groups(row_key(docs.select("doc_id", "text")).select("_id", "_th", "text"), keys, ["_id", "_th"]).filter("node is not null")
    return written(texts.select("node", "text").mapInArrow(freed(run), "node long, s array<bigint>").dropDuplicates(["node"]), "near-sets")


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, hashes: Hashes, hundredths: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= hundredths * union of their whole sets."""
    pairs = written(pairs, "near-doubtful")
    if pairs.isEmpty():
        return pairs.select("a", "b")
    sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node")), nodes, docs, hashes)
    met = with_values(with_values(pairs.select("a", "b"), "a", sets, {"s": "x"}), "b", sets, {"s": "y"})

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            keep = []
            x, y = batch.column("x"), batch.column("y")
            for i in range(batch.num_rows):
                p, q = (c[i].values.to_numpy() for c in (x, y))
                both = len(p) + len(q) - len(np.union1d(p, q)) if 100 * min(len(p), len(q)) >= hundredths * max(len(p), len(q)) else -1
                keep.append(100 * both >= hundredths * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in (batch.column("a"), batch.column("b"))], names=["a", "b"])

    return met.select("a", "b", "x", "y").mapInArrow(freed(run), "a long, b long")


def _ordered(x: Column, y: Column) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _few(met: DataFrame) -> DataFrame:
    """All pairs of nodes of different components ``c`` (any, if there is none) under keys with at most DENSE of them."""
    each = lambda x, i: F.transform(F.slice("m", i + 2, F.lit(DENSE)), lambda y: F.struct(x.alias("x"), y.alias("y")))
    lists = met.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("node", "c"))).alias("m"))
    return lists.select(F.explode(F.flatten(F.transform("m", each))).alias("e")).filter("e.x.c <> e.y.c").select(*_ordered(F.col("e.x.node"), F.col("e.y.node")))


def _met(index: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Pairs under keys that are not dense, with two pivots under those that are; and (g, node, c) under the dense keys."""
    ends = F.struct(F.xxhash64("node").alias("h"), "node")
    sizes = index.groupBy("g").agg(F.count("*").alias("n"), F.min(ends).alias("p"), F.max(ends).alias("q"), F.min("c").alias("c0"), F.max("c").alias("c1"))
    sizes = written(sizes.filter("c0 <> c1").select("g", "n", F.col("p.node").alias("p"), F.col("q.node").alias("q")), f"{name}-keys")
    met = written(joined_to_groups(index, sizes.filter("n > 2"), ["g"]).filter("n is not null"), f"{name}-met")
    dense = met.filter(F.col("n") > DENSE)
    star = dense.select("node", F.explode(F.array("p", "q")).alias("o")).filter("node <> o").select(*_ordered(F.col("node"), F.col("o")))
    pairs = sizes.filter("n = 2").select(*_ordered(F.col("p"), F.col("q"))).unionByName(_few(met.filter(F.col("n") <= DENSE))).unionByName(star)
    return pairs.distinct(), dense.select("g", "node", "c")


class Links:
    """Edges found so far, and the component of each node by them."""

    def __init__(self):
        self.found: list[DataFrame] = []

    def add(self, edges: DataFrame, name: str) -> bool:
        self.found.append(written(edges.select("a", "b"), name))
        return not self.found[-1].isEmpty()

    def all(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.found).distinct()

    def named(self, members: DataFrame, name: str) -> DataFrame:
        """members (g, node) with their component c, under keys that hold more than one."""
        roots = connected_components(self.all())
        now = written(members.select("g", "node").join(merged(roots), "node", "left").select("g", "node", F.coalesce("root", "node").alias("c")), name)
        open_keys = now.groupBy("g").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).filter("c0 <> c1")
        return joined_to_groups(now, written(open_keys.select("g", F.lit(True).alias("open")), f"{name}-open"), ["g"]).filter("open").drop("open")


def compared(members: DataFrame, pivots: DataFrame, sets: DataFrame, hundredths: int) -> DataFrame:
    """Edges (a, b) from ``members`` (m, node, c) to ``pivots`` (m, node, c) of the same m whose sets are similar, one for each component c
    of pivots but the member's own."""
    salts = 1 + members.count() // STREAMED
    own = pivots.select("m", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(False).alias("streamed"), "node", "c")
    rest = members.select("m", F.pmod(F.xxhash64("node"), F.lit(salts)).cast("int").alias("salt"), F.lit(True).alias("streamed"), "node", "c")
    dealt = own.unionByName(rest).join(merged(sets), "node").select("m", "salt", "streamed", "node", "c", "s")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        key, held, block = None, [], None

        def laid_out():
            """The block's distinct hashes, and which pivots have each."""
            hashes = np.concatenate([x for _, _, x in held])
            of = np.repeat(np.arange(len(held)), [len(x) for _, _, x in held])
            order = np.argsort(hashes, kind="stable")
            own, first = np.unique(hashes[order], return_index=True)
            return own, np.append(first, len(hashes)), of[order], np.array([len(x) for _, _, x in held]), np.array([x[0] for x in held]), np.array([x[1] for x in held])

        for batch in batches:
            found = ([], [])
            m, salt, streamed, node, c = (batch.column(x).to_pylist() for x in ("m", "salt", "streamed", "node", "c"))
            sets = batch.column("s")
            for i in range(batch.num_rows):
                if (m[i], salt[i]) != key:
                    key, held, block = (m[i], salt[i]), [], None
                s = sets[i].values.to_numpy()
                if not streamed[i]:
                    held.append((node[i], c[i], s))
                    continue
                if block is None:
                    if not held:
                        continue
                    block = laid_out()
                own, first, of, sizes, nodes, comps = block
                at = np.searchsorted(own, s)
                at[at == len(own)] = 0
                at = at[own[at] == s]
                begin, n = first[at], first[at + 1] - first[at]
                where = np.repeat(begin - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else n
                both = np.bincount(of[where], minlength=len(sizes))
                hit = np.flatnonzero((100 * both >= hundredths * (len(s) + sizes - both)) & (comps != c[i]))
                if len(hit):
                    hit = hit[np.unique(comps[hit], return_index=True)[1]]
                    found[0].extend([node[i]] * len(hit))
                    found[1].extend(nodes[hit].tolist())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["a", "b"])

    return dealt.repartition("m", "salt").sortWithinPartitions("m", "salt", "streamed").mapInArrow(run, "a long, b long")


def links(index: DataFrame, nodes: DataFrame, docs: DataFrame, hashes: Hashes, hundredths: int, check: Check) -> DataFrame:
    """Edges (a, b) with the components of all pairs of nodes that share a key of ``index`` (g, node) and are similar.

    ``check`` leaves out pairs that sketches show to be unlike; what it keeps is verified.
    """
    out = Links()
    pairs, dense = _met(index.select("g", "node", F.col("node").alias("c")), "near")
    out.add(verified(check(pairs), nodes, docs, hashes, hundredths), "near-links")
    sets = used = None
    while not dense.isEmpty():
        left = out.named(dense, "near-dense")
        sizes = left.groupBy("g", "c").agg(F.count("*").alias("n")).groupBy("g").agg(F.max_by("c", F.struct("n", "c")).alias("m"))
        left = written(joined_to_groups(left, written(sizes, "near-main"), ["g"]), "near-left")
        rest = left.filter("c <> m").select("g", "m", "node", "c")
        rest = rest if used is None else rest.join(merged(used), ["g", "node"], "left_anti")
        if rest.isEmpty():
            break
        if sets is None:
            sets = sets_of(left, nodes, docs, hashes)
        order = Window.partitionBy("m").orderBy(F.xxhash64("node"), "node").rowsBetween(Window.unboundedPreceding, -1)
        ranked = rest.select("m", "node", "c").distinct().join(merged(sets.select("node", F.size("s").alias("n"))), "node").withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0)))
        pivots = written(ranked.filter(F.col("before") < BLOCK).select("m", "node", "c"), "near-pivots")
        out.add(compared(left.select("m", "node", "c").distinct(), pivots, sets, hundredths), "near-links")
        asked = rest.join(merged(pivots.select("m", "node")), ["m", "node"], "left_semi").select("g", "node")
        used = written(asked if used is None else used.unionByName(asked), "near-used")
        dense = left.select("g", "node")
    return out.all()


def least_needed(hundredths: int) -> int:
    """The fewest shingles of a set that can be linked to another one, as part of one with a shingle more: below it only equal sets are."""
    return math.ceil(hundredths / (100 - hundredths)) if hundredths < 100 else 1 << 30
