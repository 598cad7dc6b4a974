"""SimHash near-duplicates through an index of positional bytes with count filtering.

A 64-bit fingerprint is eight bytes, each with its place. Two fingerprints that differ in at most d bits agree in at least
8 - d of them, the guaranteed minimum. Lists of single (place, byte) entries would hold a 256th of all fingerprints, so by prefix
filtering the index lists each distinct fingerprint under the combinations of l = 4 of its first d + l places, one of which any
such pair shares. For each pair the places of all entries it meets in are put together and tallied, its last places are added, and
pairs that reach 8 - d matches are verified by bit count.

An entry with more than ``DENSE`` fingerprints (large groups of near copies) would have too many pairs. Its fingerprints take an
exact way that never emits the pairs of a group: two fingerprints are within two bits if and only if some value lies within one
bit of both. Each is listed under itself and its 64 one-bit neighbours; at most 65 distinct fingerprints can meet there, all of
them linked. Both ways find the same links; the bound decides cost, not results.

Texts that share 0.8 of their five-word shingles differ in about ten of 64 SimHash bits: hardly a byte stays, so SimHash bits can't find them. deduplicated(),
which takes that similarity, fills the same kind of index otherwise: a byte in each of 80 places, taken from the least
shingle hash of a place, agrees with a probability equal to the similarity. Entries are 16 keys of five neighbouring places, and a pair
at 0.8 meets in one with probability 0.998. Matching bytes are tallied over all places, pairs with fewer than the number that linked ones reach go (one in
ten million of those doesn't), and all others are verified on the whole sets of shingles. Texts are one node only if their
whole sets are equal, by a digest of 128 bits; dense entries take the way of ``near``, which loses no link.

Equal texts are folded into one fingerprint before any of this, and fingerprints that more than a thousandth of the rows have get
their group by broadcast, so that copies aren't one task. Null and empty texts have fingerprint zero and are linked like any other;
null ids stay in the result, and the least non-null id names a group. Other columns, whatever their names, are ignored (deduplicated()
hands them on). An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations, repeat

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import near
from .common import freed, merged, raw_texts, written
from .graph import connected_components

#: Differing bits up to which fingerprints are linked; the exact way for dense entries rests on it being 2.
BITS = 2
#: An index entry with more members than this takes the exact way for dense groups.
DENSE = 8
#: A fingerprint that more than one in HOT rows has is joined by broadcast.
HOT = 1000
#: Common entries that an index key holds.
KEY_BYTES = 4
#: deduplicated(): words of a shingle and the Jaccard similarity of shingle sets from which texts are near copies.
SHINGLE, SIMILAR = 5, 0.8
#: Its fingerprint has so many places of a byte, so many neighbouring ones make an index key.
PLACES, BAND = 80, 5
#: Matching places below which a pair is out: a pair at SIMILAR falls there once in ten million.
LEAST = 44


def simhash(text: bytes, k: int = 3) -> int:
    """64 bits, each the majority of that bit over XXH64 (seed 42) of the k-word shingles, as a signed number."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    shingles = zip(*(words[i:] for i in range(k))) if len(words) >= k else [words]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, shingles), repeat(42)), np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 32768):
        part = hashes[i : i + 32768].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, k: int = 3) -> DataFrame:
    """(doc_id, fp) of every row."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            fp = [simhash(t, k) for t in raw_texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(fp, pa.int64())], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def _byte(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * i).bitwiseAND(F.lit(255))


def links(nodes: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp`` whose components are those of the pairs within BITS."""
    need = 8 - BITS
    places = BITS + KEY_BYTES
    keys = [sum(0xFF << (8 * i) for i in c) for c in combinations(range(places), KEY_BYTES)]
    signed = [m - (1 << 64) if m >> 63 else m for m in keys]
    entries = F.array(*(F.struct(F.lit(i).cast("tinyint").alias("c"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(signed)))
    index = nodes.select("fp", F.explode(entries).alias("e")).select("fp", "e.c", "e.key")
    sizes = written(index.groupBy("c", "key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).filter("n > 1"), "simhash-entries")
    masks = [sum(1 << p for p in c) for c in combinations(range(places), KEY_BYTES)]
    shared = F.element_at(F.array(*(F.lit(m) for m in masks)), F.col("c").cast("int") + 1)  # the places an entry stands for
    pairs = sizes.filter("n = 2").select("a", "b", shared.alias("places"))
    met = index.join(merged(sizes.filter("n > 2").select("c", "key", "n")), ["c", "key"])
    few = met.filter(F.col("n") <= DENSE).groupBy("c", "key").agg(F.sort_array(F.collect_list("fp")).alias("m"))
    each = F.flatten(F.transform("m", lambda x, i: F.transform(F.slice("m", i + 2, F.lit(DENSE)), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    pairs = pairs.unionByName(few.select(shared.alias("places"), F.explode(each).alias("p")).select("p.*", "places"))
    tallied = pairs.groupBy("a", "b").agg(F.bit_count(F.bit_or("places")).alias("matches"))
    rest = sum((F.when(_byte(F.col("a"), i) == _byte(F.col("b"), i), 1).otherwise(0) for i in range(places, 8)), F.lit(0))
    pairs = tallied.filter(F.col("matches") + rest >= need).filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= BITS).select("a", "b")
    dense = met.filter(F.col("n") > DENSE).select("fp").distinct()
    flips = [0, *(1 << i for i in range(63)), -(1 << 63)]
    ball = dense.select("fp", F.explode(F.array(*(F.col("fp").bitwiseXOR(F.lit(m)) for m in flips))).alias("mid"))
    near = ball.groupBy("mid").agg(F.min("fp").alias("a"), F.sort_array(F.collect_list("fp")).alias("m")).filter(F.size("m") > 1)
    star = near.select("a", F.explode("m").alias("b")).filter("a <> b")
    return pairs.unionByName(star).distinct()


def _named(rows: DataFrame) -> DataFrame:
    """(fp, root) of every distinct fingerprint in ``rows``."""
    nodes = written(rows.select("fp").distinct(), "simhash-nodes")
    roots = connected_components(links(nodes))
    return written(nodes.join(merged(roots), F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root")), "simhash-roots")


def grouped(docs: DataFrame, k: int = 3) -> DataFrame:
    """(doc_id, fingerprint as 16 hex digits, component_id) of every row; see the module for nulls and empty texts."""
    rows = written(fingerprints(docs, k), "simhash")
    of_fp = _named(rows)
    least = rows.groupBy("fp").agg(F.min("doc_id").alias("least")).join(merged(of_fp), "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    sizes = rows.groupBy("fp").agg(F.count("*").alias("n"))
    named = written(of_fp.join(merged(least), "root").join(merged(sizes), "fp").select("fp", "component_id", "n"), "simhash-named")
    most = (named.agg(F.sum("n")).first()[0] or 0) / HOT
    hot = F.broadcast(named.filter(F.col("n") > most).select("fp", "component_id"))  # fewer than HOT
    cold = rows.join(hot.select("fp"), "fp", "left_anti").join(merged(named.filter(F.col("n") <= most).select("fp", "component_id")), "fp")
    out = rows.join(hot, "fp").unionByName(cold)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def shingle_hashes(text: bytes, k: int = SHINGLE) -> np.ndarray:
    """XXH64 (seed 42) of the k-word shingles of a text, repeats included; fewer words are one shingle, and so is no word."""
    import xxhash

    words = text.lower().split()
    shingles = zip(*(words[i:] for i in range(k))) if len(words) >= k else [words]
    return np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, shingles), repeat(42)), np.uint64)


def least_bytes(hashes: np.ndarray) -> bytes:
    """One byte at each of PLACES places: of the least of the hashes, multiplied by the place's odd number, a byte that all its bits decide."""
    odd = np.random.default_rng(42).integers(0, 2**63, PLACES, np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.full(PLACES, np.iinfo(np.uint64).max)
    for i in range(0, len(hashes), 1024):
        np.minimum(least, (hashes[i : i + 1024] * odd[:, None]).min(axis=1), out=least)
    return ((least ^ (least >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(56)).astype(np.uint8).tobytes()


def _tallied(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose fingerprints agree in LEAST places or more."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, PLACES) for c in ("x", "y"))
            keep = pa.array((x == y).sum(axis=1) >= LEAST)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("a", "b")], names=["a", "b"])

    pairs = written(pairs, "near-pairs")
    met = near.with_values(near.with_values(pairs, "a", nodes, {"sig": "x"}), "b", nodes, {"sig": "y"})
    return met.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def near_links(nodes: DataFrame, docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """Edges (a, b) between ``nodes`` (node, n: its shingles, sig, b: keys of one row of docs with its text) at a similarity of SIMILAR or more."""
    keys = F.array(*(F.xxhash64(F.lit(c), F.substring("sig", c * BAND + 1, BAND)) for c in range(PLACES // BAND)))
    hundredths = round(100 * SIMILAR)
    index = nodes.filter(F.col("n") >= near.least_needed(hundredths)).select(F.explode(keys).alias("g"), "node")
    return near.links(index, nodes, docs, partial(shingle_hashes, k=k), hundredths, lambda pairs: _tallied(pairs, nodes))


def deduplicated(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """docs with one row of each group of near copies (shingles of k words, similarity SIMILAR): the least id (none after all
    others), of rows with that id the first by a hash of the text, of rows equal in both the first by a hash of all columns.

    Groups are found on fingerprints; the texts are moved once, to meet the keys of the rows that stay, by a join that is dealt by
    key at every size. Texts of pairs that may be near are read again.
    """
    names = docs.columns

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        for batch in batches:
            sets = [np.unique(shingle_hashes(t, k)) for t in raw_texts(batch.column("text"))]
            k1, k2 = np.array([np.frombuffer(xxhash.xxh3_128_digest(x.tobytes()), "<i8") for x in sets], np.int64).reshape(-1, 2).T
            more = [pa.array([len(x) for x in sets], pa.int64()), pa.array(k1), pa.array(k2), pa.array(map(least_bytes, sets), pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("_id", "_th", "_none")), *more], names=["_id", "_th", "_none", "n", "k1", "k2", "sig"])

    keyed = near.row_key(docs.select("doc_id", "text")).select("_id", "_th", F.col("doc_id").isNull().alias("_none"), "text")
    rows = written(keyed.mapInArrow(freed(run), "_id long, _th long, _none boolean, n long, k1 long, k2 long, sig binary"), "near")
    nodes = rows.groupBy("k1", "k2").agg(F.min(F.struct("_none", "_id", "_th")).alias("b"), F.max("n").alias("n"), F.max("sig").alias("sig"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "near-nodes")
    roots = connected_components(near_links(nodes, docs, k))
    best = nodes.join(merged(roots), "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("b").alias("b"))
    kept = written(best.select("b._id", "b._th"), "near-kept")
    repeated = rows.join(merged(kept), ["_id", "_th"]).groupBy("_id", "_th").agg(F.count("*").alias("n")).filter("n > 1")
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row"), "doc_id", "text")
    own = near.row_key(own).select("_row", "_id", "_th").join(kept.hint("shuffle_hash"), ["_id", "_th"], "left_semi")
    if not repeated.isEmpty():
        text = F.to_json("_row")
        own = own.groupBy("_id", "_th").agg(F.min_by("_row", F.struct(F.xxhash64(text), text)).alias("_row"))
    return own.select("_row.*")
