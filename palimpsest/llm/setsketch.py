"""MinHash near-duplicates with SetSketch registers.

A register holds 1 - floor(log_b(m)), where m is the least of exponential values that its own hash gives to the members of a set, cut to
0..65535: exponentially spaced, truncated minima. Sketches of parts of a set merge by the larger register; registers of alike sets tend to be
equal, so bands of five neighbouring ones are keys of an index. Two sets of similarity 0.85 share at least one of 20 keys with a
probability of 1 - 8e-6.

For a pair that meets, the counts of registers that are larger, smaller and equal and both set sizes give the likelihood of every
similarity. A pair goes unverified only if the best similarity of 0.85 or more is e**12 times less likely than the best of all
(which happens to a linked pair about once in a million); all others are verified on whole sets.

Equal sets are one node from the start (a 128-bit digest of the sorted set), so copies cost nothing further. Dense keys take the way of
``near``, which loses no link. A set of fewer than six shingles can only be linked to equal ones and isn't listed.

Shingles are three words of the text with A-Z lower-cased; a text with fewer words is one shingle. Null and blank texts have an empty set and are
linked with nothing: their component is their own id. Of rows with null ids the component is the least id of the group, null if it has none,
and kept is true then. Repeated rows are copies of each other. Other columns are ignored, whatever their names; an empty table gives an
empty result. Texts of any length count whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, near
from .common import Cached, numbers, raw_texts, written
from .graph import connected_components

#: Words of a shingle; hundredths of the union that must be shared.
SHINGLE, SIMILAR = 3, 85
#: Registers, those of a band, and the ratio of neighbouring register values.
REGISTERS, BAND, BASE = 100, 5, 1.02
#: Rate of the exponential values, so that registers of one-member sets are above 0; log-likelihood by which a pair may fall short.
RATE, SLACK = 20.0, 12.0
#: A set that more than one in HOT rows has is joined by broadcast.
HOT = 1000
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Shingles:
    """Hashes of the shingles of texts; word hashes are remembered within bounds."""

    def __init__(self, words: int = SHINGLE):
        import xxhash

        self.words, self.word = words, Cached(lambda w: xxhash.xxh64_intdigest(w, 42))

    def __call__(self, text: bytes) -> np.ndarray:
        words = text.lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        h = numbers(self.word, words, np.uint64)
        n, k = max(1, len(h) - self.words + 1), min(self.words, len(h))
        acc = np.full(n, k, np.uint64)
        with np.errstate(over="ignore"):
            for j in range(k):
                acc = (acc ^ h[j : j + n]) * _ODD
                acc = (acc ^ (acc >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                acc ^= acc >> np.uint64(32)
        return acc

    def __reduce__(self):  # the remembered words stay where they are
        return Shingles, (self.words,)


@cache
def _factors(m: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(13)
    return r.integers(0, 2**63, m, np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 2**64 - 1, m, np.uint64)


def registers(hashes: np.ndarray, m: int = REGISTERS, base: float = BASE) -> np.ndarray:
    """The registers of a set of hashes; all 0 for an empty one."""
    if not len(hashes):
        return np.zeros(m, np.uint16)
    odd, add = _factors(m)
    least = np.full(m, np.iinfo(np.uint64).max)
    held = np.empty((m, min(256, len(hashes))), np.uint64)
    for i in range(0, len(hashes), 256):
        some = hashes[i : i + 256]
        block = np.multiply(some, odd[:, None], out=held[:, : len(some)])
        block += add[:, None]
        np.minimum(least, block.min(axis=1), out=least)
    uniform = (least.astype(np.float64) + 0.5) / 2.0**64
    x = -np.log1p(-np.minimum(uniform, 1 - 2.0**-53)) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(base)), 0, 65535).astype(np.uint16)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The registers of the union of two sets."""
    return np.maximum(a, b)


def log_likelihood(larger: np.ndarray, smaller: np.ndarray, equal: np.ndarray, u: np.ndarray, j: np.ndarray, base: float = BASE) -> np.ndarray:
    """Of similarity j, for counts of registers in which the first set of a pair is larger, smaller, equal; u: its share of both sizes."""
    p = lambda x: -np.log1p(-np.maximum(x, 0) * (base - 1) / base) / np.log(base)
    up, down = p(u - (1 - u) * j), p((1 - u) - u * j)
    log = lambda x: np.log(np.maximum(x, 1e-12))
    return larger * log(up) + smaller * log(down) + equal * log(1 - up - down)


def estimated(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray, similar: float, steps: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """For pairs (rows) of registers and set sizes: the likeliest similarity, and by how much the likeliest of ``similar`` or more falls short of it."""
    larger, smaller = (x > y).sum(axis=1)[:, None], (x < y).sum(axis=1)[:, None]
    u = (n / (n + m))[:, None]
    most = np.minimum(n, m)[:, None] / np.maximum(n, m)[:, None]
    grid = np.linspace(0, 1, steps + 1)
    args = (larger, smaller, x.shape[1] - larger - smaller, u)
    below = log_likelihood(*args, most * grid)
    low = np.minimum(similar, most)
    above = log_likelihood(*args, low + (most - low) * grid)
    best = np.maximum(below.max(axis=1), above.max(axis=1))
    estimate = most[:, 0] * grid[below.argmax(axis=1)]
    short = np.where(most[:, 0] < similar, np.inf, best - above.max(axis=1))
    return estimate, short


def sketched(docs: DataFrame, k: int = SHINGLE, similar: int = SIMILAR) -> DataFrame:
    """(_id, _th, _none: keys of the row; n: shingles, k1, k2: digest of the set, sig: registers) of every row."""
    listed = near.least_needed(similar)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        hashes = Shingles(k)
        for batch in batches:
            count, keys, sigs = [], [], []
            for t in raw_texts(batch.column("text")):
                s = np.unique(hashes(t))
                count.append(len(s))
                keys.append(np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), "<i8"))
                sigs.append(registers(s).astype("<u2").tobytes() if len(s) >= listed else None)
            k1, k2 = np.array(keys, np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("_id", "_th", "_none")] + [pa.array(count, pa.int64()), pa.array(k1), pa.array(k2), pa.array(sigs, pa.binary())], names=["_id", "_th", "_none", "n", "k1", "k2", "sig"])

    keyed = near.row_key(docs.select("doc_id", "text")).select("_id", "_th", F.col("doc_id").isNull().alias("_none"), "text")
    return keyed.mapInArrow(run, "_id long, _th long, _none boolean, n long, k1 long, k2 long, sig binary")


def likely(pairs: DataFrame, nodes: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """The pairs (a, b) that their registers don't show to be unlike."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, REGISTERS) for c in ("x", "y"))
            n, m = (batch.column(c).to_numpy().astype(float) for c in ("n", "m"))
            keep = pa.array(estimated(x, y, n, m, similar / 100)[1] <= SLACK)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("a", "b")], names=["a", "b"])

    pairs = written(pairs, "near-pairs")
    met = near.with_values(near.with_values(pairs, "a", nodes, {"sig": "x", "n": "n"}), "b", nodes, {"sig": "y", "n": "m"})
    return met.filter(100 * F.least("n", "m") >= similar * F.greatest("n", "m")).select("a", "b", "x", "y", "n", "m").mapInArrow(run, "a long, b long")


def index(nodes: DataFrame) -> DataFrame:
    """(g, node): the keys of each listed node, one for each band of registers."""
    width = 2 * BAND
    keys = F.array(*(F.xxhash64(F.lit(c), F.substring("sig", c * width + 1, width)) for c in range(REGISTERS // BAND)))
    return nodes.filter("sig is not null").select(F.explode(keys).alias("g"), "node")


def grouped(docs: DataFrame, k: int = SHINGLE, similar: int = SIMILAR) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row; see the module for nulls and empty texts."""
    rows = written(sketched(docs, k, similar), "setsketch")
    own = F.when(~F.col("_none"), F.col("_id"))
    nodes = rows.filter("n > 0").groupBy("k1", "k2").agg(F.min(F.struct("_none", "_id", "_th")).alias("b"), F.min(own).alias("least"), F.count("*").alias("copies"), F.max("n").alias("n"), F.max("sig").alias("sig"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "setsketch-nodes")
    edges = near.links(index(nodes), nodes, docs, Shingles(k), similar, lambda pairs: likely(pairs, nodes, similar))
    roots = connected_components(edges)
    of = nodes.join(common.merged(roots), "node", "left").select("k1", "k2", "copies", "least", F.coalesce("root", "node").alias("root"))
    of = written(of, "setsketch-roots")
    named = of.join(common.merged(of.groupBy("root").agg(F.min("least").alias("component_id"))), "root").select("k1", "k2", "copies", "component_id")
    named = written(named, "setsketch-named")
    most = (named.agg(F.sum("copies")).first()[0] or 0) / HOT
    hot = F.broadcast(named.filter(F.col("copies") > most).drop("copies"))  # fewer than HOT
    slim = rows.select(own.alias("doc_id"), F.col("n").alias("n_shingles"), "k1", "k2")
    full = slim.filter("n_shingles > 0")
    cold = full.join(hot, ["k1", "k2"], "left_anti").join(common.merged(named.filter(F.col("copies") <= most).drop("copies")), ["k1", "k2"])
    out = full.join(hot, ["k1", "k2"]).unionByName(cold).drop("k1", "k2")
    out = out.unionByName(slim.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
  s AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 2], ' ') END AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM w WHERE len(w) > 0))),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s AS x JOIN s AS y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
  links AS (SELECT a, b FROM pairs JOIN n AS p ON p.doc_id = a JOIN n AS q ON q.doc_id = b WHERE 100 * shared >= 85 * (p.n + q.n - shared)),
  reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, w.doc_id = m.component_id AS kept FROM w LEFT JOIN n ON n.doc_id = w.doc_id
  JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) AS m ON m.a = w.doc_id"""
