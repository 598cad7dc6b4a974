"""Toxicity by a factorization machine over hashed terms.

A document's terms are its words, lower-cased and without signs at both ends, and their first four, five and six letters, hashed
into 2^18 buckets; a term that occurs n times has the value (1 + log2 n) / 2. The machine scores bias + sum of w_i x_i + sum over
pairs of <v_i, v_j> x_i x_j, so that a pair (an insult with a mention of a group) can count for more than its words alone.

It is fitted on the driver on a bounded sample, at most ``SAMPLE`` labelled rows, taken by hash of the id. Every bucket that
``LEAST`` of these rows hold takes part: proximal Adam steps with an L1 threshold on each weight and on the length of each factor
leave at exactly zero what the labels say nothing about. Steps between full ones run over the buckets that aren't zero; each full
step puts back those whose gradient passes the threshold. What is sent to score with is what isn't zero. Scoring reads every row
and every word; a word whose buckets are all zero adds zero.

Null and empty texts are scored by the bias alone. Rows without a label, with a null label or a null id aren't learned from; of
repeated labels the largest counts. With no labels of either kind, every score is the share of positive ones, or 0. Rows that
repeat are scored each, with equal scores; other columns of the documents, whatever their names, are ignored (``without_toxic``
hands them on). An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Cached, fold, freed, raw_texts

SAMPLE, LEAST, FACTORS, BUCKETS = 5000, 3, 6, 1 << 18
#: Steps of the fit: how many, how many at first with all buckets, and how often all buckets are looked at after them.
STEPS, FIRST, AGAIN, RATE, THRESHOLD = 45, 6, 12, 0.1, 4e-3
#: Entries of the sample that a step of the fit works on at once.
ENTRIES = 1 << 16
SIGNS = b".,;:!?\"'`|*#%&$()[]{}<>=+-_~"


def buckets(word: bytes) -> tuple[int, ...]:
    """Of a lower-cased word and its first letters."""
    word = word.strip(SIGNS)
    letters = word.decode("utf-8", "replace")
    return tuple({crc32(x) & (BUCKETS - 1) for x in (word, *(b"^" + letters[:n].encode("utf-8", "replace") for n in (4, 5, 6) if len(letters) >= n))})


def counted(terms: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct terms and their values."""
    at, n = np.unique(np.array(terms, np.int64), return_counts=True)
    return at, 0.5 + 0.5 * np.log2(n)


class Machine:
    """Bias, weights and factors of the buckets that have any."""

    def __init__(self, kept: np.ndarray, bias: float, weights: np.ndarray, factors: np.ndarray):
        self.at = {int(b): i for i, b in enumerate(kept)}
        self.bias, self.weights, self.factors = bias, weights, factors

    def features(self, word: bytes) -> tuple[int, ...]:
        return tuple(self.at[b] for b in buckets(word) if b in self.at)

    def score(self, text: bytes, of: Cached) -> float:
        """Of a text, with the features of words remembered in ``of``."""
        at, x = counted(list(chain.from_iterable(map(of.__getitem__, text.lower().split()))))
        v = self.factors[at] * x[:, None]
        s = self.bias + float(self.weights[at] @ x) + 0.5 * float((v.sum(axis=0) ** 2 - (v * v).sum(axis=0)).sum())
        return float(1.0 / (1.0 + np.exp(-np.clip(s, -30, 30))))


def _blocks(starts: np.ndarray, total: int) -> list[tuple[int, int]]:
    """Runs of groups, which start at ``starts``, with about ENTRIES entries each: what is held at once stays small."""
    cuts = np.unique(np.searchsorted(starts, np.arange(0, total, ENTRIES)))
    return list(zip(cuts, [*cuts[1:], len(starts)]))


class _Entries:
    """The entries (row, column, value) of some columns, in both orders. Each of the columns has an entry."""

    def __init__(self, n: int, row: np.ndarray, col: np.ndarray, x: np.ndarray, columns: np.ndarray):
        if len(columns) == int(col.max(initial=-1)) + 1:  # all of them: no copies
            self.col, self.x = col, x
        else:
            number = np.full(int(col.max(initial=0)) + 1, -1, np.int32)
            number[columns] = np.arange(len(columns), dtype=np.int32)
            use = number[col] >= 0
            row, self.col, self.x = row[use], number[col[use]], x[use]
        self.n, self.row_at = n, np.flatnonzero(np.diff(row, prepend=-1))  # rows ascend
        self.rows = row[self.row_at]
        ends = np.cumsum(np.bincount(self.col, minlength=len(columns)))
        self.col_at = np.concatenate([[0], ends])[: len(columns)]
        self.by_row, self.by_x = np.empty_like(row), np.empty_like(self.x)
        for a, b in _blocks(self.col_at, len(row)):  # in order of columns, some of them at a time
            if a == b:
                continue
            last = b - 1
            here = np.flatnonzero((self.col >= a) & (self.col <= last))
            here = here[np.argsort(self.col[here], kind="stable")]
            at = slice(self.col_at[a], ends[last])
            self.by_row[at], self.by_x[at] = row[here], self.x[here]
        self.row_blocks, self.col_blocks = _blocks(self.row_at, len(row)), _blocks(self.col_at, len(row))

    def gradient(self, bias: float, theta: np.ndarray, labels: np.ndarray) -> tuple[float, np.ndarray]:
        """Of the mean log loss by the bias and by theta (weight, then factors), which is zero outside these columns."""
        sums, squares = np.zeros((self.n, theta.shape[1]), np.float32), np.zeros(self.n, np.float32)
        ends = np.append(self.row_at, len(self.col))
        for a, b in self.row_blocks:
            here = slice(ends[a], ends[b])
            part = theta[self.col[here]] * self.x[here, None]
            sums[self.rows[a:b]] = np.add.reduceat(part, self.row_at[a:b] - ends[a])
            squares[self.rows[a:b]] = np.add.reduceat((part[:, 1:] ** 2).sum(axis=1), self.row_at[a:b] - ends[a])
        z = bias + sums[:, 0] + 0.5 * ((sums[:, 1:] ** 2).sum(axis=1) - squares)
        g = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) / self.n).astype(np.float32)
        sums[:, 0] = 1
        lead, out, ends = sums * g[:, None], np.zeros_like(theta), np.append(self.col_at, len(self.col))
        for a, b in self.col_blocks:
            here, at = slice(ends[a], ends[b]), self.col_at[a:b] - ends[a]
            row, x = self.by_row[here], self.by_x[here]
            out[a:b] = np.add.reduceat(lead[row] * x[:, None], at)
            out[a:b, 1:] -= theta[a:b, 1:] * np.add.reduceat(g[row] * x * x, at)[:, None]
        return float(g.sum()), out


def fit(size: np.ndarray, flat: np.ndarray, values: np.ndarray, labels: np.ndarray, steps: int = STEPS, rate: float = RATE, threshold: float = THRESHOLD) -> Machine:
    """A machine for 0/1 ``labels``; row i has the next size[i] of the buckets ``flat`` with their values."""
    n, n_pos = len(size), int(labels.sum())
    if n == 0 or n_pos in (0, n):
        share = n_pos / n if n else 0.0
        return Machine(np.zeros(0, np.int64), float(np.clip(np.log(max(share, 1e-12) / max(1 - share, 1e-12)), -30, 30)), np.zeros(0), np.zeros((0, FACTORS)))
    rows_of = np.zeros(BUCKETS, np.int64)
    for i in range(0, len(flat), ENTRIES):
        rows_of += np.bincount(flat[i : i + ENTRIES], minlength=BUCKETS)
    kept = np.flatnonzero(rows_of >= LEAST)
    place = np.full(BUCKETS, -1, np.int32)
    place[kept] = np.arange(len(kept))
    col = place[flat]
    del flat  # the caller holds no other: what is kept of them is enough
    use = col >= 0
    entry = np.repeat(np.arange(n, dtype=np.int32), size)[use], col[use], values[use].astype(np.float32)
    del col, use, values
    every = _Entries(n, *entry, np.arange(len(kept)))
    theta = np.zeros((len(kept), 1 + FACTORS), np.float32)
    theta[:, 1:] = np.random.default_rng(7).normal(0, 0.05, (len(kept), FACTORS))
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    bias, bias_first, bias_second = float(np.log(n_pos / (n - n_pos))), 0.0, 0.0
    live, some = np.arange(len(kept)), every
    for step in range(1, steps + 1):
        full = step <= FIRST or step % AGAIN == 0
        at, entries = (np.arange(len(kept)), every) if full else (live, some)
        slope, gradient = entries.gradient(bias, theta[at], labels)
        bias_first, bias_second = 0.9 * bias_first + 0.1 * slope, 0.999 * bias_second + 0.001 * slope * slope
        bias -= rate * (bias_first / (1 - 0.9**step)) / (np.sqrt(bias_second / (1 - 0.999**step)) + 1e-8)
        first[at] = 0.9 * first[at] + 0.1 * gradient
        second[at] = 0.999 * second[at] + 0.001 * gradient * gradient
        if step > FIRST and full:  # those at zero have had no steps since the last full one
            idle = ~theta.any(axis=1)
            first[idle] = gradient[idle] * (1 - 0.9**step)
        pace = rate / (np.sqrt(second[at] / (1 - 0.999**step)) + 1e-5)
        now = theta[at] - pace * first[at] / (1 - 0.9**step)
        now[:, 0] = np.sign(now[:, 0]) * np.maximum(np.abs(now[:, 0]) - pace[:, 0] * threshold, 0)
        length = np.sqrt((now[:, 1:] ** 2).sum(axis=1))
        now[:, 1:] *= np.maximum(1 - pace[:, 1:].mean(axis=1) * threshold / np.maximum(length, 1e-9), 0)[:, None]
        theta[at] = now
        if full and step >= FIRST:
            live, some = np.flatnonzero(theta.any(axis=1)), None
            if 2 * len(live) < len(kept):
                some = _Entries(n, *entry, live)
            else:  # hardly less work, and as much memory again
                live, some = np.arange(len(kept)), every
    live = np.flatnonzero(theta.any(axis=1))
    return Machine(kept[live], bias, theta[live, 0].astype(float), theta[live, 1:].astype(float))


def trained(docs: DataFrame, labels: DataFrame) -> Machine:
    """A machine learned from at most SAMPLE labelled rows of docs whose fold of 5 is not 0."""
    import pyarrow as pa

    known = labels.select("doc_id", "toxic").filter("doc_id is not null and toxic is not null").filter(fold(F.col("doc_id"), 5) != 0)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        of = Cached(buckets)
        for batch in batches:
            rows = [counted(list(chain.from_iterable(map(of.__getitem__, t.lower().split())))) for t in raw_texts(batch.column("text"))]
            terms = pa.array([at for at, _ in rows], pa.list_(pa.int32()))
            values = pa.array([x for _, x in rows], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("toxic").cast(pa.int32()), terms, values], names=["doc_id", "toxic", "terms", "x"])

    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most SAMPLE rows
    got = texts.mapInArrow(run, "doc_id long, toxic int, terms array<int>, x array<float>").toArrow().sort_by("doc_id").combine_chunks()
    terms, values = got.column("terms").combine_chunks(), got.column("x").combine_chunks()
    size, labels_ = np.asarray(terms.value_lengths()).astype(np.int64), (np.asarray(got.column("toxic")) > 0).astype(float)
    columns = [np.asarray(terms.flatten()), np.asarray(values.flatten())]
    del got, terms, values
    pa.default_memory_pool().release_unused()
    return fit(size, columns.pop(0), columns.pop(), labels_)


def scored(docs: DataFrame, machine: Machine) -> DataFrame:
    """(doc_id, score) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # at most BUCKETS * (FACTORS + 1) numbers

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        model = shared.value
        of = Cached(model.features)
        for batch in batches:
            scores = [model.score(t, of) for t in raw_texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def predicted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs."""
    out = scored(docs, trained(docs, labels))
    return out.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs but for the rows predicted toxic; columns and repeated rows stay as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(trained(docs, labels))
    names = docs.columns

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        model = shared.value
        of = Cached(model.features)
        for batch in batches:
            keep = [model.score(t, of) < 0.5 for t in raw_texts(batch.column("text"))]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.select(*names).mapInArrow(freed(run), docs.schema)
