"""A linear text encoder, trained on pairs of texts that belong together.

A text is the log counts of its terms' hash buckets, projected to a unit vector; the projection starts random and learns that a question lies nearer
to its own text than to the others of its batch (cross-entropy over cosines). Batches are made once, by a hash of the pair: a batch is one row,
so partitions don't show in it. Every step is one pass in which each task sums its batches' gradients; the sums are added in a tree, and the
driver holds the projection, BUCKETS x DIMENSIONS numbers, alone.

Equal pairs count once. A null or empty text has no vector (null) and its pairs teach nothing. Without two pairs in any batch nothing is learned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import scratch

#: Sums that a task of the tree adds up; texts that are projected at once.
FAN, TILE = 8, 256
#: Bytes of a row group of batches, and of a task of a step at most; tasks of a step a core, at least.
GROUP, SPLIT, WAVES = 2 << 20, 32 << 20, 4
#: Logs of 1 + 0 to 255 times.
LOGS = np.log1p(np.arange(256, dtype=np.float64))


@dataclass(frozen=True)
class Settings:
    """Size of the projection, pairs of a batch (about), temperature of the cosines, steps of Adam, their rate, and the seed."""

    buckets: int = 4096
    dimensions: int = 64
    batch: int = 128
    temperature: float = 0.05
    steps: int = 20
    rate: float = 0.02
    seed: int = 7


def bucketed(terms: Column, buckets: int) -> Column:
    return F.transform(terms, lambda t: F.pmod(F.xxhash64(t), F.lit(buckets)).cast("int"))


def counted(rows: list, buckets: int) -> np.ndarray:
    """Log counts of buckets, a row for each list."""
    return np.log1p(np.stack([np.bincount(np.asarray(r, np.int64), minlength=buckets) for r in rows]).astype(np.float64))


_ENTRY = np.dtype([("at", "<u4"), ("times", "<u4")])


def _counts(rows, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(row * buckets + bucket, times) of what isn't zero; rows are an Arrow list column."""
    size = np.asarray(rows.value_lengths().fill_null(0), np.int64)
    return np.unique(np.repeat(np.arange(len(size)), size) * buckets + np.asarray(rows.flatten(), np.int64), return_counts=True)


def _entries(rows, buckets: int) -> bytes:
    """What isn't zero in counted(rows), so that steps don't count again; rows may be an Arrow list column."""
    import pyarrow as pa

    at, n = _counts(rows if isinstance(rows, pa.Array) else pa.array(rows, pa.list_(pa.int32())), buckets)
    out = np.empty(len(at), _ENTRY)
    out["at"], out["times"] = at, n
    return out.tobytes()


def _matrix(entries: bytes, n: int, buckets: int) -> np.ndarray:
    found = np.frombuffer(entries, _ENTRY)
    out = np.zeros((n, buckets))
    out.ravel()[found["at"]] = _logs(found["times"])
    return out


def _logs(times: np.ndarray) -> np.ndarray:
    """log(1 + times), most of which are looked up."""
    out = LOGS[np.minimum(times, len(LOGS) - 1)]
    large = times >= len(LOGS)
    if large.any():
        out[large] = np.log1p(times[large].astype(np.float64))
    return out


class _Room:
    """Memory for log counts, taken once and zero between uses: fresh pages, and zeroing all of them, cost as much as the products."""

    def __init__(self):
        self.held, self.at = np.zeros(0), np.zeros(0, np.int64)

    def laid(self, at: np.ndarray, times: np.ndarray, n: int, buckets: int) -> tuple[np.ndarray | slice, np.ndarray]:
        """The buckets that n rows have, all if they have most, and the rows' log counts in them; good until the next call."""
        self.held[self.at] = 0
        if n * buckets > len(self.held):
            self.held = np.zeros(n * buckets)
        bucket = at % buckets
        place = np.zeros(buckets, np.int64)
        place[bucket] = 1
        used, width = np.flatnonzero(place), buckets
        if 2 * len(used) < buckets:
            width = len(used)
            place[used] = np.arange(width)
            at = at // buckets * width + place[bucket]
        else:
            used = slice(None)
        self.at = at
        self.held[at] = _logs(times)
        return used, self.held[: n * width].reshape(n, width)


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    length = np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    return x / length, length


def gradient(weights: np.ndarray, asked: np.ndarray, own: np.ndarray, temperature: float) -> tuple[np.ndarray, float]:
    """(gradient, loss) summed over a batch's questions: -log of each one's share of exp(cosine / temperature) over all texts of the batch."""
    return _gradient(weights, np.concatenate([asked, own]), temperature)


def _gradient(weights: np.ndarray, both: np.ndarray, temperature: float) -> tuple[np.ndarray, float]:
    """gradient() of questions and, below them, their texts: one product there and one back."""
    unit, lengths = _unit(both @ weights)
    (q, p), (q_length, p_length) = np.split(unit, 2), np.split(lengths, 2)
    score = q @ p.T / temperature
    score -= score.max(axis=1, keepdims=True)
    share = np.exp(score)
    share /= share.sum(axis=1, keepdims=True)
    loss = -np.log(np.maximum(np.diagonal(share), 1e-300)).sum()
    slope = (share - np.eye(len(q))) / temperature
    back = lambda unit, length, d: (d - unit * (unit * d).sum(axis=1, keepdims=True)) / length
    wide = np.concatenate([back(q, q_length, slope @ p), back(p, p_length, slope.T @ q)]).T @ both  # this way round rows of both are read as they lie
    return wide.T, float(loss)


@dataclass
class Encoder:
    settings: Settings
    weights: np.ndarray
    losses: list[float] = field(default_factory=list)

    def encoded(self, df: DataFrame, terms: Column, into: str = "embedding", ready: bool = False) -> DataFrame:
        """df with the unit vector of a column of terms, or of their buckets if it is ``ready``."""
        sent, buckets = df.sparkSession.sparkContext.broadcast(self.weights), self.settings.buckets

        def vectors(lists):
            import pyarrow as pa

            known = np.asarray(lists.value_lengths().fill_null(0)) > 0
            texts, room, out = lists.filter(pa.array(known)), _Room(), [np.zeros((0, sent.value.shape[1]))]
            for i in range(0, len(texts), TILE):
                some = texts.slice(i, TILE)
                used, both = room.laid(*_counts(some, buckets), len(some), buckets)
                out.append(_unit(both @ sent.value[used])[0])
            offsets = np.concatenate([[0], np.cumsum(known)]) * sent.value.shape[1]
            return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(out).ravel()), mask=pa.array(~known))

        # Not said to be deterministic: a filter on the vectors would then be moved below them and make them once more.
        return df.withColumn(into, F.arrow_udf(vectors, "array<double>").asNondeterministic()(terms if ready else bucketed(terms, buckets)))


def untrained(settings: Settings = Settings()) -> Encoder:
    """The random projection that training starts from."""
    shape = (settings.buckets, settings.dimensions)
    return Encoder(settings, np.random.default_rng(settings.seed).normal(size=shape) / math.sqrt(settings.dimensions))


def _batches(pairs: DataFrame, question: Column, positive: Column, s: Settings, ready: bool = False, text: Column | None = None, held: Column | None = None) -> tuple[DataFrame, str]:
    """One row a batch, written; and its folder."""
    folder, spark = scratch.folder(pairs.sparkSession, "encoder"), pairs.sparkSession
    rows = pairs.select(question.alias("q"), positive.alias("p"), (F.lit(None).cast("string") if text is None else text).alias("text"), F.coalesce(F.lit(False) if held is None else held, F.lit(False)).alias("held"))
    if not ready:  # terms are dear, so they are made once
        rows.select(*(bucketed(F.col(c), s.buckets).alias(c) for c in "qp"), "text", "held").write.parquet(f"{folder}/pairs")
        rows = spark.read.parquet(f"{folder}/pairs")
    rows = rows.filter("size(q) > 0 and size(p) > 0").withColumn("key", F.xxhash64("q", "p"))
    if held is not None:
        free = rows.groupBy("key", "text").agg(F.max("held").alias("held")).filter("not held")
    else:
        free = rows
    number = max(1, -(-free.select("key").distinct().count() // s.batch))  # keys alone are shuffled
    # Equal pairs and copies of those that are held have one key, so they meet in one batch; a set drops equal ones before that.
    kept = lambda c: F.when(~F.col("held"), F.col(c)).alias(c)  # noqa: E731 - of a pair that is held, what tells its copies is needed alone
    dealt = rows.select("key", "text", "held", kept("q"), kept("p")).groupBy(F.pmod(F.xxhash64("key", F.lit(s.seed)), F.lit(number)).alias("batch"))
    found = dealt.agg(F.sort_array(F.collect_set(F.struct("key", "text", "held", "q", "p"))).alias("rows"))  # about s.batch pairs

    def packed(arrow: Iterator) -> Iterator:
        import pyarrow as pa

        for part in arrow:
            for rows in part.column("rows"):
                rows, taken = rows.values, {}
                keys, texts, out = (rows.field(c).to_pylist() for c in ("key", "text", "held"))
                never = {(k, t) for k, t, h in zip(keys, texts, out) if h}
                for i, (k, t) in enumerate(zip(keys, texts)):
                    if (k, t) not in never:
                        taken.setdefault(k, i)
                rows = rows.take(pa.array(list(taken.values()), pa.int64()))
                sides = [_entries(rows.field(c), s.buckets) for c in ("q", "p")]
                yield pa.RecordBatch.from_pylist([{"n": len(rows), "q": sides[0], "p": sides[1]}], pa.schema([("n", pa.int32()), ("q", pa.binary()), ("p", pa.binary())]))

    small = {"parquet.block.size": GROUP, "parquet.page.size.row.check.min": 1, "parquet.enable.dictionary": False}  # a size is looked at after 100 rows else
    found.select("rows").mapInArrow(packed, "n int, q binary, p binary").write.options(**small).parquet(f"{folder}/batches")
    return _evenly(spark).read.parquet(f"{folder}/batches"), folder


def _evenly(spark: SparkSession) -> SparkSession:
    """A session like this that reads files in small parts: batches are much work for their bytes, so with a task or two a core some cores would wait."""
    own = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if own.conf.get(name, None) != value:
            own.conf.set(name, value)
    for name, value in (("maxPartitionBytes", SPLIT), ("openCostInBytes", GROUP // 8), ("minPartitionNum", WAVES * spark.sparkContext.defaultParallelism)):
        own.conf.set(f"spark.sql.files.{name}", str(value))
    return own


def _step(batches: DataFrame, weights: np.ndarray, s: Settings) -> tuple[np.ndarray, float, int]:
    """(gradient, loss, questions) summed over all batches."""
    spark = batches.sparkSession
    sent = spark.sparkContext.broadcast(weights)
    schema = "task int, total binary, loss double, n long"

    def out(task: int, total: np.ndarray, loss: float, n: int):
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), pa.array([total.tobytes()], pa.binary()), pa.array([loss]), pa.array([n], pa.int64())], names=["task", "total", "loss", "n"])

    def sums(arrow: Iterator) -> Iterator:
        total, loss, n, room = np.zeros(sent.value.shape, order="F"), 0.0, 0, _Room()
        for part in arrow:
            for m, *sides in zip(part.column("n").to_pylist(), part.column("q"), part.column("p")):
                if m > 1:
                    q, p = (np.frombuffer(side.as_buffer(), _ENTRY) for side in sides)
                    at = np.concatenate([q["at"], p["at"] + np.uint32(m * s.buckets)])  # questions, and below them their texts
                    used, both = room.laid(at, np.concatenate([q["times"], p["times"]]), 2 * m, s.buckets)
                    slope, lost = _gradient(sent.value[used], both, s.temperature)
                    total[used] += slope
                    loss, n = loss + lost, n + m
        if n:
            yield out(TaskContext.get().partitionId(), total, loss, n)

    def added(arrow: Iterator) -> Iterator:
        total, loss, n = np.zeros_like(sent.value), 0.0, 0
        for part in arrow:
            for blob, lost, m in zip(part.column("total"), part.column("loss").to_pylist(), part.column("n").to_pylist()):
                total, loss, n = total + np.frombuffer(blob.as_buffer(), np.float64).reshape(total.shape), loss + lost, n + m
        if n:
            yield out(TaskContext.get().partitionId(), total, loss, n)

    tree, parts = batches.mapInArrow(sums, schema), batches.rdd.getNumPartitions()
    while parts > FAN:
        parts = -(-parts // FAN)
        near = tree.withColumn("near", F.pmod("task", F.lit(parts)))  # sums that meet, in however many partitions they are dealt
        tree = near.repartition(parts, "near").sortWithinPartitions("task").mapInArrow(added, schema)
    found = sorted(tree.collect())  # FAN sums at most
    sent.destroy()
    total = sum((np.frombuffer(r.total, np.float64).reshape(weights.shape) for r in found), np.zeros_like(weights))
    return total, sum(r.loss for r in found), sum(r.n for r in found)


def trained(pairs: DataFrame, question: Column, positive: Column, settings: Settings = Settings(), ready: bool = False, text: Column | None = None, held: Column | None = None) -> Encoder:
    """The encoder learned from columns of terms, or of their buckets if they are ``ready``; its ``losses`` hold the mean loss before each step.

    Pairs that are ``held`` teach nothing, nor do equal pairs with the ``text`` of one (a digest will do)."""
    made = untrained(settings)
    batches, folder = _batches(pairs, question, positive, settings, ready, text, held)
    mean, spread = np.zeros_like(made.weights), np.zeros_like(made.weights)
    for step in range(1, settings.steps + 1):
        total, loss, n = _step(batches, made.weights, settings)
        if not n:
            break
        if not np.isfinite(loss):
            raise RuntimeError(f"the loss of step {step} isn't finite")
        made.losses.append(loss / n)
        slope = total / n
        mean, spread = 0.9 * mean + 0.1 * slope, 0.99 * spread + 0.01 * slope**2
        made.weights = made.weights - settings.rate * (mean / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.99**step)) + 1e-8)
    scratch.remove(pairs.sparkSession, folder)
    return made
