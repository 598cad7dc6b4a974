"""Incremental ingestion: each family's validity ranges are state, and only what changes of them is written.

Observations (family, content, version, payload) arrive as files in any order, late ones and repeats included. The state of a (family,
content) is its list of disjoint ranges; an observation extends one, joins two, or starts one. Spark calls Python once for each key of its state, which takes
milliseconds however little there is to do, so a key is a slot: a hash of (family, content), whose state is read and written whole if the batch touches it.
A batch hands on the ranges that went and the ranges that came, and these are merged into a table of copy-on-write buckets (sources.snapshots), each batch as
one snapshot. So rows handed on are in proportion to the families that a batch touches, state read and buckets written to the slots and buckets of these.
The number of slots is fixed with the checkpoint: raise it where a slot's share of all ranges is much for one task. A batch that runs again after a failure hands on the same changes, which are
put in by key and so change nothing more.

The payload of a range is that of its earliest version, the least where several were seen. Observations without a version are ignored; null
families and contents are keys like any other.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.snapshots import Snapshots

SCHEMA = "family long, content string, version int, payload string"
STATE = "held binary"
CHANGE = "family long, content string, version_low int, version_high int, payload string, present boolean"
#: Keys of the stream's state, each with the ranges of many families.
SLOTS = 1024


def _least(a: str | None, b: str | None) -> str | None:
    return b if a is None else a if b is None else min(a, b)


class Ranges:
    """Disjoint ranges of whole numbers, never adjacent, each with the payload of its first."""

    def __init__(self, lows=(), highs=(), payloads=()):
        self.lows, self.highs, self.payloads = list(lows), list(highs), list(payloads)

    def add(self, v: int, payload: str | None) -> None:
        i = bisect_right(self.lows, v) - 1
        if i >= 0 and v <= self.highs[i]:
            if v == self.lows[i]:
                self.payloads[i] = _least(self.payloads[i], payload)
            return
        after, before = i + 1 < len(self.lows) and self.lows[i + 1] == v + 1, i >= 0 and self.highs[i] == v - 1
        if before and after:
            self.highs[i] = self.highs[i + 1]
            for held in (self.lows, self.highs, self.payloads):
                del held[i + 1]
        elif before:
            self.highs[i] = v
        elif after:
            self.lows[i + 1], self.payloads[i + 1] = v, payload
        else:
            for held, x in ((self.lows, v), (self.highs, v), (self.payloads, payload)):
                held.insert(i + 1, x)

    def rows(self) -> list[tuple]:
        return list(zip(self.lows, self.highs, self.payloads))


def _kept(held: dict[tuple, Ranges]) -> bytes:
    rows = [(*key, r.lows, r.highs, r.payloads if any(p is not None for p in r.payloads) else None) for key, r in held.items()]
    return zlib.compress(json.dumps(rows, separators=(",", ":")).encode(), 1)


def _held(kept: bytes) -> dict[tuple, Ranges]:
    return {(f, c): Ranges(low, high, [None] * len(low) if p is None else p) for f, c, low, high, p in json.loads(zlib.decompress(kept))}


def folded(slot: tuple, frames: Iterator, state: GroupState) -> Iterator:
    """The changes to the ranges of one slot's families; families are texts, as pandas has no whole numbers with nulls."""
    import pandas as pd

    held = _held(state.get[0]) if state.exists else {}
    seen: dict[tuple, dict[int, str | None]] = {}
    for frame in frames:
        texts = ([x if isinstance(x, str) else None for x in frame[c].tolist()] for c in ("family", "content", "payload"))
        for family, content, p, v in zip(*texts, frame["version"].tolist()):
            own = seen.setdefault((family, content), {})
            own[v] = _least(own[v], p) if v in own else p
    changes = []
    for key, own in seen.items():
        ranges = held.get(key) or Ranges()
        before = ranges.rows()
        for v in sorted(own):
            ranges.add(v, own[v])
        after = ranges.rows()
        if after != before:
            held[key] = ranges
            family = None if key[0] is None else int(key[0])
            were, now = set(before), set(after)
            changes += [(family, key[1], *r, False) for r in before if r not in now] + [(family, key[1], *r, True) for r in after if r not in were]
    if changes:
        state.update((_kept(held),))
        yield pd.DataFrame(changes, columns=["family", "content", "version_low", "version_high", "payload", "present"], dtype=object)


def changes(observed: DataFrame, slots: int = SLOTS) -> DataFrame:
    """A stream of changes (CHANGE) of ranges from a stream of observations (SCHEMA)."""
    slot = F.pmod(F.xxhash64("family", "content"), F.lit(slots)).cast("int")
    rows = observed.filter("version is not null").select(slot.alias("slot"), F.col("family").cast("string").alias("family"), "content", "version", "payload")
    return rows.groupBy("slot").applyInPandasWithState(folded, CHANGE, STATE, "update", GroupStateTimeout.NoTimeout)


def merged(table: Snapshots, batch: DataFrame) -> None:
    """Puts a batch of changes into the table: one new snapshot, or none if nothing changed."""
    keyed = batch.withColumn("range_id", F.sha2(F.to_json(F.struct("family", "content", "version_low")), 256)).persist()
    try:
        came = keyed.filter("present").select("range_id", "family", "content", "version_low", "version_high", "payload")
        table.merge(came, keyed.filter("not present").select("range_id"))
    finally:
        keyed.unpersist()


def start(spark: SparkSession, source: str, ranges: str, checkpoint: str, available_now: bool = True, files_a_batch: int | None = None, buckets: int = 64, slots: int = SLOTS) -> StreamingQuery:
    """Streams observation files (SCHEMA, Parquet) and keeps the table ``ranges`` (Snapshots by range_id) at the ranges of all of them."""
    table = Snapshots(spark, ranges, "range_id", buckets)
    reader = spark.readStream.schema(SCHEMA)
    stream = (reader.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else reader).parquet(source)
    writer = changes(stream, slots).writeStream.outputMode("update").foreachBatch(lambda batch, number: merged(table, batch)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def current(spark: SparkSession, ranges: str) -> DataFrame:
    """family, content, version_low, version_high, payload as of the last batch."""
    return Snapshots(spark, ranges, "range_id").rows().drop("range_id")
