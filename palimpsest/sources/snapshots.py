"""Versioned tables of keyed rows: copy-on-write buckets, immutable snapshots, atomic commits; and a store of collections with a live one.

A table is a folder. Rows lie in buckets by a hash of their key; a snapshot is a small file that names the folder of each bucket, its rows, and
what they were made from. A change writes new folders for the buckets it touches and then a new snapshot file, which comes into being by one rename that
fails if its number is taken. A reader takes the snapshot with the highest number, so until the rename it sees the one before, and what a crashed or beaten
writer left is never referred to. All files are reached through Hadoop's file systems, so a table may lie wherever Spark can write.

    t = Snapshots(spark, path, "id", buckets=64)
    t.replace(rows, {"model": "m"})     all buckets
    t.merge(rows, gone)                 rows put in by key, keys of ``gone`` removed: only touched buckets are read and written
    t.rows(), t.rows(3), t.history(), t.revert(3), t.expire(keep=2)

Null keys are an error. Of several new rows with one key one stays, the greatest by all its columns as JSON, so reruns agree.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Conflict(RuntimeError):
    """Another writer committed first; the change must be made anew on its snapshot."""


class Refused(RuntimeError):
    """The change isn't allowed in this state."""


class Log:
    """Numbered files in a folder, each written once and whole."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.jvm = spark._jvm.org.apache.hadoop.fs
        self.fs = self.jvm.Path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.Path(f"{self.folder}/{name}")

    def numbers(self) -> list[int]:
        where = self.jvm.Path(self.folder)
        if not self.fs.exists(where):
            return []
        return sorted(int(s.getPath().getName()[:-5]) for s in self.fs.listStatus(where) if s.getPath().getName()[:-5].isdigit())

    def read(self, number: int) -> dict:
        rows = self.spark.read.option("wholetext", True).text(f"{self.folder}/{number:010d}.json").collect()  # one file of one entry
        return json.loads(rows[0][0])

    def last(self) -> tuple[int, dict] | None:
        found = self.numbers()
        return (found[-1], self.read(found[-1])) if found else None

    def append(self, number: int, entry: dict) -> None:
        """Writes entry ``number``, or raises Conflict if it is there."""
        self.fs.mkdirs(self.jvm.Path(self.folder))
        made = self._path(f"_{uuid.uuid4().hex}")
        out = self.fs.create(made, False)
        try:
            out.write(bytearray(json.dumps(entry, sort_keys=True).encode()))
        finally:
            out.close()
        to = self._path(f"{number:010d}.json")
        if self.fs.exists(to) or not self.fs.rename(made, to):
            self.fs.delete(made, False)
            raise Conflict(f"{to.toString()} was written meanwhile")


@dataclass
class Snapshot:
    number: int
    schema: str
    buckets: int
    folders: dict[str, str] = field(default_factory=dict)
    counts: dict[str, int] = field(default_factory=dict)
    facts: dict = field(default_factory=dict)
    change: dict = field(default_factory=dict)


class Snapshots:
    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.log = Log(spark, f"{self.path}/snapshots")

    def snapshot(self, number: int | None = None) -> Snapshot | None:
        if number is None:
            found = self.log.last()
            return Snapshot(**found[1]) if found else None
        return Snapshot(**self.log.read(number))

    def history(self) -> list[dict]:
        """number, rows, facts and change of every snapshot kept, the oldest first."""
        return [{"number": s.number, "rows": sum(s.counts.values()), "facts": s.facts, "change": s.change} for s in map(self.snapshot, self.log.numbers())]

    def rows(self, number: int | None = None) -> DataFrame:
        """The rows of a snapshot, the last one's by default. Raises if there is none."""
        s = self.snapshot(number)
        if s is None:
            raise Refused(f"nothing was written to {self.path}")
        return self._read(s, list(s.folders))

    def count(self, number: int | None = None) -> int:
        """From the snapshot alone; 0 if there is none."""
        s = self.snapshot(number)
        return sum(s.counts.values()) if s else 0

    def _read(self, s: Snapshot, buckets: list[str]) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(s.schema))
        folders = [f"{self.path}/{s.folders[b]}" for b in buckets]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def _bucket(self, key: Column, n: int) -> Column:
        held = F.when(key.isNull(), F.raise_error(F.lit("a key is null")).cast("int"))
        return held.otherwise(F.pmod(F.xxhash64(key), F.lit(n)).cast("int"))

    def _keyed(self, rows: DataFrame, n: int) -> DataFrame:
        """One row of each key, with its bucket."""
        row = F.struct(*(F.col(f"`{c}`") for c in rows.columns))
        one = rows.select(F.col(f"`{self.key}`").alias("_key"), row.alias("_row")).groupBy("_key").agg(F.max_by("_row", F.to_json("_row")).alias("_row"))
        return one.select("_row.*", self._bucket(F.col("_key"), n).alias("_bucket"))

    def _written(self, rows: DataFrame, n: int) -> tuple[dict[str, str], dict[str, int]]:
        """Folder and rows of each bucket that rows (with _bucket) fill, written under a name of their own."""
        name = f"data/{uuid.uuid4().hex}"
        rows.repartition(n, "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{name}")
        counts = self.spark.read.schema("_bucket int").parquet(f"{self.path}/{name}").groupBy("_bucket").count().collect()  # a row a bucket; footers only
        return {str(r["_bucket"]): f"{name}/_bucket={r['_bucket']}" for r in counts}, {str(r["_bucket"]): r["count"] for r in counts}

    def _commit(self, before: Snapshot | None, s: Snapshot) -> Snapshot:
        s.change["at"] = round(time.time(), 3)
        self.log.append(s.number, asdict(s))
        return s

    def replace(self, rows: DataFrame, facts: dict | None = None) -> Snapshot:
        """A snapshot of rows alone, in as many buckets as the object names."""
        before = self.snapshot()
        folders, counts = self._written(self._keyed(rows, self.buckets), self.buckets)
        change = {"kind": "replace", "touched": len(folders), "written": sum(counts.values())}
        return self._commit(before, Snapshot(before.number + 1 if before else 1, rows.schema.json(), self.buckets, folders, counts, facts or {}, change))

    def merge(self, rows: DataFrame, gone: DataFrame | None = None, facts: dict | None = None) -> Snapshot:
        """rows put in by key and the keys of ``gone`` taken out (a key in both is put in). Untouched buckets are neither read nor written."""
        before = self.snapshot()
        if before is None:
            return self.replace(rows, facts)
        schema = T.StructType.fromJson(json.loads(before.schema))
        if [(f.name, f.dataType) for f in schema] != [(f.name, f.dataType) for f in rows.schema]:
            raise ValueError(f"columns are {rows.schema.simpleString()}, the table's are {schema.simpleString()}")
        n = before.buckets
        fresh = self._keyed(rows, n).persist()
        try:
            keys = fresh.select(F.col(f"`{self.key}`").alias("_key"), "_bucket")
            if gone is not None:
                out = gone.select(F.col(f"`{self.key}`").alias("_key"))
                keys = keys.unionByName(out.withColumn("_bucket", self._bucket(F.col("_key"), n))).distinct()
            touched = sorted(str(r[0]) for r in keys.select("_bucket").distinct().collect())  # as many as buckets at most
            if not touched:
                return before
            held = [b for b in touched if b in before.folders]
            old = self._read(before, held)
            old = old.join(keys.select(F.col("_key").alias(self.key)), self.key, "left_anti").select(*(f"`{c}`" for c in schema.names))
            both = old.withColumn("_bucket", self._bucket(F.col(f"`{self.key}`"), n)).unionByName(fresh)
            folders, counts = self._written(both, min(n, len(touched)))
        finally:
            fresh.unpersist()
        change = {"kind": "merge", "touched": len(touched), "written": sum(counts.values())}
        keep = lambda d: {b: v for b, v in d.items() if b not in set(touched)}
        return self._commit(before, Snapshot(before.number + 1, before.schema, n, keep(before.folders) | folders, keep(before.counts) | counts, before.facts if facts is None else facts, change))

    def revert(self, number: int) -> Snapshot:
        """A new snapshot equal to an older one that is still kept; no row is written."""
        before, s = self.snapshot(), self.snapshot(number)
        s.number, s.change = before.number + 1, {"kind": "revert", "to": number, "touched": 0, "written": 0}
        return self._commit(before, s)

    def expire(self, keep: int = 2) -> int:
        """Deletes all but the last ``keep`` snapshots and the data folders that none of these names; returns how many folders went.

        Not while others write: what they have written and not committed is referred to by no snapshot yet.
        """
        numbers = self.log.numbers()
        kept, old = numbers[-keep:], numbers[:-keep]
        named = {f for n in kept for f in self.snapshot(n).folders.values()}
        fs, path, went = self.log.fs, self.log.jvm.Path, 0
        for n in old:
            fs.delete(path(f"{self.log.folder}/{n:010d}.json"), False)
        top = path(f"{self.path}/data")
        for run in fs.listStatus(top) if fs.exists(top) else []:
            name = run.getPath().getName()
            for b in fs.listStatus(run.getPath()):
                if b.isDirectory() and f"data/{name}/{b.getPath().getName()}" not in named:
                    fs.delete(b.getPath(), True)
                    went += 1
        return went


class Store:
    """Collections of passages and vectors by model and revision, one of which is live. Promotion and rollback are entries of a log, so each is
    atomic and the way back is known."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64, key: str = "point_id"):
        self.spark, self.root, self.buckets, self.key = spark, root.rstrip("/"), buckets, key
        self.log = Log(spark, f"{self.root}/live")

    @staticmethod
    def name(model: str, revision: int) -> str:
        low = "".join(c if c.isascii() and c.isalnum() else "_" for c in model.lower())
        return "chunks__" + "_".join(p for p in low.split("_") if p) + f"__v{revision}"

    def collection(self, name: str) -> Snapshots:
        return Snapshots(self.spark, f"{self.root}/{name}", self.key, self.buckets)

    def live(self) -> str | None:
        found = self.log.last()
        return found[1]["name"] if found else None

    def plan(self, model: str, revision: int) -> dict:
        """Current and target collection, and whether a backfill of the target would overwrite what is served."""
        target = self.name(model, revision)
        return {"current": self.live(), "target": target, "overwrites_live": target == self.live()}

    def backfill(self, model: str, revision: int, passages: DataFrame, vectors: DataFrame, facts: dict | None = None, recreate: bool = False, force: bool = False) -> Snapshot:
        """Puts passages with their vectors (both with the key) into the target collection. Refused for the live one unless forced; passages without a
        vector, vectors without a passage and vectors of different lengths are errors before anything is written."""
        plan = self.plan(model, revision)
        if plan["overwrites_live"] and not force:
            raise Refused(f"{plan['target']} is live: take another revision")
        own = vectors.select(F.col(f"`{self.key}`"), "embedding")
        met = passages.select(self.key).withColumn("_p", F.lit(1)).join(own.select(self.key, F.size("embedding").alias("_n")), self.key, "full")
        seen = met.agg(F.count_if(F.col("_p").isNull()).alias("loose"), F.count_if(F.col("_n").isNull()).alias("bare"), F.min("_n").alias("a"), F.max("_n").alias("b")).first()
        if seen["loose"] or seen["bare"] or seen["a"] != seen["b"]:
            raise ValueError(f"{seen['bare']} passages without a vector, {seen['loose']} vectors without a passage, lengths {seen['a']} to {seen['b']}")
        rows = passages.join(own, self.key)
        table = self.collection(plan["target"])
        about = {"model": model, "revision": revision, "dimension": seen["a"], **(facts or {})}
        return table.replace(rows, about) if recreate else table.merge(rows, facts=about)

    def judge(self, name: str, metrics: DataFrame, **how) -> dict:
        """The verdict on a candidate from metrics (config incumbent or candidate, metric, value), kept for promote()."""
        from ..operators.gate import migration

        row = migration(metrics, "incumbent", "candidate", **how).first().asDict()
        log = Log(self.spark, f"{self.root}/verdicts/{name}")
        found = log.numbers()
        log.append(found[-1] + 1 if found else 1, row)
        return row

    def promote(self, name: str, skip_gate: bool = False) -> str | None:
        """Makes a collection live and returns the one before. It must have rows and, unless the gate is skipped, a verdict for it."""
        if not self.collection(name).count():
            raise Refused(f"{name} has no rows")
        if not skip_gate:
            verdict = Log(self.spark, f"{self.root}/verdicts/{name}").last()
            if verdict is None:
                raise Refused(f"{name} was not evaluated")
            if not verdict[1]["promote"]:
                raise Refused(f"{name} failed the gate: {verdict[1]}")
        last = self.log.last()
        before = last[1]["name"] if last else None
        self.log.append(last[0] + 1 if last else 1, {"name": name, "before": before})
        return before

    def rollback(self) -> str:
        """Makes the collection live again that was so before the last promotion, and returns its name."""
        last = self.log.last()
        if last is None or last[1]["before"] is None:
            raise Refused("nothing was live before")
        number, entry = last
        earlier = [self.log.read(n) for n in self.log.numbers() if n < number]
        came_from = next((e["before"] for e in reversed(earlier) if e["name"] == entry["before"]), None)
        self.log.append(number + 1, {"name": entry["before"], "before": came_from})
        return entry["before"]
