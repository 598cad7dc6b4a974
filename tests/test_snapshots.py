"""Versioned tables: touched buckets only, old snapshots after crashes and conflicts, the store's way from plan to rollback."""

import pytest
from pyspark.sql import functions as F

from palimpsest.sources import snapshots
from palimpsest.sources.snapshots import Conflict, Refused, Snapshots, Store


def as_dict(df):
    return {r[0]: r[1] for r in df.collect()}


@pytest.fixture
def table(spark, tmp_path):
    t = Snapshots(spark, f"file://{tmp_path}/t", "id", 16)
    t.replace(spark.range(1000).select("id", F.lit("old").alias("value")), {"model": "a"})
    return t


def test_merge_rewrites_touched_buckets_only(spark, table):
    s = table.snapshot()
    assert (s.number, s.change["written"], table.count(), len(s.folders)) == (1, 1000, 1000, 16)
    new = spark.createDataFrame([(5, "new"), (5, "mew"), (2000, "new")], "id long, value string")
    m = table.merge(new, spark.createDataFrame([(7,), (5,), (99999,)], "id long"))
    assert m.change["touched"] <= 4 and m.change["written"] < 1000 * 5 / 16
    assert sum(m.folders[b] == s.folders[b] for b in s.folders) == 16 - m.change["touched"]
    want = {i: "old" for i in range(1000) if i != 7} | {5: "new", 2000: "new"}
    assert as_dict(table.rows()) == want and table.count() == len(want) and m.facts == {"model": "a"}
    assert len(as_dict(table.rows(1))) == 1000
    assert table.merge(new.limit(0)).number == 2  # nothing to do, nothing written
    assert as_dict(table.rows(table.revert(1).number))[7] == "old"
    assert [h["change"]["kind"] for h in table.history()] == ["replace", "merge", "revert"]


def test_crash_between_write_and_commit_leaves_the_old_snapshot(spark, table, monkeypatch):
    monkeypatch.setattr(snapshots.Log, "append", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        table.merge(spark.createDataFrame([(5, "new")], "id long, value string"))
    monkeypatch.undo()
    assert as_dict(table.rows())[5] == "old" and table.snapshot().number == 1
    assert table.expire(2) == 1  # what the lost writer left
    assert as_dict(table.rows())[5] == "old"


def test_second_writer_of_a_number_is_refused(spark, table):
    late = table.snapshot()
    table.merge(spark.createDataFrame([(5, "new")], "id long, value string"))
    with pytest.raises(Conflict):
        table.log.append(late.number + 1, {})
    assert as_dict(table.rows())[5] == "new"


def test_expire_keeps_what_is_named(spark, table):
    for i in range(3):
        table.merge(spark.createDataFrame([(i, f"v{i}")], "id long, value string"))
    assert table.expire(1) > 0
    got = as_dict(table.rows())
    assert len(got) == 1000 and [got[i] for i in range(4)] == ["v0", "v1", "v2", "old"]
    assert [h["number"] for h in table.history()] == [4]


def test_odd_input(spark, table, tmp_path):
    with pytest.raises(ValueError):
        table.merge(spark.createDataFrame([(1, 2)], "id long, value int"))
    with pytest.raises(Exception, match="key is null"):
        table.merge(spark.createDataFrame([(None, "x")], "id long, value string"))
    empty = Snapshots(spark, f"file://{tmp_path}/none", "id")
    assert empty.count() == 0 and empty.snapshot() is None
    with pytest.raises(Refused):
        empty.rows()
    empty.replace(spark.createDataFrame([], "id long, value string"))
    assert empty.rows().count() == 0 and empty.rows().columns == ["id", "value"]


def test_from_plan_to_rollback(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", 4)
    passages = spark.range(20).select(F.col("id").alias("point_id"), F.concat(F.lit("text "), "id").alias("text"))
    vectors = passages.select("point_id", F.array(F.lit(1.0), F.col("point_id").cast("double")).alias("embedding"))
    one, two = store.name("Org/Small", 1), store.name("Org/Small", 2)
    store.backfill("Org/Small", 1, passages, vectors)
    with pytest.raises(Refused, match="not evaluated"):
        store.promote(one)
    assert store.promote(one, skip_gate=True) is None and store.live() == one
    assert store.plan("Org/Small", 1)["overwrites_live"] and not store.plan("Org/Small", 2)["overwrites_live"]
    with pytest.raises(Refused, match="is live"):
        store.backfill("Org/Small", 1, passages, vectors)
    with pytest.raises(ValueError, match="1 passages without"):
        store.backfill("Org/Small", 2, passages, vectors.filter("point_id > 0"))
    with pytest.raises(ValueError, match="lengths 1 to 2"):
        store.backfill("Org/Small", 2, passages, vectors.withColumn("embedding", F.when(F.col("point_id") > 3, F.col("embedding")).otherwise(F.array(F.lit(1.0)))))
    assert store.collection(two).count() == 0
    store.backfill("Org/Small", 2, passages, vectors)
    metrics = lambda c: spark.createDataFrame([("incumbent", "ndcg_at_10", 0.6), ("candidate", "ndcg_at_10", c)], "config string, metric string, value double")
    assert not store.judge(two, metrics(0.5))["promote"]
    with pytest.raises(Refused, match="failed the gate"):
        store.promote(two)
    assert store.judge(two, metrics(0.598))["promote"] and store.promote(two) == one
    assert store.rollback() == one and store.live() == one
    with pytest.raises(Refused):
        store.rollback()
    assert store.collection(store.live()).rows().filter("size(embedding) = 2").count() == 20
