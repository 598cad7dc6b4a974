"""Streamed ranges equal those of a batch over shuffled, late and repeated arrivals; a small batch writes little."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.operators import corpus, ranges
from palimpsest.sources.snapshots import Snapshots
from palimpsest.streaming import ingest


@given(st.lists(st.tuples(st.integers(-5, 12), st.sampled_from(["a", "b", None])), max_size=40))
@settings(max_examples=300, deadline=None)
def test_ranges_equal_runs_in_any_order(seen):
    r = ingest.Ranges()
    for v, p in seen:
        r.add(v, p)
    want, versions = [], sorted({v for v, _ in seen})
    for v in versions:
        if want and want[-1][1] == v - 1:
            want[-1][1] = v
        else:
            want.append([v, v])
    assert [(a, b) for a, b, _ in r.rows()] == [tuple(w) for w in want]


def test_stream_equals_batch(spark, tmp_path):
    r = random.Random(2)
    rows = [(r.choice([1, 2, 3, None]), r.choice(["a", "b", None]), r.randrange(30), r.choice(["x", "y"])) for _ in range(300)]
    rows += [(50 + i, "c", v, "z") for i in range(200) for v in range(3)]
    rows += rows[:100] + [(1, "a", None, "x")]
    r.shuffle(rows)
    parts = [rows[i::4] for i in range(4)] + [[(77, "c", 4, "late"), (78, "c", 3, "late")], rows[:20]]
    for part in parts:
        spark.createDataFrame(part, ingest.SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        ingest.start(spark, str(tmp_path / "in"), f"file://{tmp_path}/ranges", str(tmp_path / "ck"), buckets=32).awaitTermination(120)
    got = {tuple(x) for x in ingest.current(spark, f"file://{tmp_path}/ranges").collect()}
    everything = spark.createDataFrame([x for p in parts for x in p], ingest.SCHEMA).filter("version is not null")
    assert got == {tuple(x) for x in ranges.coalesced(everything, ["family", "content"], ["payload"]).collect()}
    table = Snapshots(spark, f"file://{tmp_path}/ranges", "range_id", 32)
    history = table.history()
    assert len(history) == 5  # the last batch repeats rows only and changes nothing
    small = history[-1]["change"]
    assert small["touched"] <= 3 and small["written"] <= table.count() / 4


def test_ordered_digest_tells_order_and_not_partitions(spark):
    ids = [f"id{i}" for i in range(500)]
    frame = lambda xs, n: spark.createDataFrame(list(enumerate(xs)), "at long, id string").repartition(n)
    digest = lambda xs, n=3: tuple(corpus.ordered_digest(frame(xs, n), "id", ["at"]).first())
    swapped = [*ids[:250], ids[251], ids[250], *ids[252:]]
    assert digest(ids) == digest(ids, 7) != digest(swapped) and digest(ids)[0] == 500
    assert digest(ids[:-1]) != digest(ids) and digest([]) == (0, 0, 0) and digest([None]) != digest([])


def test_vector_facts(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "id long, v array<double>")
    facts = corpus.vector_facts(df, "id", ["id"], "v", "m", 512)
    assert facts["dimension"] == 2 and facts["count"] == 20 and len(facts["digest"]) == 32
    assert corpus.vector_facts(df.filter("id <> 4"), "id", ["id"], "v", "m", 512)["digest"] != facts["digest"]
    try:
        corpus.vector_facts(df.unionByName(spark.createDataFrame([(99, [1.0])], "id long, v array<double>")), "id", ["id"], "v", "m", 512)
        raise AssertionError("lengths differ")
    except ValueError:
        pass


def test_one_call_folds_many_families():
    """Python is called once a slot; families beyond doubles, none at all, and no payload keep what they are."""
    import pandas as pd

    class State:
        exists, get = False, None

        def update(self, value):
            self.exists, self.get = True, value

    state, columns = State(), ["family", "content", "version", "payload"]
    large = str(2**53 + 1)
    fold = lambda rows: [tuple(x) for d in ingest.folded((0,), iter([pd.DataFrame(rows, columns=columns)]), state) for x in d.itertuples(index=False)]
    first = fold([(large, "a", 1, None), (None, "a", 2, "p"), (large, None, 5, "q"), (large, "a", 2, None)])
    assert set(first) == {(2**53 + 1, "a", 1, 2, None, True), (None, "a", 2, 2, "p", True), (2**53 + 1, None, 5, 5, "q", True)}
    assert set(fold([(large, "a", 3, "x")])) == {(2**53 + 1, "a", 1, 2, None, False), (2**53 + 1, "a", 1, 3, None, True)}
    assert fold([(large, "a", 2, None), (None, "a", 2, "p")]) == []
