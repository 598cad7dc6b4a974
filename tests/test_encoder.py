"""The linear encoder: gradient against differences, steps against a loop over batches, and recall on families it hasn't seen."""

import numpy as np
from pyspark.sql import functions as F

from palimpsest.operators import dense, encoder

S = encoder.Settings(buckets=64, dimensions=8, batch=16, steps=3)


def pairs(spark, n, seed=0, noise=8):
    """A pair shares two rare terms; frequent ones, drawn anew on both sides, drown them."""
    r = np.random.default_rng(seed)
    often = lambda: [f"w{i}" for i in r.integers(0, 12, noise)]
    rows = [(i, [f"r{i % 40}", f"s{i % 37}", *often()], [f"r{i % 40}", f"s{i % 37}", *often()]) for i in range(n)]
    return spark.createDataFrame(rows, "id long, q array<string>, p array<string>")


def test_entries_hold_all_counts():
    rows = [[1, 1, 3], [], [0, 63, 63, 63]]
    assert np.array_equal(encoder._matrix(encoder._entries(rows, 64), 3, 64), encoder.counted(rows, 64))


def test_gradient_equals_differences():
    r = np.random.default_rng(1)
    w, a, b = r.normal(size=(10, 4)), r.random((5, 10)), r.random((5, 10))
    slope, _ = encoder.gradient(w, a, b, 0.2)
    for i, j in ((0, 0), (3, 2), (9, 3)):
        d = np.zeros_like(w)
        d[i, j] = 1e-6
        there = (encoder.gradient(w + d, a, b, 0.2)[1] - encoder.gradient(w - d, a, b, 0.2)[1]) / 2e-6
        assert abs(there - slope[i, j]) < 1e-5 * max(1, abs(there))


def test_partitions_and_the_tree_change_nothing(spark, monkeypatch):
    df = pairs(spark, 200)
    one = encoder.trained(df.coalesce(1), F.col("q"), F.col("p"), S)
    monkeypatch.setattr(encoder, "FAN", 2)
    two = encoder.trained(df.union(df).repartition(7), F.col("q"), F.col("p"), S)  # equal pairs count once
    assert np.allclose(one.losses, two.losses) and np.allclose(one.weights, two.weights, atol=1e-6)


def test_step_sums_all_batches(spark):
    df = pairs(spark, 100)
    w = encoder.untrained(S).weights
    batches, _ = encoder._batches(df, F.col("q"), F.col("p"), S)
    total, loss, n = encoder._step(batches, w, S)
    want = [encoder.gradient(w, *(encoder._matrix(r[c], r.n, 64) for c in ("q", "p")), S.temperature) for r in batches.collect() if r.n > 1]
    assert np.allclose(total, sum(g for g, _ in want)) and np.isclose(loss, sum(x for _, x in want)) and 90 <= n <= 100


def test_beats_the_base_on_pairs_it_has_not_seen(spark):
    s = encoder.Settings(buckets=512, dimensions=32, batch=64, steps=25)
    df = pairs(spark, 900, noise=20)
    made = encoder.trained(df.filter("id >= 200"), F.col("q"), F.col("p"), s)
    asked = df.filter("id < 200")

    def recall(e):
        q = e.encoded(asked, F.col("q")).select(F.col("id").alias("query_id"), "embedding", F.lit(1).alias("version"))
        p = e.encoded(asked, F.col("p")).select(F.col("id").alias("vec_id"), "embedding", F.lit(1).alias("version_low"), F.lit(1).alias("version_high"))
        return dense.top_k(q, p, 1, False).filter("query_id = vec_id").count() / 200

    base, tuned = recall(encoder.untrained(s)), recall(made)
    assert made.losses[-1] < made.losses[0] / 2 and tuned > base + 0.2


def test_odd_texts(spark):
    df = spark.createDataFrame([(1, None, ["a"]), (2, [], ["b"]), (3, ["c"], ["c"])], "id int, q array<string>, p array<string>")
    made = encoder.trained(df, F.col("q"), F.col("p"), S)
    assert made.losses == []
    got = {r.id: r.embedding for r in made.encoded(df, F.col("q")).collect()}
    assert got[1] is None and got[2] is None and abs(sum(x * x for x in got[3]) - 1) < 1e-9
    assert encoder.trained(df.limit(0), F.col("q"), F.col("p"), S).losses == []


def test_buckets_that_are_ready_teach_the_same(spark):
    df = pairs(spark, 100)
    made = encoder.trained(df, F.col("q"), F.col("p"), S)
    ready = df.select("id", *(encoder.bucketed(F.col(c), S.buckets).alias(c) for c in "qp"))
    again = encoder.trained(ready, F.col("q"), F.col("p"), S, ready=True)
    assert np.allclose(made.weights, again.weights, atol=1e-9)
    x, y = ({r.id: r.embedding for r in made.encoded(d, F.col("q"), ready=k).collect()} for d, k in ((df, False), (ready, True)))
    assert x == y


def test_terms_of_documents_are_made_once(spark, data):
    from palimpsest.plans import learned

    assert all("encoder-halves" in f for f in learned._halves(spark, data).inputFiles())


def test_held_pairs_and_their_copies_teach_nothing(spark):
    """A held pair, and an equal one of the same text, go; an equal pair of another text stays, and equal pairs count once."""
    df = pairs(spark, 60).withColumn("text", F.col("id").cast("string")).withColumn("held", F.col("id") < 20)
    copies = df.filter("id < 40").withColumn("held", F.lit(False))
    others = df.filter("id < 5").withColumn("text", F.lit("another")).withColumn("held", F.lit(False))
    want = encoder.trained(df.filter("id >= 20 or id < 5"), F.col("q"), F.col("p"), S)
    got = encoder.trained(df.union(copies).union(others).repartition(5), F.col("q"), F.col("p"), S, text=F.col("text"), held=F.col("held"))
    assert np.allclose(want.losses, got.losses) and np.allclose(want.weights, got.weights, atol=1e-6)


def test_a_step_has_tasks_for_all_cores(spark):
    """Much work for few bytes: files in large parts left cores without any."""
    r = np.random.default_rng(3)
    rows = [(i, *(r.integers(0, 4096, 300).tolist() for _ in "qp")) for i in range(12_000)]
    df = spark.createDataFrame(rows, "id long, q array<int>, p array<int>")
    batches, _ = encoder._batches(df, F.col("q"), F.col("p"), encoder.Settings(), ready=True)
    sizes = batches.select(F.spark_partition_id().alias("at")).groupBy("at").count().collect()
    assert len(sizes) >= 2 * spark.sparkContext.defaultParallelism and max(x["count"] for x in sizes) <= batches.count() / 4


def test_room_is_zero_again_and_holds_all_counts():
    room, r = encoder._Room(), np.random.default_rng(5)
    for n, width in ((7, 64), (3, 5), (9, 64), (2, 3)):  # most buckets, then few
        rows = [r.integers(0, width, 400 if i else 900).tolist() for i in range(n)]
        found = np.frombuffer(encoder._entries(rows, 64), encoder._ENTRY)
        used, got = room.laid(found["at"], found["times"], n, 64)
        want = encoder.counted(rows, 64)
        assert np.array_equal(got, want[:, used]) and np.isclose(got.sum(), want.sum())


def test_vectors_are_made_once_a_row(spark):
    made = encoder.untrained(S)
    df = made.encoded(pairs(spark, 30), F.col("q")).filter(F.size("embedding") > 0).filter(~F.exists("embedding", lambda x: x.isNull()))
    assert df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1 and df.count() == 30


def test_questions_out_of_reach_have_no_rank(spark):
    """in_reach leaves every question whose own passage is among the k nearest, copies and ties included, and few others."""
    r = np.random.default_rng(2)
    p = r.normal(size=(400, 8))
    p /= np.linalg.norm(p, axis=1, keepdims=True)
    p[100:130] = p[7]  # copies of a passage that is found
    q = p + r.normal(size=p.shape) * np.where(np.arange(400) < 60, 0.05, 2.0)[:, None]
    passages = spark.createDataFrame([(i, p[i].tolist(), 1, 1) for i in range(400)], "vec_id long, embedding array<double>, version_low int, version_high int")
    queries = spark.createDataFrame([(i, q[i].tolist(), p[i].tolist(), 1) for i in range(400)] + [(400, None, None, 1)], "query_id long, embedding array<double>, own array<double>, version int")
    ranks = lambda asks: sorted(dense.top_k(asks.drop("own"), passages, 10, False).filter("query_id = vec_id").select("query_id", "rank").collect())
    for part in (passages, passages.filter("vec_id % 2 = 0"), passages.limit(0)):
        left = dense.in_reach(queries, "own", part.select("embedding"), 10)
        assert ranks(left) == ranks(queries)
    assert dense.in_reach(queries, "own", passages.select("embedding"), 10).count() < 250


def test_the_driver_gets_few_sums_in_any_number_of_partitions(spark, monkeypatch):
    batches, _ = encoder._batches(pairs(spark, 300), F.col("q"), F.col("p"), S)
    batches, w = batches.repartition(12), encoder.untrained(S).weights
    want, kind, got = encoder._step(batches, w, S), type(batches), []
    deal, collect = kind.repartition, kind.collect
    monkeypatch.setattr(encoder, "FAN", 3)
    monkeypatch.setattr(kind, "repartition", lambda self, n, *c: deal(self, max(n, 50), *c))
    monkeypatch.setattr(kind, "collect", lambda self: got.append(collect(self)) or got[-1])
    total, loss, n = encoder._step(batches, w, S)
    assert len(got[-1]) <= 3 and np.allclose(total, want[0]) and np.isclose(loss, want[1]) and n == want[2]
