"""Needles in texts against a plain search; models in packs against one call an input."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import inference, substrings


@pytest.mark.parametrize("part", [1_000_000, 40])
def test_contains_join_equals_a_plain_search(spark, monkeypatch, part):
    monkeypatch.setattr(substrings, "PART", part)
    monkeypatch.setattr(substrings, "TEXTS", 60)
    r = random.Random(part)
    texts = [(i, "".join(r.choice("abcé 🎉.") for _ in range(r.randrange(80)))) for i in range(150)] + [(500, None), (501, ""), (3, "abc"), (3, "abc")]
    needles = [(f"n{i}", "".join(r.choice("abcé 🎉.") for _ in range(r.randrange(1, 4)))) for i in range(60)] + [("none", None), ("empty", ""), ("twin", "ab"), ("twin2", "ab")]
    df, nd = spark.createDataFrame(texts, "id long, body string").repartition(3), spark.createDataFrame(needles, "nid string, needle string")
    got = Counter(map(tuple, substrings.contains_join(df, nd, "id", "body", "nid", "needle").collect()))
    assert got == Counter((i, k) for i, t in texts for k, n in needles if t is not None and n and n in t)
    assert substrings.contains_join(df.limit(0), nd, "id", "body", "nid", "needle").count() == 0
    assert substrings.contains_join(df, nd.limit(0), "id", "body", "nid", "needle").count() == 0


def test_no_loop_join_is_planned(spark):
    df = spark.createDataFrame([(1, "a b")], "id long, body string")
    plan = substrings.contains_join(df, df.select("id", F.col("body").alias("needle")), "id", "body", "id", "needle")._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def models():
    """An encoder and a scorer, as functions that workers needn't import."""

    def lengths():
        return lambda items: [[float(len(i.split())), float(sum(map(ord, i)) % 1000)] for i in items]

    def overlap():
        return lambda pairs: [float(len(a)) * 1000 + len(b) for a, b in pairs]

    return lengths, overlap


lengths, overlap = models()


def test_packs_hold_like_lengths_within_bounds():
    r = random.Random(1)
    sizes = [r.randrange(1, 400) for _ in range(500)]
    p = inference.Packing(most=16, budget=1000)
    found = list(inference.packs(sizes, p))
    assert sorted(i for pack in found for i in pack) == list(range(500))
    assert all(len(pack) <= 16 and (len(pack) == 1 or max(sizes[i] for i in pack) * len(pack) <= 1000) for pack in found)
    padded = sum(max(sizes[i] for i in pack) * len(pack) for pack in found)
    assert padded < 1.1 * sum(sizes)
    with pytest.raises(ValueError):
        inference.answered(["a", "b"], lambda xs: [1], p)


@pytest.mark.parametrize("window", [7, 4096])
def test_encoded_rows_keep_order_and_each_input_is_asked_once(spark, window):
    texts = [f"w{i % 40} " * (i % 13 + 1) for i in range(400)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(900, None), (901, "")], "id long, body string").repartition(5)
    counts = inference.Counts(spark)
    out = inference.encoded(rows, "body", f"lengths{window}", lengths, prefix="q: ", most_words=6, packing=inference.Packing(8, 100, window), counts=counts)
    got = {x.id: x.embedding for x in out.collect()}
    cut = lambda t: " ".join(f"q: {t}".split()[:6])
    assert out.columns == ["id", "body", "embedding"] and got[900] is None
    assert all(got[i][0] == len(cut(t).split()) for i, t in enumerate(texts))
    seen = counts.now()
    assert seen["inputs"] == len({cut(t) for t in texts}) + 1 and seen["calls"] >= seen["inputs"] / 8 and seen["loads"] >= 1
    again = {x.id: x.embedding for x in inference.encoded(rows.repartition(2), "body", "lengths", lengths, prefix="q: ", most_words=6).collect()}
    assert again == got


def test_pairs_are_scored_once_for_all_configurations(spark):
    pairs = [(q, p) for q in range(6) for p in range(30)]
    frame = lambda some: spark.createDataFrame([(q, p, f"query {q}", f"passage {p}") for q, p in some], "q int, p int, a string, b string")
    counts = inference.Counts(spark)
    got = inference.scored_once({"dense": frame(pairs[:100]), "hybrid": frame(pairs[50:] + pairs[:5])}, ["a", "b"], "overlap", overlap, "score", "double", counts=counts)
    assert counts.inputs.value == len(pairs)
    assert got["dense"].count() == 100 and got["hybrid"].count() == 135
    assert all(x.score == 1000 * len(x.a) + len(x.b) for g in got.values() for x in g.collect())
    assert inference.reranked_pairs(frame(pairs).limit(0), "a", "b", "overlap", overlap).count() == 0


def test_pairs_are_cut_from_the_longer_side(spark):
    rows = [("a " * 10, "b " * 3), ("a " * 3, "b " * 10), ("a " * 9, "b " * 9), ("a a", "b"), ("", "b " * 20)]
    df = spark.createDataFrame(rows, "x string, y string")
    x, y = inference.cut_pair(F.col("x"), F.col("y"), 8)
    got = [(len(r[0].split()), len(r[1].split())) for r in df.select(x, y).collect()]
    assert got == [(5, 3), (3, 5), (4, 4), (2, 1), (0, 8)]
