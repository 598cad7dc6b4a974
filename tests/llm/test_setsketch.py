"""SetSketch near-dedup and the link finder against brute force: dense groups, chains, templates, odd tables."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import common, near, setsketch, simhash

SCHEMA = "doc_id long, text string, n int, node long, sig string, a int, g int"


def shingles(text, k=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(rows, hundredths=85):
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    of = {}
    for i, s in enumerate(sets):
        if s:
            root[find(i)] = find(of.setdefault(s, i))
    own = list(of.items())
    for x, (s, i) in enumerate(own):
        for t, j in own[x + 1 :]:
            if 100 * min(len(s), len(t)) >= hundredths * max(len(s), len(t)) and 100 * len(s & t) >= hundredths * len(s | t):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    out = []
    for i, r in enumerate(rows):
        c = least.get(find(i)) if sets[i] else r[0]
        out.append((r[0], len(sets[i]), c, r[0] == c))
    return Counter(out)


def changed(r, words, n):
    words = list(words)
    for i in r.sample(range(len(words)), n):
        words[i] = f"x{r.randrange(10**9)}"
    return words


def rows(kind, seed=6):
    r = random.Random(seed)
    base = [f"w{r.randrange(5000)}" for _ in range(200)]
    texts = []
    if kind == "group":  # near copies of one text, most linked to most
        texts = [" ".join(changed(r, base, r.randrange(6))) for _ in range(150)]
    elif kind == "chain":  # each linked to its neighbours only
        now = base
        for _ in range(80):
            texts.append(" ".join(now))
            now = changed(r, now, 4)
    elif kind == "template":  # alike but not linked, with a few linked pairs among them
        for _ in range(120):
            own = changed(r, base, 12)
            texts.append(" ".join(own))
            if r.random() < 0.2:
                texts.append(" ".join(changed(r, own, 2)))
    else:
        texts = [" ".join(f"w{r.randrange(300)}" for _ in range(r.randrange(1, 9))) for _ in range(400)] + ["a b c d e f g h", "A B C d e f g h", "b a"]
    r.shuffle(texts)
    return [(1000 + i, t, 1, 2, "s", 3, 4) for i, t in enumerate(texts)]


@pytest.mark.parametrize("kind", ["group", "chain", "template", "short"])
def test_components_equal_brute_force(spark, kind):
    df = spark.createDataFrame(rows(kind), SCHEMA).repartition(3)
    assert Counter(map(tuple, setsketch.grouped(df).collect())) == brute(rows(kind))


def test_smallest_sets_that_can_be_linked(spark):
    """Six shingles of seven are 0.857 of them, four of five 0.8: the smaller set must be listed."""
    words = [[f"{w}{i}" for i in range(9)] for w in "abcdefghijklmnopqrst"]
    texts = [(100 * i + n, " ".join(w[:n]), 1, 2, "s", 3, 4) for i, w in enumerate(words) for n in (7, 8, 9)]
    got = setsketch.grouped(spark.createDataFrame(texts, SCHEMA))
    assert Counter(map(tuple, got.collect())) == brute(texts) and got.filter("kept").count() == 40
    for hundredths in range(1, 100):
        assert near.least_needed(hundredths) == next(n for n in range(1, 100) if 100 * n >= hundredths * (n + 1))
    got = setsketch.grouped(spark.createDataFrame(texts, SCHEMA), similar=83)  # five of six are 0.833
    assert Counter(map(tuple, got.collect())) == brute(texts, 83) and got.filter("kept").count() == 20
    texts = [(100 * i + n, " ".join(w[:n]), 1, 2, "s", 3, 4) for i, w in enumerate(words) for n in (8, 9)]
    assert simhash.deduplicated(spark.createDataFrame(texts, SCHEMA)).count() == 20


def test_dense_keys_lose_no_link(spark, monkeypatch):
    """One key holds all nodes, so only the way of dense keys finds links; in small blocks."""
    monkeypatch.setattr(near, "BLOCK", 1500)
    monkeypatch.setattr(near, "STREAMED", 30)
    monkeypatch.setattr(setsketch, "index", lambda nodes: nodes.filter("sig is not null").select(F.lit(1).cast("long").alias("g"), "node"))
    for kind in ("chain", "template"):
        df = spark.createDataFrame(rows(kind, 9), SCHEMA)
        assert Counter(map(tuple, setsketch.grouped(df).collect())) == brute(rows(kind, 9))


def test_small_files_with_many_rows_are_not_broadcast(spark, monkeypatch, tmp_path):
    """Past the count that may be sent, and for values of nodes, no join sends a side to all tasks, however small its file."""
    monkeypatch.setattr(common, "NEAR_GROUPS", 5)
    spark.range(60).selectExpr("id % 20 as g", "id as a", "id + 1 as b").write.parquet(f"{tmp_path}/rows")
    spark.range(10).selectExpr("id as g", "id * 7 as n", "id as node").write.parquet(f"{tmp_path}/groups")
    rows, groups = (spark.read.parquet(f"{tmp_path}/{x}") for x in ("rows", "groups"))
    got = common.joined_to_groups(rows, groups.select("g", "n"), ["g"])
    valued = near.with_values(rows.select("a", "b"), "a", groups, {"n": "x"})
    assert Counter((r.g, r.n) for r in got.collect()) == Counter({(i, 7 * i if i < 10 else None): 3 for i in range(20)})
    assert {tuple(r) for r in valued.collect()} == {(i, i + 1, 7 * i) for i in range(10)}
    for df in (got, valued.select("a", "x")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("BroadcastExchange") == (0 if df is got else 2) and "SortMergeJoin" in plan  # the copies of hot nodes are counted and sent


def test_values_of_a_hot_node_are_dealt_in_copies(spark, monkeypatch):
    monkeypatch.setattr(near, "SPREAD", 4)
    pairs = spark.createDataFrame([(0, i) for i in range(1, 60)] + [(1, 2)], "a long, b long")
    values = spark.createDataFrame([(i, i * 10) for i in range(60)], "node long, s long")
    got = near.with_values(near.with_values(pairs, "a", values, {"s": "x"}), "b", values, {"s": "y"})
    assert Counter((r.a, r.b, r.x, r.y) for r in got.collect()) == Counter([(0, i, 0, 10 * i) for i in range(1, 60)] + [(1, 2, 10, 20)])


def test_odd_rows(spark):
    long = "lorem ipsum dolor sit amet consectetur elit " * 20_000
    odd = [(1, None), (2, ""), (3, " \n\t"), (4, long), (5, long), (None, "a text without id at all it is"), (None, "a text without id at all it is"), (None, None), (7, "a text without id at all it is"), (8, "été 日本"), (8, "ÉTÉ 日本"), (9, "x\x1cy z"), (10, "x y z"), (11, "one two"), (12, "One  two"), (13, "one two three"), (13, "one two three"), (None, "alone and without an id")]
    odd = [(*x, 1, 2, "s", 3, 4) for x in odd]
    df = spark.createDataFrame(odd, SCHEMA).repartition(3)
    got = Counter((r.doc_id, r.n_shingles, r.component_id, bool(r.kept)) for r in setsketch.grouped(df).collect())
    want = Counter({(a, b, c, a == c): n for (a, b, c, _), n in brute(odd).items()})
    assert got == want
    assert setsketch.grouped(df.limit(0)).count() == 0


def test_registers_merge_and_estimate():
    r = np.random.default_rng(1)
    for share in (0.3, 0.6, 0.9):
        got, short = [], []
        for _ in range(60):
            common, x, y = (r.integers(0, 2**63, n, np.uint64) for n in (int(2000 * share), int(1000 * (1 - share)), int(1000 * (1 - share))))
            a, b = np.concatenate([common, x]), np.concatenate([common, y])
            assert (setsketch.merged(setsketch.registers(common), setsketch.registers(x)) == setsketch.registers(a)).all()
            j = len(common) / (len(common) + len(x) + len(y))
            e, s = setsketch.estimated(setsketch.registers(a)[None], setsketch.registers(b)[None], np.array([float(len(a))]), np.array([float(len(b))]), 0.85)
            got.append(e[0] - j)
            short.append(s[0])
        assert abs(np.mean(got)) < 0.04 and np.std(got) < 0.1
        assert (max(short) <= setsketch.SLACK) if j >= 0.85 else (np.mean(np.array(short) > setsketch.SLACK) > 0.5 or j > 0.6)


def test_no_linked_pair_is_held_unlike():
    """At the threshold itself the likelihood lets all of 2,000 pairs through."""
    r = np.random.default_rng(2)
    equal = r.binomial(setsketch.REGISTERS, 0.851, 2000)
    larger = r.binomial(setsketch.REGISTERS - equal, 0.5)
    x, y = np.zeros((2000, setsketch.REGISTERS), int), np.zeros((2000, setsketch.REGISTERS), int)
    for i in range(2000):
        x[i, : larger[i]] = 1
        y[i, larger[i] : setsketch.REGISTERS - equal[i]] = 1
    assert (setsketch.estimated(x, y, np.full(2000, 500.0), np.full(2000, 500.0), 0.85)[1] <= setsketch.SLACK).all()
