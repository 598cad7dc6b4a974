"""Interval joins against brute force, with long intervals, negative values and odd rows."""

import random
from collections import Counter

import pytest

from palimpsest.operators import intervals


def rows(seed, n=120, far=10**12):
    r = random.Random(seed)
    out = []
    for i in range(n):
        low = r.choice([r.randrange(-50, 50), r.randrange(-far, far)])
        out.append((r.choice(["x", "y"]), i, low, low + r.choice([0, 1, 15, 16, 17, 300, r.randrange(far), -1])))
    return out + [(None, 900, 0, 5), ("x", 901, None, 5), ("x", 902, 5, None), ("x", 3, -10, 10), ("x", 3, -10, 10)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_stabbing_join_equals_brute_force(spark, seed):
    spans = rows(seed)
    r = random.Random(seed)
    ends = [v for s in spans for v in s[2:] if v is not None]
    points = [(r.choice(["x", "y"]), i, r.choice(ends) + r.choice([-1, 0, 1])) for i in range(200)] + [("x", 800, None), (None, 801, 3)]
    df, pf = spark.createDataFrame(spans, "k string, id int, low long, high long"), spark.createDataFrame(points, "k string, pid int, at long")
    got = Counter((x.pid, x.id) for x in intervals.stabbing_join(pf, df, ["k"], "at", "low", "high").collect())
    ok = lambda *v: None not in v
    assert got == Counter((p, i) for pk, p, at in points for k, i, a, b in spans if ok(pk, k, at, a, b) and pk == k and a <= at <= b)


def test_overlaps_equal_brute_force(spark):
    a, b = rows(5), rows(6)
    schema = "k string, id int, low long, high long"
    got = Counter((x.a_id, x.b_id) for x in intervals.overlapping(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), ["k"], "id", "low", "high").collect())
    good = lambda rs: [x for x in rs if None not in x and x[2] <= x[3]]
    assert got == Counter((i, j) for k, i, lo, hi in good(a) for m, j, lo2, hi2 in good(b) if k == m and lo <= hi2 and lo2 <= hi)
    one = spark.createDataFrame([("x", 1, -(10**15), 10**15)], schema)
    assert intervals.overlapping(one.limit(0), one, ["k"], "id", "low", "high").count() == 0


def test_long_intervals_have_few_rows(spark):
    """A thousand intervals of a trillion points and as many points: what meets the join stays near the input."""
    spans = spark.range(1000).selectExpr("'x' as k", "id", "id * 1000000007 as low", "id * 1000000007 + 1000000000000 as high")
    out = intervals.stabbing_join(spark.range(1000).selectExpr("'x' as k", "id * 31 as at"), spans, ["k"], "at", "low", "high")
    assert out.count() == 1000
    plan = out._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_overlapping_pairs_are_counted_as_all_pairs_are_and_none_is_made(spark):
    """Equal points, repeated ids, one interval in all others, null bounds and keys; 40,000 intervals of one key, 800 million pairs, are counted too."""
    draw = random.Random(8)
    rows = [(draw.choice([1, 2, None]), draw.randrange(60), low, None if draw.random() < 0.05 else low + draw.choice([-1, 0, 0, 3, 40])) for low in (draw.randrange(50) for _ in range(160))]
    want = {}
    for i, (k, a, lo, hi) in enumerate(rows):
        for k2, b, lo2, hi2 in rows[i + 1 :]:
            if k is not None and k == k2 and a != b and None not in (hi, hi2) and lo <= hi and lo2 <= hi2 and lo <= hi2 and lo2 <= hi:
                want[k] = want.get(k, 0) + 1
    df = spark.createDataFrame([*rows, (3, 1, 5, 6), (3, 1, 5, 6), (4, 1, 5, 6), (4, 2, 7, 8)], "k long, id int, low long, high long")
    assert {r.k: r.pairs for r in intervals.overlap_pairs(df, ["k"], "id", "low", "high").collect()} == want
    many = spark.range(40_000).selectExpr("1L as k", "id", "id as low", "id + 40000 as high")
    assert [tuple(r) for r in intervals.overlap_pairs(many, ["k"], "id", "low", "high").collect()] == [(1, 40_000 * 39_999 // 2)]
