"""Fill-in-middle against a version by regular expressions, and on odd tables."""

import hashlib
import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm import infill

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
TEXT = st.text(st.sampled_from("ab<>PSMé日🎉\x1c  \t\n\r"), max_size=200)


def brute(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    i, j = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = ("".join(x) for x in (units[:i], units[i:j], units[j:]))
    form = "spm" if h[3] % 100 < 80 else "psm"
    return len(units), form, len(p), len(m), f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"


@given(TEXT)
@settings(max_examples=300, deadline=None)
def test_starts_and_ranks(text):
    raw, units = text.encode(), UNIT.findall(text)
    mask = infill.starts_of(raw)
    assert mask.bit_count() == len(units)
    at = 0
    for k, unit in enumerate(units):
        assert infill.select(mask, k) == at
        at += len(unit.encode())


@given(st.integers(0, 10**9), TEXT)
@settings(max_examples=500, deadline=None)
def test_cut_equals_brute_force_and_can_be_undone(doc_id, text):
    c = infill.cut(text, f"42:{doc_id}")
    plain = c.form == "plain"
    assert (c.n, c.form, None if plain else len(c.prefix), None if plain else len(c.middle), c.output(text)) == brute(doc_id, text)
    assert infill.original(c.output(text), c.form) == text


def test_ranks_in_a_long_mask():
    r = random.Random(1)
    places = sorted(r.sample(range(1_000_000), 5000))
    mask = sum(1 << p for p in places)
    assert [infill.select(mask, k) for k in range(0, 5000, 97)] == places[::97]


SCHEMA = "doc_id long, text string, n int, Form string, `odd.name` int, _key int"


def rows():
    out = [(i, f" w{i}  x\ty\n" * (i % 9), 1, "f", 2, 3) for i in range(200)]
    return out + [(500, None, 1, "f", 2, 3), (None, None, 1, "f", 2, 3), (None, "a text without id", 1, "f", 2, 3), (501, "a <M> b c", 1, "f", 2, 3), (502, "lorem ipsum " * 200_000, 1, "f", 2, 3), (7, " w7", 1, "f", 2, 3), (7, " w7", 1, "f", 2, 3)]


def test_transformed_rows(spark):
    df = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    out = infill.transformed(df)
    assert out.columns == ["doc_id", "text", "odd.name", "_key", *infill.ADDED.names]
    assert Counter((r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out.collect()) == Counter((r[0], r[1], *brute(r[0], r[1])) for r in rows())
    assert infill.restored(out).filter("restored <> coalesce(text, '')").count() == 0
    assert {r.form for r in out.select("form").collect()} == {"plain", "spm", "psm"}
    assert infill.transformed(df.limit(0)).count() == 0 and infill.digests(df.limit(0)).count() == 0
    assert infill.transformed(df, rate=0).filter("form <> 'plain'").count() == 0


@pytest.mark.parametrize("seed", [1, 42])
def test_reruns_agree_whatever_the_partitions(spark, seed):
    df = spark.createDataFrame(rows(), SCHEMA)
    a, b = (infill.digests(x, seed=seed) for x in (df.repartition(1), df.repartition(7)))
    assert Counter(map(tuple, a.collect())) == Counter(map(tuple, b.collect()))
