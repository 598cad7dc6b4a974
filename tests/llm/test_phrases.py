"""Phrase mining against a version with plain counters, with many parts and salts, and on odd tables."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import phrases

SCHEMA = "doc_id long, text string, lang string, n int, phrase string, part int"


def brute(rows, least, top=2000):
    """lang -> ranked (phrase, a, l, r, n, score)."""
    f, n = {}, Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for _, text, lang, *_ in rows:
        lang, text = lang or "und", (text or "").translate(lower)
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f.setdefault(lang, Counter()).update(" ".join(w[i : i + k]) for i in range(len(w) - k + 1))
    out = {}
    for lang, c in f.items():
        found = {p: a for p, a in c.items() if " " in p and a >= least}
        held = Counter()
        for p, a in found.items():
            w = p.split(" ")
            for k in range(2, len(w)):
                for i in range(len(w) - k + 1):
                    inner = " ".join(w[i : i + k])
                    held[inner] = max(held[inner], a)
        rows_ = []
        for p, a in found.items():
            w = p.split(" ")
            score, k = min((2_000_000 * a // (c[" ".join(w[:k])] + c[" ".join(w[k:])]), k) for k in range(1, len(w)))
            if 100 * held[p] < 80 * a:
                rows_.append((p, a, c[" ".join(w[:k])], c[" ".join(w[k:])], n[lang], score))
        out[lang] = sorted(rows_, key=lambda x: (-x[5], -x[1], x[0].encode()))[:top]
    return {lang: rows_ for lang, rows_ in out.items() if rows_}


def as_lists(df):
    out = {}
    for r in df.orderBy("lang", "rank").collect():
        out.setdefault(r.lang, []).append(tuple(r[c] for c in ("phrase", "a", "l", "r", "n", "score")))
        assert r["rank"] == len(out[r.lang])
    return out


def rows():
    r = random.Random(4)
    vocabulary = ["New", "york", "times", "the", "of", "été", "日本", "a\x1cb", "x" * 300, *(f"w{i}" for i in range(25))]
    out = []
    for i in range(400):
        words = [r.choice(vocabulary) for _ in range(r.randrange(60))]
        if i % 3 == 0:
            words[3:3] = ["in", "New", "York", "City"]
        text = "".join(w + r.choice([" ", " ", " ", "\t ", ", ", "\n", ". "]) for w in words)
        out.append((i, text, ("en", "fr", None, "und")[i % 4], 1, "p", 2))
    out += [(900, None, "en", 1, "p", 2), (901, "", "en", 1, "p", 2), (None, "of of of of of of of", None, 1, "p", 2), (902, "the of " * 30_000, "en", 1, "p", 2)]
    return out + out[:40] + [out[7]] * 40


@pytest.mark.parametrize(("part", "scan"), [(60_000, 1 << 25), (20, 4_000)])
def test_equals_brute_force_in_one_part_and_in_many(spark, monkeypatch, part, scan):
    monkeypatch.setattr(phrases, "PART", part)
    monkeypatch.setattr(phrases, "SCAN_BYTES", scan)
    df = spark.createDataFrame(rows(), SCHEMA).repartition(5)
    assert as_lists(phrases.mined(df, least=10)) == brute(rows(), 10)
    monkeypatch.setattr(phrases, "BLOBS", 1)
    assert as_lists(phrases.mined(df, least=4, top=15)) == brute(rows(), 4, 15)


def test_a_small_sketch_costs_candidates_and_no_result(spark, monkeypatch):
    df = spark.createDataFrame(rows(), SCHEMA)
    monkeypatch.setattr(phrases, "FEWEST_CELLS", 6)
    monkeypatch.setattr(phrases, "MOST_CELLS", 6)
    assert as_lists(phrases.mined(df, least=10)) == brute(rows(), 10)


def test_bits_are_upper_bounds(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    cells = phrases.cell_count(df)
    bits = phrases.sketched(df, cells, 4, 10)
    listed = lambda b: {(r.lang, p.decode()) for r in phrases.candidates(df, b, cells, 3).filter("part >= 0").collect() for p in phrases._unlisted(r.payload)}
    found = listed(bits)
    assert {(lang, p[0]) for lang, ps in brute(rows(), 10).items() for p in ps} <= found
    assert len(found) < len(listed(bits | 255)) / 5


def test_chunks_end_at_breaks_and_words_keep_their_places(monkeypatch):
    monkeypatch.setattr(phrases, "CHUNK", 64)
    r = random.Random(3)
    texts = ["".join(r.choice("abAé \t\t  .,\n\x0b\x1c") for _ in range(r.randrange(200))).encode() for _ in range(50)]
    got = []
    for chunk in phrases.chunks(texts):
        runs = phrases.Runs("en", chunk)
        got += [(runs.text[a:b], left) for a, b, left in zip(runs.start, runs.stop, runs.left)]
        same = {}
        assert all(same.setdefault(h, runs.text[a:b]) == runs.text[a:b] for h, a, b in zip(runs.h.tolist(), runs.start, runs.stop))
    want = []
    for t in texts:
        for piece in re.split(rb"[.,;:!?\x0A-\x0D]", t.lower()):
            w = re.findall(rb"[^\x20\x09]+", piece)
            want += [(x, len(w) - i) for i, x in enumerate(w)]
    assert got == want


def test_odd_tables(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    assert phrases.mined(df.limit(0)).count() == 0
    assert phrases.mined(df.withColumn("text", F.lit(None).cast("string"))).count() == 0
    assert phrases.mined(df.withColumn("text", F.lit(" , . "))).count() == 0


def test_scores_past_64_bits(spark):
    big = 9 * 10**15
    counts = spark.createDataFrame([("en", "a", big), ("en", "b", big - 1), ("en", "a b", big - 5)], "lang string, phrase string, f long")
    r = phrases.scored(counts).first()
    assert r.score == 2_000_000 * (big - 5) // (2 * big - 1)
