"""Language identification by interpolated Kneser-Ney character models.

Each language has a model of the letters inside words (order ``ORDER``; a word starts after blanks and ends in one). Probabilities
and back-off weights of all languages stand in one table an order, its n-gram hashes sorted, found by binary search. A text's
language is the one with the least cross-entropy a letter. Models are learned on the driver from a bounded sample: ``LEARN`` texts
a language by hash of the id; ``CHECK`` more set the temperature of the score and, for each language, the cross-entropy beyond
which a text is marked ``rejected`` (its language stays the best one). Distinct words are scored once a group of texts.

Texts without a letter (and null or empty ones) are ``und`` with score 0. Rows with null text or language aren't learned from. With
no languages to learn from, all are ``und``. Equal cross-entropies go to the first language by code point. Repeated rows get equal
predictions; other columns are ignored, whatever their names. An empty table gives an empty result. What is collected and sent grows
with the number of languages alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fold, joined_to_groups, raw_texts

ORDER, LEARN, CHECK, KEEP = 5, 250, 80, 300_000
REJECT = 0.995
_ODD = 0x9E3779B97F4A7C15


def letters(word: bytes) -> str:
    text = word.decode("utf-8", "replace").lower()
    return text if text.isalpha() else "".join(c for c in text if c.isalpha())


class Grams:
    """Hashes of the n-grams, n = 1..ORDER, that end at each position of padded words, and which positions count."""

    def __init__(self, words: list[str]):
        pad = " " * (ORDER - 1)
        points = np.frombuffer("".join([pad + w + " " for w in words]).encode("utf-32-le"), np.uint32).astype(np.uint64)
        size = np.fromiter(map(len, words), np.int64, len(words))
        self.size = size + 1
        starts = np.cumsum(size + ORDER) - (size + ORDER)
        self.at = np.repeat(starts + ORDER - 1 - (np.cumsum(self.size) - self.size), self.size) + np.arange(self.size.sum())
        with np.errstate(over="ignore"):
            c = (points + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
            c = (c ^ (c >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            self.ending = [np.zeros(len(c), np.uint64)]
            power = np.uint64(1)
            for n in range(1, ORDER + 1):
                h = self.ending[-1].copy()
                h[n - 1 :] += c[: len(c) - n + 1] * power
                self.ending.append(h)
                power = np.uint64(int(power) * _ODD & (1 << 64) - 1)


def _totals(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the first place of each, and their summed weights."""
    values, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
    return values, first, np.bincount(inverse, weights=weights, minlength=len(values))


def _counts(words: dict[str, int]) -> list[dict[str, np.ndarray]]:
    """For each order the n-grams with discounted probabilities and the contexts with back-off weights."""
    names = list(words)
    grams = Grams(names)
    place, weight = grams.at, np.repeat(np.array([words[w] for w in names], float), grams.size)
    out = []
    for n in range(ORDER, 0, -1):
        keys, first, count = _totals(grams.ending[n][place], weight)
        here = place[first]
        n1, n2 = (count == 1).sum(), (count == 2).sum()
        discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        contexts, _, total = _totals(grams.ending[n - 1][here - 1] if n > 1 else np.zeros(len(here), np.uint64), count)
        of = np.searchsorted(contexts, grams.ending[n - 1][here - 1] if n > 1 else np.zeros(len(here), np.uint64))
        cut = np.minimum(count, discount)
        out.append({"keys": keys, "p": (count - cut) / total[of], "contexts": contexts, "left": np.bincount(of, weights=cut, minlength=len(contexts)) / total})
        place, weight = here, np.ones(len(here))  # below, an n-gram counts once for each letter before it
    return out[::-1]


class Models:
    """All languages' models: for each order sorted hashes, probabilities and, as contexts of the next order, back-off weights."""

    def __init__(self, words: dict[str, dict[str, int]]):
        self.langs = sorted(words)
        k = len(self.langs)
        parts = [_counts(words[lang]) for lang in self.langs]
        self.root = np.array([p[0]["left"][0] for p in parts], np.float32) if k else np.zeros(0, np.float32)
        self.floor = 1.0 / 4096
        self.keys, self.p, self.left = [], [], []
        for n in range(1, ORDER + 1):
            own = [p[n - 1]["keys"] for p in parts] + ([p[n]["contexts"] for p in parts] if n < ORDER else [])
            keys = np.unique(np.concatenate(own)) if own else np.zeros(0, np.uint64)
            prob, left = np.zeros((len(keys) + 1, k), np.float32), np.ones((len(keys) + 1, k), np.float32)
            for i, p in enumerate(parts):
                prob[np.searchsorted(keys, p[n - 1]["keys"]), i] = p[n - 1]["p"]
                if n < ORDER:
                    left[np.searchsorted(keys, p[n]["contexts"]), i] = p[n]["left"]
            self.keys.append(keys)
            self.p.append(prob)
            self.left.append(left)
        self.heat, self.limit = 1.0, np.full(k, np.inf)

    def _find(self, n: int, hashes: np.ndarray) -> np.ndarray:
        """Rows of order n; the last row, of zeros and ones, for unknown n-grams."""
        keys = self.keys[n - 1]
        at = np.searchsorted(keys, hashes)
        known = at < len(keys)
        known[known] = keys[at[known]] == hashes[known]
        return np.where(known, at, len(keys))

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Negative log probability of each word for each language."""
        out = np.zeros((len(words), len(self.langs)), np.float32)
        for i in range(0, len(words), 20_000):
            part = words[i : i + 20_000]
            grams = Grams(part)
            place = grams.at
            p = np.float32(self.floor) * self.root[None, :] + self.p[0][self._find(1, grams.ending[1][place])]
            for n in range(2, ORDER + 1):
                p = self.p[n - 1][self._find(n, grams.ending[n][place])] + self.left[n - 2][self._find(n - 1, grams.ending[n - 1][place - 1])] * p
            out[i : i + len(part)] = np.add.reduceat(-np.log(np.maximum(p, 1e-30)), np.cumsum(grams.size) - grams.size, axis=0)
        return out


class Scorer:
    """Mean cross-entropies of texts, with the scores of known words kept up to ``KEEP`` words."""

    def __init__(self, models: Models):
        self.m = models
        self.slot: dict[bytes, int] = {}
        self.table = np.zeros((0, len(models.langs) + 2), np.float32)  # scores, letters and ends, letters

    def texts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropies a letter (rows: texts), and numbers of letters."""
        cut = [t.split() for t in texts]
        fresh = list(set().union(*cut).difference(self.slot))
        if len(self.slot) + len(fresh) > KEEP:
            self.slot, fresh = {}, list(set().union(*cut))
            self.table = self.table[:0]
        clean = [letters(w) for w in fresh]
        size = np.fromiter(map(len, clean), np.float32, len(clean))
        rows = np.zeros((len(fresh), self.table.shape[1]), np.float32)
        has = np.flatnonzero(size)
        if len(has) and self.m.langs:
            rows[has, :-2] = self.m.word_scores([clean[i] for i in has])
        rows[:, -1], rows[has, -2] = size, size[has] + 1
        self.slot.update(zip(fresh, range(len(self.table), len(self.table) + len(fresh))))
        self.table = np.concatenate([self.table, rows])
        sums = np.zeros((len(texts), self.table.shape[1]))
        for i, words in enumerate(cut):
            if words:
                sums[i] = self.table[np.fromiter(map(self.slot.__getitem__, words), np.int64, len(words))].sum(axis=0, dtype=np.float64)
        return sums[:, :-2] / np.maximum(sums[:, -2:-1], 1), sums[:, -1]


def _posterior(h: np.ndarray, heat: float) -> np.ndarray:
    z = np.exp(-(h - h.min(axis=1, keepdims=True)) * heat)
    return z / z.sum(axis=1, keepdims=True)


def trained(docs: DataFrame) -> Models:
    """Models from at most LEARN + CHECK whole texts a language, of rows whose fold of 3 is not 1."""
    known = docs.filter("lang is not null and text is not null and doc_id is not null").filter(fold(F.col("doc_id"), 3) != 1)
    # The least hashes of a language: a threshold from its count lets about twice as many through, which then are ranked.
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    share = F.least(F.lit(1.0), 2.0 * (LEARN + CHECK) / F.col("n"))
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).select("lang", (share * (1 << 40)).cast("long").alias("most"))
    few = joined_to_groups(known.select("doc_id", "lang"), counts, ["lang"]).filter(place <= F.col("most"))
    order = Window.partitionBy("lang").orderBy(place, "doc_id")
    chosen = few.select("doc_id", "lang").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= LEARN + CHECK)
    texts = known.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"])  # LEARN + CHECK rows a language
    rows = texts.select("lang", "place", "text").toArrow().sort_by([("lang", "ascending"), ("place", "ascending")])
    langs, place, raw = rows.column("lang").to_pylist(), rows.column("place").to_pylist(), raw_texts(rows.column("text"))
    counts: dict[str, dict[str, int]] = {}
    for lang, n, text in zip(langs, place, raw):
        if n <= LEARN:
            own = counts.setdefault(lang, {})
            for w in text.split():
                w = letters(w)
                if w:
                    own[w] = own.get(w, 0) + 1
    models = Models({lang: own for lang, own in counts.items() if own})
    held = [i for i, n in enumerate(place) if n > LEARN and langs[i] in models.langs]
    if held:
        h, size = Scorer(models).texts([raw[i] for i in held])
        truth = np.array([models.langs.index(langs[i]) for i in held])
        has = size > 0
        h, truth = h[has], truth[has]
        if len(h):
            losses = {t: -np.log(np.maximum(_posterior(h, t)[np.arange(len(h)), truth], 1e-9)).mean() for t in (1, 2, 4, 8, 16, 32, 64)}
            models.heat = float(min(losses, key=losses.get))
            for i in range(len(models.langs)):
                own = h[truth == i, i]
                if len(own):
                    models.limit[i] = np.quantile(own, REJECT) * 1.05
    return models


def predicted(docs: DataFrame, models: Models | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of every whole text."""
    models = models or trained(docs)
    shared = docs.sparkSession.sparkContext.broadcast(models)  # bounded by the sample

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        m = shared.value
        scorer = Scorer(m)
        for batch in batches:
            h, size = scorer.texts(raw_texts(batch.column("text")))
            if m.langs and len(h):
                best = h.argmin(axis=1)
                post = _posterior(h, m.heat)[np.arange(len(h)), best]
                far = h[np.arange(len(h)), best] > m.limit[best]
                names = [m.langs[b] if n else "und" for b, n in zip(best, size)]
                score, rejected = np.where(size > 0, post, 0.0), (size == 0) | far
            else:
                names, score, rejected = ["und"] * len(h), np.zeros(len(h)), np.ones(len(h), bool)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"])

    out = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")
    return out.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score", "rejected")
