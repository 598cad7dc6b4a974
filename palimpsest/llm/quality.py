"""Quality rules with adaptive thresholds from mergeable quantile sketches per language and source.

Each text is measured once. A sketch of a measure counts documents in buckets whose bounds grow by a fixed ratio, so that a quantile
is right to ``ACCURACY``; sketches merge by adding counts, in any order, and reruns agree. Those of every (lang, source) merge into
those of languages and of all documents. A group's median and 10 % quantile are its own as far as it has documents: with n of them,
n / (n + ``ROWS``) is its own and the rest its language's, which is drawn to that of all documents likewise. The upper fence
is the median plus ``WIDTH`` times the way from the 10 % quantile up to the median and what the sketch can't tell apart (twice its
error), the lower fence the mirror of it. The lower half serves for the upper fence, so that junk, which lies above, can't widen it until it is half of a group.

Measures: code points a word; shares of ``#*$%&|<>`` signs in word characters, of repeated lines, and of words in repeated
eight-word windows. Shares are (count + p) / (size + p), so that they differ between documents that have none, by how much their
size tells; a document that has none passes. Only the first measure has a lower fence.

Null texts have no words and fail the base rule; null lang and source are groups too. Documents that fail the base rule aren't
sketched. Equal rows get equal verdicts, each its row; a value on a fence is kept. Other columns, whatever their names, are
ignored; an empty table gives an empty result; memory for a text is in proportion to it. Bytes that aren't UTF-8 count as U+FFFD.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import joined_to_groups, raw_texts, written

ACCURACY, ROWS, WIDTH, WINDOW = 0.01, 20, 8.0, 8
#: Measure -> count, size, and what is added to both.
MEASURES = {"word_len": ("word_chars", "n_words", 0.0), "sign_share": ("n_symbols", "word_chars", 4.0), "line_share": ("n_dup_lines", "n_lines", 0.5), "window_share": ("n_repeat_words", "n_words", 8.0)}
SPACE, SIGNS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more. Windows are ranked by doubling (1, 2, 4, 8 words), so equality is exact."""
    n = len(words)
    if n <= window:
        return 0
    number = {w: i for i, w in enumerate(set(words))}
    if len(number) == n:
        return 0
    rank = np.fromiter(map(number.__getitem__, words), np.int64, n)
    span, size = 1, len(number)
    while span < window:
        values, rank = np.unique(rank[:-span] * size + rank[span:], return_inverse=True)
        size, span = len(values), span * 2
        if size == len(rank):
            return 0
    again = np.bincount(rank)[rank] > 1
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure(text: bytes) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lines with a word."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    solid = text.translate(None, SPACE)
    return len(words), len(solid.decode("utf-8", "replace")), len(text) - len(text.translate(None, SIGNS)), len(lines) - len(set(lines)), repeated_words(words), len(lines)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of every whole text."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = np.array([measure(t) for t in raw_texts(batch.column("text"))], np.int64).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([batch.column(c).cast(t) for c, t in (("doc_id", pa.int64()), ("lang", pa.string()), ("source", pa.string()))] + [pa.array(c) for c in rows.T.copy()], names=["doc_id", "lang", "source", *names])

    return docs.select("doc_id", "text", "lang", "source").mapInArrow(run, "doc_id long, lang string, source string, " + ", ".join(f"{n} long" for n in names))


def _with_measures(counts: DataFrame) -> DataFrame:
    shares = {m: F.try_divide(F.col(a) + F.lit(p), F.col(b) + F.lit(p)) for m, (a, b, p) in MEASURES.items()}
    return counts.withColumns({**shares, "base_failed": (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))})


_RATIO = (1 + ACCURACY) / (1 - ACCURACY)


def sketches(counts: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket, n) of the documents that pass the base rule: few rows a group, counted before any shuffle."""
    place = lambda m: F.ceil(F.log(F.col(m)) / F.log(F.lit(_RATIO))).cast("int")
    each = F.array(*(F.struct(F.lit(m).alias("measure"), place(m).alias("bucket")) for m in MEASURES))
    return counts.filter("not base_failed").select("lang", "source", F.explode(each).alias("e")).groupBy("lang", "source", "e.measure", "e.bucket").agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """One sketch for each value of keys."""
    return sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """keys, measure, n (documents), mid (median) and low (10 % quantile) of every sketch."""
    own = Window.partitionBy(*keys, "measure")  # a row a bucket
    upto = sketch.withColumns({"upto": F.sum("n").over(own.orderBy("bucket")), "all": F.sum("n").over(own)})
    at = lambda q: F.lit(2 / (1 + _RATIO)) * F.pow(F.lit(_RATIO), F.min(F.when(F.col("upto") >= F.col("all") * q, F.col("bucket"))))
    return upto.groupBy(*keys, "measure").agg(F.max("all").alias("n"), at(0.5).alias("mid"), at(0.1).alias("low"))


def _shrunk(own: DataFrame, wider: DataFrame, keys: list[str]) -> DataFrame:
    """own with mid and low drawn to those of the wider groups, whose keys are ``keys``."""
    few = wider.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("measure").alias("_measure"), F.col("mid").alias("_mid"), F.col("low").alias("_low"))
    same = F.col("measure") == F.col("_measure")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    share = F.col("n") / (F.col("n") + ROWS)
    drawn = {c: share * F.col(c) + (1 - share) * F.col(f"_{c}") for c in ("mid", "low")}
    return own.join(few, same).withColumns(drawn).select(*own.columns)


def fences(counts: DataFrame) -> DataFrame:
    """(lang, source, a fence above for each measure, one below for word_len)."""
    own = written(sketches(counts), "quality-sketches")
    by_lang = _shrunk(quantiles(merged(own, ["lang"]), ["lang"]), quantiles(merged(own, []), []), [])
    q = _shrunk(quantiles(own, ["lang", "source"]), by_lang, ["lang"])
    way = WIDTH * (F.col("mid") - F.col("low") + 2 * ACCURACY * F.col("mid"))
    of = lambda m, c: F.max(F.when(F.col("measure") == m, c))
    cuts = [of(m, F.col("mid") + way).alias(f"{m}_most") for m in MEASURES]
    return q.groupBy("lang", "source").agg(*cuts, of("word_len", F.col("mid") - way).alias("word_len_least"))


def judged(docs: DataFrame) -> DataFrame:
    """The counts of every document, base_failed, and kept: not base_failed and within all its group's fences."""
    counts = _with_measures(written(measured(docs), "quality"))
    joined = joined_to_groups(counts, written(fences(counts), "quality-fences"), ["lang", "source"])
    inside = F.col("word_len") >= F.col("word_len_least")
    for m, (count, _, p) in MEASURES.items():
        within = F.col(m) <= F.col(f"{m}_most")
        inside = inside & ((F.col(count) == 0) | within if p else within)
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.coalesce(inside, F.lit(False))).alias("kept"))
