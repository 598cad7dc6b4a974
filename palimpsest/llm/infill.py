"""Fill-in-middle transformation by bit-parallel work on big integers.

A token is a run of whitespace (space, \\t..\\r) with the word after it, or what whitespace is left at the end. The UTF-8 bytes of a text are
translated to a mask with a bit a byte, 1 for whitespace. A token starts at the text's start and where whitespace follows a word, which is one
shift and two boolean operations on the whole text at once; bit_count() of that mask is the number n of tokens, and the byte at
which the k-th token starts is found by recursive halving: the count of the lower half says in which half to go on. As all classes are ASCII,
byte masks are right for any UTF-8, and no token is ever made.

Two cuts and the form come from the SHA-256 of ``seed:doc_id`` alone, so reruns and partitions agree. Texts that hold a marker stay plain, as
do empty ones; all others can be rebuilt from output and form, which original() does.

A null text is an empty one; a null id counts as the empty text after ``seed:``. Rows with equal ids and texts get equal outputs. Texts
of any length are cut whole (a mask takes a seventh of the text's bytes). Bytes that aren't UTF-8 become U+FFFD. transformed() keeps all columns,
whatever their names, and takes the place of columns named as those it adds, in any case; an empty table stays empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import texts_of

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, SPM, PSM = "plain", "spm", "psm"
#: Hundredths of the texts that are cut, and of these that have the suffix first.
RATE, SUFFIX_FIRST, SEED = 50, 80, 42
_SPACE = bytes(48 + (b == 0x20 or 0x09 <= b <= 0x0D) for b in range(256))
#: From so few bits on a mask's ranks are found bit by bit.
_FEW = 64


def starts_of(text: bytes) -> int:
    """Bit i is set if a token starts at byte i."""
    if not text:
        return 0
    space = int(text.translate(_SPACE)[::-1], 2)
    words = space ^ ((1 << len(text)) - 1)
    return space & (words << 1) | 1


def select(mask: int, k: int) -> int:
    """The place of the set bit of rank k (from 0); k must be below mask.bit_count()."""
    at, size = 0, mask.bit_length()
    while size > _FEW:
        half = size >> 1
        low = mask & ((1 << half) - 1)
        below = low.bit_count()
        if k < below:
            mask, size = low, half
        else:
            mask, k, at, size = mask >> half, k - below, at + half, size - half
    for _ in range(k):
        mask &= mask - 1
    return at + (mask & -mask).bit_length() - 1


class Cut(NamedTuple):
    n: int
    form: str
    prefix: str
    middle: str
    suffix: str

    def output(self, text: str) -> str:
        if self.form == PLAIN:
            return text
        if self.form == PSM:
            return f"{PREFIX}{self.prefix}{SUFFIX}{self.suffix}{MIDDLE}{self.middle}"
        return f"{SUFFIX}{self.suffix}{PREFIX}{self.prefix}{MIDDLE}{self.middle}"


def cut(text: str, key: str, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> Cut:
    """How a text is cut under a key, whose SHA-256 gives both cuts, whether it is cut, and the form."""
    digest = hashlib.sha256(key.encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    raw = text.encode()
    starts = starts_of(raw)
    n = starts.bit_count()
    if not text or h3 % 100 >= rate or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return Cut(n, PLAIN, "", "", "")
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    i, j = (select(starts, k) if k < n else len(raw) for k in (a, b))
    return Cut(n, SPM if h4 % 100 < suffix_first else PSM, raw[:i].decode(), raw[i:j].decode(), raw[j:].decode())


def original(output: str, form: str) -> str:
    """The text that an output was made of. A marker can't arise where a text meets one, so the first of each is the one put there."""
    if form == PLAIN:
        return output
    order = (PREFIX, SUFFIX, MIDDLE) if form == PSM else (SUFFIX, PREFIX, MIDDLE)
    parts, rest = {}, output[len(order[0]) :]
    for own, following in zip(order, order[1:]):
        parts[own], rest = rest.split(following, 1)
    return parts[PREFIX] + rest + parts[SUFFIX]


ADDED = T.StructType([T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())])


def transformed(docs: DataFrame, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: int = SEED) -> DataFrame:
    """docs with n (tokens), form, prefix_chars and middle_chars (code points, null if plain) and output. One pass, no shuffle."""
    added = {f.name for f in ADDED}
    own = [f for f in docs.schema.fields if f.name.lower() not in added]
    kept = [f.name for f in own]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            *held, keys = batch.columns
            texts = texts_of(held[kept.index("text")])
            cuts = [cut(t, k, rate, suffix_first) for t, k in zip(texts, keys.to_pylist())]
            plain = [c.form == PLAIN for c in cuts]
            columns = [
                pa.array([c.n for c in cuts], pa.int64()),
                pa.array([c.form for c in cuts], pa.string()),
                pa.array([None if p else len(c.prefix) for c, p in zip(cuts, plain)], pa.int64()),
                pa.array([None if p else len(c.middle) for c, p in zip(cuts, plain)], pa.int64()),
                pa.array([c.output(t) for c, t in zip(cuts, texts)], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([*held, *columns], names=[*kept, *ADDED.names])

    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    keyed = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)), key.alias("key"))  # names with dots can't be handed on
    return keyed.mapInArrow(run, T.StructType([*own, *ADDED.fields]))


def restored(rows: DataFrame, out: str = "restored") -> DataFrame:
    """rows (with output and form) with the text each was made of; plain rows have their own."""

    @F.pandas_udf("string")
    def back(output, form):
        import pandas as pd

        return pd.Series([original(o, f) for o, f in zip(output, form)], dtype=object)

    return rows.withColumn(out, back("output", "form"))


def digests(docs: DataFrame, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: int = SEED) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, and the SHA-256 of output and of the text rebuilt from it."""
    made = restored(transformed(docs.select("doc_id", "text"), rate, suffix_first, seed))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    return made.select(F.col("doc_id").cast("long").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", digest("output"), digest("restored"))


SQL = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units FROM documents),
  k AS (SELECT doc_id, text, units, CAST(len(units) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
    CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
  c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS i, greatest(h1 % (n + 1), h2 % (n + 1)) AS j,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM k),
  p AS (SELECT *, array_to_string(units[1:i], '') AS prefix, array_to_string(units[i + 1:j], '') AS middle, array_to_string(units[j + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p"""
