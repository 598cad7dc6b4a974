"""Document fingerprints: threshold-scaled sketches of five-word shingles.

A sketch keeps every shingle hash below ``FRACTION`` of the hash range. What is kept depends on the hash alone, so sketches merge
by union, and the share of one sketch found in another estimates containment however unequal the documents are.

A fingerprint is text: 8 hex digits that stand for the whole word sequence, then 8 for each kept hash, ascending. Likeness is the
share of the smaller sketch that the larger holds; if either is empty (very short texts), it is 1 for equal fingerprints, else 0.
Words are lower-cased (A-Z). Null texts count as empty; texts under five words have one shingle, empty ones none. Of rows with equal ids
the texts' order decides which is next; repeated rows get equal fingerprints. Other columns are ignored, whatever their names; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from .common import Cached, numbers, texts_of, with_next

FRACTION, WORDS = 0.25, 5
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finish that spreads every input bit over the whole value."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(31))


class Sketcher:
    """Sketches of texts; word hashes are remembered within bounds."""

    def __init__(self, fraction: float = FRACTION, words: int = WORDS):
        import xxhash

        self.limit, self.words = np.uint64(min(fraction, 1.0) * ((1 << 64) - 1024)), words
        self.word = Cached(xxhash.xxh3_64_intdigest)

    def sketch(self, text: str) -> tuple[int, np.ndarray]:
        """What stands for the word sequence, and the kept hashes (32 bits each, ascending)."""
        words = text.encode().lower().split()
        if not words:
            return 0, np.zeros(0, np.uint32)
        h = numbers(self.word, words, np.uint64)
        n = max(1, len(h) - self.words + 1)
        acc = np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            for j in range(min(self.words, len(h))):
                acc = acc * _ODD + h[j : j + n]
            acc = _mixed(acc)
            whole = int(_mixed(np.array([np.add.reduce(acc * (np.arange(n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)))]))[0])
        scale = np.uint64(max(0, int(self.limit).bit_length() - 32))
        return whole >> 32, np.unique((acc[acc < self.limit] >> scale).astype(np.uint32))


def written_out(sketch: tuple[int, np.ndarray]) -> str:
    return f"{sketch[0]:08x}" + sketch[1].astype(">u4").tobytes().hex()


def read_in(fingerprint: str) -> tuple[int, np.ndarray]:
    return int(fingerprint[:8], 16), np.frombuffer(bytes.fromhex(fingerprint[8:]), ">u4")


def merged(a: str, b: str) -> str:
    """The sketch of both documents' shingles together (the leading digits, of no one sequence now, are joined by xor)."""
    (x, p), (y, q) = read_in(a), read_in(b)
    return written_out((x ^ y, np.union1d(p, q)))


def likeness(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> float:
    small = min(len(a[1]), len(b[1]))
    if not small:
        return float(a[0] == b[0] and len(a[1]) == len(b[1]))
    return len(np.intersect1d(a[1], b[1], assume_unique=True)) / small


def edited(text: str, following: str) -> str:
    """text with its last floor(n / 2) code points replaced by the first as many of ``following``, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compared(docs: DataFrame, fraction: float = FRACTION) -> DataFrame:
    """Fingerprints of every text and its edited text, with their likeness and that to the next text by doc_id (nulls first, ties by text)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        sk = Sketcher(fraction)
        held = (None, None)  # the text last looked ahead to comes next
        for batch in batches:
            rows = []
            for text, following in zip(texts_of(batch.column("text")), texts_of(batch.column("following"))):
                own = held[1] if held[0] == text else sk.sketch(text)
                changed = edited(text, following)
                other = sk.sketch(changed)
                held = (following, sk.sketch(following))
                rows.append((len(text), hashlib.sha256(changed.encode()).hexdigest(), written_out(own), written_out(other), likeness(own, other), likeness(own, held[1])))
            types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            cols = [pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *cols], names=names)

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    paired = with_next(docs.select("doc_id", "text"), "doc_id", "text", "following", ["text"])
    return paired.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
