"""Phrase collocation mining: candidates from sketch upper bounds, counted by delimiter-guarded automata.

Texts are cut into pieces at punctuation and line ends, pieces into words; a phrase is two to four neighbouring words of a piece. Four steps, each
a pass over whole texts:

1. A count-min sketch of all runs of one to four words of a language: tasks count cells in sorted batches, partial sums of a shard of cells are added up
   by Spark. A cell never counts less than any run that falls in it, so a run whose cell is below the threshold is out for certain.
   Only a bit a cell remains, whether it reaches the threshold.
2. Runs whose cells, and whose parts' cells, all reach it are the candidates: distinct (language, run), dealt by first word into
   parts of about ``PART``.
3. The stretches of text in which candidates of a part can stand go to its tasks. A task compiles its part's candidates, each between two
   spaces, into an Aho-Corasick automaton and scans its stretches, which are held together by spaces as well, so matches are whole
   words and all overlapping ones count. Stretches of one part never share a word's place, so nothing is counted twice.
4. Counts are added up, thresholds applied, and scores made in exact decimals.

What is sent to every task is the sketch's bits, at most 2**MOST_CELLS of them (64 MB). The number of cells grows with the input up to that; beyond it
more runs pass, which costs time and changes no result, as every count is exact. A task holds one automaton and one batch, however
frequent a word, line or language is: stretches are dealt by (language, part, salt) and stream through.

Null texts are empty; a null language is ``und`` (with texts that name it so). Repeated rows count as often as they are there; ids and other
columns are ignored, whatever their names. An empty table gives an empty result. Words of any length count.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce
from operator import itemgetter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import raw_texts, written

#: Words of the longest phrase; occurrences that a candidate needs; phrases of a language in the result.
WORDS, LEAST, TOP = 4, 30, 2000
#: A phrase goes if one that holds it occurs so many hundredths as often.
HELD = 80
#: Candidates of an automaton, about (its nodes take some 60 bytes a letter).
PART = 80_000
#: Bytes of stretches that a task scans, about; cells of a shard of the sketch; the fewest and the most cells, as powers of two.
SCAN_BYTES, SHARD_CELLS, FEWEST_CELLS, MOST_CELLS = 32 << 20, 20, 20, 29
#: Runs that a task gathers before it counts them; blobs of a shard that one task adds up.
GATHERED, BLOBS = 8_000_000, 2048
#: Phrases that a task gathers before it hands them on; phrases of a row; bytes of text that are looked at together, about.
HANDED, ROW_PHRASES, CHUNK = 400_000, 5_000, 1 << 20
_BREAKS = bytes(10 if chr(b) in ".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))
_ODD = np.uint64(0x9E3779B97F4A7C15)
_POWERS = [np.ones(1, np.uint64)]


def _powers(n: int, odd: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """odd**0 .. odd**(n - 1) modulo 2**64."""
    if len(_POWERS[0]) < n:
        with np.errstate(over="ignore"):
            _POWERS[0] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(2 * n, odd, np.uint64)]), dtype=np.uint64)
    return _POWERS[0][:n]


def _inverse(odd: np.ndarray) -> np.ndarray:
    """x with x * odd = 1 modulo 2**64."""
    x = odd.copy()
    for _ in range(5):
        x *= np.uint64(2) - odd * x
    return x


def chunks(texts: list[bytes]) -> Iterator[bytes]:
    """The texts lower-cased, breaks as line ends and tabs as spaces, in chunks that end at breaks."""
    joined = b"\n".join(texts).lower().translate(_BREAKS)
    at = 0
    while at < len(joined):
        end = joined.find(b"\n", at + CHUNK) if at + CHUNK < len(joined) else -1
        end = len(joined) if end < 0 else end + 1
        yield joined[at:end]
        at = end


class Runs:
    """A chunk's words, with single spaces between those of a piece, and the hashes of their runs."""

    def __init__(self, lang: str, chunk: bytes):
        import xxhash

        raw = np.frombuffer(b"\n" + chunk + b"\n", np.uint8)
        gap = (raw == 32) | (raw == 10)
        keep = ~gap
        keep[0] = True
        keep[1:] |= gap[1:] & ~gap[:-1] | (raw[1:] == 10)
        raw = raw[keep]
        gap = (raw == 32) | (raw == 10)
        self.text = raw.tobytes()
        self.start = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1
        self.stop = np.flatnonzero(~gap[:-1] & gap[1:]) + 1
        n = len(self.start)
        piece = np.cumsum(raw == 10)[self.start] if n else np.zeros(0, np.int64)
        edges = np.flatnonzero(np.concatenate([piece[1:] != piece[:-1], [True]])) + 1 if n else np.zeros(0, np.int64)
        self.left = np.repeat(edges, np.diff(edges, prepend=0)) - np.arange(n)  # words from here to the end of the piece
        with np.errstate(over="ignore"):
            pw = _powers(len(raw) + 1)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * pw[:-1], dtype=np.uint64)])
            h = (sums[self.stop] - sums[self.start]) * _inverse(pw[self.start])
            h = (h ^ (h >> np.uint64(32))) * _ODD
            self.h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        self.seed = np.uint64(xxhash.xxh64_intdigest(lang.encode(), 7))

    def part(self, parts: int) -> np.ndarray:
        """The part of the phrases that start at each word."""
        return ((self.h >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)

    def hashes(self, most: int) -> list[np.ndarray]:
        """For 1 to ``most`` words: the hash of the run from each place on, whether or not it leaves the piece."""
        out, acc, n = [], np.full(len(self.h), self.seed), len(self.h)
        with np.errstate(over="ignore"):
            for k in range(most):
                acc = acc[: max(0, n - k)]
                acc = (acc ^ self.h[k:]) * _ODD
                acc ^= acc >> np.uint64(29)
                acc *= np.uint64(0xBF58476D1CE4E5B9)
                acc ^= acc >> np.uint64(32)
                out.append(acc)
        return out

    def admitted(self, bits: np.ndarray, cells: int, most: int) -> np.ndarray:
        """The words of the longest run from each place on all of whose parts reach the threshold; 0 if the word itself doesn't."""
        out = np.zeros(len(self.h), np.int64)
        before = None
        for k, acc in enumerate(self.hashes(most)):
            at = (acc & np.uint64((1 << cells) - 1)).astype(np.int64)
            ok = (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool) & (self.left[: len(at)] > k)
            if before is not None:
                ok &= before[: len(ok)] & before[1 : len(ok) + 1]  # both runs that are a word shorter
            out[: len(ok)][ok] = k + 1
            before = ok
        return out


def _runs(batch) -> Iterator[tuple[str, Runs]]:
    """The chunks of a batch, each of one language."""
    by_lang: dict[str, list[bytes]] = {}
    for lang, text in zip(batch.column("lang").to_pylist(), raw_texts(batch.column("text"))):
        by_lang.setdefault(lang, []).append(text)
    for lang, some in by_lang.items():
        for chunk in chunks(some):
            yield lang, Runs(lang, chunk)


def texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").filter("text is not null")


def cell_count(docs: DataFrame, most: int = WORDS) -> int:
    """The power of two of the sketch's cells: about one for two runs, within the bounds."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(MOST_CELLS, max(FEWEST_CELLS, int(size / 6 * most / 2).bit_length()))


def _packed(values: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(values.tobytes())


def _gaps(places: np.ndarray) -> bytes:
    """Ascending places of a shard as gaps, their low bytes first."""
    return _packed(np.diff(places.astype("<u4"), prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T[: SHARD_CELLS + 7 >> 3])


def _unpacked(blob: bytes, kind) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), kind)


def _cells(docs: DataFrame, cells: int, most: int) -> DataFrame:
    """(shard, gaps, counts): partial counts of the cells of a shard."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held, gathered = [], 0

        def flushed():
            at = np.concatenate(held)
            at.sort()
            first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            n = np.minimum(np.diff(np.append(first, len(at))), 255).astype(np.uint8)
            at = at[first]
            shard = at >> np.uint32(SHARD_CELLS)
            bounds = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]])).tolist()
            gaps = [_gaps(at[a:b] & np.uint32((1 << SHARD_CELLS) - 1)) for a, b in zip(bounds, bounds[1:])]
            counts = [_packed(n[a:b]) for a, b in zip(bounds, bounds[1:])]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(shard[bounds[:-1]].astype(np.int32)), pa.array(gaps, pa.binary()), pa.array(counts, pa.binary())], names=["shard", "gaps", "counts"])

        for batch in batches:
            for lang, runs in _runs(batch):
                for k, acc in enumerate(runs.hashes(most)):
                    held.append((acc[runs.left[: len(acc)] > k] & np.uint64((1 << cells) - 1)).astype(np.uint32))
                    gathered += len(held[-1])
                if gathered >= GATHERED:
                    yield flushed()
                    gathered = 0
        if gathered:
            yield flushed()

    return texts(docs).mapInArrow(run, "shard int, gaps binary, counts binary")


def _added(parts: DataFrame, least: int | None = None) -> DataFrame:
    """Partial counts of equal shards of a task added up (capped at 255, so that sums stay upper bounds where it matters); with ``least``, bits instead."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        now, total = None, np.zeros(1 << SHARD_CELLS, np.uint32)

        def out():
            if least is None:
                at = np.flatnonzero(total)
                gaps = _gaps(at)
                counts = _packed(np.minimum(total[at], 255).astype(np.uint8))
            else:
                gaps, counts = _packed(np.packbits(total >= least, bitorder="little")), None
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([gaps], pa.binary()), pa.array([counts], pa.binary())], names=["shard", "gaps", "counts"])

        for batch in batches:
            for shard, gaps, counts in zip(*(batch.column(c).to_pylist() for c in ("shard", "gaps", "counts"))):
                if shard != now:
                    if now is not None:
                        yield out()
                    now = shard
                    total[:] = 0
                places = sum(p.astype(np.int64) << 8 * i for i, p in enumerate(_unpacked(gaps, np.uint8).reshape(SHARD_CELLS + 7 >> 3, -1)))
                total[np.cumsum(places)] += _unpacked(counts, np.uint8)
        if now is not None:
            yield out()

    return parts.mapInArrow(run, "shard int, gaps binary, counts binary")


def sketched(docs: DataFrame, cells: int, most: int = WORDS, least: int = LEAST) -> np.ndarray:
    """A bit a cell, set if the cell reaches ``least`` (at most 255)."""
    blobs = _cells(docs, cells, most)
    salts = 1 + int((docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / 6 * most / GATHERED / BLOBS)
    if salts > 1:
        blobs = _added(blobs.withColumn("salt", F.pmod(F.xxhash64("gaps"), F.lit(salts))).repartition("shard", "salt").sortWithinPartitions("shard").drop("salt"))
    bits = np.zeros(max(1, 1 << cells >> 3), np.uint8)
    width = 1 << SHARD_CELLS >> 3
    for r in _added(blobs.repartition("shard").sortWithinPartitions("shard"), least).select("shard", "gaps").toLocalIterator():  # at most 2**MOST_CELLS bits
        bits[r["shard"] * width : (r["shard"] + 1) * width] = _unpacked(r["gaps"], np.uint8)[: len(bits)]
    return bits


def _listed(phrases: Iterable[bytes]) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(b"\n".join(phrases))


def _unlisted(blob: bytes) -> list[bytes]:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(blob).split(b"\n")


def candidates(docs: DataFrame, bits: np.ndarray, cells: int, parts: int, most: int = WORDS) -> DataFrame:
    """(lang, part, n, payload): lists of the runs of one to ``most`` words that may reach the threshold, each once in its part; every one that does is
    there. Rows of part -1 have n words of a language."""
    held = docs.sparkSession.sparkContext.broadcast(bits)  # 2**MOST_CELLS bits at most
    names, kinds = ["lang", "part", "n", "payload"], "lang string, part int, n long, payload binary"

    def batch_of(rows: list[tuple]):
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.int64(), pa.binary()))], names=names)

    def found(batches: Iterator) -> Iterator:
        words, own, seen = Counter(), {}, set()

        def handed():
            rows = [(lang, part, None, _listed(sorted(some))) for (lang, part), some in own.items()]
            own.clear()
            return batch_of(rows)

        for batch in batches:
            for lang, runs in _runs(batch):
                words[lang] += len(runs.start)
                longest, part = runs.admitted(held.value, cells, most), runs.part(parts)
                for k, acc in enumerate(runs.hashes(most)):
                    at = np.flatnonzero(longest[: len(acc)] > k)
                    hashes, first = np.unique(acc[at], return_index=True)
                    at = at[first]
                    for h, p, a, b in zip(hashes.tolist(), part[at].tolist(), runs.start[at].tolist(), runs.stop[at + k].tolist()):
                        if h not in seen:
                            seen.add(h)
                            own.setdefault((lang, p), []).append(runs.text[a:b])
                if len(seen) > HANDED and own:  # what was seen may be told again
                    yield handed()
                    seen.clear()
        if own:
            yield handed()
        if words:
            yield batch_of([(lang, -1, n, None) for lang, n in words.items()])

    def together(batches: Iterator) -> Iterator:
        now, n, own = None, 0, set()

        def ended():
            if now[1] < 0:
                return [(*now, n, None)]
            some = sorted(own)
            return [(*now, None, _listed(some[i : i + ROW_PHRASES])) for i in range(0, len(some), ROW_PHRASES)]

        for batch in batches:
            for lang, part, more, blob in zip(*(batch.column(c).to_pylist() for c in names)):
                if (lang, part) != now:
                    if now is not None:
                        yield batch_of(ended())
                    now, n = (lang, part), 0
                    own.clear()
                n += more or 0
                if blob is not None:
                    own.update(_unlisted(blob))
        if now is not None:
            yield batch_of(ended())

    return texts(docs).mapInArrow(found, kinds).repartition("lang", "part").sortWithinPartitions("lang", "part").mapInArrow(together, kinds)


def _stretches(docs: DataFrame, bits: np.ndarray, cells: int, parts: int, most: int) -> DataFrame:
    """(lang, part, payload): the stretches of texts in which a candidate of the part can stand."""
    held = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        press = zstandard.ZstdCompressor(level=6).compress
        for batch in batches:
            rows = []
            for lang, runs in _runs(batch):
                longest = runs.admitted(held.value, cells, most)
                at = np.flatnonzero(longest)
                if not len(at):
                    continue
                part = runs.part(parts)[at]
                order = np.argsort(part.astype(np.uint16 if parts <= 65536 else np.int64), kind="stable")
                at, part = at[order], part[order]
                far = len(longest) + 1
                reach = np.maximum.accumulate(at + longest[at] + part * far)  # how far the part's stretches go up to here
                first = np.flatnonzero(np.concatenate([[True], at[1:] + part[1:] * far >= reach[:-1]]))
                last = np.append(first[1:], len(at)) - 1
                of = part[first]
                begin, until = runs.start[at[first]].tolist(), runs.stop[reach[last] - of * far - 1].tolist()
                edges = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1], [True]])).tolist()
                text = runs.text
                rows += [(lang, int(of[a]), press(b" " + b" \n ".join([text[i:j] for i, j in zip(begin[a:b], until[a:b])]) + b" ")) for a, b in zip(edges, edges[1:])]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.binary()))], names=["lang", "part", "payload"])

    return texts(docs).mapInArrow(run, "lang string, part int, payload binary")


def _scanned(dealt: DataFrame) -> DataFrame:
    """(lang, phrase, f): matches of each phrase in the stretches that a task has for its part. Rows come sorted, a part's phrases before its stretches."""

    def run(batches: Iterator) -> Iterator:
        import ahocorasick
        import pyarrow as pa
        import zstandard

        press = zstandard.ZstdDecompressor().decompress
        state: dict = {"key": None}

        def begun(key) -> None:
            state.update(key=key, own=[], seen=Counter(), automaton=ahocorasick.Automaton(ahocorasick.STORE_INTS), ready=False)

        def ended():
            found = list(state["seen"].items())
            names = [state["own"][i] for i, _ in found]
            arrays = [pa.array([state["key"][0]] * len(found), pa.string()), pa.array(names, pa.string()), pa.array([n for _, n in found], pa.int64())]
            return pa.RecordBatch.from_arrays(arrays, names=["lang", "phrase", "f"])

        for batch in batches:
            for lang, part, salt, stretch, payload in zip(*(batch.column(c).to_pylist() for c in ("lang", "part", "salt", "stretch", "payload"))):
                if state["key"] != (lang, part, salt):
                    if state["key"] is not None:
                        yield ended()
                    begun((lang, part, salt))
                text = press(payload).decode("utf-8", "replace")
                if not stretch:
                    for phrase in text.split("\n"):
                        state["automaton"].add_word(f" {phrase} ", len(state["own"]))
                        state["own"].append(phrase)
                elif state["own"]:
                    if not state["ready"]:
                        state["automaton"].make_automaton()
                        state["ready"] = True
                    state["seen"].update(map(itemgetter(1), state["automaton"].iter(text)))
        if state["key"] is not None:
            yield ended()

    return dealt.mapInArrow(run, "lang string, phrase string, f long")


def counted(docs: DataFrame, most: int = WORDS, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, f) of every run of one to ``most`` words that occurs ``least`` times or more, and (lang, n) of all words."""
    cells = cell_count(docs, most)
    bits = sketched(docs, cells, most, min(least, 255))
    parts = 1 + int(np.bitwise_count(bits).sum()) // PART
    found = written(candidates(docs, bits, cells, parts, most), "phrase-candidates")
    salts = 1 + int((docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / parts / SCAN_BYTES)
    salt = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")
    lists = found.filter("part >= 0").select("lang", "part", salt, F.lit(False).alias("stretch"), "payload")
    text = _stretches(docs, bits, cells, parts, most).select("lang", "part", F.pmod(F.xxhash64("payload"), F.lit(salts)).cast("int").alias("salt"), F.lit(True).alias("stretch"), "payload")
    dealt = lists.unionByName(text).repartition("lang", "part", "salt").sortWithinPartitions("lang", "part", "salt", "stretch")
    f = _scanned(dealt).groupBy("lang", "phrase").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)
    return written(f, "phrase-counts"), found.filter("part < 0").select("lang", "n")


def _slices(words: str, size: int) -> Column:
    """Every run of ``size`` words of the array ``words``, which has more."""
    return F.transform(F.sequence(F.lit(1), F.size(words) - size + 1), lambda i: F.array_join(F.slice(words, i, F.lit(size)), " "))


def scored(counts: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) of each phrase of two words or more, by the cut with the lowest score."""
    words = F.split("phrase", " ", -1)
    one = counts.withColumn("w", words).filter(F.size("w") > 1)
    k = F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k")
    cuts = one.select("lang", "phrase", F.col("f").alias("a"), "w", k)
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("head"), F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("tail"))
    of = lambda name, as_: counts.select("lang", F.col("phrase").alias(name), F.col("f").alias(as_))
    both = cuts.join(of("head", "l"), ["lang", "head"]).join(of("tail", "r"), ["lang", "tail"])
    both = both.withColumn("score", F.expr("(CAST(2000000 AS DECIMAL(10,0)) * CAST(a AS DECIMAL(20,0))) div (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))"))
    best = both.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    return best.select("lang", "phrase", "a", "b.l", "b.r", "b.score")


def mined(docs: DataFrame, most: int = WORDS, least: int = LEAST, top: int = TOP, held: int = HELD) -> DataFrame:
    """The first ``top`` phrases of each language by score, occurrences and phrase: lang, rank, phrase, a, l, r, n, score."""
    counts, n = counted(docs, most, least)
    longer = counts.withColumn("w", F.split("phrase", " ", -1)).filter(F.size("w") > 2)
    inside = [longer.filter(F.size("w") > k).select("lang", "f", F.explode(_slices("w", k)).alias("phrase")) for k in range(2, max(3, most))]
    inside = reduce(DataFrame.unionByName, inside)
    holder = inside.groupBy("lang", "phrase").agg(F.max("f").alias("m"))
    free = scored(counts).join(holder, ["lang", "phrase"], "left")
    free = free.filter(F.expr(f"m IS NULL OR CAST(m AS DECIMAL(20,0)) * 100 < CAST(a AS DECIMAL(20,0)) * {held}"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = free.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    return best.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = r"""WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents WHERE text IS NOT NULL),
  p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM t),
  n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
  g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT lang, w, unnest([1, 2, 3, 4]) AS k FROM p))),
  f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY lang, k, phrase HAVING count(*) >= 30),
  c AS (SELECT lang, k AS size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
  parted AS (SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail FROM (SELECT *, unnest(range(1, size)) AS k FROM c)),
  cuts AS (SELECT p.lang, p.phrase, p.a, p.k, l.f AS l, r.f AS r, (2000000::HUGEINT * p.a) // (l.f::HUGEINT + r.f) AS score FROM parted AS p
    JOIN f AS l ON l.lang = p.lang AND l.phrase = p.head JOIN f AS r ON r.lang = p.lang AND r.phrase = p.tail),
  best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
  inside AS (SELECT lang, a AS f, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, a, w, k, unnest(range(1, size - k + 2)) AS i FROM (SELECT *, unnest([2, 3]) AS k FROM c) WHERE k < size)),
  m AS (SELECT lang, phrase, max(f) AS m FROM inside GROUP BY lang, phrase),
  kept AS (SELECT best.* FROM best LEFT JOIN m ON m.lang = best.lang AND m.phrase = best.phrase WHERE m.m IS NULL OR 100::HUGEINT * m.m < 80::HUGEINT * best.a),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT ranked.lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN n ON n.lang = ranked.lang WHERE rank <= 2000"""
