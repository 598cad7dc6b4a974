"""Language-model scores of texts from a sharded Elias-Fano n-gram trie.

Counts cover every training text and every word; nothing is capped. Words are identified by XXH3-64 of their lower-cased bytes (two of a
billion words collide with a chance of 3 %). The trie holds every bigram and trigram, a start mark before each text included, that
occurs at least twice in training, so it grows with the corpus:

P(w | u v) = max(c(uvw) - D, 0) / c(uv) + left(uv) P(w | v), and likewise down to P(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)). D is DISCOUNT
for n-grams that the trie holds, and left() is what they leave of a context, so each distribution sums to 1 but for quantisation.

Texts are read in groups. A group sends its distinct n-grams, each with its count in training texts, to shards, and its texts as numbers to
one of them, which hands them on. A shard (TOKENS training tokens on average, so there are more of them as the corpus grows) adds the counts up, builds its own
trie, asks it for the n-grams that occur twice (it holds no others), and answers each group; the group puts the answers in the places of its tokens.
The most frequent words, NEAR at most, have their counts sent to all tasks. Their bigrams are dealt by both words, so no word is
one task; bigrams that begin with another word are dealt by that word, and its shard counts it as well. Trigrams follow their
first two words.

Null texts count as empty: one end token. With nothing to learn from, every probability is 1. Repeated rows are scored each and count
each. Null ids stay. Other columns are ignored, whatever their names; an empty table gives an empty result. One text is never split, so a
task holds its longest text's words.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import trie
from .common import fold, raw_texts, written

#: Words whose counts are sent to all tasks. It decides cost, not results.
NEAR = 1_000_000
#: Taken from the count of each n-gram that the trie holds.
DISCOUNT = 0.75
#: Training tokens a shard holds, on average.
TOKENS = 1_000_000
#: Numbers of the other words start here; near ones are numbered by falling count, and the start mark comes after them.
RARE = 1 << 62
END = b"\n"  # no word holds it
GROUP = 4_000_000


def word_hash(word: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word) - (1 << 63)


def _groups(batches: Iterator, size: int = GROUP) -> Iterator:
    """Lists of Arrow batches with about ``size`` bytes of text."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.column("text").nbytes
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def word_counts(docs: DataFrame) -> DataFrame:
    """(h, c): how often each word and the end token occur in docs."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def out(count: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([word_hash(w) for w in count], pa.int64()), pa.array(count.values(), pa.int64())], names=["h", "c"])

        count: Counter = Counter()
        for batch in batches:
            for t in raw_texts(batch.column("text")):
                count.update(t.lower().split())
                count[END] += 1
            if len(count) > 400_000:
                yield out(count)
                count = Counter()
        yield out(count)

    return docs.select("text").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


class Words:
    """Numbers of words in a sorted array of hashes; those of the last groups' words are remembered."""

    def __init__(self, hashes: np.ndarray, limit: int = 250_000):
        self.hashes, self.limit = hashes, limit
        self.slot: dict[bytes, int] = {}
        self.h, self.at = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def slots(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        """For each list of words their rows in ``h`` (hash) and ``at`` (number, -1 if not in the array)."""
        fresh = list(set().union(*texts).difference(self.slot))
        if len(self.slot) + len(fresh) > self.limit:
            self.slot, self.h, self.at = {}, self.h[:0], self.at[:0]
            fresh = list(set().union(*texts))
        h = np.fromiter(map(word_hash, fresh), np.int64, len(fresh))
        at = np.searchsorted(self.hashes, h)
        hit = at < len(self.hashes)
        hit[hit] = self.hashes[at[hit]] == h[hit]
        self.slot.update(zip(fresh, range(len(self.h), len(self.h) + len(fresh))))
        self.h, self.at = np.concatenate([self.h, h]), np.concatenate([self.at, np.where(hit, at, -1)])
        look = self.slot.__getitem__
        return [np.fromiter(map(look, t), np.int64, len(t)) for t in texts]


def tokens(text: bytes) -> list[bytes]:
    return [*text.lower().split(), END]


def _least(counts: DataFrame, most: int) -> int:
    """A count that no more than ``most`` rows reach, the least but for rounding to seven bits above 127."""
    coarse = F.expr("shiftleft(shiftright(c, greatest(length(bin(c)) - 7, 0)), greatest(length(bin(c)) - 7, 0))")
    spread = counts.groupBy(coarse.alias("c")).agg(F.count("*").alias("n")).toArrow().sort_by("c")  # 127 and 64 a power of two
    c, n = np.asarray(spread.column("c")), np.asarray(spread.column("n"))
    reach = np.cumsum(n[::-1])[::-1]
    return int(min(c[reach <= most], default=1 << 62))


def packed(*arrays: np.ndarray) -> bytes:
    """The arrays as byte planes, compressed."""
    import zstandard

    planes = (np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() if len(a) else b"" for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(np.array([len(a) for a in arrays], np.int64).tobytes() + b"".join(planes))


def unpacked(blob: bytes, kinds: str) -> list[np.ndarray]:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    types = [np.dtype(k) for k in kinds.split()]
    out, at = [], 8 * len(types)
    for n, t in zip(raw[:at].view(np.int64), types):
        size = int(n) * t.itemsize
        out.append(np.ascontiguousarray(raw[at : at + size].reshape(t.itemsize, int(n)).T).reshape(-1).view(t))
        at += size
    return out


#: What a group sends a shard (bigrams: both words, count; trigrams: bigram's place, word, count; other words, count; first words and
#: places as steps), what comes back (bigrams: probability, what their trigrams leave; trigrams: probability; words: count, what their bigrams leave), and what a group keeps.
ASKED, ANSWERED, KEPT = "i8 i8 i8 i4 i8 i8 i8 i8", "u2 u2 u2 i8 u2", "i8 u1 i8 i8 i4"


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    for shift, odd in ((31, 0x9E3779B97F4A7C15), (29, 0xD1B54A32D192ED03)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(odd)
    return x ^ (x >> np.uint64(32))


def _numbered(codes: np.ndarray, near: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes, ascending, and the place of each code among them; codes up to ``near`` need no sort."""
    small = codes <= near
    there = np.zeros(near + 1, bool)
    there[codes[small]] = True
    first = np.flatnonzero(there)
    rest, of_rest = np.unique(codes[~small], return_inverse=True)
    at = np.empty(len(codes), np.int64)
    at[small] = (np.cumsum(there) - 1)[codes[small]]
    at[~small] = len(first) + of_rest
    return np.concatenate([first, rest]), at


class Grams:
    """Distinct n-grams of a group's texts and the shard of each; ``codes`` ascend, ``at`` are their places for each token and mark."""

    def __init__(self, codes: np.ndarray, at: np.ndarray, mark: int, shards: int):
        n, size = len(at), max(1, len(codes))
        self.mark = codes[at] == mark
        second = np.flatnonzero(~self.mark)  # a mark comes first
        keys, self.of2 = np.unique(at[second - 1].astype(np.int64) * size + at[second], return_inverse=True)
        self.u, self.v = keys // size, keys % size
        self.second, self.pair = second, np.full(n, -1)
        self.pair[second] = self.of2
        self.third = second[~self.mark[second - 1]]
        keys, self.of3 = np.unique(self.pair[self.third - 1] * size + at[self.third], return_inverse=True)
        self.parent, self.w = keys // size, keys % size
        self.rare = np.flatnonzero(codes >= RARE)
        head = codes[self.u]
        both = _mix(_mix(head) + codes[self.v].astype(np.uint64))
        deal = lambda x: (x % np.uint64(shards)).astype(np.int64)
        at2 = deal(np.where(head >= RARE, _mix(head), both))
        self.order = [np.argsort(x, kind="stable") for x in (at2, at2[self.parent], deal(_mix(codes[self.rare])))]
        self.shards = [x[o] for x, o in zip((at2, at2[self.parent], deal(_mix(codes[self.rare]))), self.order)]
        self.place = np.zeros(len(at2), np.int64)
        self.place[self.order[0]] = np.arange(len(at2))

    def parts(self) -> Iterator:
        """(shard, slices of the orders of bigrams, trigrams and rare words) of each shard that has any."""
        for s in np.unique(np.concatenate(self.shards)):
            yield int(s), [slice(*np.searchsorted(x, [s, s + 1])) for x in self.shards]


def answered(blobs: list[bytes], near: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """A shard's work: the answers to the groups' blobs, and for near words (the last of ``near`` is the start mark) what the bigrams here take of their counts."""
    asked = [unpacked(b, ASKED) for b in blobs]
    for a in asked:
        a[0], a[3] = np.cumsum(a[0]), np.cumsum(a[3])
    ends = [np.cumsum([0, *(len(a[i]) for a in asked)]) for i in (0, 4, 6)]
    u, v, n2, parent, w, n3, rare, n1 = (np.concatenate(x) for x in zip(*(a[:3] + [a[3] + at] + a[4:] for a, at in zip(asked, ends[0]))))
    del asked
    words, at = _numbered(np.concatenate([u, v, w, rare]), len(near) - 1)
    u, v, w, rare = np.split(at, np.cumsum([len(u), len(v), len(w)]))
    size = max(1, len(words))
    two, of2 = np.unique(u * size + v, return_inverse=True)
    three, of3 = np.unique(of2[parent] * size + w, return_inverse=True)
    c1 = np.bincount(rare, n1, size).astype(np.int64)[: len(words)]
    known = words < RARE
    c1[known] = near[words[known]]
    c2, c3 = np.bincount(of2, n2, len(two)), np.bincount(of3, n3, len(three))
    kept = np.flatnonzero(c2 > 1)
    node = np.full(len(two), -1)
    node[kept] = np.arange(len(kept))
    kept3 = np.flatnonzero(c3 > 1)  # their first two words occur as often
    first, at3 = two[kept] // size, node[three[kept3] // size]
    taken = np.bincount(first, c2[kept] - DISCOUNT, size)[: len(words)]
    p3 = (c3[kept3] - DISCOUNT) / c2[kept][at3]
    arrays = {f"two.{k}": x for k, x in trie.level(len(words), first, two[kept] % size).items()}
    arrays |= {f"three.{k}": x for k, x in trie.level(len(kept), at3, three[kept3] % size).items()}
    arrays["two.p"] = trie.quantised((c2[kept] - DISCOUNT) / c1[first])
    arrays["two.left"] = trie.quantised(np.maximum(1 - np.bincount(at3, p3, len(kept)), 1e-9)[: len(kept)])
    arrays["three.p"] = trie.quantised(p3)
    whole = trie.mapped(arrays)
    level2, level3 = trie.Level(whole, "two"), trie.Level(whole, "three")
    p2, left2, p3 = np.zeros(len(two), np.uint16), np.full(len(two), trie.LEVELS + 1, np.uint16), np.zeros(len(three), np.uint16)
    found = np.full(len(two), -1)
    found[kept] = level2.find(two[kept] // size, two[kept] % size)
    p2[kept], left2[kept] = level2.p[found[kept]], level2.left[found[kept]]
    p3[kept3] = level3.p[level3.find(found[three[kept3] // size], three[kept3] % size)]
    left1 = trie.quantised(np.maximum(1 - taken / np.maximum(c1, 1), 1e-9))
    p2, left2, p3, count, left1 = p2[of2], left2[of2], p3[of3], c1[rare], left1[rare]
    cut = lambda k, i, *xs: [x[ends[i][k] : ends[i][k + 1]] for x in xs]
    out = [packed(*cut(k, 0, p2, left2), *cut(k, 1, p3), *cut(k, 2, count, left1)) for k in range(len(blobs))]
    took = np.flatnonzero(known & (taken > 0))
    return out, words[took], taken[took]


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every whole text."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", (fold(F.col("doc_id"), 5) == 1).alias("held_out"))
    counts = written(word_counts(docs.filter("not held_out")), "lm-words")
    sizes = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    total, scale = int(sizes["n"]), sizes["n"] + 0.5 * (sizes["v"] + 1)
    frequent = counts.filter(F.col("c") >= _least(counts, NEAR)).toArrow()  # NEAR rows at most
    h, c = np.asarray(frequent.column("h")), np.asarray(frequent.column("c"))
    first = np.lexsort((h, -c))
    number = np.empty(len(h), np.int64)
    number[first] = np.arange(len(h))
    by_hash = np.argsort(h)
    end = counts.filter(F.col("h") == word_hash(END)).first()
    mark = len(h)  # the start mark's number; it comes as often as the end
    near = np.concatenate([c[first], [end["c"] if end else 0]]).astype(np.int64)
    sent = spark.sparkContext.broadcast((h[by_hash], number[by_hash], near))  # 24 bytes for each of NEAR words at most
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // TOKENS))

    def ask(batches: Iterator) -> Iterator:
        import pyarrow as pa

        hashes, numbers, _ = sent.value
        words, task = Words(hashes), TaskContext.get().partitionId()
        for i, group in enumerate(_groups(batches)):
            slots = words.slots([tokens(t) for b in group for t in raw_texts(b.column("text"))])
            size = np.array([len(s) + 1 for s in slots])
            of_word = np.where(words.at >= 0, numbers[words.at] if mark else 0, RARE | (words.h & (RARE - 1)))
            flat = np.concatenate([x for s in slots for x in (np.array([-1]), s)])
            codes, at = _numbered(np.where(flat < 0, mark, of_word[flat]), mark)
            held = np.concatenate([np.asarray(b.column("held_out")) for b in group])
            learn = np.repeat(~held, size).astype(np.float64)
            ids = pa.concat_arrays([b.column("doc_id").cast(pa.int64()) for b in group])
            g = Grams(codes, at, mark, shards)
            n1 = np.bincount(at, learn, len(codes)).astype(np.int64)
            n2 = np.bincount(g.of2, learn[g.second], len(g.u)).astype(np.int64)
            n3 = np.bincount(g.of3, learn[g.third], len(g.w)).astype(np.int64)
            state = packed(np.asarray(ids.fill_null(0)), np.asarray(ids.is_null()).astype(np.uint8) + 2 * held.astype(np.uint8), size, codes, at.astype(np.int32))
            gid = task << 32 | i
            rows = [(-1 - gid % shards, state)]
            for s, (a, b, r) in g.parts():
                two, three, rare = g.order[0][a], g.order[1][b], g.rare[g.order[2][r]]
                under = (g.place[g.parent[three]] - a.start).astype(np.int32)
                rows.append((s, packed(np.diff(codes[g.u[two]], prepend=0), codes[g.v[two]], n2[two], np.diff(under, prepend=np.int32(0)), codes[g.w[three]], n3[three], codes[rare], n1[rare])))
            for k in range(0, len(rows), 256):
                part = rows[k : k + 256]
                yield pa.RecordBatch.from_arrays([pa.array([gid] * len(part), pa.int64()), pa.array([s for s, _ in part], pa.int32()), pa.array([x for _, x in part], pa.binary())], names=["gid", "shard", "body"])

    def answer(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        of: dict[int, list] = {}
        for b in batches:
            texts = b.filter(pc.less(b.column("shard"), 0))
            n = texts.num_rows
            yield pa.RecordBatch.from_arrays([texts.column("gid"), texts.column("shard"), texts.column("body"), pa.nulls(n, pa.int64()), pa.nulls(n, pa.float64())], names=["gid", "shard", "body", "word", "taken"])
            for gid, s, body in zip(*(b.column(x).to_pylist() for x in ("gid", "shard", "body"))):
                if s >= 0:
                    of.setdefault(s, []).append((gid, body))
        for s, rows in of.items():  # one shard a task
            got, word, taken = answered([body for _, body in rows], sent.value[2])
            for k in range(0, len(got), 256):
                n = len(got[k : k + 256])
                yield pa.RecordBatch.from_arrays([pa.array([gid for gid, _ in rows[k : k + n]], pa.int64()), pa.array([s] * n, pa.int32()), pa.array(got[k : k + n], pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.float64())], names=["gid", "shard", "body", "word", "taken"])
            for k in range(0, len(word), 100_000):
                n = len(word[k : k + 100_000])
                yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.array(word[k : k + n]), pa.array(taken[k : k + n])], names=["gid", "shard", "body", "word", "taken"])

    asked = docs.mapInArrow(ask, "gid long, shard int, body binary").repartitionById(shards, F.expr("if(shard < 0, -1 - shard, shard)"))
    answers = written(asked.mapInArrow(answer, "gid long, shard int, body binary, word long, taken double"), "lm-answers")
    took = answers.filter("word is not null").groupBy("word").agg(F.sum("taken").alias("taken")).toArrow()  # near words only
    left = np.ones(len(near))
    word = np.asarray(took.column("word"))
    left[word] = np.maximum(1 - np.asarray(took.column("taken")) / near[word], 1e-9)
    sent_left = spark.sparkContext.broadcast(left)

    def score(state: bytes, parts: dict[int, bytes]) -> tuple:
        ids, flags, size, codes, at = unpacked(state, KEPT)
        g = Grams(codes, at, mark, shards)
        p2, left2, p3 = np.empty(len(g.u)), np.empty(len(g.u)), np.empty(len(g.w))
        inside = codes < RARE
        count, left1 = np.zeros(len(codes), np.int64), np.ones(len(codes))
        count[inside], left1[inside] = sent.value[2][codes[inside]], sent_left.value[codes[inside]]
        for s, (a, b, r) in g.parts():
            x2, l2, x3, c1, l1 = unpacked(parts[s], ANSWERED)
            p2[g.order[0][a]], left2[g.order[0][a]], p3[g.order[1][b]] = trie.restored(x2), trie.restored(l2), trie.restored(x3)
            rare = g.rare[g.order[2][r]]
            count[rare], left1[rare] = c1, trie.restored(l1)
        one = (count + 0.5) / scale
        p = p2 + left1[g.u] * one[g.v]  # of the second word of each bigram
        full = np.ones(len(at))
        full[g.second] = p[g.of2]
        before = g.pair[g.third - 1]
        full[g.third] = p3[g.of3] + left2[before] * full[g.third]
        starts = np.cumsum(size) - size
        real = ~g.mark
        add = lambda x: np.add.reduceat(np.where(real, x, 0), starts)
        return ids, flags & 1 == 1, flags & 2 == 2, size - 1, add(count[at] > 0), add(np.log10(one)[at]), add(np.log10(full))

    def combine(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def out(state: bytes, parts: dict) -> pa.RecordBatch:
            ids, none, held, n, known, base, full = score(state, parts)
            columns = [pa.array(ids, mask=none), pa.array(held), pa.array(n), pa.array(known.astype(np.int64)), pa.array(base), pa.array(full)]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

        state, parts = None, {}
        for b in batches:  # each group's texts, then its answers
            for s, body in zip(b.column("shard").to_pylist(), b.column("body").to_pylist()):
                if s < 0:
                    if state is not None:
                        yield out(state, parts)
                    state, parts = body, {}
                else:
                    parts[s] = body
        if state is not None:
            yield out(state, parts)

    dealt = answers.filter("gid is not null").select("gid", "shard", "body").repartition(shards, "gid").sortWithinPartitions("gid", "shard")
    out = dealt.mapInArrow(combine, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
