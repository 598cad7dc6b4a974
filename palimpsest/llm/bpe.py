"""BPE encoding and decoding by prefix-sharing trie traversal.

The encoding of every prefix of a word ends in one token, its *last token*: the only vocabulary token ``t`` that ends there
and is compatible with the last token of the prefix before ``t``. So a word's encoding follows from the last tokens of its
prefixes. Distinct words go into a trie; a depth-first walk computes each node's last token once, from its ancestors' only,
and words that share a prefix share that work. Two tokens are compatible if merging their joined bytes yields just the two.

The pre-tokenizer is the byte-level one: a text is cut into contractions, letters, digits, other signs (each with a leading
space, if any) and white space. A single space between two non-spaces always starts a new piece, so texts are cut there
first and each distinct chunk is encoded once per worker and remembered.

Null texts count as empty; empty texts have no ids and decode to the empty text. Any length of text works: memory grows with
the chunks of one text and a bounded cache. The string of a special token inside a text yields its id, as in the library. Bytes that
aren't UTF-8 become U+FFFD. Repeated rows are encoded each; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import regex
from pyspark.sql import DataFrame

from .common import Cached, freed, texts_of

#: Fixed value: the public byte-level pre-tokenizer's pattern.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
DOUBLE_SPACE = re.compile(r"\s\s|[\x1c-\x1f]")
#: White space but the space itself: to look for each is faster than any pattern.
WHITE = [c for c in map(chr, range(0x3001)) if c != " " and re.match(r"[\s\x1c-\x1f]", c)]
SAFE_SPACE = regex.compile(r"(?<=[^\s\x1c-\x1f]) (?=[^\s\x1c-\x1f])")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for letters from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    letters.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))})
    return letters


class Vocabulary:
    """Token bytes, ids and merges of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        model = spec["model"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        named = {k: i for k, i in model["vocab"].items() if k not in self.special}
        self.id_of = {bytes(letters[c] for c in k): i for k, i in named.items()}
        self.bytes_of = {i: k for k, i in self.id_of.items()} | {i: k.encode() for k, i in self.special.items()}
        self.merge_of: dict[tuple[int, int], tuple[int, int]] = {}  # pair -> rank, merged id
        self.parts_of: dict[int, tuple[int, int, int]] = {}  # id -> rank, left, right
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            left, right = named[a], named[b]
            whole = named[a + b]
            self.merge_of.setdefault((left, right), (rank, whole))
            self.parts_of.setdefault(whole, (rank, left, right))
        lengths: dict[bytes, set[int]] = {}
        for k in self.id_of:
            if len(k) > 2:
                lengths.setdefault(k[-3:], {1, 2}).add(len(k))
        self.lengths = {k: tuple(sorted(n, reverse=True)) for k, n in lengths.items()}  # of the tokens that end in three bytes
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def merged(self, ids: list[int]) -> list[int]:
        """Plain merging of a short id list, lowest rank first, leftmost first: the definition that compatible() rests on."""
        ids = list(ids)
        while len(ids) > 1:
            rank, at, whole = min(((*self.merge_of[p][:1], i, self.merge_of[p][1]) for i, p in enumerate(zip(ids, ids[1:])) if p in self.merge_of), default=(None, 0, 0))
            if rank is None:
                break
            ids[at : at + 2] = [whole]
        return ids

    def compatible(self, left: int, right: int) -> bool:
        """Whether no merge across the seam of two adjacent tokens would come before the merges that formed them.

        Undo the later of the two tokens' last merges again and again; at each step the two tokens at the seam must not have
        a merge that ranks before the merge undone last.
        """
        never = 1 << 60
        undone, from_left = never, False
        parts, merges = self.parts_of, self.merge_of
        a, b = left, right
        while True:
            hit = merges.get((a, b))
            # the merge at the seam wins against one undone later in rank, or, at equal rank, when it stands further left
            if hit is not None and (hit[0] < undone or (hit[0] == undone and not from_left)):
                return False
            ra, rb = parts.get(a, (-1, 0, 0))[0], parts.get(b, (-1, 0, 0))[0]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                undone, from_left, a = ra, True, parts[a][2]
            else:
                undone, from_left, b = rb, False, parts[b][1]


class Trie:
    """Encodes sets of byte words; last tokens of shared prefixes are computed once."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.good = PairMemo(vocabulary)
        self.wholes: dict[int, bool] = {}

    def encode(self, words: set[bytes]) -> dict[bytes, bytes]:
        """Each word's ids (little-endian u32), depth-first over the trie of words.

        Sorted order visits the trie so; the current path is a stack of last tokens and their lengths.
        """
        out: dict[bytes, bytes] = {}
        id_of, lengths, good = self.v.id_of.get, self.v.lengths.get, self.good
        ids: list[int] = [-1]
        back: list[int] = [0]
        path = b""
        for word in sorted(words):
            n = len(word)
            shared, most = 0, min(n, len(path))
            while shared < most and word[shared] == path[shared]:
                shared += 1
            del ids[shared + 1 :], back[shared + 1 :]
            for end in range(shared + 1, n + 1):
                for length in lengths(word[end - 3 : end], (2, 1)) if end > 2 else (2, 1):  # only as long as a token with this end is
                    start = end - length
                    if start < 0:
                        continue
                    token = id_of(word[start:end])
                    if token is not None and (good[ids[start] << 20 | token] if start else self.whole(token)):
                        break
                else:
                    raise ValueError("a byte is not in the vocabulary")
                ids.append(token)
                back.append(length)
            path = word
            found, end = [], n
            while end:
                found.append(ids[end])
                end -= back[end]
            out[word] = array("I", found[::-1]).tobytes()
        return out

    def whole(self, token: int) -> bool:
        """Whether merging the token's own bytes yields the token."""
        if token not in self.wholes:
            self.wholes[token] = self.v.merged([self.v.id_of[bytes([b])] for b in self.v.bytes_of[token]]) == [token]
        return self.wholes[token]


class PairMemo(Cached):
    def __init__(self, vocabulary: Vocabulary):
        super().__init__(lambda p: vocabulary.compatible(p >> 20, p & 0xFFFFF), 200_000)


def doubled(text: str) -> bool:
    """Whether DOUBLE_SPACE is in the text."""
    here = [" ", *filter(text.__contains__, WHITE)]
    if len(here) > 4 or any("\x1c" <= c <= "\x1f" for c in here):
        return DOUBLE_SPACE.search(text) is not None
    return any(a + b in text for a in here for b in here)


def cuts(text: str) -> list[str]:
    """The text cut at each single space between two non-spaces, where a pre-tokenizer piece begins; the spaces are left out."""
    return SAFE_SPACE.split(text) if doubled(text) else text.split(" ")


def chunks(text: str) -> list[str]:
    """cuts() with the space that each but the first begins with."""
    cut = cuts(text)
    return [cut[0], *(" " + c for c in cut[1:])] if cut[0] else [" " + c for c in cut[1:]]


class Encoder:
    """Chunks -> ids through the trie, with remembered chunks and pieces."""

    def __init__(self, path: str, remember: int = 250_000):
        self.v = Vocabulary(path)
        self.trie = Trie(self.v)
        self.chunks = Cached(lambda c: None, remember)
        self.words = Cached(lambda w: None, remember)

    def pieces(self, chunk: str, marked: bool = True) -> list[bytes | int]:
        """The pieces of a chunk, with the ids of special tokens where it may be ``marked`` by any."""
        if marked and self.v.cut is not None and any(s in chunk for s in self.v.special):
            parts = [x for x in self.v.cut.split(chunk) if x]
            return [y for x in parts for y in ([self.v.special[x]] if x in self.v.special else [p.encode() for p in PIECES.findall(x)])]
        if chunk.isascii() and chunk[1:].isalpha() and (chunk[:1] == " " or chunk[:1].isalpha()):
            return [chunk.encode()]
        return [p.encode() for p in PIECES.findall(chunk)]

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        cut = [cuts(t) for t in texts]
        for c in cut:
            c[0] = " " + c[0]  # others never begin with a space: their own is left out, so that no text is copied chunk by chunk
        entries, fresh = self.chunks.fresh(set().union(*cut))
        marked = any(s in t for s in self.v.special for t in texts)
        split = {c: self.pieces(c[1:] if c[:1] == " " else " " + c, marked) for c in fresh}
        coded, unseen = self.words.fresh({p for ps in split.values() for p in ps if isinstance(p, bytes)})
        found = self.trie.encode(unseen)
        self.words.learn(found)
        coded.update(found)
        made = {}
        for c, ps in split.items():
            made[c] = coded[ps[0]] if len(ps) == 1 and isinstance(ps[0], bytes) else b"".join([array("I", [p]).tobytes() if isinstance(p, int) else coded[p] for p in ps])
        self.chunks.learn(made)
        entries.update(made)
        look = entries.__getitem__
        return [np.frombuffer(b"".join(map(look, c)), np.uint32) for c in cut]


def decode(ids: list[int], table: dict[int, bytes]) -> str:
    """Text of the tokens' joined bytes; bytes that aren't UTF-8 become U+FFFD."""
    return b"".join(map(table.__getitem__, ids)).decode("utf-8", "replace")


def grouped(batches: Iterator, column: str, size: int) -> Iterator:
    """Arrow batches joined until ``column`` holds about ``size`` bytes: the more distinct words at once, the more prefixes they share."""
    import pyarrow as pa

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.column(column).nbytes
        if n >= size:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0] if len(held) > 1 else batch
            held, n = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, remember: int) -> Encoder:
    """One encoder for each worker process; a task that asks for another one drops the last."""
    if (path, remember) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path, remember] = Encoder(path, remember)
    return _ENCODERS[path, remember]


def forget() -> None:
    """Drops the process's encoder."""
    _ENCODERS.clear()


def with_encoding(docs: DataFrame, path: str | None = None, text: str = "text", remember: int = 100_000) -> DataFrame:
    """docs with ``ids`` array<int> and ``decoded`` string, which take the place of columns that have these names (in any case)."""
    path = path or default_vocabulary()
    from pyspark.sql import types as T

    own = [f for f in docs.schema.fields if f.name.lower() not in ("ids", "decoded")]
    kept = [f.name for f in own]
    schema = T.StructType([*own, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        try:
            enc = encoder(path, remember)
            for batch in grouped(batches, text, 15 * remember):
                coded = enc.encode_batch(texts_of(batch.column(text)))
                decoded = pa.array([decode(ids.tolist(), enc.v.bytes_of) for ids in coded], pa.string())
                ends = np.cumsum([0, *map(len, coded)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(coded).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), ids, decoded], names=[*kept, "ids", "decoded"])
        finally:
            forget()  # a worker lives on, and would hold it beside all later stages

    return docs.select(*kept).mapInArrow(freed(run), schema)


def digests(docs: DataFrame, path: str | None = None, remember: int = 250_000) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by commas) and decoded_sha256 of every whole text."""
    path = path or default_vocabulary()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        enc = encoder(path, remember)
        named = {i: b"%d" % i for i in enc.v.bytes_of}.__getitem__
        for batch in grouped(batches, "text", 15 * remember):
            count, shas, back = [], [], []
            for doc in enc.encode_batch(texts_of(batch.column("text"))):
                ids = doc.tolist()
                count.append(len(ids))
                shas.append(hashlib.sha256(b",".join(map(named, ids))).hexdigest())
                back.append(hashlib.sha256(decode(ids, enc.v.bytes_of).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(count, pa.int64()), pa.array(shas, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
