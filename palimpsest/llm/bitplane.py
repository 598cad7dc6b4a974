"""Token ids in files of compressed planes.

Documents go in ascending id order into ranges, one file a range. A file is a run of records, each ended by a line feed:
blocks, an index and a tail of 32 bytes. A block holds up to ``BLOCK`` ids, transposed so that the k-th bytes (or bits) of all
ids stand together; every plane is a zstandard frame of its own. The index lists where blocks begin, how many ids each has, and
the documents' ids and lengths; the tail says where the index is. A reader needs the tail and the index to reach any document.

    block: "BPB1", ids u32, kind u8 (8 byte planes, 1 bit planes), planes u8, length of each plane u32, planes
    index: zstandard frame of: counts of blocks and documents u64 x 2, block offsets u64, ids in blocks u32, document ids i64,
           1 for a null id u8, document lengths u64
    tail:  offset of the index u64, its length u64, number of the range u64, "BPFILE01"

Files are written and read by Spark (one text row a record, ``binaryFile``), so any store that Spark reaches will do. Ids come from
the tokenizers library, asked once for each distinct run between safe spaces (see ``bpe.cuts``). Null texts count as empty: their
one id is the end id; bytes that aren't UTF-8 become U+FFFD. Null ids come first, equal ids by text, repeated rows one after the
other. An empty table makes no file with documents. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import os
import struct
from array import array
from collections.abc import Iterator
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import cuts, default_vocabulary
from .common import RANGE_BYTES, batch_limits, range_of, scratch_path, sized_cuts, texts_of, written

BLOCK, END_ID, LEVEL = 1 << 16, 0, 3
TAIL = b"BPFILE01"
#: The letter that stands for a space in the names of byte-level tokens; chunks in a joined text.
SPACE_LETTER, JOINED = "\u0120", 200


def block(ids: bytes, bits: bool = False) -> bytes:
    """A block record of little-endian u32 ids."""
    import zstandard

    raw = np.frombuffer(ids, np.uint8).reshape(-1, 4)
    if bits:
        planes = [np.packbits(raw[:, k // 8] >> (k % 8) & 1, bitorder="little") for k in range(32)]
    else:
        planes = [np.ascontiguousarray(raw[:, k]) for k in range(4)]
    while planes and not planes[-1].any():
        planes.pop()
    z = zstandard.ZstdCompressor(level=LEVEL)
    frames = [z.compress(p.tobytes()) for p in planes]
    return b"BPB1" + struct.pack("<IBB", len(raw), 1 if bits else 8, len(frames)) + struct.pack(f"<{len(frames)}I", *map(len, frames)) + b"".join(frames)


def unblock(record: memoryview) -> np.ndarray:
    """The ids of a block record."""
    import zstandard

    n, kind, planes = struct.unpack_from("<IBB", record, 4)
    size = struct.unpack_from(f"<{planes}I", record, 10)
    out, at, z = np.zeros((n, 4), np.uint8), 10 + 4 * planes, zstandard.ZstdDecompressor()
    for k in range(planes):
        plane = np.frombuffer(z.decompress(record[at : at + size[k]]), np.uint8)
        if kind == 8:
            out[:, k] = plane
        else:
            out[:, k // 8] |= np.unpackbits(plane, count=n, bitorder="little") << (k % 8)
        at += size[k]
    return out.reshape(-1).view("<u4")


class Writer:
    """Records of one file, in order."""

    def __init__(self, number: int, bits: bool = False):
        self.number, self.bits = number, bits
        self.buffer = bytearray()
        self.offsets, self.sizes, self.ids, self.lengths, self.at = [], [], [], [], 0

    def _block(self, n: int) -> bytes:
        record = block(bytes(self.buffer[: 4 * n]), self.bits)
        del self.buffer[: 4 * n]
        self.offsets.append(self.at)
        self.sizes.append(n)
        self.at += len(record) + 1
        return record

    def add(self, doc_id: int | None, ids: bytes) -> Iterator[bytes]:
        self.ids.append(doc_id)
        self.lengths.append(len(ids) // 4)
        self.buffer += ids
        while len(self.buffer) >= 4 * BLOCK:
            yield self._block(BLOCK)

    def close(self) -> Iterator[bytes]:
        import zstandard

        if self.buffer:
            yield self._block(len(self.buffer) // 4)
        null = np.array([d is None for d in self.ids], np.uint8)
        parts = [np.array([len(self.offsets), len(self.ids)], "<u8"), np.array(self.offsets, "<u8"), np.array(self.sizes, "<u4"), np.array([d or 0 for d in self.ids], "<i8"), null, np.array(self.lengths, "<u8")]
        index = zstandard.ZstdCompressor(level=LEVEL).compress(b"".join(p.tobytes() for p in parts))
        yield index
        yield struct.pack("<QQQ", self.at, len(index), self.number) + TAIL


class Reader:
    """A file's documents, by place."""

    def __init__(self, content: bytes):
        import zstandard

        self.content = memoryview(content)
        at, size, self.number = struct.unpack_from("<QQQ", content, len(content) - 33)
        if content[-9:-1] != TAIL:
            raise ValueError("not a file of planes")
        raw = zstandard.ZstdDecompressor().decompress(self.content[at : at + size])
        blocks, docs = np.frombuffer(raw, "<u8", 2).astype(int)
        at = 16
        read = []
        for kind, n in (("<u8", blocks), ("<u4", blocks), ("<i8", docs), ("u1", docs), ("<u8", docs)):
            read.append(np.frombuffer(raw, kind, n, at))
            at += read[-1].nbytes
        self.offsets, self.sizes, self.ids, self.null, self.lengths = read
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.first = np.cumsum(self.sizes.astype(np.int64)) - self.sizes
        self.held: tuple[int, np.ndarray] = (-1, np.zeros(0, "<u4"))

    def _block(self, k: int) -> np.ndarray:
        if self.held[0] != k:
            self.held = (k, unblock(self.content[int(self.offsets[k]) :]))
        return self.held[1]

    def document(self, i: int) -> np.ndarray:
        """The ids of the i-th document."""
        start, stop, got = int(self.starts[i]), int(self.starts[i] + self.lengths[i]), []
        k = int(np.searchsorted(self.first, start, side="right")) - 1
        while start < stop:
            base = int(self.first[k])
            part = self._block(k)[start - base : stop - base]
            got.append(part)
            start, k = start + len(part), k + 1
        return np.concatenate(got) if got else np.zeros(0, "<u4")


class Ids:
    """Little-endian u32 ids of texts by the tokenizers library, asked once for each chunk that is remembered.

    Unknown chunks go to the library joined by single spaces, ``JOINED`` in a text: as a piece begins at each such space, the ids
    of a joined text are those of its chunks, and each chunk's first id is a token that begins with a space. If it has more such
    tokens than chunks, its chunks are asked for one by one.
    """

    def __init__(self, path: str, remember: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        self.t.no_truncation()
        self.t.no_padding()
        names = self.t.get_vocab()
        self.spaced = np.zeros(max(names.values()) + 1, bool)
        self.spaced[[i for name, i in names.items() if name.startswith(SPACE_LETTER)]] = True
        self.remember = remember
        self.seen: dict[str, bytes] = {}  # chunks without the space before them
        self.before: dict[str, bytes] = {}

    def _asked(self, texts: list[str]) -> Iterator[bytes]:
        for i in range(0, len(texts), 512):
            for e in self.t.encode_batch_fast(texts[i : i + 512], add_special_tokens=False):
                yield array("I", e.ids).tobytes()

    def _learn(self, chunks: list[str]) -> None:
        parts = [chunks[i : i + JOINED] for i in range(0, len(chunks), JOINED)]
        for part, raw in zip(parts, self._asked([" " + " ".join(p) for p in parts])):
            at = (4 * np.flatnonzero(self.spaced[np.frombuffer(raw, np.uint32)])).tolist()
            if len(at) == len(part):
                self.seen.update(zip(part, [raw[x:y] for x, y in zip(at, [*at[1:], len(raw)])]))
            else:  # some chunk has runs of spaces inside
                self.seen.update(zip(part, self._asked([" " + c for c in part])))

    def batch(self, texts: list[str]) -> list[bytes]:
        cut = [cuts(t) for t in texts]
        heads = list(self._asked([c.pop(0) for c in cut]))
        got = [list(map(self.seen.get, c)) for c in cut]
        missed = [[i for i, x in enumerate(g) if x is None] for g in got]
        new = {c[i] for c, m in zip(cut, missed) for i in m}
        if len(self.seen) + len(new) > self.remember:  # two generations: frequent chunks stay, memory is bounded
            self.before, self.seen = self.seen, {}
        if self.before:
            old = self.before.keys() & new
            self.seen.update(zip(old, map(self.before.__getitem__, old)))
            new -= old
        self._learn(list(new))
        look = self.seen.__getitem__
        for c, g, m in zip(cut, got, missed):
            for i in m:
                g[i] = look(c[i])
        return [head + b"".join(g) for head, g in zip(heads, got)]


_SOURCES: dict[str, Ids] = {}


def source(path: str) -> Ids:
    """One for each worker process, so that what it remembers serves its later tasks."""
    if path not in _SOURCES:
        _SOURCES[path] = Ids(path)
    return _SOURCES[path]


def write(docs: DataFrame, where: str, path: str | None = None, bits: bool = False) -> None:
    """Writes the ids of docs (doc_id, text), each with the end id, as files under ``where``."""
    path = path or default_vocabulary()
    cuts = sized_cuts(docs, "doc_id", "text", RANGE_BYTES)
    dealt = docs.select(range_of(F.col("doc_id"), cuts).alias("at"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    dealt = dealt.repartitionById(max(1, len(cuts)), "at").sortWithinPartitions("at", F.col("doc_id").asc_nulls_first(), "text")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encode, writer = source(path).batch, None
        end = np.array([END_ID], "<u4").tobytes()

        def out(records: list[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(records, pa.binary())], names=["record"])

        for batch in batches:
            coded = encode(texts_of(batch.column("text")))
            for at, doc_id, ids in zip(batch.column("at").to_pylist(), batch.column("doc_id").to_pylist(), coded):
                if writer is None:
                    writer = Writer(at, bits)
                for record in writer.add(doc_id, ids + end):
                    yield out([record])
        if writer is not None:
            yield out(list(writer.close()))

    dealt.mapInArrow(run, "record binary").select(F.col("record").cast("string")).write.option("maxRecordsPerFile", 0).text(where)


def read(spark, where: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files under ``where``."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for content in batch.column("content").to_pylist():
                f = Reader(content)
                sums = [crc32(f.document(i).tobytes()) for i in range(len(f.ids))]
                ids = pa.array(f.ids.astype(np.int64), mask=f.null.astype(bool))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sums), f.number, np.int64)), ids, pa.array(f.starts.astype(np.int64)), pa.array(f.lengths.astype(np.int64)), pa.array(sums, pa.int64())], names=["at", "doc_id", "inside", "n_tokens", "ids_crc32"])

    files = spark.read.format("binaryFile").load(where).filter("length > 0").select("content")
    with batch_limits(spark, rows=1):  # a file a batch
        rows = written(files.mapInArrow(run, "at long, doc_id long, inside long, n_tokens long, ids_crc32 long"), "planes-read")
    per = rows.groupBy("at").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    starts = per.select("at", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    return rows.join(starts, "at").select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """What read() finds in the files that write() makes of docs, in a new folder beside the session's other shared files."""
    where = scratch_path(docs.sparkSession, "planes")
    write(docs, where, path)
    return read(docs.sparkSession, where)
