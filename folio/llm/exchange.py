"""Global shuffle of distinct words, with positions.

Documents are parsed in blocks. A block sends to each word bucket two packed
rows: its distinct words there, in order; and for each occurrence its position in
the block and its word. A bucket lets the second kind pass, holds the first
(packed) until all blocks' are there, works out one value for each distinct word
of the corpus, and sends each block the values in the block's order. A block then
puts its documents together again by position.

So a word crosses the network once for each block, not once for each
occurrence; no group is larger than a block or a bucket's share of the
vocabulary, and a very frequent word is one entry in a block. The rows are
zstd frames, of the order of 1.5 bytes for an occurrence. The number of buckets
follows the bytes of text, so that what a task reads does not grow with them.

The input has to give the same rows if a task is run again (a file scan or a
checkpoint): blocks are numbered by partition and order. A block whose parts do
not fit together is an error, never a wrong result.
"""

from __future__ import annotations

import struct
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

#: Bytes of text in a block; a longer document is a block of its own. A document without text counts as EACH bytes.
BLOCK_BYTES, EACH = 30 << 20, 64
#: Bytes of text for each word bucket, and most buckets.
BUCKET_BYTES, MOST_BUCKETS = 32 << 20, 4096

#: Stands for the block in a bucket's own rows.
SUMMARY = -1
ROW = "bucket int, block long, words binary, post binary, meta binary"
_ROW = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("words", pa.binary()), ("post", pa.binary()), ("meta", pa.binary())])


def pack(*parts: np.ndarray | bytes, level: int = 3) -> bytes:
    """Each part is a frame of its own: their statistics differ."""
    z = zstandard.ZstdCompressor(level=level, write_checksum=False)
    raw = [z.compress(x if isinstance(x, bytes) else np.ascontiguousarray(x).tobytes()) for x in parts]
    return struct.pack(f"<{len(raw) + 1}i", len(raw), *map(len, raw)) + b"".join(raw)


def unpack(data: bytes) -> list[bytes]:
    n = struct.unpack_from("<i", data)[0]
    z, at, out = zstandard.ZstdDecompressor(), 4 * (n + 1), []
    for size in struct.unpack_from(f"<{n}i", data, 4):
        out.append(z.decompress(data[at : at + size]))
        at += size
    return out


def narrow(a: np.ndarray) -> list[np.ndarray]:
    """Two planes: a byte each, and the rest of the few values of 128 or more, in two or four bytes each."""
    a = a.astype(np.uint32)
    big = a > 127
    rest = a[big] >> 7
    return [((a & 127) | (big.astype(np.uint32) << 7)).astype(np.uint8), short(rest)]


def short(a: np.ndarray) -> np.ndarray:
    return a.astype(np.uint16 if not len(a) or a.max() < 1 << 16 else np.uint32)


def long(raw: bytes, n: int) -> np.ndarray:
    """What short() made of n values."""
    return np.frombuffer(raw, np.uint16 if len(raw) == 2 * n else np.uint32)


def widen(low: bytes, high: bytes) -> np.ndarray:
    a = np.frombuffer(low, np.uint8).astype(np.int64)
    big = a > 127
    a[big] = (a[big] & 127) | (long(high, int(big.sum())).astype(np.int64) << 7)
    return a


def pack_words(words: list[bytes]) -> list[np.ndarray | bytes]:
    return [*narrow(np.fromiter(map(len, words), np.int64, len(words))), b"".join(words)]


def unpack_words(low: bytes, high: bytes, text: bytes) -> list[bytes]:
    ends = np.cumsum(widen(low, high)).tolist()
    return [text[a:b] for a, b in zip([0, *ends], ends)]


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indices of all runs (start, size), one after another."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()), dtype=np.int64)


class Documents(NamedTuple):
    """A block's documents: id (or None), the text each has, whether it is marked; and the number of words of each text."""

    ids: list[int | None]
    of: np.ndarray
    marks: np.ndarray
    sizes: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [np.array([x or 0 for x in self.ids], np.int64), np.array([x is not None for x in self.ids], np.uint8), self.of.astype(np.int32), self.marks.astype(np.uint8), self.sizes.astype(np.int32)]

    @classmethod
    def read(cls, parts: list[bytes]) -> Documents:
        ids, known, of, marks, sizes = (np.frombuffer(x, kind) for x, kind in zip(parts, (np.int64, np.uint8, np.int32, np.uint8, np.int32)))
        return cls([i if k else None for i, k in zip(ids.tolist(), known.tolist())], of.astype(np.int64), marks.astype(bool), sizes.astype(np.int64))


class _Block:
    """Texts of a block, equal ones once."""

    def __init__(self, weigh: bool):
        self.index: defaultdict = defaultdict()
        self.index.default_factory = self.index.__len__
        self.texts: dict[str, int] = {}
        self.ids: list[np.ndarray] = []
        self.docs: list[int | None] = []
        self.of: list[int] = []
        self.marks: list[bool] = []
        self.bytes = 0
        self.weigh = weigh

    def add(self, doc_id: int | None, text: str, split: Callable, mark: bool) -> None:
        if (k := self.texts.get(text)) is None:
            k = self.texts[text] = len(self.ids)
            words = split(text)
            self.ids.append(np.fromiter(map(self.index.__getitem__, words), np.int32, len(words)))
            self.bytes += len(text)
        self.bytes += EACH
        self.docs.append(doc_id)
        self.of.append(k)
        self.marks.append(mark)

    def rows(self, number: int, buckets: int, raw: Callable) -> Iterator[dict]:
        words = [raw(w) for w in self.index]
        sizes = np.array([len(x) for x in self.ids], np.int64)
        ids = np.concatenate(self.ids) if self.ids else np.zeros(0, np.int32)
        self.ids, self.index, self.texts = [], defaultdict(), {}
        where = np.fromiter((zlib.crc32(w) % buckets for w in words), np.uint16 if buckets < 1 << 16 else np.int32, len(words))
        # in a bucket frequent words first (small numbers), and those about as frequent by their letters (like next to like)
        often = np.frexp(np.bincount(ids, minlength=len(words)))[1].tolist() if words else []
        first = np.searchsorted(np.sort(where), np.arange(buckets + 1))
        ordered = np.argsort(where, kind="stable").tolist()
        for a, b in zip(first[:-1], first[1:]):
            ordered[a:b] = sorted(ordered[a:b], key=lambda i: (-often[i], words[i]))
        rank = np.empty(len(words), np.int64)
        rank[ordered] = np.arange(len(words))
        weights = None
        if self.weigh:
            times = np.bincount(np.array(self.of, np.int64), np.array(self.marks, np.float64), len(sizes))
            weights = np.bincount(ids, np.repeat(times, sizes), len(words)).astype(np.int64)
        of = where[ids]
        edge = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=buckets))])
        by = np.argsort(of, kind="stable").astype(np.int32)
        del of
        for b in range(buckets):
            if first[b] == first[b + 1]:
                continue
            pos, mine = by[edge[b] : edge[b + 1]], ordered[first[b] : first[b + 1]]
            more = [] if weights is None else narrow(weights[mine])
            yield {"bucket": b, "block": number, "words": pack(*pack_words([words[i] for i in mine]), *more, level=9), "post": None, "meta": None}
            yield {"bucket": b, "block": number, "words": None, "post": pack(*narrow(np.diff(pos, prepend=0)), *narrow(rank[ids[pos]] - first[b])), "meta": None}
        meta = pack(*Documents(self.docs, np.array(self.of), np.array(self.marks), sizes).parts())
        yield {"bucket": number % buckets, "block": number, "words": None, "post": None, "meta": meta}


def blocks(docs: DataFrame, split: Callable[[str], list], raw: Callable, buckets: int, mark: Callable | None = None) -> DataFrame:
    """docs (doc_id, text) as packed rows. split: a text's words; raw: a word's bytes; mark: doc_id to whether its words are weighed."""

    def run(batches):
        base, count = TaskContext.get().partitionId() << 24, 0
        block = _Block(mark is not None)

        def flush():
            nonlocal block, count
            number, full = base + count, block
            count, block = count + 1, _Block(mark is not None)
            yield from batched(full.rows(number, buckets, raw), _ROW)

        for batch in batches:
            texts = batch.column("text")
            for k, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                text = texts[k].as_py()
                block.add(doc_id, text, split, bool(mark and mark(doc_id)))
                if block.bytes >= BLOCK_BYTES:
                    yield from flush()
        if block.docs:
            yield from flush()

    return docs.select("doc_id", "text").mapInArrow(run, ROW)


def buckets_for(docs: DataFrame) -> int:
    """A number of word buckets that follows the bytes of text."""
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return min(MOST_BUCKETS, max(8, -(-size // BUCKET_BYTES)))


class Lists:
    """(words, weights or None) of each block, opened anew in each pass so that one block's are in memory at a time."""

    def __init__(self, frames: list[bytes]):
        self.frames = frames

    def __iter__(self) -> Iterator[tuple[list[bytes], np.ndarray | None]]:
        for frame in self.frames:
            parts = unpack(frame)
            yield unpack_words(*parts[:3]), widen(*parts[3:5]) if len(parts) > 3 else None


def batched(rows: Iterator[dict], schema: pa.Schema, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Rows of binary values in batches of about so many bytes."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += 64 + sum(len(x) for x in r.values() if isinstance(x, bytes))
        if size >= most:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def values(rows: DataFrame, value: Callable[[Lists], Iterator[list]], buckets: int) -> DataFrame:
    """A task for each bucket, and one call of value for each bucket: the word lists and weights of all blocks, to an iterator over what each block gets for its list (parts to be packed); what it gives further becomes rows of block SUMMARY. Other rows pass."""

    def answers(bucket: int, held: list[tuple[int, bytes]]) -> Iterator[dict]:
        got = value(Lists([w for _, w in held]))
        for (block, _), parts in zip(held, got):
            yield {"bucket": bucket, "block": block, "words": pack(*parts, level=9)}
        for parts in got:
            yield {"bucket": bucket, "block": SUMMARY, "meta": pack(*parts)}

    def run(batches):
        bucket, held = None, []
        for b in batches:
            mine = b.column("words").is_valid()
            others = b.filter(pc.invert(mine))
            if others.num_rows:
                yield others
            b = b.filter(mine)
            for at, block, words in zip(b.column("bucket").to_pylist(), b.column("block").to_pylist(), b.column("words").to_pylist()):
                if at != bucket and held:
                    yield from batched(answers(bucket, held), _ROW)
                    held = []
                bucket = at
                held.append((block, words))
        if held:
            yield from batched(answers(bucket, held), _ROW)

    return rows.repartitionById(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(run, ROW)


class Parts:
    """(bucket, positions, words, parts of values) of each bucket of a block, opened anew in each pass so that one is in memory at a time."""

    def __init__(self, rows: list[tuple[int, bytes, bytes]]):
        self.rows = rows

    def __iter__(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[bytes]]]:
        for bucket, words, post in self.rows:
            p = unpack(post)
            yield bucket, np.cumsum(widen(*p[:2])), widen(*p[2:4]), unpack(words)


def assemble(rows: DataFrame, whole: Callable, schema: str, tasks: int) -> DataFrame:
    """One call of whole for each block: its number, documents and Parts, to the result's columns. Positions run through the block's texts."""

    def run(table: pa.Table) -> pa.Table:
        docs, words, posts = None, {}, {}
        for r in table.select(["bucket", "words", "post", "meta"]).to_pylist():
            if r["meta"] is not None:
                docs = Documents.read(unpack(r["meta"]))
            else:
                where, what = (words, r["words"]) if r["post"] is None else (posts, r["post"])
                if r["bucket"] in where:
                    raise RuntimeError("a part of a block came twice: the input changed while it was read; cut its lineage")
                where[r["bucket"]] = what
        if docs is None or words.keys() != posts.keys():
            raise RuntimeError("a block lacks parts: the input changed while it was read; cut its lineage")
        return whole(table.column("block")[0].as_py(), docs, Parts([(k, words[k], posts[k]) for k in sorted(words)]))

    return rows.repartition(tasks, "block").groupBy("block").applyInArrow(run, schema)
