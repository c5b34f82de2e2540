"""SimHash near-duplicates by bit-sliced comparison.

A text's fingerprint has a bit set where over half of its shingles' hashes have
it. Fingerprints at most three bits apart agree wholly in at least three of six
blocks of bits, so each distinct fingerprint goes to the 20 buckets of its
triples of blocks: no link is lost, and a bucket's key has about 32 bits.

In a bucket fingerprints are stored as bit planes, 64 to a word. Differences
with many others are counted plane by plane in carry-save counters (ones, twos,
and a flag for four or more), and words in which all are beyond the radius are
abandoned. Small buckets are compared pair by pair in the same way, many buckets
at once. A large bucket is searched breadth first among those not yet reached,
so that a dense group of n costs about n comparisons and gives n - 1 links.
Exact copies meet before all this, by an aggregation.

A text without words has fingerprint zero and is linked like any other. Nulls
are empty texts. A row with a null id gets its fingerprint and the component of
equal fingerprints that have ids, else none. Repeated rows stay repeated.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import cache
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import cut, plain, read, scratch, tune
from .components import components

SHINGLE, SEED, RADIUS = 3, 42, 3
#: First bit and size of the six blocks, and the triples that must agree.
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
TRIPLES = tuple(combinations(range(6), 3))
#: Buckets of up to so many are compared pair by pair.
SMALL = 48
#: Pairs compared at once.
PAIRS = 1 << 18
#: Bands whose buckets are compared before all others.
EARLY = 3
#: Shingles of the texts that a task compares, about, and what each text counts besides.
TASK, ROW = 1 << 20, 256
#: Rows gathered before their buckets are compared.
HELD = 1 << 16
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Unsigned 64 bits."""
    words = text.encode().lower().split()  # of bytes: A-Z only, and ASCII blanks only
    if not words:
        return 0
    runs = map(b" ".join, zip(*(words[k:] for k in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    n = max(1, len(words) - shingle + 1)
    h = np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(SEED)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 14):
        ones += np.unpackbits(h[k : k + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """docs (doc_id, text) to (doc_id, fp long: the 64 bits, signed)."""
    tune(docs.sparkSession)

    def run(batches):
        for b in batches:
            texts = b.column("text")
            fp = np.fromiter((fingerprint(texts[k].as_py(), shingle) for k in range(b.num_rows)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "fp": fp.view(np.int64)})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def planes(fps: np.ndarray) -> np.ndarray:
    """(bits, words): plane b holds bit b of all fingerprints (n, 64-bit words), 64 to a word; the last word is filled with zeros."""
    fps = np.concatenate([fps, np.zeros((-len(fps) % 64, fps.shape[1]), np.uint64)])
    bits = np.unpackbits(fps.view(np.uint8).reshape(len(fps), 8 * fps.shape[1]), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def _beyond(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Flags of counts over the radius, counters being the bits of the counts, lowest first."""
    over, same = np.zeros_like(counters[0]), np.full_like(counters[0], ALL)
    for k in range(len(counters) - 1, -1, -1):
        if radius >> k & 1:
            same &= counters[k]
        else:
            over |= same & counters[k]
            same &= ~counters[k]
    return over


def within(plane: Callable, bits: int, radius: int, shape: tuple, live: np.ndarray | None = None, tight: tuple[int, np.ndarray] | None = None) -> np.ndarray:
    """Words of flags for at most radius differing bits. plane(b, keep): plane b of the differences in the words kept (all: None); live: flags that still matter; tight: a lesser radius and flags of where it holds.

    The counts are kept as bits in carry-save counters, one word for 64 counts; what
    runs over the highest bit is far. Every 16 bits words that are all far are left out.
    """
    counters = [np.zeros(shape, np.uint64) for _ in range(max(1, radius.bit_length()))]
    far = np.zeros(shape, np.uint64) if live is None else ~live
    done, keep = np.zeros(shape, np.uint64), None
    for b in range(bits):
        carry = plane(b, keep)
        for k, c in enumerate(counters):
            carry, counters[k] = c & carry, c ^ carry
        far = far | carry
        if b % 16 == 15 and b < bits - 1:
            gone = far | _beyond(counters, radius) if b % 64 == 63 else far
            open_ = ~(gone == ALL).all(axis=tuple(range(gone.ndim - 1)))
            if not open_.any():
                return done
            if open_.sum() < 0.8 * len(open_):
                keep = np.flatnonzero(open_) if keep is None else keep[open_]
                counters, far = [c[..., open_] for c in counters], far[..., open_]
    near = ~(far | _beyond(counters, radius))
    if tight is not None:
        near &= ~(_beyond(counters, tight[0]) & (tight[1] if keep is None else tight[1][..., keep]))
    if keep is None:
        return near
    done[..., keep] = near
    return done


def packed(flags: np.ndarray) -> np.ndarray:
    """Flags as words of 64, along the last axis; the last word is filled with zeros."""
    full = np.zeros((*flags.shape[:-1], flags.shape[-1] + -flags.shape[-1] % 64), bool)
    full[..., : flags.shape[-1]] = flags
    return np.packbits(full, axis=-1, bitorder="little").view(np.uint64)


def near_pairs(a: np.ndarray, b: np.ndarray, radius: int = RADIUS, tight: tuple[int, np.ndarray] | None = None) -> np.ndarray:
    """Which fingerprints of a and b, pair by pair, are linked; tight: a lesser radius and the pairs for which it holds."""
    p = planes(a ^ b)
    flags = within(lambda k, keep: p[k] if keep is None else p[k][keep], len(p), radius, (p.shape[1],), tight=tight and (tight[0], packed(tight[1])))
    return np.unpackbits(flags.view(np.uint8), bitorder="little")[: len(a)].astype(bool)


def near_rows(p: np.ndarray, fps: np.ndarray, now: np.ndarray, words: np.ndarray, radius: int, live: np.ndarray, tight: tuple[int, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are linked with the rows now, as two arrays: places in now, rows. p: planes of fps; words: those of the planes that are looked at; live, tight: as in within, for these words."""
    mine = p[:, words]
    asked = np.where(np.unpackbits(fps[now].view(np.uint8).reshape(len(now), -1), axis=1, bitorder="little").astype(bool), ALL, np.uint64(0))
    flags = within(lambda k, keep: (mine[k] if keep is None else mine[k][keep])[None, :] ^ asked[:, k, None], len(p), radius, (len(now), len(words)), live, tight)
    hit = np.unpackbits(np.ascontiguousarray(flags).view(np.uint8), axis=1, bitorder="little")
    rows, cols = np.nonzero(hit)
    return rows, words[cols // 64] * 64 + cols % 64


def spread(fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the components of a bucket, as two arrays of indices."""
    n, p = len(fps), planes(fps)
    live = np.zeros(p.shape[1] * 64, np.uint8)
    live[:n] = 1
    at, to, queue, start = [], [], [], 0
    while True:
        if not queue:
            while start < n and not live[start]:
                start += 1
            if start == n:
                break
            live[start] = 0
            queue.append(start)
        now, queue = np.array(queue[:64]), queue[64:]
        left = np.packbits(live, bitorder="little").view(np.uint64)
        words = np.flatnonzero(left)
        if not len(words):
            break
        rows, cols = near_rows(p, fps, now, words, radius, np.broadcast_to(left[words], (len(now), len(words))))
        cols, first = np.unique(cols, return_index=True)
        live[cols] = 0
        at.append(now[rows[first]])
        to.append(cols)
        queue += cols.tolist()
    return (np.concatenate(at), np.concatenate(to)) if at else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def block_key(fp: Column, triple: int) -> Column:
    key = F.lit(triple).cast("long")
    for k in TRIPLES[triple]:
        first, size = BLOCKS[k]
        key = F.shiftleft(key, size).bitwiseOR(F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << size) - 1).cast("long")))
    return key


def _links(key: np.ndarray, fp: np.ndarray, node: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Links (two arrays of nodes, distances) in whole buckets, sorted by key: all within the radius in small ones; in large ones a spanning set of those, their distances left at 0."""
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    start, size = edge[:-1], np.diff(edge)
    for n in np.unique(size[(size > 1) & (size <= SMALL)]).tolist():
        i, j = np.triu_indices(n, 1)
        runs = start[size == n]
        step = max(1, PAIRS // (len(i) * fp.shape[1]))
        for k in range(0, len(runs), step):
            a, b = (runs[k : k + step, None] + i).ravel(), (runs[k : k + step, None] + j).ravel()
            hit = near_pairs(fp[a], fp[b], radius)
            a, b = a[hit], b[hit]
            yield node[a], node[b], np.bitwise_count(fp[a] ^ fp[b]).sum(axis=1).astype(np.int64)
    for s, n in zip(start[size > SMALL].tolist(), size[size > SMALL].tolist()):
        a, b = spread(fp[s : s + n], radius)
        yield node[s + a], node[s + b], np.zeros(len(a), np.int64)


def whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of batches sorted by key, their first, in parts of whole buckets; fp as 64-bit words, bands as 32-bit ones."""
    held: list[list[np.ndarray]] = []
    rows = 0
    for b in batches:
        if not b.num_rows:
            continue
        cols = []
        for name, c in zip(b.schema.names, b.columns):
            c = np.frombuffer(b"".join(c.to_pylist()), np.uint8) if pa.types.is_binary(c.type) else c.to_numpy(zero_copy_only=False)
            cols.append(c.view(np.uint64).reshape(b.num_rows, -1) if name == "fp" else c.view(np.uint32).reshape(b.num_rows, -1) if name == "bands" else c)
        held.append(cols)
        rows += b.num_rows
        if rows < HELD or held[0][0][0] == cols[0][-1]:  # few yet, or one bucket that has not ended
            continue
        cols = [np.concatenate(x) for x in zip(*held)]
        last = np.searchsorted(cols[0], cols[0][-1])
        yield [x[:last] for x in cols]
        held, rows = [[x[last:] for x in cols]], len(cols[0]) - int(last)
    if held:
        yield [np.concatenate(x) for x in zip(*held)]


def bucket_links(keyed: DataFrame, radius: int) -> DataFrame:
    """keyed (key, node, fp long) to links (u, v), see _links."""
    tune(keyed.sparkSession)

    def run(batches):
        for key, fp, node in whole_buckets(batches):
            got = list(_links(key, fp, node, radius))
            if got:
                u, v, _ = (np.concatenate(x) for x in zip(*got))
                pairs = np.unique(np.stack([np.maximum(u, v), np.minimum(u, v)]), axis=1)
                yield pa.RecordBatch.from_pydict({"u": pairs[0], "v": pairs[1]})

    return keyed.select("key", "fp", "node").repartition("key").sortWithinPartitions("key").mapInArrow(run, "u long, v long")


def links(nodes: DataFrame) -> DataFrame:
    """nodes (fp, node), fingerprints distinct, to links (u, v) whose components are those of all pairs within the radius."""
    return bucket_links(nodes.select("fp", "node", F.explode(F.array(*[block_key(F.col("fp"), k) for k in range(len(TRIPLES))])).alias("key")), RADIUS)


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id) of every row of docs."""
    prints = cut(fingerprints(plain(docs, id_col, text_col), shingle))
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("node")).where("node is not null")
    nodes = cut(nodes)
    found = components(links(nodes))
    labels = nodes.join(found, F.col("node") == F.col("u"), "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return prints.join(labels, "fp", "left").select("doc_id", "fp", "component_id")


@cache
def _most_apart(similarity: float, few: int) -> float:
    """The largest chance that a bit differs in the fingerprints of two sets at least so similar, one of less than few shingles."""
    most = 0.0
    for c in range(1, few):  # shingles that both have; one set has a more, the other b
        x = np.arange(c + 1)
        held = np.array([math.comb(c, k) / 2**c for k in x])

        def one(more: int) -> np.ndarray:
            """The chance of a one in a set of that many more, by the ones among what both have."""
            least = np.clip((c + more) // 2 + 1 - x, 0, more + 1)
            return np.array([sum(math.comb(more, k) for k in range(at, more + 1)) / 2**more for at in least])

        for a in range(few - c):
            if c < similarity * (c + 2 * a):
                break
            p, b = one(a), a
            while c >= similarity * (c + a + b):
                q = one(b)
                most = max(most, float((held * (p * (1 - q) + q * (1 - p))).sum()))
                b += 1
    return most


class Wide:
    """Fingerprints for similarities that 64 bits within three cannot tell: BITS bits of the set of shingles, and the keys of BANDS bands of ROWS minimal hashes."""

    BITS, BANDS, ROWS = 512, 25, 4
    #: Below so many shingles in one of them two sets have a wider limit, for ties tell them further apart.
    FEW = 64

    def __init__(self, shingle: int, similarity: float):
        self.shingle = shingle
        self.similarity = similarity
        # sets of equal size and that similarity are at this angle: the mean of their distances, and the deviation
        # with ties and unequal sizes the mean is at most a bit more for sets of FEW and more (exactly: 78.6 for 77.6 at 0.8)
        self.radius = self.limit(math.acos(2 * similarity / (1 + similarity)) / math.pi)
        self.loose = max(self.radius, self.limit(_most_apart(similarity, self.FEW)))
        rng = np.random.default_rng(SEED)
        self.odd = rng.integers(1, 1 << 63, self.BANDS * self.ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.salt = rng.integers(1, 1 << 63, self.BITS // 64, dtype=np.uint64)

    def limit(self, share: float) -> int:
        """Seven deviations above the mean distance where a bit differs with that chance."""
        return int(self.BITS * share + 7 * math.sqrt(self.BITS * share * (1 - share)))

    def hashes(self, words: list[bytes]) -> np.ndarray:
        runs = map(b" ".join, zip(*(words[k:] for k in range(self.shingle)))) if len(words) >= self.shingle else [b" ".join(words)]
        return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(SEED)), np.uint64, max(1, len(words) - self.shingle + 1)))

    def alike(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether sets of these sizes can be as similar as asked."""
        return np.minimum(a, b) >= self.similarity * np.maximum(a, b)

    def near(self, fp: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs of rows can be as similar as asked, by the sizes of their sets and their fingerprints."""
        fine = self.alike(size[a], size[b])
        at = np.flatnonzero(fine)
        step = PAIRS // fp.shape[1]
        for k in range(0, len(at), step):
            i = at[k : k + step]
            fine[i] = near_pairs(fp[a[i]], fp[b[i]], self.loose, (self.radius, np.minimum(size[a[i]], size[b[i]]) >= self.FEW))
        return fine

    def near_rows(self, p: np.ndarray, fp: np.ndarray, size: np.ndarray, now: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for rows now against those live (flags, a row of them for each); p: planes of fp."""
        left = packed(live & self.alike(size[now][:, None], size))
        words = np.flatnonzero(left.any(axis=0))
        if not len(words):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        many = np.where((size[now] >= self.FEW)[:, None], packed(size >= self.FEW)[words], np.uint64(0))
        return near_rows(p, fp, now, words, self.loose, left[:, words], (self.radius, many))

    def print(self, text: str) -> tuple[bytes, bytes, int, list[int]]:
        """Digest of the words, fingerprint, size of the set, keys of the bands."""
        words = text.encode().lower().split()
        joined = xxhash.xxh3_128_digest(b" ".join(words))
        h = self.hashes(words)
        least, ones = np.full(len(self.odd), ALL, np.uint64), np.zeros(self.BITS, np.int64)
        for k in range(0, len(h), 1 << 11):
            part = h[k : k + (1 << 11), None]
            mixed = part * self.odd
            least = np.minimum(least, (mixed ^ (mixed >> np.uint64(29))).min(axis=0))
            wide = (part ^ self.salt) * np.uint64(0xBF58476D1CE4E5B9)
            wide = (wide ^ (wide >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
            wide ^= wide >> np.uint64(29)
            ones += np.unpackbits(wide.view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
        fp = np.packbits(2 * ones > len(h), bitorder="little").tobytes()
        bands = least.reshape(self.BANDS, -1)
        return joined, fp, len(h), [xxhash.xxh64_intdigest(b.tobytes(), k) - (1 << 63) for k, b in enumerate(bands)]


def _later(band: np.ndarray, bands: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of rows meet in no earlier band."""
    return ~((bands[a] == bands[b]) & (np.arange(bands.shape[1]) < band[a][:, None])).any(axis=1)


def _asked(key: np.ndarray, band: np.ndarray, fp: np.ndarray, size: np.ndarray, group: np.ndarray, bands: np.ndarray, wide: Wide) -> np.ndarray:
    """Which rows, in whole cells sorted by key, have to be compared by their shingles: those with a partner of another group that may be similar, and that they meet in no earlier band. A small cell is a ring: each row is asked with those 1, 2, ... places ahead, in all small cells at once."""
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    n = np.diff(edge)
    start, count, of = np.repeat(edge[:-1], n), np.repeat(n, n), np.repeat(np.arange(len(n)), n)
    asked, rows = np.zeros(len(key), bool), np.flatnonzero(count <= SMALL)
    for k in range(1, SMALL // 2 + 1):
        rows = rows[count[rows] >= 2 * k]
        if k % 8 == 0:  # where all rows are asked already, nothing is left to find
            rows = rows[(np.bincount(of[~asked], minlength=len(n)) > 0)[of[rows]]]
        if not len(rows):
            break
        ahead = start[rows] + (rows - start[rows] + k) % count[rows]
        open_ = ~(asked[rows] & asked[ahead]) & (group[rows] != group[ahead])
        a, b = rows[open_], ahead[open_]
        later = _later(band, bands, a, b)
        a, b = a[later], b[later]
        near = wide.near(fp, size, a, b)
        asked[a[near]] = asked[b[near]] = True
    for s, m in zip(edge[:-1][n > SMALL].tolist(), n[n > SMALL].tolist()):
        asked[s : s + m] = _asked_of(*(x[s : s + m] for x in (band, fp, size, group, bands)), wide)
    return asked


def _asked_of(band: np.ndarray, fp: np.ndarray, size: np.ndarray, group: np.ndarray, bands: np.ndarray, wide: Wide) -> np.ndarray:
    """The same in one large cell: rows not asked yet against all that were not before them, those of the largest group last."""
    p = planes(fp)
    _, code, count = np.unique(group, return_inverse=True, return_counts=True)
    order, step = np.lexsort((code, count[code])), 1
    asked, open_ = np.zeros(len(fp), bool), np.ones(len(fp), bool)
    while True:
        order = order[open_[order] & ~asked[order]]
        if not len(order):
            return asked
        now, step = order[:step], min(64, 2 * step)
        rows, b = wide.near_rows(p, fp, size, now, open_ & (code[now][:, None] != code))
        a = now[rows]
        for k in range(0, len(a), PAIRS // 8):
            i, j = a[k : k + PAIRS // 8], b[k : k + PAIRS // 8]
            later = _later(band, bands, i, j)
            asked[i[later]] = asked[j[later]] = True
        open_[now] = False


def _shared(keyed: DataFrame) -> DataFrame:
    """The rows of keyed (key, node, band) whose bucket has others."""

    def run(batches):
        for key, node, band in whole_buckets(batches):
            same = key[1:] == key[:-1]
            keep = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            yield pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(node[keep]), pa.array(band[keep])], names=["key", "node", "band"])

    return keyed.select("key", "node", "band").repartition("key").sortWithinPartitions("key").mapInArrow(run, "key long, node long, band int")


def _parts(weight: Column) -> Column:
    """Into how many parts rows of that many shingles and ROW more for each row are dealt."""
    return F.greatest(F.lit(1), F.ceil(weight / F.lit(TASK))).cast("int")


def _part(parts: Column, turn: int) -> Column:
    return F.pmod(F.xxhash64("node", F.lit(turn)), parts).cast("int")


def _cells(rows: DataFrame, wide: Wide, turn: int) -> DataFrame:
    """rows (key, node, band, group, size, fp, bands, parts) to the texts to be compared, (task, side, node, group): buckets in parts, each row with those of its own part; each turn deals them anew. Side 2 is compared with itself."""

    def run(batches):
        for cell, node, band, group, size, fp, bands in whole_buckets(batches):
            keep = _asked(cell, band, fp, size, group, bands, wide)
            n = int(keep.sum())
            yield pa.RecordBatch.from_arrays([pa.array(cell[keep]), pa.array(np.full(n, 2, np.int32)), pa.array(node[keep]), pa.array(group[keep])], names=["task", "side", "node", "group"])

    cell = F.xxhash64("key", _part(F.col("parts"), turn))
    dealt = rows.select(cell.alias("key"), "node", "band", "group", "size", "fp", "bands")
    return dealt.repartition("key").sortWithinPartitions("key").mapInArrow(run, "task long, side int, node long, group long")


def _across(rows: DataFrame) -> DataFrame:
    """rows (key, node, group, size, parts) to (task, side, node, group), so that each row outside its bucket's largest group (side 0) meets every row of the bucket (side 1)."""
    largest = rows.groupBy("key", "group").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("group", "n").alias("largest"))
    rows = rows.join(largest, "key").withColumn("out", F.col("group") != F.col("largest"))
    asking = rows.where("out").groupBy("key").agg(_parts(F.sum(F.col("size") + ROW)).alias("asking"))
    rows = rows.join(asking, "key")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    out = rows.where("out").select("key", F.lit(0).alias("side"), "node", "group", _part(F.col("asking"), 0).alias("i"), every("parts").alias("j"))
    whole = rows.select("key", F.lit(1).alias("side"), "node", "group", every("asking").alias("i"), _part(F.col("parts"), 1).alias("j"))
    return out.union(whole).select(F.xxhash64("key", "i", "j").alias("task"), "side", "node", "group")


def _apart(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of buckets that are not yet in one group, with their groups; found: components."""
    rows = rows.drop("group").join(found, F.col("node") == F.col("u"), "left").withColumn("group", F.coalesce("component", "node")).drop("u", "component")
    apart = rows.groupBy("key").agg(F.min("group").alias("a"), F.max("group").alias("b")).where("a < b").select("key")
    return rows.join(apart, "key", "left_semi")


def _near_in(fp: np.ndarray, size: np.ndarray, side: np.ndarray, wide: Wide) -> Callable:
    """near(u, queue, live): the rows that u has to be compared with, of those live; asked for it, those in the queue and others at once."""
    p, known = planes(fp), {}

    def near(u: int, queue: list[int], live: np.ndarray) -> np.ndarray:
        if u not in known:
            now = [u, *(k for k in queue[:-64:-1] if k not in known)]
            now += [k for k in np.flatnonzero(live)[: 64 - len(now)].tolist() if k not in known]
            now = np.array(now)
            rows, cols = wide.near_rows(p, fp, size, now, live & ((side == 2) | (side[now][:, None] != side)))
            known.update(zip(now.tolist(), np.split(cols, np.searchsorted(rows, np.arange(1, len(now))))))
        return known.pop(u)

    return near


def joined(sets: list[np.ndarray], near: Callable, node: np.ndarray, group: np.ndarray, wide: Wide) -> tuple[list[int], list[int]]:
    """Links that span what similar sets and equal groups connect; near: see _near_in.

    Breadth first: a row is compared with all not reached yet that are near it, so each
    near pair is compared or both are reached from one row.
    """
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    start = np.cumsum(size) - size
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    mark, live = np.zeros(len(values), bool), np.ones(len(sets), bool)
    code = np.unique(group, return_inverse=True)[1]
    us, vs = [], []
    while live.any():
        queue = np.flatnonzero(live & (code == code[np.argmax(live)])).tolist()
        live[queue] = False
        while queue and live.any():
            u = queue.pop()
            others = near(u, queue, live)
            others = others[live[others]]
            if not len(others):
                continue
            mine = flat[start[u] : start[u] + size[u]]
            mark[mine] = True
            both = np.empty(len(others), np.int64)
            step = max(1, (1 << 20) // int(size[others].max()))
            for k in range(0, len(others), step):
                part = others[k : k + step]
                first = np.cumsum(size[part]) - size[part]
                both[k : k + step] = np.add.reduceat(mark[flat[np.repeat(start[part] - first, size[part]) + np.arange(int(size[part].sum()))]], first, dtype=np.int64)
            mark[mine] = False
            fine = others[both >= wide.similarity * (size[u] + size[others] - both)]
            if len(fine):
                new, first = np.unique(code[fine], return_index=True)
                us += [int(node[u])] * len(new)
                vs += node[fine[first]].tolist()
                reached = np.flatnonzero(live & np.isin(code, new))
                live[reached] = False
                queue += reached.tolist()
    return us, vs


def joined_tasks(tasks: list[list[tuple]], wide: Wide) -> tuple[list[int], list[int]]:
    """The links of tasks, lists of (node, group, side, fp, set): rows of side 2 are compared with all others of their task, those of side 0 with those of side 1, by their fingerprints first and what is near by the shingles. The pairs of all small tasks are compared at once."""
    us, vs, small, pairs, total = [], [], [], [], 0
    for held in tasks:
        node, group, side, fp, sets = zip(*held)
        node, group, side = (np.array(x, np.int64) for x in (node, group, side))
        fp, size = np.frombuffer(b"".join(fp), np.uint64).reshape(len(held), -1), np.fromiter(map(len, sets), np.int64, len(held))
        if len(held) > SMALL:
            u, v = joined(list(sets), _near_in(fp, size, side, wide), node, group, wide)
            us, vs = us + u, vs + v
            continue
        i, j = np.triu_indices(len(held), 1)
        open_ = ((side[i] == 2) | (side[i] != side[j])) & (group[i] != group[j])
        pairs.append((total + i[open_], total + j[open_]))
        small.append((total, sets, node, group, fp, size))
        total += len(held)
    if not small:
        return us, vs
    a, b = (np.concatenate(x) for x in zip(*pairs))
    hit = wide.near(np.concatenate([x[4] for x in small]), np.concatenate([x[5] for x in small]), a, b)
    a, b = a[hit], b[hit]
    ends = np.searchsorted(a, [x[0] for x in small] + [total])
    for k, (at, sets, node, group, _, _) in enumerate(small):
        if ends[k] == ends[k + 1]:
            continue
        i, j = a[ends[k] : ends[k + 1]] - at, b[ends[k] : ends[k + 1]] - at
        flags = np.zeros((len(sets), len(sets)), bool)
        flags[i, j] = flags[j, i] = True
        u, v = joined(list(sets), lambda u, queue, live, flags=flags: np.flatnonzero(flags[u]), node, group, wide)
        us, vs = us + u, vs + v
    return us, vs


def _compared(dealt: DataFrame, sketches: DataFrame, texts: DataFrame, wide: Wide) -> DataFrame:
    """dealt (task, side, node, group) to links (u, v), see joined_tasks; sketches (node, fp), texts (node, text), repeated ones repeated. A text goes once to each task that needs it, from each task that reads it."""
    spark, path = dealt.sparkSession, scratch(dealt.sparkSession, "asked")
    dealt.groupBy("node").agg(F.collect_list(F.struct("task", "side", "group")).alias("tasks")).join(sketches.select("node", "fp"), "node").select("node", "fp", "tasks").write.parquet(path)
    asked = spark.read.schema("node long, fp binary, tasks array<struct<task:long,side:int,group:long>>").parquet(path)  # of known size, so Spark broadcasts what is small

    def once(batches):
        seen: set[int] = set()
        for b in batches:
            keep = []
            for node in b.column("node").to_pylist():
                keep.append(node not in seen)
                seen.add(node)
            yield b.filter(pa.array(keep, pa.bool_()))

    needed = texts.join(asked, "node").select("node", "text", "fp", "tasks").mapInArrow(once, "node long, text string, fp binary, tasks array<struct<task:long,side:int,group:long>>")
    rows = needed.select(F.explode("tasks").alias("t"), "node", "fp", "text").select("t.task", "t.side", "t.group", "node", "fp", "text")

    def run(batches):
        task, held, seen, ready, weight = None, [], set(), [], 0

        def links(tasks):
            u, v = joined_tasks([x for x in tasks if len(x) > 1], wide)
            return pa.RecordBatch.from_pydict({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

        for b in batches:
            text = b.column("text")
            for k, (t, side, group, node, fp) in enumerate(zip(*(b.column(c).to_pylist() for c in ("task", "side", "group", "node", "fp")))):
                if t != task:
                    ready.append(held)
                    if weight >= 4 * TASK:
                        yield links(ready)
                        ready, weight = [], 0
                    task, held, seen = t, [], set()
                if (node, side) not in seen:
                    seen.add((node, side))
                    held.append((node, group, side, fp, wide.hashes(text[k].as_py().encode().lower().split())))
                    weight += len(held[-1][-1]) + ROW
        yield links([*ready, held])

    return rows.repartition("task").sortWithinPartitions("task").mapInArrow(run, "u long, v long")


def near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, h, component_id, kept) of every row: groups of texts whose sets of word shingles are at least as similar as asked.

    Rows are told apart by id and text (h, its xxhash64), so clashing and null ids do no
    harm: component_id is the smallest id of the group, null if none of its rows has one,
    and kept is true for the id and text that stands for the group (smallest id, then
    hash; null ids last).

    Copies so far apart differ in too many bits for buckets of whole blocks, so buckets
    are bands of minimal hashes (two sets of similarity 0.8 share one of the 25 with a
    chance of 0.99999). There 512-bit fingerprints are compared as above, in bit planes. A
    text is sent to be compared in a bucket if it has a partner there that may be similar
    by size and fingerprint, and that it meets in no earlier band (told by 32 bits of each
    band). The fingerprints' limit is seven deviations above the mean distance at the
    similarity asked (where a set has less than FEW shingles: above the largest that sets
    of such sizes have), so it loses about one pair in 10^10, the 32 bits one in 10^8, and
    the chance of a common bucket is that of a link.

    Tasks get texts and fingerprints, not pairs, and give the links that span what is
    similar: what is near by its fingerprint, in buckets of any size and in their parts,
    is confirmed by its shingles, and nothing else is compared by these. Buckets of
    EARLY bands come first, so that large groups are mostly found there; then those of
    all bands that are not yet in one group. A bucket of more than TASK shingles is dealt
    in parts, in each of these turns anew; what it still has outside its largest group
    then meets all its rows, part by part. Texts of equal words meet before all that, by
    their digest.
    """
    wide = Wide(shingle, similarity)
    tune(docs.sparkSession)

    def run(batches):
        for b in batches:
            texts = b.column("text")
            same, fp, size, bands = zip(*(wide.print(texts[k].as_py()) for k in range(b.num_rows))) if b.num_rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h"), pa.array(same, pa.binary()), pa.array(fp, pa.binary()), pa.array(size, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "h", "same", "fp", "size", "bands"])

    docs = plain(docs, id_col, text_col).withColumn("h", F.xxhash64("text"))
    texts = docs.select(F.col("h").alias("node"), "text")
    prints = cut(docs.mapInArrow(run, "doc_id long, h long, same binary, fp binary, size long, bands array<long>"))
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    # a text stands for those of equal words; the wide columns are fetched by the pair (same, h) of what stands
    least = prints.groupBy("same").agg(F.min("h").alias("node"), F.min(row).alias("first"))
    nodes = cut(prints.select("same", F.col("h").alias("node"), "fp", "size", "bands").dropDuplicates(["same", "node"]).join(least, ["same", "node"]).select("same", "node", "fp", "size", "bands", "first"))
    low = F.transform("bands", lambda b: F.substring(F.to_binary(F.lpad(F.hex(b), F.lit(16), F.lit("0")), F.lit("hex")), 5, 4))
    sketches = nodes.select("node", "fp", "size", F.concat(*[low[k] for k in range(wide.BANDS)]).alias("bands"))
    keyed = cut(_shared(nodes.select("node", F.posexplode("bands").alias("band", "key"))))
    sized = keyed.join(nodes.select("node", "size"), "node")
    rows = cut(sized.join(sized.groupBy("key").agg(_parts(F.sum(F.col("size") + ROW)).alias("parts")), "key"))
    early = rows.where(F.col("band") < EARLY).withColumn("group", F.col("node")).join(sketches.drop("size"), "node")
    found = components(_compared(_cells(early, wide, 0), sketches, texts, wide))
    rows = cut(_apart(rows.where((F.col("band") >= EARLY) | (F.col("parts") > 1)), found))
    found = components(found.select("u", F.col("component").alias("v")).union(_compared(_cells(rows.join(sketches.drop("size"), "node"), wide, 1), sketches, texts, wide)))
    rows = cut(_apart(rows.where("parts > 1"), found))
    if not rows.isEmpty():
        found = components(found.select("u", F.col("component").alias("v")).union(_compared(_across(rows), sketches, texts, wide)))
    grouped = cut(nodes.join(found, F.col("node") == F.col("u"), "left").select("same", "first", F.coalesce("component", "node").alias("group")))
    labels = grouped.join(grouped.groupBy("group").agg(F.min("first").alias("head")), "group").select("same", "head")
    kept = F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("h") == F.col("head.h"))
    return prints.select("doc_id", "h", "same").join(labels, "same", "left").select("doc_id", "h", F.col("head.doc_id").alias("component_id"), kept.alias("kept"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
