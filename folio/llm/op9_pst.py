"""Language-model scores by a probabilistic suffix tree over words.

A text's tokens are its words in lower case (A-Z) and one end. Their training
counts come from the global shuffle of distinct words (:mod:`exchange`) and give
the base model, P0(w) = (c + 0.1) / (N + 0.1 (V + 1)).

The tree's alphabet is bounded: the OWN most frequent words are symbols of their
own, any other belongs to one of 256 classes by its last bytes. A state is a run
of up to DEPTH symbols before a token. It is kept if it occurs at least STATE
times in the training texts and its next symbols differ from those of its parent
(the longest state kept that is a suffix of the run) by a likelihood-ratio test;
its distribution is smoothed towards the parent's. A token is scored in the
longest state kept:

    P(w | state) = P(symbol of w | state) * P0(w) / P0(symbol of w)

where a class has the mass of its known words and of one unknown word. STATE is a
count, not a share, so the states grow with the corpus.

States of one symbol are a table of bounded size, which every task holds. Longer
ones never reach the driver: each block of texts sends its distinct runs of
DEPTH + 1 symbols, once with their number, to a bucket by the last two symbols of
the context. A bucket so has all that its states need, deepens them step by step,
and sends back one number for each run (the ratio to its state of one
symbol), in the block's order. The number of
buckets follows the number of tokens.

Nulls are empty texts (one token, the end). A row with a null id counts as held
out. Repeated rows are scored, and counted, as often as they occur. Without
training tokens every probability is that of one unknown word.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import exchange
from .common import plain, read, scratch, tune

#: Words that are symbols of their own, at most; classes of the others; bytes at a word's end that choose its class.
OWN, CLASSES, TAIL = 1700, 256, 3
#: The symbol before a text, and what is before that.
START, NONE = CLASSES + OWN, CLASSES + OWN + 1
#: Bits of a symbol, and the longest context.
BITS, DEPTH = 11, 4
MASK = (1 << BITS) - 1
ADD = 0.1
#: Least occurrences of a state.
STATE = 32
#: Tokens' worth of the parent's distribution in a state's.
PRIOR = 20.0
#: Least divergence from the parent in nats a token, and deviations by which the test statistic must exceed its mean.
LEAST, DEVIATIONS = 0.002, 4.0
#: Groups of symbols that are added up apart.
GROUPS = 16
#: Tokens whose runs are sent together, and tokens for each bucket of runs.
STEP, BUCKET_TOKENS = 1 << 20, 2 << 20

SEQUENCES = "block long, meta binary, symbols binary, sums binary, known binary"
RUNS = "bucket int, block long, step int, runs binary"
_RUNS = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("step", pa.int32()), ("runs", pa.binary())])


def tokens(text: str) -> list[bytes]:
    """Words and the end, an empty string."""
    words = text.encode().lower().split()
    words.append(b"")
    return words


def class_of(word: bytes) -> int:
    return zlib.crc32(word[-TAIL:]) % CLASSES


def held_out(doc_id: int | None, modulus: int) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % modulus == 0


def count(rows: DataFrame, buckets: int) -> DataFrame:
    """Packed rows with, for each word of a block, its training count and its tag: class + CLASSES * (rank among the bucket's OWN most frequent, from 1; or 0). Summary rows hold the bucket's counts and kinds by class, and its most frequent words' counts and classes."""

    def value(lists):
        total: dict[bytes, int] = {}
        for words, w in lists:
            for word, n in zip(words, w.tolist()):
                total[word] = total.get(word, 0) + n
        top = sorted((w for w, n in total.items() if n), key=lambda w: (-total[w], w))[:OWN]
        rank = {w: k for k, w in enumerate(top, 1)}
        for words, _ in lists:
            n = np.fromiter(map(total.__getitem__, words), np.int64, len(words))
            tags = np.fromiter((class_of(w) + CLASSES * rank.get(w, 0) for w in words), np.int64, len(words))
            yield [*exchange.narrow(n), *exchange.narrow(tags)]
        by = np.zeros((2, CLASSES), np.int64)
        for w, n in total.items():
            if n:
                by[:, class_of(w)] += (n, 1)
        yield [by, np.array([total[w] for w in top], np.int64), np.array([class_of(w) for w in top], np.int64)]

    return exchange.values(rows, value, buckets)


class Vocabulary:
    """What the symbols need: the size of the training text, the frequent words by (bucket, rank), and P0 of each symbol. At most CLASSES + OWN entries."""

    def __init__(self, summaries: DataFrame):
        def run(batches):
            for b in batches:
                for bucket, meta in zip(b.column("bucket").to_pylist(), b.column("meta").to_pylist()):
                    by, n, of = (np.frombuffer(x, np.int64) for x in exchange.unpack(meta))
                    by = by.reshape(2, CLASSES)
                    yield pa.RecordBatch.from_pydict({"bucket": np.full(CLASSES, -1, np.int32), "rank": np.arange(CLASSES, dtype=np.int32), "n": by[0], "more": by[1]})
                    yield pa.RecordBatch.from_pydict({"bucket": np.full(len(n), bucket, np.int32), "rank": np.arange(1, len(n) + 1, dtype=np.int32), "n": n, "more": of})

        found = summaries.select("bucket", "meta").mapInArrow(run, "bucket int, rank int, n long, more long").persist()
        classes = found.where("bucket = -1").groupBy("rank").agg(F.sum("n"), F.sum("more")).collect()
        n, kinds = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
        for k, a, b in classes:
            n[k], kinds[k] = a, b
        self.tokens, self.kinds = int(n.sum()), int(kinds.sum())
        top = found.where("bucket >= 0").orderBy(F.desc("n"), "bucket", "rank").limit(OWN).collect()
        found.unpersist()
        self.symbol = {(r["bucket"], r["rank"]): CLASSES + k for k, r in enumerate(top)}
        self.mass = self.tokens + ADD * (self.kinds + 1)
        for r in top:
            n[r["more"]] -= r["n"]
            kinds[r["more"]] -= 1
        self.base = np.concatenate([n + ADD * kinds + ADD, [r["n"] + ADD for r in top]]) / self.mass
        self.base /= self.base.sum()


def sequences(rows: DataFrame, known: Vocabulary, tasks: int) -> DataFrame:
    """A row for each block: its documents' ids, sizes and marks, their symbols, the sums of log10(c + 0.1) and the number of known tokens."""
    symbol, schema = known.symbol, pa.schema([("block", pa.int64()), *((n, pa.binary()) for n in ("meta", "symbols", "sums", "known"))])

    def whole(block, docs, parts):
        n = int(docs.sizes.sum())
        symbols, logs, seen = np.zeros(n, np.uint16), np.zeros(n), np.zeros(n, bool)
        for bucket, pos, word, got in parts:
            c, tag = exchange.widen(*got[:2]), exchange.widen(*got[2:4])
            own = np.array([symbol.get((bucket, k), -1) if k else -1 for k in (tag // CLASSES).tolist()], np.int64)
            own = np.where(own < 0, tag % CLASSES, own)
            symbols[pos], logs[pos], seen[pos] = own[word], np.log10(c + ADD)[word], (c > 0)[word]
        at = np.cumsum(docs.sizes) - docs.sizes  # no text is empty: it has its end
        meta, symbols = exchange.pack(*docs.parts()), exchange.pack(symbols)
        return pa.table([[block], [meta], [symbols], [np.add.reduceat(logs, at).tobytes()], [np.add.reduceat(seen, at, dtype=np.int64).tobytes()]], schema=schema)

    return exchange.assemble(rows, whole, SEQUENCES, tasks)


class Text:
    """A block's symbols, with the contexts of any part of them."""

    def __init__(self, row: dict):
        self.docs = exchange.Documents.read(exchange.unpack(row["meta"]))
        symbols = np.frombuffer(exchange.unpack(row["symbols"])[0], np.uint16)
        self.symbols = np.concatenate([np.full(DEPTH, NONE, np.uint16), symbols])
        self.n = len(symbols)
        self.ends = np.cumsum(self.docs.sizes)

    def part(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the tokens a to b (excluded) with their contexts, the last symbol of the context first, the token last; and the document of each."""
        at = np.arange(a, b)
        doc = np.searchsorted(self.ends, at, side="right")
        place = at - (self.ends - self.docs.sizes)[doc]
        code = np.zeros(b - a, np.int64)
        for k in range(1, DEPTH + 1):
            before = self.symbols[a + DEPTH - k : b + DEPTH - k].astype(np.int64)
            before[place == k - 1], before[place < k - 1] = START, NONE
            code = code << BITS | before
        return code << BITS | self.symbols[a + DEPTH : b + DEPTH], doc

    def times(self) -> np.ndarray:
        """How often each text occurs for training."""
        return np.bincount(self.docs.of, self.docs.marks.astype(np.float64), len(self.docs.sizes)).astype(np.int64)


def first_counts(seqs: DataFrame) -> np.ndarray:
    """(context, symbol): training counts of symbols after one symbol; added up in each task first. A table of bounded size."""
    size = START + 1

    def run(batches):
        total = np.zeros(size * size, np.int64)
        for b in batches:
            for row in b.to_pylist():
                text = Text(row)
                times = text.times()
                for a in range(0, text.n, STEP):
                    code, doc = text.part(a, min(text.n, a + STEP))
                    pair = (code >> BITS * DEPTH) * size + (code & MASK)
                    total += np.bincount(pair, times[doc], size * size).astype(np.int64)
        total = total.reshape(size, size)
        yield from exchange.batched(({"bucket": b, "block": 0, "step": 0, "runs": _sparse(total[b::GROUPS])} for b in range(GROUPS)), _RUNS)

    def add(batches):
        totals: dict[int, np.ndarray] = {}
        for b in batches:
            for bucket, frame in zip(b.column("bucket").to_pylist(), b.column("runs").to_pylist()):
                n = totals.setdefault(bucket, np.zeros((len(range(bucket, size, GROUPS)), size), np.int64))
                at, more = _opened(frame)
                n.reshape(-1)[at] += more
        yield from exchange.batched(({"bucket": b, "block": 0, "step": 0, "runs": _sparse(n)} for b, n in totals.items()), _RUNS)

    out = np.zeros((size, size), np.int64)
    for r in seqs.mapInArrow(run, RUNS).repartition("bucket").mapInArrow(add, RUNS).toArrow().to_pylist():
        at, n = _opened(r["runs"])
        part = np.zeros(out[r["bucket"] :: GROUPS].shape, np.int64)
        part.reshape(-1)[at] = n
        out[r["bucket"] :: GROUPS] = part
    return out


def _sparse(n: np.ndarray) -> bytes:
    at = np.flatnonzero(n)
    return _packed(at, n.reshape(-1)[at])


def differs(nats: np.ndarray, total: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Which states are kept: of enough occurrences, and told apart from their parents by a likelihood-ratio test."""
    return (total >= STATE) & (nats >= LEAST * total) & (2 * nats >= kinds + DEVIATIONS * np.sqrt(2.0 * kinds))


class Root:
    """States of at most one symbol. chance[row[symbol], next]: P(next | symbol); row 0 is the base."""

    def __init__(self, counts: np.ndarray, base: np.ndarray):
        counts = counts[:, : len(base)].astype(np.float64)
        total, kinds = counts.sum(axis=1), (counts > 0).sum(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            nats = np.where(counts > 0, counts * np.log(counts / total[:, None] / base), 0).sum(axis=1)
        keep = np.flatnonzero(differs(nats, total, kinds))
        self.row = np.zeros(NONE + 1, np.int64)
        self.row[keep] = 1 + np.arange(len(keep))
        self.base = base
        self.chance = np.concatenate([base[None], (counts[keep] + PRIOR * base) / (total[keep, None] + PRIOR)])

    def of(self, code: np.ndarray) -> np.ndarray:
        return self.chance[self.row[code >> BITS * DEPTH], code & MASK]


def deepened(code: np.ndarray, n: np.ndarray, root: Root) -> np.ndarray:
    """P(token | longest state kept) of each of all distinct runs (sorted) that share their last two symbols of context, n being their training counts."""
    p, token = root.of(code), code & MASK
    for depth in range(2, DEPTH + 1):
        context = code >> BITS * (DEPTH + 1 - depth)
        cell, of = np.unique(context << BITS | token, return_inverse=True) if depth < DEPTH else (code, slice(None))
        first = np.zeros(len(cell), np.int64)
        first[of] = np.arange(len(code))
        c = np.bincount(of, n, len(cell)) if depth < DEPTH else n.astype(np.float64)
        edge = np.flatnonzero(np.concatenate([[True], np.diff(cell >> BITS) != 0]))
        size = np.diff(np.concatenate([edge, [len(cell)]]))
        total, seen = np.add.reduceat(c, edge), c > 0
        nats = np.zeros(len(cell))
        nats[seen] = c[seen] * np.log(c[seen] / np.repeat(total, size)[seen] / p[first][seen])
        keep = differs(np.add.reduceat(nats, edge), total, np.add.reduceat(seen.astype(np.int64), edge)) & ((cell[edge] >> BITS & MASK) != NONE)
        new = np.where(np.repeat(keep, size), (c + PRIOR * p[first]) / (np.repeat(total, size) + PRIOR), p[first])
        p = new[of]
    return p


def _packed(codes: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted codes as the planes of their differences' bytes."""
    return exchange.pack(np.diff(codes, prepend=0).view(np.uint8).reshape(-1, 8).T, *exchange.narrow(n))


def _opened(frame: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes, *n = exchange.unpack(frame)
    return np.cumsum(np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).view(np.int64).ravel()), exchange.widen(*n)


class Runs:
    """Distinct runs of a part of a text whose last two symbols of context occur often enough for a state, by bucket."""

    def __init__(self, text: Text, a: int, b: int, deep: np.ndarray, buckets: int):
        self.code, self.doc = text.part(a, b)
        pair = self.code >> BITS * (DEPTH - 1)
        self.use = deep[pair >> BITS, pair & MASK]
        code, self.inverse = np.unique(self.code[self.use], return_inverse=True)
        where = ((code >> BITS * (DEPTH - 1)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % buckets
        self.order = np.argsort(where, kind="stable")
        self.codes, self.edge = code[self.order], np.concatenate([[0], np.cumsum(np.bincount(where, minlength=buckets))])

    def rows(self, block: int, step: int, times: np.ndarray) -> Iterator[dict]:
        n = np.bincount(self.inverse, times[self.doc[self.use]], len(self.codes)).astype(np.int64)[self.order]
        for b in np.flatnonzero(np.diff(self.edge)).tolist():
            part = slice(self.edge[b], self.edge[b + 1])
            yield {"bucket": b, "block": block, "step": step, "runs": _packed(self.codes[part], n[part])}

    def ratios(self, frames: dict[int, bytes], root: Root) -> np.ndarray:
        """log10 of P(symbol | state) / P0(symbol) of each token, from what the buckets gave."""
        out = np.log10(root.of(self.code) / root.base[self.code & MASK])
        got = np.zeros(len(self.codes), np.float32)
        for b in np.flatnonzero(np.diff(self.edge)).tolist():
            planes = np.frombuffer(exchange.unpack(frames[b])[0], np.uint8).reshape(4, -1)
            got[self.edge[b] : self.edge[b + 1]] = np.ascontiguousarray(planes.T).view(np.float32).ravel()
        back = np.empty_like(got)
        back[self.order] = got
        out[self.use] += back[self.inverse]
        return out


def score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", modulus: int = 10, buckets: int | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; trained on those not held out."""
    spark = docs.sparkSession
    tune(spark, 4)  # a row can be a block
    docs = plain(docs, id_col, text_col)
    buckets = buckets or exchange.buckets_for(docs)
    rows = exchange.blocks(docs, tokens, bytes, buckets, lambda i: not held_out(i, modulus))
    at = scratch(spark, "pst")
    counted = count(rows, buckets).withColumn("summary", F.col("block") == exchange.SUMMARY)
    counted.write.partitionBy("summary").option("compression", "none").parquet(f"{at}/counts")
    schema = exchange.ROW + ", summary boolean"
    counted = spark.read.schema(schema).parquet(f"{at}/counts")
    known = Vocabulary(counted.where("summary"))
    sequences(counted.where("not summary").drop("summary"), known, buckets).write.option("compression", "none").parquet(f"{at}/sequences")
    seqs = spark.read.schema(SEQUENCES).parquet(f"{at}/sequences")
    counts = first_counts(seqs)
    model = spark.sparkContext.broadcast((Root(counts, known.base), np.pad(counts.T >= STATE, ((0, 1), (0, 1)))))  # of bounded size
    parts = min(exchange.MOST_BUCKETS, max(8, -(-known.tokens // BUCKET_TOKENS)))
    n_train, scale = known.tokens, float(np.log10(known.mass))

    def send(batches):
        _, deep = model.value
        for b in batches:
            for row in b.to_pylist():
                text = Text(row)
                times = text.times()
                for step, a in enumerate(range(0, text.n, STEP)):
                    yield from exchange.batched(Runs(text, a, min(text.n, a + STEP), deep, parts).rows(row["block"], step, times), _RUNS)

    def answers(bucket: int, held: list[tuple[int, int, bytes]]) -> Iterator[dict]:
        root, _ = model.value
        codes, counts = zip(*(_opened(f) for *_, f in held))
        sizes = [len(c) for c in codes]
        code, of = np.unique(np.concatenate(codes), return_inverse=True)
        n = np.bincount(of, np.concatenate(counts), len(code)).astype(np.int64)
        del codes, counts
        ratio, a = np.log10(deepened(code, n, root) / root.of(code)).astype(np.float32), 0
        for (block, step, _), size in zip(held, sizes):  # zero where no longer state is kept; like bytes together
            yield {"bucket": bucket, "block": block, "step": step, "runs": exchange.pack(ratio[of[a : a + size]].view(np.uint8).reshape(-1, 4).T)}
            a += size

    def deepen(batches):
        bucket, held = None, []
        for b in batches:
            for r in b.to_pylist():
                if r["bucket"] != bucket and held:
                    yield from exchange.batched(answers(bucket, held), _RUNS)
                    held = []
                bucket = r["bucket"]
                held.append((r["block"], r["step"], r["runs"]))
        if held:
            yield from exchange.batched(answers(bucket, held), _RUNS)

    def finish(seq: pa.Table, runs: pa.Table) -> pa.Table:
        root, deep = model.value
        frames: dict[int, dict[int, bytes]] = {}
        for r in runs.to_pylist():
            frames.setdefault(r["step"], {})[r["bucket"]] = r["runs"]
        out = []
        for row in seq.to_pylist():
            text = Text(row)
            more = np.zeros(len(text.docs.sizes))
            for step, a in enumerate(range(0, text.n, STEP)):
                run = Runs(text, a, min(text.n, a + STEP), deep, parts)
                more += np.bincount(run.doc, run.ratios(frames.get(step, {}), root), len(more))
            docs = text.docs
            base = np.frombuffer(row["sums"], np.float64) - docs.sizes * scale
            out.append(pa.table({
                "doc_id": pa.array(docs.ids, pa.int64()), "held_out": ~docs.marks, "n_tokens": docs.sizes[docs.of], "n_known": np.frombuffer(row["known"], np.int64)[docs.of],
                "train_tokens": np.full(len(docs.ids), n_train, np.int64), "base_score": base[docs.of], "score": (base + more)[docs.of],
            }))
        return pa.concat_tables(out) if out else RESULT.empty_table()

    runs = seqs.mapInArrow(send, RUNS).repartitionById(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(deepen, RUNS)
    return seqs.repartition(parts, "block").groupBy("block").cogroup(runs.repartition(parts, "block").groupBy("block")).applyInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


RESULT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def op9_pst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read(spark, sf_dir, "documents"))
