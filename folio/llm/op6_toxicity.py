"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities of a lexicon of insults (a fixed list, and
words and word beginnings learned from the labelled rows), how near to a second
person they stand, capitals, punctuation, repetition and obfuscation (digits and
signs for letters, stretched letters, spaced-out letters). Labels, language,
source and id are no features.

Lexicon, trees and calibration are fitted on at most FIT_ROWS labelled rows, those
with the smallest hashed ids: lexicon counts and features are computed on the
executors, the driver gets at most LEXICON entries and FIT_ROWS rows of FEATURES
numbers. Four fifths of them grow the trees, the rest calibrate. Every document
is scored.

Null texts are empty, and an empty text gets the score of its features like any
other. Null ids count as id "". Labels that are null are not used; an id with
several labels is used once for each of them, one with several documents with the
text of the least hash. Without any
labelled rows, or with labels of one kind only, every score is their mean (0
without rows). Repeated rows get equal scores.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .common import plain, read, tune

FIT_ROWS, LEXICON = 20_000, 5_000
#: Fewest toxic rows that hold a lexicon entry, and how much likelier it must be in them.
SUPPORT, ODDS = 8, 25.0
BEGINNINGS = range(4, 9)
TREES, DEPTH, RATE, BINS, RIDGE = 80, 3, 0.15, 64, 1.0
NEAR = 6
#: Rows learned from have a remainder other than 0.
MODULUS = 5

# Common English insults, and second persons in several languages.
INSULTS = """idiot idiots idiotic moron morons moronic stupid dumb loser losers scum scumbag trash garbage worthless pathetic disgusting clown clowns
fool foolish imbecile cretin jerk pig filth filthy vermin bastard bitch asshole dumbass retard retarded hate shut ugly freak parasite coward liar
crap shit fuck fucking kill die""".split()
SECOND = "you your yours yourself u ur du dich dir dein deine euch ihr sie tu te toi ton ta tes vous votre vos tú ti tuyo usted ustedes vosotros".split()

_LEET = bytes.maketrans(b"0134578@$!|+", b"oieastbasilt")
_UPPER = bytes(range(65, 91))
_PUNCT = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_CORE = re.compile(rb"[^0-9a-z\x80-\xff]+")
_STRETCH = re.compile(rb"(.)\1{2,}")
_SPACED = re.compile(rb"(?<![^\W_])(?:[a-z][ .\-_*]{1,2}){3,}[a-z](?![^\W_])")
HIT, HIDDEN, YOU, ODD, SINGLE, BEGIN = 1, 2, 4, 8, 16, 32

FEATURES = """hit_density hits kinds begin_density begins near_you you_density capitals shouted exclaim ask punctuation hidden_density hidden odd_density
repeats words word_length digits spaced""".split()


class Lexicon(dict):
    """Flags of a blank-separated token, remembered."""

    def __init__(self, words: set[bytes], beginnings: set[bytes]):
        super().__init__()
        self.words, self.beginnings, self.second = words, beginnings, {w.encode() for w in SECOND}

    def __missing__(self, token: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        flags, parts = 0, [p for p in _CORE.split(token) if p]
        for p in parts:
            flags |= HIT * (p in self.words) | YOU * (p in self.second) | BEGIN * any(p[:k] in self.beginnings for k in BEGINNINGS)
        if len(parts) == 1 and len(parts[0]) == 1:
            flags |= SINGLE
        letters = token.translate(_LEET)
        inner = token.strip(_PUNCT)
        if not flags & HIT and inner:
            plain = re.sub(rb"[^a-z\x80-\xff]", b"", inner.translate(_LEET))
            if inner != plain and plain in self.words:
                flags |= HIDDEN
            elif plain in self.words or _STRETCH.search(letters) and (_STRETCH.sub(rb"\1", plain) in self.words or _STRETCH.sub(rb"\1\1", plain) in self.words):
                flags |= HIDDEN
        if len(parts) > 1 or inner and re.search(rb"[a-z\x80-\xff]", inner) and re.search(rb"[0-9@$!*#]", inner):
            flags |= ODD
        self[token] = flags
        return flags


def features(text: str, lexicon: Lexicon) -> list[float]:
    raw = text.encode()
    low = text.lower().encode()
    tokens = low.split()
    n = len(tokens)
    f = np.fromiter(map(lexicon.__getitem__, tokens), np.uint8, n)
    hit, begin, hidden, you = (np.flatnonzero(f & k) for k in (HIT, BEGIN, HIDDEN, YOU))
    spaced = 0
    if int((f & SINGLE).astype(bool).sum()) >= 4:
        spaced = sum(re.sub(rb"[^a-z]", b"", m) in lexicon.words for m in _SPACED.findall(low))
    bad = np.union1d(np.union1d(hit, hidden), begin)
    if len(bad) and len(you):
        k = np.searchsorted(you, bad)
        gap = np.minimum(np.abs(bad - you[np.minimum(k, len(you) - 1)]), np.abs(bad - you[np.maximum(k - 1, 0)]))
        near = float((gap <= NEAR).mean())
    else:
        near = 0.0
    size, per = max(1, len(raw)), 1.0 / max(1, n)
    upper = len(raw) - len(raw.translate(None, _UPPER))
    letters = len(low) - len(re.sub(rb"[a-z\x80-\xff]+", b"", low))
    marks = len(raw) - len(raw.translate(None, _PUNCT))
    return [
        len(hit) * per, len(hit), len({tokens[i] for i in hit.tolist()}), len(begin) * per, len(begin), near, len(you) * per, upper / max(1, letters),
        float(upper > 0.5 * letters), raw.count(b"!") * per, raw.count(b"?") * per, marks / size, len(hidden) * per, len(hidden), float((f & ODD).astype(bool).sum()) * per,
        sum(a == b for a, b in zip(tokens, tokens[1:])) * per, float(np.log1p(n)), letters * per, (len(raw) - len(raw.translate(None, b"0123456789"))) / size, spaced,
    ]


def entries(text: str) -> set[bytes]:
    """Lexicon candidates: whole words (as =word) and word beginnings (as word~)."""
    out = set()
    for w in set(_CORE.split(text.lower().encode())):
        if 3 <= len(w) <= 24:
            out.add(b"=" + w)
            out.update(w[:k] + b"~" for k in BEGINNINGS if len(w) >= k)
    return out


class Trees:
    """Boosted regression trees on binned features; a tree is a list of (feature, bin) by node, and its leaves."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        qs = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        self.edges, self.trees = qs, []
        rate = min(max(float(y.mean()), 1e-6), 1 - 1e-6)
        self.start = float(np.log(rate / (1 - rate)))
        b, m = self.binned(x), np.full(len(y), self.start)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-m))
            tree, leaf = self.grow(b, p - y, p * (1 - p))
            self.trees.append(tree)
            m += tree[1][leaf]

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(q, c, side="left") for q, c in zip(self.edges, x.T)], axis=1).astype(np.int32) if len(x) else np.zeros(x.shape, np.int32)

    def grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray):
        n, d = b.shape
        node, splits = np.zeros(n, np.int64), []
        for level in range(DEPTH):
            width = 1 << level
            G, H = (np.stack([np.bincount(node * (BINS + 1) + b[:, k], v, width * (BINS + 1)).reshape(width, -1) for k in range(d)], 1).cumsum(2) for v in (g, h))
            tg, th = G[:, :, -1:], H[:, :, -1:]
            gain = G**2 / (H + RIDGE) + (tg - G) ** 2 / (th - H + RIDGE) - tg**2 / (th + RIDGE)
            gain[(H < 1) | (th - H < 1)] = 0
            best = gain.reshape(width, -1).argmax(1)
            feature, at = best // (BINS + 1), best % (BINS + 1)
            splits.append((feature, at))
            node = 2 * node + (b[np.arange(n), feature[node]] > at[node])
        leaves = -RATE * np.bincount(node, g, 1 << DEPTH) / (np.bincount(node, h, 1 << DEPTH) + RIDGE)
        return (splits, leaves), node

    def margin(self, x: np.ndarray) -> np.ndarray:
        b, m, rows = self.binned(x), np.full(len(x), self.start), np.arange(len(x))
        for splits, leaves in self.trees:
            node = np.zeros(len(x), np.int64)
            for feature, at in splits:
                node = 2 * node + (b[rows, feature[node]] > at[node])
            m += leaves[node]
        return m


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the best non-decreasing fit of y to x (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for v, group in groupby(sorted(zip(x.tolist(), y.tolist())), key=lambda p: p[0]):
        ys = [p[1] for p in group]
        blocks.append([v, v, sum(ys), len(ys)])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
            low, high = blocks[-2], blocks.pop()
            low[1:] = [high[1], low[2] + high[2], low[3] + high[3]]
    return np.array([e for b in blocks for e in b[:2]]), np.array([b[2] / b[3] for b in blocks for _ in "ab"])


class Model:
    """What scores a text: lexicon, trees, calibration. Of bounded size."""

    def __init__(self, words: set[bytes], beginnings: set[bytes], x: np.ndarray, y: np.ndarray, calibrates: np.ndarray):
        self.words, self.beginnings, self.trees, self.mean = words, beginnings, None, float(y.mean()) if len(y) else 0.0
        if 0 < self.mean < 1 and 0 < y[~calibrates].mean() < 1:
            self.trees = Trees(x[~calibrates], y[~calibrates])
            use = calibrates if calibrates.any() and 0 < y[calibrates].mean() < 1 else ~calibrates
            self.knots = isotonic(self.trees.margin(x[use]), y[use])

    def lexicon(self) -> Lexicon:
        return Lexicon(self.words, self.beginnings)

    def score(self, x: np.ndarray) -> np.ndarray:
        """The calibrated share; a hundredth of the raw one keeps the order within its steps."""
        if self.trees is None:
            return np.full(len(x), self.mean)
        m = self.trees.margin(x)
        return 0.99 * np.interp(m, *self.knots) + 0.01 / (1 + np.exp(-m))


def remainder(doc_id: Column, modulus: int = MODULUS) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def fit(docs: DataFrame, labels: DataFrame, *, label_col: str = "toxic", most: int = FIT_ROWS) -> Model:
    """docs (doc_id, text) and labels (doc_id, label_col)."""
    spark = docs.sparkSession
    use = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("y")).where("doc_id is not null and y in (0, 1)").where(remainder(F.col("doc_id")) != 0)
    use = use.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(most)  # at most 20,000 rows of two numbers
    rows = docs.join(F.broadcast(use), "doc_id").groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("doc_id", "text", "y").persist()
    size = dict(rows.groupBy("y").count().collect())
    n1, n0 = size.get(1.0, 0), size.get(0.0, 0)

    def candidates(batches):
        for b in batches:
            got: tuple[Counter, Counter] = (Counter(), Counter())
            for text, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist()):
                got[int(y)].update(entries(text))
            keys = list(got[0] | got[1])
            yield pa.RecordBatch.from_pydict({"entry": pa.array(keys, pa.binary()), "a": pa.array([got[1][k] for k in keys], pa.int64()), "b": pa.array([got[0][k] for k in keys], pa.int64())})

    odds = (F.col("a") + 0.5) / (n1 + 1.0) / ((F.col("b") + 0.5) / (n0 + 1.0))
    found = rows.mapInArrow(candidates, "entry binary, a long, b long").groupBy("entry").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    top = found.where((F.col("a") >= SUPPORT) & (odds >= ODDS)).orderBy((F.log(odds) * F.col("a")).desc(), "entry").limit(LEXICON).collect()
    entry = [bytes(r["entry"]) for r in top]
    words = {e[1:] for e in entry if e[:1] == b"="} | {w.encode() for w in INSULTS}
    beginnings = {e[:-1] for e in entry if e[-1:] == b"~"}

    def measure(batches):
        lexicon = Lexicon(words, beginnings)
        for b in batches:
            x = [features(t, lexicon) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "y": b.column("y"), "x": pa.array(x, pa.list_(pa.float64()))})

    got = rows.mapInArrow(measure, "doc_id long, y double, x array<double>").toPandas().sort_values(["doc_id", "y"])
    rows.unpersist()
    x = np.array(got["x"].tolist(), np.float64).reshape(-1, len(FEATURES))
    calibrates = (got["doc_id"].to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % 5 == 0
    return Model(words, beginnings, x, got["y"].to_numpy(np.float64), calibrates)


def scored(docs: DataFrame, model: Model, *, text_col: str = "text", score: str = "score", predicted: str = "predicted") -> DataFrame:
    """docs with two more columns, whose names docs must not have; all others stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of bounded size
    names, at = docs.columns, docs.columns.index(text_col)

    def run(batches):
        m = shared.value
        lexicon = m.lexicon()
        for b in batches:
            texts = b.column(at)
            x = np.array([features(texts[k].as_py() or "", lexicon) for k in range(b.num_rows)], np.float64).reshape(-1, len(FEATURES))
            s = m.score(x)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[*names, score, predicted])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType()), T.StructField(predicted, T.IntegerType())]))


def toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs."""
    tune(docs.sparkSession)
    rows = plain(docs, id_col, text_col)
    out = scored(rows, fit(rows, labels))
    return out.select("doc_id", (remainder(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
