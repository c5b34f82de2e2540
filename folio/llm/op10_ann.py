"""Nearest neighbours by additive quantisation.

A vector of unit length is approximated by a sum of full-dimensional codewords,
one from each codebook. The codebooks are fitted one after another to what the
earlier ones leave over (k-means on a bounded sample), and a vector is encoded
by beam search: the best few partial sums go on to the next book. With the codes
goes the norm of the sum, so that a query's score against a code is a sum of
looked-up products divided by the stored norm.

All rows are encoded and dealt to cells, those of the nearest of some centres
(k-means on the same sample), about ROWS rows each; a larger cell is cut into
parts of about that size by a hash of the id. A task holds one part of a cell and
reads its queries as a stream; table look-ups pick each query's KEEP best codes
there (ties: smaller ids), and the exact cosines of those are taken in double
precision on the vectors stored beside the codes. A last aggregation merges the
cells.

Nothing that the codes or the cells miss is lost, whatever the rows are like: with
a code goes how far its vector leans away from it, so the look-up also bounds the
cosine from above, and every row whose bound reaches the TOP-th best cosine found
is taken exactly, too. Likewise for cells, by the angle of their farthest row to
the centre: a query visits its FIRST nearest cells, and then each cell that may
hold a cosine as large as the TOP-th of those. Clustered data needs few cells and
exact cosines; data without clusters needs most cells, so there the work grows with
queries times rows (a part and a batch of its queries are held at a time).

Vectors that are null, empty, zero, or that hold null or non-finite components
take no part; nor do rows with a null id. Vectors of different lengths have no
cosine: each length is an index of its own. Repeated rows are candidates as often
as they occur, but a query's own id never is one. Queries that are equal in id and
vector are one query; equal ids with different vectors are queries of their own.
Equal scores are ordered by id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import cut, read, scratch, tune

#: Codebooks, codewords in each, width of the beam.
BOOKS, WORDS, BEAM = 16, 256, 4
#: Rows that the codebooks are fitted on, at most: those with the smallest hashed ids.
SAMPLE = 8192
#: Rows of a cell, about; codes of a cell that are reranked for a query; results for a query; most cells.
ROWS, KEEP, TOP, CELLS = 2048, 100, 5, 2048
#: Cells that a query visits first; what rounding may take from a cosine in double precision, and from a look-up.
FIRST, FINE, ROUGH = 4, 1e-9, 1e-4
SEED = 7


def unit(x: np.ndarray) -> np.ndarray:
    """Scaled by the largest component first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def fit(x: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = 12) -> np.ndarray:
    """(books, words, dim) float32. x: unit vectors; fewer than words are repeated."""
    rng = np.random.default_rng(SEED)
    rest, out = x.astype(np.float32), []
    for _ in range(books):
        centre = rest[rng.choice(len(rest), words, replace=len(rest) < words)].copy()
        for _ in range(rounds):
            near = (rest @ centre.T - 0.5 * (centre * centre).sum(axis=1)).argmax(axis=1)
            n = np.bincount(near, minlength=words)
            total = np.stack([np.bincount(near, rest[:, d], words) for d in range(rest.shape[1])], axis=1)
            centre = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centre).astype(np.float32)
        near = (rest @ centre.T - 0.5 * (centre * centre).sum(axis=1)).argmax(axis=1)
        rest = rest - centre[near]
        out.append(centre)
    return np.stack(out)


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Codes (n, books) and the norms of their sums."""
    n, (m, words, dim) = len(x), books.shape
    codes, rest = np.zeros((n, 1, 0), np.uint8), x.astype(np.float32)[:, None, :]
    for book in books:
        far = (rest * rest).sum(-1)[..., None] - 2 * (rest.reshape(-1, dim) @ book.T).reshape(n, -1, words) + (book * book).sum(-1)
        width = far.shape[1]
        k = min(beam, width * words)
        best = _least(far.reshape(n, -1), k)
        at, word = best // words, best % words
        rows = np.arange(n)[:, None]
        rest = rest[rows, at] - book[word]
        codes = np.concatenate([codes[rows, at], word[..., None].astype(np.uint8)], axis=2)
    best = (rest * rest).sum(-1).argmin(axis=1)
    codes = codes[np.arange(n), best]
    norm = np.sqrt((sum(books[k][codes[:, k]] for k in range(m)) ** 2).sum(axis=1))
    return codes, np.maximum(norm, 1e-12).astype(np.float32)


def _least(a: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k least of each row, in order."""
    part = np.argpartition(a, k - 1, axis=1)[:, :k]
    return np.take_along_axis(part, np.argsort(np.take_along_axis(a, part, 1), axis=1, kind="stable"), 1)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = F.col(vec_col)
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    d = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: x.cast("double")).alias("vec"))
    return d.where(F.col("vec_id").isNotNull() & (F.size("vec") > 0) & F.forall("vec", fine) & F.exists("vec", lambda x: x != 0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def sample(rows: DataFrame, most: int = SAMPLE) -> np.ndarray:
    """The fitting sample: unit vectors."""
    got = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(most).select("vec").toArrow().column("vec").combine_chunks()
    return unit(_matrix(got)) if len(got) else np.zeros((0, 0))


def centres(x: np.ndarray, cells: int, rounds: int = 10) -> np.ndarray:
    """(cells, dim) unit vectors: spherical k-means."""
    centre = x[np.random.default_rng(SEED).choice(len(x), cells, replace=False)]
    for _ in range(rounds):
        near = (x @ centre.T).argmax(axis=1)
        total = np.stack([np.bincount(near, x[:, d], cells) for d in range(x.shape[1])], axis=1)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        centre = np.where(size > 0, total / np.maximum(size, 1e-12), centre)
    return centre


INDEX = "cell int, near double, vec_id long, code binary, norm float, along float, beside float, vec array<double>"


def index(rows: DataFrame, books: np.ndarray, centre: np.ndarray) -> DataFrame:
    """(cell, near, vec_id, code binary, norm, along, beside float, vec) of every row. near: cosine to the cell's centre; along, beside: the vector's parts in the direction of its code and across."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = unit(_matrix(b.column("vec")))
            codes, norm = encode(x, books)
            to = x @ centre.T
            raw, cell = codes.tobytes(), to.argmax(axis=1).astype(np.int32)
            code_unit = sum(books[k][codes[:, k]].astype(np.float64) for k in range(codes.shape[1]))
            code_unit /= np.maximum(np.linalg.norm(code_unit, axis=1, keepdims=True), 1e-12)
            along = (x * code_unit).sum(axis=1)
            beside = np.linalg.norm(x - along[:, None] * code_unit, axis=1)
            code = pa.array([raw[k : k + codes.shape[1]] for k in range(0, len(raw), codes.shape[1])], pa.binary())
            near = pa.array(to[np.arange(len(x)), cell])
            lean = [pa.array(v.astype(np.float32)) for v in (along, beside)]
            yield pa.RecordBatch.from_arrays([pa.array(cell), near, b.column("vec_id"), code, pa.array(norm), *lean, b.column("vec")], names=["cell", "near", "vec_id", "code", "norm", "along", "beside", "vec"])

    return rows.select("vec_id", "vec").mapInArrow(run, INDEX)


class Cell:
    """The rows of a part of a cell, in the order of their ids."""

    def __init__(self, batches: list[pa.RecordBatch], books: np.ndarray):
        one = pa.Table.from_batches(batches)
        one = one.take(pa.array(np.argsort(one.column("vec_id").to_numpy(), kind="stable")))
        self.ids, self.norm, self.along, self.beside = (one.column(c).to_numpy() for c in ("vec_id", "norm", "along", "beside"))
        self.vecs = unit(_matrix(one.column("vec").combine_chunks()))
        self.codes = np.frombuffer(b"".join(one.column("code").to_pylist()), np.uint8).reshape(len(self.ids), -1)
        self.books = books

    def find(self, qids: np.ndarray, q: np.ndarray, least: np.ndarray, keep: int, top: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query's place, ids, cosines) of the top rows of each query; q: unit vectors; least: a cosine that top rows elsewhere reach, so only rows that reach it count."""
        tables = (q.astype(np.float32) @ self.books.reshape(-1, self.books.shape[2]).T).reshape(len(q), *self.books.shape[:2])
        ids, codes = self.ids, self.codes
        for k, own in enumerate(qids.tolist()):
            near = tables[k, 0][codes[:, 0]]
            for m in range(1, codes.shape[1]):
                near = near + tables[k, m][codes[:, m]]
            near = near / self.norm
            most = near * self.along + (self.beside + ROUGH)
            near = np.where(ids == own, -np.inf, near)
            if keep < len(near):
                edge = np.partition(near, len(near) - keep)[len(near) - keep]
                above, at = np.flatnonzero(near > edge), np.flatnonzero(near == edge)
                pick = np.concatenate([above, at[: keep - len(above)]])  # rows are in the order of their ids
            else:
                pick = np.arange(len(near))
            pick = pick[ids[pick] != own]
            exact = (self.vecs[pick] * q[k]).sum(axis=1)
            reach = least[k]
            if len(exact) >= top:
                reach = max(reach, np.partition(exact, len(exact) - top)[len(exact) - top])
            rest = ids != own
            rest[pick] = False
            more = np.flatnonzero(rest & (most >= reach - FINE))
            if len(more):
                pick = np.concatenate([pick, more])
                exact = np.concatenate([exact, (self.vecs[more] * q[k]).sum(axis=1)])
            best = np.lexsort((ids[pick], -exact))[:top]
            best = best[exact[best] >= least[k] - FINE]
            yield k, ids[pick][best], exact[best]


def reachable(q: np.ndarray, centre: np.ndarray, width: np.ndarray) -> np.ndarray:
    """(queries, cells): the largest cosine that a row of a cell can have; width: the angle of a cell's farthest row to its centre."""
    angle = np.arccos(np.clip(q @ centre.T, -1, 1))
    return np.cos(np.maximum(angle - width, 0)) + 1e-6


def _search(base: DataFrame, asked: DataFrame, count: int, top: int, keep: int) -> DataFrame:
    """search() among usable vectors of one length."""
    spark = base.sparkSession
    x = sample(base)
    books = fit(x)
    centre = centres(x, max(1, min(CELLS, len(x) // 4, -(-count // ROWS))))
    path = scratch(spark, "ann")
    index(base, books, centre).write.parquet(path)
    coded = spark.read.schema(INDEX).parquet(path)
    cells = {c: (n, far) for c, n, far in coded.groupBy("cell").agg(F.count("*"), F.min("near")).collect()}  # at most CELLS rows
    split = [max(1, -(-cells.get(c, (0,))[0] // ROWS)) for c in range(len(centre))]
    width = np.array([np.arccos(np.clip(cells[c][1], -1, 1)) if c in cells else -np.inf for c in range(len(centre))])
    first = min(FIRST, len(centre))
    parts = F.element_at(F.array(*[F.lit(n) for n in split]), F.col("cell") + 1)

    def route(batches):
        """Cells of each query: the first of all while it has no least cosine, then all others that can reach that."""
        for b in batches:
            if b.num_rows:
                q, least = unit(_matrix(b.column("vec"))), b.column("least").to_numpy(zero_copy_only=False)
                order = np.argsort(-(q @ centre.T), axis=1, kind="stable").astype(np.int32)
                if b.column("second")[0].as_py():
                    can = np.take_along_axis(reachable(q, centre, width) >= least[:, None], order, 1)
                    to = [o[first:][c[first:]] for o, c in zip(order, can)]
                else:
                    to = list(order[:, :first])
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("vec"), b.column("least"), pa.array(to, pa.list_(pa.int32()))], names=["vec_id", "vec", "least", "cells"])

    none = lambda *kinds: [F.lit(None).cast(kind).alias(name) for name, kind in kinds]
    lean = [("code", "binary"), ("norm", "float"), ("along", "float"), ("beside", "float")]
    rows = coded.select("cell", F.pmod(F.xxhash64("vec_id"), parts.cast("long")).cast("int").alias("part"), F.lit(0).alias("kind"), "vec_id", F.lit(0).cast("long").alias("own"), *none(("least", "double")), *[n for n, _ in lean], "vec")

    def visit(batches):
        at, held, cell = None, [], None
        for b in batches:
            place, part, kind = (b.column(c).to_numpy() for c in ("cell", "part", "kind"))
            if not len(place):
                continue
            edge = np.flatnonzero(np.concatenate([[True], (np.diff(place) != 0) | (np.diff(part) != 0) | (np.diff(kind) != 0), [True]]))
            for a, z in zip(edge[:-1].tolist(), edge[1:].tolist()):
                if (place[a], part[a]) != at:
                    at, held, cell = (place[a], part[a]), [], None
                piece = b.slice(a, z - a)
                if not kind[a]:  # a part's rows come before its queries
                    held.append(piece)
                    continue
                if not held and cell is None:
                    continue
                if cell is None:
                    cell, held = Cell(held, books), []
                q, qids = _matrix(piece.column("vec")), piece.column("vec_id").to_numpy()
                got = list(cell.find(qids, unit(q), piece.column("least").to_numpy(), keep, top))
                size = [len(ids) for _, ids, _ in got]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qids, size)), pa.array(np.repeat(piece.column("own").to_numpy(), size)), pa.array(np.concatenate([i for _, i, _ in got])), pa.array(np.concatenate([e for *_, e in got]))], names=["query_id", "own", "vec_id", "score"])

    def round_of(queries: DataFrame, second: bool) -> DataFrame:
        ask = queries.select("vec_id", "vec", "least", F.lit(second).alias("second")).mapInArrow(route, "vec_id long, vec array<double>, least double, cells array<int>").withColumn("cell", F.explode("cells"))
        ask = ask.select("cell", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(1).alias("kind"), "vec_id", F.xxhash64("vec").alias("own"), "least", *none(*lean), "vec")
        return rows.union(ask).repartition("cell", "part").sortWithinPartitions("cell", "part", "kind").mapInArrow(visit, "query_id long, own long, vec_id long, score double")

    def best(found: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("query_id", "own").orderBy(F.col("score").desc(), "vec_id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= top)

    lowest = F.lit(float("-inf"))
    found = cut(best(round_of(asked.withColumn("least", lowest), False)).drop("rank"))
    if first < len(centre):
        least = found.groupBy("query_id", "own").agg(F.when(F.count("*") >= top, F.min("score")).otherwise(lowest).alias("least"))
        again = asked.withColumns({"query_id": F.col("vec_id"), "own": F.xxhash64("vec")}).join(least, ["query_id", "own"], "left").withColumn("least", F.coalesce("least", lowest))
        found = found.union(round_of(again, True))
    return best(found).select("query_id", "rank", "vec_id", "score")


def search(vectors: DataFrame, queries: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", top: int = TOP, keep: int = KEEP) -> DataFrame:
    """(query_id, rank, vec_id, score): of each row of queries, the top rows of vectors by cosine, its own id left out."""
    spark = vectors.sparkSession
    tune(spark)
    base, asked = usable(vectors, id_col, vec_col), usable(queries, id_col, vec_col).dropDuplicates(["vec_id", "vec"])
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for size, count in sorted(base.groupBy(F.size("vec")).count().collect()):
        out = out.union(_search(base.where(F.size("vec") == size), asked.where(F.size("vec") == size), count, top, keep))
    return out


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    return search(rows, rows.where(F.col("vec_id") % 50 == 0))
