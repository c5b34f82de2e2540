"""Mixing sources to target weights.

Sizes are added up for each source; target sizes share the sum of all sizes by
weight, none above a multiple of its source's size, and what that leaves over
goes to the others by weight until none is above. A source's repetition rate is
target / size; a document is emitted floor(rate) times, and once more where a
number drawn from a hash of seed, id, text and occurrence is below the rate's
fraction. Reruns draw alike.

Null or empty texts have size 0; sources without words have target and rate 0;
null sources are one source, the last. Rows with equal or null ids draw by their
own texts. Rows equal in id and text are numbered in the order of their sources,
and each draws by its number (only such rows are shuffled for that).

Only totals reach the driver: the number of sources of each partition of their
sorted list, and a few sums a round. The table of sources is broadcast where its bytes,
which are counted, are few; else it is joined by a shuffle, in which Spark splits
a hot source's documents.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import WORD, cut, fresh, read

#: The table of sources is broadcast if it was counted to have no more bytes; beyond, it is joined by a shuffle.
BROADCAST_BYTES = 8 << 20
WEIGHTS, MOST, SEED = (5, 2, 1), 3, "mix-2"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def digest_of(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def draw(doc_id: Column, digest: Column, occurrence: Column, seed: str = SEED) -> Column:
    """A number from 0 to below 1: 52 bits of SHA-256 of seed, id, digest of the text and occurrence."""
    name = F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), digest, occurrence.cast("string"))
    return F.conv(F.substring(F.sha2(name, 256), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def numbered(rows: DataFrame, doc_id: str, digest: str, source: str, name: str) -> DataFrame:
    """rows with a column `name`: 1, or among rows equal in id and digest their number in the order of sources."""
    again = cut(rows.groupBy(F.col(doc_id).alias("again_id"), F.col(digest).alias("again_digest")).count().where("count > 1").drop("count"))
    if again.isEmpty():
        return rows.withColumn(name, F.lit(1))
    same = rows[doc_id].eqNullSafe(again["again_id"]) & (rows[digest] == again["again_digest"])
    order = Window.partitionBy(doc_id, digest).orderBy(F.col(source).asc_nulls_last())
    return rows.join(again, same, "left_anti").withColumn(name, F.lit(1)).union(rows.join(again, same, "left_semi").withColumn(name, F.row_number().over(order)))


def _ranked(sources: DataFrame) -> DataFrame:
    """sources with place (from 0) in the order of their names, null last; without a task that holds them all."""
    s = cut(sources.orderBy(F.col("source").asc_nulls_last())).withColumn("mid", F.monotonically_increasing_id())
    part = F.shiftright("mid", 33).cast("int")
    offsets, before = [], 0
    for p, n in sorted(s.groupBy(part.alias("p")).count().collect()):  # one row a partition
        offsets += [F.lit(p), F.lit(before)]
        before += n
    if not offsets:
        return s.withColumn("place", F.lit(0).cast("long")).drop("mid")
    return s.withColumn("place", F.element_at(F.create_map(*offsets), part) + F.col("mid").bitwiseAND(F.lit((1 << 33) - 1))).drop("mid")


def targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST) -> DataFrame:
    """sources (source, source_size) with target. Weights repeat along the sources in the order of their names; most: the highest rate."""
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    s = cut(_ranked(sources.groupBy("source").agg(F.sum("source_size").alias("source_size"))).select("source", "source_size", w.alias("weight")))
    total, held = s.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum(F.octet_length(F.coalesce("source", F.lit(""))) + 64), F.lit(0))).first()
    size = F.col("source_size")
    left, share, last = float(total), None, None
    while True:  # the level rises, and with it the sources that are full; in practice a few rounds
        full = F.lit(False) if share is None else size * most * share < F.col("weight") * left
        filled, rest = s.agg(F.coalesce(F.sum(F.when(full, size * most)), F.lit(0)).cast("double"), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)).cast("double")).first()
        if (filled, rest) == last or not rest:
            break
        last, left, share = (filled, rest), total - filled, rest
    out = s.select("source", "source_size", F.when(full | F.lit(not rest), (size * most).cast("double")).otherwise(F.col("weight") * F.lit(left) / F.lit(share or 1.0)).alias("target"))
    return F.broadcast(out) if held <= BROADCAST_BYTES else out


def plan(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, times): how often the mix takes each document."""
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size_of(F.col(text_col)).alias("size"), digest_of(F.col(text_col)).alias("digest"))
    goal = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most).withColumnRenamed("source", "name")
    rows = numbered(sized, "doc_id", "digest", "source", "occurrence")
    u = draw(F.col("doc_id"), F.col("digest"), F.col("occurrence"), seed)
    return rows.join(goal, F.col("source").eqNullSafe(F.col("name"))).select("doc_id", "source", "size", "source_size", "target", _times(_rate(F.col("target"), F.col("source_size")), u).alias("times"))


def _rate(target: Column, size: Column) -> Column:
    return F.when(size > 0, target / size).otherwise(0.0)


def _times(rate: Column, u: Column) -> Column:
    return (F.floor(rate) + F.when(u < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED) -> DataFrame:
    """The mixed corpus: rows of docs, each as often as the plan says, with all columns of docs, whatever their names."""
    sized = docs.select(F.col(source_col).alias("source"), size_of(F.col(text_col)).alias("size"))
    goal = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    name, rate, digest, occurrence, copy = fresh(docs.columns, "name", "rate", "digest", "occurrence", "copy")
    goal = goal.select(F.col("source").alias(name), _rate(F.col("target"), F.col("source_size")).alias(rate))
    rows = numbered(docs.withColumn(digest, digest_of(F.col(text_col))), id_col, digest, source_col, occurrence)
    times = _times(F.col(rate), draw(F.col(id_col), F.col(digest), F.col(occurrence), seed)).cast("int")
    rows = rows.join(goal, F.col(source_col).eqNullSafe(F.col(name))).withColumn(copy, F.explode(F.array_repeat(F.lit(0), times)))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = plan(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"))


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(coalesce(text, '')) AS digest,
    row_number() OVER (PARTITION BY doc_id, md5(coalesce(text, '')) ORDER BY source NULLS LAST) AS occurrence FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT source, source_size, CAST([5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT) + 1] AS DOUBLE) AS w FROM sources
), ordered AS (
  SELECT *, row_number() OVER o AS k,
    CAST(coalesce(sum(3 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS filled,
    sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share,
    CAST(sum(source_size) OVER () AS DOUBLE) AS total
  FROM weighed WINDOW o AS (ORDER BY source_size / w, source NULLS LAST)
), edge AS (
  SELECT min(k) AS k, arg_min(total - filled, k) AS rest, arg_min(share, k) AS share FROM ordered WHERE 3 * source_size * share >= w * (total - filled)
), goal AS (
  SELECT source, source_size, CASE WHEN edge.k IS NULL OR ordered.k < edge.k THEN CAST(3 * source_size AS DOUBLE) ELSE w * rest / edge.share END AS target FROM ordered, edge
), drawn AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
    CAST(CAST('0x' || substr(sha256('mix-2:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || digest || ':' || CAST(occurrence AS VARCHAR)), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u
  FROM sized JOIN goal ON sized.source IS NOT DISTINCT FROM goal.source
)
SELECT doc_id, size, source_size, target, CAST(floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) * size AS taken FROM drawn
"""
