"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch retains every hash below a fixed fraction of the hash range, one in
SCALE, of the five-word shingles of a text in lower case, and its LEAST smallest
hashes in any case, so that short texts keep all they have. So the sketch of a
union of texts follows from their sketches (:func:`merged`). The share of a sketch
found in another, counted up to where both are complete, estimates the containment
of the one text in the other, however unequal they are. A text of fewer than five
words is one shingle; a text without words has an empty sketch.

Everything is made of built-in functions. Neighbours by id are found without a
task that sees all rows: ids are cut into ranges of about equal numbers of rows
(the range partitioner's sample of the ids gives the bounds, at most RANGES), each
sorted by itself, and the first document of a range is also sent to the range
before it (the very first to the last), where it only serves as the next. A row
finds its range by bisection in the bounds, a literal of at most 20 bytes each.

Null texts are empty. Among equal ids the order is that of the texts. A row with
a null id has itself for its next. One document alone follows itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import plain, read

SHINGLE, SCALE, LEAST = 5, 4, 16
#: Most id ranges, and rows in each where there are fewer.
RANGES, ROWS = 1 << 15, 512


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def hashes_of(words: Column, shingle: int = SHINGLE) -> Column:
    """words: a column of the plan (an attribute), for it is read many times."""
    n = F.size(words)
    many = F.transform(F.sequence(F.lit(0), n - shingle), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(shingle)]))
    one = F.array(F.xxhash64(F.array_join(words, " ")))
    return F.when(n >= shingle, many).when(n > 0, one).otherwise(F.array().cast("array<bigint>"))


def ordered(h: Column) -> Column:
    """A hash as a long whose order is that of the unsigned hashes; and back."""
    return h.bitwiseXOR(F.lit(-(1 << 63)))


def kept(hashes: Column, scale: int = SCALE) -> Column:
    """hashes: a column of the plan, sorted and distinct, as ordered. Those below the threshold, and the LEAST smallest."""
    return F.slice(hashes, 1, F.greatest(F.lit(LEAST), F.size(F.filter(hashes, lambda h: h < bound(scale)))))


def bound(scale: int = SCALE) -> int:
    """Below it every hash is retained."""
    return (1 << 64) // scale - (1 << 63)


def sketched(df: DataFrame, text: str, name: str, *, shingle: int = SHINGLE, scale: int = SCALE) -> DataFrame:
    """df with the sketch of a text column, array<long>, ascending, as ordered."""
    w, h, k = f"__{name}_words", f"__{name}_hashes", f"__{name}_all"
    df = df.withColumn(w, words_of(F.col(text))).withColumn(h, hashes_of(F.col(w), shingle)).withColumn(k, F.sort_array(F.array_distinct(F.transform(h, ordered))))
    return df.withColumn(name, kept(F.col(k), scale)).drop(w, h, k)


def merged(a: Column, b: Column, scale: int = SCALE) -> Column:
    """The sketch of two texts' shingles together, from their sketches."""
    return kept(F.sort_array(F.array_union(a, b)), scale)


def complete(sketch: Column, scale: int = SCALE) -> Column:
    """Up to this hash the sketch has all that its text has."""
    return F.when(F.size(sketch) < LEAST, F.lit((1 << 63) - 1)).otherwise(F.greatest(F.element_at(sketch, -1), F.lit(bound(scale) - 1)))


def containment(a: Column, b: Column, scale: int = SCALE) -> Column:
    """a, b: columns of the plan. Share of sketch a that is in b, up to where both are complete: 1 if both are empty, 0 if only one is or nothing can be compared."""
    upto = F.least(complete(a, scale), complete(b, scale))
    n = F.size(F.filter(a, lambda h: h <= upto))
    both = F.size(F.filter(F.array_intersect(a, b), lambda h: h <= upto))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when(n > 0, both / n).otherwise(0.0)


def fingerprint(sketch: Column) -> Column:
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.lower(F.hex(ordered(h))), 16, "0")), "")


def bounds(docs: DataFrame) -> list[int]:
    """The first ids of ranges of about equal numbers of rows, ascending: at most RANGES numbers."""
    ids = docs.select("doc_id").where("doc_id is not null")
    ranges = min(RANGES, -(-ids.count() // ROWS))
    if not ranges:
        return []
    found = ids.repartitionByRange(ranges, "doc_id").groupBy(F.spark_partition_id().alias("p")).agg(F.min("doc_id").alias("first"))
    return sorted(r["first"] for r in found.collect())


def with_ranges(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with range and ghost: rows that only serve as the next of a range's last have ghost true."""
    alone = (-1 - F.pmod(F.xxhash64("text"), F.lit(1024))).cast("int")
    firsts = bounds(docs)
    if not firsts:
        return docs.select("*", alone.alias("range"), F.lit(False).alias("ghost"))
    table = F.split(F.lit(",".join(map(str, firsts))), ",").cast("array<bigint>")  # folded to a literal
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(firsts).bit_length()))])
    # the number of bounds that are not above the id
    own = F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= len(firsts)) & (F.get(table, at + step - 1) <= F.col("doc_id")), at + step).otherwise(at)) - 1
    placed = docs.withColumn("own", F.coalesce(F.when(F.col("doc_id").isNotNull(), own), alone)).withColumn("first", F.when(F.col("doc_id").isNotNull(), F.get(table, F.col("own"))))
    here = F.struct(F.col("own").alias("range"), F.lit(False).alias("ghost"))
    there = F.struct(F.when(F.col("own") == 0, len(firsts) - 1).otherwise(F.col("own") - 1).alias("range"), F.lit(True).alias("ghost"))
    return placed.select("doc_id", "text", F.inline(F.when(F.col("doc_id") == F.col("first"), F.array(here, there)).otherwise(F.array(here))))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, next_text, sketch, next_sketch)."""
    order = Window.partitionBy("range").orderBy("ghost", "doc_id", "text")
    rows = with_ranges(plain(docs, id_col, text_col)).withColumn("next_text", F.lead("text").over(order))
    rows = sketched(rows, "text", "sketch").withColumn("next_sketch", F.lead("sketch").over(order)).where(~F.col("ghost"))
    alone = F.col("doc_id").isNull()
    return rows.select("doc_id", "text", F.when(alone, F.col("text")).otherwise(F.col("next_text")).alias("next_text"), "sketch", F.when(alone, F.col("sketch")).otherwise(F.col("next_sketch")).alias("next_sketch"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_next(read(spark, sf_dir, "documents")).withColumn("n_chars", F.char_length("text").cast("long"))
    part = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - part), F.substring(F.col("next_text"), F.lit(1), part))
    rows = sketched(rows.withColumn("edited", edited), "edited", "edited_sketch")
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("sketch")).alias("fingerprint"), fingerprint(F.col("edited_sketch")).alias("edited_fingerprint"),
        containment(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), containment(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
