"""A corpus pipeline of five stages over documents.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept
and returns a DataFrame; run() writes it as Parquet in the shared folder and reads
it again for the next. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from folio.llm import op1_language, op3_simhash, op5_mix, op6_toxicity, op8_bpe
from folio.llm.common import fresh, plain, read, scratch, tune


def _written(df: DataFrame, what: str) -> DataFrame:
    """Written and reread, so that its size is known: Spark broadcasts it only if it is small."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told: not those without letters (nulls, empty texts), in no language known, or undecided. Decided for each id and text, so rows with clashing or null ids are judged by their own text, and repeated rows share their fate. An empty table stays empty; where no row has a language nothing is known and all go."""
    rows = docs.select(F.struct("doc_id", _hash().alias("h")).alias("key"), "text", "lang", "source")
    found = op1_language.identify_documents(rows, op1_language.fit(docs), id_col="key")
    rejected = _written(found.where(~F.col("accepted")).select(F.col("id.doc_id").alias("r"), F.col("id.h").alias("h")).distinct(), "language")
    return docs.join(rejected, docs["doc_id"].eqNullSafe(rejected["r"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == rejected["h"]), "left_anti")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the calibrated score does not call toxic; null texts count as empty, equal texts share their fate, an empty table stays empty, further columns stay whatever their names."""
    tune(spark)
    model = op6_toxicity.fit(plain(docs), read(spark, sf_dir, "labels"))
    score, predicted = fresh(docs.columns, "score", "predicted")
    return op6_toxicity.scored(docs, model, score=score, predicted=predicted).where(F.col(predicted) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each group of near duplicates (five-word shingles, similarity 0.8): that of the smallest id, or of the smallest hash where ids are equal or null. Rows with clashing or null ids are judged by their own text; nulls, empty and blank texts are equal. An empty table stays empty."""
    kept = _written(op3_simhash.near_copies(docs).where("kept").groupBy(F.col("doc_id").alias("k"), "h").agg(F.count("*").alias("n")), "kept")
    k, h, n = fresh(docs.columns, "k", "h", "n")
    kept = kept.select(F.col("k").alias(k), F.col("h").alias(h), F.col("n").alias(n))
    same = docs["doc_id"].eqNullSafe(kept[k]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == kept[h])
    # of rows equal in id and text one, the same in each run
    columns = [F.col(f"`{c}`") for c in docs.columns]
    again = docs.join(kept.where(F.col(n) > 1), same).groupBy(k, h).agg(F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias("row"))
    return docs.join(kept.where(F.col(n) == 1), same, "left_semi").union(again.select("row.*"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that sources come near their target weights: a row up to three times, or not at all. Rows without words count nothing, null sources are one source, an empty table stays empty."""
    return op5_mix.mix(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row of the mix; null texts are empty and have no tokens."""
    return op8_bpe.encode(docs, digests=True)


STAGES = [("language", language), ("toxicity", toxicity), ("near_duplicates", near_duplicates), ("mixing", mixing), ("encoding", encoding)]

#: Language, toxicity and byte-pair encoding have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = _written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
