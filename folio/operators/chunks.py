"""Chunked work that can be resumed: plan, what is pending, and joining what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import patterns as P
from ..functions.text import chunk_anchors, chunk_name, strip
from .pages import in_order


def plan_chunks(documents: DataFrame, size: int = P.CHUNK_PAGES) -> DataFrame:
    """(doc_id, total_pages) to (doc_id, first, last): runs of so many pages, the last clipped."""
    d = documents.where("total_pages > 0")
    starts = F.explode(F.sequence(F.lit(0), F.col("total_pages").cast("int") - 1, F.lit(size)))
    return d.select("doc_id", "total_pages", starts.alias("first")).select("doc_id", "first", F.least(F.col("first") + size - 1, F.col("total_pages").cast("int") - 1).alias("last"))


def pending_chunks(plan: DataFrame, written: DataFrame, resume: bool = True) -> DataFrame:
    """What of a plan is not written yet (all of it if not to be resumed)."""
    return plan.join(written.select("doc_id", "first", "last"), ["doc_id", "first", "last"], "left_anti") if resume else plan


def missing_chunks(plan: DataFrame, written: DataFrame) -> DataFrame:
    """(doc_id, missing): the names of chunks that a join lacks."""
    return pending_chunks(plan, written).groupBy("doc_id").agg(in_order(F.col("first"), chunk_name(F.col("first"), F.col("last")), ", ").alias("missing"))


def joined(written: DataFrame, plan: DataFrame) -> DataFrame:
    """Every document of a plan: (doc_id, text, missing): its chunks joined, or null and the names of the chunks that it lacks."""
    lacking = missing_chunks(plan, written)
    texts = concatenate(written.join(plan, ["doc_id", "first", "last"], "left_semi"))
    d = plan.select("doc_id").distinct().join(lacking, "doc_id", "left").join(texts, "doc_id", "left")
    return d.select("doc_id", F.when(F.col("missing").isNull(), F.col("text")).alias("text"), "missing")


def concatenate(written: DataFrame, plan: DataFrame | None = None) -> DataFrame:
    """chunk (doc_id, first, last, text) to document, in page order, link targets prefixed. With a plan only its chunks; a document that lacks one is an error when its row is read."""
    if plan is not None:
        why = F.concat(F.lit("document "), F.col("doc_id").cast("string"), F.lit(" lacks chunks: "), F.col("missing"))
        return joined(written, plan).select("doc_id", F.when(F.col("missing").isNull(), F.col("text")).otherwise(F.raise_error(why).cast("string")).alias("text"))
    text = chunk_anchors(strip(F.col("text")), F.col("first"))
    return written.groupBy("doc_id").agg(F.concat(in_order(F.struct("first", "last"), text, "\n\n"), F.lit("\n")).alias("text"))
