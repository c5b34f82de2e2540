"""Running heads, learned from repetition at the edges of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import patterns as P
from ..functions.text import head_form, head_like, local_head_like
from .pages import edge_lines


def running_heads(pages: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """(doc_id, form, n): forms at the edges of at least 30 % of a document's pages, and of 4; each once a page."""
    edges = edge_lines(pages) if edges is None else edges
    total = pages.groupBy("doc_id").agg(F.count("*").alias("pages"))
    seen = edges.where(head_like(F.col("text"))).select("doc_id", "seq", head_form(F.col("text")).alias("form")).where("form <> ''").distinct()
    counted = seen.groupBy("doc_id", "form").agg(F.count("*").alias("n")).join(total, "doc_id")
    least = F.greatest(F.lit(P.HEAD_PAGES), F.floor(F.col("pages") * F.lit(P.HEAD_SHARE)))
    return counted.where((F.col("pages") >= P.HEAD_PAGES) & (F.col("n") >= least)).select("doc_id", "form", "n")


def local_heads(pages: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """(doc_id, seq, form): forms of the very first or last line that repeat on at least three pages in a row, each at most two after the one before. Islands of sequence numbers, found by windows."""
    edges = edge_lines(pages) if edges is None else edges
    hits = edges.where(F.col("outer") & (F.col("inked") >= 2) & local_head_like(F.col("text")))
    # two lines of one page can have one form; the same line counts once
    hits = hits.select("doc_id", "seq", F.col("text").alias("line"), head_form(F.col("text")).alias("form")).where("form <> ''").distinct()
    run = Window.partitionBy("doc_id", "form").orderBy("seq", "line")
    broken = F.coalesce(F.col("seq") - F.lag("seq").over(run) > P.HEAD_GAP, F.lit(True))
    hits = hits.withColumn("island", F.sum(broken.cast("int")).over(run))
    long = F.count("*").over(Window.partitionBy("doc_id", "form", "island")) >= P.HEAD_RUN
    return hits.withColumn("long", long).where("long").select("doc_id", "seq", "form").distinct()


def head_lines(pages: DataFrame) -> DataFrame:
    """(doc_id, seq, line_no): lines to be removed. Of the lines with one form that are headings, the first is kept: it is the title."""
    edges = edge_lines(pages)
    e = edges.withColumn("form", head_form(F.col("text")))
    whole = running_heads(pages, edges).select("doc_id", "form", F.lit(True).alias("whole"))
    local = local_heads(pages, edges).select("doc_id", "seq", "form", F.lit(True).alias("local"))
    e = e.join(whole, ["doc_id", "form"], "left").join(local, ["doc_id", "seq", "form"], "left")
    is_head = (F.col("whole").isNotNull() & head_like(F.col("text"))) | (F.col("local").isNotNull() & F.col("outer") & local_head_like(F.col("text")))
    e = e.where(is_head).withColumn("heading", F.ltrim("text").startswith("#"))
    rank = F.row_number().over(Window.partitionBy("doc_id", "form", "heading").orderBy("seq", "line_no"))
    return e.withColumn("rank", rank).where(~F.col("heading") | (F.col("rank") > 1)).select("doc_id", "seq", "line_no")


def strip_heads(pages: DataFrame) -> DataFrame:
    """page without its running heads, and how many lines went (heads_removed)."""
    gone = head_lines(pages).groupBy("doc_id", "seq").agg(F.collect_set("line_no").alias("gone"))
    p = pages.join(gone, ["doc_id", "seq"], "left")
    kept = F.array_join(F.filter(F.split("body", "\n", -1), lambda t, i: ~F.array_contains("gone", i)), "\n")
    return p.withColumns({"body": F.when(F.col("gone").isNull(), F.col("body")).otherwise(kept), "heads_removed": F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone"))}).drop("gone")
