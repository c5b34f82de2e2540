"""Refinement of paginated documents: learn from the whole document, apply page by page, then across pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..lineage import cut
from ..operators import heads as _heads, pagework as w
from ..operators.pages import assemble, explode_pages

COUNTERS = ["chars_cleaned", "heads_removed", "hyphens_joined", "hyphens_kept", "lines_joined", "headings_levelled", "headings_promoted", "links_tidied", "notes_numbered", "pages_bridged", "links_unlinked"]


def refine_pages(
    docs: DataFrame, outline: DataFrame | None = None, *, heads: bool = True, margins: bool = False, footnotes: bool = True, hyphens: bool = True, reflow: bool = True, bridge: bool = True, clean: bool = True, links: bool = True
) -> DataFrame:
    """document (doc_id, text) to refined pages, with a counter for each step that was on. The order of the steps matters: hyphens before reflow, reflow before notes, unlinking last."""
    d = w.clean_characters(docs.select("doc_id", "text")) if clean else docs.select("doc_id", "text").withColumn("chars_cleaned", F.lit(0))
    d = cut(d)
    vocab = w.vocabulary(d)
    # a document's count is that of its first page
    pages = cut(explode_pages(d, also=["chars_cleaned"]).withColumn("chars_cleaned", F.when(F.col("seq") == 0, F.col("chars_cleaned")).otherwise(0)))
    if hyphens or bridge:
        vocab = cut(vocab)
    if heads:
        pages = cut(_heads.strip_heads(pages))
    if margins:
        pages = w.margin_numbers(pages)
    if hyphens:
        pages = w.join_hyphens(pages, vocab)
    if reflow:
        pages = w.reflow(pages)
    if outline is not None:
        pages = w.apply_outline(cut(pages), outline)
    if links:
        pages = w.tidy_links(pages)
    if footnotes:
        pages = w.number_notes(pages)
    pages = w.stripped(pages)
    if bridge:
        pages = w.bridge_pages(pages, vocab, hyphens)
    if links:
        pages = w.unlink_dangling(cut(pages))
    return pages


def refine(docs: DataFrame, outline: DataFrame | None = None, **switches: bool) -> DataFrame:
    """document to refined document."""
    return assemble(refine_pages(docs, outline, **switches))


def refine_stats(pages: DataFrame) -> DataFrame:
    """A row for each document: its pages and the sums of the counters that refine_pages left."""
    have = [c for c in COUNTERS if c in pages.columns]
    extra = [F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("seq", "margins"))), lambda x: x["margins"])).alias("margin_sequence")] if "margins" in pages.columns else []
    return pages.groupBy("doc_id").agg(F.count("*").alias("pages"), *[F.sum(c).alias(c) for c in have], *extra)


def sequence_breaks(stats: DataFrame) -> DataFrame:
    """(doc_id, before, after): margin numbers that do not follow each other."""
    s = F.col("margin_sequence")
    pairs = F.zip_with(F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))), F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("before"), b.alias("after")))
    return stats.select("doc_id", F.inline(F.filter(pairs, lambda p: p["after"] != p["before"] + 1)))
