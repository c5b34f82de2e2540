"""Page audit: text that is lost, invented or repeated, page by page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import patterns as P
from ..functions.text import content_amount, letters, strip

KINDS = ["repeated", "missing", "extra", "empty", "sparse"]


def units(body: Column) -> Column:
    """A page's sentences and lines in one form, those with enough letters."""
    flat = F.transform(F.split(body, P.UNIT_J, -1), lambda u: F.lower(strip(F.regexp_replace(u, f"{P.BLANK_J}+", " "))))
    return F.filter(flat, lambda u: letters(u) >= P.LOOP_LETTERS)


def repetition(pages: DataFrame) -> DataFrame:
    """page columns with unit and times of pages stuck in a loop: the most frequent unit (first seen of equals) comes at least four times and is 30 % of the text."""
    keys = [c for c in pages.columns if c != "body"]
    u = pages.select(*keys, F.posexplode(units(F.col("body"))).alias("at", "unit"))
    each = u.groupBy(*keys, "unit").agg(F.count("*").alias("times"), F.min("at").alias("first"), F.sum(F.char_length("unit")).alias("own"))
    page = each.groupBy(*keys).agg(F.max_by(F.struct("unit", "times"), F.struct("times", -F.col("first"))).alias("top"), F.sum("own").alias("total"))
    part, of = P.LOOP_SHARE
    return page.where((F.col("top.times") >= P.LOOP_TIMES) & (of * F.col("top.times") * F.char_length("top.unit") >= part * F.col("total"))).select(*keys, "top.unit", "top.times")


def page_issues(pages: DataFrame, witness: DataFrame | None = None) -> DataFrame:
    """(doc_id, seq, page_no, kind, detail, strong).

    witness (doc_id, page_no, layer_text, ink): a page's text in the source, and how
    dark it is. A long enough layer is compared; else a page with ink and no text is
    empty, and one with far less text for its ink than the document's median is
    sparse. Without witness only loops are found; nor is a document without page
    marks (marked, if pages have that column) compared: its text is no single page's.
    Issues have a place (ord) in their document: by page, kinds in a fixed order.
    """
    loops = repetition(pages.select("doc_id", "seq", "page_no", "body")).select("doc_id", "seq", "page_no", F.lit("repeated").alias("kind"), F.concat(F.lit("the same text appears "), F.col("times").cast("string"), F.lit(" times: "), F.substring("unit", 1, 40)).alias("detail"), F.lit(True).alias("strong"))
    if witness is None:
        return _ordered(loops)
    w = (pages.where("marked") if "marked" in pages.columns else pages).join(witness, ["doc_id", "page_no"]).select("doc_id", "seq", "page_no", content_amount(F.col("body")).alias("got"), content_amount(F.coalesce("layer_text", F.lit(""))).alias("expected"), F.coalesce("ink", F.lit(0.0)).alias("ink"))
    plain = (F.col("expected") < P.WITNESS) & (F.col("ink") >= P.INK)
    w = w.withColumn("rate", F.when(plain & (F.col("got") >= P.EMPTY), F.col("got") / F.col("ink")))
    doc = Window.partitionBy("doc_id")
    w = w.withColumn("usual", F.median("rate").over(doc)).withColumn("n", F.count("rate").over(doc))
    short, long = ((of * F.col("got"), part * F.col("expected")) for part, of in (P.SHORT, P.LONG))
    kind = (
        F.when((F.col("expected") >= P.WITNESS) & (short[0] < short[1]), "missing").when((F.col("expected") >= P.WITNESS) & (long[0] > long[1]), "extra")
        .when(plain & (F.col("got") < P.EMPTY), "empty").when((F.col("n") >= P.SPARSE_PAGES) & (F.col("rate") < P.SPARSE * F.col("usual")), "sparse")
    )
    found = w.withColumn("kind", kind).where("kind is not null")
    amount = F.concat(F.col("got").cast("string"), F.lit(" letters where the source has "), F.col("expected").cast("string"))
    detail = F.when(F.col("kind").isin("missing", "extra"), amount).when(F.col("kind") == "empty", "no text, but the page is not blank").otherwise(F.concat(F.col("got").cast("string"), F.lit(" letters, far fewer than this much ink carries elsewhere")))
    return _ordered(loops.unionByName(found.select("doc_id", "seq", "page_no", "kind", detail.alias("detail"), F.col("kind").isin("missing", "extra").alias("strong"))))


def _ordered(issues: DataFrame) -> DataFrame:
    place = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    return issues.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("page_no", "seq", place)))


def summary(issues: DataFrame, limit: int = 6) -> DataFrame:
    """(doc_id, strong, weak, shown): counts, and the first issues, strong ones first."""
    order = F.struct((~F.col("strong")).alias("weak"), "page_no", F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).alias("k"))
    listed = F.sort_array(F.collect_list(F.struct(order.alias("o"), F.concat(F.lit("page "), F.col("page_no").cast("string"), F.lit(": "), F.col("detail")).alias("t"))))
    s = issues.groupBy("doc_id").agg(F.count_if("strong").alias("strong"), F.count_if(~F.col("strong")).alias("weak"), listed.alias("all"))
    return s.select("doc_id", "strong", "weak", F.array_join(F.transform(F.slice("all", 1, limit), lambda x: x["t"]), "; ").alias("shown"))

