"""Documents, pages and lines.

Tables: document (doc_id, text), page (doc_id, seq, page_no, body), line (doc_id,
line_no, text, page_no, level, is_anchor). A page's place in its document is seq;
page_no may repeat (a preamble is page 0).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import patterns as P
from ..functions.text import filled, strip


def explode_pages(docs: DataFrame, *, marked: bool = False, also: Sequence[str] = ()) -> DataFrame:
    """document to page: text between page marks, unstripped; what stands before the first mark, stripped, is page 0 unless blank; without marks the text is page 0. With marked, a column says whether the document has marks; also: columns of the document that its pages have, too."""
    mark = F.lit(P.PAGE_MARK_J)
    first, second = (F.regexp_extract_all("text", mark, F.lit(k)) for k in (1, 2))
    d = docs.select("doc_id", "text", *also, F.zip_with(first, second, lambda a, b: F.when(a != "", a).otherwise(b).cast("int")).alias("numbers"), F.split("text", P.PAGE_MARK_J, -1).alias("parts"))
    after = F.zip_with("numbers", F.slice("parts", 2, F.size("parts")), lambda n, b: F.struct(n.alias("page_no"), b.alias("body")))
    opening = strip(F.col("parts")[0])
    whole = F.array(F.struct(F.lit(0).alias("page_no"), F.col("text").alias("body")))
    before = F.array(F.struct(F.lit(0).alias("page_no"), opening.alias("body")))
    pages = F.when(F.size("numbers") == 0, whole).when(opening != "", F.concat(before, after)).otherwise(after)
    more = [*also, *([(F.size("numbers") > 0).alias("marked")] if marked else [])]
    d = d.select("doc_id", *more, F.posexplode(pages).alias("seq", "page"))
    return d.select("doc_id", "seq", "page.page_no", "page.body", *also, *(["marked"] if marked else []))


def anchor(page_no: Column) -> Column:
    return F.concat(F.lit("<!-- page "), page_no.cast("string"), F.lit(" -->"))


def separator(page_no: Column) -> Column:
    return F.concat(F.lit("{"), page_no.cast("string"), F.lit("}" + "-" * P.DASHES))


def in_order(order: Column, text: Column, between: str) -> Column:
    """Aggregate: texts of a group in order, joined; null texts are left out."""
    rows = F.sort_array(F.collect_list(F.when(text.isNotNull(), F.struct(order.alias("o"), text.alias("t")))))
    return F.array_join(F.transform(rows, lambda r: r["t"]), between)


def assemble(pages: DataFrame) -> DataFrame:
    """page to document: an anchor above each page; pages without text go, runs of blank lines become one."""
    shown = F.when(F.col("body") != "", F.concat(anchor(F.col("page_no")), F.lit("\n\n"), F.col("body")))
    return pages.groupBy("doc_id").agg(F.regexp_replace(in_order(F.col("seq"), shown, "\n\n"), r"\n{3,}", "\n\n").alias("text"))


def paginate(pages: DataFrame) -> DataFrame:
    """page to raw document: a separator above each page, also above those without text, so that numbers stay right."""
    shown = F.concat(separator(F.col("page_no")), F.lit("\n\n"), strip(F.coalesce("body", F.lit(""))))
    return pages.groupBy("doc_id").agg(F.concat(in_order(F.col("seq"), shown, "\n\n"), F.lit("\n")).alias("text"))


def split_lines(text: Column) -> Column:
    """Lines by Python's line ends; a last line end ends the last line."""
    return F.split(F.regexp_replace(text, f"(?:{P.SPLITLINES_J})\\z", ""), P.SPLITLINES_J, -1)


def explode_lines(docs: DataFrame, *, slim: bool = False) -> DataFrame:
    """document to line, by Python's line ends. A line's page is that of the last anchor at or above it, its level that of a heading; neither counts between code fences. With slim, only what may be a heading keeps its text, and columns say how long a line is without outer white space (length) and whether it has ink (inked)."""
    rows = docs.select("doc_id", F.posexplode(split_lines(F.col("text"))).alias("line_no", "text")).where("text <> '' or line_no > 0")
    here = Window.partitionBy("doc_id").orderBy("line_no")
    hashes = F.char_length(F.regexp_extract("text", P.HEADING_J, 1))
    of_line = {"fence": F.col("text").rlike(P.FENCE_J).cast("int"), "number": F.regexp_extract("text", P.PAGE_ANCHOR_J, 1), "hashes": hashes}
    more = {"length": F.char_length(strip(F.col("text"))), "inked": filled(F.col("text"))} if slim else {}
    rows = rows.select("doc_id", "line_no", F.when(hashes > 0, F.col("text")).alias("text") if slim else "text", *[c.alias(n) for n, c in (of_line | more).items()])
    rows = rows.withColumn("inside", F.sum("fence").over(here.rowsBetween(Window.unboundedPreceding, 0)) % 2 == 1)
    rows = rows.withColumn("own", F.when(~F.col("inside") & (F.col("number") != ""), F.col("number").cast("int")))
    return rows.select(
        "doc_id", "line_no", "text", F.last("own", ignorenulls=True).over(here.rowsBetween(Window.unboundedPreceding, 0)).alias("page_no"),
        F.when(~F.col("inside") & F.col("own").isNull(), F.col("hashes")).otherwise(0).alias("level"), F.col("own").isNotNull().alias("is_anchor"), *more,
    )


def edge_lines(pages: DataFrame) -> DataFrame:
    """(doc_id, seq, line_no, text, outer): lines of a page that are among its first or last two with ink; outer: the very first and last. pages_inked: how many it has."""
    numbered = F.filter(F.transform(F.split("body", "\n", -1), lambda t, i: F.struct(i.alias("line_no"), t.alias("text"))), lambda x: filled(x["text"]))
    p = pages.select("doc_id", "seq", numbered.alias("ink")).where(F.size("ink") > 0).withColumn("n", F.size("ink"))
    place = F.transform("ink", lambda x, i: F.struct(x["line_no"].alias("line_no"), x["text"].alias("text"), ((i == 0) | (i == F.col("n") - 1)).alias("outer"), ((i < P.HEAD_EDGE) | (i >= F.col("n") - P.HEAD_EDGE)).alias("edge")))
    return p.select("doc_id", "seq", "n", F.inline(F.filter(place, lambda x: x["edge"]))).select("doc_id", "seq", F.col("n").alias("inked"), "line_no", "text", "outer")


def sampled(rows: DataFrame, order: str, most: int) -> DataFrame:
    """At most so many rows of each doc_id, evenly spaced in the given order: every step-th from the first, step = max(1, rows div most)."""
    n = F.count("*").over(Window.partitionBy("doc_id"))
    at = F.row_number().over(Window.partitionBy("doc_id").orderBy(order)) - 1
    r = rows.withColumn("__n", n).withColumn("__at", at).withColumn("__step", F.greatest(F.lit(1), F.floor(F.col("__n") / most)))
    return r.where((F.col("__at") % F.col("__step") == 0) & (F.col("__at") / F.col("__step") < most)).drop("__n", "__at", "__step")
