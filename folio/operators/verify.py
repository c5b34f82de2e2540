"""Document checks: a finding (doc_id, ord, name, ok, detail) for each."""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions import patterns as P
from ..functions.text import filled
from .audit import page_issues, summary
from .pages import explode_pages, sampled


@F.pandas_udf(T.DoubleType())
def likeness(layer: pd.Series, body: pd.Series) -> pd.Series:
    """Ratio of matching characters, as the standard library's difflib defines it; the order of the operands matters."""

    def flat(s: str) -> str:
        return re.sub(r"\s+", " ", s).strip().lower()

    return pd.Series([difflib.SequenceMatcher(None, flat(a), flat(b)[: P.SIMILAR_MOST]).ratio() for a, b in zip(layer, body)], dtype="float64")


def embedded_similarity(pages: DataFrame, layers: DataFrame) -> DataFrame:
    """(doc_id, compared, similarity): mean likeness of sampled pages to the source's own text layer (doc_id, page_no, layer_text)."""
    some = sampled(pages.where(filled(F.col("body"))), "seq", P.SIMILAR_PAGES).join(layers, ["doc_id", "page_no"])
    flat = F.trim(F.regexp_replace("layer_text", f"{P.BLANK_J}+", " "))
    return some.where(F.char_length(flat) >= P.SIMILAR_TEXT).select("doc_id", likeness("layer_text", "body").alias("r")).groupBy("doc_id").agg(F.count("*").alias("compared"), F.avg("r").alias("similarity"))


def stale_markers(docs: DataFrame, markers: list[str] = P.STALE) -> DataFrame:
    """fresh OCR: none of the known artefacts of an old text layer occurs."""
    hits = F.filter(F.array(*map(F.lit, markers)), lambda m: F.contains(F.lower("text"), F.lower(m)))
    return docs.select("doc_id", F.lit(0).alias("ord"), F.lit("fresh OCR").alias("name"), (F.size(hits) == 0).alias("ok"), F.concat(F.lit("artefacts: "), F.array_join(hits, ", ")).alias("detail"))


def content_checks(docs: DataFrame, expect: tuple[str, ...] = ()) -> DataFrame:
    """word spacing, greek, italics, footnotes. The last three fail only where they are expected and there are none."""
    checks = [(2, "word spacing", P.RUN_ON_J, "run-on words"), (3, "greek", P.GREEK_J, "Greek runs"), (4, "italics", P.ITALIC_J, "italic spans"), (5, "footnotes", P.FOOTNOTE_J, "footnote markers")]
    rows = []
    for order, name, pattern, noun in checks:
        n = F.regexp_count("text", F.lit(pattern))
        ok = n <= P.RUN_ONS if order == 2 else (n > 0) | F.lit(name not in expect)
        rows.append(F.struct(F.lit(order).alias("ord"), F.lit(name).alias("name"), ok.alias("ok"), F.concat(n.cast("string"), F.lit(f" {noun}")).alias("detail")))
    return docs.select("doc_id", F.inline(F.array(*rows)))


def page_check(docs: DataFrame, witness: DataFrame | None = None, pages: DataFrame | None = None) -> DataFrame:
    """page audit: no page has a strong issue."""
    issues = summary(page_issues(explode_pages(docs, marked=True) if pages is None else pages, witness))
    detail = F.when(F.col("shown").isNull(), "no page looks incomplete or repeated").otherwise(F.concat(F.col("strong").cast("string"), F.lit(" lost or repeated, "), F.col("weak").cast("string"), F.lit(" worth a look: "), F.col("shown")))
    return docs.select("doc_id").join(issues, "doc_id", "left").select("doc_id", F.lit(1).alias("ord"), F.lit("page audit").alias("name"), (F.coalesce("strong", F.lit(0)) == 0).alias("ok"), detail.alias("detail"))


def findings(docs: DataFrame, witness: DataFrame | None = None, *, markers: list[str] = P.STALE, expect: tuple[str, ...] = (), fresh_ocr: bool = True) -> DataFrame:
    """All checks of documents, in order (ord). With a witness freshness is judged by likeness to its layer, else by known artefacts."""
    parts = [page_check(docs, witness), content_checks(docs, expect)]
    if fresh_ocr and witness is not None:
        s = docs.select("doc_id").join(embedded_similarity(explode_pages(docs), witness), "doc_id", "left")
        detail = F.when(F.col("compared").isNull(), "no embedded text to compare with").otherwise(F.format_string("%.0f%% similar over %d pages", F.col("similarity") * 100, "compared"))
        parts.insert(0, s.select("doc_id", F.lit(0).alias("ord"), F.lit("fresh OCR").alias("name"), ~F.coalesce(F.col("similarity") > P.SIMILAR, F.lit(False)), detail.alias("detail")).toDF("doc_id", "ord", "name", "ok", "detail"))
    elif fresh_ocr:
        parts.insert(0, stale_markers(docs, markers))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
