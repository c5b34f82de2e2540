"""Inspection of sources before reading: spreads, gutters, text layers, and what to do.

Tables: spread (doc_id, src_page, width, height, ink array<long>), one number for each
pixel column; doc_probe (doc_id, page_no, layer_text, max_image_coverage, producer).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import patterns as P
from ..functions.text import human_seconds
from .pages import sampled


def gutters(spreads: DataFrame) -> DataFrame:
    """spread with gutter and band, as shares of the width: centre and width of the widest blank strip in the middle, over which narrow dark strips (folds) are bridged; 0.5 and 0 without any.

    Blank is what has at most 5 % of the ink of the 95th percentile column. Two
    rounds of gaps and islands over the columns in the middle of each page.
    """
    low, high = P.SEARCH
    s = spreads.withColumn("n", F.size("ink"))
    key = ["doc_id", "src_page"]
    columns = s.select(*key, "n", F.posexplode("ink").alias("x", "v"))
    floor = columns.groupBy(*key).agg((F.percentile("v", F.lit(0.95)) * P.BLANK_COLUMN).alias("floor"))
    middle = columns.join(floor, key).where((F.col("x") >= F.floor(F.col("n") * F.lit(low))) & (F.col("x") < F.floor(F.col("n") * F.lit(high))) & (F.col("v") <= F.col("floor")))
    order = Window.partitionBy(*key).orderBy("x")
    runs = middle.withColumn("run", F.col("x") - F.row_number().over(order)).groupBy(*key, "n", "run").agg(F.min("x").alias("a"), (F.max("x") + 1).alias("b"))
    order = Window.partitionBy(*key).orderBy("a")
    fold = F.greatest(F.lit(1), F.bround(F.col("n") * F.lit(P.FOLD)).cast("int"))
    apart = F.coalesce(F.col("a") - F.lag("b").over(order) > fold, F.lit(True))
    strips = runs.withColumn("strip", F.sum(apart.cast("int")).over(order)).groupBy(*key, "n", "strip").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    best = strips.groupBy(*key).agg(F.max_by(F.struct("a", "b"), F.struct(F.col("b") - F.col("a"), -F.col("a"))).alias("best"))
    return s.join(best, key, "left").select(
        *spreads.columns, F.when(F.col("best").isNull(), 0.5).otherwise((F.col("best.a") + (F.col("best.b") - F.col("best.a")) / 2) / F.col("n")).alias("gutter"),
        F.when(F.col("best").isNull(), 0.0).otherwise((F.col("best.b") - F.col("best.a")) / F.col("n")).alias("band"),
    )


def spread_verdict(spreads: DataFrame, most: int = 20) -> DataFrame:
    """(doc_id, checked, landscape, spreads, is_spread, median_gutter, median_band) from evenly spaced pages; the medians are the upper ones."""
    upper = lambda c: F.element_at(F.sort_array(F.collect_list(c)), F.floor(F.count("*") / 2).cast("int") + 1)
    s = gutters(sampled(spreads, "src_page", most))
    wide = F.col("width") > F.col("height")
    s = s.groupBy("doc_id").agg(F.count("*").alias("checked"), F.count_if(wide).alias("landscape"), F.count_if(wide & (F.col("band") >= P.BAND)).alias("spreads"), upper("gutter").alias("median_gutter"), upper("band").alias("median_band"))
    return s.withColumn("is_spread", F.col("spreads") / F.col("checked") >= P.SPREADS)


def split_spreads(spreads: DataFrame) -> DataFrame:
    """page_map (doc_id, out_page, src_page, half, gutter_frac): halves with at least 2 % of their spread's ink, numbered densely."""
    s = gutters(spreads).withColumn("cut", F.floor(F.col("gutter") * F.size("ink")).cast("int"))
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)
    s = s.withColumn("left", total(F.slice("ink", 1, F.col("cut")))).withColumn("right", total(F.slice("ink", F.col("cut") + 1, F.size("ink"))))
    halves = F.array(F.struct(F.lit(0).alias("side"), F.lit("left").alias("half"), F.col("left").alias("own")), F.struct(F.lit(1).alias("side"), F.lit("right").alias("half"), F.col("right").alias("own")))
    whole = F.col("left") + F.col("right")
    h = s.where(whole > 0).select("doc_id", "src_page", F.bround("gutter", 4).alias("gutter_frac"), whole.alias("whole"), F.inline(halves)).where(F.col("own") >= F.col("whole") * F.lit(P.BLANK_HALF))
    return h.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("src_page", "side")) - 1).alias("out_page"), "src_page", "half", "gutter_frac")


def text_probe(probe: DataFrame) -> DataFrame:
    """(doc_id, chars_per_page, runons_per_1k, scanned_ratio, producer) from 12 pages for the text and 8 for the images."""
    text = sampled(probe, "page_no", 12).groupBy("doc_id").agg(F.sum(F.char_length("layer_text")).alias("chars"), F.sum(F.regexp_count("layer_text", F.lit(P.RUN_ON_J))).alias("runs"), F.count("*").alias("n"))
    scans = sampled(probe, "page_no", 8).groupBy("doc_id").agg(F.avg((F.col("max_image_coverage") >= P.COVERED).cast("double")).alias("scanned_ratio"))
    about = probe.groupBy("doc_id").agg(F.coalesce(F.min("producer"), F.lit("")).alias("producer"), F.count("*").alias("pages"))
    return about.join(text, "doc_id").join(scans, "doc_id").select("doc_id", "pages", "producer", (F.col("chars") / F.col("n")).alias("chars_per_page"), F.when(F.col("chars") > 0, F.col("runs") / F.col("chars") * 1000).otherwise(0.0).alias("runons_per_1k"), "scanned_ratio")


def verdict() -> Column:
    ocr = F.col("producer").rlike(P.PRODUCER_J)
    return F.when(F.col("chars_per_page") < P.FEW_CHARS, "no_text").when(F.col("scanned_ratio") >= P.SCANNED, "bad_ocr").when((F.col("runons_per_1k") >= P.RUN_ONS_1K) | ocr, "bad_ocr").otherwise("born_digital")


def analyze(probe: DataFrame, spreads: DataFrame | None = None) -> DataFrame:
    """document_analysis: the text layer's verdict, whether to split and to read anew, pages to process, seconds estimated."""
    a = text_probe(probe).withColumn("text_verdict", verdict())
    split = spread_verdict(spreads).select("doc_id", F.col("is_spread").alias("recommend_split")) if spreads is not None else None
    a = a.join(split, "doc_id", "left").fillna(False, ["recommend_split"]) if split is not None else a.withColumn("recommend_split", F.lit(False))
    a = a.withColumn("recommend_ocr", F.col("text_verdict") != "born_digital").withColumn("output_pages", F.when(F.col("recommend_split"), F.col("pages") * 2).otherwise(F.col("pages")))
    seconds = F.col("output_pages") * F.when(F.col("recommend_ocr"), P.OCR_SECONDS).otherwise(P.TEXT_SECONDS)
    return a.withColumn("estimated_seconds", seconds).withColumn("estimate", human_seconds(seconds))
