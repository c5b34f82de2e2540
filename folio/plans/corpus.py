"""A damaged corpus made from a table of clean documents, so that every operator has something to repair.

Documents become pages of books (doc_id: source and a run of 1,000 ids; page_no: place
in it), and each page gets damage by fixed rules of its number. SQL is the same in
DuckDB, for comparison.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

#: Ids in a book: bounds the size of a document, whatever a source's share.
BOOK_IDS = 1000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def clean_pages(docs: DataFrame) -> DataFrame:
    """(doc_id, seq, page_no, id, body) of undamaged pages."""
    book = F.concat(F.coalesce("source", F.lit("none")), F.lit("-"), F.floor(F.col("doc_id") / BOOK_IDS).cast("string"))
    d = docs.select(book.alias("book"), F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("body"))
    seq = F.row_number().over(Window.partitionBy("book").orderBy("id")) - 1
    return d.select(F.col("book").alias("doc_id"), seq.alias("seq"), seq.alias("page_no"), "id", "body")


def damaged_pages(docs: DataFrame) -> DataFrame:
    """(doc_id, seq, page_no, id, clean, body)."""
    p = clean_pages(docs).withColumn("clean", F.col("body"))
    n = F.col("page_no")
    when = lambda m, r, text: F.when(n % m == r, text).otherwise("")
    chapter = F.concat(F.lit("The Matter of "), F.repeat(F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (F.floor(n / 10) % 26 + 1).cast("int"), F.lit(1)), 3))
    head = F.when(n % 6 != 5, F.concat((n + 1).cast("string"), F.lit("  A Placeholder Title  II. "), (n % 3).cast("string"), F.lit("\n"))).otherwise("")
    text = F.when(n % 13 == 6, F.substring(F.col("clean"), F.lit(1), F.floor(F.char_length("clean") / 3).cast("int"))).when(n % 17 == 8, F.concat("clean", F.lit("\n"), "clean")).otherwise(F.col("clean"))
    text = F.when(n % 4 == 1, F.regexp_replace(text, r"\.\z", "")).otherwise(text)
    text = F.when(n % 4 == 2, F.concat(F.lower(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.char_length(text)))).otherwise(text)
    body = F.concat(
        head,
        when(10, 0, F.concat(F.lit("# "), chapter, F.lit("\n\n"))),
        F.when(n % 4 == 2, "so ").otherwise("So "),
        F.translate(F.substring(F.md5(F.col("id").cast("string")), 1, 8), "0123456789", "ghijklmnop"), F.lit(" "),  # else the line is a running head
        F.when(n % 2 == 1, "under-\nstanding and ").otherwise("understanding and "),
        F.when(n % 3 == 0, "self-\nevident ").otherwise("self-evident "),
        when(5, 0, F.lit("\ufb01nd\u00a0the co\u00adop\u200bs cafe\u0301 ")),
        when(7, 1, F.lit('<span id="page-1-0"></span>')),
        when(7, 0, F.lit("biodiversit[y2](#page-1-0) and [27.](#nowhere) ends ")),
        F.when(n % 2 == 0, "noted<sup>1</sup>\n\n").otherwise("x<sup>9</sup>\n\n"),
        when(3, 2, F.concat((F.col("id") % 500).cast("string"), F.lit("\n"))),
        when(11, 3, F.repeat(F.lit("The same sentence comes again and again.\n"), 40)),
        text,
        F.when(n % 2 == 0, "\n\n<sup>1</sup> A note here. <sup>2</sup> Another note").otherwise(""),
        F.lit("\n"), chapter,
    )
    return p.select("doc_id", "seq", "page_no", "id", "clean", body.alias("body"))


def outline(pages: DataFrame) -> DataFrame:
    """(doc_id, level, title, page_no): the book, and its chapters below it."""
    n = F.col("page_no")
    chapter = F.concat(F.lit("The Matter of "), F.repeat(F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (F.floor(n / 10) % 26 + 1).cast("int"), F.lit(1)), 3))
    rows = F.when(n == 0, F.array(F.struct(F.lit(1).alias("level"), F.lit("The Book").alias("title")), F.struct(F.lit(2).alias("level"), chapter.alias("title")))).otherwise(F.array(F.struct(F.lit(2).alias("level"), chapter.alias("title"))))
    return pages.where(n % 10 == 0).select("doc_id", "page_no", F.inline(rows)).select("doc_id", "level", "title", "page_no")


def spreads(docs: DataFrame) -> DataFrame:
    """(doc_id, src_page, width, height, ink): two blocks of columns with a gap between, a fold in some gaps, a blank half on some pages."""
    p = clean_pages(docs)
    i = F.col("id")
    gap, at = 4 + i % 9, 90 + i % 21
    ink = F.transform(
        F.sequence(F.lit(0), F.lit(199)),
        lambda x: F.when((x >= at) & (x < at + gap), F.when((i % 4 == 0) & (x == at + 2), 40).otherwise(0)).when((i % 15 == 7) & (x >= at), 0).otherwise((x * 7 + i * 13) % 50 + 50).cast("long"),
    )
    return p.select("doc_id", F.col("page_no").alias("src_page"), F.when(i % 10 == 9, 400.0).otherwise(800.0).alias("width"), F.lit(600.0).alias("height"), ink.alias("ink"))


_CHAPTER = "'The Matter of ' || repeat(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', CAST((page_no // 10) % 26 + 1 AS INT), 1), 3)"

#: DuckDB: page as in clean_pages, damaged as in damaged_pages.
SQL = f"""
WITH page AS (
  SELECT coalesce(source, 'none') || '-' || CAST(doc_id // {BOOK_IDS} AS VARCHAR) AS doc_id, row_number() OVER (PARTITION BY coalesce(source, 'none') || '-' || CAST(doc_id // {BOOK_IDS} AS VARCHAR) ORDER BY doc_id) - 1 AS page_no, doc_id AS id, coalesce(text, '') AS clean
  FROM documents
), damage AS (
  SELECT *, {_CHAPTER} AS chapter,
    CASE WHEN page_no % 13 = 6 THEN substr(clean, 1, CAST(length(clean) // 3 AS INT)) WHEN page_no % 17 = 8 THEN clean || chr(10) || clean ELSE clean END AS t1
  FROM page
), cut AS (
  SELECT *, CASE WHEN page_no % 4 = 1 AND ends_with(t1, '.') THEN substr(t1, 1, length(t1) - 1) WHEN page_no % 4 = 2 THEN lower(substr(t1, 1, 1)) || substr(t1, 2) ELSE t1 END AS t2 FROM damage
), damaged AS (
  SELECT doc_id, page_no AS seq, page_no, id, clean, chapter,
    CASE WHEN page_no % 6 <> 5 THEN CAST(page_no + 1 AS VARCHAR) || '  A Placeholder Title  II. ' || CAST(page_no % 3 AS VARCHAR) || chr(10) ELSE '' END
    || CASE WHEN page_no % 10 = 0 THEN '# ' || chapter || chr(10) || chr(10) ELSE '' END
    || CASE WHEN page_no % 4 = 2 THEN 'so ' ELSE 'So ' END || translate(substr(md5(CAST(id AS VARCHAR)), 1, 8), '0123456789', 'ghijklmnop') || ' '
    || CASE WHEN page_no % 2 = 1 THEN 'under-' || chr(10) || 'standing and ' ELSE 'understanding and ' END
    || CASE WHEN page_no % 3 = 0 THEN 'self-' || chr(10) || 'evident ' ELSE 'self-evident ' END
    || CASE WHEN page_no % 5 = 0 THEN chr(64257) || 'nd' || chr(160) || 'the co' || chr(173) || 'op' || chr(8203) || 's cafe' || chr(769) || ' ' ELSE '' END
    || CASE WHEN page_no % 7 = 1 THEN '<span id="page-1-0"></span>' ELSE '' END
    || CASE WHEN page_no % 7 = 0 THEN 'biodiversit[y2](#page-1-0) and [27.](#nowhere) ends ' ELSE '' END
    || CASE WHEN page_no % 2 = 0 THEN 'noted<sup>1</sup>' ELSE 'x<sup>9</sup>' END || chr(10) || chr(10)
    || CASE WHEN page_no % 3 = 2 THEN CAST(id % 500 AS VARCHAR) || chr(10) ELSE '' END
    || CASE WHEN page_no % 11 = 3 THEN repeat('The same sentence comes again and again.' || chr(10), 40) ELSE '' END
    || t2
    || CASE WHEN page_no % 2 = 0 THEN chr(10) || chr(10) || '<sup>1</sup> A note here. <sup>2</sup> Another note' ELSE '' END
    || chr(10) || chapter AS body
  FROM cut
)
"""
