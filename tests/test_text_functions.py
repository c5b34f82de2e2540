"""Column functions: each case names what it guards against."""

import pytest
from pyspark.sql import functions as F

from folio.functions import text as T


def one(spark, column, *values, kinds="string"):
    d = spark.createDataFrame([tuple(values)], ", ".join(f"c{k} {t}" for k, t in enumerate(kinds.split(","))))
    return d.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("line, form", [("82  A Long Story  I. 2", "# a long story i. #"), ("  **The Head** ", "the head"), ("# Title", "title"), ("٣ x", "# x"), (" a b ", "a b")])
def test_head_form(spark, line, form):
    assert one(spark, T.head_form(F.col("c0")), line) == form


@pytest.mark.parametrize(
    "line, head, local",
    [("A Title", True, True), ("A sentence.", False, False), ("", False, False), ("x" * 61, False, False), ("x" * 60, True, True), ("see<sup>1</sup>", False, False), ("[^1] note", False, False), ("![](a.png)", False, False), ("- item", True, False), ("1. item", True, False), ("> quote", True, False), ("12", True, True)],
)
def test_head_shapes(spark, line, head, local):
    assert one(spark, T.head_like(F.col("c0")), line) is head and one(spark, T.local_head_like(F.col("c0")), line) is local


def test_content_amount(spark):
    text = "<!-- page 3 -->\nAb1 [text](http://x.y) ![](f.png)[^p1-2]: <sup>9</sup> ünï ²½"
    assert one(spark, T.content_amount(F.col("c0")), text) == 3 + 1 + 3 + 2


@pytest.mark.parametrize(
    "heading, title",
    [("# One: Two", "One Two"), ("## [Linked](x.md)<sup>3</sup> **Bold**", "Linked Bold"), ("plain [^1] text.", "plain text"), ("# " + "word " * 30, ("word " * 16).strip()), ("### a/b\\c|d", "a b c d"), ("# End. ", "End")],
)
def test_clean_title(spark, heading, title):
    assert one(spark, T.clean_title(F.col("c0")), heading) == title


@pytest.mark.parametrize("text, count", [("x" * 10, 1), ("x" * 4001, 3), ("<!-- page 1 -->\na\n<!-- page 1 -->\nb\n<!-- page 7 -->", 2), ("", 1)])
def test_page_count(spark, text, count):
    assert one(spark, T.page_count(F.col("c0")), text) == count


def test_names(spark):
    assert one(spark, T.book_prefix(F.col("c0")), "2006_Dawkins_GodDelusion") == "GodDelusion"
    assert one(spark, T.book_prefix(F.col("c0")), "1962_BT") == "1962_BT"
    assert one(spark, T.chapter_file(F.lit("B"), F.lit(3), F.lit("T"), F.lit(2)), "") == "B 03 T.md"
    assert one(spark, T.chapter_file(F.lit("B"), F.lit(103), F.lit("T"), F.lit(2)), "") == "B 103 T.md"
    assert one(spark, T.chunk_name(F.lit(0), F.lit(19)), "") == "0000-0019.md"
    assert one(spark, T.slug(F.col("c0")), "Latin American Spanish!") == "latin-american-spanish" and one(spark, T.slug(F.col("c0")), "日本語") == "translated"
    assert [one(spark, T.page_label(F.col("c0"), F.col("c1")), a, b, kinds="int,int") for a, b in ((None, None), (3, 3), (3, 9))] == ["", "p. 3", "pp. 3–9"]


@pytest.mark.parametrize("spec, pages", [("8,40-41", [8, 40, 41]), ("", []), (" 3 , 5-5,", [3, 5]), ("9-7", [])])
def test_page_range(spark, spec, pages):
    assert one(spark, T.page_range(F.col("c0")), spec) == pages


def test_argument(spark):
    line = "python -m x.run --pdf a.pdf --out-dir out"
    assert one(spark, T.argument(F.col("c0"), "--pdf"), line) == "a.pdf" and one(spark, T.argument(F.col("c0"), "--out-dir"), line) == "out"
    assert one(spark, T.argument(F.col("c0"), "--pdf"), "x --pdf") is None and one(spark, T.argument(F.col("c0"), "--pdf"), "x") is None


def test_links(spark):
    assert one(spark, T.link_target(F.lit("a b_images"), F.lit("f (1)*~é.png")), "") == "a%20b_images/f%20%281%29%2A~%C3%A9.png"
    once = T.chunk_anchors(F.col("c0"), F.lit(20))
    text = '[x](#page-19-0) <span id="page-3-1"> page-1-1'
    got = one(spark, once, text)
    assert got == '[x](#c0020-page-19-0) <span id="c0020-page-3-1"> page-1-1' and one(spark, once, got) == got  # twice is once


def test_figures(spark):
    text = "a<!--figure-->b<!--figure-->c<!--figure-->"
    assert one(spark, T.figure_links(F.col("c0"), F.array(F.lit("x.jpeg"), F.lit("y.jpeg"))), text) == "a![](x.jpeg)b![](y.jpeg)c"


@pytest.mark.parametrize("answer, text", [("```markdown\nHi\nthere\n```\n", "Hi\nthere"), ("  plain ", "plain"), ("```\nopen", "```\nopen"), ("a\n```\nb\n```", "a\n```\nb\n```")])
def test_unfenced(spark, answer, text):
    assert one(spark, T.unfenced(F.col("c0")), answer) == text


def test_estimates(spark):
    assert [one(spark, T.human_seconds(F.col("c0")), s, kinds="double") for s in (89.0, 90.0, 5399.0, 5400.0)] == ["~89 seconds", "~2 minutes", "~90 minutes", "~1.5 hours"]
    assert [one(spark, T.parallel_pages(F.col("c0")), g, kinds="double") for g in (48.0, 24.0, 15.0, 8.0, 4.0)] == [8, 6, 4, 2, 1]


def test_answers_of_servers(spark):
    assert one(spark, T.edge_error(F.col("c0")), " error code: 1010\n") == "1010" and one(spark, T.edge_error(F.col("c0")), "error code: 1010 in model") is None
    gone = lambda status, body: one(spark, T.retired_model(F.col("c0"), F.col("c1")), status, body, kinds="int,string")
    assert gone(404, "x model_not_found") and not gone(500, "model_not_found") and not gone(404, "no such page")
    wait = lambda n, after: one(spark, T.backoff(F.col("c0"), F.col("c1")), n, after, kinds="int,string")
    assert [wait(0, None), wait(3, None), wait(9, None), wait(1, "7.5"), wait(1, "9999"), wait(2, "soon")] == [1, 8, 120, 7.5, 300, 4]
