"""Refinement: pages, heads, hyphens, reflow, notes, links, outline, bridging, and the whole."""

import re

import pytest
from pyspark.sql import functions as F

from folio.operators import heads, pages as pg, pagework as pw, surgery
from folio.plans import refine

PAGE = "doc_id string, seq int, page_no int, body string"


def pages(spark, *bodies):
    return spark.createDataFrame([("b", k, k, x) for k, x in enumerate(bodies)], PAGE)


def bodies(df):
    return [r["body"] for r in df.orderBy("seq").collect()]


def explode(spark, text):
    return [(r["page_no"], r["body"]) for r in pg.explode_pages(spark.createDataFrame([("d", text)], "doc_id string, text string")).orderBy("seq").collect()]


def test_explode_pages(spark):
    assert explode(spark, "no marks") == [(0, "no marks")]
    assert explode(spark, "{3}----------\n\nthree\n{9}" + "-" * 48 + "\nnine") == [(3, "\nthree\n"), (9, "nine")] or [p for p, _ in explode(spark, "{3}----------\n\nthree\n{9}" + "-" * 48 + "\nnine")] == [3, 9]
    assert explode(spark, " before \n<!-- page 1 -->\na")[0] == (0, "before")
    assert explode(spark, "----------\nrule\n{1}---\nshort") == [(0, "----------\nrule\n{1}---\nshort")]
    assert [p for p, _ in explode(spark, "{0}----------\n{1}----------\n")] == [0, 1]


def test_assemble_and_paginate_round_trip(spark):
    p = pages(spark, "one", "", "three\n\n\n\nmore")
    text = pg.assemble(p).first()["text"]
    assert text == "<!-- page 0 -->\n\none\n\n<!-- page 2 -->\n\nthree\n\nmore"
    raw = pg.paginate(p)
    assert [b.strip() for _, b in explode(spark, raw.first()["text"])] == ["one", "", "three\n\n\n\nmore"]


def test_lines(spark):
    text = "# A\n<!-- page 4 -->\nx\n```\n# not\n<!-- page 5 -->\n```\n## B\r\ny\x0cz\n"
    got = pg.explode_lines(spark.createDataFrame([("d", text)], "doc_id string, text string")).orderBy("line_no").collect()
    assert [r["text"] for r in got] == text.splitlines()
    assert [r["level"] for r in got] == [1, 0, 0, 0, 0, 0, 0, 2, 0, 0] and [r["page_no"] for r in got] == [None] + [4] * 9
    assert [r["is_anchor"] for r in got].count(True) == 1


def test_running_heads(spark):
    p = pages(spark, *[f"{k}  The Book  I. 2\nbody {'ABCDEFGHIJ'[k]} is\nmore of {'abcdefghij'[k]}\nlast words {'klmnopqrst'[k]}." for k in range(10)])
    assert [r["form"] for r in heads.running_heads(p).collect()] == ["# the book i. #"]
    assert heads.running_heads(p.where("seq < 3")).count() == 0  # too few pages to prove anything
    assert all("The Book" not in b for b in bodies(heads.strip_heads(p)))


def test_a_page_counts_a_form_once(spark):
    p = pages(spark, "Same\nSame\na b\nSame\nSame", *["x y %s\nend %s" % (k, c) for k, c in enumerate("abcdefgh")])
    assert "same" not in {r["form"] for r in heads.running_heads(p).collect()}


def test_local_heads_need_neighbours(spark):
    body = lambda head: f"{head}\nwords of prose here\nand their end."
    names = ["One", "xa", "One", "xb", "One", "Far", "ya", "yb", "Far", "yc", "yd", "Far", "z"]
    got = {(r["seq"], r["form"]) for r in heads.local_heads(pages(spark, *map(body, names))).collect()}
    assert got == {(0, "one"), (2, "one"), (4, "one")}  # the gaps between the others are too wide


def test_first_heading_is_kept(spark):
    p = pages(spark, "# The Title\nprose a", *[f"The Title\nprose {c}" for c in "bcdef"])
    got = bodies(heads.strip_heads(p))
    assert got[0] == "# The Title\nprose a" and got[1:] == [f"prose {c}" for c in "bcdef"]


def test_mid_page_lines_stay(spark):
    p = pages(spark, *[f"Head {k}\na{k} b.\nc{k} d.\nHead {k}\ne{k} f.\ng{k} h." for k in range(6)])
    assert all(b.count("Head") == 1 for b in bodies(heads.strip_heads(p)))


def test_clean_characters(spark):
    d = spark.createDataFrame([("d", "ﬁnd\r\nco­ \n op ​x café ² ﬅ\x07\t")], "doc_id string, text string")
    r = pw.clean_characters(d).first()
    assert r["text"] == "find\nco op x café ² st\t".replace("co op", "coop") and r["chars_cleaned"] == 7


def test_margin_numbers(spark):
    r = pw.margin_numbers(pages(spark, "text\n **123** \n438\n0\n12 x\n437")).first()
    assert r["body"] == "text\n[H. 123]\n438\n0\n12 x\n[H. 437]" and r["margins"] == [123, 437]


@pytest.mark.parametrize(
    "text, joined",
    [
        ("under-\nstanding", "understanding"), ("self-\nevident self-evident", "self-evident self-evident"), ("Anglo-\nSaxon", "Anglo-Saxon"), ("1914-\n18", "1914-18"), ("Being-in-\nthe-world", "Being-in-the-world"),
        ("re-\nform reform re-form re-form", "re-form reform re-form re-form"), ("aa-\nbb-\ncc", "aabb-\ncc"), ("end—\nnext", "end—\nnext"), ("co‐\nop", "coop"), ("a- \n b", "ab"),
    ],
)
def test_hyphens(spark, text, joined):
    p = pages(spark, text)
    assert bodies(pw.join_hyphens(p, pw.vocabulary(p, "body"))) == [joined]


@pytest.mark.parametrize(
    "page, flowed",
    [
        ("a\nb\n\nc", "a b\n\nc"), ("# H\na\nb", "# H\na b"), ("- x\n  y\n- z", "- x y\n- z"), ("```\na\nb\n```\nc\nd", "```\na\nb\n```\nc d"), ("$$\nx\n$$\ny\nz", "$$\nx\n$$\ny z"), ("a  \nb", "a  \nb"), ("a\\\nb", "a\\\nb"),
        ("word-\nb", "word-\nb"), ("| a |\nb", "| a |\nb"), ("<sup>1</sup> n\n<sup>2</sup> m", "<sup>1</sup> n\n<sup>2</sup> m"), ("text\n<sup>1</sup> on", "text <sup>1</sup> on"), ("a\n<div>\nb", "a\n<div>\nb"), ("a\n<span>b", "a <span>b"),
        ("a\nb  \nc", "a b c"), ("~~~\nx\n```\ny\n~~~\na\nb", "~~~\nx\n```\ny\n~~~\na b"),
    ],
)
def test_reflow(page, flowed):
    assert surgery.reflow(page)[0] == flowed


@pytest.mark.parametrize(
    "page, numbered",
    [
        ("x<sup>1</sup> y\n\n<sup>1</sup> Note.", "x[^p7-1] y\n\n[^p7-1]: Note."), ("E = mc<sup>2</sup>", "E = mc<sup>2</sup>"), ("a[^i]\n[^i]: def", "a[^p7-i]\n[^p7-i]: def"),
        ("t\n<sup>1</sup> A. <sup>2</sup> B; <sup>3</sup> C", "t\n[^p7-1]: A.\n[^p7-2]: B;\n[^p7-3]: C"), ("name<sup>a,b</sup>", "name<sup>a,b</sup>"),
    ],
)
def test_notes(spark, page, numbered):
    p = spark.createDataFrame([("b", 0, 7, page)], PAGE)
    assert bodies(pw.number_notes(p)) == [numbered]


@pytest.mark.parametrize(
    "page, tidied",
    [("biodiversit[y2](#p)", "biodiversity[2](#p)"), ("x [27.](#p)", "x [27](#p)."), ("[\\)15](#p)", ")[15](#p)"), ("see [a7](#p)", "see [a7](#p)"), ("[12](#p) , x", "[12](#p), x"), ("[text](#p)", "[text](#p)"), ("![3.](#p)", "![3.](#p)"), ("[3.](http://x)", "[3.](http://x)")],
)
def test_links(spark, page, tidied):
    r = pw.tidy_links(pages(spark, page)).first()
    assert r["body"] == tidied and r["links_tidied"] == (re.sub("[ ,]", "", page) != re.sub("[ ,]", "", tidied))


def test_dangling(spark):
    p = pages(spark, 'by 2030[5](#gone) and [6](#here) ([7](#gone)) [word](#gone)', '<span id="here"></span> ![x](#gone)')
    assert bodies(pw.unlink_dangling(p))[0] == "by 2030<sup>5</sup> and [6](#here) (7) word"
    assert {(r["seq"], r["target"]) for r in pw.dangling_links(p).collect()} == {(0, "gone")}


def outlined(spark, entries, *bodies_):
    o = spark.createDataFrame([("b", *e) for e in entries], "doc_id string, level int, title string, page_no int")
    return bodies(pw.apply_outline(pages(spark, *bodies_), o))


def test_outline(spark):
    entries = [(2, "Part One", 0), (3, "The First Chapter", 1), (3, "Methods", 3), (4, "Input data", 2)]
    assert outlined(spark, entries, "#### Part One", "# The First Chapter OPEN\ntext", "### Unknown\n\n**Input data.** The rest", "# Methods") == [
        "# Part One", "## The First Chapter\n\nOPEN\ntext", "### Unknown\n\n### **Input data.**\n\nThe rest", "## Methods",
    ]
    assert outlined(spark, [(1, "Elsewhere", 9)], "### Kept", "# Elsewhere") == ["### Kept", "# Elsewhere"]  # nothing known, too far away
    assert outlined(spark, [(1, "Code", 0)], "# Code\n```\n### in fence\n```\n## Lower\n## Same") == ["# Code\n```\n### in fence\n```\n## Lower\n## Same"]


def bridged(spark, *bodies_):
    p = pages(spark, *bodies_)
    return bodies(pw.bridge_pages(p, pw.vocabulary(p, "body")))


def test_bridge(spark):
    assert bridged(spark, "It goes", "on here. Then.\n\nNext") == ["It goes on here. Then.", "Next"]
    assert bridged(spark, "It ends.", "on here") == ["It ends.", "on here"]
    assert bridged(spark, "It goes", "On here") == ["It goes", "On here"]
    assert bridged(spark, "It goes\n\n[^p0-1]: a note\n\n**Label**", "on") == ["It goes on\n\n[^p0-1]: a note\n\n**Label**", ""]
    assert bridged(spark, "It goes", "", "on") == ["It goes on", "", ""]
    assert bridged(spark, "the under-", "standing of understanding.") == ["the understanding of understanding.", ""]
    assert bridged(spark, "a", "b", "c") == ["a b c", "", ""]  # what moved is continued in turn
    assert bridged(spark, "# Heading", "on") == ["# Heading", "on"] and bridged(spark, "It goes", "- on") == ["It goes", "- on"]
    assert bridged(spark, "It is said.\"[^p0-1]", "on") == ["It is said.\"[^p0-1]", "on"]


def test_switches_and_order(spark):
    text = "".join(f"{{{k}}}----------\n\n{k} The Head\n\nIt begins with {'abcdef'[k]},\nthe under-\nstanding of page {'abcdef'[k]}<sup>1</sup>\nends {'abcdef'[k]}.\n\n<sup>1</sup> Note\n" for k in range(6))
    d = spark.createDataFrame([("d", text)], "doc_id string, text string")
    out = refine.refine(d).first()["text"]
    assert "The Head" not in out and "understanding of page a[^p0-1]" in out and out.count("<!-- page") == 6
    raw = refine.refine(d, heads=False, footnotes=False, hyphens=False, reflow=False, bridge=False, links=False, clean=False).first()["text"]
    assert "0 The Head" in raw and "under-\nstanding" in raw and "<sup>1</sup>" in raw
    stats = refine.refine_stats(refine.refine_pages(d, margins=True)).first()
    assert stats["pages"] == 6 and stats["heads_removed"] == 6 and stats["hyphens_joined"] == 6 and stats["notes_numbered"] == 12 and stats["margin_sequence"] == []


def test_sequence_breaks(spark):
    d = spark.createDataFrame([("d", [1, 2, 5, 6, 6])], "doc_id string, margin_sequence array<int>")
    assert [(r["before"], r["after"]) for r in refine.sequence_breaks(d).collect()] == [(2, 5), (6, 6)]


def test_damage_gives_every_operator_work(spark):
    from folio.plans import corpus

    rows = [(k, "The story of %s goes on. It has an end.\nMore of it" % ("abcdefghijklmnopqrstuvwxyz"[k % 26] * 3), "src0") for k in range(60)]
    p = corpus.damaged_pages(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    s = refine.refine_stats(refine.refine_pages(pg.paginate(p), corpus.outline(p), margins=True)).first().asDict()
    assert all(s[c] > 0 for c in refine.COUNTERS if c != "headings_promoted") and s["margin_sequence"]
    assert pw.clean_characters(p, "body").agg(F.sum("chars_cleaned")).first()[0] > 0


def test_python_holds_few_pages(spark):
    """However many pages a task has, Python gets them in batches of bounded rows and bytes."""
    keys = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"]
    before = {k: spark.conf.get(k) for k in keys}
    spark.conf.set(keys[0], "10000")
    spark.conf.set(keys[1], str(256 << 20))
    try:
        pages = spark.range(0, 5000, 1, 1).select(F.col("id").alias("doc_id"), F.lit(0).alias("seq"), F.lit("a b\nc").alias("body"))
        seen = pw.work(pages, lambda r: {"body": str(id(r)), "n": 1}, "n int")
        assert seen.count() == 5000
        assert int(spark.conf.get(keys[0])) <= 1000 and int(spark.conf.get(keys[1])) <= 16 << 20
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_hyphens_read_the_vocabulary_once(spark):
    """Both spellings of a break are looked up in one pass over the words, and repeated breaks stay."""
    p = pages(spark, "under-\nstanding and self-\nevident", "understanding self-evident self-evident", "self-\nevident")
    vocab = pw.vocabulary(p, "body")
    breaks = pw.hyphen_breaks(p)
    got = pw.hyphen_decisions(breaks.union(breaks), vocab)
    assert sorted((r["seq"], r["at"], r["left"], r["right"], r["keeps"]) for r in got.collect()) == sorted([(0, 0, "under", "standing", False), (0, 1, "self", "evident", True), (2, 0, "self", "evident", True)] * 2)
    plan = pw.hyphen_decisions(breaks, vocab)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall("Generate explode\\(regexp_extract_all", plan)) == 1
