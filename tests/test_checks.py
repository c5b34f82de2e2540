"""Audit, checks, inspection: every detector has a case that it must find and one that it must leave alone."""

import difflib

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.operators import audit, inspection, verify
from folio.sources import documents as src

PAGE = "doc_id string, seq int, page_no int, body string"


@pytest.mark.parametrize(
    "body, found",
    [
        ("The same line again.\n" * 4, ("the same line again.", 4)), ("The same line again.\n" * 3, None), ("The same line again. " * 5 + "x" * 400, None), ("Short.\n" * 50, None), ("A b c. D e f.", None), ("", None),
        ("One longer sentence here. Two longer sentence here. " * 4, ("one longer sentence here.", 4)), ("the  SAME\tline again!\n" * 5, ("the same line again!", 5)),
    ],
)
def test_loops(spark, body, found):
    r = audit.repetition(spark.createDataFrame([("d", 0, 0, body)], PAGE)).first()
    assert (r and (r["unit"], r["times"])) == found


def test_page_issues(spark):
    text = "word " * 100
    cases = [  # body, layer, ink
        (text, text, 0.05, None), (text[:150], text, 0.05, "missing"), (text * 2, text, 0.05, "extra"), ("", "", 0.05, "empty"), ("", "", 0.001, None), (text, "caption", 0.05, None), ("word " * 10, "", 0.05, "sparse"),
        *[(text, "", 0.05, None)] * 8, ("loops and loops on.\n" * 30, text, 0.05, "repeated"), (text[:320], text, 0.05, None),
    ]
    p = spark.createDataFrame([("d", k, k, c[0]) for k, c in enumerate(cases)], PAGE)
    w = spark.createDataFrame([("d", k, c[1], c[2]) for k, c in enumerate(cases)], "doc_id string, page_no int, layer_text string, ink double")
    got = audit.page_issues(p, w)
    assert {(r["seq"], r["kind"]) for r in got.collect()} == {(k, c[3]) for k, c in enumerate(cases) if c[3]}
    assert {r["kind"] for r in got.where("strong").collect()} == {"missing", "extra", "repeated"}
    s = audit.summary(got, 2).first()
    assert (s["strong"], s["weak"]) == (3, 2) and s["shown"].startswith("page 1:") and s["shown"].count(";") == 1
    assert {r["kind"] for r in audit.page_issues(p).collect()} == {"repeated"}


def test_text_without_marks_is_no_page(spark):
    from folio.operators.pages import explode_pages

    text = "word " * 400
    docs = spark.createDataFrame([("bare", text), ("marked", "{0}----------\n" + text)], "doc_id string, text string")
    w = spark.createDataFrame([(d, 0, "word " * 2000, 0.05) for d in ("bare", "marked")], "doc_id string, page_no int, layer_text string, ink double")
    assert [(r["doc_id"], r["kind"], r["ord"]) for r in audit.page_issues(explode_pages(docs, marked=True), w).collect()] == [("marked", "missing", 1)]
    ok = {r["doc_id"]: r["ok"] for r in verify.findings(docs, w).where("name = 'page audit'").collect()}
    assert ok == {"bare": True, "marked": False}


def test_findings(spark):
    texts = [("good", "λόγος and *slant* here.[^p1-1]"), ("bad", "sirnply " + " ".join("a" * 30 for _ in range(6))), ("loop", "The same line again.\n" * 9)]
    d = spark.createDataFrame(texts, "doc_id string, text string")
    ok = {(r["doc_id"], r["name"]): r["ok"] for r in verify.findings(d, expect=("greek",)).collect()}
    assert len(ok) == 18 and {k for k, v in ok.items() if not v} == {("bad", "fresh OCR"), ("bad", "word spacing"), ("bad", "greek"), ("loop", "page audit"), ("loop", "greek")}
    assert [r["name"] for r in verify.findings(d).where("doc_id = 'good'").orderBy("ord").collect()] == ["fresh OCR", "page audit", "word spacing", "greek", "italics", "footnotes"]
    assert verify.findings(d, fresh_ocr=False).where("name = 'fresh OCR'").count() == 0


def test_embedded_layer(spark):
    body, other = " ".join(f"word{k}" for k in range(80)), " ".join(f"other{k * 7}" for k in range(80))
    docs = spark.createDataFrame([("same", f"{{0}}----------\n{body}"), ("new", f"{{0}}----------\n{other}"), ("short", "{0}----------\nx")], "doc_id string, text string")
    layer = spark.createDataFrame([("same", 0, body.upper(), 0.1), ("new", 0, body, 0.1), ("short", 0, "y", 0.1)], "doc_id string, page_no int, layer_text string, ink double")
    ok = {r["doc_id"]: r["ok"] for r in verify.findings(docs, layer).where("name = 'fresh OCR'").collect()}
    assert ok == {"same": False, "new": True, "short": True}
    from folio.operators.pages import explode_pages

    r = {x["doc_id"]: x["similarity"] for x in verify.embedded_similarity(explode_pages(docs), layer).collect()}
    assert r["new"] == pytest.approx(difflib.SequenceMatcher(None, body, other).ratio()) and r["same"] == 1 and "short" not in r


def gutter(ink):
    """By a loop, for comparison."""
    n, floor = len(ink), 0.05 * float(np.percentile(ink, 95))
    blank = [x for x in range(int(n * 0.35), int(n * 0.65)) if ink[x] <= floor]
    runs = []
    for x in blank:
        if runs and x - runs[-1][1] < 1 + (0 if x == runs[-1][1] else max(1, round(n * 0.01))):
            runs[-1][1] = x + 1
        else:
            runs.append([x, x + 1])
    if not runs:
        return 0.5, 0.0
    a, b = max(runs, key=lambda r: (r[1] - r[0], -r[0]))
    return (a + (b - a) / 2) / n, (b - a) / n


def test_gutters(spark):
    rng = np.random.default_rng(0)
    rows = []
    for k in range(30):
        ink = rng.integers(50, 100, 180 + k)
        for _ in range(rng.integers(0, 4)):
            a = rng.integers(60, 120)
            ink[a : a + rng.integers(1, 12)] = rng.integers(0, 4)
        rows.append(("d", k, 800.0, 600.0, ink.tolist()))
    got = inspection.gutters(spark.createDataFrame(rows, "doc_id string, src_page int, width double, height double, ink array<bigint>")).orderBy("src_page").collect()
    assert [(r["gutter"], r["band"]) for r in got] == [pytest.approx(gutter(np.array(r[4]))) for r in rows]


def test_splitting(spark):
    page = [80] * 90 + [0] * 20 + [80] * 90
    rows = [("d", 0, 800.0, 600.0, page), ("d", 1, 800.0, 600.0, [80] * 90 + [0] * 110), ("d", 2, 800.0, 600.0, [0] * 200), ("d", 3, 800.0, 600.0, page), ("p", 0, 500.0, 600.0, page)]
    s = spark.createDataFrame(rows, "doc_id string, src_page int, width double, height double, ink array<bigint>")
    got = inspection.split_spreads(s.where("doc_id = 'd'")).orderBy("out_page").collect()
    assert [(r["out_page"], r["src_page"], r["half"]) for r in got] == [(0, 0, "left"), (1, 0, "right"), (2, 1, "left"), (3, 3, "left"), (4, 3, "right")] and got[0]["gutter_frac"] == 0.5
    v = {r["doc_id"]: r for r in inspection.spread_verdict(s).collect()}
    assert v["d"]["is_spread"] and not v["p"]["is_spread"] and v["p"]["landscape"] == 0


@pytest.mark.parametrize(
    "text, covered, producer, verdict",
    [("x", 0.0, "", "no_text"), ("good words " * 40, 1.0, "TeX", "bad_ocr"), (("a" * 30 + " ") * 20, 0.0, "TeX", "bad_ocr"), ("good words " * 40, 0.0, "ABBYY FineReader", "bad_ocr"), ("good words " * 40, 0.5, "TeX", "born_digital"), ("", None, None, "no_text")],
)
def test_verdicts(spark, text, covered, producer, verdict):
    probe = spark.createDataFrame([("d", k, text, covered, producer) for k in range(10)], "doc_id string, page_no int, layer_text string, max_image_coverage double, producer string")
    r = inspection.analyze(probe).first()
    assert r["text_verdict"] == verdict and r["recommend_ocr"] == (verdict != "born_digital")
    assert r["estimated_seconds"] == pytest.approx(450 if r["recommend_ocr"] else 2) and r["output_pages"] == 10


def test_ink(spark):
    grey = np.full((4, 6), 250, np.uint8)
    grey[:, 2] = 10
    d = spark.createDataFrame([(grey.tobytes(), 6)], "pixels binary, width int")
    assert d.select(src.ink_profile("pixels", "width").alias("x")).first()["x"] == [0, 0, 960, 0, 0, 0]
    assert d.select(src.page_ink("pixels").alias("x")).first()["x"] == pytest.approx(((255 - grey.astype(float)).mean()) / 255)


def test_preflight(spark):
    assert {r["name"]: r["ok"] for r in src.preflight(spark).where(F.col("name") != "disk").collect()} == {"python": True, "spark": True, "arrow": True}
