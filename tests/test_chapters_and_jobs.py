"""Chapters, chunks, translation, catalog, streams, sources."""

import json
import time

import pytest
from pyspark.sql import functions as F

from folio.operators import catalog, chapters as ch, chunks, pages, translation as tr
from folio.sources import documents as src
from folio.streaming import watch

DOC = "doc_id string, text string"


def book(*parts, size=600):
    """A book with an anchor above each part and filler text in it."""
    out = []
    for k, (heading, factor) in enumerate(parts):
        out.append(f"<!-- page {k} -->\n{heading}\n" + "\n".join("word " * 10 + f"line {j}" for j in range(factor * size // 60)))
    return "\n".join(out) + "\n"


def split(spark, text, **more):
    return ch.split_chapters(spark.createDataFrame([("b", text)], DOC), **more).orderBy("n").collect()


def test_chapters(spark):
    text = book(("# Front Page Title", 1), ("# One", 3), ("## inner", 2), ("# Two: *b*", 3))
    got = split(spark, text, section=100)
    assert [r["title"] for r in got] == ["Front matter", "Front matter", "inner", "Front matter"]  # titles are of the level chosen
    assert [(r["first_page"], r["last_page"]) for r in got] == [(0, 0), (1, 1), (2, 2), (3, 3)]
    got = split(spark, text, section=1500)
    assert [r["title"] for r in got] == ["Front Page Title", "One", "Two b"]
    assert [(r["first_page"], r["last_page"]) for r in got] == [(0, 0), (1, 2), (3, 3)]
    joined = "".join(r["body"] for r in got)
    assert [x for x in joined.split("\n") if x] == [x for x in text.split("\n") if x]  # nothing lost, nothing twice
    assert all(r["body"].startswith("<!-- page") and r["body"].endswith("\n") for r in got)


def test_small_pieces_join_the_next(spark):
    got = split(spark, book(("# Part", 0), ("# One", 2), ("# Two", 2), ("# Stray", 0)), level=1)
    assert [r["title"] for r in got] == ["Part", "Two"] and "Stray" in got[1]["body"] and "# One" in got[0]["body"]


def test_no_headings_and_oversized(spark):
    got = split(spark, book(*[("", 2)] * 10), most=4000)
    assert [r["title"] for r in got] == [f"Front matter ({k})" for k in (1, 2, 3)] and got[0]["first_page"] == 0 and got[-1]["last_page"] == 9
    assert [r["title"] for r in split(spark, "just text\n")] == ["Front matter"]


def test_chapter_that_opens_mid_page_says_which(spark):
    text = "<!-- page 1 -->\n# A\n" + "word " * 200 + "\n\n# B\n" + "word " * 200 + "\n"
    got = split(spark, text, level=1)
    assert got[1]["body"].startswith("<!-- page 1 -->\n\n\n# B") and got[0]["body"].count("<!-- page 1 -->") == 1


def test_headings_in_fences_are_no_headings(spark):
    text = "# A\n" + "word " * 200 + "\n```\n# not\n" + "word " * 200 + "\n```\n# B\n" + "word " * 200
    assert [r["title"] for r in split(spark, text, level=1)] == ["A", "B"]


def test_notes_follow_their_references(spark):
    text = "# A\nsee[^1] and[^2] " + "word " * 200 + "\n\n# B\nmore[^2] " + "word " * 200 + "\n\n[^1]: first\n    goes on\n[^2]: second\n"
    a, b = split(spark, text, level=1)
    assert a["body"].endswith("\n\n[^1]: first\n    goes on\n[^2]: second\n") and a["notes_moved"] == 2
    assert "[^1]:" not in b["body"] and "[^2]: second" in b["body"]


def test_export(spark):
    text = "".join(f"<!-- page {k} -->\n# Ch {'abcdefghij'[k // 10]}{k}\n" + "word " * 200 + "\n" for k in range(70))
    docs = spark.createDataFrame([("2001_Doe_TheBook", text), ("article", "<!-- page 1 -->\nshort")], DOC)
    files = {r["file"]: r["body"] for r in ch.export_manifest(docs, section=100).collect()}
    assert len(files) == 71 and "TheBook 01 Ch a0.md" in files and files["TheBook 00 Contents.md"].startswith("# TheBook\n\n- [[TheBook 01 Ch a0]] · p. 0\n")
    listing = spark.createDataFrame([("2001_Doe_TheBook", f) for f in ("TheBook 01 Ch a0.md", "TheBook 99 Old.md", "TheBook notes.md", "Other 01 x.md")], "doc_id string, file string")
    assert [r["file"] for r in ch.stale_files(listing, ch.export_manifest(docs, section=100)).collect()] == ["TheBook 99 Old.md"]


def test_image_links(spark):
    body = "![](a%20b/f.png) ![](http://x/y.png) ![](/abs.png) ![](../out.png) ![](in/../ok.png) ![](data:xx) ![](in/../../no.png)"
    got = ch.image_links(spark.createDataFrame([("b", 1, body)], "doc_id string, n int, body string")).collect()
    assert {r["path"] for r in got} == {"a b/f.png", "in/../ok.png"}


def test_chunks(spark):
    plan = chunks.plan_chunks(spark.createDataFrame([("a", 45), ("b", 20), ("c", 0)], "doc_id string, total_pages int"))
    assert sorted((r["doc_id"], r["first"], r["last"]) for r in plan.collect()) == [("a", 0, 19), ("a", 20, 39), ("a", 40, 44), ("b", 0, 19)]
    written = spark.createDataFrame([("a", 0, 19, " x [l](#page-1-0) "), ("a", 40, 44, "z"), ("b", 0, 19, "b"), ("b", 0, 9, "stale")], "doc_id string, first int, last int, text string")
    assert [tuple(r) for r in chunks.pending_chunks(plan, written).collect()] == [("a", 20, 39)]
    assert chunks.missing_chunks(plan, written).first()["missing"] == "0020-0039.md" and chunks.pending_chunks(plan, written, resume=False).count() == 4
    assert {r["doc_id"]: (r["text"], r["missing"]) for r in chunks.joined(written, plan).collect()} == {"a": (None, "0020-0039.md"), "b": ("b\n", None)}  # the stale chunk is left out
    with pytest.raises(Exception, match="a lacks chunks: 0020-0039.md"):
        chunks.concatenate(written, plan).collect()
    whole = written.union(spark.createDataFrame([("a", 20, 39, "y")], written.schema))
    assert {r["doc_id"]: r["text"] for r in chunks.concatenate(whole, plan).collect()}["a"] == "x [l](#c0000-page-1-0)\n\ny\n\nz\n"


def test_chunks_are_read_and_resumed(spark, tmp_path):
    plan = chunks.plan_chunks(spark.createDataFrame([("a", 45)], "doc_id string, total_pages int"))
    out = f"{tmp_path}/chunks"
    read = src.read_chunks(plan.where("first < 40"), lambda: lambda d, a, b: f"{d} {a}-{b}")
    src.write_chunks(read, out)
    have = spark.read.parquet(out)
    assert sorted(r["text"] for r in have.collect()) == ["a 0-19", "a 20-39"] and chunks.pending_chunks(plan, have).count() == 1


def test_resuming_keeps_what_is_written(spark, tmp_path):
    plan = chunks.plan_chunks(spark.createDataFrame([("007", 45), ("8", 20)], "doc_id string, total_pages int"))
    out = f"{tmp_path}/chunks"

    def failing():
        def read(d, a, b):
            if a == 40:
                raise OSError("page 41 cannot be read")
            return f"{d} {a}-{b}"

        return read

    with pytest.raises(Exception, match="page 41"):
        src.run_chunks(plan, failing, out, at_once=1)
    assert sorted(r["text"] for r in src.written_chunks(spark, out).collect()) == ["007 0-19", "007 20-39", "8 0-19"]
    assert src.run_chunks(plan, failing, out, room=lambda: False).count() == 3  # no room: a clean end
    got = src.run_chunks(plan, lambda: lambda d, a, b: f"again {a}", out)  # only what was missing
    assert sorted((r["doc_id"], r["text"]) for r in got.collect()) == [("007", "007 0-19"), ("007", "007 20-39"), ("007", "again 40"), ("8", "8 0-19")]
    src.write_chunks(spark.createDataFrame([("007", 20, 39, "new")], src.CHUNKS), out)
    assert {r["doc_id"]: r["text"] for r in chunks.concatenate(src.written_chunks(spark, out), plan).collect()} == {"007": "007 0-19\n\nnew\n\nagain 40\n", "8": "8 0-19\n"}


def test_translation_goes_on_where_it_stopped(spark, tmp_path):
    p = spark.createDataFrame([("d", k, k, f"page {k}" if k != 2 else " ") for k in range(6)], "doc_id string, seq int, page_no int, body string")
    log = tmp_path / "asked"

    def make(bad):
        def one(text, target):
            if text == bad:
                raise RuntimeError("refused")
            with open(log, "a") as f:
                f.write(text + "\n")
            return text.upper()

        return lambda: one

    with pytest.raises(Exception, match="refused"):
        tr.translate_document(p, make("page 4"), f"{tmp_path}/store", at_once=2)
    got = tr.translate_document(p, make(None), f"{tmp_path}/store", at_once=2)
    assert [r["answer"] for r in got.orderBy("seq").collect()] == ["PAGE 0", "PAGE 1", None, "PAGE 3", "PAGE 4", "PAGE 5"]
    assert sorted(log.read_text().split("\n")).count("page 0") == 1 == log.read_text().count("page 3")


def test_http_translator():
    now, slept, sent = [0.0], [], []
    answer = '{"choices": [{"message": {"content": "Gut"}, "finish_reason": "stop"}], "usage": {"prompt_tokens": 3, "completion_tokens": 2}}'
    replies = [(429, {"Retry-After": "7"}, ""), (503, {}, ""), (200, {}, answer), (200, {}, answer)]

    def transport(url, headers, body):
        sent.append(now[0])
        return replies.pop(0)

    def sleep(s):
        slept.append(s)
        now[0] += s

    t = tr.HttpTranslator(transport, "http://x", "k", "m", lambda target: f"to {target}", per_minute=20, clock=lambda: now[0], sleep=sleep)
    assert t("Good", "German") == "Gut" == t("Good", "German")
    assert slept == [7.0, 2.0, 1.0, 3.0] and (t.input_tokens, t.output_tokens) == (6, 4)  # the pace adds 1 s and 3 s
    for status, body, match in ((400, "no such model", "no such model"), (200, "<html>", "not a completion"), (200, '{"choices": []}', "not a completion"), (200, '{"choices": [{"message": {"content": "x"}, "finish_reason": "length"}]}', "cut off")):
        with pytest.raises(tr.Refused, match=match):
            tr.HttpTranslator(lambda *a: (status, {}, body), "u", "k", "m", str, sleep=sleep, clock=lambda: now[0])("p", "x")
    with pytest.raises(tr.Refused, match="500"):
        tr.HttpTranslator(lambda *a: (500, {}, ""), "u", "k", "m", str, retries=2, sleep=sleep, clock=lambda: now[0])("p", "x")
    assert tr.wait_seconds(9, None) == 120 and tr.wait_seconds(0, "999") == 300 and tr.wait_seconds(3, "soon") == 8


def test_models_refused(spark):
    d = spark.createDataFrame([("p", "no key")], "provider string, body string")
    assert tr.listed_models(d).first()["models"] is None
    with pytest.raises(Exception, match="does not list its models: no key"):
        tr.listed_models(d, refuse=True).collect()


def test_export_writes_and_cleans(spark, tmp_path):
    text = "".join(f"<!-- page {k} -->\n\n" + (f"# Part {k // 35}\n\n![](fig/{k}.png)\n\n" if k % 35 == 0 else "") + "words " * 200 + "\n\n" for k in range(70))
    d = spark.createDataFrame([("My Book", text)], "doc_id string, text string")
    (tmp_path / "in/My Book/fig").mkdir(parents=True)
    (tmp_path / "in/My Book/fig/0.png").write_bytes(b"png")
    out = tmp_path / "out/My Book"
    out.mkdir(parents=True)
    prefix = spark.createDataFrame([("My Book",)], "d string").select(ch.book_prefix(F.col("d")).alias("p")).first()["p"]
    (out / f"{prefix} 09 Gone.md").write_text("old")
    (out / "Own notes.md").write_text("mine")
    written, gone, copied = ch.export_chapters(d, str(tmp_path / "out"), str(tmp_path / "in"))
    assert sorted(r["file"] for r in written.collect()) == sorted(p.name for p in out.glob("*.md") if p.name != "Own notes.md") and written.count() == 3
    assert [r["file"] for r in gone.collect()] == [f"{prefix} 09 Gone.md"] and (out / "Own notes.md").exists()
    assert {r["path"]: r["copied"] for r in copied.collect()} == {"fig/0.png": True, "fig/35.png": False} and (out / "fig/0.png").read_bytes() == b"png"
    with pytest.raises(Exception, match="not inside"):
        src.write_files(spark.createDataFrame([("b", "../../x.md", "x")], "doc_id string, file string, body string"), str(tmp_path / "out"))


def test_overlay_round_trip(spark, tmp_path):
    rows = [('a "b"', True, 2, None), ("c: [d]", None, 0, "x")]
    d = spark.createDataFrame(rows, "doc_id string, skip boolean, attempts int, last_error string")
    src.save_overlay(d, f"{tmp_path}/overlay")
    assert sorted(map(tuple, src.read_overlay(spark, f"{tmp_path}/overlay").collect())) == sorted(rows)


def test_silent_now(spark):
    from folio.operators import catalog

    d = spark.createDataFrame([("a", "2024-01-01 10:00:00"), ("a", "2024-01-01 10:30:00"), ("b", "2024-01-01 10:49:00")], "job string, at string").select("job", F.to_timestamp("at").alias("ts"))
    got = catalog.silent(d, "job", F.to_timestamp(F.lit("2024-01-01 11:00:00"))).collect()
    assert [(r["job"], r["idle"]) for r in got] == [("a", 1800)]


def test_translation(spark):
    p = spark.createDataFrame([("d", 0, 3, "Ein Satz[^p3-1] ![](a.png)", True), ("d", 1, 4, "  ", True), ("d", 2, 5, "Drei[^p5-1]", True)], "doc_id string, seq int, page_no int, body string, anchored boolean")
    answers = tr.translate_pages(p, lambda: lambda text, target: f"```\n{target}: {text.replace('[^p5-1]', '[^1]')}\n```")
    j = tr.judged(answers)
    assert {r["seq"]: r["drift"] for r in j.collect()} == {0: False, 1: False, 2: True}
    assert tr.rendered(j).first()["text"] == "<!-- page 3 -->\n\nEnglish: Ein Satz[^p3-1] ![](a.png)\n\n<!-- page 5 -->\n\nEnglish: Drei[^1]"
    s = tr.translation_stats(j).first()
    assert (s["pages"], s["pages_translated"], s["pages_blank"], s["markup_drift"]) == (3, 2, 1, [5])
    with pytest.raises(Exception, match="empty translation"):
        tr.translate_pages(p, lambda: lambda text, target: " ").collect()


def test_models(spark):
    entries = [
        {"id": "b"}, {"id": "a", "active": True, "input_modalities": ["text"], "max_completion_tokens": 8000}, {"id": "off", "active": False}, {"id": "speech", "output_modalities": ["audio"]}, {"id": "small", "max_output_length": 512},
        {"id": "b"}, {"id": ""}, {"noid": 1}, {"id": "odd", "max_completion_tokens": "lots"}, {"id": "none", "input_modalities": []},
    ]
    d = spark.createDataFrame([("p", json.dumps({"data": entries})), ("q", "<html>")], "provider string, body string")
    assert {r["provider"]: r["models"] for r in tr.listed_models(d).collect()} == {"p": ["a", "b", "none", "odd"], "q": None}


def test_answers(spark):
    good = {"choices": [{"message": {"content": "Hi"}, "finish_reason": "stop"}], "usage": {"prompt_tokens": 3, "completion_tokens": 1}}
    cut = {"choices": [{"message": {"content": "Hi"}, "finish_reason": "length"}]}
    d = spark.createDataFrame([(0, json.dumps(good)), (1, json.dumps(cut)), (2, "<html>"), (3, "{}"), (4, json.dumps({"choices": [{"message": {"content": " "}}]}))], "k int, body string")
    got = {r["k"]: r for r in tr.read_answers(d).collect()}
    assert [got[k]["problem"] for k in range(5)] == [None, "truncated", "not JSON", "shape", "empty"] and got[0]["content"] == "Hi" and got[0]["input_tokens"] == 3


def test_catalog(spark):
    docs = spark.createDataFrame([(n, f"{n}.pdf", p, None, None) for n, p in (("Skip", 30), ("done", 20), ("stall", 30), ("b-begun", 30), ("A-new", 30), ("none", 0))], "doc_id string, name string, pages int, split boolean, ocr boolean")
    have = spark.createDataFrame([("done", 0, 9), ("done", 10, 19), ("b-begun", 0, 9), ("Skip", 0, 9)], "doc_id string, first int, last int")
    overlay = spark.createDataFrame([("Skip", True, 0, ""), ("stall", None, 3, "boom")], "doc_id string, skip boolean, attempts int, last_error string")
    s = catalog.document_state(docs, have, overlay)
    assert {r["doc_id"]: r["status"] for r in s.collect()} == {"Skip": "skipped", "done": "done", "stall": "stalled", "b-begun": "in progress", "A-new": "pending", "none": "pending"}
    assert catalog.next_pending(s).first()["doc_id"] == "b-begun" and catalog.next_pending(s.where("chunks_done = 0")).first()["doc_id"] == "A-new"
    assert s.where("doc_id = 'b-begun'").first()["fraction"] == pytest.approx(1 / 3)


def test_attempts(spark):
    runs = spark.createDataFrame([("a", 1, False, "x"), ("a", 2, True, ""), ("a", 3, False, "y"), ("a", 4, False, "z"), ("b", 1, True, "")], "doc_id string, at int, progressed boolean, error string")
    assert {r["doc_id"]: (r["attempts"], r["last_error"]) for r in catalog.attempts(runs).collect()} == {"a": (2, "z"), "b": (0, "")}


def test_job_status(spark):
    jobs = spark.createDataFrame([("a", True, 45, 10), ("b", False, 20, 10)], "doc_id string, running boolean, total_pages int, chunk_pages int")
    log = spark.createDataFrame([("a", 0, "47.4s/page"), ("a", 1, "44.9s/page"), ("a", 2, "STOPPING now"), ("b", 0, "Concatenated 2 chunks")], "doc_id string, line_no int, text string")
    have = spark.createDataFrame([("a", 0, 9), ("b", 0, 9), ("b", 10, 19)], "doc_id string, first int, last int")
    got = {r["doc_id"]: r for r in catalog.job_status(jobs, log, have).collect()}
    assert (got["a"]["chunks_total"], got["a"]["page_seconds"], got["a"]["stopped_early"], got["a"]["finished"]) == (5, 44.9, True, False) and got["b"]["finished"] and got["b"]["fraction"] == 1
    assert [r["line_no"] for r in catalog.log_tail(log.where("doc_id = 'a'"), 2).orderBy("line_no").collect()] == [1, 2]
    runs = spark.createDataFrame([(1, "a.pdf", "o"), (2, "a.pdf", "o"), (3, None, None)], "pid int, pdf string, out_dir string")
    assert [tuple(r) for r in catalog.active_runs(runs).collect()] == [("a.pdf", "o", [1, 2])]


def test_stalls_batch_and_stream_agree(spark, tmp_path):
    rows = [("j", t) for t in (0, 600, 1700, 3000, 3100, 9000)] + [("k", 50)]
    e = spark.createDataFrame(rows, "job string, s long").select("job", F.timestamp_seconds("s").alias("ts"))
    assert [(r["since"].timestamp(), r["idle"]) for r in catalog.stalls(e, "job").orderBy("since").collect()] == [(1700, 1300), (3100, 5900)]
    # the last row moves the watermark past all sessions
    e.union(spark.sql("SELECT 'z', timestamp_seconds(100000)")).write.parquet(f"{tmp_path}/events")
    stream = spark.readStream.schema("job string, ts timestamp").parquet(f"{tmp_path}/events")
    q = watch.sessions(stream, "job").writeStream.outputMode("append").format("memory").queryName("sessions").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["job"], r["began"].timestamp(), r["last"].timestamp(), r["events"]) for r in spark.table("sessions").collect()}
    assert got == {("j", 0, 1700, 3), ("j", 3000, 3100, 2), ("j", 9000, 9000, 1), ("k", 50, 50, 1)}


def test_documents_as_they_arrive(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "A book.md").write_text("{0}----------\nthe under-\nstanding of understanding")
    (folder / ".hidden.md").write_text("no")
    from folio.plans.refine import refine

    def run():
        q = watch.refine_arriving(watch.arriving(spark, str(folder)), lambda d: refine(d.select("doc_id", "text")), f"{tmp_path}/out", f"{tmp_path}/ck")
        q.awaitTermination(180)
        assert q.exception() is None
        return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}

    assert run() == {"A book": "<!-- page 0 -->\n\nthe understanding of understanding"}
    time.sleep(0.1)
    (folder / "B.md").write_text("{0}----------\nnew")
    assert set(run()) == {"A book", "B"}  # only the new one was read


def test_sources(spark, tmp_path):
    (tmp_path / "b x.md").write_text("two")
    (tmp_path / "A.md").write_text("one\n")
    (tmp_path / ".c.md").write_text("no")
    assert {r["doc_id"]: r["text"] for r in src.read_markdown(spark, str(tmp_path)).collect()} == {"A": "one\n", "b x": "two"}
    found = src.discover(spark, str(tmp_path), "*.md")
    assert [r["doc_id"] for r in found.collect()] == ["A", "b x"] and found.columns == ["doc_id", "path", "mtime", "size"]
    (tmp_path / "queue.json").write_text(json.dumps({"A": {"skip": True}, "B": {"attempts": 2, "last_error": "x"}}))
    o = src.read_overlay(spark, f"{tmp_path}/queue.json")
    assert {r["doc_id"]: (r["skip"], r["attempts"]) for r in o.collect()} == {"A": (True, None), "B": (None, 2)}
    new = src.updated_overlay(o, spark.createDataFrame([("B", True, None, None), ("C", False, 1, "y")], o.schema))
    assert {r["doc_id"]: (r["skip"], r["attempts"]) for r in new.collect()} == {"A": (True, None), "B": (True, 2), "C": (False, 1)}
    (tmp_path / "broken.json").write_text("{nope")
    assert src.read_overlay(spark, f"{tmp_path}/broken.json").count() == 0
    out = src.read_outline(spark.createDataFrame([("d", 1, " A ", 1), ("d", 1, "  ", 2)], "doc_id string, level int, title string, page int"))
    assert [tuple(r) for r in out.collect()] == [("d", 1, "A", 0)]
    known = spark.createDataFrame([("a", 1, 5), ("b", 1, 6)], "doc_id string, mtime int, size int")
    assert [r["doc_id"] for r in catalog.fresh_analysis(known, known.where("doc_id = 'a'")).collect()] == ["b"]


def test_chunks_in_few_files(spark, tmp_path):
    """A write has files by its tasks, not by its chunks; a write that was not committed does not count."""
    out = str(tmp_path / "many")
    rows = [(f"d{k % 40}", k // 40 * 20, k // 40 * 20 + 19, f"text {k}") for k in range(200)]
    src.write_chunks(spark.createDataFrame(rows, src.CHUNKS).coalesce(2), out)
    src.write_chunks(spark.createDataFrame([("d3", 20, 39, "again")], src.CHUNKS).coalesce(1), out)
    files = list((tmp_path / "many").rglob("*.parquet"))
    assert len(files) <= 3
    want = sorted((d, a, z, "again" if (d, a) == ("d3", 20) else t) for d, a, z, t in rows)
    assert sorted(map(tuple, src.written_chunks(spark, out).collect())) == want
    broken = tmp_path / "many" / "run=000000000009-x"
    broken.mkdir()
    (broken / "part-0.parquet").write_bytes(files[0].read_bytes())
    assert sorted(map(tuple, src.written_chunks(spark, out).collect())) == want


def test_chunks_of_the_earlier_layout(spark, tmp_path):
    out = str(tmp_path / "old")
    spark.createDataFrame([("007", 0, 19, "a"), ("007", 20, 39, "b")], src.CHUNKS).write.partitionBy("doc_id", "first").parquet(out)
    src.write_chunks(spark.createDataFrame([("007", 20, 39, "new")], src.CHUNKS), out)
    assert sorted(map(tuple, src.written_chunks(spark, out).collect())) == [("007", 0, 19, "a"), ("007", 20, 39, "new")]


def test_chapters_cut_without_text(spark):
    """Lines that are no headings go through the windows without their text; a chapter is a slice of the document."""
    text = "<!-- page 1 -->\n\nFront text\n\n# One\n\nBody of one.\r\n\n<!-- page 2 -->\n# Two\n```\n# no heading\n```\nEnd.\n\n\n"
    docs = spark.createDataFrame([("b", text)], "doc_id string, text string")
    slim = pages.explode_lines(docs, slim=True).orderBy("line_no").collect()
    assert {r["text"] for r in slim} == {None, "# One", "# Two", "# no heading"} and [r["text"] for r in slim if r["level"]] == ["# One", "# Two"]
    got = ch.raw_chapters(docs, 1, least=1).orderBy("n").collect()
    assert [r["body"] for r in got] == ["<!-- page 1 -->\n\nFront text\n", "<!-- page 1 -->\n\n\n# One\n\nBody of one.\n", "<!-- page 2 -->\n# Two\n```\n# no heading\n```\nEnd.\n"]
