"""The queue's worker, folders, providers, sinks, command line."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from folio import __main__ as cli
from folio.operators import catalog, providers, translation as tr
from folio.sources import documents as src
from folio.streaming import worker

BOOKS = "doc_id string, name string, pages int, split boolean, ocr boolean"


def stores(tmp_path):
    return str(tmp_path / "chunks"), str(tmp_path / "overlay.json")


def reader(broken=()):
    def make():
        def read(doc_id, first, last):
            if doc_id in broken:
                raise RuntimeError(f"cannot read {doc_id}")
            return f"{doc_id} {first}-{last}"

        return read

    return make


def test_the_queue_reads_all_books_by_name(spark, tmp_path):
    store, overlay = stores(tmp_path)
    docs = spark.createDataFrame([("b", "b.pdf", 12, True, True), ("a", "A.pdf", 5, True, True), ("none", "none.pdf", 0, True, True)], BOOKS)
    assert worker.run_queue(docs, reader(), store, overlay) == [("a", 0, 1), ("b", 0, 2)]
    got = src.written_chunks(spark, store).orderBy("doc_id", "first").collect()
    assert [r["text"] for r in got] == ["a 0-4", "b 0-9", "b 10-11"]
    assert worker.run_queue(docs, reader(), store, overlay) == []


def test_a_broken_book_is_stalled_after_three_attempts_and_the_rest_goes_on(spark, tmp_path):
    store, overlay = stores(tmp_path)
    docs = spark.createDataFrame([("a", "a.pdf", 5, True, True), ("b", "b.pdf", 5, True, True)], BOOKS)
    assert worker.run_queue(docs, reader({"a"}), store, overlay) == [("a", 0, 0)] * 3 + [("b", 0, 1)]
    kept = {r["doc_id"]: r for r in worker.stored_overlay(spark, overlay).collect()}
    assert kept["a"]["attempts"] == 3 and kept["a"]["last_error"] and kept["b"]["attempts"] == 0


def test_skipped_books_no_room_and_a_number_of_turns(spark, tmp_path):
    store, overlay = stores(tmp_path)
    docs = spark.createDataFrame([("a", "a.pdf", 5, True, True), ("b", "b.pdf", 5, True, True), ("c", "c.pdf", 5, True, True)], BOOKS)
    src.save_overlay(spark.createDataFrame([("a", True, 0, "")], worker.OVERLAY), overlay)
    assert worker.run_queue(docs, reader(), store, overlay, room=lambda: False) == []
    assert worker.run_queue(docs, reader(), store, overlay, most=1) == [("b", 0, 1)]
    assert worker.run_queue(docs, reader(), store, overlay) == [("c", 0, 1)]
    assert {r["doc_id"] for r in worker.stored_overlay(spark, overlay).where("skip").collect()} == {"a"}


def test_root_is_taken_only_if_its_chunks_are_of_that_file(spark):
    docs = spark.createDataFrame([("a", "/in/a.pdf"), ("b", "/in/b.pdf"), ("c", "/in/c.pdf")], "doc_id string, path string")
    folders = spark.createDataFrame([("o", 3, "/in/b.pdf", False), ("o/a", 2, None, True), ("o/c", 0, None, False)], "folder string, chunks int, owner string, images boolean")
    got = {r["doc_id"]: (r["out_dir"], r["image_dir"]) for r in catalog.output_folders(docs, folders, "o").collect()}
    assert got == {"a": ("o/a", "o/a/images"), "b": ("o", "o/b_images"), "c": ("o/c", "o/c/c_images")}
    empty = {r["doc_id"]: r["out_dir"] for r in catalog.output_folders(docs, folders.limit(0), "o").collect()}
    assert empty == {"a": "o/a", "b": "o/b", "c": "o/c"}


def test_presets_and_what_replaces_them():
    assert providers.preset().key_variable == "OPENROUTER_API_KEY"
    p = providers.preset("groq", model="m", url="http://x/v1/", key_variable="")
    assert (p.model, p.url, p.key_variable, p.per_minute) == ("m", "http://x/v1/", "", 25)
    with pytest.raises(ValueError, match="gemini, groq"):
        providers.preset("nobody")


def test_a_translator_shares_the_limit_and_asks_with_the_prompt():
    asked = []

    def transport(url, headers, body):
        asked.append((url, headers["Authorization"], json.loads(body)))
        return 200, {}, json.dumps({"choices": [{"message": {"content": "done"}}]})

    t = providers.translator(providers.preset("groq"), transport, tasks=5, environment={"GROQ_API_KEY": "k"})
    assert t("Seite", "English") == "done" and t.gap == 12.0
    url, key, body = asked[0]
    assert url == "https://api.groq.com/openai/v1/chat/completions" and key == "Bearer k"
    assert "English" in body["messages"][0]["content"] and body["messages"][1]["content"] == "Seite"
    with pytest.raises(ValueError, match="GROQ_API_KEY"):
        providers.translator(providers.preset("groq"), transport, environment={})


def test_tokens_of_all_answers_are_summed(spark):
    def body(content, finish, **usage):
        return json.dumps({"choices": [{"message": {"content": content}, "finish_reason": finish}], "usage": usage})

    rows = [("a", body("x", "stop", prompt_tokens=3, completion_tokens=2)), ("a", body("y", "length", prompt_tokens=4)), ("b", "<html>")]
    got = {r["k"]: tuple(r)[1:] for r in tr.token_usage(spark.createDataFrame(rows, "k string, body string"), "k").collect()}
    assert got == {"a": (2, 1, 7, 2), "b": (1, 1, 0, 0)}


def test_page_maps_are_in_order_and_keep_nulls(spark):
    rows = [("a", 1, 0, "right", 0.5), ("a", 0, 0, "left", 0.5), ("b", 0, 0, "whole", None)]
    maps = {r["doc_id"]: json.loads(r["body"]) for r in src.page_maps(spark.createDataFrame(rows, "doc_id string, output_page int, source_page int, half string, gutter double")).collect()}
    assert [p["half"] for p in maps["a"]] == ["left", "right"] and maps["b"][0]["gutter"] is None


def test_bundles_hold_each_documents_files(spark, tmp_path):
    rows = [("a", "a_images/1.png", b"\x89"), ("a", "a.md", b"text"), ("b", "b.md", b"")]
    made = src.bundles(spark.createDataFrame(rows, "doc_id string, file string, body binary"))
    assert src.write_files(made, str(tmp_path)).count() == 2
    with zipfile.ZipFile(io.BytesIO((tmp_path / "a" / "a.zip").read_bytes())) as z:
        assert z.namelist() == ["a.md", "a_images/1.png"] and z.read("a_images/1.png") == b"\x89"


def test_commands(spark, tmp_path):
    books, out = tmp_path / "in", tmp_path / "out"
    books.mkdir()
    (books / "one book.md").write_text("<!-- page 0 -->\n\n# Title\n\nSome words of pro-\nse here.\n")
    assert cli.run(spark, cli.parser().parse_args(["refine", str(books), str(out)])).count() == 1
    assert "# Title" in (out / "one book" / "one book.md").read_text()
    assert cli.run(spark, cli.parser().parse_args(["preflight"])).where(F.col("name") == "spark").count() == 1
    for name in ("audit", "verify"):
        cli.run(spark, cli.parser().parse_args([name, str(books)])).collect()
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["query", "nothing", "x"])
