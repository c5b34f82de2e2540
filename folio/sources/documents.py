"""Documents in, documents out.

Readers that need other libraries (PDF, OCR) plug in as callables: see read_chunks.
"""

from __future__ import annotations

import io
import os
import shutil
import uuid
import zipfile
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ..functions import patterns as P
from ..lineage import cut

#: A chunk (doc_id, first page, last page) to its Markdown.
ChunkReader = Callable[[str, int, int], str]


def _stem(path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return F.regexp_replace(F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))), r"\.[^.]*$", "")


def discover(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """(doc_id, path, mtime, size) of files, by name without regard to case; names that begin with a dot are left out. Contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return files.where(~name.startswith(".")).select(_stem(F.col("path")).alias("doc_id"), "path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size")).orderBy(F.lower(name))


def read_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """document (doc_id, text) of the Markdown files of a folder."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.md")
    return files.select(_stem(F.input_file_name()).alias("doc_id"), F.col("value").alias("text"))


def write_documents(docs: DataFrame, path: str, mode: str = "overwrite") -> None:
    """document table, committed whole or not at all."""
    docs.write.mode(mode).parquet(path)


CHUNKS = "doc_id string, first int, last int, text string"


def _below(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder that hidden files are not; none where there is no folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []


def _runs(spark: SparkSession, path: str) -> list[str]:
    """Folders of the writes that were committed, in order."""
    return [name for name in _below(spark, path) if name.startswith("run=") and "_SUCCESS" in _below(spark, f"{path}/{name}")]


def write_chunks(chunks: DataFrame, path: str) -> None:
    """chunk (doc_id, first, last, text): a write is a folder of its own, in as many files as it has tasks, committed whole or not at all. Writing some chunks replaces those and leaves all others, also of the same documents, as they are: of a chunk that was written several times the last counts."""
    spark = chunks.sparkSession
    last = max((int(name[4:16]) for name in _below(spark, path) if name.startswith("run=")), default=0)
    chunks.select("doc_id", "first", "last", "text").write.parquet(f"{path}/run={last + 1:012d}-{uuid.uuid4().hex}")


def written_chunks(spark: SparkSession, path: str) -> DataFrame:
    """chunk as write_chunks left it, ids as they were written; no rows where nothing is. A folder for each chunk (doc_id=, first=), as an earlier version wrote it, is older than all runs."""
    runs = _runs(spark, path)
    tables = [spark.read.schema(CHUNKS).parquet(f"{path}/{name}").withColumn("run", F.lit(name)) for name in runs]
    if any(name.startswith("doc_id=") for name in _below(spark, path)):
        tables.insert(0, spark.read.option("basePath", path).schema(CHUNKS).parquet(f"{path}/doc_id=*").select("doc_id", "first", "last", "text", F.lit("").alias("run")))
    if not tables:
        return spark.createDataFrame([], CHUNKS)
    every = reduce(DataFrame.union, tables)
    if len(tables) > 1:
        newest = every.groupBy("doc_id", "first").agg(F.max("run").alias("newest"), F.min("run").alias("oldest")).where("newest > oldest")
        e, n = every.alias("e"), newest.alias("n")
        every = e.join(n, F.col("e.doc_id").eqNullSafe(F.col("n.doc_id")) & F.col("e.first").eqNullSafe(F.col("n.first")), "left").where("newest is null or run = newest").select("e.*")
    return every.select("doc_id", "first", "last", "text")


def run_chunks(plan: DataFrame, make: Callable[[], ChunkReader], path: str, *, at_once: int = 64, room: Callable[[], bool] = lambda: True) -> DataFrame:
    """Read what of a plan (doc_id, first, last) is not written yet, in rounds of each document's next at_once chunks; a round is kept whatever fails later. room: asked before each round; where it says no the run ends early and cleanly. The chunks written so far."""
    spark = plan.sparkSession
    todo = plan.join(written_chunks(spark, path).select("doc_id", "first", "last"), ["doc_id", "first", "last"], "left_anti")
    order = Window.partitionBy("doc_id").orderBy("first")
    todo = cut(todo.withColumn("round", F.floor((F.row_number().over(order) - 1) / at_once)))
    for k in range(int(todo.agg(F.max("round")).first()[0] or 0) + 1 if not todo.isEmpty() else 0):
        if not room():
            break
        write_chunks(read_chunks(todo.where(F.col("round") == k), make), path)
    return written_chunks(spark, path)


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """(doc_id, file, body string or binary) written to folder/doc_id/file, a folder that all executors share; each file whole or not at all. (doc_id, file, bytes) of what was written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = []
            for r in b.to_pylist():
                home = os.path.realpath(os.path.join(folder, r["doc_id"]))
                at = os.path.realpath(os.path.join(home, r["file"]))
                if not at.startswith(os.path.realpath(folder) + os.sep) or not at.startswith(home + os.sep):
                    raise ValueError(f"{r['file']!r} is not inside its document's folder")
                os.makedirs(os.path.dirname(at), exist_ok=True)
                body = r["body"].encode() if isinstance(r["body"], str) else r["body"]
                part = f"{at}.{uuid.uuid4().hex}.part"
                with open(part, "wb") as f:
                    f.write(body)
                os.replace(part, at)
                sizes.append(len(body))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("file"), pa.array(sizes, pa.int64())], names=["doc_id", "file", "bytes"])

    return cut(files.select("doc_id", "file", "body").mapInArrow(run, "doc_id string, file string, bytes long"))


def write_markdown(docs: DataFrame, folder: str) -> DataFrame:
    """document (doc_id, text) written to folder/doc_id/doc_id.md; null texts are empty files."""
    return write_files(docs.select("doc_id", F.concat("doc_id", F.lit(".md")).alias("file"), F.coalesce("text", F.lit("")).alias("body")), folder)


def page_maps(pages: DataFrame) -> DataFrame:
    """Pages of split spreads (doc_id, output_page, source_page, half, gutter) to (doc_id, file, body): a JSON array for each document, by output page. For write_files."""
    row = F.struct("output_page", "source_page", "half", "gutter")
    body = F.to_json(F.sort_array(F.collect_list(row)), {"ignoreNullFields": "false"})
    return pages.groupBy("doc_id").agg(body.alias("body")).select("doc_id", F.lit("pagemap.json").alias("file"), "body")


def bundles(files: DataFrame) -> DataFrame:
    """(doc_id, file, body string or binary) to (doc_id, file, body): one zip archive for each document, entries by name and without times, so equal files give equal archives. A document's files are in memory together."""

    def run(table: pa.Table) -> pa.Table:
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
            for r in sorted(table.to_pylist(), key=lambda r: r["file"]):
                z.writestr(zipfile.ZipInfo(r["file"]), r["body"], zipfile.ZIP_DEFLATED)
        doc_id = table.column("doc_id")[0].as_py()
        return pa.table({"doc_id": [doc_id], "file": [f"{doc_id}.zip"], "body": pa.array([held.getvalue()], pa.binary())})

    return files.select("doc_id", "file", "body").groupBy("doc_id").applyInArrow(run, "doc_id string, file string, body binary")


def delete_files(files: DataFrame, folder: str) -> DataFrame:
    """(doc_id, file) deleted from folder/doc_id; those that were there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            gone = []
            for r in b.to_pylist():
                at = os.path.join(folder, r["doc_id"], os.path.basename(r["file"]))
                gone.append(os.path.isfile(at))
                if gone[-1]:
                    os.remove(at)
            yield b.filter(pa.array(gone, pa.bool_()))

    return cut(files.select("doc_id", "file").mapInArrow(run, "doc_id string, file string"))


def list_files(spark: SparkSession, folder: str, pattern: str = "*.md") -> DataFrame:
    """(doc_id, file) of what write_files left: a folder for each document."""
    parts = F.split("path", "/")
    decoded = lambda c: F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    return files.select(decoded(F.element_at(parts, -2)).alias("doc_id"), decoded(F.element_at(parts, -1)).alias("file"))


def copy_figures(links: DataFrame, source: str, folder: str) -> DataFrame:
    """links (doc_id, path) of figures copied from source/doc_id to folder/doc_id, shared folders: (doc_id, path, copied); copied is false for those that are missing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = []
            for r in b.to_pylist():
                old, new = (os.path.join(root, r["doc_id"], r["path"]) for root in (source, folder))
                done.append(os.path.isfile(old))
                if done[-1]:
                    os.makedirs(os.path.dirname(new), exist_ok=True)
                    shutil.copyfile(old, new)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(done, pa.bool_())], names=["doc_id", "path", "copied"])

    return cut(links.select("doc_id", "path").distinct().mapInArrow(run, "doc_id string, path string, copied boolean"))


def save_overlay(overlay: DataFrame, path: str) -> None:
    """overlay as the JSON object that read_overlay reads; fields that are null are left out. One file: a row for each document that someone edited."""
    entry = F.concat(F.to_json(F.array("doc_id")), F.lit(":"), F.to_json(F.struct("skip", "attempts", "last_error")))
    named = F.regexp_replace(entry, r"^\[(.*)\]:(\{)", "$1:$2")
    one = overlay.agg(F.concat(F.lit("{"), F.array_join(F.sort_array(F.collect_list(named)), ","), F.lit("}")).alias("value"))
    one.coalesce(1).write.mode("overwrite").text(path)


def read_chunks(pending: DataFrame, make: Callable[[], ChunkReader]) -> DataFrame:
    """chunk of what is pending (doc_id, first, last); make() builds the reader once for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = make()
        for b in batches:
            rows = b.to_pylist()
            yield pa.RecordBatch.from_pylist([r | {"text": read(r["doc_id"], r["first"], r["last"])} for r in rows], schema=b.schema.append(pa.field("text", pa.string())))

    return pending.select("doc_id", F.col("first").cast("int"), F.col("last").cast("int")).mapInArrow(run, "doc_id string, first int, last int, text string")


@F.pandas_udf(T.ArrayType(T.LongType()))
def ink_profile(pixels: pd.Series, width: pd.Series) -> pd.Series:
    """Darkness of each pixel column against the paper (the 90th percentile) of grey pixels, row by row in bytes."""

    def one(raw: bytes, w: int) -> list[int]:
        a = np.frombuffer(raw, np.uint8).reshape(-1, w).astype(np.float64)
        return np.clip(np.percentile(a, 90) - a, 0, None).sum(axis=0).astype(np.int64).tolist()

    return pd.Series([one(p, w) for p, w in zip(pixels, width)])


@F.pandas_udf(T.DoubleType())
def page_ink(pixels: pd.Series) -> pd.Series:
    """Mean darkness of grey pixels, 0 to 1."""
    return pixels.map(lambda raw: float((255 - np.frombuffer(raw, np.uint8).astype(np.float64)).mean() / 255) if raw else 0.0)


def read_outline(rows: DataFrame) -> DataFrame:
    """Bookmarks (doc_id, level, title, page from 1) to outline (doc_id, level, title, page_no from 0); blank titles go."""
    return rows.withColumn("title", F.trim("title")).where("title <> ''").select("doc_id", "level", "title", (F.col("page") - 1).alias("page_no"))


def read_overlay(spark: SparkSession, path: str) -> DataFrame:
    """overlay (doc_id, skip, attempts, last_error) from a JSON object by document; broken files give no rows."""
    kind = "map<string, struct<skip: boolean, attempts: int, last_error: string>>"
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.explode(F.from_json("value", kind)).alias("doc_id", "o")).select("doc_id", "o.skip", "o.attempts", "o.last_error")


def updated_overlay(overlay: DataFrame, changes: DataFrame) -> DataFrame:
    """overlay with the fields of changes that are not null."""
    o, c = overlay.alias("o"), changes.alias("c")
    joined = o.join(c, F.col("o.doc_id") == F.col("c.doc_id"), "full")
    return joined.select(*[F.coalesce(f"c.{k}", f"o.{k}").alias(k) for k in ("doc_id", "skip", "attempts", "last_error")])


def preflight(spark: SparkSession) -> DataFrame:
    """finding rows (name, ok, detail): Spark, Arrow, and room in the scratch folder of the driver."""
    import sys

    free = shutil.disk_usage("/").free / 1e9
    rows = [
        ("python", sys.version_info >= (3, 10), sys.version.split()[0]),
        ("spark", int(spark.version.split(".")[0]) >= 4, spark.version),
        ("arrow", True, pa.__version__),
        ("disk", free >= P.PREFLIGHT_GB, f"{free:.1f} GB free"),
    ]
    return spark.createDataFrame(rows, "name string, ok boolean, detail string")
