"""The unattended run as streams: new documents as they arrive, and jobs that fall silent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import patterns as P

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def arriving(spark: SparkSession, folder: str, pattern: str = "*.md", per_trigger: int = 100) -> DataFrame:
    """document (doc_id, text, arrived) of files as they appear in a folder; names that begin with a dot are left out."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_trigger).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return files.where(~name.startswith(".")).select(F.regexp_replace(F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))), r"\.[^.]*$", "").alias("doc_id"), F.decode("content", "UTF-8").alias("text"), F.col("modificationTime").alias("arrived"))


def refine_arriving(documents: DataFrame, plan: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Run a plan over each batch of documents and append its rows; a failed batch is run again from the checkpoint, so a batch's rows replace what it wrote before."""

    def batch(rows: DataFrame, number: int) -> None:
        plan(rows).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = documents.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="120 seconds")).start()


def sessions(events: DataFrame, key: str, seconds: int = P.STALL_SECONDS, late: str = "1 minute") -> DataFrame:
    """(key, began, last, events) of runs of activity: a silence longer than the limit ends one. Each session but a key's newest was followed by a stall."""
    gap = f"{seconds} seconds"
    e = events.withWatermark("ts", late).groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events"), F.max("ts").alias("last"))
    return e.select(key, F.col("w.start").alias("began"), "last", "events")


def progress(chunks: DataFrame, late: str = "10 minutes") -> DataFrame:
    """(doc_id, hour, chunks): chunks written (doc_id, written) for each hour, as a stream."""
    return chunks.withWatermark("written", late).groupBy("doc_id", F.window("written", "1 hour").alias("w")).agg(F.count("*").alias("chunks")).select("doc_id", F.col("w.start").alias("hour"), "chunks")
