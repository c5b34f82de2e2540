"""The catalog of documents: state of each, what comes next, and how jobs stand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import patterns as P


def fraction(done: Column, total: Column) -> Column:
    return F.when(F.coalesce(total, F.lit(0)) <= 0, 0.0).otherwise(F.least(F.lit(1.0), done / total))


def document_state(documents: DataFrame, chunks: DataFrame, overlay: DataFrame, size: int = P.QUEUE_CHUNK_PAGES) -> DataFrame:
    """documents (doc_id, name, pages, split, ocr), written chunks (doc_id, first, last) and overlay (doc_id, skip, attempts, last_error) to a row for each document. status: skipped before done before stalled before in progress before pending."""
    done = chunks.groupBy("doc_id").agg(F.count("*").alias("chunks_done"))
    d = documents.join(done, "doc_id", "left").join(overlay, "doc_id", "left")
    d = d.select(
        "doc_id", "name", F.coalesce("pages", F.lit(0)).alias("pages"), F.coalesce("split", F.lit(True)).alias("split"), F.coalesce("ocr", F.lit(True)).alias("ocr"), F.coalesce("skip", F.lit(False)).alias("skip"),
        F.coalesce("attempts", F.lit(0)).alias("attempts"), F.coalesce("last_error", F.lit("")).alias("last_error"), F.coalesce("chunks_done", F.lit(0)).alias("chunks_done"), F.ceil(F.coalesce("pages", F.lit(0)) / size).alias("chunks_total"),
    )
    finished = (F.col("chunks_total") > 0) & (F.col("chunks_done") >= F.col("chunks_total"))
    status = F.when(F.col("skip"), "skipped").when(finished, "done").when(F.col("attempts") >= P.ATTEMPTS, "stalled").when(F.col("chunks_done") > 0, "in progress").otherwise("pending")
    return d.select("*", status.alias("status"), fraction(F.col("chunks_done"), F.col("chunks_total")).alias("fraction"))


def next_pending(state: DataFrame) -> DataFrame:
    """The one document to take up next: started ones first, then by name."""
    open_ = state.where(F.col("status").isin("pending", "in progress"))
    return open_.orderBy((F.col("chunks_done") == 0), F.lower("name"), "doc_id").limit(1)


def attempts(runs: DataFrame) -> DataFrame:
    """runs (doc_id, at, progressed, error) to overlay columns: runs since the last that progressed, and the last error of those."""
    last = F.max(F.when(F.col("progressed"), F.col("at"))).over(Window.partitionBy("doc_id"))
    r = runs.withColumn("since", F.coalesce(F.col("at") > last, F.lit(True)))
    return r.groupBy("doc_id").agg(F.count_if("since").alias("attempts"), F.coalesce(F.max_by("error", F.when(F.col("since"), F.col("at"))), F.lit("")).alias("last_error"))


def fresh_analysis(files: DataFrame, cached: DataFrame) -> DataFrame:
    """files (doc_id, mtime, size) whose cached analysis is missing or of another file."""
    return files.join(cached.select("doc_id", "mtime", "size"), ["doc_id", "mtime", "size"], "left_anti")


def job_status(jobs: DataFrame, log_lines: DataFrame, chunks: DataFrame) -> DataFrame:
    """jobs (doc_id, running, total_pages, chunk_pages), the tail of their logs (doc_id, line_no, text) and written chunks to (doc_id, running, chunks_done, chunks_total, fraction, stopped_early, finished, page_seconds)."""
    rate = F.regexp_extract("text", r"([0-9.]+)s/page", 1)
    said = log_lines.groupBy("doc_id").agg(F.bool_or(F.contains("text", F.lit("STOPPING"))).alias("stopped"), F.bool_or(F.contains("text", F.lit("Concatenated"))).alias("joined"), F.max_by(rate.try_cast("double"), F.when(rate != "", F.col("line_no"))).alias("page_seconds"))
    done = chunks.groupBy("doc_id").agg(F.count("*").alias("chunks_done"))
    j = jobs.join(said, "doc_id", "left").join(done, "doc_id", "left").withColumn("total", F.ceil(F.col("total_pages") / F.col("chunk_pages"))).withColumn("done", F.coalesce("chunks_done", F.lit(0)))
    return j.select("doc_id", "running", F.col("done").alias("chunks_done"), F.col("total").alias("chunks_total"), fraction(F.col("done"), F.col("total")).alias("fraction"), F.coalesce("stopped", F.lit(False)).alias("stopped_early"), (~F.col("running") & F.coalesce("joined", F.lit(False))).alias("finished"), "page_seconds")


def log_tail(lines: DataFrame, most: int = 12) -> DataFrame:
    """The last lines with ink of each log (doc_id, line_no, text)."""
    back = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("line_no").desc()))
    return lines.where(F.trim("text") != "").withColumn("__b", back).where(F.col("__b") <= most).drop("__b")


def active_runs(commands: DataFrame) -> DataFrame:
    """(pid, pdf, out_dir) of processes by what they work on: (pdf, out_dir, pids)."""
    return commands.where("pdf is not null").groupBy("pdf", "out_dir").agg(F.sort_array(F.collect_list("pid")).alias("pids"))


def silent(events: DataFrame, key: str, now: Column, seconds: int = P.STALL_SECONDS) -> DataFrame:
    """(key, since, idle): what has been silent for longer than the limit until now."""
    last = events.groupBy(key).agg(F.max("ts").alias("since")).withColumn("idle", F.unix_timestamp(now) - F.unix_timestamp("since"))
    return last.where(F.col("idle") > seconds)


def stalls(events: DataFrame, key: str, seconds: int = P.STALL_SECONDS) -> DataFrame:
    """(key, since, until, idle): silences longer than the limit between events (key, ts) in a row."""
    before = F.lag("ts").over(Window.partitionBy(key).orderBy("ts"))
    e = events.select(key, before.alias("since"), F.col("ts").alias("until")).withColumn("idle", F.unix_timestamp("until") - F.unix_timestamp("since"))
    return e.where(F.col("idle") > seconds)


def output_folders(documents: DataFrame, folders: DataFrame, root: str) -> DataFrame:
    """documents (doc_id, path) and what is on disk (folder, chunks, owner, images) to (doc_id, out_dir, image_dir). A document works in its own folder below root; in root itself only if its own has no chunks and root's are known to be of its file (owner). Figures go to <doc_id>_images, or to images where the folder has that already, so that links of earlier chunks stay right."""
    own = F.concat(F.lit(f"{root}/"), F.col("doc_id"))
    began = folders.where("chunks > 0")
    mine = began.select(F.col("folder").alias("own")).distinct()
    old = began.where(F.col("folder") == root).select(F.col("owner").alias("path"), F.lit(True).alias("in_root")).distinct()
    with_images = folders.where("images").select(F.col("folder").alias("out_dir"), F.lit(True).alias("images")).distinct()
    d = documents.select("doc_id", "path", own.alias("own")).join(mine.withColumn("begun", F.lit(True)), "own", "left").join(old, "path", "left")
    d = d.withColumn("out_dir", F.when(F.col("begun").isNull() & F.col("in_root"), F.lit(root)).otherwise(F.col("own"))).join(with_images, "out_dir", "left")
    return d.select("doc_id", "out_dir", F.concat("out_dir", F.when(F.col("images"), F.lit("/images")).otherwise(F.concat(F.lit("/"), F.col("doc_id"), F.lit("_images")))).alias("image_dir"))
