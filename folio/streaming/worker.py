"""The unattended run over a queue of documents."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import patterns as P
from ..lineage import cut
from ..operators import catalog, chunks
from ..sources.documents import ChunkReader, read_overlay, run_chunks, save_overlay, updated_overlay, written_chunks

OVERLAY = "doc_id string, skip boolean, attempts int, last_error string"


def stored_overlay(spark: SparkSession, path: str) -> DataFrame:
    """The overlay of a path; no rows where nothing is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    return read_overlay(spark, path) if there else spark.createDataFrame([], OVERLAY)


def run_queue(
    documents: DataFrame, make: Callable[[], ChunkReader], store: str, overlay: str, *, size: int = P.QUEUE_CHUNK_PAGES, at_once: int = 64, room: Callable[[], bool] = lambda: True,
    most: int | None = None, pause: float = 0, sleep: Callable[[float], None] = time.sleep,
) -> list[tuple[str, int, int]]:
    """Take up one document after another (doc_id, name, pages, split, ocr) until none is open, no room is left, or so many have been taken up: (doc_id, chunks before, chunks after) of each turn.

    A turn that wrote a chunk has succeeded, whatever ended it: it clears the document's
    attempts and error. One that wrote none is an attempt; a document with too many is
    stalled and the queue goes on without it. What is skipped stays so.
    """
    spark, turns = documents.sparkSession, []
    while (most is None or len(turns) < most) and room():
        known = stored_overlay(spark, overlay)
        state = catalog.document_state(documents, written_chunks(spark, store), known, size)
        due = catalog.next_pending(state.where("pages > 0")).first()
        if due is None:
            break
        mine = F.col("doc_id") == due["doc_id"]
        plan = chunks.plan_chunks(documents.where(mine).select("doc_id", F.col("pages").alias("total_pages")), size)
        error = ""
        try:
            run_chunks(plan, make, store, at_once=at_once, room=room)
        except Exception as e:  # whatever a reader does must not end the queue; it is kept in the overlay
            error = str(e).strip().splitlines()[-1][:500] if str(e).strip() else type(e).__name__
        after = written_chunks(spark, store).where(mine).count()
        turns.append((due["doc_id"], due["chunks_done"], after))
        if after == due["chunks_done"] and not error and not room():
            break
        attempts, said = (0, "") if after > due["chunks_done"] else (due["attempts"] + 1, error or "no chunk was written")
        change = spark.createDataFrame([(due["doc_id"], None, attempts, said)], OVERLAY)
        save_overlay(cut(updated_overlay(known, change)), overlay)
        if pause:
            sleep(pause)
    return turns
