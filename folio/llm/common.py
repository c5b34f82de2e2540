"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Words are runs of anything but ASCII blanks.
WORD = "[^\\x20\\x09-\\x0D]+"
#: Bytes of an Arrow batch, about.
BATCH_BYTES = 16 << 20


def tune(spark: SparkSession, rows: int = 1000) -> None:
    """Keep Arrow batches small, in rows and in bytes: rows can hold very long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``, or one in the warehouse where that is unset (tests)."""
    sc = spark.sparkContext
    have = sc._jsc.sc().getCheckpointDir()
    path = sc.getConf().get("spark.checkpoint.dir")
    if have.isEmpty():
        sc.setCheckpointDir(path or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints")
        have = sc._jsc.sc().getCheckpointDir()
    return (path or str(have.get())).rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def plain(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only id and text (null: empty), so further columns with clashing names do no harm."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def fresh(columns: list[str], *names: str) -> list[str]:
    """Column names that none of the given ones equals, in any case."""
    have = {c.lower() for c in columns}
    out = []
    for n in names:
        while n.lower() in have:
            n = f"_{n}"
        have.add(n.lower())
        out.append(n)
    return out
