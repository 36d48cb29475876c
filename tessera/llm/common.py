"""Shared plumbing: the shared folder, durable lineage cuts and Arrow helpers."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and every executor see.

    It is what ``spark.checkpoint.dir`` names. Only a session on one machine (a master local[..]) may
    be without that setting, and gets a temporary folder of its own; on a cluster that is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    have = sc._jsc.sc().getCheckpointDir()
    if named:
        if have.isEmpty():
            sc.setCheckpointDir(named)
        return named.rstrip("/")
    if have.isEmpty():
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-checkpoints-"))
        have = sc._jsc.sc().getCheckpointDir()
    return have.get().rstrip("/")


def new_path(spark: SparkSession, stem: str) -> str:
    return f"{shared_dir(spark)}/{stem}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a folder that new_path named, in whatever file system it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """Materialises df in the shared folder and forgets its lineage; lost executors lose nothing of it.

    Spark deletes the files once the frame is no longer referenced (where the session
    sets ``spark.cleaner.referenceTracking.cleanCheckpoints``). The frame is built anew over the
    checkpointed rows: a plan over checkpoint()'s own frame would carry estimates of the old plan's size,
    and broadcast by them what is not small.
    """
    spark = df.sparkSession
    shared_dir(spark)
    kept = df.checkpoint(eager=True)._jdf
    fresh = spark._jsparkSession.internalCreateDataFrame(kept.queryExecution().toRdd(), kept.schema(), False)
    return DataFrame(fresh, spark)


#: Rows in an Arrow batch of texts. Texts of some kilobytes, and the copies that kernels make of a batch, stay small beside an executor's memory.
TEXT_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """For queries over texts: Python workers get TEXT_ROWS rows at a time. A session's smaller setting is kept."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > TEXT_ROWS:
        spark.conf.set(key, str(TEXT_ROWS))


def text_column(df: DataFrame, column: str = "text") -> DataFrame:
    """doc_id and text only: other columns of the input, whatever their names, never meet ours."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("string").alias("text"))


def whole_row(docs: DataFrame) -> Column:
    """All columns of docs as one struct, whatever their names."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns])


def batch_from(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def executor_file(path: str) -> str:
    """Vocabulary files are installed with the Python environment of every node."""
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    return path
