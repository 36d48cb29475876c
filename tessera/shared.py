"""Folders that the driver and all executors see, and durable cuts of a plan."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructField, StructType


def shared_dir(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names. Only a session on one machine (a master local[..]) may be without it, and gets a temporary folder."""
    sc, named = spark.sparkContext, spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named.rstrip("/")
    if sc.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-shared-"))
    return sc.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, stem: str) -> str:
    return f"{shared_dir(spark)}/{stem}-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """df, computed once into the shared folder: what follows sees the same rows in the same partitions, whatever executors are lost."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def map_in_arrow(df: DataFrame, run, schema: StructType) -> DataFrame:
    """df.mapInArrow(run, schema) for columns of any name: batches have df's names, but the plan's columns are named by place, since names with dots do not resolve."""
    names = df.columns
    plain = StructType([StructField(f"c{i}", f.dataType, f.nullable) for i, f in enumerate(schema.fields)])

    def renamed(batches):
        for b in run(b.rename_columns(names) for b in batches):
            yield b.rename_columns(plain.names)

    return df.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(renamed, plain).toDF(*schema.names)


def file_system(path: str):
    """(pyarrow file system, name in it) of a path or URI, for byte formats that tasks read by ranges."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path)) if re.match(r"[a-z0-9]+:", path) else fs.FileSystem.from_uri(os.path.abspath(path))
