"""Shared by the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _whole(vectors: DataFrame) -> tuple[DataFrame, Column]:
    """((vec_id, v array<double>) of all rows, whether v is usable: not null or zero, of finite components, and with an id)."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return v, F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & F.coalesce(fine, F.lit(False))


def _fine(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<double>): vectors that are not null or zero and have only finite components."""
    v, good = _whole(vectors)
    return v.where(good)


def flagged(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of all rows; v is null unless it is usable and has the commonest length."""
    v, good = _whole(vectors)
    return v.select("vec_id", F.when(good & (F.size("v") == dimension(vectors)), F.col("v")).alias("v"))


def dimension(vectors: DataFrame) -> int:
    """The commonest length of usable vectors, the smaller of two; 0 without any."""
    top = _fine(vectors).groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return top.d if top else 0


def usable(vectors: DataFrame, length: int | None = None) -> DataFrame:
    """(vec_id, v array<double>): vectors that are not null or zero, have only finite components and that length, or the commonest one."""
    return _fine(vectors).where(F.size("v") == (dimension(vectors) if length is None else length))


def matrix(column) -> np.ndarray:
    """[rows, dimension] of a list column whose lists have one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
