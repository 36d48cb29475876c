"""Ordered work on groups of any length: row numbers, values of the row before, prefix products of matrices.

Rows are dealt by ranges of (group, order), so a group may span many partitions. Each partition does its part alone; what crosses a border is one row a partition and
group, of which at most two groups a partition continue elsewhere. So a session of any length is never one task's fold.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from tessera.shared import kept, map_in_arrow

_PLACE = (1 << 33) - 1


def _dealt(rows: DataFrame, by: tuple[str, ...], order: tuple[str | Column, ...]) -> DataFrame:
    """rows in ranges of (by, order), sorted, with _block, the partition, and _i, the place in it; kept."""
    keys = [*by, *order]
    spread = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return kept(spread.withColumn("_block", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACE))))


def number_rows(rows: DataFrame, *order: str | Column, name: str = "number") -> DataFrame:
    """rows with a number from 0 in that order, over the whole table. Rows that the order does not tell apart are numbered in some order."""
    dealt = _dealt(rows, (), order)
    before = F.sum("n").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))  # a row a partition
    counts = dealt.groupBy("_block").agg(F.count("*").alias("n")).select("_block", F.coalesce(before, F.lit(0)).alias("_before"))
    return dealt.join(F.broadcast(counts), "_block").withColumn(name, F.col("_before") + F.col("_i")).drop("_block", "_i", "_before")


def _same(by: tuple[str, ...], left: str = "", right: str = "") -> Column:
    out = F.lit(True)
    for c in by:
        out = out & F.col(f"{left}{c}").eqNullSafe(F.col(f"{right}{c}"))
    return out


def _with_edges(dealt: DataFrame, edges: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """dealt with the columns of edges (by, _block, ..): a row for each group that continues in a partition, two a partition at most, so they are broadcast."""
    named = edges.select(*[F.col(c).alias(f"_k_{c}") for c in by], F.col("_block").alias("_k"), *[c for c in edges.columns if c not in (*by, "_block")])
    return dealt.join(F.broadcast(named), (F.col("_block") == F.col("_k")) & _same(by, right="_k_"), "left").drop("_k", *[f"_k_{c}" for c in by])


def previous(rows: DataFrame, columns: tuple[str, ...], by: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """rows with before: a struct of those columns of the row before in the group, null in its first row."""
    dealt = _dealt(rows, by, order).withColumn("_own", F.struct(*columns))
    inside = F.lag("_own").over(Window.partitionBy("_block", *by).orderBy("_i"))
    ends = dealt.groupBy(*by, "_block").agg(F.max_by("_own", "_i").alias("_end"))
    carried = F.lag("_end").over(Window.partitionBy(*by).orderBy("_block"))
    edges = ends.withColumn("_carried", carried).where("_carried is not null").drop("_end")
    out = _with_edges(dealt.withColumn("_in", inside), edges, by)
    return out.withColumn("before", F.coalesce("_in", "_carried")).drop("_own", "_in", "_carried", "_block", "_i")


def starts(batch: pa.RecordBatch, by: tuple[str, ...], last: tuple | None) -> np.ndarray:
    """Which rows of a sorted batch begin a group; last is the key before the batch, None at the very beginning."""
    n = batch.num_rows
    new = np.zeros(n, bool)
    if not n:
        return new
    for c in by:
        col = batch.column(c)
        a, b = col.slice(1), col.slice(0, n - 1)
        differ = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False) | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))
        new[1:] |= differ
    new[0] = last is None or last != tuple(batch.column(c)[0].as_py() for c in by)
    return new


def key_of(batch: pa.RecordBatch, by: tuple[str, ...]) -> tuple:
    return tuple(batch.column(c)[batch.num_rows - 1].as_py() for c in by)


def whole_groups(batches, by: tuple[str, ...], hold: int):
    """Sorted batches as batches of whole groups, of about ``hold`` rows, or of one group that is longer."""
    held, rows, limit = [], 0, hold
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows < limit:
            continue
        t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        last = int(np.flatnonzero(starts(t, by, None))[-1])
        if last:
            yield t.slice(0, last)
        held, rows = [t.slice(last)], rows - last
        limit = max(hold, 2 * rows)
    if rows:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _matrices(column: pa.Array, size: int) -> np.ndarray:
    """[n, size, size]; null is the identity."""
    out = np.broadcast_to(np.eye(size), (len(column), size, size)).copy()
    there = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    if len(there):
        out[there] = column.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, size, size)
    return out


def _listed(m: np.ndarray) -> pa.Array:
    k = m.shape[1] * m.shape[2]
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * k), pa.array(np.ascontiguousarray(m).ravel()))


def running_products(m: np.ndarray, new: np.ndarray, left: bool = False) -> np.ndarray:
    """m[s] @ .. @ m[i] of each row i, with s the last row up to i that begins a group (left: m[i] @ .. @ m[s]); log2(n) products of whole arrays."""
    out, n = m.copy(), len(m)
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0)) if n else new
    step = 1
    while step < n:
        i = np.flatnonzero(np.arange(n) - step >= first)
        if not len(i):
            break
        out[i] = out[i] @ out[i - step] if left else out[i - step] @ out[i]
        step *= 2
    return out


def _local_products(rows: DataFrame, matrix: str, by, order, size: int, left: bool) -> DataFrame:
    """rows with _product, over the partition's own rows of the group, _block and _i; kept."""
    schema = StructType([*rows.schema.fields, StructField("_product", ArrayType(DoubleType())), StructField("_block", IntegerType()), StructField("_i", LongType())])

    def run(batches):
        from pyspark import TaskContext

        last, carry, at, block = None, None, 0, TaskContext.get().partitionId()
        for b in batches:
            if not b.num_rows:
                continue
            new = starts(b, by, last)
            m = _matrices(b.column(matrix), size)
            if carry is not None and not new[0]:
                m[0] = m[0] @ carry if left else carry @ m[0]
            m = running_products(m, new, left)
            last, carry = key_of(b, by), m[-1]
            yield pa.RecordBatch.from_arrays([*b.columns, _listed(m), pa.array(np.full(b.num_rows, block, np.int32)), pa.array(np.arange(at, at + b.num_rows))], names=[*b.schema.names, "_product", "_block", "_i"])
            at += b.num_rows

    keys = [*by, *order]
    return kept(map_in_arrow(rows.repartitionByRange(*keys).sortWithinPartitions(*keys), run, schema))


def _block_totals(local: DataFrame, by) -> DataFrame:
    return local.groupBy(*by, "_block").agg(F.max_by("_product", "_i").alias("_total"), F.count("*").alias("_n"))


def prefix_products(rows: DataFrame, matrix: str, by: tuple[str, ...] = (), order: tuple[str, ...] = ("seq",), size: int = 4, left: bool = False, name: str = "product") -> DataFrame:
    """rows with name: the product of the group's matrices (row-major arrays of size * size) up to each row, m1 @ m2 @ .. or, with left, .. @ m2 @ m1.

    A null matrix is the identity. Partitions multiply their own rows; the totals of partitions, one row each, are multiplied in turn, and each partition takes what
    stands before it. Rows that the order does not tell apart are multiplied in some order; rows with a null key are a group.
    """
    local = _local_products(rows, matrix, by, order, size, left)

    def carried(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("_block")
        m = running_products(np.array(t["_total"].tolist()).reshape(-1, size, size), np.zeros(len(t), bool), left)
        return t[[*by, "_block"]].iloc[1:].assign(_carry=m[:-1].reshape(-1, size * size).tolist())

    # only groups in more than one partition have anything to carry
    totals = _block_totals(local, by).withColumn("_parts", F.count("*").over(Window.partitionBy(*by))).where("_parts > 1").drop("_parts", "_n")
    fields = [f for f in rows.schema.fields if f.name in by]
    edges = totals.groupBy(*by).applyInPandas(carried, StructType([*sorted(fields, key=lambda f: by.index(f.name)), StructField("_block", IntegerType()), StructField("_carry", ArrayType(DoubleType()))]))
    schema = StructType([*rows.schema.fields, StructField(name, ArrayType(DoubleType()))])

    def run(batches):
        for b in batches:
            m, carry = _matrices(b.column("_product"), size), b.column("_carry")
            there = np.flatnonzero(carry.is_valid().to_numpy(zero_copy_only=False))
            if len(there):
                c = _matrices(carry.take(pa.array(there)), size)
                m[there] = m[there] @ c if left else c @ m[there]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(schema) - 1], _listed(m)], names=schema.names)

    with_carry = _with_edges(local, edges, by)
    return map_in_arrow(with_carry.select(*[F.col(f"`{c}`") for c in rows.columns], "_product", "_carry"), run, schema)


def products(rows: DataFrame, matrix: str, by: tuple[str, ...] = (), order: tuple[str, ...] = ("seq",), size: int = 4, left: bool = False, name: str = "product") -> DataFrame:
    """by, name, n: the product of each group's matrices and the number of its rows. A group's partitions hand on one row each."""
    totals = _block_totals(_local_products(rows.select(*by, *order, matrix), matrix, by, order, size, left), by)
    whole = totals.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_block", "_total"))).alias("_t"), F.sum("_n").alias("n"))  # a row a partition of the group

    def run(batches):
        for b in batches:
            out = []
            for blocks in b.column("_t").to_pylist():
                m = np.array([t["_total"] for t in blocks]).reshape(-1, size, size)
                out.append(running_products(m, np.zeros(len(m), bool), left)[-1])
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in by], _listed(np.array(out).reshape(-1, size, size)), b.column("n")], names=[*by, name, "n"])

    kinds = {f.name: f for f in rows.schema.fields}
    return whole.mapInArrow(run, StructType([*[kinds[c] for c in by], StructField(name, ArrayType(DoubleType())), StructField("n", LongType())]))
