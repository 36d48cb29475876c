"""Aligning streams in time: nearest and linear as-of joins, overlap, pose lookup.

An as-of join without an equality key would be one window over everything. Here time is cut into
buckets; windows run inside a bucket, and each bucket gets the last sample before it and the
first after it from a small table of buckets. With ``by`` columns streams are kept apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.errors import SensorError


def neighbours(samples: DataFrame, queries: DataFrame, time: str = "t", by: tuple[str, ...] = (), width: float = 3600.0) -> DataFrame:
    """queries' columns plus before and after: the samples next to each query time, as structs of all sample columns.

    A sample at the query's own time counts as before. Either is null where there is none. width
    is the length of a bucket in the unit of the time column.
    """
    by = list(by)
    own = [c for c in samples.columns if c not in by]
    bucket = lambda c: F.floor(F.col(c) / F.lit(width)).cast("long")
    s = samples.where(F.col(time).isNotNull()).select(*by, F.struct(*own).alias("_sample"), F.col(time).alias("_time"), bucket(time).alias("_bucket"))
    q = queries.select(*by, F.struct(*queries.columns).alias("_query"), F.col(time).alias("_time"), bucket(time).alias("_bucket"))
    rows = s.withColumn("_query", F.lit(None).cast(q.schema["_query"].dataType)).unionByName(q.withColumn("_sample", F.lit(None).cast(s.schema["_sample"].dataType)))
    edges = rows.groupBy(*by, "_bucket").agg(
        F.min_by("_sample", F.when(F.col("_sample").isNotNull(), F.col("_time"))).alias("_first"),
        F.max_by("_sample", F.when(F.col("_sample").isNotNull(), F.col("_time"))).alias("_last"),
    )
    # what follows is read as a running frame over the descending order, which costs no more than what precedes
    over, back = Window.partitionBy(*by).orderBy("_bucket"), Window.partitionBy(*by).orderBy(F.desc("_bucket"))
    carry = edges.select(
        *by,
        "_bucket",
        F.last("_last", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("_carry_last"),
        F.last("_first", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1)).alias("_carry_first"),
    )
    is_query = F.col("_query").isNotNull()
    inside = Window.partitionBy(*by, "_bucket").orderBy("_time", is_query)
    behind = Window.partitionBy(*by, "_bucket").orderBy(F.desc("_time"), is_query.desc())
    found = rows.select(
        *by,
        "_bucket",
        "_query",
        F.last("_sample", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias("_b"),
        F.last("_sample", ignorenulls=True).over(behind.rowsBetween(Window.unboundedPreceding, 0)).alias("_a"),
    ).where("_query is not null")
    joined = found.join(carry, [*by, "_bucket"], "left") if by else found.join(carry, "_bucket", "left")
    return joined.select("_query.*", F.coalesce("_b", "_carry_last").alias("before"), F.coalesce("_a", "_carry_first").alias("after"))


def nearest(samples: DataFrame, queries: DataFrame, time: str = "t", by: tuple[str, ...] = (), width: float = 3600.0) -> DataFrame:
    """queries' columns plus sample, the nearest in time; the earlier of two equally near; the first or last beyond the ends."""
    n = neighbours(samples, queries, time, by, width)
    left = F.col(time) - F.col(f"before.{time}")
    right = F.col(f"after.{time}") - F.col(time)
    pick = F.when(F.col("before").isNull(), F.col("after")).when(F.col("after").isNull(), F.col("before")).when(left <= right, F.col("before")).otherwise(F.col("after"))
    return n.withColumn("sample", pick).drop("before", "after")


def _between(t: Column, before: Column, after: Column, time: str, value: str, array: bool) -> Column:
    t0, t1, v0, v1 = before[time], after[time], before[value], after[value]
    weight = F.try_divide(t - t0, t1 - t0)
    line = lambda a, b: F.when(t1 == t0, a).otherwise(a + (b - a) * weight)
    mid = F.zip_with(v0, v1, line) if array else line(v0, v1)
    return F.when(before.isNull(), v1).when(after.isNull(), v0).otherwise(mid)


def linear(samples: DataFrame, queries: DataFrame, values: tuple[str, ...] = ("v",), time: str = "t", by: tuple[str, ...] = (), width: float = 3600.0) -> DataFrame:
    """queries' columns plus each value column interpolated linearly; flat beyond the ends. Values are numbers or arrays of numbers."""
    kinds = dict(samples.dtypes)
    n = neighbours(samples, queries, time, by, width)
    cols = [_between(F.col(time), F.col("before"), F.col("after"), time, v, kinds[v].startswith("array")).alias(v) for v in values]
    return n.select(*[c for c in n.columns if c not in ("before", "after")], *cols)


def interpolate(samples: DataFrame, queries: DataFrame, method: str = "linear", **options) -> DataFrame:
    if method == "linear":
        return linear(samples, queries, **options)
    if method == "nearest":
        values = options.pop("values", ("v",))
        return nearest(samples, queries, **options).select(*queries.columns, *[F.col(f"sample.{v}").alias(v) for v in values])
    raise SensorError(f"unknown method {method!r}")


def apply_time_offset(t: Column, offset_sec: float | Column) -> Column:
    return t - offset_sec


def synchronise(streams: DataFrame, reference: DataFrame, method: str = "linear", width: float = 3600.0) -> DataFrame:
    """(stream, t, v) for every stream at every reference time. streams: stream, t, v; reference: t."""
    names = streams.select("stream").distinct()  # a row a stream, broadcast
    asked = reference.select("t").crossJoin(F.broadcast(names))
    return interpolate(streams, asked, method, values=("v",), by=("stream",), width=width).select("stream", "t", "v")


def extents(streams: DataFrame) -> DataFrame:
    """stream, start, end."""
    return streams.groupBy("stream").agg(F.min("t").alias("start"), F.max("t").alias("end"))


def temporal_overlap(streams: DataFrame) -> DataFrame:
    """One row (start, end), or none: fewer than two streams, or no common time."""
    whole = extents(streams).agg(F.count("*").alias("n"), F.max("start").alias("start"), F.min("end").alias("end"))
    return whole.where((F.col("n") >= 2) & (F.col("start") < F.col("end"))).select("start", "end")


def pose_at(poses: DataFrame, queries: DataFrame, duration: float, by: tuple[str, ...] = ()) -> DataFrame:
    """queries' columns plus pose: the first pose, by seq, whose frame [timestamp, timestamp + duration) holds t; null if none does. Each query row gives one row, repeated ones too.

    A frame spans two buckets of its own length at most, so the range condition becomes an equality on buckets.
    """
    if duration <= 0:
        raise SensorError("a frame has a positive duration")
    slot = lambda c: F.floor(c / F.lit(duration)).cast("long")
    p = poses.select(*by, F.struct(*poses.columns).alias("_pose"), F.explode(F.array(slot(F.col("timestamp")), slot(F.col("timestamp")) + 1)).alias("_slot"))
    # equal queries are looked up once and given back as often as they came
    asked = queries.select(F.struct(*[F.col(f"`{c}`") for c in queries.columns]).alias("_row")).groupBy("_row").agg(F.count("*").cast("int").alias("_n"))
    q = asked.select("_row", "_n", *[F.col("_row")[c].alias(c) for c in (*by, "t")]).withColumn("_slot", slot(F.col("t")))
    start = F.col("_pose.timestamp")
    hit = q.join(p, [*by, "_slot"], "left").withColumn("_in", (F.col("t") >= start) & (F.col("t") < start + duration))
    best = F.min_by("_pose", F.when(F.col("_in"), F.col("_pose.seq")))
    found = hit.groupBy("_row", "_n").agg(best.alias("pose"))
    return found.select("_row", "pose", F.explode(F.sequence(F.lit(1), "_n"))).select("_row.*", "pose")
