"""Fusing fixes over time: the outage gate, fix ages, and inserting fixes into a sequence of poses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _over(by, order):
    return Window.partitionBy(*by).orderBy(*order)


def outage_gate(fixes: DataFrame, max_age: float, by: tuple[str, ...] = (), order: tuple[str, ...] = ("t",), recover: bool = False) -> DataFrame:
    """fixes with used: false where the last fix is older than max_age.

    The time of the last fix does not advance on a skip, so once stale every later fix is skipped
    too; with recover a skipped fix counts as the last one again. Both are running maxima, not folds.
    """
    t = order[0]
    gap = F.col(t) - F.lag(t).over(_over(by, order))
    late = F.when(gap > max_age, 1).otherwise(0)
    if recover:
        return fixes.withColumn("used", late == 0)
    d = fixes.withColumn("_late", late)
    return d.withColumn("used", F.max("_late").over(_over(by, order).rowsBetween(Window.unboundedPreceding, 0)) == 0).drop("_late")


def fix_age(fixes: DataFrame, by: tuple[str, ...] = (), order: tuple[str, ...] = ("t",)) -> DataFrame:
    """fixes with age, the time since the fix before; null for the first."""
    return fixes.withColumn("age", F.col(order[0]) - F.lag(order[0]).over(_over(by, order)))


def fuse_into_sequence(poses: DataFrame, fixes: DataFrame, duration: float) -> DataFrame:
    """poses (seq, timestamp, x, y, z, qw, qx, qy, qz) with the place of the latest fix (t, x, y, z) in each frame; a fix in no frame becomes a pose of its own, without rotation."""
    from tessera.operators.sync import pose_at

    hit = pose_at(poses, fixes, duration)
    inside = hit.where("pose is not null").groupBy(F.col("pose.seq").alias("seq")).agg(F.max_by(F.struct("x", "y", "z"), "t").alias("_f"))
    moved = poses.join(inside, "seq", "left").select("seq", "timestamp", *[F.coalesce(F.col(f"_f.{c}"), F.col(c)).alias(c) for c in "xyz"], "qw", "qx", "qy", "qz")
    new = hit.where("pose is null").select(F.lit(None).cast("long").alias("seq"), F.col("t").alias("timestamp"), "x", "y", "z", F.lit(1.0).alias("qw"), *[F.lit(0.0).alias(c) for c in ("qx", "qy", "qz")])
    return moved.withColumn("seq", F.col("seq").cast("long")).unionByName(new)
