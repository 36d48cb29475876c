"""Dead reckoning and keyframes: wheel odometry as prefix sums, ordered folds, inertial integration."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, StructField, StructType

from tessera.errors import SensorError
from tessera.operators.scans import key_of, prefix_products, previous, products, starts, whole_groups
from tessera.shared import map_in_arrow


def _integrate(samples: DataFrame, speed: Column, rate: Column, by: tuple[str, ...], time: str) -> DataFrame:
    """Columns x, y, theta by two prefix sums: the heading, then the way along the heading of each interval's middle."""
    over = Window.partitionBy(*by).orderBy(time)
    run = over.rowsBetween(Window.unboundedPreceding, 0)
    prev = lambda c: F.lag(c).over(over)
    d = samples.withColumn("_v", speed).withColumn("_w", rate).withColumn("_dt", F.col(time) - prev(time)).withColumn("_pv", prev("_v")).withColumn("_pw", prev("_w"))
    d = d.withColumn("_turn", F.coalesce((F.col("_w") + F.col("_pw")) / 2 * F.col("_dt"), F.lit(0.0)))
    d = d.withColumn("theta", F.sum("_turn").over(run))
    middle = F.col("theta") - F.col("_turn") / 2
    way = (F.col("_v") + F.col("_pv")) / 2 * F.col("_dt")
    d = d.withColumn("_dx", F.coalesce(way * F.cos(middle), F.lit(0.0))).withColumn("_dy", F.coalesce(way * F.sin(middle), F.lit(0.0)))
    d = d.withColumn("x", F.sum("_dx").over(run)).withColumn("y", F.sum("_dy").over(run))
    return d.select(*samples.columns, "x", "y", "theta")


def differential_drive(samples: DataFrame, wheel_base: float, by: tuple[str, ...] = (), time: str = "t", left: str = "left", right: str = "right") -> DataFrame:
    """samples with x, y, theta from the speeds of two wheels. The steps of one ``by`` group are one window: give a session or vehicle."""
    if wheel_base <= 0:
        raise SensorError("a wheel base is positive")
    l, r = F.col(left), F.col(right)
    return _integrate(samples, (l + r) / 2, (r - l) / wheel_base, by, time)


def ticks_to_speeds(samples: DataFrame, ticks_per_revolution: int, wheel_radius: float, by: tuple[str, ...] = (), time: str = "t", left: str = "left", right: str = "right") -> DataFrame:
    """Encoder counts become speeds of the interval before each sample; the first sample has that of the first interval."""
    if ticks_per_revolution <= 0 or wheel_radius <= 0:
        raise SensorError("ticks and the radius are positive")
    over = Window.partitionBy(*by).orderBy(time)
    out = samples
    for c in (left, right):
        step = (F.col(c) - F.lag(c).over(over)) * (2 * math.pi * wheel_radius / ticks_per_revolution) / (F.col(time) - F.lag(time).over(over))
        out = out.withColumn(f"_{c}", step)
    for c in (left, right):
        out = out.withColumn(f"_{c}2", F.coalesce(f"_{c}", F.lead(f"_{c}").over(over)))
    return out.select(*[F.col(f"_{c}2").alias(c) if c in (left, right) else F.col(c) for c in samples.columns])


def ackermann(samples: DataFrame, wheel_base: float, by: tuple[str, ...] = (), time: str = "t", speed: str = "speed", steering: str = "steering") -> DataFrame:
    """samples with x, y, theta from speed and steering angle, both taken at the middle of each interval."""
    if wheel_base <= 0:
        raise SensorError("a wheel base is positive")
    over = Window.partitionBy(*by).orderBy(time)
    run = over.rowsBetween(Window.unboundedPreceding, 0)
    mid = lambda c: (F.col(c) + F.lag(c).over(over)) / 2
    d = samples.withColumn("_v", mid(speed)).withColumn("_s", mid(steering)).withColumn("_dt", F.col(time) - F.lag(time).over(over))
    d = d.withColumn("_turn", F.coalesce(F.col("_v") * F.tan("_s") / wheel_base * F.col("_dt"), F.lit(0.0))).withColumn("theta", F.sum("_turn").over(run))
    middle = F.col("theta") - F.col("_turn") / 2
    d = d.withColumn("_dx", F.coalesce(F.col("_v") * F.col("_dt") * F.cos(middle), F.lit(0.0))).withColumn("_dy", F.coalesce(F.col("_v") * F.col("_dt") * F.sin(middle), F.lit(0.0)))
    return d.withColumn("x", F.sum("_dx").over(run)).withColumn("y", F.sum("_dy").over(run)).select(*samples.columns, "x", "y", "theta")


def check_times(samples: DataFrame, by: tuple[str, ...] = (), time: str = "t") -> None:
    """Raises unless every group has two samples or more with strictly increasing times."""
    over = Window.partitionBy(*by).orderBy(time)
    bad = samples.withColumn("_d", F.col(time) - F.lag(time).over(over)).groupBy(*by).agg(F.count("*").alias("n"), F.min("_d").alias("d")).where("n < 2 or d <= 0")
    if bad.limit(1).count():
        raise SensorError("two samples or more with increasing times are needed")


def adaptive_threshold(residuals: DataFrame, by: tuple[str, ...], order: str, value: str, initial: float, alpha: float = 0.9, low: float = 0.0, high: float = float("inf")) -> DataFrame:
    """by, order, sigma, threshold after each residual: sigma <- alpha sigma + (1 - alpha) r; the threshold is 3 sigma, clipped.

    A step is an affine map, so the steps of a group are a prefix product of 2x2 matrices; a group may span partitions. After a null residual a group's sigma is NaN.
    """
    r = F.coalesce(F.col(value).cast("double"), F.lit(float("nan")))
    steps = residuals.select(*by, order, F.array(F.lit(float(alpha)), r * (1 - alpha), F.lit(0.0), F.lit(1.0)).alias("_step"))
    got = prefix_products(steps, "_step", by, (order,), size=2, left=True, name="_map")
    sigma = F.col("_map")[0] * float(initial) + F.col("_map")[1]
    limit = 3 * F.col("sigma")
    clipped = F.when(F.isnan(limit), limit).otherwise(F.least(F.greatest(limit, F.lit(float(low))), F.lit(float(high))))
    return got.select(*by, order, sigma.alias("sigma")).withColumn("threshold", clipped)


def keyframes(poses: DataFrame, min_distance: float, by: tuple[str, ...], order: str = "seq", min_degrees: float = 10.0) -> DataFrame:
    """poses with accepted: the first pose, then each at min_distance or more, or turned by min_degrees or more, from the last accepted.

    Poses have x, y, z and may have qw, qx, qy, qz; without these, or with min_degrees 0, turns do not count. Every row is kept with all its columns; rows of one order
    follow each other by their place and turn, and rows with a null key are a group. Acceptance looks back to acceptances, so a group is one ordered stream, which carries
    nothing but the last accepted pose; many groups share a task and a batch, and rows are not joined.
    """
    if min_distance <= 0 or min_degrees < 0:
        raise SensorError("a positive distance and an angle of 0 or more are needed")
    turns = min_degrees > 0 and {"qw", "qx", "qy", "qz"} <= set(poses.columns)
    columns = ["x", "y", "z", *(["qw", "qx", "qy", "qz"] if turns else [])]
    reach, least = min_distance * min_distance, math.cos(math.radians(min_degrees) / 2) if turns else -1.0

    def run(batches):
        last, ax, ay, az, aq = None, 0.0, 0.0, 0.0, None
        for b in batches:
            if not b.num_rows:
                continue
            new = starts(b, by, last)
            last = key_of(b, by)
            p = np.stack([b.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in columns], axis=1)
            xs, ys, zs = p[:, 0].tolist(), p[:, 1].tolist(), p[:, 2].tolist()
            qs = (p[:, 3:] / np.linalg.norm(p[:, 3:], axis=1)[:, None]).tolist() if turns else None
            out = [False] * b.num_rows
            for i, first in enumerate(new.tolist()):
                if not first:
                    dx, dy, dz = xs[i] - ax, ys[i] - ay, zs[i] - az
                    if not dx * dx + dy * dy + dz * dz >= reach:
                        if not turns:
                            continue
                        w, x, y, z = qs[i]
                        if not abs(w * aq[0] + x * aq[1] + y * aq[2] + z * aq[3]) <= least:
                            continue
                out[i], ax, ay, az = True, xs[i], ys[i], zs[i]
                aq = qs[i] if turns else None
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], names=[*b.schema.names, "accepted"])

    schema = StructType([*poses.schema.fields, StructField("accepted", BooleanType())])
    dealt = poses.repartition(*by) if by else poses.coalesce(1)
    return map_in_arrow(dealt.sortWithinPartitions(*by, order, *columns), run, schema)


def submaps(frames: DataFrame, max_keyframes: int, overlap: int = 0, by: tuple[str, ...] = (), order: str = "seq") -> DataFrame:
    """by, submap, position, order: keyframes in chunks; a new submap begins with the last ``overlap`` of the one before, which count."""
    if not 0 <= overlap < max_keyframes:
        raise SensorError("the overlap is less than a submap")
    step = max_keyframes - overlap
    i = F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1
    own = F.greatest(F.lit(0), F.floor((i - overlap) / step)).cast("int")
    d = frames.withColumn("_i", i).withColumn("_own", own).withColumn("_n", F.count("*").over(Window.partitionBy(*by)))
    # a keyframe also opens the next submap if it is among the last ones before that begins, and something follows
    nxt = (F.col("_own") + 1) * step
    also = (F.col("_i") >= nxt) & (F.col("_n") > nxt + overlap)
    d = d.withColumn("submap", F.explode(F.when(also, F.array("_own", F.col("_own") + 1)).otherwise(F.array("_own"))))
    return d.select(*by, "submap", (F.col("_i") - F.col("submap") * step).cast("int").alias("position"), order)


def increments(imu: DataFrame, by: tuple[str, ...], accel_bias=(0.0, 0.0, 0.0), gyro_bias=(0.0, 0.0, 0.0)) -> DataFrame:
    """by, t, step: the motion since the sample before by the midpoint rule, as a 5x5 matrix [[R, v, p], [0, 1, dt], [0, 0, 1]]; null for a first sample.

    Products of such matrices are motions over longer spans. Where time does not increase the matrix is NaN.
    """
    from tessera.kernels import exp_so3_many

    columns = ("t", "ax", "ay", "az", "wx", "wy", "wz")
    rows = imu.select(*by, *[F.col(c).cast("double").alias(c) for c in columns])
    bias = np.array([*accel_bias, *gyro_bias])
    kinds = {f.name: f for f in imu.schema.fields}
    schema = StructType([*[kinds[c] for c in by], StructField("t", DoubleType()), StructField("step", ArrayType(DoubleType()))])

    def run(batches):
        for b in batches:
            before = b.column("before")
            there = np.flatnonzero(before.is_valid().to_numpy(zero_copy_only=False))
            now = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in columns], axis=1)[there]
            was = np.stack([before.field(c).to_numpy(zero_copy_only=False) for c in columns], axis=1)[there]
            dt = now[:, 0] - was[:, 0]
            mean = (now[:, 1:] + was[:, 1:]) / 2 - bias
            m = np.zeros((len(there), 5, 5))
            m[:, :3, :3] = exp_so3_many(mean[:, 3:] * dt[:, None])
            m[:, :3, 3], m[:, :3, 4] = mean[:, :3] * dt[:, None], mean[:, :3] * (dt * dt / 2)[:, None]
            m[:, 3, 3] = m[:, 4, 4] = 1
            m[:, 3, 4] = dt
            m[~(dt > 0)] = np.nan
            sizes = np.zeros(b.num_rows, bool)
            sizes[there] = True
            steps = pa.array(m.reshape(-1, 25).tolist(), pa.list_(pa.float64())) if len(there) else pa.array([], pa.list_(pa.float64()))
            place = pa.array(np.cumsum(sizes) - 1, mask=~sizes)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in by], b.column("t"), steps.take(place)], names=schema.names)

    return previous(rows, columns, by, ("t",)).mapInArrow(run, schema)


def preintegrate(imu: DataFrame, accel_bias=(0.0, 0.0, 0.0), gyro_bias=(0.0, 0.0, 0.0), by: str = "interval") -> DataFrame:
    """by, rotation (9), quaternion (4, w first), velocity (3), position (3), duration, n from rows of t, ax..az, wx..wz, by the midpoint rule.

    Samples are multiplied up as matrices, partition by partition, so an interval may be of any length. Intervals of one sample, or whose times do not increase, give no row.
    """
    from tessera.kernels import matrix_to_quat

    whole = products(increments(imu, (by,), accel_bias, gyro_bias), "step", (by,), ("t",), size=5)

    def run(batches):
        for b in batches:
            m = np.array(b.column("product").to_pylist()).reshape(-1, 5, 5)
            good = np.flatnonzero((b.column("n").to_numpy() > 1) & ~np.isnan(m[:, 3, 4]))
            m, lists = m[good], pa.list_(pa.float64())
            quat = [matrix_to_quat(r).tolist() for r in m[:, :3, :3]]
            parts = [m[:, :3, :3].reshape(-1, 9).tolist(), quat, m[:, :3, 3].tolist(), m[:, :3, 4].tolist()]
            at = pa.array(good)
            yield pa.RecordBatch.from_arrays([b.column(by).take(at), *[pa.array(v, lists) for v in parts], pa.array(m[:, 3, 4]), b.column("n").take(at)], names=[by, "rotation", "quaternion", "velocity", "position", "duration", "n"])

    return whole.mapInArrow(run, f"{by} {dict(imu.dtypes)[by]}, rotation array<double>, quaternion array<double>, velocity array<double>, position array<double>, duration double, n long")


def deskew(points: DataFrame, imu: DataFrame, frame: str = "frame", gravity=(0.0, 0.0, -9.81), velocity=(0.0, 0.0, 0.0), ref: str = "ref_time") -> DataFrame:
    """points (frame, seq, t, x, y, z, ref_time) moved to where the sensor was at ref_time, along the path of the frame's inertial rows.

    Points and inertial rows of a frame lie side by side in one sorted partition, which is read by whole frames. Frames with under two inertial rows stay as they are.
    """
    from tessera.kernels import deskew as kernel

    xyz, motion = ("x", "y", "z"), ("ax", "ay", "az", "wx", "wy", "wz")

    def run(batches):
        for b in whole_groups(batches, ("_f",), 40_000):
            side = b.column("_side").to_numpy(zero_copy_only=False)
            begin = np.flatnonzero(starts(b, ("_f",), None))
            end = np.append(begin[1:], b.num_rows)
            middle = begin + np.add.reduceat(side == 0, begin)
            column = lambda c, b=b: b.column(c).to_numpy(zero_copy_only=False)
            t, when, p, m = column("_t"), column("_ref"), np.stack([column(f"_{c}") for c in motion[:3]], axis=1), np.stack([column(f"_{c}") for c in motion], axis=1)
            for at, of, to in zip(begin, middle, end, strict=True):  # imu rows stand first
                if of - at >= 2 and to > of:
                    p[of:to] = kernel(p[of:to], t[of:to], t[at:of], m[at:of, :3], m[at:of, 3:], float(when[of]), np.array(gravity), np.array(velocity))
            rows = pa.array(np.flatnonzero(side == 1))
            yield pa.RecordBatch.from_arrays([b.column("_f").take(rows), b.column("_seq").take(rows), *[pa.array(np.ascontiguousarray(p[side == 1, k])) for k in range(3)]], names=[frame, "seq", *xyz])

    number = lambda c: F.col(c).cast("double")
    nothing = lambda c: F.lit(None).cast("double").alias(c)
    one = imu.select(F.col(frame).alias("_f"), F.lit(0).alias("_side"), F.lit(None).cast(points.schema["seq"].dataType).alias("_seq"), number("t").alias("_t"), nothing("_ref"), *[number(c).alias(f"_{c}") for c in motion])
    two = points.select(F.col(frame).alias("_f"), F.lit(1).alias("_side"), F.col("seq").alias("_seq"), number("t").alias("_t"), number(ref).alias("_ref"), *[number(c).alias(f"_{a}") for c, a in zip(xyz, motion, strict=False)], *[nothing(f"_{c}") for c in motion[3:]])
    rows = one.unionByName(two).repartition("_f").sortWithinPartitions("_f", "_side", "_seq", "_t")
    schema = StructType([StructField(frame, points.schema[frame].dataType), StructField("seq", points.schema["seq"].dataType), *[StructField(c, DoubleType()) for c in xyz]])
    return rows.mapInArrow(run, schema)
