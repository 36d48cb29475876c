"""Estimators: rigid fits and ego velocity from moments, ICP by driver-iterated joins or frame by frame, calibration."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, StructField, StructType

from tessera import kernels
from tessera.errors import CalibrationError, SensorError
from tessera.operators.scans import number_rows, prefix_products, starts, whole_groups
from tessera.shared import map_in_arrow

XYZ = ("x", "y", "z")


def kabsch_moments(pairs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, n, means and the nine cross moments of matched points (sx, sy, sz) and (tx, ty, tz)."""
    means = [F.avg(f"{s}{c}").alias(f"m{s}{c}") for s in "st" for c in XYZ]
    cross = [(F.covar_pop(f"s{a}", f"t{b}") * F.count("*")).alias(f"c{a}{b}") for a in XYZ for b in XYZ]
    return pairs.groupBy(*by).agg(F.count("*").alias("n"), *means, *cross)


def solve_kabsch(row) -> np.ndarray:
    """The 4x4 transform of a row of kabsch_moments."""
    s, t = (np.array([row[f"m{k}{c}"] for c in XYZ]) for k in "st")
    return kernels.kabsch_from_moments(s, t, np.array([[row[f"c{a}{b}"] for b in XYZ] for a in XYZ]))


def kabsch(pairs: DataFrame) -> np.ndarray:
    return solve_kabsch(kabsch_moments(pairs).first())


def ego_velocity_moments(detections: DataFrame, min_snr: float = 0.0, by: tuple[str, ...] = ()) -> DataFrame:
    """by, n, the six sums of d d^T and the three of -velocity * d, with d the direction of each detection of enough snr."""
    a, e = F.radians("azimuth"), F.radians("elevation")
    d = {"x": F.cos(e) * F.cos(a), "y": F.cos(e) * F.sin(a), "z": F.sin(e)}
    rows = detections.where(F.col("snr") >= min_snr).select(*by, "velocity", *[v.alias(f"d{k}") for k, v in d.items()])
    quad = [F.sum(F.col(f"d{p}") * F.col(f"d{q}")).alias(f"a{p}{q}") for i, p in enumerate(XYZ) for q in XYZ[i:]]
    right = [F.sum(-F.col("velocity") * F.col(f"d{p}")).alias(f"b{p}") for p in XYZ]
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *quad, *right)


def solve_ego_velocity(row, min_inliers: int = 3) -> tuple[np.ndarray, bool]:
    """(velocity, valid); zeros and false with too few detections."""
    if row is None or row["n"] < min_inliers:
        return np.zeros(3), False
    a = np.array([[row["axx"], row["axy"], row["axz"]], [row["axy"], row["ayy"], row["ayz"]], [row["axz"], row["ayz"], row["azz"]]])
    return np.linalg.lstsq(a, np.array([row["bx"], row["by"], row["bz"]]), rcond=None)[0], True


def calibrate_rigs(planes: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, n, transform (16): lidar to camera of each rig from matched planes (lx, ly, lz, ld, cx, cy, cz, cd), null with fewer than three planes.

    The rotation is that of the normals, without centring; then t from n_c . t = d_c - d_l. A rig's planes become one row of sums, and rows are solved many at a time.
    """
    cross = [F.sum(F.col(f"l{a}") * F.col(f"c{b}")).alias(f"_w{a}{b}") for a in XYZ for b in XYZ]
    quad = [F.sum(F.col(f"c{a}") * F.col(f"c{b}")).alias(f"_q{a}{b}") for a in XYZ for b in XYZ]
    right = [F.sum(F.col(f"c{a}") * (F.col("cd") - F.col("ld"))).alias(f"_r{a}") for a in XYZ]
    sums = planes.groupBy(*by).agg(F.count("*").alias("n"), *cross, *quad, *right)
    kinds = {f.name: f for f in sums.schema.fields}
    schema = StructType([*[kinds[c] for c in by], kinds["n"], StructField("transform", ArrayType(DoubleType()))])

    def run(batches):
        for b in batches:
            column = lambda c, b=b: b.column(c).fill_null(0.0).to_numpy(zero_copy_only=False)
            w = np.stack([column(f"_w{a}{c}") for a in XYZ for c in XYZ], axis=1).reshape(-1, 3, 3)
            q = np.stack([column(f"_q{a}{c}") for a in XYZ for c in XYZ], axis=1).reshape(-1, 3, 3)
            d = np.stack([column(f"_r{a}") for a in XYZ], axis=1)
            u, _, vt = np.linalg.svd(w)
            vt[:, 2] *= np.linalg.det(vt.transpose(0, 2, 1) @ u.transpose(0, 2, 1))[:, None]
            m = np.tile(np.eye(4), (len(w), 1, 1))
            m[:, :3, :3] = vt.transpose(0, 2, 1) @ u.transpose(0, 2, 1)
            m[:, :3, 3] = np.einsum("nij,nj->ni", np.linalg.pinv(q), d)  # the shortest where planes leave a direction open
            few = b.column("n").to_numpy() < 3
            lists = pa.array([None if f else r for f, r in zip(few, m.reshape(-1, 16).tolist(), strict=True)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in by], b.column("n"), lists], names=schema.names)

    return map_in_arrow(sums, run, schema)


def calibrate(planes: DataFrame) -> np.ndarray:
    """The lidar-to-camera transform of one rig, see calibrate_rigs."""
    row = calibrate_rigs(planes).first()
    if row.transform is None:
        raise CalibrationError("three planes or more are needed")
    return np.reshape(row.transform, (4, 4))


def _nearest_in_cells(source: DataFrame, target: DataFrame, cell: float) -> DataFrame:
    """source's id, sx..sz and tx..tz of its nearest target point within the cell size, by 27 cells."""
    at = lambda c: F.floor(F.col(c) / cell).cast("long")
    offset = F.explode(F.expr("flatten(flatten(transform(sequence(-1,1), i -> transform(sequence(-1,1), j -> transform(sequence(-1,1), k -> struct(i as i, j as j, k as k))))))"))
    s = source.withColumn("_o", offset).select("*", (at("sx") + F.col("_o.i")).alias("_i"), (at("sy") + F.col("_o.j")).alias("_j"), (at("sz") + F.col("_o.k")).alias("_k"))
    t = target.select("*", at("tx").alias("_i"), at("ty").alias("_j"), at("tz").alias("_k"))
    d2 = sum((F.col(f"s{c}") - F.col(f"t{c}")) * (F.col(f"s{c}") - F.col(f"t{c}")) for c in XYZ)
    near = s.join(t, ["_i", "_j", "_k"]).withColumn("_d", d2).where(F.col("_d") <= cell * cell)
    best = F.min(F.struct("_d", "tx", "ty", "tz")).alias("m")
    return near.groupBy("id", "sx", "sy", "sz").agg(best).select("id", "sx", "sy", "sz", "m.tx", "m.ty", "m.tz", F.col("m._d").alias("d2"))


def icp(source: DataFrame, target: DataFrame, max_distance: float, max_iterations: int = 50, tolerance: float = 1e-6, initial=None, callback=None) -> tuple[np.ndarray, float, int, bool]:
    """(transform, mse, iterations, converged) of large clouds (x, y, z): each step is one join and one row of moments.

    max_distance bounds a correspondence and is the size of the cells of the join.
    """
    if max_distance <= 0:
        raise SensorError("a distance is positive")
    s0 = source.select(F.monotonically_increasing_id().alias("id"), *XYZ).persist()
    t0 = target.select(*[F.col(c).alias(f"t{c}") for c in XYZ]).persist()

    def pairs(m):
        moved = [sum((float(m[i, j]) * F.col(c) for j, c in enumerate(XYZ)), F.lit(float(m[i, 3]))).alias(f"s{k}") for i, k in enumerate(XYZ)]
        return _nearest_in_cells(s0.select("id", *moved), t0, max_distance)

    m = np.eye(4) if initial is None else np.array(initial, float)
    last, converged, step = np.inf, False, 0
    for step in range(1, max_iterations + 1):
        p = pairs(m)
        row = p.groupBy().agg(F.avg("d2").alias("mse"), F.count("*").alias("n"), *[F.avg(f"{k}{c}").alias(f"m{k}{c}") for k in "st" for c in XYZ], *[(F.covar_pop(f"s{a}", f"t{b}") * F.count("*")).alias(f"c{a}{b}") for a in XYZ for b in XYZ]).first()
        if row.n < 3:
            break
        m = solve_kabsch(row) @ m
        if callback:
            callback(step, row.mse)
        if abs(last - row.mse) < tolerance:
            converged = True
            break
        last = row.mse
    mse = pairs(m).agg(F.avg("d2")).first()[0]
    s0.unpersist()
    t0.unpersist()
    return m, float("inf") if mse is None else float(mse), step, converged


ICP_SCHEMA = "transform array<double>, mse double, iterations int, converged boolean"

#: Points that are read before the clouds among them are matched.
READ = 40_000


def _xyz(b: pa.RecordBatch) -> np.ndarray:
    return np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in XYZ], axis=1)


def _matched(keys: pa.Array, name: str, got) -> pa.RecordBatch:
    t, mse, n, ok = got
    lists = pa.array(np.reshape(t, (-1, 16)).tolist(), pa.list_(pa.float64()))
    return pa.RecordBatch.from_arrays([keys, lists, pa.array(mse, pa.float64()), pa.array(n, pa.int32()), pa.array(ok, pa.bool_())], names=[name, "transform", "mse", "iterations", "converged"])


def _match_schema(source: DataFrame, by: str) -> StructType:
    return StructType([StructField(by, source.schema[by].dataType), StructField("transform", ArrayType(DoubleType())), StructField("mse", DoubleType()), StructField("iterations", IntegerType()), StructField("converged", BooleanType())])


def icp_frames(source: DataFrame, target: DataFrame, by: str = "frame", plane: bool = False, normals_k: int = 20, **options) -> DataFrame:
    """by, transform (16), mse, iterations, converged for each group of two clouds; with plane point-to-plane.

    The clouds of a group lie side by side in one sorted partition, and a task matches some groups together.
    """

    def run(batches):
        for b in whole_groups(batches, ("_k",), READ):
            p, side = _xyz(b), b.column("_side").to_numpy(zero_copy_only=False)
            begin = np.flatnonzero(starts(b, ("_k",), None))
            end = np.append(begin[1:], b.num_rows)
            middle = begin + np.add.reduceat(side == 0, begin)
            both = np.flatnonzero((middle > begin) & (middle < end))
            if not len(both):
                continue
            one, two = [p[begin[i] : middle[i]] for i in both], [p[middle[i] : end[i]] for i in both]
            if plane:
                each = [kernels.icp(x, y, plane_normals=kernels.point_normals(y, normals_k), **options) for x, y in zip(one, two, strict=True)]
                got = [np.array(v) for v in zip(*each, strict=True)]
            else:
                got = kernels.icp_many(one, two, **options)
            yield _matched(b.column("_k").take(pa.array(begin[both])), by, got)

    sided = lambda d, side: d.select(F.col(by).alias("_k"), F.lit(side).alias("_side"), "seq", *[F.col(c).cast("double").alias(c) for c in XYZ])
    rows = sided(source, 0).unionByName(sided(target, 1)).repartition("_k").sortWithinPartitions("_k", "_side", "seq")
    return rows.select("_k", "_side", *XYZ).mapInArrow(run, _match_schema(source, by))


#: Points of a fixed map that are read by a task as one array; beyond, a map is matched by joins over cells.
MAP_POINTS = 5_000_000


def icp_to_map(scans: DataFrame, map_points: DataFrame, by: str = "frame", **options) -> DataFrame:
    """by, transform, mse, iterations, converged of each scan against one fixed map.

    A map of up to MAP_POINTS points is broadcast to the workers once, and scans are grouped; a larger map would not fit them, and each scan
    is matched by icp, a join over cells a step, which needs max_distance.
    """
    points = map_points.select(*XYZ)
    if points.limit(MAP_POINTS + 1).count() > MAP_POINTS:
        if not np.isfinite(options.get("max_distance", np.inf)):
            raise SensorError(f"a map of more than {MAP_POINTS} points needs max_distance")
        rows = []
        for (f,) in scans.select(by).distinct().orderBy(by).collect():
            m, mse, n, ok = icp(scans.where(F.col(by) == f), points, **options)
            rows.append((f, m.ravel().tolist(), mse, n, ok))
        return scans.sparkSession.createDataFrame(rows, f"{by} {dict(scans.dtypes)[by]}, {ICP_SCHEMA}")
    target = scans.sparkSession.sparkContext.broadcast(points.toPandas().to_numpy(float))

    def run(batches):
        for b in whole_groups(batches, ("_k",), READ):
            begin = np.flatnonzero(starts(b, ("_k",), None))
            clouds = np.split(_xyz(b), begin[1:])
            yield _matched(b.column("_k").take(pa.array(begin)), by, kernels.icp_many(clouds, [target.value] * len(clouds), **options))

    rows = scans.select(F.col(by).alias("_k"), "seq", *[F.col(c).cast("double").alias(c) for c in XYZ]).repartition("_k").sortWithinPartitions("_k", "seq")
    return rows.select("_k", *XYZ).mapInArrow(run, _match_schema(scans, by))


def scan_odometry(scans: DataFrame, session: str = "session", frame: str = "frame", forward: bool = True, world: bool = False, window: int = 1, voxel: float | None = None, **options) -> DataFrame:
    """session, frame, pose (16), transform (16, of the match), mse, converged: neighbouring frames are matched, transforms multiplied up.

    forward aligns the frame before to the current one, as radar odometry does; else the current one is aligned to what is before. The pose becomes
    pose @ transform, or with world transform @ pose. With window the target is the last so many frames together, each reduced to means of
    voxels if asked (not with forward). Matching needs only two neighbouring frames, so it runs frame by frame; the transforms of a session
    are multiplied up by partitions.
    """
    if forward and window > 1:
        raise SensorError("a window of frames is a target only")
    # frames are counted over all sessions, and each session subtracts where it begins
    counted = number_rows(scans.select(session, frame).distinct(), session, frame, name="_at")
    began = counted.groupBy(F.col(session).alias("_s")).agg(F.min("_at").alias("_from"))
    number = counted.join(began, F.col(session).eqNullSafe(F.col("_s"))).select(session, frame, (F.col("_at") - F.col("_from") + 1).alias("_i"))
    key = F.struct(session, "_i").cast("string").alias("_k")
    cols = (session, frame, "seq", *XYZ)
    numbered = scans.select(*cols).join(number, [session, frame])
    current = numbered.where("_i > 1").select(key, "seq", *XYZ)
    kept = numbered
    if voxel:
        from tessera.operators.clouds import voxel_downsample

        kept = voxel_downsample(numbered.drop("seq"), voxel, (session, "_i"), origin="zero").withColumn("seq", F.row_number().over(Window.partitionBy(session, "_i").orderBy(*XYZ)))
    last = number.groupBy(session).agg(F.max("_i").alias("_n"))
    later = F.explode(F.sequence(F.col("_i") + 1, F.least(F.col("_i") + window, F.col("_n"))))
    before = kept.join(last, session).where("_i < _n").select(session, F.col("_i").alias("_of"), later.alias("_i"), "seq", *XYZ).select(key, (F.col("_of") * (1 << 32) + F.col("seq")).alias("seq"), *XYZ)
    steps = icp_frames(*((before, current) if forward else (current, before)), by="_k", **options)
    keyed = number.withColumn("_k", key).join(steps, "_k", "left")

    poses = prefix_products(keyed.select(session, frame, "transform", "mse", "converged"), "transform", (session,), (frame,), left=world, name="pose")
    return poses.select(session, frame, "pose", "transform", "mse", "converged")


def kiss_odometry(scans: DataFrame, session: str = "session", frame: str = "frame", voxel: float = 1.0, max_voxels: int = 100_000, initial: float = 2.0, alpha: float = 0.9, low: float = 0.1, high: float = 10.0, max_iterations: int = 50, tolerance: float = 1e-4) -> DataFrame:
    """session, frame, pose (16), residual, threshold: scan-to-map matching with a threshold that follows the residuals.

    Each frame depends on the map of all before, so a session is one fold; the sessions of a task take their frames in step.
    """

    def run(batches):
        for b in whole_groups(batches, ("_s",), 5 * READ):
            b = b.filter(b.column("_f").is_valid())
            if not b.num_rows:
                continue
            xyz, at = _xyz(b), np.flatnonzero(starts(b, ("_s", "_f"), None))
            end = np.append(at[1:], len(xyz))
            first = np.flatnonzero(starts(b, ("_s",), None)[at])  # of each session's frames
            count = np.diff(np.append(first, len(at)))
            n = len(first)
            pose, sigma, have, points = np.tile(np.eye(4), (n, 1, 1)), np.full(n, float(initial)), [{} for _ in first], [np.empty((0, 3)) for _ in first]
            poses, residuals, limits = np.empty((len(at), 16)), np.zeros(len(at)), np.empty(len(at))
            for turn in range(int(count.max())):
                live = np.flatnonzero(count > turn)
                row = first[live] + turn
                scans = [kernels.voxel_means(xyz[at[i] : end[i]], voxel) for i in row]
                limits[row] = np.clip(3 * sigma[live], low, high)
                some = np.array([i for i, s in enumerate(live) if len(points[s]) and len(scans[i]) >= 3], int)
                if len(some):
                    m, mse, _, _ = kernels.icp_many([scans[i] for i in some], [points[s] for s in live[some]], max_iterations, tolerance, limits[row[some]])
                    pose[live[some]] = pose[live[some]] @ np.linalg.inv(m)
                    good = np.isfinite(mse)
                    s, found = live[some[good]], np.sqrt(mse[good])
                    residuals[row[some[good]]], sigma[s] = found, alpha * sigma[s] + (1 - alpha) * found
                poses[row] = pose[live].reshape(-1, 16)
                for p, s in zip(scans, live.tolist(), strict=True):
                    moved, known, fresh = p @ pose[s, :3, :3].T + pose[s, :3, 3], have[s], []
                    for i, key in enumerate(map(tuple, np.floor(moved / voxel).astype(int).tolist())):
                        if key not in known:
                            known[key] = None
                            fresh.append(i)
                    points[s] = np.concatenate((points[s], moved[fresh]))
                    if len(known) > max_voxels:  # the oldest voxels leave first
                        points[s] = points[s][len(known) - max_voxels :]
                        for old in list(known)[: len(known) - max_voxels]:
                            del known[old]
            names = pa.array(at)
            yield pa.RecordBatch.from_arrays([b.column("_s").take(names), b.column("_f").take(names), pa.array(poses.tolist(), pa.list_(pa.float64())), pa.array(residuals), pa.array(limits)], names=[session, frame, "pose", "residual", "threshold"])

    rows = scans.select(F.col(session).alias("_s"), F.col(frame).alias("_f"), "seq", *[F.col(c).cast("double").alias(c) for c in XYZ]).repartition("_s").sortWithinPartitions("_s", "_f", "seq")
    schema = StructType([*[StructField(c, scans.schema[c].dataType) for c in (session, frame)], StructField("pose", ArrayType(DoubleType())), StructField("residual", DoubleType()), StructField("threshold", DoubleType())])
    return rows.select("_s", "_f", *XYZ).mapInArrow(run, schema)
