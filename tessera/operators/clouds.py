"""Point clouds: voxels, ground, filters, planes, normals, maps. A cloud is rows of frame, seq, x, y, z and more."""

from __future__ import annotations

import itertools
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from tessera.errors import SensorError
from tessera.kernels import Cells

XYZ = ("x", "y", "z")


def _positive(v: float, what: str) -> None:
    if not v > 0:
        raise SensorError(f"{what} must be positive")


def _voxel(c: str, size: float, origin: Column | float = 0.0) -> Column:
    return F.floor((F.col(c) - origin) / size).cast("long")


def voxel_downsample(cloud: DataFrame, size: float, by: tuple[str, ...] = (), origin: str = "min", colours: bool = False) -> DataFrame:
    """by, ix, iy, iz, x, y, z, n [, r, g, b]: the mean point of each voxel. origin is 'min', the cloud's least corner, or 'zero'.

    Mean colours are truncated to whole numbers.
    """
    _positive(size, "a voxel's size")
    if origin == "min":
        corner = [F.min(c).alias(f"_{c}") for c in XYZ]
        if by:  # a join with the corners, as a window would hold a cloud's rows
            low = cloud.groupBy(*by).agg(*corner).toDF(*[f"_by{i}" for i in range(len(by))], *[f"_{c}" for c in XYZ])
            base = cloud.join(low, reduce(and_, [F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)]))
        else:
            base = cloud.crossJoin(F.broadcast(cloud.agg(*corner)))
        keys = [_voxel(c, size, F.col(f"_{c}")).alias(f"i{c}") for c in XYZ]
    else:
        base, keys = cloud, [_voxel(c, size).alias(f"i{c}") for c in XYZ]
    extra = [F.floor(F.avg(c)).cast("short").alias(c) for c in "rgb"] if colours else []
    return base.groupBy(*by, *keys).agg(*[F.avg(c).alias(c) for c in XYZ], F.count("*").alias("n"), *extra)


def voxel_first(cloud: DataFrame, size: float, by: tuple[str, ...] = (), max_voxels: int | None = None) -> DataFrame:
    """by, ix, iy, iz, seq, x, y, z: the first point of each voxel by seq; beyond max_voxels the oldest voxels are dropped."""
    _positive(size, "a voxel's size")
    first = cloud.groupBy(*by, *[_voxel(c, size).alias(f"i{c}") for c in XYZ]).agg(F.min_by(F.struct("seq", *XYZ), "seq").alias("p"))
    out = first.select(*by, "ix", "iy", "iz", "p.*")
    if max_voxels is None:
        return out
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("seq")))
    return out.withColumn("_r", rank).where(F.col("_r") <= max_voxels).drop("_r")


def is_ground_by_height(z: Column, threshold: float = 0.3) -> Column:
    return z < threshold


def is_static(velocity: Column, doppler_threshold: float = 0.5) -> Column:
    return F.abs(velocity) <= doppler_threshold


#: Distances in the side of a block of space, reference points that are searched at once if no block holds more, and pairs that are held at once.
BLOCK_SIDE, TASK_POINTS, HELD = 8, 100_000, 1_000_000


def within_distance(cloud: DataFrame, reference: DataFrame, distance: float, by: tuple[str, ...] = ()) -> DataFrame:
    """cloud's columns plus keep: whether any reference point lies within the distance, itself included. Each row gives one row, repeated ones too.

    Space is cut into blocks of BLOCK_SIDE distances. A point goes to its block, a reference point to those that its reach touches (two on average, eight at most).
    Blocks are dealt to groups of about TASK_POINTS; there a point asks the cells around it in its block, about as wide as the distance, some points at a time.
    """
    _positive(distance, "a distance")
    side, reach = BLOCK_SIDE * distance, distance * (1 + 1e-9)
    axes = [f"_b{c}" for c in XYZ]
    keys = [f"_g{i}" for i in range(len(by))]
    names = cloud.columns
    block = lambda c: F.floor(c / side).cast("long")
    spread = lambda c: F.explode(F.sequence(block(F.col(c) - reach - F.abs(F.col(c)) * 1e-12), block(F.col(c) + reach + F.abs(F.col(c)) * 1e-12)))
    group = [F.col(c).alias(k) for c, k in zip(by, keys, strict=True)]
    own = cloud.select(F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)]).alias("_row"), *[F.col(c).cast("double").alias(f"_{c}") for c in XYZ], *group, *[block(F.col(c)).alias(a) for c, a in zip(XYZ, axes, strict=True)])
    sound = [*[F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in XYZ], *[F.col(c).isNotNull() for c in by]]
    other = reference.where(reduce(and_, sound)).select(*[F.col(c).cast("double").alias(f"_{c}") for c in XYZ], *group)
    for c, a in zip(XYZ, axes, strict=True):
        other = other.withColumn(a, spread(f"_{c}"))
    other = other.toDF(*[f"r{c}" for c in other.columns])
    schema = StructType([StructField("_row", own.schema["_row"].dataType), StructField("keep", BooleanType())])

    def run(t: pa.Table, o: pa.Table) -> pa.Table:
        keep = np.zeros(t.num_rows, bool)
        if t.num_rows and o.num_rows:
            code = np.zeros(t.num_rows + o.num_rows, np.int64)
            for k in (*keys, *axes):  # blocks are numbered
                found = pa.chunked_array([*t.column(k).chunks, *o.column(f"r{k}").chunks]).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
                code = np.unique(code * (int(found.max()) + 1) + found, return_inverse=True)[1]
            xyz = lambda t, head, kind="": np.stack([t.column(f"{head}_{kind}{c}").to_numpy().astype(float) for c in XYZ], axis=1)
            p, q = xyz(t, ""), xyz(o, "r")
            # blocks stand side by side along x, too far apart to meet; cells are a little wider than the distance for what this rounds
            apart = np.array([side + 4 * distance, 0, 0])
            place = p - xyz(t, "", "b") * side + code[: len(p), None] * apart
            cells = Cells(q - xyz(o, "r", "b") * side + code[len(p) :, None] * apart, distance * (1 + 1e-6))
            ask, step = np.flatnonzero(np.isfinite(place).all(axis=1)), 256
            while len(ask):
                some, ask = ask[:step], ask[step:]
                who, found, _ = cells.around(place[some])
                gap = p[some][who] - q[found]
                keep[some[who[gap[:, 0] * gap[:, 0] + gap[:, 1] * gap[:, 1] + gap[:, 2] * gap[:, 2] <= distance * distance]]] = True
                step = int(np.clip(HELD * len(some) // max(1, len(who)), 1, 50_000))
        return pa.table([t.column("_row"), pa.array(keep)], names=["_row", "keep"])

    deal = F.lit(reference.count() // TASK_POINTS + 1)
    own = own.withColumn("_deal", F.pmod(F.xxhash64(*keys, *axes), deal))
    other = other.withColumn("_rdeal", F.pmod(F.xxhash64(*[f"r{c}" for c in (*keys, *axes)]), deal))
    out = own.groupBy("_deal").cogroup(other.groupBy("_rdeal")).applyInArrow(run, schema)
    return out.select(*[F.col(f"_row.c{i}").alias(c) for i, c in enumerate(names)], "keep")


def plane_moments(cloud: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, n, the centroid and the six central second moments (sums), enough for a plane and its residuals."""
    means = [F.avg(c).alias(f"m{c}") for c in XYZ]
    cov = [(F.covar_pop(a, b) * F.count("*")).alias(f"s{a}{b}") for a, b in itertools.combinations_with_replacement(XYZ, 2)]
    return cloud.groupBy(*by).agg(F.count("*").alias("n"), *means, *cov)


def solve_plane(row) -> tuple[np.ndarray, float]:
    """(normal, d) with normal . p = d and d >= 0, from a row of plane_moments."""
    if row["n"] < 3:
        raise SensorError("a plane needs three points")
    m = np.array([[row["sxx"], row["sxy"], row["sxz"]], [row["sxy"], row["syy"], row["syz"]], [row["sxz"], row["syz"], row["szz"]]])
    normal = np.linalg.eigh(m)[1][:, 0]
    d = float(normal @ [row["mx"], row["my"], row["mz"]])
    return (normal, d) if d >= 0 else (-normal, -d)


def fit_plane(cloud: DataFrame) -> tuple[np.ndarray, float]:
    return solve_plane(plane_moments(cloud).first())


def plane_hypotheses(cloud: DataFrame, triples: DataFrame, key: str = "seq") -> DataFrame:
    """hyp, nx, ny, nz, d of the planes through given triples (hyp, a, b, c of key values); degenerate ones are dropped."""
    p = cloud.select(F.col(key).alias("_k"), F.struct(*XYZ).alias("_p"))
    t = triples
    for c in "abc":  # triples are a handful, drawn on the driver
        t = F.broadcast(t).join(p.withColumnRenamed("_k", c).withColumnRenamed("_p", f"p{c}"), c)
    u = [F.col(f"pb.{c}") - F.col(f"pa.{c}") for c in XYZ]
    v = [F.col(f"pc.{c}") - F.col(f"pa.{c}") for c in XYZ]
    n = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    t = t.select("hyp", "pa", *[x.alias(f"_{c}") for c, x in zip(XYZ, n, strict=True)])
    norm = F.sqrt(F.col("_x") * F.col("_x") + F.col("_y") * F.col("_y") + F.col("_z") * F.col("_z"))
    t = t.withColumn("_n", norm).where("_n > 1e-12").select("hyp", "pa", *[(F.col(f"_{c}") / F.col("_n")).alias(f"n{c}") for c in XYZ])
    return t.select("hyp", "nx", "ny", "nz", (F.col("nx") * F.col("pa.x") + F.col("ny") * F.col("pa.y") + F.col("nz") * F.col("pa.z")).alias("d"))


def count_inliers(cloud: DataFrame, planes: DataFrame, threshold: float, inclusive: bool = True) -> DataFrame:
    """hyp and how many points lie within the threshold; planes, a handful, go to every task, which reads its points once and gives one row a plane."""
    kind = planes.schema["hyp"].dataType
    found = [(p.hyp, p.nx, p.ny, p.nz, p.d) for p in planes.select("hyp", "nx", "ny", "nz", "d").collect()]

    def run(batches):
        counts = np.zeros(len(found), np.int64)
        for b in batches:
            x, y, z = (b.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(3))
            for at in range(0, len(x), 8192):  # a piece stays in the cache while all planes pass
                u, v, w = x[at : at + 8192], y[at : at + 8192], z[at : at + 8192]
                for i, (_, nx, ny, nz, d) in enumerate(found):
                    off = np.abs(nx * u + ny * v + nz * w - d)
                    counts[i] += np.count_nonzero(off <= threshold if inclusive else off < threshold)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(found))), pa.array(counts)], names=["i", "n"])

    sums = cloud.select(*[F.col(c).cast("double") for c in XYZ]).mapInArrow(run, "i long, n long").groupBy("i").agg(F.sum("n").alias("inliers")).where("inliers > 0")
    names = cloud.sparkSession.createDataFrame([(i, p[0]) for i, p in enumerate(found)], StructType([StructField("i", LongType()), StructField("hyp", kind)]))
    return sums.join(F.broadcast(names), "i").select("hyp", "inliers")


def _triples(n: int, iterations: int, seed: int) -> list[tuple[int, int, int, int]]:
    rng = np.random.default_rng(seed)
    return [(i, *map(int, rng.choice(n, 3, replace=False))) for i in range(iterations)]


def _drawn(cloud: DataFrame, iterations: int, seed: int) -> DataFrame:
    """plane_hypotheses of triples drawn over the row number by seq. Only the drawn points, three a triple, leave the tasks."""
    from tessera.operators.scans import number_rows

    spark, points = cloud.sparkSession, number_rows(cloud.select("seq", *XYZ), "seq", name="_row")
    n = points.count()
    if n < 3:
        raise SensorError("a plane needs three points")
    triples = _triples(n, iterations, seed)
    wanted = spark.createDataFrame([(i,) for i in sorted({i for t in triples for i in t[1:]})], "_row long")
    points = points.select("_row", *XYZ)
    some = spark.createDataFrame(points.join(F.broadcast(wanted), "_row").select(*points.columns).collect(), points.schema)
    return plane_hypotheses(some, spark.createDataFrame(triples, "hyp int, a long, b long, c long"), "_row")


def ransac_plane(cloud: DataFrame, threshold: float = 0.05, iterations: int = 100, min_inliers: int = 10, seed: int = 0) -> tuple[np.ndarray, float, DataFrame]:
    """(normal, d, cloud with inlier). Triples are drawn over the row number by seq; the first of the best wins and is refitted."""
    planes = _drawn(cloud, iterations, seed)
    best = count_inliers(cloud, planes, threshold).orderBy(F.desc("inliers"), "hyp").first()
    if best is None or best.inliers < min_inliers:
        raise SensorError("too few inliers")
    plane = planes.where(F.col("hyp") == best.hyp).first()
    off = lambda nx, ny, nz, d: F.abs(nx * F.col("x") + ny * F.col("y") + nz * F.col("z") - d)
    normal, d = fit_plane(cloud.where(off(plane.nx, plane.ny, plane.nz, plane.d) <= threshold))
    return normal, d, cloud.withColumn("inlier", off(*map(float, normal), d) <= threshold)


def ransac_ground(cloud: DataFrame, threshold: float = 0.2, iterations: int = 1000, normal_threshold: float = 0.9, seed: int = 0) -> tuple[np.ndarray, float, DataFrame]:
    """(normal, d, cloud with ground): planes whose upward normal is steep enough; strict inliers, no refit. Under three points nothing is ground."""
    none = (np.zeros(3), 0.0, cloud.withColumn("ground", F.lit(False)))
    if len(cloud.limit(3).select("seq").take(3)) < 3:
        return none
    planes = _drawn(cloud, iterations, seed)
    sign = F.when(F.col("nz") < 0, -1.0).otherwise(1.0)
    planes = planes.select("hyp", *[(F.col(c) * sign).alias(c) for c in ("nx", "ny", "nz", "d")]).where(F.col("nz") >= normal_threshold)
    best = count_inliers(cloud, planes, threshold, inclusive=False).orderBy(F.desc("inliers"), "hyp").first()
    if best is None:
        return none
    p = planes.where(F.col("hyp") == best.hyp).first()
    off = F.abs(p.nx * F.col("x") + p.ny * F.col("y") + p.nz * F.col("z") - p.d)
    return np.array([p.nx, p.ny, p.nz]), p.d, cloud.withColumn("ground", off < threshold)


def normals(cloud: DataFrame, k: int = 20, frame: str = "frame", up: bool = False) -> DataFrame:
    """frame, seq, nx, ny, nz: the least principal axis of the k nearest points of the frame, the point included.

    Normals point towards the frame's centroid, or with up to where z grows. Frames of fewer than three points get (0, 0, 1).
    """
    if k < 3:
        raise SensorError("k must be three or more")
    from tessera.kernels import point_normals

    def run(t):
        import pandas as pd

        t = t.sort_values("seq")
        n = point_normals(t[list(XYZ)].to_numpy(float), k, up)
        return pd.DataFrame({frame: t[frame].to_numpy(), "seq": t["seq"].to_numpy(), "nx": n[:, 0], "ny": n[:, 1], "nz": n[:, 2]})

    kinds = dict(cloud.dtypes)
    return cloud.select(frame, "seq", *XYZ).groupBy(frame).applyInPandas(run, f"{frame} {kinds[frame]}, seq {kinds['seq']}, nx double, ny double, nz double")


def ground_by_normals(cloud: DataFrame, k: int = 20, verticality: float = 0.85, frame: str = "frame") -> DataFrame:
    return normals(cloud, k, frame, up=True).withColumn("ground", F.col("nz") > verticality)


def add_scans(scans: DataFrame, poses: DataFrame, max_points: int | None = None) -> DataFrame:
    """The map: scans (frame, seq, x, y, z) moved by poses (frame, transform), the newest max_points by (frame, seq)."""
    from tessera.functions import se3

    moved = scans.join(poses, "frame").withColumn("_p", se3.apply_to_point(F.col("transform"), *[F.col(c) for c in XYZ]))
    out = moved.select(*[F.col(f"_p.{c}").alias(c) if c in XYZ else F.col(c) for c in scans.columns])
    return out if max_points is None else out.orderBy(F.desc("frame"), F.desc("seq")).limit(max_points)


def local_map(scans: DataFrame, keyframe: str = "frame", last: int = 10, voxel: float | None = None) -> DataFrame:
    """Points of the last keyframes, reduced to voxel means of each keyframe if asked."""
    newest = scans.select(keyframe).distinct().orderBy(F.desc(keyframe)).limit(last)
    kept = scans.join(F.broadcast(newest), keyframe)
    return kept if voxel is None else voxel_downsample(kept, voxel, (keyframe,), origin="zero").select(keyframe, *XYZ)
