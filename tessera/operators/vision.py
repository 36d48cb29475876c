"""Images and stereo, image by image or pair by pair; geometry of points as column expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera import kernels
from tessera.errors import CalibrationError


def corners(pixels: DataFrame, image: str = "img", **options) -> DataFrame:
    """image, rank, row, col of Harris corners, strongest first. pixels: img, row, col, v."""

    def run(t: pd.DataFrame) -> pd.DataFrame:
        c = kernels.harris(kernels.to_image(t), **options)
        return pd.DataFrame({image: t[image].iloc[0], "rank": np.arange(len(c)), "row": c[:, 0], "col": c[:, 1]})

    return pixels.select(image, "row", "col", "v").groupBy(image).applyInPandas(run, f"{image} {dict(pixels.dtypes)[image]}, rank int, row int, col int")


def sobel(pixels: DataFrame, image: str = "img") -> DataFrame:
    """image, row, col, gx, gy inside the image: the stencil as a join-free aggregation of each pixel's shares to its neighbours."""
    share = [(dr, dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1) if (dr, dc) != (0, 0)]
    taps = F.explode(F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc"), F.lit(-dc * (2 if dr == 0 else 1)).alias("wx"), F.lit(-dr * (2 if dc == 0 else 1)).alias("wy")) for dr, dc in share]))
    s = pixels.withColumn("_t", taps).select(image, (F.col("row") + F.col("_t.dr")).alias("row"), (F.col("col") + F.col("_t.dc")).alias("col"), (F.col("v") * F.col("_t.wx")).alias("x"), (F.col("v") * F.col("_t.wy")).alias("y"))
    g = s.groupBy(image, "row", "col").agg(F.sum("x").alias("gx"), F.sum("y").alias("gy"), F.count("*").alias("_n"))
    return g.where("_n = 8").drop("_n")


def patches(pixels: DataFrame, keypoints: DataFrame, size: int = 11, image: str = "img") -> DataFrame:
    """image, row, col, descriptor: zero-mean patches of norm 1; zeros at the border. keypoints: img, row, col."""

    def run(p: pd.DataFrame, k: pd.DataFrame) -> pd.DataFrame:
        if not len(p) or not len(k):
            return pd.DataFrame(columns=[image, "row", "col", "descriptor"])
        d = kernels.patch_descriptors(kernels.to_image(p), k[["row", "col"]].to_numpy(int), size)
        return pd.DataFrame({image: k[image].to_numpy(), "row": k["row"].to_numpy(), "col": k["col"].to_numpy(), "descriptor": list(map(list, d))})

    return pixels.select(image, "row", "col", "v").groupBy(image).cogroup(keypoints.groupBy(image)).applyInPandas(run, f"{image} {dict(pixels.dtypes)[image]}, row int, col int, descriptor array<double>")


def disparity(pixels: DataFrame, image: str = "img", **options) -> DataFrame:
    """image, row, col, d by block matching. pixels: img, row, col, left, right."""

    def run(t: pd.DataFrame) -> pd.DataFrame:
        a, b = (kernels.to_image(t.rename(columns={c: "v"})[["row", "col", "v"]]) for c in ("left", "right"))
        d = kernels.disparity(a, b, **options)
        r, c = np.indices(d.shape)
        return pd.DataFrame({image: t[image].iloc[0], "row": r.ravel(), "col": c.ravel(), "d": d.ravel()})

    return pixels.groupBy(image).applyInPandas(run, f"{image} {dict(pixels.dtypes)[image]}, row int, col int, d double")


def stereo_point(u: Column, v: Column, d: Column, f: float, cx: float, cy: float, baseline: float) -> Column:
    """struct<x,y,z> from a disparity; nan where it is not positive."""
    z = F.when(d > 1e-12, F.try_divide(F.lit(f * baseline), d)).otherwise(F.lit(float("nan")))
    return F.struct(((u - cx) * z / f).alias("x"), ((v - cy) * z / f).alias("y"), z.alias("z"))


def stereo_points(disparities: DataFrame, f: float, cx: float, cy: float, baseline: float, image: str = "img") -> DataFrame:
    """image, seq, x, y, z of a disparity map in row order; pixels without a disparity are dropped."""
    if baseline <= 0:
        raise CalibrationError("a baseline is positive")
    p = disparities.where("d > 1e-12").withColumn("_p", stereo_point(F.col("col"), F.col("row"), F.col("d"), f, cx, cy, baseline))
    return p.select(image, (F.row_number().over(Window.partitionBy(image).orderBy("row", "col")) - 1).alias("seq"), "_p.*")


def sampson(e, u1: Column, v1: Column, u2: Column, v2: Column) -> Column:
    """Sampson error of a pair of normalised points under a literal essential matrix."""
    m = np.asarray(e, float)
    a = [float(m[i, 0]) * u1 + float(m[i, 1]) * v1 + float(m[i, 2]) for i in range(3)]
    b = [float(m[0, i]) * u2 + float(m[1, i]) * v2 + float(m[2, i]) for i in range(2)]
    dot = u2 * a[0] + v2 * a[1] + a[2]
    return dot * dot / F.greatest(a[0] * a[0] + a[1] * a[1] + b[0] * b[0] + b[1] * b[1], F.lit(1e-12))


def reprojection_sq(r, t, k, x: Column, y: Column, z: Column, u: Column, v: Column) -> Column:
    """Squared pixel error of a point under a literal pose; infinite where its depth vanishes."""
    m = np.asarray(r, float)
    c = [float(m[i, 0]) * x + float(m[i, 1]) * y + float(m[i, 2]) * z + float(t[i]) for i in range(3)]
    k = np.asarray(k, float)
    pu = (float(k[0, 0]) * c[0] + float(k[0, 1]) * c[1] + float(k[0, 2]) * c[2]) / c[2]
    pv = (float(k[1, 1]) * c[1] + float(k[1, 2]) * c[2]) / c[2]
    return F.when(F.abs(c[2]) <= 1e-8, F.lit(float("inf"))).otherwise((pu - u) * (pu - u) + (pv - v) * (pv - v))


def essential(matches: DataFrame, k, by: str = "pair", **options) -> DataFrame:
    """by, e (9), rotation (9), translation (3), inliers. matches: by, seq, u1, v1, u2, v2."""
    k = np.asarray(k, float)

    def run(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("seq")
        a, b = t[["u1", "v1"]].to_numpy(float), t[["u2", "v2"]].to_numpy(float)
        e, ok = kernels.essential(a, b, k, **options) if len(t) >= 8 else (None, np.zeros(len(t), bool))
        if e is None:
            return pd.DataFrame(columns=[by, "e", "rotation", "translation", "inliers"])
        r, s = kernels.pose_from_essential(e, a[ok], b[ok], k)
        return pd.DataFrame({by: [t[by].iloc[0]], "e": [e.ravel().tolist()], "rotation": [r.ravel().tolist()], "translation": [s.tolist()], "inliers": [int(ok.sum())]})

    return matches.groupBy(by).applyInPandas(run, f"{by} {dict(matches.dtypes)[by]}, e array<double>, rotation array<double>, translation array<double>, inliers long")


def pnp(matches: DataFrame, k, by: str = "view", **options) -> DataFrame:
    """by, rotation (9), translation (3), inliers. matches: by, seq, x, y, z, u, v."""
    k = np.asarray(k, float)

    def run(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("seq")
        r, s, ok = kernels.pnp(t[["x", "y", "z"]].to_numpy(float), t[["u", "v"]].to_numpy(float), k, **options) if len(t) >= 6 else (None, None, np.zeros(1, bool))
        if r is None:
            return pd.DataFrame(columns=[by, "rotation", "translation", "inliers"])
        return pd.DataFrame({by: [t[by].iloc[0]], "rotation": [r.ravel().tolist()], "translation": [s.tolist()], "inliers": [int(ok.sum())]})

    return matches.groupBy(by).applyInPandas(run, f"{by} {dict(matches.dtypes)[by]}, rotation array<double>, translation array<double>, inliers long")


def triangulate(matches: DataFrame, p1, p2, by: str = "pair") -> DataFrame:
    """by, seq, x, y, z by the direct linear transform. matches: by, seq, u1, v1, u2, v2."""
    a, b = np.asarray(p1, float), np.asarray(p2, float)

    def run(batches):
        for t in batches:
            x = kernels.triangulate(a, b, t[["u1", "v1"]].to_numpy(float), t[["u2", "v2"]].to_numpy(float))
            yield pd.DataFrame({by: t[by], "seq": t["seq"], "x": x[:, 0], "y": x[:, 1], "z": x[:, 2]})

    kinds = dict(matches.dtypes)
    return matches.select(by, "seq", "u1", "v1", "u2", "v2").mapInPandas(run, f"{by} {kinds[by]}, seq {kinds['seq']}, x double, y double, z double")


def stereo_rectify(k1, d1, k2, d2, r, t, image_size) -> dict:
    """Rotations r1, r2 (3x3) and projections p1, p2 (3x4) of a rectified pair, with all that remapping needs.

    k1, k2: 3x3; d1, d2: k1, k2, p1, p2, k3, missing ones 0, which do not turn the cameras but bend the way back to their pixels; r, t: from camera 1 to 2; image_size: (height, width).
    """
    k1, k2, r, t = (np.asarray(m, float) for m in (k1, k2, r, t))
    if k1.shape != (3, 3) or k2.shape != (3, 3) or r.shape != (3, 3) or t.ravel().shape != (3,):
        raise CalibrationError("two 3x3 camera matrices, a 3x3 rotation and a translation of three are needed")
    if len(image_size) != 2 or min(image_size) <= 0:
        raise CalibrationError("an image has a positive height and width")
    try:
        r1, r2, p1, p2 = kernels.rectify(k1, k2, r, t.ravel())
    except ValueError as e:
        raise CalibrationError(str(e)) from e
    return {"r1": r1, "r2": r2, "p1": p1, "p2": p2, "k1": k1, "k2": k2, "d1": tuple(d1), "d2": tuple(d2), "image_size": tuple(image_size)}


def rectified_pixels(pair: dict, side: int, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """[n, 2] of u, v: where pixels of the rectified image of camera 1 or 2 lie in that camera's own image; NaN where they look backwards."""
    k, rot, p = pair[f"k{side}"], pair[f"r{side}"], pair[f"p{side}"]
    k1, k2, p1, p2, k3 = [*map(float, pair[f"d{side}"]), 0.0, 0.0, 0.0, 0.0, 0.0][:5]
    ray = np.stack(((col - p[0, 2]) / p[0, 0], (row - p[1, 2]) / p[1, 1], np.ones(len(row))), axis=1) @ rot  # its inverse is its transpose
    ahead = ray[:, 2] > 0
    x, y = (ray[:, :2] / np.where(ahead, ray[:, 2], np.nan)[:, None]).T
    r2 = x * x + y * y
    radial = 1 + r2 * (k1 + r2 * (k2 + r2 * k3))
    bent = np.stack((x * radial + 2 * p1 * x * y + p2 * (r2 + 2 * x * x), y * radial + p1 * (r2 + 2 * y * y) + 2 * p2 * x * y, np.ones(len(x))), axis=1)
    return bent @ k[:2].T


def rectification_map(spark: SparkSession, pair: dict, side: int) -> DataFrame:
    """row, col, u, v of every pixel of the rectified image; u and v are null where it looks backwards."""
    height, width = map(int, pair["image_size"])

    def run(batches):
        for b in batches:
            i = b.column(0).to_numpy()
            uv = rectified_pixels(pair, side, i // width, i % width)
            yield pa.RecordBatch.from_arrays([pa.array((i // width).astype(np.int32)), pa.array((i % width).astype(np.int32)), *[pa.array(c, mask=np.isnan(c)) for c in uv.T]], names=["row", "col", "u", "v"])

    return spark.range(height * width).mapInArrow(run, "row int, col int, u double, v double")


def remap(images: DataFrame, lookup: DataFrame, by: tuple[str, ...] = ("img",), value: str = "v") -> DataFrame:
    """by, row, col, value: images (by, row, col, value) looked up between pixels, by weights of the four around.

    lookup: row, col, u (column), v (row). A pixel that needs any that an image does not have is left out. Places that fall on a pixel need that one alone.
    """
    u, v = F.col("u"), F.col("v")
    x0, y0 = F.floor(u), F.floor(v)
    fx, fy = u - x0, v - y0
    four = F.array(*[F.struct((y0 + i).cast("int").alias("_r"), (x0 + j).cast("int").alias("_c"), ((fy if i else 1 - fy) * (fx if j else 1 - fx)).alias("_w")) for i in (0, 1) for j in (0, 1)])
    asked = lookup.where(u.isNotNull() & v.isNotNull()).select(F.col("row").alias("_row"), F.col("col").alias("_col"), F.explode(F.filter(four, lambda q: q._w > 0)).alias("_q")).select("_row", "_col", "_q.*")
    there = images.select(*by, F.col("row").alias("_r"), F.col("col").alias("_c"), F.col(value).cast("double").alias("_v")).join(asked, ["_r", "_c"])
    out = there.groupBy(*by, "_row", "_col").agg(F.sum("_w").alias("_w"), F.sum(F.col("_w") * F.col("_v")).alias(value))
    return out.where(F.col("_w") > 1 - 1e-9).select(*by, F.col("_row").alias("row"), F.col("_col").alias("col"), value)
