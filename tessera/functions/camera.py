"""Camera models as column expressions: pinhole, Brown-Conrady, fisheye and rolling shutter."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.errors import CalibrationError


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise CalibrationError(what)


def focal_length_from_fov(image_size: Column, fov_deg: Column) -> Column:
    """Pixels; null unless the size is positive and 0 < fov < 180."""
    return F.when((image_size > 0) & (fov_deg > 0) & (fov_deg < 180), image_size / 2 / F.tan(F.radians(fov_deg) / 2))


def focal_length_from_sensor(image_size_px: Column, sensor_size_mm: Column, focal_length_mm: Column) -> Column:
    ok = (image_size_px > 0) & (sensor_size_mm > 0) & (focal_length_mm > 0)
    return F.when(ok, focal_length_mm * image_size_px / sensor_size_mm)


def fov_from_focal_length(focal_length_px: Column, image_size_px: Column) -> Column:
    return F.when((focal_length_px > 0) & (image_size_px > 0), F.degrees(2 * F.atan(image_size_px / 2 / focal_length_px)))


def fisheye_focal_length_from_fov(image_size: Column, fov_deg: Column) -> Column:
    return F.when((image_size > 0) & (fov_deg > 0) & (fov_deg < 360), image_size / 2 / (F.radians(fov_deg) / 2))


def camera_matrix(fx: float, fy: float, cx: float, cy: float) -> list[float]:
    """K, row by row."""
    return [float(fx), 0.0, float(cx), 0.0, float(fy), float(cy), 0.0, 0.0, 1.0]


def project_point(k: list[float], x: Column, y: Column, z: Column) -> Column:
    """struct<u,v>; null at or behind the camera."""
    w = k[6] * x + k[7] * y + k[8] * z
    return F.when(z > 0, F.struct(((k[0] * x + k[1] * y + k[2] * z) / w).alias("u"), ((k[3] * x + k[4] * y + k[5] * z) / w).alias("v")))


def _inverse3(k: list[float]) -> list[float]:
    a, b, c, d, e, f, g, h, i = k
    det = a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)
    _need(abs(det) > 1e-300, "a camera matrix that cannot be inverted")
    return [x / det for x in (e * i - f * h, c * h - b * i, b * f - c * e, f * g - d * i, a * i - c * g, c * d - a * f, d * h - e * g, b * g - a * h, a * e - b * d)]


def unproject_pixel(k: list[float], u: Column, v: Column, depth: Column) -> Column:
    """struct<x,y,z> at a depth along z."""
    m = _inverse3(k)
    return F.struct(*[((m[3 * i] * u + m[3 * i + 1] * v + m[3 * i + 2]) * depth).alias(n) for i, n in enumerate("xyz")])


def _brown(x: Column, y: Column, dist) -> tuple[Column, Column, Column]:
    """Radial factor and the two tangential terms."""
    k1, k2, p1, p2, k3 = [*map(float, dist), 0.0, 0.0, 0.0, 0.0, 0.0][:5]
    r2 = x * x + y * y
    return 1 + k1 * r2 + k2 * r2 * r2 + k3 * r2 * r2 * r2, 2 * p1 * x * y + p2 * (r2 + 2 * x * x), p1 * (r2 + 2 * y * y) + 2 * p2 * x * y


def distort_point(x: Column, y: Column, dist) -> Column:
    """struct<x,y>; coefficients k1, k2, p1, p2, k3, missing ones 0."""
    radial, tx, ty = _brown(x, y, dist)
    return F.struct((x * radial + tx).alias("x"), (y * radial + ty).alias("y"))


def undistort_point(x: Column, y: Column, dist, steps: int = 100, tolerance: float = 1e-8) -> Column:
    """struct<x,y>: fixed-point steps that stop once a step's distorted image is within the tolerance.

    The steps run in Arrow batches, over the points of a batch that are not done yet; a null coordinate gives nulls.
    """
    k1, k2, p1, p2, k3 = [*map(float, dist), 0.0, 0.0, 0.0, 0.0, 0.0][:5]

    @F.pandas_udf("x double, y double")
    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        x0, y0 = x.to_numpy(float), y.to_numpy(float)
        out, live = np.stack((x0, y0)), np.flatnonzero(~(np.isnan(x0) | np.isnan(y0)))
        for _ in range(steps):
            u, v = out[:, live]
            r2 = u * u + v * v
            radial = 1 + k1 * r2 + k2 * r2 * r2 + k3 * r2 * r2 * r2
            tx, ty = 2 * p1 * u * v + p2 * (r2 + 2 * u * u), p1 * (r2 + 2 * v * v) + 2 * p2 * u * v
            ex, ey = u * radial + tx - x0[live], v * radial + ty - y0[live]
            move = ~(ex * ex + ey * ey < tolerance * tolerance)
            live, radial, tx, ty = live[move], radial[move], tx[move], ty[move]
            if not len(live):
                break
            out[0, live], out[1, live] = (x0[live] - tx) / radial, (y0[live] - ty) / radial
        return pd.DataFrame({"x": out[0], "y": out[1]})

    return run(x.cast("double"), y.cast("double"))


def _theta_d(theta: Column, dist) -> Column:
    k = [*map(float, dist), 0.0, 0.0, 0.0, 0.0][:4]
    t2 = theta * theta
    return theta * (1 + t2 * (k[0] + t2 * (k[1] + t2 * (k[2] + t2 * k[3]))))


def fisheye_distort_point(x: Column, y: Column, dist=()) -> Column:
    r = F.sqrt(x * x + y * y)
    s = F.when(r < 1e-8, F.lit(1.0)).otherwise(F.try_divide(_theta_d(F.atan(r), dist), r))
    return F.struct((x * s).alias("x"), (y * s).alias("y"))


def _theta_from(rd: Column, dist, steps: int, tolerance: float) -> Column:
    """Newton on theta * (1 + k1 theta^2 + ...) = rd, in Arrow batches over the values that are not done yet."""
    k = [*map(float, dist), 0.0, 0.0, 0.0, 0.0][:4]

    @F.pandas_udf("double")
    def run(rd: pd.Series) -> pd.Series:
        goal = rd.to_numpy(float)
        out, live = goal.copy(), np.flatnonzero(~np.isnan(goal))
        for _ in range(steps):
            t = out[live]
            t2 = t * t
            slope = 1 + t2 * (3 * k[0] + t2 * (5 * k[1] + t2 * (7 * k[2] + t2 * 9 * k[3])))
            off = t * (1 + t2 * (k[0] + t2 * (k[1] + t2 * (k[2] + t2 * k[3])))) - goal[live]
            move = np.divide(off, slope, out=np.zeros(len(t)), where=np.abs(slope) > 1e-12)
            out[live] = t - move
            live = live[~(np.abs(move) < tolerance)]
            if not len(live):
                break
        return pd.Series(out)

    return run(rd.cast("double"))


def fisheye_undistort_point(x: Column, y: Column, dist=(), steps: int = 20, tolerance: float = 1e-8) -> Column:
    rd = F.sqrt(x * x + y * y)
    s = F.when(rd < 1e-8, F.lit(1.0)).otherwise(F.try_divide(F.tan(_theta_from(rd, dist, steps, tolerance)), rd))
    return F.struct((x * s).alias("x"), (y * s).alias("y"))


def fisheye_project_point(k: list[float], x: Column, y: Column, z: Column, dist=()) -> Column:
    """struct<u,v>; points beside and behind the camera are allowed."""
    r = F.sqrt(x * x + y * y)
    s = F.when(r < 1e-8, F.lit(0.0)).otherwise(F.try_divide(_theta_d(F.atan2(r, z), dist), r))
    a, b = x * s, y * s
    return F.struct((k[0] * a + k[1] * b + k[2]).alias("u"), (k[3] * a + k[4] * b + k[5]).alias("v"))


def fisheye_unproject_pixel(k: list[float], u: Column, v: Column, depth: Column, dist=(), steps: int = 20, tolerance: float = 1e-8) -> Column:
    """struct<x,y,z> at a Euclidean range."""
    m = _inverse3(k)
    a, b = (m[3 * i] * u + m[3 * i + 1] * v + m[3 * i + 2] for i in range(2))
    rd = F.sqrt(a * a + b * b)
    theta = _theta_from(rd, dist, steps, tolerance)
    s = F.when(rd < 1e-8, F.lit(0.0)).otherwise(F.try_divide(F.sin(theta), rd))
    return F.struct((a * s * depth).alias("x"), (b * s * depth).alias("y"), (F.when(rd < 1e-8, F.lit(1.0)).otherwise(F.cos(theta)) * depth).alias("z"))


def rolling_shutter_row_time(row: Column, image_height: int, readout_time: float) -> Column:
    _need(image_height > 1, "an image of two rows or more")
    return row / (image_height - 1) * readout_time


def rolling_shutter_correct_point(p: tuple[Column, Column, Column], velocity, rate, row_time: Column) -> Column:
    """struct<x,y,z>: the point less what the camera's own motion did to it until its row was read."""
    x, y, z = p
    (vx, vy, vz), (wx, wy, wz) = map(float, velocity), map(float, rate)
    return F.struct(
        (x - row_time * (vx + wy * z - wz * y)).alias("x"),
        (y - row_time * (vy + wz * x - wx * z)).alias("y"),
        (z - row_time * (vz + wx * y - wy * x)).alias("z"),
    )


def rolling_shutter_project_point(k: list[float], p, velocity, rate, image_height: int, readout_time: float, dist=(), steps: int = 10, tolerance: float = 1e-6) -> Column:
    """struct<u,v>: the row a point falls on depends on when the row is read, so its row is a fixed point.

    The steps run in Arrow batches, over the points of a batch that are not done yet.
    """
    _need(image_height > 1, "an image of two rows or more")
    (vx, vy, vz), (wx, wy, wz) = map(float, velocity), map(float, rate)
    k1, k2, p1, p2, k3 = [*map(float, dist), 0.0, 0.0, 0.0, 0.0, 0.0][:5]
    last = float(image_height - 1)

    @F.pandas_udf("u double, v double")
    def run(x: pd.Series, y: pd.Series, z: pd.Series) -> pd.DataFrame:
        p = np.stack([c.to_numpy(float) for c in (x, y, z)])

        def image(row: np.ndarray, x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
            s = row / last * readout_time
            q = z - s * (vz + wx * y - wy * x)
            a, b = (x - s * (vx + wy * z - wz * y)) / q, (y - s * (vy + wz * x - wx * z)) / q
            r2 = a * a + b * b
            radial = 1 + k1 * r2 + k2 * r2 * r2 + k3 * r2 * r2 * r2
            a, b = a * radial + (2 * p1 * a * b + p2 * (r2 + 2 * a * a)), b * radial + (p1 * (r2 + 2 * b * b) + 2 * p2 * a * b)
            return np.stack((k[0] * a + k[1] * b + k[2], k[3] * a + k[4] * b + k[5]))

        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            out = image(np.zeros(p.shape[1]), *p)
            live = np.arange(p.shape[1])
            for _ in range(steps):
                got = image(np.clip(out[1, live], 0.0, last), *p[:, live])
                more = ~(np.abs(got[1] - out[1, live]) < tolerance)
                out[:, live] = got
                live = live[more]
                if not len(live):
                    break
        return pd.DataFrame({"u": out[0], "v": out[1]})

    # a null coordinate is behind the camera as well
    there = (p[2] > 0) & p[0].isNotNull() & p[1].isNotNull() if all(isinstance(c, Column) for c in p) else F.lit(p[2]) > 0
    return F.when(there, run(*[(c if isinstance(c, Column) else F.lit(c)).cast("double") for c in p]))


def in_image(k: list[float], x: Column, y: Column, z: Column, width: int, height: int) -> Column:
    """struct<u,v,valid> of a point in camera coordinates; points behind the camera or outside the image get (0, 0, false)."""
    zz = F.when(z > 0, z)
    uv = project_point(k, x, y, zz)
    ok = F.coalesce((uv.u >= 0) & (uv.u < width) & (uv.v >= 0) & (uv.v < height), F.lit(False))
    return F.struct(F.when(ok, uv.u).otherwise(F.lit(0.0)).alias("u"), F.when(ok, uv.v).otherwise(F.lit(0.0)).alias("v"), ok.alias("valid"))
