"""Rasters: bird's-eye views, trajectories, overlays. An image is rows of row, col, r, g, b; the last drawn wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.errors import SensorError
from tessera.functions.colour import colour_by_height, jet


def _cell(x: Column, y: Column, resolution: float, origin, height: int) -> tuple[Column, Column]:
    col = F.floor((x - origin[0]) / resolution).cast("long")
    return col, (height - 1 - F.floor((y - origin[1]) / resolution)).cast("long")


def _last(drawn: DataFrame, width: int, height: int, radius: int = 0) -> DataFrame:
    """The last drawn of each pixel, as a square of that radius. The last of each centre is found first, so squares are spread over an image's centres only."""
    inside = drawn.where((F.col("row") >= -radius) & (F.col("row") < height + radius) & (F.col("col") >= -radius) & (F.col("col") < width + radius))
    kind = inside.schema["at"].dataType
    lead = F.col("at")[kind.names[0]] if isinstance(kind, StructType) else F.col("at")
    # the largest leading value of each pixel is a hash aggregation without a sort; few rows have it, and among those the whole order decides
    first = inside.select(F.col("row").alias("_r"), F.col("col").alias("_c"), lead.alias("_l")).groupBy("_r", "_c").agg(F.max("_l").alias("_m"))
    inside = inside.join(first, (F.col("row") == F.col("_r")) & (F.col("col") == F.col("_c")) & lead.eqNullSafe(F.col("_m"))).drop("_r", "_c", "_m")
    newest = lambda d: d.groupBy("row", "col").agg(F.max(F.struct("at", "r", "g", "b")).alias("m"))
    last = newest(inside)
    if radius:
        square = _square(last.select("row", "col", "m.*"), radius)
        last = newest(square.where((F.col("row") >= 0) & (F.col("row") < height) & (F.col("col") >= 0) & (F.col("col") < width)))
    return last.select("row", "col", "m.r", "m.g", "m.b")


def birdseye(points: DataFrame, width: int, height: int, resolution: float = 0.1, origin=(0.0, 0.0), z_range=None) -> DataFrame:
    """row, col, r, g, b: points coloured by height, the last by seq in each pixel. z_range defaults to the points' own."""
    if resolution <= 0:
        raise SensorError("a resolution is positive")
    if z_range is None:
        m = points.agg(F.min("z").alias("lo"), F.max("z").alias("hi")).first()
        z_range = (m.lo or 0.0, m.hi or 0.0)
    col, row = _cell(F.col("x"), F.col("y"), resolution, origin, height)
    c = colour_by_height(F.col("z"), F.lit(float(z_range[0])), F.lit(float(z_range[1])))
    return _last(points.select(row.alias("row"), col.alias("col"), F.col("seq").alias("at"), c.alias("c")).select("row", "col", "at", "c.*"), width, height)


def _square(df: DataFrame, radius: int) -> DataFrame:
    d = F.explode(F.sequence(F.lit(-radius), F.lit(radius)))
    return df.withColumn("_dr", d).withColumn("_dc", d).withColumn("row", F.col("row") + F.col("_dr")).withColumn("col", F.col("col") + F.col("_dc")).drop("_dr", "_dc")


def trajectory(positions: DataFrame, width: int, height: int, resolution: float = 0.1, origin=(0.0, 0.0), colour=(255, 127, 0), dot_radius: int = 2) -> DataFrame:
    """Square dots at positions (x, y)."""
    col, row = _cell(F.col("x"), F.col("y"), resolution, origin, height)
    p = _square(positions.select(row.alias("row"), col.alias("col")).distinct(), dot_radius)
    r, g, b = (F.lit(c).cast("short") for c in colour)
    return _last(p.select("row", "col", F.lit(0).alias("at"), r.alias("r"), g.alias("g"), b.alias("b")), width, height)


def overlay(points: DataFrame, width: int, height: int, radius: int = 2, d_range=None) -> DataFrame:
    """Squares coloured by depth at rounded pixels (u, v, valid, depth, seq); halves go to the even pixel."""
    p = points.where("valid")
    if d_range is None:
        m = p.agg(F.min("depth").alias("lo"), F.max("depth").alias("hi")).first()
        d_range = (m.lo or 0.0, m.hi or 0.0)
    lo, hi = map(float, d_range)
    t = F.lit(0.5) if hi <= lo else (F.col("depth") - lo) / (hi - lo)
    p = p.select(F.rint("v").cast("long").alias("row"), F.rint("u").cast("long").alias("col"), F.col("seq").alias("at"), jet(t).alias("c"))
    return _last(p.select("row", "col", "at", "c.*"), width, height, radius)


def layered(*layers: DataFrame) -> DataFrame:
    """Layers from bottom to top as one image."""
    if not layers:
        raise SensorError("nothing to draw")
    out = None
    for i, layer in enumerate(layers):
        part = layer.withColumn("_z", F.lit(i))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("row", "col").agg(F.max_by(F.struct("r", "g", "b"), "_z").alias("c")).select("row", "col", "c.*")


def colour_points(points: DataFrame, pixels: DataFrame, width: int, height: int) -> DataFrame:
    """points (with u, v, valid) and the r, g, b of their pixel; black where not valid. pixels: row, col, r, g, b, one image, broadcast by Spark if small."""
    clip = lambda c, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.rint(c).cast("int")))
    at = points.withColumn("_row", clip(F.col("v"), height)).withColumn("_col", clip(F.col("u"), width))
    img = pixels.select(F.col("row").alias("_row"), F.col("col").alias("_col"), *[F.col(c).alias(f"_{c}") for c in "rgb"])
    j = at.join(img, ["_row", "_col"], "left")
    return j.select(*points.columns, *[F.when(F.col("valid"), F.col(f"_{c}")).otherwise(F.lit(0)).cast("short").alias(c) for c in "rgb"])


def rviz_markers(poses: DataFrame, frame_id: str = "map", namespace: str = "trajectory", first_id: int = 0, colour=(1.0, 0.5, 0.0, 1.0), scale: float = 0.3) -> DataFrame:
    """One sphere marker a pose (seq from 0, timestamp, x, y, z, qw..qz)."""
    return poses.select(
        F.lit(frame_id).alias("frame_id"), F.lit(namespace).alias("ns"), (F.col("seq") + first_id).alias("id"), F.lit("SPHERE").alias("type"), F.col("timestamp").alias("stamp"),
        F.struct("x", "y", "z").alias("position"), F.struct(F.col("qx").alias("x"), F.col("qy").alias("y"), F.col("qz").alias("z"), F.col("qw").alias("w")).alias("orientation"),
        F.array(*[F.lit(scale)] * 3).alias("scale"), F.array(*map(F.lit, colour)).alias("color"),
    )


def open3d_points(points: DataFrame, colours: bool = False) -> DataFrame:
    """points array<double>, and colours in 0..1 (as bytes they are divided by 255)."""
    cols = [F.array(*[F.col(c).cast("double") for c in "xyz"]).alias("points")]
    if colours:
        cols.append(F.array(*[F.col(c) / 255.0 for c in "rgb"]).alias("colors"))
    return points.select(*cols)
