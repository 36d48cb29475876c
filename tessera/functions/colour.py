"""Colours by height, and radar coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def jet(t: Column) -> Column:
    """struct<r,g,b> of 0..255, truncated: blue, cyan, green, yellow, red at quarters of 0..1."""
    unit = lambda v: (F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)) * 255).cast("int").cast("short")
    return F.struct(unit(4 * t - 2).alias("r"), unit(F.least(4 * t, 4 - 4 * t)).alias("g"), unit(2 - 4 * t).alias("b"))


def colour_by_height(z: Column, lo: Column, hi: Column) -> Column:
    """jet of the height's place between lo and hi; 0.5 where they coincide."""
    t = F.when(hi > lo, F.try_divide(z - lo, hi - lo)).otherwise(F.lit(0.5))
    return jet(t)


def radar_xyz(range_m: Column, azimuth_deg: Column, elevation_deg: Column) -> Column:
    """struct<x,y,z> of float, as the detections' own type is."""
    a, e, r = F.radians(azimuth_deg), F.radians(elevation_deg), range_m
    return F.struct((r * F.cos(e) * F.cos(a)).cast("float").alias("x"), (r * F.cos(e) * F.sin(a)).cast("float").alias("y"), (r * F.sin(e)).cast("float").alias("z"))
