"""Occupancy grids and truncated signed distance volumes, sparse: a row a cell."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.errors import SensorError


def world_to_cell(x: Column, y: Column, resolution: float, origin=(0.0, 0.0)) -> Column:
    return F.struct(F.floor((x - origin[0]) / resolution).cast("long").alias("col"), F.floor((y - origin[1]) / resolution).cast("long").alias("row"))


def cell_to_world(col: Column, row: Column, resolution: float, origin=(0.0, 0.0)) -> Column:
    return F.struct((origin[0] + (col + 0.5) * resolution).alias("x"), (origin[1] + (row + 0.5) * resolution).alias("y"))


def bresenham(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """array<struct<x,y>>: the cells of a line, both ends included, in closed form."""
    dx, dy = F.abs(x1 - x0), F.abs(y1 - y0)
    sx, sy = F.signum(x1 - x0).cast("long"), F.signum(y1 - y0).cast("long")
    major, minor = F.greatest(dx, dy), F.least(dx, dy)
    side = lambda k: F.floor((k * minor - F.floor(major / 2) + major - 1) / F.greatest(major, F.lit(1))).cast("long")
    cell = lambda k: F.struct((x0 + sx * F.when(dx >= dy, k).otherwise(side(k))).alias("x"), (y0 + sy * F.when(dx >= dy, side(k)).otherwise(k)).alias("y"))
    return F.transform(F.sequence(F.lit(0).cast("long"), major.cast("long")), cell)


def occupancy_updates(scans: DataFrame, resolution: float, width: int, height: int, origin=(0.0, 0.0), z_range=(-1e18, 1e18), hit: float = 0.85, miss: float = -0.4, by: tuple[str, ...] = ()) -> DataFrame:
    """by, col, row, frame, seq, step, delta: a miss for each cell a ray crosses and a hit for its end, within the grid.

    scans: by, frame, seq, x, y, z (in the world) and ox, oy, the sensor's place.
    """
    if resolution <= 0 or width <= 0 or height <= 0:
        raise SensorError("a grid has a positive resolution and size")
    rays = scans.where(F.col("z").between(*map(float, z_range)))
    a, b = world_to_cell(F.col("ox"), F.col("oy"), resolution, origin), world_to_cell(F.col("x"), F.col("y"), resolution, origin)
    rays = rays.select(*by, "frame", "seq", a.alias("a"), b.alias("b"))
    line = bresenham(F.col("a.col"), F.col("a.row"), F.col("b.col"), F.col("b.row"))
    cells = rays.select(*by, "frame", "seq", F.col("b"), F.posexplode(line).alias("step", "c"))
    end = (F.col("c.x") == F.col("b.col")) & (F.col("c.y") == F.col("b.row"))
    out = cells.select(*by, F.col("c.x").alias("col"), F.col("c.y").alias("row"), "frame", "seq", "step", F.when(end, F.lit(hit)).otherwise(F.lit(miss)).alias("delta"))
    return out.where((F.col("col") >= 0) & (F.col("col") < width) & (F.col("row") >= 0) & (F.col("row") < height))


#: Frames that are merged to one triple before the last merge of a cell.
FRAMES_A_BLOCK = 256


def scan_occupancy(scans: DataFrame, resolution: float, width: int, height: int, origin=(0.0, 0.0), z_range=(-1e18, 1e18), hit: float = 0.85, miss: float = -0.4, limit: float = 5.0, by: tuple[str, ...] = ()) -> DataFrame:
    """by, col, row, log_odds of scans: occupancy(occupancy_updates(scans)) without a row for each cell of each ray.

    Clamped addition does not commute, but it composes: a run of updates is x -> clamp(x + a, lo, hi), and n equal ones have such a triple in closed form.
    A frame, one scan of a sensor, is traced and folded in one Arrow batch to a triple a cell; triples are merged in order of blocks of frames, then of a cell.
    frame is a number.
    """
    if resolution <= 0 or width <= 0 or height <= 0:
        raise SensorError("a grid has a positive resolution and size")
    kinds = dict(scans.dtypes)
    fields = scans.select(*by, "frame").schema
    names = [*fields.names, "col", "row", "a", "lo", "hi"]

    def run(t: pa.Table) -> pa.Table:
        seq = t.column("seq")
        order = pc.sort_indices(pa.table([c for c in seq.combine_chunks().flatten()], names=[str(i) for i in range(seq.type.num_fields)]) if pa.types.is_struct(seq.type) else pa.table({"0": seq}), sort_keys=[(str(i), "ascending") for i in range(seq.type.num_fields if pa.types.is_struct(seq.type) else 1)])
        got = {c: t.column(c).take(order).to_numpy().astype(float) for c in ("x", "y", "ox", "oy")}
        cell = lambda c, o: np.floor((got[c] - o) / resolution).astype(np.int64)
        col, row, delta = trace(cell("ox", origin[0]), cell("oy", origin[1]), cell("x", origin[0]), cell("y", origin[1]), width, height, hit, miss)
        place, triple = folded(row * width + col, delta, limit)
        n = len(place)
        head = [pa.array([t.column(c)[0].as_py()] * n, t.schema.field(c).type) for c in fields.names]
        return pa.table([*head, pa.array(place % width), pa.array(place // width), *map(pa.array, triple)], names=names)

    schema = ", ".join([*[f"{c} {kinds[c]}" for c in fields.names], "col long, row long, a double, lo double, hi double"])
    rays = scans.where(F.col("z").between(*map(float, z_range))).select(*by, "frame", "seq", "x", "y", F.col("ox").cast("double").alias("ox"), F.col("oy").cast("double").alias("oy"))
    frames = rays.groupBy(*by, "frame").applyInArrow(run, schema)
    triple = F.struct("a", "lo", "hi")
    blocks = frames.groupBy(*by, "col", "row", F.floor(F.col("frame") / FRAMES_A_BLOCK).alias("_block")).agg(F.array_sort(F.collect_list(F.struct("frame", triple.alias("f")))).alias("fs"))
    blocks = blocks.select(*by, "col", "row", F.struct("_block", _composed(F.col("fs")).alias("f")).alias("b"))
    cells = blocks.groupBy(*by, "col", "row").agg(F.array_sort(F.collect_list("b")).alias("bs")).select(*by, "col", "row", _composed(F.col("bs")).alias("w"))
    return cells.select(*by, "col", "row", F.greatest("w.lo", F.least("w.hi", "w.a")).alias("log_odds"))


def trace(x0, y0, x1, y1, width: int, height: int, hit: float, miss: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """col, row and delta of the cells of all lines within the grid, line by line from its start."""
    dx, dy = np.abs(x1 - x0), np.abs(y1 - y0)
    major, minor = np.maximum(dx, dy), np.minimum(dx, dy)
    n = major + 1
    line = np.repeat(np.arange(len(n)), n)
    k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    side = (k * minor[line] - major[line] // 2 + major[line] - 1) // np.maximum(major[line], 1)
    flat = (dx >= dy)[line]
    col = x0[line] + np.sign(x1 - x0)[line] * np.where(flat, k, side)
    row = y0[line] + np.sign(y1 - y0)[line] * np.where(flat, side, k)
    inside = (col >= 0) & (col < width) & (row >= 0) & (row < height)
    delta = np.where((col == x1[line]) & (row == y1[line]), hit, miss)
    return col[inside], row[inside], delta[inside]


def folded(place: np.ndarray, delta: np.ndarray, limit: float) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The distinct places, and of each the triple (a, lo, hi) of its updates in order, each clamped to [-limit, limit]."""
    order = np.argsort(place, kind="stable")
    place, delta = place[order], delta[order]
    new = np.ones(len(place), bool)
    new[1:] = (place[1:] != place[:-1]) | (delta[1:] != delta[:-1])
    first = np.flatnonzero(new)
    n, d, own = np.diff(np.append(first, len(place))), delta[first], place[first]
    # n equal steps: the first clamps both ends, each later one moves them and clamps again
    a, rest = n * d, (n - 1) * d
    lo, hi = np.clip(-limit + rest, -limit, limit), np.clip(limit + rest, -limit, limit)
    cells, at, size = np.unique(own, return_index=True, return_counts=True)
    out = a[at], lo[at], hi[at]
    for turn in range(1, int(size.max(initial=0))):
        live = np.flatnonzero(size > turn)
        i = at[live] + turn
        for value in out:
            value[live] += a[i]
        for value in out[1:]:
            value[live] = np.clip(value[live], lo[i], hi[i])
    return cells, out


def _composed(ordered: Column) -> Column:
    """One triple of an ordered list of structs with a triple f."""
    clamp = lambda v, lo, hi: F.greatest(lo, F.least(hi, v))
    first = F.struct(F.lit(0.0).alias("a"), F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"))
    step = lambda s, x: F.struct((s.a + x.f.a).alias("a"), clamp(s.lo + x.f.a, x.f.lo, x.f.hi).alias("lo"), clamp(s.hi + x.f.a, x.f.lo, x.f.hi).alias("hi"))
    return F.aggregate(ordered, first, step)


def occupancy(updates: DataFrame, limit: float = 5.0, by: tuple[str, ...] = ()) -> DataFrame:
    """by, col, row, log_odds: updates of any origin in order of (frame, seq, step), each sum clamped to [-limit, limit]. scan_occupancy does scans with less."""
    low, high = F.lit(-float(limit)), F.lit(float(limit))
    steps = F.transform(F.array_sort(F.collect_list(F.struct("seq", "step", "delta"))), lambda u: F.struct(F.struct(u.delta.alias("a"), low.alias("lo"), high.alias("hi")).alias("f")))
    frames = updates.groupBy(*by, "col", "row", "frame").agg(_composed(steps).alias("f"))
    whole = _composed(F.array_sort(F.collect_list(F.struct("frame", "f"))))
    return frames.groupBy(*by, "col", "row").agg(whole.alias("w")).select(*by, "col", "row", F.greatest("w.lo", F.least("w.hi", "w.a")).alias("log_odds"))


def to_ros(log_odds: Column) -> Column:
    """100 occupied, 0 free, -1 unknown."""
    return F.when(log_odds > 0, 100).when(log_odds < 0, 0).otherwise(-1).cast("byte")


def to_probability(log_odds: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-log_odds))


def dense(cells: DataFrame, width: int, height: int) -> DataFrame:
    """Every cell of the grid with its value; -1 where nothing is known."""
    spark = cells.sparkSession
    grid = spark.range(width * height).select((F.col("id") % width).alias("col"), F.floor(F.col("id") / width).cast("long").alias("row"))
    return grid.join(cells.select("col", "row", to_ros(F.col("log_odds")).alias("value")), ["col", "row"], "left").select("col", "row", F.coalesce("value", F.lit(-1)).cast("byte").alias("value"))


def voxel_to_world(i: Column, origin: float, size: float) -> Column:
    return origin + (i + 0.5) * size


def world_to_voxel(v: Column, origin: float, size: float) -> Column:
    return (v - origin) / size


#: Voxels in the side of a block of space that points are dealt by.
VOLUME_SIDE = 32


def tsdf(points: DataFrame, size: float, truncation: float, origin=(0.0, 0.0, 0.0), shape=(1 << 40, 1 << 40, 1 << 40), by: tuple[str, ...] = ()) -> DataFrame:
    """by, ix, iy, iz, tsdf, weight. points: x, y, z in the world and ox, oy, oz, the sensor's place.

    A point updates the voxels in its box of the truncation distance whose centre projects
    onto its ray within that distance of it. The running mean of equal weights is the mean, so the order does not matter and a plain aggregation does it.
    With by, points are dealt by group and block of space, and their voxels, several a point, are made and summed where they arrive; without it sums are made first and dealt then.
    """
    if size <= 0 or truncation <= 0:
        raise SensorError("a voxel and the truncation are positive")
    axes = list(zip(("x", "y", "z"), map(float, origin), shape, strict=True))
    number = lambda c: F.col(c).cast("double")
    d = points.select(*by, *[number(c).alias(f"_{c}") for c, _, _ in axes], *[number(f"o{c}").alias(f"_o{c}") for c, _, _ in axes])
    block = lambda v: F.floor(v / VOLUME_SIDE)
    for c, o, n in axes:  # the ends of the box
        low = F.greatest(F.lit(0), F.floor((F.col(f"_{c}") - truncation - o) / size))
        high = F.least(F.lit(n - 1), F.ceil((F.col(f"_{c}") + truncation - o) / size))
        d = d.where(~F.isnan(f"_{c}") & ~F.isnan(f"_o{c}") & (low <= high))
        if by:
            d = d.withColumn(f"_b{c}", F.explode(F.sequence(block(low), block(high))))
    if by:
        d = d.repartition(*by, *[f"_b{c}" for c, _, _ in axes])
    ray = {c: F.col(f"_{c}") - F.col(f"_o{c}") for c, _, _ in axes}
    d = d.withColumn("_d", F.sqrt(ray["x"] * ray["x"] + ray["y"] * ray["y"] + ray["z"] * ray["z"])).where("_d > 1e-9")
    for c, o, n in axes:
        low = F.greatest(F.lit(0), F.floor((F.col(f"_{c}") - truncation - o) / size))
        high = F.least(F.lit(n - 1), F.ceil((F.col(f"_{c}") + truncation - o) / size))
        if by:
            low, high = F.greatest(low, F.col(f"_b{c}") * VOLUME_SIDE), F.least(high, F.col(f"_b{c}") * VOLUME_SIDE + VOLUME_SIDE - 1)
        d = d.withColumn(f"i{c}", F.explode(F.sequence(low, high)))
    dot = [(voxel_to_world(F.col(f"i{c}"), o, size) - F.col(f"_o{c}")) * ray[c] for c, o, _ in axes]
    sdf = F.col("_d") - (dot[0] + dot[1] + dot[2]) / F.col("_d")
    share = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.col("_s") / truncation))
    near = d.withColumn("_s", sdf).where(F.abs("_s") <= truncation)
    sums = near.groupBy(*by, *[f"_b{c}" for c, _, _ in axes if by], "ix", "iy", "iz").agg(F.avg(share).alias("tsdf"), F.count("*").cast("double").alias("weight"))
    return sums.select(*by, "ix", "iy", "iz", "tsdf", "weight")


def surface(volume: DataFrame, size: float, origin=(0.0, 0.0, 0.0), threshold: float = 0.1) -> DataFrame:
    """x, y, z of the voxels near the surface."""
    if not 0 <= threshold <= 1:
        raise SensorError("a threshold between 0 and 1")
    keep = volume.where((F.col("weight") > 0) & (F.abs(F.col("tsdf")) <= threshold))
    return keep.select(*[c for c in volume.columns if c not in ("ix", "iy", "iz", "tsdf", "weight")], *[voxel_to_world(F.col(f"i{c}"), o, size).alias(c) for c, o in zip(("x", "y", "z"), origin, strict=True)])
