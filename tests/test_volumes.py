"""Signed distance volumes."""

import math

import numpy as np

from tessera.operators import grids

SCHEMA = "frame int, x double, y double, z double, ox double, oy double, oz double"


def brute(rows, size, truncation):
    sums = {}
    for f, *p in rows:
        if any(v is None or not math.isfinite(v) for v in p):
            continue
        q, o = np.array(p[:3]), np.array(p[3:])
        depth = math.dist(q, o)
        low, high = np.maximum(0, np.floor((q - truncation) / size)).astype(int), np.ceil((q + truncation) / size).astype(int)
        for i in np.ndindex(*np.maximum(high - low + 1, 0)):
            v = low + i
            s = depth - (((v + 0.5) * size - o) * (q - o)).sum() / depth if depth > 1e-9 else math.inf
            if abs(s) <= truncation:
                sums.setdefault((f, *v.tolist()), []).append(min(1.0, max(-1.0, s / truncation)))
    return {k: (np.mean(v), float(len(v))) for k, v in sums.items()}


def test_points_are_dealt_and_voxels_are_not(spark):
    """Points around the borders of blocks, at the sensor, outside and damaged; a frame's voxels are made after its points are dealt."""
    rng = np.random.default_rng(3)
    rows = [(int(f), *map(float, p), 1.0, 2.0, 50.0) for f, p in zip(rng.integers(0, 3, 120), rng.uniform(28, 36, (120, 3)).round(2), strict=True)]
    rows += [(0, 1.0, 2.0, 50.0, 1.0, 2.0, 50.0), (1, -90.0, 3.0, 3.0, 1.0, 2.0, 50.0), (1, 0.2, 0.1, 3.0, 1.0, 2.0, 50.0), (2, None, 3.0, 3.0, 1.0, 2.0, 50.0)]
    rows += [(2, float(v), 3.0, 3.0, 1.0, 2.0, 50.0) for v in ("nan", "inf", "-inf")] + [(None, 31.9, 32.0, 32.1, 1.0, 2.0, 50.0)]
    points = spark.createDataFrame(rows, SCHEMA)
    for by in (("frame",), ()):
        got = grids.tsdf(points, 1.0, 1.5, by=by)
        want = brute(rows if by else [(0, *r[1:]) for r in rows], 1.0, 1.5)
        found = {(r.frame if by else 0, r.ix, r.iy, r.iz): (r.tsdf, r.weight) for r in got.collect()}
        assert found.keys() == want.keys() and got.columns == [*by, "ix", "iy", "iz", "tsdf", "weight"]
        assert all(abs(found[k][0] - v[0]) < 1e-12 and found[k][1] == v[1] for k, v in want.items())
    dealt = grids.tsdf(points, 1.0, 1.5, by=("frame",))._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in dealt.split("Initial Plan")[-1].splitlines() if "Exchange" in line]
    assert len(exchanges) == 1 and "_bx" in exchanges[0] and "ix#" not in exchanges[0]
