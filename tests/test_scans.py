"""Ordered work on long groups, against plain loops, over one partition and many."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import kernels
from tessera.operators import odometry, scans, sync
from tessera.plans.session import Session
from tests.test_definitions import chain

RNG = np.random.default_rng(7)


def poses(n, size=4):
    if size == 4:
        return [kernels.rigid(kernels.exp_so3(v[:3]), v[3:]) for v in RNG.normal(size=(n, 6))]
    return list(RNG.normal(size=(n, size, size)) / size)


def table(spark, groups):
    """group, seq, m of lists of matrices, in no order, with a null key, an extra column and one null matrix a group."""
    rows = [(g, i, None if m is None else m.ravel().tolist(), f"{g}-{i}") for g, ms in groups.items() for i, m in enumerate(ms)]
    RNG.shuffle(rows)
    return spark.createDataFrame([(None if g is None else int(g), int(i), m, x) for g, i, m, x in rows], "g int, seq long, m array<double>, product_of string").withColumn("a.b", F.lit(1))


@pytest.mark.parametrize("parts", [1, 7, 64])
@pytest.mark.parametrize(("size", "left"), [(4, False), (4, True), (2, False), (5, True)])
def test_prefix_products_equal_the_fold(spark, parts, size, left):
    groups = {1: poses(300, size), 2: poses(1, size), 3: [None, *poses(5, size)], None: poses(40, size)}
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        frame = table(spark, groups)
        got = {(r.g, r.seq): np.reshape(r.product, (size, size)) for r in scans.prefix_products(frame, "m", ("g",), size=size, left=left).collect()}
        whole = {r.g: (np.reshape(r.product, (size, size)), r.n) for r in scans.products(frame, "m", ("g",), size=size, left=left).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == sum(map(len, groups.values()))
    for g, ms in groups.items():
        want = np.eye(size)
        for i, m in enumerate(ms):
            m = np.eye(size) if m is None else m
            want = m @ want if left else want @ m
            assert np.allclose(got[g, i], want, rtol=1e-9, atol=1e-9)
        assert whole[g][1] == len(ms) and np.allclose(whole[g][0], want, rtol=1e-9, atol=1e-9)


def test_products_without_a_group_or_rows(spark):
    frame = table(spark, {1: poses(50)})
    one = scans.products(frame.repartition(5), "m").first()
    assert np.allclose(np.reshape(one.product, (4, 4)), np.linalg.multi_dot([np.reshape(r.m, (4, 4)) for r in frame.orderBy("seq").collect()]))
    assert scans.prefix_products(frame.limit(0), "m").count() == 0 == scans.products(frame.limit(0), "m", ("g",)).count()


def test_row_numbers_and_rows_before(spark):
    frame = table(spark, {1: poses(70), 2: poses(1), None: poses(30)}).select("g", "seq", "`a.b`").repartition(9)
    got = scans.number_rows(frame, "g", "seq").orderBy("number").collect()
    assert [r.number for r in got] == list(range(101)) and [(r.g, r.seq) for r in got] == [(None, i) for i in range(30)] + [(1, i) for i in range(70)] + [(2, 0)]
    before = scans.previous(frame, ("seq",), ("g",), ("seq",)).collect()
    assert len(before) == 101 and all((r.before is None) == (r.seq == 0) and (r.seq == 0 or r.before.seq == r.seq - 1) for r in before)


def test_long_interval_over_many_partitions(spark):
    """An interval of thousands of samples equals the kernel's loop; one sample, or times that stand still, give no row."""
    n = 3000
    t, a, w = np.cumsum(RNG.uniform(0.001, 0.01, n)), RNG.normal(size=(n, 3)), RNG.normal(size=(n, 3))
    rows = [(1, float(t[i]), *map(float, a[i]), *map(float, w[i])) for i in range(n)] + [(2, 0.0, *[1.0] * 6), (3, 0.0, *[1.0] * 6), (3, 0.0, *[1.0] * 6)]
    imu = spark.createDataFrame(rows, "interval int, t double, ax double, ay double, az double, wx double, wy double, wz double").repartition(11)
    (got,) = odometry.preintegrate(imu, (0.1, 0, 0), (0, 0.2, 0)).collect()
    r, v, p = kernels.preintegrate(t, a - [0.1, 0, 0], w - [0, 0.2, 0])
    assert got.interval == 1 and got.n == n and got.duration == pytest.approx(t[-1] - t[0])
    assert np.allclose(np.reshape(got.rotation, (3, 3)), r, atol=1e-9) and np.allclose(got.velocity, v, atol=1e-9) and np.allclose(got.position, p, atol=1e-9)
    assert np.allclose(kernels.quat_to_matrix(np.array(got.quaternion)), r, atol=1e-9)


def plain_keyframes(rows, distance):
    out, last = {}, {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])):
        was = last.get(r[0])
        ok = was is None or abs(r[2] - was) >= distance
        out.setdefault((r[0], r[1], r[2]), []).append(ok)
        if ok:
            last[r[0]] = r[2]
    return {k: sorted(v) for k, v in out.items()}


def test_keyframes_keep_every_row(spark):
    """Ties of order, repeated rows, null keys and columns of clashing names."""
    rows = [(1, 0, 0.0), (1, 0, 0.0), (1, 1, 5.0), (1, 1, 5.0), (1, 1, 11.0), (1, 2, 12.0), (None, 0, 3.0), (None, 1, 20.0), (2, 0, 1.0)] + [(3, i, float(i % 17)) for i in range(400)]
    frame = spark.createDataFrame(rows, "car int, seq long, x double").withColumns({"y": F.lit(0.0), "z": F.lit(0.0), "a.b": F.lit("kept"), "last": F.lit(1)}).repartition(5)
    got = {}
    for r in odometry.keyframes(frame, 10.0, ("car",)).collect():
        assert r["a.b"] == "kept"
        got.setdefault((r.car, r.seq, r.x), []).append(r.accepted)
    assert {k: sorted(v) for k, v in got.items()} == plain_keyframes(rows, 10.0)
    assert odometry.keyframes(frame.limit(0), 10.0, ("car",)).count() == 0


def test_threshold_of_a_long_group(spark):
    values = RNG.uniform(0, 5, 500)
    frame = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(values)] + [(None, 0, 1.0), (None, 1, None), (None, 2, 1.0)], "g int, seq long, r double").repartition(6)
    got = {(r.g, r.seq): r for r in odometry.adaptive_threshold(frame, ("g",), "seq", "r", 2.0, 0.9, 1.0, 9.0).collect()}
    sigma = 2.0
    for i, v in enumerate(values):
        sigma = 0.9 * sigma + 0.1 * v
        assert got[1, i].sigma == pytest.approx(sigma, rel=1e-12) and got[1, i].threshold == pytest.approx(min(9.0, max(1.0, 3 * sigma)))
    assert got[None, 0].sigma == pytest.approx(1.9) and np.isnan(got[None, 1].sigma) and np.isnan(got[None, 2].threshold)


def test_pose_lookup_keeps_repeated_queries(spark):
    p = spark.createDataFrame([(0, 0.0, 1.0), (1, 10.0, 2.0)], "seq int, timestamp double, x double")
    q = spark.createDataFrame([(1.0, "a"), (1.0, "a"), (1.0, "b"), (12.0, "a"), (99.0, "a"), (None, "a"), (None, "a")], "t double, name string").withColumn("a.b", F.lit(0))
    got = sorted(((r.t, r.name, r.pose and r.pose.x) for r in sync.pose_at(p, q, 5.0).collect()), key=str)
    assert got == sorted([(1.0, "a", 1.0), (1.0, "a", 1.0), (1.0, "b", 1.0), (12.0, "a", 2.0), (99.0, "a", None), (None, "a", None), (None, "a", None)], key=str)


def test_scans_of_several_files(spark):
    """Two files whose messages have the same offsets are two scans each, in order of file and offset."""
    clouds = chain()
    rows = [(f"/{f}", 10 * i, "/lidar/points", float(2 * f + i), json.dumps({"xyz": clouds[2 * f + i].tolist()})) for f in range(2) for i in range(2)]
    imu = [(f"/{f}", 10 * i + 5, "/imu", float(2 * f + i) + k / 10, json.dumps({"accel": [0, 0, 0], "gyro": [0, 0, 0]})) for f in range(2) for i in range(2) for k in range(1)]
    bag = spark.createDataFrame(rows + imu, "path string, offset long, topic string, timestamp double, data string").repartition(4)
    got = Session(spark).scans_of(bag, "/lidar/points", "xyz").toPandas()
    assert len(got) == sum(map(len, clouds[:4])) and sorted(got.frame.unique()) == [0, 1, 2, 3]
    for f in range(4):
        one = got[got.frame == f].sort_values("seq")
        assert set(one.timestamp) == {float(f)} and np.allclose(one[["x", "y", "z"]].to_numpy(), clouds[f])
    s = Session(spark).run(bag, imu_topic="/imu")
    assert s.tables["nodes"].count() == 4 and {(r.a, r.b) for r in s.tables["edges"].collect()} >= {(0, 1), (1, 2), (2, 3)}
