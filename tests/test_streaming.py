"""Stateful operators in batch and as streams."""

import numpy as np
import pytest

from tessera.errors import SensorError
from tessera.streaming import ekf, gps, windows


def test_filter():
    f, s = ekf.Filter(), ekf.State()
    for _ in range(10):
        s = f.predict(s, [0, 0, 9.81], [0, 0, 0], 0.1)
    assert np.allclose(s.p, 0, atol=1e-9)
    before = np.trace(s.cov)
    s = f.position(s, [1, 0, 0], 0.1)
    assert 0 < s.p[0] <= 1 and np.trace(s.cov) < before and np.allclose(s.cov, s.cov.T)
    s = f.velocity(s, [0, 0, 0], 0.1)
    s = f.pose(s, [1, 0, 0], [1, 0, 0, 0], 0.1, 0.1)
    with pytest.raises(SensorError):
        f.predict(s, [0, 0, 0], [0, 0, 0], 0.0)


def test_outage_never_recovers_unless_asked(spark):
    d = spark.createDataFrame([(t, "a") for t in (0.0, 1.0, 10.0, 11.0)], "t double, car string")
    used = lambda **k: [r.used for r in gps.outage_gate(d, 5.0, by=("car",), **k).orderBy("t").collect()]
    assert used() == [True, True, False, False]
    assert used(recover=True) == [True, True, False, True]


def test_fixes_into_poses(spark):
    p = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0)], "seq long, timestamp double, x double, y double, z double, qw double, qx double, qy double, qz double")
    f = spark.createDataFrame([(0.05, 1.0, 2.0, 3.0), (9.0, 4.0, 5.0, 6.0)], "t double, x double, y double, z double")
    got = {r.timestamp: (r.x, r.y, r.z) for r in gps.fuse_into_sequence(p, f, 0.1).collect()}
    assert got == {0.0: (1.0, 2.0, 3.0), 9.0: (4.0, 5.0, 6.0)}


def test_windows_over_a_stream(spark, tmp_path, data):
    e = spark.read.parquet(f"{data}/events.parquet").selectExpr("event_type AS stream", "CAST(ts AS timestamp) AS ts", "value AS v")
    e.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = windows.tumbling(s, "1 hour", "10 minutes").writeStream.format("memory").queryName("hours").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("hours").count() > 0


def test_filter_over_a_stream(spark, tmp_path):
    rows = [("a", float(t), "imu" if t % 2 else "position", [0.0, 0.0, 9.81] if t % 2 else [0.0, 0.0, 0.0], [0.0, 0.0, 0.0]) for t in range(1, 20)]
    d = spark.createDataFrame(rows, "vehicle string, t double, kind string, a array<double>, b array<double>").selectExpr("*", "timestamp_seconds(t) AS ts")
    d.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
    q = ekf.track_stream(s, watermark="1 second").writeStream.format("memory").queryName("track").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("track").count() > 0


def test_a_fleet_steps_as_its_trackers(spark):
    """All kinds of rows, vehicles of different lengths and a null one, in few steps of many vehicles."""
    rng, rows = np.random.default_rng(9), []
    for v, n in ((1, 30), (2, 1), (3, 12), (None, 9)):
        for k in range(n):
            q = rng.normal(0, 0.05, 4) + [1.0, 0, 0, 0]
            kind = ("imu", "position", "velocity", "pose", "fix", "imu")[int(rng.integers(6))]
            rows.append((v, k * 0.1 + (50 if k > 20 else 0), kind, rng.normal(0, 1, 3).tolist(), (q if kind == "pose" else rng.normal(0, 0.2, 3)).tolist()))
    got = {(r.vehicle, r.t): [r.x, r.y, r.z, r.qw, r.qx, r.qy, r.qz] for r in ekf.track(spark.createDataFrame(rows, "vehicle int, t double, kind string, a array<double>, b array<double>"), max_fix_age=5.0).collect()}
    trackers = {}
    assert len(got) == len(rows)
    for v, t, kind, a, b in rows:
        s = trackers.setdefault(v, ekf.Tracker(max_fix_age=5.0)).step(kind, t, np.array(a), np.array(b))
        assert np.allclose(got[v, t], [*s.p, *s.q], atol=1e-9)
    calls, fleet = [], ekf.Fleet()
    fleet.grow(500)
    fleet._predict, update = None, fleet._update
    fleet._update = lambda *row: calls.append(1) or update(*row)
    fleet.step(np.arange(500), np.array(["position"] * 500, dtype=object), np.zeros(500), [[1.0, 2.0, 3.0]] * 500, [[0.0] * 3] * 500)
    assert len(calls) == 1
