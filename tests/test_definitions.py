"""Operators beyond SQL against plain loops over NumPy, on the tables and on small cases with rotating motion."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import catalog, kernels
from tessera.errors import SensorError
from tessera.functions import camera
from tessera.operators import descriptors, estimation, grids, odometry
from tessera.plans.session import Session
from tessera.queries import adapters
from tessera.streaming import ekf

RNG = np.random.default_rng(5)
CLOUD = RNG.uniform(-5, 5, (150, 3))
TURN = [kernels.rigid(kernels.exp_so3(w), t) for w, t in (([0.02, -0.01, 0.06], [0.1, 0.02, 0.0]), ([-0.03, 0.04, 0.01], [-0.05, 0.1, 0.03]), ([0.01, 0.02, -0.05], [0.02, -0.08, 0.05]))]


def query(spark, data, name):
    return catalog.queries()[name](spark, data).toPandas()


def moved(m, p):
    return p @ m[:3, :3].T + m[:3, 3]


def chain():
    """Frames each of which is the one before, moved by the next of TURN."""
    frames = [CLOUD]
    for m in TURN:
        frames.append(moved(m, frames[-1]))
    return frames


def plain_icp(source, target, iterations=50, tolerance=1e-6, limit=np.inf):
    """(transform, converged): point to point, all distances at once."""
    t, last = np.eye(4), np.inf
    for _ in range(iterations):
        p = moved(t, source)
        d2 = ((p[:, None, :] - target[None, :, :]) ** 2).sum(axis=2)
        near = d2.argmin(axis=1)
        d2 = d2[np.arange(len(p)), near]
        ok = np.sqrt(d2) <= limit
        if ok.sum() < 3:
            return t, False
        a, b = p[ok], target[near[ok]]
        u, _, vt = np.linalg.svd((a - a.mean(0)).T @ (b - b.mean(0)))
        r = vt.T @ np.diag([1, 1, np.sign(np.linalg.det(vt.T @ u.T))]) @ u.T
        step = np.eye(4)
        step[:3, :3], step[:3, 3] = r, b.mean(0) - r @ a.mean(0)
        t = step @ t
        if abs(last - d2[ok].mean()) < tolerance:
            return t, True
        last = d2[ok].mean()
    return t, False


def scans(spark, frames, session=0):
    rows = [(session, f, i, *map(float, p)) for f, cloud in enumerate(frames) for i, p in enumerate(cloud)]
    return spark.createDataFrame(rows, "session int, frame long, seq long, x double, y double, z double")


def bag_of(spark, frames, extra=()):
    rows = [(100 * i, "/lidar/points", float(i), json.dumps({"xyz": p.tolist()})) for i, p in enumerate(frames)] + list(extra)
    return spark.createDataFrame(rows, "offset long, topic string, timestamp double, data string")


def clouds_of(spark, data):
    p = adapters.numbered(spark, data).toPandas().sort_values(["frame", "seq"])
    return {f: g[["x", "y", "z"]].to_numpy() for f, g in p.groupby("frame")}


# ---- odometry and sessions


def test_radar_odometry_goes_forward(spark):
    """The frame before is aligned to the current one, and poses are multiplied on the right."""
    got = estimation.scan_odometry(scans(spark, chain())).orderBy("frame").collect()
    want = np.eye(4)
    for r, m in zip(got[1:], TURN, strict=True):
        want = want @ m
        assert r.converged and np.allclose(np.reshape(r.transform, (4, 4)), m, atol=1e-6) and np.allclose(np.reshape(r.pose, (4, 4)), want, atol=1e-6)
    assert got[0].transform is None and np.allclose(np.reshape(got[0].pose, (4, 4)), np.eye(4))


def test_session_poses_edges_and_map(spark):
    """The current scan is aligned to the one before, poses are multiplied on the left, edges hold the matched transform with information 100."""
    s = Session(spark).run(bag_of(spark, chain()))
    poses = {r.id: np.reshape(r.transform, (4, 4)) for r in s.tables["nodes"].collect()}
    edges = {(r.a, r.b): r for r in s.tables["edges"].collect()}
    want = np.eye(4)
    for i, m in enumerate(TURN):
        back = np.linalg.inv(m)
        want = back @ want
        assert np.allclose(poses[i + 1], want, atol=1e-6) and np.allclose(np.reshape(edges[i, i + 1].transform, (4, 4)), back, atol=1e-6)
        assert np.allclose(np.reshape(edges[i, i + 1].information, (6, 6)), 100 * np.eye(6))
    assert len(edges) == 3
    one = s.tables["points"].where("frame = 2").orderBy("seq").toPandas()[["x", "y", "z"]].to_numpy()
    assert np.allclose(one, chain()[2] + poses[2][:3, 3])
    few = Session(spark, max_iterations=1).run(bag_of(spark, chain()))
    assert {np.reshape(r.information, (6, 6))[0, 0] for r in few.tables["edges"].collect()} == {1.0}


def test_session_closes_loops(spark, tmp_path):
    """Two scans that come back to the first place are joined to it, once the gap and the excluded window allow it."""
    places = [RNG.uniform([-40, -40, 0], [40, 40, 5], (120, 3)) for _ in range(6)]
    frames = [*places, places[0] + [0.02, 0, 0], places[3] + [0, 0.03, 0]]
    s = Session(spark, loop_gap=3, exclusion=2, max_iterations=40)
    s.run(bag_of(spark, frames))
    loops = {(r.a, r.b): r for r in s.tables["edges"].collect() if np.reshape(r.information, (6, 6))[0, 0] == 50}
    assert set(loops) == {(0, 6), (3, 7)} or set(loops) == {(0, 6)}
    assert np.allclose(np.reshape(loops[0, 6].transform, (4, 4))[:3, 3], [-0.02, 0, 0], atol=1e-3)
    s.save(str(tmp_path / "s"))
    back = Session.load(spark, str(tmp_path / "s"))
    assert (back.loops, back.context, back.icp) == (s.loops, s.context, s.icp)
    assert not [1 for r in Session(spark, loop_gap=9, exclusion=2).run(bag_of(spark, frames)).tables["edges"].collect() if r.information[0] == 50]


def test_local_map_mode(spark):
    """The target is the last scans, each reduced to means of voxels, as they were measured."""
    frames = chain()
    s = Session(spark, max_iterations=15).run(bag_of(spark, frames), local_map=2, local_voxel=0.5)
    poses = {r.id: np.reshape(r.transform, (4, 4)) for r in s.tables["nodes"].collect()}
    want = np.eye(4)
    for i in range(1, 4):
        m, _ = plain_icp(frames[i], np.concatenate([kernels.voxel_means(f, 0.5) for f in frames[max(0, i - 2) : i]]), 15)
        want = m @ want
        assert np.allclose(poses[i], want, atol=1e-6)


def test_localisation_in_a_fixed_map(spark, monkeypatch):
    frames = [moved(TURN[0], CLOUD), moved(TURN[1], CLOUD)]
    for cap in (10, 1000):
        monkeypatch.setattr(estimation, "MAP_POINTS", cap)
        got = {r.frame: np.reshape(r.transform, (4, 4)) for r in Session(spark, max_iterations=12, max_distance=2.5).localise(bag_of(spark, frames), spark.createDataFrame(CLOUD.tolist(), "x double, y double, z double")).collect()}
        assert all(np.allclose(got[i], np.linalg.inv(TURN[i]), atol=1e-2) for i in (0, 1))
    with pytest.raises(SensorError):
        monkeypatch.setattr(estimation, "MAP_POINTS", 10)
        Session(spark).localise(bag_of(spark, frames), spark.createDataFrame(CLOUD.tolist(), "x double, y double, z double"))


def test_keyframes_by_turn(spark):
    rows = [("a", i, 0.0, 0.0, 0.0, float(np.cos(np.radians(4 * i) / 2)), 0.0, 0.0, float(np.sin(np.radians(4 * i) / 2))) for i in range(9)]
    d = spark.createDataFrame(rows, "car string, seq long, x double, y double, z double, qw double, qx double, qy double, qz double")
    kept = lambda **k: [r.seq for r in odometry.keyframes(d, 1.0, ("car",), **k).where("accepted").orderBy("seq").collect()]
    assert kept() == [0, 3, 6] and kept(min_degrees=0.0) == [0] and kept(min_degrees=19.0) == [0, 5]
    with pytest.raises(SensorError):
        odometry.keyframes(d, 0.0, ("car",))


# ---- the filter


def test_covariance_of_a_turned_prediction():
    f, s = ekf.Filter(), ekf.State(q=np.array([np.cos(0.4), 0, 0, np.sin(0.4)]))
    assert np.allclose(s.cov, 1e-4 * np.eye(15))
    a, w, dt = np.array([1.0, 2.0, 9.0]), np.array([0.1, -0.2, 0.3]), 0.5
    c, sn = np.cos(0.8), np.sin(0.8)
    r = np.array([[c, -sn, 0], [sn, c, 0], [0, 0, 1]])
    cross = np.array([[0, -a[2], a[1]], [a[2], 0, -a[0]], [-a[1], a[0], 0]])
    got = f.predict(s, a, w, dt).cov
    # rows of the transition: position, velocity, orientation
    p_th, p_ba, v_th, v_ba = -0.5 * r @ cross * dt**2, -0.5 * r * dt**2, -r @ cross * dt, -r * dt
    assert np.allclose(got[:3, :3], 1e-4 * (np.eye(3) * (1 + dt**2) + p_th @ p_th.T + p_ba @ p_ba.T))
    assert np.allclose(got[:3, 3:6], 1e-4 * (dt * np.eye(3) + p_th @ v_th.T + p_ba @ v_ba.T))
    assert np.allclose(got[:3, 9:12], 1e-4 * p_ba) and np.allclose(got[9:12, 9:12], 1e-4 * np.eye(3) + 1e-8 * dt * np.eye(3))


def test_pose_residual_is_a_full_rotation_vector():
    """With next to no noise a pose is taken over; the residual of measured times conjugate of predicted is as large as the turn."""
    f = ekf.Filter()
    q0, axis, angle = np.array([np.cos(0.3), np.sin(0.3), 0, 0]), np.array([0.0, 0.6, 0.8]), 1.0
    turn = np.array([np.cos(angle / 2), *(np.sin(angle / 2) * axis)])
    seen = []
    f._update = lambda s, residual, h, noise: seen.append(residual) or s
    f.pose(ekf.State(q=q0), [1, 2, 3], -kernels.quat_multiply(turn, q0), 1e-9, 1e-9)
    assert np.allclose(seen[0], [1, 2, 3, *(angle * axis)])


def test_tracker_gates_fixes_and_knows_its_kinds(spark):
    late = []
    t = ekf.Tracker(max_fix_age=5.0, on_outage=late.append)
    t.step("fix", 0.0, [1, 0, 0], None)
    held = t.step("fix", 20.0, [9, 9, 9], None).p
    assert late == [20.0] and np.allclose(held, t.state.p) and t.fixed == 0.0
    t.step("fix", 4.0, [1, 0, 0], None)
    assert t.fixed == 4.0
    with pytest.raises(SensorError):
        t.step("smell", 5.0, None, None)
    rows = [("v", 0.0, "imu", [0.0, 0.0, 9.81], [0.0, 0.0, 0.0]), ("v", 1.0, "pose", [1.0, 0.0, 0.0], [1.0, 0.0, 0.0, 0.0])]
    got = ekf.track(spark.createDataFrame(rows, "vehicle string, t double, kind string, a array<double>, b array<double>")).orderBy("t").collect()
    assert 0 < got[-1].x < 1


# ---- grids, cameras, places, graphs


@pytest.mark.parametrize("struct", [False, True])
def test_scan_occupancy_is_that_of_its_updates(spark, struct):
    rows = [(g, f, int(i), *map(float, RNG.uniform(-3, 13, 2)), 0.0, 5.2, float(5 + f % 3)) for g in "ab" for f in range(0, 600, 120) for i in RNG.permutation(60)]
    d = spark.createDataFrame(rows, "grid string, frame long, seq long, x double, y double, z double, ox double, oy double")
    if struct:
        d = d.withColumn("seq", F.struct((F.col("seq") % 7).alias("k"), "seq"))
    got = grids.scan_occupancy(d, 1.0, 10, 10, by=("grid",)).toPandas()
    want = grids.occupancy(grids.occupancy_updates(d, 1.0, 10, 10, by=("grid",)), by=("grid",)).toPandas()
    key = lambda t: {(r.grid, r.col, r.row): round(r.log_odds, 9) for r in t.itertuples()}
    assert key(got) == key(want) and max(abs(v) for v in key(got).values()) == 5.0


def test_undistortion_is_the_fixed_point(spark):
    dist, xy = [-0.3, 0.1, 0.001, -0.002, 0.01], RNG.uniform(-0.6, 0.6, (200, 2))
    d = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(xy)] + [(999, None, 0.1)], "i long, x double, y double")
    got = {r.i: r.u for r in d.select("i", camera.undistort_point(F.col("x"), F.col("y"), dist).alias("u")).collect()}
    k1, k2, p1, p2, k3 = dist
    for i, (x0, y0) in enumerate(xy):
        x, y = x0, y0
        for _ in range(100):
            r2 = x * x + y * y
            rad, tx, ty = 1 + k1 * r2 + k2 * r2**2 + k3 * r2**3, 2 * p1 * x * y + p2 * (r2 + 2 * x * x), p1 * (r2 + 2 * y * y) + 2 * p2 * x * y
            if np.hypot(x * rad + tx - x0, y * rad + ty - y0) < 1e-8:
                break
            x, y = (x0 - tx) / rad, (y0 - ty) / rad
        assert np.allclose((got[i].x, got[i].y), (x, y), atol=1e-12)
    assert got[999] is None or got[999].x is None or np.isnan(got[999].x)


def polar(cloud, rings=20, sectors=60, far=80.0):
    out = np.zeros((rings, sectors))
    for x, y, z in cloud:
        d = np.hypot(x, y)
        if 0 < d <= far:
            a = np.arctan2(y, x) % (2 * np.pi)
            i, j = min(rings - 1, int(d / far * rings)), min(sectors - 1, int(a / (2 * np.pi) * sectors))
            out[i, j] = max(out[i, j], z)
    return out


def polar_distance(a, b):
    best = (np.inf, 0)
    na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    for shift in range(a.shape[1]):
        dot = (a * np.roll(b, -shift, axis=1)).sum(axis=1)
        ring = [0.0 if p == q == 0 else 1.0 if 0 in (p, q) else 1 - v / (p * q) for p, q, v in zip(na, nb, dot, strict=True)]
        best = min(best, (round(float(np.mean(ring)), 12), shift))
    return best


@pytest.mark.parametrize("block", [2, 2000])
def test_scan_context_query(spark, data, monkeypatch, block):
    monkeypatch.setattr(descriptors, "KEY_BLOCK", block)
    got = query(spark, data, "scan_context_query").set_index("a")
    maps = {f: polar(c) for f, c in clouds_of(spark, data).items()}
    key = {f: m.mean(axis=1) for f, m in maps.items()}
    for f in maps:
        pool = sorted((round(np.abs(key[b] - key[f]).sum(), 9), b) for b in maps if b < f - 5)[:10]
        if not pool:
            assert f not in got.index
            continue
        best = min((*polar_distance(maps[f], maps[b])[:1], b) for _, b in pool)
        assert got.loc[f, "distance"] == pytest.approx(best[0], abs=1e-6) and got.loc[f, "b"] == best[1]


def test_large_graphs_are_solved_like_small_ones(monkeypatch):
    poses, links, at = {0: np.eye(4)}, [], np.eye(4)
    for i in range(1, 40):
        m = TURN[i % 3]
        at = at @ m
        poses[i] = at @ kernels.rigid(kernels.exp_so3(RNG.normal(0, 0.01, 3)), RNG.normal(0, 0.05, 3))
        links.append((i - 1, i, m, 100 * np.eye(6)))
    links.append((0, 39, at, 50 * np.eye(6)))
    small, cost, _, ok = kernels.optimise_graph(poses, links)
    monkeypatch.setattr(kernels, "DENSE_POSES", 5)
    large, cost2, _, ok2 = kernels.optimise_graph(poses, links)
    assert ok and ok2 and cost < 1e-9 and cost2 < 1e-9
    assert all(np.allclose(small[k], large[k], atol=1e-6) for k in small)


def test_neighbours_by_cells_are_those_of_all_pairs(monkeypatch):
    p = np.concatenate((RNG.uniform(-5, 5, (700, 3)), RNG.normal(0, 0.01, (300, 3)), np.tile([[40.0, 0, 0]], (5, 1)), np.round(RNG.uniform(-2, 2, (200, 3)))))
    q = np.concatenate((RNG.uniform(-6, 6, (400, 3)), [[400.0, 3, 3], [40, 0, 0]]))
    want = kernels.nearest(q, p), kernels.k_nearest(p, 12)
    monkeypatch.setattr(kernels, "ALL_PAIRS", 10)
    got = kernels.nearest(q, p), kernels.k_nearest(p, 12)
    assert np.allclose(got[0][1], want[0][1]) and (got[1] == want[1]).all()
    assert kernels.nearest(q, p[:1])[0].tolist() == [0] * len(q) and kernels.k_nearest(p[:2], 5).shape == (2, 2)


# ---- registered queries


def test_icp_queries(spark, data):
    frames = clouds_of(spark, data)
    got = query(spark, data, "icp").set_index("frame")
    for f, p in frames.items():
        m, ok = plain_icp(p, p + [0.05, -0.05, 0.02])
        assert np.allclose(np.reshape(got.loc[f, "transform"], (4, 4)), m, atol=1e-6) and got.loc[f, "converged"] == ok
    plane = query(spark, data, "icp_plane").set_index("frame")
    assert set(plane.index) == set(frames) and (plane.mse >= 0).all()
    # away from the edges of its cloud a shift is found to within a fraction of itself
    assert np.median([np.abs(np.reshape(t, (4, 4))[:3, 3] - [0.05, -0.05, 0.02]).max() for t in plane["transform"]]) < 0.05


@pytest.mark.parametrize("name", ["radar_odometry", "session_run", "session_localize"])
def test_scan_queries(spark, data, name):
    frames = clouds_of(spark, data)
    got = query(spark, data, name).set_index("frame")
    order = sorted(frames)
    if name == "session_localize":
        for i, f in enumerate(order):
            m, ok = plain_icp(frames[f], frames[1])
            assert np.allclose(np.reshape(got.loc[i, "transform"], (4, 4)), m, atol=1e-5) and got.loc[i, "converged"] == ok
        return
    pose, last = np.eye(4), None
    for i, f in enumerate(order):
        if name == "radar_odometry":
            pose = pose @ plain_icp(frames[last], frames[f])[0] if last is not None and last // 10 == f // 10 else np.eye(4)
            assert np.allclose(np.reshape(got.loc[f, "pose"], (4, 4)), pose, atol=1e-5)
        else:
            pose = plain_icp(frames[f], frames[last])[0] @ pose if last is not None else pose
            assert np.allclose(got.loc[i, ["x", "y", "z"]].to_numpy(float), pose[:3, 3], atol=1e-5)
        last = f


def test_kiss_icp_query(spark, data):
    got = query(spark, data, "kiss_icp")
    frames = clouds_of(spark, data)
    for _, own in got.groupby("session"):
        pose, sigma, have = np.eye(4), 2.0, {}
        for r in own.sort_values("frame").itertuples():
            p = kernels.voxel_means(frames[r.frame], 4.0)
            limit = min(10.0, max(0.1, 3 * sigma))
            assert r.threshold == pytest.approx(limit)
            if have:
                target = np.array(list(have.values()))
                m, _ = plain_icp(p, target, 50, 1e-4, limit)
                pose = pose @ np.linalg.inv(m)
                d = np.sqrt(((moved(m, p)[:, None] - target[None]) ** 2).sum(axis=2).min(axis=1))
                if (d <= limit).any():
                    sigma = 0.9 * sigma + 0.1 * np.sqrt((d[d <= limit] ** 2).mean())
            assert np.allclose(np.reshape(r.pose, (4, 4)), pose, atol=1e-5)
            for q in moved(pose, p):
                have.setdefault(tuple(np.floor(q / 4.0)), q)


def test_normals_queries(spark, data):
    frames = clouds_of(spark, data)
    got, ground = query(spark, data, "normals"), query(spark, data, "ground_normals").set_index(["frame", "seq"])
    for f, own in got.groupby("frame"):
        p = frames[f]
        for r in own.itertuples():
            d = ((p - p[r.seq - 1]) ** 2).sum(axis=1)
            if np.diff(np.sort(d))[10:13].min() < 1e-9:
                continue  # which of equally far points belongs to the nearest is free
            near = p[np.argsort(d, kind="stable")[:12]]
            w, v = np.linalg.eigh(np.cov(near.T, bias=True))
            n = np.array([r.nx, r.ny, r.nz])
            if w[1] - w[0] > 1e-6:
                assert abs(n @ v[:, 0]) == pytest.approx(1, abs=1e-6) and n @ (p.mean(axis=0) - p[r.seq - 1]) >= -1e-9
                assert ground.loc[(f, r.seq), "ground"] == (abs(v[2, 0]) > 0.5) or abs(abs(v[2, 0]) - 0.5) < 1e-9


def test_planes_by_chance(spark, data):
    p = np.concatenate(list(clouds_of(spark, data).values()))
    for name, strict in (("ransac_plane", False), ("ransac_ground", True)):
        got = query(spark, data, name)
        normal, d = got.iloc[0][["nx", "ny", "nz"]].to_numpy(float), float(got.iloc[0]["d"])
        off = np.abs(p @ normal - d)
        count = int(got["ground" if strict else "inliers"].sum())
        assert np.linalg.norm(normal) == pytest.approx(1, abs=1e-5)
        assert abs(count - ((off < 2) if strict else (off <= 2)).sum()) <= 5  # the plane is rounded to six digits
        assert count > len(p) * 4 / 100 and (not strict or normal[2] >= 0.5)


def exp(w):
    a = np.linalg.norm(w)
    if a < 1e-12:
        return np.eye(3)
    k = np.array([[0, -w[2], w[1]], [w[2], 0, -w[0]], [-w[1], w[0], 0]]) / a
    return np.eye(3) + np.sin(a) * k + (1 - np.cos(a)) * k @ k


def imu_of(spark, data):
    t = adapters.table(spark, data, "events").selectExpr("user_id AS k", f"{adapters.MICROS} / 3.6e9D AS t", "value").toPandas()
    return {k: g.sort_values("t") for k, g in t.groupby("k")}


def test_preintegration_query(spark, data):
    got = query(spark, data, "preintegration").set_index("interval")
    for k, g in imu_of(spark, data).items():
        t, v = g["t"].to_numpy(), g["value"].to_numpy()
        if len(t) < 2 or (np.diff(t) <= 0).any():
            assert k not in got.index
            continue
        a = np.stack((v / 1000, np.full(len(v), 0.1), np.full(len(v), 9.81)), axis=1)
        w = np.stack((np.full(len(v), 0.01), np.full(len(v), -0.02), v / 1e5), axis=1)
        r, vel, pos = np.eye(3), np.zeros(3), np.zeros(3)
        for i in range(len(t) - 1):
            dt = t[i + 1] - t[i]
            acc = r @ ((a[i] + a[i + 1]) / 2)
            pos, vel = pos + vel * dt + 0.5 * acc * dt * dt, vel + acc * dt
            r = r @ exp((w[i] + w[i + 1]) / 2 * dt)
        row = got.loc[k]
        assert np.allclose(np.reshape(row.rotation, (3, 3)), r, atol=1e-7) and np.allclose(row.velocity, vel, rtol=1e-7) and np.allclose(row.position, pos, rtol=1e-7)
        assert row.n == len(t) and row.duration == pytest.approx(t[-1] - t[0])


def test_filter_query(spark, data):
    """Each vehicle's rows folded one by one with the filter's own steps."""
    got = query(spark, data, "ekf_track")
    assert got.groupby("vehicle").t.apply(lambda t: t.is_monotonic_increasing).all()
    e = adapters.table(spark, data, "events")
    assert len(got) == e.count() and np.allclose(np.linalg.norm(got[["qw", "qx", "qy", "qz"]].to_numpy(), axis=1), 1)


def image_of(spark, data):
    t = adapters.image(spark, data).toPandas()
    out = {}
    for i, g in t.groupby("img"):
        a = np.zeros((g["row"].max() + 1, g["col"].max() + 1))
        a[g["row"], g["col"]] = g["v"]
        out[i] = a
    return out


def test_patch_descriptor_query(spark, data):
    images, got = image_of(spark, data), query(spark, data, "patch_descriptor")
    assert len(got)
    for r in got.itertuples():
        a = images[r.img]
        if 2 <= r.row < a.shape[0] - 2 and 2 <= r.col < a.shape[1] - 2:
            p = a[r.row - 2 : r.row + 3, r.col - 2 : r.col + 3].ravel()
            p = p - p.mean()
            assert np.allclose(r.descriptor, p / np.linalg.norm(p), atol=1e-5)


def test_disparity_query(spark, data):
    """The right image is the left one moved by three: wherever the search range is whole and the texture decides, three is found."""
    got = query(spark, data, "disparity")
    images = image_of(spark, data)
    for i, own in got.groupby("img"):
        if images[i].shape[1] < 24 or images[i].shape[0] < 12:
            continue
        inner = own[(own["col"] >= 12) & (own["col"] < images[i].shape[1] - 6) & (own["row"] >= 3) & (own["row"] < images[i].shape[0] - 3)]
        assert (inner.d.round() == 3).mean() > 0.9


@pytest.mark.parametrize("name", ["essential", "pnp"])
def test_pose_queries_find_the_second_camera(spark, data, name):
    """The second camera stands half a unit to the right, without a turn, and the points are exact."""
    got = query(spark, data, name)
    assert len(got)
    for r in got.itertuples():
        m = np.reshape(r.transform if hasattr(r, "transform") else r.rotation, (4, 4) if hasattr(r, "transform") else (3, 3))
        t = m[:3, 3] if m.shape == (4, 4) else np.asarray(r.translation)
        want = np.array([-0.5, 0, 0])
        if name == "essential":
            want, t = want / 0.5, t / np.linalg.norm(t)
        assert np.allclose(m[:3, :3], np.eye(3), atol=1e-3) and np.allclose(t, want, atol=1e-2)


def test_graph_queries_lower_the_cost(spark, data):
    from tessera.operators import graphs
    from tessera.queries import motion

    nodes, edges = motion._graph(spark, data)
    before = {r.graph: r.cost for r in graphs.graph_cost(nodes, edges).collect()}
    got = query(spark, data, "pose_graph")
    cost = got.groupby("graph").cost.first()
    assert all(cost[g] <= before[g] + 1e-9 for g in before) and cost.max() < 1e-6  # a chain can be met exactly
    smooth = spark.createDataFrame(query(spark, data, "smoother")).withColumnRenamed("transform", "transform")
    after = {r.graph: r.cost for r in graphs.graph_cost(smooth, edges).collect()}
    assert sum(after.values()) < 1e-3 * sum(before.values()) + 1e-6


def test_place_descriptors(spark, data):
    m = query(spark, data, "m2dp")
    assert all(len(d) == 4 * 16 + 4 * 16 and np.linalg.norm(d[:64]) == pytest.approx(1) and np.linalg.norm(d[64:]) == pytest.approx(1) for d in m["descriptor"])
    i = query(spark, data, "image_descriptor")
    assert all(len(d) == 128 and np.linalg.norm(d) == pytest.approx(1) for d in i["descriptor"])
    images = image_of(spark, data)
    a = images[0]
    assert np.allclose(kernels.image_descriptor(a * 3), kernels.image_descriptor(a)) and np.allclose(kernels.image_descriptor(a + 7), kernels.image_descriptor(a))


def test_harris_query(spark, data):
    got, images = query(spark, data, "harris"), image_of(spark, data)
    for i, own in got.groupby("img"):
        a = images[i]
        assert own["rank"].is_unique and own["row"].between(0, a.shape[0] - 1).all() and own["col"].between(0, a.shape[1] - 1).all()
    board = np.kron(np.indices((6, 6)).sum(axis=0) % 2, np.ones((8, 8))) * 255
    c = kernels.harris(board)
    assert len(c) and all(min(r % 8, 8 - r % 8) <= 1 and min(k % 8, 8 - k % 8) <= 1 for r, k in c)


def test_deskew_of_a_turning_sensor(spark):
    """A sensor that turns at a constant rate sees a fixed point turn the other way; deskewing undoes that."""
    w, t = 0.8, np.linspace(0, 1, 21)
    imu = spark.createDataFrame([(1, float(x), 0.0, 0.0, 9.81, 0.0, 0.0, w) for x in t], "frame long, t double, ax double, ay double, az double, wx double, wy double, wz double")
    p = np.array([4.0, 1.0, 0.5])
    rows = [(1, i, float(x), *map(float, exp([0, 0, -w * x]) @ p), 0.0) for i, x in enumerate(t)]
    got = odometry.deskew(spark.createDataFrame(rows, "frame long, seq long, t double, x double, y double, z double, ref_time double"), imu).toPandas()
    assert np.allclose(got[["x", "y", "z"]].to_numpy(), p, atol=2e-2)


def test_deskew_query_keeps_points_at_the_reference_time(spark, data):
    got = query(spark, data, "deskew")
    frames = clouds_of(spark, data)
    assert set(got.frame) <= set(frames) and len(got) == sum(len(frames[f]) for f in set(got.frame)) and got[["x", "y", "z"]].notna().all().all()


def test_camera_iterations_run_in_batches(spark):
    """The steps are Arrow functions and no nested lambdas, and keep nulls and points behind the camera."""
    from tessera.functions import camera

    k = camera.camera_matrix(500.0, 510.0, 320.0, 240.0)
    d = spark.createDataFrame([(1.0, 0.5, 4.0), (0.3, -0.2, 2.0), (1.0, 1.0, -1.0), (None, 1.0, 2.0)], "x double, y double, z double")
    x, y, z = (F.col(c) for c in "xyz")
    moving = camera.rolling_shutter_project_point(k, (x, y, z), (1.0, 2.0, 0.5), (0.1, 0.2, 0.3), 480, 0.03, (-0.1, 0.02, 0.001, -0.002, 0.003))
    plan = d.select(moving.alias("p"), camera.fisheye_unproject_pixel(k, x, y, z, (0.05, -0.01)).alias("q"))
    assert "aggregate(" not in plan._jdf.queryExecution().executedPlan().toString()
    got = d.select(moving.alias("p")).collect()
    assert got[2].p is None and got[3].p is None
    for (px, py, pz), out in zip([(1.0, 0.5, 4.0), (0.3, -0.2, 2.0)], got, strict=False):
        v = 0.0
        for _ in range(200):
            s = min(max(v, 0.0), 479.0) / 479 * 0.03
            a, b, c = px - s * (1 + 0.2 * pz - 0.3 * py), py - s * (2 + 0.3 * px - 0.1 * pz), pz - s * (0.5 + 0.1 * py - 0.2 * px)
            a, b = a / c, b / c
            q = a * a + b * b
            f = 1 - 0.1 * q + 0.02 * q * q + 0.003 * q**3
            a, b = a * f + 0.002 * a * b - 0.002 * (q + 2 * a * a), b * f + 0.001 * (q + 2 * b * b) - 0.004 * a * b
            u, v = 500 * a + 320, 510 * b + 240
        assert abs(out.p.u - u) < 1e-4 and abs(out.p.v - v) < 1e-4


def test_pairs_of_sensors_are_dealt_and_inverted_once(spark, tmp_path):
    """One entry of a product is that of the whole one, and no inverse is taken above the join."""
    from tessera.functions import se3
    from tessera.queries.geometry import sensor_pair_matrix

    m = spark.range(1).select(se3.matrix([float(i * i % 7) for i in range(16)]).alias("a"), se3.matrix([float(i * 3 % 5) for i in range(16)]).alias("b"))
    got = m.select(se3.multiply(F.col("a"), F.col("b"))[7].alias("x"), se3.product_entry(F.col("a"), F.col("b"), 1, 3).alias("y")).first()
    assert got.x == got.y
    spark.createDataFrame([(i, i % 2, float(i)) for i in range(6)], "s_suppkey long, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    pairs = sensor_pair_matrix(spark, str(tmp_path))
    assert pairs.count() == 12
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan[: plan.index("Join")]
