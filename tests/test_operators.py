"""Operators whose result SQL does not give: small cases with known answers."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import kernels
from tessera.errors import SensorError, SensorNotFoundError
from tessera.operators import clouds, estimation, graphs, odometry, rig, sync
from tessera.plans.session import Session

RNG = np.random.default_rng(3)
CLOUD = RNG.uniform(-5, 5, (200, 3))
MOVE = kernels.rigid(kernels.exp_so3([0.02, -0.03, 0.05]), [0.1, -0.05, 0.02])


def frame(spark, points, **more):
    rows = [(i, *map(float, p)) for i, p in enumerate(points)]
    d = spark.createDataFrame(rows, "seq long, x double, y double, z double")
    for k, v in more.items():
        d = d.withColumn(k, F.lit(v))
    return d


def test_asof_ties_and_ends(spark):
    s = spark.createDataFrame([(float(t), 10.0 * (t + 1)) for t in range(4)], "t double, v double")
    q = spark.createDataFrame([(0.5,), (-1.0,), (10.0,), (2.0,)], "t double")
    for width in (1.0, 100.0):
        near = {r.t: r.sample.v for r in sync.nearest(s, q, width=width).collect()}
        assert near == {0.5: 10.0, -1.0: 10.0, 10.0: 40.0, 2.0: 30.0}
        line = {r.t: r.v for r in sync.linear(s, q, width=width).collect()}
        assert line == {0.5: 15.0, -1.0: 10.0, 10.0: 40.0, 2.0: 30.0}


def test_linear_of_arrays(spark):
    s = spark.createDataFrame([(0.0, [1.0, 2.0]), (1.0, [3.0, 4.0])], "t double, v array<double>")
    q = spark.createDataFrame([(0.5,)], "t double")
    assert sync.linear(s, q).first().v == [2.0, 3.0]
    with pytest.raises(SensorError):
        sync.interpolate(s, q, "cubic")


@pytest.mark.parametrize("plane", [False, True])
def test_icp_kernel(plane):
    target = CLOUD @ MOVE[:3, :3].T + MOVE[:3, 3]
    n = kernels.point_normals(target, 10) if plane else None
    m, mse, _, ok = kernels.icp(CLOUD, target, plane_normals=n)
    assert ok and mse < 1e-6 and np.allclose(m, MOVE, atol=1e-3)


def test_icp_over_joins_agrees_with_the_kernel(spark):
    target = CLOUD @ MOVE[:3, :3].T + MOVE[:3, 3]
    m, mse, _, ok = estimation.icp(frame(spark, CLOUD), frame(spark, target), max_distance=3.0, max_iterations=8)
    assert np.allclose(m, MOVE, atol=1e-2)


def test_plane_and_ground(spark):
    p = np.c_[RNG.uniform(-10, 10, (300, 2)), RNG.uniform(-0.02, 0.02, 300)]
    q = np.c_[RNG.uniform(-10, 10, (60, 2)), RNG.uniform(1, 3, 60)]
    c = frame(spark, np.vstack((p, q)), frame=0)
    n, d, marked = clouds.ransac_plane(c, threshold=0.05, iterations=30)
    assert abs(n[2]) > 0.99 and 295 <= marked.where("inlier").count() <= 305
    n, d, marked = clouds.ransac_ground(c, iterations=30)
    assert n[2] > 0.99 and marked.where("ground").count() >= 300
    assert clouds.normals(c, 10).where("abs(nz) > 0.9").count() > 250


def test_calibration(spark):
    r, t = kernels.exp_so3([0.1, 0.2, -0.3]), np.array([0.5, -0.2, 0.1])
    l = RNG.normal(size=(6, 3))
    l /= np.linalg.norm(l, axis=1)[:, None]
    ld = RNG.uniform(1, 5, 6)
    c = l @ r.T
    rows = [tuple(map(float, (*a, d, *b, d + b @ t))) for a, d, b in zip(l, ld, c, strict=True)]
    m = estimation.calibrate(spark.createDataFrame(rows, "lx double, ly double, lz double, ld double, cx double, cy double, cz double, cd double"))
    assert np.allclose(m, kernels.rigid(r, t), atol=1e-9)


def test_ego_velocity(spark):
    v = np.array([3.0, -1.0, 0.2])
    rows = []
    for _ in range(40):
        az, el = RNG.uniform(-60, 60), RNG.uniform(-20, 20)
        a, e = np.radians(az), np.radians(el)
        rows.append((float(az), float(el), float(-v @ [np.cos(e) * np.cos(a), np.cos(e) * np.sin(a), np.sin(e)]), 20.0))
    m = estimation.ego_velocity_moments(spark.createDataFrame(rows, "azimuth double, elevation double, velocity double, snr double")).first()
    got, ok = estimation.solve_ego_velocity(m)
    assert ok and np.allclose(got, v)
    assert not estimation.solve_ego_velocity(None)[1]


def test_preintegration_and_deskew():
    t = np.arange(11) * 0.1
    r, v, p = kernels.preintegrate(t, np.tile([1.0, 0, 0], (11, 1)), np.zeros((11, 3)))
    assert np.allclose(v, [1, 0, 0]) and np.allclose(p, [0.5, 0, 0]) and np.allclose(r, np.eye(3))
    still = kernels.deskew(CLOUD, np.linspace(0, 1, 200), t, np.tile([0, 0, 9.81], (11, 1)), np.zeros((11, 3)), 0.0, np.array([0, 0, -9.81]), np.zeros(3))
    assert np.allclose(still, CLOUD, atol=1e-9)


def test_pose_graph_and_smoother(spark):
    eye, step = np.eye(4), kernels.rigid(np.eye(3), [1.0, 0, 0])
    poses = {i: kernels.rigid(np.eye(3), [1.1 * i, 0.05 * i, 0]) for i in range(4)}
    edges = [(i, i + 1, step, 200 * np.eye(6)) for i in range(3)]
    x, cost, _, ok = kernels.optimise_graph(poses, edges)
    assert ok and cost < 1e-9 and np.allclose(x[3][:3, 3], [3, 0, 0], atol=1e-6) and np.allclose(x[0], eye)
    s = graphs.Smoother(2)
    for i in range(4):
        s.add(i, poses[i], [e for e in edges if e[1] == i])
        s.optimise()
    assert len(s.poses) == 2 and np.allclose(s.poses[3][:3, 3], [3, 0, 0], atol=0.3)


def test_vision_kernels():
    k = np.array([[500, 0, 320], [0, 500, 240], [0, 0, 1.0]])
    x = np.c_[RNG.uniform(-2, 2, (40, 2)), RNG.uniform(4, 10, 40)]
    r, t = kernels.exp_so3([0.02, 0.1, -0.03]), np.array([0.5, 0.1, 0.05])
    a, b = x @ k.T, (x @ r.T + t) @ k.T
    a, b = a[:, :2] / a[:, 2:], b[:, :2] / b[:, 2:]
    e, ok = kernels.essential(a, b, k, threshold=1e-3, iterations=200)
    r2, t2 = kernels.pose_from_essential(e, a[ok], b[ok], k)
    assert np.allclose(r2, r, atol=1e-4) and np.allclose(t2, t / np.linalg.norm(t), atol=1e-3)
    r3, t3, ok = kernels.pnp(x, b, k)
    assert ok.all() and np.allclose(r3, r, atol=1e-5) and np.allclose(t3, t, atol=1e-4)
    assert np.allclose(kernels.triangulate(k @ np.eye(3, 4), k @ np.c_[r, t], a, b), x, atol=1e-5)
    left = RNG.integers(0, 255, (32, 64))
    d = kernels.disparity(left, np.roll(left, -8, axis=1), 5, 16)
    assert (d[4:-4, 20:-4] == 8).mean() > 0.95
    board = np.kron(np.indices((8, 8)).sum(axis=0) % 2, np.ones((8, 8))) * 255
    c = kernels.harris(board)
    assert len(c) > 10 and kernels.patch_descriptors(board, c).shape[1] == 121


def test_rectified_rows_agree():
    k = np.array([[500, 0, 320], [0, 500, 240], [0, 0, 1.0]])
    r1, r2, p1, p2 = kernels.rectify(k, k, np.eye(3), np.array([-0.12, 0, 0]))
    assert np.allclose(r1, np.diag([-1, -1, 1])) and np.allclose(r1, r2) and p2[0, 3] == pytest.approx(-60) and p1[0, 3] == 0
    r1, r2, _, _ = kernels.rectify(k, k, kernels.exp_so3([0, 0.1, 0]), np.array([-0.12, 0.01, 0]))
    assert np.allclose(r1 @ r1.T, np.eye(3)) and np.allclose(r2 @ r2.T, np.eye(3))
    with pytest.raises(ValueError):
        kernels.rectify(k, k, np.eye(3), np.zeros(3))


def test_wheels(spark):
    s = spark.createDataFrame([(i / 10, 1.0, 1.0, "a") for i in range(11)], "t double, left double, right double, car string")
    last = odometry.differential_drive(s, 0.5, by=("car",)).orderBy(F.desc("t")).first()
    assert last.x == pytest.approx(1.0) and last.y == pytest.approx(0.0)
    with pytest.raises(SensorError):
        odometry.check_times(s.where("t = 0"), ("car",))


def test_rig(spark, tmp_path):
    cam = rig.Sensor("cam", "camera", intrinsics={"fx": 100.0, "fy": 100.0, "cx": 50.0, "cy": 50.0, "width": 100, "height": 100}, time_offset=0.03)
    r = rig.Rig([cam, rig.Sensor("lidar", "lidar", translation=(0.0, 0.0, 1.0))])
    r.to_yaml(str(tmp_path / "r.yaml"))
    s = rig.Rig.from_yaml(str(tmp_path / "r.yaml"))
    assert s.names() == ["cam", "lidar"] and np.allclose(s.transform_between("lidar", "cam")[:3, 3], [0, 0, 1])
    assert s.time_offset_between("lidar", "cam") == pytest.approx(0.03)
    with pytest.raises(SensorNotFoundError):
        s["none"]
    got = s.project(frame(spark, [[0, 0, 1], [0, 0, -5]]), "lidar", "cam").orderBy("seq").collect()
    assert (got[0].u, got[0].v, got[0].valid) == (50.0, 50.0, True) and not got[1].valid
    rig.pair_matrices(s.table(spark)).collect()
    with pytest.raises(SensorError):
        rig.Rig([rig.Sensor("c", "camera")]).validate()


def test_session(spark, tmp_path):
    rows = []
    for i in range(4):
        p = CLOUD - [0.05 * i, 0, 0]
        rows.append((i, "/lidar/points", float(i), json.dumps({"xyz": p.tolist()})))
    bag = spark.createDataFrame(rows, "offset long, topic string, timestamp double, data string")
    s = Session(spark, max_iterations=30)
    seen = []
    s.on_topic("/lidar/points")(lambda d: seen.append(d.count()))
    s.run(bag)
    assert seen == [4]
    t = {r.frame: r.x for r in s.tables["trajectory"].collect()}
    assert t[3] == pytest.approx(0.15, abs=1e-2)
    s.optimise(max_iterations=3)
    s.save(str(tmp_path / "s"))
    back = Session.load(spark, str(tmp_path / "s"))
    assert back.tables["nodes"].count() == 4
    both = back.merge(back, (0, 0, np.eye(4), np.eye(6)))
    assert both.tables["nodes"].count() == 8 and both.tables["edges"].count() == 7
    assert s.localise(bag, frame(spark, CLOUD)).count() == 4


def test_planes_are_drawn_without_a_window_over_the_cloud(spark):
    """Row numbers come from ranges, corners from a join; null groups keep their corner, and counts are those of plain numbers."""
    rows = [(i, float(i % 7), float(i % 11), 0.01 * (i % 3), None if i % 2 else 1) for i in range(300)]
    d = spark.createDataFrame(rows, "seq long, x double, y double, z double, g int")
    low = clouds.voxel_downsample(d, 4.0, ("g",))
    assert "Window" not in low._jdf.queryExecution().executedPlan().toString()
    assert {r.g for r in low.collect()} == {None, 1} and sum(r.n for r in low.collect()) == 300
    normal, off, got = clouds.ransac_plane(d, 0.05, iterations=5, seed=3)
    assert abs(normal[2]) > 0.99 and got.where("inlier").count() == 300
    assert "Window" not in got._jdf.queryExecution().analyzed().toString()
    planes = spark.createDataFrame([(0, 0.0, 0.0, 1.0, 0.0), (1, 1.0, 0.0, 0.0, 6.0), (2, 0.0, 0.0, 1.0, 9.0)], "hyp int, nx double, ny double, nz double, d double")
    want = {0: sum(r[3] <= 0.01 for r in rows), 1: sum(r[1] == 6 for r in rows)}
    counted = clouds.count_inliers(d, planes, 0.01)
    assert {r.hyp: r.inliers for r in counted.collect()} == want
    assert "NestedLoop" not in counted._jdf.queryExecution().executedPlan().toString()


def test_within_distance_meets_across_blocks_and_keeps_rows(spark):
    """Against brute force over block borders; repeated rows, null and NaN places and null groups stay, and no row is spread over 27 cells."""
    rng = np.random.default_rng(5)
    p, q = rng.uniform(-20, 20, (400, 3)).round(1), rng.uniform(-20, 20, (300, 3)).round(1)
    rows = [(i % 3, *map(float, v)) for i, v in enumerate(p)]
    rows += [rows[0], (1, None, 0.0, 0.0), (1, float("nan"), 0.0, 0.0), (None, *map(float, q[0]))]
    ref = [(i % 3, *map(float, v)) for i, v in enumerate(q)] + [(None, *map(float, q[0]))]
    kind = "g int, x double, y double, z double"
    got = clouds.within_distance(spark.createDataFrame(rows, kind), spark.createDataFrame(ref, kind), 2.0, ("g",))
    assert "Generate explode([" not in got._jdf.queryExecution().executedPlan().toString()
    near = [any(r[0] == o[0] and sum((a - b) ** 2 for a, b in zip(r[1:], o[1:], strict=True)) <= 4 for o in ref) if r[0] is not None and r[1] is not None else False for r in rows]
    key = lambda r: repr(tuple(r))
    assert sorted(key(r) for r in got.collect()) == sorted(key((*r, k)) for r, k in zip(rows, near, strict=True))


def test_overlay_spreads_centres_only(spark):
    """The last by the whole of seq wins, also from centres beside the image."""
    from tessera.operators import rasters

    rows = [((1, 1), -1.0, 0.0, True, 0.0), ((1, 2), -1.0, 0.0, True, 10.0), ((0, 9), 1.0, 0.0, True, 5.0), ((9, 9), -3.0, 0.0, True, 0.0)]
    p = spark.createDataFrame(rows, "seq struct<a:int,b:int>, u double, v double, valid boolean, depth double")
    got = {(r.row, r.col): (r.r, r.g, r.b) for r in rasters.overlay(p, 4, 2, 1, (0.0, 10.0)).collect()}
    assert set(got) == {(r, c) for r in (0, 1) for c in (0, 1, 2)}
    assert got[0, 0][0] == 255 and got[0, 1] == got[0, 2] and got[0, 1][0] != 255
    plan = rasters.overlay(p, 4, 2, 1)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Join")  # plans read from the top: squares come after centres


def test_scan_context_distances_of_pairs_at_once(spark, monkeypatch):
    """Repeated pairs count once; empty scans and empty rings; bins travel once a pair, not once a bin, ring and shift."""
    from tessera.operators import descriptors

    rng = np.random.default_rng(3)
    maps = {f: np.where(rng.random((3, 8)) < 0.5, rng.uniform(0.5, 3, (3, 8)), 0) for f in range(4)}
    maps[1][2], maps[2][2], maps[3][:] = 0, 0, 0
    rows = [(f, r, s, float(m[r, s])) for f, m in maps.items() for r in range(3) for s in range(8) if m[r, s] > 0]
    context = spark.createDataFrame(rows, "frame long, ring int, sector int, h double")
    pairs = spark.createDataFrame([(a, b) for a in range(4) for b in range(4)] * 2, "a long, b long")
    monkeypatch.setattr(descriptors, "PAIRS_HELD", 3)
    d = descriptors.scan_context_distance(context, pairs, num_rings=3, num_sectors=8)
    assert "Generate" not in d._jdf.queryExecution().executedPlan().toString()
    got = {(r.a, r.b): (r.distance, r["shift"]) for r in d.collect()}
    assert len(got) == 16
    for (a, b), (distance, shift) in got.items():
        best = (np.inf, 0)
        for s in range(8):
            turned = np.roll(maps[b], -s, axis=1)
            ring = [0.0 if not (u.any() or v.any()) else 1.0 if not (u.any() and v.any()) else 1 - u @ v / np.linalg.norm(u) / np.linalg.norm(v) for u, v in zip(maps[a], turned, strict=True)]
            best = min(best, (round(float(np.mean(ring)), 12), s))
        assert abs(distance - best[0]) < 1e-11 and shift == best[1]


def test_essential_and_triangulation_take_many_at_once(monkeypatch):
    """What one trial and one point after the other gave; a pair of 40,000 points has no matrix of points x points (12.8 GB)."""
    k = np.array([[500, 0, 320], [0, 500, 240], [0, 0, 1.0]])
    rng = np.random.default_rng(6)

    def seen(n, noise):
        x = np.c_[rng.uniform(-2, 2, (n, 2)), rng.uniform(4, 10, n)]
        a, b = x @ k.T, (x @ kernels.exp_so3([0.02, 0.1, -0.03]).T + [0.5, 0.1, 0.05]) @ k.T
        b = b[:, :2] / b[:, 2:]
        return a[:, :2] / a[:, 2:], b + rng.normal(0, noise, b.shape) * (rng.random((n, 1)) < 0.3)

    def plain(a, b, threshold, iterations):
        ki = np.linalg.inv(k)
        n1, n2 = ((np.c_[p, np.ones(len(p))] @ ki.T)[:, :2] for p in (a, b))
        draw, best = np.random.default_rng(0), np.zeros(len(a), bool)
        for _ in range(iterations):
            i = draw.choice(len(a), 8, replace=False)
            ok = kernels.sampson(kernels._eight(n1[i], n2[i]), n1, n2) < threshold**2
            if ok.sum() > best.sum():
                best = ok
                if ok.all():
                    break
        e = kernels._eight(n1[best], n2[best])
        return e, kernels.sampson(e, n1, n2) < threshold**2

    for n, noise, held in ((60, 3.0, 200_000), (60, 0.0, 200_000), (60, 3.0, 100), (8, 0.0, 5)):
        a, b = seen(n, noise)
        monkeypatch.setattr(kernels, "TRIALS_HELD", held)
        (e, ok), (e2, ok2) = kernels.essential(a, b, k, threshold=0.002, iterations=60), plain(a, b, 0.002, 60)
        assert (ok == ok2).all() and np.allclose(e, e2, atol=1e-12)
    a, b = seen(40_000, 0.0)
    e, ok = kernels.essential(a, b, k, iterations=5)
    assert ok.all()
    p1, p2 = k @ np.eye(3, 4), k @ np.c_[np.eye(3), [-0.5, 0, 0]]
    few = kernels.triangulate(p1, p2, np.array([[320.0, 240], [330, 250]]), np.array([[320.0, 240], [290, 250]]))
    assert np.isnan(few[0]).all() and np.isfinite(few[1]).all() and kernels.triangulate(p1, p2, np.zeros((0, 2)), np.zeros((0, 2))).shape == (0, 3)
    calls = []
    svd = np.linalg.svd
    monkeypatch.setattr(np.linalg, "svd", lambda *a, **kw: calls.append(1) or svd(*a, **kw))
    kernels.triangulate(p1, p2, a, b)
    assert len(calls) == 1


def test_k_nearest_sorts_no_whole_rows(monkeypatch):
    """Ties, copies, fewer points than k and points that are no numbers: what a stable sort of all distances gives, which is asked for the last only."""
    rng = np.random.default_rng(8)
    clouds_ = [rng.normal(size=(700, 3)), rng.integers(0, 4, (600, 3)).astype(float), np.ones((30, 3)), rng.normal(size=(5, 3)), np.vstack((rng.normal(size=(20, 3)), np.full((15, 3), np.nan)))]
    want = [np.argsort(((p[:, None] - p[None]) ** 2).sum(axis=2), axis=1, kind="stable")[:, :12] for p in clouds_]
    calls, sort = [], np.argsort
    monkeypatch.setattr(np, "argsort", lambda *a, **k: calls.append(1) or sort(*a, **k))
    for i, (p, w) in enumerate(zip(clouds_, want, strict=True)):
        assert (kernels.k_nearest(p, 12) == w).all() and len(calls) == (i == 4)
