"""Rectified pairs, remapping and grouped calibration, against what the cameras' geometry demands."""

import numpy as np
import pytest

from tessera import kernels
from tessera.errors import CalibrationError
from tessera.operators import estimation, vision

K1, K2 = np.array([[300.0, 0, 160], [0, 310, 120], [0, 0, 1]]), np.array([[290.0, 0, 150], [0, 300, 125], [0, 0, 1]])
TURN, SHIFT = kernels.exp_so3(np.array([0.01, -0.05, 0.02])), np.array([-0.2, 0.01, 0.005])


def seen(k, dist, p):
    k1, k2, p1, p2, k3 = [*dist, 0, 0, 0, 0, 0][:5]
    x, y = p[0] / p[2], p[1] / p[2]
    r2 = x * x + y * y
    radial = 1 + k1 * r2 + k2 * r2**2 + k3 * r2**3
    return k[0, 0] * (x * radial + 2 * p1 * x * y + p2 * (r2 + 2 * x * x)) + k[0, 2], k[1, 1] * (y * radial + p1 * (r2 + 2 * y * y) + 2 * p2 * x * y) + k[1, 2]


def test_rectified_pixels_show_the_same_points(spark):
    """A point lies on one row of both images once the half turn is whole, and each rectified pixel leads back to the camera's own, distorted one."""
    d1, d2 = (0.1, -0.02, 0.001, 0.002, 0.01), (0.05,)
    pair = vision.stereo_rectify(K1, d1, K2, d2, TURN, SHIFT, (240, 320))
    assert np.allclose(pair["r1"] @ pair["r1"].T, np.eye(3)) and np.isclose(np.linalg.det(pair["r2"]), 1) and np.allclose(pair["r2"], pair["r1"] @ TURN.T)
    for point in np.random.default_rng(0).uniform([-1, -1, 3], [1, 1, 6], (20, 3)):
        for side, k, d, own in ((1, K1, d1, point), (2, K2, d2, TURN @ point + SHIFT)):
            turned = pair[f"r{side}"] @ own
            if turned[2] <= 0:
                continue
            p = pair[f"p{side}"][:, :3] @ (turned / turned[2])
            got = vision.rectified_pixels(pair, side, np.array([p[1]]), np.array([p[0]]))[0]
            assert got == pytest.approx(seen(k, d, own), abs=1e-6)
    for bad in (dict(k1=np.eye(2)), dict(t=[0, 0, 0]), dict(image_size=(0, 3)), dict(r=np.eye(4))):
        with pytest.raises(CalibrationError):
            vision.stereo_rectify(**(dict(k1=K1, d1=(), k2=K2, d2=(), r=TURN, t=SHIFT, image_size=(2, 3)) | bad))


def test_remap_is_bilinear(spark):
    rng = np.random.default_rng(1)
    images = rng.uniform(0, 255, (3, 12, 15))
    frame = spark.createDataFrame([(i, r, c, float(images[i, r, c])) for i in range(3) for r in range(12) for c in range(15) if (i, r, c) != (2, 5, 5)], "img int, row int, col int, v double")
    places = [(0, 0, 0.0, 0.0), (0, 1, 14.0, 11.0), (0, 2, 3.25, 4.5), (0, 3, 14.5, 2.0), (0, 4, -0.5, 2.0), (0, 5, 4.5, 5.0), (0, 6, None, None), (0, 7, 7.0, 2.75)]
    lookup = spark.createDataFrame(places, "row int, col int, u double, v double")
    got = {(r.img, r.col): r.v for r in vision.remap(frame, lookup).collect()}
    assert set(got) == {(i, c) for i in range(3) for c in (0, 1, 2, 5, 7)} - {(2, 5)}
    for (i, c), v in got.items():
        u, w = places[c][2:]
        x, y = min(int(u), 13), min(int(w), 10)
        square, fx, fy = images[i, y : y + 2, x : x + 2], u - x, w - y
        assert v == pytest.approx(np.array([1 - fy, fy]) @ square @ np.array([1 - fx, fx]))


def test_rigs_are_calibrated_side_by_side(spark):
    rng = np.random.default_rng(2)
    truth, rows = {}, []
    for rig in range(30):
        r, t = kernels.exp_so3(rng.normal(size=3)), rng.normal(size=3)
        truth[rig] = (r, t)
        for n in rng.normal(size=(3 + rig % 4, 3)):
            n = n / np.linalg.norm(n)
            d = float(rng.uniform(-2, 2))
            rows.append((rig, *map(float, n), d, *map(float, r @ n), float(d + (r @ n) @ t)))
    rows += [(99, 1.0, 0.0, 0.0, 1.0, 1.0, 0.0, 0.0, 1.0), (None, *rows[0][1:]), (None, *rows[1][1:]), (None, *rows[2][1:])]
    frame = spark.createDataFrame(rows, "rig int, lx double, ly double, lz double, ld double, cx double, cy double, cz double, cd double")
    got = {r.rig: r for r in estimation.calibrate_rigs(frame, ("rig",)).collect()}
    assert len(got) == 32 and got[99].transform is None and got[99].n == 1
    for rig, (r, t) in truth.items():
        m = np.reshape(got[rig].transform, (4, 4))
        assert np.allclose(m[:3, :3], r, atol=1e-7) and np.allclose(m[:3, 3], t, atol=1e-6)
    assert np.allclose(np.reshape(got[None].transform, (4, 4))[:3, :3], truth[0][0], atol=1e-7)
    assert np.allclose(estimation.calibrate(frame.where("rig = 3"))[:3, :3], truth[3][0], atol=1e-7)
    with pytest.raises(CalibrationError):
        estimation.calibrate(frame.where("rig = 99"))
