"""Descriptors compared in blocks, against plain loops."""

import numpy as np

from tessera.operators import descriptors

RNG = np.random.default_rng(12)


def frame(spark, rows, place=False):
    return spark.createDataFrame([(i, i, v.tolist()) if place else (i, v.tolist()) for i, v in rows], "id long, position long, descriptor array<float>" if place else "id long, descriptor array<float>")


def test_nearest_in_blocks(spark, monkeypatch):
    """Ties go to the earlier, zero descriptors are at 1 from others and at 0 from each other, and the newest rows are left out."""
    monkeypatch.setattr(descriptors, "BLOCK_ROWS", 7)
    x = RNG.integers(0, 4, (50, 3)).astype(np.float32)
    x[10] = x[20] = 0
    base = frame(spark, enumerate(x), True)
    got = {}
    for r in descriptors.nearest_descriptors(base, base.where("id % 3 = 0"), 2, 4).orderBy("query", "rank").collect():
        got.setdefault(r.query, []).append((r.id, r.distance))

    def distance(a, b):
        m, n = np.linalg.norm(a), np.linalg.norm(b)
        return 0.0 if m == n == 0 else 1.0 if m == 0 or n == 0 else 1 - a.astype(float) @ b / (float(m) * float(n))

    for q in range(0, 50, 3):
        want = sorted((distance(x[i], x[q]), i) for i in range(50) if i < q - 2)[:4]
        assert np.allclose([d for _, d in got.get(q, [])], [d for d, _ in want], atol=1e-6)
    assert descriptors.nearest_descriptors(base.limit(0), base).count() == 0


def test_matches_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(descriptors, "BLOCK_ROWS", 6)
    left, right = RNG.normal(size=(25, 4)), RNG.normal(size=(40, 4))
    left[:8] = right[:8] + 0.05
    left[9], right[11], right[12] = 0, 0, right[13]
    a, b = frame(spark, enumerate(left)), frame(spark, enumerate(right))
    got = {r.a: (r.b, r.distance) for r in descriptors.match_features(a, b, 0.8).collect()}
    want = {}
    l32, r32 = left.astype(np.float32).astype(float), right.astype(np.float32).astype(float)
    for i in range(25):
        if i == 9:
            continue
        d = sorted((float(np.linalg.norm(l32[i] - r32[j])), j) for j in range(40) if j != 11)
        if (1.0 if d[1][0] <= 1e-12 else d[0][0] / d[1][0]) < 0.8:
            want[i] = (d[0][1], d[0][0])
    assert got.keys() == want.keys() >= set(range(8)) and all(got[i][0] == want[i][0] and abs(got[i][1] - want[i][1]) < 1e-9 for i in want)
    assert descriptors.match_features(a, b.limit(1), 0.8).count() == 0 == descriptors.match_features(a.limit(0), b).count()


def test_held_differences_are_bounded_whatever_the_width():
    for width in (2, 64, 4096):
        parts = descriptors._pieces(2000, 2000, width)
        assert sum(p.stop - p.start for p in parts[:-1]) < 2000 <= parts[-1].stop
        assert all((p.stop - p.start) * 2000 * width <= descriptors.HELD or p.stop - p.start == 1 for p in parts)
