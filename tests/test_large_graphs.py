"""Pose graphs in blocks, against the kernel on small ones, and one that no task holds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import kernels
from tessera.operators import graphs, large_graphs


def made(n, loops, seed=0, flips=True):
    """(poses, edges): a noisy path, its edges in both directions, some doubled, and links across it."""
    rng = np.random.default_rng(seed)
    truth, poses, edges = [np.eye(4)], [np.eye(4)], []
    for i in range(1, n):
        m = kernels.rigid(kernels.exp_so3(rng.normal(0, 0.05, 3)), [1, 0, 0] + rng.normal(0, 0.05, 3))
        truth.append(truth[-1] @ m)
        noisy = m @ kernels.rigid(kernels.exp_so3(rng.normal(0, 0.001, 3)), rng.normal(0, 0.005, 3))
        poses.append(poses[-1] @ noisy)
        edges.append((i, i - 1, np.linalg.inv(noisy), 100 * np.eye(6)) if flips and i % 5 == 0 else (i - 1, i, noisy, 100 * np.eye(6)))
        if i % 11 == 0:
            edges.append((i - 1, i, m, 10 * np.eye(6)))
    for _ in range(loops):
        a, b = sorted(rng.choice(n, 2, replace=False))
        edges.append((int(a), int(b), np.linalg.inv(truth[a]) @ truth[b], 50 * np.eye(6)))
    return poses, edges


def frames(spark, named):
    flat = lambda m: np.ravel(m).tolist()
    nodes = [(g, i, i, flat(m)) for g, (poses, _) in named.items() for i, m in enumerate(poses)]
    edges = [(g, a, b, flat(m), flat(w)) for g, (_, links) in named.items() for a, b, m, w in links]
    return spark.createDataFrame(nodes, "graph string, id long, seq long, transform array<double>"), spark.createDataFrame(edges, "graph string, a long, b long, transform array<double>, information array<double>")


@pytest.mark.parametrize(("n", "loops"), [(80, 5), (400, 5), (500, 300)])
def test_chain_solver_is_the_dense_one(n, loops):
    poses, edges = made(n, loops, flips=False)
    x = np.array(poses)
    i, j = np.array([e[0] for e in edges]), np.array([e[1] for e in edges])
    w = np.array([e[3] for e in edges])
    e, ja, jb = kernels.linearise(x[i], x[j], np.linalg.inv(np.array([t[2] for t in edges])))
    h, g = kernels.factors(e, ja, jb, w)
    near = j == i + 1
    ch, cg = np.zeros((n - 1, 12, 12)), np.zeros((n - 1, 12))
    np.add.at(ch, i[near], h[near])
    np.add.at(cg, i[near], g[near])
    got = kernels.solve_chain(ch, cg, i[~near], j[~near], h[~near], g[~near], 1e-6)
    assert np.allclose(got, kernels._dense_step(i, j, ja, jb, w, e, n, 1e-6, True), atol=1e-5)


def test_blocks_give_what_the_kernel_gives(spark, monkeypatch):
    """Blocks of 16 poses. A graph that is met exactly ends first; a null name and ids without links are graphs and poses too."""
    named = {"a": made(70, 3), None: made(40, 2, 1)}
    exact = made(20, 0, 2, flips=False)[0]
    named["exact"] = (exact, [(i, i + 1, np.linalg.inv(exact[i]) @ exact[i + 1], np.eye(6)) for i in range(19)])
    monkeypatch.setattr(large_graphs, "BLOCK", 16)
    monkeypatch.setattr(graphs, "TASK_POSES", 10)
    monkeypatch.setattr(kernels, "STRETCH", 5)
    nodes, edges = frames(spark, named)
    rows = graphs.optimise(nodes.repartition(3), edges, max_iterations=8).collect()
    assert len(rows) == nodes.count()
    for g, (poses, links) in named.items():
        want, cost, _, ok = kernels.optimise_graph(dict(enumerate(poses)), links, max_iterations=8)
        own = {r.id: r for r in rows if r.graph == g}
        worst = max(np.abs(np.reshape(own[i].transform, (4, 4)) - want[i]).max() for i in want)
        assert worst < 1e-5 and own[0].cost == pytest.approx(cost, rel=1e-6, abs=1e-9) and own[0].converged == ok


def test_tables_solve_what_a_task_solves(spark):
    """Conjugate gradients on tables of a few factors, with a link that is turned and one from a pose to itself."""
    poses, edges = made(4, 0, 3, flips=False)
    edges = [*edges, (3, 1, np.linalg.inv(poses[3]) @ poses[1] @ kernels.rigid(np.eye(3), [0.1, 0, 0]), 20 * np.eye(6)), (2, 2, kernels.rigid(np.eye(3), [0, 0.1, 0]), np.eye(6))]
    x = np.array(poses)
    i, j = np.array([e[0] for e in edges]), np.array([e[1] for e in edges])
    h, g = kernels.factors(*kernels.linearise(x[i], x[j], np.linalg.inv(np.array([e[2] for e in edges]))), np.array([e[3] for e in edges]))
    rows = [(0, int(a), int(b), u.ravel().tolist(), v.tolist()) for a, b, u, v in zip(i, j, h, g, strict=True)]
    frame = spark.createDataFrame(rows, large_graphs._FACTOR_SQL)
    one = {r.at: r.step for r in large_graphs._solve_in_task(frame, 1e-6).collect()}
    two = {r.at: r.step for r in large_graphs._solve_by_tables(frame, 1e-6).collect()}
    assert one.keys() == two.keys() == {0, 1, 2, 3} and all(np.allclose(one[k], two[k], atol=1e-6) for k in one) and np.abs(one[3]).max() > 1e-3


def test_a_graph_that_no_task_holds(spark):
    """100,000 poses in ten blocks: the cost falls, and the links across the path are met."""
    rng = np.random.default_rng(5)
    n = 100_000
    turn, go = rng.normal(0, 0.02, n - 1), 1 + rng.normal(0, 0.05, n - 1)

    def path(turn, go):
        a = np.concatenate(([0], np.cumsum(turn)))
        x = np.zeros((n, 4, 4))
        x[:, 0, 0], x[:, 0, 1], x[:, 1, 0], x[:, 1, 1], x[:, 2, 2], x[:, 3, 3] = np.cos(a), -np.sin(a), np.sin(a), np.cos(a), 1, 1
        x[1:, 0, 3], x[1:, 1, 3] = np.cumsum(go * np.cos(a[:-1])), np.cumsum(go * np.sin(a[:-1]))
        return x

    truth = path(turn, go)
    poses = path(turn + rng.normal(0, 1e-5, n - 1), go + rng.normal(0, 1e-3, n - 1))
    inv = kernels._inv_rigid_many
    a = np.concatenate((np.arange(n - 1), rng.integers(0, n, 200)))
    b = np.concatenate((np.arange(1, n), rng.integers(0, n, 200)))
    measured = np.concatenate((inv(poses[:-1]) @ poses[1:], inv(truth[a[n - 1 :]]) @ truth[b[n - 1 :]]))
    import pyarrow as pa

    info = (100 * np.eye(6)).ravel().tolist()
    nodes = spark.createDataFrame(pa.table({"id": np.arange(n), "transform": large_graphs._lists(poses)})).select(F.lit("g").alias("graph"), "id", F.col("id").alias("seq"), "transform")
    edges = spark.createDataFrame(pa.table({"a": a, "b": b, "transform": large_graphs._lists(measured)})).select(F.lit("g").alias("graph"), "a", "b", "transform", F.array(*map(F.lit, info)).alias("information"))
    before = graphs.graph_cost(nodes, edges).first().cost
    got = graphs.optimise(nodes, edges, max_iterations=3).orderBy("id").toPandas()
    x = np.array(got["transform"].tolist()).reshape(n, 4, 4)
    assert len(got) == n and got.cost[0] < 0.02 * before and (x[0] == poses[0]).all()
    i, j = a[n - 1 :], b[n - 1 :]
    off = lambda p: np.linalg.norm((inv(p[i]) @ p[j])[:, :3, 3] - measured[n - 1 :, :3, 3], axis=1).mean()
    assert off(x) < 0.1 * off(poses)


def test_small_graphs_are_solved_side_by_side(spark, monkeypatch):
    """Several sizes, loops, no edges, a null name and repeated ids: what one graph after the other gives, in one call for many graphs."""
    rng = np.random.default_rng(11)

    def chain(n, loop):
        poses = [kernels.rigid(kernels.exp_so3(rng.normal(0, 0.2, 3)), [i + rng.normal(0, 0.1), 0, 0]) for i in range(n)]
        links = [(i, i + 1, kernels.rigid(kernels.exp_so3(rng.normal(0, 0.1, 3)), [1.0, 0.1, 0]), np.diag([9.0, 8, 7, 50, 60, 70])) for i in range(n - 1)]
        return poses, links + ([(n - 1, 0, kernels.rigid(np.eye(3), [1.0 - n, 0, 0]), np.eye(6))] if loop else [])

    named = {f"g{k}": chain(1 + k, k > 3 and k % 2) for k in range(9)} | {None: chain(4, True)}
    nodes, edges = frames(spark, named)
    monkeypatch.setattr(graphs, "SIDE_POSES", 7)  # the largest go through the plain kernel
    planned = graphs.optimise(nodes, edges, max_iterations=9)
    assert "_bucket" in planned._jdf.queryExecution().executedPlan().toString()
    rows = planned.collect()
    assert len(rows) == nodes.count()
    for g, (poses, links) in named.items():
        want, cost, _, ok = kernels.optimise_graph(dict(enumerate(poses)), links, max_iterations=9)
        own = {r.id: r for r in rows if r.graph == g}
        assert max(np.abs(np.reshape(own[i].transform, (4, 4)) - want[i]).max() for i in want) < 1e-6
        assert own[0].cost == pytest.approx(cost, rel=1e-6, abs=1e-9) and own[0].converged == ok
    twice = graphs.optimise(nodes.where("graph = 'g3'").unionByName(nodes.where("graph = 'g3' and id = 2")), edges.where("graph = 'g3'"), max_iterations=9).collect()
    assert sorted(r.id for r in twice) == [0, 1, 2, 3]
    for window in (2, 3):
        smooth = {(r.graph, r.id): r.transform for r in graphs.smooth(nodes, edges.where("abs(a - b) = 1"), window).collect()}
        assert len(smooth) == len(rows)
        for g, (poses, links) in named.items():
            s = graphs.Smoother(window)
            for i, p in enumerate(poses):
                s.add(i, p, [e for e in links if max(e[:2]) == i and abs(e[0] - e[1]) == 1])
                s.optimise()
            for i, p in {**s.frozen, **s.poses}.items():
                assert np.abs(np.reshape(smooth[g, i], (4, 4)) - p).max() < 1e-6


def test_derivatives_are_those_of_differences():
    """Small and large turns, near a half turn, and a matrix that is no rotation."""
    rng = np.random.default_rng(2)
    m = [np.array([kernels.rigid(kernels.exp_so3(v * s), rng.normal(0, 3, 3)) for v, s in zip(rng.normal(0, 1, (30, 3)), np.repeat([0, 1e-5, 1], 10), strict=True)]) for _ in range(3)]
    m[0][4, 0, 0] *= 1.1
    for one, two in zip(kernels.derivatives(*m), kernels.linearise(*m), strict=True):
        assert np.abs(one - two).max() < 1e-5
