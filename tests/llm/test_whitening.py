"""op11 against NumPy on the whole table, and its parts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import queries, whitening


def brute(table, components=16):
    """{id: (deviation, {component: whitened})}, n, shares of the trace, axes' signs left open."""
    x = np.array([[int(np.floor(64 * c)) + 1_000_000 for c in v] for v in table.embedding])
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    values, axes = np.linalg.eigh(np.cov(fit.T, bias=True))
    values, axes = values[::-1], axes.T[::-1]
    white = (x - s / n) @ axes[:components].T / np.sqrt(values[:components])
    return ((n * x - s) ** 2).sum(axis=1), n, values / values.sum(), white


def test_whole_table(spark, data):
    table = spark.read.parquet(f"{data}/embeddings.parquet").toPandas()
    dev, n, shares, white = brute(table)
    got = queries.op11_whitening(spark, data).toPandas()
    assert len(got) == 16 * len(table) and (got.n == n).all() and got.identity_error.nunique() == 1 and got.identity_error.max() < 1e-8
    wide = got.pivot(index="vec_id", columns="component", values="whitened").loc[table.vec_id].to_numpy()
    signs = np.sign((wide * white).sum(axis=0))
    assert np.allclose(wide * signs, white, atol=1e-7)
    assert got.groupby("vec_id").deviation.first().loc[table.vec_id].tolist() == dev.tolist()
    assert np.allclose(got.groupby("component").explained.first(), shares[:16], rtol=1e-9)


@pytest.mark.parametrize("n", [1, 2, 3, 17, 40])
def test_eigen_solve(n):
    rng = np.random.default_rng(n)
    for rank in {n, max(1, n // 2)}:
        a = rng.normal(size=(n, rank))
        a = a @ a.T
        values, axes = whitening.eigen(a)
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], atol=1e-12 * n * abs(a).max())
        assert np.allclose(axes.T @ axes, np.eye(n), atol=1e-12) and np.allclose(a @ axes, axes * values, atol=1e-11 * n)
    values, axes = whitening.eigen(np.diag([2.0] * n))  # ties
    assert values.tolist() == [2.0] * n and np.allclose(abs(axes), np.eye(n))


def test_merging_is_the_same_as_one_pass(spark):
    """Many partitions, so that states are merged in several levels."""
    rng = np.random.default_rng(1)
    x = rng.integers(-(2**40), 2**40, size=(3000, 5))
    one = whitening.Moments(5)
    one.add_all(x)
    frame = spark.createDataFrame([(v.tolist(),) for v in x], "x array<long>").repartition(1100)
    add = lambda states, m: states.setdefault(m.shape[1], whitening.Moments(m.shape[1])).add_all(m)
    many = whitening.moments(frame, add)[5]
    assert many.n == one.n == 3000 and many.sums == one.sums == x.astype(object).sum(axis=0).tolist()
    assert np.allclose(many.mean, one.mean) and np.allclose(many.m2, one.m2, rtol=1e-12)
    assert np.allclose(one.covariance(), np.cov(x.T, bias=True), rtol=1e-10)


def test_odd_rows(spark):
    """Nulls, non-finite entries, ties and repeats, no id, another length, huge entries, clashing columns, an empty table."""
    rows = [(1, [0.1, 0.2], 3, "a"), (1, [0.1, 0.2], 3, "a"), (2, [0.9, -0.4], 3, "b"), (3, [0.3, 0.8], 3, "b"), (None, [0.5, 0.5], 3, "b")]
    odd = [(4, None, 0, ""), (5, [], 0, ""), (6, [1.0, None], 0, ""), (7, [float("nan"), 0.0], 0, ""), (8, [float("-inf"), 0.0], 0, "")]
    three = [(9, [0.0, 0.0, 0.0], 0, ""), (10, [1.0, 0.0, 0.0], 0, "")]
    frame = spark.createDataFrame(rows + odd + three, "vec_id long, embedding array<double>, n int, component string").withColumn("a.b", F.lit(1))
    got = whitening.whiten(frame).toPandas()
    two = got[got.vec_id.isna() | (got.vec_id < 4)]
    assert len(two) == 2 * 5 and set(two.n) == {4} and two[two.vec_id == 1].duplicated().sum() == 2
    assert set(two.identity_error.dropna()) == set(two.identity_error) and two.identity_error.max() < 1e-9
    assert not set(got.vec_id.dropna()) & {4, 5, 6, 7, 8}
    three = got[got.vec_id > 8]
    assert len(three) == 6 and set(three.n) == {2} and three[three.component == 1].whitened.abs().tolist() == [1.0, 1.0]
    assert three[three.component > 1].whitened.isna().all() and three[three.component == 1].explained.tolist() == [1.0, 1.0]
    assert whitening.whiten(frame.limit(0)).count() == 0
    one = whitening.whiten(frame.where("vec_id = 2")).toPandas()
    assert one.whitened.isna().all() and one.deviation.tolist() == [0, 0] and one.explained.tolist() == [0.0, 0.0]


def test_deviations_beyond_a_long(spark):
    rows = [(1, [1e15, 0.0]), (2, [-1e15, 3.0]), (3, [1e300, 1.0])]
    got = whitening.whiten(spark.createDataFrame(rows[:2], "vec_id long, embedding array<double>")).toPandas()
    x = [[int(64 * c // 1) + 1_000_000 for c in v] for _, v in rows[:2]]
    want = [sum((2 * x[i][k] - x[0][k] - x[1][k]) ** 2 for k in range(2)) for i in range(2)]
    assert got.deviation.isna().all() and [int(v) for v in got[got.component == 1].deviation_wide] == want
    assert whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).count() == 6
