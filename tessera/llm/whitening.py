"""Whitening of embeddings: streaming moments, merged in a tree, and a symmetric QR eigen-solve.

Entries become whole numbers, x = floor(64 * c) + 1000000, so counts and sums are exact. The fit list holds each distinct x once. Every partition's
iterator updates (n, sum, mean, M2) by Welford's rank-one step, a vector at a time: nothing but d * d numbers is held. States of partitions are
merged by the parallel formula, FAN at a time and in order of partition, until FAN or fewer are left; only these reach the driver, whatever the table's size. There the
covariance, d * d, is brought to tridiagonal form by reflections and solved by implicit QR steps.

Vectors of different lengths have no common covariance: each length is a fit list of its own and is whitened by itself.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, drop_path, new_path

#: x = floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Entries beyond are held at this, so that x is a long.
MOST = 9.2e18
#: States that one task merges.
FAN = 32
#: An eigenvalue of at most this times the dimension and the largest one is no direction: numbers of that size are rounding.
NOTHING = 2.0**-50
_STATE = "d int, part int, n long, sums array<string>, mean array<double>, m2 array<double>"
_STATE_ARROW = pa.schema([("d", pa.int32()), ("part", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.string())), ("mean", pa.list_(pa.float64())), ("m2", pa.list_(pa.float64()))])


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, x array<long>) of rows whose vector is not null and holds neither nulls nor non-finite entries. Rows without an id stay; empty vectors go."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("_c"))
    fine = F.forall("_c", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    held = lambda c: F.greatest(F.least(c * SCALE, F.lit(MOST)), F.lit(-MOST))
    return v.where(F.col("_c").isNotNull() & (F.size("_c") > 0) & F.coalesce(fine, F.lit(False))).select("vec_id", F.transform("_c", lambda c: F.floor(held(c)) + F.lit(SHIFT)).alias("x"))


class Moments:
    """n, exact sums, mean and M2, the sum of outer products of deviations, of the vectors seen so far."""

    def __init__(self, d: int):
        self.n, self.sums, self.mean, self.m2 = 0, [0] * d, np.zeros(d), np.zeros((d, d))
        self._high, self._low, self._outer = np.zeros(d, np.int64), np.zeros(d, np.int64), np.zeros((d, d))

    def add(self, x: np.ndarray) -> None:
        """Welford's step for one vector of whole numbers."""
        self.n += 1
        before = x - self.mean
        self.mean += before / self.n
        np.multiply.outer(before, x - self.mean, out=self._outer)
        self.m2 += self._outer

    def add_all(self, rows: np.ndarray) -> None:
        """The rows of an integer matrix, one after another. Sums are exact: halves of 32 bits are added apart."""
        self._high += (rows >> 32).sum(axis=0)
        self._low += (rows & 0xFFFFFFFF).sum(axis=0)
        for x in rows.astype(np.float64):
            self.add(x)
        self.sums = [s + (int(h) << 32) + int(low) for s, h, low in zip(self.sums, self._high, self._low, strict=True)]
        self._high[:], self._low[:] = 0, 0

    def merge(self, other: Moments) -> None:
        """The moments of both lists: the parallel form of Welford's step."""
        if not other.n:
            return
        n = self.n + other.n
        gap = other.mean - self.mean
        self.m2 += other.m2 + np.multiply.outer(gap, gap) * (self.n / n * other.n)
        self.mean = self.mean + gap * (other.n / n)
        self.n, self.sums = n, [a + b for a, b in zip(self.sums, other.sums, strict=True)]

    def covariance(self) -> np.ndarray:
        return (self.m2 + self.m2.T) / (2 * self.n)

    def row(self, length: int, part: int) -> tuple:
        return length, part, self.n, [str(s) for s in self.sums], self.mean.tolist(), self.m2.ravel().tolist()

    @staticmethod
    def of(row: dict) -> Moments:
        d = len(row["mean"])
        out = Moments(d)
        out.n, out.sums, out.mean, out.m2 = row["n"], [int(s) for s in row["sums"]], np.array(row["mean"], float), np.array(row["m2"], float).reshape(d, d)
        return out


def _states_of(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_STATE_ARROW)], schema=_STATE_ARROW)


def by_length(column: pa.Array):
    """(rows, matrix) for each length among the lists of a column of whole numbers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *np.diff(column.offsets.to_numpy())])
    sizes = np.diff(ends)
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        yield rows, flat[ends[rows][:, None] + np.arange(d)]


def moments(vectors: DataFrame, add) -> dict[int, Moments]:
    """Of each length of the lists in column x, the moments of what add(states, x matrix) puts into states[length].

    Partitions stream through one iterator each; their states are merged in a tree.
    """

    def partition(batches):
        from pyspark import TaskContext

        states: dict[int, Moments] = {}
        for b in batches:
            for _, x in by_length(b.column(0)):
                add(states, x)
        part = TaskContext.get().partitionId()
        for d in sorted(states):
            yield _states_of([states[d].row(d, part)])

    def merged(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("part").to_pylist()
        total = Moments.of(rows[0])
        for r in rows[1:]:
            total.merge(Moments.of(r))
        return pa.Table.from_batches([_states_of([total.row(rows[0]["d"], rows[0]["part"] // FAN)])])

    states = cut(vectors.select("x").mapInArrow(partition, _STATE))
    most = states.agg(F.max("part")).first()[0]
    while most is not None and most >= FAN:
        groups = states.withColumn("g", F.floor(F.col("part") / FAN)).groupBy("d", "g")
        states = cut(groups.applyInArrow(lambda t: merged(t.drop_columns("g")), _STATE))
        most //= FAN
    out: dict[int, Moments] = {}
    for r in sorted((r.asDict() for r in states.collect()), key=lambda r: (r["d"], r["part"])):
        own = Moments.of(r)
        out.setdefault(r["d"], Moments(len(own.sums))).merge(own)
    return out


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix: Householder reflections, then QR steps with Wilkinson's shift."""
    n = len(a)
    t, q = np.array(a, float), np.eye(n)
    for k in range(n - 2):
        v = t[k + 1 :, k].copy()
        length = np.linalg.norm(v)
        if length == 0 or not v[1:].any():
            continue
        v[0] += np.copysign(length, v[0])
        v /= np.linalg.norm(v)
        t[k + 1 :] -= 2 * np.outer(v, v @ t[k + 1 :])
        t[:, k + 1 :] -= 2 * np.outer(t[:, k + 1 :] @ v, v)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    d, e, rows = np.diag(t).tolist(), np.diag(t, -1).tolist(), np.ascontiguousarray(q.T)
    end, left = n - 1, 60 * n
    while end > 0:
        if abs(e[end - 1]) <= 2.0**-53 * (abs(d[end]) + abs(d[end - 1])) or e[end - 1] == 0:
            e[end - 1] = 0.0
            end -= 1
            continue
        left -= 1
        if left < 0:
            raise ArithmeticError("the QR steps do not converge")
        begin = end - 1
        while begin > 0 and abs(e[begin - 1]) > 2.0**-53 * (abs(d[begin]) + abs(d[begin - 1])):
            begin -= 1
        half = (d[end - 1] - d[end]) / 2
        shift = d[end] - e[end - 1] ** 2 / (half + np.copysign(np.hypot(half, e[end - 1]), half))
        x, z = d[begin] - shift, e[begin]
        for k in range(begin, end):
            r = float(np.hypot(x, z))
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > begin:
                e[k - 1] = r
            p, b, w = d[k], e[k], d[k + 1]
            d[k], d[k + 1], e[k] = c * c * p + 2 * c * s * b + s * s * w, s * s * p - 2 * c * s * b + c * c * w, c * s * (w - p) + (c * c - s * s) * b
            if k < end - 1:
                x, z, e[k + 1] = e[k], s * e[k + 1], c * e[k + 1]
            rows[k], rows[k + 1] = c * rows[k] + s * rows[k + 1], c * rows[k + 1] - s * rows[k]
    order = np.argsort(-np.array(d), kind="stable")
    return np.array(d)[order], rows[order].T


class Whitener:
    """Of one length: n, exact sums, unit components (rows), eigenvalues and shares of the trace, up to ``components`` of them."""

    def __init__(self, m: Moments, components: int):
        values, vectors = eigen(m.covariance())
        keep = min(components, len(values))
        self.n, self.sums, self.trace = m.n, m.sums, float(np.trace(m.covariance()))
        self.axes, self.values = np.ascontiguousarray(vectors.T[:keep]), values[:keep]
        self.real = self.values > NOTHING * len(values) * max(float(values[0]), 0.0)
        self.explained = np.maximum(self.values, 0.0) / self.trace if self.trace > 0 else np.zeros(keep)
        self.centre = [divmod(s, m.n) for s in m.sums]

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n in double: the whole part of the mean is taken off exactly."""
        whole = np.array([w for w, _ in self.centre], dtype=object)
        apart = (x - whole.astype(np.int64)).astype(np.float64) if np.abs(x).max(initial=0) < 2**62 else (x.astype(object) - whole).astype(np.float64)
        return apart - np.array([r / self.n for _, r in self.centre])

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """[rows, components]; NaN in components without variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.real, self.centred(x) @ self.axes.T / np.sqrt(np.where(self.real, self.values, 1.0)), np.nan)

    def deviations(self, x: np.ndarray) -> list[int]:
        """The sum over dimensions of (n * x - S)^2, exact at any size."""
        d = x.shape[1]
        reach = max(self.n * int(np.abs(x).max(initial=0)), max(map(abs, self.sums)))
        if reach < 2**62:
            y = self.n * x - np.array(self.sums, np.int64)
            if d * int(np.abs(y).max(initial=0)) ** 2 < 2**63:
                return (y * y).sum(axis=1).tolist()
        y = self.n * x.astype(object) - np.array(self.sums, dtype=object)
        return (y * y).sum(axis=1).tolist()


def fit(vectors: DataFrame, components: int = 16) -> tuple[dict[int, Whitener], dict[int, float]]:
    """(model of each length, identity error of each length).

    The error is measured on the fit list: the whitened vectors' own covariance, again by rank-one steps and merges, against the identity, over the components that have variance.
    """
    spark = vectors.sparkSession
    path = new_path(spark, "fit-list")
    whole_vectors(vectors).select("x").distinct().write.parquet(path)
    listed = spark.read.parquet(path)
    model = {d: Whitener(m, components) for d, m in moments(listed, lambda states, x: states.setdefault(x.shape[1], Moments(x.shape[1])).add_all(x)).items()}
    given = spark.sparkContext.broadcast(model)

    def add(states: dict[int, Moments], x: np.ndarray) -> None:
        w = given.value[x.shape[1]]
        into = states.setdefault(x.shape[1], Moments(int(w.real.sum())))
        for y in w.whiten(x)[:, w.real]:
            into.add(y)

    errors = {d: float(np.abs(m.covariance() - np.eye(len(m.sums))).max(initial=0.0)) for d, m in moments(listed, add).items()}
    drop_path(spark, path)
    return model, errors


_OUT = "vec_id long, component int, n long, deviation long, deviation_wide decimal(38,0), whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, components: int = 16) -> DataFrame:
    """vec_id, component (from 1), n, deviation, deviation_wide, whitened, explained, identity_error: a row for each usable vector and component.

    Rows whose vector is null, empty or holds null or non-finite entries give nothing; a null id is kept; repeated rows each give rows and count once in the fit list.
    Vectors of a length are whitened by the fit list of that length, with as many components as it has dimensions, ``components`` at most. A component without variance
    (one distinct vector, fewer vectors than dimensions) has a null whitened, and explains 0. A deviation beyond a long is null, and stands in deviation_wide, which is null else
    (and null beyond 38 digits). Entries beyond 9.2e18/64 are held at that. An empty table gives an empty result. Only vec_id and embedding are read.
    """
    spark = vectors.sparkSession
    given = spark.sparkContext.broadcast(fit(vectors, components))
    schema = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("deviation_wide", pa.decimal128(38, 0)), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])

    def run(batches):
        model, errors = given.value
        for b in batches:
            for rows, x in by_length(b.column(1)):
                w, d = model[x.shape[1]], x.shape[1]
                k, whole = len(w.values), w.deviations(x)
                ids = b.column(0).take(pa.array(rows)).take(pa.array(np.repeat(np.arange(len(rows)), k)))
                white = w.whiten(x).ravel()
                fits = [v if v < 2**63 else None for v in whole]
                wide = [None if v < 2**63 or v >= 10**38 else Decimal(v) for v in whole]
                each = pa.array(np.repeat(np.arange(len(rows)), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids,
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))),
                        pa.array(np.full(len(rows) * k, w.n)),
                        pa.array(fits, pa.int64()).take(each),
                        pa.array(wide, pa.decimal128(38, 0)).take(each),
                        pa.array(white, pa.float64(), mask=np.isnan(white)),
                        pa.array(np.tile(w.explained, len(rows))),
                        pa.array(np.full(len(rows) * k, errors.get(d, 0.0))),
                    ],
                    schema=schema,
                )

    return whole_vectors(vectors).mapInArrow(run, _OUT)
