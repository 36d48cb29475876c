"""Rigid transforms as column expressions.

A rotation is an array of 9 doubles and a transform an array of 16, row by row; a quaternion is
an array [w, x, y, z]; a vector is an array of 3. Literal matrices may be given as Python lists.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-10


def matrix(values) -> Column:
    """A literal of nested or flat Python numbers."""
    flat = [float(v) for row in values for v in (row if hasattr(row, "__len__") else [row])]
    return F.array(*[F.lit(v) for v in flat])


def _hold(value: Column, body) -> Column:
    """body over a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def multiply(a: Column, b: Column, n: int = 4) -> Column:
    """The product of two n by n matrices; each factor is computed once."""

    def body(m: Column) -> Column:
        x, y = m.x, m.y
        return F.array(*[sum((x[n * i + k] * y[n * k + j] for k in range(1, n)), x[n * i] * y[j]) for i in range(n) for j in range(n)])

    return _hold(F.struct(a.alias("x"), b.alias("y")), body)


def product_entry(a: Column, b: Column, i: int, j: int, n: int = 4) -> Column:
    """One number of multiply(a, b), for plans that need few of them."""
    return sum((a[n * i + k] * b[n * k + j] for k in range(1, n)), a[n * i] * b[j])


def apply_to_point(t: Column, x: Column, y: Column, z: Column) -> Column:
    """struct<x,y,z> of a transform applied to a point."""
    row = lambda i: t[4 * i] * x + t[4 * i + 1] * y + t[4 * i + 2] * z + t[4 * i + 3]
    return F.struct(row(0).alias("x"), row(1).alias("y"), row(2).alias("z"))


def inverse(t: Column) -> Column:
    """The general inverse of a 4 by 4 matrix, by cofactors; null if it is singular."""

    def whole(m: Column) -> Column:
        def minor(i: int, j: int) -> Column:
            r, c = [k for k in range(4) if k != i], [k for k in range(4) if k != j]
            e = lambda a, b: m[4 * r[a] + c[b]]
            return e(0, 0) * (e(1, 1) * e(2, 2) - e(1, 2) * e(2, 1)) - e(0, 1) * (e(1, 0) * e(2, 2) - e(1, 2) * e(2, 0)) + e(0, 2) * (e(1, 0) * e(2, 1) - e(1, 1) * e(2, 0))

        cof = F.array(*[minor(j, i) * (1.0 if (i + j) % 2 == 0 else -1.0) for i in range(4) for j in range(4)])
        return _hold(cof, lambda c: F.transform(c, lambda v: F.try_divide(v, m[0] * c[0] + m[1] * c[4] + m[2] * c[8] + m[3] * c[12])))

    return _hold(t, whole)


def rigid(r: Column, tx, ty, tz) -> Column:
    """A transform from a rotation and a translation."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.array(r[0], r[1], r[2], lit(tx), r[3], r[4], r[5], lit(ty), r[6], r[7], r[8], lit(tz), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))


def from_rotation_matrix(r: Column, translation=(0.0, 0.0, 0.0)) -> Column:
    return rigid(r, *translation)


def from_quaternion(q: Column, translation=(0.0, 0.0, 0.0)) -> Column:
    return rigid(quaternion_to_matrix(q), *translation)


def from_translation(tx, ty, tz) -> Column:
    return rigid(matrix([1, 0, 0, 0, 1, 0, 0, 0, 1]), tx, ty, tz)


def rotation_of(t: Column) -> Column:
    return _hold(t, lambda m: F.array(*[m[4 * i + j] for i in range(3) for j in range(3)]))


def sensor_to_sensor(source_to_ego: Column, target_to_ego: Column) -> Column:
    return multiply(inverse(target_to_ego), source_to_ego)


def quaternion_to_matrix(q: Column) -> Column:
    """Rotation of a quaternion that is normalised first; null if its norm is below 1e-10."""
    norm = F.sqrt(q[0] * q[0] + q[1] * q[1] + q[2] * q[2] + q[3] * q[3])

    def body(u: Column) -> Column:
        w, x, y, z = (u[i] for i in range(4))
        return F.array(
            1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w),
            2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w),
            2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y),
        )

    unit = F.when(norm >= EPS, F.array(*[q[i] / norm for i in range(4)]))
    return F.when(norm >= EPS, _hold(unit, body))


def matrix_to_quaternion(r: Column) -> Column:
    """[w, x, y, z] by the branch with the largest of trace and diagonal, normalised."""

    def body(m: Column) -> Column:
        tr = m[0] + m[4] + m[8]
        s0, s1, s2, s3 = (F.sqrt(F.greatest(F.lit(0.0), v)) * 2 for v in (tr + 1, 1 + m[0] - m[4] - m[8], 1 + m[4] - m[0] - m[8], 1 + m[8] - m[0] - m[4]))
        q = (
            F.when(tr > 0, F.array(s0 / 4, F.try_divide(m[7] - m[5], s0), F.try_divide(m[2] - m[6], s0), F.try_divide(m[3] - m[1], s0)))
            .when((m[0] > m[4]) & (m[0] > m[8]), F.array(F.try_divide(m[7] - m[5], s1), s1 / 4, F.try_divide(m[1] + m[3], s1), F.try_divide(m[2] + m[6], s1)))
            .when(m[4] > m[8], F.array(F.try_divide(m[2] - m[6], s2), F.try_divide(m[1] + m[3], s2), s2 / 4, F.try_divide(m[5] + m[7], s2)))
            .otherwise(F.array(F.try_divide(m[3] - m[1], s3), F.try_divide(m[2] + m[6], s3), F.try_divide(m[5] + m[7], s3), s3 / 4))
        )
        return _hold(q, lambda v: F.transform(v, lambda c: c / F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2] + v[3] * v[3])))

    return _hold(r, body)


def quaternion_multiply(a: Column, b: Column) -> Column:
    """Hamilton product."""
    return F.array(
        a[0] * b[0] - a[1] * b[1] - a[2] * b[2] - a[3] * b[3],
        a[0] * b[1] + a[1] * b[0] + a[2] * b[3] - a[3] * b[2],
        a[0] * b[2] - a[1] * b[3] + a[2] * b[0] + a[3] * b[1],
        a[0] * b[3] + a[1] * b[2] - a[2] * b[1] + a[3] * b[0],
    )


def quaternion_from_rotvec(v: Column) -> Column:
    angle = F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
    s = F.try_divide(F.sin(angle / 2), angle)
    small = F.array(F.lit(1.0), v[0] / 2, v[1] / 2, v[2] / 2)
    return F.when(angle < EPS, small).otherwise(F.array(F.cos(angle / 2), v[0] * s, v[1] * s, v[2] * s))


def skew(v: Column) -> Column:
    zero = F.lit(0.0)
    return F.array(zero, -v[2], v[1], v[2], zero, -v[0], -v[1], v[0], zero)


def exp_so3(v: Column) -> Column:
    """Rotation of a rotation vector; below 1e-10 rad the identity plus its skew matrix."""
    angle = F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])

    def body(k: Column) -> Column:
        s, c = F.sin(angle), 1 - F.cos(angle)
        sq = lambda i, j: k[i] * k[j]
        return F.array(
            1 - c * (sq(1, 1) + sq(2, 2)), c * sq(0, 1) - s * k[2], c * sq(0, 2) + s * k[1],
            c * sq(0, 1) + s * k[2], 1 - c * (sq(0, 0) + sq(2, 2)), c * sq(1, 2) - s * k[0],
            c * sq(0, 2) - s * k[1], c * sq(1, 2) + s * k[0], 1 - c * (sq(0, 0) + sq(1, 1)),
        )

    one = F.lit(1.0)
    tiny = F.array(one, -v[2], v[1], v[2], one, -v[0], -v[1], v[0], one)
    return F.when(angle < EPS, tiny).otherwise(_hold(F.array(*[F.try_divide(v[i], angle) for i in range(3)]), body))


def log_so3(r: Column) -> Column:
    """Rotation vector; near pi it loses its direction, as the closed form does."""

    def body(m: Column) -> Column:
        cos = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (m[0] + m[4] + m[8] - 1) / 2))
        return _hold(F.acos(cos), lambda a: F.array(*[(m[p] - m[q]) * F.when(a < EPS, F.lit(0.5)).otherwise(F.try_divide(a, 2 * F.sin(a))) for p, q in ((7, 5), (2, 6), (3, 1))]))

    return _hold(r, body)
