"""Geometry as Column expressions.

Coordinates and squared distances are FLOAT, as Spark keeps FLOAT through +, - and * of FLOATs;
what Spark widens (division, roots, literals) is cast back. Sums go from left to right, x, y, z.
Angles serve to find candidates only and are DOUBLE.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least and largest voxel coordinate; what lies beyond is clamped.
INT_MIN, INT_MAX = -(2**31), 2**31 - 1
GREEN, RED, BLUE = (0, 255, 0), (255, 0, 0), (0, 0, 255)


def f32(value: float | Column) -> Column:
    return (value if isinstance(value, Column) else F.lit(float(value))).cast("float")


def squared_norm(x: Column, y: Column, z: Column) -> Column:
    return (x * x + y * y) + z * z


def norm(x: Column, y: Column, z: Column) -> Column:
    return f32(F.sqrt(squared_norm(x, y, z)))


def squared_distance(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> Column:
    return squared_norm(*(p - q for p, q in zip(a, b, strict=True)))


def finite(*columns: Column) -> Column:
    """Whether all are finite; each is named once, as a filter computes what it names anew at each place."""
    return reduce(lambda a, b: a & b, [F.abs(c) < float("inf") for c in columns], F.lit(True))  # Spark holds NaN to be above infinity


def apart(df: DataFrame) -> DataFrame:
    """The rows as they are, behind a generator, so that Spark does not copy the expressions of their columns to each place that names them.

    Filters on derived columns otherwise grow into methods of over 8,000 bytes, which the JVM does not compile but interprets.
    """
    return df.select(F.inline(F.array(F.struct("*"))))


def unit(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Direction of a vector; the zero vector stays as it is."""
    r = norm(x, y, z)
    return tuple(F.when(r > 0, f32(c / r)).otherwise(c) for c in (x, y, z))


def affine(m: list[float], x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Rows 0 to 2 of a row-major 4 x 4 matrix, applied to a point."""
    return tuple(f32(m[4 * r]) * x + f32(m[4 * r + 1]) * y + f32(m[4 * r + 2]) * z + f32(m[4 * r + 3]) for r in range(3))


def inverse_rigid(m: Iterable[float]) -> list[float]:
    """Inverse of a pose whose rotation is taken to be orthonormal: R', then -R't, in float32."""
    a = np.array(list(m), np.float32).reshape(4, 4)
    r = a[:3, :3].T
    t = -a[:3, 3]
    out = np.eye(4, dtype=np.float32)
    out[:3, :3] = r
    for k in range(3):
        out[k, 3] = np.float32(np.float32(r[k, 0] * t[0] + r[k, 1] * t[1]) + r[k, 2] * t[2])
    return [float(v) for v in out.ravel()]


def voxel(c: Column, inverse: float, shift: Column | float) -> Column:
    """Voxel coordinate: float32 c * inverse + shift, then floor; clamped to 32 bits, NaN to 0."""
    place = F.floor(c * f32(inverse) + f32(shift))
    return F.least(F.greatest(place, F.lit(INT_MIN)), F.lit(INT_MAX)).cast("int")


def azimuth(x: Column, y: Column) -> Column:
    return F.atan2(y.cast("double"), x.cast("double"))


def inclination(z: Column, radius: Column) -> Column:
    """0 to pi; 0 at the origin."""
    return F.when(radius > 0, F.acos(F.greatest(F.least(z.cast("double") / radius.cast("double"), F.lit(1.0)), F.lit(-1.0)))).otherwise(F.lit(0.0))


def beam_radius(distance: Column, start: float, tangent: float) -> Column:
    return f32(start) + distance * f32(tangent)


def band(d2: Column, squared: tuple[float, ...]) -> Column:
    """Completeness band: the first tolerance that holds d2, strictly below the largest; else their number."""
    out = F.lit(len(squared))
    for k in range(len(squared) - 1, -1, -1):
        out = F.when(d2 <= f32(squared[k]), F.lit(k)).otherwise(out)
    return F.when(d2.isNotNull() & (d2 < f32(squared[-1])), out).otherwise(F.lit(len(squared)))


def first_within(d2: Column, squared: tuple[float, ...]) -> Column:
    """Accuracy index: the first tolerance that holds d2, the largest included; else their number."""
    out = F.lit(len(squared))
    for k in range(len(squared) - 1, -1, -1):
        out = F.when(d2 <= f32(squared[k]), F.lit(k)).otherwise(out)
    return F.when(d2.isNotNull(), out).otherwise(F.lit(len(squared)))


def f1(p: Column, r: Column) -> Column:
    """Harmonic mean in float32; 0 if neither is above 0; NaN stays NaN."""
    return F.when((p <= 0) & (r <= 0), f32(0)).otherwise(f32((f32(2) * p * r) / (p + r)))


def integer_root(n: Column) -> Column:
    """Largest whole number whose square is not above n, for whole n from 0 to below 2**62."""
    near = F.floor(F.sqrt(n.cast("double"))).cast("long")  # one off at most
    return F.when(near * near > n, near - 1).when((near + 1) * (near + 1) <= n, near + 1).otherwise(near)


def coloured(df: DataFrame, colour: Column) -> DataFrame:
    """Adds red, green, blue from an array column."""
    return df.withColumn("_c", colour).withColumns({n: F.col("_c")[k].cast("short") for k, n in enumerate(("red", "green", "blue"))}).drop("_c")


def rgb(colour: tuple[int, int, int]) -> Column:
    return F.array(*[F.lit(c) for c in colour])
