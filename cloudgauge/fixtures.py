"""Clouds derived from the driver's `orders` table: two posed scans and a reconstruction.

The first pair: all coordinates are multiples of 2**-14 below 16, so FLOAT holds them exactly. The rough
pair: coordinates and oblique poses that FLOAT rounds, and points that are not finite.
"""

from __future__ import annotations

from math import cos, sin

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Settings
from .plans.scoring import to_global

SETTINGS = Settings((0.01, 0.02, 0.05, 0.1, 0.2, 0.5), voxel_size=0.5)
#: Mesh-to-global poses, row-major: the identity, and a quarter turn about z with a shift.
POSES = {
    0: [1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0],
    1: [0.0, -1.0, 0.0, 4.0, 1.0, 0.0, 0.0, -4.0, 0.0, 0.0, 1.0, 0.5, 0.0, 0.0, 0.0, 1.0],
}
#: By customer modulo 8: 256 times the factor along the ray, and the shift of z.
FACTORS, LIFTS = (256, 257, 255, 260, 252, 288, 224, 256), (0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.125)


def _local(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.col("o_orderkey").alias("point_id"),
        F.col("o_custkey").alias("c"),
        F.expr("CAST(o_orderkey % 2 AS INT)").alias("scan_id"),
        F.expr("4 + ((37 * o_orderkey + o_custkey) % 64) / 64").alias("x"),
        F.expr("(o_orderkey % 512) / 64 - 4").alias("y"),
        F.expr("((7 * (o_orderkey DIV 512) + 53 * o_orderkey) % 256) / 64 - 2").alias("z"),
    )


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(point_id, scan_id, x, y, z) in scanner coordinates."""
    return _local(spark, sf_dir).select("point_id", "scan_id", *(F.col(c).cast("float").alias(c) for c in "xyz"))


def reconstruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(point_id, x, y, z) in the global frame: every third scan point, moved along its ray or up."""
    p = _local(spark, sf_dir).where("point_id % 3 = 0")
    at = (F.col("c") % 8).cast("int") + 1
    f = F.element_at(F.array(*[F.lit(v / 256) for v in FACTORS]), at)
    lift = F.element_at(F.array(*[F.lit(v) for v in LIFTS]), at)
    x, y, z = F.col("x") * f, F.col("y") * f, F.col("z") * f + lift
    second = F.col("scan_id") == 1
    return p.select("point_id", F.when(second, 4 - y).otherwise(x).cast("float").alias("x"), F.when(second, x - 4).otherwise(y).cast("float").alias("y"), F.when(second, z + 0.5).otherwise(z).cast("float").alias("z"))


def _oblique(yaw: float, pitch: float, roll: float, *shift: float) -> list[float]:
    """A row-major pose of three turns about z, y and x and a shift, in float32 values."""
    (cy, sy), (cp, sp), (cr, sr) = ((cos(a), sin(a)) for a in (yaw, pitch, roll))
    rows = [
        [cy * cp, cy * sp * sr - sy * cr, cy * sp * cr + sy * sr, shift[0]],
        [sy * cp, sy * sp * sr + cy * cr, sy * sp * cr - cy * sr, shift[1]],
        [-sp, cp * sr, cp * cr, shift[2]],
    ]
    return [float(np.float32(v)) for row in rows for v in row] + [0.0, 0.0, 0.0, 1.0]


ROUGH_POSES = {0: _oblique(0.7, -0.3, 0.2, 0.3, -1.7, 0.9), 1: _oblique(-2.1, 0.5, 1.1, 2.9, 1.3, -0.4)}
#: By order key modulo 7: factor along the ray.
ROUGH_FACTORS = (1.0, 1.003, 0.997, 1.02, 0.98, 0.9, 1.1)


def rough_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(point_id, scan_id, x, y, z) in scanner coordinates; some are not finite."""
    double = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.col("o_orderkey").alias("point_id"),
        F.expr("CAST(o_orderkey % 2 AS INT)").alias("scan_id"),
        F.expr("CASE WHEN o_orderkey % 97 = 5 THEN double('NaN') ELSE 3.7D + ((37 * o_orderkey + o_custkey) % 1009) / 997.0D * 2.3D END").alias("x"),
        F.expr("CASE WHEN o_orderkey % 101 = 7 THEN double('Infinity') ELSE ((o_orderkey * 7919) % 10007) / 10007.0D * 8.0D - 4.0D END").alias("y"),
        F.expr("CASE WHEN o_orderkey % 103 = 9 THEN double('-Infinity') ELSE ((53 * o_orderkey + 7 * (o_orderkey DIV 512)) % 2003) / 2003.0D * 4.0D - 2.0D END").alias("z"),
    )
    return double.select("point_id", "scan_id", *(F.col(c).cast("float").alias(c) for c in "xyz"))


def rough_reconstruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(point_id, x, y, z) in the global frame: every third scan point, moved along its ray."""
    p = rough_scans(spark, sf_dir).where("point_id % 3 = 0")
    f = F.element_at(F.array(*[F.lit(v).cast("float") for v in ROUGH_FACTORS]), (F.col("point_id") % 7).cast("int") + 1)
    return to_global(p.withColumns({c: F.col(c) * f for c in "xyz"}), ROUGH_POSES).drop("scan_id")


def crowded(points: DataFrame) -> DataFrame:
    """A cloud with all but a hundredth of its points in one corner, a 256th as wide as the cloud; scaling is exact."""
    return points.withColumns({c: F.when(F.col("point_id") % 100 == 3, F.col(c)).otherwise((F.col(c) / 256).cast("float")) for c in "xyz"})


def scaled(points: DataFrame, factor: float) -> DataFrame:
    return points.withColumns({c: (F.col(c) * F.lit(factor)).cast("float") for c in "xyz"})
