"""Tallies over two voxel grids shifted by half a voxel, and their macro-average."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .geometry import f32, integer_root, voxel

SHIFTS = (0.0, 0.5)
CELL = ("grid_id", "vx", "vy", "vz")
#: One voxel in so many is counted by an estimate; clouds of so few points are not estimated.
SAMPLE_RATE, SMALL_CLOUD = 128, 1 << 16
HASH_PRIME = 2**31 - 1


def in_both_grids(points: DataFrame, inverse: float) -> DataFrame:
    """Each point once a grid, with its voxel (grid_id, vx, vy, vz); shifts are in voxels."""
    grids = F.explode(F.array(*[F.struct(F.lit(k).alias("grid_id"), f32(s).alias("shift")) for k, s in enumerate(SHIFTS)]))
    out = points.withColumn("_g", grids)
    return out.select(*points.columns, F.col("_g.grid_id").alias("grid_id"), *(voxel(F.col(c), inverse, F.col("_g.shift")).alias(f"v{c}") for c in "xyz"))


def tally(points: DataFrame, inverse: float, **counts: Column) -> DataFrame:
    """Points of each voxel for which a condition holds, one column a condition; one partial and one final aggregation."""
    return in_both_grids(points, inverse).groupBy(*CELL).agg(*(F.count_if(c).alias(n) for n, c in counts.items()))


def cell_hash(x: Column, y: Column, z: Column) -> Column:
    """A hash of a voxel below HASH_PRIME: a linear form, then two quadratic rounds. BIGINT arithmetic that SQL engines share."""
    h = F.pmod(x.cast("long") * 73856093 + y.cast("long") * 19349663 + z.cast("long") * 83492791, F.lit(HASH_PRIME))
    for factor in (48271, 69621):
        h = F.pmod(h * h + h * factor + 12345, F.lit(HASH_PRIME))
    return h


def approximate_cells(points: DataFrame, inverse: float, rate: int = SAMPLE_RATE, exact_upto: int = SMALL_CLOUD) -> DataFrame:
    """(grid_id, cells): estimated numbers of occupied voxels by grid, raised by five standard deviations.

    One in `rate` voxels is counted, chosen by a hash of the voxel alone, so that crowded voxels weigh no
    more than others; the count is then binomial. No estimate exceeds the number of points, which is given
    itself for clouds of `exact_upto` points at most. An empty cloud has no cells.
    """
    kept = in_both_grids(points, inverse).select(*CELL)
    sampled = kept.where(cell_hash(*(F.col(c) for c in CELL[1:])) < HASH_PRIME // rate).groupBy(*CELL).agg(F.lit(1).alias("one"))
    number = points.agg(F.count(F.lit(1)).alias("n"))
    grids = number.select("n", F.explode(F.array(*[F.lit(k) for k in range(len(SHIFTS))])).alias("grid_id"))
    counts = sampled.groupBy("grid_id").agg(F.count(F.lit(1)).alias("taken"))
    both = grids.join(F.broadcast(counts), "grid_id", "left").withColumn("taken", F.coalesce("taken", F.lit(0)))  # a row a grid
    estimate = F.col("taken") * rate + integer_root(F.col("taken") * (25 * rate * (rate - 1))) + 1
    return both.select("grid_id", F.when(F.col("n") <= exact_upto, F.col("n")).otherwise(F.least("n", estimate)).alias("cells"))
