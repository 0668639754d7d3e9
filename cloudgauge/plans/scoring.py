"""Completeness, accuracy and F1 as DataFrame plans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.geometry import BLUE, GREEN, RED, affine, band, coloured, f1, f32, first_within, rgb
from ..functions.voxels import CELL, tally
from ..operators.beam import nearest_seen
from ..operators.nearest import SLACK, nearest_squared_distance, verified
from ..operators.stored import StoredCandidates, nearest_stored

UNOBSERVED, ACCURATE, INACCURATE = 0, 1, 2


def to_global(scans: DataFrame, poses: dict[int, list[float]]) -> DataFrame:
    """Scan points (scan_id, x, y, z, ...) moved to the global frame, all scans together; duplicates are kept."""
    new = [reduce(lambda out, p: F.when(F.col("scan_id") == p[0], affine(p[1], *(F.col(c) for c in "xyz"))[k]).otherwise(out), poses.items(), F.lit(None).cast("float")) for k in range(3)]
    return scans.withColumns(dict(zip("xyz", new, strict=True)))


def completeness_bands(scan_points: DataFrame, reconstruction: DataFrame, settings: Settings, index: str = "auto", counters: Observation | None = None) -> DataFrame:
    """scan_points (global x, y, z, ...) with `band`, the first tolerance index that holds the nearest reconstruction point, or their number. counters: of a comparison with the kd-tree, made in the same pass."""
    near = nearest_squared_distance(scan_points, reconstruction, settings.tolerances[-1] * SLACK, index=index, trees=counters is None)
    if counters is not None:
        near = verified(near, reconstruction, settings.squared, counters)
    return near.withColumn("band", band(F.col("d2"), settings.squared)).drop("d2")


def stored_bands(scan_points: DataFrame, index: StoredCandidates, settings: Settings) -> DataFrame:
    """completeness_bands over a stored index of the reconstruction."""
    near = nearest_stored(scan_points, index, settings.tolerances[-1] * SLACK)
    return near.withColumn("band", band(F.col("d2"), settings.squared)).drop("d2")


def completeness_cells(bands: DataFrame, settings: Settings) -> DataFrame:
    """(grid_id, vx, vy, vz, n, c0, c1, ...): points of each voxel, and those complete at each tolerance."""
    return tally(bands, settings.voxel_inverse, n=F.lit(True), **{f"c{t}": F.col("band") <= t for t in range(len(settings.tolerances))})


def _by_tolerance(row: DataFrame, settings: Settings, name: str) -> DataFrame:
    """One row a tolerance from a row with columns t0, t1, ..."""
    each = F.array(*[F.struct(F.lit(t).alias("tolerance_index"), f32(v).alias("tolerance"), F.col(f"t{t}").alias(name)) for t, v in enumerate(settings.tolerances)])
    return row.select(F.explode(each).alias("e")).select("e.*")


def completeness(bands: DataFrame, settings: Settings) -> DataFrame:
    """(tolerance_index, tolerance, completeness): mean over the voxels of both grids of their shares; NaN without points."""
    cells = completeness_cells(bands, settings)
    ratio = lambda t: F.col(f"c{t}") / F.col("n").cast("double")
    sums = cells.agg(F.count(F.lit(1)).alias("cells"), *(F.sum(ratio(t)).alias(f"s{t}") for t in range(len(settings.tolerances))))
    means = sums.select(*(f32(F.when(F.col("cells") > 0, F.col(f"s{t}") / F.col("cells")).otherwise(F.lit(float("nan")))).alias(f"t{t}") for t in range(len(settings.tolerances))))
    return _by_tolerance(means, settings, "completeness")


def first_and_front(points: DataFrame, scans: DataFrame | None, poses: dict[int, list[float]], settings: Settings, key: str = "point_id", rays: DataFrame | None = None) -> DataFrame:
    """points (key, x, y, z, ...) with `first`, the first tolerance index of a scan point that sees them, or their number, and `front`.

    Pairs are aggregated by coordinates first, so the points' columns take no part in that; points that no ray
    sees stay. rays: of the scans, where they are stored.
    """
    best = nearest_seen(points, scans, poses, settings.beam_start, settings.beam_tangent, rays).withColumnsRenamed({c: f"_{c}" for c in (*"xyz", "d2", "front")})
    seen = points.join(best, [F.col(c) == F.col(f"_{c}") for c in "xyz"], "left")
    return seen.select(*points.columns, first_within(F.col("_d2"), settings.squared).alias("first"), F.coalesce("_front", F.lit(False)).alias("front"))


def class_at(t: int | Column) -> Column:
    """Class code at a tolerance index: accurate, else inaccurate if the point was before a surface, else unobserved."""
    return F.when(F.col("first") <= t, ACCURATE).when(F.col("front"), INACCURATE).otherwise(UNOBSERVED).cast("byte")


def accuracy_cells(seen: DataFrame, settings: Settings) -> DataFrame:
    """(grid_id, vx, vy, vz, a0, i0, a1, i1, ...): accurate and inaccurate points of each voxel at each tolerance."""
    counts = {}
    for t in range(len(settings.tolerances)):
        counts[f"a{t}"] = F.col("first") <= t
        counts[f"i{t}"] = (F.col("first") > t) & F.col("front")
    return tally(seen, settings.voxel_inverse, **counts)


def accuracy_ratio(t: int) -> Column:
    """float32 share of a voxel, null where it has no observed point at this tolerance."""
    a, i = F.col(f"a{t}"), F.col(f"i{t}")
    return F.when(a + i > 0, f32(f32(a) / f32(a + i)))


def accuracy(seen: DataFrame, settings: Settings) -> DataFrame:
    """(tolerance_index, tolerance, accuracy): mean over the voxels of both grids that have observed points at that tolerance; 0 without any."""
    cells = accuracy_cells(seen, settings)
    means = cells.agg(*(f32(F.coalesce(F.avg(accuracy_ratio(t).cast("double")), F.lit(0.0))).alias(f"t{t}") for t in range(len(settings.tolerances))))
    return _by_tolerance(means, settings, "accuracy")


def scores(bands: DataFrame, seen: DataFrame, settings: Settings) -> DataFrame:
    """(tolerance_index, tolerance, completeness, accuracy, f1)."""
    both = completeness(bands, settings).join(accuracy(seen, settings).drop("tolerance"), "tolerance_index")
    return both.withColumn("f1", f1(F.col("accuracy"), F.col("completeness")))


def scored(complete: dict[int, float], seen: DataFrame, settings: Settings) -> DataFrame:
    """scores, where the completenesses by tolerance index are known."""
    known = reduce(lambda out, c: F.when(F.col("tolerance_index") == c[0], f32(c[1])).otherwise(out), complete.items(), f32(float("nan")))
    return accuracy(seen, settings).withColumn("completeness", known).withColumn("f1", f1(F.col("accuracy"), F.col("completeness")))


def at_each_tolerance(df: DataFrame, settings: Settings, **columns) -> DataFrame:
    """Rows once a tolerance, with columns made by functions of its index."""
    each = F.array(*[F.struct(F.lit(t).alias("tolerance_index"), *(f(t).alias(n) for n, f in columns.items())) for t in range(len(settings.tolerances))])
    return df.withColumn("_e", F.explode(each)).select(*df.columns, "_e.*")


def completeness_colours(bands: DataFrame, t: int) -> DataFrame:
    """Complete points green, others red."""
    return coloured(bands, F.when(F.col("band") <= t, rgb(GREEN)).otherwise(rgb(RED)))


def accuracy_colours(seen: DataFrame, t: int) -> DataFrame:
    """Accurate points green, inaccurate red, unobserved blue."""
    code = class_at(t)
    return coloured(seen, F.when(code == ACCURATE, rgb(GREEN)).when(code == INACCURATE, rgb(RED)).otherwise(rgb(BLUE)))


def running_counts(df: DataFrame, place: Column, number: int, cell: tuple[str, ...] = CELL) -> DataFrame:
    """Long form of the tallies: by cell and index, points at it, and running sums up to it and after it."""
    from pyspark.sql import Window

    counts = df.groupBy(*cell, place.alias("place")).agg(F.count(F.lit(1)).alias("points"))
    order = Window.partitionBy(*cell).orderBy("place")
    return counts.where(F.col("place") < number).withColumns({"upto": F.sum("points").over(order.rowsBetween(Window.unboundedPreceding, 0)), "after": F.coalesce(F.sum("points").over(order.rowsBetween(1, Window.unboundedFollowing)), F.lit(0))})


def empty_points(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "point_id long, x float, y float, z float")
