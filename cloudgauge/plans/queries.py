"""The registered queries over the derived clouds, each with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures
from ..config import Settings
from ..functions.geometry import band, beam_radius, finite, integer_root, norm, unit
from ..functions.voxels import CELL, approximate_cells, in_both_grids
from ..operators.beam import AZIMUTH_STEP, AZIMUTHS, INCLINATION_STEP, INCLINATIONS, MOST_BINS, beams, in_scan_frames, scan_rays, seen_pairs
from ..operators.nearest import SLACK, bounding_box, nearest_squared_distance, verify
from ..operators.stored import nearest_stored, open_candidates, open_rays, store_candidates, store_rays
from ..sources.files import opened, shared_path
from ..sources.ply import is_dense, read_cloud, write_coloured
from ..sources.project import check_poses, read_project, read_projects, resolved
from . import scoring
from .cli import load_scans, report, write_coloured_at_each

S = fixtures.SETTINGS
T = range(len(S.tolerances))
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Clouds, poses and constants for the SQL.
_CLOUDS = """
WITH raw AS (
  SELECT o_orderkey AS point_id, o_custkey AS c, CAST(o_orderkey % 2 AS INTEGER) AS scan_id,
         4 + ((37 * o_orderkey + o_custkey) % 64) / 64 AS lx, (o_orderkey % 512) / 64 - 4 AS ly,
         ((7 * (o_orderkey // 512) + 53 * o_orderkey) % 256) / 64 - 2 AS lz
  FROM orders
), local AS (
  SELECT point_id, scan_id, CAST(lx AS FLOAT) AS x, CAST(ly AS FLOAT) AS y, CAST(lz AS FLOAT) AS z FROM raw
), scan AS (
  SELECT point_id, scan_id, CASE WHEN scan_id = 1 THEN CAST(4 AS FLOAT) - y ELSE x END AS x,
         CASE WHEN scan_id = 1 THEN x - CAST(4 AS FLOAT) ELSE y END AS y, CASE WHEN scan_id = 1 THEN z + CAST(0.5 AS FLOAT) ELSE z END AS z
  FROM local
), moved AS (
  SELECT point_id, scan_id, lx * f AS x, ly * f AS y, lz * f + dz AS z
  FROM (SELECT *, [256, 257, 255, 260, 252, 288, 224, 256][CAST(c % 8 AS INTEGER) + 1] / 256 AS f, CASE WHEN c % 8 = 7 THEN 0.125::DOUBLE ELSE 0::DOUBLE END AS dz FROM raw WHERE point_id % 3 = 0)
), recon AS (
  SELECT point_id, CAST(CASE WHEN scan_id = 1 THEN 4 - y ELSE x END AS FLOAT) AS x, CAST(CASE WHEN scan_id = 1 THEN x - 4 ELSE y END AS FLOAT) AS y,
         CAST(CASE WHEN scan_id = 1 THEN z + 0.5::DOUBLE ELSE z END AS FLOAT) AS z
  FROM moved
), framed AS (
  SELECT point_id, 0 AS scan_id, x AS px, y AS py, z AS pz FROM recon
  UNION ALL
  SELECT point_id, 1, y + CAST(4 AS FLOAT), CAST(4 AS FLOAT) - x, z - CAST(0.5 AS FLOAT) FROM recon
)"""
_NORM = "CAST(sqrt(({0}x * {0}x + {0}y * {0}y) + {0}z * {0}z) AS FLOAT)"
_TOL = ", ".join(f"({t}, CAST({S.tolerances[t]!r} AS FLOAT), CAST({S.squared[t]!r} AS FLOAT))" for t in T)
_LAST = f"CAST({S.squared[-1]!r} AS FLOAT)"


def _index(d2: str, strict: bool) -> str:
    cases = " ".join(f"WHEN {d2} <= CAST({S.squared[t]!r} AS FLOAT) THEN {t}" for t in T)
    return f"CASE WHEN {d2} IS NULL{f' OR {d2} >= {_LAST}' if strict else ''} THEN {len(S.tolerances)} {cases} ELSE {len(S.tolerances)} END"


_NEAR = (
    _CLOUDS
    + f""", near AS (
  SELECT s.point_id, s.x, s.y, s.z, n.d2
  FROM scan s LEFT JOIN (
    SELECT s.point_id, min(((s.x - r.x) * (s.x - r.x) + (s.y - r.y) * (s.y - r.y)) + (s.z - r.z) * (s.z - r.z)) AS d2
    FROM scan s JOIN recon r ON r.x BETWEEN s.x - 0.51 AND s.x + 0.51 AND r.y BETWEEN s.y - 0.51 AND s.y + 0.51 AND r.z BETWEEN s.z - 0.51 AND s.z + 0.51
    GROUP BY s.point_id
  ) n ON n.point_id = s.point_id
), banded AS (
  SELECT point_id, x, y, z, CASE WHEN d2 < {_LAST} THEN d2 END AS d2, CAST({_index("d2", True)} AS INTEGER) AS band FROM near
)"""
)
_PLACED = """, {name}_placed AS (
  SELECT *, CAST(floor(x * CAST({inv!r} AS FLOAT) + shift) AS DOUBLE) AS fx, CAST(floor(y * CAST({inv!r} AS FLOAT) + shift) AS DOUBLE) AS fy,
         CAST(floor(z * CAST({inv!r} AS FLOAT) + shift) AS DOUBLE) AS fz
  FROM {name}, (VALUES (0, CAST(0 AS FLOAT)), (1, CAST(0.5 AS FLOAT))) AS g(grid_id, shift)
), {name}_voxels AS (
  SELECT *, CAST(CASE WHEN isnan(fx) THEN 0 ELSE greatest(least(fx, 2147483647), -2147483648) END AS INTEGER) AS vx,
         CAST(CASE WHEN isnan(fy) THEN 0 ELSE greatest(least(fy, 2147483647), -2147483648) END AS INTEGER) AS vy,
         CAST(CASE WHEN isnan(fz) THEN 0 ELSE greatest(least(fz, 2147483647), -2147483648) END AS INTEGER) AS vz
  FROM {name}_placed
)"""
_GRIDS = _PLACED + """, {name}_cells AS (
  SELECT grid_id, vx, vy, vz, {counts} FROM {name}_voxels GROUP BY ALL
)"""
_COMPLETE = _NEAR + _GRIDS.format(name="banded", inv=S.voxel_inverse, counts="count(*) AS n, " + ", ".join(f"count(*) FILTER (band <= {t}) AS c{t}" for t in T))
_SEEN = (
    _CLOUDS
    + f""", rays AS (
  SELECT scan_id, x AS sx, y AS sy, z AS sz, sr, CASE WHEN sr > 0 THEN CAST(x / sr AS FLOAT) ELSE x END AS dx,
         CASE WHEN sr > 0 THEN CAST(y / sr AS FLOAT) ELSE y END AS dy, CASE WHEN sr > 0 THEN CAST(z / sr AS FLOAT) ELSE z END AS dz
  FROM (SELECT *, {_NORM.format("")} AS sr FROM local)
), beam AS (
  SELECT *, CAST({S.beam_start!r} AS FLOAT) + {_NORM.format("p")} * CAST({S.beam_tangent!r} AS FLOAT) AS b FROM framed
), ahead AS (
  SELECT *, (dx * px + dy * py) + dz * pz AS a FROM beam JOIN rays USING (scan_id)
), pairs AS (
  SELECT point_id, ((sx - px) * (sx - px) + (sy - py) * (sy - py)) + (sz - pz) * (sz - pz) AS d2, a < sr AS front FROM ahead
  WHERE a >= CAST(0 AS FLOAT) AND ((px - a * dx) * (px - a * dx) + (py - a * dy) * (py - a * dy)) + (pz - a * dz) * (pz - a * dz) <= b * b
), seen AS (
  SELECT r.point_id, r.x, r.y, r.z, CAST({_index("p.d2", False)} AS INTEGER) AS first, coalesce(p.front, false) AS front
  FROM recon r LEFT JOIN (SELECT point_id, min(d2) AS d2, bool_or(front) AS front FROM pairs GROUP BY point_id) p ON p.point_id = r.point_id
)"""
)
_COUNTS = ", ".join(f"count(*) FILTER (first <= {t}) AS a{t}, count(*) FILTER (first > {t} AND front) AS i{t}" for t in T)
_ACCURATE = _SEEN + _GRIDS.format(name="seen", inv=S.voxel_inverse, counts=_COUNTS)
_CSCORE = f""", tol(tolerance_index, tolerance, sq) AS (VALUES {_TOL}), complete AS (
  {" UNION ALL ".join(f"SELECT {t} AS tolerance_index, CAST(sum(c{t} / n) / count(*) AS FLOAT) AS completeness FROM banded_cells" for t in T)}
)"""
RATIO = "CAST(CAST(a{t} AS FLOAT) / CAST(a{t} + i{t} AS FLOAT) AS FLOAT)"
_ASCORE = ", accurate AS (\n  " + " UNION ALL ".join(f"SELECT {t} AS tolerance_index, CAST(coalesce(avg(CAST({RATIO.format(t=t)} AS DOUBLE)) FILTER (a{t} + i{t} > 0), 0) AS FLOAT) AS accuracy FROM seen_cells" for t in T) + "\n)"
_CLASS = "CASE WHEN first <= {t} THEN 1 WHEN front THEN 2 ELSE 0 END"


def _query(name: str, sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def _scans(spark, d):
    return scoring.to_global(fixtures.scans(spark, d), fixtures.POSES)


def _bands(spark, d):
    return scoring.completeness_bands(_scans(spark, d), fixtures.reconstruction(spark, d), S)


def _seen(spark, d):
    return scoring.first_and_front(fixtures.reconstruction(spark, d), fixtures.scans(spark, d), fixtures.POSES, S)


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in columns})


@_query("scan_points_global", _CLOUDS + " SELECT * FROM scan")
def scan_points_global(spark, d):
    return _scans(spark, d)


@_query("recon_points_scan_frame", _CLOUDS + " SELECT * FROM framed")
def recon_points_scan_frame(spark, d):
    return in_scan_frames(fixtures.reconstruction(spark, d), fixtures.POSES)


@_query("voxel_counts", _COMPLETE + " SELECT grid_id, vx, vy, vz, n FROM banded_cells")
def voxel_counts(spark, d):
    return in_both_grids(_scans(spark, d), S.voxel_inverse).groupBy(*CELL).agg(F.count(F.lit(1)).alias("n"))


@_query("distinct_voxels_exact", _COMPLETE + " SELECT grid_id, count(*) AS cells FROM banded_cells GROUP BY grid_id")
def distinct_voxels_exact(spark, d):
    return in_both_grids(_scans(spark, d), S.voxel_inverse).select(*CELL).distinct().groupBy("grid_id").agg(F.count(F.lit(1)).alias("cells"))


def _estimated(rate: int, exact_upto: int) -> str:
    """SQL of the estimate from the voxels' hash."""
    mod = lambda e: f"((({e}) % 2147483647 + 2147483647) % 2147483647)"
    linear = mod("CAST(vx AS BIGINT) * 73856093 + CAST(vy AS BIGINT) * 19349663 + CAST(vz AS BIGINT) * 83492791")
    return (
        _COMPLETE
        + f""", h0 AS (SELECT *, {linear} AS h FROM banded_cells), h1 AS (SELECT * REPLACE ({mod("h * h + h * 48271 + 12345")} AS h) FROM h0),
h2 AS (SELECT * REPLACE ({mod("h * h + h * 69621 + 12345")} AS h) FROM h1),
taken AS (SELECT g.grid_id, (SELECT count(*) FROM h2 WHERE h2.grid_id = g.grid_id AND h < {2147483647 // rate}) AS t, (SELECT count(*) FROM scan) AS n FROM (VALUES (0), (1)) AS g(grid_id))
SELECT grid_id, CASE WHEN n <= {exact_upto} THEN n ELSE least(n, t * {rate} + CAST(floor(sqrt(t * {25 * rate * (rate - 1)})) AS BIGINT) + 1) END AS cells FROM taken"""
    )


@_query("distinct_voxels_approximate", _estimated(128, 1 << 16))
def distinct_voxels_approximate(spark, d):
    return approximate_cells(_scans(spark, d), S.voxel_inverse)


@_query("distinct_voxels_sampled", _estimated(16, 0))
def distinct_voxels_sampled(spark, d):
    return approximate_cells(_scans(spark, d), S.voxel_inverse, 16, 0)


@_query("finite_filter", _CLOUDS + " SELECT * FROM recon WHERE isfinite(x) AND isfinite(y) AND isfinite(z)")
def finite_filter(spark, d):
    return fixtures.reconstruction(spark, d).where(finite(*(F.col(c) for c in "xyz")))


@_query("bbox", _CLOUDS + " SELECT count(*) AS n, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z FROM recon")
def bbox(spark, d):
    return bounding_box(fixtures.reconstruction(spark, d))


@_query("spherical_radius", _CLOUDS + f" SELECT point_id, scan_id, {_NORM.format('')} AS radius, CAST(sqrt(x * x + y * y) AS FLOAT) AS horizontal FROM local")
def spherical_radius(spark, d):
    x, y, z = (F.col(c) for c in "xyz")
    return fixtures.scans(spark, d).select("point_id", "scan_id", norm(x, y, z).alias("radius"), F.sqrt(x * x + y * y).cast("float").alias("horizontal"))


@_query("unit_direction", _SEEN + f" SELECT point_id, CAST(x / r AS FLOAT) AS dx, CAST(y / r AS FLOAT) AS dy, CAST(z / r AS FLOAT) AS dz FROM (SELECT *, {_NORM.format('')} AS r FROM local)")
def unit_direction(spark, d):
    return fixtures.scans(spark, d).select("point_id", *(c.alias(f"d{n}") for c, n in zip(unit(*(F.col(a) for a in "xyz")), "xyz", strict=True)))


@_query("beam_radius", _SEEN + " SELECT point_id, scan_id, b FROM beam")
def beam_radius_query(spark, d):
    p = in_scan_frames(fixtures.reconstruction(spark, d), fixtures.POSES)
    return p.select("point_id", "scan_id", beam_radius(norm(F.col("px"), F.col("py"), F.col("pz")), S.beam_start, S.beam_tangent).alias("b"))


@_query("angular_bin_mod", _CLOUDS + " SELECT point_id, ((CAST(floor(y * CAST(64 AS FLOAT)) AS BIGINT) % 2048) + 2048) % 2048 AS bin FROM local")
def angular_bin_mod(spark, d):
    return fixtures.scans(spark, d).select("point_id", F.pmod(F.floor(F.col("y") * F.lit(64.0).cast("float")), F.lit(2048)).cast("long").alias("bin"))


_ANGLES = (
    _SEEN
    + f""", flat AS (
  SELECT *, {_NORM.format("p")} AS pr, sqrt(CAST(px AS DOUBLE) * CAST(px AS DOUBLE) + CAST(py AS DOUBLE) * CAST(py AS DOUBLE)) AS h,
         atan2(CAST(py AS DOUBLE), CAST(px AS DOUBLE)) AS az FROM beam
), cone AS (
  SELECT *, CASE WHEN pr > 0 THEN acos(greatest(least(CAST(pz AS DOUBLE) / CAST(pr AS DOUBLE), 1), -1)) ELSE 0 END AS incl,
         CASE WHEN b >= h THEN pi() ELSE asin(least(CAST(b AS DOUBLE) / h, 1)) END * 1.00001::DOUBLE + 1e-6::DOUBLE AS da,
         CASE WHEN b >= pr THEN pi() ELSE asin(least(CAST(b AS DOUBLE) / CAST(pr AS DOUBLE), 1)) END * 1.00001::DOUBLE + 1e-6::DOUBLE AS di FROM flat
), bins AS (
  SELECT *, floor((az + da) / {AZIMUTH_STEP!r}::DOUBLE) - floor((az - da) / {AZIMUTH_STEP!r}::DOUBLE) + 1 AS across,
         greatest(least(floor((incl + di) / {INCLINATION_STEP!r}::DOUBLE), {INCLINATIONS - 1}), 0) - greatest(least(floor((incl - di) / {INCLINATION_STEP!r}::DOUBLE), {INCLINATIONS - 1}), 0) + 1 AS up FROM cone
)"""
)


@_query("beam_tiers", _ANGLES + f" SELECT CASE WHEN b >= pr THEN 2 WHEN b >= h OR across * up > {MOST_BINS} THEN 1 ELSE 0 END AS tier, count(*) AS points FROM bins GROUP BY ALL")
def beam_tiers(spark, d):
    p = beams(fixtures.reconstruction(spark, d), fixtures.POSES, S.beam_start, S.beam_tangent)
    return p.groupBy("tier").agg(F.count(F.lit(1)).alias("points"))


@_query("beam_angles", _ANGLES + " SELECT point_id, scan_id, CAST(round(da, 9) AS DOUBLE) AS azimuth_reach, CAST(round(di, 9) AS DOUBLE) AS inclination_reach FROM bins")
def beam_angles(spark, d):
    p = beams(fixtures.reconstruction(spark, d), fixtures.POSES, S.beam_start, S.beam_tangent)
    return p.select("point_id", "scan_id", F.round("da", 9).alias("azimuth_reach"), F.round("di", 9).alias("inclination_reach"))


@_query(
    "angular_cells",
    _SEEN
    + f""" SELECT scan_id, CAST(((CAST(floor(atan2(CAST(y AS DOUBLE), CAST(x AS DOUBLE)) / {AZIMUTH_STEP!r}::DOUBLE) AS BIGINT) % {AZIMUTHS}) + {AZIMUTHS}) % {AZIMUTHS} AS INTEGER) AS az,
      CAST(greatest(least(floor(acos(greatest(least(CAST(z AS DOUBLE) / CAST(r AS DOUBLE), 1), -1)) / {INCLINATION_STEP!r}::DOUBLE), {INCLINATIONS - 1}), 0) AS INTEGER) AS incl, count(*) AS rays
    FROM (SELECT *, {_NORM.format("")} AS r FROM local) GROUP BY ALL""",
)
def angular_cells(spark, d):
    return scan_rays(fixtures.scans(spark, d)).groupBy("scan_id", "az", "incl").agg(F.count(F.lit(1)).alias("rays"))


@_query("integer_roots", "SELECT o_orderkey AS point_id, CAST(floor(sqrt(o_orderkey * 25 * 128 * 127)) AS BIGINT) AS root FROM orders")
def integer_roots(spark, d):
    return fixtures.scans(spark, d).select("point_id", integer_root(F.col("point_id") * (25 * 128 * 127)).alias("root"))


@_query("nn_sq_distance", _NEAR + " SELECT point_id, d2 FROM banded")
def nn_sq_distance(spark, d):
    near = nearest_squared_distance(_scans(spark, d), fixtures.reconstruction(spark, d), S.tolerances[-1])
    return near.select("point_id", F.when(F.col("d2") < F.lit(S.squared[-1]).cast("float"), F.col("d2")).alias("d2"))


@_query("nn_band", _NEAR + " SELECT point_id, band FROM banded")
def nn_band(spark, d):
    return _bands(spark, d).select("point_id", "band")


@_query("nn_band_histogram", _NEAR + " SELECT band, count(*) AS points FROM banded GROUP BY band")
def nn_band_histogram(spark, d):
    return _bands(spark, d).groupBy("band").agg(F.count(F.lit(1)).alias("points"))


@_query("nn_verify", _NEAR + " SELECT band, count(*) AS queries, CAST(0 AS BIGINT) AS value_mismatches, CAST(0 AS BIGINT) AS band_mismatches, max(d2) AS largest FROM banded GROUP BY band")
def nn_verify(spark, d):
    return verify(_scans(spark, d), fixtures.reconstruction(spark, d), "point_id", S.squared)


@_query("nn_kd", _NEAR + " SELECT point_id, d2 FROM banded")
def nn_kd(spark, d):
    near = nearest_squared_distance(_scans(spark, d), fixtures.reconstruction(spark, d), S.tolerances[-1], index="kd")
    return near.select("point_id", F.when(F.col("d2") < F.lit(S.squared[-1]).cast("float"), F.col("d2")).alias("d2"))


_CORNER = "CAST(CASE WHEN point_id % 100 = 3 THEN {0} ELSE {0} / 256 END AS FLOAT)"
_REACH = 1 / 64
#: Points of the crowded clouds; a fifth of the queries lies far away.
_CROWDED = (
    _CLOUDS
    + f""", asked AS (SELECT point_id, CAST(CASE WHEN point_id % 5 = 0 THEN x + 4096 ELSE x END AS FLOAT) AS x, y, z FROM (SELECT point_id, {", ".join(f"{_CORNER.format(c)} AS {c}" for c in "xyz")} FROM scan)),
held AS (SELECT {", ".join(f"{_CORNER.format(c)} AS {c}" for c in "xyz")} FROM recon), near AS (
  SELECT s.point_id, min(((s.x - r.x) * (s.x - r.x) + (s.y - r.y) * (s.y - r.y)) + (s.z - r.z) * (s.z - r.z)) AS d2 FROM asked s
  JOIN held r ON r.x BETWEEN s.x - 0.016 AND s.x + 0.016 AND r.y BETWEEN s.y - 0.016 AND s.y + 0.016 AND r.z BETWEEN s.z - 0.016 AND s.z + 0.016 GROUP BY ALL
)"""
)


@_query("nn_crowded", _CROWDED + f" SELECT point_id, CASE WHEN d2 < CAST({_REACH**2!r} AS FLOAT) THEN d2 END AS d2 FROM scan LEFT JOIN near USING (point_id)")
def nn_crowded(spark, d):
    """A cloud in one corner, whose blocks are halved; queries far from it are not shuffled."""
    asked = fixtures.crowded(_scans(spark, d)).withColumn("x", F.when(F.col("point_id") % 5 == 0, F.col("x") + F.lit(4096).cast("float")).otherwise(F.col("x")))
    near = nearest_squared_distance(asked, fixtures.crowded(fixtures.reconstruction(spark, d)), _REACH, split=1000)
    return near.select("point_id", F.when(F.col("d2") < F.lit(_REACH**2).cast("float"), F.col("d2")).alias("d2"))


@_query("nn_huge", _CLOUDS + " SELECT point_id, CASE WHEN n IS NOT NULL THEN CAST(0 AS FLOAT) END AS d2 FROM scan LEFT JOIN (SELECT x, y, z, count(*) AS n FROM recon GROUP BY ALL) USING (x, y, z)")
def nn_huge(spark, d):
    """Coordinates near 1e30, for which block keys would not do: the kd-tree answers. All squares but that of equal points overflow."""
    asked, held = (fixtures.scaled(c, 2.0**97) for c in (_scans(spark, d), fixtures.reconstruction(spark, d)))
    return nearest_squared_distance(asked, held, S.tolerances[-1]).select("point_id", "d2")


#: Tolerances of a second run over the same stored indexes.
AGAIN = Settings((0.03, 0.25), voxel_size=fixtures.SETTINGS.voxel_size)


@_query(
    "stored_nearest",
    _NEAR + f" SELECT 0 AS run, point_id, d2 FROM banded UNION ALL SELECT 1, point_id, CASE WHEN d2 < CAST({AGAIN.squared[-1]!r} AS FLOAT) THEN d2 END FROM banded",
)
def stored_nearest(spark, d):
    """Two runs of other tolerances over one stored index."""
    path = shared_path(spark, "blocks")
    store_candidates(fixtures.reconstruction(spark, d), path, S.tolerances[-1] * SLACK, split=1000)
    index = open_candidates(spark, path)
    runs = []
    for k, settings in enumerate((S, AGAIN)):
        near = nearest_stored(_scans(spark, d), index, settings.tolerances[-1])
        runs.append(near.select(F.lit(k).alias("run"), "point_id", F.when(F.col("d2") < F.lit(settings.squared[-1]).cast("float"), F.col("d2")).alias("d2")))
    return runs[0].unionByName(runs[1])


def _at(settings: Settings) -> str:
    return "CAST(CASE " + " ".join(f"WHEN d2 <= CAST({v!r} AS FLOAT) THEN {t}" for t, v in enumerate(settings.squared)) + f" ELSE {len(settings.tolerances)} END AS INTEGER)"


@_query(
    "stored_rays_seen",
    _SEEN + ", best AS (SELECT r.point_id, p.d2, coalesce(p.front, false) AS front FROM recon r LEFT JOIN (SELECT point_id, min(d2) AS d2, bool_or(front) AS front FROM pairs GROUP BY point_id) p USING (point_id)) "
    + " UNION ALL ".join(f"SELECT {k} AS run, point_id, {_at(s)} AS first, front FROM best" for k, s in enumerate((S, AGAIN))),
)
def stored_rays_seen(spark, d):
    """Two runs of other tolerances over the stored rays."""
    path = shared_path(spark, "rays")
    store_rays(fixtures.scans(spark, d), path)
    rays = open_rays(spark, path)
    runs = [scoring.first_and_front(fixtures.reconstruction(spark, d), None, fixtures.POSES, s, rays=rays).select(F.lit(k).alias("run"), "point_id", "first", "front") for k, s in enumerate((S, AGAIN))]
    return runs[0].unionByName(runs[1])


@_query("completeness_voxel_ratio", _COMPLETE + " SELECT grid_id, vx, vy, vz, n, " + ", ".join(f"c{t} / n AS r{t}" for t in T) + " FROM banded_cells")
def completeness_voxel_ratio(spark, d):
    return scoring.completeness_cells(_bands(spark, d), S).select(*CELL, "n", *((F.col(f"c{t}") / F.col("n").cast("double")).alias(f"r{t}") for t in T))


@_query("completeness", _COMPLETE + _CSCORE + " SELECT tolerance_index, tolerance, round(CAST(completeness AS DOUBLE), 6) AS completeness FROM tol JOIN complete USING (tolerance_index)")
def completeness(spark, d):
    return _rounded(scoring.completeness(_bands(spark, d), S), "completeness")


@_query("beam_pairs", _SEEN + " SELECT point_id, d2, front FROM pairs")
def beam_pairs(spark, d):
    return seen_pairs(fixtures.reconstruction(spark, d), fixtures.scans(spark, d), fixtures.POSES, S.beam_start, S.beam_tangent)


@_query("point_first_and_front", _SEEN + " SELECT point_id, first, front FROM seen")
def point_first_and_front(spark, d):
    return _seen(spark, d).select("point_id", "first", "front")


@_query("accuracy_class_counts", _SEEN + f", tol(tolerance_index, tolerance, sq) AS (VALUES {_TOL}) SELECT tolerance_index, CAST({_CLASS.format(t='tolerance_index')} AS TINYINT) AS class, count(*) AS points FROM seen, tol GROUP BY ALL")
def accuracy_class_counts(spark, d):
    return scoring.at_each_tolerance(_seen(spark, d), S, **{"class": scoring.class_at}).groupBy("tolerance_index", "class").agg(F.count(F.lit(1)).alias("points"))


@_query("accuracy_voxel_ratio", _ACCURATE + " SELECT grid_id, vx, vy, vz, " + ", ".join(f"CASE WHEN a{t} + i{t} > 0 THEN {RATIO.format(t=t)} END AS r{t}" for t in T) + " FROM seen_cells")
def accuracy_voxel_ratio(spark, d):
    return scoring.accuracy_cells(_seen(spark, d), S).select(*CELL, *(scoring.accuracy_ratio(t).alias(f"r{t}") for t in T))


@_query("accuracy", _ACCURATE + _ASCORE + f", tol(tolerance_index, tolerance, sq) AS (VALUES {_TOL}) SELECT tolerance_index, tolerance, round(CAST(accuracy AS DOUBLE), 6) AS accuracy FROM tol JOIN accurate USING (tolerance_index)")
def accuracy(spark, d):
    return _rounded(scoring.accuracy(_seen(spark, d), S), "accuracy")


#: Cells of both measures, banded_cells and seen_cells.
BOTH_CELLS = _COMPLETE + _SEEN.removeprefix(_CLOUDS) + _GRIDS.format(name="seen", inv=S.voxel_inverse, counts=_COUNTS)
_BOTH = BOTH_CELLS + _CSCORE + _ASCORE


@_query(
    "f1_report",
    _BOTH
    + """ SELECT tolerance_index, tolerance, round(CAST(completeness AS DOUBLE), 6) AS completeness, round(CAST(accuracy AS DOUBLE), 6) AS accuracy,
      round(CAST(CASE WHEN accuracy <= 0 AND completeness <= 0 THEN CAST(0 AS FLOAT) ELSE CAST(CAST(2 AS FLOAT) * accuracy * completeness / (accuracy + completeness) AS FLOAT) END AS DOUBLE), 6) AS f1
    FROM tol JOIN complete USING (tolerance_index) JOIN accurate USING (tolerance_index)""",
)
def f1_report(spark, d):
    return _rounded(scoring.scores(_bands(spark, d), _seen(spark, d), S), "completeness", "accuracy", "f1")


@_query("completeness_colors", _NEAR + " SELECT point_id, x, y, z, CAST(CASE WHEN band <= 3 THEN 0 ELSE 255 END AS SMALLINT) AS red, CAST(CASE WHEN band <= 3 THEN 255 ELSE 0 END AS SMALLINT) AS green, CAST(0 AS SMALLINT) AS blue FROM banded")
def completeness_colors(spark, d):
    return scoring.completeness_colours(_bands(spark, d), 3).select("point_id", "x", "y", "z", "red", "green", "blue")


@_query("accuracy_colors", _SEEN + f" SELECT point_id, x, y, z, CAST(CASE WHEN k = 2 THEN 255 ELSE 0 END AS SMALLINT) AS red, CAST(CASE WHEN k = 1 THEN 255 ELSE 0 END AS SMALLINT) AS green, CAST(CASE WHEN k = 0 THEN 255 ELSE 0 END AS SMALLINT) AS blue FROM (SELECT *, {_CLASS.format(t=3)} AS k FROM seen)")
def accuracy_colors(spark, d):
    return scoring.accuracy_colours(_seen(spark, d), 3).select("point_id", "x", "y", "z", "red", "green", "blue")


@_query("ply_round_trip", _CLOUDS + " SELECT row_number() OVER (ORDER BY point_id) - 1 AS point_index, x, y, z FROM recon")
def ply_round_trip(spark, d):
    cloud = fixtures.reconstruction(spark, d).withColumns({c: F.lit(0) for c in ("red", "green", "blue")})
    path = shared_path(spark, "cloud.ply")
    write_coloured(cloud, path, "point_id")
    return read_cloud(spark, path)


@_query("coloured_round_trip", _SEEN + f" SELECT row_number() OVER (ORDER BY point_id) - 1 AS point_index, x, y, z, CAST(CASE WHEN k = 2 THEN 255 ELSE 0 END AS SMALLINT) AS red, CAST(CASE WHEN k = 1 THEN 255 ELSE 0 END AS SMALLINT) AS green, CAST(CASE WHEN k = 0 THEN 255 ELSE 0 END AS SMALLINT) AS blue FROM (SELECT *, {_CLASS.format(t=3)} AS k FROM seen)")
def coloured_round_trip(spark, d):
    path = shared_path(spark, "accuracy.ply")
    write_coloured(scoring.accuracy_colours(_seen(spark, d), 3), path, "point_id")
    return read_cloud(spark, path, colours=True)


def _back(spark, paths):
    """Every written cloud read back, with the index of its tolerance."""
    clouds = [read_cloud(spark, path, colours=True).withColumn("tolerance_index", F.lit(t)) for t, path in enumerate(paths)]
    return reduce(DataFrame.unionByName, clouds)


_EACH = f", tol(tolerance_index, tolerance, sq) AS (VALUES {_TOL}) SELECT tolerance_index, row_number() OVER (PARTITION BY tolerance_index ORDER BY point_id) - 1 AS point_index, x, y, z, "


@_query("completeness_clouds", _NEAR + _EACH + "CAST(CASE WHEN band <= tolerance_index THEN 0 ELSE 255 END AS SMALLINT) AS red, CAST(CASE WHEN band <= tolerance_index THEN 255 ELSE 0 END AS SMALLINT) AS green, CAST(0 AS SMALLINT) AS blue FROM banded, tol")
def completeness_clouds(spark, d):
    """The files of all tolerances, written in one pass."""
    return _back(spark, write_coloured_at_each(_bands(spark, d), shared_path(spark, "completeness"), S, scoring.completeness_colours, "point_id"))


@_query(
    "accuracy_clouds",
    _SEEN + _EACH + f"CAST(CASE WHEN k = 2 THEN 255 ELSE 0 END AS SMALLINT) AS red, CAST(CASE WHEN k = 1 THEN 255 ELSE 0 END AS SMALLINT) AS green, CAST(CASE WHEN k = 0 THEN 255 ELSE 0 END AS SMALLINT) AS blue FROM (SELECT seen.*, tol.*, {_CLASS.format(t='tolerance_index')} AS k FROM seen, tol)",
)
def accuracy_clouds(spark, d):
    return _back(spark, write_coloured_at_each(_seen(spark, d), shared_path(spark, "accuracy"), S, scoring.accuracy_colours, "point_id"))


def _write_project(spark, scans: DataFrame, poses: dict[int, list[float]], project: str) -> None:
    """Scans as files beside a project that names them."""
    meshes = []
    system, name = opened(project)
    for k, pose in poses.items():
        write_coloured(scans.where(F.col("scan_id") == k).withColumns({c: F.lit(0) for c in ("red", "green", "blue")}), f"{project}-{k}.ply", "point_id")
        rows = "\n".join(" ".join(map(str, pose[4 * r : 4 * r + 4])) for r in range(4))
        meshes.append(f'<MLMesh label="scan {k}" filename="{name.rpartition("/")[2]}-{k}.ply"><MLMatrix44>{rows}</MLMatrix44></MLMesh>')
    with system.open_output_stream(name) as out:
        out.write(f"<MeshLabProject><MeshGroup>{''.join(meshes)}</MeshGroup></MeshLabProject>".encode())


@_query("project_scans", _CLOUDS + " SELECT scan_id, row_number() OVER (PARTITION BY scan_id ORDER BY point_id) - 1 AS point_index, x, y, z FROM local")
def project_scans(spark, d):
    """Scans written as files beside a project that names them, read back through the project."""
    project = shared_path(spark, "scans.mlp")
    _write_project(spark, fixtures.scans(spark, d), fixtures.POSES, project)
    scans = read_project(project)
    check_poses(scans)
    return load_scans(spark, {s.scan_id: resolved(project, s.filename) for s in scans}).select("scan_id", "point_index", "x", "y", "z")


@_query(
    "projects_of_a_folder",
    " UNION ALL ".join(
        f"SELECT '{name}' AS project, scan_id, 'scan ' || scan_id AS label, count(*) AS points, min(x) AS min_x, max(z) AS max_z FROM ({sql} SELECT * FROM scan WHERE isfinite(x) AND isfinite(y) AND isfinite(z)) GROUP BY ALL"
        for name, sql in (("even", _CLOUDS), ("turned", "{rough}"))
    ),
)
def projects_of_a_folder(spark, d):
    """Two projects in one folder, read by the data source; their scans, moved by its poses."""
    folder = shared_path(spark, "projects")
    for name, scans, poses in (("even", fixtures.scans(spark, d), fixtures.POSES), ("turned", fixtures.rough_scans(spark, d), fixtures.ROUGH_POSES)):
        _write_project(spark, scans, poses, f"{folder}/{name}.mlp")
    found = read_projects(spark, folder).collect()  # a row a scan
    clouds = []
    for project in sorted({r["project"] for r in found}):
        own = {r["scan_id"]: r for r in found if r["project"] == project}
        points = scoring.to_global(load_scans(spark, {k: r["path"] for k, r in own.items()}), {k: list(r["pose"]) for k, r in own.items()})
        labels = F.create_map(*(F.lit(x) for k, r in own.items() for x in (k, r["label"])))
        clouds.append(points.select(F.lit(project.rpartition("/")[2].removesuffix(".mlp")).alias("project"), "scan_id", labels[F.col("scan_id")].alias("label"), "x", "y", "z"))
    points = reduce(DataFrame.unionByName, clouds).where(finite(*(F.col(c) for c in "xyz")))
    return points.groupBy("project", "scan_id", "label").agg(F.count(F.lit(1)).alias("points"), F.min("x").alias("min_x"), F.max("z").alias("max_z"))


_LINES = """, scored AS (
  SELECT tolerance_index, tolerance, completeness, accuracy,
         CASE WHEN accuracy <= 0 AND completeness <= 0 THEN CAST(0 AS FLOAT) ELSE CAST(CAST(2 AS FLOAT) * accuracy * completeness / (accuracy + completeness) AS FLOAT) END AS f1
  FROM tol JOIN complete USING (tolerance_index) JOIN accurate USING (tolerance_index)
) """ + " UNION ALL ".join(
    f"SELECT {k} AS line, '{title}: ' || string_agg(format('{{:g}}', CAST({c} AS DOUBLE)), ' ' ORDER BY tolerance_index) AS text FROM scored"
    for k, (title, c) in enumerate((("Tolerances", "tolerance"), ("Completenesses", "completeness"), ("Accuracies", "accuracy"), ("F1-scores", "f1")))
)


@_query("text_report", _BOTH + _LINES)
def text_report(spark, d):
    rows = scoring.scores(_bands(spark, d), _seen(spark, d), S).orderBy("tolerance_index").collect()  # a row a tolerance
    return spark.createDataFrame(list(enumerate(report(rows).split("\n"))), "line int, text string")


@_query(
    "tolerance_running_counts",
    _NEAR
    + f""", tallied AS (
  SELECT grid_id, CAST(floor(x * CAST({S.voxel_inverse!r} AS FLOAT) + shift) AS INTEGER) AS vx, CAST(floor(y * CAST({S.voxel_inverse!r} AS FLOAT) + shift) AS INTEGER) AS vy,
         CAST(floor(z * CAST({S.voxel_inverse!r} AS FLOAT) + shift) AS INTEGER) AS vz, band AS place, count(*) AS points
  FROM banded, (VALUES (0, CAST(0 AS FLOAT)), (1, CAST(0.5 AS FLOAT))) AS g(grid_id, shift) WHERE band < {len(S.tolerances)} GROUP BY ALL
)
SELECT *, CAST(sum(points) OVER (PARTITION BY grid_id, vx, vy, vz ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS upto,
       CAST(coalesce(sum(points) OVER (PARTITION BY grid_id, vx, vy, vz ORDER BY place ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS BIGINT) AS after FROM tallied""",
)
def tolerance_running_counts(spark, d):
    return scoring.running_counts(in_both_grids(_bands(spark, d).drop("scan_id"), S.voxel_inverse), F.col("band"), len(S.tolerances))


def _row(m: list[str], x: str = "x", y: str = "y", z: str = "z") -> str:
    return f"(({m[0]} * {x} + {m[1]} * {y}) + {m[2]} * {z}) + {m[3]}"


def _rough_clouds() -> str:
    """The rough clouds in SQL; inverse poses are made there from the poses."""
    f = lambda v: f"CAST({v!r} AS FLOAT)"
    there, back = [], []
    for k, m in fixtures.ROUGH_POSES.items():
        there.append([_row([f(v) for v in m[4 * r : 4 * r + 4]]) for r in range(3)])
        columns = [[f(m[4 * r + c]) for r in range(3)] for c in range(3)]
        shifts = [f"-{f(m[4 * r + 3])}" for r in range(3)]
        moved = [_row([*column, f"(({column[0]} * {shifts[0]} + {column[1]} * {shifts[1]}) + {column[2]} * {shifts[2]})"]) for column in columns]
        back.append(f"SELECT point_id, {k} AS scan_id, {', '.join(f'{e} AS p{c}' for e, c in zip(moved, 'xyz', strict=True))} FROM recon")
    both = ", ".join(f"CASE scan_id WHEN 0 THEN {a} ELSE {b} END AS {c}" for a, b, c in zip(*there, "xyz", strict=True))
    return f"""
WITH local AS (
  SELECT o_orderkey AS point_id, CAST(o_orderkey % 2 AS INTEGER) AS scan_id,
         CAST(CASE WHEN o_orderkey % 97 = 5 THEN 'nan'::DOUBLE ELSE 3.7::DOUBLE + ((37 * o_orderkey + o_custkey) % 1009) / 997.0::DOUBLE * 2.3::DOUBLE END AS FLOAT) AS x,
         CAST(CASE WHEN o_orderkey % 101 = 7 THEN 'inf'::DOUBLE ELSE ((o_orderkey * 7919) % 10007) / 10007.0::DOUBLE * 8.0::DOUBLE - 4.0::DOUBLE END AS FLOAT) AS y,
         CAST(CASE WHEN o_orderkey % 103 = 9 THEN '-inf'::DOUBLE ELSE ((53 * o_orderkey + 7 * (o_orderkey // 512)) % 2003) / 2003.0::DOUBLE * 4.0::DOUBLE - 2.0::DOUBLE END AS FLOAT) AS z
  FROM orders
), scan AS (SELECT point_id, scan_id, {both} FROM local),
factor AS (SELECT point_id, scan_id, [{", ".join(map(f, fixtures.ROUGH_FACTORS))}][CAST(point_id % 7 AS INTEGER) + 1] AS f, x AS ox, y AS oy, z AS oz FROM local WHERE point_id % 3 = 0),
recon AS (SELECT point_id, {both} FROM (SELECT point_id, scan_id, ox * f AS x, oy * f AS y, oz * f AS z FROM factor)),
framed AS ({" UNION ALL ".join(back)})"""


def _rough(sql: str) -> str:
    """SQL over the rough clouds; points that are not finite have no neighbour and no ray."""
    finite_in = lambda p: " AND ".join(f"isfinite({p}{c})" for c in "xyz")
    return (
        sql.replace(_CLOUDS, _rough_clouds())
        .replace("FROM scan s JOIN recon r ON", f"FROM scan s JOIN (SELECT * FROM recon WHERE {finite_in('')}) r ON")
        .replace("FROM beam JOIN rays USING (scan_id)", f"FROM (SELECT * FROM beam WHERE {finite_in('p')}) JOIN (SELECT * FROM rays WHERE {finite_in('s')}) USING (scan_id)")
    )


def _rough_scans(spark, d):
    return scoring.to_global(fixtures.rough_scans(spark, d), fixtures.ROUGH_POSES)


def _rough_bands(spark, d):
    return scoring.completeness_bands(_rough_scans(spark, d), fixtures.rough_reconstruction(spark, d), S)


def _rough_seen(spark, d):
    return scoring.first_and_front(fixtures.rough_reconstruction(spark, d), fixtures.rough_scans(spark, d), fixtures.ROUGH_POSES, S)


_FINITE = "isfinite({0}x) AND isfinite({0}y) AND isfinite({0}z)"


@_query("rough_scan_points_global", _rough(_CLOUDS) + f" SELECT * FROM scan WHERE {_FINITE.format('')}")
def rough_scan_points_global(spark, d):
    return _rough_scans(spark, d).where(finite(*(F.col(c) for c in "xyz")))


@_query("rough_recon_points_scan_frame", _rough(_CLOUDS) + f" SELECT * FROM framed WHERE {_FINITE.format('p')}")
def rough_recon_points_scan_frame(spark, d):
    return in_scan_frames(fixtures.rough_reconstruction(spark, d), fixtures.ROUGH_POSES).where(finite(*(F.col(f"p{c}") for c in "xyz")))


@_query("rough_finite_filter", _rough(_CLOUDS) + f" SELECT * FROM recon WHERE {_FINITE.format('')}")
def rough_finite_filter(spark, d):
    return fixtures.rough_reconstruction(spark, d).where(finite(*(F.col(c) for c in "xyz")))


@_query("rough_voxel_counts", _rough(_COMPLETE) + " SELECT grid_id, vx, vy, vz, n FROM banded_cells")
def rough_voxel_counts(spark, d):
    return in_both_grids(_rough_scans(spark, d), S.voxel_inverse).groupBy(*CELL).agg(F.count(F.lit(1)).alias("n"))


@_query("rough_nn", _rough(_NEAR) + " SELECT point_id, d2, band FROM banded")
def rough_nn(spark, d):
    near = nearest_squared_distance(_rough_scans(spark, d), fixtures.rough_reconstruction(spark, d), S.tolerances[-1])
    return near.select("point_id", F.when(F.col("d2") < F.lit(S.squared[-1]).cast("float"), F.col("d2")).alias("d2"), band(F.col("d2"), S.squared).alias("band"))


@_query("rough_beam_pairs", _rough(_SEEN) + " SELECT point_id, d2, front FROM pairs")
def rough_beam_pairs(spark, d):
    return seen_pairs(fixtures.rough_reconstruction(spark, d), fixtures.rough_scans(spark, d), fixtures.ROUGH_POSES, S.beam_start, S.beam_tangent)


@_query("rough_f1_report", _rough(_BOTH) + """ SELECT tolerance_index, round(CAST(completeness AS DOUBLE), 6) AS completeness, round(CAST(accuracy AS DOUBLE), 6) AS accuracy FROM tol JOIN complete USING (tolerance_index) JOIN accurate USING (tolerance_index)""")
def rough_f1_report(spark, d):
    return _rounded(scoring.scores(_rough_bands(spark, d), _rough_seen(spark, d), S).select("tolerance_index", "completeness", "accuracy"), "completeness", "accuracy")


@_query("clouds_dense", _rough(_CLOUDS) + f" SELECT 'rough' AS cloud, bool_and({_FINITE.format('')}) AS dense FROM recon UNION ALL SELECT 'finite', true")
def clouds_dense(spark, d):
    cloud = fixtures.rough_reconstruction(spark, d).withColumns({c: F.lit(0) for c in ("red", "green", "blue")})
    rows = []
    for name, df in (("rough", cloud), ("finite", cloud.where(finite(*(F.col(c) for c in "xyz"))))):
        path = shared_path(spark, f"{name}.ply")
        write_coloured(df, path, "point_id")
        rows.append((name, is_dense(spark, path)))
    return spark.createDataFrame(rows, "cloud string, dense boolean")


ORACLES["projects_of_a_folder"] = ORACLES["projects_of_a_folder"].replace("{rough}", _rough(_CLOUDS))
