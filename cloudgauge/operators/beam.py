"""Beam join: which reconstruction points a scan's rays see.

A scan point s in the scanner's frame, with direction d, sees a point p if p lies ahead (a = d.p >= 0)
and within the beam's radius at its range (|p - a d|^2 <= b^2). Candidates come from an equi-join
on angular bins: a scan point has one bin, a reconstruction point has all bins that the cone around
its beam touches. Where the cone is wide - near the poles or the scanner - bins would explode, so
those points join by an inclination row and a wide sector of it, or, at the scanner, by scan alone. Then
the rays of a scan are dealt over SALTS keys, so that no key gathers a scan. There is no cap on the distance.
"""

from __future__ import annotations

from math import pi

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import affine, apart, azimuth, beam_radius, f32, inclination, inverse_rigid, norm, squared_distance, squared_norm, unit

AZIMUTHS, INCLINATIONS = 2048, 1024
AZIMUTH_STEP, INCLINATION_STEP = 2 * pi / AZIMUTHS, pi / INCLINATIONS
#: Most bins of a point in the narrow tier, and most rows of a wide tier that are broadcast.
MOST_BINS, BROADCAST_ROWS = 64, 50_000
#: Azimuth bins of a sector, and keys over which the rays of a scan are dealt.
SECTOR, SALTS = 32, 64


def _azimuth_bin(angle):
    return F.pmod(F.floor(angle / AZIMUTH_STEP), F.lit(AZIMUTHS)).cast("int")


def _inclination_bin(angle):
    return F.greatest(F.least(F.floor(angle / INCLINATION_STEP), F.lit(INCLINATIONS - 1)), F.lit(0)).cast("int")


def _names(key: str | tuple[str, ...]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def scan_rays(scans: DataFrame) -> DataFrame:
    """(scan_id, sx, sy, sz, sr, dx, dy, dz, az, incl) from scan points in scanner coordinates (scan_id, x, y, z)."""
    x, y, z = (F.col(c) for c in "xyz")
    r = norm(x, y, z)
    d = unit(x, y, z)
    return scans.select(
        "scan_id", x.alias("sx"), y.alias("sy"), z.alias("sz"), r.alias("sr"), *(c.alias(f"d{n}") for c, n in zip(d, "xyz", strict=True)),
        _azimuth_bin(azimuth(x, y)).alias("az"), _inclination_bin(inclination(z, r)).alias("incl"),
    )


def in_scan_frames(points: DataFrame, poses: dict[int, list[float]], key: str | tuple[str, ...] = "point_id") -> DataFrame:
    """(key, scan_id, px, py, pz): each point once a scan, in the scanner's frame; key: one column or several. Poses are few; they are literals of the plan."""
    keys = _names(key)
    own = [F.struct(F.lit(k).alias("scan_id"), *(c.alias(f"p{n}") for c, n in zip(affine(inverse_rigid(m), *(F.col(a) for a in "xyz")), "xyz", strict=True))) for k, m in poses.items()]
    if not own:
        own = [F.lit(None).cast("struct<scan_id:int,px:float,py:float,pz:float>")]
    return points.select(*keys, F.explode(F.array(*own)).alias("p")).where("p IS NOT NULL").select(*keys, "p.*")


def beams(points: DataFrame, poses: dict[int, list[float]], start: float, tangent: float, key: str | tuple[str, ...] = "point_id") -> DataFrame:
    """Points in scanner frames with the beam's radius b, and the angles of the cone around the beam, a little widened."""
    p = in_scan_frames(points, poses, key)
    p = p.withColumn("pr", norm(F.col("px"), F.col("py"), F.col("pz"))).withColumn("b", beam_radius(F.col("pr"), start, tangent))
    b, r = F.col("b").cast("double"), F.col("pr").cast("double")
    flat = F.sqrt(F.col("px").cast("double") * F.col("px") + F.col("py").cast("double") * F.col("py"))
    wide = lambda a, c: F.when(a >= c, F.lit(pi)).otherwise(F.asin(F.least(a / c, F.lit(1.0)))) * (1 + 1e-5) + 1e-6
    p = p.withColumn("da", wide(b, flat)).withColumn("di", wide(b, r))
    az, incl = azimuth(F.col("px"), F.col("py")), inclination(F.col("pz"), F.col("pr"))
    p = p.withColumns({"a0": F.floor((az - F.col("da")) / AZIMUTH_STEP), "a1": F.floor((az + F.col("da")) / AZIMUTH_STEP), "i0": _inclination_bin(incl - F.col("di")), "i1": _inclination_bin(incl + F.col("di"))})
    cells = (F.col("a1") - F.col("a0") + 1) * (F.col("i1") - F.col("i0") + 1)
    tier = F.when(b >= r, 2).when((b >= flat) | (cells > MOST_BINS), 1).otherwise(0)
    # a point that is not finite is seen by nothing
    return p.withColumn("tier", tier).where(~F.isnan("pr") & (F.col("pr") < float("inf")))


def seen_pairs(points: DataFrame, scans: DataFrame | None, poses: dict[int, list[float]], start: float, tangent: float, key: str | tuple[str, ...] = "point_id", rays: DataFrame | None = None) -> DataFrame:
    """(key, d2, front) of every pair of a point and a ray that sees it; front: the point lies before the surface. rays: those of the scans, where they are stored."""
    rays = apart(scan_rays(apart(scans))) if rays is None else rays
    keys = _names(key)
    p = apart(beams(apart(points.select(*dict.fromkeys([*keys, "x", "y", "z"]))), poses, start, tangent, key))
    own = [*keys, "scan_id", "px", "py", "pz", "b"]
    # rows of a wide tier: of the first, one for each inclination row and sector that a cone touches
    touched = (F.col("i1") - F.col("i0") + 1) * F.least(F.floor(F.col("a1") / SECTOR) - F.floor(F.col("a0") / SECTOR) + 1, F.lit(AZIMUTHS // SECTOR))
    wide = {r["tier"]: r["n"] for r in p.where("tier > 0").groupBy("tier").agg(F.sum(F.when(F.col("tier") == 1, touched).otherwise(1)).alias("n")).collect()}
    rows = p.where("tier = 0").withColumn("incl", F.explode(F.sequence("i0", "i1"))).withColumn("a", F.explode(F.sequence("a0", "a1")))
    joined = [rows.select(*own, "incl", F.pmod("a", F.lit(AZIMUTHS)).cast("int").alias("az")).join(rays, ["scan_id", "az", "incl"])]
    if wide.get(1):
        sectors = F.when(F.col("a1") - F.col("a0") >= AZIMUTHS - SECTOR, F.sequence(F.lit(0), F.lit(AZIMUTHS // SECTOR - 1))).otherwise(
            F.transform(F.sequence(F.floor(F.col("a0") / SECTOR).cast("int"), F.floor(F.col("a1") / SECTOR).cast("int")), lambda a: F.pmod(a, F.lit(AZIMUTHS // SECTOR)))
        )
        rows = p.where("tier = 1").withColumn("incl", F.explode(F.sequence("i0", "i1"))).select(*own, "incl", F.explode(sectors).alias("sector"))
        joined.append((F.broadcast(rows) if wide[1] <= BROADCAST_ROWS else rows).join(rays.withColumn("sector", F.expr(f"az DIV {SECTOR}").cast("int")), ["scan_id", "incl", "sector"]))
    if wide.get(2):
        rows = p.where("tier = 2").select(*own)
        if wide[2] <= BROADCAST_ROWS:
            joined.append(F.broadcast(rows).join(rays, "scan_id"))
        else:
            salted = rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            joined.append(salted.join(rays.withColumn("salt", F.pmod(F.xxhash64("sx", "sy", "sz"), F.lit(SALTS)).cast("int")), ["scan_id", "salt"]))
    out = None
    s, q = tuple(F.col(f"s{c}") for c in "xyz"), tuple(F.col(f"p{c}") for c in "xyz")
    for pairs in joined:
        ahead = (F.col("dx") * q[0] + F.col("dy") * q[1]) + F.col("dz") * q[2]
        pairs = pairs.withColumn("ahead", ahead)
        off = tuple(c - F.col("ahead") * F.col(f"d{n}") for c, n in zip(q, "xyz", strict=True))
        pairs = pairs.where((F.col("ahead") >= f32(0)) & (squared_norm(*off) <= F.col("b") * F.col("b")))
        pairs = pairs.select(*keys, squared_distance(s, q).alias("d2"), (F.col("ahead") < F.col("sr")).alias("front"))
        out = pairs if out is None else out.unionByName(pairs)
    return out


def nearest_seen(points: DataFrame, scans: DataFrame | None, poses: dict[int, list[float]], start: float, tangent: float, rays: DataFrame | None = None) -> DataFrame:
    """(x, y, z, d2, front) of every different point that a ray sees: the least of its pairs' d2, and whether it lies before a surface.

    Equal points have equal pairs, and equal rays add nothing to them, so either is taken once: the pairs of
    n copies of a point and m of a ray would be n times m.
    """
    scans = None if scans is None else scans.select("scan_id", "x", "y", "z").distinct()
    pairs = seen_pairs(points.select("x", "y", "z").distinct(), scans, poses, start, tangent, ("x", "y", "z"), rays)
    return pairs.groupBy("x", "y", "z").agg(F.min("d2").alias("d2"), F.bool_or("front").alias("front"))
