import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudgauge import fixtures
from cloudgauge.config import Settings, SettingsError
from cloudgauge.functions.geometry import f1, inverse_rigid, voxel
from cloudgauge.operators.nearest import brute_force, nearest_in_block, nearest_squared_distance
from cloudgauge.plans import scoring

EYE = fixtures.POSES[0]
NAN, INF = float("nan"), float("inf")


def cloud(spark, points, **more):
    rows = [(k, *map(float, p)) for k, p in enumerate(points)]
    out = spark.createDataFrame(rows, "point_id long, x float, y float, z float")
    return out.withColumns({k: F.lit(v) for k, v in more.items()})


def settings(*tolerances, voxel=0.5, start=0.001, angle=0.0):
    return Settings(tolerances, voxel, start, angle)


def by_id(df, *columns):
    return {r["point_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_settings():
    s = Settings((0.5, 0.1, 0.5))
    assert s.tolerances == tuple(float(np.float32(t)) for t in (0.1, 0.5, 0.5)) and s.voxel_inverse == 100.0
    assert s.beam_tangent == pytest.approx(0.00019198621, rel=1e-7)
    with pytest.raises(SettingsError) as e:
        Settings((-1.0,), 0.0)
    assert len(str(e.value).splitlines()) == 2
    with pytest.raises(SettingsError):
        Settings(())


def test_tolerance_edges(spark):
    """At the largest tolerance completeness is strict, below it is not; equal ones stay apart."""
    scan = cloud(spark, [(0.5, 0, 0), (0.25, 0, 0), (0.125, 0, 0), (9, 0, 0), (NAN, 0, 0), (INF, 0, 0)])
    recon = cloud(spark, [(0, 0, 0), (NAN, 0, 0)])
    for given, want in (((0.5,), [1, 0, 0, 1, 1, 1]), ((0.25, 0.5), [2, 0, 0, 2, 2, 2]), ((0.125, 0.5, 0.5), [3, 1, 0, 3, 3, 3])):
        bands = by_id(scoring.completeness_bands(scan, recon, settings(*given)), "band")
        assert [bands[k][0] for k in range(6)] == want, given


def test_accuracy_accepts_its_edge(spark):
    seen = by_id(scoring.first_and_front(cloud(spark, [(1, 0, 0)]), cloud(spark, [(1.5, 0, 0)], scan_id=0), {0: EYE}, settings(0.25, 0.5)), "first", "front")
    assert seen == {0: (1, True)}


@pytest.mark.parametrize("point,want", [
    ((1.0, 0, 0), (0, False)),  # on the surface
    ((0.25, 0, 0), (2, True)),  # far before it: there is no cap
    ((2.0, 0, 0), (2, False)),  # behind it: unobserved
    ((-1.0, 0, 0), (2, False)),  # behind the scanner
    ((1.0, 0.002, 0), (2, False)),  # beside the beam
    ((1.0, 0.001, 0), (0, False)),  # on the beam's edge
    ((NAN, 0, 0), (2, False)),
    ((0, 0, 0), (2, True)),  # at the scanner: seen by every ray
])
def test_beam_cases(spark, point, want):
    got = by_id(scoring.first_and_front(cloud(spark, [point]), cloud(spark, [(1, 0, 0)], scan_id=0), {0: EYE}, settings(0.01, 0.1)), "first", "front")
    assert got[0] == want


def test_scan_point_at_the_scanner(spark):
    scan = cloud(spark, [(0, 0, 0)], scan_id=0)
    got = by_id(scoring.first_and_front(cloud(spark, [(0.0005, 0, 0), (0.5, 0, 0)]), scan, {0: EYE}, settings(0.01)), "first", "front")
    assert got == {0: (0, False), 1: (1, False)}


def sees(p, s, start, tangent):
    """The rule, in float32, for one pair."""
    f = np.float32
    p, s = np.array(p, f), np.array(s, f)
    norm = lambda v: f(np.sqrt(f(f(v[0] * v[0] + v[1] * v[1]) + v[2] * v[2])))
    r = norm(s)
    d = s / r if r > 0 else s
    b = f(start) + norm(p) * f(tangent)
    a = f(f(d[0] * p[0] + d[1] * p[1]) + d[2] * p[2])
    e = p - a * d
    return a >= 0 and f(f(e[0] * e[0] + e[1] * e[1]) + e[2] * e[2]) <= b * b, bool(a < r)


@pytest.mark.parametrize("start,angle", [(0.02, 0.5), (0.2, 5.0)])
def test_beam_join_against_all_pairs(spark, start, angle):
    """Rays all around - poles and the seam of the azimuth with them - and beams wide enough for every tier."""
    rng = np.random.default_rng(4)
    scan = rng.normal(size=(400, 3))
    scan[:40, :2] *= 1e-3
    scan[40:80, 1] *= 1e-4
    scan[80:84] = [(-1, 0, 0), (-1, -0.0, 0), (0, 0, 1), (0, 0, -1)]
    points = np.concatenate([scan[::2] * rng.uniform(0.2, 1.4, (200, 1)) + rng.normal(0, 0.02, (200, 3)), rng.normal(0, 0.05, (40, 3))])
    s = settings(0.05, 0.2, start=start, angle=angle)
    points32, scan32 = points.astype("f4"), scan.astype("f4")
    got = by_id(scoring.first_and_front(cloud(spark, points32), cloud(spark, scan32, scan_id=0), {0: EYE}, s), "first", "front")
    for k, p in enumerate(points32):
        first, front = 2, False
        for q in scan32:
            hit, before = sees(p, q, s.beam_start, s.beam_tangent)
            if hit:
                e = q - p
                d2 = (e[0] * e[0] + e[1] * e[1]) + e[2] * e[2]
                first, front = min([first, *(t for t in range(2) if d2 <= np.float32(s.squared[t]))]), front or before
        assert got[k] == (first, front), (k, p)


def test_nearest_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    q = np.concatenate([rng.uniform(-2, 2, (300, 3)), rng.normal(0, 0.01, (200, 3)), [(-1, -0.5, -0.0)]])
    c = np.concatenate([rng.uniform(-2, 2, (200, 3)), rng.normal(0, 0.01, (400, 3)), np.zeros((5, 3))])
    a, b = cloud(spark, q), cloud(spark, c)
    for radius, edge in ((0.3, None), (0.3, 0.7), (5.0, None), (0.0, None)):
        got = by_id(nearest_squared_distance(a, b.drop("point_id"), radius, edge), "d2")
        want = by_id(brute_force(a, b.drop("point_id"), "point_id"), "d2")
        for k in want:
            if want[k][0] <= np.float32(radius) ** 2:
                assert got[k] == want[k], (radius, k)
            else:
                assert got[k][0] is None or got[k] == want[k]


def test_crowded_blocks_are_dealt_out(spark, monkeypatch):
    from cloudgauge.operators import nearest

    monkeypatch.setattr(nearest, "QUERY_ROWS", 10)
    rng = np.random.default_rng(2)
    a, b = cloud(spark, rng.normal(0, 0.2, (95, 3))), cloud(spark, rng.normal(0, 0.2, (30, 3))).drop("point_id")
    assert by_id(nearest_squared_distance(a, b, 9.0, 1.0), "d2") == by_id(brute_force(a, b, "point_id"), "d2")


def test_nearest_in_block_far_out():
    q, c = np.array([[1e6, 0, 0]], "f4"), np.array([[1e6 + 1, 0, 0], [-1e6, 0, 0]], "f4")
    assert nearest_in_block(q, c, 2.0)[0] == 1.0


def test_voxels(spark):
    x = cloud(spark, [(-1.0, -0.5, -0.0), (0.49, 0.5, 1e20), (NAN, -1e20, 0)])
    got = x.select(*(voxel(F.col(c), 2.0, 0.0).alias(c) for c in "xyz")).collect()
    assert [tuple(r) for r in got] == [(-2, -1, 0), (0, 1, 2**31 - 1), (0, -(2**31), 0)]


def test_unobserved_points_do_not_count(spark):
    """A voxel with only unobserved points has no share; the others are averaged, both grids together."""
    points = cloud(spark, [(1, 0, 0), (0.8, 0, 0), (5, 5, 5)])
    s = settings(0.01, voxel=10.0)
    seen = scoring.first_and_front(points, cloud(spark, [(1, 0, 0)], scan_id=0), {0: EYE}, s)
    got = scoring.accuracy(seen, s).collect()
    assert got[0]["accuracy"] == 0.5


def test_empty_clouds(spark):
    s = settings(0.1, 0.2)
    none, some = scoring.empty_points(spark), cloud(spark, [(0, 0, 0)])
    scans = lambda df: df.withColumn("scan_id", F.lit(0))
    rows = lambda a, b: [tuple(r)[2:] for r in scoring.scores(scoring.completeness_bands(a, b.drop("point_id"), s), scoring.first_and_front(b, scans(a), {0: EYE}, s), s).orderBy("tolerance_index").collect()]
    assert rows(some, none) == [(0.0, 0.0, 0.0)] * 2
    for c, a, f in rows(none, some):
        assert math.isnan(c) and a == 0 and math.isnan(f)
    assert by_id(scoring.first_and_front(some, scans(none), {}, s), "first", "front") == {0: (2, False)}


def test_f1(spark):
    df = spark.createDataFrame([(0.0, 0.0), (0.5, 1.0), (NAN, 0.0)], "p float, r float")
    got = [r[0] for r in df.select(f1(F.col("p"), F.col("r"))).collect()]
    assert got[0] == 0 and got[1] == pytest.approx(2 / 3) and math.isnan(got[2])


def test_pose_and_its_inverse(spark):
    m = fixtures.POSES[1]
    scan = cloud(spark, [(4.5, 0.25, -1.0)], scan_id=1)
    there = scoring.to_global(scan, {1: m}).first()
    assert (there["x"], there["y"], there["z"]) == (3.75, 0.5, -0.5)
    back = np.array(inverse_rigid(m), "f4").reshape(4, 4) @ np.array([3.75, 0.5, -0.5, 1], "f4")
    assert back[:3].tolist() == [4.5, 0.25, -1.0]


def test_order_and_partitions_do_not_matter(spark):
    s, d = fixtures.SETTINGS, "/root/testdata/sf0.001"
    scans, recon = fixtures.scans(spark, d), fixtures.reconstruction(spark, d)
    want = None
    for n in (1, 7):
        a, b = scans.repartition(n, "y"), recon.repartition(n, "z")
        bands = scoring.completeness_bands(scoring.to_global(a, fixtures.POSES), b.select("x", "y", "z"), s)
        got = [tuple(round(v, 6) for v in r) for r in scoring.scores(bands, scoring.first_and_front(b, a, fixtures.POSES, s), s).orderBy("tolerance_index").collect()]
        assert want is None or got == want
        want = got
    assert [r[2] for r in want] == pytest.approx([0.044343, 0.075448, 0.130564, 0.215546, 0.349411, 0.961449], abs=1e-6)
    assert [r[3] for r in want] == pytest.approx([0.253829, 0.413265, 0.594527, 0.814739, 0.814739, 0.814739], abs=1e-6)


def test_crowded_candidates_are_dealt_out(spark, monkeypatch):
    from cloudgauge.operators import nearest

    monkeypatch.setattr(nearest, "QUERY_ROWS", 40)
    monkeypatch.setattr(nearest, "CANDIDATE_ROWS", 10)
    rng = np.random.default_rng(3)
    own = rng.normal(0, 0.2, (95, 3))
    a, b = cloud(spark, np.concatenate([own, [(NAN, 0, 0), (50, 50, 50)]])), cloud(spark, rng.normal(0, 0.2, (130, 3))).drop("point_id")
    a = a.unionByName(a.where("point_id < 5"))  # repeated rows stay repeated
    got = sorted((r["point_id"], r["d2"]) for r in nearest_squared_distance(a, b, 9.0, 1.0).where("d2 IS NOT NULL").collect())
    want = sorted((r["point_id"], r["d2"]) for r in brute_force(a.dropDuplicates(["point_id"]), b, "point_id").where("point_id < 95").collect() for _ in range(2 if r["point_id"] < 5 else 1))
    assert got == want and nearest_squared_distance(a, b, 9.0, 1.0).count() == 102


def test_wide_cones_at_any_size(spark, monkeypatch):
    """The tiers of wide cones without broadcasts give the pairs that they give with them."""
    from cloudgauge.operators import beam

    rng = np.random.default_rng(5)
    scan = cloud(spark, rng.normal(size=(300, 3)), scan_id=0)
    points = cloud(spark, np.concatenate([rng.normal(0, 0.5, (200, 3)), rng.normal(0, 0.02, (30, 3)), rng.normal(size=(40, 3)) * [1e-3, 1e-3, 1]]))
    pairs = lambda: sorted(map(tuple, beam.seen_pairs(points, scan, {0: EYE}, 0.1, 0.05).collect()))
    tiers = {r["tier"] for r in beam.beams(points, {0: EYE}, 0.1, 0.05).select("tier").distinct().collect()}
    want = pairs()
    monkeypatch.setattr(beam, "BROADCAST_ROWS", 0)
    assert tiers >= {1, 2} and want and pairs() == want


def test_estimated_cells(spark):
    from cloudgauge.functions.voxels import approximate_cells, in_both_grids

    rng = np.random.default_rng(6)
    points = spark.createDataFrame([(float(x), float(y), float(z)) for x, y, z in rng.uniform(-40, 40, (20_000, 3)).repeat(4, 0)], "x float, y float, z float")
    exact = {r["grid_id"]: r["n"] for r in in_both_grids(points, 0.5).select("grid_id", "vx", "vy", "vz").distinct().groupBy("grid_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    for rate in (4, 128):
        for r in approximate_cells(points, 0.5, rate).collect():
            assert exact[r["grid_id"]] <= r["cells"] <= exact[r["grid_id"]] + 12 * math.sqrt(rate * exact[r["grid_id"]])
    assert {r["cells"] for r in approximate_cells(points.limit(100), 0.5).collect()} == {100}
    assert {r["cells"] for r in approximate_cells(points.limit(0), 0.5).collect()} == {0}


def test_integer_root(spark):
    from cloudgauge.functions.geometry import integer_root

    values = [0, 1, 2, 3, 4, 15, 16, 17, 2**52 - 1, 2**52, (2**30 + 1) ** 2 - 1, (2**30 + 1) ** 2, 2**62 - 1]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "n long").select(integer_root(F.col("n"))).collect()]
    assert got == [math.isqrt(v) for v in values]


def test_copies_of_points_and_rays_do_not_multiply(spark, monkeypatch):
    """300 copies of a ray and of a point are one pair, not 90,000; every copy keeps its row."""
    from cloudgauge.operators import beam

    pairs, plain = [], beam.seen_pairs
    monkeypatch.setattr(beam, "seen_pairs", lambda *a: pairs.append(plain(*a)) or pairs[-1])
    points = cloud(spark, [(1, 0, 0)] * 300 + [(0.25, 0, -0.0), (0.25, -0.0, 0), (NAN, 0, 0), (NAN, 0, 0), (1, 0.002, 0)])
    got = by_id(scoring.first_and_front(points, cloud(spark, [(1, 0, 0)] * 300, scan_id=0), {0: EYE}, settings(0.01, 0.1)), "first", "front")
    assert got == {k: (0, False) if k < 300 else (2, k < 302) for k in range(305)}
    assert pairs[0].count() == 2
