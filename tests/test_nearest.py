"""Octree blocks and the kd-tree against all pairs."""

import logging

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from cloudgauge.operators import kd, nearest
from cloudgauge.operators.kd import Regions, Tree, cuts, kd_squared_distance
from cloudgauge.operators.nearest import PLACE, SLACK, bounding_box, brute_force, in_blocks, nearest_squared_distance, octree, verified, verify


def all_pairs(q, c):
    d = q[:, None, :].astype(np.float32) - c[None].astype(np.float32)
    with np.errstate(over="ignore"):
        return ((d[..., 0] * d[..., 0] + d[..., 1] * d[..., 1]) + d[..., 2] * d[..., 2]).min(1) if len(c) else np.full(len(q), np.inf, np.float32)


def clustered(rng, n, spread=1.0):
    return (rng.integers(0, 5, (n, 3)) * 10 + rng.normal(size=(n, 3)) * rng.choice([0.001, 0.1, 1.0], (n, 1)) * spread).astype(np.float32)


def frame(spark, x, key="point_id"):
    return spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(x)], f"{key} long, x float, y float, z float")


def capped(rows, radius, column="d2"):
    return {r["point_id"]: r[column] if r[column] is not None and r[column] < np.float32(radius * radius) else None for r in rows.collect()}


@pytest.mark.parametrize("leaf", [1, 7, 32])
def test_tree_against_all_pairs(leaf):
    rng = np.random.default_rng(leaf)
    for c in (clustered(rng, 3000), np.repeat(clustered(rng, 3), 200, 0), rng.normal(size=(1, 3)), rng.normal(size=(500, 3)) * [1, 0, 0], np.empty((0, 3))):
        q = np.concatenate([clustered(rng, 300), c[:20], rng.normal(size=(50, 3)) * 1e6]).astype(np.float32)
        tree = Tree(np.asarray(c, np.float32).reshape(-1, 3), leaf)
        assert np.array_equal(tree.nearest(q, np.full(len(q), np.inf, np.float32)), all_pairs(q, np.asarray(c, np.float32).reshape(-1, 3)))


def test_tree_looks_at_few_points_and_keeps_what_is_nearer():
    rng = np.random.default_rng(2)
    c, q = rng.uniform(size=(20_000, 3)).astype(np.float32), rng.uniform(size=(500, 3)).astype(np.float32)
    tree = Tree(c)
    assert np.array_equal(tree.nearest(q, np.full(500, np.inf, np.float32)), all_pairs(q, c))
    assert tree.looked < 500 * 20_000 / 50
    before = tree.looked
    assert (tree.nearest(q, np.zeros(500, np.float32)) == 0).all() and tree.looked - before <= 500 * kd.LEAF  # its own leaf only


def test_tree_of_huge_coordinates():
    rng = np.random.default_rng(4)
    c = (rng.normal(size=(400, 3)) * 1e30).astype(np.float32)
    q = np.concatenate([c[::3], (rng.normal(size=(100, 3)) * 1e30).astype(np.float32)])
    assert np.array_equal(Tree(c).nearest(q, np.full(len(q), np.inf, np.float32)), all_pairs(q, c))


def test_regions_find_all_that_are_nearer():
    rng = np.random.default_rng(5)
    c, q = clustered(rng, 2000).astype(float), clustered(rng, 200).astype(float)
    axis, value = cuts(c[::7], 16)
    where = Regions(axis, value, np.empty(0), np.empty(0)).of(c)
    low = np.array([c[where == k].min(0) if (where == k).any() else np.full(3, np.inf) for k in range(16)])
    high = np.array([c[where == k].max(0) if (where == k).any() else np.full(3, -np.inf) for k in range(16)])
    table = Regions.boxed(axis, value, low, high)
    best, own = rng.uniform(0, 9, 200), table.of(q)
    want = {(i, k) for i in range(200) for k in range(16) if k != own[i] and kd.outside(q[i], low[k], high[k]) * kd.CAUTION < best[i]}
    assert set(zip(*(a.tolist() for a in table.nearer(q, best, own)), strict=True)) == want and want


@pytest.mark.parametrize("small", [False, True])
def test_kd_join_against_brute_force(spark, small, monkeypatch):
    if small:
        for name, value in (("REGION_POINTS", 40), ("QUERY_ROWS", 15), ("CANDIDATE_ROWS", 30)):
            monkeypatch.setattr(kd, name, value)
    rng = np.random.default_rng(6)
    x = clustered(rng, 400)
    x[5], x[6, 1], x[7] = np.nan, np.inf, [-0.0, 0.0, -0.0]
    x[10:60] = x[10]
    a, b = frame(spark, x), frame(spark, np.concatenate([clustered(rng, 500), x[:40], np.zeros((1, 3)), np.repeat(x[11:12], 300, 0)]))
    for radius in (0.05, 3.0, 1e9):
        got = kd_squared_distance(a.union(a.limit(3)), b, radius)
        assert got.count() == 403 and got.columns == ["point_id", "x", "y", "z", "d2"]
        assert capped(got, radius) == capped(brute_force(a, b, "point_id"), radius)
    assert {r["d2"] for r in kd_squared_distance(a, b.limit(0), 1.0).collect()} == {None}
    assert kd_squared_distance(a.limit(0), b, 1.0).count() == 0


def crowded_cloud(rng, n):
    """All but a hundredth of the points in one corner."""
    x = rng.uniform(0, 64, (n, 3)).astype(np.float32)
    x[n // 100 :] /= 256
    return x


def test_a_crowded_corner_is_halved(spark, monkeypatch):
    rng = np.random.default_rng(7)
    c, q, radius = crowded_cloud(rng, 6000), crowded_cloud(rng, 1500), 1 / 128
    a, b = frame(spark, q), frame(spark, c)
    edge = nearest.edge_within(bounding_box(b).first(), radius, 4)
    blocks = octree(b, edge, radius, 300)
    assert blocks.levels > 3 and not blocks.crowded
    held = in_blocks(b, blocks, radius * SLACK)
    most = held.groupBy(*PLACE).count().agg(F.max("count")).first()[0]
    assert most <= 600 < held.groupBy(*(F.floor(F.col(c) / edge) for c in "xyz")).count().agg(F.max("count")).first()[0]  # what reaches in comes on top
    assert held.count() < 3 * len(c) and in_blocks(a, blocks).count() == len(q)
    monkeypatch.setattr(nearest, "SPLIT_ROWS", 300)
    assert capped(nearest_squared_distance(a, b, radius), radius) == capped(brute_force(a, b, "point_id"), radius)


@pytest.mark.parametrize("radius", [0.0, 0.01, 0.3])
def test_leaves_hold_each_point_once_and_each_neighbour(spark, radius):
    rng = np.random.default_rng(8)
    c = np.concatenate([clustered(rng, 500, 0.1), -clustered(rng, 300, 0.1)])
    b = frame(spark, c)
    blocks = octree(b, 8.0, radius, 50)
    own = {(r["point_id"], *(r[p] for p in PLACE)) for r in in_blocks(b, blocks).collect()}
    held = {(r["point_id"], *(r[p] for p in PLACE)) for r in in_blocks(b, blocks, radius * SLACK).collect()}
    assert len(own) == len(c) and own <= held and len(held) <= 8 * len(c)
    leaf = {k: place for k, *place in own}
    near = np.argwhere(((c[:, None].astype(float) - c[None]) ** 2).sum(2) <= radius**2)
    assert all((int(j), *leaf[int(i)]) in held for i, j in near)


def test_blocks_that_cannot_be_halved_are_dealt(spark, monkeypatch):
    for name, value in (("SPLIT_ROWS", 40), ("LEAST_SPLIT", 40), ("CANDIDATE_ROWS", 320), ("QUERY_ROWS", 25)):
        monkeypatch.setattr(nearest, name, value)
    rng = np.random.default_rng(9)
    c = crowded_cloud(rng, 900)
    a, b = frame(spark, np.concatenate([crowded_cloud(rng, 200), np.repeat(c[500:501], 60, 0)])), frame(spark, c)
    for radius in (0.01, 2.0, 100.0):
        assert capped(nearest_squared_distance(a, b, radius), radius) == capped(brute_force(a, b, "point_id"), radius)


def test_far_queries_are_not_shuffled(spark):
    rng = np.random.default_rng(10)
    c = rng.uniform(0, 4, (300, 3))
    q = np.concatenate([c[:50] + 0.01, c[:50] + [1e4, 0, 0], c[:50] - [0, 0, 1e6], np.full((1, 3), np.nan)])
    a, b = frame(spark, q), frame(spark, c)
    near = nearest_squared_distance(a, b, 0.5)
    assert capped(near, 0.5) == capped(brute_force(a, b, "point_id"), 0.5) and near.count() == 151
    plan = near._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Union") and "<= 4." in plan.split("FlatMapCoGroupsInArrow")[1]  # the box stands in the filter below the cogroup
    assert nearest.root_counts(1.0, 1000, b, a, (F.col("x") < 100) & (F.col("z") > -100)) == ([], {}, 101)


def test_huge_coordinates_take_the_other_index(spark, caplog):
    rng = np.random.default_rng(11)
    c = (rng.normal(size=(200, 3)) * 1e30).astype(np.float32)
    a, b = frame(spark, np.concatenate([c[:30], (rng.normal(size=(30, 3)) * 1e30)])), frame(spark, c)
    with caplog.at_level(logging.WARNING, "cloudgauge"):
        got = capped(nearest_squared_distance(a, b, 0.5), 0.5)
    assert "kd-tree" in caplog.text
    assert got == capped(brute_force(a, b, "point_id"), 0.5) and sum(v == 0 for v in got.values()) == 30
    with pytest.raises(ValueError, match="block keys"):
        nearest_squared_distance(a, b, 0.5, index="blocks")


def test_verify_counts_differences(spark, monkeypatch):
    rng = np.random.default_rng(12)
    a, b = frame(spark, clustered(rng, 300)), frame(spark, clustered(rng, 300))
    squared = (0.01, 0.25, 1.0)
    rows = verify(a, b, "point_id", squared).collect()
    assert sum(r["queries"] for r in rows) == 300 and not any(r["value_mismatches"] or r["band_mismatches"] for r in rows)
    monkeypatch.setattr(nearest, "kd_squared_distance", lambda q, c, r: kd_squared_distance(q, c.limit(100), r))
    rows = verify(a, b, "point_id", squared).collect()
    assert sum(r["value_mismatches"] for r in rows) > 20 and sum(r["band_mismatches"] for r in rows) > 0


def test_counters_come_with_the_pass(spark, monkeypatch):
    """The observed counters equal what the comparison sums, and no job runs for them."""
    rng = np.random.default_rng(13)
    a, b = frame(spark, clustered(rng, 200)), frame(spark, clustered(rng, 200))
    squared = (0.01, 0.25, 1.0)
    monkeypatch.setattr(nearest, "kd_squared_distance", lambda q, c, r: kd_squared_distance(q, c.limit(50), r))
    rows = verify(a, b, "point_id", squared).collect()
    near = nearest_squared_distance(a, b, SLACK)
    counters = Observation("differences")
    passed = verified(near, b, squared, counters)
    got = sorted(map(tuple, passed.collect()), key=str)
    tracker, seen = spark.sparkContext.statusTracker(), counters.get
    jobs = len(tracker.getJobIdsForGroup(None))
    assert seen == {n: sum(r[n] for r in rows) for n in ("queries", "value_mismatches", "band_mismatches")} and seen["band_mismatches"] > 0
    assert len(tracker.getJobIdsForGroup(None)) == jobs
    assert passed.columns == near.columns and got == sorted(map(tuple, near.collect()), key=str)


def test_over_full_blocks_are_left_to_the_tree(spark, monkeypatch):
    for name, value in (("SPLIT_ROWS", 40), ("LEAST_SPLIT", 40)):
        monkeypatch.setattr(nearest, name, value)
    rng = np.random.default_rng(11)
    c, q = crowded_cloud(rng, 900), np.concatenate([crowded_cloud(rng, 200), np.repeat(crowded_cloud(rng, 1), 5, 0)])
    a, b = frame(spark, q), frame(spark, c)
    near = nearest_squared_distance(a, b, 0.5)
    assert near.count() == len(q) and capped(near, 0.5) == capped(brute_force(a, b, "point_id"), 0.5)
    dealt = nearest_squared_distance(a, b, 0.5, trees=False)  # to several tasks, each of which meets all queries of its block
    assert capped(dealt, 0.5) == capped(near, 0.5)
    explained = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "holders" in explained(dealt) and "holders" not in explained(near)


@pytest.mark.parametrize("seen", [False, True])
def test_filters_stay_small_enough_to_be_compiled(spark, seen):
    """The JVM interprets methods of over 8,000 bytes, at a tenth of the speed or less."""
    from cloudgauge import fixtures
    from cloudgauge.operators.beam import seen_pairs
    from cloudgauge.plans.scoring import to_global

    d, before = "/root/testdata/sf0.001", spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # so that the whole plan has its code at once
    try:
        recon = fixtures.reconstruction(spark, d)
        found = seen_pairs(recon, fixtures.scans(spark, d), fixtures.POSES, 0.001, 0.0002) if seen else nearest_squared_distance(to_global(fixtures.scans(spark, d), fixtures.POSES), recon, 0.5)
        codes = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenStringSeq(found._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    sizes = [codes.apply(k)._3().maxMethodCodeSize() for k in range(codes.size())]
    assert sizes and max(sizes) < 8000


@pytest.mark.parametrize("trees", [True, False])
def test_over_full_blocks_look_near_first(spark, monkeypatch, trees):
    """Dense clouds are answered within a part of the radius; only what finds nothing there is left to the other index."""
    for name, value in (("SPLIT_ROWS", 40), ("LEAST_SPLIT", 40)):
        monkeypatch.setattr(nearest, name, value)
    rng = np.random.default_rng(14)
    c = np.repeat(rng.uniform(0, 2, (1500, 3)), 2, 0).astype(np.float32)  # copies are one candidate
    far = np.array([[2.9, 1, 1], [1, -0.8, 1], [1, 1, 9]])
    a, b = frame(spark, np.concatenate([rng.uniform(0, 2, (600, 3)), c[:50], np.repeat(c[:1], 20, 0), far, np.full((1, 3), np.nan)])), frame(spark, c)
    asked = []
    monkeypatch.setattr(nearest, "kd_squared_distance", lambda q, c, r: asked.append(q.count()) or kd_squared_distance(q, c, r))
    near = nearest_squared_distance(a, b, 1.0, trees=trees)
    assert near.count() == 674 and capped(near, 1.0) == capped(brute_force(a, b, "point_id"), 1.0)
    assert sum(asked) < 300 and nearest._different(b).count() == 1500
