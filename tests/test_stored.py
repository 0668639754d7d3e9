import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudgauge import fixtures
from cloudgauge.operators.nearest import nearest_squared_distance
from cloudgauge.operators.stored import nearest_stored, open_candidates, open_rays, store_candidates, store_rays
from cloudgauge.plans import scoring
from cloudgauge.sources.files import shared_path

XYZ = "point_id long, x float, y float, z float"


def cloud(spark, n, seed, spread=1.0):
    points = np.random.default_rng(seed).random((n, 3)).astype(np.float32) * np.float32(spread)
    return spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(points)], XYZ)


def distances(df):
    return sorted((r["point_id"], r["d2"]) for r in df.select("point_id", "d2").collect())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges_above_scan(text, table):
    """Exchanges on the way from the scan of a table up to the operator that joins it."""
    lines = text.splitlines()
    at = next(k for k, line in enumerate(lines) if "FileScan" in line and table in line)
    indent = lambda line: len(re.match(r"[ :|+\-]*", line)[0])
    found, level = [], indent(lines[at])
    for line in reversed(lines[:at]):
        if indent(line) < level:
            level = indent(line)
            if "CoGroup" in line or "Join" in line:
                return found
            found += ["Exchange"] if "Exchange" in line else []
    raise AssertionError(text)


@pytest.mark.parametrize("split", [None, 50])
def test_stored_index_answers_as_the_join_does(spark, split):
    queries, held = cloud(spark, 400, 1), cloud(spark, 600, 2)
    odd = spark.createDataFrame([(1000, float("nan"), 0.0, 0.0), (1001, 0.5, float("inf"), 0.0), (1002, None, 0.0, 0.0), (1003, 50.0, 0.0, 0.0), (1, 0.5, 0.5, 0.5)], XYZ)
    queries = queries.unionByName(odd).unionByName(odd)
    path = shared_path(spark, "index")
    store_candidates(held.unionByName(odd.where("point_id < 1003")), path, 0.2, split=split)
    index = open_candidates(spark, path)
    assert bool(index.blocks.halved) == (split is not None)
    for radius in (0.2, 0.05, 0.0):
        assert distances(nearest_stored(queries, index, radius).fillna(-1.0, ["d2"])) == distances(nearest_squared_distance(queries, held.unionByName(odd.where("point_id < 1003")), radius).fillna(-1.0, ["d2"]))


def test_crowded_blocks_of_either_side_are_dealt(spark, monkeypatch):
    monkeypatch.setattr("cloudgauge.operators.nearest.SPLIT_ROWS", 100)
    monkeypatch.setattr("cloudgauge.operators.stored.SPLIT_ROWS", 100)
    queries, held = cloud(spark, 300, 3, 0.1), cloud(spark, 900, 4, 0.1).unionByName(cloud(spark, 5, 5, 40.0))
    queries = queries.unionByName(queries.limit(20))
    path = shared_path(spark, "index")
    store_candidates(held, path, 0.2)
    index = open_candidates(spark, path)
    assert any(n > 1 for n in index.blocks.crowded.values())
    expected = distances(nearest_squared_distance(queries, held, 0.2, index="kd").fillna(-1.0, ["d2"]))
    assert distances(nearest_stored(queries, index, 0.2).fillna(-1.0, ["d2"])) == expected
    assert distances(nearest_stored(queries, index, 0.2, most_queries=40).fillna(-1.0, ["d2"])) == expected


def test_indexes_are_not_shuffled_again(spark):
    path, rays = shared_path(spark, "index"), shared_path(spark, "rays")
    store_candidates(cloud(spark, 200, 6), path, 0.2)
    text = plan(nearest_stored(cloud(spark, 100, 7), open_candidates(spark, path), 0.1))
    assert "Bucketed: true" in text and not exchanges_above_scan(text, "holder")
    scans = cloud(spark, 200, 8).withColumn("scan_id", F.lit(0))
    store_rays(scans, rays)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(scoring.first_and_front(cloud(spark, 100, 9), None, {0: fixtures.POSES[0]}, fixtures.SETTINGS, rays=open_rays(spark, rays)))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Bucketed: true" in text and not exchanges_above_scan(text, "sx")


def test_stored_rays_see_what_rays_see(spark):
    points, scans = cloud(spark, 200, 10), cloud(spark, 300, 11).withColumn("scan_id", (F.col("point_id") % 2).cast("int"))
    path = shared_path(spark, "rays")
    store_rays(scans, path)
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    for settings in (fixtures.SETTINGS, scoring.Settings((0.3,), beam_start_radius=0.05)):
        expected = rows(scoring.first_and_front(points, scans, fixtures.POSES, settings))
        assert rows(scoring.first_and_front(points, None, fixtures.POSES, settings, rays=open_rays(spark, path))) == expected


def test_refusals_empty_clouds_and_a_catalog_left_as_it_was(spark):
    none, some = cloud(spark, 0, 1), cloud(spark, 10, 2)
    path = shared_path(spark, "index")
    store_candidates(none, path, 0.2)
    index = open_candidates(spark, path)
    assert distances(nearest_stored(some, index, 0.1)) == [(k, None) for k in range(10)]
    with pytest.raises(ValueError, match="radii"):
        nearest_stored(some, index, 0.3)
    with pytest.raises(FileExistsError):
        store_candidates(none, path, 0.2)
    with pytest.raises(ValueError, match="block keys"):
        store_candidates(fixtures.scaled(some, 2.0**97), shared_path(spark, "huge"), 0.2)
    full = shared_path(spark, "index")
    store_candidates(some, full, 0.2)
    assert nearest_stored(none, open_candidates(spark, full), 0.1).count() == 0
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("stored_")]


def test_over_full_blocks_meet_each_query_once(spark, monkeypatch):
    monkeypatch.setattr("cloudgauge.operators.nearest.SPLIT_ROWS", 100)
    monkeypatch.setattr("cloudgauge.operators.stored.SPLIT_ROWS", 100)
    queries, held = cloud(spark, 300, 3, 0.1), cloud(spark, 900, 4, 0.1)
    path = shared_path(spark, "index")
    store_candidates(held, path, 0.2)
    index = open_candidates(spark, path)
    near = nearest_stored(queries, index, 0.2)
    assert index.blocks.crowded and near.count() == 300
    assert "DIV holders" not in plan(near) and "div holders" not in plan(near)  # not once a holder
