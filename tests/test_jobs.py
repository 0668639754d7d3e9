"""The jobs on copies of small tables, over growing input, by function and by command line."""

import json
import os
import subprocess
import sys

import numpy as np
import pytest

from jobs import growing_coverage, quality_tiles
from jobs.clouds import cloud, config_beside, read_config

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
GIVEN = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def config_of(spark, job, **changes):
    return read_config(spark, config_beside(job.__file__)) | changes


def nearest(ground, arriving, tolerances):
    """(key, d2 or None, band) by comparing all pairs in float32."""
    out = {}
    there = np.array([[r["x"], r["y"], r["z"]] for r in arriving], np.float32)
    squared = [float(np.float32(t) * np.float32(t)) for t in tolerances]
    for r in ground:
        d = np.array([r["x"], r["y"], r["z"]], np.float32) - there
        d2 = float(((d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1]) + d[:, 2] * d[:, 2]).min()) if len(there) else np.inf
        out[r["key"]] = (d2, next(t for t, s in enumerate(squared) if d2 <= s)) if d2 < squared[-1] else (None, len(squared))
    return out


def found(df):
    return {r["key"]: (r["d2"], r["band"]) for r in df.collect()}




@pytest.mark.parametrize("name, ground, arriving", [("growing_coverage", "benchmark", "documents"), ("growing_coverage_scans", "orders", "orders")])
def test_two_runs_over_growing_input(spark, tmp_path, name, ground, arriving):
    config = read_config(spark, f"{ROOT}/jobs/{name}.json") | {"files_a_batch": 1}
    config["arriving"] = config["arriving"] | {"table": "new"}
    here = f"file://{tmp_path}"
    spark.read.parquet(f"{GIVEN}/{ground}.parquet").write.parquet(f"{here}/{ground}.parquet")
    shares = spark.read.parquet(f"{GIVEN}/{arriving}.parquet").randomSplit([1.0, 1.0], 7)
    settings = spark.conf.get("spark.sql.sources.partitionOverwriteMode")

    def expected():
        points = cloud(spark.read.parquet(f"{here}/new.parquet"), config["arriving"]).collect()
        return nearest(cloud(spark.read.parquet(f"{here}/{ground}.parquet"), config["ground_truth"]).collect(), points, config["tolerances"])

    def batches():
        return {r["batch"]: r["count"] for r in spark.read.parquet(f"{here}/out/nearest").groupBy("batch").count().collect()}

    def run():
        return growing_coverage.run(spark, here, f"{here}/out", f"{here}/check", config)

    shares[0].coalesce(1).write.parquet(f"{here}/new.parquet")
    assert found(run()) == expected()
    first = batches()
    assert set(first) == {0}
    shares[1].repartition(2).write.mode("append").parquet(f"{here}/new.parquet")
    assert found(run()) == expected()
    second = batches()
    assert set(second) == {0, 1, 2} and second[0] == first[0]  # only the two new files were taken
    again = rows_of(run())
    assert batches() == second and again == rows_of(spark.read.schema("key long, x float, y float, z float, d2 float, band int").parquet(f"{here}/out/coverage"))
    assert any(b < len(config["tolerances"]) for _, b in expected().values())
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == settings


def test_a_batch_that_is_run_again_replaces_itself(spark, tmp_path):
    """The last batch's commit is lost, as when a run dies: the next run takes that batch again."""
    config = config_of(spark, growing_coverage)
    here = f"file://{tmp_path}"
    args = (spark, GIVEN, f"{here}/out", f"{here}/check", config)
    once = rows_of(growing_coverage.run(*args))
    rows = spark.read.parquet(f"{here}/out/nearest").count()
    os.remove(tmp_path / "check" / "commits" / "0")
    os.remove(tmp_path / "check" / "commits" / ".0.crc")
    assert rows_of(growing_coverage.run(*args)) == once
    assert spark.read.parquet(f"{here}/out/nearest").count() == rows


def test_nothing_arrives(spark, tmp_path):
    config = config_of(spark, growing_coverage)
    spark.read.parquet(f"{GIVEN}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.read.parquet(f"{GIVEN}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    got = growing_coverage.run(spark, str(tmp_path), f"{tmp_path}/out", f"{tmp_path}/check", config).collect()
    assert len(got) == spark.read.parquet(f"{GIVEN}/benchmark.parquet").count()
    assert {(r["d2"], r["band"]) for r in got} == {(None, len(config["tolerances"]))}


def test_quality_tiles_again_with_fewer_tolerances(spark, tmp_path):
    config = config_of(spark, quality_tiles)
    out = f"file://{tmp_path}/tiles"
    first = rows_of(quality_tiles.run(spark, GIVEN, out, config))
    assert rows_of(quality_tiles.run(spark, GIVEN, out, config)) == first
    assert sorted(p for p in os.listdir(tmp_path / "tiles") if "=" in p) == [f"tolerance_index={t}" for t in range(6)]
    fewer = quality_tiles.run(spark, GIVEN, out, config | {"tolerances": [0.5, 0.1]})
    assert {r["tolerance_index"] for r in fewer.collect()} == {0, 1}
    drop = lambda rows: sorted(r[:-1] for r in rows)
    assert drop(rows_of(fewer.na.fill(-1))) == drop(rows_of(spark.createDataFrame(first, fewer.schema).where("tolerance_index IN (3, 5)").na.fill(-1)))


def test_tiles_add_up_to_the_whole_scene(spark, tmp_path):
    from cloudgauge import fixtures
    from cloudgauge.plans import queries

    rows = quality_tiles.run(spark, GIVEN, f"{tmp_path}/tiles", config_of(spark, quality_tiles)).collect()
    points = fixtures.scans(spark, GIVEN).count()
    whole = {r["tolerance_index"]: r for r in queries.f1_report(spark, GIVEN).collect()}
    for t, r in whole.items():
        own = [x for x in rows if x["tolerance_index"] == t]
        assert sum(x["scan_points"] for x in own) == 2 * points  # each point is in a voxel of both grids
        mean = lambda score, weight: sum(x[score] * x[weight] for x in own if x[weight]) / sum(x[weight] for x in own)  # noqa: E731, B023
        assert mean("completeness", "scan_voxels") == pytest.approx(r["completeness"], abs=2e-6)
        assert mean("accuracy", "seen_voxels") == pytest.approx(r["accuracy"], abs=2e-6)


def test_command_lines(tmp_path):
    env = os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.ui.enabled=false --conf spark.sql.shuffle.partitions=2 pyspark-shell"}
    with open(f"{ROOT}/jobs/growing_coverage.json") as f:
        config = json.load(f) | {"tolerances": [1, 2]}
    (tmp_path / "own.json").write_text(json.dumps(config))
    for job, more in (("growing_coverage", ["--checkpoint", f"{tmp_path}/check", "--config", f"{tmp_path}/own.json"]), ("quality_tiles", [])):
        done = subprocess.run([sys.executable, "-m", f"jobs.{job}", "--tables", GIVEN, "--output", f"{tmp_path}/{job}", *more], cwd=ROOT, env=env, capture_output=True, text=True, timeout=300)
        assert done.returncode == 0, done.stderr[-2000:]
        assert f"{job}: " in done.stderr and "wrote" in done.stderr
    assert {p for p in os.listdir(tmp_path / "growing_coverage")} == {"nearest", "coverage"}
