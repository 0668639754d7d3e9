"""The command line: scores a reconstruction against the scans of a project."""

from __future__ import annotations

import argparse
import sys
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..config import Settings, SettingsError
from ..sources.ply import COLOURS, PlyUnreadable, PlyUnsupported, read_cloud, write_clouds
from ..sources.project import ProjectError, check_poses, read_project, resolved
from . import scoring

OK, SYSTEM_FAILURE, RECONSTRUCTION_UNREADABLE, UNSUPPORTED = 0, 1, 2, 3


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("cloudgauge")
    p.add_argument("--reconstruction_ply_path", default="")
    p.add_argument("--ground_truth_mlp_path", default="")
    p.add_argument("--tolerances", default="", help="comma-separated")
    p.add_argument("--voxel_size", type=float, default=0.01)
    p.add_argument("--beam_start_radius_meters", type=float, default=0.5 * 0.00225)
    p.add_argument("--beam_divergence_halfangle_deg", type=float, default=0.011)
    p.add_argument("--completeness_cloud_output_path", default="")
    p.add_argument("--accuracy_cloud_output_path", default="")
    p.add_argument("--nn_index", choices=("grid", "flann"), default="grid", help="grid: octree blocks; flann: the kd-tree; both give the same answer")
    p.add_argument("--nn_verify", action="store_true", help="compares the octree blocks with the kd-tree")
    p.add_argument("--general_ply", action="store_true", help="also reads ASCII, big-endian and double PLY files")
    return p


def load_scans(spark: SparkSession, paths: dict[int, str], general: bool = False) -> DataFrame:
    """All scans (scan_id, point_index, x, y, z), in scanner coordinates."""
    clouds = [read_cloud(spark, path, general).withColumn("scan_id", F.lit(k)) for k, path in paths.items()]
    empty = spark.createDataFrame([], "point_index long, x float, y float, z float, scan_id int")
    return reduce(DataFrame.unionByName, clouds, empty) if clouds else empty


def report(rows: list) -> str:
    """The four result lines, six significant digits each."""
    show = lambda title, key: f"{title}: " + " ".join(f"{r[key]:g}" for r in rows)
    return "\n".join(show(*x) for x in (("Tolerances", "tolerance"), ("Completenesses", "completeness"), ("Accuracies", "accuracy"), ("F1-scores", "f1")))


def write_coloured_at_each(points: DataFrame, path: str, settings: Settings, colours, order: str) -> list[str]:
    """One coloured cloud a tolerance, beside each other, in one sorted pass: <path>.tolerance_<t>.ply; path may be a URI."""
    each = points
    for t in range(len(settings.tolerances)):
        each = colours(each, t).withColumnsRenamed({c: f"{c}_{t}" for c in COLOURS})
    return write_clouds(each, path, [f".tolerance_{value:g}.ply" for value in settings.tolerances], order)


def run(spark: SparkSession, args: argparse.Namespace, settings: Settings) -> int:
    try:
        scans = read_project(args.ground_truth_mlp_path)
        check_poses(scans)
    except ProjectError as e:
        print(e, file=sys.stderr)
        return SYSTEM_FAILURE
    print(f"Loading reconstruction: {args.reconstruction_ply_path}", flush=True)
    try:
        reconstruction = read_cloud(spark, args.reconstruction_ply_path, args.general_ply).withColumnRenamed("point_index", "point_id").persist(StorageLevel.MEMORY_AND_DISK)
    except (PlyUnreadable, PlyUnsupported) as e:
        print(e, file=sys.stderr)
        return UNSUPPORTED if isinstance(e, PlyUnsupported) else RECONSTRUCTION_UNREADABLE
    paths = {s.scan_id: resolved(args.ground_truth_mlp_path, s.filename) for s in scans}
    try:
        for path in paths.values():
            print(f"Loading scan: {path}", flush=True)
        local = load_scans(spark, paths, args.general_ply).persist(StorageLevel.MEMORY_AND_DISK)
    except (PlyUnreadable, PlyUnsupported) as e:
        print(e, file=sys.stderr)
        return UNSUPPORTED if isinstance(e, PlyUnsupported) else SYSTEM_FAILURE
    poses = {s.scan_id: list(s.pose) for s in scans}
    placed = scoring.to_global(local, poses) if poses else local
    print("Computing completeness", flush=True)
    counters = Observation("nn_verify") if args.nn_verify else None
    bands = scoring.completeness_bands(placed, reconstruction.select("x", "y", "z"), settings, {"grid": "auto", "flann": "kd"}[args.nn_index], counters).persist(StorageLevel.MEMORY_AND_DISK)
    complete = {r["tolerance_index"]: r["completeness"] for r in scoring.completeness(bands, settings).collect()}  # a row a tolerance
    if counters is not None:
        found = counters.get
        print("nn_verify:", {n: found[n] for n in ("queries", "value_mismatches", "band_mismatches")}, file=sys.stderr)
        if found["band_mismatches"]:
            return SYSTEM_FAILURE
    if args.completeness_cloud_output_path:
        write_coloured_at_each(bands.withColumn("order", F.struct("scan_id", "point_index")), args.completeness_cloud_output_path, settings, scoring.completeness_colours, "order")
    print("Computing accuracy", flush=True)
    seen = scoring.first_and_front(reconstruction, local, poses, settings).persist(StorageLevel.MEMORY_AND_DISK)
    if args.accuracy_cloud_output_path:
        write_coloured_at_each(seen, args.accuracy_cloud_output_path, settings, scoring.accuracy_colours, "point_id")
    print(report(scoring.scored(complete, seen, settings).orderBy("tolerance_index").collect()), flush=True)
    for df in (bands, seen, local, reconstruction):
        df.unpersist()
    return OK


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = _parser().parse_args(argv)
    faults = [f"--{n} is needed" for n in ("reconstruction_ply_path", "ground_truth_mlp_path", "tolerances") if not getattr(args, n)]
    settings = None
    try:
        values = tuple(float(t) for t in args.tolerances.split(",") if t)
        settings = Settings(values or (1.0,), args.voxel_size, args.beam_start_radius_meters, args.beam_divergence_halfangle_deg)
    except (ValueError, SettingsError) as e:
        faults.append(str(e))
    if faults:
        print("\n".join(faults), file=sys.stderr)
        return SYSTEM_FAILURE
    return run(spark or SparkSession.builder.appName("cloudgauge").getOrCreate(), args, settings)
