"""Quality map: where in space a reconstruction is complete and accurate, tile by tile.

    python -m jobs.quality_tiles --tables DIR --output DIR [--config FILE]

Scores of a whole scene hide where it is bad. This job scores every tile, a cube of some voxels, at every
tolerance, as the whole scene is scored: means over the voxels of both grids of the shares of complete and
of accurate points. The config names the tables of the scans and of the reconstruction, SQL
expressions that make points of their rows, the scans' poses, tolerances and sizes.

The output is Parquet, partitioned by tolerance_index: tolerance, tile (tx, ty, tz), scan_voxels, scan_points,
completeness, seen_voxels, accuracy, f1. A side without voxels has a null score. A run replaces
the whole output, so a rerun over the same tables gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudgauge.config import Settings
from cloudgauge.functions.geometry import f32
from cloudgauge.plans import scoring

from .clouds import LOG, arguments, cloud, read_config, settings_of, table_path

TILE = ("tx", "ty", "tz")


def in_tiles(cells: DataFrame, edge: int, *values: Column) -> DataFrame:
    """Cells summed by tile; a tile is a cube of `edge` voxels, in the coordinates of each grid."""
    tile = [F.floor(F.col(f"v{c}") / edge).cast("int").alias(f"t{c}") for c in "xyz"]
    return cells.select("*", *tile).groupBy(*TILE).agg(*values)


def tiles(scans: DataFrame, reconstruction: DataFrame, poses: dict[int, list[float]], settings: Settings, edge: int) -> DataFrame:
    """(tolerance_index, tolerance, tx, ty, tz, scan_voxels, scan_points, completeness, seen_voxels, accuracy, f1), a row for each tile and tolerance."""
    each = range(len(settings.tolerances))
    bands = scoring.completeness_bands(scoring.to_global(scans, poses), reconstruction.select("x", "y", "z"), settings)
    share = lambda t: F.avg(F.col(f"c{t}") / F.col("n").cast("double")).alias(f"c{t}")
    complete = in_tiles(scoring.completeness_cells(bands, settings), edge, F.count(F.lit(1)).alias("scan_voxels"), F.sum("n").alias("scan_points"), *map(share, each))
    seen = scoring.accuracy_cells(scoring.first_and_front(reconstruction, scans, poses, settings), settings)
    ratio = lambda t, f, name: f(scoring.accuracy_ratio(t).cast("double")).alias(f"{name}{t}")
    accurate = in_tiles(seen, edge, *(ratio(t, F.avg, "a") for t in each), *(ratio(t, F.count, "s") for t in each))
    both = complete.join(accurate, list(TILE), "full")
    rows = F.explode(F.array(*[F.struct(F.lit(t).alias("tolerance_index"), f32(v).alias("tolerance"), F.col(f"c{t}").alias("c"), F.col(f"a{t}").alias("a"), F.coalesce(f"s{t}", F.lit(0)).alias("seen_voxels")) for t, v in enumerate(settings.tolerances)]))
    long = both.select(*TILE, F.coalesce("scan_voxels", F.lit(0)).alias("scan_voxels"), F.coalesce("scan_points", F.lit(0)).alias("scan_points"), rows.alias("r")).select("*", "r.*")
    f1 = F.when(F.col("c") + F.col("a") > 0, 2 * F.col("c") * F.col("a") / (F.col("c") + F.col("a"))).when((F.col("c") + F.col("a")) == 0, 0.0)
    return long.select("tolerance", *TILE, "scan_voxels", "scan_points", F.round("c", 6).alias("completeness"), "seen_voxels", F.round("a", 6).alias("accuracy"), F.round(f1, 6).alias("f1"), "tolerance_index")


def run(spark: SparkSession, tables: str, output: str, config: dict) -> DataFrame:
    """Scores the tiles, writes them to `output` and returns them as read back."""
    settings = settings_of(config)
    clouds = {}
    for name in ("scans", "reconstruction"):
        path = table_path(tables, config[name])
        rows = spark.read.parquet(path)
        LOG.info("quality_tiles: read %s rows of %s as %s", rows.count(), path, name)
        clouds[name] = cloud(rows, config[name])
    poses = {int(k): [float(v) for v in m] for k, m in config["poses"].items()}
    found = tiles(clouds["scans"], clouds["reconstruction"], poses, settings, config["tile_voxels"])
    # a task of each tolerance and range of tiles, so that a partition has few files
    dealt = found.repartition("tolerance_index", F.pmod(F.xxhash64(*TILE), F.lit(config["files"])))
    dealt.write.mode("overwrite").partitionBy("tolerance_index").parquet(output)
    result = spark.read.schema(found.schema).parquet(output)
    LOG.info("quality_tiles: wrote %s rows to %s", result.count(), output)
    return result


def main() -> None:
    args = arguments("Completeness and accuracy of a reconstruction by tile.", __file__).parse_args()
    spark = SparkSession.builder.appName("quality_tiles").getOrCreate()
    try:
        run(spark, args.tables, args.output, read_config(spark, args.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
