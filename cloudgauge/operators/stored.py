"""Spatial indexes kept as bucketed tables, for runs that ask the same clouds again.

A stored index of candidates holds every candidate in each leaf block of the octree that its ball of the
index's radius touches; over-full blocks that cannot be halved are dealt to holders, so that no file holds one whole. The table is bucketed by the key that the
search groups by, so a run with any tolerance up to that radius shuffles its queries alone. A stored
index of rays is bucketed by scan and angular bins, the key of the beam join's narrow tier.

An index is a folder: `table` is the bucketed Parquet table, `halved` and `crowded` describe the octree,
`about` is written last, so that a folder without it is no index. A folder is written once. Tables are opened under
unique names that are dropped at once; the files stay.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import apart, finite
from .beam import scan_rays
from .kd import kd_squared_distance
from .nearest import CANDIDATE_ROWS, LEAST_SPLIT, MOST_BLOCKS, PLACE, QUERY_ROWS, SLACK, SPLIT_ROWS, Blocks, _points, bounding_box, edge_within, in_blocks, nearest_in_block, octree, representable, within_reach

HELD, RAY = [*PLACE, "holder"], ["scan_id", "az", "incl"]
_HALVED, _CROWDED = "level int, bx long, by long, bz long", "level int, bx long, by long, bz long, holders long"
_SIDES = [f"{e}_{c}" for e in ("min", "max") for c in "xyz"]
_ABOUT = "edge double, radius double, buckets int, n long, " + ", ".join(f"{s} float" for s in _SIDES)


@dataclass(frozen=True)
class StoredCandidates:
    """An opened index: its octree, the largest radius it answers, the candidates' box and the bucketed table."""

    blocks: Blocks
    radius: float
    box: dict
    table: DataFrame


def _buckets(spark: SparkSession, rows: int) -> int:
    """As many as a shuffle has at least: with fewer, Spark would shuffle the table after all."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // CANDIDATE_ROWS))


def _store(df: DataFrame, path: str, buckets: int, by: list[str]) -> None:
    """One sorted file a bucket, through a table name that goes again."""
    name = f"stored_{uuid.uuid4().hex}"
    df.repartition(buckets, *by).write.bucketBy(buckets, *by).sortBy(*by).option("path", path).saveAsTable(name)
    df.sparkSession.sql(f"DROP TABLE {name}")


def _open(spark: SparkSession, path: str, columns: str, buckets: int, by: list[str]) -> DataFrame:
    name, keys = f"stored_{uuid.uuid4().hex}", ", ".join(by)
    quoted = path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {buckets} BUCKETS LOCATION '{quoted}'")
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return table


def _unused(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        raise FileExistsError(f"an index is written to a new folder, but {path} is there")


def store_candidates(candidates: DataFrame, path: str, radius: float, edge: float | None = None, split: int | None = None, buckets: int | None = None) -> None:
    """Writes an index of the finite candidates (x, y, z) for radii up to `radius` to a new folder.

    edge, split: as in nearest_squared_distance. A cloud without a finite point gives an index in which nothing is
    found. Coordinates too large for block keys are refused.
    """
    spark = candidates.sparkSession
    _unused(spark, path)
    candidates = apart(candidates.select("x", "y", "z"))
    box = bounding_box(candidates).first()
    tasks = spark.sparkContext.defaultParallelism
    edge = edge_within(box, radius, tasks) if edge is None else edge
    if box["n"] and not representable(box, edge):
        raise ValueError(f"coordinates of {box.asDict()} have no exact block keys at an edge of {edge:g}")
    usable = candidates.where(finite(*(F.col(c) for c in "xyz"))).select("x", "y", "z")
    blocks = octree(usable, edge, radius, min(SPLIT_ROWS, split or max(LEAST_SPLIT, box["n"] // (2 * tasks))))
    crowded = spark.createDataFrame([(*place, n) for place, n in blocks.crowded.items()], _CROWDED)
    holders = F.coalesce("holders", F.lit(1).cast("long"))
    held = in_blocks(usable, blocks, max(radius, 0.0) * SLACK).join(F.broadcast(crowded), PLACE, "left")
    held = held.select("x", "y", "z", *PLACE, F.pmod(F.xxhash64("x", "y", "z"), holders).alias("holder"), holders.alias("holders"))
    buckets = buckets or _buckets(spark, box["n"])
    _store(held, f"{path}/table", buckets, HELD)
    crowded.coalesce(1).write.parquet(f"{path}/crowded")
    spark.createDataFrame(blocks.halved, _HALVED).coalesce(1).write.parquet(f"{path}/halved")
    about = (float(edge), float(radius), buckets, box["n"], *(box[s] for s in _SIDES))
    spark.createDataFrame([about], _ABOUT).coalesce(1).write.parquet(f"{path}/about")


def open_candidates(spark: SparkSession, path: str) -> StoredCandidates:
    about = spark.read.schema(_ABOUT).parquet(f"{path}/about").first()
    halved = [tuple(r) for r in spark.read.schema(_HALVED).parquet(f"{path}/halved").collect()]  # MOST_BLOCKS rows at most, as crowded
    crowded = {tuple(r)[:4]: r["holders"] for r in spark.read.schema(_CROWDED).parquet(f"{path}/crowded").collect()}
    table = _open(spark, f"{path}/table", "x float, y float, z float, level int, bx long, by long, bz long, holder long, holders long", about["buckets"], HELD)
    return StoredCandidates(Blocks(about["edge"], halved, crowded), about["radius"], {s: about[s] for s in ("n", *_SIDES)}, table)


def nearest_stored(queries: DataFrame, index: StoredCandidates, radius: float, most_queries: int = QUERY_ROWS) -> DataFrame:
    """nearest_squared_distance over a stored index; only queries are shuffled.

    The radius must not exceed the index's. Blocks with over `most_queries` queries deal them to several tasks, and
    their candidates, no others, are shuffled to meet them; so are those of over-full blocks, which the kd-tree answers.
    """
    if radius > index.radius:
        raise ValueError(f"the index answers radii up to {index.radius:g}, not {radius:g}")
    null = F.lit(None).cast("float")
    if not index.box["n"]:
        return queries.withColumn("d2", null)
    spark, names = queries.sparkSession, queries.columns
    reach = max(radius, 0.0) * SLACK
    queries, inside = apart(queries), within_reach(index.box, reach)
    asked = in_blocks(queries.where(inside), index.blocks)
    full = in_blocks(queries.where(inside).select("x", "y", "z"), index.blocks).groupBy(*PLACE).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most_queries)
    askers = {tuple(r)[:4]: -(-r["n"] // most_queries) for r in full.orderBy(F.desc("n")).limit(MOST_BLOCKS).collect()}

    def search(left: pa.Table, right: pa.Table, names: list[str]) -> pa.Table:
        best = nearest_in_block(_points(left, ("x", "y", "z")), _points(right, ("x", "y", "z")), radius)
        best[best > np.float32(reach * reach)] = np.inf
        return left.select(names).append_column("d2", pa.array(best, mask=np.isinf(best)))

    def searched(left: DataFrame, right: DataFrame, keys: list[str], kept: list[str]) -> DataFrame:
        schema = left.limit(0).select(*kept).withColumn("d2", null).schema
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(lambda a, b: search(a, b, kept), schema)

    out, table = queries.where(~inside).withColumn("d2", null), index.table
    if index.blocks.crowded:
        dense = F.broadcast(spark.createDataFrame(list(index.blocks.crowded), _HALVED))
        held = table.where("holders > 1").select("x", "y", "z")
        out = out.unionByName(kd_squared_distance(asked.join(dense, PLACE, "left_semi").select(*names), held, radius))
        asked, table = asked.join(dense, PLACE, "left_anti"), table.where("holders = 1")
        askers = {place: n for place, n in askers.items() if place not in index.blocks.crowded}
    zero = F.lit(0).cast("long")
    if not askers:
        return out.unionByName(searched(asked.withColumn("holder", zero), table, HELD, names))
    parts = F.broadcast(spark.createDataFrame([(*place, n) for place, n in sorted(askers.items())], f"{_HALVED}, askers long"))
    asked = asked.join(parts, PLACE, "left").withColumns({"askers": F.coalesce("askers", F.lit(1).cast("long")), "holder": zero})
    asked = asked.withColumn("part", F.pmod(F.xxhash64(*names), F.col("askers")))
    dealt = table.drop("holders").join(parts, PLACE).withColumn("part", F.explode(F.sequence(zero, F.col("askers") - 1)))
    out = out.unionByName(searched(asked.where("askers = 1"), table, HELD, names))
    return out.unionByName(searched(asked.where("askers > 1"), dealt.drop("askers"), [*HELD, "part"], names))


def store_rays(scans: DataFrame, path: str, buckets: int | None = None) -> None:
    """Writes the rays of scan points (scan_id, x, y, z in the scanners' frames) to a new folder; they serve all tolerances and poses."""
    spark = scans.sparkSession
    _unused(spark, path)
    rays = scan_rays(apart(scans))
    buckets = buckets or _buckets(spark, scans.count())
    _store(rays, f"{path}/table", buckets, RAY)
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rays.schema)
    spark.createDataFrame([(buckets, columns)], "buckets int, columns string").coalesce(1).write.parquet(f"{path}/about")


def open_rays(spark: SparkSession, path: str) -> DataFrame:
    """Stored rays, for seen_pairs: points of the narrow tier meet them without a shuffle of the rays."""
    about = spark.read.schema("buckets int, columns string").parquet(f"{path}/about").first()
    return _open(spark, f"{path}/table", about["columns"], about["buckets"], RAY)
