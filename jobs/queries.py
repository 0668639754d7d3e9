"""The jobs as registered queries, over the whole tables, each with its DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from cloudgauge.plans import queries as plans
from cloudgauge.sources.files import shared_base

from . import growing_coverage, quality_tiles
from .clouds import config_beside, read_config


def job1_quality_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs into one new folder; the output as it stands after the second."""
    config, output = read_config(spark, config_beside(quality_tiles.__file__)), f"{shared_base(spark)}/job1-{uuid.uuid4().hex}"
    quality_tiles.run(spark, sf_dir, output, config)
    return quality_tiles.run(spark, sf_dir, output, config)


def job2_growing_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs into one new folder and checkpoint; the second finds nothing new. The output as it stands then."""
    config, folder = read_config(spark, config_beside(growing_coverage.__file__)), f"{shared_base(spark)}/job2-{uuid.uuid4().hex}"
    growing_coverage.run(spark, sf_dir, f"{folder}/output", f"{folder}/checkpoint", config)
    return growing_coverage.run(spark, sf_dir, f"{folder}/output", f"{folder}/checkpoint", config)


QUERIES = {"job1_quality_tiles": job1_quality_tiles, "job2_growing_coverage": job2_growing_coverage}

_TILE = ", ".join(f"CAST(floor(v{c} / 4::DOUBLE) AS INTEGER) AS t{c}" for c in "xyz")
_TILES_SQL = f"""{plans.BOTH_CELLS}, complete_tiles AS (
  SELECT {_TILE}, count(*) AS scan_voxels, CAST(sum(n) AS BIGINT) AS scan_points, {", ".join(f"avg(CAST(c{t} AS DOUBLE) / n) AS c{t}" for t in plans.T)} FROM banded_cells GROUP BY ALL
), accurate_tiles AS (
  SELECT tx, ty, tz, {", ".join(f"avg(CAST(r{t} AS DOUBLE)) AS a{t}, count(r{t}) AS s{t}" for t in plans.T)}
  FROM (SELECT {_TILE}, {", ".join(f"CASE WHEN a{t} + i{t} > 0 THEN {plans.RATIO.format(t=t)} END AS r{t}" for t in plans.T)} FROM seen_cells) GROUP BY ALL
), both_tiles AS (SELECT * FROM complete_tiles FULL JOIN accurate_tiles USING (tx, ty, tz))
""" + " UNION ALL ".join(
    f"""SELECT CAST({v!r} AS FLOAT) AS tolerance, tx, ty, tz, coalesce(scan_voxels, 0) AS scan_voxels, coalesce(scan_points, 0) AS scan_points,
    round(c{t}, 6) AS completeness, coalesce(s{t}, 0) AS seen_voxels, round(a{t}, 6) AS accuracy,
    round(CASE WHEN c{t} + a{t} > 0 THEN 2 * c{t} * a{t} / (c{t} + a{t}) WHEN c{t} + a{t} = 0 THEN 0 END, 6) AS f1, {t} AS tolerance_index FROM both_tiles"""
    for t, v in enumerate(plans.S.tolerances)
)

#: The tolerances of growing_coverage.json.
_WITHIN = (0.0625, 0.125, 0.25, 0.5, 1.0)
_MEASURED = r"""SELECT {key}, length(coalesce(text, '')) AS chars, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words, len(regexp_extract_all(coalesce(text, ''), '[.!?]+')) AS ends FROM {table}"""
_POINTS = "SELECT {key}, CAST(CASE WHEN words > 0 THEN chars / words ELSE 0 END AS FLOAT) AS x, CAST(words / (4 * (1 + ends)) AS FLOAT) AS y, CAST(chars / 256 AS FLOAT) AS z FROM ({rows})"
_COVERAGE_SQL = f"""
WITH ground AS ({_POINTS.format(key="key", rows=_MEASURED.format(key="item_id AS key", table="benchmark"))}),
arriving AS ({_POINTS.format(key="1 AS one", rows=_MEASURED.format(key="1 AS one", table="documents"))}),
near AS (
  SELECT key, min(((g.x - a.x) * (g.x - a.x) + (g.y - a.y) * (g.y - a.y)) + (g.z - a.z) * (g.z - a.z)) AS d2
  FROM ground AS g JOIN arriving AS a ON a.x BETWEEN g.x - 1.01 AND g.x + 1.01 AND a.y BETWEEN g.y - 1.01 AND g.y + 1.01 AND a.z BETWEEN g.z - 1.01 AND g.z + 1.01 GROUP BY key
), capped AS (SELECT g.key, x, y, z, CASE WHEN d2 < CAST(1 AS FLOAT) THEN d2 END AS d2 FROM ground AS g LEFT JOIN near AS n ON n.key = g.key)
SELECT *, CAST(CASE WHEN d2 IS NULL THEN {len(_WITHIN)} {" ".join(f"WHEN d2 <= CAST({w * w!r} AS FLOAT) THEN {t}" for t, w in enumerate(_WITHIN))} ELSE {len(_WITHIN)} END AS INTEGER) AS band FROM capped
"""

ORACLES = {"job1_quality_tiles": _TILES_SQL, "job2_growing_coverage": _COVERAGE_SQL}
