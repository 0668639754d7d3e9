"""What both jobs share: configs, and point clouds taken from tables by SQL expressions."""

from __future__ import annotations

import json
import logging
import os

from pyspark.sql import DataFrame, SparkSession

from cloudgauge.config import Settings

LOG = logging.getLogger("jobs")


def config_beside(module_file: str) -> str:
    """The config file that lies beside a job."""
    return os.path.splitext(os.path.abspath(module_file))[0] + ".json"


def read_config(spark: SparkSession, path: str) -> dict:
    """A JSON file: of the driver's machine, or remote."""
    if "://" in path:
        return json.loads(spark.read.text(path, wholetext=True).first()[0])
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def settings_of(config: dict) -> Settings:
    return Settings(tuple(config["tolerances"]), **{k: config[k] for k in ("voxel_size", "beam_start_radius", "beam_halfangle_degrees") if k in config})


def cloud(rows: DataFrame, spec: dict) -> DataFrame:
    """Points from rows of a table: `where` keeps rows, each map of `derive` adds columns by SQL expressions, `keep` names the columns that stay."""
    out = rows.where(spec.get("where", "true"))
    for step in spec["derive"]:
        out = out.selectExpr("*", *(f"{e} AS {n}" for n, e in step.items()))
    return out.select(*spec["keep"])


def table_path(tables: str, spec: dict) -> str:
    return f"{tables.rstrip('/')}/{spec['table']}.parquet"


def arguments(description: str, module_file: str, *more: tuple[str, str]):
    """The command line of a job."""
    import argparse

    p = argparse.ArgumentParser(description=description)
    p.add_argument("--tables", required=True, help="folder of the tables")
    p.add_argument("--output", required=True, help="folder that gets the output")
    p.add_argument("--config", default=config_beside(module_file), help="JSON file")
    for name, text in more:
        p.add_argument(name, required=True, help=text)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    return p
