"""Files by path or URI, through pyarrow's file systems."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import SparkSession


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path in it; a path without a scheme is local."""
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")  # Spark also writes file:/path


def size(path: str) -> int | None:
    """Bytes of a file; None if there is none."""
    system, name = opened(path)
    info = system.get_file_info(name)
    return info.size if info.type == fs.FileType.File else None


def read(path: str, start: int = 0, length: int | None = None) -> bytes:
    system, name = opened(path)
    with system.open_input_file(name) as f:
        f.seek(start)
        return f.read(length) if length is not None else f.read()


def shared_base(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; only a local session may do without."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if where:
        return where.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return str(current.get())
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    where = "file://" + tempfile.mkdtemp(prefix="cloudgauge-")
    spark.sparkContext.setCheckpointDir(where)
    return where


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_base(spark)}/{uuid.uuid4().hex}-{name}"
