"""Scan projects: an XML file that names posed scan meshes; one is read as a list, many by a Spark data source."""

from __future__ import annotations

import os
import sys
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import files


class ProjectError(ValueError):
    """The project file cannot be used."""


@dataclass(frozen=True)
class Scan:
    """A mesh of the project: its place, label, file and mesh-to-global matrix (row-major, 16 float32 values)."""

    scan_id: int
    label: str | None
    filename: str
    pose: tuple[float, ...]


def read_project(path: str) -> list[Scan]:
    """The scans of the first MeshGroup, in order; a missing label is a warning, other faults are errors."""
    if not files.size(path):
        raise ProjectError(f"{path}: no such file, or it is empty")
    try:
        root = ET.fromstring(files.read(path))
    except ET.ParseError as e:
        raise ProjectError(f"{path}: {e}") from e
    if root.tag != "MeshLabProject":
        raise ProjectError(f"{path}: the root is not MeshLabProject")
    group = root.find("MeshGroup")
    if group is None:
        raise ProjectError(f"{path}: there is no MeshGroup")
    out = []
    for k, mesh in enumerate(group.findall("MLMesh")):
        label, filename, matrix = mesh.get("label"), mesh.get("filename"), mesh.find("MLMatrix44")
        if label is None:
            print(f"Warning: mesh {k} has no label", file=sys.stderr)
        if filename is None or matrix is None:
            raise ProjectError(f"{path}: mesh {k} has no filename or no MLMatrix44")
        try:
            values = [float(np.float32(v)) for v in (matrix.text or "").split()]
        except ValueError as e:
            raise ProjectError(f"{path}: mesh {k}: {e}") from e
        if len(values) < 16:
            raise ProjectError(f"{path}: the matrix of mesh {k} has {len(values)} numbers")
        out.append(Scan(k, label, filename, tuple(values[:16])))
    return out


def check_poses(scans: list[Scan]) -> None:
    for s in scans:
        if s.pose[12:] != (0.0, 0.0, 0.0, 1.0):
            raise ProjectError(f"the last row of the matrix of mesh {s.scan_id} is not 0 0 0 1")


def resolved(project: str, filename: str) -> str:
    """A scan's path: as it is if it is absolute or empty, else beside the project file."""
    return filename if not filename or os.path.isabs(filename) or "://" in filename else os.path.join(os.path.dirname(project), filename)


@dataclass
class _Project(InputPartition):
    path: str


class _Projects(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[_Project]:
        """A partition for each project file; of a folder, for each *.mlp in it or below."""
        system, name = files.opened(self.path)
        if system.get_file_info(name).type != fs.FileType.Directory:
            return [_Project(self.path)]
        inside = sorted(f.path for f in system.get_file_info(fs.FileSelector(name, recursive=True)) if f.path.endswith(".mlp"))
        return [_Project(self.path.rstrip("/") + f[len(name.rstrip("/")) :]) for f in inside]

    def read(self, partition: _Project) -> Iterator[tuple]:
        scans = read_project(partition.path)
        check_poses(scans)
        for s in scans:
            yield partition.path, s.scan_id, s.label, resolved(partition.path, s.filename), list(s.pose)


class ProjectSource(DataSource):
    """`spark.read.format("scanproject").load(path)`: the scans of a project file, or of all those below a folder, by the rules of read_project and check_poses; a faulty file fails the read."""

    @classmethod
    def name(cls) -> str:
        return "scanproject"

    def schema(self) -> str:
        return "project string, scan_id int, label string, path string, pose array<float>"

    def reader(self, schema) -> DataSourceReader:
        return _Projects(self.options["path"])


def read_projects(spark: SparkSession, path: str) -> DataFrame:
    """(project, scan_id, label, path, pose) of a project file or of all project files below a folder."""
    spark.dataSource.register(ProjectSource)
    return spark.read.format("scanproject").load(path)
