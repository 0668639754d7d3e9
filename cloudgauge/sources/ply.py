"""PLY point clouds: a splittable Spark data source, and an ordered sink of coloured clouds.

Accepted is `binary_little_endian 1.0` with float x, y, z among any scalar vertex properties.
Vertices have a fixed size, so partitions are ranges of them and each task reads its own bytes;
only the coordinates are taken out of a record. `general` reading also takes ASCII, big-endian and
double coordinates. Numbers of an ASCII file are counted by ranges of bytes first, so that a task knows
which vertices begin in its range. `df.write.format("ply")` writes rows in the order of their
partitions, as one file or, with several sets of colours, as one file for each in a single pass.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from . import files

SCHEMA = "point_index long, x float, y float, z float"
HEADER_BYTES, LARGEST_RECORD, LARGEST_COUNT, BATCH = 64 << 10, 4096, 2**32 - 1, 1 << 16
#: Vertices of a partition; bytes of one of an ASCII file; bytes that a commit copies at a time.
SPLIT, ASCII_SPLIT, COPY_BYTES = 2_000_000, 32 << 20, 16 << 20
COLOURS = ("red", "green", "blue")

#: Scalar type names of the format.
TYPES = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}


class PlyUnreadable(OSError):
    """There is no such file, or it ends before its vertices do."""


class PlyUnsupported(ValueError):
    """The file is of a variant that is not read."""


@dataclass
class Header:
    """Where vertices begin, how many there are, and what each holds: name and type, in order."""

    count: int = 0
    offset: int = 0
    order: str = "<"
    properties: list[tuple[str, str]] = field(default_factory=list)

    @property
    def record(self) -> np.dtype:
        return np.dtype({"names": [f"{k}:{n}" for k, (n, _) in enumerate(self.properties)], "formats": [self.order + t for _, t in self.properties]})

    def place(self, name: str) -> str | None:
        return next((f"{k}:{n}" for k, (n, _) in enumerate(self.properties) if n == name), None)


def _count(text: str) -> int:
    if not re.fullmatch(r"[0-9]{1,20}", text) or int(text) >= 2**64:
        raise PlyUnsupported(f"not a count: {text!r}")
    return int(text)


def parse_header(data: bytes, general: bool = False) -> Header:
    """The header at the start of a file's bytes."""
    out, at, formats, vertex, elements, ended = Header(), 0, 0, None, [], False
    need = PlyUnsupported
    while not ended:
        end = data.find(b"\n", at, HEADER_BYTES)
        if end < 0:
            raise need("the header does not end in time")
        line = data[at:end].decode("latin-1").removesuffix("\r")
        first, at = at == 0, end + 1
        words = [w for w in re.split(r"[ \t]+", line) if w]
        if first:
            if words != ["ply"]:
                raise need("the first line is not `ply`")
            continue
        if not words:
            raise need("a header line is blank")
        keyword = words[0]
        if keyword == "comment":
            continue
        if keyword == "format":
            formats += 1
            known = {"binary_little_endian": "<"} | ({"binary_big_endian": ">", "ascii": "a"} if general else {})
            if formats > 1 or len(words) != 3 or words[1] not in known or words[2] != "1.0":
                raise need(f"format {' '.join(words[1:])}")
            out.order = known[words[1]]
        elif keyword == "element":
            if len(words) != 3:
                raise need("an element needs a name and a count")
            name, count = words[1], _count(words[2])
            if name == "vertex":
                if vertex is not None:
                    raise need("two vertex elements")
                vertex, out.count = len(elements), count
            elif count and (vertex is None or name not in ("face", "camera")):
                raise need(f"an element {name} with data")
            elements.append(name)
        elif keyword == "property":
            if not elements:
                raise need("a property before any element")
            is_list, inside = len(words) > 1 and words[1] == "list", elements[-1] == "vertex"
            if is_list and inside:
                raise need("a list among the vertex properties")
            if len(words) != (5 if is_list else 3) or (inside and words[1] not in TYPES):
                raise need(f"property {' '.join(words[1:])}")  # types matter only where records are read
            if inside:
                kind, name = TYPES[words[1]], words[2]
                if name in "xyz" and len(name) == 1 and (any(n == name for n, _ in out.properties) or kind not in (("f4", "f8") if general else ("f4",))):
                    raise need(f"coordinate {name} repeats or is not a float")
                out.properties.append((name, kind))
        elif keyword == "end_header":
            if len(words) > 1:
                raise need("end_header is followed by more words")
            ended = True
        else:
            raise need(f"unknown keyword {keyword}")
    if not formats or vertex is None or not out.properties:
        raise need("no format, no vertex element or no vertex property")
    if out.count > LARGEST_COUNT or sum(np.dtype(t).itemsize for _, t in out.properties) > LARGEST_RECORD:
        raise need("too many vertices, or records too large")
    out.offset = at
    return out


def read_header(path: str, general: bool = False) -> Header:
    """The header of a file, whose vertices are then known to be there in full."""
    there = files.size(path)
    if not there:
        raise PlyUnreadable(f"{path}: no such file, or it is empty")
    header = parse_header(files.read(path, 0, HEADER_BYTES), general)
    if header.order != "a" and there < header.offset + header.count * header.record.itemsize:
        raise PlyUnreadable(f"{path}: the file ends before its vertices do")
    return header


def _batches(header: Header, data: bytes, first: int, colours: bool) -> Iterator[pa.RecordBatch]:
    rows = np.frombuffer(data, header.record)
    wanted = [*((c, "<f4") for c in "xyz"), *((c, "<i2") for c in COLOURS if colours)]
    for at in range(0, len(rows), BATCH):
        part = rows[at : at + BATCH]
        own = [np.ascontiguousarray(part[p]).astype(kind) if (p := header.place(c)) else np.zeros(len(part), kind) for c, kind in wanted]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(first + at, first + at + len(part))), *map(pa.array, own)], names=["point_index", *(c for c, _ in wanted)])


@dataclass
class _Range(InputPartition):
    path: str
    header: Header
    first: int
    count: int
    start: int = 0
    stop: int | None = None


class _Reader(DataSourceReader):
    def __init__(self, path: str, general: bool, colours: bool, index: str = ""):
        self.path, self.general, self.colours, self.index = path, general, colours, index

    def partitions(self) -> list[_Range]:
        header = read_header(self.path, self.general)
        if header.order == "a":
            ranges = json.loads(self.index) if self.index else [(header.offset, None, 0)]
            return [_Range(self.path, header, first, 0, start, stop) for start, stop, first in ranges]
        return [_Range(self.path, header, a, min(SPLIT, header.count - a)) for a in range(0, max(header.count, 1), SPLIT)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        header, size = partition.header, partition.header.record.itemsize if partition.header.order != "a" else 0
        if header.order == "a":
            yield from _ascii_batches(partition)
            return
        for at in range(partition.first, partition.first + partition.count, BATCH):
            n = min(BATCH, partition.first + partition.count - at)
            yield from _batches(header, files.read(partition.path, header.offset + at * size, n * size), at, self.colours)


def _numbers(path: str, start: int, stop: int | None) -> tuple[list[bytes], int]:
    """Numbers that begin in a range of bytes, whole, and where the next one may begin."""
    data = files.read(path, start, None if stop is None else stop - start)
    end = start + len(data)
    while stop is not None and data and not data[-1:].isspace():  # the last one may go on behind the range
        more = files.read(path, end, 64)
        here = next((k for k in range(len(more)) if more[k : k + 1].isspace()), len(more))
        data, end = data + more[:here], end + here
        if here < 64:
            break
    if start and data and not files.read(path, start - 1, 1).isspace():  # the first one belongs to the range before
        data = data[next((k for k in range(len(data)) if data[k : k + 1].isspace()), len(data)) :]
    return data.split(), end


def _ascii_batches(partition: _Range) -> Iterator[pa.RecordBatch]:
    """The vertices whose first number begins in a range; `first` is the place of the range's first number."""
    header = partition.header
    width = len(header.properties)
    words, end = _numbers(partition.path, partition.start, partition.stop)
    skip = -partition.first % width
    vertex = -(-partition.first // width)
    most = header.count - vertex
    number = min(most, -(-max(0, len(words) - skip) // width))
    while skip + number * width > len(words):  # a vertex that begins here may end in later ranges
        more, end = _numbers(partition.path, end, end + 4096)
        if not more and not files.read(partition.path, end, 1):
            raise PlyUnreadable(f"{partition.path}: the file ends before its vertices do")
        words += more
    if partition.stop is None and number < most:
        raise PlyUnreadable(f"{partition.path}: the file ends before its vertices do")
    if number <= 0:
        return
    names = [n for n, _ in header.properties]
    for at in range(0, number, BATCH):
        n = min(BATCH, number - at)
        values = np.array(words[skip + at * width : skip + (at + n) * width], "S").astype("f8").reshape(-1, width)
        own = [(values[:, names.index(c)] if c in names else np.zeros(len(values))).astype("<f4") for c in "xyz"]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(vertex + at, vertex + at + n)), *map(pa.array, own)], names=["point_index", "x", "y", "z"])


def ascii_index(spark: SparkSession, path: str, header: Header) -> list[tuple[int, int | None, int]]:
    """Ranges of bytes of an ASCII file, and how many numbers begin before each: counted by tasks, a row a range."""
    there, split = files.size(path), ASCII_SPLIT
    edges = [*range(header.offset, max(there, header.offset + 1), split), there]
    if len(edges) == 2:
        return [(header.offset, None, 0)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([len(_numbers(path, edges[k], edges[k + 1])[0])])], names=["k", "n"])

    parts = len(edges) - 1
    counts = dict(tuple(r) for r in spark.range(0, parts, 1, parts).mapInArrow(run, "k long, n long").collect())
    before = np.cumsum([0, *(counts[k] for k in range(parts))]).tolist()
    if before[-1] < header.count * len(header.properties):
        raise PlyUnreadable(f"{path}: the file ends before its vertices do")
    return [(edges[k], edges[k + 1], before[k]) for k in range(parts)]


class PlySource(DataSource):
    """`spark.read.format("ply")`; options: path, general=true for further variants, colours=true for red, green and blue of binary files, index: ranges of an ASCII file.

    `df.write.format("ply")` takes x, y, z, red, green, blue; or, with the option `names`, a list of endings as JSON, red_0, green_0, blue_0
    and so on, one set for each file, whose path is `path` with the ending. Overwriting is the only mode.
    """

    @classmethod
    def name(cls) -> str:
        return "ply"

    def _is(self, option: str) -> bool:
        return self.options.get(option, "false").lower() == "true"

    def schema(self) -> str:
        return SCHEMA + "".join(f", {c} short" for c in COLOURS if self._is("colours"))

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self._is("general"), self._is("colours"), self.options.get("index", ""))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        if not overwrite:
            raise ValueError("a cloud is overwritten as a whole")
        return _Writer(self.options["path"], json.loads(self.options.get("names", '[""]')), schema.names)


def read_cloud(spark: SparkSession, path: str, general: bool = False, colours: bool = False) -> DataFrame:
    """(point_index, x, y, z) of a file; `colours` adds red, green, blue (0 where a binary file has none). Faults of the file are raised here, as PlyUnreadable or PlyUnsupported."""
    if read_header(path, general).order == "a" and colours:
        raise PlyUnsupported("colours of an ASCII file")
    spark.dataSource.register(PlySource)
    header = read_header(path, general)
    index = json.dumps(ascii_index(spark, path, header)) if header.order == "a" else ""
    return spark.read.format("ply").option("general", str(general)).option("colours", str(colours)).option("index", index).load(path)


def is_dense(spark: SparkSession, path: str) -> bool:
    """Whether all float properties of all vertices are finite; one aggregate over ranges of vertices."""
    header = read_header(path)
    size = header.record.itemsize
    floats = [n for n, (_, t) in zip(header.record.names, header.properties, strict=True) if t[0] == "f"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.column(0).to_pylist():
                dense = True
                for at in range(part * SPLIT, min(header.count, (part + 1) * SPLIT), BATCH):
                    n = min(BATCH, header.count - at, (part + 1) * SPLIT - at)
                    rows = np.frombuffer(files.read(path, header.offset + at * size, n * size), header.record)
                    dense = dense and all(np.isfinite(rows[n]).all() for n in floats)
                yield pa.RecordBatch.from_arrays([pa.array([dense])], names=["dense"])

    parts = max(1, -(-header.count // SPLIT))
    return spark.range(0, parts, 1, parts).mapInArrow(run, "dense boolean").agg(F.bool_and("dense")).first()[0]


#: Properties of the camera record that follows the vertices.
_CAMERA = ("view_px", "view_py", "view_pz", "x_axisx", "x_axisy", "x_axisz", "y_axisx", "y_axisy", "y_axisz", "z_axisx", "z_axisy", "z_axisz", "focal", "scalex", "scaley", "centerx", "centery")


def coloured_header(count: int) -> bytes:
    lines = ["ply", "format binary_little_endian 1.0", "comment coloured point cloud", f"element vertex {count}"]
    lines += [f"property float {c}" for c in "xyz"] + [f"property uchar {c}" for c in ("red", "green", "blue")]
    lines += ["element face 0", "property list uchar int vertex_indices", "element camera 1"]
    lines += [f"property float {c}" for c in _CAMERA] + ["property int viewportx", "property int viewporty", "property float k1", "property float k2", "end_header"]
    return ("\n".join(lines) + "\n").encode()


_VERTEX = np.dtype([*((c, "<f4") for c in "xyz"), *((c, "u1") for c in COLOURS)])


@dataclass
class _Part(WriterCommitMessage):
    """What a task has written: its place, and a file of vertices for each set of colours."""

    place: int
    names: list[str]
    count: int


class _Writer(DataSourceArrowWriter):
    """Tasks write their rows as bytes beside the target, a file for each set of colours; the commit strings them together.

    Only committed tasks' files count, so a task that is run again does no harm. The parts go when the
    job is committed or aborted. A file appears under its name when it is whole. As stores give a file one writer,
    the committing process copies the parts' bytes, COPY_BYTES at a time. An empty cloud gives no file.
    """

    def __init__(self, path: str, endings: list[str], columns: list[str]):
        self.path, self.endings, self.columns = path, endings, columns
        self.parts = f"{path}.parts-{uuid.uuid4().hex}"
        system, base = files.opened(self.parts)
        system.create_dir(base, recursive=True)  # not by tasks: one that is still running when the job is aborted then finds no folder

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Part:
        system, base = files.opened(self.parts)
        names, outs, count = [f"{base}/{uuid.uuid4().hex}" for _ in self.endings], [], 0
        sets = [[*"xyz", *COLOURS]] if self.endings == [""] else [[*"xyz", *(f"{c}_{k}" for c in COLOURS)] for k in range(len(self.endings))]
        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                if not outs:
                    outs.extend(system.open_output_stream(n) for n in names)
                for out, columns in zip(outs, sets, strict=True):
                    rows = np.empty(batch.num_rows, _VERTEX)
                    for own, column in zip(_VERTEX.names, columns, strict=True):
                        rows[own] = batch.column(self.columns.index(column)).to_numpy(zero_copy_only=False)
                    out.write(rows.tobytes())
                count += batch.num_rows
        finally:
            for out in outs:
                out.close()
        return _Part(TaskContext.get().partitionId(), names, count)

    def commit(self, messages: list[_Part | None]) -> None:
        parts = sorted((m for m in messages if m is not None and m.count), key=lambda m: m.place)
        count = sum(m.count for m in parts)
        try:
            for k, ending in enumerate(self.endings if parts else []):
                system, name = files.opened(self.path + ending)
                if parent := name.rpartition("/")[0]:
                    system.create_dir(parent, recursive=True)
                whole = f"{files.opened(self.parts)[1]}/whole"
                with system.open_output_stream(whole) as out:
                    out.write(coloured_header(count))
                    for m in parts:
                        with system.open_input_stream(m.names[k]) as held:
                            while piece := held.read(COPY_BYTES):
                                out.write(piece)
                    pose = [0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0]
                    out.write(struct.pack("<17f2i2f", *pose, count, 1, 0.0, 0.0))
                system.move(whole, name)
        finally:
            self._clear()

    def abort(self, messages: list[_Part | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        system, base = files.opened(self.parts)
        if system.get_file_info(base).type == fs.FileType.Directory:
            system.delete_dir(base)


def write_coloured(cloud: DataFrame, path: str, order: str = "point_index") -> bool:
    """Writes (x, y, z, red, green, blue) as one file of 15-byte vertices by ascending `order`; False, and no file, for an empty cloud."""
    return bool(write_clouds(cloud.withColumns({f"{c}_0": F.col(c) for c in COLOURS}), path, [""], order))


def write_clouds(cloud: DataFrame, path: str, endings: list[str], order: str) -> list[str]:
    """Writes (x, y, z, red_0, green_0, blue_0, red_1, ...) as a file for each set of colours, all in one sorted pass; the paths, none for an empty cloud."""
    cloud.sparkSession.dataSource.register(PlySource)
    bare = endings == [""]
    colours = [F.col(f"{c}_{k}").cast("short").alias(c if bare else f"{c}_{k}") for k in range(len(endings)) for c in COLOURS]
    rows = cloud.orderBy(order).select(*(F.col(c).cast("float").alias(c) for c in "xyz"), *colours)
    for ending in endings:  # what is there from an earlier run must not pass for this one's
        system, name = files.opened(path + ending)
        if system.get_file_info(name).type == fs.FileType.File:
            system.delete_file(name)
    rows.write.format("ply").mode("overwrite").option("names", json.dumps(endings)).save(path)
    return [path + e for e in endings if files.size(path + e)]
