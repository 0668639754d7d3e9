"""Shared plumbing: the shared folder, whole-text Arrow batches, words."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import shared_base

#: Text bytes that a worker handles at a time, so that its memory does not follow the batch.
CHUNK_BYTES = 4 << 20
#: Rows of a file of a narrow intermediate table.
FILE_ROWS = 1 << 16
#: Rows and key bytes of a lookup table that is broadcast, and keys over which the rows that ask a larger one are dealt.
BROADCAST_ROWS, BROADCAST_BYTES, SALTS = 100_000, 16 << 20, 64


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_base(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Cuts the lineage: writes df to the shared folder and reads it back. The table goes when the application ends."""
    path = fresh_dir(df.sparkSession, label)
    df.write.parquet(path)
    dropped_at_end(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _target(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def dropped_at_end(spark: SparkSession, path: str) -> None:
    """Deletes a path of the shared folder when the driver ends in order."""
    system, target = _target(spark, path)
    system.deleteOnExit(target)


def looked_up(rows: DataFrame, table: DataFrame, key: str, on: Column, dealt: Column, how: str = "inner", most: int = BROADCAST_ROWS) -> DataFrame:
    """rows (as `d`) joined with a written table (as `p`) of one row a key by the condition `on`, at any share of rows that one key holds.

    A table of at most `most` rows and BROADCAST_BYTES of keys is broadcast, and the rows stay where they
    are. A larger one is copied to SALTS keys, over which rows are dealt by the hash of `dealt`, an expression of theirs
    that tells rows of one key apart. An empty table, or one without keys, is broadcast.
    """
    n, size = table.agg(F.count(F.lit(1)), F.sum(F.octet_length(F.col(key).cast("string")))).first()
    if n <= most and (size or 0) <= BROADCAST_BYTES:
        return rows.alias("d").join(F.broadcast(table).alias("p"), on, how)
    salt, copy = free_name(rows, "_salt"), free_name(table, "_copy")
    asked = rows.withColumn(salt, F.pmod(F.xxhash64(dealt), F.lit(SALTS)).cast("int"))
    copies = table.withColumn(copy, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return asked.alias("d").join(copies.alias("p"), on & (F.col(f"d.{salt}") == F.col(f"p.{copy}")), how)


def files_for(rows: int) -> int:
    """Files, and tasks that write them, of a narrow table: as many as its rows ask for, not one a shuffle partition."""
    return max(1, -(-rows // FILE_ROWS))


def dropped(spark: SparkSession, path: str) -> None:
    """Deletes a path of the shared folder that no result reads any more."""
    system, target = _target(spark, path)
    system.delete(target, True)


def file_system(uri: str):
    """(pyarrow file system, path) of a URI; a path without a scheme is local."""
    from pyarrow import fs

    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def crc_fold(key: str, modulus: int) -> Column:
    """crc32 of the key as text, modulo; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % modulus


def chunks(batch: pa.RecordBatch, column: str | int, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have about `most` bytes; a longer text comes alone."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    groups = np.cumsum(sizes) // most
    starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    for a, b in zip(starts, np.r_[starts[1:], len(sizes)], strict=True):
        yield batch.slice(int(a), int(b - a))


def by_run(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[object, list[pa.RecordBatch]]]:
    """Each run of rows of one value in a column: the value, and the slices that hold it. Only one run is held."""
    value, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        codes = batch.column(column).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(codes)], strict=True):
            if held and codes[a] != value:
                yield value, held
                held = []
            value = codes[a].item()
            held.append(batch.slice(a, b - a))
    if held:
        yield value, held


def named(column: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + column.replace("`", "``") + "`")


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores before it until no column has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def carried(docs: DataFrame, text: str, kept: list[str]) -> tuple[DataFrame, int, list[int]]:
    """docs with the columns `kept` and the text, which travels once; where the text is, and where those of `kept` are.

    Columns are named by their places, as mapInArrow fails on names with dots.
    """
    names = [c.lower() for c in kept]
    own = [] if text.lower() in names else [text]
    where = len(kept) if own else names.index(text.lower())
    return docs.select(*(named(c).alias(f"c{k}") for k, c in enumerate([*kept, *own]))), where, list(range(len(kept)))


def ascii_words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, pa.Array]:
    """Words `[^\\x20\\x09-\\x0D]+` of each text: how many each has, and all of them in order.

    A null text has none. With `lower`, A-Z are lower-cased and nothing else.
    """
    # (ascii_lower of a slice of large_string reads the wrong bytes in pyarrow 23; string is right)
    texts = pc.fill_null(texts.cast(pa.string()), "")
    if lower:
        texts = pc.ascii_lower(texts)
    parts = pc.ascii_split_whitespace(texts)
    flat, count = parts.flatten(), np.diff(parts.offsets.to_numpy()).astype(np.int64)
    keep = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0  # white space at an end leaves an empty part
    if not keep.all():
        count = np.bincount(np.repeat(np.arange(len(count)), count), keep, len(count)).astype(np.int64)
        flat = flat.filter(pa.array(keep))
    return count, flat


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )
