"""Operator 12: near-duplicate embeddings by Euclidean p-stable hashing.

Equal vectors of a label are merged first. A merged vector, brought to length 1, is hashed by tables; a table
has some random normal projections, each shifted and cut into buckets of a width, and its key names
the buckets of all of them. Two vectors at the distance that the least cosine stands for share a
projection's bucket with a known probability, and so do unlike ones; from these come the number
of projections, by which unlike vectors seldom meet, and that of tables, by which the recall is reached.
Only keys of two vectors or more are followed: their vectors meet in blocks, each pair of blocks is a
task's work, and exact cosines decide. A pair is counted in the first table that both share, so a
task sends each vector's number of links and a spanning forest of them, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from math import ceil, erfc, exp, log, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_of, by_run, files_for, named, read_table, written
from .simhash import Forest, _looked_up, components

#: Least cosine; share of the pairs at just that cosine that some table brings together; width of a bucket; unlike vectors that one meets in a table on average, about.
COSINE, RECALL, WIDTH, MET = 0.93, 0.999, 2.0, 1 / 16
#: Vectors of a block, and of a side of a product of cosines.
BLOCK, SIDE, SEED = 1024, 256, 12
#: Low bits of a key, which name its table.
TABLE_BITS = 16


def meeting(distance: float, width: float = WIDTH) -> float:
    """Probability that a projection puts two vectors of this distance into one bucket."""
    u = width / distance
    return 1 - erfc(u / sqrt(2)) - 2 / (sqrt(2 * pi) * u) * (1 - exp(-u * u / 2))


@cache
def _drawn(dimensions: int, projections: int, width: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Directions, shifts and the factors that hash buckets; the same in every task."""
    rng = np.random.default_rng([SEED, dimensions])
    return rng.normal(size=(dimensions, projections)), rng.uniform(0, width, projections), rng.integers(0, 1 << 64, projections, np.uint64) | np.uint64(1)


@dataclass(frozen=True)
class Tables:
    """Numbers of tables and of projections of each, width of the buckets."""

    tables: int
    projections: int
    width: float = WIDTH

    @staticmethod
    def for_rows(rows: int, cosine: float = COSINE, recall: float = RECALL, met: float = MET, width: float = WIDTH) -> Tables:
        """Tables for a label with so many different vectors; unlike ones are taken to be orthogonal."""
        near, far = meeting(sqrt(2 - 2 * cosine), width), meeting(sqrt(2), width)
        projections = max(1, ceil(log(max(rows, 1) / met) / -log(far)))
        tables = ceil(log(1 - recall) / log(1 - near**projections))
        if tables >> TABLE_BITS:
            raise ValueError(f"{tables} tables would be needed; ask for less recall or a greater cosine")
        return Tables(tables, projections, width)

    def keys(self, x: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """Keys of unit vectors, a row each and a column for each table; other labels and widths have other keys."""
        turn, shift, factor = _drawn(x.shape[1], self.tables * self.projections, self.width)
        out = np.empty((len(x), self.tables), np.uint64)
        with np.errstate(over="ignore"):
            own = labels.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(x.shape[1])
            for at in range(0, len(x), 256):
                cell = np.floor((x[at : at + 256] @ turn + shift) / self.width).astype(np.int64).view(np.uint64)
                h = (cell * factor).reshape(len(cell), self.tables, -1).sum(2, dtype=np.uint64) + own[at : at + 256, None]
                h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
                out[at : at + 256] = (h ^ (h >> np.uint64(29))) << np.uint64(TABLE_BITS) | np.arange(self.tables, dtype=np.uint64)
        return out.view(np.int64)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows brought to length 1, whatever their size."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


_MARKED = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("x", pa.binary()), ("node", pa.binary())])


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each vector as bytes of doubles, and its name: a 128-bit hash of label and bytes; neither where it takes no part."""
    for batch in batches:
        xs, nodes = [], []
        offsets, flat = batch.column(2).offsets.to_numpy(), batch.column(2).values.to_numpy(zero_copy_only=False)
        usable = batch.column(3).to_numpy(zero_copy_only=False)
        for label, a, b, used in zip(batch.column(1).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), usable.tolist(), strict=True):
            own = (flat[a:b] + 0.0).astype("<f8").tobytes() if used else None  # no negative zeros
            xs.append(own)
            nodes.append(xxhash.xxh3_128_digest(own, label & (1 << 64) - 1) if used else None)
        yield batch_of(_MARKED, batch.column(0), batch.column(1), xs, nodes)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(len(column), -1)


def _by_width(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Rows of a batch whose vectors have one width together."""
    size = np.array([len(x) for x in batch.column(column).to_pylist()], np.int64)
    for width in np.unique(size):
        yield batch.filter(pa.array(size == width))


_KEYED = pa.schema([("key", pa.int64()), ("node", pa.binary())])
_FOUND = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("n", pa.int64())])


def compared(x: np.ndarray, first: int, within: bool, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of unit vectors with the least cosine: of the first rows with the later ones, or, within a block, of all rows."""
    for i in range(0, first, SIDE):
        for j in range(i if within else first, len(x), SIDE):
            a, b = np.nonzero(x[i : min(first, i + SIDE)] @ x[j : j + SIDE].T >= cosine)
            a, b = a + i, b + j
            yield (a[a < b], b[a < b]) if within else (a, b)


def linked(nodes: DataFrame, tables: Tables, cosine: float = COSINE) -> DataFrame:
    """(a, b, n): with n over 0, n rows are linked with a; else a link of a and b. nodes: (node, label, x, copies), one row a different vector.

    Each pair is counted once. The links join what all found pairs join.
    """
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _by_width(batch, "x") if batch.num_rows else ():
                for at in range(0, part.num_rows, 1024):
                    some = part.slice(at, 1024)
                    keys = tables.keys(unit(_matrix(some.column("x"))), some.column("label").to_numpy())
                    yield batch_of(_KEYED, keys.ravel(), some.column("node").take(pa.array(np.repeat(np.arange(len(keys)), tables.tables))))

    keyed = written(nodes.select("node", "label", "x").mapInArrow(key, "key long, node binary"), "pstable-keys")
    crowded = written(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("size", F.col("n")), "pstable-crowded")
    placed = _looked_up(keyed, crowded, "key", crowded.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    dealt = placed.select("node", "key", blocks.alias("blocks"), F.pmod(F.xxhash64("node"), blocks).cast("int").alias("block"))
    sides = dealt.join(nodes.hint("merge"), "node")
    paired = sides.select("key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"), "block", "node", "label", "x", "copies")
    paired = paired.select(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("work"), "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "label", "x", "copies")

    def found_in(table: pa.Table) -> Iterator[pa.RecordBatch]:
        key, i, j = (table.column(c)[0].as_py() for c in ("key", "i", "j"))
        order = np.argsort(table.column("block").to_numpy() != i, kind="stable")
        table = table.take(pa.array(order)).combine_chunks()
        first = len(table) if i == j else int((table.column("block").to_numpy() == i).sum())
        if len(table) < 2 or not first or i != j and first == len(table):
            return
        x, label, names = unit(_matrix(table.column("x").combine_chunks())), table.column("label").to_numpy(), table.column("node").to_pylist()
        copies, number, forest, keys = table.column("copies").to_numpy(), np.zeros(len(x), np.int64), Forest(len(x)), None
        for a, b in compared(x, first, i == j, cosine):
            if not len(a):
                continue
            keys = tables.keys(x, label) if keys is None else keys
            for at in range(0, len(a), 4096):
                p, q = a[at : at + 4096], b[at : at + 4096]
                same = keys[p] == keys[q]
                mine = (same.argmax(1) == key & (1 << TABLE_BITS) - 1) & same.any(1) & (label[p] == label[q])
                p, q = p[mine], q[mine]
                np.add.at(number, p, copies[q])
                np.add.at(number, q, copies[p])
                used = forest.join(p, q)
                if len(used):
                    yield batch_of(_FOUND, [names[k] for k in p[used]], [names[k] for k in q[used]], np.zeros(len(used), np.int64))
        some = np.flatnonzero(number)
        yield batch_of(_FOUND, [names[k] for k in some], [None] * len(some), number[some])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in by_run(batches, "work"):
            table = pa.Table.from_batches(held)
            where = [np.array(table.column(c).to_numpy()) for c in ("key", "i", "j")]
            size = np.array([len(x) for x in table.column("x").to_pylist()], np.int64)
            if all((w == w[0]).all() for w in [*where, size]):
                yield from found_in(table)
                continue
            for own in np.unique(np.stack([*where, size]), axis=1).T:  # two works of one hash, or two widths of one key
                yield from found_in(table.filter(pa.array(np.logical_and.reduce([w == v for w, v in zip([*where, size], own, strict=True)]))))

    return paired.repartition(parts, "work").sortWithinPartitions("work").mapInArrow(match, "a binary, b binary, n long")


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Rows link when their labels (whole numbers) are equal and not null, their vectors have one width and a cosine of `cosine` or
    more. Rows whose label or vector is null, or whose vector is empty, zero or has null or non-finite
    components link with nothing and are kept. Rows repeated under one id each get a row and count as others; a component's id is the
    smallest that it has, and a null id stands behind any other. Other columns, whatever their names, are not read. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    x = named(vector).cast("array<double>")
    usable = F.coalesce(named(label).isNotNull() & F.forall(x, lambda v: v.isNotNull() & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0), F.lit(False))
    rows = vectors.select(named(key).cast("long").alias("vec_id"), named(label).cast("long").alias("label"), x.alias("x"), usable.alias("usable"))
    rows = written(rows.withColumn("x", F.when(F.col("usable"), F.col("x")).otherwise(F.array().cast("array<double>"))).mapInArrow(_marked, "vec_id long, label long, x binary, node binary"), "pstable-rows")
    nodes = rows.where("node IS NOT NULL").groupBy("node", "label", "x").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("low"))
    nodes = written(nodes, "pstable-nodes")
    most = nodes.groupBy("label").count().agg(F.max("count"), F.sum("count")).first()
    found = written(linked(nodes.select("node", "label", "x", "copies"), Tables.for_rows(most[0] or 1, cosine, recall), cosine), "pstable-found")
    stars = components(found.where("n = 0").select("a", "b"), files_for(most[1] or 0)).withColumnRenamed("component", "star")
    number = found.where("n > 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    named_by = nodes.select("node", "copies", "low").join(stars.hint("merge"), "node", "left").join(number.hint("merge"), "node", "left")
    named_by = written(named_by.select("node", "low", F.coalesce("star", "node").alias("star"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "pstable-placed")
    least = written(named_by.groupBy("star").agg(F.min("low").alias("component_id"), F.count(F.lit(1)).alias("n")), "pstable-least")
    placed = _looked_up(named_by, least, "star", nodes.count()).select("node", "n_links", "component_id")
    copied = written(placed.join(nodes.select("node", F.col("copies").alias("n")).hint("merge"), "node"), "pstable-answers")
    own = rows.where("node IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = _looked_up(rows.where("node IS NOT NULL").select("vec_id", "node"), copied, "node", rows.count()).select("vec_id", "n_links", "component_id").unionByName(own)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op12_pstable_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "embeddings"))


ORACLE_SQL = f"""
WITH RECURSIVE usable AS (
    SELECT vec_id, label, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings
    WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0
        AND len(list_filter(embedding, lambda v: v <> 0)) > 0
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM usable AS a JOIN usable AS b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
    WHERE list_dot_product(a.x, b.x) / (sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x))) >= {COSINE}
), reached AS (
    SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reached AS r JOIN links AS l ON l.a = r.b
), least AS (
    SELECT a, min(b) AS component_id FROM reached GROUP BY a
), number AS (
    SELECT a, count(*) AS n FROM links GROUP BY a
)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, l.component_id, e.vec_id = l.component_id AS kept
FROM embeddings AS e JOIN least AS l ON l.a = e.vec_id LEFT JOIN number AS n ON n.a = e.vec_id
"""
