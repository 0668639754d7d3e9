"""Operator 1: nearest neighbours by inner product from randomly rotated one-bit codes.

The index holds, for each vector, the signs of its rotated residual from a centre, packed into
bits, and two correction scalars: one turns the bits' inner product with a rotated query into an
unbiased estimate, the other bounds its error. A rotated query is rounded to four levels, held as two
packed planes, so that the estimate is made of bit counts of the packed words; what rounding loses
is corrected by the query's own scalar and enters the error bound. A search scans blocks of codes
with all queries, which each task reads in batches. A query's threshold is the k-th best lower
bound, then the k-th best score so far; exactly the vectors whose upper bound reaches it are
reranked by inner products in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batch_of, dropped_at_end, file_system, fresh_dir, read_table, written

#: Bits of a code for each dimension; standard deviations of the error bound; rows of a block; queries read at a time; rows that the centre is the mean of, at most about.
EXPANSION, BOUND, BLOCK_ROWS, BATCH_QUERIES, SAMPLE_ROWS, SEED = 4, 1.9, 32_768, 1024, 20_000, 3
#: Rows of a block that are estimated at a time.
_STRIDE = 4096
#: A query's four levels, in its standard deviations: half a step and one and a half, either way.
_STEP = 0.9957


def rotation(size: int, expansion: int = EXPANSION, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix; vectors are filled up with zeros to `expansion` times their width, in whole 64-bit words."""
    size = -(-size * expansion // 64) * 64
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, size)))
    return q * np.sign(np.diag(r))


@dataclass
class Coder:
    """Rotation and centre; encodes vectors and estimates inner products from codes."""

    turn: np.ndarray
    centre: np.ndarray

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Packed bits, estimate scalars and error scalars of the rows of x."""
        d, width = x.shape[1], len(self.turn)
        turned = (x - self.centre) @ self.turn[:, :d].T
        norm = np.sqrt((turned**2).sum(1))
        agree = np.abs(turned).sum(1) / np.sqrt(width) / np.where(norm > 0, norm, 1)  # <code, residual>, both of length 1
        agree = np.where(norm > 0, np.clip(agree, 1e-6, 1), 1)
        scale = norm / agree / np.sqrt(width)
        error = norm * np.sqrt(np.maximum(0, 1 - agree**2)) / agree / np.sqrt(max(1, width - 1))
        return np.packbits(turned > 0, axis=1), scale, error

    def asked(self, queries: np.ndarray) -> Asked:
        """The queries rotated, rounded and packed."""
        turned = queries @ self.turn[:, : queries.shape[1]].T
        step = _STEP * np.sqrt((turned**2).mean(1, keepdims=True))
        level = np.clip(np.floor(turned / np.where(step > 0, step, 1)) + 2, 0, 3).astype(np.int64)
        rounded = (level - 1.5) * step
        along = np.einsum("ij,ij->i", rounded, turned)
        norm = np.sqrt((turned**2).sum(1))
        correct = np.where(along > 0, norm**2 / np.where(along > 0, along, 1), 1.0)
        lost = np.sqrt(((turned - correct[:, None] * rounded) ** 2).sum(1))
        planes = np.stack([_words_of(np.packbits(level >> plane & 1, axis=1)) for plane in (0, 1)], 1)
        return Asked(planes, correct * step[:, 0], level.sum(1) * 2 - 3 * turned.shape[1], norm, np.max(lost / np.where(norm > 0, norm, 1), initial=0.0), queries @ self.centre)


@dataclass
class Asked:
    """Queries as codes are compared with: two planes of words each, the factor of their bit counts and what is taken off those, norms, the largest share lost by rounding, and inner products with the centre."""

    planes: np.ndarray
    factor: np.ndarray
    off: np.ndarray
    norm: np.ndarray
    lost: float
    centre: np.ndarray


def _words_of(bits: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(bits).view(np.uint64)


@dataclass
class Codes:
    """A block's codes by word, the set bits of each, and the scalars; error covers rounded queries."""

    words: np.ndarray
    ones: np.ndarray
    scale: np.ndarray
    error: np.ndarray

    @staticmethod
    def of(bits: np.ndarray, scale: np.ndarray, error: np.ndarray, lost: float) -> Codes:
        words = np.ascontiguousarray(_words_of(bits).T)
        return Codes(words, np.bitwise_count(words).sum(0, dtype=np.int16 if len(words) <= 64 else np.int64), scale.astype(np.float32), np.hypot(error, scale * lost).astype(np.float32))

    def estimates(self, asked: Asked, query: int, rows: slice) -> np.ndarray:
        """Inner products of some rows' residuals with a query, from bit counts of packed words."""
        low, high = (np.zeros(self.words[0, rows].shape, self.ones.dtype) for _ in range(2))
        for w, word in enumerate(self.words[:, rows]):
            low += np.bitwise_count(word & asked.planes[query, 0, w])
            high += np.bitwise_count(word & asked.planes[query, 1, w])
        # of signs s and levels v: 2 * sum(s * v) = 2 * (2 * sum over set bits of v - sum of v)
        total = 2 * (2 * high + low) - 3 * self.ones[rows]
        return (total * np.float32(2) - np.float32(asked.off[query])) * np.float32(asked.factor[query] / 2) * self.scale[rows]


def vectors_of(column: pa.Array) -> np.ndarray:
    """A list column whose lists have one length, as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, x): rows that take part; x has doubles. The rest are rows whose id or vector is null, zero, of another length than most, or has null or non-finite components."""
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("x")).where("vec_id IS NOT NULL")
    rows = rows.where(F.coalesce(F.forall("x", lambda v: v.isNotNull() & (F.abs(v) < float("inf"))), F.lit(False)) & F.exists("x", lambda v: v != 0))
    most = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("x") == (most["d"] if most else 0))


_CODE = pa.schema([("vec_id", pa.int64()), ("x", pa.list_(pa.float64())), ("bits", pa.binary()), ("scale", pa.float64()), ("error", pa.float64())])


def build_index(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, Coder | None]:
    """The code table (vec_id, x, bits, scale, error) with every usable row, in the shared folder, and its coder.

    Only the centre is fitted, on a sample of about SAMPLE_ROWS rows at most.
    """
    rows = usable(vectors, key, vector)
    spark, number = vectors.sparkSession, rows.count()
    if not number:
        return spark.createDataFrame([], "vec_id long, x array<double>, bits binary, scale double, error double"), None
    rate = min(1.0, SAMPLE_ROWS / number)
    some = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(1 << 20)) < int(rate * (1 << 20)))
    sums = some.select(F.posexplode("x").alias("k", "v")).groupBy("k").agg(F.avg("v").alias("v")).collect()
    d = rows.select(F.size("x").alias("d")).first()["d"]
    centre = np.zeros(d)
    for r in sums:
        centre[r["k"]] = r["v"]
    coder = Coder(rotation(d), centre)
    shared = spark.sparkContext.broadcast(coder)  # two arrays of the vectors' width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                bits, scale, error = shared.value.encode(vectors_of(batch.column(1)))
                yield batch_of(_CODE, batch.column(0), batch.column(1), [b.tobytes() for b in bits], scale, error)

    tasks = max(-(-number // BLOCK_ROWS), min(2 * spark.sparkContext.defaultParallelism, -(-number // 2048)))
    return written(rows.repartition(tasks).mapInArrow(run, "vec_id long, x array<double>, bits binary, scale double, error double"), "one-bit-codes"), coder


def best_rows(coder: Coder, x: np.ndarray, ids: np.ndarray, bits: np.ndarray, scale: np.ndarray, error: np.ndarray, q: np.ndarray, query_ids: np.ndarray, k: int, bound: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of a block for each of some queries: places of queries, places of rows, scores.

    Rows come in strides. Those whose upper bound reaches the k-th best score so far are reranked -
    in the first stride, those that reach the k-th best lower bound.
    """
    asked = coder.asked(q)
    codes = Codes.of(bits, scale, error, asked.lost)
    width = 64 * float(np.finfo(np.float32).eps) * (1 + np.abs(asked.centre).max(initial=0))  # the bounds are float32
    c, r, score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    limit = np.full(len(q), -np.inf)
    for at in range(0, len(ids), _STRIDE):
        rows = slice(at, at + _STRIDE)
        new_c, new_r = [], []
        for i in range(len(q)):
            estimate, side = codes.estimates(asked, i, rows), codes.error[rows] * np.float32(bound * asked.norm[i])
            if at == 0 and len(estimate) > k:  # rows of the query's own id set no limit, however many there are
                limit[i] = np.partition(np.where(ids[rows] == query_ids[i], np.float32(-np.inf), estimate - side), -k)[-k] + asked.centre[i]
            estimate += side
            new_r.append(np.flatnonzero(estimate >= np.float32(limit[i] - asked.centre[i] - width)) + at)
            new_c.append(np.full(len(new_r[-1]), i))
        new_c, new_r = np.concatenate(new_c), np.concatenate(new_r)
        other = query_ids[new_c] != ids[new_r]
        new_c, new_r = new_c[other], new_r[other]
        exact = np.concatenate([np.einsum("ij,ij->i", x[new_r[i : i + 65536]], q[new_c[i : i + 65536]]) for i in range(0, len(new_r), 65536)] or [np.empty(0)])
        c, r, score = np.concatenate([c, new_c]), np.concatenate([r, new_r]), np.concatenate([score, exact])
        order = np.lexsort((ids[r], -score, c))
        c, r, score = c[order], r[order], score[order]
        place = np.arange(len(c)) - np.searchsorted(c, c)
        last = place == k - 1
        limit[c[last]] = np.maximum(limit[c[last]], score[last])
        c, r, score = c[place < k], r[place < k], score[place < k]
    return c, r, score


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _batches_of(path: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of a table in the shared folder, BATCH_QUERIES at a time."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    system, base = file_system(path)
    names = sorted(f.path for f in system.get_file_info(fs.FileSelector(base)) if f.path.endswith(".parquet"))
    for name in names:
        with system.open_input_file(name) as file:
            for batch in pq.ParquetFile(file).iter_batches(BATCH_QUERIES, columns=["vec_id", "x"]):
                if batch.num_rows:
                    yield batch.column(0).to_numpy(), vectors_of(batch.column(1))


def search(index: DataFrame, coder: Coder | None, queries: DataFrame, k: int = 20, bound: float = BOUND) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest inner product found for each query, ties to the smaller id.

    queries: (vec_id, x), one row an id. A row with the query's own id is no candidate; ids repeated
    among the candidates are candidates each. Fewer candidates than k are all returned; other columns
    are not read. Rows stay where the index has them: each task takes its rows in blocks and reads the
    queries, which are written to the shared folder, in batches. A block gives at most k rows a query,
    and these are ranked.
    """
    spark = index.sparkSession
    if coder is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    path = fresh_dir(spark, "ann-queries")
    queries.select("vec_id", "x").write.parquet(path)
    dropped_at_end(spark, path)
    shared = spark.sparkContext.broadcast(coder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            ids, x = table.column("vec_id").to_numpy(), vectors_of(table.column("x").combine_chunks())
            bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint8).reshape(len(ids), -1)
            scale, error = table.column("scale").to_numpy(), table.column("error").to_numpy()
            for query_ids, q in _batches_of(path):
                for at in range(0, len(q), 256):
                    c, r, score = best_rows(shared.value, x, ids, bits, scale, error, q[at : at + 256], query_ids[at : at + 256], k, bound)
                    yield batch_of(_FOUND, query_ids[at : at + 256][c], ids[r], score)

        held, rows = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                held.append(batch.slice(at, BLOCK_ROWS))
                rows += held[-1].num_rows
                if rows >= BLOCK_ROWS:
                    yield from block(held)
                    held, rows = [], 0
        if held:
            yield from block(held)

    found = index.mapInArrow(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_rotated_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, coder = build_index(read_table(spark, sf_dir, "embeddings"))
    queries = index.where("vec_id % 20 = 0").groupBy("vec_id").agg(F.min("x").alias("x"))
    return search(index, coder, queries)
