"""Nearest neighbours by a kd-tree: the second index, where block keys cannot be had, and the check on the first.

The different candidates are dealt to regions of space of about equal numbers, cut by the medians of a bounded
sample. A task holds a region and builds its own tree. A query first asks the region that it lies in; then only
those whose box is nearer than what it has found. Within a tree a query descends to its leaf first, then
looks at further leaves from the nearest on, as long as one is nearer than the best. Nothing depends on a lattice,
so coordinates may have any size; no candidate is copied for its surroundings.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import inf

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import apart, finite
from ..sources.files import shared_base

#: Candidates of a region, about; regions at most; sampled points a region; points of a leaf.
REGION_POINTS, MOST_REGIONS, SAMPLE_EACH, LEAF = 100_000, 1 << 14, 16, 32
#: Queries and candidates of a task; queries that a tree answers at a time.
QUERY_ROWS, CANDIDATE_ROWS, BATCH = 250_000, 400_000, 8192
#: A little below 1: bounds are DOUBLE, distances FLOAT, and rounding must not hide a neighbour.
CAUTION = 1 - 1e-6


def outside(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances, in double, of points to boxes; the arrays fit each other."""
    with np.errstate(over="ignore"):
        gap = np.maximum(np.maximum(low - points, points - high), 0.0)
        return (gap * gap).sum(-1)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """float32 squared distances of rows, summed from x to z."""
    with np.errstate(over="ignore"):
        d = a - b
        return (d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1]) + d[:, 2] * d[:, 2]


class Tree:
    """A kd-tree: nodes with boxes; inner nodes are cut at the median of their longest side."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points = points.astype(np.float32)
        order, wide = np.arange(len(points)), points.astype(np.float64)
        low, high, child, span, axis, value = [], [], [], [], [], []
        stack = [(0, len(points), -1, 0)]
        while stack:
            a, b, parent, side = stack.pop()
            own, node = wide[order[a:b]], len(low)
            if parent >= 0:
                child[parent][side] = node
            low.append(own.min(0) if a < b else np.full(3, inf))
            high.append(own.max(0) if a < b else np.full(3, -inf))
            child.append([-1, -1])
            span.append((a, b))
            cut = int(np.argmax(high[-1] / 2 - low[-1] / 2)) if a < b else 0
            axis.append(cut)
            value.append(0.0)
            if b - a > leaf and high[-1][cut] > low[-1][cut]:
                middle = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(own[:, cut], middle)]
                value[-1] = wide[order[a + middle], cut]
                stack += [(a + middle, b, node, 1), (a, a + middle, node, 0)]
        self.order, self.low, self.high, self.child = order, np.array(low), np.array(high), np.array(child)
        self.span, self.axis, self.value = np.array(span), np.array(axis), np.array(value)
        self.looked = 0  # distances computed

    def _visit(self, q: np.ndarray, who: np.ndarray, node: np.ndarray, best: np.ndarray) -> None:
        """Each of `who`, once, meets the points of its leaf."""
        start, number = self.span[node, 0], self.span[node, 1] - self.span[node, 0]
        some = number > 0
        who, start, number = who[some], start[some], number[some]
        if not len(who):
            return
        first = np.cumsum(number) - number
        pick = self.order[np.repeat(start - first, number) + np.arange(number.sum())]
        self.looked += len(pick)
        best[who] = np.minimum(best[who], np.minimum.reduceat(squared(q[np.repeat(who, number)], self.points[pick]), first))

    def nearest(self, queries: np.ndarray, best: np.ndarray) -> np.ndarray:
        """float32 squared distances of queries to their nearest points, or what they had if that is less."""
        best = best.astype(np.float32).copy()
        for at in range(0, len(queries), BATCH):
            self._batch(queries[at : at + BATCH], best[at : at + BATCH])
        return best

    def _batch(self, q: np.ndarray, best: np.ndarray) -> None:
        wide = q.astype(np.float64)
        node = np.zeros(len(q), np.int64)
        while (inner := np.flatnonzero(self.child[node, 0] >= 0)).size:
            at = node[inner]
            node[inner] = self.child[at, (wide[inner, self.axis[at]] >= self.value[at]).astype(np.int64)]
        self._visit(q, np.arange(len(q)), node, best)
        own = node
        who, node = np.arange(len(q)), np.zeros(len(q), np.int64)
        leaves: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(who):
            bound = outside(wide[who], self.low[node], self.high[node]) * CAUTION
            some = bound < best[who]
            who, node, bound = who[some], node[some], bound[some]
            ends = self.child[node, 0] < 0
            new = ends & (node != own[who])
            leaves.append((who[new], node[new], bound[new]))
            who, node = np.repeat(who[~ends], 2), self.child[node[~ends]].ravel()
        who, node, bound = (np.concatenate(x) for x in zip(*leaves, strict=True))
        order = np.lexsort((bound, who))
        who, node, bound = who[order], node[order], bound[order]
        while len(who):  # each query's nearest leaf that is left, then again
            lead = np.r_[True, who[1:] != who[:-1]]
            self._visit(q, who[lead], node[lead], best)
            left = ~lead & (bound < best[who])
            who, node, bound = who[left], node[left], bound[left]


@dataclass(frozen=True)
class Regions:
    """Cuts of space in heap order (node k has the children 2k + 1 and 2k + 2; the last ones are the regions), and each node's box of candidates."""

    axis: np.ndarray
    value: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @property
    def depth(self) -> int:
        return (len(self.axis) + 1).bit_length() - 1

    @staticmethod
    def boxed(axis: np.ndarray, value: np.ndarray, low: np.ndarray, high: np.ndarray) -> Regions:
        """From the boxes of the regions."""
        lows, highs = [low], [high]
        while len(lows[0]) > 1:
            lows.insert(0, np.minimum(lows[0][::2], lows[0][1::2]))
            highs.insert(0, np.maximum(highs[0][::2], highs[0][1::2]))
        low, high = np.concatenate(lows), np.concatenate(highs)
        return Regions(axis, value, low, high)

    def of(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (points[np.arange(len(points)), self.axis[node]] >= self.value[node])
        return node - len(self.axis)

    def nearer(self, points: np.ndarray, best: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a point and another region whose box is nearer than its best."""
        who, node = np.arange(len(points)), np.zeros(len(points), np.int64)
        for level in range(self.depth + 1):
            near = outside(points[who], self.low[node], self.high[node]) * CAUTION < best[who]
            who, node = who[near], node[near]
            if level < self.depth:
                who, node = np.repeat(who, 2), np.stack([2 * node + 1, 2 * node + 2], 1).ravel()
        other = node - len(self.axis) != own[who]
        return who[other], node[other] - len(self.axis)


def cuts(sample: np.ndarray, regions: int) -> tuple[np.ndarray, np.ndarray]:
    """Axes and values of a balanced tree of cuts over a sample; regions is a power of two."""
    axis, value = np.zeros(regions - 1, np.int64), np.zeros(regions - 1)
    own = {0: sample}
    for k in range(regions - 1):
        here = own.pop(k)
        if len(here):
            axis[k] = np.argmax(here.max(0) / 2 - here.min(0) / 2)
            value[k] = np.median(here[:, axis[k]])
        right = here[:, axis[k]] >= value[k]
        own[2 * k + 1], own[2 * k + 2] = here[~right], here[right]
    return axis, value


def _array(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([batch.column(k).to_numpy() for k in range(3)]).astype(np.float64)


def _rows(x: np.ndarray, *more: np.ndarray, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(pa.array(x[:, k].astype(np.float32)) for k in range(3)), *map(pa.array, more)], names=["x", "y", "z", *names])


def kd_squared_distance(queries: DataFrame, candidates: DataFrame, radius: float = inf) -> DataFrame:
    """queries (x, y, z and other columns) with `d2`, the FLOAT squared distance to the nearest candidate within the radius or a hair beyond, else null.

    Queries that are not finite have none; candidates that are not finite take no part; every query keeps its row.
    """
    spark = queries.sparkSession
    queries, candidates = apart(queries), apart(candidates.select("x", "y", "z"))
    usable = finite(*(F.col(c) for c in "xyz"))
    shared_base(spark)  # where checkpoints go
    points = candidates.where(usable).select(*(F.col(c).cast("float").alias(c) for c in "xyz")).distinct().checkpoint()
    asked = queries.where(usable).select(*(F.col(c).cast("float").alias(c) for c in "xyz")).distinct()
    number = points.count()
    if not number:
        return queries.withColumn("d2", F.lit(None).cast("float"))
    regions = 1 << max(0, min(MOST_REGIONS, -(-number // REGION_POINTS)) - 1).bit_length()
    share = min(1.0, 4 * SAMPLE_EACH * regions / number)
    drawn = points.where(F.pmod(F.xxhash64("x", "y", "z"), F.lit(1 << 20)) < max(1, int(share * (1 << 20)))).limit(8 * SAMPLE_EACH * regions).toArrow()
    axis, value = cuts(np.column_stack([drawn.column(c).to_numpy() for c in "xyz"]).astype(np.float64), regions)
    bare = Regions(axis, value, np.empty(0), np.empty(0))
    reach = np.float32(min(float(radius) ** 2 * (1 + 1e-5), np.finfo(np.float32).max))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _array(batch)
            yield _rows(x, bare.of(x), names=["region"])

    placed = points.mapInArrow(place, "x float, y float, z float, region long")
    boxes = placed.groupBy("region").agg(F.count(F.lit(1)).alias("n"), *(f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max)))).collect()  # MOST_REGIONS rows at most
    low, high, holders = np.full((regions, 3), inf), np.full((regions, 3), -inf), np.ones(regions, np.int64)
    for r in boxes:
        low[r["region"]], high[r["region"]] = [r[f"min_{c}"] for c in "xyz"], [r[f"max_{c}"] for c in "xyz"]
        holders[r["region"]] = -(-r["n"] // CANDIDATE_ROWS)
    shared = spark.sparkContext.broadcast(Regions.boxed(axis, value, low, high))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _array(batch)
            yield _rows(x, np.full(len(x), reach), shared.value.of(x), names=["best", "region"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                x, best = _array(part), part.column(3).to_numpy()
                who, where = shared.value.nearer(x, best, shared.value.of(x))
                yield _rows(x[who], best[who], where, names=["best", "region"])

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        x = np.column_stack([left.column(c).to_numpy() for c in "xyz"]).astype(np.float32)
        best = left.column("best").to_numpy()
        if right.num_rows:
            best = Tree(np.column_stack([right.column(c).to_numpy() for c in "xyz"])).nearest(x, best)
        return left.select(["x", "y", "z"]).append_column("best", pa.array(best, pa.float32()))

    def answered(asks: DataFrame) -> DataFrame:
        """(x, y, z, best): each asked region dealt to tasks of bounded size; a query comes back once a holder."""
        parts = np.ones(regions, np.int64)
        for r in asks.groupBy("region").agg(F.count(F.lit(1)).alias("n")).collect():
            parts[r["region"]] = -(-r["n"] // QUERY_ROWS)
        # arrays of literals are looked up; a condition for each region would outgrow what the JVM compiles
        each = lambda numbers: F.array(*map(F.lit, numbers.tolist()))[F.col("region")] if numbers.max() > 1 else F.lit(1)
        askers, several = each(parts), each(holders)
        left = asks.withColumn("part", F.pmod(F.xxhash64("x", "y", "z"), askers)).withColumn("holder", F.explode(F.sequence(F.lit(0), several - 1)))
        right = placed.withColumn("holder", F.pmod(F.xxhash64("x", "y", "z", F.lit(1)), several)).withColumn("part", F.explode(F.sequence(F.lit(0), askers - 1)))
        keys = ["region", "part", "holder"]
        cast = lambda df: df.withColumns({"part": F.col("part").cast("long"), "holder": F.col("holder").cast("long")})
        return cast(left).groupBy(*keys).cogroup(cast(right).groupBy(*keys)).applyInArrow(search, "x float, y float, z float, best float").groupBy("x", "y", "z").agg(F.min("best").alias("best"))

    near = answered(asked.mapInArrow(first, "x float, y float, z float, best float, region long"))
    if regions > 1:
        near = near.checkpoint()
        further = near.mapInArrow(again, "x float, y float, z float, best float, region long")
        near = near.unionByName(answered(further)).groupBy("x", "y", "z").agg(F.min("best").alias("best"))
    names = {c: f"_kd_{c}" for c in "xyz"}
    found = near.where(F.col("best") < F.lit(float(reach)).cast("float")).withColumnsRenamed(names).withColumnRenamed("best", "d2")
    on = [F.col(c).cast("float") == F.col(n) for c, n in names.items()]
    return queries.join(found.hint("merge"), on, "left").select(*queries.columns, "d2")
