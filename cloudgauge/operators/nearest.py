"""Radius-capped nearest-neighbour join.

Both sides are dealt to cubic blocks: a query to the block it lies in, a candidate also to the
blocks that its ball of the radius reaches. Blocks are the leaves of an octree. The edge of its root
blocks follows the mean density; a block that holds more than SPLIT_ROWS candidates is halved along each side, again
and again, while its edge stays at least twice the radius, so that a candidate goes to 8 blocks at most.
Queries farther than the radius from the box of all candidates are answered without a shuffle. Within a
block the search refines: cells of doubling size, each query looking at the 27 cells around it and
dropping out once its nearest lies within the size. Work thus follows the distance to the neighbour,
not the radius, also where points are dense. Blocks with too many queries deal them to several tasks.
Equal candidates are one. Where blocks are over-full and cannot be halved any more, all queries first look within
a part of the radius, for which blocks can be smaller; a neighbour found there is the nearest. The rest, few where candidates
are dense, look again within the radius. Of these, the over-full blocks' are left to the kd-tree, whose regions are as small as
their points ask for, whatever the radius. Where it is to be compared with the blocks, such a block deals its
candidates to several tasks instead, each of which meets all the queries that are left, and the least of their distances is
taken. No task holds a block of unbounded size. Where coordinates are too large for block
keys, the kd-tree answers all.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass, field
from functools import reduce
from math import ceil, floor, inf, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.geometry import apart, band, f32, finite, squared_distance
from ..sources.files import shared_base
from .kd import kd_squared_distance

LOG = logging.getLogger("cloudgauge")
#: Candidates of a block at most and at least, about; queries and candidates of a task; pairs compared at a time.
BLOCK_POINTS, LEAST_POINTS, QUERY_ROWS, CANDIDATE_ROWS, PAIRS = 50_000, 1_000, 250_000, 400_000, 1 << 18
#: Candidates over which a block is halved, at most and at least; those that reach in from around come on top.
SPLIT_ROWS, LEAST_SPLIT = CANDIDATE_ROWS // 8, 16 * LEAST_POINTS
#: Halvings at most, and rows of the tables of halved or crowded blocks, which are broadcast.
MOST_LEVELS, MOST_BLOCKS = 16, 1 << 16
#: How often the radius is lessened, at most, where blocks are over-full.
MOST_RUNGS = 3
#: Coordinates in root blocks up to which keys are exact; edges and coordinates whose squares FLOAT still holds.
MOST_KEY, MOST_COORDINATE = 2.0**40, float(np.finfo(np.float32).max) ** 0.5 / 4
#: A little more than 1, so that rounding never hides a neighbour.
SLACK = 1 + 1e-5


def bounding_box(points: DataFrame) -> DataFrame:
    """Extent and number of the finite points, one row."""
    some = points.where(finite(*(F.col(c) for c in "xyz")))
    return some.agg(F.count(F.lit(1)).alias("n"), *(f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))))


def edge_within(box, radius: float, tasks: int) -> float:
    """Edge of a root block, from the candidates' box and number."""
    if not box["n"]:
        return max(2 * radius * SLACK, 1.0)
    sides = [max(float(box[f"max_{c}"]) - float(box[f"min_{c}"]), radius, 1e-6) for c in "xyz"]
    even = (sides[0] / box["n"] * sides[1] * sides[2] * min(max(box["n"] / (8 * tasks), LEAST_POINTS), BLOCK_POINTS)) ** (1 / 3)
    least, edge = max(2 * radius * SLACK, 1e-6), min(even, max(sides))
    # doubled so often that halving comes down to the least edge
    return least * 2.0 ** max(0, ceil(log2(edge / least) - 1e-9))


def representable(box, edge: float) -> bool:
    """Whether block keys are exact whole numbers of 64 bits, and the squares of differences finite."""
    most = max(abs(float(box[f"{e}_{c}"])) for c in "xyz" for e in ("min", "max"))
    return most / edge < MOST_KEY and max(most, edge) < MOST_COORDINATE


def within_reach(box, reach: float):
    """Whether a point is finite and no farther than the reach from the box; what lies outside has no neighbour and is not shuffled."""
    near = [F.col(c).cast("double").between(float(box[f"min_{c}"]) - reach, float(box[f"max_{c}"]) + reach) for c in "xyz"]
    return F.coalesce(reduce(lambda a, b: a & b, near), F.lit(False))


@dataclass(frozen=True)
class Blocks:
    """An octree: the edge of its root blocks, and by (level, x, y, z) the halved blocks and those that are over-full but cannot be halved, with the tasks to deal them to."""

    edge: float
    halved: list[tuple[int, int, int, int]] = field(default_factory=list)
    crowded: dict[tuple[int, int, int, int], int] = field(default_factory=dict)

    @property
    def levels(self) -> int:
        return 1 + max((level for level, *_ in self.halved), default=-1) + 1


PLACE = ["level", "bx", "by", "bz"]


def _at(c, edge: float, level=None):
    """Block coordinate; at a level, of blocks that many times halved. Halving is exact, so a block's parent has half its coordinates."""
    place = c.cast("double") / F.lit(edge)
    return F.floor(place if level is None else place * F.pow(F.lit(2.0), level))


def root_counts(edge: float, most: int, candidates: DataFrame, queries: DataFrame | None = None, inside=None) -> tuple[list[tuple[int, int, int]], dict[tuple[int, int, int], int], int]:
    """Root blocks with over `most` finite candidates, those with over QUERY_ROWS queries and their numbers, and how many queries lie outside: one job, and MOST_BLOCKS rows of each at most."""
    key = lambda f: [f(_at(F.col(c), edge)).alias(f"b{c}") for c in "xyz"]
    rows = candidates.select(F.lit(0).alias("side"), *key(lambda c: c))
    if queries is not None:
        rows = rows.unionByName(queries.select(F.lit(1).alias("side"), *key(lambda c: F.when(inside, c))))
    counts = rows.groupBy("side", "bx", "by", "bz").agg(F.count(F.lit(1)).alias("n"))
    over = counts.where(F.col("bx").isNull() | (F.col("n") > F.when(F.col("side") == 0, most).otherwise(QUERY_ROWS)))
    found = over.orderBy(F.col("bx").isNotNull(), F.desc("n")).limit(2 * MOST_BLOCKS).collect()
    place = lambda r: (r["bx"], r["by"], r["bz"])
    full = [place(r) for r in found if not r["side"]][:MOST_BLOCKS]
    return full, {place(r): r["n"] for r in found if r["side"] and r["bx"] is not None}, sum(r["n"] for r in found if r["bx"] is None)


def octree(candidates: DataFrame, edge: float, radius: float, most: int = SPLIT_ROWS, full: list[tuple[int, int, int]] | None = None) -> Blocks:
    """Blocks for some finite candidates; most: that one holds; full: root blocks with more. Only these are counted again, at all levels at once."""
    level = max(0, min(MOST_LEVELS, floor(log2(edge / max(2 * radius * SLACK, 1e-9)) + 1e-9)))
    full = root_counts(edge, most, candidates)[0] if full is None else full
    if not full:
        return Blocks(edge)
    spark = candidates.sparkSession
    some = spark.createDataFrame(full, "rx long, ry long, rz long")
    rows = candidates.select("x", "y", "z", *(_at(F.col(c), edge).alias(f"r{c}") for c in "xyz")).join(F.broadcast(some), ["rx", "ry", "rz"], "left_semi")
    finest = rows.select(*(_at(F.col(c), edge, F.lit(level)).alias(f"b{c}") for c in "xyz")).groupBy("bx", "by", "bz").agg(F.count(F.lit(1)).alias("n"))
    up = finest.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(level))))
    up = up.select("level", *(F.expr(f"shiftright({b}, {level} - level)").alias(b) for b in ("bx", "by", "bz")), "n").groupBy(*PLACE).agg(F.sum("n").alias("n"))
    # a block holds no more than its parent, so the fullest ones have their parents among them
    over = up.where(F.col("n") > most).orderBy(F.desc("n"), "level").limit(MOST_BLOCKS).collect()
    return Blocks(edge, [tuple(r[c] for c in PLACE) for r in over if r["level"] < level], {tuple(r[c] for c in PLACE): -(-r["n"] // SPLIT_ROWS) for r in over if r["level"] == level and r["n"] > SPLIT_ROWS})


def in_blocks(points: DataFrame, blocks: Blocks, reach: float | None = None) -> DataFrame:
    """points with the leaf block (level, bx, by, bz) each lies in; with a reach, a row for each leaf block that its ball touches."""
    low = [F.col(c).cast("double") - (reach or 0.0) for c in "xyz"]
    high = [F.col(c).cast("double") + (reach or 0.0) for c in "xyz"]
    out = points.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(blocks.levels - 1)))) if blocks.halved else points.withColumn("level", F.lit(0))
    for c, a, b in zip("xyz", low, high, strict=True):
        first = _at(a, blocks.edge, F.col("level"))
        out = out.withColumn(f"b{c}", first if reach is None else F.explode(F.sequence(first, _at(b, blocks.edge, F.col("level")))))
    if not blocks.halved:
        return out
    # a leaf is not halved, and its parent is
    halved = points.sparkSession.createDataFrame(blocks.halved, "level int, bx long, by long, bz long")
    above = F.broadcast(halved.select((F.col("level") + 1).alias("_level"), *(F.col(b).alias(f"_{b}") for b in PLACE[1:]), F.lit(True).alias("_within")))
    parent = F.expr("level = _level AND " + " AND ".join(f"shiftright({b}, 1) = _{b}" for b in PLACE[1:]))
    out = out.join(F.broadcast(halved), PLACE, "left_anti").join(above, parent, "left")
    return out.where("level = 0 OR _within").select(*points.columns, *PLACE)


def _cells(points: np.ndarray, size: float, low: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Cells of a lattice, numbered; the lattice leaves a margin of one on all sides."""
    at = np.floor((points - low) / size).astype(np.int64) + 1
    return (at[:, 0] * counts[1] + at[:, 1]) * counts[2] + at[:, 2]


def nearest_in_block(q: np.ndarray, c: np.ndarray, radius: float) -> np.ndarray:
    """float32 squared distance of each query to its nearest candidate, +inf if none is within the radius or so."""
    if not len(c) or not len(q):
        return np.full(len(q), np.inf, np.float32)
    # equal queries are asked once, and those near each other one after the other
    order = np.lexsort(q.T)
    q = q[order]
    new = np.r_[True, (q[1:] != q[:-1]).any(1)]
    found = np.empty(len(q), np.float32)
    found[order] = _nearest_of_different(q[new], c, radius)[np.cumsum(new) - 1]
    return found


def _nearest_of_different(q: np.ndarray, c: np.ndarray, radius: float) -> np.ndarray:
    best = np.full(len(q), np.inf, np.float32)
    q64, c64 = q.astype(np.float64), c.astype(np.float64)
    low, high = np.minimum(q64.min(0), c64.min(0)), np.maximum(q64.max(0), c64.max(0))
    reach = max(radius * SLACK, 1e-9)
    volume = float(np.prod(np.maximum(high - low, reach / 64)))
    # so many cells that 64 bits number them
    size = max(min(reach, max((2 * volume / len(c)) ** (1 / 3), reach / 256)), float((high - low).max()) / 1e5)
    left = np.arange(len(q))
    while len(left):
        counts = np.floor((high - low) / size).astype(np.int64) + 3
        filed = _cells(c64, size, low, counts)
        order = np.argsort(filed, kind="stable")
        filed, held, own = filed[order], c[order], _cells(q64[left], size, low, counts)
        by = np.argsort(own, kind="stable")
        left, own = left[by], own[by]
        for row in (-1, 0, 1):
            for line in (-1, 0, 1):  # three cells side by side are one range
                base = own + (row * counts[1] + line) * counts[2]
                start, stop = np.searchsorted(filed, base - 1, "left"), np.searchsorted(filed, base + 1, "right")
                number = stop - start
                some = np.flatnonzero(number)
                upto = np.cumsum(number[some])
                for a, b in _cuts(upto):
                    rows, n = some[a:b], number[some[a:b]]
                    first = np.cumsum(n) - n
                    pick = np.repeat(start[rows] - first, n) + np.arange(n.sum())
                    d = q[np.repeat(left[rows], n)] - held[pick]
                    d2 = (d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1]) + d[:, 2] * d[:, 2]
                    best[left[rows]] = np.minimum(best[left[rows]], np.minimum.reduceat(d2, first))
        if size >= reach:
            break
        left = left[best[left] > np.float32(size * size / SLACK**2)]
        size = min(size * 2, reach)
    return best


def _cuts(upto: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of rows with about PAIRS pairs each."""
    out, a = [], 0
    while a < len(upto):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + PAIRS, "right")))
        out.append((a, b))
        a = b
    return out


def _points(table: pa.Table, names: tuple[str, str, str]) -> np.ndarray:
    return np.column_stack([table.column(n).to_numpy() for n in names]).astype(np.float32)


def nearest_squared_distance(queries: DataFrame, candidates: DataFrame, radius: float, edge: float | None = None, index: str = "auto", split: int | None = None, trees: bool = True, rungs: int = MOST_RUNGS) -> DataFrame:
    """queries (x, y, z and other columns) with `d2`, the FLOAT squared distance to the nearest candidate (x, y, z).

    d2 is null where no candidate lies within the radius (or a hair beyond), and for queries that are
    not finite. Candidates that are not finite take no part. Every query keeps its row. edge: of the
    root blocks. index: `blocks`, `kd`, or `auto`: blocks wherever their keys are exact. split: candidates over
    which a block is halved, by default a task's share. trees: whether the kd-tree answers what is
    left in over-full blocks. rungs: how often the radius may be lessened first; at 0 the candidates differ and are finite.
    """
    if index == "kd":
        return kd_squared_distance(queries, candidates, radius)
    queries = apart(queries)
    shared_base(queries.sparkSession)  # where checkpoints go
    filed = _different(candidates) if rungs else candidates.select("x", "y", "z")
    box = bounding_box(filed).first()
    if not box["n"]:
        return queries.withColumn("d2", F.lit(None).cast("float"))
    tasks = queries.sparkSession.sparkContext.defaultParallelism
    edge = edge_within(box, radius, tasks) if edge is None else edge
    if not representable(box, edge):
        if index == "blocks":
            raise ValueError(f"coordinates of {box.asDict()} have no exact block keys at an edge of {edge:g}")
        LOG.warning("coordinates are too large for block keys; the kd-tree is used instead")
        return kd_squared_distance(queries, filed, radius)
    reach = max(radius, 0.0) * SLACK
    inside = within_reach(box, reach)
    most = min(SPLIT_ROWS, split or max(LEAST_SPLIT, box["n"] // (2 * tasks)))
    blocks = octree(filed, edge, radius, most)
    near, fine = radius, blocks
    for _ in range(rungs):
        if less := lesser_radius(fine, box, near):
            near, fine = less, octree(filed, edge_within(box, less, tasks), less, most)
    if near < radius:
        close = nearest_squared_distance(queries, filed, near, split=split, trees=trees, rungs=0).checkpoint()
        some, rest = close.where("d2 IS NOT NULL"), close.where("d2 IS NULL").drop("d2")
        return close if rest.where(inside).isEmpty() else some.unionByName(nearest_squared_distance(rest, filed, radius, edge, split=split, trees=trees, rungs=0))
    _, many, away = root_counts(edge, most, filed, queries, inside)
    names, planted = queries.columns, None
    asked, held = in_blocks(queries.where(inside), blocks), in_blocks(filed, blocks, reach)
    if trees and blocks.crowded:
        dense = F.broadcast(queries.sparkSession.createDataFrame(list(blocks.crowded), "level int, bx long, by long, bz long"))
        planted = kd_squared_distance(asked.join(dense, PLACE, "left_semi").select(*names), filed, radius)
        asked, held = asked.join(dense, PLACE, "left_anti"), held.join(dense, PLACE, "left_anti")
    filed = held
    crowded = crowded_blocks(queries.where(inside), many, blocks, trees)
    schema = queries.limit(0).withColumn("d2", F.lit(None).cast("float")).schema

    def search(left: pa.Table, right: pa.Table, names: list[str]) -> pa.Table:
        best = nearest_in_block(_points(left, ("x", "y", "z")), _points(right, ("x", "y", "z")), radius)
        best[best > np.float32(reach * reach)] = np.inf  # what lies beyond the reach need not be the nearest
        return left.select(names).append_column("d2", pa.array(best, mask=np.isinf(best)))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return search(left, right, names)

    def beside(near: DataFrame) -> DataFrame:
        near = near.unionByName(planted) if planted is not None else near
        return near.unionByName(queries.where(~inside).withColumn("d2", F.lit(None).cast("float"))) if away else near

    # by the work, not by bytes, of which there are few
    parts = max(4 * tasks, -(-box["n"] // SPLIT_ROWS)) if box["n"] > SPLIT_ROWS else 0
    dealt = lambda df, keys: (df.repartition(parts, *keys) if parts else df).groupBy(*keys)
    if not crowded:
        return beside(dealt(asked, PLACE).cogroup(dealt(filed, PLACE)).applyInArrow(run, schema))
    shares = F.broadcast(queries.sparkSession.createDataFrame(crowded, "level int, bx long, by long, bz long, askers long, holders long"))
    askers, holders = F.coalesce("askers", F.lit(1)), F.coalesce("holders", F.lit(1))
    # a task of a block has one part of its queries and one of its candidates
    asked = asked.join(shares, PLACE, "left").withColumn("part", F.pmod(F.xxhash64(*names), askers)).withColumn("holder", F.explode(F.sequence(F.lit(0).cast("long"), holders - 1)))
    filed = filed.join(shares, PLACE, "left").withColumn("holder", F.pmod(F.xxhash64("x", "y", "z"), holders)).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), askers - 1)))
    places = [*PLACE, "part", "holder"]
    several = asked.where(holders > 1).drop("askers"), filed.where(holders > 1).drop("askers", "holders")
    asked, filed = asked.where(holders == 1).drop("askers", "holders"), filed.where(holders == 1).drop("askers", "holders")
    whole = dealt(asked, places).cogroup(dealt(filed, places)).applyInArrow(run, schema)
    more = [*names, "holders"]
    wider = queries.limit(0).withColumn("holders", F.lit(0).cast("long")).withColumn("d2", F.lit(None).cast("float")).schema
    pieces = dealt(several[0], places).cogroup(dealt(several[1], places)).applyInArrow(lambda left, right: search(left, right, more), wider)
    # equal queries have equal distances, so they may be taken together; each has come back once a holder
    least = pieces.groupBy(*more).agg(F.min("d2").alias("d2"), F.count(F.lit(1)).alias("_n"))
    least = least.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), F.expr("_n DIV holders")))).select(*names, "d2")
    return beside(whole.unionByName(least))


def _different(candidates: DataFrame) -> DataFrame:
    """The different finite candidates (x, y, z), kept below the checkpoints' folder, as they are counted before they are dealt."""
    candidates = apart(candidates.select(*(F.col(c).cast("float").alias(c) for c in "xyz")))
    return candidates.where(finite(*(F.col(c) for c in "xyz"))).distinct().checkpoint()


def lesser_radius(blocks: Blocks, box, radius: float) -> float | None:
    """A part of the radius for which the fullest block, if its points lie evenly, can be halved to a task's share; None without over-full blocks or exact keys."""
    if not blocks.crowded:
        return None
    near = radius / 2 ** (1 + ceil(log2(max(blocks.crowded.values())) / 3))
    return near if near > 1e-6 and representable(box, 2 * near) else None


def crowded_blocks(queries: DataFrame, many: dict[tuple[int, int, int], int], blocks: Blocks, trees: bool = False) -> list[tuple[int, int, int, int, int, int]]:
    """Blocks with more queries or candidates than a task should have, and over how many tasks to deal each, MOST_BLOCKS of either at most.

    many: root blocks with over QUERY_ROWS queries. They are counted by leaves again where one is halved. trees: over-full blocks are left to the kd-tree.
    """
    askers = {(0, *place): -(-n // QUERY_ROWS) for place, n in many.items()}
    if any(place in askers for place in blocks.halved):
        fine = in_blocks(queries.select("x", "y", "z"), blocks).groupBy(*PLACE).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > QUERY_ROWS)
        askers = {tuple(r[c] for c in PLACE): -(-r["n"] // QUERY_ROWS) for r in fine.orderBy(F.desc("n")).limit(MOST_BLOCKS).collect()}
    if trees:
        return [(*place, n, 1) for place, n in sorted(askers.items()) if place not in blocks.crowded]
    return [(*place, askers.get(place, 1), blocks.crowded.get(place, 1)) for place in sorted(askers.keys() | blocks.crowded.keys())]


def brute_force(queries: DataFrame, candidates: DataFrame, key: str, radius: float = inf) -> DataFrame:
    """(key, d2) by comparing all pairs: the yardstick for small clouds, not for large ones."""
    c = candidates.where(finite(*(F.col(c) for c in "xyz"))).select(*(F.col(c).alias(f"c{c}") for c in "xyz"))
    pairs = queries.where(finite(*(F.col(c) for c in "xyz"))).crossJoin(c)
    d2 = squared_distance(tuple(F.col(c) for c in "xyz"), tuple(F.col(f"c{c}") for c in "xyz"))
    best = pairs.groupBy(key).agg(F.min(d2).alias("d2"))
    return queries.select(key).join(best, key, "left")


def _against_kd(near: DataFrame, candidates: DataFrame, squared: tuple[float, ...]) -> DataFrame:
    """near (queries with d2) with `a` and `b`, the distances of both indexes below the largest tolerance, and their bands."""
    capped = lambda c: F.when(c < f32(squared[-1]), c)
    both = kd_squared_distance(near.withColumnRenamed("d2", "_near"), candidates, float(np.sqrt(squared[-1])) * SLACK)
    both = both.withColumns({"a": capped(F.col("_near")), "b": capped(F.col("d2"))}).drop("d2").withColumnRenamed("_near", "d2")
    return both.withColumns({"band": band(F.col("a"), squared), "other": band(F.col("b"), squared)})


def _mismatches():
    return F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("value_mismatches"), F.count_if(F.col("band") != F.col("other")).alias("band_mismatches")


def verify(queries: DataFrame, candidates: DataFrame, key: str, squared: tuple[float, ...]) -> DataFrame:
    """Compares the block search with the kd-tree within the largest tolerance: by band of the block search, numbers of queries, and of values and of bands that differ, and the largest squared distance."""
    near = nearest_squared_distance(queries.select(key, "x", "y", "z"), candidates, float(np.sqrt(squared[-1])) * SLACK, trees=False)
    both = _against_kd(near, candidates, squared)
    return both.groupBy("band").agg(F.count(F.lit(1)).alias("queries"), *_mismatches(), F.max("a").alias("largest"))


def verified(near: DataFrame, candidates: DataFrame, squared: tuple[float, ...], counters: Observation) -> DataFrame:
    """near (queries x, y, z, ..., d2) as it is, compared with the kd-tree while its rows pass.

    The counters hold what `verify` sums, over all bands: queries, value_mismatches and band_mismatches. They come with
    the first action that reads the rows, without a job of their own. Tasks that are run again may count
    twice, so only zero and not zero are to be relied on.
    """
    both = _against_kd(near, candidates, squared).observe(counters, F.count(F.lit(1)).alias("queries"), *_mismatches())
    return both.select(*near.columns)
