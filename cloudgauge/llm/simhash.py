"""Operator 9: SimHash near-duplicates by multi-index hashing.

A fingerprint has one majority bit for each bit of the hashes of a text's word shingles. Equal
fingerprints are merged first. To find all pairs within d differing bits, a fingerprint is cut into
s segments; a pair within d has a segment with at most d // s differing bits. The table of a
segment files every distinct fingerprint under its segment's value, and every fingerprint looks up
the Hamming ball of that radius around its own. Tables are dealt by the top bits of the value, so
that a fingerprint travels to its own slice and to the slices that a flip of a top bit reaches,
and the rest of the ball is enumerated there. Complete distances are verified. A task emits only
links that join what it had not joined yet, and compares members of a large family only with those
outside their component, so near copies cost a spanning forest and never all of their pairs.
The pipeline's stage takes the components of such links as groups, and compares all pairs of a group
by their whole shingle sets.
Components come from alternating large-star and small-star rounds on tables in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import acos, ceil, comb, log2, pi, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_words, batch_of, by_run, chunks, dropped, dropped_at_end, files_for, free_name, fresh_dir, named, read_table, written

SHINGLE, DISTANCE, SEGMENTS, SEED = 3, 3, 2, 42
#: Where segments follow the number of fingerprints: those of one value on average, the least bits, and the share of pairs
#: at the similarity that no segment may bring together.
BUCKET, LEAST_BITS, MISSED = 16, 16, 0.006
#: Texts, and hashes of their shingle sets, that a block of a candidate group has about; blocks are compared in pairs.
BLOCK_TEXTS, BLOCK_HASHES = 256, 1 << 18
#: Candidate pairs that a task verifies at a time, and the size from which a bucket is gone through row by row.
BLOCK, LARGE = 1 << 18, 512
#: Text bytes, and shingles of them, that a task hashes at a time.
HASH_BYTES, HASHED = 1 << 20, 1 << 16
#: Fewer nodes than this have so many links that they are looked up by a broadcast.
HUBS = 4096


def shingle_hashes(texts: pa.Array, size: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of each text's word shingles, repeats included: numbers per text, and all hashes.

    Words are runs without ASCII white space, A-Z lower-cased. A text with fewer words than `size`
    has one shingle of all its words; a text without words has none.
    """
    words, flat = ascii_words(texts, lower=True)
    if not len(flat):
        return np.zeros(len(words), np.int64), np.empty(0, np.uint64)
    joined = memoryview(pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat.cast(pa.string())), " ")[0].as_buffer())
    length = pc.binary_length(flat).to_numpy(zero_copy_only=False).astype(np.int64)
    stop = np.cumsum(length + 1) - 1
    start = stop - length
    number = np.where(words > 0, np.maximum(words - size + 1, 1), 0)
    first = np.repeat(np.cumsum(words) - words, number) + np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
    last = first + np.repeat(np.minimum(words, size), number) - 1
    digest, hashes = xxhash.xxh64_intdigest, np.empty(len(first), np.uint64)
    for at in range(0, len(first), HASHED):
        some = slice(at, at + HASHED)
        hashes[some] = [digest(joined[a:b], seed) for a, b in zip(start[first[some]].tolist(), stop[last[some]].tolist(), strict=True)]
    return number, hashes


#: For each byte, its bits as eight counters of a byte each.
_SPREAD = np.array([sum((x >> k & 1) << 8 * k for k in range(8)) for x in range(256)], np.uint64)


def widened(hashes: np.ndarray, words: int) -> np.ndarray:
    """`words` hash words of each hash; the first is the hash."""
    out = np.empty((len(hashes), words), np.uint64)
    out[:, 0] = hashes
    with np.errstate(over="ignore"):
        for k in range(1, words):
            x = hashes + np.uint64(0x9E3779B97F4A7C15) * np.uint64(k)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            out[:, k] = x ^ (x >> np.uint64(31))
    return out


def majority(number: np.ndarray, hashes: np.ndarray, words: int = 1) -> np.ndarray:
    """Fingerprints (a row of words each) of consecutive groups of hashes: a bit is set if it is in over half of a group."""
    out = np.zeros((len(number), words), np.uint64)
    some = np.flatnonzero(number)
    if not len(some):
        return out
    pieces = -(-number[some] // 255)  # a byte counts up to 255 hashes
    group = np.repeat(np.arange(len(some)), pieces)
    within = np.arange(len(group)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = (np.cumsum(number) - number)[some][group] + 255 * within
    first = np.cumsum(pieces) - pieces
    data = np.ascontiguousarray(widened(hashes, words)).view(np.uint8)
    for byte in range(8 * words):
        counts = np.add.reduceat(_SPREAD[data[:, byte]], starts).view(np.uint8).reshape(-1, 8).astype(np.int64)
        ones = np.add.reduceat(counts, first, axis=0)
        out.view(np.uint8).reshape(len(number), -1)[some, byte] = np.packbits(ones * 2 > number[some][:, None], axis=1, bitorder="little").ravel()
    return out


def shingle_sets(number: np.ndarray, hashes: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct values of consecutive groups of hashes."""
    return [np.unique(hashes[end - n : end]) for n, end in zip(number, np.cumsum(number), strict=True)]


def set_key(own: np.ndarray) -> bytes:
    """A 128-bit hash of a sorted set."""
    return xxhash.xxh3_128_digest(own.astype("<u8").tobytes())


def sketches(number: np.ndarray, hashes: np.ndarray, size: int) -> list[bytes]:
    """The `size` least distinct values of consecutive groups of hashes, by their high 32 bits."""
    tops, ends = (hashes >> np.uint64(32)).astype("<u4"), np.cumsum(number)
    return [np.unique(tops[end - n : end])[:size].tobytes() for n, end in zip(number, ends, strict=True)]


def jaccard(a: bytes, b: bytes, size: int) -> float:
    """Similarity of two sets from their sketches: the share of both among the least values of either."""
    x, y = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
    both = np.concatenate([x, y])
    both.sort()
    twice = both[:-1][both[1:] == both[:-1]]
    least = np.unique(both)[:size]
    return float(np.count_nonzero(twice <= least[-1]) / len(least)) if len(least) else 1.0


def alike(left: list[np.ndarray], right: list[np.ndarray], similarity: float, width: int = 4096) -> np.ndarray:
    """For each set of left and each of right, whether their Jaccard similarity is `similarity` or more; exact.

    Numbers of common hashes are products of incidence matrices, `width` hashes at a time.
    """
    shared = np.intersect1d(np.concatenate(left), np.concatenate(right))
    common = np.zeros((len(left), len(right)))
    entries = []
    for sets in (left, right):
        flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        at = np.searchsorted(shared, flat)
        hit = at < len(shared)
        hit[hit] = shared[at[hit]] == flat[hit]
        order = np.argsort(at[hit], kind="stable")
        entries.append((len(sets), at[hit][order], row[hit][order]))
    for low in range(0, len(shared), width):
        dense = []
        for n, at, row in entries:
            a, b = np.searchsorted(at, [low, low + width])
            dense.append(np.zeros((n, min(width, len(shared) - low)), np.float32))
            dense[-1][row[a:b], at[a:b] - low] = 1
        common += dense[0] @ dense[1].T
    union = np.array([len(x) for x in left])[:, None] + np.array([len(x) for x in right])[None] - common
    return np.divide(common, union, out=np.ones_like(common), where=union > 0) >= similarity


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, words: int = 1, sets: bool = False) -> DataFrame:
    """(doc_id, fp, node, n): the key, of any type, and the SimHash of every whole text, 8 * words bytes, each word's high byte first; zero for a text without words.

    With `sets`, the fingerprint is of the distinct shingles, and node and n are the set's hash and size;
    without, shingles weigh by their repeats, and node and n are null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = pa.schema([("doc_id", batch.schema.field(0).type), ("fp", pa.binary()), ("node", pa.binary()), ("n", pa.int64())])
            for part in chunks(batch, "text", HASH_BYTES):
                number, hashes = shingle_hashes(part.column(1), size)
                nodes = counts = [None] * len(number)
                if sets:
                    own = shingle_sets(number, hashes)
                    number, hashes = np.array([len(x) for x in own], np.int64), np.concatenate(own)
                    nodes, counts = [set_key(x) for x in own], number
                prints = majority(number, hashes, words).astype(">u8")
                yield batch_of(out, part.column(0), [p.tobytes() for p in prints], nodes, counts)

    rows = docs.select(named(key).alias("doc_id"), named(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp binary, node binary, n long")


class Forest:
    """Components of positions; `up` always holds each position's root."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Joins the pairs, first ones first; which of them joined something new."""
        used, left = [], np.arange(len(a))
        while True:
            left = left[self.up[a[left]] != self.up[b[left]]]
            if not len(left):
                return np.concatenate(used) if used else left
            # of all pairs that would hang the same larger root, the first does so in this round
            low, high = np.minimum(self.up[a[left]], self.up[b[left]]), np.maximum(self.up[a[left]], self.up[b[left]])
            _, at = np.unique(high, return_index=True)
            self.up[high[at]] = low[at]
            used.append(left[at])
            while not np.array_equal(top := self.up[self.up], self.up):
                self.up = top


def ball(bits: int, radius: int) -> np.ndarray:
    """Masks of the bits that differ within a segment, the empty mask first."""
    return np.array([sum(1 << b for b in flips) for r in range(radius + 1) for flips in combinations(range(bits), r)], np.uint64)


_DEALT = pa.schema([("slice", pa.int32()), ("fp", pa.binary()), ("home", pa.bool_())])
_LINK = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def _words(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), ">u8").astype(np.uint64).reshape(len(column), -1)


def _segment(fp: np.ndarray, low: int, high: int) -> np.ndarray:
    """Bits low to high of fingerprints; a segment has 64 bits at most."""
    word, shift = low // 64, low % 64
    out = fp[:, word] >> np.uint64(shift)
    if shift + high - low > 64:
        out = out | fp[:, word + 1] << np.uint64(64 - shift)
    return out & np.uint64((1 << high - low) - 1)


def _gathered(fp: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The bits of fingerprints at these positions, the first lowest."""
    if bits[-1] - bits[0] + 1 == len(bits):  # positions ascend
        return _segment(fp, int(bits[0]), int(bits[-1]) + 1)
    out = np.zeros(len(fp), np.uint64)
    for k, b in enumerate(bits.tolist()):
        out |= (fp[:, b // 64] >> np.uint64(b % 64) & np.uint64(1)) << np.uint64(k)
    return out


def _mask(bits: np.ndarray, words: int) -> np.ndarray:
    out = np.zeros(words, np.uint64)
    for b in bits.tolist():
        out[b // 64] |= np.uint64(1 << b % 64)
    return out


def cut(bits: int, segments: int) -> list[np.ndarray]:
    """Positions of each of so many consecutive segments of a fingerprint."""
    edges = [bits * k // segments for k in range(segments + 1)]
    return [np.arange(a, b) for a, b in zip(edges, edges[1:], strict=False)]


def segments_for(number: int, similarity: float, words: int, radius: int = 1) -> list[np.ndarray]:
    """Positions of each segment, ascending, as wide as this number of fingerprints asks for.

    A segment's value has BUCKET of them on average, so that what one meets does not grow with their number.
    Wider segments bring fewer pairs together: the bits are cut in their order, then in one fixed
    permutation after the other, until a pair of sets of this similarity is missed by all
    segments at MISSED at most. Up to 2^20 fingerprints of 256 bits that is one cut into 16.
    """
    bits = 64 * words
    width = min(max(LEAST_BITS, ceil(log2(max(1, number) / BUCKET))), 64, bits)
    each = bits // width
    # ways to lay d differing bits so that every segment of a permutation has more than radius of them
    ways = np.array([comb(bits - each * width, r) for r in range(bits - each * width + 1)], float)
    for _ in range(each):
        ways = np.convolve(ways, [comb(width, r) * (r > radius) for r in range(width + 1)])
    apart = np.array([comb(bits, d) for d in range(bits + 1)], float)
    share = differing(similarity)
    chance = apart * share ** np.arange(bits + 1) * (1 - share) ** np.arange(bits, -1, -1)
    rounds = 1
    while chance @ (ways / apart) ** rounds > MISSED:
        rounds += 1
    orders = [np.arange(bits), *(np.random.default_rng(k).permutation(bits) for k in range(1, rounds))]
    return [np.sort(order[k * width : (k + 1) * width]) for order in orders for k in range(each)]


def _near(fp: np.ndarray, left: np.ndarray, right: np.ndarray, distance: int) -> np.ndarray:
    """Which pairs differ in `distance` bits at most, the nearest first."""
    apart = np.bitwise_count(fp[left] ^ fp[right]).sum(1, dtype=np.int64)
    near = np.flatnonzero(apart <= distance)
    return near[np.argsort(apart[near], kind="stable")]


def slice_links(fp: np.ndarray, rows: np.ndarray, keys: np.ndarray, homes: int, flips: np.ndarray, distance: int, earlier: tuple[np.ndarray, ...] = (), radius: int = 0) -> list[tuple[int, int]]:
    """Links among the fingerprints of a slice, as pairs of rows of fp.

    The first `homes` entries file their row under their key, and look up the flips of it; the
    others only look up their key. Of two different keys the smaller looks up the larger. A pair
    that also meets in one of the `earlier` segments (masks), by differing in `radius` bits at
    most there, is left to that.
    """
    forest = Forest(len(fp))
    order = np.argsort(keys[:homes], kind="stable")
    filed, owner = keys[:homes][order], rows[:homes][order]
    found: list[tuple[int, int]] = []

    def join(left: np.ndarray, right: np.ndarray) -> None:
        apart = fp[left] ^ fp[right]
        own = np.ones(len(left), bool)
        for mask in earlier:
            own &= np.bitwise_count(apart & mask).sum(1) > radius
        left, right = left[own], right[own]
        used = forest.join(left, right)
        found.extend(zip(left[used].tolist(), right[used].tolist(), strict=True))

    def meet(own: np.ndarray, start: np.ndarray, stop: np.ndarray) -> None:
        """Each row meets the filed rows from start to stop."""
        number = stop - start
        own, start, number = own[number > 0], start[number > 0], number[number > 0]
        at = 0
        while at < len(own):
            upto = max(at + 1, at + int(np.searchsorted(np.cumsum(number[at : at + BLOCK]), BLOCK, "right")))
            for base in range(0, int(number[at:upto].max()), BLOCK):  # a row may meet more than a block
                n = np.clip(number[at:upto] - base, 0, BLOCK)
                left = np.repeat(own[at:upto], n)
                right = owner[np.repeat(start[at:upto] + base, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                apart = forest.up[left] != forest.up[right]
                left, right = left[apart], right[apart]
                near = _near(fp, left, right, distance)
                join(left[near], right[near])
            at = upto

    begins = np.flatnonzero(np.r_[True, filed[1:] != filed[:-1]]) if homes else np.empty(0, np.int64)
    sizes = np.diff(np.r_[begins, homes])
    small = np.repeat(sizes <= LARGE, sizes)
    look = lambda own, asked: meet(own, np.searchsorted(filed, asked, "left"), np.searchsorted(filed, asked, "right"))
    for a, n in zip(begins[sizes > LARGE], sizes[sizes > LARGE], strict=True):
        bucket = owner[a : a + n]
        for k in range(n - 1):  # each row meets, of those behind it, the ones that are not in its component
            others = bucket[k + 1 :][forest.up[bucket[k + 1 :]] != forest.up[bucket[k]]]
            if len(others):
                near = others[_near(fp, bucket[k : k + 1], others, distance)]
                join(np.full(len(near), bucket[k]), near)
    meet(owner[small], np.repeat(begins, sizes)[small], np.arange(homes)[small])
    look(rows[homes:], keys[homes:])
    for flip in flips[1:]:
        up = (filed ^ flip) > filed
        look(owner[up], filed[up] ^ flip)
    return found


def links(fps: DataFrame, distance: int = DISTANCE, segments: int | list[np.ndarray] = SEGMENTS, words: int = 1, radius: int | None = None) -> DataFrame:
    """(a, b): links between distinct fingerprints that join all pairs within `distance` bits.

    segments: how many, or the bit positions of each. radius: of the balls; by default distance // segments,
    which misses no pair where segments do not overlap. A smaller one misses pairs whose bits differ in every segment by more.
    """
    places = cut(64 * words, segments) if isinstance(segments, int) else segments
    radius = distance // len(places) if radius is None else radius
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    widths, masks = [len(bits) for bits in places], [_mask(bits, words) for bits in places]
    top = min(max(0, (4 * parts // len(places)).bit_length() - 1), min(widths))  # bits that name a slice

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                column = batch.column(0).slice(at, 8192)
                fp = _words(column)
                for s, width in enumerate(widths):
                    place = (_gathered(fp, places[s]) >> np.uint64(width - top)).astype(np.int64)
                    for flip in ball(top, radius).astype(np.int64):
                        there = place ^ flip
                        go = np.flatnonzero((there > place) | (flip == 0))
                        yield batch_of(_DEALT, (there[go] + (s << top)).astype(np.int32), column.take(pa.array(go)), np.full(len(go), flip == 0))

    def slice_of(number: int, fp: np.ndarray, at_home: np.ndarray) -> list[tuple[int, int]]:
        s, here = number >> top, number & (1 << top) - 1
        width = widths[s]
        key = _gathered(fp, places[s])
        low, rest = np.uint64((1 << width - top) - 1), ball(width - top, radius)
        here = np.uint64(here) << np.uint64(width - top)
        # a guest has left its slice by some flips, and looks up what the rest of its ball has here
        guest = np.flatnonzero(~at_home)
        used = np.bitwise_count((key[guest] & ~low) ^ here)
        pick, which = [np.flatnonzero(at_home)], [key[at_home]]
        for flip in rest:
            fits = guest[used + np.bitwise_count(flip) <= radius]
            pick.append(fits)
            which.append(key[fits] & low ^ flip | here)
        return slice_links(fp, np.concatenate(pick), np.concatenate(which), len(pick[0]), rest, distance, tuple(masks[:s]), radius)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, parts_of in by_run(batches, "slice"):
            table = pa.Table.from_batches(parts_of)
            fp = _words(table.column("fp").combine_chunks())
            found = slice_of(number, fp, table.column("home").to_numpy())
            for at in range(0, len(found), 1 << 16):
                yield batch_of(_LINK, *([fp[pair[k]].astype(">u8").tobytes() for pair in found[at : at + (1 << 16)]] for k in (0, 1)))

    dealt = fps.select("fp").mapInArrow(deal, "slice int, fp binary, home boolean")
    return dealt.repartition(parts, "slice").sortWithinPartitions("slice").mapInArrow(match, "a binary, b binary")


def _looked_up(rows: DataFrame, table: DataFrame, key: str, number: int) -> DataFrame:
    """rows joined with table (key, n, more columns); n is in how many of the `number` rows the key stands.

    Keys with over a HUBS-th of all rows, of which there are fewer than HUBS, are found by a broadcast, so
    that no key gathers in one task; the rest by a sort-merge join.
    """
    more = [c for c in table.columns if c not in (key, "n")]
    hubs = F.broadcast(table.where(F.col("n") > number // HUBS + 1).select(key, F.struct(*more).alias("_hub")))
    marked = rows.join(hubs, key, "left")
    few = marked.where("_hub IS NULL").select(*rows.columns).join(table.select(key, *more).hint("merge"), key)
    return marked.where("_hub IS NOT NULL").select(*rows.columns, "_hub.*").unionByName(few.select(*rows.columns, *more))


def _with_least(edges: DataFrame, number: int) -> DataFrame:
    """(u, v, m): each link with the least v of its u."""
    return _looked_up(edges, edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "u", number)


def contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v): a task's links (a, b) as stars: each of their nodes with the smallest that it reaches by them."""
    table = pa.Table.from_batches(list(batches), _LINK)
    both = pa.concat_arrays([c for name in ("a", "b") for c in table.column(name).chunks]) if table.num_rows else pa.array([], pa.binary())
    nodes = pc.unique(both)
    nodes = nodes.take(pc.sort_indices(nodes))
    place = pc.index_in(both, nodes).to_numpy(zero_copy_only=False).astype(np.int64)
    forest = Forest(len(nodes))
    forest.join(place[: table.num_rows], place[table.num_rows :])
    out = np.flatnonzero(forest.up != np.arange(len(nodes)))
    for at in range(0, len(out), 1 << 16):
        some = out[at : at + (1 << 16)]
        yield pa.RecordBatch.from_arrays([nodes.take(pa.array(some)), nodes.take(pa.array(forest.up[some]))], names=["u", "v"])


def components(links: DataFrame, tasks: int = 1, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that each linked node reaches.

    Each of `tasks` tasks contracts its share of the links to stars. Then large-star joins the larger
    neighbours of each node to its smallest neighbour, small-star the smaller ones; both keep the
    components and together end in stars, when a round changes nothing.
    """
    spark, kept = links.sparkSession, []

    def save(df: DataFrame) -> DataFrame:
        kept.append(path := fresh_dir(spark, "stars"))
        df.write.parquet(path)
        dropped_at_end(spark, path)
        return spark.read.schema("u binary, v binary").parquet(path)

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges = save(links.repartition(tasks).mapInArrow(contracted, "u binary, v binary"))
    was = state(edges)
    for _ in range(rounds):
        if not was[0]:
            break
        both = _with_least(edges.union(edges.select("v", "u")), 2 * was[0])
        large = both.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        small = _with_least(large, was[0]).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = save(small.where("u <> v").distinct().coalesce(files_for(was[0])))  # a round's links are no more than the ones before
        now = state(edges)
        if now == was:
            break
        was = now
        for path in kept[:-1]:
            dropped(spark, path)
        del kept[:-1]
    else:
        raise RuntimeError("the components have not settled")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


_SIDE = pa.schema([("group", pa.binary()), ("block", pa.int32()), ("blocks", pa.int32()), ("node", pa.binary()), ("own", pa.binary())])


def verified(found: DataFrame, nodes: DataFrame, docs: DataFrame, key: str, text: str, size: int, similarity: float, files: int = 1) -> DataFrame:
    """(a, b): links between nodes that join all pairs whose whole shingle sets are `similarity` alike or more, within groups.

    nodes has one row (node, fp, low, n) for each distinct shingle set; low is the id of a row of docs that has it. Groups are
    the components of the candidate links `found` between fingerprints; nodes of one fingerprint are in one group. All
    pairs of a group are compared. A group is dealt to blocks by the nodes' hash, and each pair of
    blocks is a task's work of bounded size; only the sets of grouped nodes are built again and
    travel, once for each block of their group. The joins are sort-merge joins at any size.
    """
    coarse = components(found, files)
    placed = written(nodes.join(coarse.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").select("node", "low", "n", F.coalesce("component", "fp").alias("group")).coalesce(files), "simhash-placed")
    sizes = placed.groupBy("group").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("total")).where("texts > 1")
    blocks = F.ceil(F.greatest(F.col("texts") / BLOCK_TEXTS, F.col("total") / BLOCK_HASHES)).cast("int")
    several = _looked_up(placed.select("node", "low", "group"), sizes.select("group", blocks.alias("blocks"), F.col("texts").alias("n")), "group", placed.count())
    dealt = several.select("node", "low", "group", "blocks", F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("block"))
    rows = docs.select(named(key).alias("_key"), named(text).alias("text"))
    sides = rows.join(dealt.hint("merge"), F.col("_key").eqNullSafe(F.col("low"))).select("group", "block", "blocks", "node", "text")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", HASH_BYTES):
                own = shingle_sets(*shingle_hashes(part.column(4), size))
                same = [k for k, (x, node) in enumerate(zip(own, part.column(3).to_pylist(), strict=True)) if set_key(x) == node]  # an id may name several texts
                if same:
                    at = pa.array(same)
                    yield batch_of(_SIDE, *(part.column(k).take(at) for k in range(4)), [own[k].tobytes() for k in same])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links_of(name: tuple, rows: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
            order = sorted({node: (block, node, own) for block, node, own in rows}.values(), key=lambda r: (r[0] != name[1], r[1]))
            named, sets = [r[1] for r in order], [np.frombuffer(r[2], np.uint64) for r in order]
            first = sum(r[0] == name[1] for r in order)
            start = first if name[1] != name[2] else 0  # pairs within a block are the work of that block with itself
            if not first or start == len(sets):
                return batch_of(_LINK, [], [])
            a, b = np.nonzero(alike(sets[:first], sets[start:], similarity))
            a, b = a[a < b + start], b[a < b + start] + start
            used = Forest(len(sets)).join(a, b)
            return batch_of(_LINK, [named[k] for k in a[used]], [named[k] for k in b[used]])

        name, rows = None, []
        for batch in batches:
            for part in chunks(batch, 5):
                for *now, block, node, own in zip(*(part.column(k).to_pylist() for k in range(6)), strict=True):
                    if (now := tuple(now)) != name:
                        if len(rows) > 1:
                            yield links_of(name, rows)
                        name, rows = now, []
                    rows.append((block, node, own))
        if len(rows) > 1:
            yield links_of(name, rows)

    built = sides.mapInArrow(build, "group binary, block int, blocks int, node binary, own binary")
    paired = built.select("group", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"), "block", "node", "own")
    paired = paired.select("group", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "own")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return paired.repartition(parts, "group", "i", "j").sortWithinPartitions("group", "i", "j").mapInArrow(compare, "a binary, b binary")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, distance: int = DISTANCE, segments: int | None = SEGMENTS, words: int = 1, radius: int | None = None, similarity: float | None = None) -> DataFrame:
    """(doc_id, fp, component_id) of every row of docs.

    component_id is the smallest id that a chain of links reaches. With `similarity`, texts of one
    shingle set are merged, fingerprints are of sets and find candidates only, and links hold by
    the Jaccard similarity of the whole sets; without `segments`, these follow the number of distinct sets. Null and empty texts have the fingerprint 0 and are
    linked like any other. A null id stays null and never names a component unless all ids of it
    are null. Rows repeated under one id each get a row; other columns, whatever their names, are not
    read. Texts are read whole, however long; a task hashes a very long one by itself. An empty
    table gives no rows.
    """
    prints = written(fingerprints(docs, key, text, size, words, similarity is not None), "simhash")
    files = files_for(prints.count())
    node = "fp" if similarity is None else "node"
    lows = prints.groupBy(node).agg(F.min("doc_id").alias("low"), *([] if similarity is None else [F.min("fp").alias("fp"), F.min("n").alias("n")]))
    distinct = written(lows.coalesce(files), "simhash-distinct")
    if segments is None:
        radius = 1 if radius is None else radius
        segments = SEGMENTS if similarity is None else segments_for(distinct.count(), similarity, words, radius)
    found = links(distinct.select("fp").distinct() if similarity is not None else distinct, distance, segments, words, radius)
    stars = components(found if similarity is None else verified(found, distinct, docs, key, text, size, similarity, files), files).withColumnRenamed("node", "_node")
    placed = distinct.join(stars, distinct[node] == stars["_node"], "left").select(node, "low", F.coalesce("component", node).alias("component"))
    least = placed.groupBy("component").agg(F.min("low").alias("component_id"))
    placed = written(placed.join(least, "component").select(node, "component_id").coalesce(files), "simhash-named")
    return prints.select("doc_id", *dict.fromkeys(["fp", node])).join(placed, node).select("doc_id", "fp", "component_id").coalesce(files)


def differing(similarity: float) -> float:
    """The share of bits that differ between texts whose shingle sets have this Jaccard similarity.

    Sets of similarity s have a cosine of 2s / (1 + s), and a bit differs with the angle's share of pi.
    """
    return acos(2 * similarity / (1 + similarity)) / pi


def distance_for(similarity: float, words: int, slack: float = 3.0) -> int:
    """Differing bits of texts whose shingle sets have this Jaccard similarity: the mean and `slack` standard deviations."""
    share = differing(similarity)
    return round(64 * words * share + slack * sqrt(64 * words * share * (1 - share)))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, similarity: float = 0.8, words: int = 4, segments: int | None = None, radius: int = 1) -> DataFrame:
    """The rows of docs without near duplicates: of each group the row of the smallest id stays.

    Groups are components of texts whose sets of `size`-word shingles are `similarity` alike or
    more. Fingerprints of 64 * words bits find the candidates, with some slack, in segments that follow the number of
    texts unless `segments` names one; the whole sets decide.
    Rows are told apart by 128 bits of a SHA-256 of all their named values, so null and repeated ids do
    no harm; of equal rows one stays. Null and empty texts are one group, of which one stays. Texts
    are read whole, however long. Columns of any name and type come back as they were. An empty
    table gives no rows.
    """
    row = free_name(docs, "_row")
    # long values enter by their digests, so that the JSON is short; nulls are left out of it
    values = [F.sha2(named(f.name).cast("binary"), 256).alias(f.name) if f.dataType.typeName() in ("string", "binary") else named(f.name) for f in docs.schema]
    wide = F.coalesce(F.substring(F.unhex(F.sha2(F.to_json(F.struct(*values)), 256)), 1, 16), F.lit(b""))  # never null
    marked = docs.select("*", F.struct(wide.alias("row"), named(key).alias("id")).alias(row))
    groups = near_duplicates(marked, row, text, size, distance_for(similarity, words), segments, words, radius, similarity)
    chosen = groups.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id.id").isNull(), "doc_id.id", "doc_id.row")).alias("c"))
    chosen = written(chosen.select(F.col("c.row").alias(row)).coalesce(files_for(marked.count())), "simhash-kept")
    # a sort-merge join at any size: what is kept grows with the input, so it is never broadcast
    kept = docs.select("*", wide.alias(row)).join(chosen.hint("merge"), row)
    return kept.dropDuplicates([row]).select(*map(named, docs.columns))


def op9_multi_index_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")
