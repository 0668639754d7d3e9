"""Operator 10: packing token pieces into windows by minimum bin slack.

A document is cut at multiples of the capacity. Full pieces are sequences of their own; what is
left of each document, shorter than a window, is packed. Only the number of rests of each length
matters, so the plan is made from a histogram of at most capacity - 1 counts: for the longest
length left, a bitset subset-sum over the remaining multiset finds the fill closest to capacity,
the counts of that fill are traced back through the bitsets, and the pattern is repeated as often
as the histogram allows. Documents then find their place by their rank within their length: ranks
come from per-bucket counts and a running number inside each small bucket, never from one sort.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batch_of, read_table, written

CAPACITY, END_ID = 1024, 0
#: Rests in a numbering bucket, about.
BUCKET_ROWS = 200_000
#: White space in a row from which tiktoken's pattern, which looks ahead there, is not asked: it panics at about a million.
LONG_SPACE = 50_000

_TOKENS = pa.schema([("doc_id", pa.int64()), ("doc_tokens", pa.int64()), ("crcs", pa.list_(pa.int64()))])


def tokenizer_paths() -> tuple[str, str]:
    """The byte-level BPE of tokenizers, and the same vocabulary as ranks for tiktoken."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(2)
def encoder(json_path: str, ranks_path: str | None):
    """text -> ids as Tokenizer.encode(text, add_special_tokens=False) gives them.

    tiktoken reads the same vocabulary three times as fast and gives the same ids, except where a
    text spells a special token; those texts, texts with LONG_SPACE white-space characters in a
    row, and any that tiktoken refuses, go to tokenizers.
    """
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(json_path)
    special = [t.content for t in exact.get_added_tokens_decoder().values()]
    if ranks_path is None:
        return lambda text: exact.encode(text, add_special_tokens=False).ids
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def spaced(text: str) -> bool:
        return len(text) >= LONG_SPACE and any(len(run) >= LONG_SPACE for run in re.findall(r"\s+", text))

    def encode(text: str) -> list[int]:
        if not any(s in text for s in special) and not spaced(text):
            try:
                return fast.encode_ordinary(text)
            except BaseException as e:  # a panic of the library is no Exception
                if not isinstance(e, (ValueError, RuntimeError)) and type(e).__name__ != "PanicException":
                    raise
        return exact.encode(text, add_special_tokens=False).ids

    return encode


def tokenise(docs: DataFrame, key: str, text: str, capacity: int, paths: tuple[str, str | None]) -> DataFrame:
    """(doc_id, doc_tokens, crcs): tokens with the end id, and the crc32 of each piece of `capacity` ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(*paths)
        for batch in batches:
            counts, crcs = [], []
            for value in batch.column(1):
                ids = np.array([*encode(value.as_py() or ""), END_ID], "<u4")
                counts.append(len(ids))
                crcs.append([zlib.crc32(ids[k : k + capacity]) for k in range(0, len(ids), capacity)])
            yield batch_of(_TOKENS, batch.column(0), counts, crcs)

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, doc_tokens long, crcs array<long>")


def best_fill(first: int, counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset holding `first` whose sum is closest to capacity from below, as length -> number.

    Bit s of a bitset says that some multiset of the lengths seen so far sums to s. A length that
    is there k times is added by shifts of 1, 2, 4, ... copies. The bitset before each length is
    kept; from the highest bit, each length is traced back by the fewest copies that lead to a sum
    reachable without it.
    """
    mask, bits, trail = (1 << capacity + 1) - 1, 1 << first, []
    for length in sorted(counts, reverse=True):
        room = min(counts[length] - (length == first), (capacity - first) // length)
        if room <= 0:
            continue
        trail.append((length, bits))
        copies = 1
        while room:
            step = min(copies, room)
            bits |= bits << step * length & mask
            room -= step
            copies *= 2
        if bits >> capacity & 1:
            break
    at, fill = bits.bit_length() - 1, {first: 1}
    for length, before in reversed(trail):
        while not before >> at & 1:
            at -= length
            fill[length] = fill.get(length, 0) + 1
    return fill


def plan_windows(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Slots (length, rank_from, rank_to, first_sequence, copies, offset) for all rests, and the number of windows.

    The plan has at most a few patterns for each length, whatever the number of documents.
    """
    left = {k: v for k, v in histogram.items() if v > 0}
    used, slots, windows = dict.fromkeys(left, 0), [], 0
    while left:
        fill = best_fill(max(left), left, capacity)
        times = min(left[k] // n for k, n in fill.items())
        offset = 0
        for length, copies in sorted(fill.items(), reverse=True):
            slots.append((length, used[length], used[length] + times * copies, windows, copies, offset))
            used[length] += times * copies
            offset += length * copies
            left[length] -= times * copies
            if not left[length]:
                del left[length]
        windows += times
    return slots, windows


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, paths: tuple[str, str | None] | None = None) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are a piece of one id, the end. Very long texts give many full pieces.
    Repeated rows are packed as often as they stand there; a null id stays null; further columns
    are not read. An empty table gives no rows. Each id lies in one piece; offsets in a sequence
    are gapless from 0.
    """
    spark = docs.sparkSession
    tokens = written(tokenise(docs, key, text, capacity, paths or tokenizer_paths()).withColumn("uid", F.monotonically_increasing_id()), "pack-tokens")
    rows = tokens.agg(F.count(F.lit(1))).first()[0]
    buckets = max(32, -(-rows // BUCKET_ROWS))
    placed = tokens.withColumn("rest", F.col("doc_tokens") % capacity).withColumn("full", F.expr(f"doc_tokens div {capacity}")).withColumn("bucket", F.pmod(F.xxhash64("uid"), F.lit(buckets)))
    counts = written(placed.groupBy("rest", "bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("full").alias("full")), "pack-counts")
    histogram = {r["rest"]: r["n"] for r in counts.where("rest > 0").groupBy("rest").agg(F.sum("n").alias("n")).collect()}
    slots, windows = plan_windows(histogram, capacity)

    before = lambda *part: Window.partitionBy(*part).orderBy("bucket", "rest").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("rank0", F.coalesce(F.sum("n").over(before("rest")), F.lit(0))).withColumn("full_here", F.coalesce(F.sum("full").over(before("bucket")), F.lit(0)))
    per_bucket = counts.groupBy("bucket").agg(F.sum("full").alias("f"))
    bucket0 = per_bucket.select("bucket", F.coalesce(F.sum("f").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("bucket0"))
    starts = starts.join(bucket0, "bucket").select("rest", "bucket", "rank0", (F.col("full_here") + F.col("bucket0") + windows).alias("seq0"))
    inside = Window.partitionBy("rest", "bucket").orderBy("uid")
    numbered = placed.withColumn("r", F.row_number().over(inside) - 1).withColumn("f", F.coalesce(F.sum("full").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    numbered = numbered.join(starts, ["rest", "bucket"]).withColumn("rank", F.col("rank0") + F.col("r"))

    plan = spark.createDataFrame(slots or [(-1, 0, 0, 0, 1, 0)], "length long, a long, b long, window long, copies long, at long")
    slot = F.broadcast(plan)  # at most a few rows for each length below the capacity
    found = numbered.join(slot, (F.col("rest") == F.col("length")) & (F.col("rank") >= F.col("a")) & (F.col("rank") < F.col("b")), "left")
    piece = found.select("doc_id", "doc_tokens", "full", "rest", "seq0", "f", "rank", "a", "window", "copies", "at", F.posexplode("crcs").alias("k", "ids_crc32"))
    last = F.col("k") == F.col("full")
    j = F.col("rank") - F.col("a")
    return piece.select(
        "doc_id",
        (F.col("k").cast("long") * capacity).alias("start"),
        F.when(last, F.col("rest")).otherwise(F.lit(capacity).cast("long")).alias("length"),
        "ids_crc32",
        "doc_tokens",
        F.when(last, F.col("window") + F.floor(j / F.col("copies")).cast("long")).otherwise(F.col("seq0") + F.col("f") + F.col("k")).cast("long").alias("sequence_id"),
        F.when(last, F.col("at") + (j % F.col("copies")) * F.col("rest")).otherwise(F.lit(0)).cast("long").alias("offset"),
    )


def op10_minimum_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))
