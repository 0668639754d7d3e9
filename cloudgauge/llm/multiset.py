"""Operator 8: document fingerprints by a homomorphic multiset hash.

A text is a multiset of passages: its paragraphs (lines), cut after sentence ends and every
PASSAGE words. Each passage hashes to a wide vector; a fingerprint is the sum of the vectors, modulo
2**16 in every lane. The sum does not depend on the order, and passages are inserted or deleted by
adding or subtracting their vectors. EQUAL lanes are uniform and tell multisets apart; LIKE
lanes are +1 or -1, so that the squared difference of two fingerprints estimates the size of the
passages' symmetric difference, which gives a likeness.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_of, chunks, read_table

#: Lanes of 16 bits, and the most words of a passage.
EQUAL, LIKE, PASSAGE = 64, 256, 16
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def passages(text: str) -> list[str]:
    """The passages of a text, without white space around them; blank ones are none."""
    out = []
    for line in text.splitlines():
        words: list[str] = []
        for word in line.split():
            words.append(word)
            if len(words) == PASSAGE or word[-1] in ".!?":
                out.append(" ".join(words))
                words = []
        if words:
            out.append(" ".join(words))
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def vectors(keys: np.ndarray) -> np.ndarray:
    """Wide vectors (uint16) of 128-bit passage hashes (two words a row), one row each."""
    words = EQUAL // 4 + LIKE // 64
    steps = _GOLD * np.arange(1, words + 1, dtype=np.uint64)[None, :]
    with np.errstate(over="ignore"):
        stream = _mixed(_mixed(keys[:, :1] + steps) ^ (keys[:, 1:] + steps))
    equal = np.ascontiguousarray(stream[:, : EQUAL // 4]).view("<u2")
    signs = np.unpackbits(np.ascontiguousarray(stream[:, EQUAL // 4 :]).view(np.uint8), axis=1).astype(np.uint16)
    return np.concatenate([equal, signs * np.uint16(2) - np.uint16(1)], 1)


def passage_keys(items: list[str]) -> np.ndarray:
    """XXH3's 128 bits of each passage, as two words, the low one first."""
    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(p) for p in items), ">u8").astype(np.uint64).reshape(-1, 2)[:, ::-1]


class Fingerprint:
    """A sum of passage vectors; insert() and delete() change it by passages, in any order."""

    def __init__(self, text: str = ""):
        self.lanes = np.zeros(EQUAL + LIKE, np.uint16)
        self.insert(passages(text))

    def _sum(self, items: list[str]) -> np.ndarray:
        total = np.zeros(EQUAL + LIKE, np.uint16)
        for at in range(0, len(items), 4096):
            total += vectors(passage_keys(items[at : at + 4096])).sum(0, dtype=np.uint16)
        return total

    def insert(self, items: list[str]) -> Fingerprint:
        self.lanes = self.lanes + self._sum(items)
        return self

    def delete(self, items: list[str]) -> Fingerprint:
        self.lanes = self.lanes - self._sum(items)
        return self

    def copy(self) -> Fingerprint:
        out = Fingerprint()
        out.lanes = self.lanes.copy()
        return out

    def hex(self) -> str:
        return self.lanes.astype("<u2").tobytes().hex()

    def likeness(self, other: Fingerprint) -> float:
        """1 for equal fingerprints; else about 2 * common / (sum of both sizes squared by passage), 0 to 1."""
        if np.array_equal(self.lanes, other.lanes):
            return 1.0
        a, b = (x.lanes[EQUAL:].view(np.int16).astype(float) for x in (self, other))
        whole = (a @ a + b @ b) or 1.0
        return float(min(1.0, max(0.0, 1 - ((a - b) @ (a - b)) / whole)))


def edited(prints: Fingerprint, text: str, head: str) -> tuple[str, Fingerprint]:
    """The text whose last quarter is replaced by the head of another, and its fingerprint.

    Passages that both texts share stay in the sum; those of the old end are deleted and those of
    the new end inserted.
    """
    cut = len(text) - len(text) // 4
    new = text[:cut] + head[: len(text) // 4]
    line = max(text.rfind(end, 0, cut) for end in "\n\r") + 1  # whole lines before it are untouched
    return new, prints.copy().delete(passages(text[line:])).insert(passages(new[line:]))


_OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _range_of(column: str, cuts: list[int], low: int = 0) -> str:
    """SQL for the number of cuts at or below a key, as a tree of comparisons."""
    if not cuts:
        return str(low)
    mid = len(cuts) // 2
    return f"CASE WHEN {column} < {cuts[mid]}L THEN {_range_of(column, cuts[:mid], low)} ELSE {_range_of(column, cuts[mid + 1 :], low + mid + 1)} END"


def with_successor(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(range, ghost, k, doc_id, text), where each range ends with a ghost of the row that follows it.

    Ranges of ids come from quantiles, one for each shuffle partition; a table of one row a range
    says which rows begin a range, and those go to the range before as well. One shuffle moves the
    texts, and a task sorts its own ranges.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(-(2**63))).alias("k"), F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    cuts = rows.agg(F.percentile_approx("k", [p / parts for p in range(1, parts)], 20 * parts)).first()[0] if parts > 1 else []
    rows = rows.withColumn("range", F.expr(_range_of("k", sorted(set(cuts or [])))).cast("int"))
    first = [(r["range"], r["k"]) for r in rows.groupBy("range").agg(F.min("k").alias("k")).orderBy("range").collect()]
    ghosts = [(k, first[at - 1][0]) for at, (_, k) in enumerate(first)] or [(0, 0)]
    table = F.broadcast(spark.createDataFrame(ghosts, "k long, before int"))  # one row a range
    rows = rows.join(table, "k", "left")
    places = F.array_compact(F.array(F.struct(F.col("range"), F.lit(False).alias("ghost")), F.when(F.col("before").isNotNull(), F.struct(F.col("before").alias("range"), F.lit(True).alias("ghost")))))
    dealt = rows.select("k", "doc_id", "text", F.explode(places).alias("p")).select("p.range", "p.ghost", "k", "doc_id", "text")
    return dealt.repartitionById(parts, F.col("range")).sortWithinPartitions("range", "ghost", "k", "text")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every whole text and of its edited text, with their likenesses.

    The next document is the next in ascending id; rows of one id follow each other by text, a null
    id comes first, and the first document follows the last (a single one follows itself). Null
    texts count as empty: their fingerprint is the zero sum, and two empty multisets are alike (1).
    Further columns are not read; an empty table gives no rows. A range holds all rows of an id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # (range, doc_id, text, fingerprint) that waits for its successor
        for batch in batches:
            for part in chunks(batch, "text"):
                out = []
                for where, ghost, doc_id, value in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(3).to_pylist(), part.column(4), strict=True):
                    if ghost and (last is None or last[0] != where):
                        continue
                    body = value.as_py()
                    prints = Fingerprint(body)
                    if last is not None and last[0] == where:
                        new, changed = edited(last[3], last[2], body)
                        digest = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
                        out.append((last[1], len(last[2]), digest, last[3].hex(), changed.hex(), last[3].likeness(changed), last[3].likeness(prints)))
                    last = None if ghost else (where, doc_id, body, prints)
                if out:
                    yield batch_of(_OUT, *map(list, zip(*out, strict=True)))

    return with_successor(docs, key, text).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op8_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(read_table(spark, sf_dir, "documents"))
