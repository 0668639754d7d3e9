"""Operator 11: phrase collocations mined from exact n-gram counts.

Texts are split into pieces, and identical pieces are merged into one with a multiplicity, so every
count is weighted. A first pass sums the 64-bit hashes of words and of pairs of words; those that reach
the least count set bits of a bitmap of bounded size. The second pass spells only the n-grams whose
words and pairs all have their bits (no frequent one is missed, as a phrase is no more frequent than
its parts), sums them within a chunk of text, and deals them to hash buckets. A bucket is counted
by duckdb, which streams the rows in and spills its groups to disk. For each cut of a candidate, requests for the counts
of both parts travel to the bucket of the part and meet it there; parts that very many candidates
ask for are answered by a broadcast of a few thousand rows, so that no part gathers in one task.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_words, batch_of, chunks, named, read_table, written
from .simhash import _looked_up

#: Words of a phrase at most, its count at least, phrases kept of each language, percent of a phrase's count at which a longer one hides it.
LONGEST, LEAST, KEPT, HIDES = 5, 100, 2000, 100
#: Text bytes whose n-grams are summed at a time; memory of a bucket's duckdb before it spills.
SUM_BYTES, DUCKDB_MB = 8 << 20, 256
#: Bits of the bitmap for each frequent hash, and at least and at most (powers of two; 32 MB); bits that a hash sets.
BITS_EACH, LEAST_BITS, MOST_BITS, PROBES = 16, 1 << 16, 1 << 28, 3
#: Stands between a language and a phrase in a key; no phrase holds it.
BETWEEN = "\n"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def pieces_of(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, piece, m): the distinct pieces of each language, and how often each stands in the texts."""
    lowered = F.translate(F.coalesce(named(text), F.lit("")), UPPER, LOWER)
    rows = docs.select(F.coalesce(named(lang).cast("string"), F.lit("und")).alias("lang"), F.explode(F.split(lowered, r"[.,;:!?\x0A-\x0D]")).alias("piece"))
    trimmed = rows.select("lang", F.expr(r"trim(BOTH ' \t' FROM piece)").alias("piece")).where("piece <> ''")
    return trimmed.groupBy("lang", "piece").agg(F.count(F.lit(1)).alias("m"))


def summed(ids: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ids, the place of each id among them, and the whole weight of each; in integers."""
    distinct, place = np.unique(ids, return_inverse=True)
    total = np.zeros(len(distinct), np.int64)
    np.add.at(total, place, weights)
    return distinct, place, total


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Chunk:
    """Words of some pieces: of each occurrence its place among the distinct (language, word) keys, its hash, its weight, and the hash of it and the next."""

    def __init__(self, part: pa.RecordBatch):
        number, flat = ascii_words(part.column(1))
        langs, words = part.column(0).dictionary_encode(), flat.dictionary_encode()
        piece = np.repeat(np.arange(len(number)), number)
        lang = langs.indices.to_numpy().astype(np.int64)[piece]
        code = lang * max(1, len(words.dictionary)) + words.indices.to_numpy()
        distinct, self.place = np.unique(code, return_inverse=True)
        seeds = [xxhash.xxh64_intdigest(x) for x in langs.dictionary.to_pylist()]
        of_lang, of_word = np.divmod(distinct, max(1, len(words.dictionary)))
        spelled = words.dictionary.to_pylist()
        hashes = np.array([xxhash.xxh64_intdigest(spelled[w], seeds[k]) for k, w in zip(of_lang.tolist(), of_word.tolist(), strict=True)], np.uint64)
        self.words = words.dictionary.take(pa.array(of_word))
        self.keys = pc.binary_join_element_wise(langs.dictionary.take(pa.array(of_lang)), self.words, BETWEEN)
        self.hash = hashes[self.place]
        self.weight = part.column(2).to_numpy().astype(np.int64)[piece]
        self.joined = piece[1:] == piece[:-1]
        with np.errstate(over="ignore"):
            self.pair = _mixed(self.hash[:-1] * np.uint64(0x9E3779B97F4A7C15) + self.hash[1:])
        self.langs, self.lang = langs.dictionary, lang


_HASHED = pa.schema([("h", pa.int64()), ("w", pa.int64())])
_COUNTED = pa.schema([("key", pa.string()), ("w", pa.int64())])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of words and pairs with their weights, summed within a chunk."""
    for batch in batches:
        for part in chunks(batch, 1, SUM_BYTES):
            c = Chunk(part)
            for h, w in ((c.hash, c.weight), (c.pair[c.joined], c.weight[1:][c.joined])):
                distinct, _, total = summed(h, w)
                yield batch_of(_HASHED, distinct.view(np.int64), total)


class Bitmap:
    """Hashes by PROBES bits each, named by their low and high halves; says yes to all that were put in, and to few others."""

    def __init__(self, cells: np.ndarray, masks: np.ndarray, bits: int):
        self.words, self.bits = np.zeros(bits >> 6, np.uint64), bits
        self.words[cells] = masks

    def __call__(self, h: np.ndarray) -> np.ndarray:
        first, step = h & np.uint64(self.bits - 1), h >> np.uint64(32) | np.uint64(1)
        out = np.ones(len(h), bool)
        for k in range(PROBES):
            at = first + step * np.uint64(k) & np.uint64(self.bits - 1)
            out &= (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out


def frequent_hashes(pieces: DataFrame, least: int = LEAST) -> Bitmap:
    """The hashes of words and pairs that are frequent. Bits are set by an aggregation; the driver gets at most MOST_BITS of them."""
    sums = pieces.mapInArrow(_hashed, "h long, w long").groupBy("h").agg(F.sum("w").alias("w")).where(F.col("w") >= least).select("h")
    sums = written(sums, "phrases-hashes")
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_EACH * sums.count()).bit_length()))
    probes = F.expr(f"explode(transform(sequence(0, {PROBES - 1}), k -> ((h & {bits - 1}) + k * (shiftrightunsigned(h, 32) | 1)) & {bits - 1}))")
    masks = F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("mask")
    cells = sums.select(probes.alias("bit")).groupBy(F.shiftright("bit", 6).alias("cell")).agg(masks).toArrow()
    return Bitmap(cells.column("cell").to_numpy(), cells.column("mask").to_numpy().view(np.uint64), bits)


def spelled(c: Chunk, likely: Bitmap, longest: int = LONGEST) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Keys and weights of a chunk's likely n-grams, by their length; before them each language's number of words, under its key without a phrase."""
    lang, _, total = summed(c.lang, c.weight)
    yield pc.binary_join_element_wise(c.langs.take(pa.array(lang)), "", BETWEEN), total
    good = likely(c.hash)
    at = np.flatnonzero(good)
    distinct, place, total = summed(c.place[at], c.weight[at])
    keys = c.keys.take(pa.array(distinct))
    yield keys, total
    goes_on = np.r_[c.joined & good[:-1] & good[1:], False]
    goes_on[:-1] &= likely(c.pair)
    for length in range(2, longest + 1):
        # an n-gram is a shorter one, by its place among their keys, and the word behind it
        on = goes_on[at + length - 2]
        at, prefix = at[on], place[on]
        if not len(at):
            return
        own, place, total = summed(prefix * np.int64(len(c.words)) + c.place[at + length - 1], c.weight[at])
        before, last = np.divmod(own, len(c.words))
        keys = pc.binary_join_element_wise(keys.take(pa.array(before)), c.words.take(pa.array(last)), " ")
        yield keys, total


def counted(least: int):
    """Counts a hash bucket's n-grams in duckdb, out of core; its scratch goes when the bucket is done."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryDirectory() as scratch, duckdb.connect(config={"memory_limit": f"{DUCKDB_MB}MB", "threads": 1, "temp_directory": scratch, "preserve_insertion_order": False}) as db:
            db.register("grams", pa.RecordBatchReader.from_batches(_COUNTED, (b.cast(_COUNTED) for b in batches)))
            db.execute(f"SELECT key, sum(w)::BIGINT AS w FROM grams GROUP BY key HAVING sum(w) >= {least} OR ends_with(key, chr({ord(BETWEEN)}))")
            for batch in db.to_arrow_reader(1 << 16):
                yield batch_of(_COUNTED, *batch.columns)

    return run


def frequent_ngrams(pieces: DataFrame, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """(key, f): the n-grams of 1 to `longest` words found `least` times or more, and each language's number of words."""
    shared = pieces.sparkSession.sparkContext.broadcast(frequent_hashes(pieces, least))  # MOST_BITS at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 1, SUM_BYTES):
                for keys, weights in spelled(Chunk(part), shared.value, longest):
                    yield batch_of(_COUNTED, keys, weights)

    parts = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pieces.mapInArrow(run, "key string, w long").repartition(parts, "key").mapInArrow(counted(least), "key string, w long").withColumnRenamed("w", "f")


def score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 * a * n / (left * right)) in decimals of 38 digits."""
    wide = lambda c, digits: c.cast(f"decimal({digits},0)")
    return F.call_function("div", wide(wide(F.lit(1000), 4) * wide(a, 16), 20) * wide(n, 17), wide(left, 18) * wide(right, 18))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, kept: int = KEPT, hides: int = HIDES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first phrases of 2 to `longest` words that are counted `least` times or more.

    Null and empty texts have no pieces; a null language is `und`. Repeated rows count each time. Texts
    are read whole, however long; a very long piece is handled by itself. Ties in score and count go
    by the phrase's bytes. An empty table, or one without frequent phrases, gives no rows. Other columns, whatever their names, are
    not read. Counts are exact up to 10^16 of a phrase and 10^17 words of a language.
    """
    pieces = written(pieces_of(docs, text, lang), "phrases-pieces")
    counts = written(frequent_ngrams(pieces, least, longest), "phrases-counts")
    phrase = F.substring_index("key", BETWEEN, -1)
    own = F.expr("substring(key, 1, length(key) - length(phrase) - 1)")
    all_phrases = counts.withColumn("phrase", phrase).select("key", own.alias("lang"), "phrase", F.split("phrase", " ").alias("words"), F.col("f").alias("a"))
    candidates = all_phrases.where(F.size("words") > 1)

    def part(first: Column | int, number: Column) -> Column:
        return F.concat("lang", F.lit(BETWEEN), F.array_join(F.slice("words", first, number), " "))

    size = F.size("words")
    hidden = candidates.where(size > 2).select("a", "lang", "words", F.explode(F.sequence(F.lit(2), size - 1)).alias("k"))
    hidden = hidden.select("a", F.explode(F.transform(F.sequence(F.lit(1), size - F.col("k") + 1), lambda i: part(i, F.col("k")))).alias("key"))
    hidden = hidden.groupBy("key").agg(F.max("a").alias("longer"))
    seen = candidates.join(hidden.hint("merge"), "key", "left").where(f"longer IS NULL OR 100 * longer < {hides} * a")

    ask = lambda side, of: F.struct(F.lit(side).alias("side"), of.alias("part"))
    asks = lambda k: F.array(ask("n", F.concat("lang", F.lit(BETWEEN))), ask("l", part(1, k)), ask("r", part(k + 1, size - k)))
    requests = seen.select("key", "a", "lang", "words", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    requests = written(requests.select("key", "a", "k", F.explode(asks(F.col("k"))).alias("ask")).select("key", "a", "k", "ask.*"), "phrases-requests")
    asked = requests.groupBy("part").agg(F.count(F.lit(1)).alias("n")).join(counts.withColumnRenamed("key", "part").hint("merge"), "part")
    answers = _looked_up(requests, written(asked, "phrases-asked"), "part", requests.count())

    answer = lambda side: F.max(F.when(F.col("side") == side, F.col("f"))).alias(side)
    cuts = answers.repartition(F.col("key")).groupBy("key", "a", "k").agg(answer("n"), answer("l"), answer("r"))
    lowest = cuts.groupBy("key", "a").agg(F.min(F.struct(score(F.col("a"), F.col("n"), F.col("l"), F.col("r")).alias("score"), "k", "l", "r", "n")).alias("cut"))
    rows = lowest.withColumn("phrase", phrase).select(own.alias("lang"), "phrase", "a", "cut.l", "cut.r", "cut.n", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= kept)  # a task passes on `kept` rows of a language at most
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents"))


ORACLE_SQL = rf"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
), words AS (
    SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS ws FROM pieces
), totals AS (
    SELECT lang, sum(len(ws)) AS n FROM words GROUP BY lang
), grams AS (
    SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase
    FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM words, range(1, {LONGEST + 1}) AS lengths(k) WHERE len(ws) >= k)
), counts AS (
    SELECT lang, k, phrase, count(*) AS f, string_split(phrase, ' ') AS ws FROM grams GROUP BY ALL HAVING count(*) >= {LEAST}
), hidden AS (
    SELECT lang, array_to_string(ws[i:i + j - 1], ' ') AS phrase, max(f) AS f
    FROM (SELECT lang, ws, f, j, unnest(range(1, k - j + 2)) AS i FROM counts, range(2, {LONGEST}) AS shorter(j) WHERE j < k)
    GROUP BY ALL
), seen AS (
    SELECT c.* FROM counts AS c LEFT JOIN hidden AS h USING (lang, phrase) WHERE c.k > 1 AND (h.f IS NULL OR 100 * h.f < {HIDES} * c.f)
), cuts AS (
    SELECT s.lang, s.phrase, s.f AS a, l.f AS l, r.f AS r, t.n, s.cut, (1000::HUGEINT * s.f * t.n) // (l.f::HUGEINT * r.f) AS score
    FROM (SELECT *, unnest(range(1, k)) AS cut FROM seen) AS s
    JOIN totals AS t ON t.lang = s.lang
    JOIN counts AS l ON l.lang = s.lang AND l.phrase = array_to_string(s.ws[1:s.cut], ' ')
    JOIN counts AS r ON r.lang = s.lang AND r.phrase = array_to_string(s.ws[s.cut + 1:], ' ')
), lowest AS (
    SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
    a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM lowest QUALIFY rank <= {KEPT}
"""
