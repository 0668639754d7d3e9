"""Operator 4: language-model scores from an Elias-Fano n-gram trie.

Level 1 holds the words: their 64-bit hashes and running counts are Elias-Fano sequences, and a
word's id is its place. Level 2 holds the bigrams by (context word, word), level 3 the trigrams
by (context bigram, word). A level's monotone pointers say where each context's children begin.
Children are numbers relative to their context - in level 3 a word is its place among the children
of the bigram's second word, which holds it too - raised by the last number of the context before,
so that the whole level is one monotone sequence; a child is found by successor search.
Each entry keeps its discounted share of its context as a 16-bit logarithm, and each context
the sum of those shares; what is missing from 1 goes to the next shorter context (interpolated
absolute discounting), and from words to one unknown word. Higher entries seen once are left out.

Levels are cut into segments of bounded size by ranges of their keys, so that a frequent context
may span several. Segments are built by tasks, written to the shared folder and memory-mapped.
Counting goes in three passes: words; bigrams of words seen often enough; trigrams of which both
bigrams were kept. Tasks send sorted, compressed counts by segment, not single n-grams.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from math import log10

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_words, batch_of, chunks, crc_fold, dropped_at_end, fresh_dir, read_table
from .eliasfano import EliasFano, load, save

#: Discount, least count of bigrams and trigrams, tokens of a segment, pending keys of a task.
DISCOUNT, LEAST, SEGMENT_TOKENS, PENDING = 0.75, 2, 4_000_000, 2_000_000
#: Documents whose words make a segment of level 1, about.
SEGMENT_DOCS = 32_768
#: The hash that stands for a text's end; no word has it.
END = np.uint64(0)
#: Steps of a quantised logarithm to a decade.
_STEPS = 4096


def _stirred(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of words, never END: of three 8-byte pieces and the length, or XXH64 for longer words.

    Ids rest on them being distinct, which 64 bits hold for any vocabulary in reach.
    """
    size = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    if not len(size):
        return np.empty(0, np.uint64)
    _, offsets, data = words.cast(pa.binary()).buffers()
    start = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(size)].astype(np.int64)
    text = np.r_[np.frombuffer(data, np.uint8), np.zeros(24, np.uint8)]
    at = np.arange(24)
    pieces = text[start[:, None] + at[None, :]]
    pieces[at[None, :] >= size[:, None]] = 0
    pieces = pieces.view(np.uint64)
    out = size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(3):
        out = _stirred(out ^ pieces[:, k]) + np.uint64(k + 1)
    for k in np.flatnonzero(size > 24):
        out[k] = xxhash.xxh64_intdigest(text[start[k] : start[k] + size[k]].tobytes(), 7)
    return np.where(out == END, np.uint64(1), out)


def quantised(p: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-np.log10(np.maximum(p, 1e-30)) * _STEPS), 0, 65535).astype(np.uint16)


def restored(q: np.ndarray) -> np.ndarray:
    return 10.0 ** (-q.astype(np.float64) / _STEPS)


@dataclass
class Segment:
    uri: str
    first: int  # contexts from `first` to `last` have children here
    last: int
    base: int  # entries in the segments before
    n: int
    before: int = 0  # sum of the counts in the segments before
    total: int = 0  # sum of the counts here


@dataclass
class Trie:
    """Where the segments are, and the totals. Workers map segments when they first need them."""

    cuts: int = 1  # segments of level 1
    words: list[Segment] = field(default_factory=list)
    levels: list[list[Segment]] = field(default_factory=list)  # bigrams, trigrams
    tokens: int = 0
    vocabulary: int = 0
    least: int = LEAST  # count from which a word may be in bigrams
    fan: int = 1  # most children of a word
    _open: dict[str, dict] = field(default_factory=dict)
    _ranges: dict = field(default_factory=dict)

    def __getstate__(self):
        return self.__dict__ | {"_open": {}, "_ranges": {}}

    def touched(self, segments: list[Segment], by: str, values: np.ndarray) -> Iterator[tuple[Segment, int, int]]:
        """The segments that hold some of the ascending values, and which ones: by their 'contexts' or by their 'places'. No other is opened."""
        name = (by, id(segments))
        if name not in self._ranges:
            ranges = [(s.first, s.last + 1) if by == "contexts" else (s.base, s.base + s.n) for s in segments]
            self._ranges[name] = np.array(ranges, np.int64).reshape(-1, 2).T
        start, stop = (np.searchsorted(values, edge) for edge in self._ranges[name])
        for k in np.flatnonzero(start < stop):
            if segments[k].n:
                yield segments[k], int(start[k]), int(stop[k])

    def opened(self, s: Segment) -> dict:
        if s.uri not in self._open:
            self._open[s.uri] = load(s.uri)[0]
        return self._open[s.uri]

    def ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: unknown) and training counts of words."""
        ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        where = cut_of(hashes, self.cuts)
        order = np.argsort(hashes)
        bounds = np.searchsorted(where[order], np.arange(len(self.words) + 1))
        for k in np.flatnonzero(bounds[1:] > bounds[:-1]):
            s = self.words[k]
            if s.n:
                rows, parts = order[bounds[k] : bounds[k + 1]], self.opened(s)
                at = parts["hash"].find(hashes[rows] - np.uint64(s.first))
                rows, at = rows[at >= 0], at[at >= 0]
                ids[rows] = at + s.base
                counts[rows] = (parts["count"].access(at + 1) - parts["count"].access(at)).astype(np.int64)
        return ids, counts

    def contexts(self, level: int, ctx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of ascending, distinct contexts: the place of their first child, and the share that children have."""
        start, share = np.full(len(ctx), -1, np.int64), np.zeros(len(ctx))
        for s, a, b in self.touched(self.levels[level], "contexts", ctx):
            parts, own = self.opened(s), ctx[a:b] - s.first
            begin = parts["pointer"].access(own).astype(np.int64) + s.base
            start[a:b] = np.where(start[a:b] < 0, begin, start[a:b])
            share[a:b] += parts["share"][own] / 65535.0
        return start, np.minimum(share, 1.0)

    def find(self, level: int, ctx: np.ndarray, child: np.ndarray) -> np.ndarray:
        """Places of entries (context, child), sorted by both; -1 where absent."""
        out = np.full(len(ctx), -1, np.int64)
        for s, a, b in self.touched(self.levels[level], "contexts", ctx):
            parts = self.opened(s)
            own, which = np.unique(ctx[a:b] - s.first, return_inverse=True)
            begin, end = (parts["pointer"].access(own + k).astype(np.int64) for k in (0, 1))
            base = np.where(begin > 0, parts["child"].access(np.maximum(begin - 1, 0)), np.uint64(0))
            at = parts["child"].find(base[which] + child[a:b].astype(np.uint64) + np.uint64(1))
            good = (at >= begin[which]) & (at < end[which])
            out[a:b][good] = at[good] + s.base
        return out

    def entry(self, level: int, place: np.ndarray) -> np.ndarray:
        """The quantised shares of entries at ascending places."""
        out = np.zeros(len(place), np.int64)
        for s, a, b in self.touched(self.levels[level], "places", place):
            out[a:b] = self.opened(s)["p"][place[a:b] - s.base]
        return out

    def running(self, segments: list[Segment], place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of entries (words, or bigrams) at ascending places: the counts of all entries before, summed, and their own."""
        before, count = np.zeros(len(place)), np.zeros(len(place))
        for s, a, b in self.touched(segments, "places", place):
            low, high = (self.opened(s)["count"].access(place[a:b] - s.base + k).astype(np.float64) for k in (0, 1))
            before[a:b], count[a:b] = low + s.before, high - low
        return before, count


def cut_of(hashes: np.ndarray, cuts: int) -> np.ndarray:
    """The level-1 segment of each hash: equal ranges."""
    return (hashes // np.uint64(-(-(1 << 64) // cuts) if cuts > 1 else (1 << 64) - 1)).astype(np.int64).clip(0, cuts - 1)


def _first_hash(cut: int, cuts: int) -> int:
    return cut * -(-(1 << 64) // cuts) if cuts > 1 else 0


@dataclass
class Coded:
    """Texts of a chunk as numbers: tokens of each text (with the end), and the word of each token."""

    number: np.ndarray
    token: np.ndarray  # places in `hashes`; the end is place 0
    hashes: np.ndarray


def coded(texts: pa.Array) -> Coded:
    count, flat = ascii_words(texts, lower=True)
    words = flat.dictionary_encode()
    number = count + 1
    token = np.zeros(number.sum(), np.int64)
    inside = np.ones(len(token), bool)
    inside[np.cumsum(number) - 1] = False
    token[inside] = words.indices.to_numpy(zero_copy_only=False) + 1
    return Coded(number, token, np.r_[END, word_hashes(words.dictionary)].astype(np.uint64))


def context_tokens(c: Coded) -> np.ndarray:
    """The token before each token; a text begins after an end."""
    before = np.r_[0, c.token[:-1]].astype(np.int64)
    before[np.cumsum(c.number) - c.number] = 0
    return before


_BLOB = pa.schema([("segment", pa.int32()), ("counts", pa.binary())])


def _packed(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending keys as differences with counts, compressed."""
    steps = np.diff(keys, prepend=np.uint64(0))
    return len(keys).to_bytes(8, "little") + zstandard.compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes() + counts.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(blob[:8], "little")
    raw = np.frombuffer(zstandard.decompress(blob[8:]), np.uint8)
    steps = np.ascontiguousarray(raw[: 8 * n].reshape(8, n).T).view(np.uint64).ravel()
    return np.cumsum(steps, dtype=np.uint64), np.ascontiguousarray(raw[8 * n :].reshape(4, n).T).view("<u4").ravel().astype(np.int64)


def merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with their counts summed."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    return keys[start], np.add.reduceat(counts, start) if len(start) else counts


def _counted(texts: DataFrame, keys_of: Callable[[Coded], np.ndarray], segment_of: Callable[[np.ndarray], np.ndarray], segments: int, build: Callable[[int, np.ndarray, np.ndarray], tuple]) -> list:
    """Counts keys of all texts and builds each segment from its own; what build() returns, by segment."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            keys, counts = merged(np.concatenate(held), np.concatenate(numbers))
            held.clear()
            numbers.clear()
            where = segment_of(keys)
            bounds = np.searchsorted(where, np.arange(segments + 1))
            some = [(k, _packed(keys[a:b], counts[a:b])) for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)) if a < b]
            return batch_of(_BLOB, [k for k, _ in some], [b for _, b in some])

        held, numbers = [], []
        for batch in batches:
            for part in chunks(batch, "text"):
                keys, counts = np.unique(keys_of(coded(part.column(0))), return_counts=True)
                held.append(keys)
                numbers.append(counts)
                if sum(map(len, held)) > PENDING:
                    yield flush()
        if held:
            yield flush()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[bytes]] = {}
        for batch in batches:
            for segment, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parts.setdefault(segment, []).append(blob)
        for segment, blobs in parts.items():
            keys, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
            while blobs:  # a few at a time, so that memory follows the distinct keys
                some = [_unpacked(blobs.pop()) for _ in range(min(4, len(blobs)))]
                keys, counts = merged(np.concatenate([keys, *(k for k, _ in some)]), np.concatenate([counts, *(c for _, c in some)]))
            yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([json.dumps(build(segment, keys, counts))])], names=["segment", "facts"])

    blobs = texts.mapInArrow(count, "segment int, counts binary").repartition(segments, "segment")
    rows = blobs.mapInArrow(gather, "segment int, facts string").collect()  # one short row a segment
    return [(r["segment"], json.loads(r["facts"])) for r in sorted(rows, key=lambda r: r["segment"])]


def _level(path: str, name: str, ctx: np.ndarray, child: np.ndarray, counts: np.ndarray, of_context: np.ndarray, counted: bool) -> list:
    """Writes a level segment from sorted entries; of_context: each entry's context count; counted: keeps running counts."""
    first, last = (int(ctx[0]), int(ctx[-1])) if len(ctx) else (0, -1)
    pointer = np.searchsorted(ctx, np.arange(first, last + 2))
    share = (counts - DISCOUNT) / of_context
    begins = np.flatnonzero(np.r_[True, ctx[1:] != ctx[:-1]]) if len(ctx) else np.empty(0, np.int64)
    sums = np.zeros(max(0, last - first + 1))
    sums[ctx[begins] - first] = np.add.reduceat(share, begins) if len(begins) else []
    # a context's children, from 1, are raised by the last number of the context before
    most = child[np.r_[begins[1:] - 1, len(child) - 1]] + 1 if len(begins) else np.empty(0, np.int64)
    raised = np.repeat(np.cumsum(most) - most, np.diff(np.r_[begins, len(ctx)])) + child + 1
    parts = {
        "pointer": EliasFano.of(pointer, len(ctx) + 1),
        "child": EliasFano.of(raised, int(raised[-1]) + 1 if len(raised) else 1),
        "p": quantised(share),
        "share": np.rint(np.minimum(sums, 1) * 65535).astype(np.uint16),
    }
    if counted:
        parts["count"] = EliasFano.of(np.r_[0, np.cumsum(counts)], int(counts.sum()) + 1)
    fans = np.diff(pointer) if len(ctx) else np.zeros(1, np.int64)
    return [save(path, name, parts), first, last, len(ctx), int(counts.sum()), int(fans[0]), int(fans[-1]), int(fans.max())]


def _segments(found: list) -> tuple[list[Segment], int]:
    """Segments in order, and the most children of a context; one may span several segments."""
    out, base, before, widest, over = [], 0, 0, 1, (-1, 0)
    for _, (uri, first, last, n, total, at_first, at_last, most) in found:
        out.append(Segment(uri, first, last, base, n, before, total))
        base, before = base + n, before + total
        if n:
            spanning = at_first + (over[1] if over[0] == first else 0)
            widest = max(widest, most, spanning)
            over = (last, spanning if first == last else at_last)
    return out, widest


def train(texts: DataFrame, text: str = "text", least: int = LEAST, segment_tokens: int = SEGMENT_TOKENS) -> Trie:
    """Builds the trie of all texts in the shared folder.

    Null texts count as empty and have an end only. What is gathered grows with the input; nothing
    is sampled. An empty table gives an empty trie, for which every word is unknown.
    """
    spark = texts.sparkSession
    path = fresh_dir(spark, "trie")
    rows = texts.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    cuts = max(1, -(-rows.count() // SEGMENT_DOCS))

    def words(segment: int, keys: np.ndarray, counts: np.ndarray) -> list:
        first = _first_hash(segment, cuts)
        parts = {"hash": EliasFano.of(keys - np.uint64(first), -(-(1 << 64) // cuts)), "count": EliasFano.of(np.r_[0, np.cumsum(counts)], int(counts.sum()) + 1)}
        return [save(path, "words", parts), first, 0, len(keys), int(counts.sum())]

    found = _counted(rows, lambda c: c.hashes[c.token], lambda keys: cut_of(keys, cuts), cuts, words)
    trie = Trie(cuts=cuts, least=least, words=[Segment("", _first_hash(k, cuts), 0, 0, 0) for k in range(cuts)])
    for k, (uri, first, _, n, total) in found:
        trie.words[k] = Segment(uri, first, 0, 0, n, trie.tokens, total)
        trie.tokens += total
    for s in trie.words:
        s.base = trie.vocabulary
        trie.vocabulary += s.n
    segments = max(1, -(-trie.tokens // segment_tokens))

    shared = spark.sparkContext.broadcast(trie)  # a line a segment
    width, total = max(1, trie.vocabulary), max(1, trie.tokens)
    if width >= 1 << 32:
        raise OverflowError("a vocabulary of over 2**32 words does not fit the keys")

    def bigrams(c: Coded) -> np.ndarray:
        ids, counts = shared.value.ids(c.hashes)
        ids = np.where(counts >= least, ids, -1)  # a rarer word has no bigram to keep
        a, b = ids[context_tokens(c)], ids[c.token]
        both = (a >= 0) & (b >= 0)
        return a[both].astype(np.uint64) * np.uint64(width) + b[both].astype(np.uint64)

    def bigram_segment(keys: np.ndarray) -> np.ndarray:
        """By the words' running counts, so that segments get about equal numbers of tokens; a frequent word spans several."""
        a, b = (keys // np.uint64(width)).astype(np.int64), keys % np.uint64(width)
        own, which = np.unique(a, return_inverse=True)
        before, count = shared.value.running(shared.value.words, own)
        place = (before[which] + count[which] * (b / width)) * (segments / total)
        return np.minimum(np.maximum.accumulate(place.astype(np.int64)), segments - 1)

    def bigram_level(segment: int, keys: np.ndarray, counts: np.ndarray) -> list:
        keep = counts >= least
        ctx, child = (keys[keep] // np.uint64(width)).astype(np.int64), (keys[keep] % np.uint64(width)).astype(np.int64)
        own, which = np.unique(ctx, return_inverse=True)
        return _level(path, "bigrams", ctx, child, counts[keep], shared.value.running(shared.value.words, own)[1][which], True)

    level, trie.fan = _segments(_counted(rows, bigrams, bigram_segment, segments, bigram_level))
    trie.levels.append(level)
    shared2 = spark.sparkContext.broadcast(trie)
    kept, kept_tokens, fan = sum(s.n for s in level), max(1, sum(s.total for s in level)), trie.fan
    if kept * fan >= 1 << 63:
        raise OverflowError("bigrams times the most children of a word do not fit the keys")

    def trigrams(c: Coded) -> np.ndarray:
        ids, counts = shared2.value.ids(c.hashes)
        place, relative, _ = bigram_places(shared2.value, np.where(counts >= least, ids, -1), c)
        both = (place[:-1] >= 0) & (place[1:] >= 0) & same_text(c)
        return place[:-1][both].astype(np.uint64) * np.uint64(fan) + relative[1:][both].astype(np.uint64)

    def trigram_segment(keys: np.ndarray) -> np.ndarray:
        """By the bigrams' running counts, likewise."""
        a, b = (keys // np.uint64(fan)).astype(np.int64), keys % np.uint64(fan)
        own, which = np.unique(a, return_inverse=True)
        before, count = shared2.value.running(shared2.value.levels[0], own)
        place = (before[which] + count[which] * (b / fan)) * (segments / kept_tokens)
        return np.minimum(np.maximum.accumulate(place.astype(np.int64)), segments - 1)

    def trigram_level(segment: int, keys: np.ndarray, counts: np.ndarray) -> list:
        keep = counts >= least
        ctx, child = (keys[keep] // np.uint64(fan)).astype(np.int64), (keys[keep] % np.uint64(fan)).astype(np.int64)
        own, which = np.unique(ctx, return_inverse=True)
        return _level(path, "trigrams", ctx, child, counts[keep], shared2.value.running(shared2.value.levels[0], own)[1][which], False)

    trie.levels.append(_segments(_counted(rows, trigrams, trigram_segment, segments, trigram_level))[0])
    dropped_at_end(spark, path)
    return trie


def same_text(c: Coded) -> np.ndarray:
    """Whether each token but the last is in the same text as its follower."""
    out = np.ones(max(0, len(c.token) - 1), bool)
    out[np.cumsum(c.number)[:-1] - 1] = False
    return out


def bigram_places(trie: Trie, ids: np.ndarray, c: Coded) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each token: the place of the bigram that ends in it (-1: none), that place relative to its context's first, and its share.

    ids: of words that are frequent enough to be in bigrams; -1 for others.
    """
    a, b = ids[context_tokens(c)], ids[c.token]
    place, relative, share = np.full(len(b), -1, np.int64), np.full(len(b), -1, np.int64), np.zeros(len(b))
    known = np.flatnonzero((a >= 0) & (b >= 0))
    if not len(known):
        return place, relative, share
    width = max(1, trie.vocabulary)
    keys, which = np.unique(a[known] * width + b[known], return_inverse=True)
    ctx = keys // width
    at = trie.find(0, ctx, keys - ctx * width)
    kept = np.flatnonzero(at >= 0)
    own, back = np.unique(ctx[kept], return_inverse=True)
    beside, p = np.full(len(keys), -1, np.int64), np.zeros(len(keys))
    beside[kept] = at[kept] - trie.contexts(0, own)[0][back]
    p[kept] = restored(trie.entry(0, at[kept]))
    place[known], relative[known], share[known] = at[which], beside[which], p[which]
    return place, relative, share


@dataclass
class Scores:
    number: np.ndarray
    known: np.ndarray
    base: np.ndarray
    score: np.ndarray


def _token_probabilities(trie: Trie, c: Coded) -> tuple[np.ndarray, np.ndarray]:
    """The training count of each distinct word of a chunk, and the model's probability of each token."""
    ids, counts = trie.ids(c.hashes)
    n, v = trie.tokens, trie.vocabulary
    unknown = DISCOUNT * v / n / (v + 1) if n else 1.0
    p = ((np.maximum(counts - DISCOUNT, 0) / n if n else 0.0) + unknown * np.ones(len(counts)))[c.token]
    if trie.levels:
        place, relative, more = bigram_places(trie, np.where(counts >= trie.least, ids, -1), c)
        own, back = np.unique(ids, return_inverse=True)
        share = np.zeros(len(own))
        share[own >= 0] = trie.contexts(0, own[own >= 0])[1]
        p = p * (1 - share)[back][context_tokens(c)] + more
        ctx = np.r_[-1, np.where(same_text(c), place[:-1], -1)]
        some = np.flatnonzero(ctx >= 0)
        if len(some) and len(trie.levels) > 1:
            own, back = np.unique(ctx[some], return_inverse=True)
            p[some] *= (1 - trie.contexts(1, own)[1])[back]
            asked = some[relative[some] >= 0]
            keys, which = np.unique(ctx[asked] * trie.fan + relative[asked], return_inverse=True)
            at = trie.find(1, keys // trie.fan, keys % trie.fan)
            hit = np.flatnonzero(at >= 0)
            more = np.zeros(len(keys))
            more[hit] = restored(trie.entry(1, at[hit]))
            p[asked] += more[which]
    return counts, np.maximum(p, 1e-300)


def token_scores(trie: Trie, texts: pa.Array) -> np.ndarray:
    """log10 probability of every token, ends included, of texts one after the other."""
    return np.log10(_token_probabilities(trie, coded(texts))[1])


def scored(trie: Trie, texts: pa.Array) -> Scores:
    """log10 probabilities of whole texts: of add-one unigrams (base) and of the model."""
    c = coded(texts)
    counts, p = _token_probabilities(trie, c)
    base = np.log10(counts + 1.0) - log10(trie.tokens + trie.vocabulary + 1)
    size, doc = len(c.number), np.repeat(np.arange(len(c.number)), c.number)
    return Scores(c.number, np.bincount(doc, (counts > 0)[c.token], size).astype(np.int64), np.bincount(doc, base[c.token], size), np.bincount(doc, np.log10(p), size))


_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def score(docs: DataFrame, trie: Trie, key: str = "doc_id", text: str = "text", held_out: str = "held_out") -> DataFrame:
    """Scores of every whole text: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null and empty texts are one end. Very long texts are read whole. Repeated rows score alike;
    further columns are not read; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trie)  # a line a segment

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for part in chunks(batch, "text"):
                s = scored(own, part.column(2))
                yield batch_of(_OUT, part.column(0), part.column(1), s.number, s.known, np.full(part.num_rows, own.tokens), s.base, s.score)

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(held_out).alias("held_out"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op4_elias_fano_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").withColumn("held_out", crc_fold("doc_id", 7) == 2)
    return score(docs, train(docs.where("NOT held_out")))
