"""Operator 5: toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding decomposes, lower-cases, replaces homoglyphs and digit substitutions by the letters they stand
for, removes accents and invisible characters and turns all else that is no letter into spaces. An
exclamation mark between letters is read both as an i and as a space. The lexicon holds word beginnings;
each weighs the logarithm of its rate in toxic over its rate in other text. Exception phrases are a match
with the word before or behind it that other texts hold at least as often as toxic ones; a match
inside one does not count. The matches' sum, number and largest weight, the
length and the sum by length give the score through a logistic curve. Weights and curve are learned from a bounded sample of
labelled rows.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_of, carried, chunks, crc_fold, read_table

#: Bounds of the training sample, by label, and on what may become a lexicon entry.
SAMPLE_TOXIC, SAMPLE_OTHER = 2500, 5000
SHORTEST, LONGEST, LEAST_DOCS, LEAST_SHARE, LEAST_WEIGHT, MOST_ENTRIES = 3, 14, 4, 0.004, 1.5, 5000
THRESHOLD = 0.7

#: Letters of other scripts that look like Latin ones, and the signs that are written for letters.
HOMOGLYPHS = {"а": "a", "в": "b", "с": "c", "е": "e", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ł": "l", "ɑ": "a", "ɡ": "g"}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s"}
#: Documents of other text that an exception phrase stands in at least.
LEAST_SPARED = 4


class _Fold(dict):
    """A table for str.translate that fills itself: what each character folds to."""

    def __missing__(self, code: int) -> str:
        shown = unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", chr(code)).lower())
        out = "".join(HOMOGLYPHS.get(c, DIGITS.get(c, c)) for c in shown if unicodedata.category(c) not in ("Cf", "Mn"))
        if shown and not out.isalpha() and out:
            out = " "
        self[code] = out
        return out


_FOLD = _Fold({ord("!"): "!"})
_MARK = re.compile(r"(?<=[^\W_])!(?=[^\W_])")


def readings(text: str) -> tuple[str, str]:
    """The text folded, between spaces: with exclamation marks as spaces, and with those between letters as an i."""
    folded = " " + text.translate(_FOLD) + " "
    if "!" not in folded:
        return folded, folded
    return folded.replace("!", " "), _MARK.sub("i", folded).replace("!", " ")


def fold(text: str) -> str:
    """The text folded, between spaces; exclamation marks between letters are read as an i."""
    return readings(text)[1]


@dataclass
class Lexicon:
    """Weights of word beginnings, exception phrases, and the curve from features to a score."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    curve: np.ndarray = field(default_factory=lambda: np.array([-4.0, 0, 0, 0, 0, 0, 0]))
    _automaton: object = None

    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            for entry, w in self.weights.items():
                self._automaton.add_word(" " + entry, (len(entry) + 1, w))
            for phrase in self.exceptions:  # an exception has no weight
                self._automaton.add_word(folded := fold(phrase), (len(folded), None))
            self._automaton.make_automaton()
        return self._automaton

    def spans(self, folded: str) -> list[tuple[int, int, float]]:
        """Matches (start, stop, weight) in a folded text that no exception phrase covers."""
        if not self.weights:
            return []
        found = [(end + 1 - n, end + 1, w) for end, (n, w) in self.automaton().iter(folded)]
        starts, reach = [], []  # of exception phrases in order of their starts, how far those so far reach
        for a, b in sorted((a, b) for a, b, w in found if w is None):
            starts.append(a)
            reach.append(max(b, reach[-1] if reach else b))
        return [(a, b, w) for a, b, w in found if w is not None and not ((k := bisect_right(starts, a)) and reach[k - 1] >= b)]

    def features(self, text: str) -> tuple[float, int, float, int]:
        """Sum of weights, matches, largest weight, and words of the folded text."""
        plain, joined = readings(text)
        spans = self.spans(plain)
        if joined != plain:  # the readings have the same places
            spans = list({*spans, *self.spans(joined)})
        found = [w for *_, w in spans]
        return sum(found), len(found), max(found, default=0.0), len(plain.split())

    @staticmethod
    def design(features: np.ndarray) -> np.ndarray:
        """Inputs of the curve: sums and matches as they are and by length."""
        total, hits, peak, words = np.asarray(features, float).reshape(-1, 4).T
        dense = 100 * total / (words + 50)
        return np.column_stack([np.ones(len(total)), np.log1p(total), np.log1p(dense), np.log1p(words), dense / 10, np.log1p(hits), peak / 3])

    def scores(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.design(features) @ self.curve, -40, 40)))


def _logistic(x: np.ndarray, y: np.ndarray, weigh: np.ndarray, ridge: float = 0.05, rounds: int = 60) -> np.ndarray:
    """Newton's method with a ridge, on weighted rows."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (weigh * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (weigh * (p - y)) + ridge * w)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


_COUNT = pa.schema([("entry", pa.string()), ("toxic", pa.int32()), ("docs", pa.int64()), ("hits", pa.int64())])
_FEATURE = pa.schema([("toxic", pa.int32()), ("total", pa.float64()), ("hits", pa.int64()), ("peak", pa.float64()), ("words", pa.int64())])


def _counted(some: DataFrame, allowed=None) -> DataFrame:
    """(entry, toxic, docs, hits) of word beginnings; with `allowed`, of those only. '' counts documents and words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = allowed.value if allowed is not None else None
        docs, hits = Counter(), Counter()
        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = Counter(fold(text.as_py() or "").split())
                own: Counter = Counter()
                for word, n in words.items():
                    for k in range(SHORTEST, min(LONGEST, len(word)) + 1):
                        if only is None or word[:k] in only:
                            own[word[:k]] += n
                own[""] = sum(words.values())
                for entry, n in own.items():
                    docs[entry, toxic] += 1
                    hits[entry, toxic] += n
        keys = list(docs)
        for at in range(0, len(keys), 50_000):
            part = keys[at : at + 50_000]
            yield batch_of(_COUNT, [k[0] for k in part], [k[1] for k in part], [docs[k] for k in part], [hits[k] for k in part])

    return some.mapInArrow(run, "entry string, toxic int, docs long, hits long").groupBy("entry", "toxic").agg(F.sum("docs").alias("docs"), F.sum("hits").alias("hits"))


def choose(counts: dict[tuple[str, int], tuple[int, int]]) -> dict[str, float]:
    """Lexicon entries with weights from (entry, toxic) -> (docs, hits).

    An entry's odds must stand out by more than the largest of as many chance ones would: sqrt(2 ln n)
    standard errors. The most telling entry is taken first; entries that begin with it, or that it begins with,
    are then left out, so no word counts twice.
    """
    (p_docs, p_words), (n_docs, n_words) = counts.get(("", 1), (0, 0)), counts.get(("", 0), (0, 0))
    ranked = []
    entries = {e for e, _ in counts if e}
    least = max(3.0, np.sqrt(2 * np.log(max(1, len(entries)))))
    for entry in entries:
        (p, ph), (n, nh) = counts.get((entry, 1), (0, 0)), counts.get((entry, 0), (0, 0))
        weight = np.log((ph + 0.1) / (p_words + 1)) - np.log((nh + 0.5) / (n_words + 1))
        odds = np.log((p + 0.5) / (p_docs + 1)) - np.log((n + 0.5) / (n_docs + 1))
        z = odds / np.sqrt(1 / (p + 0.5) + 1 / (n + 0.5))
        if weight >= LEAST_WEIGHT and z >= least:
            ranked.append((-z * odds, -len(entry), entry, float(weight)))
    chosen: dict[str, float] = {}
    closed: set[str] = set()
    for *_, entry, weight in sorted(ranked):
        heads = [entry[:k] for k in range(SHORTEST, len(entry) + 1)]
        if entry not in closed and not any(h in chosen for h in heads):
            chosen[entry] = weight
            closed.update(heads)
            if len(chosen) == MOST_ENTRIES:
                break
    return chosen


_PHRASE = pa.schema([("phrase", pa.string()), ("toxic", pa.int32()), ("docs", pa.int64())])


def _word_before(folded: str, at: int) -> str:
    """The last word before a place, its last 40 characters if longer; the text is not copied, so many matches in a very long one cost no more each."""
    end = at
    while end and folded[end - 1].isspace():
        end -= 1
    return folded[max(0, end - 40) : end].split(" ")[-1]


def _phrases(some: DataFrame, shared) -> dict[tuple[str, int], int]:
    """(phrase, toxic) -> documents, of matched words with the word before or behind them; '' counts documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                folded, own = fold(text.as_py() or ""), {""}
                for a, _, _ in shared.value.spans(folded):
                    stop = folded.index(" ", a + 1)
                    word, before, behind = folded[a + 1 : stop], _word_before(folded, a), folded[stop : stop + 40].split(maxsplit=1)
                    own.update([f"{before} {word}"] if before else [], [f"{word} {behind[0]}"] if behind else [])
                counts.update((phrase, toxic) for phrase in own)
        yield batch_of(_PHRASE, [k[0] for k in counts], [k[1] for k in counts], list(counts.values()))

    rows = some.mapInArrow(run, "phrase string, toxic int, docs long").groupBy("phrase", "toxic").agg(F.sum("docs").alias("docs")).collect()  # of the bounded sample
    return {(r["phrase"], r["toxic"]): r["docs"] for r in rows}


def spared(counts: dict[tuple[str, int], int]) -> tuple[str, ...]:
    """Phrases that stand in LEAST_SPARED other documents or more, and in no smaller share of them than of toxic ones."""
    toxic, other = max(1, counts.get(("", 1), 0)), max(1, counts.get(("", 0), 0))
    return tuple(sorted(p for (p, label), n in counts.items() if p and label == 0 and n >= LEAST_SPARED and n * toxic >= counts.get((p, 1), 0) * other))


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Lexicon:
    """Learns from about SAMPLE_TOXIC and SAMPLE_OTHER labelled rows at most, drawn by a hash of the id.

    Weights and exception phrases are counted in that sample. Null labels teach nothing. Without rows of both labels the lexicon is empty and scores are low.
    """
    spark = docs.sparkSession
    marked = labels.select(F.col(key).alias("_id"), F.col(label).cast("int").alias("toxic")).where("_id IS NOT NULL AND toxic IN (0, 1)")
    there = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(there) < 2:
        return Lexicon()
    rate = {k: min(1.0, most / there[k]) for k, most in ((1, SAMPLE_TOXIC), (0, SAMPLE_OTHER))}
    draw = F.pmod(F.xxhash64("_id", F.lit(31)), F.lit(1 << 20)) < F.when(F.col("toxic") == 1, int(rate[1] * (1 << 20))).otherwise(int(rate[0] * (1 << 20)))
    drawn = F.broadcast(marked.where(draw).limit(2 * (SAMPLE_TOXIC + SAMPLE_OTHER)))
    some = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text")).join(drawn, "_id").select("toxic", "_text")
    toxic = {r["entry"]: r["docs"] for r in _counted(some.where("toxic = 1")).where(F.col("docs") >= max(LEAST_DOCS, int(LEAST_SHARE * min(there[1], SAMPLE_TOXIC)))).collect()}
    counts = {(r["entry"], r["toxic"]): (r["docs"], r["hits"]) for r in _counted(some, spark.sparkContext.broadcast(frozenset(toxic))).collect()}
    weights = choose(counts)
    lexicon = Lexicon(weights, spared(_phrases(some, spark.sparkContext.broadcast(Lexicon(weights)))))
    shared = spark.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.features(t.as_py() or "") for t in batch.column(1)]
            yield batch_of(_FEATURE, batch.column(0), *([f[k] for f in found] for k in range(4)))

    rows = some.mapInArrow(run, "toxic int, total double, hits long, peak double, words long").toPandas()  # the bounded sample's numbers
    toxic = rows["toxic"].to_numpy().astype(float)
    weigh = np.where(toxic == 1, 1 / rate[1], 1 / rate[0])  # the labels are drawn at different rates; the curve is fitted at their true share
    lexicon.curve = _logistic(lexicon.design(rows[["total", "hits", "peak", "words"]].to_numpy()), toxic, weigh / (weigh.mean() if len(weigh) else 1))
    return lexicon


def rate_toxicity(docs: DataFrame, lexicon: Lexicon, text: str = "text", keep: list[str] | None = None, score: str = "score") -> DataFrame:
    """The columns `keep` of docs (all, if None) with the score, 0 to 1, higher for toxic.

    Null and empty texts score as texts without a match do. Texts are read whole, however long.
    Repeated rows score alike; an earlier column of the result's name is replaced. An empty table
    gives no rows.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() != score.lower()]
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)  # at most MOST_ENTRIES entries
    taken, where, others = carried(docs, text, kept)
    schema = taken.select(*(f"c{k}" for k in others)).schema.add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for part in chunks(batch, where):
                found = np.array([own.features(t.as_py() or "") for t in part.column(where)], float).reshape(-1, 4)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in others), pa.array(own.scores(found))], names=schema.names)

    return taken.mapInArrow(run, schema).toDF(*kept, score)


def op5_folded_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", (crc_fold("doc_id", 3) == 1).alias("held_out"))
    lexicon = learn(docs.where("NOT held_out"), read_table(spark, sf_dir, "labels").where(crc_fold("doc_id", 3) != 1))
    rated = rate_toxicity(docs, lexicon, keep=["doc_id", "held_out"])
    return rated.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
