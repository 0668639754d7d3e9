"""Operator 6: language identification by a bidirectional gated recurrent network over bytes.

The network reads a window of bytes forwards and backwards and gives every position a probability
for each language. Windows are the words of a text, A-Z lower-cased (longer ones in pieces of
WINDOW bytes), so equal windows give equal outputs: each distinct one is run once and counted as
often as it stands in a document. A document's probabilities are the mean over all its positions.
Training is backpropagation through time in numpy, on the driver, over a bounded sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_words, batch_of, carried, chunks, crc_fold, read_table

#: Bytes of a window, units in each direction, bounds of the training sample.
WINDOW, UNITS, SAMPLE_DOCS, SAMPLE_WORDS = 24, 16, 3000, 60
STEPS, BATCH, RATE, SEED = 500, 384, 0.01, 11
UNKNOWN = "und"
#: Distinct words whose outputs a worker keeps, and text bytes that it handles at a time.
_CACHE, PART_BYTES = 100_000, 1 << 20


def windows(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte matrix (padded with 256), lengths, and the word of each window."""
    pieces, owner = [], []
    for k, w in enumerate(words):
        for at in range(0, len(w), WINDOW):
            pieces.append(w[at : at + WINDOW])
            owner.append(k)
    length = np.fromiter(map(len, pieces), np.int64, len(pieces))
    out = np.full((len(pieces), max(WINDOW if not len(length) else length.max(), 1)), 256, np.int16)
    at = np.arange(out.shape[1])[None, :] < length[:, None]
    out[at] = np.frombuffer(b"".join(pieces), np.uint8)
    return out, length, np.array(owner, np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class ByteBiGRU:
    """Gated recurrent units in both directions; a softmax over languages at every position."""

    def __init__(self, languages: list[str], units: int = UNITS, seed: int = SEED):
        rng, n = np.random.default_rng(seed), len(languages)
        self.languages, self.units = languages, units
        self.p = {}
        for d in "fb":
            self.p[f"x{d}"] = rng.normal(0, 0.3, (257, 3 * units)).astype(np.float32)  # input weights and biases, by byte
            self.p[f"u{d}"] = rng.normal(0, units**-0.5, (units, 3 * units)).astype(np.float32)
            self.p[f"o{d}"] = rng.normal(0, 0.1, (units, n)).astype(np.float32)
        self.p["bias"] = np.zeros(n, np.float32)

    def _run(self, d: str, ids: np.ndarray, keep: bool):
        """States after each byte, in the order of reading; keep: also what the gradient needs."""
        h, k = np.zeros((len(ids), self.units), np.float32), self.units
        states, trail = [], []
        for t in range(ids.shape[1]):
            x, u = self.p[f"x{d}"][ids[:, t]], h @ self.p[f"u{d}"]
            gates = _sigmoid(x[:, : 2 * k] + u[:, : 2 * k])
            z, r = gates[:, :k], gates[:, k:]
            new = np.tanh(x[:, 2 * k :] + r * u[:, 2 * k :])
            if keep:
                trail.append((h, z, r, new, u[:, 2 * k :]))
            h = new + z * (h - new)
            states.append(h)
        return states, trail

    @staticmethod
    def _backwards(ids: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each window read from its last byte, and where the forward position is in that order."""
        at = length[:, None] - 1 - np.arange(ids.shape[1])[None, :]
        inside = at >= 0
        return np.where(inside, np.take_along_axis(ids, np.maximum(at, 0), 1), 256), np.where(inside, at, np.arange(ids.shape[1])[None, :])

    def positions(self, ids: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Probabilities of each language at each position; 0 beyond a window's end."""
        back, at = self._backwards(ids, length)
        forth = np.stack(self._run("f", ids, False)[0], 1) @ self.p["of"]
        other = np.take_along_axis(np.stack(self._run("b", back, False)[0], 1) @ self.p["ob"], at[:, :, None], 1)
        return self._softmax(forth + other + self.p["bias"]) * (np.arange(ids.shape[1])[None, :, None] < length[:, None, None])

    @staticmethod
    def _softmax(logits: np.ndarray) -> np.ndarray:
        e = np.exp(logits - logits.max(-1, keepdims=True))
        return e / e.sum(-1, keepdims=True)

    def gradient(self, ids: np.ndarray, length: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over positions and its gradient, through time in both directions."""
        k, (b, t) = self.units, ids.shape
        back, at = self._backwards(ids, length)
        runs = {"f": (ids, *self._run("f", ids, True)), "b": (back, *self._run("b", back, True))}
        h = {d: np.stack(runs[d][1], 1) for d in "fb"}
        hb = np.take_along_axis(h["b"], at[:, :, None], 1)
        p = self._softmax(h["f"] @ self.p["of"] + hb @ self.p["ob"] + self.p["bias"])
        mask = (np.arange(t)[None, :] < length[:, None]).astype(np.float32)
        total = mask.sum()
        loss = -float((np.log(p[np.arange(b)[:, None], np.arange(t)[None, :], y[:, None]] + 1e-9) * mask).sum() / total)
        p[np.arange(b)[:, None], np.arange(t)[None, :], y[:, None]] -= 1
        d_logit = p * (mask / total)[:, :, None]
        g = {"bias": d_logit.sum((0, 1)), "of": np.einsum("bth,btn->hn", h["f"], d_logit), "ob": np.einsum("bth,btn->hn", hb, d_logit)}
        d_state = {"f": d_logit @ self.p["of"].T, "b": np.zeros_like(hb)}
        np.put_along_axis(d_state["b"], at[:, :, None], d_logit @ self.p["ob"].T, 1)
        for d in "fb":
            seen, _, trail = runs[d]
            gu, gx, dh = np.zeros_like(self.p[f"u{d}"]), np.zeros_like(self.p[f"x{d}"]), np.zeros((b, k), np.float32)
            for s in range(t - 1, -1, -1):
                before, z, r, new, un = trail[s]
                dh = dh + d_state[d][:, s]
                d_new = dh * (1 - z) * (1 - new * new)
                dx = np.concatenate([dh * (before - new) * z * (1 - z), d_new * un * r * (1 - r), d_new], 1)
                du = np.concatenate([dx[:, : 2 * k], d_new * r], 1)
                np.add.at(gx, seen[:, s], dx)
                gu += before.T @ du
                dh = dh * z + du @ self.p[f"u{d}"].T
            g[f"u{d}"], g[f"x{d}"] = gu, gx
        return loss, g

    def fit(self, ids: np.ndarray, length: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = SEED) -> list[float]:
        """Adam over batches drawn by weight; the losses."""
        rng, losses = np.random.default_rng(seed), []
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(v) for k, v in self.p.items()}
        chance = weight / weight.sum()
        for step in range(1, steps + 1):
            pick = rng.choice(len(y), batch, p=chance)
            widest = int(length[pick].max())
            loss, g = self.gradient(ids[pick, :widest], length[pick], y[pick])
            losses.append(loss)
            now = rate * min(1, 2 * (1 - step / (steps + 1)))
            for k, x in g.items():
                np.clip(x, -1, 1, out=x)
                m[k] += 0.1 * (x - m[k])
                v[k] += 0.01 * (x * x - v[k])
                self.p[k] -= now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
        return losses

    def pooled(self, words: list[bytes]) -> np.ndarray:
        """For each word the sums over its positions: each language's probability, then the positions."""
        out = np.zeros((len(words), len(self.languages) + 1))
        ids, length, owner = windows(words)
        order = np.argsort(length, kind="stable")
        for at in range(0, len(order), 2048):  # windows of like length together
            rows = order[at : at + 2048]
            p = self.positions(ids[rows, : int(length[rows].max())], length[rows])
            np.add.at(out, owner[rows], np.concatenate([p.sum(1), length[rows, None]], 1))
        return out


def label_positions(model: ByteBiGRU, text: str) -> list[tuple[int, int, str]]:
    """Runs of bytes (start, stop, language) with one label, over the words of a text; bytes count in UTF-8."""
    data, out, at = text.encode(), [], 0
    for word in data.split():
        at = data.index(word, at)
        ids, length, _ = windows([word.lower()])
        p = model.positions(ids, length)
        for label in np.concatenate([x[:n] for x, n in zip(p.argmax(2), length, strict=True)]):
            name = model.languages[label]
            if out and out[-1][1] == at and out[-1][2] == name:
                out[-1] = (out[-1][0], at + 1, name)
            else:
                out.append((at, at + 1, name))
            at += 1
    return out


_WORDS = pa.schema([("lang", pa.string()), ("word", pa.binary())])


def train(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE_DOCS, words: int = SAMPLE_WORDS) -> ByteBiGRU | None:
    """Fits the network on about `sample` labelled rows at most, of each at most `words` words.

    A long text's words are those at places drawn from the whole text by its id. Rows without text or language teach nothing; None if there are none.
    """
    import xxhash

    known = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    rate = min(1.0, sample / max(1, known.select(lang).count()))
    some = known.where(F.pmod(F.xxhash64(F.col(key), F.lit(23)), F.lit(1 << 20)) < int(rate * (1 << 20))).limit(2 * sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                count, flat = ascii_words(part.column(1), lower=True)
                at = np.cumsum(count) - count
                langs, picked = [], []
                for name, seed, a, n in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), at, count, strict=True):
                    drawn = np.arange(n) if n <= words else np.random.default_rng(xxhash.xxh64_intdigest(seed, 5)).choice(n, words, replace=False)
                    own = flat.take(pa.array(a + drawn)).to_pylist()
                    picked += [w.encode() for w in own]
                    langs += [name] * len(own)
                yield batch_of(_WORDS, langs, picked)

    pairs = some.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key")).mapInArrow(run, "lang string, word binary").groupBy("lang", "word").count().collect()
    if not pairs:
        return None
    pairs.sort(key=lambda r: (r["lang"], bytes(r["word"])))
    languages = sorted({r["lang"] for r in pairs})
    ids, length, owner = windows([bytes(r["word"]) for r in pairs])
    y = np.array([languages.index(r["lang"]) for r in pairs])[owner]
    weight = np.array([r["count"] for r in pairs], float)[owner] * length
    # languages weigh as the square root of their share, so that rare ones are learned too
    weight *= np.array([1 / np.sqrt(max(weight[y == k].sum(), 1)) for k in range(len(languages))])[y]
    model = ByteBiGRU(languages)
    model.fit(ids, length, y, weight)
    return model


def identify(docs: DataFrame, model: ByteBiGRU | None, text: str = "text", keep: list[str] | None = None, prediction: str = "lang_pred", score: str = "score") -> DataFrame:
    """The columns `keep` of docs (all, if None) with the predicted language and its pooled probability.

    `und` with score 0 if the text is null, empty or has no letters, or if nothing was learned. Very
    long texts are read whole, word by word; ties go to the language that sorts first. Repeated rows
    fare alike; earlier columns of the result's names are replaced. An empty table gives no rows.
    """
    import regex

    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in (prediction.lower(), score.lower())]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand weights
    letter = regex.compile(r"\p{L}")
    taken, where, others = carried(docs, text, kept)
    schema = taken.select(*(f"c{k}" for k in others)).schema.add("lang", "string").add("score", "double")

    def rows(net: ByteBiGRU, words: list[str]) -> np.ndarray:
        return np.column_stack([net.pooled([w.encode() for w in words]), [bool(letter.search(w)) for w in words]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        cache: dict[str, int] = {}
        known = np.zeros((0, len(net.languages) + 2 if net else 0))
        for batch in batches:
            for part in chunks(batch, where, PART_BYTES):
                names, scores = [UNKNOWN] * part.num_rows, np.zeros(part.num_rows)
                count, flat = ascii_words(part.column(where), lower=True)
                if net and len(flat):
                    coded = flat.dictionary_encode()
                    words = coded.dictionary.to_pylist()
                    if len(cache) + len(words) > _CACHE:
                        cache, known = {}, known[:0]
                    if new := [w for w in words if w not in cache]:
                        cache.update(zip(new, range(len(cache), len(cache) + len(new)), strict=True))
                        known = np.concatenate([known, rows(net, new)])
                    index = np.fromiter((cache[w] for w in words), np.int64, len(words))[coded.indices.to_numpy()]
                    doc = np.repeat(np.arange(part.num_rows), count)
                    sums = np.stack([np.bincount(doc, known[index, k], part.num_rows) for k in range(known.shape[1])], 1)
                    best = sums[:, :-2].argmax(1)
                    for k in np.flatnonzero(sums[:, -1]):
                        names[k], scores[k] = net.languages[best[k]], min(1.0, sums[k, best[k]] / sums[k, -2])
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in others), pa.array(names, pa.string()), pa.array(scores)], names=schema.names)

    return taken.mapInArrow(run, schema).toDF(*kept, prediction, score)


def op6_byte_bigru(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").withColumn("held_out", crc_fold("doc_id", 3) == 1)
    model = train(docs.where("NOT held_out"))
    return identify(docs, model, keep=["doc_id", "held_out"])
