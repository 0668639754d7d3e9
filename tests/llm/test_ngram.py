import math
import os
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cloudgauge.llm import eliasfano, ngram
from cloudgauge.llm.common import ascii_words, fresh_dir
from cloudgauge.llm.eliasfano import EliasFano, load, save
from tests.llm.tools import documents

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=80), st.integers(1, 64), st.lists(st.integers(0, 2**64 - 1), max_size=20))
def test_elias_fano(values, bits, more):
    values = np.sort(np.array([v >> 64 - bits for v in values], np.uint64))
    asked = np.r_[values, np.array([v >> 64 - bits for v in more], np.uint64)].astype(np.uint64)
    e = EliasFano.of(values, 1 << bits)
    assert np.array_equal(e.access(np.arange(len(values))), values)
    assert np.array_equal(e.successor(asked), np.searchsorted(values, asked))
    assert np.array_equal(e.find(asked) >= 0, np.isin(asked, values))


def test_word_hashes():
    words = ["a", "a\0", "ab", "é", "x" * 23, "x" * 24, "x" * 25, "x" * 26, "y" * 90, *(f"w{k}" for k in range(5000))]
    hashes = ngram.word_hashes(pa.array(words))
    assert len(set(hashes.tolist())) == len(words) and 0 not in hashes
    assert np.array_equal(ngram.word_hashes(pa.array(words).slice(3)), hashes[3:]) and len(ngram.word_hashes(pa.array([], pa.string()))) == 0


def test_words():
    texts = pa.array([" a b ", None, "", "\x0b", "C\u00a0d\x1ce", "x"]).slice(0)
    count, flat = ascii_words(texts, lower=True)
    assert count.tolist() == [2, 0, 0, 0, 1, 1] and flat.to_pylist() == ["a", "b", "c\u00a0d\x1ce", "x"]
    count, flat = ascii_words(texts.slice(4), lower=True)
    assert count.tolist() == [1, 1] and flat.to_pylist() == ["c\u00a0d\x1ce", "x"]
    assert ascii_words(pa.array([], pa.string()))[0].tolist() == []


def test_files(spark):
    e = EliasFano.of(np.arange(0, 999, 3), 1000)
    parts, facts = load(save(fresh_dir(spark, "t"), "x", {"e": e, "q": np.arange(3, dtype=np.uint16)}, {"a": 1}))
    assert facts == {"a": 1} and parts["q"].tolist() == [0, 1, 2] and parts["e"].find(np.array([5, 6])).tolist() == [-1, 2]


def test_fetched_files_go(tmp_path, monkeypatch):
    monkeypatch.setattr(eliasfano, "FETCHED_BYTES", 250)
    for k in range(5):
        (tmp_path / f"{k}.ef").write_bytes(b"x" * 100)
        os.utime(tmp_path / f"{k}.ef", (k, k))
    (tmp_path / "other").write_bytes(b"x" * 1000)
    eliasfano._evict(str(tmp_path), "0.ef")
    assert sorted(p.name for p in tmp_path.iterdir()) == ["0.ef", "4.ef", "other"]


def model(texts):
    """Probabilities by dictionaries, from the same formulas."""
    d, c = ngram.DISCOUNT, [Counter(), Counter(), Counter()]
    for t in texts:
        w = [b"\0", *WORD.findall(t.encode().lower()), b"\0"]
        c[0].update(w[1:])
        c[1].update(zip(w, w[1:], strict=False))
        c[2].update(zip(w, w[1:], w[2:], strict=False))
    n, v = sum(c[0].values()), len(c[0])
    c[1:] = [Counter({k: x for k, x in y.items() if x >= 2}) for y in c[1:]]
    share = [Counter(), Counter()]
    for (a, b), x in c[1].items():
        share[0][a] += (x - d) / c[0][a]
    for (a, b, e), x in c[2].items():
        share[1][a, b] += (x - d) / c[1][a, b]

    def logs(text):
        w, base, score, known = [b"\0", *WORD.findall((text or "").encode().lower()), b"\0"], 0.0, 0.0, 0
        for i in range(1, len(w)):
            x, a = c[0][w[i]], w[i - 1]
            known += x > 0
            base += math.log10((x + 1) / (n + v + 1))
            p = (max(x - d, 0) / n if n else 0) + (d * v / n / (v + 1) if n else 1)
            p = p * (1 - share[0][a]) + (max(c[1][a, w[i]] - d, 0) / c[0][a] if c[0][a] else 0)
            if i > 1 and c[1][w[i - 2], a]:
                q = (w[i - 2], a)
                p = p * (1 - share[1][q]) + max(c[2][(*q, w[i])] - d, 0) / c[1][q]
            score += math.log10(p)
        return len(w) - 1, known, n, base, score

    return logs


@pytest.mark.parametrize("segment", [40, 10**6])
def test_against_dictionaries(spark, segment):
    """Also with segments so small that frequent words span several."""
    rng = np.random.default_rng(segment)
    words = ["the", "The", "a", "é", "x\x1fy", *(f"w{k}" for k in range(30))]
    texts = [" ".join(rng.choice(words, rng.integers(0, 60), p=np.r_[[0.3, 0.05, 0.1], np.full(32, 0.55 / 32)])) for _ in range(80)] + ["", None, "the " * 500]
    docs = documents(spark, [(k, t) for k, t in enumerate(texts)])
    trie = ngram.train(docs.where("doc_id % 4 <> 1"), segment_tokens=segment)
    logs = model([t or "" for k, t in enumerate(texts) if k % 4 != 1])
    if segment == 40:
        assert len(trie.levels[0]) > 10 and any(a.last == b.first for a, b in zip(trie.levels[0], trie.levels[0][1:], strict=False))
        spans = Counter()
        for s in trie.levels[0]:
            pointers = trie.opened(s)["pointer"].access(np.arange(s.last - s.first + 2)).astype(int)
            spans.update({s.first + k: int(n) for k, n in enumerate(np.diff(pointers))})
        assert trie.fan == max(spans.values())
    for r in ngram.score(docs.selectExpr("*", "doc_id % 4 = 1 AS held_out"), trie).collect():
        want = logs(texts[r["doc_id"]])
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == want[:3]
        assert r["base_score"] == pytest.approx(want[3], abs=1e-6) and r["score"] == pytest.approx(want[4], abs=2e-3 * want[0])


def test_probabilities_sum_to_one(spark):
    """Over all words, the end and one unknown word, after each context; the model before quantisation."""
    texts = ["a b a c", "a b b", "c a b a"] * 3
    logs = model(texts)
    trie = ngram.train(documents(spark, list(enumerate(texts))))
    for context in ("", "a", "a b", "zz"):
        total = 0.0
        for word in ("a", "b", "c", "unseen"):
            total += 10 ** (tokens(trie, f"{context} {word}")[-2])
        total += 10 ** tokens(trie, context)[-1]
        assert total == pytest.approx(1, abs=2e-3), context
    assert logs("a b")[4] == pytest.approx(sum(tokens(trie, "a b")), abs=1e-3)


def tokens(trie, text):
    return ngram.token_scores(trie, pa.array([text]))


def test_empty(spark):
    trie = ngram.train(documents(spark, []))
    out = ngram.score(documents(spark, [(1, "a b"), (2, None)]).selectExpr("*", "true AS held_out"), trie).collect()
    assert [(r["n_tokens"], r["n_known"], r["base_score"], r["score"]) for r in out] == [(3, 0, 0.0, 0.0), (1, 0, 0.0, 0.0)]
