import time

import duckdb
import numpy as np
import pytest

from cloudgauge.llm import toxicity
from cloudgauge.llm.toxicity import Lexicon, fold
from tests.llm.tools import documents


def test_folding():
    assert fold("1D10T").split() == ["idiot"] and fold("іdіоt") == " idiot " and fold("ｉｄｉｏｔ") == " idiot "
    assert fold("idíot") == fold("idi\u0301ot") == " idiot " and fold("ＩＤÍＯＴ!") == " idiot  "
    assert toxicity.readings("Hello!world id!ot oh!") == (" hello world id ot oh  ", " helloiworld idiot oh  ")
    assert fold("i\u200bdíot").split() == ["idiot"] and fold("a-b_c###") == " a b c    " and fold("réeux") == " reeux "


def test_spans_and_exceptions():
    own = Lexicon({"trash": 2.0, "stupid": 3.0}, ("trash can", "not stupid"))
    words = lambda text: [fold(text)[a:b].strip() for a, b, _ in own.spans(fold(text))]
    assert words("Trash! the tr@shy trash can, outtrash stupid not 5tupid") == ["trash", "trash", "stupid"]
    assert own.features("trash trash") == (4.0, 2, 2.0, 2) and own.features("") == (0, 0, 0.0, 0) and Lexicon().features("trash") == (0, 0, 0.0, 1)


def plain_spans(lexicon, folded):
    """Every place of every entry and phrase, by looking there."""
    spans = [(a, a + len(e) + 1, w) for e, w in lexicon.weights.items() for a in range(len(folded)) if folded.startswith(" " + e, a)]
    kept = [(a, a + len(fold(p))) for p in lexicon.exceptions for a in range(len(folded)) if folded.startswith(fold(p), a)]
    return sorted(s for s in spans if not any(x <= s[0] and s[1] <= y for x, y in kept))


def test_against_a_plain_search():
    rng = np.random.default_rng(7)
    words = ["ab", "abc", "abcd", "bc", "b", "ca", "c", "d"]
    for _ in range(200):
        lexicon = Lexicon({str(w): float(k) for k, w in enumerate(rng.choice(words, 3, replace=False), 1)}, tuple({" ".join(rng.choice(words, rng.integers(1, 4))) for _ in range(3)}))
        folded = fold(" ".join(rng.choice(words, 40)))
        assert sorted(lexicon.spans(folded)) == plain_spans(lexicon, folded)
        text = " ".join(rng.choice(words, 20))
        assert lexicon.features(text)[:2] == (sum(w for *_, w in plain_spans(lexicon, fold(text))), len(plain_spans(lexicon, fold(text))))


def test_many_exceptions_are_quick():
    own = Lexicon({"trash": 2.0}, ("trash can",))
    began = time.perf_counter()
    assert own.features("trash can " * 100_000 + "trash")[1] == 1
    assert time.perf_counter() - began < 5


def test_exceptions_are_learned(spark):
    rng = np.random.default_rng(9)
    rows, labels = corpus(rng, 600)
    rows = [(k, t + (" grumpf soup" if k % 10 == 1 else "")) for k, t in rows]  # harmless
    lexicon = toxicity.learn(documents(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert "grumpf soup" in lexicon.exceptions and any("grumpf".startswith(e) for e in lexicon.weights)
    assert lexicon.features("some grumpf soup")[1] == 0 and lexicon.features("some grumpf")[1] == 1


def test_no_word_counts_twice():
    counts = {("", 1): (100, 10_000), ("", 0): (1000, 100_000)} | {(h, 1): (60, 80) for h in ("idi", "idio", "idiot")} | {("the", 1): (100, 900), ("the", 0): (1000, 9000)}
    assert list(toxicity.choose(counts)) == ["idiot"]


def scored(spark, rows, lexicon):
    return {r["doc_id"]: r["score"] for r in toxicity.rate_toxicity(documents(spark, rows), lexicon).collect()}


def corpus(rng, n):
    words = [f"w{chr(97 + a)}{chr(97 + b)}x" for a in range(20) for b in range(5)]
    rows, labels = [], []
    for k in range(n):
        text = list(rng.choice(words, rng.integers(10, 120)))
        bad = k % 5 == 0
        if bad:
            for _ in range(2 + len(text) // 50):
                text[rng.integers(len(text))] = rng.choice(["grumpf", "GRUMPF!", "gru​mpf", "zonk###"])
        rows.append((k, " ".join(text)))
        labels.append((k, int(bad)))
    return rows, labels


def test_learns_and_scores(spark):
    rows, labels = corpus(np.random.default_rng(0), 400)
    extra = [(1000, None), (1001, ""), (1002, "grumpf zonk"), (1003, "waax " * 30_000), (1004, "waax wbbx"), (1002, "grumpf zonk")]
    marks = spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")
    lexicon = toxicity.learn(documents(spark, rows[:300]), marks)
    assert any("grumpf".startswith(e) for e in lexicon.weights)
    got = scored(spark, rows + extra, lexicon)
    assert np.mean([(got[k] >= 0.7) == bool(y) for k, y in labels[300:]]) > 0.97
    assert got[1002] > 0.7 and max(got[1000], got[1001], got[1003], got[1004]) < 0.3 and all(0 <= s <= 1 for s in got.values())
    assert toxicity.rate_toxicity(documents(spark, rows), lexicon).columns == documents(spark, rows).drop("score").columns + ["score"]


def test_nothing_to_learn(spark):
    marks = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    lexicon = toxicity.learn(documents(spark, [(1, "a b")]), marks)
    assert scored(spark, [(1, "a b"), (2, None)], lexicon)[1] < 0.3 and scored(spark, [], lexicon) == {}


@pytest.mark.parametrize("d", ["/root/testdata/sf0.1"])
def test_held_out(spark, d):
    got = {r["doc_id"]: r for r in toxicity.op5_folded_lexicon(spark, d).collect()}
    pairs = [(got[k]["predicted"], y) for k, y in duckdb.sql(f"SELECT doc_id, toxic FROM '{d}/labels.parquet'").fetchall() if got[k]["held_out"]]
    hit, said, true = sum(p and y for p, y in pairs), sum(p for p, _ in pairs), sum(y for _, y in pairs)
    assert hit / said > 0.95 and hit / true > 0.8


def test_curve_is_fitted_at_the_true_share(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_TOXIC", 200)
    monkeypatch.setattr(toxicity, "SAMPLE_OTHER", 200)
    rng = np.random.default_rng(4)
    rows, labels = corpus(rng, 2000)
    labels = [(k, int(y and rng.random() < 0.5)) for k, y in labels]  # half of the marked texts are labelled clean
    share = np.mean([y for _, y in labels])
    lexicon = toxicity.learn(documents(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = scored(spark, rows, lexicon)
    assert abs(np.mean(list(got.values())) - share) < 0.03


def test_the_word_before_a_match():
    rng = np.random.default_rng(31)
    for _ in range(300):
        text = "".join(rng.choice(list("ab  \t"), 150)) + "x" * int(rng.integers(0, 60)) + " " * int(rng.integers(0, 50))
        for at in {0, 1, len(text), *rng.integers(0, len(text), 5).tolist()}:
            assert toxicity._word_before(text, at) == text[:at].rstrip()[-40:].split(" ")[-1]


def test_a_very_long_text_with_many_matches_teaches(spark):
    shared = spark.sparkContext.broadcast(toxicity.Lexicon({"vile": 1.0}))
    text = "quite vile thing " * 60_000  # a megabyte
    rows = spark.createDataFrame([(0, text), (1, "vile"), (0, None), (0, "")], "toxic int, _text string")
    got = toxicity._phrases(rows, shared)
    assert got[("", 0)] == 3 and got[("quite vile", 0)] == got[("vile thing", 0)] == 1
