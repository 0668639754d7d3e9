import math

import numpy as np
import pytest

from cloudgauge.llm import langid
from cloudgauge.llm.langid import ByteBiGRU, label_positions, windows
from tests.llm.tools import documents


def test_gradient_against_differences():
    net = ByteBiGRU(["a", "b", "c"], units=3, seed=1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    ids, length, _ = windows([b"abc", b"z", b"hello"])
    y = np.array([0, 2, 1])
    ids = ids[:, :5]
    _, g = net.gradient(ids, length, y)
    rng = np.random.default_rng(0)
    for name, p in net.p.items():
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in p.shape)
            if name.startswith("x"):
                at = (int(rng.choice(list(b"abchelo"))), at[1])
            old, step = p[at], 1e-3
            p[at] = old + step
            up = net.gradient(ids, length, y)[0]
            p[at] = old - step
            down = net.gradient(ids, length, y)[0]
            p[at] = old
            assert g[name][at] == pytest.approx((up - down) / (2 * step), abs=2e-4), (name, at)


def test_padding_does_not_matter():
    net = ByteBiGRU(["a", "b"], seed=2)
    ids, length, _ = windows([b"abc", b"longer words"])
    alone = net.positions(ids[:1, :3], length[:1])
    assert np.allclose(net.positions(ids, length)[0, :3], alone[0], atol=1e-6)
    assert net.positions(ids, length)[0, 3:].sum() == 0


@pytest.fixture(scope="module")
def net(spark):
    rng = np.random.default_rng(0)
    parts = {"xx": ["ba", "bo", "bu"], "yy": ["zi", "ze", "zé"], "zz": ["ба", "бо"]}
    rows = [(k, " ".join("".join(rng.choice(parts[lang], 3)) for _ in range(30)), lang) for k, lang in enumerate(list(parts) * 40)]
    docs = documents(spark, [r[:2] for r in rows]).drop("lang").join(spark.createDataFrame([(k, lang) for k, _, lang in rows], "doc_id long, lang string"), "doc_id")
    return langid.train(docs)


def test_documents(spark, net):
    rows = [(1, "babo bubu"), (2, "ZIZE zézi"), (3, "бабо"), (4, None), (5, ""), (6, " 12 -- 3 \n"), (7, "babo " * 40_000), (8, "ba" * 50_000), (1, "babo bubu"), (None, "zize"), (9, "日本語")]
    out = langid.identify(documents(spark, rows), net)
    got = {r["doc_id"]: r for r in out.collect()}
    assert {k: r["lang_pred"] for k, r in got.items() if k != 9} == {1: "xx", 2: "yy", 3: "zz", 4: "und", 5: "und", 6: "und", 7: "xx", 8: "xx", None: "yy"}
    assert got[9]["lang_pred"] in ("xx", "yy", "zz") and all(r["score"] == 0 if r["lang_pred"] == "und" else 0 < r["score"] <= 1 for r in got.values())
    assert "size" in out.columns and out.columns.count("score") == 1
    assert langid.identify(documents(spark, []), net).count() == 0


def plain_pooled(net, word):
    """Sums over the positions of a word, one number at a time."""
    p, k, n = {a: b.astype(float).tolist() for a, b in net.p.items()}, net.units, len(net.languages)
    sums = [0.0] * n
    for piece in (word[a : a + langid.WINDOW] for a in range(0, len(word), langid.WINDOW)):
        states = {}
        for d, order in (("f", range(len(piece))), ("b", range(len(piece) - 1, -1, -1))):
            h = [0.0] * k
            for t in order:
                x = p[f"x{d}"][piece[t]]
                u = [sum(h[i] * p[f"u{d}"][i][j] for i in range(k)) for j in range(3 * k)]
                z = [1 / (1 + math.exp(-x[j] - u[j])) for j in range(k)]
                r = [1 / (1 + math.exp(-x[k + j] - u[k + j])) for j in range(k)]
                new = [math.tanh(x[2 * k + j] + r[j] * u[2 * k + j]) for j in range(k)]
                h = [(1 - z[j]) * new[j] + z[j] * h[j] for j in range(k)]
                states[d, t] = h
        for t in range(len(piece)):
            logit = [p["bias"][c] + sum(states["f", t][i] * p["of"][i][c] + states["b", t][i] * p["ob"][i][c] for i in range(k)) for c in range(n)]
            e = [math.exp(v - max(logit)) for v in logit]
            sums = [s + v / sum(e) for s, v in zip(sums, e, strict=True)]
    return sums


def test_against_a_plain_forward_pass(spark, net):
    texts = ["babo Bubu zize", "бабо " * 3 + "12", "x" * 60 + " zé", "日本 ba-bo"]
    for r in langid.identify(documents(spark, list(enumerate(texts))), net).collect():
        words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w).encode() for w in texts[r["doc_id"]].split()]
        sums = np.sum([plain_pooled(net, w) for w in words], 0) / sum(map(len, words))
        assert r["lang_pred"] == net.languages[int(np.argmax(sums))] and r["score"] == pytest.approx(sums.max(), abs=1e-4)


def test_positions(net):
    runs = label_positions(net, "babobu бабо")
    assert runs[0][0] == 0 and runs[-1][1] == len("babobu бабо".encode()) and {r[2] for r in runs} >= {"xx", "zz"}


def test_nothing_to_learn(spark):
    docs = documents(spark, [(1, "words here")])
    assert langid.train(docs.withColumn("lang", docs["lang"].substr(1, 0)).where("false")) is None
    assert [r["lang_pred"] for r in langid.identify(docs, None).collect()] == ["und"]


def test_held_out(spark):
    d = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in langid.op6_byte_bigru(spark, d).collect()}
    right = [got[r["doc_id"]]["lang_pred"] == r["lang"] for r in spark.read.parquet(f"{d}/documents.parquet").collect() if got[r["doc_id"]]["held_out"]]
    assert len(right) > 300 and np.mean(right) > 0.97
