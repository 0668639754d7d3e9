import re

import numpy as np
import pytest
import xxhash

from cloudgauge.llm import simhash
from tests.llm.tools import documents

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def fingerprint(text, size=3):
    words = WORD.findall((text or "").encode().lower())
    shingles = [b" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1))] if words else []
    bits = [sum(xxhash.xxh64_intdigest(s, 42) >> k & 1 for s in shingles) * 2 > len(shingles) for k in range(64)]
    return sum(b << k for k, b in enumerate(bits)) if shingles else 0


def grouped(values, distance):
    """Smallest member of each one's component, by comparing all pairs."""
    n, up = len(values), list(range(len(values)))

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for i in range(n):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= distance:
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return [top(k) for k in range(n)]


def frame(spark, values, words=1):
    rows = [(b"".join((v >> 64 * k & 2**64 - 1).to_bytes(8, "big") for k in range(words)),) for v in dict.fromkeys(values)]
    return spark.createDataFrame(rows, "fp binary").repartition(3)


def number(fp):
    return sum(int.from_bytes(fp[8 * k : 8 * k + 8], "big") << 64 * k for k in range(len(fp) // 8))


def linked(spark, values, distance, segments, words=1, radius=None):
    got = simhash.links(frame(spark, values, words), distance, segments, words, radius).collect()
    pairs = [(number(bytes(r["a"])), number(bytes(r["b"]))) for r in got]
    assert all((a ^ b).bit_count() <= distance for a, b in pairs)
    up = {v: v for v in values}

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    names = {}
    return [names.setdefault(top(v), k) for k, v in enumerate(values)], len(pairs)


def families(rng, n, bits, flips):
    """Random fingerprints with copies that differ in a few bits, chains among them."""
    out = []
    for _ in range(n):
        v = int.from_bytes(rng.bytes(bits // 8), "big")
        for k in range(6):
            out.append(v)
            for b in rng.choice(bits, rng.integers(0, flips + 2), replace=False):
                v ^= 1 << int(b)
    return list(dict.fromkeys(out))


@pytest.mark.parametrize("distance,segments,words", [(3, 2, 1), (5, 3, 1), (0, 1, 1), (7, 4, 2), (8, 4, 1)])
def test_no_link_is_lost(spark, distance, segments, words):
    values = families(np.random.default_rng(distance), 60, 64 * words, distance)
    got, _ = linked(spark, values, distance, segments, words)
    want = grouped(values, distance)
    first = {}
    assert got == [first.setdefault(w, k) for k, w in enumerate(want)]


def test_a_large_family_costs_a_forest(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LARGE", 20)
    rng = np.random.default_rng(0)
    base = int.from_bytes(rng.bytes(8), "big")
    values = list(dict.fromkeys([base, *(base ^ 1 << int(a) ^ 1 << int(b) for a, b in rng.integers(0, 64, (900, 2)))]))
    got, pairs = linked(spark, values, 3, 2)
    assert got == [0] * len(values) and pairs < 40 * len(values)
    key = np.zeros(len(values), np.uint64)
    found = simhash.slice_links(np.array(values, np.uint64)[:, None], np.arange(len(values)), key, len(values), np.zeros(1, np.uint64), 3)
    assert len(found) == len(values) - 1


def test_segments_follow_the_number_of_fingerprints():
    shapes = {e: [len(x) for x in simhash.segments_for(1 << e, 0.8, 4)] for e in (0, 4, 20, 21, 24, 28, 32)}
    assert shapes[0] == shapes[4] == shapes[20] == [16] * 16
    assert [set(shapes[e]) for e in (21, 24, 28, 32)] == [{17}, {20}, {24}, {28}]
    assert all(np.array_equal(x, y) for x, y in zip(simhash.segments_for(1 << 20, 0.8, 4), simhash.cut(256, 16), strict=True))
    for bits in simhash.segments_for(1 << 24, 0.8, 4):
        assert len(np.unique(bits)) == 20 and (np.diff(bits) > 0).all() and 0 <= bits[0] and bits[-1] < 256


@pytest.mark.parametrize("exponent", [16, 22, 24, 28, 32])
def test_wider_segments_still_bring_pairs_together(exponent):
    rng, n = np.random.default_rng(exponent), 40_000
    apart = np.packbits(rng.random((n, 256)) < simhash.differing(0.8), axis=1).view(np.uint64)  # pairs at a similarity of just 0.8
    missed = np.ones(n, bool)
    for bits in simhash.segments_for(1 << exponent, 0.8, 4):
        missed &= np.bitwise_count(apart & simhash._mask(bits, 4)).sum(1) > 1
    assert missed.mean() <= simhash.MISSED + 3 * (simhash.MISSED / n) ** 0.5


def test_gathered_bits():
    rng = np.random.default_rng(21)
    values = [int.from_bytes(rng.bytes(32), "big") for _ in range(50)]
    fp = np.array([[v >> 64 * k & 2**64 - 1 for k in range(4)] for v in values], np.uint64)
    for bits in [*simhash.cut(256, 7), np.sort(rng.permutation(256)[:30]), np.sort(rng.permutation(256)[:64])]:
        assert simhash._gathered(fp, bits).tolist() == [sum((v >> int(b) & 1) << k for k, b in enumerate(bits)) for v in values]
        assert simhash._mask(bits, 4).tolist() == [sum(1 << int(b) for b in bits) >> 64 * k & 2**64 - 1 for k in range(4)]


def test_candidates_of_a_fingerprint_do_not_grow_with_their_number(monkeypatch):
    monkeypatch.setattr(simhash, "LEAST_BITS", 4)
    met, near = [], simhash._near
    monkeypatch.setattr(simhash, "_near", lambda fp, left, right, distance: (met.append(len(right)), near(fp, left, right, distance))[1])
    rng, rates = np.random.default_rng(22), []
    for n in (1 << 12, 1 << 14, 1 << 16):
        bits = simhash.segments_for(n, 0.8, 4)[0]
        fp = rng.integers(0, 2**64 - 1, (n, 4), dtype=np.uint64)
        met.clear()
        assert simhash.slice_links(fp, np.arange(n), simhash._gathered(fp, bits), n, simhash.ball(len(bits), 1), 56) == []
        rates.append(sum(met) / n / (1 + len(bits)))  # for each value of the ball
    assert max(rates) < 1.1 * min(rates) and max(rates) < simhash.BUCKET


def test_no_link_is_lost_in_permuted_segments(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LEAST_BITS", 24)
    places = simhash.segments_for(1, 0.8, 4)
    values = families(np.random.default_rng(23), 40, 256, 12)
    got, _ = linked(spark, values, 20, places, 4, 1)
    want, first = grouped(values, 20), {}
    assert len(places) > 256 // 24 and got == [first.setdefault(w, k) for k, w in enumerate(want)]


def test_components(spark):
    pairs = [(k, k + 1) for k in range(40)] + [(100, 150), (120, 150), (100, 120), (7, 7)]
    df = spark.createDataFrame([(a.to_bytes(2, "big"), b.to_bytes(2, "big")) for a, b in pairs], "a binary, b binary")
    for tasks in (1, 7):
        got = {int.from_bytes(r["node"], "big"): int.from_bytes(r["component"], "big") for r in simhash.components(df, tasks).collect()}
        assert got == {**{k: 0 for k in range(1, 41)}, 120: 100, 150: 100}
    assert simhash.components(df.limit(0)).count() == 0


def test_hubs_and_the_rest_find_their_least(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HUBS", 10)
    pairs = [(9, k) for k in range(100, 160)] + [(8, k) for k in range(100, 104)] + [(k, k + 1) for k in range(20)]
    df = spark.createDataFrame([(bytes([a]), bytes([b])) for a, b in pairs], "u binary, v binary")
    got = sorted((r["u"][0], r["v"][0], r["m"][0]) for r in simhash._with_least(df, len(pairs)).collect())
    least = {a: min(b for x, b in pairs if x == a) for a, _ in pairs}
    assert got == sorted((a, b, least[a]) for a, b in pairs)


def test_documents(spark):
    rng = np.random.default_rng(2)
    words = [f"Wörd{k}" for k in range(50)]
    texts = [" ".join(rng.choice(words, 300)) for _ in range(15)]
    texts += [texts[0], texts[1].replace("Wörd3 ", "x ", 1), texts[2].lower(), None, "", " \n", "one", "one two", "ONE", "long " * 70_000, "a\x1fb c d e"]
    rows = [(100 - k, t) for k, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in simhash.near_duplicates(documents(spark, [*rows, rows[3], (None, "one")])).collect()}
    prints = [fingerprint(t) for t in texts]
    assert [int.from_bytes(got[k]["fp"], "big") for k, _ in rows] == prints
    want = grouped(prints, 3)
    lowest = {}
    for (k, _), w in zip(rows, want, strict=True):
        lowest[w] = min(lowest.get(w, k), k)
    assert [got[k]["component_id"] for k, _ in rows] == [lowest[w] for w in want]
    assert got[None]["component_id"] == min(k for k, t in rows if t in ("one", "ONE"))
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


def test_sketches():
    rng = np.random.default_rng(5)
    for n, shared in ((100, 80), (3000, 2400), (5, 0), (0, 0)):
        a, b = (np.concatenate([x, y]) for x, y in [(s, rng.integers(0, 2**64 - 1, n, dtype=np.uint64)) for s in [rng.integers(0, 2**64 - 1, shared, dtype=np.uint64)] * 2])
        x, y = simhash.sketches(np.array([len(a), len(b)]), np.concatenate([a, b]), 256)
        true = len(set(a) & set(b)) / max(1, len(set(a) | set(b))) if len(a) else 1.0
        assert simhash.jaccard(x, y, 256) == pytest.approx(true, abs=1e-9 if len(a) < 256 and len(b) < 256 and len(set(a) | set(b)) <= 256 else 0.1)


def test_one_of_each(spark):
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(500)]
    texts = [" ".join(rng.choice(words, 400)) for _ in range(30)]
    near = []
    for t in texts[:10]:
        w = t.split()
        for k in rng.choice(400, 4, replace=False):  # 20 of about 400 shingles change
            w[k] = "changed"
        near.append(" ".join(w))
    rows = [(k, t) for k, t in enumerate(texts + near + texts[20:25])]
    rows += [(50, texts[29]), (50, texts[29]), (None, "quite alone here with these words"), (None, "quite alone here with these words")]
    docs = documents(spark, rows)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, [*range(30), None]))
    assert simhash.one_of_each(documents(spark, [])).count() == 0


def test_rows_are_told_apart_by_all_their_values(spark):
    line = "alpha beta gamma delta epsilon zeta"
    rows = [(None, line, None, {"a": 1}, 1, "x", line), (None, None, line, {"a": 1}, 1, "x", line), (None, None, line, {"a": 2}, 1, "x", line)]
    docs = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string, source string, _row map<string,int>, _number int, `n.x` string, row string")
    got = simhash.one_of_each(docs)
    assert got.columns == docs.columns
    kept = [tuple(r) for r in got.collect()]
    assert len(kept) == 2 and rows[0] in kept and all(r in rows for r in kept)
