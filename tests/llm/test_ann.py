import numpy as np
import pytest

from cloudgauge.llm import ann


def table(spark, x, ids=None):
    rows = [(int(i), None if v is None else [None if c is None else float(c) for c in v], 0) for i, v in zip(range(len(x)) if ids is None else ids, x, strict=True)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, bits int")


def found(index, coder, k=5):
    queries = index.where("vec_id % 20 = 0").groupBy("vec_id").agg({"x": "min"}).withColumnRenamed("min(x)", "x")
    out = {}
    for r in sorted(ann.search(index, coder, queries, k).collect()):
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return out


def brute(x, ids, k):
    x = np.asarray(x, np.float32).astype(float)
    out = {}
    for i in np.flatnonzero(np.asarray(ids) % 20 == 0):
        s = x @ x[i]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(n + 1, int(ids[j]), pytest.approx(s[j], abs=1e-9)) for n, j in enumerate(order)]
    return out


@pytest.mark.parametrize("width", [1, 7, 64])
def test_against_brute_force(spark, width, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 100)
    monkeypatch.setattr(ann, "BATCH_QUERIES", 7)
    monkeypatch.setattr(ann, "_STRIDE", 30)
    rng = np.random.default_rng(width)
    x = rng.normal(1, 1, (401, width)) * rng.uniform(0.1, 3, (401, 1))
    x[50:90] = x[40]  # ties go to the smaller id
    index, coder = ann.build_index(table(spark, x))
    want, got = brute(x, np.arange(401), 5), found(index, coder)
    assert got.keys() == want.keys()
    hits = sum(len({b for _, b, _ in got[q]} & {b for _, b, _ in want[q]}) for q in want)
    assert hits >= 0.95 * sum(map(len, want.values()))
    assert sum(got[q] == want[q] for q in want) >= 0.9 * len(want)


def test_unusable_rows_and_few_candidates(spark):
    x = [[1, 0], [0, 0], None, [float("nan"), 1], [float("inf"), 1], [None, 1], [1, 2, 3], [2, 0]]
    index, coder = ann.build_index(table(spark, x, [0, 1, 2, 3, 4, 5, 6, 20]))
    assert found(index, coder) == {0: [(1, 20, 2.0)], 20: [(1, 0, 2.0)]}


@pytest.mark.parametrize("copies", [5, 40, 400])
def test_repeated_own_ids_hide_no_candidate(spark, copies):
    rng = np.random.default_rng(copies)
    x = rng.normal(1, 1, (300, 16))
    x = np.concatenate([x, np.repeat(x[:1], copies, 0)])
    ids = np.r_[np.arange(300), np.zeros(copies, int)]
    index, coder = ann.build_index(table(spark, x, ids))
    got, want = found(index, coder), brute(x, ids, 5)
    assert got.keys() == want.keys() and all(len(v) == 5 for v in got.values())
    assert sum(got[q] == want[q] for q in want) >= 0.9 * len(want)


def test_empty(spark):
    index, coder = ann.build_index(table(spark, []))
    assert coder is None and found(index, coder) == {}


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(0)
    x, q = rng.normal(size=(4000, 64)), rng.normal(size=(1, 64))
    coder = ann.Coder(ann.rotation(64), x.mean(0))
    bits, scale, error = coder.encode(x)
    assert bits.shape == (4000, 32)
    asked = coder.asked(q)
    codes = ann.Codes.of(bits, scale, error, asked.lost)
    estimate, side, true = codes.estimates(asked, 0, slice(None)) + asked.centre[0], ann.BOUND * codes.error * asked.norm[0], x @ q[0]
    assert abs((estimate - true).mean()) < 0.1
    assert (abs(true - estimate) <= side).mean() > 0.9


@pytest.mark.parametrize("width", [3, 64, 1100])
def test_bit_counts_against_a_plain_product(width):
    rng = np.random.default_rng(width)
    x, q = rng.normal(size=(50, width)), rng.normal(size=(4, width))
    coder = ann.Coder(ann.rotation(width), np.zeros(width))
    bits, scale, error = coder.encode(x)
    asked = coder.asked(q)
    codes = ann.Codes.of(bits, scale, error, asked.lost)
    signs = np.unpackbits(bits, axis=1) * 2.0 - 1
    for i in range(4):
        turned = coder.turn[:, :width] @ q[i]
        step = ann._STEP * np.sqrt((turned**2).mean())
        levels = np.select([turned < -step, turned < 0, turned < step], [-1.5, -0.5, 0.5], 1.5) * step
        want = signs @ levels * (turned @ turned) / (levels @ turned) * scale
        assert np.allclose(codes.estimates(asked, i, slice(None)), want, rtol=1e-4, atol=1e-4)


def test_recall_on_embeddings(spark):
    d = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{d}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    want, got = brute(x, ids, 20), {}
    for r in sorted(ann.op1_rotated_codes(spark, d).collect()):
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    assert sum(len({b for _, b, _ in got[q]} & {b for _, b, _ in want[q]}) for q in want) >= 0.99 * 20 * len(want)
