import duckdb
import numpy as np
import pytest

from cloudgauge.llm import pstable
from cloudgauge.llm.pstable import Tables, meeting


def table(spark, x, labels, ids=None):
    rows = [(int(i), None if v is None else [None if c is None else float(c) for c in v], None if g is None else int(g), 1, "n") for i, v, g in zip(range(len(x)) if ids is None else ids, x, labels, strict=True)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, copies int, node string")


def found(spark, *args, **kw):
    return sorted(tuple(r) for r in pstable.near_duplicates(table(spark, *args), **kw).collect())


def brute(x, labels, ids=None, cosine=pstable.COSINE):
    ids = list(range(len(x))) if ids is None else ids
    own = [None if v is None or None in list(v) or not len(v) else np.asarray(v, np.float32).astype(float) for v in x]
    own = [v if v is not None and np.isfinite(v).all() and v.any() else None for v in own]
    own = [None if v is None else v / np.abs(v).max() for v in own]
    own = [None if v is None else v / np.sqrt(v @ v) for v in own]
    links = {i: {j for j in range(len(x)) if i != j and labels[i] is not None and labels[i] == labels[j] and own[i] is not None and own[j] is not None and len(own[i]) == len(own[j]) and own[i] @ own[j] >= cosine} for i in range(len(x))}
    low = list(ids)
    while True:
        now = [min([low[i], *(low[j] for j in links[i])]) for i in range(len(x))]
        if now == low:
            return sorted((ids[i], len(links[i]), low[i], low[i] == ids[i]) for i in range(len(x)))
        low = now


def planted(seed, width=64, number=300):
    """Vectors of which some stand in families at cosines just over and under the least one, in chains, and as copies."""
    rng = np.random.default_rng(seed)
    x, labels = list(rng.normal(size=(number, width))), list(rng.integers(0, 3, number))
    for k in range(40):
        base, other = x[k] / np.linalg.norm(x[k]), rng.normal(size=width)
        other -= (other @ base) * base
        other /= np.linalg.norm(other)
        for angle in np.linspace(0.01, 0.9, 7):
            x.append((np.cos(angle) * base + np.sin(angle) * other) * rng.uniform(0.01, 50))
            labels.append(labels[k])
    x += [x[3]] * 25 + [x[3] * 2.0] * 10
    labels += [labels[3]] * 35
    order = rng.permutation(len(x))
    return [x[k] for k in order], [labels[k] for k in order]


@pytest.mark.parametrize("width", [8, 64])
def test_against_brute_force(spark, width, monkeypatch):
    monkeypatch.setattr(pstable, "BLOCK", 16)
    monkeypatch.setattr(pstable, "SIDE", 5)
    x, labels = planted(width, width)
    got, want = found(spark, x, labels), brute(x, labels)
    linked = sum(r[1] for r in want)
    assert linked > 1500 and [r[0] for r in got] == [r[0] for r in want]
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
    assert sum(r[1] for r in got) >= 0.998 * linked
    assert sum(g == w for g, w in zip(got, want, strict=True)) >= 0.99 * len(want)


def test_rows_that_take_no_part(spark):
    x = [[1, 0], [1, 0], None, [0, 0], [float("nan"), 1], [float("inf"), 1], [None, 1], [1, 0, 0], [2, 0], [], [1, 0], [-0.0, 0], [1, -0.0]]
    labels = [5, 5, 5, 5, 5, 5, 5, 5, 5, 5, None, 5, 5]
    got = found(spark, x, labels)
    assert got == brute(x, labels) and got[0] == (0, 3, 0, True) and got[8] == (8, 3, 0, False)
    assert found(spark, [], []) == [] and found(spark, [None], [None]) == [(0, 0, 0, True)]


def test_repeated_ids_count_as_rows(spark):
    assert found(spark, [[1, 0], [1, 0], [1, 0.01], [0, 1]], [1, 1, 1, 1], [7, 7, 3, 7]) == [(3, 2, 3, True), (7, 0, 7, True), (7, 2, 3, False), (7, 2, 3, False)]


def test_equal_vectors_of_other_labels_do_not_link(spark):
    assert found(spark, [[1, 1]] * 4, [1, 2, -1, 1]) == [(0, 1, 0, True), (1, 0, 1, True), (2, 0, 2, True), (3, 1, 0, False)]


def test_null_ids(spark):
    rows = spark.createDataFrame([(None, [1.0, 0.0], 1), (4, [1.0, 0.0], 1), (None, [0.0, 1.0], 1)], "vec_id long, embedding array<double>, label long")
    got = sorted((tuple(r) for r in pstable.near_duplicates(rows).collect()), key=str)
    assert got == sorted([(None, 1, 4, False), (4, 1, 4, True), (None, 0, None, True)], key=str)


def test_sizes_at_the_ends_of_doubles(spark):
    rows = spark.createDataFrame([(k, [s, s * 0.5], 1) for k, s in enumerate([1e300, 1.0, 1e-300, -1e300])], "vec_id long, embedding array<double>, label long")
    assert sorted(tuple(r) for r in pstable.near_duplicates(rows).collect()) == [(0, 2, 0, True), (1, 2, 0, False), (2, 2, 0, False), (3, 0, 3, True)]


def test_tables_meet_as_often_as_promised():
    rng = np.random.default_rng(1)
    tables = Tables.for_rows(5000)
    n, cosine = 400, pstable.COSINE
    a, b = pstable.unit(rng.normal(size=(n, 64))), rng.normal(size=(n, 64))
    b = pstable.unit(b - (a * b).sum(1, keepdims=True) * a)
    near = cosine * a + np.sqrt(1 - cosine**2) * b
    label = np.zeros(n, np.int64)
    ka, kn, kb = (tables.keys(v, label) for v in (a, near, b))
    assert abs((ka == kn).mean() - meeting(np.sqrt(2 - 2 * cosine)) ** tables.projections) < 0.01
    assert (ka == kn).any(1).mean() >= 0.99
    assert (ka == kb).mean() * 5000 < 0.2
    assert not (ka == tables.keys(a, label + 1)).any()


def test_against_sql(spark):
    d = "/root/testdata/sf0.01"
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{d}/embeddings.parquet'")
        want = db.execute(f"SELECT vec_id, n_links, component_id, kept FROM ({pstable.ORACLE_SQL})").fetchall()
    assert sorted(tuple(r) for r in pstable.op12_pstable_embeddings(spark, d).collect()) == sorted(want)
