import duckdb
import pytest

from cloudgauge.llm import mixing
from tests.llm.tools import documents


def run(spark, rows):
    return {r["doc_id"]: r for r in mixing.mix(documents(spark, rows)).collect()}


def waterfill(sizes, weights, total, repeats):
    """Targets by sharing the excess again until none is above its cap."""
    targets, open_, left = {}, dict(weights), total
    while open_:
        whole = sum(open_.values())
        over = {s for s, w in open_.items() if left * w / whole > repeats * sizes[s] + 1e-9}
        if not over:
            return targets | {s: left * w / whole for s, w in open_.items()}
        for s in over:
            targets[s] = repeats * sizes[s]
            left -= targets[s]
            del open_[s]
    return targets


def test_targets_and_budgets(spark):
    rows = [(k, "w " * (1 + k % 7), f"s{k % 6 if k % 3 else 0}") for k in range(600)] + [(700 + k, "w w", None) for k in range(50)]
    got = run(spark, rows)
    sizes, took, targets = {}, {}, {}
    source = {k: s for k, _, s in rows}
    for k, r in got.items():
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        sizes[source[k]] = sizes.get(source[k], 0) + r["size"]
        took[source[k]] = took.get(source[k], 0) + r["taken"]
        targets[source[k]] = r["target"]
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = waterfill(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, 1.5 * sum(sizes.values()), 2)
    for s in order:
        assert targets[s] == pytest.approx(want[s]) and abs(took[s] - want[s]) <= 7


def test_thresholds_nest(spark):
    sized = mixing.sizes(documents(spark, [(k, "w w w", "a") for k in range(200)]))
    at = [mixing.thresholds(sized, spark.createDataFrame([("a", float(b))], "source string, budget double")).first() for b in (0, 30, 90, 300)]
    assert at == sorted(at, key=lambda r: r["threshold"])
    assert [sized.where(sized["h"] < r["threshold"]).count() for r in at] == [0, 10, 30, 100]


def test_edges(spark):
    got = run(spark, [(1, None, "a"), (2, "", "a"), (3, " \t\n", "b"), (None, "x y", "c"), (5, "x y\x1fz", "c"), (5, "again", "c")])
    assert got[1]["size"] == 0 and got[3]["target"] == 0 and got[3]["taken"] == 0 and got[5]["source_size"] == 4
    assert run(spark, []) == {}
    everything = run(spark, [(1, None, "a"), (2, None, None)])
    assert all(r["taken"] == 0 and r["target"] == 0 for r in everything.values())


def test_mixture_repeats_rows_and_keeps_columns(spark):
    docs = documents(spark, [(k, "w " * 5, "ab"[k % 4 == 0]) for k in range(80)])
    out, plan = mixing.mixture(docs), {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix(docs).collect()}
    counts = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert out.columns == docs.columns and counts == {k: n for k, n in plan.items() if n}


def test_against_sql(spark):
    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS FROM '/root/testdata/sf0.001/documents.parquet'")
    want = sorted(con.sql(mixing.ORACLE_SQL).fetchall())
    assert want == sorted(map(tuple, mixing.op3_hash_threshold_mix(spark, "/root/testdata/sf0.001").collect()))


def test_many_sources_are_dealt_and_agree(spark):
    """A plan too large to broadcast: sources and a hot one are dealt over keys, with the same result; texts are not gathered by source."""
    rows = [(k, "w " * (k % 9), None if k % 50 == 0 else f"s{k % 7}" if k % 3 else "hot") for k in range(500)] + [(3, "again", "hot"), (None, None, "hot")]
    docs = documents(spark, rows)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = [mixing.mix(docs, most=most) for most in (100_000, 0)]
        assert sorted(map(tuple, found[0].collect()), key=str) == sorted(map(tuple, found[1].collect()), key=str)
        out = [mixing.mixture(docs, most=most) for most in (100_000, 0)]
        assert sorted(map(tuple, out[0].collect()), key=str) == sorted(map(tuple, out[1].collect()), key=str)
        plans = [o._jdf.queryExecution().executedPlan().toString() for o in out]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "hashpartitioning" not in plans[0] and "_salt" in plans[1]


def test_very_long_texts_are_counted_whole(spark):
    got = run(spark, [(1, "word " * 1_000_000, "a"), (2, "x" * 5_000_000, "a")])
    assert (got[1]["size"], got[2]["size"], got[2]["source_size"]) == (1_000_000, 1, 1_000_001)
