import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cloudgauge.llm import phrases

FIELDS = "doc_id long, text string, lang string, phrase string, key string, w long"


def table(spark, rows):
    return spark.createDataFrame([(k, t, g, "x", "y", 7) for k, (t, g) in enumerate(rows)], FIELDS)


def brute(rows, least, longest=5, kept=2000, hides=100):
    counts, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        often = {p: n for p, n in f.items() if n >= least and len(p) > 1}
        rows = []
        for p, a in often.items():
            if any(len(q) > len(p) and 100 * n >= hides * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, n in often.items()):
                continue
            score, k = min((1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, n + 1, p.decode(), -a, left, right, total[lang], -s) for n, (s, a, p, left, right) in enumerate(sorted(rows)[:kept])]
    return sorted(out)


def found(spark, rows, least, **kw):
    return sorted(tuple(r) for r in phrases.collocations(table(spark, rows), least=least, **kw).collect())


def texts(seed, number, words=12):
    rng = np.random.default_rng(seed)
    some = ["a", "b", "Bb", "c", "é", "İ", "日本", "x\x1fy", " ", "the", "of", "zz"][:words]
    ends = [". ", ", ", " ", " ", " ", "\t", "  ", "\n", "\x0b", "!?"]
    return [("".join(some[min(int(rng.exponential(3)), len(some) - 1)] + ends[rng.integers(len(ends))] for _ in range(rng.integers(0, 60))), ["en", "de", None][rng.integers(3)]) for _ in range(number)]


@pytest.mark.parametrize("least", [1, 3, 20])
def test_against_brute_force(spark, least, monkeypatch):
    monkeypatch.setattr(phrases, "SUM_BYTES", 300)
    rows = texts(least, 120) + [("the of the of the of", "en")] * 30 + [(None, "en"), ("", None), (" .. ", "de")]
    assert found(spark, rows, least) == brute(rows, least)
    assert found(spark, rows, least, longest=3, kept=7, hides=60) == brute(rows, least, 3, 7, 60)


def test_a_full_bitmap_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(phrases, "LEAST_BITS", 64)
    monkeypatch.setattr(phrases, "MOST_BITS", 64)
    rows = texts(5, 150)
    assert found(spark, rows, 4) == brute(rows, 4)


def test_parts_that_many_ask_for_and_keys_of_odd_languages(spark, monkeypatch):
    monkeypatch.setattr("cloudgauge.llm.simhash.HUBS", 40)
    rows = [(f"the w{k % 50} of w{k % 7}", lang) for k in range(400) for lang in ("en", "e\nn", "", "\n")]
    assert found(spark, rows, 5) == brute(rows, 5)


def test_empty_and_rare(spark):
    assert found(spark, [], 1) == []
    assert found(spark, [("a b c", "en"), (None, None)], 2) == []


def test_a_very_long_text_and_a_very_long_word(spark):
    rows = [("ab cd " * 400_000, "en"), ("x" * 3_000_000 + " y", "en")] + [("ab cd, cd ab", "en")] * 5
    assert found(spark, rows, 4) == brute(rows, 4)


def test_the_bucket_counts_out_of_core(spark, monkeypatch):
    monkeypatch.setattr(phrases, "DUCKDB_MB", 40)
    pieces = spark.range(300_000).select(F.lit("en").alias("lang"), F.concat(F.lit("w" * 40), "id", F.lit(" q")).alias("piece"), F.lit(1).cast("long").alias("m"))
    got = phrases.frequent_ngrams(pieces.repartition(2), 1, 2).agg(F.count("f"), F.sum("f")).first()
    assert tuple(got) == (300_000 * 2 + 1 + 1, 300_000 * 4 + 300_000 - 300_000 + 300_000)


wide = st.integers(1, 10**13)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(wide, wide, wide, wide), min_size=1, max_size=50))
def test_scores_are_exact(spark, rows):
    rows = [r for r in rows if 1000 * r[0] * r[1] // (r[2] * r[3]) < 2**63] or [(1, 1, 1, 1)]
    got = spark.createDataFrame(rows, "a long, n long, l long, r long").select(phrases.score(F.col("a"), F.col("n"), F.col("l"), F.col("r"))).collect()
    assert [g[0] for g in got] == [1000 * a * n // (left * right) for a, n, left, right in rows]


def test_against_sql(spark):
    d = "/root/testdata/sf0.001"
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
        want = db.execute(f"SELECT lang, rank, phrase, a, l, r, n, score FROM ({phrases.ORACLE_SQL})").fetchall()
    got = [tuple(r) for r in phrases.op11_collocations(spark, d).collect()]
    assert sorted(got) == sorted(want) and want
