import numpy as np

from cloudgauge.llm import simhash
from tests.llm.tools import documents


def shingles(text, size=5):
    words = text.split()
    return {tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()


def survivors(texts, similarity=0.8):
    """The smallest position of each group, by comparing the whole shingle sets of all pairs."""
    sets, up = [shingles(t) for t in texts], list(range(len(texts)))

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for i, x in enumerate(sets):
        for j in range(i):
            both = len(x & sets[j])
            if top(i) != top(j) and both >= similarity * (len(x) + len(sets[j]) - both):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return [k for k in range(len(texts)) if top(k) == k]


def kept(spark, texts):
    return sorted(r["doc_id"] for r in simhash.one_of_each(documents(spark, list(enumerate(texts)))).collect())


def fresh(rng, n):
    return [f"v{k}" for k in rng.integers(0, 10**9, n)]


def test_whole_sets_decide_close_pairs(spark):
    rng, texts = np.random.default_rng(11), []
    for shared in [456] * 30 + [446] * 30:  # 0.836 and 0.804
        base = fresh(rng, 504)
        texts += [" ".join(base), " ".join(base[: shared + 4] + fresh(rng, 500 - shared))]
    for shared in [438] * 30:  # 0.779
        base = fresh(rng, 504)
        texts += [" ".join(base), " ".join(base[: shared + 4] + fresh(rng, 500 - shared))]
    assert len(survivors(texts)) == 60 + 60
    assert kept(spark, texts) == survivors(texts)


def test_alike():
    rng = np.random.default_rng(12)
    sets = [np.unique(rng.integers(0, 60, n).astype(np.uint64)) for n in (0, 0, 1, 20, 40, 90, 200, 200)]
    want = [[len(set(x) & set(y)) / max(1, len(set(x) | set(y))) >= 0.8 or not len(x) + len(y) for y in sets[2:] + sets[:2]] for x in sets]
    assert simhash.alike(sets, sets[2:] + sets[:2], 0.8, 7).tolist() == want


def test_equal_fingerprints_are_verified(spark):
    rng = np.random.default_rng(13)
    line = fresh(rng, 11)
    texts = [" ".join(line * 60 + fresh(rng, 40)) for _ in range(2)]
    assert kept(spark, texts) == survivors(texts) == [0, 1]
    # equal fingerprints of different sets
    prints = simhash.fingerprints(documents(spark, [(0, "a b c d e f g h"), (1, "z y x w v u")]), size=5, words=4, sets=True).collect()
    nodes = spark.createDataFrame([(bytes(r["node"]), b"\0" * 32, r["doc_id"], r["n"]) for r in prints], "node binary, fp binary, low long, n long")
    none = spark.createDataFrame([], "a binary, b binary")
    assert len({r["node"] for r in nodes.collect()}) == 2
    assert simhash.verified(none, nodes, documents(spark, [(0, "a b c d e f g h"), (1, "z y x w v u")]), "doc_id", "text", 5, 0.8).count() == 0


def test_repeats_do_not_hide_copies(spark):
    rng = np.random.default_rng(14)
    line, body = fresh(rng, 11), fresh(rng, 400)
    texts = [" ".join(body + line), " ".join(body + line * 60), " ".join(body + line * 61)]
    assert kept(spark, texts) == survivors(texts) == [0]


def test_family_on_a_template_against_brute_force(spark):
    rng = np.random.default_rng(15)
    base, texts = fresh(rng, 300), []
    for _ in range(500):
        own = list(base)
        for k in rng.choice(300, rng.integers(4, 11), replace=False):
            own[k] = fresh(rng, 1)[0]
        texts.append(" ".join(own))
    want = survivors(texts)
    assert 1 < len(want) < 500
    assert kept(spark, texts) == want


def test_wide_segments_keep_the_same_rows(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LEAST_BITS", 22)  # as for some 60 million texts
    rng, texts = np.random.default_rng(17), [None, ""]
    for shared in [456] * 20 + [446] * 20 + [438] * 20:
        base = fresh(rng, 504)
        texts += [" ".join(base), " ".join(base[: shared + 4] + fresh(rng, 500 - shared))]
    assert kept(spark, texts) == survivors([t or "" for t in texts])
    assert kept(spark, []) == []


def test_blocks_compare_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK_TEXTS", 3)
    rng = np.random.default_rng(16)
    base, texts = fresh(rng, 300), []
    for k in range(40):  # a chain, each only like its neighbours
        base = base[:10 * k % 300] + fresh(rng, 8) + base[10 * k % 300 + 8 :]
        texts.append(" ".join(base))
    assert kept(spark, texts) == survivors(texts) == [0]
