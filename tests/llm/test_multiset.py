import hashlib

import numpy as np
import pytest
import xxhash

from cloudgauge.llm import multiset
from cloudgauge.llm.multiset import Fingerprint, passages
from tests.llm.tools import documents


def test_sums_do_not_depend_on_order():
    parts = [f"line {k} of a text." for k in range(40)] + ["twice.", "twice."]
    whole = Fingerprint("\n".join(parts))
    assert np.array_equal(whole.lanes, Fingerprint("\r\n".join(reversed(parts))).lanes)
    grown = Fingerprint("\n".join(parts[:20])).insert(parts[20:])
    assert np.array_equal(grown.lanes, whole.lanes)
    assert np.array_equal(grown.delete(parts[20:]).lanes, Fingerprint("\n".join(parts[:20])).lanes)
    assert not np.array_equal(Fingerprint("twice.").lanes, Fingerprint("twice.\ntwice.").lanes)


def test_passages_cover_the_words():
    text = "One. Two two\nthree! " + "w " * 100 + "\n\n  last"
    assert " ".join(passages(text)).split() == text.split() and max(len(p.split()) for p in passages(text)) <= multiset.PASSAGE


def test_likeness_follows_the_shared_part():
    parts = [f"line {k} of a text." for k in range(400)]
    a = Fingerprint("\n".join(parts))
    for n in (0, 100, 200, 400):
        b = Fingerprint("\n".join(parts[:n] + [f"new {k} here." for k in range(400 - n)]))
        assert a.likeness(b) == pytest.approx(n / 400, abs=0.2)
    assert a.likeness(a.copy()) == 1 and Fingerprint("").likeness(Fingerprint(" ")) == 1 and a.likeness(Fingerprint("")) < 0.2


def expected(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out = []
    for k, (key, text) in enumerate(order):
        text, other = text or "", order[(k + 1) % len(order)][1] or ""
        n = len(text) // 4
        new = text[: len(text) - n] + other[:n]
        mine, theirs, nexts = Fingerprint(text), Fingerprint(new), Fingerprint(other)
        out.append((key, len(text), hashlib.sha256(new.encode()).hexdigest(), mine.hex(), theirs.hex(), mine.likeness(theirs), mine.likeness(nexts)))
    return sorted(out, key=str)


@pytest.mark.parametrize("number", [1, 2, 40])
def test_against_one_list(spark, number):
    rng = np.random.default_rng(number)
    rows = [(int(k), " ".join(rng.choice(["é", "word.", "\n", "日本", "x\r\n", "\x85", "🎉"], rng.integers(0, 80)))) for k in rng.integers(-(10**12), 10**12, number)]
    if number > 2:
        rows += [(None, "null id"), (None, "another"), (rows[0][0], "repeated"), rows[1], (5, None), (6, ""), (7, "long\n" * 30_000)]
    got = sorted(map(tuple, multiset.fingerprints(documents(spark, rows).repartition(3)).collect()), key=str)
    want = expected(rows)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:])


def mixed(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
    x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
    return x ^ x >> 31


def plain_lanes(text):
    """The sum of the passages' vectors, lane by lane, in whole numbers."""
    lanes = [0] * (multiset.EQUAL + multiset.LIKE)
    for p in passages(text):
        key = xxhash.xxh3_128_intdigest(p)
        stream = []
        for k in range(1, multiset.EQUAL // 4 + multiset.LIKE // 64 + 1):
            step = 0x9E3779B97F4A7C15 * k
            stream.append(mixed(mixed(((key & 2**64 - 1) + step) % 2**64) ^ ((key >> 64) + step) % 2**64))
        for k in range(multiset.EQUAL):
            lanes[k] += stream[k // 4] >> 16 * (k % 4) & 0xFFFF
        for k in range(multiset.LIKE):
            byte = stream[multiset.EQUAL // 4 + k // 64] >> 8 * (k % 64 // 8) & 0xFF
            lanes[multiset.EQUAL + k] += 1 if byte >> 7 - k % 8 & 1 else -1
    return [x % 2**16 for x in lanes]


def test_against_plain_sums(spark):
    texts = ["", "one", "a line.\nanother line! and more words " + "w " * 40, "é\r\n日本 " * 9, "b c d\n" * 70]
    got = {r["doc_id"]: r for r in multiset.fingerprints(documents(spark, list(enumerate(texts)))).collect()}
    for k, text in enumerate(texts):
        after = texts[(k + 1) % len(texts)]
        n = len(text) // 4
        own, new, next_ = plain_lanes(text), plain_lanes(text[: len(text) - n] + after[:n]), plain_lanes(after)
        assert got[k]["fingerprint"] == b"".join(x.to_bytes(2, "little") for x in own).hex()
        assert got[k]["edited_fingerprint"] == b"".join(x.to_bytes(2, "little") for x in new).hex()
        for name, other in (("near_edited", new), ("near_next", next_)):
            a, b = ([(x + 2**15) % 2**16 - 2**15 for x in v[multiset.EQUAL :]] for v in (own, other))
            apart, whole = sum((x - y) ** 2 for x, y in zip(a, b, strict=True)), sum(x * x for x in a + b)
            assert got[k][name] == pytest.approx(1.0 if own == other else min(1, max(0, 1 - apart / whole)))


def test_lanes_have_the_whole_hash():
    keys = np.array([[5, 7], [5, 8], [6, 7]], np.uint64)
    assert len(np.unique(multiset.vectors(keys), axis=0)) == 3


def test_empty(spark):
    assert multiset.fingerprints(documents(spark, [])).count() == 0
