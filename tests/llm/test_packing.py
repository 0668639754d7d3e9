import zlib
from functools import lru_cache

import numpy as np
import pytest

from cloudgauge.llm import packing
from tests.llm.tools import documents


@lru_cache(1)
def exact():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.tokenizer_paths()[0])


def ids_of(text):
    return [*exact().encode(text or "", add_special_tokens=False).ids, 0]


@pytest.mark.parametrize("text", ["", "plain words", "<|endoftext|> inside", "é ä \n\n  \t x\r\n", "1234567 " * 50, "日本語 🎉", "a" * 3000, " " * 500])
def test_ids(text):
    assert [*packing.encoder(*packing.tokenizer_paths())(text), 0] == ids_of(text)
    assert [*packing.encoder(packing.tokenizer_paths()[0], None)(text), 0] == ids_of(text)


def test_best_fill_is_best():
    rng = np.random.default_rng(0)
    for _ in range(60):
        capacity = int(rng.integers(5, 40))
        counts = {int(k): int(rng.integers(1, 4)) for k in rng.integers(1, capacity, 5)}
        first = max(counts)
        sums = {0}
        for k, n in counts.items():
            sums = {s + k * m for s in sums for m in range(n + (0 if k == first else 1))} if k != first else {s + k * m for s in sums for m in range(n)}
        fill = packing.best_fill(first, counts, capacity)
        assert all(n <= counts[k] for k, n in fill.items()) and fill[first] >= 1
        assert sum(k * n for k, n in fill.items()) == max(s + first for s in sums if s + first <= capacity)


def fewest(histogram, capacity):
    """The L2 bound of bin packing: for each k, rests over capacity - k and over a half stand alone, and those from k on fill what the latter leave."""
    best = 0
    for k in range(capacity // 2 + 1):
        alone = sum(n for x, n in histogram.items() if x > capacity - k)
        large = [(x, n) for x, n in histogram.items() if capacity // 2 < x <= capacity - k]
        room = sum(n * (capacity - x) for x, n in large)
        small = sum(n * x for x, n in histogram.items() if k <= x <= capacity // 2)
        best = max(best, alone + sum(n for _, n in large) + max(0, -(-(small - room) // capacity)))
    return best


def test_plan_covers_each_rest_once():
    histogram = {k: int(n) for k, n in zip(range(1, 64), np.random.default_rng(1).integers(0, 9000, 63), strict=True)}
    slots, windows = packing.plan_windows(histogram, 64)
    filled = {}
    for length, a, b, first, copies, offset in slots:
        assert (b - a) % copies == 0
        for r in (a, b - 1):
            filled.setdefault(first + (r - a) // copies, []).append((offset + (r - a) % copies * length, length))
    for k, n in histogram.items():
        own = sorted((a, b) for length, a, b, *_ in slots if length == k)
        assert sum(b - a for a, b in own) == n and all(x[1] == y[0] for x, y in zip(own, own[1:], strict=False))
    assert windows <= 1.015 * fewest(histogram, 64)
    assert len(slots) < 2000


def check(rows, texts, capacity):
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for key, text in texts.items():
        ids, at = np.array(ids_of(text), "<u4"), 0
        for r in sorted(pieces[key], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]])
            at += r["length"]
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    return len(sequences)


@pytest.mark.parametrize("capacity", [16, 1024])
def test_pack(spark, capacity, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_ROWS", 7)
    rng = np.random.default_rng(capacity)
    texts = {k: " ".join(rng.choice(["the", "of", "packing", "x1"], rng.integers(0, 60))) for k in range(300)}
    texts |= {300: None, 301: "", 302: "word " * 9000, 303: "same", 304: "same", 305: "<|endoftext|>"}
    rows = packing.pack(documents(spark, list(texts.items())).repartition(5), capacity=capacity).collect()
    sequences = check(rows, texts, capacity)
    total = sum(len(ids_of(t)) for t in texts.values())
    assert sequences <= 1.01 * total / capacity + 2


def test_repeats_nulls_and_nothing(spark):
    rows = packing.pack(documents(spark, [(1, "a b"), (1, "a b"), (None, "c")])).collect()
    assert sorted((str(r["doc_id"]), r["length"]) for r in rows) == [("1", 3), ("1", 3), ("None", 2)]
    assert len({r["sequence_id"] for r in rows}) == 1 and {r["offset"] for r in rows} == {0, 3, 6}
    assert packing.pack(documents(spark, [])).count() == 0


@pytest.mark.parametrize("run", [" ", "\n", "\t", " \n"])
def test_a_million_white_spaces(run):
    text = "one" + run * (1_000_000 // len(run)) + "two"
    assert [*packing.encoder(*packing.tokenizer_paths())(text), 0] == ids_of(text)


def test_a_very_long_text_is_packed(spark):
    rows = [(1, "a" + " " * 1_000_000 + "b"), (2, "word " * 300_000), (3, "x" * 100_000)]
    got = packing.pack(documents(spark, rows)).collect()
    for k, _ in rows:
        own = sorted((r["start"], r["length"], r["doc_tokens"]) for r in got if r["doc_id"] == k)
        assert [s for s, *_ in own] == [sum(n for _, n, _ in own[:i]) for i in range(len(own))] and sum(n for _, n, _ in own) == own[0][2]
