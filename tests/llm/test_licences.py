import re

import numpy as np
import pytest

from cloudgauge.llm import licences
from cloudgauge.llm.licences import BASE, NOTICES, TEXTS as WHOLE, Template, scan_licences
from tests.llm.tools import documents

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}


def base(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    places = [(k, label) for label, p in PHRASES.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
    return len(words), sorted(places)


TEXTS = [
    None, "", "no licence here", "The MIT License", "MIT\n-- license mit-LICENSE", "mit lïcense", "permit license", "Apache  License,\tVersion 2.0; and GNU General Public License version 2",
    "mit " * 3000 + "license", "license mit general license public license", "GENERAL PUBLIC\x00LICENSE", "é mit license é", "1mit license", "mit license2", "word " * 50_000 + "general public license",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
    "Licensed under CC BY-NC 4.0.", "cc by", "Permission to use, copy, modify, and distribute",
]


def test_base_places(spark):
    rows = list(enumerate(TEXTS))
    got = {r["doc_id"]: r for r in scan_licences(documents(spark, [*rows, (None, "mit license"), (1, "")])).collect() if r["doc_id"] != 1}
    for k, text in rows:
        if k != 1:
            n, places = base(text)
            assert got[k]["n_words"] == n
            assert sorted((m["first_word"], m["label"]) for m in got[k]["matches"] if m["base"]) == places, text[:50]
    labels = {k: {m["label"] for m in r["matches"]} for k, r in got.items()}
    assert labels[7] == {"apache", "apache-2.0", "gpl", "gpl-2"} and "gpl-text" in labels[15] and labels[16] == {"cc-by-nc"} and labels[17] == set() and labels[None] == {"mit"}


def test_partial_notice_needs_its_key_phrase(spark):
    text = NOTICES[0].text.split()
    whole, broken, cut = " ".join(text), " ".join(["foo" if k == 0 or w == "deal" else w for k, w in enumerate(text)]), " ".join(text[:12])
    got = {r["doc_id"]: [(m["label"], m["first_word"], m["share"]) for m in r["matches"]] for r in scan_licences(documents(spark, [(1, f"x y {whole}"), (2, broken), (3, cut)])).collect()}
    assert got[1] == [("mit-text", 2, 1.0)] and got[2] == []
    assert got[3] == []


def test_whole_texts_with_edits(spark):
    rows = []
    for k, t in enumerate(WHOLE):
        lines = t.text.split("\n")
        rows += [(2 * k, "/*\n * " + "\n * ".join(lines) + "\n */ code()"), (2 * k + 1, "\n".join([lines[0], "Copyright (c) 2020 Some Body", *lines[1:-1]]))]
    got = {r["doc_id"]: {m["label"]: m["share"] for m in r["matches"]} for r in scan_licences(documents(spark, rows)).collect()}
    for k, t in enumerate(WHOLE):
        assert got[2 * k][t.label] == 1.0
        assert t.label not in got[2 * k + 1]  # a key phrase of the last part is missing
    middle = WHOLE[0].text.replace("subject to the following conditions:", "subject to conditions (c) 2020 Some Body:")
    (row,) = scan_licences(documents(spark, [(1, f"{middle} {WHOLE[0].text}")])).collect()
    assert [m["share"] > 0.9 for m in row["matches"] if m["label"] == "mit-full"] == [True, True]


def test_key_phrases_against_a_plain_search():
    rng = np.random.default_rng(3)
    own = tuple(Template(f"t{k}", " ".join(rng.choice(list("abcd"), 6)), ()) for k in range(12))
    own = tuple(Template(t.label, t.text, (t.text[: 2 * n - 1],)) for t, n in zip(own, rng.integers(1, 7, 12), strict=True))
    index = licences.Index(own, {w: float(k) for k, w in enumerate("dbac")})
    for _ in range(50):
        words = [w.encode() for w in rng.choice(list("abcde"), rng.integers(0, 60))]
        want = {(k, at) for k, t in enumerate(own) for at in range(len(words)) if words[at : at + len(key := t.keys[0].encode().split())] == key}
        assert {(k, at) for k, at, _ in index.scan(words)} == want


def test_every_template_finds_itself(spark):
    rows = list(enumerate(t.text for t in BASE + NOTICES + WHOLE))
    for r in scan_licences(documents(spark, rows)).collect():
        assert (BASE + NOTICES + WHOLE)[r["doc_id"]].label in {m["label"] for m in r["matches"] if m["share"] == 1.0}


def test_own_templates_and_empty(spark):
    own = (Template("a", "b b", ("b b",), True),)
    got = scan_licences(documents(spark, [(1, "b b b")]), own).first()
    assert [(m["label"], m["first_word"]) for m in got["matches"]] == [("a", 0), ("a", 1)]
    assert scan_licences(documents(spark, [])).count() == 0


@pytest.mark.parametrize("column", ["n_base", "first_word", "last_word", "base_labels"])
def test_query(spark, column):
    d = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    for r in licences.op7_rare_token_index(spark, d).collect():
        _, places = base(texts[r["doc_id"]])
        want = {"n_base": len(places), "first_word": places[0][0] if places else None, "last_word": places[-1][0] if places else None, "base_labels": ",".join(sorted({p for _, p in places}))}
        assert r[column] == want[column]


def test_key_phrases_are_mandatory(spark):
    templates = BASE + NOTICES + WHOLE
    rows = [(n, f"x y {key} z") for n, key in enumerate(k for t in templates for k in t.keys)]
    want = [(t.label, len(t.keys)) for t in templates for _ in t.keys]
    got = {r["doc_id"]: {m["label"] for m in r["matches"]} for r in scan_licences(documents(spark, rows)).collect()}
    assert all((label in got[n]) == (keys == 1) for n, (label, keys) in enumerate(want))


def test_rare_words_lead_and_positions_decide():
    own = (Template("a", "the software is provided as is", ("the software is provided as is",)),)
    text = "the software is the software is provided as is the".split() * 50
    words = [w.encode() for w in text]
    want = [10 * k + 3 for k in range(50)]
    idf = {"the": 0.1, "software": 0.5, "is": 0.1, "provided": 5.0, "as": 2.0}
    rare = licences.Index(own, idf)
    common = licences.Index(own, {"the": 5.0, "software": 0.5, "is": 4.0, "provided": 0.1, "as": 0.2})
    assert rare.phrases_in(words) == common.phrases_in(words) == {0: want}
    assert list(rare.postings) == [b"provided"] and rare.looked < common.looked
    absent = licences.Index(own, idf)
    assert absent.phrases_in([w for w in words if w != b"provided"]) == {} and absent.looked == 0
    rare.postings[b"provided"] = [(0, 2)]  # a wrong position of the word looked up, then of another
    assert rare.phrases_in(words) == {}
    rare = licences.Index(own, idf)
    rare.others[0][0] = (rare.others[0][0][0], rare.others[0][0][1] + 1)
    assert rare.phrases_in(words) == {}


def test_a_very_long_text(spark):
    text = "the software is " * 500_000 + "MIT License " + "license " * 300_000
    (row,) = scan_licences(documents(spark, [(1, text)])).collect()
    assert row["n_words"] == 1_800_002 and [(m["label"], m["first_word"]) for m in row["matches"] if m["base"]] == [("mit", 1_500_000)]
