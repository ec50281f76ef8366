"""Licence scans against plain searches."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from bidloom.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
COLUMNS = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def lowered(text: str | None) -> list[str]:
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def base(text: str | None) -> tuple:
    own = lowered(text)
    places = [(i, label) for phrase, label in licenses.BASE for n in [len(phrase.split())] for i in range(len(own) - n + 1) if own[i : i + n] == phrase.split()]
    at = [i for i, _ in places]
    return len(own), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def scanned(texts: list[str | None], scanner=None) -> list[dict]:
    found = [c.to_pylist() for c in (scanner or licenses.scanner()).scan(pa.array(texts, pa.string()))]
    return [dict(zip([*COLUMNS, "spans"], row, strict=True)) for row in zip(*found, strict=True)]


NOTICE = dict((label, text) for label, text in licenses.NOTICES)


@pytest.mark.parametrize("tile", [2048, 5])
def test_base_places_are_those_of_a_plain_search(monkeypatch, tile):
    monkeypatch.setattr(licenses, "TILE", tile)
    r = random.Random(4)
    parts = ["gnu", "general", "public", "license", "License,", "APACHE", "mit", "cc", "CC-BY", "by", "é", "x", "4.0", "licensed under the", "\n", "日本", "gnu general public license", "İ"]
    texts = [" ".join(r.choice(parts) for _ in range(r.randint(0, 60))) for _ in range(300)] + [None, "", "  ", "mit license", "cc by " * 5000]
    for text, row in zip(texts, scanned(texts), strict=True):
        assert (row["n_words"], row["n_base"], row["first_word"], row["last_word"], row["base_labels"]) == base(text)
        assert set(filter(None, row["base_labels"].split(","))) <= set(row["labels"].split(",")) and 0 <= row["score"] <= 1


@pytest.mark.parametrize("tile", [2048, 3])
def test_statistics_are_the_longest_suffixes(monkeypatch, tile):
    monkeypatch.setattr(licenses, "TILE", tile)
    r = random.Random(6)
    for _ in range(60):
        templates = [[bytes([97 + r.randrange(3)]) for _ in range(r.randint(1, 12))] for _ in range(r.randint(1, 5))]
        auto = licenses.build(templates, 1)
        held = {tuple(t[i:j]) for t in templates for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
        texts = [[bytes([97 + r.randrange(4)]) for _ in range(r.randint(0, 40))] for _ in range(3)]
        of = np.cumsum([0, *map(len, texts)])
        _, matched = licenses.statistics(auto, np.array([auto.vocabulary.get(w, -1) for t in texts for w in t], np.int64), of, 1)
        for t, a in zip(texts, of.tolist(), strict=False):
            for i in range(len(t)):
                assert matched[a + i] == max((n for n in range(1, i + 2) if tuple(t[i + 1 - n : i + 1]) in held), default=0)


def test_places_of_a_state():
    words = [list("abcab"), list("bcb"), list("abc")]
    auto = licenses.build([[w.encode() for w in t] for t in words], 0)
    flat = [w for t in words for w in t]
    for s in range(1, len(auto.link)):
        ends = auto.ends[auto.enter[s] : auto.leave[s]].tolist()
        n = int(auto.length[s])
        assert ends and len({tuple(flat[e - n + 1 : e + 1]) for e in ends}) == 1


@pytest.mark.parametrize("label", sorted(NOTICE))
def test_notices_are_found_whole_and_with_changes(label):
    text = "some words before.\n" + NOTICE[label] + "\nand after"
    own = scanned([text, text + "\n\n" + text])
    assert label in own[0]["labels"].split(",") and own[0]["score"] == 1
    size = len(lowered(NOTICE[label]))
    assert any(x["label"] == label and x["start"] == 3 and x["end"] == 3 + size and x["covered"] == size for x in own[0]["spans"])
    assert sum(x["label"] == label and x["share"] == 1 for x in own[1]["spans"]) >= 2
    if size > 30:
        words = NOTICE[label].split()
        words[size // 3] = "changedword"
        words.insert(2 * size // 3, "put in here")
        assert label in scanned([" ".join(words)])[0]["labels"].split(",")


def test_plain_texts_have_no_label():
    rows = scanned(["the license of the work is under the terms and conditions of any kind", "copyright notice", "as is"])
    assert [r["labels"] for r in rows] == ["", "", ""] and [r["score"] for r in rows] == [0, 0, 0]


def test_chains_are_in_order_and_near():
    assert licenses.chains([(0, 0, 5), (6, 6, 5), (12, 12, 4)]) == [[(0, 0, 5), (6, 6, 5), (12, 12, 4)]]
    assert licenses.chains([(0, 6, 5), (6, 0, 5)]) == [[(0, 6, 5)], [(6, 0, 5)]]
    far = licenses.GAP + 6
    assert licenses.chains([(0, 0, 5), (far, 6, 5)]) == [[(0, 0, 5)], [(far, 6, 5)]]
    r = random.Random(2)
    for _ in range(200):  # the best chain, against all orders
        anchors = sorted({(r.randrange(30), r.randrange(30), r.randint(1, 6)) for _ in range(r.randint(1, 8))})
        best = [0] * len(anchors)
        for i, (a, b, n) in enumerate(anchors):
            best[i] = n + max([best[j] for j in range(i) if anchors[j][0] + anchors[j][2] <= a and anchors[j][1] + anchors[j][2] <= b], default=0)
        found = licenses.chains(anchors)
        assert sum(n for _, _, n in found[0]) == max(best) and sorted(x for c in found for x in c) == anchors


def test_frame(spark):
    rows = [(1, "Released under the MIT License.", 7, "x"), (1, "Released under the MIT License.", 7, "x"), (None, None, None, None), (3, "", 1, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words int, labels string")
    found = licenses.scan(df).collect()
    assert sorted((r["doc_id"] or 0, r["labels"], r["n_words"]) for r in found) == [(0, "", 0), (1, "mit,mit-license", 5), (1, "mit,mit-license", 5), (3, "", 0)]
    assert licenses.scan(df.limit(0)).count() == 0
