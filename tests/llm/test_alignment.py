"""Alignment of two tokenizers against all pairs of tokens."""

from __future__ import annotations

import collections
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from bidloom.llm import alignment

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
ODD = [None, "", "a", " ", "  a b  ", "x\r\ny;\r\n z", "a▁b c", "don't <|endoftext|> <s> </s> <0x0A>", "日本語 テスト 漢字", "\n\n\t a\x0b\x0c b", "é à ñ ß", "\U0001f600 x", "end ", "x" * 3000, "a\xa0b　c", "\r", " \r a", "\0 b", "漢" * 400, "word " * 4000, "a"]
PARTS = ["the ", "a", "tion", " of", "\n", "é", "\r", "日", "  ", "\t", "b", "1", "'s", "Z", "<s>", "qu"]


def plain(texts):
    """All columns by the libraries and all pairs of tokens."""
    to_a, to_b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    to_a.encode_special_tokens = True
    byte_of = alignment._byte_of()
    counted, rows = collections.Counter(), []
    for text in texts:
        whole = (" " + (text or "")).encode()
        ids = to_a.encode(" " + text, add_special_tokens=False).ids if text else [], to_b.encode(text) if text else []
        told = [bytes(byte_of[c] for c in to_a.id_to_token(i)) for i in ids[0]], [bytes([int(to_b.id_to_piece(i)[3:5], 16)]) if to_b.is_byte(i) else to_b.id_to_piece(i).replace("▁", " ").encode() for i in ids[1]]
        if any(b"".join(x) != whole for x in told):
            rows.append(None)
            continue
        ends = [np.cumsum([len(x) for x in own]) for own in told]
        starts = [e - [len(x) for x in own] for e, own in zip(ends, told, strict=True)]
        near = (starts[0][:, None] < ends[1]) & (starts[1] < ends[0][:, None])
        links = [(ids[0][i], ids[1][j]) for i, j in np.argwhere(near).tolist()]
        counted.update(links)
        groups, i, j = [], 0, 0
        for end in sorted(set(ends[0].tolist()) & set(ends[1].tolist())):
            x, y = int(np.searchsorted(ends[0], end)) + 1, int(np.searchsorted(ends[1], end)) + 1
            groups.append((ids[0][i:x], ids[1][j:y]))
            i, j = x, y
        rows.append((ids, groups, links))
    most = collections.defaultdict(int)
    for (_, b), n in counted.items():
        most[b] = max(most[b], n)
    out = []
    for row in rows:
        if row is None:
            out.append((0, 0, 0, 0, 0, 0, "", []))
            continue
        ids, groups, links = row
        sha = hashlib.sha256(";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups).encode()).hexdigest()
        out.append((len(ids[0]), len(ids[1]), len(groups), len(links), sum(counted[x] == most[x[1]] for x in links), sum(counted[x] for x in links), sha, groups))
    return out


def made(seed: int, n: int = 60) -> list[str]:
    r = random.Random(seed)
    return ["".join("▁" if r.random() < 0.002 else r.choice(PARTS) for _ in range(r.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize(("most_pairs", "part"), [(alignment.MOST_PAIRS, 64), (0, 64), (alignment.MOST_PAIRS, 1)])
def test_digest(spark, monkeypatch, most_pairs, part):
    """Both places of the counts, and lists in parts of any size."""
    monkeypatch.setattr(alignment, "PART", part)
    texts = ODD + made(most_pairs % 7 + part)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: tuple(r)[1:] for r in alignment.digest(df, A, B, most_pairs=most_pairs).collect()}
    assert [found[i] for i in range(len(texts))] == [x[:-1] for x in plain(texts)]


def test_links_are_tokens_less_groups(spark):
    df = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    for r in alignment.digest(df, A, B).collect():
        assert r["n_links"] == r["n_a"] + r["n_b"] - r["n_groups"] and r["n_best"] <= r["n_links"] <= r["count_sum"]


def test_groups(spark):
    texts = ODD + made(5, 20)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: [(list(g["a"]), list(g["b"])) for g in r["groups"]] for r in alignment.align(df, A, B).collect()}
    assert [found[i] for i in range(len(texts))] == [x[-1] for x in plain(texts)]


def test_gallop():
    r = random.Random(8)
    for _ in range(100):
        short, long = (np.array(sorted(r.sample(range(200), r.randint(1, 60)))) for _ in range(2))
        x, y = alignment.gallop(short, np.array([0]), np.array([len(short)]), long, np.array([0]), np.array([len(long)]))
        assert short[x].tolist() == long[y].tolist() == sorted(set(short.tolist()) & set(long.tolist()))


def test_nulls_repeats_clashes_and_nothing(spark):
    df = spark.createDataFrame([(None, None, 1, "x"), (4, "a b", 2, "y"), (4, "a b", 2, "y"), (None, "a b", 3, "z")], "doc_id long, text string, row int, n_a string")
    for most in (alignment.MOST_PAIRS, 0):
        found = sorted((r["doc_id"] or 0, r["n_a"], r["count_sum"]) for r in alignment.digest(df, A, B, most_pairs=most).collect())
        assert found == [(0, 0, 0), (0, 2, 6), (4, 2, 6), (4, 2, 6)]
        assert alignment.digest(df.limit(0), A, B, most_pairs=most).count() == 0
