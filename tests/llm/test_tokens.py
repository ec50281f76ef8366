"""BPE and packing against the libraries themselves."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from bidloom.llm import bpe, packing

RANKS, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")
ODD = [None, "", " ", "\n\n", "a", "é à", "x" * 5000, "a  b\t\nc 　d\x85 e", "don't stop", "日本 語 " * 30, "<|endoftext|> x", "\U0001f600 \U0001f600", "word " * 3000]
SCHEMA = "doc_id long, text string, ids string, length int, extra int"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1, None) for i, t in enumerate(texts)], SCHEMA)


@settings(max_examples=60, deadline=None)
@given(texts=st.lists(st.text(alphabet="ab é \n\t　1'!日\x1c\x85\xa0", max_size=20), min_size=1, max_size=4))
def test_pieces_give_the_texts_ids(texts):
    encoding = bpe.rank_encoding(RANKS, P.PATTERN)[0]
    ids, at = bpe.ids_of(pa.array(texts), RANKS, P.PATTERN)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [encoding.encode_ordinary(t) for t in texts]


def test_round_trip(spark):
    encoding = bpe.rank_encoding(RANKS, P.PATTERN)[0]
    found = {r["doc_id"]: r for r in bpe.round_trip(frame(spark, ODD), RANKS, P.PATTERN).collect()}
    assert len(found) == len(ODD)
    for i, t in enumerate(ODD):
        ids = encoding.encode_ordinary(t or "")
        assert found[i]["n_tokens"] == len(ids)
        assert found[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert found[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_encode_then_decode(spark):
    back = bpe.decode(bpe.encode(frame(spark, ODD), RANKS, P.PATTERN), RANKS, P.PATTERN)
    assert {r["doc_id"]: bytes(r["raw"]) for r in back.collect()} == {i: (t or "").encode() for i, t in enumerate(ODD)}
    assert bpe.encode(frame(spark, ODD).limit(0), RANKS, P.PATTERN).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_every_piece(seed):
    r = random.Random(seed)
    histogram = {r.randint(1, 64): r.randint(1, 40) for _ in range(r.randint(1, 30))}
    patterns = packing.plan(dict(histogram), 64)
    placed: dict[int, int] = {}
    for pattern, count in patterns:
        assert sum(pattern) <= 64
        for x in pattern:
            placed[x] = placed.get(x, 0) + count
    assert placed == histogram
    total = sum(k * n for k, n in histogram.items())
    assert sum(n for _, n in patterns) * 64 <= 2 * total + 64


def test_packing(spark):
    texts = [*ODD, *ODD]
    found = packing.pack_documents(frame(spark, texts), JSON, max_tokens=64).collect()
    tokenizer = Tokenizer.from_file(JSON)
    ids = [tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for t in texts]
    by_document: dict[int, list] = {}
    by_sequence: dict[int, list] = {}
    for row in found:
        by_document.setdefault(row["doc_id"], []).append(row)
        by_sequence.setdefault(row["sequence_id"], []).append(row)
    for i, own in enumerate(ids):
        pieces = sorted(by_document[i], key=lambda p: p["start"])
        assert [p["start"] for p in pieces] == list(np.cumsum([0, *(p["length"] for p in pieces)])[:-1])
        assert sum(p["length"] for p in pieces) == len(own) == pieces[0]["doc_tokens"]
        for p in pieces:
            assert zlib.crc32(np.array(own[p["start"] : p["start"] + p["length"]], "<u4").tobytes()) == p["ids_crc32"]
    for pieces in by_sequence.values():
        pieces.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in pieces] == list(np.cumsum([0, *(p["length"] for p in pieces)])[:-1])
        assert sum(p["length"] for p in pieces) <= 64


def test_special_strings_are_the_librarys(spark):
    """Ids are those of the library with its defaults, also where a text holds a special token's string, beside white space or not."""
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y", "<|endoftext|>\n<|endoftext|> <|endo", "é <|endoftext|>é"]
    plain = Tokenizer.from_file(JSON)
    ids, at = packing.token_ids(pa.array(texts), JSON)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids[: at[1]].tolist() == [64, 220, 50256, 275]


def test_packing_nothing(spark):
    assert packing.pack_documents(frame(spark, ["x"]).limit(0), JSON).count() == 0


@pytest.mark.parametrize("most", [3, 40, bpe.KNOWN_PIECES])
def test_known_pieces_give_the_same_ids(monkeypatch, most):
    """Slice after slice, whatever number of pieces is kept, ids are the library's."""
    monkeypatch.setattr(bpe, "KNOWN_PIECES", most)
    packing.known.cache_clear()
    r, plain = random.Random(most), Tokenizer.from_file(JSON)
    for _ in range(8):
        texts = ["".join(r.choice(["the ", "a", " of", "\n", "é", "日", "  ", "<|endoftext|>", "1", "'s"]) for _ in range(r.randint(0, 30))) for _ in range(12)] + [None, ""]
        ids, at = packing.token_ids(pa.array(texts), JSON)
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
    packing.known.cache_clear()
