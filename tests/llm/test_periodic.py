"""Periodic runs against a search of all periods."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from bidloom.llm import periodic
from bidloom.llm.common import mix


def plain_runs(w: list) -> list[tuple[int, int, int]]:
    """(start, period, length) of all runs, by start and period."""
    out, n = [], len(w)
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(12, 2 * q) and not any(all(w[k] == w[k + p] for k in range(i, i + size - p)) for p in range(1, q)):
                out.append((i, q, size))
            i = max(j, i + 1)
    return sorted(out)


def plain_row(doc_id, text) -> tuple:
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = plain_runs(w)
    dropped = {k for s, q, size in runs for k in range(s + q, s + size)}
    best = min(runs, key=lambda x: (-x[2], x[0], x[1]), default=None)
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{size},{q}\n" for s, q, size in runs), " ".join(x for k, x in enumerate(w) if k not in dropped))]
    top = (best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else (None,) * 4
    return (doc_id, len(runs), *top, *sha)


def made(r: random.Random, most: int = 150) -> list[int]:
    n, kinds = r.randint(0, most), r.choice([1, 2, 2, 3, 5])
    w = [r.randrange(kinds) for _ in range(n)]
    if n > 30 and r.random() < 0.6:
        p, a = r.randint(1, n // 3), r.randrange(n)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


@pytest.mark.parametrize(("tile", "part"), [(4096, 1 << 18), (16, 8), (1, 1)])
def test_tiles_give_all_fragments(monkeypatch, tile, part):
    monkeypatch.setattr(periodic, "TILE", tile)
    monkeypatch.setattr(periodic, "PART", part)
    r = random.Random(tile)
    for _ in range(150):
        texts = [made(r) for _ in range(r.randint(1, 3))]
        of = np.cumsum([0, *map(len, texts)])
        code = np.array(sum(texts, []), np.int64)
        for w, tiles in zip(texts, periodic.tiles_of(code, mix(code.astype(np.uint64) + np.uint64(9)), of), strict=True):
            equal = {(q, i) for t in tiles for q, a, b in periodic.solve(t["octave"], t["first"], t["begin"], t["finish"], np.frombuffer(t["words"], "<i4").tolist()) for i in range(a, b)}
            assert all(w[i] == w[i + q] for q, i in equal)
            assert equal >= {(q, i) for s, q, size in plain_runs(w) for i in range(s, s + size - q)}


def test_z_function():
    r = random.Random(1)
    for _ in range(100):
        s = [r.randrange(2) for _ in range(r.randint(1, 30))]
        z = periodic.z_function(s, len(s))
        for i in range(1, len(s)):
            assert z[i] == next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i)


def test_digest(spark):
    r = random.Random(11)
    texts = [" ".join(f"w{x}" for x in made(r)) for _ in range(120)] + [None, "", " \n", "é " * 11, "é " * 12, "a b c " * 900, "\tx\x0by\x0c" * 7, "a\xa0b " * 13, "same " * 3000]
    ids = [next(i for i in range(10**6) if (zlib.crc32(str(i).encode()) % 10 == 0) == (k % 3 == 0) and i % 1009 == k) for k in range(len(texts))]
    rows = [(i, t, k, "x") for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    df = spark.createDataFrame(rows, "doc_id long, text string, row int, runs string")
    found = {r["doc_id"]: tuple(r) for r in periodic.digest(df, periodic.planted()).collect()}
    for i, t, _, _ in rows[:-1]:
        assert found[i] == plain_row(i, t)
    assert found[ids[-1]][1:6] == (1, 0, 3000, 1, 3000000)


def test_repeats_nulls_and_nothing(spark):
    text = "a b " * 20
    df = spark.createDataFrame([(None, text), (5, text), (5, text), (None, None), (5, "c")], "doc_id long, text string")
    found = sorted(tuple(r)[:2] if r["doc_id"] else (0, r["n_runs"]) for r in periodic.digest(df, periodic.planted()).collect())
    assert found == [(0, 0), (0, 1), (5, 0), (5, 1), (5, 1)]
    assert periodic.digest(df.limit(0), periodic.planted()).count() == 0
    runs = [(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]]) for r in periodic.runs_of(df).where("doc_id = 5").collect()]
    assert sorted(runs, key=str) == [(5, 1, []), (5, 40, [(0, 2, 40)]), (5, 40, [(0, 2, 40)])]


def test_texts_of_several_slices(spark):
    """A batch of more bytes than a slice has, with and without runs."""
    r = random.Random(8)
    rows = [(i, " ".join(f"{r.randrange(10**6)}" for _ in range(9000)) + " x y" * (i % 3 * 8)) for i in range(60)]
    found = {r["doc_id"]: tuple(r) for r in periodic.digest(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), periodic.planted()).collect()}
    for i, text in rows:
        if zlib.crc32(str(i).encode()) % 10:
            w = text.split()
            n = 16 * (i % 3)
            sha = hashlib.sha256(" ".join(w[: len(w) - n + 2] if n else w).encode()).hexdigest()
            assert (found[i][1], found[i][7]) == (int(n > 0), sha)


def test_words_of_one_long_text_are_spread(spark):
    """Tiles of one text go to several tasks."""
    from pyspark.sql import functions as F

    r = random.Random(3)
    text = " ".join(" ".join(f"{k}x{r.randrange(9)}" for k in range(20)) + " " + " ".join(["p", "q", "r"] * 9) for _ in range(300))
    exploded = periodic.explode(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    tiles = exploded.select("row", F.explode("tiles").alias("t")).select("row", "t.*")
    assert tiles.repartition(4, "row", "octave", "first").select(F.spark_partition_id().alias("p")).distinct().count() == 4
