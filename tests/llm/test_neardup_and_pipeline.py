"""Near-duplicate groups against all pairs; the pipeline's stages against their own rules."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from bidloom.llm import components, neardup
from tests.conftest import SMALL


def brute(rows, n, part, whole):
    """Components by comparing all pairs of (id, text)."""
    sets = []
    for _, text in rows:
        words = (text or "").lower().split()
        sets.append({tuple(words)} if 0 < len(words) < n else {tuple(words[i : i + n]) for i in range(len(words) - n + 1)})
    group = list(range(len(rows)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            same = sets[i] and sets[j] and whole * len(sets[i] & sets[j]) >= part * len(sets[i] | sets[j])
            if same or rows[i][0] == rows[j][0] and sets[i] and sets[j]:
                a, b = sorted((top(i), top(j)))
                group[b] = a
    least: dict[int, int] = {}
    for i, (key, _) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), key), key)
    return sorted((key, len(sets[i]), least[top(i)]) for i, (key, _) in enumerate(rows))


def corpus(seed, groups=12, copies=9):
    r = random.Random(seed)
    word = lambda: f"w{r.randint(0, 3000)}"
    texts = []
    for _ in range(groups):
        base = [word() for _ in range(r.choice([4, 30, 120, 400]))]
        for _ in range(copies):
            own = list(base)
            for _ in range(int(len(own) * r.choice([0, 0.01, 0.03, 0.05]))):
                own[r.randrange(len(own))] = word()
            texts.append(" ".join(own))
    texts += ["", None, "one", "One", "two words", " ", texts[0].upper(), "\t" + texts[0]]
    return [(i * 3 % 1000, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("seed", "n", "part"), [(1, 3, 85), (2, 5, 80)])
def test_groups_equal_all_pairs(spark, seed, n, part):
    rows = corpus(seed)
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit(0))
    found = neardup.near_duplicates(frame, n, part, 100).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == brute(rows, n, part, 100)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


def test_odd_rows(spark):
    rows = [(5, "a b c d"), (5, "a b c d"), (None, "a b c d"), (None, "x y z"), (None, None), (7, "a b c d"), (8, "q q q q"), (8, "r r r r"), (9, "q q q q")]
    found = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3).collect()), key=str)
    assert found == sorted([(5, 5, True), (5, 5, True), (7, 5, False), (8, 8, True), (8, 8, True), (9, 8, False), (None, 5, False), (None, None, True), (None, None, True)], key=str)
    kept = neardup.keep_one(spark.createDataFrame(rows, "doc_id long, text string").withColumn("_row_key", F.lit(1)), 3)
    assert kept.columns == ["doc_id", "text", "_row_key"] and kept.count() == 4
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_components(spark, seed):
    r = random.Random(seed)
    links = [(r.randint(0, 60), r.randint(0, 60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)] + [(None, 1), (3, 3)]
    label = {x: x for e in links if None not in e for x in e}
    for _ in label:
        for a, b in links:
            if a is not None:
                label[a] = label[b] = min(label[a], label[b])
    found = {x["id"]: x["component"] for x in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {k: v for k, v in label.items() if k != v}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_crowded_regions(spark):
    """One large group whose members differ a little: no member is lost."""
    r = random.Random(3)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(400):
        own = list(base)
        for _ in range(2):
            own[r.randrange(150)] = f"v{r.randint(0, 10**6)}"
        rows.append((i, " ".join(own)))
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85, 100)
    assert [(x["doc_id"], x["component_id"]) for x in found.orderBy("doc_id").collect()] == [(a, c) for a, _, c in brute(rows, 3, 85, 100)]


def near_threshold():
    """Texts of one family, most pairs of them just under the threshold, and some just over it."""
    r = random.Random(5)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(400):
        own = list(base)
        for _ in range(5):
            own[r.randrange(300)] = f"v{r.randint(0, 10**6)}"
        rows.append((i, " ".join(own)))
        if i % 2:
            at = next(k for k in range(300) if rows[i - 1][1].split()[k] != base[k])
            own[at] = rows[i - 1][1].split()[at]
            rows[i] = (i, " ".join(own))
    return rows


def test_near_threshold(spark):
    """Pairs that fail don't hide those that hold."""
    rows = near_threshold()
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85, 100)
    assert [(x["doc_id"], x["component_id"]) for x in found.orderBy("doc_id").collect()] == [(a, c) for a, _, c in brute(rows, 3, 85, 100)]


def test_stages(spark):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    total = docs.count()
    for name, stage in pipeline.STAGES[:-1]:
        after = stage(spark, docs, SMALL)
        after = after.select(*after.columns).persist()
        assert after.columns == docs.columns and after.dtypes == docs.dtypes, name
        assert 0.5 * total < after.count() <= docs.count(), name
        if name == "near_duplicates":
            assert sorted(x["doc_id"] for x in after.select("doc_id").collect()) == sorted({c for _, _, c in brute([(x["doc_id"], x["text"]) for x in docs.collect()], 5, 80, 100)})
        if name == "secret_scan":
            from bidloom.llm import secrets

            assert not [x for x in after.select("text").collect() if secrets.scan(x["text"])[1]]
            assert after.where("n_chars <> length(text)").count() == 0
        docs = after
    packed = pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert packed.select("doc_id").distinct().count() == docs.count()


def test_stages_take_odd_rows(spark):
    import corpus_pipeline as pipeline

    schema = spark.read.parquet(f"{SMALL}/documents.parquet").schema
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", None, None, None), (2, "a b " * 50, "en", None, 3), (2, "a b " * 50, "en", None, 3)], schema)
    for frame in (odd, odd.limit(0)):
        for _, stage in pipeline.STAGES:
            stage(spark, frame, SMALL).collect()
