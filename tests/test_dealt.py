"""Joins of hot keys by blocks against plain ones, and orders of hot keys in tiles."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from bidloom.operators import history, pairs, pools, segments, texts
from bidloom.operators.dealt import dealt_join, dealt_pairs


def keyed(spark, n, names, seed, hot=0.8):
    r = random.Random(seed)
    rows = [(None if r.random() < 0.03 else "hot" if r.random() < hot else r.choice("abcd"), i, r.randrange(50)) for i in range(n)]
    return spark.createDataFrame(rows, names).repartition(3)


@pytest.mark.parametrize(("n", "m", "block"), [(300, 200, 16), (300, 200, 10_000), (5, 90, 1), (0, 40, 8), (40, 0, 8)])
def test_dealt_join(spark, n, m, block):
    one, two = keyed(spark, n, "k string, x int, v int", 1), keyed(spark, m, "k string, y int, w int", 2)
    got = dealt_join(one, two, ["k"], ["x"], ["y"], block).select("k", "x", "v", "y", "w")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, one.join(two, "k").select("k", "x", "v", "y", "w").collect()))


@pytest.mark.parametrize("block", [7, 64, 10_000])
def test_dealt_pairs(spark, block):
    rows = keyed(spark, 240, "k string, x int, v int", 3).collect()
    got = dealt_pairs(spark.createDataFrame(rows, "k string, x int, v int"), ["k"], "x", ["v"], block)
    want = [(p.k, p.x, q.x, p.v, q.v) for p in rows for q in rows if p.k is not None and p.k == q.k and p.x < q.x]
    assert sorted(map(tuple, got.select("k", "a", "b", "v_a", "v_b").collect())) == sorted(want)


def test_a_hot_key_is_dealt(spark):
    """No task of the joins holds a key: the largest group of rows with equal join keys stays near a block."""
    rows = keyed(spark, 3000, "k string, x int, v int", 4)
    met = dealt_join(rows, rows.select("k", F.col("x").alias("y")), ["k"], ["x"], ["y"], 100).where("k = 'hot'")
    joins = [line for line in met._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
    assert any("_x" in line and "_y" in line for line in joins)
    assert met.count() == rows.where("k = 'hot'").count() ** 2


def test_alike_classes_of_a_hot_token(spark, monkeypatch):
    r = random.Random(5)
    rows = [("t" if r.random() < 0.9 else "u", i, ["all", *r.sample("abcdef", r.randint(0, 3))]) for i in range(120)]
    frame = spark.createDataFrame(rows, "t string, id int, w array<string>")
    whole = sorted(map(tuple, pairs.token_pairs(frame, ["t"], "id", "w", 6, 10).select("t", "a", "b", "common").collect()))
    monkeypatch.setattr(dealt_pairs, "__defaults__", (4,))
    assert whole == sorted(map(tuple, pairs.token_pairs(frame, ["t"], "id", "w", 6, 10).select("t", "a", "b", "common").collect()))
    assert whole == sorted((t, i, j, len(set(v) & set(w))) for t, i, v in rows for u, j, w in rows if t == u and i < j and 10 * len(set(v) & set(w)) >= 6 * len(set(v) | set(w)))


def test_checklist_of_one_tender(spark, monkeypatch):
    """Blocks of three rows give the matches of one block."""
    r = random.Random(6)
    word = lambda: " ".join(r.sample(["form", "gst", "bid", "cover", "note", "tax"], r.randint(1, 3)))
    items = spark.createDataFrame([("t", i, word(), r.choice("xy")) for i in range(25)] + [(None, 99, "form", "x"), ("t", 98, None, "x")], "tender_id string, item_id int, label string, wants_type string")
    files = spark.createDataFrame([("t", i % 7, i, word(), r.choice("xy")) for i in range(60)] + [("v", 1, 100, "form", "x")], "tender_id string, bidder_id int, doc_id int, filename string, doc_type string")
    want = sorted(map(tuple, texts.checklist_matches(items, files).collect()), key=str)
    assert len(want) == 25 * 7
    monkeypatch.setattr(texts.dealt_join, "__defaults__", (3,))
    assert want == sorted(map(tuple, texts.checklist_matches(items, files).collect()), key=str)


def test_checklist_compares_classes(spark):
    """Copies of items and documents add rows to the result, not to what is compared; the first of equal documents fits."""
    words = ["gst form", "bid form", "tax note", "cover", "GST"]
    items = spark.createDataFrame([("t", i, words[i % 5], "xy"[i % 2]) for i in range(200)] + [("t", 900, "gst form", None)], "tender_id string, item_id int, label string, wants_type string")
    files = spark.createDataFrame([("t", i % 3, 1000 - i, words[i % 4], "xy"[i // 4 % 2]) for i in range(240)], "tender_id string, bidder_id int, doc_id int, filename string, doc_type string")
    found = texts.checklist_matches(items, files)
    got = {(x.item_id, x.bidder_id): (x.doc_id, x.state) for x in found.collect()}
    want = {}
    for i in items.collect():
        for b in range(3):
            label, best = set(i.label.lower().split()), (0, 0)
            for d in files.where(f"bidder_id = {b}").collect() if (i.label, i.wants_type, b) not in want else []:
                common = len(label & set(d.filename.split()))
                score = round(common / len(label) + 0.3 * (i.wants_type == d.doc_type), 4) if common else 0
                best = max(best, (score, -d.doc_id)) if score >= 0.4 else best
            best = want.setdefault((i.label, i.wants_type, b), best)
            assert got[i.item_id, b] == ((-best[1], "present" if best[0] >= 0.7 else "partial") if best[0] else (None, "missing"))
    assert len(got) == 201 * 3 and found.count() == 201 * 3
    joins = [x for x in found._jdf.queryExecution().executedPlan().toString().splitlines() if "token#" in x and "Join" in x]
    assert joins
    sizes = found._jdf.queryExecution().optimizedPlan().toString()
    assert "min(item_id" in sizes and "min(doc_id" in sizes


@pytest.mark.parametrize(("before", "after", "size"), [(3, 3, 4), (0, 1, 2), (5, 0, 1), (2, 9, 4096)])
def test_framed_windows_are_those_of_whole_keys(spark, before, after, size):
    rows = keyed(spark, 200, "k string, x int, v int", 7)
    placed = segments.ranked(rows, ["k"], ["x"], "n")
    frame = lambda w: F.collect_list("v").over(w.rowsBetween(-before, after))
    got = segments.framed(placed, ["k"], "n", before, after, {"f": frame, "m": lambda w: F.sum("v").over(w.rowsBetween(-before, after))}, size)
    by = Window.partitionBy("k").orderBy("x")
    want = rows.select("*", F.row_number().over(by).cast("bigint").alias("n"), frame(by).alias("f"), F.sum("v").over(by.rowsBetween(-before, after)).alias("m"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_versions_revisions_contexts_and_instruments_of_a_hot_key(spark, monkeypatch):
    r = random.Random(8)
    monkeypatch.setattr(segments.framed, "__defaults__", (4,))
    made = [("hot" if r.random() < 0.9 else "a", i, r.choice([None, 1, 2, 3]), None if r.random() < 0.1 else i * 10) for i in range(150)]
    keys = {k for k, *_ in made}
    found = {(x.k, x.version): (x.f, x.valid_from, x.valid_to, x.is_current) for x in history.versions(spark.createDataFrame(made, "k string, at int, f int, start int"), ["k"], ["at"], ["f"], "start").collect()}
    want = {}
    for k in keys:
        own, last = [x for x in made if x[0] == k], None
        for n, (_, _, f, start) in enumerate(own):
            last = f if f is not None else last
            want[k, n + 1] = (last, start, own[n + 1][3] if n + 1 < len(own) else None, n + 1 == len(own))
    assert found == want

    bodies = [(k, i, r.choice(["x", "x ", "y", None]), r.choice(["ai", "o", None])) for k, i, *_ in made]
    found = {(x.k, x.at): (x.revision, x.body_before, x.body_after, x.authored_by) for x in history.revisions(spark.createDataFrame(bodies, "k string, at int, body string, author string"), ["k"], ["at"], "body", "author").collect()}
    want = {}
    for k in keys:
        before, n = None, 0
        for _, i, body, author in (x for x in bodies if x[0] == k):
            if before is None or (body is not None and before.strip(" ") != body.strip(" ")):
                n += 1
                want[k, i] = (n, before, body, "ai" if author == "ai" else "co-authored")
            before = body
    assert found == want

    found = {x.at: x.around for x in history.event_context(spark.createDataFrame(bodies, "k string, at int, body string, author string"), "k", "at", 3, F.col("author") == "ai").collect()}
    for k in keys:
        own = [x for x in bodies if x[0] == k]
        for n, x in enumerate(own):
            assert found.get(x[1]) == ([y[1] for y in own[max(0, n - 3) : n + 4]] if x[3] == "ai" else None)

    sold = [(k, f"DD-{r.randrange(400) + 10_000}", r.randrange(4)) for k, *_ in made] + [("hot", "none", 1), ("hot", None, 2)]
    found = sorted(map(tuple, pools.sequential_instruments(spark.createDataFrame(sold, "k string, number string, bidder int"), ["k"], "number", "bidder").collect()))
    want = []
    for k in keys:
        own = sorted((int(n[3:]), b) for q, n, b in sold if q == k and n and n != "none")
        want += [(k, b, c, m - n, "high" if m - n <= 2 else "medium") for (n, b), (m, c) in zip(own, own[1:]) if b != c and m - n <= 5]
    assert found == sorted(want)
