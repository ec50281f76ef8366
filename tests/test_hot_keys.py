"""Logs, versions, streams and pools where one key holds most rows."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from bidloom.operators import history, pools, workflow
from bidloom.sources.shared import new_path
from bidloom.streaming import logs

ARGS = ("tender_id", "id", "event_type", "event_data", "actor", "at")


def log(spark, n=600, seed=1):
    """Events of which nine in ten are of one tender."""
    r = random.Random(seed)
    return spark.createDataFrame([(1 if r.random() < 0.9 else r.randint(2, 9), i, "made", f"d{i}", i % 3, f"t{i}") for i in range(n)], "tender_id long, id long, event_type string, event_data string, actor int, at string")


def plain_breaks(rows) -> dict:
    out, before = {}, {}
    for x in sorted(rows, key=lambda x: x["id"]):
        k = x["tender_id"]
        own = out.setdefault(k, [0, None, None])
        own[0] += 1
        kind = "link" if x["prev_hash"] != before.get(k, history.GENESIS) else "content" if x["entry_hash"] != logs_hash(x) else None
        if kind and own[1] is None:
            own[1], own[2] = x["id"], kind
        before[k] = x["entry_hash"]
    return {k: tuple(v) for k, v in out.items()}


def logs_hash(x) -> str:
    import hashlib

    return hashlib.sha256("|".join([x["prev_hash"], x["event_type"], x["event_data"] or "", str(x["actor"]), x["at"]]).encode()).hexdigest()


@pytest.mark.parametrize("edit", ["id = -1", "id = 300", "id in (7, 410)", "id % 50 = 3"])
def test_chains_are_checked_in_segments(spark, edit):
    chain = history.chained(log(spark), *ARGS)
    edited = chain.withColumn("event_data", F.when(F.expr(edit), "changed").otherwise(F.col("event_data"))).where("id <> 501")
    found = {r["tender_id"]: (r["events"], r["first_break"], r["kind"]) for r in history.chain_breaks(edited, *ARGS).collect()}
    assert found == plain_breaks(edited.collect())


def stream_of(spark, batches, name):
    """A stream that gets each table as a batch of its own."""
    path = new_path(spark, name)
    for i, rows in enumerate(batches):
        rows.coalesce(1).write.mode("append").option("maxRecordsPerFile", 0).parquet(f"{path}/{i:03}")
    return spark.readStream.schema(batches[0].schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)


def test_chains_go_on_over_batches(spark, monkeypatch):
    monkeypatch.setattr(logs, "GATHER", 2)  # tails are gathered often
    rows = log(spark, 200)
    parts = [rows.where(f"id >= {a} and id < {a + 40}") for a in range(0, 200, 40)]
    found = logs.chain_stream(stream_of(spark, parts, "in"), new_path(spark, "chain"))
    whole = history.chained(rows, *ARGS)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, whole.select("tender_id", "id", "prev_hash", "entry_hash").collect()))
    edited = whole.withColumn("event_data", F.when(F.col("id").isin(3, 40, 150), "changed").otherwise(F.col("event_data"))).withColumn("prev_hash", F.when(F.col("id") == 120, "x").otherwise(F.col("prev_hash")))
    parts = [edited.where(f"id >= {a} and id < {a + 40}") for a in range(0, 200, 40)]
    broken = logs.verify_stream(stream_of(spark, parts, "in"), new_path(spark, "breaks"))
    assert sorted(map(tuple, broken.select("id", "kind").collect())) == [(3, "content"), (40, "content"), (120, "link"), (150, "content")]


def test_a_batch_of_tails_run_again_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(logs, "GATHER", 2)
    tails = logs.Tails(spark, new_path(spark, "tails"), "k", "long")
    for batch in (0, 1, 1, 2, 2, 3, 3):
        was = sorted(map(tuple, tails.before(batch).collect()))
        assert was == [(k, f"{min(batch - 1, batch - 1 - (batch - 1 - k) % 2)}") for k in range(2) if batch - 1 - (batch - 1 - k) % 2 >= 0]
        tails.keep(spark.createDataFrame([(batch % 2, str(batch))], "k long, tail string"), batch)


def test_intake_drops_late_repeats(spark):
    """A repeat long after its event's time is dropped, and a batch that runs again leaves the same rows."""
    rows = lambda *ids: spark.createDataFrame([(i, datetime.datetime(2024, 1, 1) + datetime.timedelta(days=i or 0)) for i in ids], "id long, ts timestamp")
    path = new_path(spark, "intake")
    found = logs.intake(stream_of(spark, [rows(1, 2, 2, None), rows(3000, 3001), rows(1, 3001, 4, None), rows(4, 5)], "in"), "id", path)
    assert sorted((r["id"] or 0) for r in found.collect()) == [0, 1, 2, 4, 5, 3000, 3001]
    again = logs.intake(stream_of(spark, [rows(1, 2)], "in"), "id", path)  # batch 0 again, with a state that is lost
    assert again.where("id = 1").count() == 1


def test_bursts_by_bucket(spark):
    r = random.Random(2)
    begin = datetime.datetime(2024, 1, 1)
    made = [("k" if r.random() < 0.9 else "j", r.randrange(5), begin + datetime.timedelta(seconds=r.randrange(20_000)), i) for i in range(250)]
    stream = stream_of(spark, [spark.createDataFrame(made, "key string, owner int, ts timestamp, id int")], "in")
    path = new_path(spark, "bursts")
    query = logs.bursts(stream, "key", "owner", "ts", "id").writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    found = sorted(map(tuple, spark.read.parquet(f"{path}/rows").collect()))
    assert found == sorted((x[0], x[3], y[3]) for x in made for y in made if x[0] == y[0] and x[1] != y[1] and (x[2], x[3]) < (y[2], y[3]) and (y[2] - x[2]).total_seconds() <= 600)


def test_bursts_over_batches(spark):
    """Rows of any batch meet those of all others, however late they come."""
    r = random.Random(3)
    begin = datetime.datetime(2024, 1, 1)
    made = [(r.choice("kkj"), r.randrange(4), begin + datetime.timedelta(microseconds=r.randrange(9_000_000_000)), i) for i in range(120)]
    parts = [spark.createDataFrame(made[i : i + 40], "key string, owner int, ts timestamp, id int") for i in (0, 40, 80)]
    path = new_path(spark, "bursts")
    want = sorted((x[0], x[3], y[3]) for x in made for y in made if x[0] == y[0] and x[1] != y[1] and (x[2], x[3]) < (y[2], y[3]) and (y[2] - x[2]).total_seconds() <= 600)
    found = logs.burst_pairs(stream_of(spark, parts, "in"), "key", "owner", "ts", "id", path)
    assert sorted(map(tuple, found.collect())) == want and want
    again = logs.burst_pairs(stream_of(spark, parts[:1], "in").select("key", "owner", "ts", "id"), "key", "owner", "ts", "id", new_path(spark, "bursts"))
    assert set(map(tuple, again.collect())) == {x for x in want if x[1] < 40 and x[2] < 40}


def test_replay_at_thousands_of_times(spark):
    """Counts and states at every point against a walk over all cells; ties of a time are settled by id."""
    r = random.Random(9)
    day = lambda n: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=n)
    verdict = lambda: r.choice(["PASS", "FAIL", "REVIEW"])
    cells = [(r.choice([1, 1, 1, 2]), c, day(r.randrange(400)), verdict(), day(r.randrange(500)) if r.random() < 0.6 else None) for c in range(60)]
    snapshots = [(r.randrange(62), day(r.randrange(450)), i, verdict()) for i in range(300)]
    states = [(r.choice([1, 2]), day(r.randrange(300)), i, f"s{i}") for i in range(50)]
    points = [(t, day(n / 4)) for t in (1, 2, 3) for n in range(0, 2000)]
    frames = [spark.createDataFrame(x, s) for x, s in ((cells, "tender_id int, cell int, created timestamp, verdict string, decided_at timestamp"), (snapshots, "cell int, at timestamp, id int, verdict string"), (states, "tender_id int, at timestamp, id int, to_state string"), (points, "tender_id int, point timestamp"))]
    found = {(x["tender_id"], x["point"]): tuple(x)[2:] for x in history.state_as_of(*frames).collect()}
    by_cell: dict = {}
    for c, at, i, v in snapshots:
        by_cell.setdefault(c, []).append((at, i, v))
    want = {}
    for t, p in points:
        own = [(x, max((s for s in by_cell.get(x[1], []) if s[0] <= p), default=(0, 0, x[3]))[2]) for x in cells if x[0] == t and x[2] <= p]
        if own:
            n = [sum(v == w for _, v in own) for w in ("PASS", "FAIL", "REVIEW")]
            decided = [sum(x[4] is not None and x[4] <= p for x, _ in own), sum(x[4] is not None and x[4] > p for x, _ in own)]
            want[t, p] = (len(own), *decided, *n, max(((s[1], s[2], s[3]) for s in states if s[0] == t and s[1] <= p), default=(None,) * 3)[2])
    assert found == want


def test_versions_numbers_and_pools(spark):
    r = random.Random(4)
    key = lambda: 1 if r.random() < 0.9 else r.randint(2, 5)
    facts = [(key(), r.randrange(300), i) for i in range(400)]
    versions = [(key(), r.randrange(300), v) for v in range(60)]
    found = history.as_of(spark.createDataFrame(facts, "k int, at int, id int"), spark.createDataFrame(versions, "k int, created int, version int"), "k", "at", "created", "version")
    assert {x["id"]: x["version_in_force"] for x in found.collect()} == {i: max((v for q, c, v in versions if q == k and c <= at), default=None) for k, at, i in facts}

    documents = sorted({(key(), f"d{r.randrange(500):03}") for _ in range(400)})
    stored = [(k, d, n) for n, (k, d) in enumerate(documents) if n % 7 == 0]
    frame = spark.createDataFrame(documents, "tender_id int, document string")
    numbered = {(x["tender_id"], x["document"]): x["number"] for x in history.corrigendum_numbers(frame, spark.createDataFrame(stored, "tender_id int, document string, number long")).collect()}
    for k in {k for k, _ in documents}:
        most = max((n for q, _, n in stored if q == k), default=0)
        rest = [d for q, d in documents if q == k and (q, d) not in {x[:2] for x in stored}]
        assert [numbered[k, d] for d in rest] == list(range(most + 1, most + 1 + len(rest)))

    bids = [(None if r.random() < 0.05 else key(), i, r.choice([None, 0.0, -1.0, 100.0 + r.random(), 500.0])) for i in range(500)]
    scored = {x["id"]: x["z"] for x in pools.zscore_pool(spark.createDataFrame(bids, "tender int, id int, value double"), ["tender"], "value").collect()}
    want = {}
    for t in {b[0] for b in bids}:
        own = [(i, round(v, 2), v) for k, i, v in bids if k == t and v is not None and v > 0]
        mean = sum(v for _, v, _ in own) / max(len(own), 1)
        sd = (sum((v - mean) ** 2 for _, v, _ in own) / max(len(own), 1)) ** 0.5
        want |= {i: (v - mean) / sd for i, _, v in own if len(own) >= 3 and sd and abs((v - mean) / sd) > 1.5}
    assert set(scored) == set(want) and all(abs(scored[i] - want[i]) < 1e-6 for i in want)


def test_precedents_of_a_hot_term(spark):
    """A term that all have costs k + 1 rows for each department, and gives the same precedents."""
    r = random.Random(5)
    rows = [(i, r.choice(["d", "d", "e"]), r.choice("xy"), ["all", *r.sample(["a", "b", "c", "f", "g"], 2)] if r.random() < 0.9 else [], r.randrange(40)) for i in range(200)]
    corpus = spark.createDataFrame(rows, "id int, department string, kind string, terms array<string>, created int")
    found = {}
    for x in workflow.precedents(corpus.where("id % 3 = 0").drop("created"), corpus).collect():
        found.setdefault(x["query"], []).append((x["k"], x["found"], x["basis"]))
    for i, d, kind, terms, _ in rows:
        if i % 3 == 0:
            near = sorted((-c, j) for j, e, _, other, c in rows if e == d and j != i and set(terms) & set(other))
            same = sorted((-c, j) for j, e, q, _, c in rows if e == d and q == kind and j != i)
            chosen, basis = (near, "terms") if near else (same, "type")
            assert sorted(found.get(i, [])) == [(k + 1, j, basis) for k, (_, j) in enumerate(chosen[:3])]
    lists = workflow.posting_lists(corpus, 3)
    assert lists.groupBy("department", "term").count().agg(F.max("count")).first()[0] <= 4
