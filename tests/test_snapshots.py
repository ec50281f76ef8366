"""Snapshots, rollups, timelines, findings and graphs on hand-made rows: nulls, empty tables, many flags, broken data."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from bidloom.functions import values as V
from bidloom.operators import checks, history, matrix, workflow

TENDERS, BIDDERS = "tender_id string, title string", "tender_id string, bidder_id long, company_name string"
CRITERIA, CELLS = "tender_id string, criterion_id string", "tender_id string, bidder_id long, criterion_id string, verdict string"
FLAGS, CORRIGENDA = "tender_id string, bidder_id long, evaluation_id string, severity string, flag_type string", "tender_id string, sequence_number long, title string"


def test_tender_snapshots_hold_the_worst_flags_and_empty_lists(spark):
    flags = [("t", 1, f"e{i:02}", "low", "round_number") for i in range(40)] + [("t", None, None, "high", "novel")]
    found = matrix.tender_snapshots(
        spark.createDataFrame([("t", "bridge"), ("u", None)], TENDERS), spark.createDataFrame([("t", 1, "A"), ("t", 2, None)], BIDDERS), spark.createDataFrame([("t", "N"), ("t", "A")], CRITERIA),
        spark.createDataFrame([("t", 1, "N", "PASS"), ("t", 1, "A", None)], CELLS), spark.createDataFrame(flags, FLAGS), spark.createDataFrame([("t", 2, "b"), ("t", 1, "a")], CORRIGENDA),
    )
    rows = {(r["tender_id"], r["bidder_id"]): json.loads(r["snapshot"]) for r in found.collect()}
    assert set(rows) == {("t", None), ("u", None), ("t", 1), ("t", 2)}
    head = rows["t", None]
    assert len(head["open_anomalies"]) == 30 and head["open_anomalies"][0]["severity"] == "high"
    assert [c["criterion_id"] for c in head["criteria"]] == ["A", "N"] and [c["title"] for c in head["corrigenda"]] == ["a", "b"]
    assert rows["u", None] == {"tender": {"tender_id": "u", "title": None}, "criteria": [], "open_anomalies": [], "corrigenda": []}
    assert [c["verdict"] for c in rows["t", 1]["evaluations"]] == [None, "PASS"] and rows["t", 2]["evaluations"] == []


def test_tender_snapshots_of_empty_tables(spark):
    empty = [spark.createDataFrame([], s) for s in (TENDERS, BIDDERS, CRITERIA, CELLS, FLAGS, CORRIGENDA)]
    assert matrix.tender_snapshots(*empty).count() == 0


def test_timeline_of_broken_and_missing_data(spark):
    rows = [(1, "evaluation_decided", '{"decision":"confirm","final_verdict":"PASS"}'), (2, "evaluation_decided", "{oops"), (3, "criteria_approved", None), (4, "tender_created", "{}"), (5, None, "{}")]
    found = history.decision_timeline(spark.createDataFrame(rows, "id long, event_type string, event_data string"))
    assert {r["id"]: r["summary"] for r in found.collect()} == {1: "Officer confirm → PASS", 2: "Officer ? → ?", 3: "Criteria approved (? criteria)"}


def test_states_and_groups(spark):
    rows = [("DRAFT", "verification_run"), ("FINALIZED", "unheard_of"), (None, None)]
    found = spark.createDataFrame(rows, "state string, kind string").select(V.progress_of(F.col("state")).alias("p"), V.event_group(F.col("kind")).alias("g")).collect()
    assert [tuple(r) for r in found] == [(5, "verification"), (100, "other"), (0, "other")]
    assert set(V.PROGRESS) == set(history.TRANSITIONS) == {s for states in V.PROGRESS_STEPS.values() for s in states}
    moves = spark.createDataFrame([("e", 1, "pending_review", "resolved"), ("e", 2, "resolved", "pending_review")], "cell string, at int, from_state string, to_state string")
    assert [r["at"] for r in history.illegal_transitions(moves, "cell", ["at"], history.EVALUATION_MOVES).collect()] == [2]


def test_registry_details(spark):
    rows = [("012345n ", "L12345HR2001PTC000001"), ("012345Q", "U12345MH1999PLC000001"), ("12", "X1"), (None, "")]
    found = spark.createDataFrame(rows, "frn string, cin string").select(checks.verify_frn().alias("f"), checks.verify_cin().alias("c")).collect()
    assert [r["f"]["details"] for r in found] == [{"region": "Northern"}, {"region": "Unknown"}, None, None]
    assert [r["c"]["details"] for r in found] == [{"listing": "Listed", "state": "HR", "year": "2001"}, {"listing": "Unlisted", "state": "MH", "year": "1999"}, None, None]


def test_findings_come_from_the_last_good_run(spark):
    answers = [("h", 1, "a", 0.9, None), ("h", 2, "b", 0.8, None), ("h", 2, "c", 0.7, None), ("h", 3, None, None, "timeout"), ("h", 3, "d", 0.6, None), ("i", 1, None, None, "timeout"), (None, 1, "x", 0.5, None)]
    findings = spark.createDataFrame(answers, "prompt_hash string, run int, finding string, confidence double, error string")
    cells = spark.createDataFrame([("e1", "h"), ("e2", "i"), ("e3", None)], "evaluation_id string, prompt_hash string")
    found = {(r["evaluation_id"], r["finding"]) for r in workflow.findings_for(cells, findings).collect()}
    assert found == {("e1", "b"), ("e1", "c"), ("e2", None), ("e3", None)}
    with pytest.raises(ValueError, match="error"):
        workflow.findings_for(cells, findings.drop("error"))


def test_context_rollup_keeps_its_length(spark):
    base = spark.createDataFrame([("t", 1), ("u", 2)], "tender_id string, passes int")
    notes = spark.createDataFrame([("t", "x" * 9000)], "tender_id string, text string")
    found = {r["tender_id"]: r for r in matrix.context_rollup(base, {"notes": notes}).collect()}
    assert len(found["t"]["context"]) == 8000 and found["u"]["notes_text"] is None and json.loads(found["u"]["context"])["passes"] == 2


def test_graph_of_a_cell_without_evidence(spark):
    cells = spark.createDataFrame([("t", 1, "e", [], [], [], False, None)], "tender_id string, bidder_id long, evaluation_id string, figures array<long>, rules_figures array<long>, model_figures array<long>, has_documents boolean, dissent string")
    flags = spark.createDataFrame([("t", 1, None, "low", f"f{i}") for i in range(7)], FLAGS)
    nodes, edges = workflow.provenance(cells, flags, spark.createDataFrame([], "evaluation_id string, decision string"), spark.createDataFrame([("e", 2)], "evaluation_id string, notes int"))
    assert {r["node"] for r in nodes.collect()} == {"criterion", "bidder", "value", "verdict", "comments", *(f"flag_{i}" for i in range(1, 6))}
    links = {(r["source"], r["target"], r["label"]) for r in edges.collect()}
    assert {("bidder", "value", "no evidence"), ("value", "verdict", "determines"), ("verdict", "comments", "annotated")} <= links and len(links) == 9
