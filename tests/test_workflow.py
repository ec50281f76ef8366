"""Detectors, explanations, review contexts, comments and consequences on hand-made rows."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from bidloom.functions import values as V
from bidloom.operators import detectors, evidence, listings, matrix, pairs, texts, workflow
from bidloom.plans import registry
from tests.conftest import SMALL

BIDDERS = [  # tender, bidder, company, pan, gstin, address, instrument, number, signatories, letter
    ("t", 1, "Ganga Steel Works Pvt Ltd", "AAACB1234Z", "06AAACB1234Z1Z5", "Plot 1", "DD", "DD-100001", ["Mr. P. Sharma"], "one two three four five six seven eight nine ten eleven"),
    ("t", 2, "ganga steel works limited", "aaacb12", "06AAACB9999Z1Z5", " plot 1 ", "demand draft", "100003", ["P Sharma", None], "ONE two three four five six seven eight nine ten eleven"),
    ("t", 3, "Other Mills", "AAACB1234Z", "06BBBCB1234Z1Z5", None, "BG", "100004", [], None),
    ("t", 4, None, None, "", "", "DD", "12", None, "short"),
    ("u", 5, "Ganga Steel Works", None, None, "Plot 1", "DD", "100002", ["P Sharma"], "one two three four five six seven eight nine ten eleven"),
]
TABLES = {
    "bidders": (BIDDERS, "tender_id string, bidder_id long, company_name string, pan string, gstin string, address string, instrument string, instrument_no string, signatories array<string>, letter string"),
    "figures": ([("t", 1, "turnover", 10_000_000), ("t", 1, "turnover", 10_000_000), ("t", 2, "net worth", 1_100_000), ("t", 2, "x", 900_000), ("t", 3, "x", None)] + [("b", 9, "y", 90_001 + i) for i in range(20)], "tender_id string, bidder_id long, label string, value long"),
    "bids": ([("t", "c", i, v) for i, v in enumerate([100.0, 101.0, 99.0, 100.0, 100.0, 400.0, None, -5.0])] + [("t", "d", i, 100.0 + i / 10) for i in range(4)] + [("t", "e", i, 5.0) for i in range(2)], "tender_id string, criterion_id string, bidder_id long, value double"),
    "documents": ([("t", 1, 11, "h1", " Acme Writer ", "x", 0), ("t", 2, 12, "h1", "", "acme writer", 500), ("t", 2, 13, "h2", "abc", None, 1200), ("t", 1, 14, "h2", "abc", None, 5000), ("t", None, 15, "h1", None, None, 1), ("u", 5, 16, "h1", "Acme Writer", None, 3)], "tender_id string, bidder_id long, doc_id long, sha256 string, producer string, creator string, modified long"),
}


@pytest.fixture(scope="module")
def tables(spark):
    return {k: spark.createDataFrame(*v) for k, v in TABLES.items()}


def test_each_detector(tables):
    found = {}
    for x in detectors.screen(tables).collect():
        found.setdefault(x["flag_type"], set()).add((x["tender_id"], x["severity"], ",".join(sorted(x["bidder_ids"])), x["subject"]))
    assert found == {
        "round_number": {("t", "low", "1", "turnover::10000000"), ("t", "low", "2", "net worth::1100000")},
        "pan_format_mismatch": {("t", "medium", "2", "AAACB12")},
        "gstin_format_mismatch": {("t", "high", "2", "06AAACB9999Z1Z5"), ("t", "high", "3", "06BBBCB1234Z1Z5")},
        "address_collision": {("t", "high", "1,2", None)}, "date_proximity": {("t", "medium", "1,2", "11-12")}, "duplicate_document": {("t", "high", "1,2", "h1"), ("t", "high", "1,2", "h2")},
        "sequential_dd": {("t", "high", "1,2", None)}, "common_signatory": {("t", "high", "1,2", "p sharma")}, "cover_letter_overlap": {("t", "high", "1,2", None)},
        "benford_violation": {("b", "high", "", "20")}, "zscore_outlier": {("t", "medium", "5", "5::2.24")},
        "bid_spread_anomaly": {("t", "high", "", "price_fixing::4")},
        "metadata_cluster": {("t", "medium", "1,2", "acme writer")}, "entity_resolution_match": {("t", "high", "1,2", None)},
    }
    assert set(detectors.DETECTORS) == set(found) and set(found) < set(matrix.FLAG_TYPES)


def test_equal_findings_are_one_and_stored_ones_none(spark):
    flags = spark.createDataFrame([("t", "address_collision", "low", ["2", "1"], None), ("t", "address_collision", "high", ["1", "2"], None), ("t", "never_heard", "odd", ["3"], "S"), ("u", "never_heard", "odd", ["3"], "s")], "tender_id string, flag_type string, severity string, bidder_ids array<string>, subject string")
    found = {(x["tender_id"], x["flag_key"], x["flag_type"], x["severity"]) for x in matrix.merged_flags([flags]).collect()}
    assert found == {("t", "address_collision::1,2", "address_collision", "high"), ("t", "novel::s", "novel", "medium"), ("u", "novel::s", "novel", "medium")}
    stored = spark.createDataFrame([("t", "novel::s"), ("u", "address_collision::1,2")], "tender_id string, flag_key string")
    assert {(x["tender_id"], x["flag_key"]) for x in matrix.merged_flags([flags], stored).collect()} == {("t", "address_collision::1,2"), ("u", "novel::s")}


def test_pairs_of_bidders_are_not_brought_together(spark, tables, monkeypatch):
    """Pairs that are found once each aren't shuffled by their keys, whatever the blocks; those of a bidder with two names are merged."""
    words = [["ganga", "steel", "works"], ["ganga", "steel", "mills"], ["ganga", "steel"], ["rao", "glass"]]
    rows = [("t", i, " ".join(words[i % 4])) for i in range(40)] + [("t", 1, "ganga steel works"), ("t", 2, "rao glass")]
    letter = "one two three four five six seven eight nine ten eleven"
    frame = spark.createDataFrame([(*x, letter) for x in rows], "tender_id string, bidder_id long, company_name string, letter string")
    alike = lambda v, w: 10 * len(set(v) & set(w)) >= 6 * len(set(v) | set(w))
    want = {",".join(sorted((str(i), str(j)))) for _, i, v in rows for _, j, w in rows if i != j and alike(v.split(), w.split())}
    for block in (512, 3):
        monkeypatch.setattr(pairs.member_pairs, "__defaults__", (None, block))
        found = detectors.screen({"bidders": frame}, ["entity_resolution_match", "cover_letter_overlap"])
        keys = sorted(x["flag_key"] for x in found.collect())
        assert keys == sorted([f"entity_resolution_match::{k}" for k in want] + [f"cover_letter_overlap::{k}" for k in {",".join(sorted((str(i), str(j)))) for i in range(40) for j in range(i)}])
    letters = detectors.screen({"bidders": frame}, ["cover_letter_overlap"])
    plan = letters._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" in plan and "flag_key" not in "".join(x for x in plan.splitlines() if "Aggregate" in x)


def test_explanations_by_type(spark):
    names = ("criterion_type", "verdict", "confidence", "has_value", "has_documents", "figures", "threshold", "expected_count", "found", "kind", "registration", "validity_date", "qualifying_count", "required_count", "reasoning", "agreement", "clause", "source_doc", "source_page", "route", "reason")
    schema = "criterion_type string, verdict string, confidence double, has_value boolean, has_documents boolean, figures array<bigint>, threshold bigint, expected_count int, found boolean, kind string, registration string, validity_date string, qualifying_count int, required_count int, reasoning string, agreement string, clause string, source_doc string, source_page int, route string, reason string"
    cases = [
        ({"criterion_type": "numeric_threshold", "verdict": "PASS", "confidence": 0.905, "has_value": True, "figures": [12_345, 1_250_000, 25_000_000], "threshold": 1_000_000, "expected_count": 4, "agreement": "partial", "clause": "4.1", "source_doc": "abcdefghij", "source_page": 3, "route": "auto_commit"},
         ("I'm 90% confident this satisfies 4.1.", "Figures found: ✗ (unspecified): Rs. 12,345 · ✓ (unspecified): Rs. 12.50 L · ✓ (unspecified): Rs. 2.50 Cr Note: criterion expects 4 period(s) but only 3 found. Note: only one extractor branch found a value.", "Source: doc abcdefgh, page 3", "I will record this as confirmed unless you override.")),
        ({"criterion_type": "categorical_presence", "verdict": "FAIL", "confidence": 0.5, "has_value": True, "found": True, "kind": "gst", "registration": "06X", "validity_date": "1/2/24", "agreement": "agree", "source_doc": "doc", "route": "hitl_review", "reason": "Why."},
         ("I'm 50% confident this does not satisfy the criterion.", "Found GST: 06X Validity: 1/2/24", "Source: doc doc", "Please review and confirm. Why.")),
        ({"criterion_type": "categorical_presence", "verdict": "REVIEW", "confidence": 0.0, "has_value": True, "found": False, "route": "mandatory_review", "reason": "R."}, ("I cannot determine this with confidence (currently 0%).", "Required document was not found in the bidder's submission.", "", "Officer review required. R.")),
        ({"criterion_type": "temporal_recency", "verdict": "PASS", "confidence": 1.0, "has_value": True, "qualifying_count": 2, "required_count": 3, "route": "auto_commit"}, ("I'm 100% confident this satisfies the criterion.", "Found 2 qualifying project(s) (required: 3)", "", "I will record this as confirmed unless you override.")),
        ({"criterion_type": "qualitative_assessment", "verdict": "PASS", "confidence": 0.7, "has_value": True, "reasoning": "r" * 300, "agreement": "disagree", "route": "auto_commit"}, ("I'm 70% confident this satisfies the criterion.", "r" * 220 + " Note: rules and LLM extractors disagreed; officer review is recommended.", "", "I will record this as confirmed unless you override.")),
        ({"criterion_type": "composite", "verdict": "PASS", "confidence": 0.7, "has_value": True, "route": "auto_commit"}, ("I'm 70% confident this satisfies the criterion.", "Refer to the source document.", "", "I will record this as confirmed unless you override.")),
        ({"criterion_type": "numeric_threshold", "verdict": "FAIL", "confidence": 0.7, "has_value": False, "has_documents": True, "route": "auto_commit"}, ("I'm 70% confident this does not satisfy the criterion.", evidence.SAID["not_found"], "", "I will record this as confirmed unless you override.")),
        ({"criterion_type": "numeric_threshold", "verdict": "FAIL", "confidence": 0.7, "has_value": False, "has_documents": False, "route": "auto_commit"}, ("I'm 70% confident this does not satisfy the criterion.", evidence.SAID["no_document"], "", "I will record this as confirmed unless you override.")),
    ]
    rows = [(i, *(case.get(n, [] if n == "figures" else None) for n in names)) for i, (case, _) in enumerate(cases)]
    part = {"ocr_quality": 0.85, "entity_match": 1.0, "date_parsing": None, "llm_branch": 0.125}
    breakdown = F.struct(*(F.lit(part.get(k)).cast("double").alias(k) for k in evidence.COMPONENTS))
    found = evidence.explained(spark.createDataFrame(rows, "i int, " + schema).withColumn("breakdown", breakdown)).orderBy("i").collect()
    assert [(x["headline"], x["detail"], x["source_reference"], x["next_action"]) for x in found] == [w for _, w in cases]
    assert found[0]["facts"] == ["Ocr Quality: 85%", "Entity Match: 100%", "Llm Branch: 12%"]


def test_comments_and_review_context(spark):
    cells = spark.createDataFrame([("t", 1, "A", "e1", "PASS", 70), ("t", 1, "B", "e2", "FAIL", None), ("t", 2, "A", "e3", "FAIL", 71)], "tender_id string, bidder_id long, criterion_id string, evaluation_id string, verdict string, source_doc long")
    officers = spark.createDataFrame([(5, "Rao", "senior"), (6, "Iyer", "reviewer")], "officer_id long, name string, role string")
    notes = [("c1", "e1", None, None, 5, "see", True, "d1"), ("c2", "e1", 9, "Z", 6, "ok", None, "d2"), ("c3", None, 2, None, 5, "general", False, "d3"), ("c4", "e1", None, None, 99, "lost", True, "d4"), ("c5", "e1", None, None, 5, "  ", True, "d5"), ("c6", None, None, None, 5, "no target", True, "d6"), ("c7", "gone", None, None, 5, "old", False, "d7")]
    comments = workflow.comments_with_author(spark.createDataFrame(notes, "comment_id string, evaluation_id string, bidder_id long, criterion_id string, officer_id long, body string, affects_verdict boolean, created string"), officers, cells)
    assert {(x["comment_id"], x["bidder_id"], x["criterion_id"], x["officer_name"], x["actionable"]) for x in comments.collect()} == {("c1", 1, "A", "Rao", True), ("c2", 9, "Z", "Iyer", False), ("c3", 2, None, "Rao", False), ("c7", None, None, "Rao", False)}
    requests = spark.createDataFrame([("r1", "e1", 5), ("r2", "e2", 77), ("r3", "none", 5)], "request_id string, evaluation_id string, requested_by long")
    bidders = spark.createDataFrame([(1, "Acme")], "bidder_id long, company_name string")
    criteria = spark.createDataFrame([("A", True), ("B", False)], "criterion_id string, is_mandatory boolean")
    documents = spark.createDataFrame([(70, "f.pdf")], "doc_id long, filename string")
    flags = spark.createDataFrame([("t", 1, "e1", "high", "open"), ("t", 1, None, "low", None), ("t", 1, "e1", "low", "dismissed"), ("t", 2, None, "low", "open"), ("u", 1, None, "low", "open")], "tender_id string, bidder_id long, evaluation_id string, severity string, state string")
    found = {}
    for x in workflow.review_context(requests, cells, bidders, criteria, documents, officers, comments, flags).collect():
        found.setdefault((x["request_id"], x["part"]), []).append(json.loads(x["record"]))
    assert {k: len(v) for k, v in found.items()} == {("r1", p): n for p, n in (("request", 1), ("evaluation", 1), ("bidder", 1), ("criterion", 1), ("document", 1), ("officer", 1), ("comment", 2), ("actionable_comment", 1), ("flag", 2))} | {("r2", p): 1 for p in ("request", "evaluation", "bidder", "criterion", "flag")}
    assert found["r1", "document"][0]["filename"] == "f.pdf" and {f["severity"] for f in found["r1", "flag"]} == {"high", "low"} and found["r1", "actionable_comment"][0]["comment_id"] == "c1"


def test_consequences(spark):
    cells = spark.createDataFrame([("t", 1, c, v, r, d) for c, v, r, d in (("A", "FAIL", "mandatory_review", "x"), ("B", "PASS", "auto_commit", "x"), ("C", "PASS", "auto_commit", None))], "tender_id string, bidder_id long, criterion_id string, verdict string, route string, source_doc string")
    companies = spark.createDataFrame([(1, "Acme")], "bidder_id long, company_name string")
    found = {(x["criterion_id"], x["action"], x["new_verdict"], x["type"], x["text"]) for x in matrix.consequences(matrix.what_if(cells.drop("source_doc")), cells.drop("verdict", "route"), companies).collect()}
    turned = {x[:4] for x in found if x[3] == "eligibility"}
    assert turned == {("A", "override", v, "eligibility") for v in ("PASS", "REVIEW")} and ("A", "override", "PASS", "eligibility", "Acme moves from NOT ELIGIBLE → ELIGIBLE") in found
    assert {x[:3] for x in found if x[3] == "concurrence"} == {("A", "override", v) for v in ("PASS", "FAIL", "REVIEW")}
    assert {(x[0], x[4]) for x in found if x[3] == "shared_source"} == {(c, "1 other cell(s) reference the same source document.") for c in "AB"}


@pytest.mark.parametrize(
    ("text", "kind", "number", "valid"),
    [
        ("GSTIN: 06AAACB1234Z1Z5, valid up to 01/02/2030", "gst", "06AAACB1234Z1Z5", True), ("gstin 6AAACB1234Z1Z5", "gst", None, None), ("PAN AAACB1234Z valid until 1-2-20", "pan", "AAACB1234Z", False), ("PAN AAACB1234", "pan", None, None),
        ("Udyam-HR-05-0012345 valid through 31.12.2031", "udyam", "Udyam-HR-05-0012345", True), ("UDYAM HR 05", "udyam", None, None), ("certified iso 9001 - 2015", "iso", "iso 9001 - 2015", None), ("ISO 14001:2015", "iso", None, None),
    ],
)
def test_certificates_as_they_are_spelt(spark, text, kind, number, valid):
    found = spark.createDataFrame([(text,)], "t string").select(texts.certificate(F.col("t"), kind, F.lit("2024-01-01").cast("date")).alias("c")).first()["c"]
    assert (found["found"], found["registration"], found["is_valid"]) == (number is not None, number, valid if number else None)


def test_criterion_types(spark):
    rows = spark.createDataFrame([("numeric_threshold",), ("composite",), ("odd",), (None,)], "t string").select(V.criterion_type(F.col("t")).alias("k"))
    assert [r["k"] for r in rows.collect()] == ["numeric_threshold", "composite", "qualitative_assessment", "qualitative_assessment"]


@pytest.mark.parametrize("most", [5, 12, 13, 60, 1000])
def test_text_of_pages_up_to_a_limit(spark, most):
    pages = [(1, 2, "second page"), (1, 1, "first"), (1, 3, None), (2, 1, "x" * 100), (3, 1, ""), (3, 2, "tail")]
    frame = spark.createDataFrame(pages, "doc int, n int, t string")
    for marked in (True, False):
        want = {d: "\n".join((f"[Page {n}]\n" if marked else "") + (t or "") for e, n, t in sorted(pages, key=lambda p: p[:2]) if e == d)[:most] for d in (1, 2, 3)}
        assert {x["doc"]: x["text"] for x in texts.assembled(frame, "doc", "n", "t", most, marked).collect()} == want


def test_recommendation_lists(spark):
    """A tender's lists hold all its bidders in order, at 30 % FAIL too and without an id; an empty list is null, open cells add up."""
    counts = [("t", b, fails, reviews, total) for b, fails, reviews, total in ((12, 0, 1, 3), (3, 3, 0, 10), (None, 0, 2, 2), (7, 4, 0, 10), (1, 1, 1, 3))] + [("u", 5, 1, 0, 1), (None, 6, 0, 0, 1)]
    frame = spark.createDataFrame(counts, "tender_id string, bidder_id long, fails long, reviews long, total long").repartition(4)
    found = {x["tender_id"]: (x["qualified"], x["excluded"], x["open_count"]) for x in listings.recommendations(frame).collect()}
    assert found == {"t": ([3, 12, None], [1, 7], 4), "u": (None, [5], 0), None: ([6], None, 0)}


def test_recommendation_lists_of_the_tables(spark):
    """One row for each tender, whose lists and open cells are those of all its bidders."""
    want = {}
    for x in registry.QUERIES["a1_verdict_distribution"](spark, SMALL).collect():
        lists = want.setdefault(x["tender_id"], ([], [], [0]))
        lists[10 * x["fails"] > 3 * x["total"]].append(x["bidder_id"])
        lists[2][0] += x["reviews"]
    found = registry.QUERIES["a15_recommendation_lists"](spark, SMALL).collect()
    assert len(found) == len(want)
    assert {x["tender_id"]: (x["qualified"] or [], x["excluded"] or [], [x["open_count"]]) for x in found} == {k: (sorted(a), sorted(b), n) for k, (a, b, n) in want.items()}
