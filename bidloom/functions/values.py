"""Column builders for money, names, identifiers, dates and hashes. All are native expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Units of Indian currency.
UNITS = {"crore": 10_000_000, "cr": 10_000_000, "lakh": 100_000, "lac": 100_000, "l": 100_000}

#: Texts deleted from company names, in this order (two conventions), and words written out.
COMPANY_SUFFIXES = ("pvt ltd", "pvt. ltd.", "pvt. ltd", "private limited", "limited", "ltd", "ltd.", "llp", "inc", "inc.", "& co", "& company", "enterprises", "industries", "solutions", "services", "systems", "technologies")
REGISTRY_SUFFIXES = ("private limited", "pvt ltd", "pvt. ltd.", "pvt ltd.", "limited", "ltd.", "ltd", "industries", "company", "co.", "corporation", "corp.", "corp", "llp", "llc")
COMPANY_WORDS = {
    "mfg": "manufacturing", "engg": "engineering", "engr": "engineering", "intl": "international", "natl": "national", "govt": "government", "infra": "infrastructure", "tech": "technology",
    "telecom": "telecommunications", "auto": "automobile", "pharma": "pharmaceutical", "elec": "electrical", "const": "construction", "trans": "transport", "def": "defence",
}
HONORIFICS = ("mr.", "mrs.", "ms.", "dr.", "shri", "smt.", "jr.", "sr.")

#: Formats of registration numbers.
PAN = "^[A-Z]{5}[0-9]{4}[A-Z]$"
GSTIN = "^[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[0-9A-Z]$"
FRN = "^[0-9]{6}[A-Z]$"
UDYAM = "^UDYAM-[A-Z]{2}-[0-9]{2}-[0-9]{7}$"
CIN = "^[ULP][0-9]{5}[A-Z]{2}[0-9]{4}[A-Z]{3}[0-9]{6}$"

#: Words that search terms leave out.
SEARCH_STOP = "the shall have been not less than for and with from that this which are was were has had will can may must should would could each last years year bidder valid certificate".split()

#: Lifecycle of a tender.
PROGRESS_STEPS = {
    "setup": ("DRAFT",),
    "documents": ("DOCUMENTS_PENDING", "DOCUMENTS_PROCESSING", "DOCUMENTS_READY"),
    "criteria": ("CRITERIA_EXTRACTING", "CRITERIA_PENDING_REVIEW", "CRITERIA_APPROVED", "CHECKLIST_PENDING", "PRELIMINARY_DONE"),
    "evaluation": ("EVALUATING", "EVALUATIONS_COMPUTED", "HITL_PENDING", "EVALUATION_COMPLETE"),
    "report": ("REPORT_GENERATED", "FINALIZED"),
}

#: How far a tender is in each state, in percent.
PROGRESS = {
    "DRAFT": 5, "DOCUMENTS_PENDING": 10, "DOCUMENTS_PROCESSING": 20, "DOCUMENTS_READY": 30, "CRITERIA_EXTRACTING": 35, "CRITERIA_PENDING_REVIEW": 45, "CRITERIA_APPROVED": 55, "CHECKLIST_PENDING": 60,
    "PRELIMINARY_DONE": 65, "EVALUATING": 75, "EVALUATIONS_COMPUTED": 85, "HITL_PENDING": 90, "EVALUATION_COMPLETE": 95, "REPORT_GENERATED": 98, "FINALIZED": 100,
}

#: The audit events of each group; others belong to ``other``.
EVENT_GROUPS = {
    "lifecycle": ("tender_created", "tender_metadata_updated", "tender_state_transition", "tender_deleted"),
    "document": ("document_received", "document_processed", "document_failed"),
    "criteria": ("criteria_extracted", "criterion_edited", "criterion_version_created", "criteria_approved", "criterion_amended"),
    "bidder": ("bidder_registered", "bidder_excluded", "bidder_emd_recorded", "bidder_debarment_checked"),
    "verification": ("verification_run",),
    "evaluation": ("evaluation_computed", "evaluation_decided", "second_officer_decided", "concurrence_requested", "concurrence_decided", "anomaly_flagged", "anomaly_dismissed", "evidence_citation_recorded"),
    "human": ("officer_comment_added", "post_review_check_answered", "tec_draft_generated", "tec_section_authored", "tec_section_revised", "tec_report_finalised", "studio_doc_created", "studio_doc_message", "studio_doc_finalised"),
    "report": ("report_generated", "report_signed", "brief_generated", "vault_generated", "reproduce_attempted"),
    "chat": ("copilot_message", "decision_replay_captured"),
    "checklist": ("checklist_extracted", "checklist_response_decided", "preliminary_finalised"),
    "corrigendum": ("corrigendum_received", "corrigendum_summarised", "corrigendum_applied", "corrigendum_rejected"),
}

#: Regions by the last letter of a firm's registration number.
FRN_REGIONS = {"N": "Northern", "S": "Southern", "E": "Eastern", "W": "Western", "C": "Central"}


def _case(pairs: list[tuple[Column, Column]], otherwise: Column | None = None) -> Column:
    out = reduce(lambda acc, p: acc.when(*p), pairs[1:], F.when(*pairs[0]))
    return out if otherwise is None else out.otherwise(otherwise)


def lookup(key: Column, table: dict, otherwise: Column | None = None) -> Column:
    """The value of a small fixed table."""
    return _case([(key == k, F.lit(v)) for k, v in table.items()], otherwise)


def rupees(value: Column, unit: Column) -> Column:
    """An amount with a unit in whole rupees, truncated; other units count as rupees."""
    plain = F.regexp_replace(F.lower(F.trim(unit)), r"\.+$", "")
    return (value * lookup(plain, UNITS, F.lit(1))).cast("bigint")


def threshold_rupees(stated: Column, value: Column, unit: Column) -> Column:
    """A threshold in rupees (P2): the stated amount, else value and unit; without a known unit, values under 1000 are crore."""
    v = value.cast("double")
    factor = lookup(F.lower(F.trim(F.coalesce(unit, F.lit("")))), UNITS, F.when(v < 1000, F.lit(10_000_000)).otherwise(F.lit(1)))
    return F.coalesce(stated.cast("bigint"), (v * factor).cast("bigint"), F.lit(0).cast("bigint"))


def humanised(amount: Column) -> Column:
    """An amount as crore, lakh or rupee with two decimals."""
    whole = lambda unit: F.floor((amount * 100 + unit // 2) / unit) / 100  # noqa: E731  hundredths in whole numbers: halves go up
    return (
        F.when(amount >= 10_000_000, F.format_string("%.2f crore", whole(10_000_000)))
        .when(amount >= 100_000, F.format_string("%.2f lakh", whole(100_000)))
        .otherwise(F.format_string("%.2f rupee", amount.cast("double")))
    )


def _without(text: Column, parts: tuple[str, ...], by: str = "") -> Column:
    return reduce(lambda acc, part: F.replace(acc, F.lit(part), F.lit(by)), parts, text)


def company_key(name: Column) -> Column:
    """A company name for matching (P4): suffix texts cut, words written out, punctuation dropped."""
    cut = _without(F.lower(F.trim(F.coalesce(name, F.lit("")))), COMPANY_SUFFIXES)
    words = F.filter(F.split(cut, r"\s+"), lambda w: w != "")
    spelled = F.array_join(F.transform(words, lambda w: lookup(w, COMPANY_WORDS, w)), " ")
    return F.trim(F.regexp_replace(F.regexp_replace(spelled, r"[^\w\s]", " "), r"\s+", " "))


def registry_key(name: Column) -> Column:
    """A company name for registry matching (P5): suffix texts cut, only letters and digits left."""
    return F.regexp_replace(_without(F.lower(F.coalesce(name, F.lit(""))), REGISTRY_SUFFIXES), "[^a-z0-9]+", "")


def person_key(name: Column) -> Column:
    """A person's name for matching (P6); null when under five characters are left."""
    plain = _without(F.lower(F.coalesce(name, F.lit(""))), HONORIFICS, " ")
    plain = F.trim(F.regexp_replace(F.regexp_replace(plain, r"[^\w\s]", " "), r"\s+", " "))
    return F.when(F.length(plain) >= 5, plain)


def matches(text: Column, pattern: str) -> Column:
    return F.upper(F.trim(F.coalesce(text, F.lit("")))).rlike(pattern)


def round_tier(amount: Column) -> Column:
    """Whole multiples of ten lakh or a lakh from ten lakh on (P9); null for others."""
    return F.when((amount >= 1_000_000) & (amount % 1_000_000 == 0), F.lit("ten_lakh")).when((amount >= 1_000_000) & (amount % 100_000 == 0), F.lit("lakh"))


def first_digit(value: Column) -> Column:
    """The first significant digit of a positive number (P10); null otherwise."""
    return F.when(value > 0, F.substring(F.format_string("%.10e", value.cast("double")), 1, 1).cast("int"))


def as_date(text: Column) -> Column:
    """d/m/y with /, - or . and two or four digits for the year, or null."""
    parts = F.split(F.trim(text), "[-/.]")
    year = F.try_element_at(parts, F.lit(3)).try_cast("int")
    stated = F.concat_ws("-", F.when(year < 100, year + 2000).otherwise(year).cast("string"), F.try_element_at(parts, F.lit(2)), F.try_element_at(parts, F.lit(1)))
    return F.when(F.size(parts) == 3, F.try_to_timestamp(stated, F.lit("yyyy-M-d")).cast("date"))


def step_of(state: Column) -> Column:
    """The step of a tender's state (P22); unknown states are at the report."""
    return lookup(state, {s: step for step, states in PROGRESS_STEPS.items() for s in states}, F.lit("report"))


def progress_of(state: Column) -> Column:
    """How far a tender is, in percent (P22); 0 for unknown states."""
    return lookup(state, PROGRESS, F.lit(0))


def evaluation_state(route: Column, second: Column, decided: Column) -> Column:
    """The state of a cell's evaluation (P22): committed alone, resolved by a decision, or waiting for one or two officers."""
    return F.when(route == "auto_commit", "auto_committed").when(F.coalesce(decided, F.lit(False)), "resolved").when(F.coalesce(second, F.lit(False)), "pending_second_officer").otherwise("pending_review")


def event_group(kind: Column) -> Column:
    """The group of an audit event."""
    return _case([(kind.isin(*kinds), F.lit(group)) for group, kinds in EVENT_GROUPS.items()], F.lit("other"))


def content_hash(**fields: Column) -> Column:
    """A record's hash that doesn't depend on the order of its fields."""
    parts = [F.concat(F.lit(f"{k}="), F.coalesce(v.cast("string"), F.lit(""))) for k, v in sorted(fields.items())]
    return F.sha2(F.concat_ws("|", *parts), 256)


def search_terms(text: Column, most: int = 8) -> Column:
    """The first words of a text that are worth searching (P28): over three letters, not in the stop list."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z]+)"), 1)
    return F.slice(F.filter(words, lambda w: (F.length(w) > 3) & ~w.isin(*SEARCH_STOP)), 1, most)


def certificate_kind(text: Column) -> Column:
    """What a categorical criterion asks for (P20)."""
    t = F.lower(F.coalesce(text, F.lit("")))
    return _case([(t.contains("gst"), F.lit("gst")), (t.contains("pan") | t.contains("permanent account"), F.lit("pan")), (t.contains("iso"), F.lit("iso")), (t.contains("msme") | t.contains("udyam"), F.lit("udyam"))], F.lit("unknown"))


def label_hint(text: Column) -> Column:
    """What a numeric criterion is about (P20); empty if it doesn't say."""
    t = F.lower(F.coalesce(text, F.lit("")))
    return _case([(t.contains("turnover"), F.lit("turnover")), (t.contains("net worth"), F.lit("net worth")), (t.contains("emd") | t.contains("earnest"), F.lit("emd"))], F.lit(""))


#: Types that a criterion may have; another counts as the last but one.
CRITERION_TYPES = ("numeric_threshold", "categorical_presence", "temporal_recency", "qualitative_assessment", "composite")


def criterion_type(stated: Column) -> Column:
    """A criterion's type (P20): what is stated if it is one, else qualitative."""
    return F.when(stated.isin(*CRITERION_TYPES), stated).otherwise("qualitative_assessment")


def harmonic(*parts: Column) -> Column:
    """Harmonic mean of the parts that aren't null (P12); 0 if there is none or one isn't positive."""
    present = F.filter(F.array(*(p.cast("double") for p in parts)), lambda x: x.isNotNull())
    total = F.aggregate(present, F.lit(0.0), lambda acc, x: acc + F.when(x > 0, 1.0 / x).otherwise(0.0))
    return F.when((F.size(present) == 0) | F.exists(present, lambda x: x <= 0), F.lit(0.0)).otherwise(F.size(present) / total)


def file_format(name: Column) -> Column:
    """pdf, docx, image or unknown, by the extension."""
    end = F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"(\.[^.]+)$", 1))
    return F.when(end == ".pdf", "pdf").when(end == ".docx", "docx").when(end.isin(".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp"), "image").otherwise("unknown")
