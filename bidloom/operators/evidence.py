"""Evidence for each cell (tender, bidder, criterion): reconciling what rules and models found, verdict, confidence, route.

All are projections over one row per cell, so no step here shuffles. Model outputs are input columns, never calls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidloom.functions.values import harmonic

#: Tolerance of numeric agreement; thresholds of the router (warm, cold) and the precedents that make it warm.
TOLERANCE = 0.05
AUTO_COMMIT, REVIEW_FLOOR = {"warm": 0.92, "cold": 0.95}, {"warm": 0.50, "cold": 0.60}
WARM_AT = 50


def reconcile_numeric(cells: DataFrame) -> DataFrame:
    """Figures of rules and model become one list.

    Input: rules_figures, model_figures (arrays of rupees, null or empty if none), rules_confidence, model_confidence,
    has_documents. Adds figures, agreement, agreement_score, extraction_confidence, ocr_confidence, method; no figures means
    the cell is filled as missing evidence (J23).
    """
    rules, model = (F.coalesce(F.col(f"{x}_figures"), F.expr("array()").cast("array<bigint>")) for x in ("rules", "model"))
    r, m = (F.array_max(x).cast("double") for x in (rules, model))
    best = F.greatest(F.coalesce("rules_confidence", F.lit(0.0)), F.coalesce("model_confidence", F.lit(0.0)))
    both = (F.size(rules) > 0) & (F.size(model) > 0)
    apart = both & (F.greatest(r, m) > 0) & (F.abs(r - m) / F.greatest(r, m) > TOLERANCE)
    figures = F.when(F.size(model) > 0, model).otherwise(rules)
    none = F.size(figures) == 0
    return cells.select(
        "*",
        figures.alias("figures"),
        F.when(~none & apart, "disagree").otherwise("agree").alias("agreement"),
        F.when(~none & apart, 0.4).otherwise(1.0).alias("agreement_score"),
        F.when(none, F.when(F.col("has_documents"), 0.78).otherwise(0.0)).when(apart, best * 0.7).otherwise(F.least(F.lit(0.95), best + 0.05)).alias("extraction_confidence"),
        F.when(F.col("has_documents"), 0.85).otherwise(0.0).alias("ocr_confidence"),
        F.when(both, "rules+llm").when(F.size(model) > 0, "llm").otherwise("rules").alias("method"),
    )


def reconcile_value(rules_found: Column, model_found: Column, rules: Column, model: Column, rules_confidence: Column, model_confidence: Column) -> Column:
    """One figure of each branch as struct(agreement, score, value, picked, confidence)."""
    out = lambda a, s, v, p, c: F.struct(F.lit(a).alias("agreement"), F.lit(s).alias("score"), v.alias("value"), F.lit(p).alias("picked"), c.cast("double").alias("confidence"))
    big, small = F.greatest(rules, model), F.least(rules, model)
    close = (big == 0) | ((big - small) / big <= TOLERANCE)
    both = rules_found & model_found
    top = F.greatest(rules_confidence, model_confidence)
    return (
        F.when(~rules_found & ~model_found, out("agree", 1.0, F.lit(None).cast("bigint"), "none", F.lit(0.0)))
        .when(both & close, out("agree", 1.0, model, "both", F.least(F.lit(0.95), top + 0.05)))
        .when(both & (model_confidence >= rules_confidence), out("disagree", 0.4, model, "llm", model_confidence * 0.7))
        .when(both, out("disagree", 0.4, rules, "rules", rules_confidence * 0.7))
        .when(model_found, out("partial", 0.7, model, "llm", model_confidence * 0.85))
        .otherwise(out("partial", 0.7, rules, "rules", rules_confidence * 0.85))
    )


def reconcile_categorical(rules_found: Column, model_found: Column, rules_number: Column, model_number: Column, rules_confidence: Column, model_confidence: Column) -> Column:
    """Certificates of both branches as struct(found, agreement, score, picked, registration, confidence)."""
    number = F.coalesce(F.upper(rules_number), F.lit("")) == F.coalesce(F.upper(model_number), F.lit(""))
    both, top = rules_found & model_found, F.greatest(rules_confidence, model_confidence)
    picked = F.when(both & number, "both").when(both, F.when(model_confidence >= rules_confidence, "llm").otherwise("rules")).when(model_found, "llm").when(rules_found, "rules").otherwise("none")
    confidence = (
        F.when(both & number, F.least(F.lit(0.95), top + 0.05)).when(both, top * 0.7).when(model_found, model_confidence * 0.85).when(rules_found, rules_confidence * 0.85).otherwise(0.65)
    )
    return F.struct(
        (rules_found | model_found).alias("found"),
        F.when(both & number, "agree").when(both, "disagree").when(rules_found | model_found, "partial").otherwise("agree").alias("agreement"),
        F.when(both & ~number, 0.4).when(rules_found != model_found, 0.7).otherwise(1.0).alias("score"),
        picked.alias("picked"),
        F.when(picked.isin("both", "llm"), model_number).when(picked == "rules", rules_number).alias("registration"),
        F.round(confidence, 4).alias("confidence"),
    )


def reconcile_temporal(rules_count: Column, model_count: Column, model_error: Column, rules_confidence: Column, model_confidence: Column) -> Column:
    """Counts of both branches as struct(agreement, score, picked, count, confidence) (J21); null count if nothing is known."""
    near = F.abs(rules_count - model_count) <= 1
    fallback = model_error & (rules_count > 0)
    return F.struct(
        F.when(fallback, "partial").when(model_error | near, "agree").otherwise("disagree").alias("agreement"),
        F.when(fallback, 0.5).when(model_error | near, 1.0).otherwise(0.4).alias("score"),
        F.when(fallback, "rules").when(model_error, "none").otherwise("llm").alias("picked"),
        F.when(fallback, rules_count).when(~model_error, model_count).alias("count"),
        F.round(F.when(fallback, F.least(rules_confidence, F.lit(0.6))).when(model_error, 0.78).when(near, F.least(F.lit(0.92), model_confidence + 0.05)).otherwise(model_confidence * 0.7), 4).alias("confidence"),
    )


def numeric_verdict(figures: Column, threshold: Column, rule: Column, periods: Column) -> Column:
    """struct(verdict, basis) from figures in found order (P13): each, average, any or cumulative of n, else the largest one."""
    n, found = periods.cast("int"), F.size(figures)
    first = F.slice(figures, 1, F.greatest(n, F.lit(1)))
    total = F.aggregate(first, F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    out = lambda ok, basis: F.struct(F.when(ok, "PASS").otherwise("FAIL").alias("verdict"), F.lit(basis).alias("basis"))
    review = lambda basis: F.struct(F.lit("REVIEW").alias("verdict"), basis.alias("basis"))
    missing = review(F.concat(F.lit("missing_periods_found_"), found.cast("string"), F.lit("_of_"), n.cast("string")))
    return (
        F.when((F.coalesce(threshold, F.lit(0)) == 0) | (found <= 0), review(F.lit("rules_unclear")))
        .when(rule.isin("each_of_n_years", "average_of_n_years", "cumulative_n_years") & (found < n), missing)
        .when(rule == "each_of_n_years", out(F.forall(first, lambda x: x >= threshold), "rules_each_year"))
        .when(rule == "average_of_n_years", out(total / n >= threshold, "rules_average"))
        .when(rule == "any_of_n_years", out(F.exists(figures, lambda x: x >= threshold), "rules_any_year"))
        .when(rule == "cumulative_n_years", out(total >= threshold, "rules_cumulative"))
        .otherwise(out(F.array_max(figures) >= threshold, "rules_single"))
    )


def typed_verdict(cells: DataFrame) -> DataFrame:
    """Adds verdict and basis for any criterion type.

    Input: criterion_type, has_value, extraction_confidence; figures, threshold, rule, periods; found, is_valid;
    qualifying_count, required_count; model_verdict.
    """
    out = lambda verdict, basis: F.struct(verdict.alias("verdict"), basis.alias("basis"))
    lit = lambda verdict, basis: out(F.lit(verdict), F.lit(basis))
    kind, found, valid = F.col("criterion_type"), F.col("found"), F.col("is_valid")
    missing = F.when(F.coalesce("extraction_confidence", F.lit(0.0)) >= 0.5, lit("FAIL", "evidence_missing_in_submission")).otherwise(lit("REVIEW", "no_evidence"))
    categorical = F.when(~F.coalesce(found, F.lit(False)), lit("FAIL", "rules_not_found")).when(valid, lit("PASS", "rules_valid")).when(~valid, lit("FAIL", "rules_expired")).otherwise(lit("REVIEW", "rules_validity_unclear"))
    enough = F.coalesce("qualifying_count", F.lit(0)) >= F.coalesce("required_count", F.lit(3))
    temporal = F.when(enough, lit("PASS", "rules_count")).otherwise(lit("FAIL", "rules_count"))
    stated = F.col("model_verdict").isin("PASS", "FAIL", "REVIEW")
    qualitative = F.when(stated, out(F.col("model_verdict"), F.lit("llm"))).otherwise(lit("REVIEW", "llm_unclear"))
    verdict = (
        F.when(~F.col("has_value"), missing)
        .when(kind == "numeric_threshold", numeric_verdict(F.col("figures"), F.col("threshold"), F.col("rule"), F.col("periods")))
        .when(kind == "categorical_presence", categorical)
        .when(kind == "temporal_recency", temporal)
        .when(kind == "qualitative_assessment", qualitative)
        .otherwise(lit("REVIEW", "unknown_type"))
    )
    return cells.withColumn("_verdict", verdict).select("*", "_verdict.verdict", "_verdict.basis").drop("_verdict")


def mosaic(cells: DataFrame) -> DataFrame:
    """Adds the seven confidence components and their harmonic mean as ``confidence``.

    Input: criterion_type, ocr_confidence, extraction_confidence, entity_match_flag, rules_found, rules_confidence, model_found,
    model_confidence, has_date.
    """
    zero = F.lit(0.0)
    ocr, field = F.coalesce("ocr_confidence", zero), F.coalesce("extraction_confidence", zero)
    rules = F.when(F.col("rules_found"), F.coalesce("rules_confidence", zero))
    model = F.when(F.col("model_found"), F.coalesce("model_confidence", zero))
    parts = {
        "ocr_quality": ocr,
        "field_extraction": field,
        "entity_match": F.when(F.coalesce("entity_match_flag", F.lit(False)), 0.0).otherwise(1.0),
        "date_parsing": F.when(F.col("criterion_type").isin("temporal_recency", "categorical_presence"), F.when(F.col("has_date"), 0.85).otherwise(0.4)),
        "semantic_match": F.when(F.col("criterion_type") == "qualitative_assessment", F.coalesce(model, field)),
        "rules_branch": rules,
        "llm_branch": model,
    }
    return cells.select("*", F.struct(*(c.alias(k) for k, c in parts.items())).alias("breakdown"), harmonic(*parts.values()).alias("confidence"))


def with_signals(severities: Column, agreement: Column, dissent: Column) -> Column:
    """Severities of a cell's flags, with medium added for disagreeing branches and high for high dissent."""
    none = F.expr("cast(array() as array<string>)")
    return F.concat(F.coalesce(severities, none), F.when(agreement == "disagree", F.array(F.lit("medium"))).otherwise(none), F.when(dissent == "high", F.array(F.lit("high"))).otherwise(none))


def route(cells: DataFrame, precedents: Column) -> DataFrame:
    """Adds route, reason, second_officer and triggers (P17); the first rule that fits decides.

    Input: verdict, confidence, criterion_type, is_mandatory, override_permitted, severities (array). ``precedents`` is the size
    of the precedent corpus: under WARM_AT the stricter thresholds hold.
    """
    cold = precedents < WARM_AT
    auto, floor = (F.when(cold, t["cold"]).otherwise(t["warm"]) for t in (AUTO_COMMIT, REVIEW_FLOOR))
    kind, confidence, fail = F.col("criterion_type"), F.col("confidence"), F.col("verdict") == "FAIL"
    has = lambda s: F.array_contains("severities", s)
    percent = lambda c: F.concat(F.round(c * 100, 0).cast("int").cast("string"), F.lit("%"))
    rules = [
        (F.col("is_mandatory") & fail, "mandatory_review", F.lit("Mandatory criterion failed; an officer confirms before exclusion."), F.col("override_permitted"), "mandatory_fail"),
        (has("high"), "mandatory_review", F.lit("A flag of high severity needs an officer's confirmation."), F.lit(False), "high_severity_anomaly"),
        (fail & (kind == "qualitative_assessment"), "hitl_review", F.lit("A qualitative FAIL is never committed alone."), F.lit(False), "llm_fail_no_auto"),
        (confidence < floor, "mandatory_review", F.concat(F.lit("Confidence "), percent(confidence), F.lit(" is under the floor.")), F.lit(False), "low_confidence"),
        (has("medium"), "hitl_review", F.lit("A flag of medium severity needs review."), F.lit(False), "medium_severity_anomaly"),
        (confidence < auto, "hitl_review", F.concat(F.lit("Confidence "), percent(confidence), F.lit(" is under the threshold.")), F.lit(False), "mid_confidence"),
        (kind.isin("numeric_threshold", "categorical_presence", "temporal_recency"), "auto_commit", F.concat(F.lit("Deterministic at confidence "), percent(confidence), F.lit(".")), F.lit(False), "deterministic_high_confidence"),
        (F.lit(True), "hitl_review", F.lit("Qualitative criteria go to an officer."), F.lit(False), "qualitative_default_hitl"),
    ]
    chosen = None
    for when, to, reason, second, trigger in rules:
        value = F.struct(F.lit(to).alias("route"), reason.alias("reason"), F.coalesce(second, F.lit(False)).alias("second_officer"), F.lit(trigger).alias("trigger"))
        chosen = F.when(when, value) if chosen is None else chosen.when(when, value)
    triggers = F.when(cold, F.array(F.lit("cold_start_thresholds"), F.col("_route.trigger"))).otherwise(F.array(F.col("_route.trigger")))
    return cells.withColumn("_route", chosen).select("*", "_route.route", "_route.reason", "_route.second_officer", triggers.alias("triggers")).drop("_route")


#: The sentences of an explanation; {} stands for what is put in.
SAID = {
    "PASS": "I'm {}% confident this satisfies {}.", "FAIL": "I'm {}% confident this does not satisfy {}.", "REVIEW": "I cannot determine this with confidence (currently {}%).",
    "not_found": "I read the bidder's submission but did not find this figure. Officer to verify whether the supporting document is missing.", "no_document": "Bidder has not uploaded the relevant supporting document.",
    "few": "Note: criterion expects {} period(s) but only {} found.", "absent": "Required document was not found in the bidder's submission.", "projects": "Found {} qualifying project(s) (required: {})",
    "disagree": "Note: rules and LLM extractors disagreed; officer review is recommended.", "partial": "Note: only one extractor branch found a value.", "nothing": "Refer to the source document.",
    "auto_commit": "I will record this as confirmed unless you override.", "hitl_review": "Please review and confirm. {}", "mandatory_review": "Officer review required. {}",
}
#: Names of the confidence components, and the unit words of amounts.
COMPONENTS = {"ocr_quality": "Ocr Quality", "field_extraction": "Field Extraction", "entity_match": "Entity Match", "date_parsing": "Date Parsing", "semantic_match": "Semantic Match", "rules_branch": "Rules Branch", "llm_branch": "Llm Branch"}


def _said(name: str, *parts: Column) -> Column:
    texts = SAID[name].split("{}")
    return F.concat(*(x for t, p in zip(texts, [*parts, None], strict=True) for x in ([F.lit(t)] if t else []) + ([p.cast("string")] if p is not None else [])))


def _amount(rupees: Column) -> Column:
    return F.when(rupees >= 10_000_000, F.format_string("Rs. %.2f Cr", F.floor((rupees + 50_000) / 100_000) / 100)).when(rupees >= 100_000, F.format_string("Rs. %.2f L", F.floor((rupees + 500) / 1000) / 100)).otherwise(F.concat(F.lit("Rs. "), F.format_number(rupees, 0)))


def percent(share: Column) -> Column:
    """A share as whole percent; halves go to the even number."""
    return F.bround(share * 100, 0).cast("int")


def explained(cells: DataFrame) -> DataFrame:
    """Adds headline, detail, facts, source_reference and next_action (P19), each made of what the cell holds.

    Beside what ``mosaic`` and ``route`` give, cells have clause, source_doc and source_page (null: none), expected_count,
    registration, kind and validity_date of a certificate, reasoning, and figures with threshold. Where no value was found the
    detail says whether a document was there; else it goes by the criterion's type. What applies to no case is left out.
    """
    clause = F.coalesce("clause", F.lit("the criterion"))
    pct = percent(F.col("confidence"))
    head = F.when(F.col("verdict") == "PASS", _said("PASS", pct, clause)).when(F.col("verdict") == "FAIL", _said("FAIL", pct, clause)).otherwise(_said("REVIEW", pct))
    kind, count = F.col("criterion_type"), F.size("figures")
    lines = F.transform("figures", lambda f: F.concat(F.when(f >= F.col("threshold"), "✓").otherwise("✗"), F.lit(" (unspecified): "), _amount(f)))
    figures = F.when(count > 0, F.concat(F.lit("Figures found: "), F.array_join(lines, " · ")))
    few = F.when((count > 0) & (count < F.col("expected_count")), _said("few", F.col("expected_count"), count))
    found = F.coalesce("found", F.lit(False))
    certificate = F.when(found, F.concat(F.lit("Found "), F.upper(F.coalesce("kind", F.lit("certificate"))), F.lit(": "), F.coalesce("registration", F.lit("None")))).otherwise(_said("absent"))
    validity = F.when(found & F.col("validity_date").isNotNull(), F.concat(F.lit("Validity: "), F.col("validity_date")))
    projects = _said("projects", F.coalesce("qualifying_count", F.lit(0)), F.coalesce("required_count", F.lit(0)))
    typed = (
        F.when(~F.col("has_value"), F.array(F.when(F.col("has_documents"), _said("not_found")).otherwise(_said("no_document"))))
        .when(kind == "numeric_threshold", F.array(figures, few))
        .when(kind == "categorical_presence", F.array(certificate, validity))
        .when(kind == "temporal_recency", F.array(projects))
        .otherwise(F.array(F.substring("reasoning", 1, 220)))
    )
    note = F.when(F.col("agreement") == "disagree", _said("disagree")).when(F.col("agreement") == "partial", _said("partial"))
    parts = F.filter(F.concat(typed, F.array(note)), lambda p: p.isNotNull())
    detail = F.when(F.size(parts) > 0, F.array_join(parts, " ")).otherwise(_said("nothing"))
    facts = F.array_compact(F.array(*(F.when(F.col(f"breakdown.{k}").isNotNull(), F.concat(F.lit(f"{name}: "), percent(F.col(f"breakdown.{k}")).cast("string"), F.lit("%"))) for k, name in COMPONENTS.items())))
    source = F.when(F.col("source_doc").isNull(), "").otherwise(F.concat(F.lit("Source: doc "), F.substring("source_doc", 1, 8), F.when(F.col("source_page").isNotNull(), F.concat(F.lit(", page "), F.col("source_page").cast("string"))).otherwise("")))
    action = F.when(F.col("route") == "auto_commit", _said("auto_commit")).when(F.col("route") == "hitl_review", _said("hitl_review", F.col("reason"))).otherwise(_said("mandatory_review", F.col("reason")))
    return cells.select("*", head.alias("headline"), detail.alias("detail"), facts.alias("facts"), source.alias("source_reference"), action.alias("next_action"))
