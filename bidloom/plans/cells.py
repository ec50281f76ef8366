"""Queries over the evaluation matrix."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from bidloom.functions import values as V
from bidloom.operators import evidence, listings, matrix
from bidloom.plans.registry import query
from bidloom.sources import views
from bidloom.sources.tables import table
from bidloom.sources.views import with_cte

CELL = ["tender_id", "bidder_id", "criterion_id"]


@query("j19_reconcile_numeric", f"{with_cte('numeric_v')} SELECT tender_id, bidder_id, criterion_id, CAST(len(figures) AS INT) AS n_figures, agreement, CAST(agreement_score AS DOUBLE) AS agreement_score, round(extraction_confidence, 4) AS extraction_confidence, method FROM numeric_v")
def j19_reconcile_numeric(spark, sf_dir):
    return views.reconciled(spark, sf_dir).select(*CELL, F.size("figures").alias("n_figures"), "agreement", "agreement_score", F.round("extraction_confidence", 4).alias("extraction_confidence"), "method")


@query("j23_missing_evidence", f"{with_cte('numeric_v')} SELECT tender_id, bidder_id, criterion_id, CAST(ocr_confidence AS DOUBLE) AS ocr_confidence, CAST(extraction_confidence AS DOUBLE) AS extraction_confidence FROM numeric_v WHERE len(figures) = 0")
def j23_missing_evidence(spark, sf_dir):
    return views.reconciled(spark, sf_dir).where(F.size("figures") == 0).select(*CELL, "ocr_confidence", "extraction_confidence")


@query("j22_reconcile_value", f"""{with_cte('recon_v')}, m AS (SELECT tender_id, bidder_id, criterion_id, len(rules_figures) > 0 AS rf, len(model_figures) > 0 AS mf, list_max(rules_figures) AS r, list_max(model_figures) AS m, rules_confidence AS rc, model_confidence AS mc FROM recon_v),
    n AS (SELECT *, (greatest(r, m) - least(r, m)) / greatest(r, m) <= 0.05 AS close FROM m)
    SELECT tender_id, bidder_id, criterion_id, CASE WHEN NOT rf AND NOT mf THEN 'agree' WHEN rf AND mf THEN CASE WHEN close THEN 'agree' ELSE 'disagree' END ELSE 'partial' END AS agreement,
      CASE WHEN NOT rf AND NOT mf THEN NULL WHEN rf AND mf THEN CASE WHEN close OR mc >= rc THEN m ELSE r END WHEN mf THEN m ELSE r END AS value,
      CASE WHEN NOT rf AND NOT mf THEN 'none' WHEN rf AND mf THEN CASE WHEN close THEN 'both' WHEN mc >= rc THEN 'llm' ELSE 'rules' END WHEN mf THEN 'llm' ELSE 'rules' END AS picked,
      round(CASE WHEN NOT rf AND NOT mf THEN 0.0 WHEN rf AND mf THEN CASE WHEN close THEN least(0.95, greatest(rc, mc) + 0.05) ELSE greatest(rc, mc) * 0.7 END WHEN mf THEN mc * 0.85 ELSE rc * 0.85 END, 4) AS confidence FROM n""")
def j22_reconcile_value(spark, sf_dir):
    r, m = F.array_max("rules_figures"), F.array_max("model_figures")
    found = views.reconciled(spark, sf_dir).withColumn("one", evidence.reconcile_value(F.size("rules_figures") > 0, F.size("model_figures") > 0, r, m, F.col("rules_confidence"), F.col("model_confidence")))
    return found.select(*CELL, "one.agreement", "one.value", "one.picked", F.round("one.confidence", 4).alias("confidence"))


@query("p13_numeric_verdict", f"{with_cte('cell_v')} SELECT tender_id, bidder_id, criterion_id, verdict FROM cell_v")
def p13_numeric_verdict(spark, sf_dir):
    return views.cells(spark, sf_dir).select(*CELL, "verdict")


@query("p11_p12_mosaic", f"{with_cte('cell_v')} SELECT tender_id, bidder_id, criterion_id, round(confidence, 4) AS confidence FROM cell_v")
def p11_p12_mosaic(spark, sf_dir):
    return views.cells(spark, sf_dir).select(*CELL, F.round("confidence", 4).alias("confidence"))


@query("p17_p18_routing", f"{with_cte('routed_v')} SELECT tender_id, bidder_id, criterion_id, route, second_officer FROM routed_v")
def p17_p18_routing(spark, sf_dir):
    return views.cells(spark, sf_dir).select(*CELL, "route", "second_officer")


@query("p17_routing_cold", f"""{with_cte('cell_v')} SELECT tender_id, bidder_id, criterion_id, CASE WHEN is_mandatory AND verdict = 'FAIL' THEN 'mandatory_review' WHEN dissent = 'high' THEN 'mandatory_review' WHEN confidence < 0.6 THEN 'mandatory_review'
    WHEN agreement = 'disagree' THEN 'hitl_review' WHEN confidence < 0.95 THEN 'hitl_review' ELSE 'auto_commit' END AS route,
    CASE WHEN is_mandatory AND verdict = 'FAIL' THEN 'mandatory_fail' WHEN dissent = 'high' THEN 'high_severity_anomaly' WHEN confidence < 0.6 THEN 'low_confidence' WHEN agreement = 'disagree' THEN 'medium_severity_anomaly' WHEN confidence < 0.95 THEN 'mid_confidence' ELSE 'deterministic_high_confidence' END AS deciding FROM cell_v""")
def p17_routing_cold(spark, sf_dir):
    return views.cells(spark, sf_dir, precedents=0).select(*CELL, "route", F.element_at("triggers", -1).alias("deciding"))


_AMOUNT = "CASE WHEN f >= 10000000 THEN printf('Rs. %.2f Cr', (f + 50000) // 100000 / 100) WHEN f >= 100000 THEN printf('Rs. %.2f L', (f + 500) // 1000 / 100) ELSE format('Rs. {:,}', f) END"
_FACTS = {"Ocr Quality": "n.ocr_confidence", "Field Extraction": "n.extraction_confidence", "Entity Match": "1.0", "Rules Branch": "CASE WHEN len(n.rules_figures) > 0 THEN n.rules_confidence END", "Llm Branch": "CASE WHEN len(n.model_figures) > 0 THEN n.model_confidence END"}
_THRESHOLD = " ".join(f"WHEN '{k}' THEN {t}" for k, (_, _, t, _) in views.CRITERIA.items())
_PERIODS = " ".join(f"WHEN '{k}' THEN {n}" for k, (_, n, _, _) in views.CRITERIA.items())


@query("p19_explanation", f"""{with_cte('routed_v', 'numeric_v')}, e AS (SELECT r.*, CAST(round_even(r.confidence * 100, 0) AS INT) AS pct, CASE r.criterion_id {_PERIODS} END AS periods, list_transform(r.figures, lambda f: CASE WHEN f >= CASE r.criterion_id {_THRESHOLD} END THEN '✓' ELSE '✗' END || ' (unspecified): ' || {_AMOUNT}) AS lines,
      list_filter([{", ".join(f"'{name}: ' || CAST(round_even({c} * 100, 0) AS INT) || '%'" for name, c in _FACTS.items())}], lambda x: x IS NOT NULL) AS facts FROM routed_v r JOIN numeric_v n ON n.tender_id = r.tender_id AND n.bidder_id = r.bidder_id AND n.criterion_id = r.criterion_id)
    SELECT evaluation_id, CASE verdict WHEN 'PASS' THEN 'I''m ' || pct || '% confident this satisfies clause ' || criterion_id || '.' WHEN 'FAIL' THEN 'I''m ' || pct || '% confident this does not satisfy clause ' || criterion_id || '.' ELSE 'I cannot determine this with confidence (currently ' || pct || '%).' END AS headline,
      concat_ws(' ', CASE WHEN len(figures) > 0 THEN 'Figures found: ' || array_to_string(lines, ' · ') WHEN has_documents THEN 'I read the bidder''s submission but did not find this figure. Officer to verify whether the supporting document is missing.' ELSE 'Bidder has not uploaded the relevant supporting document.' END,
        CASE WHEN len(figures) > 0 AND len(figures) < periods THEN 'Note: criterion expects ' || periods || ' period(s) but only ' || len(figures) || ' found.' END, CASE WHEN agreement = 'disagree' THEN 'Note: rules and LLM extractors disagreed; officer review is recommended.' END) AS detail, facts,
      CASE WHEN bidder_id % 4 = 0 THEN '' ELSE 'Source: doc ' || substr('file-' || bidder_id || '-scan', 1, 8) || CASE WHEN bidder_id % 4 = 1 THEN ', page ' || bidder_id % 9 ELSE '' END END AS source_reference,
      CASE route WHEN 'auto_commit' THEN 'I will record this as confirmed unless you override.' WHEN 'hitl_review' THEN 'Please review and confirm.' ELSE 'Officer review required.' END AS asked FROM e""")
def p19_explanation(spark, sf_dir):
    """All parts of the explanation; of the next action what comes before the router's own reason."""
    k = F.col("bidder_id")
    cells = views.cells(spark, sf_dir).withColumns({
        "clause": F.concat(F.lit("clause "), F.col("criterion_id")), "source_doc": F.when(k % 4 != 0, F.concat(F.lit("file-"), k.cast("string"), F.lit("-scan"))), "source_page": F.when(k % 4 == 1, k % 9), "expected_count": F.col("periods"),
        **{c: F.lit(None).cast("string") for c in ("kind", "registration", "validity_date", "reasoning")},
    })
    asked = F.when(F.col("route") == "auto_commit", F.col("next_action")).otherwise(F.regexp_extract("next_action", r"^[^.]*\.", 0))
    return evidence.explained(cells).select("evaluation_id", "headline", "detail", "facts", "source_reference", asked.alias("asked"))


TYPED = """typed_v AS (SELECT o_orderkey AS cell, CASE o_orderpriority WHEN '1-URGENT' THEN 'numeric_threshold' WHEN '2-HIGH' THEN 'categorical_presence' WHEN '3-MEDIUM' THEN 'temporal_recency' WHEN '4-NOT SPECIFIED' THEN 'qualitative_assessment' ELSE 'composite' END AS criterion_type,
    o_orderkey % 11 <> 0 AS has_value, (o_orderkey % 100) / 100 AS conf, CAST(trunc(o_totalprice) AS BIGINT) AS amount, o_orderkey % 3 <> 0 AS found, CASE o_orderkey % 4 WHEN 0 THEN true WHEN 1 THEN false END AS is_valid, o_orderkey % 6 AS n,
    CASE o_orderstatus WHEN 'F' THEN 'FAIL' WHEN 'O' THEN 'PASS' ELSE 'unsure' END AS said FROM orders)"""


_TYPED_PARTS = """[0.9, conf, CASE WHEN cell % 13 = 0 THEN 0.0 ELSE 1.0 END, CASE WHEN criterion_type IN ('temporal_recency', 'categorical_presence') THEN CASE WHEN cell % 5 = 0 THEN 0.85 ELSE 0.4 END END,
  CASE WHEN criterion_type = 'qualitative_assessment' THEN CASE WHEN cell % 3 = 0 THEN 0.8 ELSE conf END END, CASE WHEN cell % 2 = 0 THEN 0.7 END, CASE WHEN cell % 3 = 0 THEN 0.8 END]"""


@query("p11_components", f"""WITH {TYPED}, p AS (SELECT cell, criterion_type, list_filter({_TYPED_PARTS}, lambda x: x IS NOT NULL) AS parts FROM typed_v)
    SELECT cell, criterion_type, CAST(len(parts) AS INT) AS components, CASE WHEN list_min(parts) <= 0 THEN 0.0 ELSE round(len(parts) / list_sum(list_transform(parts, lambda x: 1 / x)), 6) END::DOUBLE AS confidence FROM p""")
def p11_components(spark, sf_dir):
    """Components of all criterion types, with entity, date and semantic ones, and their harmonic mean."""
    k = F.col("cell")
    kinds = {"1-URGENT": "numeric_threshold", "2-HIGH": "categorical_presence", "3-MEDIUM": "temporal_recency", "4-NOT SPECIFIED": "qualitative_assessment"}
    cells = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("cell"), V.lookup(F.col("o_orderpriority"), kinds, F.lit("composite")).alias("criterion_type"))
    cells = cells.withColumns({
        "ocr_confidence": F.lit(0.9), "extraction_confidence": (k % 100) / 100, "entity_match_flag": k % 13 == 0, "rules_found": k % 2 == 0, "rules_confidence": F.lit(0.7), "model_found": k % 3 == 0, "model_confidence": F.lit(0.8), "has_date": k % 5 == 0,
    })
    found = evidence.mosaic(cells)
    many = F.size(F.array_compact(F.array(*(F.col(f"breakdown.{c}") for c in evidence.COMPONENTS))))
    return found.select("cell", "criterion_type", many.alias("components"), F.round("confidence", 6).alias("confidence"))


@query("p14_p16_typed_verdict", f"""WITH {TYPED} SELECT cell, criterion_type, CASE WHEN NOT has_value THEN CASE WHEN conf >= 0.5 THEN 'FAIL' ELSE 'REVIEW' END
    WHEN criterion_type = 'numeric_threshold' THEN CASE WHEN amount >= 150000 THEN 'PASS' ELSE 'FAIL' END
    WHEN criterion_type = 'categorical_presence' THEN CASE WHEN NOT found THEN 'FAIL' WHEN is_valid THEN 'PASS' WHEN NOT is_valid THEN 'FAIL' ELSE 'REVIEW' END
    WHEN criterion_type = 'temporal_recency' THEN CASE WHEN n >= 3 THEN 'PASS' ELSE 'FAIL' END
    WHEN criterion_type = 'qualitative_assessment' AND said IN ('PASS', 'FAIL') THEN said ELSE 'REVIEW' END AS verdict FROM typed_v""")
def p14_p16_typed_verdict(spark, sf_dir):
    orders = views.table(spark, sf_dir, "orders")
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "numeric_threshold").when(F.col("o_orderpriority") == "2-HIGH", "categorical_presence").when(F.col("o_orderpriority") == "3-MEDIUM", "temporal_recency").when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "qualitative_assessment").otherwise("composite")
    key = F.col("o_orderkey")
    cells = orders.select(
        key.alias("cell"), kind.alias("criterion_type"), (key % 11 != 0).alias("has_value"), ((key % 100) / 100).alias("extraction_confidence"), F.array(F.col("o_totalprice").cast("bigint")).alias("figures"),
        F.lit(150_000).alias("threshold"), F.lit("single").alias("rule"), F.lit(1).alias("periods"), (key % 3 != 0).alias("found"), F.when(key % 4 == 0, True).when(key % 4 == 1, False).alias("is_valid"),
        (key % 6).alias("qualifying_count"), F.lit(3).alias("required_count"), F.when(F.col("o_orderstatus") == "F", "FAIL").when(F.col("o_orderstatus") == "O", "PASS").otherwise("unsure").alias("model_verdict"),
    )
    return evidence.typed_verdict(cells).select("cell", "criterion_type", "verdict")


BRANCH = "b AS (SELECT o_orderkey AS cell, o_orderkey % 3 <> 0 AS rf, o_orderkey % 4 <> 0 AS mf, 'R' || (o_custkey % 5) AS rr, 'r' || (o_custkey % 4) AS mr, 0.65 AS rc, 0.6 + (o_orderkey % 30) / 100 AS mc, o_orderkey % 7 AS rn, o_orderkey % 5 AS mn, o_orderkey % 13 = 0 AS err FROM orders)"


def _branches(spark, sf_dir):
    key = F.col("o_orderkey")
    return views.table(spark, sf_dir, "orders").select(
        key.alias("cell"), (key % 3 != 0).alias("rf"), (key % 4 != 0).alias("mf"), F.concat(F.lit("R"), (F.col("o_custkey") % 5).cast("string")).alias("rr"), F.concat(F.lit("r"), (F.col("o_custkey") % 4).cast("string")).alias("mr"),
        F.lit(0.65).alias("rc"), (0.6 + (key % 30) / 100).alias("mc"), (key % 7).alias("rn"), (key % 5).alias("mn"), (key % 13 == 0).alias("err"),
    )


@query("j20_reconcile_categorical", f"""WITH {BRANCH} SELECT cell, rf OR mf AS found, CASE WHEN rf AND mf THEN CASE WHEN upper(rr) = upper(mr) THEN 'agree' ELSE 'disagree' END WHEN rf OR mf THEN 'partial' ELSE 'agree' END AS agreement,
    CASE WHEN rf AND mf AND upper(rr) = upper(mr) THEN 'both' WHEN rf AND mf THEN CASE WHEN mc >= rc THEN 'llm' ELSE 'rules' END WHEN mf THEN 'llm' WHEN rf THEN 'rules' ELSE 'none' END AS picked,
    round(CASE WHEN rf AND mf THEN CASE WHEN upper(rr) = upper(mr) THEN least(0.95, greatest(rc, mc) + 0.05) ELSE greatest(rc, mc) * 0.7 END WHEN mf THEN mc * 0.85 WHEN rf THEN rc * 0.85 ELSE 0.65 END, 4) AS confidence FROM b""")
def j20_reconcile_categorical(spark, sf_dir):
    one = evidence.reconcile_categorical(*(F.col(c) for c in ("rf", "mf", "rr", "mr", "rc", "mc")))
    return _branches(spark, sf_dir).withColumn("one", one).select("cell", "one.found", "one.agreement", "one.picked", "one.confidence")


@query("j21_reconcile_temporal", f"""WITH {BRANCH} SELECT cell, CASE WHEN err AND rn > 0 THEN 'partial' WHEN err OR abs(rn - mn) <= 1 THEN 'agree' ELSE 'disagree' END AS agreement,
    CASE WHEN err AND rn > 0 THEN rn WHEN NOT err THEN mn END AS qualifying, round(CASE WHEN err AND rn > 0 THEN least(rc, 0.6) WHEN err THEN 0.78 WHEN abs(rn - mn) <= 1 THEN least(0.92, mc + 0.05) ELSE mc * 0.7 END, 3) AS confidence FROM b""")
def j21_reconcile_temporal(spark, sf_dir):
    one = evidence.reconcile_temporal(*(F.col(c) for c in ("rn", "mn", "err", "rc", "mc")))
    return _branches(spark, sf_dir).withColumn("one", one).select("cell", "one.agreement", F.col("one.count").alias("qualifying"), F.round("one.confidence", 3).alias("confidence"))


COUNTS = "SELECT tender_id, bidder_id, count(*) FILTER (verdict = 'PASS') AS passes, count(*) FILTER (verdict = 'FAIL') AS fails, count(*) FILTER (verdict = 'REVIEW') AS reviews, count(*) AS total FROM cell_v GROUP BY 1, 2"


@query("a1_verdict_distribution", f"{with_cte('cell_v')} {COUNTS}")
def a1_verdict_distribution(spark, sf_dir):
    return matrix.verdict_counts(views.cells(spark, sf_dir), ["tender_id", "bidder_id"])


@query("p23_eligibility", f"{with_cte('cell_v')}, c AS ({COUNTS}) SELECT tender_id, bidder_id, CASE WHEN 10 * fails > 3 * total THEN 'NOT ELIGIBLE' WHEN 2 * passes > total THEN 'ELIGIBLE' ELSE 'NEEDS REVIEW' END AS eligibility FROM c")
def p23_eligibility(spark, sf_dir):
    return matrix.eligibility(matrix.verdict_counts(views.cells(spark, sf_dir), ["tender_id", "bidder_id"])).select("tender_id", "bidder_id", "eligibility")


@query("a2_run_summary", f"""{with_cte('routed_v')} SELECT tender_id, count(*) AS total, count(*) FILTER (route = 'auto_commit') AS auto_commit, count(*) FILTER (route = 'hitl_review') AS hitl_review, count(*) FILTER (route = 'mandatory_review') AS mandatory_review,
    count(*) FILTER (agreement = 'disagree' OR dissent = 'high') AS flagged, CASE WHEN count(*) FILTER (route <> 'auto_commit') > 0 THEN 'HITL_PENDING' ELSE 'EVALUATION_COMPLETE' END AS next_state FROM routed_v GROUP BY 1""")
def a2_run_summary(spark, sf_dir):
    return matrix.run_summary(views.cells(spark, sf_dir))


HEAT = """o AS (SELECT evaluation_id AS e, count(*) FILTER (severity = 'high') AS h, count(*) FILTER (severity = 'medium') AS m, count(*) FILTER (severity = 'low') AS l FROM flag_v WHERE evaluation_id IS NOT NULL GROUP BY 1),
  g AS (SELECT tender_id AS t, bidder_id AS b, count(*) FILTER (severity = 'high') AS h, count(*) FILTER (severity = 'medium') AS m, count(*) FILTER (severity = 'low') AS l FROM flag_v WHERE evaluation_id IS NULL GROUP BY 1, 2),
  f AS (SELECT c.tender_id, c.bidder_id, c.criterion_id, c.evaluation_id, least(1.0, (coalesce(o.h, 0) + coalesce(g.h, 0)) * 0.4 + (coalesce(o.m, 0) + coalesce(g.m, 0)) * 0.2 + (coalesce(o.l, 0) + coalesce(g.l, 0)) * 0.05) AS anomaly,
    CASE c.dissent WHEN 'high' THEN 1.0 WHEN 'medium' THEN 0.5 WHEN 'low' THEN 0.2 ELSE 0.0 END AS dissent_factor, 1 - c.confidence AS confidence_gap
    FROM cell_v c LEFT JOIN o ON c.evaluation_id = o.e LEFT JOIN g ON c.tender_id = g.t AND c.bidder_id = g.b),
  heat AS (SELECT *, round(greatest(0.0, least(1.0, 0.4 * anomaly + 0.3 * dissent_factor + 0.3 * confidence_gap)), 3) AS risk FROM f),
  heat_v AS (SELECT *, CASE WHEN risk >= 0.6 THEN 'high' WHEN risk >= 0.3 THEN 'medium' ELSE 'low' END AS level FROM heat)"""


@query("a7_risk_heatmap", f"{with_cte('flag_v')}, {HEAT} SELECT tender_id, bidder_id, criterion_id, risk, level, CAST(round(anomaly, 2) AS DOUBLE) AS anomaly, CAST(dissent_factor AS DOUBLE) AS dissent_factor FROM heat_v")
def a7_risk_heatmap(spark, sf_dir):
    cells = views.kept_cells(spark, sf_dir)
    heat = matrix.heatmap(cells, views.flags(spark, sf_dir, cells))
    return heat.select(*CELL, "risk", "level", F.round("anomaly", 2).alias("anomaly"), "dissent_factor")


@query("a8_heatmap_rollup", f"""{with_cte('flag_v')}, {HEAT} SELECT tender_id, bidder_id, count(*) AS cells, count(*) FILTER (level = 'high') AS high_risk, count(*) FILTER (level = 'medium') AS medium_risk, count(*) FILTER (level = 'low') AS low_risk,
    round(avg(CAST(round(anomaly, 6) AS DECIMAL(18,6))), 4) AS mean_anomaly, round(avg(CAST(round(dissent_factor, 6) AS DECIMAL(18,6))), 4) AS mean_dissent_factor, round(avg(CAST(round(confidence_gap, 6) AS DECIMAL(18,6))), 4) AS mean_confidence_gap FROM heat_v GROUP BY 1, 2""")
def a8_heatmap_rollup(spark, sf_dir):
    cells = views.kept_cells(spark, sf_dir)
    return matrix.heatmap_rollup(matrix.heatmap(cells, views.flags(spark, sf_dir, cells)), ["tender_id", "bidder_id"])


@query("a9_bidder_radar", f"""{with_cte('flag_v')},
    m AS (SELECT tender_id, bidder_id, coalesce(avg(CASE WHEN money THEN points END), 50.0) AS financial, coalesce(avg(CASE WHEN NOT money THEN points END), 50.0) AS experience, CAST(round(sum(c) / count(*), 10) AS DOUBLE) * 100 AS confidence FROM (SELECT tender_id, bidder_id, CASE verdict WHEN 'PASS' THEN 100.0 WHEN 'REVIEW' THEN 50.0 ELSE 0.0 END AS points, criterion_id <> 'R' AS money, CAST(confidence AS DECIMAL(18,6)) AS c FROM cell_v) GROUP BY 1, 2),
    p AS (SELECT tender_id AS t, bidder_id AS b, sum(CASE severity WHEN 'high' THEN 8 WHEN 'medium' THEN 4 ELSE 1 END) AS lost FROM flag_v GROUP BY 1, 2),
    r AS (SELECT m.*, CAST(greatest(0, least(100, 100 - coalesce(lost, 0))) AS DOUBLE) AS risk FROM m LEFT JOIN p ON m.tender_id = p.t AND m.bidder_id = p.b), o AS (SELECT *, round((financial + experience + 50.0 + risk + confidence) / 5, 1) AS overall FROM r)
    SELECT tender_id, bidder_id, round(financial, 1) AS financial, round(experience, 1) AS experience, 50.0::DOUBLE AS compliance, risk, round(confidence, 1) AS confidence, overall, rank() OVER (PARTITION BY tender_id ORDER BY overall DESC) AS rank FROM o""")
def a9_bidder_radar(spark, sf_dir):
    """Criterion R counts as experience here, so that two scores come from cells."""
    cells = views.kept_cells(spark, sf_dir)
    typed = cells.withColumn("criterion_type", F.when(F.col("criterion_id") == "R", "temporal_recency").otherwise(F.col("criterion_type")))
    return matrix.radar(typed, views.flags(spark, sf_dir, cells))


@query("a16_strongest_weakest", f"""{with_cte('cell_v')}, c AS ({COUNTS}), r AS (SELECT *, row_number() OVER (PARTITION BY tender_id ORDER BY passes DESC, fails, bidder_id) AS best, row_number() OVER (PARTITION BY tender_id ORDER BY passes, fails DESC, bidder_id) AS worst FROM c)
    SELECT tender_id, max(bidder_id) FILTER (best = 1) AS strongest, max(bidder_id) FILTER (worst = 1) AS weakest FROM r GROUP BY 1""")
def a16_strongest_weakest(spark, sf_dir):
    return matrix.strongest_weakest(matrix.verdict_counts(views.cells(spark, sf_dir), ["tender_id", "bidder_id"]))


@query("a14_tender_summary", f"{with_cte('routed_v')} SELECT tender_id, count(DISTINCT bidder_id) AS bidders, count(DISTINCT criterion_id) AS criteria, count(*) AS cells, count(*) FILTER (verdict = 'PASS') AS passes, count(*) FILTER (verdict = 'FAIL') AS fails, count(*) FILTER (verdict = 'REVIEW') AS reviews, count(*) FILTER (route <> 'auto_commit') AS open_review FROM routed_v GROUP BY 1")
def a14_tender_summary(spark, sf_dir):
    return listings.tender_summary(views.cells(spark, sf_dir))


@query("a15_recommendation_lists", f"{with_cte('cell_v')}, c AS ({COUNTS}) SELECT tender_id, list(bidder_id ORDER BY bidder_id) FILTER (10 * fails <= 3 * total) AS qualified, list(bidder_id ORDER BY bidder_id) FILTER (10 * fails > 3 * total) AS excluded, CAST(sum(reviews) AS BIGINT) AS open_count FROM c GROUP BY 1")
def a15_recommendation_lists(spark, sf_dir):
    return listings.recommendations(matrix.verdict_counts(views.cells(spark, sf_dir), ["tender_id", "bidder_id"]))


@query("a17_brief", f"""{with_cte('flag_v', 'routed_v')}, r AS (SELECT tender_id, list(evaluation_id ORDER BY evaluation_id)[1:8] AS review_items, count(*) AS n FROM routed_v WHERE route <> 'auto_commit' GROUP BY 1),
    k AS (SELECT tender_id, evaluation_id, row_number() OVER (PARTITION BY tender_id ORDER BY CASE severity WHEN 'high' THEN 0 ELSE 1 END, evaluation_id) AS k FROM flag_v WHERE severity IN ('high', 'medium')),
    f AS (SELECT tender_id, list(evaluation_id ORDER BY k) AS risks FROM k WHERE k <= 6 GROUP BY 1),
    t AS (SELECT tender_id, count(DISTINCT bidder_id) AS b, count(DISTINCT criterion_id) AS c FROM cell_v GROUP BY 1)
    SELECT t.tender_id, b || ' bidders, ' || c || ' criteria, ' || coalesce(n, 0) || ' need review.' AS lay_of_land, review_items, risks FROM t LEFT JOIN r ON r.tender_id = t.tender_id LEFT JOIN f ON f.tender_id = t.tender_id""")
def a17_brief(spark, sf_dir):
    cells = views.kept_cells(spark, sf_dir)
    return listings.brief(cells, views.flags(spark, sf_dir, cells))


@query("a21_route_stats", f"{with_cte('routed_v')} SELECT route, count(*) AS cells, count(*) FILTER (confidence >= 0.92) AS high_confidence, count(*) FILTER (second_officer) AS second_officer FROM routed_v GROUP BY 1")
def a21_route_stats(spark, sf_dir):
    return listings.route_stats(views.cells(spark, sf_dir))


@query("j4_comparative_matrix", f"{with_cte('cell_v')}, b AS (SELECT DISTINCT tender_id, bidder_id FROM cell_v), k AS (SELECT DISTINCT tender_id, criterion_id FROM cell_v) SELECT b.tender_id, b.bidder_id, k.criterion_id, c.verdict FROM b JOIN k ON b.tender_id = k.tender_id LEFT JOIN cell_v c ON c.tender_id = b.tender_id AND c.bidder_id = b.bidder_id AND c.criterion_id = k.criterion_id")
def j4_comparative_matrix(spark, sf_dir):
    c = views.cells(spark, sf_dir)
    own = views.figures(spark, sf_dir).select("tender_id", "bidder_id", "criterion_id")
    return matrix.comparative_matrix(own.select("tender_id", "bidder_id").distinct(), own.select("tender_id", "criterion_id").distinct(), c).drop("route")


@query("j4_report_pivot", f"{with_cte('cell_v')} SELECT tender_id, bidder_id, max(verdict) FILTER (criterion_id = 'A') AS a, max(verdict) FILTER (criterion_id = 'N') AS n, max(verdict) FILTER (criterion_id = 'R') AS r FROM cell_v GROUP BY 1, 2")
def j4_report_pivot(spark, sf_dir):
    pivot = views.cells(spark, sf_dir).groupBy("tender_id", "bidder_id").pivot("criterion_id", ["A", "N", "R"]).agg(F.first("verdict"))
    return pivot.withColumnsRenamed({"A": "a", "N": "n", "R": "r"})


@query("j6_cells_to_evaluate", f"{with_cte('cell_v')} SELECT tender_id, bidder_id, criterion_id FROM cell_v WHERE NOT (bidder_id % 2 = 0 AND verdict <> 'REVIEW')")
def j6_cells_to_evaluate(spark, sf_dir):
    done = views.cells(spark, sf_dir).where("bidder_id % 2 = 0 and verdict <> 'REVIEW'").select(*CELL)
    return views.figures(spark, sf_dir).select(*CELL).distinct().join(done, CELL, "left_anti")


@query("j26_flags_of_cell", f"{with_cte('flag_v')} SELECT c.evaluation_id, f.flag_type, f.severity FROM cell_v c JOIN flag_v f ON f.evaluation_id = c.evaluation_id OR (f.evaluation_id IS NULL AND f.tender_id = c.tender_id AND f.bidder_id = c.bidder_id)")
def j26_flags_of_cell(spark, sf_dir):
    cells = views.kept_cells(spark, sf_dir)
    c, flags = cells.select("tender_id", "bidder_id", "evaluation_id"), views.flags(spark, sf_dir, cells)
    own = c.join(flags.where("evaluation_id is not null").select("evaluation_id", "flag_type", "severity"), "evaluation_id").select("evaluation_id", "flag_type", "severity")
    whole = c.join(flags.where("evaluation_id is null").drop("evaluation_id"), ["tender_id", "bidder_id"]).select("evaluation_id", "flag_type", "severity")
    return own.union(whole)


@query("k1_k2_top_flags", f"{with_cte('flag_v')}, k AS (SELECT *, row_number() OVER (PARTITION BY tender_id ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, bidder_id, evaluation_id NULLS FIRST) AS k FROM flag_v) SELECT tender_id, k, severity, bidder_id, evaluation_id FROM k WHERE k <= 8")
def k1_k2_top_flags(spark, sf_dir):
    return matrix.top_flags(views.flags(spark, sf_dir), 8, [F.col("bidder_id"), F.col("evaluation_id")]).select("tender_id", "k", "severity", "bidder_id", "evaluation_id")


@query("w12_what_if", f"""{with_cte('routed_v')}, n AS (SELECT *, count(*) FILTER (verdict = 'PASS') OVER w AS p, count(*) FILTER (verdict = 'FAIL') OVER w AS f, count(*) OVER w AS total FROM routed_v WINDOW w AS (PARTITION BY tender_id, bidder_id)),
    t AS (SELECT n.*, a.action, coalesce(a.v, verdict) AS new_verdict FROM n CROSS JOIN (VALUES ('confirm', NULL), ('override', 'PASS'), ('override', 'FAIL'), ('override', 'REVIEW')) a(action, v)),
    m AS (SELECT *, p - (verdict = 'PASS')::INT + (new_verdict = 'PASS')::INT AS new_passes, f - (verdict = 'FAIL')::INT + (new_verdict = 'FAIL')::INT AS new_fails FROM t)
    SELECT tender_id, bidder_id, criterion_id, action, new_verdict, new_passes, new_fails, 10 * f <= 3 * total AS was_eligible, 10 * new_fails <= 3 * total AS will_be_eligible, action = 'override' AND route = 'mandatory_review' AS concurrence_required FROM m""")
def w12_what_if(spark, sf_dir):
    return matrix.what_if(views.cells(spark, sf_dir)).drop("new_reviews")


@query("w12_consequences", f"""{with_cte('routed_v')}, src AS (SELECT *, CASE WHEN bidder_id % 6 <> 0 THEN CASE WHEN criterion_id = 'R' THEN 'r' ELSE 'an' END || bidder_id END AS doc FROM routed_v), n AS (SELECT *, count(*) FILTER (verdict = 'FAIL') OVER w AS f, count(*) OVER w AS total, count(*) OVER (PARTITION BY tender_id, bidder_id, doc) - 1 AS others FROM src WINDOW w AS (PARTITION BY tender_id, bidder_id)),
    t AS (SELECT n.*, a.action, coalesce(a.v, verdict) AS new_verdict FROM n CROSS JOIN (VALUES ('confirm', NULL), ('override', 'PASS'), ('override', 'FAIL'), ('override', 'REVIEW')) a(action, v)),
    m AS (SELECT *, 10 * f <= 3 * total AS was, 10 * (f - (verdict = 'FAIL')::INT + (new_verdict = 'FAIL')::INT) <= 3 * total AS will FROM t), c AS (SELECT m.*, s_name FROM m LEFT JOIN supplier ON s_suppkey = bidder_id)
    SELECT tender_id, bidder_id, criterion_id, action, new_verdict, 'eligibility' AS type, s_name || CASE WHEN will THEN ' moves from NOT ELIGIBLE → ELIGIBLE' ELSE ' moves from ELIGIBLE → NOT ELIGIBLE' END AS text, 'high' AS severity FROM c WHERE was <> will
    UNION ALL SELECT tender_id, bidder_id, criterion_id, action, new_verdict, 'concurrence', 'This triggers a concurrence request to a second officer.', 'medium' FROM c WHERE action = 'override' AND route = 'mandatory_review'
    UNION ALL SELECT tender_id, bidder_id, criterion_id, action, new_verdict, 'shared_source', others || ' other cell(s) reference the same source document.', 'low' FROM c WHERE doc IS NOT NULL AND others > 0""")
def w12_consequences(spark, sf_dir):
    cells, k = views.cells(spark, sf_dir), F.col("bidder_id")
    sources = cells.withColumn("source_doc", F.when(k % 6 != 0, F.concat(F.when(F.col("criterion_id") == "R", "r").otherwise("an"), k.cast("string"))))
    companies = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("bidder_id"), F.col("s_name").alias("company_name"))
    return matrix.consequences(matrix.what_if(cells), sources.select("tender_id", "bidder_id", "criterion_id", "source_doc"), companies)


@query("u1_u3_flag_union", f"""{with_cte('flag_v')}, a AS (SELECT DISTINCT tender_id, CASE WHEN flag_type = 'round_number' THEN flag_type ELSE 'novel' END AS flag_type, bidder_id, lower(coalesce(evaluation_id, CAST(bidder_id AS VARCHAR))) AS subject FROM flag_v)
    SELECT tender_id, flag_type || '::' || subject AS flag_key, bidder_id FROM a""")
def u1_u3_flag_union(spark, sf_dir):
    flags = views.flags(spark, sf_dir)
    shaped = flags.select("tender_id", "flag_type", "severity", F.array("bidder_id").alias("bidder_ids"), F.coalesce("evaluation_id", F.col("bidder_id").cast("string")).alias("subject"))
    merged = matrix.merged_flags([shaped.where("flag_type = 'round_number'"), shaped.where("flag_type <> 'round_number'")])
    return matrix.fan_out(merged).select("tender_id", "flag_key", "bidder_id")
