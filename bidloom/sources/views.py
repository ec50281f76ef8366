"""Procurement views over the driver's tables: deterministic projections that the queries and their SQL share.

``CTE`` has each view's SQL for DuckDB; the functions build the same rows with DataFrames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidloom.operators import evidence
from bidloom.sources.shared import stored
from bidloom.sources.tables import table

CTE: dict[str, str] = {}

#: Criteria of the cell views: rule, periods, threshold, mandatory.
CRITERIA = {"A": ("each_of_n_years", 2, 50_000, True), "N": ("average_of_n_years", 2, 50_000, True), "R": ("any_of_n_years", 1, 50_000, False)}


def with_cte(*names: str) -> str:
    """WITH clause for views, each after those it needs (the order of CTE)."""
    needed: set[str] = set()

    def add(name: str) -> None:
        for other in CTE:
            if other != name and f" {other} " in CTE[name].replace("(", " ").replace(")", " ").replace(",", " ").replace("\n", " ") + " ":
                add(other)
        needed.add(name)

    for name in names:
        add(name)
    return "WITH " + ", ".join(f"{k} AS ({v})" for k, v in CTE.items() if k in needed)


CTE["bid_v"] = "SELECT l_partkey AS tender_id, l_suppkey AS bidder_id, max(l_extendedprice) AS value FROM lineitem GROUP BY 1, 2"


def bids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tender_id, bidder_id, value): the largest extended price of a part and supplier."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_extendedprice")
    return lines.groupBy(F.col("l_partkey").alias("tender_id"), F.col("l_suppkey").alias("bidder_id")).agg(F.max("l_extendedprice").alias("value"))


CTE["figure_v"] = """
  SELECT p_brand AS tender_id, l_suppkey AS bidder_id, l_returnflag AS criterion_id, CAST(trunc(l_extendedprice) AS BIGINT) AS rupees, l_shipdate, l_orderkey, l_linenumber, l_discount
  FROM lineitem JOIN part ON l_partkey = p_partkey"""


def figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tender_id, bidder_id, criterion_id, rupees, order columns, l_discount): one row for each figure."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag", "l_extendedprice", "l_shipdate", "l_orderkey", "l_linenumber", "l_discount")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_brand").alias("tender_id"), F.col("l_suppkey").alias("bidder_id"), F.col("l_returnflag").alias("criterion_id"),
        F.col("l_extendedprice").cast("bigint").alias("rupees"), "l_shipdate", "l_orderkey", "l_linenumber", "l_discount",
    )


CTE["evidence_v"] = """
  SELECT tender_id, bidder_id, criterion_id, list(rupees ORDER BY l_shipdate, l_orderkey, l_linenumber, rupees) AS fig,
    list(CAST(trunc(CASE WHEN l_linenumber % 2 = 0 THEN rupees * 1.02 ELSE rupees * 1.2 END) AS BIGINT) ORDER BY l_shipdate, l_orderkey, l_linenumber, rupees) AS mfig,
    round(0.6 + max(l_discount), 4) AS mconf
  FROM figure_v GROUP BY 1, 2, 3"""
CTE["recon_v"] = """
  SELECT tender_id, bidder_id, criterion_id, CASE WHEN bidder_id % 7 = 0 THEN [] ELSE fig END AS rules_figures, CASE WHEN bidder_id % 5 = 0 THEN [] ELSE mfig END AS model_figures,
    CASE WHEN bidder_id % 7 = 0 THEN 0.0 ELSE 0.7 END AS rules_confidence, CASE WHEN bidder_id % 5 = 0 THEN 0.0 ELSE mconf END AS model_confidence, bidder_id % 70 <> 0 AS has_documents
  FROM evidence_v"""
CTE["agreed_v"] = """
  SELECT *, CASE WHEN len(model_figures) > 0 THEN model_figures ELSE rules_figures END AS figures,
    len(model_figures) > 0 AND len(rules_figures) > 0 AND abs(list_max(rules_figures) - list_max(model_figures)) / greatest(list_max(rules_figures), list_max(model_figures)) > 0.05 AS apart,
    greatest(rules_confidence, model_confidence) AS top
  FROM recon_v"""
CTE["numeric_v"] = """
  SELECT *, CASE WHEN apart THEN 'disagree' ELSE 'agree' END AS agreement, CASE WHEN apart THEN 0.4 ELSE 1.0 END AS agreement_score,
    CASE WHEN len(figures) = 0 THEN CASE WHEN has_documents THEN 0.78 ELSE 0.0 END WHEN apart THEN top * 0.7 ELSE least(0.95, top + 0.05) END AS extraction_confidence,
    CASE WHEN has_documents THEN 0.85 ELSE 0.0 END AS ocr_confidence,
    CASE WHEN len(model_figures) > 0 AND len(rules_figures) > 0 THEN 'rules+llm' WHEN len(model_figures) > 0 THEN 'llm' ELSE 'rules' END AS method
  FROM agreed_v"""


def reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with the figures of both branches reconciled; some bidders have only one branch, some none."""
    row = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "rupees")
    found = figures(spark, sf_dir).groupBy("tender_id", "bidder_id", "criterion_id").agg(F.array_sort(F.collect_list(row)).alias("rows"), F.round(F.lit(0.6) + F.max("l_discount"), 4).alias("mconf"))
    none = F.expr("cast(array() as array<bigint>)")
    own = F.transform("rows", lambda r: r["rupees"])
    read = F.transform("rows", lambda r: (r["rupees"] * F.when(r["l_linenumber"] % 2 == 0, F.lit("1.02").cast("decimal(4,2)")).otherwise(F.lit("1.20").cast("decimal(4,2)"))).cast("bigint"))
    no_rules, no_model = F.col("bidder_id") % 7 == 0, F.col("bidder_id") % 5 == 0
    cells = found.select(
        "tender_id", "bidder_id", "criterion_id",
        F.when(no_rules, none).otherwise(own).alias("rules_figures"), F.when(no_model, none).otherwise(read).alias("model_figures"),
        F.when(no_rules, 0.0).otherwise(0.7).alias("rules_confidence"), F.when(no_model, 0.0).otherwise(F.col("mconf")).alias("model_confidence"),
        (F.col("bidder_id") % 70 != 0).alias("has_documents"),
    )
    return evidence.reconcile_numeric(cells)


_RULES = "\n".join(
    f"  WHEN criterion_id = '{k}' THEN CASE "
    + {
        "each_of_n_years": f"WHEN len(figures) < {n} THEN 'REVIEW' WHEN list_min(figures[1:{n}]) >= {t} THEN 'PASS' ELSE 'FAIL' END",
        "average_of_n_years": f"WHEN len(figures) < {n} THEN 'REVIEW' WHEN list_sum(figures[1:{n}]) / {n} >= {t} THEN 'PASS' ELSE 'FAIL' END",
        "any_of_n_years": f"WHEN list_max(figures) >= {t} THEN 'PASS' ELSE 'FAIL' END",
    }[rule]
    for k, (rule, n, t, _) in CRITERIA.items()
)
CTE["cell_v"] = f"""
  SELECT tender_id, bidder_id, criterion_id, tender_id || '/' || CAST(bidder_id AS VARCHAR) || '/' || criterion_id AS evaluation_id, figures, agreement, extraction_confidence, rules_figures, model_figures, has_documents,
    criterion_id IN ('A', 'N') AS is_mandatory, criterion_id = 'N' AS override_permitted,
    CASE WHEN bidder_id % 11 = 0 THEN 'high' WHEN bidder_id % 11 = 1 THEN 'medium' WHEN bidder_id % 11 = 2 THEN 'low' END AS dissent,
    CASE WHEN len(figures) = 0 THEN CASE WHEN extraction_confidence >= 0.5 THEN 'FAIL' ELSE 'REVIEW' END
    {_RULES} ELSE 'REVIEW' END AS verdict,
    CASE WHEN ocr_confidence <= 0 OR extraction_confidence <= 0 THEN 0.0 ELSE
      (3 + (len(rules_figures) > 0)::INT + (len(model_figures) > 0)::INT) / (1 / ocr_confidence + 1 / extraction_confidence + 1
        + CASE WHEN len(rules_figures) > 0 THEN 1 / rules_confidence ELSE 0 END + CASE WHEN len(model_figures) > 0 THEN 1 / model_confidence ELSE 0 END) END AS confidence
  FROM numeric_v"""
CTE["routed_v"] = """
  SELECT *, CASE WHEN is_mandatory AND verdict = 'FAIL' THEN 'mandatory_review' WHEN dissent = 'high' THEN 'mandatory_review' WHEN confidence < 0.5 THEN 'mandatory_review'
    WHEN agreement = 'disagree' THEN 'hitl_review' WHEN confidence < 0.92 THEN 'hitl_review' ELSE 'auto_commit' END AS route,
    is_mandatory AND verdict = 'FAIL' AND override_permitted AS second_officer
  FROM cell_v"""


def cells(spark: SparkSession, sf_dir: str, precedents: int = 100) -> DataFrame:
    """The evaluation matrix: verdict, confidence and route of each (tender, bidder, criterion) with figures."""
    dissent = F.col("bidder_id") % 11
    found = reconciled(spark, sf_dir)
    case = lambda i: F.when(F.col("criterion_id") == "A", F.lit(CRITERIA["A"][i])).when(F.col("criterion_id") == "N", F.lit(CRITERIA["N"][i])).otherwise(F.lit(CRITERIA["R"][i]))
    found = found.select(
        "*", F.concat_ws("/", "tender_id", F.col("bidder_id").cast("string"), "criterion_id").alias("evaluation_id"), F.lit("numeric_threshold").alias("criterion_type"),
        case(0).alias("rule"), case(1).alias("periods"), case(2).alias("threshold"), case(3).alias("is_mandatory"), (F.col("criterion_id") == "N").alias("override_permitted"),
        F.when(dissent == 0, "high").when(dissent == 1, "medium").when(dissent == 2, "low").alias("dissent"),
        (F.size("figures") > 0).alias("has_value"), F.lit(None).cast("boolean").alias("found"), F.lit(None).cast("boolean").alias("is_valid"), F.lit(None).cast("int").alias("qualifying_count"),
        F.lit(None).cast("int").alias("required_count"), F.lit(None).cast("string").alias("model_verdict"), F.lit(False).alias("entity_match_flag"), F.lit(False).alias("has_date"),
        (F.size("rules_figures") > 0).alias("rules_found"), (F.size("model_figures") > 0).alias("model_found"),
    )
    judged = evidence.mosaic(evidence.typed_verdict(found))
    judged = judged.withColumn("severities", evidence.with_signals(F.lit(None).cast("array<string>"), F.col("agreement"), F.col("dissent")))
    return evidence.route(judged, F.lit(precedents))


CTE["flag_v"] = """
  SELECT tender_id, bidder_id, evaluation_id, CASE WHEN agreement = 'disagree' THEN 'medium' ELSE 'high' END AS severity,
    CASE WHEN agreement = 'disagree' THEN 'branch_disagreement' ELSE 'dissent' END AS flag_type
  FROM cell_v WHERE agreement = 'disagree' OR dissent = 'high'
  UNION ALL SELECT DISTINCT tender_id, bidder_id, NULL, 'low', 'round_number' FROM figure_v WHERE rupees % 1000 = 0"""


def kept_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evaluation matrix, stored, for queries that read it more than once."""
    return stored(cells(spark, sf_dir), "cells")


def flags(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    """Flags of cells (disagreement, high dissent; ``of`` has the cells where they are at hand) and of bidders (whole thousands; no
    evaluation)."""
    own = (cells(spark, sf_dir) if of is None else of).where((F.col("agreement") == "disagree") | (F.col("dissent") == "high"))
    apart = F.col("agreement") == "disagree"
    own = own.select("tender_id", "bidder_id", "evaluation_id", F.when(apart, "medium").otherwise("high").alias("severity"), F.when(apart, "branch_disagreement").otherwise("dissent").alias("flag_type"))
    whole = figures(spark, sf_dir).where("rupees % 1000 = 0").select("tender_id", "bidder_id").distinct()
    return own.union(whole.select("tender_id", "bidder_id", F.lit(None).cast("string"), F.lit("low"), F.lit("round_number")))
