"""The screen of a bid pool (F2): fourteen detectors over whole tables, each a function from tables to flags.

Tables, by name (a detector reads those that it needs):

- ``bidders``: tender_id, bidder_id, company_name, pan, gstin, address, instrument, instrument_no, signatories (array), letter
- ``bids``: tender_id, criterion_id, bidder_id, value
- ``figures``: tender_id, bidder_id, label, value
- ``documents``: tender_id, bidder_id, doc_id, sha256, producer, creator, modified (whole seconds)

Flags have tender_id, flag_type, severity, bidder_ids (array of text) and subject, from which ``matrix.merged_flags`` makes one
key for equal findings, and ``alone`` for two bidders, sorted, where no other flag can have that key: pairs of bidders grow with the square of their number, and
those that are found once each needn't be brought together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from bidloom.functions import values as V
from bidloom.operators import pairs, pools
from bidloom.operators.matrix import merged_flags

Tables = dict[str, DataFrame]

#: Detectors by name.
DETECTORS: dict[str, Callable[[Tables], DataFrame]] = {}

#: Instruments whose numbers are compared, and words that company names are compared without.
NUMBERED = ("dd", "demand draft", "banker's cheque")
COMMON = ("the", "of", "and", "for", "in")


def detector(name: str):
    """Register a detector under a name."""

    def add(fn: Callable[[Tables], DataFrame]):
        DETECTORS[name] = fn
        return fn

    return add


def screen(tables: Tables, names: list[str] | None = None, stored: DataFrame | None = None) -> DataFrame:
    """All flags of the chosen detectors, merged, without those whose keys (tender_id, flag_key) are ``stored``."""
    return merged_flags([DETECTORS[n](tables) for n in (names or DETECTORS)], stored)


def _flags(found: DataFrame, kind: str, severity: str | Column, bidders: Column, subject: Column | None = None, alone: Column | None = None) -> DataFrame:
    worth = F.lit(severity) if isinstance(severity, str) else severity
    return found.select("tender_id", F.lit(kind).alias("flag_type"), worth.alias("severity"), bidders.cast("array<string>").alias("bidder_ids"), (F.lit(None) if subject is None else subject).cast("string").alias("subject"), (F.lit(False) if alone is None else alone).alias("alone"))


def _as_text(bidders: DataFrame) -> DataFrame:
    """Bidders whose ids are texts before they are paired, so an id is written once and not in each of its pairs."""
    return bidders.withColumn("bidder_id", F.col("bidder_id").cast("string"))


def _told_apart(bidders: DataFrame) -> Column:
    """Whether different bidder ids can't make one key: numbers can't, texts with commas or in other case could."""
    return F.lit(isinstance(bidders.schema["bidder_id"].dataType, IntegralType))


@detector("round_number")
def _round(tables: Tables) -> DataFrame:
    found = tables["figures"].where(V.round_tier(F.col("value")).isNotNull())
    return _flags(found, "round_number", "low", F.array("bidder_id"), F.concat_ws("::", "label", F.col("value").cast("bigint").cast("string")))


@detector("pan_format_mismatch")
def _pan(tables: Tables) -> DataFrame:
    found = tables["bidders"].where((F.coalesce("pan", F.lit("")) != "") & ~V.matches(F.col("pan"), V.PAN))
    return _flags(found, "pan_format_mismatch", "medium", F.array("bidder_id"), F.upper(F.trim("pan")))


@detector("gstin_format_mismatch")
def _gstin(tables: Tables) -> DataFrame:
    gstin, pan = F.upper(F.trim("gstin")), F.upper(F.trim(F.coalesce("pan", F.lit(""))))
    malformed = ~V.matches(F.col("gstin"), V.GSTIN)
    other = (pan != "") & (F.substring(gstin, 3, 10) != pan)
    found = tables["bidders"].where((F.coalesce("gstin", F.lit("")) != "") & (malformed | other))
    return _flags(found, "gstin_format_mismatch", F.when(malformed, "medium").otherwise("high"), F.array("bidder_id"), gstin)


@detector("address_collision")
def _address(tables: Tables) -> DataFrame:
    found = pools.shared_value(tables["bidders"], ["tender_id"], F.lower(F.trim("address")), "bidder_id")
    return _flags(found, "address_collision", "high", F.col("bidder_ids"))


@detector("date_proximity")
def _near(tables: Tables) -> DataFrame:
    docs = tables["documents"].where("bidder_id is not null")
    found = pairs.range_pairs(docs, ["tender_id"], "modified", 600, "doc_id", "bidder_id")
    owner = docs.select(F.col("doc_id").alias("_doc"), F.col("bidder_id").cast("string").alias("_owner"))
    for side in "ab":
        found = found.join(owner, F.col(side) == F.col("_doc")).withColumnRenamed("_owner", f"_{side}").drop("_doc")
    return _flags(found, "date_proximity", "medium", F.array("_a", "_b"), F.concat_ws("-", F.col("a").cast("string"), F.col("b").cast("string")))


@detector("duplicate_document")
def _duplicate(tables: Tables) -> DataFrame:
    found = pools.shared_value(tables["documents"], ["tender_id"], F.col("sha256"), "bidder_id")
    return _flags(found, "duplicate_document", "high", F.col("bidder_ids"), F.col("value"))


@detector("sequential_dd")
def _sequential(tables: Tables) -> DataFrame:
    drafts = tables["bidders"].where(F.lower("instrument").isin(*NUMBERED))
    found = pools.sequential_instruments(drafts, ["tender_id"], "instrument_no", "bidder_id")
    return _flags(found, "sequential_dd", F.col("severity"), F.array("a", "b"))


@detector("common_signatory")
def _signatory(tables: Tables) -> DataFrame:
    signed = tables["bidders"].withColumn("_one", F.explode("signatories"))
    found = pools.shared_value(signed, ["tender_id"], V.person_key(F.col("_one")), "bidder_id")
    return _flags(found, "common_signatory", "high", F.col("bidder_ids"), F.col("value"))


@detector("cover_letter_overlap")
def _letters(tables: Tables) -> DataFrame:
    found = pairs.copied_prose(_as_text(tables["bidders"]), "tender_id", "bidder_id", "letter", sample=False)
    return _flags(found, "cover_letter_overlap", "high", F.array("a", "b"), alone=_told_apart(tables["bidders"]))


@detector("benford_violation")
def _benford(tables: Tables) -> DataFrame:
    found = pools.benford(tables["figures"], ["tender_id"], "value")
    return _flags(found, "benford_violation", F.col("severity"), F.array(), F.col("n_values"))


@detector("zscore_outlier")
def _zscore(tables: Tables) -> DataFrame:
    found = pools.zscore_pool(tables["bids"], ["tender_id", "criterion_id"], "value")
    return _flags(found, "zscore_outlier", F.col("severity"), F.array("bidder_id"), F.concat_ws("::", F.col("bidder_id").cast("string"), F.round("z", 2).cast("decimal(12,2)").cast("string")))


@detector("bid_spread_anomaly")
def _spread(tables: Tables) -> DataFrame:
    found = pools.bid_spread(tables["bids"], ["tender_id", "criterion_id"], "value")
    return _flags(found, "bid_spread_anomaly", F.col("severity"), F.array(), F.concat_ws("::", "signal", F.col("n_bidders").cast("string")))


@detector("metadata_cluster")
def _metadata(tables: Tables) -> DataFrame:
    made = F.lower(F.trim(F.coalesce(F.nullif("producer", F.lit("")), "creator")))
    found = pools.shared_value(tables["documents"], ["tender_id"], F.when(F.length(made) > 3, made), "bidder_id")
    return _flags(found, "metadata_cluster", "medium", F.col("bidder_ids"), F.substring("value", 1, 40))


@detector("entity_resolution_match")
def _entity(tables: Tables) -> DataFrame:
    words = F.filter(F.split(V.company_key(F.col("company_name")), " "), lambda w: (w != "") & ~w.isin(*COMMON))
    several = F.count("*").over(Window.partitionBy("tender_id", "bidder_id")) > 1  # rows of a bidder under several names
    named = _as_text(tables["bidders"]).withColumns({"_words": words, "_several": several})
    found = pairs.token_pairs(named, ["tender_id"], "bidder_id", "_words", 6, 10, "_several")
    return _flags(found, "entity_resolution_match", "high", F.array("a", "b"), alone=_told_apart(tables["bidders"]) & ~F.col("_several"))
