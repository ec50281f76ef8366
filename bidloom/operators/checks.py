"""Identifier formats, verifiers and debarment. Verifiers are builders of one struct column, so all run in one projection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidloom.functions import values as V


def _clean(name: str) -> Column:
    return F.upper(F.trim(F.coalesce(F.col(name).cast("string"), F.lit(""))))


def _result(status: Column, confidence: Column, note: Column | None = None, details: Column | None = None) -> Column:
    read = F.lit(None) if details is None else details
    return F.struct(status.alias("status"), confidence.cast("double").alias("confidence"), (F.lit("") if note is None else note).alias("note"), read.cast("map<string,string>").alias("details"))


def _format(name: str, pattern: str, absent: tuple[str, float], bad: float, good: float, extra: Column | None = None, details: Column | None = None) -> Column:
    """absent, malformed or verified, each with its confidence; ``details`` are what a well-formed number says."""
    v = _clean(name)
    ok = v.rlike(pattern) if extra is None else extra
    return (
        F.when(v == "", _result(F.lit(absent[0]), F.lit(absent[1])))
        .when(~ok, _result(F.lit("mismatch"), F.lit(bad)))
        .otherwise(_result(F.lit("verified"), F.lit(good), details=details))
    )


def verify_pan() -> Column:
    """Format, and the fourth character against the declared constitution (V1)."""
    pan, declared = _clean("pan"), F.lower(F.coalesce("constitution", F.lit("private limited")))
    kind = F.substring(pan, 4, 1)
    company = declared.contains("limited") | declared.contains("ltd")
    firm = declared.contains("partnership") | declared.contains("llp")
    wrong = F.when(company, kind != "C").when(firm, kind != "F").when(declared.contains("trust"), kind != "T").otherwise(F.lit(False))
    return (
        F.when(pan == "", _result(F.lit("unknown"), F.lit(0.0)))
        .when(~pan.rlike(V.PAN), _result(F.lit("mismatch"), F.lit(0.95), F.lit("format")))
        .when(wrong, _result(F.lit("mismatch"), F.lit(0.90), F.lit("constitution")))
        .otherwise(_result(F.lit("verified"), F.lit(0.93)))
    )


def verify_gst(as_of: Column) -> Column:
    """Format, then validity on the bid date and on ``as_of`` (V2)."""
    gstin, until, bid = _clean("gstin"), F.col("valid_until"), F.col("bid_date")
    return (
        F.when(gstin == "", _result(F.lit("unknown"), F.lit(0.0)))
        .when(~gstin.rlike(V.GSTIN), _result(F.lit("mismatch"), F.lit(0.95), F.lit("format")))
        .when(until < bid, _result(F.lit("mismatch"), F.lit(0.92), F.lit("not active on the bid date")))
        .when(until < as_of, _result(F.lit("verified"), F.lit(0.85), F.lit("expired since")))
        .otherwise(_result(F.lit("verified"), F.lit(0.95)))
    )


def verify_udin() -> Column:
    v = _clean("udin")
    return _format("udin", "", ("not_found", 0.7), 0.9, 0.78, (F.length(v) >= 12) & v.rlike("[0-9]"))


def verify_frn() -> Column:
    """Format, and the region that the last letter stands for (V4)."""
    region = V.lookup(F.substring(_clean("frn"), 7, 1), V.FRN_REGIONS, F.lit("Unknown"))
    return _format("frn", V.FRN, ("not_found", 0.7), 0.9, 0.80, details=F.create_map(F.lit("region"), region))


def verify_udyam() -> Column:
    return _format("udyam", V.UDYAM, ("not_found", 0.7), 0.92, 0.78)


def verify_cin() -> Column:
    """Format, and the listing, state and year of incorporation that the number holds (V6)."""
    v = _clean("cin")
    listing = F.when(F.substring(v, 1, 1) == "L", "Listed").otherwise("Unlisted")
    read = {"listing": listing, "state": F.substring(v, 7, 2), "year": F.substring(v, 9, 4)}
    return _format("cin", V.CIN, ("not_found", 0.6), 0.9, 0.82, details=F.create_map(*(x for k, c in read.items() for x in (F.lit(k), c))))


def verify_debarment() -> Column:
    """Only a match by number counts against a bidder (V7); needs ``debarment_confidence`` of ``debarment``."""
    return F.when(F.col("debarment_confidence") == "high", _result(F.lit("mismatch"), F.lit(0.92))).otherwise(_result(F.lit("verified"), F.lit(0.95)))


#: The registry of verifiers (F1): a plug-in is a function from a date to a struct column over the claims.
VERIFIERS: dict[str, Callable[[Column], Column]] = {
    "pan": lambda as_of: verify_pan(), "gst": verify_gst, "udin": lambda as_of: verify_udin(), "frn": lambda as_of: verify_frn(),
    "udyam": lambda as_of: verify_udyam(), "mca": lambda as_of: verify_cin(), "debarment": lambda as_of: verify_debarment(),
}


def verify_all(claims: DataFrame, as_of: Column, verifiers: dict | None = None) -> DataFrame:
    """One row for each claim and verifier (V8), with a hash of the result."""
    chosen = verifiers or VERIFIERS
    results = F.array(*(F.struct(F.lit(name).alias("verifier"), build(as_of).alias("result")) for name, build in chosen.items()))
    rows = claims.select("bidder_id", F.explode(results).alias("one")).select("bidder_id", "one.verifier", "one.result.*")
    return rows.withColumn("snapshot_hash", V.content_hash(bidder=F.col("bidder_id"), verifier=F.col("verifier"), status=F.col("status")))


def debarment(bidders: DataFrame, registry: DataFrame, as_of: Column) -> DataFrame:
    """Registry matches of bidders (J8): by PAN or GSTIN (high), by folded name (medium); entries that have run out don't count.

    (bidder_id, debarment_confidence, hits, state) for every bidder.
    """
    live = registry.where(F.col("debarred_until").isNull() | (F.col("debarred_until") >= as_of))
    keys = [("pan", _clean("pan"), "high"), ("gstin", _clean("gstin"), "high"), ("name", V.registry_key(F.col("company_name")), "medium")]
    parts = []
    for kind, key, confidence in keys:
        one = bidders.select("bidder_id", key.alias("key")).where("key <> ''")
        two = live.select(F.col("entry_id"), key.alias("entry_key")).where("entry_key <> ''")
        parts.append(one.join(two, F.col("key") == F.col("entry_key")).select("bidder_id", "entry_id", F.lit(kind).alias("matched_on"), F.lit(confidence).alias("confidence")))
    hits = parts[0].union(parts[1]).union(parts[2])
    best = hits.groupBy(F.col("bidder_id").alias("hit")).agg(F.min(F.when(F.col("confidence") == "high", 0).otherwise(1)).alias("rank"), F.countDistinct("entry_id").alias("hits"))
    joined = bidders.select("bidder_id").join(best, F.col("bidder_id") == F.col("hit"), "left")
    confidence = F.when(F.col("rank") == 0, "high").when(F.col("rank") == 1, "medium")
    state = F.when(F.col("rank") == 0, "confirmed_debarred").when(F.col("rank") == 1, "flagged").otherwise("clear")
    return joined.select("bidder_id", confidence.alias("debarment_confidence"), F.coalesce("hits", F.lit(0)).alias("hits"), state.alias("state"))
