"""Statistics over pools of values: bids of a tender, figures of a criterion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidloom.operators import segments


def exact_moments(value: str) -> tuple[Column, Column, Column]:
    """(n, mean, population deviation) from exact decimal sums, so the result doesn't depend on row order."""
    v = F.col(value).cast("decimal(18,2)")
    n, s, q = F.count(v), F.sum(v), F.sum((v * v).cast("decimal(38,4)"))
    n, s, q = n, s.cast("double"), q.cast("double")
    mean = s / n
    return n, mean, F.sqrt(F.greatest(q / n - mean * mean, F.lit(0.0)))


def zscore_pool(bids: DataFrame, keys: list[str], value: str, flag_at: float = 1.5, high_at: float = 2.5, least: int = 3) -> DataFrame:
    """Values further than ``flag_at`` deviations from the mean of their pool.

    Pools of under ``least`` positive values, or without spread, give nothing. Null and non-positive values take no part. A pool
    is summed in parts and its moments are joined back, so no task sees a whole pool.
    """
    positive = bids.where(F.col(value) > 0)
    n, mean, deviation = exact_moments(value)
    pools = positive.groupBy(*(F.col(k).alias(f"_of_{k}") for k in keys)).agg(n.alias("pool_size"), mean.alias("pool_mean"), deviation.alias("pool_sd")).where((F.col("pool_size") >= least) & (F.col("pool_sd") > 0))
    own = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys))
    scored = positive.join(pools, own).drop(*(f"_of_{k}" for k in keys))
    scored = scored.withColumn("z", (F.col(value).cast("double") - F.col("pool_mean")) / F.col("pool_sd"))
    return scored.where(F.abs("z") > flag_at).select(
        "*",
        F.when(F.col("z") > 0, "above").otherwise("below").alias("side"),
        F.when(F.abs("z") > high_at, "high").otherwise("medium").alias("severity"),
    )


def benford(values: DataFrame, keys: list[str], value: str, least: int = 15, critical: float = 15.507, high_at: float = 25.0) -> DataFrame:
    """First-digit test of each pool (A3): chi-square against log10(1 + 1/d), and the digit furthest off.

    Pools of under ``least`` positive values give nothing. Digits are counted before anything is gathered.
    """
    from bidloom.functions.values import first_digit

    digits = values.select(*keys, first_digit(F.col(value)).alias("digit")).where("digit is not null")
    counted = digits.groupBy(*keys, "digit").agg(F.count("*").alias("n"))
    wide = counted.groupBy(*keys).agg(F.sum("n").alias("n_values"), F.map_from_entries(F.collect_list(F.struct("digit", "n"))).alias("seen")).where(F.col("n_values") >= least)
    every = wide.select(*keys, "n_values", F.explode(F.sequence(F.lit(1), F.lit(9))).alias("digit"), "seen")
    expected = F.col("n_values") * F.log10(1 + 1 / F.col("digit"))
    off = every.select(*keys, "n_values", "digit", expected.alias("expected"), F.coalesce(F.try_element_at("seen", F.col("digit")), F.lit(0)).alias("n"))
    term = (F.col("n") - F.col("expected")) * (F.col("n") - F.col("expected")) / F.col("expected")
    share = F.abs(F.col("n") - F.col("expected")) / F.col("expected")
    found = off.groupBy(*keys).agg(F.first("n_values").alias("n_values"), F.round(F.sum(F.round(term, 6).cast("decimal(28,6)")), 4).cast("double").alias("chi_square"), F.max(F.struct(share.alias("share"), (-F.col("digit")).alias("digit"))).alias("worst"))
    return found.where(F.col("chi_square") > critical).select(*keys, "n_values", "chi_square", (-F.col("worst.digit")).alias("worst_digit"), F.when(F.col("chi_square") > high_at, "high").otherwise("medium").alias("severity"))


def bid_spread(bids: DataFrame, keys: list[str], value: str, low: float = 0.05, high: float = 0.80, least: int = 3) -> DataFrame:
    """Pools whose bids lie too close together or too far apart (A4), by the population coefficient of variation."""
    n, mean, deviation = exact_moments(value)
    pools = bids.where(F.col(value) > 0).groupBy(*keys).agg(n.alias("n_bidders"), mean.alias("mean"), deviation.alias("sd")).where(F.col("n_bidders") >= least)
    pools = pools.withColumn("cv", F.col("sd") / F.col("mean"))
    signal = F.when(F.col("cv") < low, "price_fixing").when(F.col("cv") > high, "cover_bidding")
    return pools.select(*keys, "n_bidders", "cv", signal.alias("signal"), F.when(F.col("cv") < low, "high").otherwise("medium").alias("severity")).where("signal is not null")


def shared_value(rows: DataFrame, keys: list[str], value: Column, bidder: str, least: int = 2) -> DataFrame:
    """Values that several bidders of a pool have in common (J9, J10, A5, A6): (keys, value, bidder_ids sorted)."""
    pairs = rows.select(*keys, value.alias("value"), F.col(bidder).alias("bidder")).where("value is not null and value <> ''").distinct()
    return pairs.groupBy(*keys, "value").agg(F.array_sort(F.collect_list("bidder")).alias("bidder_ids")).where(F.size("bidder_ids") >= least)


def sequential_instruments(instruments: DataFrame, keys: list[str], number: str, bidder: str, most: int = 5, high_at: int = 2) -> DataFrame:
    """Neighbouring instrument numbers of different bidders at most ``most`` apart (W2): the first run of four digits or more counts.
    Neighbours are found in segments, so a key may have any number of instruments."""
    digits = F.regexp_extract(F.col(number), r"(\d{4,})", 1)
    numbered = instruments.select(*keys, F.col(bidder).alias("a"), digits.try_cast("decimal(38,0)").alias("number")).where("number is not null")
    seen = segments.previous(numbered.withColumn("_self", F.struct("a", "number")), keys, ["number", "a"], "_self", "_before")
    near = seen.select(*keys, F.col("_before.a").alias("a"), F.col("a").alias("b"), (F.col("number") - F.col("_before.number")).alias("gap")).where((F.col("a") != F.col("b")) & (F.col("gap") <= most)).withColumn("gap", F.col("gap").cast("bigint"))
    return near.select(*keys, "a", "b", "gap", F.when(F.col("gap") <= high_at, "high").otherwise("medium").alias("severity"))
