"""Listings, joins to dimensions and rollups that a report or a page is made of. Each takes tables with the named columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from bidloom.operators.matrix import top_flags


def listing(rows: DataFrame, where: Column, order: list[Column], size: int, columns: list[str]) -> DataFrame:
    """The first ``size`` rows that fit, in an order (S1). Filters and columns reach the scan; each task keeps its own first rows."""
    return rows.where(where).select(*columns).orderBy(*order).limit(size)


def decoded(rows: DataFrame, column: str, schema: str) -> DataFrame:
    """The fields of a JSON column as columns beside the others (S2); text that is no such JSON gives nulls."""
    fields = StructType.fromDDL(schema).names
    return rows.withColumn("_json", F.from_json(column, schema)).select(*(c for c in rows.columns if c != column), *(F.col(f"_json.{f}").alias(f) for f in fields))


def with_dimensions(facts: DataFrame, dimensions: list[tuple[str, DataFrame, str]], how: str = "inner") -> DataFrame:
    """Facts joined with dimension tables (J1, J2): for each (column of facts, dimension, its key) the dimension's other columns. A
    later dimension may hang on a column of an earlier one."""
    out = facts
    for column, dimension, key in dimensions:
        named = dimension.withColumnRenamed(key, f"_key_{key}")
        out = out.join(named, F.col(column) == F.col(f"_key_{key}"), how).drop(f"_key_{key}")
    return out


def file_vault(documents: DataFrame, levels: list[str], pages: str, complete: Column) -> DataFrame:
    """Files, pages and complete files of each level and of those above it (A10)."""
    return documents.rollup(*levels).agg(F.count("*").alias("files"), F.sum(pages).alias("pages"), F.count_if(complete).alias("complete"))


def documents_by(documents: DataFrame, keys: list[str], pages: str) -> DataFrame:
    """Files and pages by keys, such as bidder and type."""
    return documents.groupBy(*keys).agg(F.count("*").alias("files"), F.sum(pages).alias("pages"))


def tender_summary(cells: DataFrame) -> DataFrame:
    """Bidders, criteria, cells by verdict, and cells that an officer has to see, of each tender."""
    return cells.groupBy("tender_id").agg(
        F.countDistinct("bidder_id").alias("bidders"), F.countDistinct("criterion_id").alias("criteria"), F.count("*").alias("cells"),
        *(F.count_if(F.col("verdict") == v).alias(n) for v, n in (("PASS", "passes"), ("FAIL", "fails"), ("REVIEW", "reviews"))), F.count_if(F.col("route") != "auto_commit").alias("open_review"),
    )


def recommendations(counts: DataFrame) -> DataFrame:
    """(tender_id, qualified, excluded, open_count): each tender's bidders in order, excluded by over 30 % FAIL, and its open cells.

    ``counts`` as ``verdict_counts`` gives them by bidder. A list without bidders is null. Only ids are gathered, so a list grows by
    one id for each bidder, whatever the number of cells.
    """
    ok = 10 * F.col("fails") <= 3 * F.col("total")
    # wrapped, as collect_list drops null ids; sorted as plain ids, nulls last
    ids = lambda when: F.array_sort(F.transform(F.collect_list(F.when(when, F.struct("bidder_id"))), lambda x: x["bidder_id"]))
    found = counts.groupBy("tender_id").agg(ids(ok).alias("qualified"), ids(~ok).alias("excluded"), F.sum("reviews").alias("open_count"))
    return found.withColumns({n: F.when(F.size(n) > 0, F.col(n)) for n in ("qualified", "excluded")})


def brief(cells: DataFrame, flags: DataFrame, most_items: int = 8, most_risks: int = 6) -> DataFrame:
    """A tender's brief (A17): a line of counts, its first open cells and its most severe flags. Lists have a fixed most of entries."""
    first = F.row_number().over(Window.partitionBy("tender_id").orderBy("evaluation_id"))
    items = cells.where("route <> 'auto_commit'").select("tender_id", "evaluation_id").withColumn("k", first).where(F.col("k") <= most_items)
    items = items.groupBy(F.col("tender_id").alias("_i")).agg(F.array_sort(F.collect_list("evaluation_id")).alias("review_items"))
    line = F.format_string("%d bidders, %d criteria, %d need review.", F.countDistinct("bidder_id"), F.countDistinct("criterion_id"), F.count_if(F.col("route") != "auto_commit"))
    top = top_flags(flags.where(F.col("severity").isin("high", "medium")), most_risks, [F.col("evaluation_id")])
    risks = top.groupBy(F.col("tender_id").alias("_r")).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "evaluation_id"))), lambda x: x["evaluation_id"]).alias("risks"))
    land = cells.groupBy("tender_id").agg(line.alias("lay_of_land"))
    return land.join(items, F.col("tender_id") == F.col("_i"), "left").join(risks, F.col("tender_id") == F.col("_r"), "left").drop("_i", "_r")


def authorship(sections: DataFrame, key: str, author: str) -> DataFrame:
    """Sections of each report by who wrote them."""
    return sections.groupBy(key).agg(*(F.count_if(F.col(author) == a).alias(n) for a, n in (("ai", "ai"), ("officer", "officer"), ("co-authored", "co_authored"))), F.count("*").alias("sections"))


def events_by_day(events: DataFrame, at: str, kind: str) -> DataFrame:
    """Events of each day and kind."""
    return events.groupBy(F.window(at, "1 day").alias("w"), kind).agg(F.count("*").alias("events")).select(F.col("w.start").cast("date").alias("day"), kind, "events")


def route_stats(cells: DataFrame, high: float = 0.92) -> DataFrame:
    """Cells of each route, how many of high confidence, and how many need a second officer."""
    return cells.groupBy("route").agg(F.count("*").alias("cells"), F.count_if(F.col("confidence") >= high).alias("high_confidence"), F.count_if("second_officer").alias("second_officer"))


def page_confidence(words: DataFrame, key: str, confidence: str) -> DataFrame:
    """The mean confidence of the words of a page or document, and their number (A22); exact in any order of rows."""
    return words.groupBy(key).agg(F.round(F.avg(F.col(confidence).cast("decimal(18,4)")), 6).cast("double").alias("confidence"), F.count("*").alias("words"))


def corpus_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row with the number of rows of each table, by name."""
    rows = [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, t in tables.items()]
    return reduce(DataFrame.union, rows).agg(*(F.max(F.when(F.col("name") == name, F.col("n"))).alias(name) for name in tables))


def first_page(pages: DataFrame, key: str, number: str, text: str) -> DataFrame:
    """The text of each document's first page."""
    return pages.groupBy(key).agg(F.min_by(text, number).alias("first_text"))


def shared_source(cells: DataFrame, keys: list[str], cell: str) -> DataFrame:
    """Cells that rest on the same document of a bidder, with the number of others (J27). The number comes by a join, so no task
    holds all cells of a document."""
    own = cells.select(*keys, cell).distinct()
    many = own.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg((F.count("*") - 1).alias("others")).where("others > 0")
    return own.join(many, reduce(Column.__and__, (F.col(k) == F.col(f"_{k}") for k in keys))).select(cell, *keys, "others")


def latest_turns(turns: DataFrame, key: str, order: str, most: int) -> DataFrame:
    """The last ``most`` turns of each conversation (K4)."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return turns.withColumn("_k", place).where(F.col("_k") <= most).drop("_k")


def inbox(requests: DataFrame, officers: DataFrame, target: str = "target") -> DataFrame:
    """Open requests with the officer that each goes to (K5); requests to nobody that is known give no row."""
    return requests.join(officers.select("officer_id"), F.col(target) == F.col("officer_id"))


def set_relations(a: Column, b: Column) -> list[Column]:
    """Columns common, total and added: sizes of two token sets' intersection and union, and what the second adds."""
    return [F.size(F.array_intersect(a, b)).alias("common"), F.size(F.array_union(a, b)).alias("total"), F.size(F.array_except(b, a)).alias("added")]


def override_precedents(cells: DataFrame, decisions: DataFrame) -> DataFrame:
    """A precedent for each override that changed a verdict (H6): what it was about and what it said. decisions (evaluation_id, decision, new)."""
    made = decisions.where("decision = 'override'").select(F.col("evaluation_id").alias("_cell"), "new")
    changed = cells.join(made, F.col("evaluation_id") == F.col("_cell")).where(F.col("new") != F.col("verdict"))
    return changed.select("evaluation_id", "tender_id", "criterion_id", F.format_string("override on %s: %s became %s", "criterion_id", "verdict", "new").alias("interpretation"))


def signature_drift(cells: DataFrame, key: str, stored: Column, current: str) -> DataFrame:
    """How many cells of each tender were computed by other component versions than the current ones (H7)."""
    return cells.groupBy(key).agg(F.count_if(~stored.eqNullSafe(F.lit(current))).alias("drifted"), F.count("*").alias("cells"))
