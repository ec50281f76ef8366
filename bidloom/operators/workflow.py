"""Registries, citations, precedents, caches, graphs and data quality over whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidloom.operators.matrix import severity_rank


def registry_additions(entries: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """The entries to append (S6): keys upper-cased, those already stored and repeats left out."""
    clean = entries.withColumns({k: F.upper(F.trim(k)) for k in keys}).dropDuplicates(keys)
    return clean.join(stored.select(*keys), keys, "left_anti")


def not_yet(rows: DataFrame, kept: DataFrame, keys: list[str]) -> DataFrame:
    """Rows to insert: each key once, without those already kept (J7). Null keys are keys like others."""
    new = rows.dropDuplicates(keys)
    known = kept.select(*(F.col(k).alias(f"_{k}") for k in keys))
    return new.join(known, reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys)), "left_anti")


def violations(table: str, rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """How many rows break each rule of a table (P25); a check is true or null where a row is fine."""
    counted = rows.agg(*(F.count_if(~F.coalesce(c, F.lit(True))).alias(k) for k, c in checks.items()))
    return counted.select(F.explode(F.array(*(F.struct(F.lit(table).alias("table"), F.lit(k).alias("rule"), F.col(k).alias("violations")) for k in checks))).alias("v")).select("v.*")


def orphans(table: str, rows: DataFrame, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """How many rows refer to a parent that isn't there (P25)."""
    lost = rows.where(F.col(key).isNotNull()).join(parents.select(F.col(parent_key).alias("_parent")), F.col(key) == F.col("_parent"), "left_anti")
    return lost.agg(F.count("*").alias("violations")).select(F.lit(table).alias("table"), F.lit(f"{key} has a parent").alias("rule"), "violations")


def posting_lists(corpus: DataFrame, k: int) -> DataFrame:
    """(department, term, found, created): the ``k`` + 1 newest precedents of each department and term.

    Each task keeps its own newest before the shuffle (a limit of the rank), so a term that all precedents have costs k + 1 rows
    of a task.
    """
    terms = corpus.select("department", F.col("id").alias("found"), "created", F.explode(F.array_distinct("terms")).alias("term"))
    newest = F.row_number().over(Window.partitionBy("department", "term").orderBy(F.desc("created"), "found"))
    return terms.withColumn("n", newest).where(F.col("n") <= k + 1).drop("n")


def precedents(queries: DataFrame, corpus: DataFrame, k: int = 3) -> DataFrame:
    """For each query the k newest precedents of its department that share a search term, else of its type and department.

    queries (id, department, kind, terms), corpus (id, department, kind, terms, created). A precedent isn't its own. A query meets
    the newest k + 1 of each of its terms: its own newest k are among them, as it is at most one of those itself.
    """
    lists = posting_lists(corpus, k).withColumnsRenamed({"department": "d", "term": "t"})
    asked = queries.select(F.col("id").alias("query"), "department", F.explode("terms").alias("term"))
    by_term = asked.join(lists, (F.col("department") == F.col("d")) & (F.col("term") == F.col("t")) & (F.col("query") != F.col("found")))
    hits = by_term.select("query", "found", "created").distinct()
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("created"), "found"))
    top = hits.withColumn("k", rank).where(F.col("k") <= k).select("query", "found", "k", F.lit("terms").alias("basis"))
    rest = queries.join(hits.select("query").distinct(), F.col("id") == F.col("query"), "left_anti")
    # The newest of each type and department are the same for all queries; one more than k, as a query may be among them.
    newest = F.row_number().over(Window.partitionBy("department", "kind").orderBy(F.desc("created"), "id"))
    pool = corpus.withColumn("n", newest).where(F.col("n") <= k + 1).select(F.col("id").alias("found"), F.col("department").alias("d"), F.col("kind").alias("t"), "created")
    same = rest.join(pool, (F.col("department") == F.col("d")) & (F.col("kind") == F.col("t")) & (F.col("id") != F.col("found"))).select(F.col("id").alias("query"), "found", "created")
    fallback = same.withColumn("k", rank).where(F.col("k") <= k).select("query", "found", "k", F.lit("type").alias("basis"))
    return top.union(fallback)


def cached_responses(prompts: DataFrame, log: DataFrame) -> DataFrame:
    """The latest error-free response to each prompt hash (J18), null where there is none."""
    last = log.where("error is null").groupBy(F.col("prompt_hash").alias("h")).agg(F.max_by("response", "at").alias("response"))
    return prompts.join(last, F.col("prompt_hash") == F.col("h"), "left").drop("h")


#: The columns of a findings table (F3): what a provider answered to a prompt in one run, one row for each finding.
FINDINGS = ("prompt_hash", "run", "finding", "confidence", "error")


def findings_for(cells: DataFrame, findings: DataFrame) -> DataFrame:
    """(evaluation_id, run, finding, confidence): a provider's findings on each cell's prompt (F3), from its last run without an error.

    cells (evaluation_id, prompt_hash), findings as in FINDINGS, ``run`` in order of time. A run with an error in any row counts as
    failed. A cell without a prompt, or whose prompt has no good run, keeps one row with nulls.
    """
    missing = set(FINDINGS) - set(findings.columns)
    if missing:
        raise ValueError(f"the findings lack {sorted(missing)}")
    runs = findings.groupBy("prompt_hash", "run").agg(F.bool_and(F.col("error").isNull()).alias("good"))
    last = runs.where("good").groupBy(F.col("prompt_hash").alias("_h")).agg(F.max("run").alias("_run"))
    chosen = findings.join(last, (F.col("prompt_hash") == F.col("_h")) & (F.col("run") == F.col("_run"))).select("_h", "run", "finding", "confidence")
    asked = cells.select("evaluation_id", F.col("prompt_hash").alias("_asked"))
    return asked.join(chosen, F.col("_asked") == F.col("_h"), "left").select("evaluation_id", "run", "finding", "confidence")


def reverse_citations(citations: DataFrame, targets: dict[str, DataFrame]) -> DataFrame:
    """(kind, target, cell): the cells that cite a word or a page (J3). ``targets`` has for each column of ``citations`` the
    table of one column whose values count."""
    found = []
    for kind, wanted in targets.items():
        key = wanted.columns[0]
        found.append(citations.join(wanted, F.col(kind) == F.col(key)).select(F.lit(kind).alias("kind"), F.col(key).alias("target"), "cell"))
    out = found[0]
    for part in found[1:]:
        out = out.union(part)
    return out


def cited_documents(citations: DataFrame, documents: DataFrame) -> DataFrame:
    """Documents cited in each tender, all complete ones where none is (U4)."""
    cited = citations.select("tender_id", "doc_id").distinct()
    rest = documents.where("complete").select("tender_id", "doc_id").join(cited.select("tender_id").distinct(), "tender_id", "left_anti")
    return cited.union(rest)


def provenance(cells: DataFrame, flags: DataFrame, decisions: DataFrame, comments: DataFrame, most_flags: int = 5) -> tuple[DataFrame, DataFrame]:
    """Typed nodes (evaluation_id, kind, node) and labelled edges (evaluation_id, source, target, label) of every cell.

    Nodes: criterion, bidder, document, value (also where none was found), branches, verdict, dissent, the ``most_flags`` most severe flags
    of the cell's bidder, decision and comments. decisions (evaluation_id, decision) and comments (evaluation_id, notes) have at most one
    row for each cell. Nodes of a cell are named by their kind, flags also by their place.
    """
    made = decisions.select(F.col("evaluation_id").alias("_d"), "decision")
    noted = comments.select(F.col("evaluation_id").alias("_c"), "notes")
    rank = F.row_number().over(Window.partitionBy("tender_id", "bidder_id").orderBy(severity_rank(F.col("severity")), "flag_type", F.asc_nulls_first("evaluation_id")))
    kept = flags.withColumn("k", rank).where(F.col("k") <= most_flags).groupBy(F.col("tender_id").alias("_t"), F.col("bidder_id").alias("_b")).agg(F.count("*").cast("int").alias("raised"))
    wide = cells.join(kept, (F.col("tender_id") == F.col("_t")) & (F.col("bidder_id") == F.col("_b")), "left").join(made, F.col("evaluation_id") == F.col("_d"), "left").join(noted, F.col("evaluation_id") == F.col("_c"), "left")
    always = F.lit(True)
    rules, model, document = F.size("rules_figures") > 0, F.size("model_figures") > 0, F.col("has_documents")
    value, decided, noted_ = F.size("figures") > 0, F.col("decision").isNotNull(), F.coalesce("notes", F.lit(0)) > 0
    there = {"criterion": always, "bidder": always, "document": document, "value": always, "rules": rules, "model": model, "verdict": always, "dissent": F.col("dissent").isNotNull(), "decision": decided, "comments": noted_}
    links = [
        ("criterion", "bidder", "evaluated against", always), ("bidder", "document", "evidence from", document), ("document", "value", "extracted", document & value), ("document", "value", "not found in", document & ~value),
        ("bidder", "value", "no evidence", ~document), ("value", "rules", "rules analysis", rules), ("value", "model", "model analysis", model), ("rules", "verdict", "contributes", rules), ("model", "verdict", "contributes", model),
        ("value", "verdict", "determines", ~rules & ~model), ("verdict", "dissent", "challenged by", F.col("dissent").isNotNull()), ("verdict", "decision", "decided", decided),
        ("decision", "comments", "annotated", decided & noted_), ("verdict", "comments", "annotated", ~decided & noted_),
    ]
    raised = F.when(F.col("raised") > 0, F.sequence(F.lit(1), F.col("raised"))).otherwise(F.expr("cast(array() as array<int>)"))
    flag = lambda k: F.concat(F.lit("flag_"), k.cast("string"))
    nodes = F.array_compact(F.array(*(F.when(when, F.struct(F.lit(kind).alias("kind"), F.lit(kind).alias("node"))) for kind, when in there.items())))
    edges = F.array_compact(F.array(*(F.when(when, F.struct(F.lit(a).alias("source"), F.lit(b).alias("target"), F.lit(label).alias("label"))) for a, b, label, when in links)))
    nodes = F.concat(nodes, F.transform(raised, lambda k: F.struct(F.lit("flag").alias("kind"), flag(k).alias("node"))))
    edges = F.concat(edges, F.transform(raised, lambda k: F.struct(F.lit("verdict").alias("source"), flag(k).alias("target"), F.lit("flagged").alias("label"))))
    return wide.select("evaluation_id", F.explode(nodes).alias("n")).select("evaluation_id", "n.*"), wide.select("evaluation_id", F.explode(edges).alias("e")).select("evaluation_id", "e.*")


def checklist_status(responses: DataFrame, keys: list[str], most: int = 3) -> DataFrame:
    """Present, partial and missing items of each bidder, the first missing mandatory labels, and the preliminary outcome.

    responses (keys, label, state, is_mandatory, officer_decision).
    """
    missing = F.col("is_mandatory") & (F.col("state") == "missing")
    lost = missing & (F.coalesce("officer_decision", F.lit("")) != "accepted")
    return responses.groupBy(*keys).agg(
        F.count_if(F.col("state") == "present").alias("present"), F.count_if(F.col("state").isin("partial", "unclear")).alias("partial"), F.count_if(missing).alias("missing_mandatory"),
        F.slice(F.array_sort(F.collect_set(F.when(missing, F.col("label")))), 1, most).alias("missing_labels"), F.when(F.bool_or(lost), "preliminary_failed").otherwise("passed").alias("outcome"),
    )


def comments_with_author(comments: DataFrame, officers: DataFrame, cells: DataFrame) -> DataFrame:
    """Comments (comment_id, evaluation_id, bidder_id, criterion_id, officer_id, body, affects_verdict, created) with officer_name,
    officer_role and actionable (J28). A missing bidder or criterion is that of the comment's cell; comments without a body, a
    target or a known officer give no row. Those that affect the verdict are the actionable ones."""
    own = cells.select(F.col("evaluation_id").alias("_cell"), F.col("bidder_id").alias("_bidder"), F.col("criterion_id").alias("_criterion"))
    author = officers.select(F.col("officer_id").alias("_officer"), F.col("name").alias("officer_name"), F.col("role").alias("officer_role"))
    said = comments.where((F.trim("body") != "") & F.coalesce(F.col("evaluation_id").cast("string"), F.col("bidder_id").cast("string"), F.col("criterion_id").cast("string")).isNotNull())
    joined = said.join(author, F.col("officer_id") == F.col("_officer")).join(own, F.col("evaluation_id") == F.col("_cell"), "left")
    return joined.select("comment_id", "evaluation_id", F.coalesce("bidder_id", "_bidder").alias("bidder_id"), F.coalesce("criterion_id", "_criterion").alias("criterion_id"), "officer_id", "officer_name", "officer_role", "body", "created", F.coalesce("affects_verdict", F.lit(False)).alias("actionable"))


def review_context(requests: DataFrame, cells: DataFrame, bidders: DataFrame, criteria: DataFrame, documents: DataFrame, officers: DataFrame, comments: DataFrame, flags: DataFrame) -> DataFrame:
    """(request_id, part, record): all that a second officer sees of each request, one row of JSON for each record.

    requests (request_id, evaluation_id, requested_by, ...), cells (evaluation_id, bidder_id, criterion_id, source_doc, ...), bidders
    (bidder_id, ...), criteria (criterion_id, ...), documents (doc_id, ...), officers (officer_id, ...), comments as
    ``comments_with_author`` gives them, flags (evaluation_id, bidder_id, tender_id, severity, state, ...; those dismissed don't
    count, and one that names no cell belongs to all cells of its bidder). A request without a cell gives no row; without a document,
    an officer, comments or flags those parts are missing. Rows, and not one record, as a bidder may have any number of flags.
    """
    asked = requests.join(cells.withColumnRenamed("evaluation_id", "_cell"), F.col("evaluation_id") == F.col("_cell")).drop("_cell")
    keys = asked.select("request_id", "evaluation_id", "bidder_id", "criterion_id", "tender_id", "source_doc", "requested_by")
    record = lambda rows, columns: F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("record")

    def part(name: str, rows: DataFrame, of: str, key: str) -> DataFrame:
        other = rows.select(F.col(key).alias("_key"), F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("record"))
        return keys.join(other, F.col(of) == F.col("_key")).select("request_id", F.lit(name).alias("part"), "record")

    parts = [
        requests.join(keys.select(F.col("request_id").alias("_r")), F.col("request_id") == F.col("_r")).select("request_id", F.lit("request").alias("part"), record(requests, requests.columns)),
        part("evaluation", cells, "evaluation_id", "evaluation_id"), part("bidder", bidders, "bidder_id", "bidder_id"), part("criterion", criteria, "criterion_id", "criterion_id"),
        part("document", documents, "source_doc", "doc_id"), part("officer", officers, "requested_by", "officer_id"),
        part("comment", comments, "evaluation_id", "evaluation_id"), part("actionable_comment", comments.where("actionable"), "evaluation_id", "evaluation_id"),
    ]
    live = flags.where("state is null or state <> 'dismissed'")
    told = F.to_json(F.struct(*(c for c in flags.columns)), {"ignoreNullFields": "false"}).alias("record")
    own = live.where("evaluation_id is not null").select(F.col("evaluation_id").alias("_key"), told)
    whole = live.where("evaluation_id is null").select(F.col("tender_id").alias("_t"), F.col("bidder_id").alias("_b"), told)
    parts.append(keys.join(own, F.col("evaluation_id") == F.col("_key")).select("request_id", F.lit("flag").alias("part"), "record"))
    parts.append(keys.join(whole, (F.col("tender_id") == F.col("_t")) & (F.col("bidder_id") == F.col("_b"))).select("request_id", F.lit("flag").alias("part"), "record"))
    return reduce(DataFrame.union, parts)


def extracted_by(pages: DataFrame, text: str, extractor) -> DataFrame:
    """Figures from a user's own extractor (F4): an Arrow-batched function from texts to arrays of (raw_value, unit, rupees)."""
    return pages.withColumn("figures", extractor(F.col(text)))
