"""Versions, audit chains and replay: who changed what, in which order, and what held at a time."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, NumericType, StructType

from bidloom.operators import segments

#: Fixed value: what the first event of a chain links to.
GENESIS = "0" * 64

#: Allowed transitions of a tender.
TRANSITIONS = {
    "DRAFT": ["DOCUMENTS_PENDING"], "DOCUMENTS_PENDING": ["DOCUMENTS_PROCESSING", "CRITERIA_EXTRACTING"], "DOCUMENTS_PROCESSING": ["DOCUMENTS_READY", "DOCUMENTS_PENDING"], "DOCUMENTS_READY": ["CRITERIA_EXTRACTING"],
    "CRITERIA_EXTRACTING": ["CRITERIA_PENDING_REVIEW"], "CRITERIA_PENDING_REVIEW": ["CRITERIA_APPROVED", "CRITERIA_EXTRACTING"], "CRITERIA_APPROVED": ["CHECKLIST_PENDING", "CRITERIA_EXTRACTING"], "CHECKLIST_PENDING": ["PRELIMINARY_DONE"],
    "PRELIMINARY_DONE": ["EVALUATING"], "EVALUATING": ["EVALUATIONS_COMPUTED"], "EVALUATIONS_COMPUTED": ["HITL_PENDING", "EVALUATION_COMPLETE"], "HITL_PENDING": ["EVALUATION_COMPLETE", "EVALUATING"],
    "EVALUATION_COMPLETE": ["REPORT_GENERATED", "EVALUATING"], "REPORT_GENERATED": ["FINALIZED"], "FINALIZED": [],
}


#: Allowed moves of an evaluation.
EVALUATION_MOVES = {"pending_review": ["resolved", "pending_second_officer"], "pending_second_officer": ["resolved", "pending_review"], "auto_committed": [], "resolved": []}

#: The decisions of a timeline and how each is put; braces name a field of the event's data.
DECISIONS = {
    "evaluation_decided": "Officer {decision} → {final_verdict}", "second_officer_decided": "Second officer {decision}", "concurrence_decided": "Concurrence {decision}",
    "tec_report_finalised": "TEC report sealed ({section_count} sections)", "criteria_approved": "Criteria approved ({criteria_count} criteria)", "tender_state_transition": "State → {target_state}",
}


def decision_timeline(events: DataFrame, kind: str = "event_type", data: str = "event_data") -> DataFrame:
    """The events that are decisions, with a one-line ``summary`` (K3). A field that the data lack, or data that are no JSON, is ?."""

    def line(template: str) -> Column:
        parts = enumerate(re.split(r"\{(\w+)\}", template))
        return F.concat(*(F.coalesce(F.get_json_object(data, f"$.{part}"), F.lit("?")) if i % 2 else F.lit(part) for i, part in parts))

    lines = F.coalesce(*(F.when(F.col(kind) == name, line(template)) for name, template in DECISIONS.items()))
    return events.where(F.col(kind).isin(*DECISIONS)).withColumn("summary", lines)


def link_hash(prev: Column, kind: Column, data: Column, actor: Column, at: Column) -> Column:
    """The hash of an event and of what precedes it."""
    return F.sha2(F.concat_ws("|", prev, kind, F.coalesce(data, F.lit("")), actor.cast("string"), at), 256)


def chained(events: DataFrame, key: str, order: str, kind: str, data: str, actor: str, at: str, tails: DataFrame | None = None) -> DataFrame:
    """The events with prev_hash and entry_hash (H3). A chain is serial within its key; keys are built side by side.

    ``at`` is text. A key's events come sorted, and only the last hash is carried from one to the next, so a log of any length
    takes no memory. ``tails`` (key, tail) has the last hashes of chains that go on; others begin with GENESIS. A null kind, actor
    or time is left out of the hash, null data count as empty.
    """
    columns = [key, order, kind, data, actor, at]
    rows = events.select(*columns)
    if tails is None:
        rows = rows.withColumn("_tail", F.lit(GENESIS))
    else:
        last = tails.select(F.col(key).alias("_tail_of"), F.col("tail").alias("_last"))
        rows = rows.join(last, F.col(key) == F.col("_tail_of"), "left").select(*columns, F.coalesce("_last", F.lit(GENESIS)).alias("_tail"))
    parts = [F.col(c).cast("string").alias(f"_{i}") for i, c in enumerate((kind, data, actor, at))]
    ordered = rows.select(*columns, F.col(key).cast("string").alias("_key"), "_tail", *parts).repartition(key).sortWithinPartitions(key, order)
    schema = StructType([*rows.select(*columns).schema.fields, *StructType.fromDDL("prev_hash string, entry_hash string").fields])

    def run(batches):
        begun, own, prev = False, None, GENESIS
        for batch in batches:
            before, after = [], []
            for chain, tail, *row in zip(*(batch.column(i).to_pylist() for i in range(len(columns), batch.num_columns)), strict=True):
                if not begun or chain != own:
                    begun, own, prev = True, chain, tail
                row[1] = row[1] or ""
                entry = hashlib.sha256("|".join([prev, *(x for x in row if x is not None)]).encode()).hexdigest()
                before.append(prev)
                after.append(entry)
                prev = entry
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(before, pa.string()), pa.array(after, pa.string())], names=schema.names)

    return ordered.mapInArrow(run, schema)


def chain_breaks(events: DataFrame, key: str, order: str, kind: str, data: str, actor: str, at: str) -> DataFrame:
    """Per key the number of events and the first break of the chain (H1): where and of which kind, null if it holds.

    Every row is checked against the one before it. A key's log is cut into segments that are checked side by side, and the last
    hash of a segment goes on to the next one, so a log with most of all rows is no single task's.
    """
    broken = F.when(F.col("prev_hash") != F.coalesce("_before", F.lit(GENESIS)), "link").when(F.col("entry_hash") != link_hash(F.col("prev_hash"), F.col(kind), F.col(data), F.col(actor), F.col(at)), "content")
    checked = segments.previous(events, [key], [order], "entry_hash", "_before").withColumn("broken", broken)
    return checked.groupBy(key).agg(F.count("*").alias("events"), F.min(F.when(F.col("broken").isNotNull(), F.struct(F.col(order).alias("at"), "broken"))).alias("first")).select(key, "events", F.col("first.at").alias("first_break"), F.col("first.broken").alias("kind"), F.col("first").isNull().alias("valid"))


def illegal_transitions(moves: DataFrame, key: str, order: list[str], allowed: dict[str, list[str]] = TRANSITIONS) -> DataFrame:
    """Transitions (from_state, to_state) that aren't allowed, or don't start where the last one ended (H4)."""
    pairs = F.array(*(F.lit(f"{a}>{b}") for a, to in allowed.items() for b in to)) if any(allowed.values()) else F.array(F.lit(""))
    forbidden = ~F.array_contains(pairs, F.concat_ws(">", "from_state", "to_state"))
    found = segments.previous(moves, [key], order, "to_state", "before").select("*", forbidden.alias("forbidden"), (F.col("before").isNotNull() & (F.col("before") != F.col("from_state"))).alias("gap"))
    return found.where("forbidden or gap").drop("before")


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


def versions(changes: DataFrame, keys: list[str], order: list[str], fields: list[str], valid_from: str) -> DataFrame:
    """A history with carried-forward fields (W6): version numbers from 1, null fields keep their last value, valid_to is the
    next version's start, and the last version is current.

    Fields and numbers are carried in segments and the next start is read in tiles of version numbers, so one key may have any
    number of versions. A version whose successor has a null start isn't current, but has no end.
    """
    values = {f: ("last", F.col(f"_{f}")) for f in fields} | {"version": ("sum", F.lit(1).cast("bigint"))}
    told = changes.select(*keys, *(F.col(c).alias(f"_order{i}") for i, c in enumerate(order)), F.col(valid_from).alias("valid_from"), *(F.col(f).alias(f"_{f}") for f in fields))
    run = segments.running(told, keys, [f"_order{i}" for i in range(len(order))], values).select(*keys, *fields, "version", "valid_from")
    ended = segments.framed(run, keys, "version", 0, 1, {"valid_to": lambda w: F.lead("valid_from").over(w), "_next": lambda w: F.lead("version").over(w)})
    return ended.withColumn("is_current", F.col("_next").isNull()).drop("_next")


def revisions(edits: DataFrame, keys: list[str], order: list[str], body: str, author: str) -> DataFrame:
    """Revisions of sections (W5): edits that change nothing are dropped; each has the body before and after, and the section's
    authorship then: ai until an officer edits, then co-authored, and ai again when it is regenerated. A section's edits are
    compared and numbered in segments, so it may have any number of them."""
    seen = segments.previous(edits.select(*keys, *order, body, author), keys, order, body, "body_before")
    changed = seen.where(F.col("body_before").isNull() | (F.trim("body_before") != F.trim(body)))
    told = changed.select(*keys, *order, "body_before", F.col(body).alias("body_after"), F.when(F.col(author) == "ai", "ai").otherwise("co-authored").alias("authored_by"))
    return segments.ranked(told, keys, order, "revision")


def event_context(events: DataFrame, key: str, order: str, reach: int, wanted: Column) -> DataFrame:
    """The wanted events with ``around`` (W10): the ``order`` values of the ``reach`` events before and after each in its log, and its
    own, in order. ``order`` is an event's id and is never null. A log is numbered in segments and read in tiles, so it may have any length."""
    placed = segments.ranked(events, [key], [order], "_place")
    around = lambda w: F.collect_list(order).over(w.rowsBetween(-reach, reach))
    return segments.framed(placed, [key], "_place", reach, reach, {"around": around}).where(wanted).drop("_place")


def corrigendum_numbers(documents: DataFrame, stored: DataFrame, key: str = "tender_id", document: str = "document") -> DataFrame:
    """(key, document, number) of the documents that have no number yet (W7): they go on from the largest stored one of their key,
    in the order of the documents. ``stored`` has (key, document, number); a document gets a number once. A key with most of all
    documents is numbered in segments."""
    known = stored.select(key, document)
    new = documents.select(key, document).distinct().join(known, [key, document], "left_anti")
    most = stored.groupBy(F.col(key).alias("_key")).agg(F.max("number").alias("_most"))
    placed = segments.ranked(new, [key], [document], "_place")
    return placed.join(most, F.col(key) == F.col("_key"), "left").select(key, document, (F.col("_place") + F.coalesce("_most", F.lit(0))).cast("bigint").alias("number"))


def keyset_page(rows: DataFrame, order: str, size: int, after=None, descending: bool = False) -> DataFrame:
    """One page of a log (W9): the next ``size`` rows beyond the cursor ``after``, and one more, which says whether a page follows.

    The cursor is the last row's ``order`` value; it becomes a filter of the scan, so no earlier row is read again.
    """
    if after is not None:
        rows = rows.where(F.col(order) < after if descending else F.col(order) > after)
    return rows.orderBy(F.desc(order) if descending else F.asc(order)).limit(size + 1)


def as_of(facts: DataFrame, versions_: DataFrame, key: str, at: str, created: str, version: str) -> DataFrame:
    """The highest version that existed when each fact came (J14): one pass over both, ordered by time.

    Versions and facts are merged by key and time, and a running maximum carries the version on, also over the segments that a key
    with many rows is cut into; a version of the same moment counts.
    """
    merged = facts.select("*", F.lit(1).alias("_fact"), F.col(at).alias("_at"), F.lit(None).cast("int").alias("_v")).unionByName(
        versions_.select(key, F.lit(0).alias("_fact"), F.col(created).alias("_at"), F.col(version).cast("int").alias("_v")), allowMissingColumns=True
    )
    return segments.running(merged, [key], ["_at", "_fact"], {"version_in_force": ("max", F.col("_v"))}).where("_fact = 1").drop("_fact", "_at", "_v")


def state_as_of(cells: DataFrame, snapshots: DataFrame, states: DataFrame, points: DataFrame) -> DataFrame:
    """For each (tender, time) of ``points``: cells that existed, those decided by then and since, verdicts of the latest snapshot
    up to then (the cell's own where there is none), and the tender's state (H2, A25). Points without a cell give no row.

    cells (tender_id, cell, created, verdict, decided_at), snapshots (cell, at, id, verdict), states (tender_id, at, id, to_state);
    ids settle ties of a time. All become changes of counts at a time: a cell adds one to its verdict when it is created, a snapshot
    takes one from the verdict before it and adds one to its own. Running sums then answer all points of a tender in one pass,
    so their number costs rows and not products with the cells; a tender with most of all changes is summed in segments.
    """
    verdicts = {"passes": "PASS", "fails": "FAIL", "reviews": "REVIEW"}
    counts = ["cells", "decided", "decided_later", *verdicts]

    def change(tender: str, at: Column, **by: Column | int) -> list[Column]:
        return [F.col(tender).alias("tender_id"), at.alias("at"), *(F.lit(by.get(c, 0)).cast("bigint").alias(c) for c in counts)]

    def one(when: Column) -> Column:
        return F.when(when, 1).otherwise(0)

    made = cells.select(*change("tender_id", F.col("created"), cells=1, decided_later=one(F.col("decided_at") > F.col("created")), **{n: one(F.col("verdict") == v) for n, v in verdicts.items()}))
    decided = cells.where("decided_at is not null").select(*change("tender_id", F.greatest("created", "decided_at"), decided=1, decided_later=-one(F.col("decided_at") > F.col("created"))))
    own = cells.select(F.col("cell").alias("_cell"), "tender_id", "created", F.col("verdict").alias("_own"))
    seen = segments.previous(snapshots.select("cell", "at", "id", "verdict"), ["cell"], ["at", "id"], "verdict", "_before").join(own, F.col("cell") == F.col("_cell"))
    before = F.coalesce("_before", "_own")
    turned = seen.select(*change("tender_id", F.greatest("at", "created"), **{n: one(F.col("verdict") == v) - one(before == v) for n, v in verdicts.items()}))
    changes = made.union(decided).union(turned).groupBy("tender_id", "at").agg(*(F.sum(c).alias(c) for c in counts))
    moved = states.groupBy("tender_id", "at").agg(F.max_by("to_state", "id").alias("to_state"))
    asked = points.select("tender_id", F.col("point").alias("at")).distinct().withColumn("_point", F.lit(1))
    sweep = changes.unionByName(moved, allowMissingColumns=True).unionByName(asked, allowMissingColumns=True).withColumn("_point", F.coalesce("_point", F.lit(0)))
    sums = {c: ("sum", F.coalesce(f"_{c}", F.lit(0))) for c in counts}
    found = segments.running(sweep.withColumnsRenamed({c: f"_{c}" for c in counts}), ["tender_id"], ["at", "_point"], sums | {"state": ("last", F.col("to_state"))})
    return found.where((F.col("_point") == 1) & (F.col("cells") > 0)).select("tender_id", F.col("at").alias("point"), *counts, "state")


def _differing(a: Column, b: Column, kind: DataType, path: Column, tolerance: float) -> Column:
    """An array of the paths at which two values of a type differ."""
    none = F.expr("cast(array() as array<string>)")
    here = F.array(path)
    if isinstance(kind, StructType):
        inner = F.concat(none, *(_differing(a[f.name], b[f.name], f.dataType, F.concat(path, F.lit("." + f.name)), tolerance) for f in kind.fields))
    elif isinstance(kind, ArrayType):
        each = lambda i: _differing(F.get(a, i), F.get(b, i), kind.elementType, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), tolerance)
        inner = F.when(F.size(a) != F.size(b), here).when(F.size(a) == 0, none).otherwise(F.flatten(F.transform(F.sequence(F.lit(0), F.size(a) - 1), each)))
    elif isinstance(kind, MapType):
        keys = F.array_sort(F.map_keys(a))
        each = lambda k: _differing(F.try_element_at(a, k), F.try_element_at(b, k), kind.valueType, F.concat(path, F.lit("["), k.cast("string"), F.lit("]")), tolerance)
        inner = F.when(keys != F.array_sort(F.map_keys(b)), here).when(F.size(keys) == 0, none).otherwise(F.flatten(F.transform(keys, each)))
    elif isinstance(kind, NumericType):
        inner = F.when(a.eqNullSafe(b) | (F.abs(a - b) <= tolerance), none).otherwise(here)
    else:
        inner = F.when(a.eqNullSafe(b), none).otherwise(here)
    return F.when(a.isNull() & b.isNull(), none).when(a.isNull() | b.isNull(), here).otherwise(inner)


def reproduce_diff(stored: DataFrame, recomputed: DataFrame, key: str, tolerance: float = 1e-3) -> DataFrame:
    """Rows whose recomputed columns differ (J24): (key, differing), an array of paths such as ``value.figures[2]`` in schema order.

    Structs, arrays and maps are walked by their type down to the leaves; numbers may differ by ``tolerance``. A list of another
    length, a map with other keys and a value that is null on one side only differ as a whole. A row that is missing on either side
    differs in all columns.
    """
    fields = [f for f in stored.schema.fields if f.name != key]
    one = stored.select(F.col(key).alias("_key_a"), *(F.col(f.name).alias(f"_a_{f.name}") for f in fields))
    two = recomputed.select(F.col(key).alias("_key_b"), *(F.col(f.name).cast(f.dataType).alias(f"_b_{f.name}") for f in fields))
    paths = F.concat(*(_differing(F.col(f"_a_{f.name}"), F.col(f"_b_{f.name}"), f.dataType, F.lit(f.name), tolerance) for f in fields))
    lone = F.col("_key_a").isNull() | F.col("_key_b").isNull()
    found = F.when(lone, F.array(*(F.lit(f.name) for f in fields))).otherwise(paths)
    return one.join(two, F.col("_key_a") == F.col("_key_b"), "full").select(F.coalesce("_key_a", "_key_b").alias(key), found.alias("differing")).where(F.size("differing") > 0)


def manifest(files: DataFrame, key: str, path: str, content: Column) -> tuple[DataFrame, DataFrame]:
    """(key, path, sha256) of all files, and each key's manifest hash.

    The hash has three levels: entries are sorted and hashed in 65,536 buckets by the hash of their path, the buckets in 256 by
    the first half of that, and those for the key, so a task gathers a 65,536th of a key's entries, or 256 hashes.
    """
    entries = files.select(key, F.col(path).alias("path"), F.sha2(content, 256).alias("sha256"))
    sealed = lambda lines: F.sha2(F.array_join(F.array_sort(F.collect_list(lines)), "\n"), 256).alias("seal")
    bucket = F.substring(F.sha2(F.col("path"), 256), 1, 4).alias("bucket")
    line = F.concat_ws(" ", "bucket", "seal")
    low = entries.withColumn("bucket", bucket).groupBy(key, "bucket").agg(F.count("*").alias("files"), sealed(F.concat_ws(" ", "path", "sha256")))
    high = low.groupBy(key, F.substring("bucket", 1, 2).alias("upper")).agg(F.sum("files").alias("files"), sealed(line))
    seals = high.groupBy(key).agg(F.sum("files").alias("files"), sealed(F.concat_ws(" ", "upper", "seal")).alias("manifest_hash"))
    return entries, seals


def verify_manifest(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """MISSING, TAMPERED, EXTRA or OK for each (key, path) of two entry tables."""
    a = actual.select(F.col("key").alias("key_a"), F.col("path").alias("path_a"), F.col("sha256").alias("sha_a"))
    joined = expected.join(a, (F.col("key") == F.col("key_a")) & (F.col("path") == F.col("path_a")), "full")
    status = F.when(F.col("key_a").isNull(), "MISSING").when(F.col("key").isNull(), "EXTRA").when(F.col("sha256") != F.col("sha_a"), "TAMPERED").otherwise("OK")
    return joined.select(F.coalesce("key", "key_a").alias("key"), F.coalesce("path", "path_a").alias("path"), status.alias("status"))


def signature(versions_: dict[str, str]) -> str:
    """The first 16 hex digits of the hash of all component versions, in order of name (H7)."""
    return hashlib.sha256("|".join(f"{k}:{v}" for k, v in sorted(versions_.items())).encode()).hexdigest()[:16]


#: Questions asked after a decision, by criterion type.
POST_REVIEW = {
    "numeric_threshold": ("year_match", "account_type", "ca_verification"), "categorical_presence": ("entity_consistency", "validity_check", "format_check"),
    "temporal_recency": ("date_window", "value_minimum", "issuer_check"), "qualitative_assessment": ("capacity_consistency", "third_party_verification"), "composite": ("subcriterion_completeness",),
}


def post_review_checks(cells: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """The questions of each cell that wasn't committed alone (H8); those already asked (cell, check) are left out."""
    table = F.create_map(*(x for k, v in POST_REVIEW.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    asked = cells.where("route <> 'auto_commit'").select("evaluation_id", F.explode(F.try_element_at(table, F.col("criterion_type"))).alias("check"))
    return asked if kept is None else asked.join(kept.select("evaluation_id", "check"), ["evaluation_id", "check"], "left_anti")


def second_officers(requests: DataFrame, officers: DataFrame) -> DataFrame:
    """Who concurs with each request (W8): the first reviewer by name, else senior, never the one who asks."""
    rank = F.when(F.col("role") == "reviewer", 0).when(F.col("role") == "senior", 1)
    first = officers.where(rank.isNotNull()).orderBy(rank, "name", "officer_id").limit(2)
    able = first.agg(F.array_sort(F.collect_list(F.struct(rank.alias("rank"), "name", "officer_id")))).scalar()
    chosen = F.element_at(F.filter("able", lambda o: o["officer_id"] != F.col("requested_by")), 1)
    return requests.withColumn("able", able).withColumn("target", F.when(F.size(F.filter("able", lambda o: o["officer_id"] != F.col("requested_by"))) > 0, chosen["officer_id"])).drop("able")
