"""Queries over logs, versions and decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from bidloom.functions import values as V
from bidloom.operators import history, listings, matrix, segments
from bidloom.plans.registry import query
from bidloom.sources import views
from bidloom.sources.tables import table
from bidloom.sources.views import with_cte

EVENTS = "e AS (SELECT user_id AS tender_id, event_id AS id, event_type, props AS event_data, user_id % 3 AS actor, strftime(ts, '%Y-%m-%d %H:%M:%S') AS stamp, ts FROM events)"


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("tender_id"), F.col("event_id").alias("id"), "event_type", F.col("props").alias("event_data"), (F.col("user_id") % 3).alias("actor"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), "ts"
    )


CHAIN = f"""r AS (SELECT *, row_number() OVER (PARTITION BY tender_id ORDER BY id) AS k FROM e),
  c AS (SELECT tender_id, k, id, event_type, event_data, actor, stamp, repeat('0', 64) AS prev_hash, sha256(repeat('0', 64) || '|' || event_type || '|' || coalesce(event_data, '') || '|' || actor || '|' || stamp) AS entry_hash FROM r WHERE k = 1
    UNION ALL SELECT r.tender_id, r.k, r.id, r.event_type, r.event_data, r.actor, r.stamp, c.entry_hash, sha256(c.entry_hash || '|' || r.event_type || '|' || coalesce(r.event_data, '') || '|' || r.actor || '|' || r.stamp) FROM c JOIN r ON r.tender_id = c.tender_id AND r.k = c.k + 1)"""
CHAIN_ARGS = ("tender_id", "id", "event_type", "event_data", "actor", "at")


@query("h3_chain_build", f"WITH RECURSIVE {EVENTS}, {CHAIN} SELECT tender_id, id, prev_hash, entry_hash FROM c")
def h3_chain_build(spark, sf_dir):
    return history.chained(_events(spark, sf_dir).drop("ts"), *CHAIN_ARGS).select("tender_id", "id", "prev_hash", "entry_hash")


@query("h1_chain_verify", f"""WITH RECURSIVE {EVENTS}, {CHAIN}, bad AS (SELECT tender_id, min(k) AS k FROM r WHERE id % 977 = 5 GROUP BY 1)
    SELECT c.tender_id, count(*) AS events, min(c.id) FILTER (c.k = bad.k) AS first_break, max(CASE WHEN bad.k IS NOT NULL THEN 'content' END) AS kind, bool_and(bad.k IS NULL) AS valid FROM c LEFT JOIN bad ON bad.tender_id = c.tender_id GROUP BY 1""")
def h1_chain_verify(spark, sf_dir):
    chain = history.chained(_events(spark, sf_dir).drop("ts"), *CHAIN_ARGS)
    edited = chain.withColumn("event_data", F.when(F.col("id") % 977 == 5, F.concat("event_data", F.lit(" "))).otherwise(F.col("event_data")))
    return history.chain_breaks(edited, *CHAIN_ARGS)


STEPS = "s AS (SELECT o_custkey AS tender_id, o_orderkey AS id, o_orderdate AS at, o_orderstatus AS to_state, coalesce(lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 'O') AS from_state FROM orders)"


@query("h4_transition_legality", f"WITH {STEPS} SELECT tender_id, id, from_state, to_state FROM s WHERE from_state || to_state NOT IN ('OF', 'OP', 'PF', 'FO')")
def h4_transition_legality(spark, sf_dir):
    from pyspark.sql import Window

    by = Window.partitionBy("tender_id").orderBy("at", "id")
    moves = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("tender_id"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at"), F.col("o_orderstatus").alias("to_state"))
    moves = moves.withColumn("from_state", F.coalesce(F.lag("to_state").over(by), F.lit("O")))
    return history.illegal_transitions(moves, "tender_id", ["at", "id"], {"O": ["F", "P"], "P": ["F"], "F": ["O"]}).select("tender_id", "id", "from_state", "to_state")


@query("a19_p22_lifecycle", "SELECT o_custkey AS tender_id, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS state, CASE arg_max(o_orderstatus, (o_orderdate, o_orderkey)) WHEN 'O' THEN 'setup' WHEN 'P' THEN 'evaluation' ELSE 'report' END AS step FROM orders GROUP BY 1")
def a19_p22_lifecycle(spark, sf_dir):
    from bidloom.functions.values import lookup, step_of

    last = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("tender_id")).agg(F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("state"))
    return last.withColumn("step", step_of(lookup(F.col("state"), {"O": "DRAFT", "P": "EVALUATING"}, F.lit("FINALIZED"))))


LIFECYCLE = list(V.PROGRESS)


@query("p22_progress", f"SELECT o_orderkey, state, CASE state {' '.join(f"WHEN '{s}' THEN {n}" for s, n in V.PROGRESS.items())} ELSE 0 END AS progress FROM (SELECT o_orderkey, ({LIFECYCLE + ['ARCHIVED']})[o_orderkey % {len(LIFECYCLE) + 1} + 1] AS state FROM orders)")
def p22_progress(spark, sf_dir):
    states = F.array(*map(F.lit, [*LIFECYCLE, "ARCHIVED"]))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.element_at(states, (F.col("o_orderkey") % (len(LIFECYCLE) + 1) + 1).cast("int")).alias("state"))
    return rows.withColumn("progress", V.progress_of(F.col("state")))


@query("p22_evaluation_state", f"""{with_cte('routed_v')} SELECT evaluation_id, CASE WHEN route = 'auto_commit' THEN 'auto_committed' WHEN bidder_id % 3 = 0 THEN 'resolved' WHEN second_officer THEN 'pending_second_officer' ELSE 'pending_review' END AS state FROM routed_v""")
def p22_evaluation_state(spark, sf_dir):
    return views.cells(spark, sf_dir).select("evaluation_id", V.evaluation_state(F.col("route"), F.col("second_officer"), F.col("bidder_id") % 3 == 0).alias("state"))


@query("a19_dashboard", "WITH l AS (SELECT o_custkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS state FROM orders GROUP BY 1) SELECT count(*) AS total, count(*) FILTER (state <> 'F') AS active, count(*) FILTER (state = 'P') AS pending_review FROM l")
def a19_dashboard(spark, sf_dir):
    last = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("state"))
    return last.agg(F.count("*").alias("total"), F.count_if(F.col("state") != "F").alias("active"), F.count_if(F.col("state") == "P").alias("pending_review"))


@query("a20_events_by_day", "SELECT CAST(date_trunc('day', ts) AS DATE) AS day, event_type, count(*) AS events FROM events GROUP BY 1, 2")
def a20_events_by_day(spark, sf_dir):
    return listings.events_by_day(table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type"), "ts", "event_type")


@query("k3_decision_timeline", "SELECT event_id, user_id AS tender_id, event_type || ' of ' || CAST(props->>'$.k' AS VARCHAR) AS summary FROM events WHERE event_type IN ('purchase', 'error')")
def k3_decision_timeline(spark, sf_dir):
    events = table(spark, sf_dir, "events").where(F.col("event_type").isin("purchase", "error"))
    return events.select("event_id", F.col("user_id").alias("tender_id"), F.concat("event_type", F.lit(" of "), F.get_json_object("props", "$.k")).alias("summary"))


TIMELINE_KINDS = [*history.DECISIONS, "tender_created", "anomaly_flagged"]
TIMELINE_DATA = "CASE WHEN event_id % 11 = 0 THEN '{broken' ELSE '{\"decision\":\"d' || event_id % 3 || '\",\"final_verdict\":\"PASS\",\"section_count\":' || event_id % 9 || ',\"target_state\":\"DRAFT\"}' END"


@query("k3_six_decisions", f"""WITH e AS (SELECT event_id, user_id AS tender_id, ({TIMELINE_KINDS})[event_id % {len(TIMELINE_KINDS)} + 1] AS event_type, event_id % 11 = 0 AS broken, 'd' || event_id % 3 AS decision, CAST(event_id % 9 AS VARCHAR) AS sections FROM events)
    SELECT event_id, tender_id, event_type, CASE event_type WHEN 'evaluation_decided' THEN 'Officer ' || CASE WHEN broken THEN '?' ELSE decision END || ' → ' || CASE WHEN broken THEN '?' ELSE 'PASS' END WHEN 'second_officer_decided' THEN 'Second officer ' || CASE WHEN broken THEN '?' ELSE decision END
      WHEN 'concurrence_decided' THEN 'Concurrence ' || CASE WHEN broken THEN '?' ELSE decision END WHEN 'tec_report_finalised' THEN 'TEC report sealed (' || CASE WHEN broken THEN '?' ELSE sections END || ' sections)' WHEN 'criteria_approved' THEN 'Criteria approved (? criteria)'
      ELSE 'State → ' || CASE WHEN broken THEN '?' ELSE 'DRAFT' END END AS summary FROM e WHERE event_type NOT IN ('tender_created', 'anomaly_flagged')""")
def k3_six_decisions(spark, sf_dir):
    kinds = F.array(*map(F.lit, TIMELINE_KINDS))
    events = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("tender_id"), F.element_at(kinds, (F.col("event_id") % len(TIMELINE_KINDS) + 1).cast("int")).alias("event_type"), F.expr(TIMELINE_DATA).alias("event_data"))
    return history.decision_timeline(events).drop("event_data")


@query("k4_latest_turns", "WITH k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) SELECT conv_id, turn, role FROM k WHERE k <= 3")
def k4_latest_turns(spark, sf_dir):
    return listings.latest_turns(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn", 3)


@query("w3_w4_latest_per_key", "WITH k AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) SELECT user_id, event_type, event_id, value FROM k WHERE k = 1")
def w3_w4_latest_per_key(spark, sf_dir):
    return history.latest(table(spark, sf_dir, "events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id", "value")


CHANGES = "c AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = 0 THEN NULL ELSE l_discount END AS discount, l_quantity AS quantity, l_shipdate, l_extendedprice, l_partkey FROM lineitem)"


@query("w6_criterion_versions", f"""WITH {CHANGES}, v AS (SELECT *, row_number() OVER w AS version, lead(l_shipdate) OVER w AS valid_to, last_value(discount IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING) AS d FROM c WINDOW w AS (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_extendedprice, l_partkey, quantity))
    SELECT l_orderkey, l_linenumber, version, d AS discount, l_shipdate AS valid_from, valid_to, valid_to IS NULL AS is_current FROM v""")
def w6_criterion_versions(spark, sf_dir):
    changes = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_discount") != 0, F.col("l_discount")).alias("discount"), "l_quantity", "l_shipdate", "l_extendedprice", "l_partkey")
    found = history.versions(changes, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_extendedprice", "l_partkey", "l_quantity"], ["discount"], "l_shipdate")
    return found.select("l_orderkey", "l_linenumber", "version", "discount", "valid_from", "valid_to", "is_current")


@query("w5_section_revisions", """WITH x AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN lag(text) OVER (PARTITION BY conv_id ORDER BY turn) || ' ' ELSE text END AS body, role FROM conversations), b AS (SELECT *, lag(body) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM x), k AS (SELECT * FROM b WHERE before IS NULL OR trim(before) <> trim(body))
    SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS revision, CASE WHEN role = 'assistant' THEN 'ai' ELSE 'co-authored' END AS authored_by FROM k""")
def w5_section_revisions(spark, sf_dir):
    turns = segments.previous(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), ["conv_id"], ["turn"], "text", "before")
    edits = turns.select("conv_id", "turn", F.when(F.col("turn") % 3 == 2, F.concat("before", F.lit(" "))).otherwise(F.col("text")).alias("body"), F.when(F.col("role") == "assistant", "ai").otherwise("officer").alias("author"))
    return history.revisions(edits, ["conv_id"], ["turn"], "body", "author").select("conv_id", "turn", "revision", "authored_by")


@query("a18_authorship", "SELECT conv_id, count(*) FILTER (role = 'assistant') AS ai, count(*) FILTER (role = 'system') AS officer, count(*) FILTER (role = 'user') AS co_authored, count(*) AS sections FROM conversations GROUP BY 1")
def a18_authorship(spark, sf_dir):
    author = F.when(F.col("role") == "assistant", "ai").when(F.col("role") == "system", "officer").when(F.col("role") == "user", "co-authored")
    return listings.authorship(table(spark, sf_dir, "conversations").select("conv_id", author.alias("author")), "conv_id", "author")


@query("w7_corrigendum_numbers", """WITH d AS (SELECT DISTINCT source, md5(text) AS document FROM documents), k AS (SELECT source, md5(text) AS document, max(doc_id) AS number FROM documents WHERE doc_id % 3 = 0 AND source <> 'src1' GROUP BY 1, 2), m AS (SELECT source, max(number) AS most FROM k GROUP BY 1),
    n AS (SELECT * FROM d ANTI JOIN k USING (source, document)) SELECT n.source, document, row_number() OVER (PARTITION BY n.source ORDER BY document) + coalesce(most, 0) AS number FROM n LEFT JOIN m ON m.source = n.source""")
def w7_corrigendum_numbers(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", F.md5("text").alias("document"))
    stored = docs.where("doc_id % 3 = 0 and source <> 'src1'").groupBy("source", "document").agg(F.max("doc_id").alias("number"))
    return history.corrigendum_numbers(docs, stored, "source")


@query("j14_version_in_force", """WITH v AS (SELECT o_custkey AS k, o_orderdate AS created, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version FROM orders), f AS (SELECT l_orderkey, l_linenumber, l_partkey, o_custkey AS k, l_shipdate AS shipped FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
    SELECT l_orderkey, l_linenumber, l_partkey, shipped, (SELECT max(version) FROM v WHERE v.k = f.k AND v.created <= f.shipped) AS version_in_force FROM f""")
def j14_version_in_force(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("created"))
    versions = segments.ranked(orders, ["k"], ["created", "o_orderkey"], "version")
    facts = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_shipdate").alias("shipped")).join(orders.select("o_orderkey", "k"), F.col("l_orderkey") == F.col("o_orderkey"))
    return history.as_of(facts.drop("o_orderkey"), versions, "k", "shipped", "created", "version").select("l_orderkey", "l_linenumber", "l_partkey", "shipped", F.col("version_in_force").cast("bigint").alias("version_in_force"))


@query("w9_keyset_page", "SELECT event_id, event_type FROM events WHERE event_id > 500 AND event_type = 'view' ORDER BY event_id LIMIT 51")
def w9_keyset_page(spark, sf_dir):
    return history.keyset_page(table(spark, sf_dir, "events").where("event_type = 'view'").select("event_id", "event_type"), "event_id", 50, after=500)


@query("w9_keyset_page_back", "SELECT event_id, event_type FROM events WHERE event_id < 500 AND event_type = 'view' ORDER BY event_id DESC LIMIT 51")
def w9_keyset_page_back(spark, sf_dir):
    return history.keyset_page(table(spark, sf_dir, "events").where("event_type = 'view'").select("event_id", "event_type"), "event_id", 50, after=500, descending=True)


@query("w10_event_context", "WITH w AS (SELECT user_id, event_id, event_type, list(event_id) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS around FROM events) SELECT user_id, event_id, around FROM w WHERE event_type = 'error'")
def w10_event_context(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return history.event_context(events, "user_id", "event_id", 3, F.col("event_type") == "error").drop("event_type")


@query("w11_recent_merged", "WITH k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) SELECT user_id, event_id FROM k WHERE k <= 5 ORDER BY event_id DESC LIMIT 12")
def w11_recent_merged(spark, sf_dir):
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("event_id")))
    return table(spark, sf_dir, "events").select("user_id", "event_id").withColumn("k", k).where("k <= 5").drop("k").orderBy(F.desc("event_id")).limit(12)


REPLAY = """c AS (SELECT o_custkey AS tender_id, o_orderkey AS cell, o_orderdate AS created, CASE o_orderstatus WHEN 'O' THEN 'PASS' WHEN 'F' THEN 'FAIL' ELSE 'REVIEW' END AS verdict, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL 400 DAY END AS decided_at FROM orders),
  s AS (SELECT l_orderkey AS cell, l_shipdate AS at, arg_max(CASE l_returnflag WHEN 'A' THEN 'FAIL' WHEN 'N' THEN 'PASS' ELSE 'REVIEW' END, l_linenumber * 10000000 + l_partkey) AS verdict FROM lineitem GROUP BY 1, 2),
  p AS (SELECT DISTINCT tender_id, created AS point FROM c UNION SELECT DISTINCT tender_id, TIMESTAMP '1996-07-01' FROM c)"""


@query("h2_state_as_of", f"""WITH {REPLAY}, h AS (SELECT c.*, p.point FROM p JOIN c ON c.tender_id = p.tender_id AND c.created <= p.point),
    l AS (SELECT h.cell, h.point, arg_max(s.verdict, s.at) AS v FROM h JOIN s ON s.cell = h.cell AND s.at <= h.point GROUP BY 1, 2),
    x AS (SELECT h.*, coalesce(l.v, h.verdict) AS v FROM h LEFT JOIN l ON l.cell = h.cell AND l.point = h.point),
    n AS (SELECT tender_id, point, count(*) AS cells, count(*) FILTER (decided_at <= point) AS decided, count(*) FILTER (decided_at > point) AS decided_later, count(*) FILTER (v = 'PASS') AS passes, count(*) FILTER (v = 'FAIL') AS fails, count(*) FILTER (v = 'REVIEW') AS reviews FROM x GROUP BY 1, 2),
    m AS (SELECT p.tender_id, p.point, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS state FROM p JOIN orders ON o_custkey = p.tender_id AND o_orderdate <= p.point GROUP BY 1, 2)
    SELECT n.*, m.state FROM n LEFT JOIN m ON m.tender_id = n.tender_id AND m.point = n.point""")
def h2_state_as_of(spark, sf_dir):
    """Each tender at every time one of its cells was made, and at one fixed time."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    verdict = F.when(F.col("o_orderstatus") == "O", "PASS").when(F.col("o_orderstatus") == "F", "FAIL").otherwise("REVIEW")
    cells = orders.select(F.col("o_custkey").alias("tender_id"), F.col("o_orderkey").alias("cell"), F.col("o_orderdate").alias("created"), verdict.alias("verdict"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderdate") + F.expr("interval 400 days")).alias("decided_at"))
    seen = F.when(F.col("l_returnflag") == "A", "FAIL").when(F.col("l_returnflag") == "N", "PASS").otherwise("REVIEW")
    snapshots = lines.select(F.col("l_orderkey").alias("cell"), F.col("l_shipdate").alias("at"), (F.col("l_linenumber").cast("bigint") * 10_000_000 + F.col("l_partkey")).alias("id"), seen.alias("verdict"))
    states = orders.select(F.col("o_custkey").alias("tender_id"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("to_state"))
    fixed = cells.select("tender_id", F.lit("1996-07-01 00:00:00").cast("timestamp_ntz").alias("point"))
    return history.state_as_of(cells, snapshots, states, cells.select("tender_id", F.col("created").alias("point")).union(fixed))


@query("j24_reproduce_diff", f"""{with_cte('cell_v')}, r AS (SELECT evaluation_id, CASE WHEN bidder_id % 17 = 0 THEN 'REVIEW' ELSE verdict END AS verdict, confidence + CASE WHEN bidder_id % 13 = 0 THEN 0.002 WHEN bidder_id % 13 = 1 THEN 0.0005 ELSE 0 END AS confidence,
      CASE WHEN bidder_id % 3 = 0 THEN list_append(figures, 1) ELSE list_transform(figures, lambda f: f + f % 2) END AS figures, bidder_id % 19 = 0 AS lost, CASE WHEN bidder_id % 23 = 0 THEN 'agree' ELSE agreement END AS agreement FROM cell_v),
    d AS (SELECT c.evaluation_id, list_concat(CASE WHEN c.verdict <> r.verdict THEN ['verdict'] ELSE [] END, CASE WHEN abs(c.confidence - r.confidence) > 0.001 THEN ['confidence'] ELSE [] END,
      CASE WHEN lost THEN ['value'] ELSE list_concat(CASE WHEN c.agreement <> r.agreement THEN ['value.agreement'] ELSE [] END, CASE WHEN len(c.figures) <> len(r.figures) THEN ['value.figures'] ELSE list_filter(list_transform(range(1, len(c.figures) + 1), lambda i: CASE WHEN c.figures[i] <> r.figures[i] THEN 'value.figures[' || (i - 1) || ']' END), lambda x: x IS NOT NULL) END) END) AS differing
      FROM cell_v c JOIN r USING (evaluation_id)) SELECT * FROM d WHERE len(differing) > 0""")
def j24_reproduce_diff(spark, sf_dir):
    k = F.col("bidder_id")
    cells = views.cells(spark, sf_dir)
    value = lambda agreement, figures: F.struct(agreement.alias("agreement"), figures.alias("figures"))
    stored = cells.select("evaluation_id", "verdict", "confidence", value(F.col("agreement"), F.col("figures")).alias("value"))
    figures = F.when(k % 3 == 0, F.array_append("figures", F.lit(1).cast("bigint"))).otherwise(F.transform("figures", lambda f: f + f % 2))
    again = cells.select(
        "evaluation_id", F.when(k % 17 == 0, "REVIEW").otherwise(F.col("verdict")).alias("verdict"), (F.col("confidence") + F.when(k % 13 == 0, 0.002).when(k % 13 == 1, 0.0005).otherwise(0.0)).alias("confidence"),
        F.when(k % 19 != 0, value(F.when(k % 23 == 0, "agree").otherwise(F.col("agreement")), figures)).alias("value"),
    )
    return history.reproduce_diff(stored, again, "evaluation_id")


@query("h7_signature_drift", f"SELECT o_orderpriority AS tender_id, count(*) FILTER (CASE WHEN o_orderkey % 9 = 0 THEN 'old' ELSE '{history.signature({'rules': 'v3', 'router': 'v2'})}' END <> '{history.signature({'rules': 'v3', 'router': 'v2'})}') AS drifted, count(*) AS cells FROM orders GROUP BY 1")
def h7_signature_drift(spark, sf_dir):
    current = history.signature({"router": "v2", "rules": "v3"})
    cells = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("tender_id"), F.when(F.col("o_orderkey") % 9 == 0, "old").otherwise(current).alias("signature"))
    return listings.signature_drift(cells, "tender_id", F.col("signature"), current)


@query("s8_manifest", """WITH e AS (SELECT source, CAST(doc_id AS VARCHAR) AS path, sha256(text) AS sha FROM documents), l AS (SELECT source, substr(sha256(path), 1, 4) AS b, count(*) AS n, sha256(string_agg(path || ' ' || sha, chr(10) ORDER BY path || ' ' || sha)) AS seal FROM e GROUP BY 1, 2),
    h AS (SELECT source, substr(b, 1, 2) AS u, sum(n) AS n, sha256(string_agg(b || ' ' || seal, chr(10) ORDER BY b || ' ' || seal)) AS seal FROM l GROUP BY 1, 2) SELECT source, CAST(sum(n) AS BIGINT) AS files, sha256(string_agg(u || ' ' || seal, chr(10) ORDER BY u || ' ' || seal)) AS manifest_hash FROM h GROUP BY 1""")
def s8_manifest(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select("source", F.col("doc_id").cast("string").alias("path"), "text")
    return history.manifest(files, "source", "path", F.col("text"))[1]


@query("s9_verify_manifest", """WITH x AS (SELECT source AS key, doc_id, CAST(doc_id AS VARCHAR) AS path FROM documents)
    SELECT key, path, CASE doc_id % 31 WHEN 0 THEN 'MISSING' WHEN 1 THEN 'TAMPERED' WHEN 2 THEN 'EXTRA' ELSE 'OK' END AS status FROM x""")
def s9_verify_manifest(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select(F.col("source").alias("key"), "doc_id", F.col("doc_id").cast("string").alias("path"), "text")
    expected = history.manifest(files.where("doc_id % 31 <> 2"), "key", "path", F.col("text"))[0]
    changed = F.when(F.col("doc_id") % 31 == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return history.verify_manifest(expected, history.manifest(files.where("doc_id % 31 <> 0"), "key", "path", changed)[0])


@query("h8_post_review_checks", f"{with_cte('routed_v')}, q(check_id) AS (VALUES ('year_match'), ('account_type'), ('ca_verification')) SELECT evaluation_id, check_id AS check FROM routed_v CROSS JOIN q WHERE route <> 'auto_commit' AND NOT (bidder_id % 4 = 0 AND check_id = 'year_match')".replace("AS check FROM", 'AS "check" FROM'))
def h8_post_review_checks(spark, sf_dir):
    cells = views.cells(spark, sf_dir)
    asked = cells.where("bidder_id % 4 = 0").select("evaluation_id", F.lit("year_match").alias("check"))
    return history.post_review_checks(cells, asked)


OFFICERS = "o AS (SELECT s_suppkey AS officer_id, s_name AS name, CASE s_suppkey % 3 WHEN 0 THEN 'junior' WHEN 1 THEN 'senior' ELSE 'reviewer' END AS role FROM supplier)"


def _officers(spark, sf_dir):
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("officer_id"), F.col("s_name").alias("name"), F.when(k % 3 == 0, "junior").when(k % 3 == 1, "senior").otherwise("reviewer").alias("role"))


@query("w8_second_officer", f"WITH {OFFICERS}, r AS (SELECT o_orderkey AS request, o_orderkey % 7 AS requested_by FROM orders), f AS (SELECT *, row_number() OVER (ORDER BY CASE role WHEN 'reviewer' THEN 0 ELSE 1 END, name, officer_id) AS k FROM o WHERE role <> 'junior') SELECT request, requested_by, (SELECT arg_min(officer_id, k) FROM f WHERE officer_id <> requested_by) AS target FROM r")
def w8_second_officer(spark, sf_dir):
    requests = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request"), (F.col("o_orderkey") % 7).alias("requested_by"))
    return history.second_officers(requests, _officers(spark, sf_dir))


@query("k5_officer_inbox", f"WITH {OFFICERS} SELECT o_orderkey, officer_id, o_orderdate FROM orders JOIN o ON o_custkey % 100 = officer_id WHERE o_orderstatus = 'O' AND role = 'reviewer'")
def k5_officer_inbox(spark, sf_dir):
    open_ = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select("o_orderkey", (F.col("o_custkey") % 100).alias("target"), "o_orderdate")
    return listings.inbox(open_, _officers(spark, sf_dir).where("role = 'reviewer'")).select("o_orderkey", "officer_id", "o_orderdate")


@query("w13_officer_decisions", f"""{with_cte('routed_v')}, d AS (SELECT evaluation_id, bidder_id % 3 AS k FROM routed_v WHERE bidder_id % 3 <> 2)
    SELECT r.evaluation_id, CASE WHEN d.k = 1 THEN 'PASS' ELSE r.verdict END AS final_verdict, second_officer OR (d.k = 1 AND route = 'mandatory_review') AS concurrence,
      CASE WHEN second_officer OR (d.k = 1 AND route = 'mandatory_review') THEN 'awaiting_concurrence' WHEN d.k = 1 THEN 'overridden' ELSE 'confirmed' END AS state FROM routed_v r JOIN d USING (evaluation_id)""")
def w13_officer_decisions(spark, sf_dir):
    cells = views.cells(spark, sf_dir)
    decisions = cells.where("bidder_id % 3 <> 2").select("evaluation_id", F.explode(F.array(F.struct(F.lit(1).alias("at"), F.lit("confirm").alias("decision"), F.col("verdict").alias("new")), F.struct(F.lit(2).alias("at"), F.when(F.col("bidder_id") % 3 == 1, "override").otherwise("confirm").alias("decision"), F.when(F.col("bidder_id") % 3 == 1, "PASS").otherwise(F.col("verdict")).alias("new")))).alias("d")).select("evaluation_id", "d.*")
    return matrix.apply_decisions(cells, decisions)


@query("h6_precedents", f"{with_cte('routed_v')} SELECT evaluation_id, tender_id, criterion_id, 'override on ' || criterion_id || ': ' || verdict || ' became PASS' AS interpretation FROM routed_v WHERE bidder_id % 3 = 1 AND verdict <> 'PASS'")
def h6_precedents(spark, sf_dir):
    cells, k = views.cells(spark, sf_dir), F.col("bidder_id")
    decisions = cells.select("evaluation_id", F.when(k % 3 == 1, "override").otherwise("confirm").alias("decision"), F.lit("PASS").alias("new"))
    return listings.override_precedents(cells, decisions)


CORRIGENDA = "corrigendum_v AS (SELECT p_brand AS tender_id, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_type) AS BIGINT) AS sequence_number, p_type AS title, list_sort(list(DISTINCT p_size)) AS versions FROM part GROUP BY p_brand, p_type)"


def corrigenda(spark, sf_dir):
    """(tender_id, sequence_number, title, versions): a corrigendum of a brand for each type of part."""
    from pyspark.sql import Window

    found = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("tender_id"), F.col("p_type").alias("title")).agg(F.array_sort(F.collect_set("p_size")).alias("versions"))
    place = F.row_number().over(Window.partitionBy("tender_id").orderBy("title"))
    return found.select("tender_id", place.cast("bigint").alias("sequence_number"), "title", "versions")


@query("a23_tender_snapshots", f"""{with_cte('flag_v', 'routed_v')}, {CORRIGENDA}, t AS (SELECT p_brand AS tender_id, min(p_type) AS title, count(*) AS lots FROM part GROUP BY 1),
    fk AS (SELECT *, row_number() OVER (PARTITION BY tender_id ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, flag_type, bidder_id NULLS FIRST, evaluation_id NULLS FIRST) AS k FROM flag_v),
    f AS (SELECT tender_id, list(struct_pack(place := k, bidder_id := bidder_id, evaluation_id := evaluation_id, severity := severity, flag_type := flag_type) ORDER BY k) AS fs FROM fk WHERE k <= 30 GROUP BY 1),
    c AS (SELECT tender_id, list(struct_pack(criterion_id := criterion_id, is_mandatory := is_mandatory) ORDER BY criterion_id) AS cs FROM (SELECT DISTINCT tender_id, criterion_id, is_mandatory FROM routed_v) GROUP BY 1),
    g AS (SELECT tender_id, list(struct_pack(sequence_number := sequence_number, title := title) ORDER BY sequence_number) AS gs FROM corrigendum_v GROUP BY 1)
    SELECT t.tender_id, NULL AS bidder_id, CAST(to_json(struct_pack(tender := struct_pack(tender_id := t.tender_id, title := title, lots := lots), criteria := coalesce(cs, []), open_anomalies := coalesce(fs, []), corrigenda := coalesce(gs, []))) AS VARCHAR) AS snapshot
    FROM t LEFT JOIN c ON c.tender_id = t.tender_id LEFT JOIN f ON f.tender_id = t.tender_id LEFT JOIN g ON g.tender_id = t.tender_id
    UNION ALL SELECT tender_id, bidder_id, CAST(to_json(struct_pack(bidder := struct_pack(bidder_id := bidder_id, company_name := s_name), evaluations := list(struct_pack(criterion_id := criterion_id, verdict := verdict, route := route) ORDER BY criterion_id))) AS VARCHAR)
    FROM routed_v JOIN supplier ON bidder_id = s_suppkey GROUP BY tender_id, bidder_id, s_name""")
def a23_tender_snapshots(spark, sf_dir):
    cells = views.kept_cells(spark, sf_dir)
    tenders = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("tender_id")).agg(F.min("p_type").alias("title"), F.count("*").alias("lots"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("bidder_id"), F.col("s_name").alias("company_name"))
    bidders = cells.select("tender_id", "bidder_id").distinct().join(suppliers, "bidder_id").select("tender_id", "bidder_id", "company_name")
    criteria = cells.select("tender_id", "criterion_id", "is_mandatory").distinct()
    return matrix.tender_snapshots(tenders, bidders, criteria, cells.select("tender_id", "bidder_id", "criterion_id", "verdict", "route"), views.flags(spark, sf_dir, cells).select("tender_id", "bidder_id", "evaluation_id", "severity", "flag_type"), corrigenda(spark, sf_dir).drop("versions"))


@query("h5_a23_snapshots", f"""{with_cte('routed_v')} SELECT evaluation_id, CAST(to_json(struct_pack(id := bidder_id, name := s_name)) AS VARCHAR) AS bidder, verdict, route,
    CAST(to_json(struct_pack(figures := figures, has_documents := has_documents)) AS VARCHAR) AS evidence,
    CAST(to_json(struct_pack(decision := CASE bidder_id % 3 WHEN 0 THEN 'confirm' WHEN 1 THEN 'override' END, officer_id := CASE WHEN bidder_id % 3 <> 2 THEN bidder_id % 7 END, decided_at := CASE WHEN bidder_id % 3 <> 2 THEN '2024-01-01' END)) AS VARCHAR) AS officer_decision,
    CAST(to_json(struct_pack(officer_id := CASE WHEN bidder_id % 3 = 1 THEN bidder_id % 5 END, decision := CASE WHEN bidder_id % 3 = 1 THEN 'concur' END)) AS VARCHAR) AS second_officer,
    CAST(to_json(struct_pack(id := criterion_id, type := 'numeric_threshold', rule := CASE criterion_id WHEN 'A' THEN 'each_of_n_years' WHEN 'N' THEN 'average_of_n_years' ELSE 'any_of_n_years' END, periods := CASE WHEN criterion_id = 'R' THEN 1 ELSE 2 END, threshold_value := 50000, is_mandatory := is_mandatory)) AS VARCHAR) AS criterion,
    round(confidence, 6) AS confidence, round(extraction_confidence, 6) AS field_extraction, len(model_figures) AS model_figures, dissent,
    CAST(to_json(struct_pack(pipeline_signature := '{history.signature({'router': 'v2', 'rules': 'v3'})}', verdict_prompt := sha256(evaluation_id))) AS VARCHAR) AS hashes, json_array_length(to_json(rules_figures)) AS rules_figures
    FROM routed_v LEFT JOIN supplier ON bidder_id = s_suppkey""")
def h5_a23_snapshots(spark, sf_dir):
    found = matrix.decision_snapshots(views.cells(spark, sf_dir), _named(spark, sf_dir), _decided(spark, sf_dir), {"pipeline_signature": F.lit(history.signature({"router": "v2", "rules": "v3"})), "verdict_prompt": F.sha2("evaluation_id", 256)})
    part = lambda name: F.get_json_object("snapshot", f"$.{name}").alias(name)
    number = lambda path, name: F.round(F.get_json_object("snapshot", f"$.{path}").cast("double"), 6).alias(name)
    figures = [F.coalesce(F.json_array_length(F.get_json_object("snapshot", f"$.branches.{b}.figures")), F.lit(0)).alias(f"{b}_figures") for b in ("rules", "model")]
    dissent = F.get_json_object("snapshot", "$.branches.dissent").alias("dissent")
    parts = map(part, ("bidder", "criterion", "verdict", "route", "evidence", "officer_decision", "second_officer", "hashes"))
    return found.select("evaluation_id", *parts, *figures, dissent, number("confidence", "confidence"), number("confidence_breakdown.field_extraction", "field_extraction"))


def _named(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("bidder_id"), F.col("s_name").alias("name"))


def _decided(spark, sf_dir):
    k = F.col("bidder_id")
    return views.cells(spark, sf_dir).where(k % 3 != 2).select(
        "evaluation_id", F.when(k % 3 == 1, "override").otherwise("confirm").alias("decision"), (k % 7).alias("officer_id"), F.lit("2024-01-01").alias("decided_at"),
        F.when(k % 3 == 1, k % 5).alias("second_officer_id"), F.when(k % 3 == 1, "concur").alias("second_decision"),
    )
