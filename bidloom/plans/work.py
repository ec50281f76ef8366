"""Queries over registries, citations, checklists, precedents, graphs and data quality."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from bidloom.functions import values as V
from bidloom.operators import checks, detectors, listings, matrix, workflow
from bidloom.plans.audit import CORRIGENDA, corrigenda
from bidloom.plans.cells import COUNTS
from bidloom.plans.forensics import CLAIMS, claims_of
from bidloom.plans.registry import query
from bidloom.sources import views
from bidloom.sources.shared import new_path
from bidloom.sources.tables import table
from bidloom.sources.views import with_cte


@query("s6_registry_append", "SELECT DISTINCT upper(trim(p_brand)) AS brand, upper(trim(p_type)) AS kind FROM part WHERE (upper(trim(p_brand)), upper(trim(p_type))) NOT IN (SELECT upper(p_brand), upper(p_type) FROM part WHERE p_partkey % 20 = 0)")
def s6_registry_append(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    entries = parts.select(F.concat(F.lit(" "), F.lower("p_brand")).alias("brand"), F.col("p_type").alias("kind"))
    stored = parts.where("p_partkey % 20 = 0").select(F.upper("p_brand").alias("brand"), F.upper("p_type").alias("kind"))
    return workflow.registry_additions(entries, stored, ["brand", "kind"])


@query("s7_evidence_export", f"""{with_cte('routed_v')}, {CORRIGENDA}, x AS (SELECT tender_id, 'decisions' AS part, CAST(to_json(struct_pack(evaluation_id := evaluation_id, verdict := verdict, route := route)) AS VARCHAR) AS record FROM routed_v
    UNION ALL SELECT DISTINCT p_brand, 'documents', CAST(to_json(struct_pack(doc_id := l_orderkey)) AS VARCHAR) FROM lineitem JOIN part ON l_partkey = p_partkey
    UNION ALL SELECT p_brand, 'timeline', CAST(to_json(struct_pack(at := l_shipdate::DATE::VARCHAR, event := l_returnflag, doc_id := l_orderkey)) AS VARCHAR) FROM lineitem JOIN part ON l_partkey = p_partkey
    UNION ALL SELECT tender_id, 'corrigenda', CAST(to_json(struct_pack(sequence_number := sequence_number, title := title, versions := versions)) AS VARCHAR) FROM corrigendum_v)
    SELECT tender_id, part, record FROM x""")
def s7_evidence_export(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", F.date_format("l_shipdate", "yyyy-MM-dd").alias("at"), F.col("l_returnflag").alias("event"), F.col("l_orderkey").alias("doc_id"))
    cited = lines.join(table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("tender_id")), F.col("l_partkey") == F.col("p_partkey"))
    parts = {
        "decisions": views.cells(spark, sf_dir).select("tender_id", "evaluation_id", "verdict", "route"), "documents": workflow.cited_documents(cited, cited.withColumn("complete", F.lit(True))),
        "timeline": cited.select("tender_id", "at", "event", "doc_id"), "corrigenda": corrigenda(spark, sf_dir),
    }
    return matrix.evidence_export(parts, new_path(spark, "export"))


#: What may be kept already, by kind: its keys, its rows, and those kept; the same expressions serve both engines.
KEPT = {
    "citation": ("lineitem", "CAST(l_orderkey AS STRING)", "CAST(l_partkey AS STRING)", "l_linenumber > 2", "l_linenumber <= 2"), "response": ("lineitem", "CAST(l_suppkey AS STRING)", "CAST(l_linenumber AS STRING)", "l_quantity < 20", "l_quantity >= 45"),
    "request": ("orders", "CAST(o_custkey AS STRING)", "o_orderpriority", "o_orderstatus <> 'F'", "o_orderstatus = 'F'"), "section": ("conversations", "CAST(conv_id AS STRING)", "role", "turn >= 3", "turn < 3"),
}


@query("j7_not_yet_kept", " UNION ALL ".join(f"(SELECT '{kind}' AS kind, {a} AS a, {b} AS b FROM {t} WHERE {new} EXCEPT SELECT '{kind}', {a}, {b} FROM {t} WHERE {old})" for kind, (t, a, b, new, old) in KEPT.items()))
def j7_not_yet_kept(spark, sf_dir):
    """Citations, responses, requests and sections that aren't kept yet, each once."""
    found = None
    for kind, (name, a, b, new, old) in KEPT.items():
        rows = table(spark, sf_dir, name)
        keyed = lambda w, rows=rows, a=a, b=b: rows.where(w).select(F.expr(a).alias("a"), F.expr(b).alias("b"))
        one = workflow.not_yet(keyed(new), keyed(old), ["a", "b"]).select(F.lit(kind).alias("kind"), "a", "b")
        found = one if found is None else found.union(one)
    return found


@query("p25_data_quality", """SELECT 'orders' AS table, 'status' AS rule, count(*) FILTER (o_orderstatus NOT IN ('O', 'F')) AS violations FROM orders UNION ALL SELECT 'orders', 'price', count(*) FILTER (NOT o_totalprice BETWEEN 1000 AND 300000) FROM orders
    UNION ALL SELECT 'events', 'json', count(*) FILTER (NOT json_valid(props)) FROM events UNION ALL SELECT 'lineitem', 'l_orderkey has a parent', count(*) FILTER (l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')) FROM lineitem""".replace("AS table", 'AS "table"'))
def p25_data_quality(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    found = workflow.violations("orders", orders, {"status": F.col("o_orderstatus").isin("O", "F"), "price": F.col("o_totalprice").between(1000, 300_000)})
    found = found.union(workflow.violations("events", table(spark, sf_dir, "events"), {"json": F.try_parse_json("props").isNotNull()}))
    return found.union(workflow.orphans("lineitem", table(spark, sf_dir, "lineitem"), "l_orderkey", orders.where("o_orderstatus <> 'P'"), "o_orderkey"))


@query("j1_star_join", f"{with_cte('routed_v')} SELECT evaluation_id, s_name AS company, n_name AS region, verdict FROM routed_v JOIN supplier ON bidder_id = s_suppkey JOIN nation ON s_nationkey = n_nationkey")
def j1_star_join(spark, sf_dir):
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("company"), "s_nationkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("region"))
    joined = listings.with_dimensions(views.cells(spark, sf_dir), [("bidder_id", suppliers, "s_suppkey"), ("s_nationkey", nations, "n_nationkey")])
    return joined.select("evaluation_id", "company", "region", "verdict")


@query("j2_forward_citations", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, p_name AS word, s_name AS page FROM lineitem LEFT JOIN part ON l_partkey = p_partkey AND p_size > 25 LEFT JOIN supplier ON l_suppkey = s_suppkey AND s_acctbal > 0")
def j2_forward_citations(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    words = table(spark, sf_dir, "part").where("p_size > 25").select("p_partkey", F.col("p_name").alias("word"))
    pages = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select("s_suppkey", F.col("s_name").alias("page"))
    return listings.with_dimensions(lines, [("l_partkey", words, "p_partkey"), ("l_suppkey", pages, "s_suppkey")], "left")


@query("j3_reverse_citations", """WITH c AS (SELECT 'word' AS kind, p_partkey AS target, l_orderkey AS cell FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 25 UNION ALL SELECT 'page', s_suppkey, l_orderkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_acctbal > 0)
    SELECT kind, target, count(DISTINCT cell) AS cells, count(*) AS citations FROM c GROUP BY 1, 2""")
def j3_reverse_citations(spark, sf_dir):
    citations = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("cell"), F.col("l_partkey").alias("word"), F.col("l_suppkey").alias("page"))
    words = table(spark, sf_dir, "part").where("p_size > 25").select("p_partkey")
    pages = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select("s_suppkey")
    found = workflow.reverse_citations(citations, {"word": words, "page": pages})
    return found.groupBy("kind", "target").agg(F.countDistinct("cell").alias("cells"), F.count("*").alias("citations"))


@query("j17_precedents", """WITH c AS (SELECT p_partkey AS id, p_brand AS d, p_type AS t, string_split(lower(p_name), ' ') AS w, p_retailprice AS created FROM part), q AS (SELECT * FROM c WHERE id % 20 = 0),
    h AS (SELECT q.id AS query, c.id AS found, c.created FROM q JOIN c ON c.d = q.d AND c.id <> q.id AND len(list_intersect(list_filter(q.w, lambda x: len(x) > 3), list_filter(c.w, lambda x: len(x) > 3))) > 0),
    f AS (SELECT q.id AS query, c.id AS found, c.created FROM q JOIN c ON c.d = q.d AND c.t = q.t AND c.id <> q.id WHERE q.id NOT IN (SELECT query FROM h)),
    u AS (SELECT *, 'terms' AS basis FROM h UNION ALL SELECT *, 'type' FROM f), k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY created DESC, found) AS k FROM u) SELECT query, found, k, basis FROM k WHERE k <= 3""")
def j17_precedents(spark, sf_dir):
    corpus = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("department"), F.col("p_type").alias("kind"), F.array_distinct(V.search_terms(F.col("p_name"))).alias("terms"), F.col("p_retailprice").alias("created"))
    return workflow.precedents(corpus.where("id % 20 = 0").drop("created"), corpus)


@query("j18_response_cache", "WITH l AS (SELECT user_id AS h, arg_max(value, event_id) AS response FROM events WHERE event_type <> 'error' GROUP BY 1) SELECT c_custkey AS prompt_hash, response FROM customer LEFT JOIN l ON l.h = c_custkey")
def j18_response_cache(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("prompt_hash"), F.col("value").alias("response"), F.col("event_id").alias("at"), F.when(F.col("event_type") == "error", "failed").alias("error"))
    return workflow.cached_responses(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("prompt_hash")), log)


@query("f3_findings", """WITH f AS (SELECT user_id AS h, event_id % 4 AS run, event_id AS finding, value AS confidence, event_type = 'error' AS bad FROM events), g AS (SELECT h, run FROM f GROUP BY 1, 2 HAVING NOT bool_or(bad)), l AS (SELECT h, max(run) AS run FROM g GROUP BY 1)
    SELECT c_custkey AS evaluation_id, f.run, f.finding, f.confidence FROM customer LEFT JOIN l ON l.h = c_custkey LEFT JOIN f ON f.h = l.h AND f.run = l.run""")
def f3_findings(spark, sf_dir):
    findings = table(spark, sf_dir, "events").select(F.col("user_id").alias("prompt_hash"), (F.col("event_id") % 4).alias("run"), F.col("event_id").alias("finding"), F.col("value").alias("confidence"), F.when(F.col("event_type") == "error", "failed").alias("error"))
    return workflow.findings_for(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("evaluation_id"), F.col("c_custkey").alias("prompt_hash")), findings)


_COMMENT_SQL = "note AS (SELECT 'c-' || evaluation_id AS comment_id, evaluation_id, CASE WHEN bidder_id % 2 = 0 THEN bidder_id END AS stated_bidder, bidder_id, criterion_id, bidder_id % 60 AS officer_id, CASE WHEN bidder_id % 20 = 0 THEN ' ' ELSE 'see page ' || bidder_id % 9 END AS body, bidder_id % 8 = 0 AS affects_verdict, '2024-01-0' || (bidder_id % 9 + 1) AS created FROM routed_v WHERE bidder_id % 4 < 2), officer AS (SELECT s_suppkey AS officer_id, s_name AS name, CASE WHEN s_suppkey % 3 = 0 THEN 'senior' ELSE 'reviewer' END AS role FROM supplier WHERE s_suppkey % 7 <> 0)"


def _comments(spark, sf_dir, cells):
    k = F.col("bidder_id")
    notes = cells.where(k % 4 < 2).select(
        F.concat(F.lit("c-"), "evaluation_id").alias("comment_id"), "evaluation_id", F.when(k % 2 == 0, k).alias("bidder_id"), F.lit(None).cast("string").alias("criterion_id"), (k % 60).alias("officer_id"), F.when(k % 20 == 0, " ").otherwise(F.concat(F.lit("see page "), (k % 9).cast("string"))).alias("body"),
        (k % 8 == 0).alias("affects_verdict"), F.concat(F.lit("2024-01-0"), (k % 9 + 1).cast("string")).alias("created"),
    )
    return workflow.comments_with_author(notes, _officers(spark, sf_dir), cells)


def _officers(spark, sf_dir):
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").where(k % 7 != 0).select(k.alias("officer_id"), F.col("s_name").alias("name"), F.when(k % 3 == 0, "senior").otherwise("reviewer").alias("role"))


@query("j28_comments", f"""{with_cte('routed_v')}, {_COMMENT_SQL} SELECT comment_id, evaluation_id, bidder_id, criterion_id, n.officer_id, name AS officer_name, role AS officer_role, body, created, affects_verdict AS actionable FROM note n JOIN officer o ON o.officer_id = n.officer_id WHERE trim(body) <> ''""")
def j28_comments(spark, sf_dir):
    """Comments on cells with their authors; the bidder of some and the criterion of all come from the cell."""
    return _comments(spark, sf_dir, views.cells(spark, sf_dir))


@query("j25_review_context", f"""{with_cte('flag_v', 'routed_v')}, {_COMMENT_SQL}, said AS (SELECT n.*, o.name, o.role FROM note n JOIN officer o ON o.officer_id = n.officer_id WHERE trim(body) <> ''),
    q AS (SELECT 'r-' || evaluation_id AS request_id, evaluation_id, bidder_id % 50 AS requested_by, tender_id, bidder_id, criterion_id, verdict, route, CASE WHEN bidder_id % 3 <> 0 THEN bidder_id * 10 END AS source_doc FROM routed_v WHERE second_officer),
    fl AS (SELECT *, CASE WHEN bidder_id % 5 = 0 THEN 'dismissed' WHEN bidder_id % 5 = 1 THEN 'open' END AS state FROM flag_v)
    SELECT request_id, 'request' AS part, CAST(to_json(struct_pack(request_id := request_id, evaluation_id := evaluation_id, requested_by := requested_by)) AS VARCHAR) AS record FROM q
    UNION ALL SELECT request_id, 'evaluation', CAST(to_json(struct_pack(tender_id := tender_id, bidder_id := bidder_id, criterion_id := criterion_id, evaluation_id := evaluation_id, verdict := verdict, route := route, source_doc := source_doc)) AS VARCHAR) FROM q
    UNION ALL SELECT request_id, 'bidder', CAST(to_json(struct_pack(bidder_id := s_suppkey, company_name := s_name)) AS VARCHAR) FROM q JOIN supplier ON s_suppkey = bidder_id
    UNION ALL SELECT request_id, 'criterion', CAST(to_json(struct_pack(criterion_id := criterion_id, is_mandatory := criterion_id IN ('A', 'N'))) AS VARCHAR) FROM q
    UNION ALL SELECT request_id, 'document', CAST(to_json(struct_pack(doc_id := o_orderkey, filename := 'f' || o_orderkey || '.pdf', page_count := o_custkey)) AS VARCHAR) FROM q JOIN orders ON o_orderkey = source_doc
    UNION ALL SELECT request_id, 'officer', CAST(to_json(struct_pack(officer_id := officer_id, name := name, role := role)) AS VARCHAR) FROM q JOIN officer ON officer_id = requested_by
    UNION ALL SELECT request_id, p.part, CAST(to_json(struct_pack(comment_id := comment_id, evaluation_id := said.evaluation_id, bidder_id := said.bidder_id, criterion_id := said.criterion_id, officer_id := said.officer_id, officer_name := name, officer_role := role, body := body, created := created, actionable := affects_verdict)) AS VARCHAR) FROM q JOIN said ON said.evaluation_id = q.evaluation_id JOIN (VALUES ('comment', false), ('actionable_comment', true)) p(part, must) ON affects_verdict OR NOT must
    UNION ALL SELECT request_id, 'flag', CAST(to_json(struct_pack(tender_id := f.tender_id, bidder_id := f.bidder_id, evaluation_id := f.evaluation_id, severity := severity, flag_type := flag_type, state := state)) AS VARCHAR) FROM q JOIN fl f ON (f.evaluation_id = q.evaluation_id OR f.evaluation_id IS NULL AND f.tender_id = q.tender_id AND f.bidder_id = q.bidder_id) AND coalesce(state, '') <> 'dismissed'""")
def j25_review_context(spark, sf_dir):
    """What a second officer sees of each cell that needs one."""
    k = F.col("bidder_id")
    every = views.kept_cells(spark, sf_dir)
    cells = every.select("tender_id", "bidder_id", "criterion_id", "evaluation_id", "verdict", "route", F.when(k % 3 != 0, k * 10).alias("source_doc"))
    requests = every.where("second_officer").select(F.concat(F.lit("r-"), "evaluation_id").alias("request_id"), "evaluation_id", (k % 50).alias("requested_by"))
    bidders = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("bidder_id"), F.col("s_name").alias("company_name"))
    criteria = every.select("criterion_id", "is_mandatory").distinct()
    documents = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("f"), F.col("o_orderkey").cast("string"), F.lit(".pdf")).alias("filename"), F.col("o_custkey").alias("page_count"))
    flags = views.flags(spark, sf_dir, every).withColumn("state", F.when(k % 5 == 0, "dismissed").when(k % 5 == 1, "open"))
    return workflow.review_context(requests, cells, bidders, criteria, documents, _officers(spark, sf_dir), _comments(spark, sf_dir, every), flags)


@query("j27_shared_source", "WITH c AS (SELECT DISTINCT l_suppkey AS bidder_id, l_partkey AS source_doc, l_orderkey AS cell FROM lineitem) SELECT x.cell, x.bidder_id, x.source_doc, count(*) AS others FROM c x JOIN c y ON x.bidder_id = y.bidder_id AND x.source_doc = y.source_doc AND x.cell <> y.cell GROUP BY 1, 2, 3")
def j27_shared_source(spark, sf_dir):
    cells = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("bidder_id"), F.col("l_partkey").alias("source_doc"), F.col("l_orderkey").alias("cell"))
    return listings.shared_source(cells, ["bidder_id", "source_doc"], "cell")


@query("a10_file_vault", "SELECT lang AS tender_id, source AS bidder_id, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS pages, count(*) FILTER (n_chars > 500) AS complete FROM documents GROUP BY ROLLUP (lang, source)")
def a10_file_vault(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("lang").alias("tender_id"), F.col("source").alias("bidder_id"), "n_chars")
    return listings.file_vault(docs, ["tender_id", "bidder_id"], "n_chars", F.col("n_chars") > 500)


@query("a11_documents_by_type", "SELECT source AS bidder_id, lang AS doc_type, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS pages FROM documents GROUP BY 1, 2")
def a11_documents_by_type(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("bidder_id"), F.col("lang").alias("doc_type"), "n_chars")
    return listings.documents_by(docs, ["bidder_id", "doc_type"], "n_chars")


@query("a12_a13_checklist_status", """WITH r AS (SELECT l_suppkey AS bidder_id, 'item ' || l_linenumber AS label, CASE l_returnflag WHEN 'N' THEN 'present' WHEN 'A' THEN 'partial' ELSE 'missing' END AS state, l_linenumber % 3 = 0 AS m, l_orderkey % 2 = 0 AS ok FROM lineitem)
    SELECT bidder_id, count(*) FILTER (state = 'present') AS present, count(*) FILTER (state = 'partial') AS partial, count(*) FILTER (state = 'missing' AND m) AS missing_mandatory, coalesce(list_sort(list_distinct(list(label) FILTER (state = 'missing' AND m)))[1:3], []) AS missing_labels,
      CASE WHEN count(*) FILTER (state = 'missing' AND m AND NOT ok) > 0 THEN 'preliminary_failed' ELSE 'passed' END AS outcome FROM r GROUP BY 1""")
def a12_a13_checklist_status(spark, sf_dir):
    responses = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("bidder_id"), F.concat(F.lit("item "), F.col("l_linenumber").cast("string")).alias("label"), F.when(F.col("l_returnflag") == "N", "present").when(F.col("l_returnflag") == "A", "partial").otherwise("missing").alias("state"),
        (F.col("l_linenumber") % 3 == 0).alias("is_mandatory"), F.when(F.col("l_orderkey") % 2 == 0, "accepted").alias("officer_decision"),
    )
    return workflow.checklist_status(responses, ["bidder_id"])


@query("a22_page_confidence", "SELECT l_orderkey AS document, round(avg(CAST(l_discount AS DECIMAL(18,4))), 6) AS confidence, count(*) AS words FROM lineitem GROUP BY 1")
def a22_page_confidence(spark, sf_dir):
    return listings.page_confidence(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document"), "l_discount"), "document", "l_discount")


@query("a24_context_rollup", f"""{with_cte('flag_v', 'routed_v')}, {CLAIMS}, c AS ({COUNTS}), v AS (SELECT tender_id, CAST(sum(passes) AS BIGINT) AS passes, CAST(sum(fails) AS BIGINT) AS fails, CAST(sum(reviews) AS BIGINT) AS reviews, count(*) AS bidders FROM c GROUP BY 1),
    f AS (SELECT tender_id, count(*) AS flags, count(*) FILTER (severity = 'high') AS high FROM flag_v GROUP BY 1), o AS (SELECT tender_id, count(*) FILTER (route <> 'auto_commit') AS review, count(*) FILTER (second_officer) AS second FROM routed_v GROUP BY 1),
    n AS (SELECT tender_id, count(*) AS notes FROM routed_v WHERE bidder_id % 4 = 0 GROUP BY 1), d AS (SELECT p_brand AS tender_id, count(DISTINCT l_orderkey) AS files, count(*) AS pages FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
    r AS (SELECT p_brand AS tender_id, CASE l_returnflag WHEN 'N' THEN 'present' WHEN 'A' THEN 'partial' ELSE 'missing' END AS state, l_linenumber % 3 = 0 AS m, l_orderkey % 2 = 0 AS ok FROM lineitem JOIN part ON l_partkey = p_partkey),
    k AS (SELECT tender_id, count(*) FILTER (state = 'present') AS present, count(*) FILTER (state = 'partial') AS partial, count(*) FILTER (state = 'missing' AND m) AS missing_mandatory, CASE WHEN count(*) FILTER (state = 'missing' AND m AND NOT ok) > 0 THEN 'preliminary_failed' ELSE 'passed' END AS outcome FROM r GROUP BY 1),
    s AS (SELECT bidder_id, CASE WHEN frn IS NULL THEN 'not_found' WHEN NOT regexp_matches(frn, '{V.FRN}') THEN 'mismatch' ELSE 'verified' END AS status FROM claims UNION ALL SELECT bidder_id, CASE WHEN cin IS NULL THEN 'not_found' WHEN NOT regexp_matches(cin, '{V.CIN}') THEN 'mismatch' ELSE 'verified' END FROM claims),
    y AS (SELECT tender_id, count(*) FILTER (status = 'verified') AS verified, count(*) FILTER (status = 'mismatch') AS mismatch, count(*) FILTER (status = 'not_found') AS not_found FROM (SELECT DISTINCT tender_id, bidder_id FROM routed_v) JOIN s USING (bidder_id) GROUP BY 1)
    SELECT v.*, flags AS flags_flags, high AS flags_high, review AS requests_review, second AS requests_second, notes AS comments_notes, files AS documents_files, pages AS documents_pages, present AS checklist_present, partial AS checklist_partial,
      missing_mandatory AS checklist_missing_mandatory, outcome AS checklist_outcome, verified AS verifications_verified, mismatch AS verifications_mismatch, not_found AS verifications_not_found
    FROM v LEFT JOIN f ON f.tender_id = v.tender_id LEFT JOIN o ON o.tender_id = v.tender_id LEFT JOIN n ON n.tender_id = v.tender_id LEFT JOIN d ON d.tender_id = v.tender_id LEFT JOIN k ON k.tender_id = v.tender_id LEFT JOIN y ON y.tender_id = v.tender_id""")
def a24_context_rollup(spark, sf_dir):
    cells = views.kept_cells(spark, sf_dir)
    counts = matrix.verdict_counts(cells, ["tender_id", "bidder_id"]).groupBy("tender_id").agg(F.sum("passes").alias("passes"), F.sum("fails").alias("fails"), F.sum("reviews").alias("reviews"), F.count("*").alias("bidders"))
    brands = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("tender_id"))
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_returnflag").join(brands, F.col("l_partkey") == F.col("p_partkey"))
    responses = lines.select(
        "tender_id", F.concat(F.lit("item "), F.col("l_linenumber").cast("string")).alias("label"), F.when(F.col("l_returnflag") == "N", "present").when(F.col("l_returnflag") == "A", "partial").otherwise("missing").alias("state"),
        (F.col("l_linenumber") % 3 == 0).alias("is_mandatory"), F.when(F.col("l_orderkey") % 2 == 0, "accepted").alias("officer_decision"),
    )
    verified = checks.verify_all(claims_of(spark, sf_dir), F.lit("2024-01-01").cast("date"), {k: checks.VERIFIERS[k] for k in ("frn", "mca")})
    verified = cells.select("tender_id", "bidder_id").distinct().join(verified, "bidder_id").groupBy("tender_id").agg(*(F.count_if(F.col("status") == x).alias(x) for x in ("verified", "mismatch", "not_found")))
    parts = {
        "flags": views.flags(spark, sf_dir, cells).groupBy("tender_id").agg(F.count("*").alias("flags"), F.count_if(F.col("severity") == "high").alias("high")),
        "requests": cells.groupBy("tender_id").agg(F.count_if(F.col("route") != "auto_commit").alias("review"), F.count_if("second_officer").alias("second")),
        "comments": cells.where("bidder_id % 4 = 0").groupBy("tender_id").agg(F.count("*").alias("notes")), "documents": lines.groupBy("tender_id").agg(F.countDistinct("l_orderkey").alias("files"), F.count("*").alias("pages")),
        "checklist": workflow.checklist_status(responses, ["tender_id"]).drop("missing_labels"), "verifications": verified,
    }
    return matrix.context_rollup(counts, parts).drop("context")


@query("a26_corpus_counts", "SELECT (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS precedents, (SELECT count(*) FROM supplier WHERE s_acctbal < 0) AS registry")
def a26_corpus_counts(spark, sf_dir):
    return listings.corpus_counts({"precedents": table(spark, sf_dir, "orders").where("o_orderstatus = 'F'"), "registry": table(spark, sf_dir, "supplier").where("s_acctbal < 0")})


@query("u4_cited_documents", "WITH d AS (SELECT source AS tender_id, doc_id, n_chars > 300 AS complete FROM documents), c AS (SELECT tender_id, doc_id FROM d WHERE doc_id % 5 = 0 AND tender_id NOT IN ('src1', 'src2')) SELECT DISTINCT * FROM c UNION ALL SELECT tender_id, doc_id FROM d WHERE complete AND tender_id NOT IN (SELECT tender_id FROM c)")
def u4_cited_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("tender_id"), "doc_id", (F.col("n_chars") > 300).alias("complete"))
    return workflow.cited_documents(docs.where((F.col("doc_id") % 5 == 0) & ~F.col("tender_id").isin("src1", "src2")), docs)


@query("u5_provenance_graph", f"""{with_cte('flag_v', 'cell_v')}, k AS (SELECT tender_id, bidder_id, CAST(least(count(*), 5) AS INT) AS raised FROM flag_v GROUP BY 1, 2),
    w AS (SELECT c.evaluation_id, has_documents AS doc, len(figures) > 0 AS val, len(rules_figures) > 0 AS r, len(model_figures) > 0 AS m, dissent IS NOT NULL AS d, c.bidder_id % 3 <> 2 AS o, c.bidder_id % 4 = 0 AS n, coalesce(raised, 0) AS raised FROM cell_v c LEFT JOIN k ON k.tender_id = c.tender_id AND k.bidder_id = c.bidder_id),
    g AS (SELECT evaluation_id, unnest(list_concat(['criterion>bidder>evaluated against'], CASE WHEN doc THEN ['bidder>document>evidence from', CASE WHEN val THEN 'document>value>extracted' ELSE 'document>value>not found in' END] ELSE ['bidder>value>no evidence'] END,
      CASE WHEN r THEN ['value>rules>rules analysis', 'rules>verdict>contributes'] ELSE [] END, CASE WHEN m THEN ['value>model>model analysis', 'model>verdict>contributes'] ELSE [] END, CASE WHEN r OR m THEN [] ELSE ['value>verdict>determines'] END,
      CASE WHEN d THEN ['verdict>dissent>challenged by'] ELSE [] END, CASE WHEN o THEN ['verdict>decision>decided'] ELSE [] END, CASE WHEN n THEN [CASE WHEN o THEN 'decision' ELSE 'verdict' END || '>comments>annotated'] ELSE [] END,
      list_transform(range(1, raised + 1), lambda i: 'verdict>flag_' || i || '>flagged'))) AS item FROM w),
    p AS (SELECT evaluation_id, unnest(list_concat(['criterion', 'bidder', 'value', 'verdict'], CASE WHEN doc THEN ['document'] ELSE [] END, CASE WHEN r THEN ['rules'] ELSE [] END, CASE WHEN m THEN ['model'] ELSE [] END, CASE WHEN d THEN ['dissent'] ELSE [] END,
      CASE WHEN o THEN ['decision'] ELSE [] END, CASE WHEN n THEN ['comments'] ELSE [] END, list_transform(range(1, raised + 1), lambda i: 'flag_' || i))) AS item FROM w)
    SELECT 'edge' AS part, * FROM g UNION ALL SELECT 'node', * FROM p""")
def u5_provenance_graph(spark, sf_dir):
    cells = views.kept_cells(spark, sf_dir)
    decisions = cells.where("bidder_id % 3 <> 2").select("evaluation_id", F.lit("confirm").alias("decision"))
    comments = cells.where("bidder_id % 4 = 0").select("evaluation_id", F.lit(1).alias("notes"))
    nodes, edges = workflow.provenance(cells, views.flags(spark, sf_dir, cells), decisions, comments)
    edges = edges.select(F.lit("edge").alias("part"), "evaluation_id", F.concat_ws(">", "source", "target", "label").alias("item"))
    return edges.union(nodes.select(F.lit("node"), "evaluation_id", "node"))


@query("u6_token_sets", "WITH p AS (SELECT p_partkey AS k, list_distinct(string_split(p_name, ' ')) AS a, list_distinct(string_split(p_name || ' ' || p_type, ' ')) AS b FROM part) SELECT k, CAST(len(list_intersect(a, b)) AS INT) AS common, CAST(len(list_distinct(list_concat(a, b))) AS INT) AS total, CAST(len(list_filter(b, lambda x: NOT list_contains(a, x))) AS INT) AS added FROM p")
def u6_token_sets(spark, sf_dir):
    a, b = F.split("p_name", " "), F.split(F.concat_ws(" ", "p_name", "p_type"), " ")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), *listings.set_relations(a, b))


#: Bidders of a tender for the screen: customers of a nation; the same expressions serve Spark and DuckDB.
_K = "c_custkey"
_PAN = f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', CAST({_K} % 26 + 1 AS INT), 1) || 'AACB' || lpad(CAST({_K} % 10000 AS STRING), 4, '0') || CASE WHEN {_K} % 9 = 0 THEN '1' ELSE 'z' END"
_NAME = f"CASE {_K} % 3 WHEN 0 THEN 'Ganga' WHEN 1 THEN 'Yamuna' ELSE 'Kaveri' END || ' ' || CASE {_K} % 5 WHEN 0 THEN 'Steel' WHEN 1 THEN 'Cable' WHEN 2 THEN 'Paper' WHEN 3 THEN 'Glass' ELSE 'Timber' END || ' ' || CASE {_K} % 7 WHEN 0 THEN 'Works' WHEN 1 THEN 'Mills' WHEN 2 THEN 'Traders' WHEN 3 THEN 'Brothers' WHEN 4 THEN 'House' WHEN 5 THEN 'Agency' ELSE 'Union' END || ' and Sons'"
SCREEN_BIDDER = {
    "tender_id": "'n' || c_nationkey", "bidder_id": _K, "company_name": f"{_NAME} || CASE WHEN {_K} % 2 = 0 THEN ' Pvt Ltd' ELSE '' END", "pan": _PAN,
    "gstin": f"CASE WHEN {_K} % 12 = 5 THEN '06ZZZZZ0000Z1Z5' ELSE '06' || upper({_PAN}) || CASE WHEN {_K} % 8 = 0 THEN 'XX' ELSE '1Z5' END END", "address": f"' Plot ' || {_K} % 40 || ', Block ' || c_mktsegment",
    "instrument": f"CASE WHEN {_K} % 4 = 0 THEN 'BG' ELSE 'DD' END", "instrument_no": f"'DD-' || (100000 + {_K})", "signatory": f"'Shri ' || CASE {_K} % 17 WHEN 0 THEN 'Anil' WHEN 1 THEN 'Ravi' WHEN 2 THEN 'Meera' ELSE 'P' || {_K} END || ' ' || CASE {_K} % 11 WHEN 0 THEN 'Sharma' WHEN 1 THEN 'Rao' ELSE 'K' || {_K} END",
    "letter": f"{_NAME} || '. ' || {_NAME} || '. ' || {_NAME} || ' ' || {_NAME}",
}
SCREEN_VALUE = "CASE o_orderpriority WHEN '1-URGENT' THEN 100000 + CAST(floor(o_totalprice) AS BIGINT) % 997 WHEN '5-LOW' THEN CAST(floor(o_totalprice) AS BIGINT) % 300 * (CAST(floor(o_totalprice) AS BIGINT) % 300) ELSE CAST(floor(o_totalprice) AS BIGINT) END"
SCREEN_FIGURE = {"tender_id": "'n' || c_nationkey", "bidder_id": _K, "label": "o_orderpriority", "value": "CAST(floor(o_totalprice) AS BIGINT) * 1000"}
SCREEN_DOCUMENT = {"tender_id": "lang", "bidder_id": "source", "doc_id": "doc_id", "producer": "CASE WHEN doc_id % 3 = 0 THEN 'Writer-' || n_chars % 40 ELSE '' END", "creator": "'maker-' || n_chars % 30", "modified": "doc_id * 211"}


def _expressions(columns: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {c}" for c, e in columns.items())


SCREEN_TABLES = f"""bidders AS (SELECT {_expressions(SCREEN_BIDDER)} FROM customer), figures AS (SELECT {_expressions(SCREEN_FIGURE)} FROM orders JOIN customer ON o_custkey = c_custkey),
    bids AS (SELECT 'n' || c_nationkey AS tender_id, o_orderpriority AS criterion_id, c_custkey AS bidder_id, max({SCREEN_VALUE}) AS value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3),
    docs AS (SELECT {_expressions(SCREEN_DOCUMENT)}, sha256(text) AS sha256 FROM documents)"""


def screen_tables(spark, sf_dir):
    """The tables of the screen."""
    customers, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    exprs = lambda columns: [F.expr(e).alias(c) for c, e in columns.items()]
    both = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    bidders = customers.select(*exprs(SCREEN_BIDDER))
    bids = both.groupBy(F.expr("'n' || c_nationkey").alias("tender_id"), F.col("o_orderpriority").alias("criterion_id"), F.col("c_custkey").alias("bidder_id")).agg(F.max(F.expr(SCREEN_VALUE)).alias("value"))
    documents = table(spark, sf_dir, "documents").select(*exprs(SCREEN_DOCUMENT), F.sha2("text", 256).alias("sha256"))
    return {"bidders": bidders.withColumn("signatories", F.array("signatory")), "bids": bids, "figures": both.select(*exprs(SCREEN_FIGURE)), "documents": documents}


_IDS = "array_to_string(list_sort(list(DISTINCT CAST({} AS VARCHAR))), ',')"
_TWO = "array_to_string(list_sort([CAST({0}.bidder_id AS VARCHAR), CAST({1}.bidder_id AS VARCHAR)]), ',')"


@query("f2_detector_screen", rf"""WITH {SCREEN_TABLES}, company AS (SELECT tender_id, bidder_id, list_distinct(list_filter(string_split(trim(replace(lower(trim(company_name)), 'pvt ltd', '')), ' '), lambda w: w <> '' AND w NOT IN ('the', 'of', 'and', 'for', 'in'))) AS w, regexp_extract_all(lower(letter), '[a-z'']+') AS l FROM bidders),
    shingle AS (SELECT DISTINCT tender_id, bidder_id, unnest(list_transform(range(1, len(l) - 8), lambda i: array_to_string(l[i:i + 9], ' '))) AS h FROM company), drafts AS (SELECT *, CAST(regexp_extract(instrument_no, '(\d{{4,}})', 1) AS BIGINT) AS number FROM bidders WHERE instrument = 'DD'),
    seq AS (SELECT *, lead(bidder_id) OVER w AS other, lead(number) OVER w - number AS gap FROM drafts WINDOW w AS (PARTITION BY tender_id ORDER BY number, bidder_id)),
    digit AS (SELECT tender_id, CAST(substr(CAST(value AS VARCHAR), 1, 1) AS INT) AS d FROM figures WHERE value > 0), counted AS (SELECT tender_id, d, count(*) AS n FROM digit GROUP BY 1, 2), total AS (SELECT tender_id, CAST(sum(n) AS BIGINT) AS n FROM counted GROUP BY 1 HAVING sum(n) >= 15),
    chi AS (SELECT t.tender_id, t.n, round(sum(round((coalesce(c.n, 0) - t.n * log10(1 + 1 / x.d)) * (coalesce(c.n, 0) - t.n * log10(1 + 1 / x.d)) / (t.n * log10(1 + 1 / x.d)), 6)), 4) AS chi FROM total t CROSS JOIN (SELECT unnest(range(1, 10)) AS d) x LEFT JOIN counted c ON c.tender_id = t.tender_id AND c.d = x.d GROUP BY 1, 2),
    pool AS (SELECT tender_id, criterion_id, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS mean, CAST(sum(CAST(CAST(value AS DECIMAL(18,2)) * CAST(value AS DECIMAL(18,2)) AS DECIMAL(38,4))) AS DOUBLE) / count(*) AS q FROM bids WHERE value > 0 GROUP BY 1, 2 HAVING count(*) >= 3),
    moment AS (SELECT *, sqrt(greatest(q - mean * mean, 0)) AS sd FROM pool), z AS (SELECT b.tender_id, b.bidder_id, (b.value - mean) / sd AS z FROM bids b JOIN moment m ON m.tender_id = b.tender_id AND m.criterion_id = b.criterion_id WHERE b.value > 0 AND sd > 0),
    made AS (SELECT tender_id, bidder_id, lower(trim(CASE WHEN producer <> '' THEN producer ELSE creator END)) AS p FROM docs),
    f AS (SELECT tender_id, 'round_number' AS flag_type, 'low' AS severity, lower(label || '::' || value) AS k FROM figures WHERE value >= 1000000 AND value % 100000 = 0
      UNION ALL SELECT tender_id, 'pan_format_mismatch', 'medium', lower(trim(pan)) FROM bidders WHERE NOT regexp_matches(upper(pan), '{V.PAN}')
      UNION ALL SELECT tender_id, 'gstin_format_mismatch', CASE WHEN NOT regexp_matches(gstin, '{V.GSTIN}') THEN 'medium' ELSE 'high' END, lower(gstin) FROM bidders WHERE NOT regexp_matches(gstin, '{V.GSTIN}') OR substr(gstin, 3, 10) <> upper(pan)
      UNION ALL SELECT tender_id, 'address_collision', 'high', {_IDS.format('bidder_id')} FROM bidders GROUP BY tender_id, lower(trim(address)) HAVING count(DISTINCT bidder_id) >= 2
      UNION ALL SELECT x.tender_id, 'date_proximity', 'medium', x.doc_id || '-' || y.doc_id FROM docs x JOIN docs y ON x.tender_id = y.tender_id AND x.bidder_id <> y.bidder_id AND y.modified - x.modified BETWEEN 0 AND 600 AND (y.modified > x.modified OR x.doc_id < y.doc_id)
      UNION ALL SELECT tender_id, 'duplicate_document', 'high', sha256 FROM docs GROUP BY tender_id, sha256 HAVING count(DISTINCT bidder_id) >= 2
      UNION ALL SELECT tender_id, 'sequential_dd', CASE WHEN gap <= 2 THEN 'high' ELSE 'medium' END, array_to_string(list_sort([CAST(bidder_id AS VARCHAR), CAST(other AS VARCHAR)]), ',') FROM seq WHERE bidder_id <> other AND gap <= 5
      UNION ALL SELECT tender_id, 'common_signatory', 'high', trim(replace(lower(signatory), 'shri', '')) AS p FROM bidders GROUP BY tender_id, p HAVING count(DISTINCT bidder_id) >= 2 AND len(p) >= 5
      UNION ALL (SELECT x.tender_id, 'cover_letter_overlap', 'high', {_TWO.format('x', 'y')} FROM shingle x JOIN shingle y ON x.tender_id = y.tender_id AND x.h = y.h AND x.bidder_id < y.bidder_id GROUP BY x.tender_id, x.bidder_id, y.bidder_id HAVING count(*) >= 2)
      UNION ALL SELECT tender_id, 'benford_violation', CASE WHEN chi > 25 THEN 'high' ELSE 'medium' END, CAST(n AS VARCHAR) FROM chi WHERE chi > 15.507
      UNION ALL SELECT tender_id, 'zscore_outlier', CASE WHEN abs(z) > 2.5 THEN 'high' ELSE 'medium' END, bidder_id || '::' || CAST(CAST(round(z, 2) AS DECIMAL(12,2)) AS VARCHAR) FROM z WHERE abs(z) > 1.5
      UNION ALL SELECT tender_id, 'bid_spread_anomaly', CASE WHEN sd / mean < 0.05 THEN 'high' ELSE 'medium' END, CASE WHEN sd / mean < 0.05 THEN 'price_fixing' ELSE 'cover_bidding' END || '::' || n FROM moment WHERE sd / mean < 0.05 OR sd / mean > 0.8
      UNION ALL SELECT tender_id, 'metadata_cluster', 'medium', substr(p, 1, 40) FROM made WHERE len(p) > 3 GROUP BY tender_id, p HAVING count(DISTINCT bidder_id) >= 2
      UNION ALL SELECT x.tender_id, 'entity_resolution_match', 'high', {_TWO.format('x', 'y')} FROM company x JOIN company y ON x.tender_id = y.tender_id AND x.bidder_id < y.bidder_id AND len(list_intersect(x.w, y.w)) * 10 >= 6 * len(list_distinct(list_concat(x.w, y.w))))
    SELECT tender_id, flag_type, flag_type || '::' || k AS flag_key, CASE min(CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END) WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS severity FROM f GROUP BY 1, 2, 3""")
def f2_detector_screen(spark, sf_dir):
    """All fourteen detectors over one set of tables."""
    return detectors.screen(screen_tables(spark, sf_dir)).select("tender_id", "flag_type", "flag_key", "severity")


@query("u2_stored_flags", f"""WITH {SCREEN_TABLES}, f AS (SELECT 'n' || c_nationkey AS tender_id, 'round_number::' || lower(o_orderpriority || '::' || CAST(floor(o_totalprice) AS BIGINT) * 1000) AS flag_key, CAST(c_custkey AS VARCHAR) AS b, o_orderstatus AS s FROM orders JOIN customer ON o_custkey = c_custkey WHERE CAST(floor(o_totalprice) AS BIGINT) % 100 = 0 AND o_totalprice >= 1000)
    SELECT tender_id, flag_key, min(b) AS bidder_id FROM f GROUP BY 1, 2 HAVING NOT bool_or(s = 'F')""")
def u2_stored_flags(spark, sf_dir):
    """Flags whose keys an earlier screen has stored give no row: here one of the figures in closed orders."""
    tables = screen_tables(spark, sf_dir)
    closed = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    earlier = detectors.screen({"figures": closed.select(*(F.expr(e).alias(c) for c, e in SCREEN_FIGURE.items()))}, ["round_number"])
    found = detectors.screen(tables, ["round_number"], earlier.select("tender_id", "flag_key"))
    return found.select("tender_id", "flag_key", F.element_at("bidder_ids", 1).alias("bidder_id"))


@query("f4_user_extractor", "SELECT o_orderkey AS id, CAST(o_orderkey % 90 + 10 AS BIGINT) * 10000000 AS rupees FROM orders")
def f4_user_extractor(spark, sf_dir):
    @F.pandas_udf("array<struct<raw_value:double,unit:string,rupees:bigint>>")
    def crores(texts: pd.Series) -> pd.Series:
        found = texts.str.extract(r"Rs\. (\d+) crore")[0].astype("int64")
        return found.map(lambda n: [{"raw_value": float(n), "unit": "crore", "rupees": n * 10_000_000}])

    pages = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("Turnover Rs. "), (F.col("o_orderkey") % 90 + 10).cast("string"), F.lit(" crore")).alias("text"))
    return workflow.extracted_by(pages, "text", crores).select("id", F.element_at("figures", 1)["rupees"].alias("rupees"))
