"""Queries over bid pools."""

from __future__ import annotations

from pyspark.sql import functions as F

from bidloom.functions import values as V
from bidloom.operators import checks, pairs, pools
from bidloom.plans.registry import query
from bidloom.sources import views
from bidloom.sources.tables import table
from bidloom.sources.views import with_cte


@query(
    "w1_zscore_pool",
    f"""
    {with_cte("bid_v")}, m AS (
      SELECT *, count(*) OVER w AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) OVER w AS DOUBLE) AS s,
        CAST(sum(CAST(CAST(value AS DECIMAL(18,2)) * CAST(value AS DECIMAL(18,2)) AS DECIMAL(38,4))) OVER w AS DOUBLE) AS q
      FROM bid_v WHERE value > 0 WINDOW w AS (PARTITION BY tender_id)),
    z AS (SELECT tender_id, bidder_id, n, s / n AS mean, sqrt(greatest(q / n - (s / n) * (s / n), 0)) AS sd, value FROM m)
    SELECT tender_id, bidder_id, n AS pool_size, round((value - mean) / sd, 4) AS z,
      CASE WHEN value > mean THEN 'above' ELSE 'below' END AS side,
      CASE WHEN abs((value - mean) / sd) > 2.5 THEN 'high' ELSE 'medium' END AS severity
    FROM z WHERE n >= 3 AND sd > 0 AND abs((value - mean) / sd) > 1.5
    """,
)
def w1_zscore_pool(spark, sf_dir):
    found = pools.zscore_pool(views.bids(spark, sf_dir), ["tender_id"], "value")
    return found.select("tender_id", "bidder_id", "pool_size", F.round("z", 4).alias("z"), "side", "severity")


@query("a4_bid_spread", f"""{with_cte("bid_v")}, m AS (SELECT tender_id, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS s, CAST(sum(CAST(CAST(value AS DECIMAL(18,2)) * CAST(value AS DECIMAL(18,2)) AS DECIMAL(38,4))) AS DOUBLE) AS q FROM bid_v WHERE value > 0 GROUP BY 1),
    c AS (SELECT tender_id, n, sqrt(greatest(q / n - (s / n) * (s / n), 0)) / (s / n) AS cv FROM m WHERE n >= 3)
    SELECT tender_id, n AS n_bidders, round(cv, 4) AS cv, CASE WHEN cv < 0.05 THEN 'price_fixing' ELSE 'cover_bidding' END AS signal FROM c WHERE cv < 0.05 OR cv > 0.8""")
def a4_bid_spread(spark, sf_dir):
    return pools.bid_spread(views.bids(spark, sf_dir), ["tender_id"], "value").select("tender_id", "n_bidders", F.round("cv", 4).alias("cv"), "signal")


@query("a3_benford", """WITH d AS (SELECT o_orderpriority AS pool, CAST(substr(CAST(CAST(trunc(o_totalprice * 100) AS BIGINT) AS VARCHAR), 1, 1) AS INT) AS digit FROM orders WHERE o_totalprice > 0),
    c AS (SELECT pool, digit, count(*) AS n FROM d GROUP BY 1, 2), t AS (SELECT pool, sum(n) AS total FROM c GROUP BY 1 HAVING sum(n) >= 15),
    e AS (SELECT t.pool, t.total, x.digit, t.total * log10(1 + 1 / x.digit) AS expected, coalesce(c.n, 0) AS n FROM t CROSS JOIN (SELECT unnest(range(1, 10)) AS digit) x LEFT JOIN c ON c.pool = t.pool AND c.digit = x.digit)
    SELECT pool, CAST(total AS BIGINT) AS n_values, round(sum(round((n - expected) * (n - expected) / expected, 6)), 2) AS chi_square, arg_max(digit, abs(n - expected) / expected) AS worst_digit, 'high' AS severity FROM e GROUP BY 1, 2 HAVING sum((n - expected) * (n - expected) / expected) > 25""")
def a3_benford(spark, sf_dir):
    found = pools.benford(table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("pool"), "o_totalprice"), ["pool"], "o_totalprice")
    return found.withColumn("chi_square", F.round("chi_square", 2)).withColumn("worst_digit", F.col("worst_digit").cast("bigint"))


SUPPLIER = "s AS (SELECT n_regionkey AS tender_id, s_suppkey AS bidder_id, s_name AS company, n_name AS address, substr(s_name, 1, 16) AS signatory FROM supplier JOIN nation ON s_nationkey = n_nationkey)"


def _suppliers(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey", "n_name")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    return suppliers.join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("n_regionkey").alias("tender_id"), F.col("s_suppkey").alias("bidder_id"), F.col("s_name").alias("company"), F.col("n_name").alias("address"), F.substring("s_name", 1, 16).alias("signatory")
    )


@query("j9_address_collision", f"WITH {SUPPLIER} SELECT tender_id, lower(trim(address)) AS address, list(bidder_id ORDER BY bidder_id) AS bidder_ids FROM s GROUP BY 1, 2 HAVING count(DISTINCT bidder_id) >= 2")
def j9_address_collision(spark, sf_dir):
    return pools.shared_value(_suppliers(spark, sf_dir), ["tender_id"], F.lower(F.trim("address")), "bidder_id").withColumnRenamed("value", "address")


@query("a5_common_signatory", f"WITH {SUPPLIER} SELECT tender_id, trim(regexp_replace(regexp_replace(lower(signatory), '[^\\w\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS person, list(DISTINCT bidder_id ORDER BY bidder_id) AS bidder_ids FROM s GROUP BY 1, 2 HAVING count(DISTINCT bidder_id) >= 2 AND len(person) >= 5")
def a5_common_signatory(spark, sf_dir):
    signed = _suppliers(spark, sf_dir).withColumn("one", F.explode(F.array("signatory")))
    return pools.shared_value(signed, ["tender_id"], V.person_key(F.col("one")), "bidder_id").withColumnRenamed("value", "person")


@query("a6_producer_cluster", "WITH d AS (SELECT lang AS tender_id, source AS bidder_id, CASE WHEN doc_id % 3 = 0 THEN 'writer-' || (n_chars % 40) ELSE 'maker-' || (n_chars % 30) END AS producer FROM documents) SELECT tender_id, producer, list(DISTINCT bidder_id ORDER BY bidder_id) AS bidder_ids FROM d GROUP BY 1, 2 HAVING count(DISTINCT bidder_id) >= 2")
def a6_producer_cluster(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("lang").alias("tender_id"), F.col("source").alias("bidder_id"), "doc_id", "n_chars")
    producer, creator = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("writer-"), (F.col("n_chars") % 40).cast("string"))), F.concat(F.lit("maker-"), (F.col("n_chars") % 30).cast("string"))
    value = F.coalesce(F.nullif(producer, F.lit("")), creator)
    return pools.shared_value(docs, ["tender_id"], F.when(F.length(value) > 3, value), "bidder_id").withColumnRenamed("value", "producer")


@query("j10_duplicate_documents", "SELECT lang AS tender_id, sha256(text) AS content, list(DISTINCT source ORDER BY source) AS bidder_ids FROM documents GROUP BY 1, 2 HAVING count(DISTINCT source) >= 2")
def j10_duplicate_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("lang").alias("tender_id"), F.col("source").alias("bidder_id"), F.sha2("text", 256).alias("content"))
    return pools.shared_value(docs, ["tender_id"], F.col("content"), "bidder_id").withColumnRenamed("value", "content")


@query("j11_upload_proximity", """WITH u AS (SELECT event_id, event_type AS tender_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS at FROM events)
    SELECT x.tender_id, x.event_id AS a, y.event_id AS b, y.at - x.at AS gap FROM u x JOIN u y ON x.tender_id = y.tender_id AND x.user_id <> y.user_id AND y.at - x.at BETWEEN 0 AND 600 AND (y.at > x.at OR x.event_id < y.event_id)""")
def j11_upload_proximity(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("tender_id"), "user_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"))
    return pairs.range_pairs(events, ["tender_id"], "at", 600, "event_id", "user_id")


@query("j12_lookalike_companies", """WITH b AS (SELECT p_brand AS tender_id, p_partkey AS bidder_id, list_distinct(list_filter(string_split(lower(p_name), ' '), lambda x: x <> '' AND x NOT IN ('the', 'of', 'and', 'for', 'in'))) AS w FROM part)
    SELECT x.tender_id, x.bidder_id AS a, y.bidder_id AS b, CAST(len(list_intersect(x.w, y.w)) AS INT) AS common, round(len(list_intersect(x.w, y.w)) / len(list_distinct(list_concat(x.w, y.w))), 4) AS score
    FROM b x JOIN b y ON x.tender_id = y.tender_id AND x.bidder_id < y.bidder_id AND len(list_intersect(x.w, y.w)) * 10 >= 6 * len(list_distinct(list_concat(x.w, y.w)))""")
def j12_lookalike_companies(spark, sf_dir):
    return pairs.token_pairs(_named(spark, sf_dir), ["tender_id"], "bidder_id", "words", 6, 10).withColumn("score", F.round("score", 4))


def _named(spark, sf_dir):
    words = F.filter(F.split(V.company_key(F.col("p_name")), " "), lambda w: (w != "") & ~w.isin("the", "of", "and", "for", "in"))
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("tender_id"), F.col("p_partkey").alias("bidder_id"), words.alias("words"))


@query("j12_lookalike_classes", """WITH b AS (SELECT p_brand AS tender_id, p_partkey AS bidder_id, list_sort(list_distinct(list_filter(string_split(lower(p_name), ' '), lambda x: x <> '' AND x NOT IN ('the', 'of', 'and', 'for', 'in')))) AS w FROM part), c AS (SELECT tender_id, w, min(bidder_id) AS class FROM b GROUP BY 1, 2)
    SELECT 'member' AS part, b.tender_id, class AS a, bidder_id AS b, NULL::DOUBLE AS score FROM b JOIN c ON c.tender_id = b.tender_id AND c.w = b.w
    UNION ALL SELECT 'alike', x.tender_id, x.class, y.class, round(len(list_intersect(x.w, y.w)) / len(list_distinct(list_concat(x.w, y.w))), 4) FROM c x JOIN c y ON x.tender_id = y.tender_id AND x.class < y.class AND len(list_intersect(x.w, y.w)) * 10 >= 6 * len(list_distinct(list_concat(x.w, y.w)))""")
def j12_lookalike_classes(spark, sf_dir):
    """Who is in each class of equal names, and which classes are alike: no link between different names is lost."""
    classes = pairs.token_classes(_named(spark, sf_dir), ["tender_id"], "bidder_id", "words")
    alike = pairs.class_pairs(classes, ["tender_id"], 6, 10)
    members = classes.select(F.lit("member").alias("part"), "tender_id", F.col("class").alias("a"), F.col("id").alias("b"), F.lit(None).cast("double").alias("score"))
    return members.union(alike.select(F.lit("alike"), "tender_id", "a", "b", F.round("score", 4)))


@query("j13_copied_prose", r"""WITH w AS (SELECT lang AS tender_id, source AS bidder, regexp_extract_all(lower(text), '[a-z'']+') AS w FROM documents),
    s AS (SELECT DISTINCT tender_id, bidder, unnest(list_transform(range(1, len(w) - 8), lambda i: array_to_string(w[i:i + 9], ' '))) AS h FROM w WHERE len(w) >= 10)
    SELECT x.tender_id, x.bidder AS a, y.bidder AS b, count(*) AS common, min(x.h) AS sample FROM s x JOIN s y ON x.tender_id = y.tender_id AND x.h = y.h AND x.bidder < y.bidder GROUP BY 1, 2, 3 HAVING count(*) >= 2""")
def j13_copied_prose(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("lang").alias("tender_id"), F.col("source").alias("bidder"), "text")
    return pairs.copied_prose(docs, "tender_id", "bidder", "text")


@query("w2_sequential_instruments", """WITH i AS (SELECT CAST(o_orderdate AS DATE) AS tender_id, o_custkey AS a, o_orderkey AS number FROM orders),
    n AS (SELECT *, lead(a) OVER w AS b, lead(number) OVER w AS nx FROM i WINDOW w AS (PARTITION BY tender_id ORDER BY number, a))
    SELECT tender_id, a, b, nx - number AS gap, CASE WHEN nx - number <= 2 THEN 'high' ELSE 'medium' END AS severity FROM n WHERE a <> b AND nx - number <= 5""")
def w2_sequential_instruments(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("tender_id"), "o_custkey", F.concat(F.lit("DD-"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0")).alias("number"))
    return pools.sequential_instruments(orders, ["tender_id"], "number", "o_custkey")


CLAIMS = """claim_v AS (SELECT c_custkey AS bidder_id, substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', CAST(c_custkey % 26 + 1 AS INT), 1) || 'AA' || substr('CCCFTP', CAST(c_custkey % 6 + 1 AS INT), 1) || 'B' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') || CASE WHEN c_custkey % 9 = 0 THEN '1' ELSE 'Z' END AS pan,
    CASE c_custkey % 3 WHEN 0 THEN 'Private Limited' WHEN 1 THEN 'LLP' ELSE 'Trust' END AS constitution, c_name AS company_name, DATE '2020-01-01' + CAST(c_custkey % 2000 AS INT) AS valid_until, c_custkey AS k FROM customer),
  claims AS (SELECT *, '06' || pan || CASE WHEN k % 8 = 0 THEN 'XX' ELSE '1Z5' END AS gstin, CASE WHEN k % 5 = 0 THEN '' ELSE '26' || lpad(CAST(k AS VARCHAR), CASE WHEN k % 4 = 0 THEN 6 ELSE 10 END, '0') || 'BJ' END AS udin,
    CASE WHEN k % 7 = 0 THEN NULL ELSE lpad(CAST(k AS VARCHAR), 6, '0') || CASE WHEN k % 6 = 0 THEN '9' ELSE 'N' END END AS frn, CASE WHEN k % 10 = 0 THEN '' ELSE 'UDYAM-HR-05-' || lpad(CAST(k AS VARCHAR), CASE WHEN k % 3 = 0 THEN 5 ELSE 7 END, '0') END AS udyam,
    CASE WHEN k % 11 = 0 THEN NULL ELSE CASE WHEN k % 2 = 0 THEN 'U' ELSE 'X' END || '12345HR' || '2001' || 'PTC' || lpad(CAST(k AS VARCHAR), 6, '0') END AS cin FROM claim_v)"""


def claims_of(spark, sf_dir):
    k = F.col("c_custkey")
    pad = lambda n: F.lpad(k.cast("string"), n, "0")
    pan = F.concat(F.expr("substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', cast(c_custkey % 26 + 1 as int), 1)"), F.lit("AA"), F.expr("substr('CCCFTP', cast(c_custkey % 6 + 1 as int), 1)"), F.lit("B"), F.lpad((k % 10000).cast("string"), 4, "0"), F.when(k % 9 == 0, "1").otherwise("Z"))
    return table(spark, sf_dir, "customer").select(
        k.alias("bidder_id"), pan.alias("pan"), F.when(k % 3 == 0, "Private Limited").when(k % 3 == 1, "LLP").otherwise("Trust").alias("constitution"), F.col("c_name").alias("company_name"),
        F.date_add(F.lit("2020-01-01").cast("date"), (k % 2000).cast("int")).alias("valid_until"), F.lit("2022-01-01").cast("date").alias("bid_date"),
        F.concat(F.lit("06"), pan, F.when(k % 8 == 0, "XX").otherwise("1Z5")).alias("gstin"),
        F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("26"), F.when(k % 4 == 0, pad(6)).otherwise(pad(10)), F.lit("BJ"))).alias("udin"),
        F.when(k % 7 != 0, F.concat(pad(6), F.when(k % 6 == 0, "9").otherwise("N"))).alias("frn"),
        F.when(k % 10 == 0, "").otherwise(F.concat(F.lit("UDYAM-HR-05-"), F.when(k % 3 == 0, pad(5)).otherwise(pad(7)))).alias("udyam"),
        F.when(k % 11 != 0, F.concat(F.when(k % 2 == 0, "U").otherwise("X"), F.lit("12345HR2001PTC"), pad(6))).alias("cin"),
    )


@query("p7_p8_identifier_formats", f"""WITH {CLAIMS} SELECT bidder_id, regexp_matches(pan, '{V.PAN}') AS pan_ok, regexp_matches(gstin, '{V.GSTIN}') AS gstin_ok, substr(gstin, 3, 10) = pan AS pan_in_gstin,
    CASE WHEN NOT regexp_matches(gstin, '{V.GSTIN}') THEN 'medium' WHEN substr(gstin, 3, 10) <> pan THEN 'high' END AS severity FROM claims""")
def p7_p8_identifier_formats(spark, sf_dir):
    same = F.substring("gstin", 3, 10) == F.col("pan")
    return claims_of(spark, sf_dir).select("bidder_id", V.matches(F.col("pan"), V.PAN).alias("pan_ok"), V.matches(F.col("gstin"), V.GSTIN).alias("gstin_ok"), same.alias("pan_in_gstin"), F.when(~V.matches(F.col("gstin"), V.GSTIN), "medium").when(~same, "high").alias("severity"))


REGISTRY = f"r AS (SELECT bidder_id AS entry_id, CASE WHEN bidder_id % 2 = 0 THEN pan ELSE '' END AS pan, CASE WHEN bidder_id % 3 = 0 THEN gstin ELSE '' END AS gstin, upper(company_name) || ' Pvt Ltd' AS company_name, CASE WHEN bidder_id % 20 = 0 THEN NULL ELSE DATE '2023-01-01' + CAST(bidder_id % 900 AS INT) END AS debarred_until FROM claims WHERE bidder_id % 10 = 0)"


def _registry(spark, sf_dir):
    k = F.col("bidder_id")
    return claims_of(spark, sf_dir).where(k % 10 == 0).select(
        k.alias("entry_id"), F.when(k % 2 == 0, F.col("pan")).otherwise("").alias("pan"), F.when(k % 3 == 0, F.col("gstin")).otherwise("").alias("gstin"), F.concat(F.upper("company_name"), F.lit(" Pvt Ltd")).alias("company_name"),
        F.when(k % 20 != 0, F.date_add(F.lit("2023-01-01").cast("date"), (k % 900).cast("int"))).alias("debarred_until"),
    )


AS_OF = "2024-01-01"
DEBARRED = f"""live AS (SELECT * FROM r WHERE debarred_until IS NULL OR debarred_until >= DATE '{AS_OF}'),
  h AS (SELECT c.bidder_id, l.entry_id, 0 AS rank FROM claims c JOIN live l ON l.pan <> '' AND l.pan = c.pan UNION ALL SELECT c.bidder_id, l.entry_id, 0 FROM claims c JOIN live l ON l.gstin <> '' AND l.gstin = c.gstin
    UNION ALL SELECT c.bidder_id, l.entry_id, 1 FROM claims c JOIN live l ON regexp_replace(replace(lower(l.company_name), 'pvt ltd', ''), '[^a-z0-9]+', '', 'g') = regexp_replace(lower(c.company_name), '[^a-z0-9]+', '', 'g')),
  best AS (SELECT bidder_id, min(rank) AS rank, count(DISTINCT entry_id) AS hits FROM h GROUP BY 1)"""


@query("j8_debarment", f"""WITH {CLAIMS}, {REGISTRY}, {DEBARRED} SELECT c.bidder_id, coalesce(hits, 0) AS hits, CASE rank WHEN 0 THEN 'confirmed_debarred' WHEN 1 THEN 'flagged' ELSE 'clear' END AS state FROM claims c LEFT JOIN best b ON b.bidder_id = c.bidder_id""")
def j8_debarment(spark, sf_dir):
    return checks.debarment(claims_of(spark, sf_dir), _registry(spark, sf_dir), F.lit(AS_OF).cast("date")).select("bidder_id", "hits", "state")


@query("v1_v8_verifiers", f"""WITH {CLAIMS}, {REGISTRY}, {DEBARRED},
    x AS (SELECT c.*, b.rank FROM claims c LEFT JOIN best b ON b.bidder_id = c.bidder_id),
    p AS (SELECT *, regexp_matches(pan, '{V.PAN}') AS pan_ok, CASE constitution WHEN 'Private Limited' THEN 'C' WHEN 'LLP' THEN 'F' ELSE 'T' END AS want FROM x)
    SELECT bidder_id, 'pan' AS verifier, CASE WHEN NOT pan_ok OR substr(pan, 4, 1) <> want THEN 'mismatch' ELSE 'verified' END AS status, CASE WHEN NOT pan_ok THEN 0.95 WHEN substr(pan, 4, 1) <> want THEN 0.9 ELSE 0.93 END::DOUBLE AS confidence FROM p
    UNION ALL SELECT bidder_id, 'gst', CASE WHEN NOT regexp_matches(gstin, '{V.GSTIN}') OR valid_until < DATE '2022-01-01' THEN 'mismatch' ELSE 'verified' END, CASE WHEN NOT regexp_matches(gstin, '{V.GSTIN}') THEN 0.95 WHEN valid_until < DATE '2022-01-01' THEN 0.92 WHEN valid_until < DATE '{AS_OF}' THEN 0.85 ELSE 0.95 END FROM p
    UNION ALL SELECT bidder_id, 'udin', CASE WHEN udin = '' THEN 'not_found' WHEN len(udin) < 12 THEN 'mismatch' ELSE 'verified' END, CASE WHEN udin = '' THEN 0.7 WHEN len(udin) < 12 THEN 0.9 ELSE 0.78 END FROM p
    UNION ALL SELECT bidder_id, 'frn', CASE WHEN frn IS NULL THEN 'not_found' WHEN NOT regexp_matches(frn, '{V.FRN}') THEN 'mismatch' ELSE 'verified' END, CASE WHEN frn IS NULL THEN 0.7 WHEN NOT regexp_matches(frn, '{V.FRN}') THEN 0.9 ELSE 0.8 END FROM p
    UNION ALL SELECT bidder_id, 'udyam', CASE WHEN udyam = '' THEN 'not_found' WHEN NOT regexp_matches(udyam, '{V.UDYAM}') THEN 'mismatch' ELSE 'verified' END, CASE WHEN udyam = '' THEN 0.7 WHEN NOT regexp_matches(udyam, '{V.UDYAM}') THEN 0.92 ELSE 0.78 END FROM p
    UNION ALL SELECT bidder_id, 'mca', CASE WHEN cin IS NULL THEN 'not_found' WHEN NOT regexp_matches(cin, '{V.CIN}') THEN 'mismatch' ELSE 'verified' END, CASE WHEN cin IS NULL THEN 0.6 WHEN NOT regexp_matches(cin, '{V.CIN}') THEN 0.9 ELSE 0.82 END FROM p
    UNION ALL SELECT bidder_id, 'debarment', CASE WHEN rank = 0 THEN 'mismatch' ELSE 'verified' END, CASE WHEN rank = 0 THEN 0.92 ELSE 0.95 END FROM p""")
def v1_v8_verifiers(spark, sf_dir):
    claims = claims_of(spark, sf_dir)
    checked = claims.join(checks.debarment(claims, _registry(spark, sf_dir), F.lit(AS_OF).cast("date")).select("bidder_id", "debarment_confidence"), "bidder_id")
    return checks.verify_all(checked, F.lit(AS_OF).cast("date")).select("bidder_id", "verifier", "status", "confidence")


@query("v4_v6_registry_details", f"""WITH {CLAIMS} SELECT bidder_id, CASE WHEN regexp_matches(frn, '{V.FRN}') THEN CASE substr(frn, 7, 1) WHEN 'N' THEN 'Northern' WHEN 'S' THEN 'Southern' WHEN 'E' THEN 'Eastern' WHEN 'W' THEN 'Western' WHEN 'C' THEN 'Central' ELSE 'Unknown' END END AS region,
    CASE WHEN regexp_matches(cin, '{V.CIN}') THEN CASE WHEN cin[1] = 'L' THEN 'Listed' ELSE 'Unlisted' END END AS listing, CASE WHEN regexp_matches(cin, '{V.CIN}') THEN cin[7:8] END AS state, CASE WHEN regexp_matches(cin, '{V.CIN}') THEN cin[9:12] END AS year
    FROM (SELECT bidder_id, CASE WHEN k % 6 = 0 THEN frn ELSE left(frn, 6) || substr('NSEWCQ', CAST(k % 6 + 1 AS INT), 1) END AS frn, cin FROM claims)""")
def v4_v6_registry_details(spark, sf_dir):
    letter = F.expr("substr('NSEWCQ', cast(bidder_id % 6 + 1 as int), 1)")
    claims = claims_of(spark, sf_dir).withColumn("frn", F.when(F.col("bidder_id") % 6 == 0, F.col("frn")).otherwise(F.concat(F.substring("frn", 1, 6), letter)))
    read = claims.select("bidder_id", checks.verify_frn().alias("frn"), checks.verify_cin().alias("cin"))
    return read.select("bidder_id", F.col("frn.details")["region"].alias("region"), *(F.col("cin.details")[k].alias(k) for k in ("listing", "state", "year")))


@query("j5_verifier_matrix", f"""WITH {CLAIMS}, {REGISTRY}, {DEBARRED} SELECT c.bidder_id, v.verifier, CASE WHEN v.verifier = 'debarment' THEN CASE WHEN b.rank = 0 THEN 'mismatch' ELSE 'verified' END END AS status FROM claims c CROSS JOIN (VALUES ('pan'), ('gst'), ('udin'), ('frn'), ('udyam'), ('mca'), ('debarment')) v(verifier) LEFT JOIN best b ON b.bidder_id = c.bidder_id""")
def j5_verifier_matrix(spark, sf_dir):
    claims = claims_of(spark, sf_dir)
    checked = claims.join(checks.debarment(claims, _registry(spark, sf_dir), F.lit(AS_OF).cast("date")).select("bidder_id", "debarment_confidence"), "bidder_id")
    results = checks.verify_all(checked, F.lit(AS_OF).cast("date"), {"debarment": checks.VERIFIERS["debarment"]}).select(F.col("bidder_id").alias("b"), F.col("verifier").alias("v"), "status")
    wide = claims.select("bidder_id", F.explode(F.array(*map(F.lit, checks.VERIFIERS))).alias("verifier"))
    return wide.join(results, (F.col("bidder_id") == F.col("b")) & (F.col("verifier") == F.col("v")), "left").select("bidder_id", "verifier", "status")


@query("p9_round_numbers", """SELECT l_orderkey, l_linenumber, CAST(trunc(l_extendedprice) AS BIGINT) * 1000 AS amount, CASE WHEN trunc(l_extendedprice) >= 1000 AND CAST(trunc(l_extendedprice) AS BIGINT) % 1000 = 0 THEN 'ten_lakh' ELSE 'lakh' END AS tier
    FROM lineitem WHERE trunc(l_extendedprice) >= 1000 AND CAST(trunc(l_extendedprice) AS BIGINT) % 100 = 0""")
def p9_round_numbers(spark, sf_dir):
    amount = F.col("l_extendedprice").cast("bigint") * 1000
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", amount.alias("amount"), V.round_tier(amount).alias("tier")).where("tier is not null")


@query("p4_p6_name_folds", r"""SELECT s_suppkey, trim(regexp_replace(regexp_replace(lower(s_name), '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g')) AS company, regexp_replace(lower(s_name), '[^a-z0-9]+', '', 'g') AS registry FROM supplier""")
def p4_p6_name_folds(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", V.company_key(F.col("s_name")).alias("company"), V.registry_key(F.col("s_name")).alias("registry"))


@query("p10_first_digit", "SELECT o_orderkey, CAST(substr(CAST(CAST(trunc(o_totalprice * 100) AS BIGINT) AS VARCHAR), 1, 1) AS INT) AS digit FROM orders")
def p10_first_digit(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", V.first_digit(F.col("o_totalprice")).alias("digit"))
