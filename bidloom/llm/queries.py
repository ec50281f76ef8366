"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidloom.llm import alignment, bpe, flac, langid, licenses, neardup, packing, pages, periodic, quality, secrets, toxicity, urlfilter
from bidloom.llm.common import crc_bucket, read


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(read(spark, sf_dir, "documents", "doc_id", "text"))


def op2_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents", "doc_id", "text"), n_words=3, part=85, whole=100)


def op3_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_text(read(spark, sf_dir, "pages", "page_id", "url", "html"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents", "doc_id", "text")
    held_out = crc_bucket("doc_id", 5) == 0
    labels = read(spark, sf_dir, "labels", "doc_id", "toxic").where(~held_out).withColumnRenamed("doc_id", "id")
    model = toxicity.train(documents.withColumnRenamed("doc_id", "id"), labels)
    found = toxicity.score(documents, model)
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


#: The rules of the query, and listed URLs (labels under the example domains; no table has a list).
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
LISTED_LABELS = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
LISTED_HOSTS = [f"{label}.example.{top}" for label in LISTED_LABELS for top in ("com", "net", "org")]


def op6_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    listed = spark.createDataFrame([(f"http://www.{host}:80",) for host in LISTED_HOSTS], "url string")
    return urlfilter.judged(read(spark, sf_dir, "pages", "page_id", "url"), rules, listed)


def op7_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.round_trip(read(spark, sf_dir, "documents", "doc_id", "text"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read(spark, sf_dir, "documents", "doc_id", "text", "lang"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents", "doc_id", "text", "lang")
    held_out = crc_bucket("doc_id", 4) == 2
    model = langid.train(documents.where(~held_out))
    return langid.predict(documents, model).select("doc_id", (crc_bucket("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents", "doc_id", "text")).withColumn("spans", F.to_json("spans"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.digest(read(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digest(read(spark, sf_dir, "documents", "doc_id", "text"), periodic.planted())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secrets": op1_secrets,
    "op2_neardup": op2_neardup,
    "op3_pages": op3_pages,
    "op4_bpe": op4_bpe,
    "op5_toxicity": op5_toxicity,
    "op6_urlfilter": op6_urlfilter,
    "op7_flac": op7_flac,
    "op8_packing": op8_packing,
    "op9_quality": op9_quality,
    "op10_langid": op10_langid,
    "op11_licenses": op11_licenses,
    "op12_alignment": op12_alignment,
    "op13_periodic": op13_periodic,
}

SQL: dict[str, str] = {
    "op6_urlfilter": f"""
    WITH rules(host, path, verdict, priority) AS (
      VALUES {", ".join(f"('{h}', '{p}', '{v}', 1)" for h, p, v in URL_RULES)}, {", ".join(f"('{h}', '/', 'block', 0)" for h in LISTED_HOSTS)}),
    u AS (
      SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
      FROM pages),
    p AS (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), '^(?:www\\.)?(.*?)\\.?(?::[0-9]*)?$', '\\1') AS plain FROM u),
    m AS (
      SELECT p.page_id, p.host, p.path, r.host || r.path AS rule, r.verdict, r.priority,
        row_number() OVER (PARTITION BY p.page_id ORDER BY r.priority DESC NULLS LAST, len(r.host || r.path) DESC) AS k
      FROM p LEFT JOIN rules r ON r.priority = 1 AND (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
        OR r.priority = 0 AND (p.plain = r.host OR ends_with(p.plain, '.' || r.host)))
    SELECT page_id, host, path, CASE WHEN priority = 1 THEN rule END AS rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
    """,
    "op2_neardup": """
    WITH RECURSIVE w AS (
      SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
      FROM documents),
    s AS (
      SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) END AS s
      FROM w),
    n AS (SELECT doc_id, len(s) AS n FROM s),
    u AS (SELECT doc_id, unnest(s) AS h FROM s),
    p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM u x JOIN u y ON x.h = y.h AND x.doc_id < y.doc_id GROUP BY 1, 2),
    e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
    d AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
    r AS (SELECT doc_id, doc_id AS to_id FROM n UNION SELECT r.doc_id, d.b FROM r JOIN d ON r.to_id = d.a)
    SELECT n.doc_id, CAST(any_value(n.n) AS BIGINT) AS n_shingles, min(r.to_id) AS component_id, n.doc_id = min(r.to_id) AS kept
    FROM n JOIN r USING (doc_id) GROUP BY n.doc_id
    """,
}
