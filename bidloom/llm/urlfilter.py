"""URL filter: a blocked Bloom filter of listed canonical URLs passes possible hits to an exact hash join.

A list has URLs in canonical form (host without user, port, www. and final dot; path without repeated slashes) and lists what lies
below them, too: a URL's keys are all pairs of a domain suffix of its canonical host and a start of its canonical path that ends
at a slash or at its end. Rules may begin anywhere in a path, so their keys are pairs of a suffix of the plain host and a path
start of a length that some rule has. Entries go into a Bloom filter of 512-bit blocks: a key's hash names its block, and eight
bits in it. The blocks are rows of a table, built by one grouped bit_or, and probed by an equi-join on the block, so the filter
may be of any size; Spark broadcasts it where it is small. Keys that pass are joined with the entries on their text, which
removes false positives, and of a URL's entries the one with the highest priority, then the longest, wins (the longer host where
two are as long; block before allow where an entry has both). All of it is DataFrame code.

A URL that is null or has no ``://`` has an empty host and path and no rule. Repeated rows get repeated results, repeated
entries count once, null entries are left out, and empty tables give no rows. Other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS, WORD_BITS = 16, 32
#: Bits for each listed entry.
BITS_PER_ENTRY = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What stands between the first :// and the next /, ? or #, with A-Z lower-cased; empty without ://."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ? or #; empty without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def canonical_host(url: Column) -> Column:
    """The host without user, port, www. and final dot."""
    return F.regexp_replace(F.regexp_replace(host_of(url), r"^.*@", ""), r"^(?:www\.)?(.*?)\.?(?::[0-9]*)?$", "$1")


def canonical_path(url: Column) -> Column:
    """The path with single slashes; a slash where it is empty."""
    path = F.regexp_replace(path_of(url), "/+", "/")
    return F.when(path == "", "/").otherwise(path)


def canonical(url: Column) -> Column:
    """The listed form of a URL: canonical host and path."""
    return F.concat(canonical_host(url), canonical_path(url))


def _blocks(entries: Column, hash_: Column) -> Column:
    return F.pmod(F.shiftright(hash_, 20), entries)


def _bits(key: Column) -> list[Column]:
    """Eight bits (0 to 511) of a key in its block, from a second hash."""
    second = F.xxhash64(key, F.lit("bits"))
    return [F.shiftrightunsigned(second, 7 * i).bitwiseAND(F.lit(511)) for i in range(8)]


def build(entries: DataFrame, key: str) -> tuple[DataFrame, int]:
    """The filter of a list's keys: (block, word, mask) rows, and how many blocks it is laid out for (one pass counts the list)."""
    n = entries.select(key).distinct().count()
    blocks = max(1, -(-n * BITS_PER_ENTRY // (WORDS * WORD_BITS)))
    marks = entries.select(_blocks(F.lit(blocks), F.xxhash64(key)).alias("block"), F.explode(F.array(*_bits(F.col(key)))).alias("bit"))
    mask = F.expr("shiftleft(1L, cast(bit % 32 as int))")
    return marks.groupBy("block", F.expr("cast(bit div 32 as int)").alias("word")).agg(F.bit_or(mask).alias("mask")), blocks


def table(words: DataFrame) -> DataFrame:
    """One row for each block: its sixteen words."""
    columns = [F.coalesce(F.max(F.when(F.col("word") == i, F.col("mask"))), F.lit(0).cast("long")) for i in range(WORDS)]
    return words.groupBy("block").agg(F.array(*columns).alias("words"))


def possible(keys: DataFrame, key: str, blocks: DataFrame, n_blocks: int) -> DataFrame:
    """The rows of ``keys`` that may be listed."""
    probed = keys.withColumn("_block", _blocks(F.lit(n_blocks), F.xxhash64(key))).join(blocks, F.col("_block") == F.col("block"))
    hit = F.lit(True)
    for bit in _bits(F.col(key)):
        word = F.element_at("words", (F.shiftright(bit, 5) + 1).cast("int"))
        hit = hit & (word.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 32).cast("int"))) != 0)
    return probed.where(hit).drop("_block", "block", "words")


def _suffixes(host: Column) -> Column:
    """A host and its parent domains."""
    parts = F.split(host, r"\.")
    return F.when(host == "", F.array(F.lit(""))).otherwise(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ".")))


def _at_slashes(path: Column) -> Column:
    """The starts of a path that end at a slash, or before one, and the path."""
    parts = F.split(path, "/")
    upto = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return F.array_distinct(F.concat(F.transform(F.slice(upto, F.lit(1), F.size(upto) - 1), lambda x: F.concat(x, F.lit("/"))), upto))


def matched(urls: DataFrame, rules: DataFrame, listed: DataFrame, url_column: str = "url", id_column: str = "page_id") -> DataFrame:
    """The best fitting entry of each URL: (id, host, path, rule, verdict, priority), the last three null where none fits.

    ``rules`` has (host, path, verdict), ``listed`` (url). Path lengths of the rules are collected; there are as many as distinct
    lengths, at most the longest URL's.
    """
    rules = rules.where("host is not null and path is not null").select(F.lit("rule").alias("kind"), "host", "path", "verdict", F.lit(1).alias("priority"))
    listed = listed.where("url is not null").select(F.lit("listed"), canonical_host(F.col("url")), canonical_path(F.col("url")), F.lit("block"), F.lit(0))
    entries = rules.union(listed).select("kind", F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict"), "priority", F.concat_ws("\n", "kind", "host", "path").alias("rule_key"))
    entries = entries.groupBy("rule_key", "kind", "rule_host", "rule_path").agg(F.max(F.struct("priority", "rule_verdict")).alias("top")).select("rule_key", "kind", "rule_host", "rule_path", "top.*")
    lengths = [r[0] for r in entries.where("kind = 'rule'").select(F.length("rule_path")).distinct().collect()]
    words, n_blocks = build(entries, "rule_key")
    url = F.col(url_column)
    parsed = urls.select(F.col(id_column).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"), canonical_host(url).alias("listed_host"), canonical_path(url).alias("listed_path"))
    starts = F.filter(F.array(*(F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in sorted(lengths))) if lengths else F.expr("cast(array() as array<string>)"), lambda x: x.isNotNull())
    pairs = lambda kind, host, starts: F.flatten(F.transform(_suffixes(host), lambda h: F.transform(starts, lambda p: F.concat_ws("\n", F.lit(kind), h, p))))
    keys = parsed.where("host <> ''").select("host", "path", "listed_host", "listed_path").distinct()
    keys = keys.select("host", "path", F.explode(F.concat(pairs("rule", F.col("host"), starts), pairs("listed", F.col("listed_host"), _at_slashes(F.col("listed_path"))))).alias("key"))
    hits = possible(keys, "key", table(words), n_blocks).join(entries, F.col("key") == F.col("rule_key"))
    best = hits.groupBy(F.col("host").alias("hit_host"), F.col("path").alias("hit_path")).agg(
        F.max(F.struct("priority", F.length(F.concat("rule_host", "rule_path")).alias("long"), F.length("rule_host").alias("host"), F.col("rule_verdict").alias("verdict"), F.concat("rule_host", "rule_path").alias("rule"))).alias("best")
    )
    found = parsed.join(best, (F.col("host") == F.col("hit_host")) & (F.col("path") == F.col("hit_path")), "left")
    return found.select(F.col("id").alias(id_column), "host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"), F.col("best.priority").alias("priority"))


def judged(urls: DataFrame, rules: DataFrame, listed: DataFrame, url_column: str = "url", id_column: str = "page_id") -> DataFrame:
    """(id, host, path, rule, verdict): the longest rule's verdict, else block where a listed URL fits, else allow.

    ``rules`` has (host, path, verdict) and ``listed`` (url); ``rule`` is null where the list decided.
    """
    found = matched(urls, rules, listed, url_column, id_column)
    return found.select(id_column, "host", "path", F.when(F.col("priority") == 1, F.col("rule")).alias("rule"), F.coalesce("verdict", F.lit("allow")).alias("verdict"))
