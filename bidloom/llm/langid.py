"""Language identification by prediction by partial matching.

For each language, a byte context tree of order 3: how often each byte followed each context of up to three bytes, summed
over all training rows by Spark. Escapes follow method C: a context seen n times with u different successors gives a
successor seen c times c / (n + u), and u / (n + u) to go on to the next shorter context; below order 0, all bytes are equal.
The statistics are then frozen, and a text's code length in bits under each language is exact for them. The shortest code
names the language; its score is the probability that the code lengths give it against the other languages.

Four-byte strings stand for nodes with their successors; all nodes of all languages count. Where distinct strings times
languages are at most MOST_CELLS, the model goes to every task; beyond, it stays a table, and the distinct strings of the texts
are priced by joins with it. Both give the same code lengths. Texts start after three newlines.

Null texts, and texts without a letter, get ``und`` and score 0. Repeated rows get repeated results; without training rows all
texts are ``und``. An empty table gives no rows. Only the id, text and language columns are read.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidloom.llm.common import buffer, lean, materialise, slices

#: Most prices (distinct strings times languages, 8 bytes each, and half as much again for shorter ones) that go to every task.
MOST_CELLS = 8_000_000
#: Digits behind the point of a price, and the type of exact sums, where the model is a table.
PLACES, EXACT = 9, "decimal(38,9)"
#: A task's counts are written out when it has this many nodes.
TABLE_NODES = 1_000_000
START = np.frombuffer(b"\n\n\n", np.uint8)
LETTER = r"\p{L}"


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The four bytes ending at each byte, as a number with the last byte lowest, for texts after START; and len + 1 offsets."""
    padded = np.insert(data, np.repeat(offsets[:-1], 3), np.tile(START, len(offsets) - 1)) if len(offsets) > 1 else data
    at = offsets + 3 * np.arange(len(offsets))
    wide = padded.astype(np.uint32)
    gram = np.zeros(len(padded), np.uint32)
    if len(padded) > 3:
        gram[3:] = wide[:-3] << 24 | wide[1:-2] << 16 | wide[2:-1] << 8 | wide[3:]
    real = np.ones(len(padded), bool)
    begin = at[:-1]
    for i in range(3):
        real[begin + i] = False
    return gram[real], offsets


def gram_counts(df: DataFrame, text_column: str, lang_column: str) -> DataFrame:
    """(lang, gram, n): partial counts of four-byte strings over all rows with a text and a language."""
    names = ["lang", "gram", "n"]

    def out(lang, found):
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found.index.to_numpy().astype(np.int64)), pa.array(found.to_numpy().astype(np.int64))], names=names)

    def run(batches):
        tables: dict[str, pd.Series] = {}
        for batch in batches:
            for part in slices(batch, 0):
                langs = part.column(1)
                for lang in pc.unique(langs).to_pylist():
                    if lang is None:
                        continue
                    found = pd.Series(_grams(*buffer(part.column(0).filter(pc.equal(langs, lang))))[0]).value_counts(sort=False)
                    tables[lang] = tables[lang].add(found, fill_value=0) if lang in tables else found
                    if len(tables[lang]) > TABLE_NODES:
                        yield out(lang, tables.pop(lang))
        for lang, found in tables.items():
            yield out(lang, found)

    return df.select(F.col(text_column).alias("text"), F.col(lang_column).alias("lang")).mapInArrow(lean(run), "lang string, gram long, n long")


class Order(NamedTuple):
    """Contexts of one length with their successors: sorted keys, and for each its code length in bits under each language."""

    keys: np.ndarray
    bits: np.ndarray
    contexts: np.ndarray
    escape: np.ndarray


class Model(NamedTuple):
    """Frozen statistics: languages, and orders 3, 2, 1 and 0."""

    languages: list[str]
    orders: list[Order]


def freeze(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """A model from each language's (grams, counts)."""
    languages = sorted(counts)
    orders: list[Order] = []
    below: Order | None = None
    for order in range(4):
        mask = np.uint32((1 << 8 * (order + 1)) - 1)
        own = []
        for lang in languages:
            gram, n = counts[lang]
            key, to = np.unique(gram.astype(np.uint32) & mask, return_inverse=True)
            own.append((key, np.bincount(to, weights=n)))
        keys = np.unique(np.concatenate([k for k, _ in own])) if own else np.zeros(0, np.uint32)
        contexts = np.unique(keys >> np.uint32(8))
        bits, escape = np.zeros((len(keys), len(languages)), np.float64), np.zeros((len(contexts), len(languages)), np.float64)
        shorter = _bits(below, orders[::-1], keys & (mask >> np.uint32(8))) if order else np.full((len(keys), len(languages)), 8.0)
        for i, (key, n) in enumerate(own):
            where, to = np.unique(key >> np.uint32(8), return_inverse=True)
            total, kinds = np.bincount(to, weights=n), np.bincount(to)
            at = np.searchsorted(contexts, where)
            escape[at, i] = -np.log2(kinds / (total + kinds))
            bits[:, i] = escape[np.searchsorted(contexts, keys >> np.uint32(8)), i] + shorter[:, i]
            bits[np.searchsorted(keys, key), i] = -np.log2(n / (total + kinds)[to])
        below = Order(keys, bits, contexts, escape)
        orders.append(below)
    return Model(languages, orders[::-1])


def _bits(first: Order | None, orders: list[Order], keys: np.ndarray) -> np.ndarray:
    """Code lengths of keys under each language, from the given order down."""
    order = orders[0]
    at = pd.Index(order.keys).get_indexer(keys)
    out = order.bits[at]
    missing = np.flatnonzero(at < 0)
    if len(missing):
        key = keys[missing]
        if len(orders) == 1:
            out[missing] = order.escape[0] + 8 if len(order.escape) else 8
        else:
            context = pd.Index(order.contexts).get_indexer(key >> np.uint32(8))
            cost = np.where((context >= 0)[:, None], order.escape[context], 0) if len(order.escape) else 0
            mask = np.uint32((1 << 8 * (len(orders) - 1)) - 1)
            out[missing] = cost + _bits(None, orders[1:], key & mask)
    return out


class Table(NamedTuple):
    """Statistics too large for a task: languages, and (lang, gram, n) in Spark."""

    languages: list[str]
    counts: DataFrame


def train(df: DataFrame, text_column: str = "text", lang_column: str = "lang", most_cells: int = MOST_CELLS) -> Model | Table:
    """A model from all rows; counts come to the driver only where all prices are at most ``most_cells``."""
    counts = gram_counts(df, text_column, lang_column).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = materialise(counts, "grams")
    languages = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    if counts.select("gram").distinct().count() * len(languages) > most_cells:
        return Table(languages, counts)
    every = counts.toArrow()
    found = {}
    for lang in languages:
        own = every.filter(pc.equal(every.column("lang"), lang))
        found[lang] = own.column("gram").to_numpy(), own.column("n").to_numpy()
    return freeze(found)


def _prices(table: Table, wanted: DataFrame) -> DataFrame:
    """(gram, lang, bits) of the wanted grams under each language, by joins with the statistics of orders 0 to 3."""
    out = wanted.select("gram", F.explode(F.array(*map(F.lit, table.languages))).alias("lang"), F.lit(8.0).alias("bits"))
    for order in range(4):
        mask = (1 << 8 * (order + 1)) - 1
        nodes = table.counts.groupBy(F.col("lang").alias("node_lang"), F.col("gram").bitwiseAND(mask).alias("node")).agg(F.sum("n").alias("n"))
        contexts = nodes.groupBy(F.col("node_lang").alias("context_lang"), F.shiftright("node", 8).alias("context")).agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
        key = F.col("gram").bitwiseAND(mask)
        out = out.join(nodes, (F.col("lang") == F.col("node_lang")) & (key == F.col("node")), "left")
        out = out.join(contexts, (F.col("lang") == F.col("context_lang")) & (F.shiftright(key, 8) == F.col("context")), "left")
        both = F.col("total") + F.col("kinds")
        bits = F.when(F.col("n").isNotNull(), -F.log2(F.col("n") / both)).when(F.col("total").isNotNull(), F.col("bits") - F.log2(F.col("kinds") / both)).otherwise(F.col("bits"))
        out = out.select("gram", "lang", bits.alias("bits"))
    return out


def _decided(df: DataFrame, table: Table, text_column: str) -> tuple[DataFrame, list[str]]:
    """The rows of ``df`` with language, score and bits, by joins; and the names of those three, which no column of ``df`` has."""
    longest = max(map(len, df.columns))
    row, best_row, least, best_of, size, share_of, lang_, score_, bits_ = ("_" * longest + x for x in ("row", "best_row", "least", "best", "size", "share", "lang", "score", "bits"))
    rows = materialise(df.withColumn(row, F.monotonically_increasing_id()), "rows")

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1):
                gram, offsets = _grams(*buffer(part.column(1)))
                row = np.repeat(np.arange(part.num_rows), np.diff(offsets)).astype(np.uint64)
                key, n = np.unique(row << np.uint64(32) | gram, return_counts=True)
                own = part.column(0).to_numpy()[(key >> np.uint64(32)).astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array((key & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(n.astype(np.int64))], names=["row", "gram", "times"])

    grams = materialise(rows.select(F.col(row).alias("row"), F.col(f"`{text_column}`").alias("text")).mapInArrow(lean(run), "row long, gram long, times long"), "text_grams")
    prices = materialise(_prices(table, grams.select("gram").distinct()), "prices").withColumnRenamed("gram", "priced")
    # Exact sums of a fixed number of digits, so a result doesn't depend on the order in which rows meet.
    cost = F.sum((F.col("times") * F.round("bits", PLACES)).cast(EXACT)).cast("double")
    bits = grams.join(prices, F.col("gram") == F.col("priced")).groupBy("row", "lang").agg(cost.alias("bits"), F.sum("times").alias("size"))
    best = bits.groupBy(F.col("row").alias("of_row")).agg(F.min(F.struct("bits", "lang")).alias("best"), F.max("size").alias(size))
    best = best.select("of_row", F.col("best.bits").alias("least"), F.col("best.lang").alias("best_lang"), size)
    share = F.pow(F.lit(2.0), F.greatest(F.col("least") - F.col("bits"), F.lit(-1000.0)))
    met = bits.select("row", "bits").join(best, F.col("row") == F.col("of_row"))
    scored = met.groupBy(F.col("of_row").alias(best_row), F.col("least").alias(least), F.col("best_lang").alias(best_of), size).agg((1 / F.sum(F.round(share, PLACES).cast(EXACT)).cast("double")).alias(share_of))
    found = rows.join(scored, F.col(row) == F.col(best_row), "left")
    letters = F.coalesce(F.col(f"`{text_column}`").rlike(LETTER), F.lit(False))
    return found.select(
        *(F.col(f"`{c}`") for c in df.columns), F.when(letters, F.col(best_of)).otherwise("und").alias(lang_), F.when(letters, F.col(share_of)).otherwise(0.0).alias(score_), F.coalesce(F.col(least) / F.col(size), F.lit(0.0)).alias(bits_)
    ), [lang_, score_, bits_]


def code_lengths(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bits of each text (rows) under each language (columns), and bytes of each text."""
    data, offsets = buffer(texts)
    gram, _ = _grams(data, offsets)
    # Each distinct string is priced once.
    code, distinct = pd.factorize(gram)
    price = _bits(None, model.orders, distinct.astype(np.uint32)) if len(distinct) else np.zeros((0, len(model.languages)))
    out = np.zeros((len(offsets) - 1, len(model.languages)))
    full = np.flatnonzero(np.diff(offsets) > 0)
    for i in range(len(model.languages)):
        if len(full):
            out[full, i] = np.add.reduceat(price[:, i][code], offsets[full])
    return out, np.diff(offsets)


def decide(model: Model, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(language or und, score, bits a byte) of each text."""
    letters = pc.fill_null(pc.match_substring_regex(texts, LETTER), False).to_numpy(zero_copy_only=False)
    if not model.languages:
        return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
    bits, size = code_lengths(model, texts)
    best = bits.argmin(1)
    least = bits[np.arange(len(best)), best]
    score = 1 / np.exp2(np.clip(least[:, None] - bits, -1000, 0)).sum(1)
    names = np.array(model.languages, object)[best]
    return np.where(letters, names, "und").tolist(), np.where(letters, score, 0.0), np.where(size > 0, least / np.maximum(size, 1), 0.0)


def predict(df: DataFrame, model: Model | Table, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, lang_pred, score, bits_per_byte) for each row."""
    if isinstance(model, Table):
        found, (lang, score, bits) = _decided(df.selectExpr(f"`{id_column}` as id", f"`{text_column}` as text"), model, "text")
        return found.select(F.col("id").cast("long").alias(id_column), F.col(lang).alias("lang_pred"), F.col(score).alias("score"), F.col(bits).alias("bits_per_byte"))
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by MOST_CELLS

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1):
                lang, score, bits = decide(shared.value, part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang), pa.array(score), pa.array(bits)], names=["id", "lang_pred", "score", "bits_per_byte"])

    found = df.selectExpr(f"`{id_column}` as id", f"`{text_column}` as text").mapInArrow(lean(run), "id long, lang_pred string, score double, bits_per_byte double")
    return found.withColumnRenamed("id", id_column)


def keep(df: DataFrame, model: Model | Table, least_score: float = 0.5, most_bits: float = 7.0, text_column: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text has a language: not ``und``, score and code length within the limits."""
    if isinstance(model, Table):
        found, (lang, score, bits) = _decided(df, model, text_column)
        return found.where((F.col(lang) != "und") & (F.col(score) >= least_score) & (F.col(bits) <= most_bits)).drop(lang, score, bits)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text_column)
            for part in slices(batch, at):
                lang, score, bits = decide(shared.value, part.column(at))
                yield part.filter(pa.array((np.array(lang, object) != "und") & (score >= least_score) & (bits <= most_bits)))

    return df.mapInArrow(lean(run), df.schema)
