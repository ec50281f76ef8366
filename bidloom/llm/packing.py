"""Packing token sequences by shortest-pack-first over the length histogram.

A document's ids (and a separator) are cut into pieces of the sequence length and a rest. Full pieces and rests are counted
by length; the histogram has at most ``max_tokens`` rows, so planning is small at any input size. Lengths are placed longest
first, each into the packing patterns with the smallest sum that have room, by updating pattern counts, never by document.
Patterns then become ranges of ranks per length, and pieces find their sequence and offset by joining their rank.

Null text counts as empty: it has the separator only. Repeated rows are packed each by itself (ties in (doc_id, start) may
swap places, which gives the same rows). An empty table gives no rows. Only the id and text columns are read.
"""

from __future__ import annotations

import functools
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from bidloom.llm.bpe import Known, pieces_to_ids
from bidloom.llm.common import keyed, materialise

#: Pieces of one length that are ranked together; a longer list is ranked in parts, whose counts are summed.
RANKED_TOGETHER = 2000

PIECE = "struct<start:bigint,length:int,ids_crc32:bigint>"


@functools.cache
def tokenizer(path: str) -> tuple[Tokenizer, np.ndarray]:
    """The library's tokenizer for a file, and the number of bytes of each id. A special token's string in a text gives its id, as by the
    library's default; none is added."""
    found = Tokenizer.from_file(path)
    vocabulary = found.get_vocab(with_added_tokens=True)
    lengths = np.zeros(max(vocabulary.values()) + 1, np.int64)
    lengths[list(vocabulary.values())] = [len(x) for x in vocabulary]  # in byte-level vocabularies a character stands for a byte
    return found, lengths


def token_ids(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of texts, end to end, and len + 1 offsets."""
    found, lengths = tokenizer(path)
    return pieces_to_ids(texts, lambda many: [x.ids for x in found.encode_batch_fast(many, add_special_tokens=False)], lengths, known(path))


@functools.cache
def known(path: str) -> Known:
    """The pieces that this worker has encoded by a tokenizer."""
    return Known()


def cut(df: DataFrame, path: str, max_tokens: int = 1024, separator: int = 0, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each piece: (id, start, length, ids_crc32, doc_tokens); the last id of each document is the separator."""

    def run(texts: pa.Array) -> list[pa.Array]:
        ids, at = token_ids(texts, path)
        full = np.insert(ids, at[1:], separator).astype("<u4")
        at = at + np.arange(len(at))
        size = np.diff(at)
        many = -(-size // max_tokens)
        to = np.concatenate([[0], np.cumsum(many)])
        start = (np.arange(to[-1]) - np.repeat(to[:-1], many)) * max_tokens
        length = np.minimum(np.repeat(size, many) - start, max_tokens)
        begin = np.repeat(at[:-1], many) + start
        crc = [zlib.crc32(full[a : a + n]) for a, n in zip(begin.tolist(), length.tolist(), strict=True)]
        pieces = pa.StructArray.from_arrays([pa.array(start, pa.int64()), pa.array(length, pa.int32()), pa.array(crc, pa.int64())], names=["start", "length", "ids_crc32"])
        return [pa.array(size, pa.int64()), pa.ListArray.from_arrays(pa.array(to, pa.int32()), pieces)]

    found = keyed(run, df.selectExpr(f"`{id_column}` as id", f"`{text_column}` as text"), f"id long, doc_tokens long, pieces array<{PIECE}>")
    return found.selectExpr(f"id as `{id_column}`", "doc_tokens", "inline(pieces)")


def plan(histogram: dict[int, int], max_tokens: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and their counts for a histogram of lengths.

    Longest first; a length goes to the patterns with the smallest sum (the most room). Where none has room, as many new
    ones are opened as the tokens still unplaced fill at least, and the rest of the length goes to those.
    """
    room: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)
    left = sum(k * n for k, n in histogram.items())
    for length in sorted(histogram, reverse=True):
        count = histogram[length]
        while count:
            most = max(room, default=0)
            if most < length:
                opened = min(count, max(1, -(-left // max_tokens)))
                room[max_tokens - length][(length,)] = room[max_tokens - length].get((length,), 0) + opened
                count, left = count - opened, left - opened * length
                continue
            pattern, have = next(iter(room[most].items()))
            placed = min(count, have)
            if placed == have:
                del room[most][pattern]
                if not room[most]:
                    del room[most]
            else:
                room[most][pattern] = have - placed
            to = room[most - length]
            to[(*pattern, length)] = to.get((*pattern, length), 0) + placed
            count, left = count - placed, left - placed * length
    return [x for patterns in room.values() for x in patterns.items()]


def places(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, ranks, first sequence, offset): the pieces of that length with those ranks go to those sequences."""
    out, used, sequence = [], defaultdict(int), 0
    for pattern, count in patterns:
        offset = 0
        for length in pattern:
            out.append((length, used[length], count, sequence, offset))
            used[length] += count
            offset += length
        sequence += count
    return out


def pack(pieces: DataFrame, max_tokens: int = 1024, id_column: str = "doc_id") -> DataFrame:
    """Adds sequence_id and offset to a stored table of pieces (lengths 1 to ``max_tokens``)."""
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # max_tokens rows at most
    table = spark.createDataFrame(places(plan(histogram, max_tokens)), "place_length int, first_rank long, ranks long, first_sequence long, offset long")
    parts = max(1, sum(histogram.values()) // RANKED_TOGETHER)
    dealt = pieces.withColumn("part", F.pmod(F.xxhash64(id_column, "start"), F.lit(parts)))
    sizes = dealt.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col("length").alias("size_length"), F.col("part").alias("size_part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "part").orderBy(id_column, "start")
    ranked = dealt.withColumn("row", F.row_number().over(within)).join(sizes, (F.col("length") == F.col("size_length")) & (F.col("part") == F.col("size_part")))
    ranked = ranked.withColumn("rank", F.col("row") - 1 + F.col("before"))
    fits = (F.col("length") == F.col("place_length")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("first_rank") + F.col("ranks"))
    placed = ranked.join(F.broadcast(table), fits)  # a few rows for each length: bounded by max_tokens
    return placed.select(
        id_column, "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens", (F.col("first_sequence") + F.col("rank") - F.col("first_rank")).alias("sequence_id"), "offset"
    )


def pack_documents(df: DataFrame, path: str, max_tokens: int = 1024, separator: int = 0, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Cut, keep the pieces in the shared folder, and pack."""
    return pack(materialise(cut(df, path, max_tokens, separator, id_column, text_column), "pieces"), max_tokens, id_column)
