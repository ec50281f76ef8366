"""Alignment of two tokenizers over the same bytes by galloping intersection of their token ends.

Tokenizer A (byte-level BPE) reads a space and the text, tokenizer B (pieces with byte fallback) the text, and adds the space
itself. Both token lists cover the same bytes, so each list is one of rising ends. The shorter list drives: from where the last
search ended in the longer list, steps of 1, 2, 4, ... find an interval that holds the next end, and a binary search finds the
end in it or its absence. Common ends cut both lists into groups; differences of ranks of a token's two ends in the other
list are the range of tokens that it overlaps.

Texts are cut where both tokenizers surely end a token (before a space, tab, line feed, vertical tab or form feed that follows
a known other character), so each distinct piece of a slice is encoded and aligned once, and texts add up what their pieces
have. Lists are searched in parts of at most PART ends, all parts of a slice in step.

Corpus-wide, pairs of ids are counted over all texts: in the task first, then by Spark. Up to ``most_pairs`` distinct pairs the
counts go to every task; beyond, they stay a table and are joined with the texts' own pairs, spread over SALTS for pairs that are
in many texts. Both give the same numbers.

A text that is null or empty, or whose joined bytes under A or B differ from a space and the text (as where the text holds
U+2581, which B reads as a space), has no tokens: zeros and an empty string, and none of its pairs count. Repeated rows count each;
an empty table gives no rows. Only the named id and text columns are read.
"""

from __future__ import annotations

import functools
import hashlib
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from tokenizers import Tokenizer

from bidloom.llm.bpe import pieces_to_ids
from bidloom.llm.common import buffer, lean, materialise, slices, small_batches

#: Most distinct pairs (20 bytes each) that go to every task.
MOST_PAIRS = 4_000_000
#: Pairs that a task holds before it writes them out.
TABLE_PAIRS = 1_000_000
#: Ends of a list that one search goes through in order.
PART = 64
#: Parts of a pair's rows where counts are joined.
SALTS = 16
#: Bytes of texts that are encoded together; more of them repeat than in a smaller slice.
SLICE = 6 << 20
#: Pieces whose ids a worker keeps for later slices (about 100 bytes each).
KNOWN_PIECES = 500_000

#: White space before which no token of either kind goes on, and the mark that B reads as a space.
CUT = np.zeros(256, bool)
CUT[[0x09, 0x0A, 0x0B, 0x0C, 0x20]] = True
MARK = "▁"


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Side(NamedTuple):
    """A tokenizer: its encoder of many strings, and the bytes of each id."""

    encode: object
    data: np.ndarray
    at: np.ndarray

    @property
    def lengths(self) -> np.ndarray:
        return np.diff(self.at)


def _side(encode, token_bytes: list[bytes]) -> Side:
    return Side(encode, np.frombuffer(b"".join(token_bytes), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in token_bytes])]))


@functools.cache
def byte_level(path: str) -> Side:
    """Tokenizer A from a file of the tokenizers library; strings of special tokens in a text are ordinary text."""
    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True
    vocabulary, byte_of = found.get_vocab(with_added_tokens=True), _byte_of()
    token_bytes = [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        token_bytes[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
    return _side(lambda many: [x.ids for x in found.encode_batch_fast(many, add_special_tokens=False)], token_bytes)


@functools.cache
def piece_level(path: str) -> Side:
    """Tokenizer B from a file of the sentencepiece library. Strings to encode begin with white space."""
    found = sentencepiece.SentencePieceProcessor(model_file=path)
    size = found.get_piece_size()
    token_bytes = [bytes([int(p[3:5], 16)]) if found.is_byte(i) else p.replace(MARK, " ").encode() for i in range(size) for p in [found.id_to_piece(i)]]
    before = found.encode("x")

    def encode(many: list[str]) -> list[list[int]]:
        return [x[len(before) :] for x in found.encode(["x" + x for x in many], num_threads=1)]

    return _side(encode, token_bytes)


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All numbers from each start on, as many as its size, end to end."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def gallop(short: np.ndarray, begin: np.ndarray, stop: np.ndarray, long: np.ndarray, cursor: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes (in short, in long) of equal values of rising lists.

    Lane i looks for short[begin[i]:stop[i]], in order, in long[cursor[i]:limit[i]].
    """
    order = np.argsort(begin - stop, kind="stable")
    begin, cursor, limit, size = begin[order], cursor[order].copy(), limit[order], (stop - begin)[order]
    found_short, found_long = [], []
    for t in range(int(size[0]) if len(size) else 0):
        live = int(np.searchsorted(-size, -t))
        want = short[begin[:live] + t]
        low, end = cursor[:live].copy(), limit[:live]
        step = np.ones(live, np.int64)
        high = np.minimum(low, end)
        todo = np.flatnonzero(high < end)
        todo = todo[long[high[todo]] < want[todo]]
        while len(todo):  # long[low - 1] < want; double the step until it isn't
            low[todo] = high[todo] + 1
            high[todo] = np.minimum(high[todo] + step[todo], end[todo])
            step[todo] *= 2
            todo = todo[high[todo] < end[todo]]
            todo = todo[long[high[todo]] < want[todo]]
        todo = np.flatnonzero(low < high)
        while len(todo):
            middle = (low[todo] + high[todo]) >> 1
            less = long[middle] < want[todo]
            low[todo[less]] = middle[less] + 1
            high[todo[~less]] = middle[~less]
            todo = todo[low[todo] < high[todo]]
        cursor[:live] = low
        hit = np.flatnonzero(low < end)
        hit = hit[long[low[hit]] == want[hit]]
        found_short.append(begin[:live][hit] + t)
        found_long.append(low[hit])
    return np.concatenate([*found_short, np.zeros(0, np.int64)]), np.concatenate([*found_long, np.zeros(0, np.int64)])


def common_ends(ends_a: np.ndarray, at_a: np.ndarray, ends_b: np.ndarray, at_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes (in a, in b) of ends that both lists of a piece have, rising. Pieces' lists lie end to end, with offsets ``at``."""
    out_a, out_b = [], []
    by_a = np.diff(at_a) <= np.diff(at_b)
    for drive, short, at_short, long, at_long, to_short, to_long in ((by_a, ends_a, at_a, ends_b, at_b, out_a, out_b), (~by_a, ends_b, at_b, ends_a, at_a, out_b, out_a)):
        begin, stop = at_short[:-1][drive], at_short[1:][drive]
        parts = -(-(stop - begin) // PART)
        whose = np.flatnonzero(drive).repeat(parts)
        start = begin.repeat(parts) + PART * spread(np.zeros(len(parts), np.int64), parts)
        end = np.minimum(start + PART, stop.repeat(parts))
        cursor = np.where(start == at_short[whose], at_long[whose], np.searchsorted(long, short[start] if len(start) else start))
        x, y = gallop(short, start, end, long, cursor, at_long[whose + 1])
        to_short.append(x)
        to_long.append(y)
    return np.sort(np.concatenate(out_a)), np.sort(np.concatenate(out_b))


class Pieces(NamedTuple):
    """The distinct pieces of a slice under both tokenizers: ids end to end with offsets, common ends, and overlapping pairs."""

    good: np.ndarray  # whether both sides give the piece's bytes
    ids_a: np.ndarray
    at_a: np.ndarray
    ids_b: np.ndarray
    at_b: np.ndarray
    last_a: np.ndarray  # index of the last token of each group
    last_b: np.ndarray
    link_a: np.ndarray  # indexes of overlapping tokens
    link_b: np.ndarray


def _encoded(distinct: pa.Array, side: Side, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, offsets, whether the ids give the bytes) of pieces; those ``apart`` are encoded each by itself."""
    together = np.flatnonzero(~apart)
    ids, at = pieces_to_ids(distinct.take(pa.array(together)).cast(pa.string()), side.encode, side.lengths)
    alone = side.encode([x.decode() for x in distinct.filter(pa.array(apart)).to_pylist()]) if apart.any() else []
    flat = np.concatenate([ids.astype(np.int64), *(np.asarray(x, np.int64) for x in alone)])
    start, size = np.zeros((2, len(distinct)), np.int64)
    start[together], size[together] = at[:-1], np.diff(at)
    size[apart] = [len(x) for x in alone]
    start[apart] = len(ids) + np.cumsum(size[apart]) - size[apart]
    flat = flat[spread(start, size)]
    to = np.concatenate([[0], np.cumsum(size)])
    data, offsets = buffer(distinct.cast(pa.string()))
    reach = np.concatenate([[0], np.cumsum(side.lengths[flat])])[to]
    good = np.diff(reach) == np.diff(offsets)
    own = good[np.repeat(np.arange(len(distinct)), size)]
    told = side.data[spread(side.at[flat[own]], side.lengths[flat[own]])]
    keep = np.repeat(good, np.diff(offsets))
    wrong = np.flatnonzero(told != data[keep])
    if len(wrong):
        good[np.searchsorted(offsets, np.flatnonzero(keep)[wrong], "right") - 1] = False
    return flat, to, good


class _Known:
    """Pieces that this worker has encoded before, with their ids: at most KNOWN_PIECES, then it begins anew with the latest."""

    def __init__(self):
        self.pieces, self.ids, self.at, self.good = pa.array([], pa.binary()), np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, bool)

    def encoded(self, distinct: pa.Array, side: Side, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As ``_encoded``; only pieces that aren't known go to the library."""
        where = pc.index_in(distinct, value_set=self.pieces)
        new = where.is_null().to_numpy(zero_copy_only=False)
        fresh = distinct.filter(pa.array(new))
        ids, at, good = _encoded(fresh, side, apart[new])
        every, ends, goods = np.concatenate([self.ids, ids]), np.concatenate([self.at, self.at[-1] + at[1:]]), np.concatenate([self.good, good])
        place = pc.fill_null(where, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        place[new] = len(self.pieces) + np.arange(len(fresh))
        start, size = ends[place], np.diff(ends)[place]
        out = every[spread(start, size)], np.concatenate([[0], np.cumsum(size)]), goods[place]
        if len(ends) > KNOWN_PIECES:
            self.pieces, (self.ids, self.at, self.good) = pa.concat_arrays([distinct]), out
        else:
            self.pieces, self.ids, self.at, self.good = pa.concat_arrays([self.pieces, fresh]), every, ends, goods
        return out


@functools.cache
def _known(side: str, path: str) -> _Known:
    """What a worker knows of a tokenizer's pieces."""
    return _Known()


def align_pieces(distinct: pa.Array, path_a: str, path_b: str) -> Pieces:
    """Encode and align distinct pieces, each of which begins with white space."""
    odd = pc.match_substring_regex(distinct.cast(pa.string()), f"\r|{MARK}").to_numpy(zero_copy_only=False).astype(bool)
    a, b = byte_level(path_a), piece_level(path_b)
    ids_a, at_a, good_a = _known("a", path_a).encoded(distinct, a, np.zeros(len(distinct), bool))
    ids_b, at_b, good_b = _known("b", path_b).encoded(distinct, b, odd)
    good = good_a & good_b

    def kept(ids, at):
        size = np.where(good, np.diff(at), 0)
        return ids[spread(at[:-1], size)], np.concatenate([[0], np.cumsum(size)])

    (ids_a, at_a), (ids_b, at_b) = kept(ids_a, at_a), kept(ids_b, at_b)
    ends_a, ends_b = np.cumsum(a.lengths[ids_a]), np.cumsum(b.lengths[ids_b])
    last_a, last_b = common_ends(ends_a, at_a, ends_b, at_b)
    first = np.concatenate([[-1], last_b])  # the group's B tokens before a token of A
    group = np.searchsorted(last_a, np.arange(len(ids_a)))
    lone = np.diff(last_a, prepend=-1) == 1
    low, high = first[group] + 1, last_b[group] if len(group) else group
    many = ~lone[group] if len(group) else np.zeros(0, bool)  # in a group of one token of A, it overlaps all of B's
    low[many] = np.searchsorted(ends_b, ends_a[many] - a.lengths[ids_a[many]], "right")
    high = high.copy()
    high[many] = np.searchsorted(ends_b, ends_a[many], "left")
    size = high - low + 1
    return Pieces(good, ids_a, at_a, ids_b, at_b, last_a, last_b, np.repeat(np.arange(len(ids_a)), size), spread(low, size))


class Texts(NamedTuple):
    """The texts of a slice as codes of distinct pieces."""

    of: np.ndarray  # first piece of each text, and the end
    code: np.ndarray
    distinct: pa.Array
    pieces: Pieces
    valid: np.ndarray


def read_texts(texts: pa.Array, path_a: str, path_b: str) -> Texts:
    """Cut texts, each with a space before it, into pieces, and align the distinct ones. Null and empty texts aren't valid."""
    texts = pc.fill_null(texts, "")
    data, offsets = buffer(pc.binary_join_element_wise("", texts, " "))
    cut = np.zeros(len(data) + 1, bool)
    if len(data) > 1:
        before, lead = data[:-1], np.concatenate([[0], data[:-2]])
        cut[1:-1] = CUT[data[1:]] & ((before > 0x20) & (before < 0x7F) | (before >= 0x80) & (lead > 0xC2) & (lead < 0xE0))
    cut[offsets] = True
    cuts = np.flatnonzero(cut)
    if len(data):
        coded = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        code, distinct = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
    else:
        cuts, code, distinct = np.zeros(1, np.int64), np.zeros(0, np.int64), pa.array([], pa.binary())
    of = np.searchsorted(cuts, offsets)
    pieces = align_pieces(distinct, path_a, path_b)
    bad = np.concatenate([[0], np.cumsum(~pieces.good[code])])[of]
    return Texts(of, code, distinct, pieces, (np.diff(bad) == 0) & (np.diff(offsets) > 1))


def _pairs(p: Pieces, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(a * width + b of each link, first link of each piece and the end)."""
    at = np.searchsorted(p.link_a, p.at_a)
    return p.ids_a[p.link_a] * width + p.ids_b[p.link_b], at


def pair_counts(df: DataFrame, path_a: str, path_b: str, text_column: str = "text") -> DataFrame:
    """(pair, n): partial counts of overlapping pairs over all texts, a pair being a * (B's ids) + b."""
    names = ["pair", "n"]

    def run(batches):
        width, table = len(piece_level(path_b).lengths), pd.Series(dtype=np.int64)
        for batch in batches:
            for part in slices(batch, 0, SLICE):
                t = read_texts(part.column(0), path_a, path_b)
                pair, at = _pairs(t.pieces, width)
                times = np.bincount(t.code[np.repeat(t.valid, np.diff(t.of))], minlength=len(t.distinct))
                n = np.repeat(times, np.diff(at))
                key, to = np.unique(pair[n > 0], return_inverse=True)
                found = pd.Series(np.bincount(to, weights=n[n > 0], minlength=len(key)).astype(np.int64), index=key)
                table = table.add(found, fill_value=0) if len(table) else found
                if len(table) > TABLE_PAIRS:
                    yield pa.RecordBatch.from_arrays([pa.array(table.index.to_numpy(), pa.int64()), pa.array(table.to_numpy().astype(np.int64))], names=names)
                    table = pd.Series(dtype=np.int64)
        if len(table):
            yield pa.RecordBatch.from_arrays([pa.array(table.index.to_numpy(), pa.int64()), pa.array(table.to_numpy().astype(np.int64))], names=names)

    small_batches(df.sparkSession)
    return df.select(F.col(text_column).alias("text")).mapInArrow(lean(run), "pair long, n long")


class Counts(NamedTuple):
    """Corpus-wide counts of pairs, sorted by pair, and whether each is its B id's highest; or, in ``table``, the same in Spark."""

    pair: np.ndarray | None
    n: np.ndarray | None
    best: np.ndarray | None
    table: DataFrame


def count_pairs(df: DataFrame, path_a: str, path_b: str, text_column: str = "text", most_pairs: int = MOST_PAIRS) -> Counts:
    """Counts over all texts; they come to the driver only where there are ``most_pairs`` at most."""
    width = len(piece_level(path_b).lengths)
    counted = materialise(pair_counts(df, path_a, path_b, text_column).groupBy("pair").agg(F.sum("n").alias("n")), "pair_counts")
    highest = counted.groupBy((F.col("pair") % width).alias("of_b")).agg(F.max("n").alias("highest"))
    table = counted.join(highest, F.col("pair") % width == F.col("of_b")).select("pair", "n", (F.col("n") == F.col("highest")).alias("best"))
    if counted.count() > most_pairs:
        return Counts(None, None, None, table)
    got = table.toArrow().sort_by("pair")
    return Counts(*(got.column(c).to_numpy() for c in ("pair", "n", "best")), table)


def align(df: DataFrame, path_a: str, path_b: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row (id, groups array<struct<a array<int>, b array<int>>>) for each row: ids of both sides between common ends, in order."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1):
                t = read_texts(part.column(1), path_a, path_b)
                p = t.pieces
                at = np.searchsorted(p.last_a, p.at_a)
                code = t.code[np.repeat(t.valid, np.diff(t.of))]
                group = spread(at[:-1][code], np.diff(at)[code])
                many = np.concatenate([[0], np.cumsum(np.where(t.valid, np.diff(np.concatenate([[0], np.cumsum(np.diff(at)[t.code])])[t.of]), 0))])
                sides = []
                for ids, last in ((p.ids_a, p.last_a), (p.ids_b, p.last_b)):
                    start, size = np.concatenate([[-1], last])[group] + 1, np.diff(last, prepend=-1)[group]
                    sides.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(ids[spread(start, size)].astype(np.int32))))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(many, pa.int32()), pa.StructArray.from_arrays(sides, names=["a", "b"]))], names=["id", "groups"])

    kind = df.select(id_column).schema[0].dataType.simpleString()
    small_batches(df.sparkSession)
    found = df.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(lean(run), f"id {kind}, groups array<struct<a:array<int>,b:array<int>>>")
    return found.withColumnRenamed("id", id_column)


def _told(p: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """The groups of each piece as text (``a1,a2|b1;`` with a last semicolon), end to end, and offsets."""
    n_a, n_b = np.diff(p.last_a, prepend=-1), np.diff(p.last_b, prepend=-1)
    total = n_a + n_b
    at = np.cumsum(total) - total
    ids = np.zeros(int(total.sum()), np.int64)
    mark = np.zeros(len(ids), np.int8)
    ids[spread(at, n_a)], ids[spread(at + n_a, n_b)] = p.ids_a, p.ids_b
    mark[at + n_a - 1], mark[at + total - 1] = 1, 2
    marks = pa.array([",", "|", ";"]).take(pa.array(mark))
    text = pc.binary_join_element_wise(pc.cast(pa.array(ids), pa.string()), marks, "")
    data, offsets = buffer(text)
    first = np.append(at, len(ids))[np.searchsorted(p.last_a, p.at_a)]
    return data, offsets[first]


def digest(df: DataFrame, path_a: str, path_b: str, id_column: str = "doc_id", text_column: str = "text", most_pairs: int = MOST_PAIRS) -> DataFrame:
    """One row (id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for each row."""
    counts = count_pairs(df, path_a, path_b, text_column, most_pairs)
    known, n_of, best_of = counts.pair, counts.n, counts.best
    beyond = known is None

    def run(batches):
        width = len(piece_level(path_b).lengths)
        for batch in batches:
            for part in slices(batch, 2, SLICE):
                t = read_texts(part.column(2), path_a, path_b)
                p = t.pieces
                pair, at = _pairs(p, width)

                def total(per_piece):
                    return np.where(t.valid, np.diff(np.concatenate([[0], np.cumsum(per_piece[t.code])])[t.of]), 0)  # noqa: B023

                def by_piece(per_link):
                    return np.diff(np.concatenate([[0], np.cumsum(per_link)])[at])  # noqa: B023

                columns = [total(np.diff(p.at_a)), total(np.diff(p.at_b)), total(np.diff(np.searchsorted(p.last_a, p.at_a))), total(np.diff(at))]
                if beyond:
                    own = np.repeat(t.valid, np.diff(t.of))
                    code, row = t.code[own], np.repeat(np.arange(len(t.valid)), np.diff(t.of))[own]
                    size = np.diff(at)[code]
                    both = np.stack([np.repeat(row, size), pair[spread(at[:-1][code], size)]])
                    order = np.lexsort(both[::-1])
                    both = both[:, order]
                    new = np.append(True, (both[:, 1:] != both[:, :-1]).any(0)) if both.shape[1] else np.zeros(0, bool)
                    where = np.flatnonzero(new)
                    times = np.diff(np.append(where, both.shape[1]))
                    lists = pa.StructArray.from_arrays([pa.array(both[1, where], pa.int64()), pa.array(times, pa.int64())], names=["pair", "times"])
                    last = pa.ListArray.from_arrays(pa.array(np.searchsorted(both[0, where], np.arange(len(t.valid) + 1)), pa.int32()), lists)
                    extra = [part.column(0), last]
                else:
                    if len(known):
                        place = np.minimum(np.searchsorted(known, pair), len(known) - 1)
                        hit = known[place] == pair
                    else:
                        place, hit = np.zeros(len(pair), np.int64), np.zeros(len(pair), bool)
                    n = np.where(hit, n_of[place] if len(known) else 0, 0)
                    best = hit & (best_of[place] if len(known) else False)
                    columns += [total(by_piece(best)), total(by_piece(n))]
                    extra = []
                data, told = _told(p)
                size = np.diff(told)[t.code]
                sha = []
                for row, (a, b) in enumerate(zip(t.of[:-1].tolist(), t.of[1:].tolist(), strict=True)):
                    text = data[spread(told[:-1][t.code[a:b]], size[a:b])] if t.valid[row] else data[:0]
                    sha.append(hashlib.sha256(text[:-1].tobytes()).hexdigest() if len(text) else "")
                yield pa.RecordBatch.from_arrays([part.column(1), *(pa.array(c, pa.int64()) for c in columns), pa.array(sha), *extra], names=names)

    numbers = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    kind = df.select(id_column).schema[0].dataType.simpleString()
    schema = f"id {kind}, " + ", ".join(f"{c} long" for c in numbers[: 4 if beyond else 6]) + ", groups_sha256 string" + (", row long, pairs array<struct<pair:bigint,times:bigint>>" if beyond else "")
    names = StructType.fromDDL(schema).names
    asked = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    found = asked.mapInArrow(lean(run), schema)
    if beyond:
        found = _joined(materialise(found, "aligned"), counts.table)
    return found.select(F.col("id").alias(id_column), *numbers, "groups_sha256")


def _joined(found: DataFrame, table: DataFrame) -> DataFrame:
    """Adds n_best and count_sum by a join of each text's pairs with the counts; a pair's rows are spread over SALTS keys."""
    own = found.select("row", F.inline("pairs")).withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
    salted = table.select(F.col("pair").alias("of_pair"), "n", "best", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("of_salt"))
    met = own.join(salted.hint("shuffle_hash"), (F.col("pair") == F.col("of_pair")) & (F.col("salt") == F.col("of_salt")))
    sums = met.groupBy(F.col("row").alias("of_row")).agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    out = found.drop("pairs").join(sums, F.col("row") == F.col("of_row"), "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_best", "count_sum")})
