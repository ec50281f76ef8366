"""Quality rules by distribution divergence.

References are learned from the whole table: for each language, the median share of each character class over its documents
(which a part of odd documents doesn't move) and the histogram of its most common words. They are a table, one small row for
each language, that documents are joined with. A document's two histograms are compared with its language's by Jensen-Shannon
distance (root of the divergence in bits, 0 to 1). Short texts are noisy, so each comparison has a least length, below which it
passes. Documents whose language is null are held against the nearest reference of all languages.

Null text counts as empty (no words, not kept: too few words). Repeated rows get repeated results; a language with few
documents still has a reference. An empty table gives no rows. Only the id, text and language columns are read.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bidloom.llm.common import buffer, discard, hashes, lean, materialise, mix, slices, sums, words, WHITE
from bidloom.llm.common import shingles as windows

#: Character classes: bytes of lower-case, upper-case, digits, white space, sentence marks, brackets and quotes, symbols; others are bytes of letters beyond ASCII.
CLASSES = ("lower", "upper", "digit", "white", "mark", "quote", "symbol", "beyond")
CLASS_OF = np.full(256, 7, np.uint8)
CLASS_OF[:128] = 6
CLASS_OF[0x80:0xC0] = 8  # not the first byte of a character: counts nowhere
#: Shares are counted in steps of a 512th.
STEPS = 512
for _chars, _class in ((b"abcdefghijklmnopqrstuvwxyz", 0), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), (b"0123456789", 2), (b"\t\n\v\f\r ", 3), (b".,;:!?-", 4), (b"()[]\"'", 5)):
    CLASS_OF[list(_chars)] = _class

#: The symbols that n_symbols counts (fixed values).
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

#: Words of a reference.
COMMON_WORDS = 64
#: Most languages (about 1.2 KB each) whose references go to every task, for documents without a language; with more, the job stops.
MOST_LANGUAGES = 50_000
#: Distances above these reject a text; below the least numbers of characters and words they aren't judged. Shares of few
#: characters vary, by about 1 / sqrt(characters), so that times CLASS_SLACK is added.
CLASS_DISTANCE, CLASS_SLACK, CLASS_LEAST = 0.17, 1.8, 200
WORD_DISTANCE, WORD_LEAST = 0.50, 100
#: Words beyond this number in a task's table of counts are first written out, then the table starts anew.
TABLE_WORDS = 200_000


#: A word's case and the marks at its ends don't count in histograms of words.
MARKS = b".,;:!?-()[]\"'#*$%&|<>"


def _bare(distinct: pa.Array) -> list[bytes]:
    return [x.lower().strip(MARKS) for x in distinct.to_pylist()]


def _class_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Characters of each class (columns) in each text (rows)."""
    kind, at = CLASS_OF[data], offsets.tolist()
    return np.array([np.bincount(kind[a:b], minlength=9)[:8] for a, b in zip(at[:-1], at[1:], strict=True)]).reshape(-1, 8)


def corpus_counts(df: DataFrame, text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """(lang, word, class, step, n): partial counts over all rows, of words, or of documents by a class's share in steps."""
    names = ["lang", "word", "class", "step", "n"]

    def out(lang, found):
        empty = pa.nulls(len(found), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(found)), pa.array(list(found), pa.binary()), empty, empty, pa.array(list(found.values()), pa.int64())], names=names)

    def run(batches):
        tables: dict[str, dict[bytes, int]] = {}
        shares: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, 0):
                langs = part.column(1)
                for lang in pc.unique(langs).to_pylist():
                    if lang is None:
                        continue
                    data, offsets = buffer(part.column(0).filter(pc.equal(langs, lang)))
                    classes = _class_counts(data, offsets)
                    chars = classes.sum(1)
                    step = (classes[chars > 0] * STEPS // chars[chars > 0][:, None]) + np.arange(8) * (STEPS + 1)
                    shares[lang] = shares.get(lang, 0) + np.bincount(step.ravel(), minlength=8 * (STEPS + 1))
                    _, code, distinct = words(data, offsets)
                    table = tables.setdefault(lang, {})
                    for word, n in zip(_bare(distinct), np.bincount(code, minlength=len(distinct)).tolist(), strict=True):
                        table[word] = table.get(word, 0) + n
                    if len(table) > TABLE_WORDS:
                        yield out(lang, tables.pop(lang))
        for lang, table in tables.items():
            yield out(lang, table)
        for lang, n in shares.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.nulls(len(at), pa.binary()), pa.array(at // (STEPS + 1), pa.int32()), pa.array(at % (STEPS + 1), pa.int32()), pa.array(n[at], pa.int64())], names=names)

    return df.selectExpr(f"`{text_column}` as text", f"`{lang_column}` as lang").mapInArrow(lean(run), "lang string, word binary, class int, step int, n long")


class Reference(NamedTuple):
    """Class shares, hashes of common words with their shares, and the share of all other words."""

    classes: np.ndarray
    words: np.ndarray
    shares: np.ndarray
    rest: float

    def packed(self) -> bytes:
        return np.concatenate([self.classes, [self.rest], self.words.view(np.float64), self.shares]).tobytes()

    @classmethod
    def unpacked(cls, raw: bytes) -> Reference:
        values = np.frombuffer(raw, np.float64)
        k = (len(values) - 9) // 2
        return cls(values[:8], values[9 : 9 + k].view(np.uint64), values[9 + k :], float(values[8]))


class References(NamedTuple):
    """A table (of, reference, words) with a row for each language, and the references of all of them."""

    table: DataFrame
    nearest: list[bytes]


def _medians(steps: list) -> np.ndarray:
    """Median share of each class from its counts by step; they are scaled to a sum of 1."""
    counts = np.zeros((8, STEPS + 1))
    for r in steps:
        counts[r["class"], r["step"]] = r["n"]
    upto = counts.cumsum(1)
    middle = np.array([(np.searchsorted(u, u[-1] / 2) + 0.5) / STEPS for u in upto])
    return middle / middle.sum()


def references(df: DataFrame, text_column: str = "text", lang_column: str = "lang") -> References:
    """References of all languages. A language's row gathers COMMON_WORDS words and 8 x 513 counts at most."""
    counts = materialise(corpus_counts(df, text_column, lang_column).groupBy("lang", "word", "class", "step").agg(F.sum("n").alias("n")), "quality-counts")
    of_words, of_shares = counts.where("class is null"), counts.where("class is not null")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    top = of_words.withColumn("k", rank).where(F.col("k") <= COMMON_WORDS).groupBy(F.col("lang").alias("top_of")).agg(F.collect_list(F.struct("word", "n")).alias("top"))
    total = of_words.groupBy(F.col("lang").alias("total_of")).agg(F.sum("n").alias("words"))
    steps = of_shares.groupBy("lang").agg(F.collect_list(F.struct("class", "step", "n")).alias("steps"))
    every = steps.join(top, F.col("lang") == F.col("top_of"), "left").join(total, F.col("lang") == F.col("total_of"), "left")

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                all_words, own = r["words"] or 0, r["top"] or []
                shares = np.array([x["n"] / all_words for x in own])
                made = Reference(_medians(r["steps"]), hashes(pa.array([x["word"] for x in own], pa.binary())), shares, max(0.0, 1 - shares.sum()))
                rows.append((r["lang"], made.packed(), all_words))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.binary(), pa.int64()))], names=["of", "reference", "words"])

    found = materialise(every.select("lang", "steps", "top", "words").mapInArrow(lean(run), "of string, reference binary, words long"), "references")
    discard(counts)
    if (n := found.count()) > MOST_LANGUAGES:
        raise ValueError(f"{n} languages are more than MOST_LANGUAGES; is the language column one?")
    return References(found, [bytes(r["reference"]) for r in found.orderBy("of").collect()])


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of p from q, as the root of the divergence in bits."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        one = np.where(p > 0, p * np.log2(p / m), 0).sum(-1)
        two = np.where(q > 0, q * np.log2(q / m), 0).sum(-1)
    return np.sqrt(np.clip((one + two) / 2, 0, 1))


class Counts(NamedTuple):
    """What the rules count in each text, and the words it was made from."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    data: np.ndarray
    offsets: np.ndarray
    code: np.ndarray
    distinct: pa.Array

    @property
    def failed(self) -> np.ndarray:
        """The base rules: too few words, or over half of them in repeated windows."""
        return (self.n_words < 50) | (100 * self.n_repeat_words > 50 * self.n_words)


def rule_counts(texts: pa.Array) -> Counts:
    data, offsets = buffer(texts)
    n = len(offsets) - 1
    of, code, distinct = words(data, offsets)
    count = np.diff(of)
    # White space of the word pattern is ASCII, so a word's code points are its leading bytes.
    chars = sums(((data & 0xC0) != 0x80) & ~WHITE[data], offsets)
    word = hashes(distinct)[code] if len(code) else np.zeros(0, np.uint64)
    triple, at = windows(of, word, 3)
    owner = np.repeat(np.arange(n), np.diff(at))
    key = mix(triple + mix(owner.astype(np.uint64)))
    twice = np.flatnonzero(pd.Series(key).duplicated(keep=False).to_numpy() & (count >= 3)[owner])
    hit = np.zeros(len(code) + 3, bool)
    first = of[:-1][owner[twice]] + twice - at[:-1][owner[twice]]
    for i in range(3):
        hit[first + i] = True
    return Counts(count.astype(np.int64), chars, sums(SYMBOLS[data], offsets), _dup_lines(data, offsets), sums(hit[: len(code)], of), data, offsets, code, distinct)


def _dup_lines(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Lines with a word that equal an earlier line of the text."""
    n = len(offsets) - 1
    newline = np.flatnonzero(data == 10)
    starts = np.union1d(offsets[:-1], newline + 1)
    starts = starts[starts < len(data)] if len(data) else starts[:0]
    # A text ends where the next begins; a line ends before its newline.
    owner = np.searchsorted(offsets, starts, side="right") - 1
    stops = np.append(starts[1:], len(data)).astype(np.int64)
    stops = np.minimum(stops, offsets[owner + 1]) if len(owner) else stops[: len(starts)]
    stops = stops - ((stops > starts) & (data[np.maximum(stops, 1) - 1] == 10)) if len(starts) else starts
    solid = np.concatenate([[0], np.cumsum(~WHITE[data])])
    real = solid[stops] > solid[starts] if len(starts) else np.zeros(0, bool)
    owner, starts, stops = owner[real], starts[real], stops[real]
    raw = data.tobytes()
    dup, seen, last = np.zeros(n, np.int64), set(), -1
    for t, a, b in zip(owner.tolist(), starts.tolist(), stops.tolist(), strict=True):
        if t != last:
            seen, last = set(), t
        line = raw[a:b]
        if line in seen:
            dup[t] += 1
        else:
            seen.add(line)
    return dup


def _distances(c: Counts, share: np.ndarray, bare: np.ndarray, rows: np.ndarray, which: np.ndarray, model: list[Reference]) -> tuple[np.ndarray, np.ndarray]:
    """(class distance, word distance) of the texts ``rows``, each from its own reference (``which`` of the model)."""
    by_class = distance(share[rows], np.stack([r.classes for r in model])[which])
    size = COMMON_WORDS + 1
    known = np.concatenate([mix(r.words + mix(np.full(len(r.words), i + 1, np.uint64))) for i, r in enumerate(model)])
    slot = np.concatenate([np.arange(len(r.words)) for r in model])
    order = np.argsort(known)
    known, slot = np.append(known[order], np.uint64(0)), np.append(slot[order], COMMON_WORDS)
    place = np.full(len(share), -1)
    place[rows] = np.arange(len(rows))
    owner = np.repeat(place, c.n_words)
    mine = owner >= 0
    owner = owner[mine]
    word = mix((bare[c.code[mine]] if len(c.code) else np.zeros(0, np.uint64)) + mix((which[owner] + 1).astype(np.uint64)))
    at = np.searchsorted(known[:-1], word)
    to = np.where(known[at] == word, slot[at], COMMON_WORDS)
    seen = np.bincount(owner * size + to, minlength=len(rows) * size).reshape(len(rows), size) / np.maximum(c.n_words[rows], 1)[:, None]
    shares = np.zeros((len(model), size))
    for i, r in enumerate(model):
        shares[i, : len(r.shares)], shares[i, -1] = r.shares, r.rest
    return by_class, distance(seen, shares[which])


def divergences(c: Counts, references_: pa.Array, nearest: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class distance, characters, word distance) of each text from its reference, or where that is null from the nearest."""
    n = len(c.n_words)
    classes = _class_counts(c.data, c.offsets)
    chars = classes.sum(1)
    share = classes / np.maximum(chars, 1)[:, None]
    bare = hashes(pa.array(_bare(c.distinct), pa.binary()))
    by_class, by_word = np.zeros(n), np.zeros(n)
    coded = references_.dictionary_encode()
    which = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    own, none = np.flatnonzero(which >= 0), np.flatnonzero(which < 0)
    if len(own):
        by_class[own], by_word[own] = _distances(c, share, bare, own, which[own], [Reference.unpacked(x) for x in coded.dictionary.to_pylist()])
    if len(none) and nearest:
        each = [_distances(c, share, bare, none, np.zeros(len(none), np.int64), [Reference.unpacked(x)]) for x in nearest]
        by_class[none], by_word[none] = np.min([x for x, _ in each], 0), np.min([x for _, x in each], 0)
    return by_class, chars, by_word


def _verdicts(texts: pa.Array, references_: pa.Array, nearest: list[bytes]) -> tuple[Counts, np.ndarray, np.ndarray, np.ndarray]:
    c = rule_counts(texts)
    by_class, chars, by_word = divergences(c, references_, nearest)
    off = (by_class > CLASS_DISTANCE + CLASS_SLACK / np.sqrt(np.maximum(chars, 1))) & (chars >= CLASS_LEAST) | (by_word > WORD_DISTANCE) & (c.n_words >= WORD_LEAST)
    return c, by_class, by_word, ~c.failed & ~off


def judge(df: DataFrame, model: References, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """One row for each row: the rule counts, both distances, base_failed and kept."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    nearest = model.nearest  # MOST_LANGUAGES small rows at most

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1):
                c, by_class, by_word, kept = _verdicts(part.column(1), part.column(2), nearest)
                columns = [part.column(0), *(pa.array(getattr(c, x), pa.int64()) for x in names), pa.array(by_class), pa.array(by_word), pa.array(c.failed), pa.array(kept)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", *names, "class_distance", "word_distance", "base_failed", "kept"])

    schema = f"id long, {', '.join(f'{x} long' for x in names)}, class_distance double, word_distance double, base_failed boolean, kept boolean"
    rows = df.selectExpr(f"`{id_column}` as id", f"`{text_column}` as text", f"`{lang_column}` as lang").join(model.table, F.col("lang") == F.col("of"), "left")
    return rows.select("id", "text", "reference").mapInArrow(lean(run), schema).withColumnRenamed("id", id_column)


def quality(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """Learn the references from the table and judge all its rows."""
    return judge(df, references(df, text_column, lang_column), id_column, text_column, lang_column)


def keep(df: DataFrame, text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """The rows, with all their columns, that the rules keep."""
    model = references(df, text_column, lang_column)
    nearest, n, longest = model.nearest, len(df.columns), max(map(len, df.columns))
    of, reference = ("_" * longest + x for x in ("of", "reference"))  # names that no column has

    def run(batches):
        for batch in batches:
            text = batch.schema.get_field_index(text_column)
            for part in slices(batch, text):
                yield part.filter(pa.array(_verdicts(part.column(text), part.column(n), nearest)[-1])).select(range(n))

    rows = df.join(model.table.select(F.col("of").alias(of), F.col("reference").alias(reference)), F.col(f"`{lang_column}`") == F.col(of), "left").drop(of)
    return rows.mapInArrow(lean(run), df.schema)
