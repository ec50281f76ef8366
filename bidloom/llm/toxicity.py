"""Toxicity by a counterfactual-regularised classifier.

Features are the words of a text and their first four to six characters, each present or not, so length doesn't matter. On a
bounded sample of labelled rows, Spark counts each feature's documents by label and the ``features`` most telling ones
(chi-square) are kept, and with them those of all identity terms. A logistic model over them is then fitted with a second
penalty over counterfactual pairs: each sample text that mentions an identity group with itself after swapping the term for
another group's, and a bounded share of all sample texts (``MENTIONS``) with themselves and a group's term put in. The square of
the difference of a pair's scores (as log-odds) is added to the loss. So a neutral mention of a group doesn't move the score,
also where the sample mentions none.

Null and empty texts have no features and score by the intercept. Labels that are null are left out, several labels of an id
count as the highest, of several texts of an id the one with the smallest hash is learned from, repeated rows get repeated
scores, and an empty table gives no rows. Without any label of either kind the score is the same for all. Only the id and text
columns are read.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidloom.llm.common import buffer, discard, lean, materialise, slices, words

#: The labelled rows that are fitted on (those with the smallest hash of the id), the features kept, and the two penalties.
SAMPLE_ROWS = 20_000
FEATURES = 2048
RIDGE, COUNTERFACTUAL = 2e-5, 1.0
STEPS = 250
#: Sample texts that get a group's term put in, at most; each of the terms is put into as many of them.
MENTIONS = 4000
MARKS = b".,;:!?-()[]\"'#*$%&|<>"
PREFIXES = (4, 5, 6)

#: Terms of identity groups; a swap replaces a term by the next of its row.
IDENTITY = [
    "muslim christian jewish hindu buddhist atheist", "muslims christians jews hindus buddhists atheists", "black white asian latino arab", "gay straight lesbian bisexual transgender",
    "women men", "woman man", "female male", "girls boys", "girl boy", "immigrants natives", "immigrant native", "disabled abled", "african european american mexican chinese indian",
    "musulman chrétien juif bouddhiste athée", "musulmans chrétiens juifs bouddhistes athées", "femmes hommes", "femme homme", "noirs blancs", "noir blanc", "filles garçons", "immigrés natifs",
    "muslime christen juden buddhisten atheisten", "muslimisch christlich jüdisch buddhistisch", "frauen männer", "frau mann", "schwarze weiße", "mädchen jungen", "ausländer inländer",
    "musulmán cristiano judío budista ateo", "musulmanes cristianos judíos budistas ateos", "mujeres hombres", "mujer hombre", "negros blancos", "niñas niños", "inmigrantes nativos",
]
SWAP = {a.encode(): b.encode() for row in IDENTITY for a, b in zip(row.split(), [*row.split()[1:], row.split()[0]], strict=True)}


TERMS = tuple(dict.fromkeys(SWAP))


class Model(NamedTuple):
    """Feature hashes with their weights, and the intercept."""

    weights: dict[int, float]
    intercept: float


def bare(word: bytes) -> bytes:
    """A word without marks at its ends, in lower case."""
    return word.strip(MARKS).decode(errors="replace").lower().encode()


def features(word: bytes) -> list[int]:
    """Hashes of a bare word and its beginnings."""
    if not word:
        return []
    text = word.decode(errors="replace")
    parts = [b"w" + word, *(b"p" + text[:n].encode() for n in PREFIXES if len(text) >= n)]
    return [xxhash.xxh3_64_intdigest(x) >> 1 for x in parts]


def _present(texts: pa.Array, swap: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, word code) pairs that occur, as two arrays, and for each code its bare word."""
    data, offsets = buffer(texts)
    of, code, distinct = words(data, offsets)
    plain = [bare(x) for x in distinct.to_pylist()]
    if swap:
        plain = [SWAP.get(x, x) for x in plain]
    width = max(len(plain), 1)
    pairs = np.unique(np.repeat(np.arange(len(offsets) - 1), np.diff(of)) * width + code)
    return pairs // width, pairs % width, plain


#: Words whose features a worker remembers.
REMEMBERED = 200_000


def _numbers(word: bytes, known: dict[int, int], memory: dict[bytes, tuple]) -> tuple:
    """The numbers of a word's known features."""
    if (found := memory.get(word)) is None:
        found = tuple(known[h] for h in features(word) if h in known)
        if len(memory) < REMEMBERED:
            memory[word] = found
    return found


def _hits(texts: pa.Array, known: dict[int, int], swap: bool = False, memory: dict[bytes, tuple] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, number) of the known features that each text has, in order."""
    text, code, plain = _present(texts, swap)
    memory = {} if memory is None else memory
    numbers = [_numbers(w, known, memory) for w in plain]
    many = np.fromiter(map(len, numbers), np.int64, len(numbers))
    flat = np.fromiter((x for n in numbers for x in n), np.int64, int(many.sum()))
    begin = np.cumsum(many) - many
    some = many[code] > 0
    text, code = text[some], code[some]
    size = many[code]
    at = np.repeat(begin[code] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    pairs = np.unique(np.repeat(text, size) * max(len(known), 1) + flat[at])
    return pairs // max(len(known), 1), pairs % max(len(known), 1)


def _rows(texts: pa.Array, known: dict[int, int], swap: bool = False) -> list[np.ndarray]:
    """For each text the sorted numbers of the known features that it has."""
    text, number = _hits(texts, known, swap)
    return np.split(number, np.searchsorted(text, np.arange(1, len(texts))))


def sample(df: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text, toxic) of the ``rows`` labelled ids with the smallest hash, one text of each. ``df`` has (id, text), ``labels`` (id, toxic)."""
    chosen = labels.where("id is not null and toxic is not null").groupBy("id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("id"), "id").limit(rows).select(F.col("id").alias("label_of"), "toxic")
    found = df.select("id", "text").join(F.broadcast(chosen), F.col("id") == F.col("label_of"))  # ``rows`` rows at most
    return found.groupBy("id", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("text", "toxic")


def select_features(labelled: DataFrame, count: int = FEATURES) -> list[int]:
    """The hashes of the ``count`` most telling features, ties by value."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 0):
                text, code, plain = _present(part.column(0))
                known: dict[int, int] = {}
                for w in plain:
                    for h in features(w):
                        known.setdefault(h, len(known))
                found = _rows(part.column(0), known)
                toxic = part.column(1).to_numpy()
                flat = np.concatenate(found)
                bad = np.repeat(toxic, [len(x) for x in found])
                total = np.bincount(flat, minlength=len(known))
                hit = np.bincount(flat[bad == 1], minlength=len(known))
                yield pa.RecordBatch.from_arrays([pa.array(list(known), pa.int64()), pa.array(total), pa.array(hit)], names=["feature", "n", "toxic"])

    counts = labelled.mapInArrow(lean(run), "feature long, n long, toxic long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("toxic").alias("t")).where("n >= 3")
    totals = labelled.agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).first()
    n, t = float(totals["n"]), float(totals["t"] or 0)
    if not 0 < t < n:
        return []
    expected = F.col("n") * (t / n)
    chi = (F.col("t") - expected) * (F.col("t") - expected) / (expected * (1 - t / n))
    return [r["feature"] for r in counts.orderBy(chi.desc(), "feature").limit(count).collect()]


def fit(texts: list[np.ndarray], toxic: np.ndarray, swapped: list[tuple[int, np.ndarray]], width: int, ridge: float = RIDGE, counterfactual: float = COUNTERFACTUAL) -> tuple[np.ndarray, float]:
    """Weights and intercept by gradient steps with momentum and per-weight scaling (Adam) over the whole sample, in which both
    labels have the same total weight."""
    row = np.repeat(np.arange(len(texts)), [len(x) for x in texts])
    col = np.concatenate(texts) if texts else np.zeros(0, np.int64)
    pair_row = np.repeat(np.arange(len(swapped)), [len(x) for _, x in swapped]) if swapped else np.zeros(0, np.int64)
    pair_col = np.concatenate([x for _, x in swapped]) if swapped else np.zeros(0, np.int64)
    own = np.array([i for i, _ in swapped], np.int64)
    w, n = np.zeros(width + 1), len(texts)
    share = np.clip(toxic.mean(), 1 / (n + 1), n / (n + 1))
    weight = np.where(toxic > 0, 0.5 / share, 0.5 / (1 - share)) / n
    one, two = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, STEPS + 1):
        z = np.bincount(row, w[col], n) + w[-1]
        slope = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - toxic) * weight
        if len(own):
            gap = z[own] - np.bincount(pair_row, w[pair_col], len(own)) - w[-1]
            push = 2 * counterfactual * gap / len(own)
            np.add.at(slope, own, push)
        grad = np.append(np.bincount(col, slope[row], width), slope.sum()) + ridge * np.append(w[:-1], 0)
        if len(own):
            grad[:-1] -= np.bincount(pair_col, push[pair_row], width)
            grad[-1] -= push.sum()
        one, two = 0.9 * one + 0.1 * grad, 0.99 * two + 0.01 * grad * grad
        w -= 0.15 * (1 - step / (STEPS + 1)) * (one / (1 - 0.9**step)) / (np.sqrt(two / (1 - 0.99**step)) + 1e-10)
    return w[:-1], float(w[-1])


def mentions(own: list[np.ndarray], known: dict[int, int], most: int = MENTIONS) -> list[tuple[int, np.ndarray]]:
    """(text, its features with a term put in) for evenly chosen texts, the terms in turn."""
    term = [np.array([known[h] for h in features(t) if h in known], np.int64) for t in TERMS]
    chosen = range(0, len(own), max(1, -(-len(own) // most)))
    return [(i, np.union1d(own[i], term[k % len(term)])) for k, i in enumerate(chosen)]


def train(df: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, count: int = FEATURES) -> Model:
    """A model from ``df`` (id, text) and ``labels`` (id, toxic); the driver gets the features of at most ``rows`` texts."""
    labelled = materialise(sample(df, labels, rows), "labelled")
    telling = select_features(labelled, count)
    if not telling:
        discard(labelled)
        return Model({}, 0.0)
    chosen = list(dict.fromkeys([*telling, *(h for term in TERMS for h in features(term))]))
    known = {h: i for i, h in enumerate(chosen)}

    def run(batches):
        for batch in batches:
            for part in slices(batch, 0):
                own, other = _rows(part.column(0), known), _rows(part.column(0), known, swap=True)
                kind = pa.list_(pa.int16())
                moved = [y if len(x) != len(y) or (x != y).any() else None for x, y in zip(own, other, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(own, kind), pa.array(moved, kind)], names=["toxic", "own", "swapped"])

    found = labelled.mapInArrow(lean(run), "toxic int, own array<short>, swapped array<short>").toArrow()
    discard(labelled)
    toxic = found.column("toxic").to_numpy().astype(float)
    own = [np.array(x, np.int64) for x in found.column("own").to_pylist()]
    swapped = [(i, np.array(x, np.int64)) for i, x in enumerate(found.column("swapped").to_pylist()) if x is not None]
    weights, intercept = fit(own, toxic, swapped + mentions(own, known), len(chosen))
    return Model(dict(zip(chosen, weights.tolist(), strict=True)), intercept)


def score(df: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, score) for each row; the score is the probability of the toxic label."""
    known = {h: i for i, h in enumerate(model.weights)}
    weights = np.array(list(model.weights.values()))

    def run(batches):
        memory: dict[bytes, tuple] = {}
        for batch in batches:
            for part in slices(batch, 1):
                text, number = _hits(part.column(1), known, memory=memory)
                z = (np.bincount(text, weights[number], part.num_rows) if len(text) else np.zeros(part.num_rows)) + model.intercept
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))))], names=["id", "score"])

    return df.selectExpr(f"`{id_column}` as id", f"`{text_column}` as text").mapInArrow(lean(run), "id long, score double").withColumnRenamed("id", id_column)
