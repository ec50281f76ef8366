"""Detection of periodic runs of words, in tiles by scale.

A run is a stretch of words with smallest period q, of 12 words and of 2 * q at least, that can't be made longer with that period.
For each octave of periods P to 2 * P - 1 (P a power of two) a text has boundaries at the multiples of P. The places i at which
word i equals word i + q, over a run, are a stretch of at least q words, so some boundary b lies in it; from there the Z-function
of the words after b, and that of the reversed words before it, give how far equality goes on either side for all periods of the
octave, cut at P words. Neighbouring boundaries inside one run give fragments that touch.

The steps are Spark's: texts are exploded into tiles (a few boundaries of one octave, with the words that they look at; tiles
of neighbours overlap), tiles are spread over tasks and solved by themselves, fragments go by text and period to be stitched,
and runs go back to their texts. A boundary makes no tile where no window of words recurs at a distance within the octave, as one
of both sides is at least half as long as a run needs; equal windows have equal hashes, so none is lost. A period whose first q
words repeat a shorter one that divides it isn't the smallest, and gives no fragment.

Null text has no words and no runs. Null ids are keys like others; repeated rows are told apart by a number of their own and
have equal results. A text of one row is one task's work in the first and last step only. An empty table gives no rows; only
the named id and text columns are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from bidloom.llm.common import buffer, hashes, lean, materialise, mix, slices, small_batches, words

#: Least words of a run.
LEAST = 12
#: Words between the first and last boundary of a tile; an octave of longer periods has a boundary to a tile.
TILE = 4096
#: Words of a text whose boundaries are compared at once.
PART = 1 << 18

TILES = "array<struct<octave:int,first:bigint,begin:bigint,finish:bigint,words:binary>>"
FRAGMENT = "row long, period long, begin long, finish long"


def longer(window: np.ndarray, n: int) -> np.ndarray:
    """Hashes of windows of 2 * n words from those of n; windows over the end stand for what is there and are looked at by nobody."""
    return mix(window * np.uint64(0xA0761D6478BD642F) + np.concatenate([window[n:], window[: min(n, len(window))]]))


def needed(octave: int) -> int:
    """Words, a power of two, that recur on one side of a boundary of a run at least."""
    least = min(max(q, LEAST - q) for q in range(octave, 2 * octave)) if octave < LEAST else octave
    return 1 << ((least + 1) // 2).bit_length() - 1


def lively(window: np.ndarray, size: int, octave: int) -> np.ndarray:
    """Boundaries of a text where a window of ``size`` words recurs at a distance of the octave."""
    total = len(window)
    out = []
    for a in range(0, total - octave, max(octave, PART)):  # a bounded part of a long text at a time
        at = np.arange(a, min(a + max(octave, PART), total - octave), octave)
        far = at[:, None] + octave + np.arange(octave)
        after = (window[np.minimum(far, total - 1)] == window[at][:, None]) & (far + size <= total)
        before = (window[np.minimum(far - size, total - 1)] == window[np.maximum(at - size, 0)][:, None]) & (at[:, None] >= size) & (far <= total)
        out.append(at[(after | before).any(1)])
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def tiles_of(code: np.ndarray, word_hash: np.ndarray, of: np.ndarray) -> list[list[dict]]:
    """The tiles of each text: boundaries from ``first`` to ``finish`` of an octave, and the words they look at, from ``begin`` on."""
    out: list[list[dict]] = [[] for _ in of[1:]]
    size, octave, window, at_hand = np.diff(of), 1, word_hash, 1
    small = {1: word_hash}
    while len(rows := np.flatnonzero(size >= max(LEAST, 2 * octave))):
        need = needed(octave)
        while at_hand < need:
            window, at_hand = longer(window, at_hand), 2 * at_hand
            if at_hand < LEAST // 2:
                small[at_hand] = window
        own_window = small.get(need, window)
        for row in rows.tolist():
            start, total = int(of[row]), int(size[row])
            at = lively(own_window[start : start + total], need, octave)
            if len(at):
                cut = np.flatnonzero((np.diff(at) != octave) | (np.diff(at // max(TILE, octave)) != 0)) + 1
                for own in np.split(at, cut):
                    first, last = int(own[0]), int(own[-1])
                    begin, end = max(0, first - octave), min(total, last + 3 * octave)
                    out[row].append({"octave": octave, "first": first, "begin": begin, "finish": last, "words": code[start + begin : start + end].astype("<i4").tobytes()})
        octave *= 2
    return out


def z_function(s: list[int], upto: int) -> list[int]:
    """For each place before ``upto``, how long what follows it agrees with the beginning."""
    n = len(s)
    z = [0] * min(upto, n)
    left = right = 0
    for i in range(1, len(z)):
        k = min(right - i, z[i - left]) if i < right else 0
        if i + k >= right:
            while i + k < n and s[k] == s[i + k]:
                k += 1
            left, right = i, i + k
        z[i] = k
    return z


def primitive(z: list[int], q: int) -> bool:
    """Whether the first q words repeat no shorter period that divides q."""
    for d in range(1, int(q**0.5) + 1):
        if q % d == 0:
            for p in (d, q // d):
                if p < q and z[p] >= q - p:
                    return False
    return True


def solve(octave: int, first: int, begin: int, finish: int, own: list[int]) -> list[tuple[int, int, int]]:
    """(period, begin, finish) of fragments: places in a text at which words are equal to those a period on. Those of neighbouring
    boundaries that touch are one."""
    out: list[tuple[int, int, int]] = []
    last: dict[int, int] = {}  # a period's latest fragment
    for b in range(first, finish + 1, octave):
        at = b - begin
        ahead = own[at : at + 3 * octave]
        z = z_function(ahead, 2 * octave)
        low = max(0, at - octave)
        mirror = own[low:at][::-1]
        edge = min(len(own), at + 2 * octave - 1)
        back = z_function([*mirror, -1, *own[low:edge][::-1]], len(mirror) + 1 + edge - low)
        for q in range(octave, min(2 * octave, len(own) - at + 1)):
            f = min(z[q], octave) if q < len(z) else 0
            place = len(mirror) + 1 + edge - (at + q)
            k = back[place] if mirror and at + q <= edge else 0
            if f + k and (f >= octave or k >= octave or f + k >= max(q, LEAST - q)) and (q > len(ahead) or primitive(z, q)):
                if (i := last.get(q)) is not None and b - k <= out[i][2]:
                    out[i] = (q, out[i][1], b + f)
                else:
                    last[q] = len(out)
                    out.append((q, b - k, b + f))
    return out


def changed(n: int, g: int) -> np.ndarray:
    """Where the words of a text of n words come from, when those from g % n on repeat a part of it."""
    at = np.arange(n)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at[a:] = a + (at[a:] - a) % p
    return at


def sources(of: np.ndarray, plant: list[int | None]) -> np.ndarray:
    """For each word of a slice, the word that stands there: itself, or where its text is changed another."""
    out = np.arange(of[-1])
    for row, g in enumerate(plant):
        a, b = int(of[row]), int(of[row + 1])
        if g is not None and b > a:
            out[a:b] = a + changed(b - a, g)
    return out


def _digest(kept: np.ndarray, of: np.ndarray, code: np.ndarray, distinct: pa.Array) -> list[str]:
    """Hashes of each text's kept words, joined by a space."""
    upto = np.concatenate([[0], np.cumsum(kept)])[of]
    many = pa.LargeListArray.from_arrays(pa.array(upto, pa.int64()), distinct.take(pa.array(code[kept])).cast(pa.large_binary()))
    joined = pc.binary_join(many, pa.scalar(b" ", pa.large_binary()))
    return [hashlib.sha256(x.as_buffer()).hexdigest() for x in joined]


def explode(df: DataFrame, plant: Column | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(row, id, plant, text, n_words, collapsed_sha256, tiles): a text without tiles has no runs, so its hash is known and its text isn't kept.

    ``plant`` is a number that changes a text by the rule of ``changed``, or null.
    """

    def run(batches):
        for batch in batches:
            for part in slices(batch, 3):
                of, code, distinct = words(*buffer(part.column(3)))
                code = code[sources(of, part.column(2).to_pylist())].astype(np.int64)
                found = tiles_of(code, hashes(distinct)[code], of)
                clean = np.array([not x for x in found])
                digest = _digest(np.repeat(clean, np.diff(of)), of, code, distinct)
                tiles = pa.array(found, pa.list_(pa.struct([("octave", pa.int32()), ("first", pa.int64()), ("begin", pa.int64()), ("finish", pa.int64()), ("words", pa.binary())])))
                texts = part.column(3).take(pa.array(np.arange(part.num_rows), mask=clean))  # null where clean
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), texts, pa.array(np.diff(of), pa.int64()), pa.array(digest, mask=~clean), tiles], names=names)

    kind = df.select(id_column).schema[0].dataType.simpleString()
    schema = f"row long, id {kind}, plant long, text string, n_words long, collapsed_sha256 string, tiles {TILES}"
    names = StructType.fromDDL(schema).names
    small_batches(df.sparkSession)
    asked = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("id"), (F.lit(None) if plant is None else plant).cast("long").alias("plant"), F.col(text_column).alias("text"))
    return asked.mapInArrow(lean(run), schema)


def fragments(exploded: DataFrame) -> DataFrame:
    """(row, period, begin, finish) of all tiles, spread over tasks whatever text they are of."""

    def run(batches):
        for batch in batches:
            row, *columns = (c.to_pylist() for c in batch.columns)
            out = [(r, *x) for r, octave, first, begin, finish, raw in zip(row, *columns, strict=True) for x in solve(octave, first, begin, finish, np.frombuffer(raw, "<i4").tolist())]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(4)], names=["row", "period", "begin", "finish"])

    tiles = exploded.where(F.size("tiles") > 0).select("row", F.explode("tiles").alias("tile")).select("row", "tile.*")
    # A number of its own keeps small tables from being dealt to few tasks: tiles are few bytes and much work.
    parts = int(exploded.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return tiles.repartition(parts, "row", "octave", "first").mapInArrow(lean(run), FRAGMENT)


def stitched(found: DataFrame) -> DataFrame:
    """(row, start, period, length) of all runs: fragments of one text and period that touch, joined."""
    own = Window.partitionBy("row", "period").orderBy("begin", "finish")
    reach = F.max("finish").over(own.rowsBetween(Window.unboundedPreceding, -1))
    marked = found.withColumn("new", F.coalesce((F.col("begin") > reach).cast("long"), F.lit(1)))
    stretches = marked.withColumn("stretch", F.sum("new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    whole = stretches.groupBy("row", "period", "stretch").agg(F.min("begin").alias("start"), F.max("finish").alias("finish"))
    length = F.col("finish") - F.col("start") + F.col("period")
    return whole.where(length >= F.greatest(F.lit(LEAST), 2 * F.col("period"))).select("row", "start", "period", length.alias("length"))


def find_runs(df: DataFrame, plant: Column | None = None, id_column: str = "doc_id", text_column: str = "text") -> tuple[DataFrame, DataFrame]:
    """The exploded texts, stored, and (row, runs): each text's runs by start and period, for texts that have one."""
    exploded = materialise(explode(df, plant, id_column, text_column), "tiles")
    runs = stitched(fragments(exploded)).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    return exploded, runs


def runs_of(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row (id, n_words, runs array<struct<start, period, length>>) for each row."""
    exploded, runs = find_runs(df, None, id_column, text_column)
    found = exploded.select("row", F.col("id").alias(id_column), "n_words").join(runs, "row", "left")
    return found.select(id_column, "n_words", F.coalesce("runs", F.expr("array()").cast("array<struct<start:bigint,period:bigint,length:bigint>>")).alias("runs"))


def digest(df: DataFrame, plant: Column | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row (id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) for each row.

    The run named is the longest (of equal ones the first, then that of the smallest period). The collapsed text keeps the
    first period of every run and drops the rest of it.
    """

    def run(batches):
        for batch in batches:
            for part in slices(batch, 2):
                of, code, distinct = words(*buffer(part.column(2)))
                code = code[sources(of, part.column(1).to_pylist())]
                kept = np.ones(len(code), bool)
                hashed = []
                for row, own in enumerate(part.column(3).to_pylist()):
                    for x in own or []:
                        begin = of[row] + x["start"]
                        kept[begin + x["period"] : begin + x["length"]] = False
                    hashed.append(hashlib.sha256("".join(f"{x['start']},{x['length']},{x['period']}\n" for x in own or []).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(3), pa.array(hashed), pa.array(_digest(kept, of, code, distinct))], names=names)

    exploded, runs = find_runs(df, plant, id_column, text_column)
    kind = exploded.schema["id"].dataType.simpleString()
    struct = "array<struct<start:bigint,period:bigint,length:bigint>>"
    schema = f"id {kind}, runs {struct}, runs_sha256 string, collapsed_sha256 string"
    names = StructType.fromDDL(schema).names
    tiled = F.col("collapsed_sha256").isNull()
    own = exploded.where(tiled).select("row", "id", "plant", "text").join(runs, "row", "left").select("id", "plant", "text", "runs").mapInArrow(lean(run), schema)
    rest = exploded.where(~tiled).select("id", F.lit(None).cast(struct).alias("runs"), F.lit(hashlib.sha256(b"").hexdigest()).alias("runs_sha256"), "collapsed_sha256")
    longest = F.expr("array_max(transform(runs, x -> struct(x.length as length, -x.start as start, -x.period as period)))")
    found = own.union(rest).withColumn("top", longest)
    return found.select(
        F.col("id").alias(id_column),
        F.coalesce(F.size("runs"), F.lit(0)).cast("long").alias("n_runs"),
        (-F.col("top.start")).alias("start"),
        F.col("top.length").alias("length"),
        (-F.col("top.period")).alias("period"),
        F.expr("1000 * top.length div -top.period").alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )


def planted(id_column: str = "doc_id") -> Column:
    """The number that changes a text, from its id: a tenth of crc32(id as text) where that divides by ten; null else."""
    h = F.crc32(F.col(id_column).cast("string").cast("binary"))
    return F.when(h % 10 == 0, F.floor(h / 10))
