"""Running values within keys of any size: a key that holds a large part of all rows is spread over many tasks.

Rows are cut into segments by points in the order of (keys, order), as a range partitioning would. Only keys with several points,
which hold about a 128th of the rows or more, are cut; where there is none, all is one plain window. A value runs within (keys,
segment), and each later segment of a key adds what its earlier ones end with. There are at most as many such segments as points,
so what they carry is broadcast. Points come from a sample; they decide how even the segments are, never the result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, TimestampNTZType, TimestampType
from pyspark.sql.window import WindowSpec

#: Most segments, and rows of the sample that their limits come from.
PARTS = 128
SAMPLE = 20_000


def _sortable(rows: DataFrame, name: str) -> Column:
    """A column in a type whose values sort alike here and in Python, and can be written as literals."""
    kind = rows.schema[name].dataType
    if isinstance(kind, TimestampType):
        return F.unix_micros(name)
    return F.col(name).cast("string") if isinstance(kind, (DateType, TimestampNTZType)) else F.col(name)


class Cut:
    """The points of a table's order by (keys, order) at which large keys are cut."""

    def __init__(self, rows: DataFrame, keys: list[str], order: list[str], parts: int = PARTS, sample: int = SAMPLE):
        self.keys, columns = keys, [_sortable(rows, c).alias(f"c{i}") for i, c in enumerate([*keys, *order])]
        names = [f"c{i}" for i in range(len(columns))]
        kinds = [f.dataType for f in rows.select(*columns).schema]
        drawn = rows.select(*columns, F.xxhash64(*keys, *order, F.monotonically_increasing_id()).alias("draw")).orderBy("draw").limit(sample)
        found = sorted({tuple(r[c] for c in names) for r in drawn.select(*names).collect()}, key=lambda t: [(v is not None, v) for v in t])
        at = sorted({len(found) * i // parts for i in range(1, parts)} - {0}) if found else []
        drawn_points = [found[i] for i in at]
        held = Counter(p[: len(keys)] for p in drawn_points)
        self.points = [p for p in drawn_points if held[p[: len(keys)]] > 1]
        self._point = lambda p: F.struct(*(F.lit(v).cast(k).alias(n) for v, k, n in zip(p, kinds, names, strict=True)))
        self._row = F.struct(*columns)
        own = {p[: len(keys)] for p in self.points}
        key = F.struct(*columns[: len(keys)])
        #: Whether a row's key may lie in several segments.
        self.divided: Column = F.lit(False)
        if own:
            self.divided = key.isin(*(F.struct(*(F.lit(v).cast(k).alias(n) for v, k, n in zip(p, kinds, names, strict=False))) for p in own))

    def segment(self) -> Column:
        """The number of points at or before a row, found by a tree of comparisons."""

        def tree(low: int, high: int) -> Column:
            if low == high:
                return F.lit(low)
            middle = (low + high) // 2
            return F.when(self._row < self._point(self.points[middle]), tree(low, middle)).otherwise(tree(middle + 1, high))

        return tree(0, len(self.points))


def _same(left: DataFrame, keys: list[str]) -> Column:
    on = F.col("_segment") == F.col("_of_segment")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    return on


def running(rows: DataFrame, keys: list[str], order: list[str], values: dict[str, tuple[str, Column]], parts: int = PARTS) -> DataFrame:
    """The rows with running values up to and with each row: ``values`` gives a name and ("sum" | "max" | "last", column).

    "last" is the last value that isn't null. Rows that tie in ``order`` come one after another in any order. ``order`` columns are
    of plain types.
    """
    cut = Cut(rows, keys, order, parts)
    inputs = [f"_in_{n}" for n in values]
    wide = rows.select("*", *(c.alias(i) for i, (_, c) in zip(inputs, values.values(), strict=True)), cut.segment().alias("_segment"))
    upto = Window.partitionBy(*keys, *(["_segment"] if cut.points else [])).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    over = {"sum": F.sum, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}
    run = wide.select("*", *(over[fn](i).over(upto).alias(f"_own_{n}") for i, (n, (fn, _)) in zip(inputs, values.items(), strict=True)))
    if not cut.points:
        return run.select(*rows.columns, *(F.col(f"_own_{n}").alias(n) for n in values))
    before = _carried(wide.where(cut.divided), keys, order, [(n, fn, i) for i, (n, (fn, _)) in zip(inputs, values.items(), strict=True)])
    joined = run.join(F.broadcast(before), _same(run, keys), "left")  # at most a row for each point
    merge = {"sum": lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b), "max": lambda a, b: F.greatest(a, b), "last": lambda a, b: F.coalesce(a, b)}
    return joined.select(*rows.columns, *(merge[fn](F.col(f"_own_{n}"), F.col(f"_before_{n}")).alias(n) for n, (fn, _) in values.items()))


def _carried(wide: DataFrame, keys: list[str], order: list[str], values: list[tuple[str, str, str]]) -> DataFrame:
    """(_of_key..., _of_segment, _before_name...) for each segment of a key but its first."""
    place = F.struct(*order)
    ends = {"sum": F.sum, "max": F.max, "last": lambda i: F.max_by(i, F.when(F.col(i).isNotNull(), place))}
    total = wide.groupBy(*(F.col(k).alias(f"_of_{k}") for k in keys), F.col("_segment").alias("_of_segment")).agg(*(ends[fn](i).alias(f"_end_{n}") for n, fn, i in values))
    earlier = Window.partitionBy(*(f"_of_{k}" for k in keys)).orderBy("_of_segment").rowsBetween(Window.unboundedPreceding, -1)
    over = {"sum": F.sum, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}
    carried = total.select(*(f"_of_{k}" for k in keys), "_of_segment", *(over[fn](f"_end_{n}").over(earlier).alias(f"_before_{n}") for n, fn, _ in values), F.count("*").over(earlier).alias("_earlier"))
    return carried.where("_earlier > 0").drop("_earlier")


def previous(rows: DataFrame, keys: list[str], order: list[str], value: str, name: str, parts: int = PARTS) -> DataFrame:
    """The rows with the value of the row before them in their key, null for a key's first row."""
    cut = Cut(rows, keys, order, parts)
    if not cut.points:
        return rows.withColumn(name, F.lag(value).over(Window.partitionBy(*keys).orderBy(*order)))
    wide = rows.withColumn("_segment", cut.segment())
    by = Window.partitionBy(*keys, "_segment").orderBy(*order)
    run = wide.select("*", F.lag(value).over(by).alias("_own"), (F.row_number().over(by) == 1).alias("_first"))
    before = _carried(wide.where(cut.divided).withColumn("_in_v", F.struct(F.col(value).alias("v"))), keys, order, [("v", "last", "_in_v")])
    joined = run.join(F.broadcast(before), _same(run, keys), "left")
    return joined.select(*rows.columns, F.when(F.col("_first"), F.col("_before_v.v")).otherwise(F.col("_own")).alias(name))


def ranked(rows: DataFrame, keys: list[str], order: list[str], name: str, parts: int = PARTS) -> DataFrame:
    """The rows with their number within their key, from 1."""
    return running(rows, keys, order, {name: ("sum", F.lit(1).cast("bigint"))}, parts)


#: Rows of a tile of ``framed``.
TILE = 4096


def framed(rows: DataFrame, keys: list[str], number: str, before: int, after: int, columns: dict[str, Callable[[WindowSpec], Column]], size: int = TILE) -> DataFrame:
    """The rows with columns over at most ``before`` rows before and ``after`` rows after each one in its key.

    ``number`` counts a key's rows from 1 without gaps, as ``ranked`` gives it. ``columns`` makes each column from a window that is
    ordered by it. A key is cut into tiles of ``size`` rows; a row near an end of its tile is a guest in the next one too, so each
    tile has all that its own rows look at, and no task holds a key.
    """
    tile = lambda n: F.floor((n - 1) / size)
    n = F.col(number)
    sent = rows.select("*", F.explode(F.sequence(tile(F.greatest(n - after, F.lit(1))), tile(n + before))).alias("_tile"))
    window = Window.partitionBy(*keys, "_tile").orderBy(number)
    found = sent.select("*", *(make(window).alias(name) for name, make in columns.items()))
    return found.where(F.col("_tile") == tile(n)).drop("_tile")
