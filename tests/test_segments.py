"""Running values of hot keys against windows over whole keys."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from bidloom.operators import segments


def rows_of(spark, n=900, hot=0.9, seed=1):
    r = random.Random(seed)
    made = [(None if r.random() < 0.02 else 7 if r.random() < hot else r.randrange(30), r.randrange(n), i, None if r.random() < 0.3 else r.randrange(100)) for i in range(n)]
    return spark.createDataFrame(made, "k int, at int, id int, v int").repartition(5)


@pytest.mark.parametrize(("n", "parts"), [(900, 128), (900, 5), (40, 128), (0, 128)])
def test_running_values_are_those_of_whole_keys(spark, n, parts):
    rows = rows_of(spark, n)
    by = Window.partitionBy("k").orderBy("at", "id")
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    want = rows.select("*", F.sum("v").over(upto).alias("s"), F.max("v").over(upto).alias("m"), F.last("v", True).over(upto).alias("l"))
    got = segments.running(rows, ["k"], ["at", "id"], {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "l": ("last", F.col("v"))}, parts)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    want = rows.select("*", F.lag("v").over(by).alias("p"))
    assert sorted(map(tuple, segments.previous(rows, ["k"], ["at", "id"], "v", "p", parts).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    want = rows.select("*", F.row_number().over(by).alias("r"))
    assert sorted(map(tuple, segments.ranked(rows, ["k"], ["at", "id"], "r", parts).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_a_hot_key_is_spread(spark):
    rows = rows_of(spark)
    cut = segments.Cut(rows, ["k"], ["at", "id"], 16)
    sizes = [r["count"] for r in rows.where("k = 7").groupBy(cut.segment().alias("s")).count().collect()]
    assert len(sizes) >= 13 and max(sizes) < 120
    carried = segments._carried(rows.withColumn("_segment", cut.segment()).where(cut.divided).withColumn("_in_s", F.col("v")), ["k"], ["at", "id"], [("s", "sum", "_in_s")])
    assert carried.count() <= 16


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz", "date", "string", "decimal(12,2)"])
def test_orders_of_other_types(spark, kind):
    r = random.Random(3)
    made = [(r.randrange(3), str(datetime.date(2020, 1, 1) + datetime.timedelta(r.randrange(2000))) if "dec" not in kind else str(r.randrange(9000) / 4), i) for i in range(500)]
    rows = spark.createDataFrame(made, "k int, at string, id int").withColumn("at", F.col("at").cast(kind))
    want = rows.select("*", F.row_number().over(Window.partitionBy("k").orderBy("at", "id")).alias("r"))
    assert sorted(map(str, segments.ranked(rows, ["k"], ["at", "id"], "r", 9).collect())) == sorted(map(str, want.collect()))
