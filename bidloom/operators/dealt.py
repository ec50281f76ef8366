"""Equality joins of keys of any size: a key's rows are dealt to blocks, so no task holds a key and no row holds a list."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block.
BLOCK = 512
#: Parts that a key's rows are counted in.
SALTS = 64


def _told(rows: DataFrame, keys: list[str], by: list[str], facts: DataFrame) -> DataFrame:
    """Rows with the facts (_of_keys, _salt, ...) of their key and salt."""
    same = reduce(Column.__and__, (F.col(k) == F.col(f"_of_{k}") for k in keys))
    return _salted(rows, by).join(facts.withColumnRenamed("_salt", "_of_salt"), same & (F.col("_salt") == F.col("_of_salt"))).drop(*(f"_of_{k}" for k in keys), "_of_salt", "_salt")


def _salted(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.withColumn("_salt", F.pmod(F.xxhash64(*by), F.lit(SALTS)))


def _counted(rows: DataFrame, keys: list[str], by: list[str], block: int) -> DataFrame:
    """(_of_keys, _salt, _blocks): in how many blocks a key's rows are dealt, for each salt that the key has. At most SALTS rows of a
    key come together."""
    parts = _salted(rows, by).groupBy(*(F.col(k).alias(f"_of_{k}") for k in keys), "_salt").agg(F.count("*").alias("_n"))
    many = F.sum("_n").over(Window.partitionBy(*(f"_of_{k}" for k in keys)))
    return parts.select(*(f"_of_{k}" for k in keys), "_salt", F.ceil(many / block).alias("_blocks"))


def dealt_join(one: DataFrame, two: DataFrame, keys: list[str], by_one: list[str], by_two: list[str], block: int = BLOCK) -> DataFrame:
    """The inner join of two tables on ``keys``, which stand once.

    A key's rows of ``two`` are dealt to blocks of about ``block`` rows by the hash of ``by_two``, and its rows of ``one``, dealt
    likewise by ``by_one``, meet each of those blocks: a task joins two blocks, and a row is sent as often as the other side has
    blocks. Null keys take no part. Other column names have to differ.
    """
    sizes_one, sizes_two = _counted(one, keys, by_one, block), _counted(two, keys, by_two, block)

    def wide(rows, by, own_sizes, other_sizes, own_name, other_name):
        blocks = other_sizes.select(*(F.col(f"_of_{k}").alias(f"_with_{k}") for k in keys), F.col("_blocks").alias("_others")).distinct()
        same = reduce(Column.__and__, (F.col(f"_of_{k}") == F.col(f"_with_{k}") for k in keys))
        facts = own_sizes.join(blocks, same).drop(*(f"_with_{k}" for k in keys))
        told = _told(rows, keys, by, facts)
        return told.withColumn(own_name, F.pmod(F.xxhash64(*by, F.lit(1)), F.col("_blocks"))).withColumn(other_name, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_others") - 1))).drop("_blocks", "_others")

    left = wide(one, by_one, sizes_one, sizes_two, "_x", "_y")
    right = wide(two, by_two, sizes_two, sizes_one, "_y", "_x")
    return left.join(right, [*keys, "_x", "_y"]).drop("_x", "_y")


def dealt_pairs(rows: DataFrame, keys: list[str], id_column: str, others: list[str], block: int = BLOCK) -> DataFrame:
    """Pairs of rows of equal keys (keys, a, b, others_a, others_b), a < b: rows of a key are dealt to blocks of about ``block`` and each
    pair of blocks meets once. Rows are unique by (keys, id); null keys take no part."""
    kept = rows.select(*keys, id_column, *others)
    return block_pairs(_told(kept, keys, [id_column], _counted(kept, keys, [id_column], block)), keys, id_column, others)


def block_pairs(rows: DataFrame, keys: list[str], id_column: str, others: list[str]) -> DataFrame:
    """The same of rows that say in how many ``_blocks`` their key is dealt."""
    own = F.pmod(F.xxhash64(id_column, F.lit(1)), F.col("_blocks"))
    one = rows.select(*keys, F.col(id_column).alias("a"), *(F.col(c).alias(f"{c}_a") for c in others), own.alias("_x"), F.explode(F.sequence(own, F.col("_blocks") - 1)).alias("_y"))
    two = rows.select(*keys, F.col(id_column).alias("b"), *(F.col(c).alias(f"{c}_b") for c in others), own.alias("_y"), F.explode(F.sequence(F.lit(0).cast("bigint"), own)).alias("_x"))
    met = one.join(two, [*keys, "_x", "_y"]).where((F.col("_x") != F.col("_y")) | (F.col("a") < F.col("b")))
    turned = F.col("a") > F.col("b")
    side = lambda c, x, y: F.when(turned, F.col(f"{c}{y}")).otherwise(F.col(f"{c}{x}"))
    return met.select(*keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), *(side(c, "_a", "_b").alias(f"{c}_a") for c in others), *(side(c, "_b", "_a").alias(f"{c}_b") for c in others))
