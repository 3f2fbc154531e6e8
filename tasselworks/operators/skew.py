"""Joins that stay balanced when one key holds a large part of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key with more rows than this is hot, whatever the input's size; one task handles any other.
HOT_ROWS = 200_000


def hot_keys(counted: DataFrame, key: str, count: str, most: int | None = None) -> DataFrame | None:
    """The keys with more than HOT_ROWS rows as a frame (``key``), None if there are none.

    At most total/HOT_ROWS of them exist, by counting: 500 000 keys, some 10 MB, in a table of 10^11 rows. ``most``,
    the largest count if it is known by now, saves the look.
    """
    if most is not None and most <= HOT_ROWS:
        return None
    hot = counted.where(F.col(count) > HOT_ROWS).select(key)
    return None if hot.isEmpty() else hot


def hot_join(many: DataFrame, one: DataFrame, key: str, hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """Join ``many`` (any rows a key) with ``one`` (one row a key) on ``key``.

    Rows of hot keys meet their partner by a broadcast of the hot partners only (bounded as ``hot`` is), all others by
    a shuffle. ``how`` is inner or left. Null keys have no partner.
    """
    if hot is None:
        return many.join(one, key, how)
    hot = F.broadcast(hot)
    few = F.broadcast(one.join(hot, key, "left_semi"))
    return many.join(hot, key, "left_semi").join(few, key, how).unionByName(many.join(hot, key, "left_anti").join(one, key, how))


def salted_join(left: DataFrame, right: DataFrame, key: str | list[str], salts: int, salt_on: Column, how: str = "inner") -> DataFrame:
    """Inner or left join of two sides that may both hold many rows of one key.

    Every left row gets one of ``salts`` numbers from ``salt_on`` (a hash of a left column), every right row is
    repeated for all of them; a key's rows then spread over ``salts`` tasks. The result has each pair once.
    """
    keys = [key] if isinstance(key, str) else list(key)
    if salts <= 1:
        return left.join(right, keys, how)
    lhs = left.withColumn("__salt", F.pmod(salt_on, F.lit(salts)).cast("int"))
    rhs = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return lhs.join(rhs, [*keys, "__salt"], how).drop("__salt")
