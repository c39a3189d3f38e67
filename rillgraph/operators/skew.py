"""Joins and groupings that stay even when a few keys hold most rows.

A key is *hot* if it holds at least one row in ``SHARE``; there can be no more
than ``SHARE`` such keys however large the table is, which is the bound that
makes the list of hot keys safe to collect and to broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Hot keys hold at least 1 / SHARE of the rows, so there are at most SHARE.
SHARE = 1000


def hot_keys(counts: DataFrame, key: str, n: str, total: int, share: int = SHARE) -> list[tuple[int, int]]:
    """``(key, salts)`` of the hot keys in a table of counts by key; at most ``share`` of them."""
    least = max(1, -(-total // share))
    if total <= share:
        return []
    rows = counts.filter(F.col(n) >= least).select(key, n).collect()
    return [(r[0], -(-r[1] // least)) for r in rows]


def hot_table(spark: SparkSession, hot: list[tuple[int, int]], key: str) -> DataFrame:
    schema = T.StructType([T.StructField(key, T.LongType()), T.StructField("__salts", T.IntegerType())])
    return spark.createDataFrame([(int(k), int(s)) for k, s in hot], schema)


def add_salt(df: DataFrame, key: str, spread: Column, hot: list[tuple[int, int]]) -> DataFrame:
    """Adds ``__salt``: 0, or for a hot ``key`` one of its salts picked by the hash of ``spread``."""
    if not hot:
        return df.withColumn("__salt", F.lit(0))
    h = F.broadcast(hot_table(df.sparkSession, hot, "__hot"))
    out = df.join(h, F.col(key) == F.col("__hot"), "left")
    salt = F.when(F.col("__salts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(spread), F.col("__salts")).cast("int"))
    return out.withColumn("__salt", salt).drop("__hot", "__salts")


def explode_salts(df: DataFrame, key: str, hot: list[tuple[int, int]]) -> DataFrame:
    """The other side of :func:`add_salt`: one copy of a row for each salt of its key."""
    if not hot:
        return df.withColumn("__salt", F.lit(0))
    h = F.broadcast(hot_table(df.sparkSession, hot, "__hot"))
    out = df.join(h, F.col(key) == F.col("__hot"), "left")
    return out.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1))).drop("__hot", "__salts")


def salted_join(left: DataFrame, right: DataFrame, key: str, spread: Column, hot: list[tuple[int, int]], how: str = "inner") -> DataFrame:
    """``left`` join ``right`` on ``key`` (unique in ``right``), the hot keys of ``left`` spread over their salts."""
    if not hot:
        return left.join(right, key, how)
    return add_salt(left, key, spread, hot).join(explode_salts(right, key, hot), [key, "__salt"], how).drop("__salt")
