"""Frequency sketches as tables ``(row, bucket, cnt)``.

A sketch has ``depth`` rows of ``width`` counters, ``width`` a power of two.
Counters combine on the map side, so a stream of any length shuffles at most
``width * depth`` rows a task; merging is a union and a sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashing import with_wang

WIDTH, DEPTH = 262_144, 8


def _cells(keys: DataFrame, key: str, width: int, depth: int, first: int = 0) -> DataFrame:
    if width & (width - 1):
        raise ValueError("width must be a power of two")
    rows = keys.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(depth - 1))))
    return with_wang(rows, F.col(key).bitwiseXOR((F.col("row") + first).cast("long")), "__h")


def cells(keys: DataFrame, key: str, width: int, depth: int) -> DataFrame:
    """The rows of ``keys`` once for each row of a sketch, with ``row`` and ``bucket``."""
    return _cells(keys, key, width, depth).withColumn("bucket", F.col("__h").bitwiseAND(width - 1).cast("int")).drop("__h")


def _signed(keys: DataFrame, key: str, width: int, depth: int) -> DataFrame:
    found = cells(keys, key, width, depth)
    signs = with_wang(found, F.col(key).bitwiseXOR((F.col("row") + depth).cast("long")), "__h")
    return signs.withColumn("sign", F.when(F.col("__h").bitwiseAND(1) == 0, 1).otherwise(-1)).drop("__h")


def count_min(keys: DataFrame, key: str, width: int = WIDTH, depth: int = DEPTH) -> DataFrame:
    """The count-min sketch of a column; nulls do not count.  Keys are first counted, so a frequent key is hashed once a task."""
    n = keys.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return cells(n, key, width, depth).groupBy("row", "bucket").agg(F.sum("n").alias("cnt"))


def count_min_estimate(sketch: DataFrame, keys: DataFrame, key: str, width: int = WIDTH, depth: int = DEPTH) -> DataFrame:
    """``(key, estimate)`` of each distinct key: the least of its counters, never below the true count."""
    found = cells(keys.select(key).filter(F.col(key).isNotNull()).distinct(), key, width, depth).join(F.broadcast(sketch) if width * depth <= 1 << 21 else sketch, ["row", "bucket"], "left")
    return found.groupBy(key).agg(F.min(F.coalesce("cnt", F.lit(0))).alias("estimate"))


def count_sketch(keys: DataFrame, key: str, width: int = WIDTH, depth: int = DEPTH) -> DataFrame:
    """The count sketch of a column: counters with random signs."""
    n = keys.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return _signed(n, key, width, depth).groupBy("row", "bucket").agg(F.sum(F.col("n") * F.col("sign")).alias("cnt"))


def count_sketch_estimate(sketch: DataFrame, keys: DataFrame, key: str, width: int = WIDTH, depth: int = DEPTH) -> DataFrame:
    """``(key, estimate)``: the median of its signed counters, for an even depth the mean of the middle two rounded down."""
    found = _signed(keys.select(key).filter(F.col(key).isNotNull()).distinct(), key, width, depth).join(F.broadcast(sketch) if width * depth <= 1 << 21 else sketch, ["row", "bucket"], "left")
    values = found.groupBy(key).agg(F.sort_array(F.collect_list(F.coalesce("cnt", F.lit(0)) * F.col("sign"))).alias("s"))
    mid = F.element_at("s", depth // 2 + 1) if depth % 2 else F.floor((F.element_at("s", depth // 2) + F.element_at("s", depth // 2 + 1)) / 2)
    return values.select(key, mid.cast("long").alias("estimate"))


def merge(*sketches: DataFrame) -> DataFrame:
    """The sketch of all streams together."""
    return _union(sketches).groupBy("row", "bucket").agg(F.sum("cnt").alias("cnt"))


def merge_disjoint(*sketches: DataFrame) -> DataFrame:
    """The larger of each counter, for streams that share no key."""
    return _union(sketches).groupBy("row", "bucket").agg(F.max("cnt").alias("cnt"))


def _union(sketches: tuple[DataFrame, ...]) -> DataFrame:
    out = sketches[0]
    for s in sketches[1:]:
        out = out.unionByName(s)
    return out


def equal(a: DataFrame, b: DataFrame) -> bool:
    a, b = a.filter("cnt <> 0").select("row", "bucket", "cnt"), b.filter("cnt <> 0").select("row", "bucket", "cnt")
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def watermarks(sketch: DataFrame) -> DataFrame:
    return sketch.agg(F.max("cnt").alias("high"), F.min("cnt").alias("low"))


def replicas(estimate: str | Column, threshold: int) -> Column:
    """Replicas of a vertex: one, and one more for each full ``threshold`` of its estimated degree."""
    return (F.floor((F.col(estimate) if isinstance(estimate, str) else estimate) / F.lit(threshold)) + 1).cast("int")
