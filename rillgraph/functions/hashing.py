"""64-bit hashes as column expressions.

Spark's bigint is signed and its ANSI arithmetic raises on overflow.  Whether an
operator does so is settled when it is analysed, so the hashes are analysed with
ANSI arithmetic off and then wrap modulo 2^64 wherever they run.  Written as
products they name each operand once or twice: one small expression that compiles.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of an agent's id in a packed virtual agent.
AGENT_BITS = 49
#: Multipliers of the published 64-bit finaliser with two multiplications.
FINALISER = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


@contextmanager
def wrapping(spark: SparkSession) -> Iterator[None]:
    """Expressions analysed inside wrap around instead of raising on overflow."""
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def _times(h: Column, factor: int) -> Column:
    return h * F.lit(factor - (1 << 64) if factor >> 63 else factor).cast("long")


def _shifted(h: Column, bits: int) -> Column:
    return h.bitwiseXOR(F.shiftrightunsigned(h, bits))


def with_wang(df: DataFrame, key: str | Column, out: str = "h") -> DataFrame:
    """Adds ``out``, the 64-bit mix of ``key`` as a signed bigint; null for a null key.

    The steps are fixed by the published definition, shifts and sums of Thomas
    Wang's 64-bit mix: not h plus h shifted by 21, xor by 24, times 265, xor by
    14, times 21, xor by 28, plus h shifted by 31.
    """
    with wrapping(df.sparkSession):
        h = (F.col(key) if isinstance(key, str) else key).cast("long")
        h = _shifted(_times(h, (1 << 21) - 1) - 1, 24)
        h = _shifted(_times(h, 265), 14)
        return df.withColumn(out, _times(_shifted(_times(h, 21), 28), (1 << 31) + 1))


def wang_of(keys: np.ndarray) -> np.ndarray:
    """The hash of :func:`with_wang` of an array of unsigned 64-bit keys."""
    u = np.uint64
    h = keys * u((1 << 21) - 1) - u(1)
    h = (h ^ h >> u(24)) * u(265)
    h = (h ^ h >> u(14)) * u(21)
    return (h ^ h >> u(28)) * u((1 << 31) + 1)


def with_finaliser(df: DataFrame, key: str | Column, out: str = "h") -> DataFrame:
    """Adds ``out``, the other 64-bit hash of ``key``: xor by shifts of 30, 27 and 31 with a multiplication after each of the first two."""
    with wrapping(df.sparkSession):
        h = (F.col(key) if isinstance(key, str) else key).cast("long")
        return df.withColumn(out, _shifted(_times(_shifted(_times(_shifted(h, 30), FINALISER[0]), 27), FINALISER[1]), 31))


def unsigned(h: str | Column) -> Column:
    """The unsigned value of a hash, as decimal(20,0)."""
    c = F.col(h) if isinstance(h, str) else h
    d = c.cast("decimal(20,0)")
    return F.when(c < 0, d + F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(d).cast("decimal(20,0)")


def unsigned_order(h: str | Column) -> Column:
    """A signed bigint that sorts as the hash does unsigned."""
    c = F.col(h) if isinstance(h, str) else h
    return c.bitwiseXOR(F.lit(-(1 << 63)))


def pack_agent(agent: Column, virtual: Column) -> Column:
    return agent.bitwiseOR(F.shiftleft(virtual.cast("long"), AGENT_BITS))


def unpack_agent(packed: Column) -> tuple[Column, Column]:
    return packed.bitwiseAND((1 << AGENT_BITS) - 1), F.shiftrightunsigned(packed, AGENT_BITS)
