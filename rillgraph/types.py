"""Schemas shared by the sources, operators and sinks."""

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

EDGE = T.StructType([T.StructField("src", T.LongType(), False), T.StructField("dst", T.LongType(), False)])

UPDATE = T.StructType(
    [
        T.StructField("seq", T.LongType(), False),
        T.StructField("op", T.IntegerType(), False),
        T.StructField("src", T.LongType(), False),
        T.StructField("dst", T.LongType(), False),
    ]
)

RAW_UPDATE = T.StructType(
    [
        *UPDATE.fields,
        T.StructField("weight", T.DoubleType(), True),
        T.StructField("ts", T.LongType(), True),
    ]
)

#: Printed by text sinks where a vertex has no value (unsigned 64-bit maximum).
UNSET_TEXT = "18446744073709551615"


def valid(vertex: str | Column) -> Column:
    """A vertex id is valid if it is neither null nor negative; never null itself."""
    c = F.col(vertex) if isinstance(vertex, str) else vertex
    return F.coalesce(c >= 0, F.lit(False))
