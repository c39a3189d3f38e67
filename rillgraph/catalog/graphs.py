"""Graphs derived from the star-schema and event tables, and the edge table itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.graph import edge_set
from ..session import Scratch

#: Offset of the second and third kind of vertex.
SECOND, THIRD = 10_000_000, 20_000_000
BLOCK = 50_000


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def cust_part(spark: SparkSession, d: str) -> DataFrame:
    o, li = table(spark, d, "orders").select("o_orderkey", "o_custkey"), table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    return o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("src"), (F.col("l_partkey") + SECOND).alias("dst")).distinct()


def part_supp(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + SECOND).alias("dst")).distinct()


def cust_region(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("src"), (F.col("c_nationkey").cast("long") + SECOND).alias("dst"))
    n = table(spark, d, "nation").select((F.col("n_nationkey").cast("long") + SECOND).alias("src"), (F.col("n_regionkey").cast("long") + THIRD).alias("dst"))
    return c.unionByName(n).distinct()


def user_steps(spark: SparkSession, d: str) -> DataFrame:
    """``(seq, op, src, dst)``: each event's user and the next event's, deletes where the event is an error.

    The order is over the whole table, so events are range-sorted into tasks and
    a task's last event finds its successor at the head of the next one.
    """
    s = Scratch(spark, "steps")
    e = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type")
    e = s.table(e.repartitionByRange("ts", "event_id").withColumn("part", F.spark_partition_id()))
    w = Window.partitionBy("part").orderBy("ts", "event_id")
    heads = e.groupBy("part").agg(F.min_by("user_id", F.struct("ts", "event_id")).alias("head"))
    heads = heads.select(F.lag("part").over(Window.orderBy("part")).alias("part"), "head")  # one row a task
    e = e.withColumn("dst", F.lead("user_id").over(w)).withColumn("last", F.lead("event_id").over(w).isNull()).join(F.broadcast(heads), "part", "left")
    e = e.withColumn("dst", F.when(F.col("last"), F.col("head")).otherwise(F.col("dst")))
    return e.filter("dst is not null").select(F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", -1).otherwise(1).alias("op"), F.col("user_id").alias("src"), "dst")


def user_next(spark: SparkSession, d: str) -> DataFrame:
    return user_steps(spark, d).select("src", "dst").distinct()


def edge(spark: SparkSession, d: str) -> DataFrame:
    return edge_set(table(spark, d, "edge"))


CUST_PART = f"SELECT DISTINCT o_custkey AS src, l_partkey + {SECOND} AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey"
PART_SUPP = f"SELECT DISTINCT l_partkey AS src, l_suppkey + {SECOND} AS dst FROM lineitem"
CUST_REGION = f"SELECT c_custkey AS src, c_nationkey::BIGINT + {SECOND} AS dst FROM customer UNION SELECT n_nationkey::BIGINT + {SECOND}, n_regionkey::BIGINT + {THIRD} FROM nation"
USER_STEPS = "SELECT event_id AS seq, CASE WHEN event_type = 'error' THEN -1 ELSE 1 END AS op, user_id AS src, lead(user_id) OVER (ORDER BY ts, event_id) AS dst FROM events"
USER_NEXT = f"SELECT DISTINCT src, dst FROM ({USER_STEPS}) WHERE dst IS NOT NULL"
EDGE = "SELECT DISTINCT src, dst FROM edge WHERE src >= 0 AND dst >= 0"
