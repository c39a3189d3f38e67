"""Streams of edge changes and the snapshots they lead to.

Within a batch the last change of an edge by ``seq`` wins; batches apply in
order.  A delete of an edge that is not there changes nothing, and a vertex
whose last edge goes is gone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..types import valid


def clean_updates(rows: DataFrame) -> DataFrame:
    """Rows with valid ends and an op of 1 or -1; others are no changes."""
    return rows.filter(valid("src") & valid("dst") & F.col("op").isin(1, -1)).select("seq", "op", "src", "dst")


def batch_of(seq: str | Column, size: int) -> Column:
    """The mini-batch of a change: ``size`` changes each, counted from the first ``seq`` of 1."""
    return F.floor(((F.col(seq) if isinstance(seq, str) else seq) - 1) / size).cast("long")


def last_wins(updates: DataFrame, *by: str) -> DataFrame:
    """The last op of each edge (in each group of ``by``), with partial aggregation; of changes with one ``seq`` an insert wins."""
    order = F.struct("seq", "op")
    return updates.groupBy(*by, "src", "dst").agg(F.max(order).alias("x")).select(*by, "src", "dst", F.col("x.op").alias("op"), F.col("x.seq").alias("seq"))


def apply_updates(edges: DataFrame, updates: DataFrame) -> DataFrame:
    """The edge set after one batch of changes: one shuffle by edge of the snapshot and the changes together."""
    last = last_wins(updates).select("src", "dst", F.col("op"))
    both = edges.select("src", "dst", F.lit(0).alias("op")).unionByName(last)
    return both.groupBy("src", "dst").agg(F.max(F.when(F.col("op") != 0, F.col("op"))).alias("op")).filter("op is null or op = 1").select("src", "dst")


def snapshot_after(edges: DataFrame | None, updates: DataFrame, size: int, batches: int) -> DataFrame:
    """The edge set after ``batches`` mini-batches: since the last change of an edge decides, all of them in one pass."""
    done = updates.filter(batch_of("seq", size) < batches)
    return apply_updates(edges, done) if edges is not None else last_wins(done).filter("op = 1").select("src", "dst")


def batch_stats(updates: DataFrame, size: int) -> DataFrame:
    """``(batch_id, changes, edges_changed, inserts, deletes)``: the size of each mini-batch before and after the last op has won."""
    b = updates.withColumn("batch_id", batch_of("seq", size))
    per_edge = b.groupBy("batch_id", "src", "dst").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("seq", "op")).alias("x"))
    return per_edge.groupBy("batch_id").agg(F.sum("n").alias("changes"), F.count(F.lit(1)).alias("edges_changed"), F.count(F.when(F.col("x.op") == 1, 1)).alias("inserts"), F.count(F.when(F.col("x.op") == -1, 1)).alias("deletes"))
