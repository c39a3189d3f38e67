"""PageRank, breadth-first search, label propagation, coreness, and components by labels, as vertex programs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .supersteps import Result, VertexProgram, run

DAMPING, UPDATES, ROUNDS = 0.85, 20, 20


def _own(c: str) -> Column:
    return F.max(F.when(F.col("self"), F.col(c)))


def pagerank(edges: DataFrame, damping: float = DAMPING, updates: int = UPDATES) -> Result:
    """``(id, value)`` after exactly ``updates`` updates from 1/n; what sinks hold is not passed on, so ranks need not sum to 1."""
    n = edges.select(F.explode(F.array("src", "dst")).alias("v")).distinct().count() if updates else 0

    def init(v: DataFrame) -> DataFrame:
        share = F.lit(1.0) / F.lit(float(n or 1)) if updates else F.lit(1.0) / F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
        return v.select("id", share.alias("value"), "out_degree")

    def message() -> Column:
        return F.when(F.col("self"), 0.0).otherwise(F.col("value") / F.col("out_degree"))

    def combine(r: DataFrame) -> DataFrame:
        g = r.groupBy("id").agg(F.sum("message").alias("s"), _own("value").alias("before"), _own("out_degree").alias("out_degree"))
        return g.select("id", (F.lit((1 - damping) / (n or 1)) + F.lit(damping) * F.col("s")).alias("value"), "before", "out_degree")

    # A fixed number of updates: a change test never ends the loop before it, since ranks are compared exactly.
    return run(VertexProgram(init, message, combine, undirected=False, chunk=5), edges, most=updates)


def bfs(edges: DataFrame, starts: list[int], directed: bool = False, most: int | None = None, keep_history: bool = False) -> Result:
    """``(id, value)``: hops from the nearest start, null where none leads; starts that are no vertices are ignored."""

    def combine(r: DataFrame) -> DataFrame:
        return r.groupBy("id").agg(F.min("message").alias("value"), _own("value").alias("before"))

    init = lambda v: v.select("id", F.when(F.col("id").isin([int(x) for x in starts]), F.lit(0).cast("long")).alias("value"))
    hop = lambda: F.col("value") + F.when(F.col("self"), 0).otherwise(1)
    return run(VertexProgram(init, hop, combine, undirected=not directed), edges, keep_history, most)


def label_components(edges: DataFrame, keep_history: bool = False, most: int | None = None) -> Result:
    """``(id, value)``: the least id that reaches a vertex, one hop a superstep; for histories and shallow graphs (see components)."""

    def combine(r: DataFrame) -> DataFrame:
        return r.groupBy("id").agg(F.min("message").alias("value"), _own("value").alias("before"))

    return run(VertexProgram(lambda v: v.select("id", F.col("id").alias("value")), lambda: F.col("value"), combine), edges, keep_history, most)


def label_propagation(edges: DataFrame, rounds: int = ROUNDS, keep_history: bool = False) -> Result:
    """``(id, value)`` after synchronous rounds: the most frequent label of the neighbours, counted with multiplicity, the least among equals."""

    def combine(r: DataFrame) -> DataFrame:
        n = r.groupBy("id", "message").agg(F.sum((~F.col("self")).cast("long")).alias("n"), F.max("self").alias("own"))
        heard = F.when(F.col("n") > 0, F.struct("n", -F.col("message")))
        return n.groupBy("id").agg(F.max_by("message", heard).alias("value"), F.max(F.when(F.col("own"), F.col("message"))).alias("before"))

    return run(VertexProgram(lambda v: v.select("id", F.col("id").alias("value")), lambda: F.col("value"), combine, chunk=2), edges, keep_history, rounds)


def coreness(edges: DataFrame, most: int | None = None, keep_history: bool = False) -> Result:
    """``(id, value)``: the h-index of the neighbours' values, from degrees down to the fixpoint; neighbours count with multiplicity.

    Values are counted before they are ordered, so a vertex orders as many rows
    as its neighbours have distinct values, not as it has neighbours.
    """

    def combine(r: DataFrame) -> DataFrame:
        n = r.groupBy("id", "message").agg(F.sum((~F.col("self")).cast("long")).alias("n"), F.max("self").alias("own"))
        upto = F.sum("n").over(Window.partitionBy("id").orderBy(F.desc("message")).rowsBetween(Window.unboundedPreceding, 0))
        h = n.withColumn("h", F.least("message", upto)).groupBy("id").agg(F.max("h").alias("h"), F.max(F.when(F.col("own"), F.col("message"))).alias("before"))
        return h.select("id", F.least("h", "before").alias("value"), "before")

    return run(VertexProgram(lambda v: v.select("id", F.col("degree").alias("value")), lambda: F.col("value"), combine, chunk=2), edges, keep_history, most)


def active_counts(result: Result) -> DataFrame:
    """``(superstep, active)`` of a result with history: states that the superstep changed."""
    out = None
    for i, state in enumerate(result.history[1:], 1):
        n = state.agg(F.count(F.when(~F.col("value").eqNullSafe(F.col("before")), 1)).alias("active")).select(F.lit(i).alias("superstep"), "active")
        out = n if out is None else out.unionByName(n)
    return out


def senders(result: Result) -> DataFrame:
    """``(superstep, id)`` of a result with history: the vertices whose state is new, at 0 those that have one, and goes out in that superstep."""
    out = None
    for i, state in enumerate(result.history):
        new = ~F.col("value").eqNullSafe(F.col("before")) if i else F.col("value").isNotNull()
        n = state.filter(new).select(F.lit(i).alias("superstep"), "id")
        out = n if out is None else out.unionByName(n)
    return out
