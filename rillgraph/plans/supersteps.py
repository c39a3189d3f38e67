"""Vertex programs as loops of supersteps over a partitioned graph.

The graph's paths ``(u, w)`` are partitioned by the sending vertex once and kept
so for all supersteps; vertices that hold more than a thousandth of the paths are
spread over salts.  A superstep joins the states of the senders, combines what
each receiver gets on the map side, and shuffles that only.  Every vertex has a
path of no length to itself (``self``), which carries its own state along, so one
join a superstep is enough and a state is named once in the plan.  Therefore
several supersteps can run as one plan; their states are then written to the
shared folder, which cuts the lineage.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..operators.graph import ends
from ..operators.skew import add_salt, explode_salts, hot_keys
from ..session import Scratch, partitions


@dataclass
class VertexProgram:
    """A program by its parts, all column- or DataFrame-valued.

    ``init(vertices)`` gives ``(id, value, ...)``; ``message`` is an expression
    over the sender's state and ``self``; ``combine(received)`` groups
    ``(id, message, self, ...)`` to ``(id, value, before, ...)``, the next states
    with the value of the state before, which the path to itself carries.
    """

    init: Callable[[DataFrame], DataFrame]
    message: Callable[[], Column]
    combine: Callable[[DataFrame], DataFrame]
    undirected: bool = True
    #: Supersteps that one plan holds.
    chunk: int = 4
    #: None runs to the fixpoint, however deep the graph is.
    most: int | None = None


@dataclass
class Result:
    state: DataFrame
    supersteps: int
    converged: bool
    history: list[DataFrame] = field(default_factory=list)


class PartitionedGraph:
    def __init__(self, edges: DataFrame, undirected: bool, scratch: Scratch, weight: bool = False):
        self.scratch, self.spark = scratch, edges.sparkSession
        edges = scratch.table(edges.select("src", "dst"))
        self.n_edges = scratch.seen["rows"]
        deg = ends(edges).groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("degree"), F.sum("out").alias("out_degree"))
        self.vertices = scratch.table(deg)
        self.n_vertices = scratch.seen["rows"]
        paths = ends(edges).select(F.col("a").alias("u"), F.col("b").alias("w")) if undirected else edges.select(F.col("src").alias("u"), F.col("dst").alias("w"))
        paths = paths.withColumn("self", F.lit(False)).unionByName(self.vertices.select(F.col("id").alias("u"), F.col("id").alias("w"), F.lit(True).alias("self")))
        self.hot = hot_keys(self.vertices, "id", "degree", 2 * self.n_edges) if self.n_edges > 100_000 else []
        self.paths = add_salt(paths, "u", F.col("w"), self.hot).repartition(partitions(self.spark), "u", "__salt").sortWithinPartitions("u", "__salt").persist(StorageLevel.MEMORY_AND_DISK)

    def received(self, state: DataFrame, message: Column) -> DataFrame:
        """``(id, message, self)`` plus the columns of the receiver's path, for one superstep."""
        sent = explode_salts(state.withColumnRenamed("id", "u"), "u", self.hot)
        return self.paths.join(sent, ["u", "__salt"]).select(F.col("w").alias("id"), message.alias("message"), "self", *[c for c in state.columns if c != "id"])

    def close(self) -> None:
        self.paths.unpersist()


def run(program: VertexProgram, edges: DataFrame, keep_history: bool = False, most: int | None = None) -> Result:
    """Runs supersteps until no state changes, or ``most`` of them where that is given; tests after each written chunk."""
    s = Scratch(edges.sparkSession, "supersteps")
    g = PartitionedGraph(edges, program.undirected, s)
    most = program.most if most is None else most
    state = s.table(program.init(g.vertices))
    steps, converged, history = 0, g.n_vertices == 0, [state]
    while not converged and (most is None or steps < most):
        k = 1 if keep_history else program.chunk if most is None else min(program.chunk, most - steps)
        for _ in range(k):
            state = program.combine(g.received(state.drop("before"), program.message()))
        new = s.table(state, changed=F.count(F.when(~F.col("value").eqNullSafe(F.col("before")), 1)))
        converged = s.seen["changed"] == 0
        steps += k
        if not keep_history:
            s.drop(*history)
            history = []
        history.append(new)
        state = new
    g.close()
    return Result(state, steps, converged, history)
