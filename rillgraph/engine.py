"""A session with one graph: load, change, run, query, save."""

from __future__ import annotations

import time
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import placement
from .operators.graph import edge_set, graph_stats, transpose, transpose_check
from .operators.updates import apply_updates, clean_updates
from .plans import programs
from .plans.components import components, incremental_components
from .session import Scratch
from .sinks.text import dump_lines, result_lines, write_lines

#: What a point query gives for an id that is no vertex.
DEFAULTS = {"pagerank": float("inf"), "wcc": -1, "lpa": -1, "bfs": 0, "kcore": 0}


class GraphSession:
    """Holds the current snapshot and the last result of each program; every batch and run is timed in ``metrics``."""

    def __init__(self, spark: SparkSession, edges: DataFrame | None = None):
        self.spark, self.scratch, self.batch = spark, Scratch(spark, "graph"), 0
        self.metrics: list[dict[str, Any]] = []
        self.results: dict[str, DataFrame] = {}
        self._pending: list[DataFrame] = []
        self._fresh: dict[str, tuple] = {}
        empty = spark.createDataFrame([], "src long, dst long")
        self.edges = self.scratch.table(edge_set(edges) if edges is not None else empty)

    def _timed(self, name: str, start: float, **more: Any) -> None:
        self.metrics.append({"name": name, "batch": self.batch, "seconds": time.time() - start, **more})

    def update(self, changes: DataFrame) -> None:
        """Queues changes ``(seq, op, src, dst)`` for the next batch."""
        self._pending.append(clean_updates(changes))

    def materialize(self) -> DataFrame:
        """Applies what is queued, a batch for each call of update, and gives the graph's statistics."""
        start = time.time()
        for changes in self._pending:
            before, self.batch = self.edges, self.batch + 1
            self.edges = self.scratch.table(apply_updates(before, changes))
            if "wcc" in self.results:
                gone = before.join(self.edges, ["src", "dst"], "left_anti")
                new = incremental_components(self.edges, self.results["wcc"].withColumnRenamed("value", "component"), gone)
                self.results["wcc"] = self.scratch.table(new.withColumnRenamed("component", "value"))
            self.results = {k: v for k, v in self.results.items() if k == "wcc"}
        self._pending = []
        stats = graph_stats(self.edges)
        self._timed("update", start)
        return stats

    def run(self, program: str, **kw: Any) -> DataFrame:
        """``(id, value)`` by ``pagerank``, ``wcc``, ``bfs`` (``starts``), ``lpa`` or ``kcore``, over the snapshot with all queued changes."""
        if self._pending:
            self.materialize()
        start = time.time()
        if program == "wcc" and "wcc" in self.results and not kw:
            return self.results["wcc"]
        extra: dict[str, Any] = {}
        if program == "wcc":
            out = components(self.edges).withColumnRenamed("component", "value")
        else:
            f = {"pagerank": programs.pagerank, "bfs": programs.bfs, "lpa": programs.label_propagation, "kcore": programs.coreness}[program]
            r = f(self.edges, **kw)
            out, extra = r.state.select("id", "value"), {"supersteps": r.supersteps, "converged": r.converged}
        self.results[program] = self.scratch.table(out)
        self._timed(program, start, **extra)
        return self.results[program]

    def query(self, program: str, ids: DataFrame | list[int]) -> DataFrame:
        """``(id, value)`` of the last result for the asked ids; an id that is no vertex gives the program's default."""
        asked = ids if isinstance(ids, DataFrame) else self.spark.createDataFrame([(int(i),) for i in ids], "id long")
        known = self.results[program].withColumn("known", F.lit(True))
        return asked.join(known, "id", "left").select("id", F.when(F.col("known"), F.col("value")).otherwise(F.lit(DEFAULTS[program])).alias("value"))

    def reset(self) -> None:
        """Forgets all results, so that the next run starts from nothing."""
        self.results = {}

    def save(self, program: str, path: str, files: int | None = None) -> None:
        write_lines(result_lines(self.results[program]), path, files)

    def dump(self, path: str, fmt: str = "el", files: int | None = None) -> None:
        write_lines(dump_lines(self.edges, fmt), path, files)

    def check_transpose(self) -> None:
        if not transpose_check(self.edges, transpose(self.edges)).isEmpty():
            raise RuntimeError("an edge lacks its copy")

    def placement(self, agents: DataFrame) -> DataFrame:
        return placement.agent_balance(self.edges, agents)

    def rebalance(self, agents: DataFrame) -> DataFrame:
        return placement.rebalanced(self.edges, agents)

    def heartbeat(self) -> DataFrame:
        """The metrics so far: ``(name, batch, seconds, supersteps, converged)``."""
        rows = [(m["name"], m["batch"], m["seconds"], m.get("supersteps"), m.get("converged")) for m in self.metrics]
        return self.spark.createDataFrame(rows, "name string, batch int, seconds double, supersteps int, converged boolean")
