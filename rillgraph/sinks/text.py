"""Text dumps of graphs and results, to any path that Spark can write."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import adjacency_lines, degrees
from ..types import UNSET_TEXT


def result_lines(state: DataFrame, value: str = "value") -> DataFrame:
    """``id value`` of each vertex; a null value prints the largest unsigned number."""
    return state.select(F.concat_ws(" ", F.col("id").cast("string"), F.coalesce(F.col(value).cast("string"), F.lit(UNSET_TEXT))).alias("line"))


def edge_lines(edges: DataFrame) -> DataFrame:
    return edges.select(F.concat_ws(" ", "src", "dst").alias("line"))


def dump_lines(edges: DataFrame, fmt: str) -> DataFrame:
    """Lines of a dump: ``el`` edges, ``bl`` adjacency, ``sbl`` symmetric adjacency."""
    if fmt == "el":
        return edge_lines(edges)
    return adjacency_lines(edges, {"bl": False, "sbl": True}[fmt]).select("line")


def history_lines(history: list[DataFrame]) -> DataFrame:
    """``(superstep, line)``: ``id:value`` of each state of a run with history."""
    out = None
    for i, state in enumerate(history):
        x = state.select(F.lit(i).alias("superstep"), F.concat_ws(":", F.col("id").cast("string"), F.coalesce(F.col("value").cast("string"), F.lit(UNSET_TEXT))).alias("line"))
        out = x if out is None else out.unionByName(x)
    return out


def sketch_report(edges: DataFrame, width: int, depth: int, threshold: int) -> DataFrame:
    """``(id, in_degree, out_degree, estimate, replicas)`` by the count-min sketch of the edges' ends."""
    from ..functions.sketches import count_min, count_min_estimate, replicas

    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    est = count_min_estimate(count_min(ends, "id", width, depth), ends, "id", width, depth)
    return degrees(edges).join(est, "id").select("id", "in_degree", "out_degree", "estimate", replicas("estimate", threshold).alias("replicas"))


def write_lines(lines: DataFrame, path: str, files: int | None = None, mode: str = "error") -> None:
    out = lines.select("line")
    (out.coalesce(files) if files else out).write.mode(mode).text(path)
