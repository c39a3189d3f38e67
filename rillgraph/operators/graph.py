"""A directed graph as a table of distinct edges, and what follows from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..types import valid


def edge_set(rows: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Distinct edges of the rows with valid ends: parallel edges become one, reciprocal edges and self-loops stay."""
    return rows.filter(valid(src) & valid(dst)).select(F.col(src).cast("long").alias("src"), F.col(dst).cast("long").alias("dst")).distinct()


def transpose(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def ends(edges: DataFrame, *more) -> DataFrame:
    """Each edge from both of its ends, ``(a, b)``: reciprocal pairs and self-loops come twice.  One scan, no union."""
    both = F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(1).alias("out")), F.struct(F.col("dst").alias("a"), F.col("src").alias("b"), F.lit(0).alias("out")))
    return edges.select(F.explode(both).alias("e"), *more).select("e.a", "e.b", "e.out", *more)


def vertices(edges: DataFrame) -> DataFrame:
    return ends(edges).select(F.col("a").alias("id")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """``(id, out_degree, in_degree, degree)``; a self-loop counts on both sides."""
    e = ends(edges)
    return e.groupBy(F.col("a").alias("id")).agg(F.sum(F.col("out").cast("long")).alias("out_degree"), F.sum(1 - F.col("out").cast("long")).alias("in_degree"), F.count(F.lit(1)).alias("degree"))


def graph_stats(edges: DataFrame) -> DataFrame:
    """One row ``(vertices, edges, self_loops, reciprocal)``, ``reciprocal`` counting ordered pairs of distinct ends."""
    pairs = edges.groupBy(F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    e = pairs.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("edges"),
        F.count(F.when(F.col("x") == F.col("y"), 1)).alias("self_loops"),
        F.coalesce(F.sum(F.when((F.col("x") < F.col("y")) & (F.col("n") == 2), 2)), F.lit(0)).cast("long").alias("reciprocal"),
    )
    return e.join(vertices(edges).agg(F.count(F.lit(1)).alias("vertices"))).select("vertices", "edges", "self_loops", "reciprocal")


def max_degree_vertex(edges: DataFrame) -> DataFrame:
    """The vertex of the highest degree, the smallest id among equals."""
    return degrees(edges).orderBy(F.desc("degree"), "id").limit(1).select("id", "degree")


def transpose_check(edges: DataFrame, reverse: DataFrame) -> DataFrame:
    """Edges that lack their copy in ``reverse``, and copies that lack their edge; empty if all is well."""
    back = transpose(reverse)
    missing = edges.join(back, ["src", "dst"], "left_anti").withColumn("missing", F.lit("copy"))
    return missing.unionByName(back.join(edges, ["src", "dst"], "left_anti").withColumn("missing", F.lit("edge")))


def adjacency_lines(edges: DataFrame, symmetric: bool = False) -> DataFrame:
    """``(id, line)``: ``id<tab>degree n1 n2 ...``, neighbours sorted; with ``symmetric`` the out-neighbours, then the in-neighbours.

    The format puts all neighbours of a vertex into one line, whatever their
    number, so a vertex's line is one value; ``edge_lines`` has no such rows.
    """
    e = ends(edges) if symmetric else edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(1).alias("out"))
    each = e.groupBy("a").agg(F.sort_array(F.collect_list(F.struct((1 - F.col("out")).alias("i"), "b"))).alias("l"))
    names = F.array_join(F.transform("l", lambda x: x["b"].cast("string")), " ")
    return each.select(F.col("a").alias("id"), F.concat(F.col("a").cast("string"), F.lit("\t"), F.size("l").cast("string"), F.lit(" "), names).alias("line"))
