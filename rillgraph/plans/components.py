"""Weakly connected components by contraction.

In a round every vertex points to the neighbour, or itself, of the least hash,
follows that pointer's pointer too, and is merged with what it finds there; the
links between merged vertices are the next round's graph.  Hashes are drawn anew
each round, so that a round leaves a fraction of the vertices whatever the order
of the ids, the number of rounds grows with the logarithm of the size and not
with the diameter, and all rounds together cost little more than the first.
Rounds combine minima on the map side and spread frequent vertices over salts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import hot_keys, salted_join
from ..session import Scratch
from ..types import valid

#: Tables of fewer rows are not looked at for hot keys: as a whole they are less than what one task should take.
SMALL = 100_000


def _roots(s: Scratch, links: DataFrame, n: int) -> DataFrame | None:
    """``(v, root)`` of the ends of ``links (a, b)``, ``a <> b``: one vertex of its component for each; None without links."""
    levels: list[tuple[DataFrame, int]] = []
    while n:
        seed = F.lit(len(levels))
        both = links.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("x")).select("x.u", "x.v")
        rank = lambda c: F.struct(F.xxhash64(c, seed).alias("h"), F.col(c).alias("v"))
        least = s.table(both.groupBy("u").agg(F.min(rank("v")).alias("m"), F.count(F.lit(1)).alias("n")).select("u", "n", F.least("m", rank("u"))["v"].alias("m")))
        vertices = s.seen["rows"]
        hot = hot_keys(least, "u", "n", 2 * n) if n > SMALL else []
        pulls = hot_keys(least.groupBy("m").count(), "m", "count", vertices) if vertices > SMALL else []
        second = least.select(F.col("u").alias("m"), F.col("m").alias("r"))
        to = s.table(salted_join(least.select("u", "m"), second, "m", F.col("u"), pulls).select("u", "r"))
        s.drop(least)
        levels.append((to, vertices))
        ends = [to.select(F.col("u").alias(c), F.col("r").alias("r" + c)) for c in ("a", "b")]
        across = salted_join(links, ends[0], "a", F.col("b"), hot).select("ra", "b")
        across = salted_join(across, ends[1], "b", F.col("ra"), hot).filter("ra <> rb")
        after = s.table(across.select(F.greatest("ra", "rb").alias("a"), F.least("ra", "rb").alias("b")).distinct())
        if len(levels) > 1:
            s.drop(links)
        links, n = after, s.seen["rows"]
    if not levels:
        return None
    roots = levels[-1][0].select(F.col("u").alias("v"), F.col("r").alias("root"))
    for to, size in reversed(levels[:-1]):
        above = roots.select(F.col("v").alias("r"), "root")
        hot = hot_keys(to.groupBy("r").count(), "r", "count", size) if size > SMALL else []
        roots = salted_join(to, above, "r", F.col("u"), hot, "left").select(F.col("u").alias("v"), F.coalesce("root", "r").alias("root"))
    return s.table(roots)


def components(edges: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """``(id, component)``: the least id of each vertex's component.

    ``labels (id, component)`` of an earlier, smaller edge set make a warm start,
    so they must still hold: their vertices are merged before the first round,
    and only edges between them and to other vertices are left to look at.
    """
    s = Scratch(edges.sparkSession, "components")
    rows = edges.filter(valid("src") & valid("dst")).select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct()
    if labels is not None:
        known = s.table(labels.select("id", "component"))
        for c in ("a", "b"):
            rows = rows.join(known.select(F.col("id").alias(c), F.col("component").alias("k" + c)), c, "left").withColumn("k" + c, F.coalesce("k" + c, c))
        own = s.table(rows)
        ids = own.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("ka").alias("k")), F.struct(F.col("b").alias("id"), F.col("kb").alias("k")))).alias("x")).select("x.id", "x.k").distinct()
        links = s.table(own.filter("ka <> kb").select(F.greatest("ka", "kb").alias("a"), F.least("ka", "kb").alias("b")).distinct())
        n = s.seen["rows"]
    else:
        first = s.table(rows, loops=F.count(F.when(F.col("a") == F.col("b"), 1)))
        n = s.seen["rows"] - s.seen["loops"]
        links = first.filter("a <> b")
        ids = first.filter("a = b").select(F.col("a").alias("id"), F.col("a").alias("k")).distinct()
    roots = _roots(s, links, n)
    if roots is None:
        return ids.select("id", F.col("k").alias("component"))
    vertices = s.seen["rows"]
    groups = s.table(roots.groupBy("root").agg(F.min("v").alias("component"), F.count(F.lit(1)).alias("n")))
    hot = hot_keys(groups, "root", "n", vertices) if vertices > SMALL else []
    found = salted_join(roots, groups.select("root", "component"), "root", F.col("v"), hot).select("v", "component")
    if labels is None:
        alone = ids.join(found.select(F.col("v").alias("id")), "id", "left_anti").select("id", F.col("k").alias("component"))
        return found.select(F.col("v").alias("id"), "component").unionByName(alone)
    return ids.join(found, F.col("k") == F.col("v"), "left").select("id", F.coalesce("component", "k").alias("component"))


def incremental_components(edges: DataFrame, before: DataFrame, deleted: DataFrame) -> DataFrame:
    """The components of ``edges`` from those ``before`` the last batch, ``deleted`` being the edges that it took away.

    Components that lost an edge are computed anew, the others keep their
    labels; the result is always that of a computation from scratch.
    """
    touched = deleted.select(F.explode(F.array("src", "dst")).alias("id")).distinct().join(before, "id").select("component").distinct()
    kept = before.join(touched, "component", "left_anti").select("id", "component")
    return components(edges, kept)
