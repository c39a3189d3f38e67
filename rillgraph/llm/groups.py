"""Groups of records that are linked directly or through others.

Low-diameter decomposition: every vertex draws an exponentially distributed
head start, clusters grow from the vertices whose start time has come, one hop
a round, and each vertex joins the cluster that reaches it first.  The clusters
are contracted to super-vertices, the links between clusters are the next
level's graph, and the levels' assignments are composed.  A level leaves a
constant fraction of the links, whatever the shape of the graph, so long chains
need a logarithmic number of levels where label propagation needs one round for
each hop.

At scale: a level's links are shuffled once, spread over salts where a vertex
holds more than a thousandth of them, and kept partitioned for its rounds; the
rounds shuffle only vertex states, combined on the map side.  The driver sees
row counts and at most ``skew.SHARE`` hot vertex ids.  Every level is cut by
written tables in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..operators.skew import add_salt, explode_salts, hot_keys, salted_join
from ..session import Scratch, partitions
from ..types import valid

#: (rate of the exponential head starts, rounds) by level; the last holds for all further levels.
SCHEDULE = ((1.0, 3), (0.7, 4), (0.5, 6), (0.4, 8))
#: Composition joins over at least so many rows look for hot clusters first.
LOOK_FOR_HOT = 50_000
#: Once no more links than this are left, the further levels run in one task: so few rows fit in any task's memory (16 bytes
#: each, some ten copies at most), and jobs for ever smaller tables would only add latency.
ONE_TASK = 30_000


def _start(v: Column, level: int, rate: float, rounds: int, seed: int) -> Column:
    """Start time of a vertex: rounds less its exponential head start, which is cut at the number of rounds."""
    u = ((F.xxhash64(v, F.lit(level), F.lit(seed)).bitwiseAND((1 << 52) - 1)) + F.lit(1)) / F.lit(float((1 << 52) + 1))
    return F.lit(float(rounds)) - F.least(-F.log(u) / F.lit(rate), F.lit(float(rounds)))


def _both_ways(links: DataFrame) -> DataFrame:
    ends = F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("w")), F.struct(F.col("b").alias("u"), F.col("a").alias("w"))))
    return links.select(ends.alias("l")).select("l.u", "l.w")


def _decompose(s: Scratch, links: DataFrame, n_links: int, level: int, rate: float, rounds: int, seed: int) -> tuple[DataFrame, int, DataFrame, int]:
    """One level: (cluster of each vertex, number of vertices, links between clusters, number of those)."""
    spark = links.sparkSession
    both = _both_ways(links)
    # First round: the neighbours' start times follow from their ids, so no join is needed.
    first = both.groupBy("w").agg(
        F.min(_start(F.col("u"), level, rate, rounds, seed) + 1).alias("t"),
        F.min_by("u", _start(F.col("u"), level, rate, rounds, seed)).alias("c"),
        F.count(F.lit(1)).alias("deg"),
    )
    own = _start(F.col("w"), level, rate, rounds, seed)
    first = first.select(F.col("w").alias("v"), F.least("t", own).alias("t"), F.when(own <= F.col("t"), F.col("w")).otherwise(F.col("c")).alias("c"), "deg")
    state = first_table = s.table(first)
    n = s.seen["rows"]
    hot = hot_keys(state, "v", "deg", 2 * n_links)
    state = state.select("v", "t", "c")
    # A vertex is its own neighbour at no distance: one join a round then carries its state on.
    paths = both.unionByName(state.select(F.col("v").alias("u"), F.col("v").alias("w")))
    paths = add_salt(paths, "u", F.col("w"), hot).repartition(partitions(spark), "u", "__salt").sortWithinPartitions("u", "__salt").persist(StorageLevel.MEMORY_AND_DISK)
    for _ in range(rounds - 1):
        sent = paths.join(explode_salts(state.withColumnRenamed("v", "u"), "u", hot), ["u", "__salt"])
        t = F.col("t") + F.when(F.col("u") == F.col("w"), 0.0).otherwise(1.0)
        state = sent.groupBy("w").agg(F.min(t).alias("t"), F.min_by("c", t).alias("c")).withColumnRenamed("w", "v")
    clusters = s.table(state.select("v", "c"))
    paths.unpersist()
    s.drop(first_table)
    by_a = clusters.select(F.col("v").alias("a"), F.col("c").alias("ca"))
    by_b = clusters.select(F.col("v").alias("b"), F.col("c").alias("cb"))
    crossing = salted_join(links, by_a, "a", F.col("b"), hot).select("ca", "b")
    crossing = salted_join(crossing, by_b, "b", F.col("ca"), hot).filter("ca <> cb")
    crossing = crossing.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct()
    crossing = s.table(crossing)
    return clusters, n, crossing, s.seen["rows"]


def _rest(rate: float, rounds: int, seed: int):
    """The same decomposition, level after level until no link is left, over one bounded batch of links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        if t.num_rows == 0:
            return
        ends = np.concatenate([t["a"].to_numpy(), t["b"].to_numpy()])
        ids, at = np.unique(ends, return_inverse=True)
        a, b = at[: t.num_rows], at[t.num_rows :]
        root, rng = np.arange(len(ids)), np.random.default_rng(seed)
        while len(a):
            start = rounds - np.minimum(rng.exponential(1 / rate, len(ids)), rounds)
            cluster = np.arange(len(ids))
            u, w = np.concatenate([a, b]), np.concatenate([b, a])
            for _ in range(rounds):
                order = np.lexsort((start[u], w))
                to, come = w[order], u[order]
                head = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
                to, come = to[head], come[head]
                sooner = start[come] + 1 < start[to]
                to, come = to[sooner], come[sooner]
                new_start, new_cluster = start[come] + 1, cluster[come]
                start[to], cluster[to] = new_start, new_cluster
            root = cluster[root]
            a, b = cluster[a], cluster[b]
            a, b = np.minimum(a, b), np.maximum(a, b)
            pairs = np.unique(np.stack([a, b], 1)[a != b], axis=0)
            a, b = pairs[:, 0], pairs[:, 1]
        out = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[root])], names=["v", "c"])
        for at in range(0, out.num_rows, 100_000):
            yield out.slice(at, 100_000)

    return run


def link_groups(pairs: DataFrame, left: str = "src", right: str = "dst", seed: int = 17, schedule: tuple[tuple[float, int], ...] = SCHEDULE, one_task: int | None = None) -> DataFrame:
    """``(vertex_id, group_id)`` for each id of the pairs; ``group_id`` is the smallest id of the group.

    Rows with a null or negative end give neither vertices nor links.  A row
    that links an id with itself gives a vertex.  Repeated, reversed and
    parallel rows change nothing; other columns, whatever their names, are not
    read.  ``one_task`` is the number of links from which on the further levels
    run in one task (``ONE_TASK``); with 0 every level is distributed.  Of an empty table the result is empty.
    """
    spark = pairs.sparkSession
    s = Scratch(spark, "groups")
    ends = pairs.filter(valid(left) & valid(right)).select(F.col(left).cast("long").alias("x"), F.col(right).cast("long").alias("y"))
    all_links = s.table(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), loops=F.count(F.when(F.col("a") == F.col("b"), 1)))
    n_links = s.seen["rows"] - s.seen["loops"]
    links = all_links.filter("a <> b")
    levels: list[tuple[DataFrame, int]] = []
    one_task = ONE_TASK if one_task is None else one_task
    while n_links > one_task:
        rate, rounds = schedule[min(len(levels), len(schedule) - 1)]
        clusters, n, crossing, n_links = _decompose(s, links, n_links, len(levels), rate, rounds, seed)
        levels.append((clusters, n))
        if len(levels) > 1:
            s.drop(links)
        links = crossing
    if n_links:
        rest = s.table(links.coalesce(1).mapInArrow(_rest(*schedule[-1], seed), "v long, c long"))
        levels.append((rest, s.seen["rows"]))
    loops = all_links.filter("a = b").select(F.col("a").alias("v"))
    if not levels:
        return loops.select(F.col("v").alias("vertex_id"), F.col("v").alias("group_id"))
    roots = levels[-1][0].select("v", F.col("c").alias("root"))
    for clusters, n in reversed(levels[:-1]):
        above = roots.select(F.col("v").alias("c"), "root")
        hot = hot_keys(clusters.groupBy("c").count(), "c", "count", n) if n >= LOOK_FOR_HOT else []
        roots = salted_join(clusters, above, "c", F.col("v"), hot, "left").select("v", F.coalesce("root", "c").alias("root"))
    n = levels[0][1]
    roots = s.table(roots)
    groups = s.table(roots.groupBy("root").agg(F.min("v").alias("group_id"), F.count(F.lit(1)).alias("n")))
    hot = hot_keys(groups, "root", "n", n)
    linked = salted_join(roots, groups.select("root", "group_id"), "root", F.col("v"), hot).select(F.col("v").alias("vertex_id"), "group_id")
    alone = loops.join(roots, "v", "left_anti").select(F.col("v").alias("vertex_id"), F.col("v").alias("group_id"))
    return linked.unionByName(alone)
