"""Placement of vertices and edges on agents by a hash ring, and what it tells.

A small table ``agents (agent_id, vagents)`` describes the cluster; its ring has a
point for each virtual agent.  The ring is cut into as many buckets by the leading
bits of the hash as it has points, so a key finds its place by an equi-join on its
bucket and a look at the few points there.  Buckets are even, as they are those of
a hash; they are broadcast up to ``BROADCAST`` points and shuffled beyond.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import AGENT_BITS, pack_agent, unsigned_order, wang_of, with_wang
from ..session import Scratch

VAGENTS, BROADCAST = 100, 500_000


def ring(agents: DataFrame) -> DataFrame:
    """``(agent_id, vagent, h, o)``: a point for each virtual agent, ``o`` sorting unsigned."""
    v = agents.filter("vagents > 0").withColumn("vagent", F.explode(F.sequence(F.lit(0), F.col("vagents") - 1)))
    return with_wang(v, pack_agent(F.col("agent_id"), F.col("vagent"))).withColumn("o", unsigned_order("h")).select("agent_id", "vagent", "h", "o")


class Ring:
    """A ring ready for look-ups: ``points (at, agent_id, vagent)`` in order and the points of each bucket.

    It is made on the driver, since it has a row for each virtual agent of the
    cluster and nothing that grows with the graph.
    """

    def __init__(self, agents: DataFrame, wrap: bool = False):
        self.wrap, spark = wrap, agents.sparkSession
        rows = agents.filter("vagents > 0 and agent_id is not null").select("agent_id", "vagents").collect()
        ids = np.repeat(np.array([r[0] for r in rows], np.int64), [r[1] for r in rows])
        vagents = np.concatenate([np.arange(r[1], dtype=np.int32) for r in rows]) if rows else np.zeros(0, np.int32)
        h = wang_of(ids.astype(np.uint64) | vagents.astype(np.uint64) << np.uint64(AGENT_BITS))
        order = np.argsort(h, kind="stable")
        h, ids, vagents = h[order], ids[order], vagents[order]
        self.size = n = len(h)
        at = np.arange(n, dtype=np.int64)
        self._bits = max(1, (n - 1).bit_length())
        n_buckets = 1 << self._bits if n else 0
        ends = np.searchsorted(h >> np.uint64(64 - self._bits), np.arange(n_buckets, dtype=np.uint64), "right")
        beyond = ends == n
        nxt = np.where(beyond, 0 if wrap else n - 1, ends)
        place = lambda i: [pa.array(at[i]), pa.array(ids[i]), pa.array(vagents[i])]
        names = ["at", "agent_id", "vagent"]
        inside = pa.StructArray.from_arrays([pa.array((h ^ np.uint64(1 << 63)).view(np.int64)), *place(at)], ["o", *names])
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), inside)
        buckets = pa.table({"bucket": pa.array(np.arange(n_buckets, dtype=np.int64)), "in": lists, "next": pa.StructArray.from_arrays(place(nxt), names), "past": pa.array(beyond)})
        self.buckets = spark.createDataFrame(buckets)
        self.points = spark.createDataFrame(pa.table(dict(zip(names, place(at), strict=True))))

    def _bucket(self, h: str) -> Column:
        return F.shiftrightunsigned(h, 64 - self._bits).alias("bucket")

    def _with(self, df: DataFrame, other: DataFrame, on: str) -> DataFrame:
        return df.join(F.broadcast(other) if self.size <= BROADCAST else other, on, "left")

    def locate(self, keys: DataFrame, key: str, at: str = "at", agent: str | None = None, vagent: str | None = None, past: str | None = None) -> DataFrame:
        """Adds the place of ``key``: ``at`` of the first point not below its hash, or of the last one (with ``wrap`` the first one) where there is none, then ``past``; null without a ring."""
        found = self._with(with_wang(keys, key, "__h").withColumn("bucket", self._bucket("__h")), self.buckets, "bucket")
        here = F.get(F.filter("in", lambda p: p["o"] >= unsigned_order("__h")), F.lit(0))
        found = found.withColumn("__hit", here)
        inside = F.col("__hit.at").isNotNull()
        out = found.withColumn(at, F.when(inside, F.col("__hit.at")).otherwise(F.col("next.at")))
        if agent:
            out = out.withColumn(agent, F.when(inside, F.col("__hit.agent_id")).otherwise(F.col("next.agent_id")))
        if vagent:
            out = out.withColumn(vagent, F.when(inside, F.col("__hit.vagent")).otherwise(F.col("next.vagent")))
        if past:
            out = out.withColumn(past, ~inside & F.coalesce("past", F.lit(True)))
        return out.drop("__h", "__hit", "bucket", "in", "next", *([] if past == "past" else ["past"]))

    def agents_at(self, df: DataFrame, at: str) -> DataFrame:
        """Adds ``agent_id`` and ``vagent`` of the point ``at``."""
        return self._with(df, self.points.withColumnRenamed("at", at), at)


def replica_agents(keys: DataFrame, key: str, agents: DataFrame, replicas: Column | int = 1, wrap: bool = False) -> DataFrame:
    """The keys' rows with ``slot, agent_id, vagent``: a row for each of the ``replicas`` ring points from the key's place on, no more than the ring has."""
    r = Ring(agents, wrap)
    k = F.lit(replicas) if isinstance(replicas, int) else replicas
    placed = r.locate(keys.withColumn("__k", k), key, "__at").filter(F.col("__at").isNotNull())
    slots = placed.withColumn("slot", F.explode(F.sequence(F.lit(0), F.least("__k", F.lit(r.size)).cast("int") - 1)))
    return r.agents_at(slots.withColumn("__at", F.pmod(F.col("__at") + F.col("slot"), F.lit(max(1, r.size))).cast("long")), "__at").drop("__at", "__k")


def find(keys: DataFrame, key: str, agents: DataFrame, replicas: Column | int = 1, wrap: bool = False) -> DataFrame:
    """Adds ``owners``, the agents of ``replicas`` ring points in a row from the key's place on; null where there is no ring."""
    k = F.lit(replicas) if isinstance(replicas, int) else replicas
    distinct = keys.select(F.col(key).alias("__key"), k.alias("__n")).distinct()
    slots = replica_agents(distinct, "__key", agents, F.col("__n"), wrap)
    owners = slots.groupBy("__key", "__n").agg(F.sort_array(F.collect_list(F.struct("slot", "agent_id"))).alias("o"))  # as many as there are replicas
    owners = owners.select("__key", "__n", F.transform("o", lambda x: x["agent_id"]).alias("owners"))
    return keys.withColumn("__k", k).join(owners, (F.col(key) == F.col("__key")) & (F.col("__k") == F.col("__n")), "left").drop("__key", "__n", "__k")


def find_one(keys: DataFrame, key: str, agents: DataFrame, replicas: Column | int = 1, seed: int = 0, wrap: bool = False) -> DataFrame:
    """Adds ``owners`` and ``agent``, one of them picked evenly by the hash of key and seed."""
    f = find(keys, key, agents, replicas, wrap)
    return f.withColumn("agent", F.get("owners", F.pmod(F.xxhash64(key, F.lit(seed)), F.size("owners")).cast("int")))


def owns(owners: str, agent: int) -> Column:
    """Whether an agent, or a packed virtual agent of it, is among the owners."""
    return F.array_contains(owners, agent & ((1 << 49) - 1))


def edge_owner(edges: DataFrame, agents: DataFrame, wrap: bool = False) -> DataFrame:
    """``(src, dst, in_agent, out_agent)``: the owner by ``dst`` of the edge's copy at its end, and by ``src`` of that at its start."""
    r = Ring(agents, wrap)
    a = r.locate(edges, "dst", "__i", "in_agent").drop("__i")
    return r.locate(a, "src", "__o", "out_agent").select("src", "dst", "in_agent", "out_agent")


def split_edge_owner(edges: DataFrame, agents: DataFrame, replicas: DataFrame, wrap: bool = False, side: str = "in", r: Ring | None = None) -> DataFrame:
    """``(src, dst, agent, vagent)`` of the copies at ``dst`` (side ``out``: at ``src``), where ``replicas (id, k)`` spreads a vertex over ``k`` ring points.

    The other end picks the slice: a second ring holds the ``k`` points, and the
    other end's place on it decides.  The points keep their hashes, so that place
    follows from both ends' places on the whole ring.  Vertices that are not
    listed have one point.  A key past the last point goes to the last one.
    """
    r = r or Ring(agents, wrap)
    own, other = ("dst", "src") if side == "in" else ("src", "dst")
    split = replicas.filter("k > 1").select(F.col("id").alias(own), "k")
    e = r.locate(edges.select("src", "dst"), own, "__p").join(split, own, "left")
    e = r.locate(e, other, "__q", past="past").withColumn("__q", F.when(F.col("past"), F.lit(r.size)).otherwise(F.col("__q")))
    p, q, k, n = F.col("__p"), F.col("__q"), F.least(F.coalesce("k", F.lit(1)), F.lit(r.size)), F.lit(r.size)
    last = p + k - 1
    beyond = (p if wrap else last, F.lit(0) if wrap else n - 1)
    straight = F.when(q <= p, p).when(q <= last, q).otherwise(beyond[0])
    around = F.when(q <= last - n, q).when(q <= p, p).when(q < n, q).otherwise(beyond[1])
    e = e.withColumn("__at", F.when(k <= 1, p).when(last < n, straight).otherwise(around).cast("long"))
    return r.agents_at(e, "__at").select("src", "dst", F.col("agent_id").alias("agent"), "vagent")


def agent_balance(edges: DataFrame, agents: DataFrame, wrap: bool = False) -> DataFrame:
    """``(agent_id, in_edges, vertices)`` of each agent, 0 where it holds none."""
    r = Ring(agents, wrap)
    # Edges are counted by end before their places are looked up.
    both = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(0).alias("n")), F.struct(F.col("dst").alias("id"), F.lit(1).alias("n")))).alias("e"))
    ids = both.groupBy("e.id").agg(F.sum("e.n").alias("n"))
    held = r.locate(ids, "id", "__at", "agent_id").groupBy("agent_id").agg(F.sum("n").alias("in_edges"), F.count(F.lit(1)).alias("vertices"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return agents.select("agent_id").join(held, "agent_id", "left").select("agent_id", zero("in_edges"), zero("vertices"))


def moved_edges(edges: DataFrame, before: DataFrame, after: DataFrame, wrap: bool = False) -> DataFrame:
    """``(src, dst, from_agent, to_agent)`` of the copies at ``dst`` that change their owner when the agents change."""
    a = Ring(before, wrap).locate(edges.select("src", "dst"), "dst", "__a", "from_agent")
    b = Ring(after, wrap).locate(a, "dst", "__b", "to_agent")
    return b.filter(~F.col("from_agent").eqNullSafe(F.col("to_agent"))).select("src", "dst", "from_agent", "to_agent")


def message_distribution(edges: DataFrame, active: DataFrame, agents: DataFrame, wrap: bool = False) -> DataFrame:
    """``(superstep, src_agent, dst_agent, messages)``: a sender's value goes once to each agent that owns a neighbour.

    ``active (superstep, id)`` lists the senders of each superstep.
    """
    e = edge_owner(edges, agents, wrap).select(F.col("src").alias("id"), F.col("out_agent").alias("src_agent"), F.col("in_agent").alias("dst_agent")).distinct()
    return active.join(e, "id").groupBy("superstep", "src_agent", "dst_agent").agg(F.count(F.lit(1)).alias("messages"))


def rebalanced(edges: DataFrame, agents: DataFrame, wrap: bool = False, replicas: DataFrame | None = None) -> DataFrame:
    """``agents`` with fewer virtual agents where an agent holds over 5/4 of the mean of in-edges.

    It keeps those up to the highest one that holds an edge, at its end or at its
    start, of the agent's vertex of the most edges there (the least id among
    equals).  ``replicas (id, k)`` spreads vertices as in :func:`split_edge_owner`.
    """
    s = Scratch(edges.sparkSession, "rebalance")
    none = edges.sparkSession.createDataFrame([], "id long, k int")
    r, split = Ring(agents, wrap), none if replicas is None else replicas
    copies = split_edge_owner(edges, agents, split, wrap, "in", r).select(F.col("dst").alias("v"), "agent", "vagent", F.lit(1).alias("end"))
    copies = copies.unionByName(split_edge_owner(edges, agents, split, wrap, "out", r).select(F.col("src").alias("v"), "agent", "vagent", F.lit(0).alias("end")))
    held = s.table(copies.groupBy("agent", "v").agg(F.count(F.lit(1)).alias("n"), F.sum("end").alias("in_edges"), F.max("vagent").alias("high")))
    per = held.groupBy(F.col("agent").alias("agent_id")).agg(F.sum("in_edges").alias("in_edges"), F.max_by("high", F.struct("n", -F.col("v"))).alias("high"))
    total = held.agg(F.coalesce(F.sum("in_edges"), F.lit(0)).alias("all"))
    out = agents.join(per, "agent_id", "left").join(F.broadcast(total)).join(F.broadcast(agents.agg(F.count(F.lit(1)).alias("count"))))
    full = F.expr("in_edges > 5 * all div count div 4")
    return out.select("agent_id", F.when(full & F.col("high").isNotNull(), F.least("vagents", F.col("high") + 1)).otherwise(F.col("vagents")).cast("int").alias("vagents"))


def pushed_sketch(copies: DataFrame, threshold: int, width: int, depth: int) -> DataFrame:
    """``(row, bucket, cnt)``: the directory's sketch after a load balance.

    ``copies (agent, v)`` are the edge ends that each agent holds.  An agent
    sends its own sketch only if its estimate of some vertex has reached
    ``threshold``; the directory adds up what is sent.
    """
    from ..functions.sketches import cells

    s = Scratch(copies.sparkSession, "push")
    n = s.table(copies.groupBy("agent", "v").agg(F.count(F.lit(1)).alias("n")))
    counted = cells(n, "v", width, depth)
    own = s.table(counted.groupBy("agent", "row", "bucket").agg(F.sum("n").alias("cnt")))
    estimate = counted.select("agent", "v", "row", "bucket").join(own, ["agent", "row", "bucket"]).groupBy("agent", "v").agg(F.min("cnt").alias("estimate"))
    sends = estimate.groupBy("agent").agg(F.max("estimate").alias("most")).filter(F.col("most") >= threshold).select("agent")
    return own.join(sends, "agent", "left_semi").groupBy("row", "bucket").agg(F.sum("cnt").alias("cnt"))
