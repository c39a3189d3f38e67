from collections import Counter

from pyspark.sql import functions as F

from rillgraph.operators import graph, placement
from rillgraph.operators.skew import add_salt, hot_keys, salted_join


def test_salted_join_keeps_every_row(spark):
    left = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 100).alias("k"), F.col("id").alias("x"))
    right = spark.range(50).select(F.col("id").alias("k"), (F.col("id") * 2).alias("y"))
    hot = hot_keys(left.groupBy("k").count(), "k", "count", 5000, share=20)
    assert [k for k, _ in hot] == [7] and hot[0][1] >= 6
    for how in ("inner", "left"):
        want = Counter(map(tuple, left.join(right, "k", how).collect()))
        assert Counter(map(tuple, salted_join(left, right, "k", F.col("x"), hot, how).collect())) == want
    assert add_salt(left, "k", F.col("x"), hot).filter("k = 7").select("__salt").distinct().count() == hot[0][1]
    assert hot_keys(left.groupBy("k").count(), "k", "count", 10) == []


def test_split_owners_are_among_the_replicas(spark):
    agents = spark.createDataFrame([(i, 20) for i in range(1, 9)], "agent_id long, vagents int")
    edges = spark.createDataFrame([(i, i % 5) for i in range(300)], "src long, dst long")
    k = spark.createDataFrame([(0, 4), (1, 3)], "id long, k int")
    got = {(r.src, r.dst): r.agent for r in placement.split_edge_owner(edges, agents, k).collect()}
    one = {(r.src, r.dst): r.in_agent for r in placement.edge_owner(edges, agents).collect()}
    owners = {r.id: set(r.owners) for r in placement.find(spark.range(5), "id", agents, 4).collect()}
    assert set(got) == set(one) and all(got[e] == one[e] for e in got if e[1] > 1)
    assert {got[e] for e in got if e[1] == 0} <= owners[0] and len({got[e] for e in got if e[1] == 0}) > 1
    kept = {r.agent_id: r.vagents for r in placement.rebalanced(edges, agents).collect()}
    assert set(kept) == set(range(1, 9)) and all(1 <= v <= 20 for v in kept.values()) and min(kept.values()) < 20
    lines = {r.id: r.line for r in graph.adjacency_lines(edges, symmetric=True).collect()}
    assert len(lines) == 300 and lines[0] == "0\t61 0 " + " ".join(str(i) for i in range(0, 300, 5)) and lines[7] == "7\t1 2"
