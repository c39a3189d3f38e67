import random

from pyspark.sql import functions as F

from rillgraph.catalog import graph_queries
from rillgraph.engine import GraphSession
from rillgraph.functions import hashing, sketches
from rillgraph.operators import graph, placement, policy, updates
from rillgraph.plans import programs
from rillgraph.plans.components import components, incremental_components
from rillgraph.sources.edges import random_graph, read_edges, unpack_edges
from rillgraph.streaming.ingest import SnapshotStore, ingest, replay, stream_lines


def E(spark, *pairs):
    return spark.createDataFrame(list(pairs), "src long, dst long")


def values(df, v="value"):
    return {r.id: r[v] for r in df.collect()}


def find(pairs):
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    return {x: top(x) for x in list(root)}


def test_golden_programs(spark):
    tail = E(spark, (1, 2), (2, 3), (3, 1), (3, 4))
    assert values(programs.coreness(tail).state) == {1: 2, 2: 2, 3: 2, 4: 1}
    pr = values(programs.pagerank(E(spark, (1, 2))).state)
    assert abs(pr[1] - 0.075) < 1e-12 and abs(pr[2] - 0.13875) < 1e-12
    path = E(spark, *[(i, i + 1) for i in range(40)])
    r = programs.bfs(path, [0])
    assert values(r.state) == {i: i for i in range(41)} and r.converged
    assert values(programs.bfs(E(spark, (1, 2), (3, 2)), [1], directed=True).state) == {1: 0, 2: 1, 3: None}
    lpa = programs.label_propagation(E(spark, (1, 2), (2, 3), (3, 1), (3, 4)), 20)
    assert set(values(lpa.state).values()) <= {1, 2, 3, 4}
    assert not programs.label_propagation(E(spark, (1, 2)), 5).converged


def test_components_match_union_find(spark):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(100, 400)] + [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(90)] + [(7, 7)]
    e = E(spark, *pairs)
    assert values(components(e), "component") == find(pairs)
    before = components(E(spark, (1, 2), (2, 3), (5, 6)))
    after = incremental_components(E(spark, (1, 2), (5, 6), (6, 1)), before, E(spark, (2, 3)))
    assert values(after, "component") == {1: 1, 2: 1, 5: 1, 6: 1}


def test_updates(spark):
    u = spark.createDataFrame([(1, 1, 1, 2), (2, -1, 1, 2), (3, 1, 3, 4), (4, -1, 9, 9), (5, 1, 1, 5), (6, 1, 1, 5)], "seq long, op int, src long, dst long")
    got = updates.apply_updates(E(spark, (7, 8), (1, 2)), u)
    assert sorted(map(tuple, got.collect())) == [(1, 5), (3, 4), (7, 8)]
    assert updates.clean_updates(spark.createDataFrame([(1, 1, None, 2), (2, 0, 1, 2), (3, None, 1, 2), (4, 1, 1, -1)], "seq long, op int, src long, dst long")).isEmpty()


def test_engine(spark, tmp_path):
    g = GraphSession(spark, E(spark, (1, 2), (2, 3), (1, 2)))
    assert values(g.run("wcc")) == {1: 1, 2: 1, 3: 1}
    g.update(spark.createDataFrame([(1, 1, 3, 4)], "seq long, op int, src long, dst long"))
    assert values(g.run("wcc")) == {1: 1, 2: 1, 3: 1, 4: 1}
    g.update(spark.createDataFrame([(2, -1, 2, 3), (3, -1, 3, 4)], "seq long, op int, src long, dst long"))
    assert tuple(g.materialize().first()) == (2, 1, 0, 0)
    assert values(g.query("wcc", [1, 99])) == {1: 1, 99: -1}
    g.check_transpose()
    g.dump(str(tmp_path / "el"))
    assert spark.read.text(str(tmp_path / "el")).first()[0] == "1 2"
    g.save("wcc", str(tmp_path / "out"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "out")).collect()) == ["1 1", "2 1"]
    g.reset()
    assert g.results == {} and g.heartbeat().count() >= 3


def test_hash_and_sketch(spark):
    keys = spark.createDataFrame([(0,), (1,), (None,), (2**62,)], "k long")
    h = {r.k: r.u for r in hashing.with_wang(keys, "k").withColumn("u", hashing.unsigned("h").cast("string")).collect()}
    assert h[0] == "8633297058295171728" and h[None] is None
    a = spark.createDataFrame([(20,)] * 500 + [(i,) for i in range(100)], "k long")
    est = {r.k: r.estimate for r in sketches.count_min_estimate(sketches.count_min(a, "k", 1024, 4), a, "k", 1024, 4).collect()}
    assert est[20] >= 501 and all(v >= 1 for v in est.values())
    x, y = a.limit(300), a.exceptAll(a.limit(300))
    assert sketches.equal(sketches.merge(sketches.count_min(x, "k", 64, 3), sketches.count_min(y, "k", 64, 3)), sketches.count_min(a, "k", 64, 3))
    p = spark.range(1).select(hashing.pack_agent(F.lit(4).cast("long"), F.lit(1)).alias("p"))
    assert tuple(p.select(*hashing.unpack_agent(F.col("p"))).first()) == (4, 1)


def test_placement(spark):
    agents = spark.createDataFrame([(i, 100) for i in range(1, 6)], "agent_id long, vagents int")
    assert placement.find_one(spark.createDataFrame([(2,)], "id long"), "id", agents).first().agent == 2
    assert placement.ring(agents).count() == 500
    assert placement.find(spark.createDataFrame([(2,)], "id long"), "id", agents.limit(0)).first().owners is None
    assert placement.moved_edges(E(spark, (1, 2)), agents, agents).isEmpty()


def test_policy():
    assert policy.autoscale_actions([5] * 40, 3, hold=2)[-1][1] == 5
    assert policy.query_schedule()[5] == (5, 300, 6)


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# c\n1 2\n2 3\n")
    (tmp_path / "b.txt").write_text("-1 1 2 0.5 7\n+1 4 5 1 8\n")
    rows = read_edges(spark, [(str(tmp_path / "a.txt"), "el"), (str(tmp_path / "b.txt"), "dyn")])
    assert sorted(map(tuple, updates.last_wins(rows).filter("op = 1").select("src", "dst").collect())) == [(2, 3), (4, 5)]
    g = random_graph(spark, 100, 500, seed=2)
    assert g.count() == g.distinct().count() == 500 and g.filter("src = dst").isEmpty()
    b = b"".join(x.to_bytes(8, "little") for x in (1, 2, 3, 2**40, 0))
    assert sorted(map(tuple, unpack_edges(spark.createDataFrame([(bytearray(b),)], "value binary")).collect())) == [(1, 2), (3, 2**40)]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.txt").write_text("+1 1 2 1 1\n+1 2 3 1 1\nbad line\n")
    store = SnapshotStore(spark, str(tmp_path / "s"))
    ingest(stream_lines(spark, str(tmp_path / "in")), store, str(tmp_path / "c")).awaitTermination()
    (tmp_path / "in" / "2.txt").write_text("-1 1 2 1 1\n")
    ingest(stream_lines(spark, str(tmp_path / "in")), store, str(tmp_path / "c")).awaitTermination()
    assert sorted(map(tuple, store.read().collect())) == [(2, 3)] and store.batches() == [0, 1]
    store.apply(store.read().limit(0).selectExpr("1L as seq", "1 as op", "src", "dst"), 1)  # a replayed batch changes nothing
    assert graph.graph_stats(store.read()).first().edges == 1


def test_deep_paths_run_to_the_fixpoint(spark):
    path = E(spark, *[(i, i + 1) for i in range(1010)])
    r = programs.bfs(path, [0], directed=True)
    assert values(r.state) == {i: i for i in range(1011)} and r.converged


def test_programs_have_no_superstep_cap(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(programs, "run", lambda p, e, keep_history=False, most=None: asked.append((p.most, most)))
    e = E(spark, (1, 2))
    programs.bfs(e, [1]), programs.label_components(e), programs.coreness(e)
    assert asked == [(None, None)] * 3


def test_replay_applies_every_batch(spark, tmp_path):
    u = spark.createDataFrame([(0, 1, 7, 8), (1, 1, 1, 2), (2, 1, 2, 3), (3, -1, 1, 2), (9, 1, 5, 6)], "seq long, op int, src long, dst long")
    some, store = SnapshotStore(spark, str(tmp_path / "k")), SnapshotStore(spark, str(tmp_path / "all"))
    replay(u, some, 2, 1)
    assert sorted(map(tuple, some.read().collect())) == sorted(map(tuple, updates.snapshot_after(None, u, 2, 1).collect())) == [(1, 2), (2, 3), (7, 8)]
    replay(u, store, 2)
    assert sorted(map(tuple, store.read().collect())) == [(2, 3), (5, 6), (7, 8)] and store.batches() == [-1, 0, 1, 4]


def test_lpa_edge_all_runs_all_rounds(spark, tmp_path):
    pairs = [(i, i + 1) for i in range(30)]
    E(spark, *pairs).write.parquet(str(tmp_path / "edge.parquet"))
    near = {i: [x for p in pairs if i in p for x in p if x != i] for i in range(31)}
    label = {i: i for i in near}
    for _ in range(programs.ROUNDS):
        heard = {i: [label[x] for x in near[i]] for i in near}
        label = {i: min(heard[i], key=lambda x: (-heard[i].count(x), x)) for i in near}
    assert values(graph_queries.Q["lpa_edge_all"](spark, str(tmp_path))) == label != values(graph_queries.Q["lpa_edge"](spark, str(tmp_path)))


def test_sketch_report_all_has_true_replicas(spark, tmp_path):
    rows = spark.range(20_000).selectExpr("id div 4 as l_partkey", "id % 400 as l_suppkey")
    rows.write.parquet(str(tmp_path / "lineitem.parquet"))
    got = graph_queries.Q["sketch_report_all"](spark, str(tmp_path))
    assert got.filter("estimate <> in_degree + out_degree or replicas <> 1").isEmpty() and got.count() == 5_400
    small = graph_queries.Q["sketch_report"](spark, str(tmp_path))
    assert not small.filter("estimate <> in_degree + out_degree").isEmpty()


def test_message_distribution_of_a_run(spark):
    e = E(spark, (0, 1), (0, 2), (1, 3), (2, 3), (9, 9))
    sent = programs.senders(programs.bfs(e, [0], directed=True, keep_history=True))
    assert sorted(map(tuple, sent.collect())) == [(0, 0), (1, 1), (1, 2), (2, 3)]
    agents = spark.createDataFrame([(1, 100)], "agent_id long, vagents int")
    assert sorted(map(tuple, placement.message_distribution(e, sent, agents).collect())) == [(0, 1, 1, 1), (1, 1, 1, 2)]


def test_stream_ingest_writes_with_many_tasks(spark, tmp_path, monkeypatch):
    at = "timestamp '2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, id)"
    spark.range(400).selectExpr("id as event_id", f"{at} as ts", "id % 7 as user_id", "if(id % 5 = 0, 'error', 'view') as event_type").write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(graph_queries, "_store", lambda s: (SnapshotStore(s, str(tmp_path / "s")), str(tmp_path / "s")))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    got = graph_queries.Q["stream_ingest_foreach_batch"](spark, str(tmp_path))
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")
    steps = graph_queries.G.user_steps(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, updates.last_wins(steps).filter("op = 1").select("src", "dst").collect()))
    assert len(list((tmp_path / "s" / "changes").glob("*.parquet"))) > 4 and SnapshotStore(spark, str(tmp_path / "s")).batches() == [0, 1, 2, 3]
