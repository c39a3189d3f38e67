"""The graph engine's queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing, sketches
from ..operators import graph, placement, policy, updates
from ..plans import programs
from ..plans.components import components, incremental_components
from ..session import Scratch
from ..sinks.text import history_lines, result_lines, sketch_report
from ..sources.edges import parse_lines, random_graph
from ..streaming.ingest import SnapshotStore, ingest, replay
from . import graphs as G

SIZE, BATCHES, LINE_LAYOUT = 1000, 4, "dyn"
WIDTH, DEPTH = 256, 4
REPLAYED = 16
Q = {}
SQL = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _u(e: str) -> str:
    return f"e AS ({e}), u AS (SELECT src AS a, dst AS b FROM e UNION ALL SELECT dst, src FROM e)"


# -- sources, snapshot, statistics ------------------------------------------------------------------------------------

query("edges_customer_part", G.CUST_PART)(G.cust_part)
query("edges_user_next", G.USER_NEXT)(G.user_next)
query("edges_load", G.EDGE)(G.edge)


@query("parse_dyn_lines", r"""WITH t AS (SELECT line_id, trim(raw, ' ' || chr(9) || chr(13) || chr(10)) AS t FROM edge_line WHERE layout = 'dyn'),
f AS (SELECT line_id, regexp_split_to_array(t, '[ \t]+') AS f FROM t WHERE t <> '' AND t[1] NOT IN ('%', '#'))
SELECT line_id, CASE WHEN NOT regexp_full_match(f[2], '[0-9]+') OR NOT regexp_full_match(f[3], '[0-9]+') OR try_cast(f[2] AS BIGINT) IS NULL OR try_cast(f[3] AS BIGINT) IS NULL
 OR f[2] IS NULL OR f[3] IS NULL OR try_cast(f[1] AS INTEGER) IS NULL OR f[1] IS NULL OR f[4] IS NULL OR f[5] IS NULL OR NOT regexp_full_match(f[4], '[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?')
 OR NOT regexp_full_match(f[5], '[0-9]+') OR try_cast(f[5] AS BIGINT) IS NULL THEN 'Invalid parameter while parsing edge.'
 WHEN try_cast(f[1] AS INTEGER) NOT IN (1, -1) THEN 'Insert/delete flag must be first entry in line' WHEN len(f) > 5 THEN 'Extra data on input line' END AS reason FROM f""")
def parse_dyn_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = G.table(spark, d, "edge_line").filter(F.col("layout") == LINE_LAYOUT).select("line_id", F.col("raw").alias("value"))
    return parse_lines(rows, LINE_LAYOUT, strict=False).select("line_id", F.col("_reason").alias("reason"))


_STATS = """SELECT (SELECT count(*) FROM (SELECT src FROM e UNION SELECT dst FROM e)) AS vertices, (SELECT count(*) FROM e) AS edges, (SELECT count(*) FROM e WHERE src = dst) AS self_loops,
 (SELECT count(*) FROM e x JOIN e y ON x.src = y.dst AND x.dst = y.src WHERE x.src <> x.dst) AS reciprocal"""
query("graph_stats", f"WITH e AS ({G.USER_NEXT}) {_STATS}")(lambda s, d: graph.graph_stats(G.user_next(s, d)))
query("graph_stats_edge", f"WITH e AS ({G.EDGE}) {_STATS}")(lambda s, d: graph.graph_stats(G.edge(s, d)))
_DEG = f"WITH {_u(G.EDGE)}, k AS (SELECT src AS a, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e)"
query("degrees", f"{_DEG} SELECT a AS id, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree, count(*) AS degree FROM k GROUP BY a")(lambda s, d: graph.degrees(G.edge(s, d)))
query("max_degree_vertex", f"{_DEG} SELECT a AS id, count(*) AS degree FROM k GROUP BY a ORDER BY 2 DESC, 1 LIMIT 1")(lambda s, d: graph.max_degree_vertex(G.edge(s, d)))
query("transpose", f"WITH e AS ({G.USER_NEXT}) SELECT dst AS src, src AS dst FROM e")(lambda s, d: graph.transpose(G.user_next(s, d)))


@query("transpose_check", f"WITH e AS ({G.USER_NEXT}), t AS (SELECT dst AS src, src AS dst FROM e WHERE (src + dst) % 5 <> 0) SELECT src, dst, 'copy' AS missing FROM e WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.src = e.dst AND t.dst = e.src)")
def transpose_check(spark: SparkSession, d: str) -> DataFrame:
    """Edges whose copy was lost: the copies of edges whose ends' sum is a multiple of 5 are left out to have some."""
    e = G.user_next(spark, d)
    return graph.transpose_check(e, graph.transpose(e.filter("(src + dst) % 5 <> 0")))


query("adjacency_dump", f"WITH e AS ({G.PART_SUPP}) SELECT src AS id, src || chr(9) || count(*) || ' ' || string_agg(dst, ' ' ORDER BY dst) AS line FROM e GROUP BY src")(lambda s, d: graph.adjacency_lines(G.part_supp(s, d)))
query("sym_adjacency_dump", f"WITH e AS ({G.USER_NEXT}), k AS (SELECT src AS a, dst AS b, 0 AS i FROM e UNION ALL SELECT dst, src, 1 FROM e) SELECT a AS id, a || chr(9) || count(*) || ' ' || string_agg(b, ' ' ORDER BY i, b) AS line FROM k GROUP BY a")(
    lambda s, d: graph.adjacency_lines(G.user_next(s, d), symmetric=True)
)

# -- changes ----------------------------------------------------------------------------------------------------------

_LAST = f"WITH s AS (SELECT * FROM ({G.USER_STEPS}) WHERE dst IS NOT NULL), l AS (SELECT src, dst, arg_max(op, seq) AS op, max(seq) AS seq FROM s"
query("updates_last_wins", f"{_LAST} GROUP BY src, dst) SELECT src, dst, op, seq FROM l")(lambda s, d: updates.last_wins(G.user_steps(s, d)))
_SNAP = f"{_LAST} WHERE (seq - 1) // {SIZE} < {BATCHES} GROUP BY src, dst) SELECT src, dst FROM l WHERE op = 1"
query("snapshot_after_k_batches", _SNAP)(lambda s, d: updates.snapshot_after(None, G.user_steps(s, d), SIZE, BATCHES))
query("batch_stats", f"""WITH s AS (SELECT *, (CASE WHEN seq < 1 THEN -1 ELSE (seq - 1) // {SIZE} END)::BIGINT AS batch_id FROM ({G.USER_STEPS}) WHERE dst IS NOT NULL),
 l AS (SELECT batch_id, src, dst, count(*) AS n, arg_max(op, seq) AS op FROM s GROUP BY 1, 2, 3)
 SELECT batch_id, sum(n)::BIGINT AS changes, count(*) AS edges_changed, count(*) FILTER (op = 1) AS inserts, count(*) FILTER (op = -1) AS deletes FROM l GROUP BY 1""")(lambda s, d: updates.batch_stats(G.user_steps(s, d), SIZE))
_CHANGED = "u AS (SELECT src, dst, max({'seq': seq, 'op': op}) AS x FROM edge_update WHERE src >= 0 AND dst >= 0 AND op IN (1, -1) GROUP BY 1, 2), a AS (SELECT coalesce(e.src, u.src) AS src, coalesce(e.dst, u.dst) AS dst FROM e FULL JOIN u ON e.src = u.src AND e.dst = u.dst WHERE u.x IS NULL OR u.x.op = 1)"
query("apply_updates", f"WITH e AS ({G.EDGE}), {_CHANGED} SELECT src, dst FROM a")(lambda s, d: updates.apply_updates(G.edge(s, d), updates.clean_updates(G.table(s, d, "edge_update"))))


def _store(spark: SparkSession) -> tuple[SnapshotStore, str]:
    root = Scratch(spark, "stream").root
    return SnapshotStore(spark, root), root


@query("stream_replay", _SNAP)
def stream_replay(spark: SparkSession, d: str) -> DataFrame:
    store, _ = _store(spark)
    steps = Scratch(spark, "replay").table(G.user_steps(spark, d))
    replay(steps, store, SIZE, BATCHES)
    return store.read()


@query("stream_replay_all", f"{_LAST} GROUP BY src, dst) SELECT src, dst FROM l WHERE op = 1")
def stream_replay_all(spark: SparkSession, d: str) -> DataFrame:
    """All changes, in some REPLAYED batches whatever the stream's length; stream_replay stops after BATCHES of SIZE."""
    store, _ = _store(spark)
    steps = Scratch(spark, "replay").table(G.user_steps(spark, d))
    least, most = steps.agg(F.min("seq"), F.max("seq")).first()
    size = SIZE if least is None else max(SIZE, (most - least) // REPLAYED + 1)
    replay(steps, store, size, keep=2)
    return store.read()


@query("stream_ingest_foreach_batch", f"{_LAST} GROUP BY src, dst) SELECT src, dst FROM l WHERE op = 1")
def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    """The change stream read as a stream of files, which come in four parts; a part is a mini-batch of as many files as it has tasks."""
    store, root = _store(spark)
    folder = f"{root}/changes"
    steps = Scratch(spark, "changes").table(G.user_steps(spark, d))
    most = steps.agg(F.max("seq")).first()[0] or 0
    for quarter in range(4):  # the later changes in the later part, which comes after the part before is applied
        steps.filter(F.least(F.lit(3), F.floor(F.col("seq") * 4 / (most + 1))) == quarter).write.mode("append").parquet(folder)
        ingest(spark.readStream.schema(steps.schema).parquet(folder), store, f"{root}/checkpoint").awaitTermination()
    return store.read()


# -- vertex programs --------------------------------------------------------------------------------------------------


def _pagerank_sql(e: str, k: int) -> str:
    return f"""WITH RECURSIVE e AS ({e}), v AS (SELECT src AS id FROM e UNION SELECT dst FROM e), n AS (SELECT count(*)::DOUBLE AS n FROM v), od AS (SELECT src, count(*) AS d FROM e GROUP BY src),
 pr(k, id, r) AS (SELECT 0, id, 1.0 / n FROM v, n UNION ALL SELECT pk.k + 1, v.id, 0.15 / n.n + 0.85 * coalesce(s.s, 0) FROM (SELECT max(k) AS k FROM pr) pk, n, v
  LEFT JOIN (SELECT e.dst AS id, sum(pr.r / od.d) AS s FROM pr JOIN e ON e.src = pr.id JOIN od ON od.src = e.src GROUP BY 1) s ON s.id = v.id WHERE pk.k < {k})
 SELECT id, round(r, 9) AS value FROM pr WHERE k = {k}"""


query("pagerank", _pagerank_sql(G.USER_NEXT, 20))(lambda s, d: programs.pagerank(G.user_next(s, d)).state.select("id", F.round("value", 9).alias("value")))
query("pagerank_edge", _pagerank_sql(G.EDGE, 20))(lambda s, d: programs.pagerank(G.edge(s, d)).state.select("id", F.round("value", 9).alias("value")))
query("pagerank_k", _pagerank_sql(G.CUST_PART, 5))(lambda s, d: programs.pagerank(G.cust_part(s, d), updates=5).state.select("id", F.round("value", 9).alias("value")))


def _labels(e: str, k: int, more: str = "") -> str:
    return f"""WITH RECURSIVE {_u(e)}{more}, l(k, id, lab) AS (SELECT 0, a, a FROM (SELECT DISTINCT a FROM u) UNION ALL (WITH cur AS (SELECT * FROM l),
 nx AS (SELECT id, min(m) AS lab FROM (SELECT id, lab AS m FROM cur UNION ALL SELECT u.b, cur.lab FROM cur JOIN u ON u.a = cur.id) GROUP BY id)
 SELECT (SELECT max(k) + 1 FROM cur), nx.id, nx.lab FROM nx WHERE (SELECT max(k) FROM cur) < {k}))"""


query("wcc", f"{_labels(G.CUST_REGION, 12)} SELECT id, lab AS component FROM l WHERE k = 12")(lambda s, d: components(G.cust_region(s, d)))
query("wcc_sizes", f"{_labels(G.CUST_REGION, 12)} SELECT lab AS component, count(*) AS vertices FROM l WHERE k = 12 GROUP BY 1")(lambda s, d: components(G.cust_region(s, d)).groupBy("component").agg(F.count(F.lit(1)).alias("vertices")))
# Chains in the edge table are long: hub-first relabelling has no short SQL, so this one has none and is tested by union-find.
query("wcc_edge")(lambda s, d: components(G.edge(s, d)))


@query("wcc_incremental", f"{_labels(f'SELECT * FROM ({G.CUST_REGION}) WHERE NOT (src >= {G.SECOND} AND src % 2 = 1)', 12)} SELECT id, lab AS component FROM l WHERE k = 12")
def wcc_incremental(spark: SparkSession, d: str) -> DataFrame:
    """Components after a batch that deletes the links of odd nations to their regions."""
    e = Scratch(spark, "wcc").table(G.cust_region(spark, d))
    gone = e.filter(f"src >= {G.SECOND} and src % 2 = 1")
    return incremental_components(e.join(gone, ["src", "dst"], "left_anti"), Scratch(spark, "wcc").table(components(e)), gone)


query("active_per_superstep", f"{_labels(G.CUST_REGION, 12)}, c AS (SELECT y.k AS superstep, count(*) FILTER (x.lab <> y.lab) AS active FROM l x JOIN l y ON x.id = y.id AND y.k = x.k + 1 GROUP BY 1) SELECT superstep::INTEGER AS superstep, active FROM c WHERE superstep <= (SELECT min(superstep) FROM c WHERE active = 0)")(
    lambda s, d: programs.active_counts(programs.label_components(G.cust_region(s, d), keep_history=True))
)


def _bfs(e: str, start: int, directed: bool) -> str:
    step = "SELECT src AS a, dst AS b FROM e" if directed else "SELECT src AS a, dst AS b FROM e UNION ALL SELECT dst, src FROM e"
    return f"WITH RECURSIVE e AS ({e}), u AS ({step}), v AS (SELECT src AS id FROM e UNION SELECT dst FROM e), b(id, d) AS (SELECT {start}::BIGINT, 0 UNION SELECT u.b, b.d + 1 FROM b JOIN u ON u.a = b.id WHERE b.d < 8), m AS (SELECT id, min(d)::BIGINT AS value FROM b GROUP BY id)"


query("bfs_sym", f"{_bfs(G.CUST_REGION, 0, False)} SELECT v.id, coalesce(m.value, -1) AS value FROM v LEFT JOIN m ON v.id = m.id")(lambda s, d: programs.bfs(G.cust_region(s, d), [0]).state.select("id", F.coalesce("value", F.lit(-1)).alias("value")))
query("bfs_directed", f"{_bfs(G.USER_NEXT, 0, True)} SELECT v.id, coalesce(m.value, -1) AS value FROM v LEFT JOIN m ON v.id = m.id")(lambda s, d: programs.bfs(G.user_next(s, d), [0], directed=True).state.select("id", F.coalesce("value", F.lit(-1)).alias("value")))
query("bfs_histogram", f"{_bfs(G.PART_SUPP, 0, False)} SELECT m.value AS hops, count(*) AS vertices FROM v LEFT JOIN m ON v.id = m.id GROUP BY 1")(
    lambda s, d: programs.bfs(G.part_supp(s, d), [0]).state.groupBy(F.col("value").alias("hops")).agg(F.count(F.lit(1)).alias("vertices"))
)


def _lpa(e: str, k: int) -> str:
    return f"""WITH RECURSIVE {_u(e)}, l(k, id, lab) AS (SELECT 0, a, a FROM (SELECT DISTINCT a FROM u) UNION ALL (WITH cur AS (SELECT * FROM l), f AS (SELECT u.b AS id, cur.lab, count(*) AS n FROM cur JOIN u ON u.a = cur.id GROUP BY 1, 2)
 SELECT (SELECT max(k) + 1 FROM cur), id, lab FROM (SELECT id, lab, row_number() OVER (PARTITION BY id ORDER BY n DESC, lab) AS r FROM f) WHERE r = 1 AND (SELECT max(k) FROM cur) < {k}))
 SELECT id, lab AS value FROM l WHERE k = {k}"""


query("lpa_k", _lpa(G.PART_SUPP, 5))(lambda s, d: programs.label_propagation(G.part_supp(s, d), 5).state.select("id", "value"))
query("lpa_edge", _lpa(G.EDGE, 4))(lambda s, d: programs.label_propagation(G.edge(s, d), 4).state.select("id", "value"))
# The operator's whole ROUNDS; lpa_edge stops after the 4 of its SQL.
query("lpa_edge_all", _lpa(G.EDGE, programs.ROUNDS))(lambda s, d: programs.label_propagation(G.edge(s, d)).state.select("id", "value"))


def _core(e: str, k: int) -> str:
    return f"""WITH RECURSIVE {_u(e)}, l(k, id, t) AS (SELECT 0, a, count(*) FROM u GROUP BY a UNION ALL (WITH cur AS (SELECT * FROM l), r AS (SELECT u.b AS id, cur.t, row_number() OVER (PARTITION BY u.b ORDER BY cur.t DESC) AS rn FROM cur JOIN u ON u.a = cur.id),
 h AS (SELECT id, count(*) FILTER (t >= rn) AS t FROM r GROUP BY id) SELECT (SELECT max(k) + 1 FROM cur), cur.id, least(cur.t, h.t) FROM cur JOIN h ON h.id = cur.id WHERE (SELECT max(k) FROM cur) < {k}))
 SELECT id, t AS value FROM l WHERE k = {k}"""


query("kcore", _core(G.CUST_PART, 30))(lambda s, d: programs.coreness(G.cust_part(s, d)).state.select("id", "value"))
query("hindex_round_k", _core(G.USER_NEXT, 1))(lambda s, d: programs.coreness(G.user_next(s, d), most=1).state.select("id", "value"))


@query("vertex_query", f"WITH e AS ({G.CUST_REGION}), d AS (SELECT a AS id, count(*) AS n FROM (SELECT src AS a FROM e UNION ALL SELECT dst FROM e) GROUP BY 1) SELECT s_suppkey AS id, coalesce(n, 0) AS value FROM supplier LEFT JOIN d ON id = s_suppkey")
def vertex_query(spark: SparkSession, d: str) -> DataFrame:
    """A batch of point queries: the degrees of the ids in supplier, 0 where the id is no vertex."""
    asked = G.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))
    return asked.join(graph.degrees(G.cust_region(spark, d)), "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("value"))


query("save_lines", f"{_bfs(G.CUST_REGION, 0, False)} SELECT v.id || ' ' || coalesce(m.value::VARCHAR, '18446744073709551615') AS line FROM v LEFT JOIN m ON v.id = m.id")(lambda s, d: result_lines(programs.bfs(G.cust_region(s, d), [0]).state))
query("state_history", f"{_labels(G.CUST_REGION, 12)}, c AS (SELECT y.k AS s, count(*) FILTER (x.lab <> y.lab) AS n FROM l x JOIN l y ON x.id = y.id AND y.k = x.k + 1 GROUP BY 1) SELECT k::INTEGER AS superstep, id || ':' || lab AS line FROM l WHERE k <= (SELECT min(s) FROM c WHERE n = 0)")(
    lambda s, d: history_lines(programs.label_components(G.cust_region(s, d), keep_history=True).history)
)

# -- hashes, sketches, placement --------------------------------------------------------------------------------------

_M = "18446744073709551616::HUGEINT"


def wang(x: str, name: str, src: str, keep: str) -> str:
    """CTEs that end in ``name (keep, h ubigint)``, the hash of ``x`` over ``src``."""
    n = name
    return f"""{n}1 AS (SELECT {keep}, ((18446744073709551615::HUGEINT - ({x})::HUGEINT + ((({x})::HUGEINT) * 2097152) % {_M}) % {_M})::UBIGINT AS h FROM {src}),
{n}2 AS (SELECT {keep}, xor(h, h >> 24) AS h FROM {n}1), {n}3 AS (SELECT {keep}, ((h::HUGEINT * 265) % {_M})::UBIGINT AS h FROM {n}2), {n}4 AS (SELECT {keep}, xor(h, h >> 14) AS h FROM {n}3),
{n}5 AS (SELECT {keep}, ((h::HUGEINT * 21) % {_M})::UBIGINT AS h FROM {n}4), {n}6 AS (SELECT {keep}, xor(h, h >> 28) AS h FROM {n}5), {n} AS (SELECT {keep}, ((h::HUGEINT + h::HUGEINT * 2147483648) % {_M})::UBIGINT AS h FROM {n}6)"""


query("wang_hash", f"WITH k AS (SELECT o_orderkey AS id FROM orders), {wang('id', 'w', 'k', 'id')} SELECT id, h::VARCHAR AS hash FROM w")(
    lambda s, d: hashing.with_wang(G.table(s, d, "orders").select(F.col("o_orderkey").alias("id")), "id").select("id", hashing.unsigned("h").cast("string").alias("hash"))
)


query("finaliser_hash", f"""WITH k AS (SELECT o_orderkey AS id FROM orders), a AS (SELECT id, xor(id::UBIGINT, id::UBIGINT >> 30) AS h FROM k), b AS (SELECT id, ((h >> 32)::HUGEINT * {hashing.FINALISER[0]} % 4294967296 * 4294967296 + (h % 4294967296)::HUGEINT * {hashing.FINALISER[0]}) % {_M} AS h FROM a),
c AS (SELECT id, xor(h::UBIGINT, h::UBIGINT >> 27) AS h FROM b), d AS (SELECT id, ((h >> 32)::HUGEINT * {hashing.FINALISER[1]} % 4294967296 * 4294967296 + (h % 4294967296)::HUGEINT * {hashing.FINALISER[1]}) % {_M} AS h FROM c) SELECT id, xor(h::UBIGINT, h::UBIGINT >> 31)::VARCHAR AS hash FROM d""")(
    lambda s, d: hashing.with_finaliser(G.table(s, d, "orders").select(F.col("o_orderkey").alias("id")), "id").select("id", hashing.unsigned("h").cast("string").alias("hash"))
)


def _keys(spark: SparkSession, d: str) -> DataFrame:
    return G.table(spark, d, "lineitem").select(F.col("l_partkey").alias("id"))


_CELLS = f"k AS (SELECT l_partkey AS id, count(*) AS n FROM lineitem GROUP BY 1), kr AS (SELECT id, n, r.r AS r FROM k, range({DEPTH}) r(r)), {wang('xor(id, r)', 'w', 'kr', 'id, n, r')}, c AS (SELECT id, n, r, (h % {WIDTH})::INTEGER AS b FROM w)"
query("cms_estimate", f"WITH {_CELLS}, s AS (SELECT r, b, sum(n)::BIGINT AS cnt FROM c GROUP BY 1, 2) SELECT c.id, min(cnt) AS estimate FROM c JOIN s ON c.r = s.r AND c.b = s.b GROUP BY 1")(
    lambda s, d: sketches.count_min_estimate(sketches.count_min(_keys(s, d), "id", WIDTH, DEPTH), _keys(s, d), "id", WIDTH, DEPTH)
)
_SIGNED = f"{_CELLS}, {wang(f'xor(id, {DEPTH} + r)', 'g', 'c', 'id, n, r, b')}, x AS (SELECT id, n, r, b, CASE WHEN h % 2 = 0 THEN 1 ELSE -1 END AS sg FROM g), s AS (SELECT r, b, sum(n * sg)::BIGINT AS cnt FROM x GROUP BY 1, 2)"
query("count_sketch_estimate", f"WITH {_SIGNED}, v AS (SELECT x.id, list(cnt * sg ORDER BY cnt * sg) AS l FROM x JOIN s ON x.r = s.r AND x.b = s.b GROUP BY 1) SELECT id, floor((l[{DEPTH // 2}] + l[{DEPTH // 2 + 1}]) / 2)::BIGINT AS estimate FROM v")(
    lambda s, d: sketches.count_sketch_estimate(sketches.count_sketch(_keys(s, d), "id", WIDTH, DEPTH), _keys(s, d), "id", WIDTH, DEPTH)
)

query("count_sketch_table", f"WITH {_SIGNED} SELECT r::INTEGER AS row, b AS bucket, cnt FROM s")(lambda s, d: sketches.count_sketch(_keys(s, d), "id", WIDTH, DEPTH))


@query("sketch_merge", f"WITH {_CELLS} SELECT r::INTEGER AS row, b AS bucket, sum(n)::BIGINT AS cnt FROM c GROUP BY 1, 2")
def sketch_merge(spark: SparkSession, d: str) -> DataFrame:
    k = G.table(spark, d, "lineitem").select(F.col("l_partkey").alias("id"), "l_suppkey")
    parts = [sketches.count_min(k.filter(f"l_suppkey % 2 = {i}"), "id", WIDTH, DEPTH) for i in (0, 1)]
    return sketches.merge(*parts)



def _report(width: int, depth: int) -> str:
    return f"e AS ({G.PART_SUPP}), k AS (SELECT a AS id, count(*) AS n FROM (SELECT src AS a FROM e UNION ALL SELECT dst FROM e) GROUP BY 1), kr AS (SELECT id, n, r.r AS r FROM k, range({depth}) r(r)), {wang('xor(id, r)', 'w', 'kr', 'id, n, r')}, c AS (SELECT id, n, r, (h % {width})::INTEGER AS b FROM w), s AS (SELECT r, b, sum(n)::BIGINT AS cnt FROM c GROUP BY 1, 2), est AS (SELECT c.id, min(cnt) AS estimate FROM c JOIN s ON c.r = s.r AND c.b = s.b GROUP BY 1)"


_REPORT, _REPORT_ALL = _report(WIDTH, DEPTH), _report(sketches.WIDTH, sketches.DEPTH)
query("replication_factor", f"WITH {_REPORT} SELECT est.id, (SELECT 0)::INTEGER + (estimate // 500 + 1)::INTEGER AS replicas FROM est")(lambda s, d: sketch_report(G.part_supp(s, d), WIDTH, DEPTH, 500).select("id", "replicas"))
query("sketch_report", f"WITH {_REPORT}, d AS (SELECT a AS id, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree FROM (SELECT src AS a, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e) GROUP BY 1) SELECT id, in_degree, out_degree, estimate, (estimate // 500 + 1)::INTEGER AS replicas FROM est JOIN d USING (id)")(
    lambda s, d: sketch_report(G.part_supp(s, d), WIDTH, DEPTH, 500)
)
# With the operator's own sketch; the two above have collisions in every counter.
query("replication_factor_all", SQL["replication_factor"].replace(_REPORT, _REPORT_ALL))(lambda s, d: sketch_report(G.part_supp(s, d), sketches.WIDTH, sketches.DEPTH, 500).select("id", "replicas"))
query("sketch_report_all", SQL["sketch_report"].replace(_REPORT, _REPORT_ALL))(lambda s, d: sketch_report(G.part_supp(s, d), sketches.WIDTH, sketches.DEPTH, 500))


def _agents(spark: SparkSession, d: str, all_: bool = True) -> DataFrame:
    a = G.table(spark, d, "agent").filter("agent_id is not null").select("agent_id", F.coalesce("vagents", F.lit(100)).alias("vagents"), "left_at")
    return (a if all_ else a.filter("left_at is null")).select("agent_id", "vagents")


def _ring_sql(name: str, where: str) -> str:
    n = name
    return f"{n}a AS (SELECT agent_id, coalesce(vagents, 100) AS vagents FROM agent WHERE agent_id IS NOT NULL {where}), {n}p AS (SELECT agent_id, vagent FROM {n}a, LATERAL (SELECT unnest(range(vagents)) AS vagent)), {wang('agent_id | (vagent << 49)', n + 'w', n + 'p', 'agent_id')}, {n} AS (SELECT agent_id, h FROM {n}w)"


def _owner_sql(key: str, src: str, keep: str, name: str, ring: str) -> str:
    n = name
    return f"{wang(key, n + 'k', src, keep + ', ' + key)}, {n}j AS (SELECT k.*, r.agent_id, r.h AS rh FROM {n}k k ASOF LEFT JOIN {ring} r ON k.h <= r.h), {n} AS (SELECT * EXCLUDE (agent_id, rh, h), coalesce(agent_id, (SELECT arg_max(agent_id, h) FROM {ring})) AS {n}_agent FROM {n}j)"


_IDS = f"e AS ({G.USER_NEXT}), v AS (SELECT src AS id FROM e UNION SELECT dst FROM e)"
_OWN = f"{_IDS}, {_ring_sql('r', '')}, {_owner_sql('id', 'v', '1 AS one', 'o', 'r')}"
query("edge_owner", f"WITH {_OWN} SELECT e.src, e.dst, a.o_agent AS in_agent, b.o_agent AS out_agent FROM e JOIN o a ON a.id = e.dst JOIN o b ON b.id = e.src")(lambda s, d: placement.edge_owner(G.user_next(s, d), _agents(s, d)))
query("agent_balance", f"WITH {_OWN} SELECT agent_id, (SELECT count(*) FROM e JOIN o ON o.id = e.dst WHERE o_agent = agent_id) AS in_edges, (SELECT count(*) FROM o WHERE o_agent = agent_id) AS vertices FROM ra")(lambda s, d: placement.agent_balance(G.user_next(s, d), _agents(s, d)))
query("moved_edges", f"WITH {_OWN}, {_ring_sql('q', 'AND left_at IS NULL')}, {_owner_sql('id', 'v', '1 AS one', 'n', 'q')} SELECT src, dst, o_agent AS from_agent, n_agent AS to_agent FROM e JOIN o ON o.id = dst JOIN n ON n.id = dst WHERE o_agent <> n_agent")(
    lambda s, d: placement.moved_edges(G.user_next(s, d), _agents(s, d), _agents(s, d, False))
)
query("message_distribution", f"WITH {_OWN}, x AS (SELECT DISTINCT e.src, b.o_agent AS src_agent, a.o_agent AS dst_agent FROM e JOIN o a ON a.id = e.dst JOIN o b ON b.id = e.src) SELECT 0 AS superstep, src_agent, dst_agent, count(*) AS messages FROM x GROUP BY 2, 3")(
    lambda s, d: placement.message_distribution(G.user_next(s, d), graph.vertices(G.user_next(s, d)).withColumn("superstep", F.lit(0)), _agents(s, d))
)


@query("message_distribution_run", f"{_bfs(G.USER_NEXT, 0, True)}, {_OWN.removeprefix(_IDS + ', ')}, x AS (SELECT DISTINCT e.src, b.o_agent AS src_agent, a.o_agent AS dst_agent FROM e JOIN o a ON a.id = e.dst JOIN o b ON b.id = e.src) SELECT m.value::INTEGER AS superstep, src_agent, dst_agent, count(*) AS messages FROM x JOIN m ON m.id = x.src GROUP BY 1, 2, 3")
def message_distribution_run(spark: SparkSession, d: str) -> DataFrame:
    """The messages of each superstep of a directed search from 0; message_distribution has all vertices send once."""
    e = Scratch(spark, "messages").table(G.user_next(spark, d))
    run = programs.bfs(e, [0], directed=True, keep_history=True)
    return placement.message_distribution(e, programs.senders(run), _agents(spark, d))



# The second ring written out: all k points of each edge's own end, of which the other end's hash picks one.
_SPLIT_AT = 50


def _split(own: str, other: str, name: str) -> str:
    n = name
    return f"""{n}e AS (SELECT e.src, e.dst, least(coalesce(kk.k, 1), (SELECT count(*) FROM rn)) AS k, a.rk AS p, b.h AS oh FROM e JOIN pos a ON a.id = e.{own} JOIN pos b ON b.id = e.{other} LEFT JOIN kk ON kk.id = e.{own}),
{n}s AS (SELECT src, dst, oh, rn.h, agent_id, vagent FROM {n}e, LATERAL (SELECT unnest(range(k)) AS i), rn WHERE rn.rk = ({n}e.p + i) % (SELECT count(*) FROM rn)),
{n} AS (SELECT src, dst, coalesce(arg_min({{'a': agent_id, 'v': vagent}}, h) FILTER (h >= oh), arg_max({{'a': agent_id, 'v': vagent}}, h)) AS x FROM {n}s GROUP BY src, dst)"""


_VRING = f"ra AS (SELECT agent_id, coalesce(vagents, 100) AS vagents FROM agent WHERE agent_id IS NOT NULL), rp AS (SELECT agent_id, vagent FROM ra, LATERAL (SELECT unnest(range(vagents)) AS vagent)), {wang('agent_id | (vagent << 49)', 'rw', 'rp', 'agent_id, vagent')}, rn AS (SELECT *, row_number() OVER (ORDER BY h) - 1 AS rk FROM rw)"
_POS = f"{wang('id', 'ik', 'v', 'id')}, pos AS (SELECT ik.id, ik.h, coalesce(rn.rk, (SELECT max(rk) FROM rn)) AS rk FROM ik ASOF LEFT JOIN rn ON ik.h <= rn.h), kk AS (SELECT a AS id, (count(*) // {_SPLIT_AT} + 1) AS k FROM (SELECT src AS a FROM e UNION ALL SELECT dst FROM e) GROUP BY 1)"
_SPLITS = f"{_IDS}, {_VRING}, {_POS}"


def _replicas(edges: DataFrame) -> DataFrame:
    return graph.degrees(edges).select("id", sketches.replicas("degree", _SPLIT_AT).alias("k"))


def _split_owner(side: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        e = Scratch(spark, "split").table(G.user_next(spark, d))
        return placement.split_edge_owner(e, _agents(spark, d), _replicas(e), side=side)

    return run


query("split_edge_owner", f"WITH {_SPLITS}, {_split('dst', 'src', 'o')} SELECT src, dst, x.a AS agent, x.v::INTEGER AS vagent FROM o")(_split_owner("in"))
query("split_edge_owner_out", f"WITH {_SPLITS}, {_split('src', 'dst', 'o')} SELECT src, dst, x.a AS agent, x.v::INTEGER AS vagent FROM o")(_split_owner("out"))


@query("replica_agents", f"WITH {_SPLITS} SELECT pos.id, i::INTEGER AS slot, agent_id FROM pos JOIN kk ON kk.id = pos.id, LATERAL (SELECT unnest(range(least(kk.k, (SELECT count(*) FROM rn)))) AS i), rn WHERE rn.rk = (pos.rk + i) % (SELECT count(*) FROM rn)")
def replica_agents(spark: SparkSession, d: str) -> DataFrame:
    """The agents of each vertex by its degree, one and one more for each 50 edges."""
    return placement.replica_agents(_replicas(Scratch(spark, "replicas").table(G.user_next(spark, d))), "id", _agents(spark, d), F.col("k")).select("id", "slot", "agent_id")


_COPIES = "c AS (SELECT dst AS v, x, 1 AS i FROM o UNION ALL SELECT src, x, 0 FROM q), hd AS (SELECT x.a AS agent_id, v, count(*) AS n, sum(i) AS i, max(x.v) AS high FROM c GROUP BY 1, 2)"
_REBALANCED = f"""{_COPIES}, pa AS (SELECT agent_id, sum(i)::BIGINT AS i, arg_max(high, n::HUGEINT * 4611686018427387904 - v) AS high FROM hd GROUP BY 1)
 SELECT agent_id, CASE WHEN pa.i > 5 * (SELECT count(*) FROM e) // (SELECT count(*) FROM ra) // 4 THEN least(vagents, high + 1) ELSE vagents END::INTEGER AS vagents FROM ra LEFT JOIN pa USING (agent_id)"""
query("rebalanced_agents", f"WITH {_SPLITS.replace(f'count(*) // {_SPLIT_AT} + 1', '1')}, {_split('dst', 'src', 'o')}, {_split('src', 'dst', 'q')}, {_REBALANCED}")(lambda s, d: placement.rebalanced(G.user_next(s, d), _agents(s, d)))


@query("rebalanced_agents_split", f"WITH {_SPLITS}, {_split('dst', 'src', 'o')}, {_split('src', 'dst', 'q')}, {_REBALANCED}")
def rebalanced_agents_split(spark: SparkSession, d: str) -> DataFrame:
    e = Scratch(spark, "rebalanced").table(G.user_next(spark, d))
    return placement.rebalanced(e, _agents(spark, d), replicas=_replicas(e))


_PUSHED = f"""WITH {_OWN}, c AS (SELECT o_agent AS agent, dst AS v FROM e JOIN o ON o.id = dst UNION ALL SELECT o_agent, src FROM e JOIN o ON o.id = src), k AS (SELECT agent, v, count(*) AS n FROM c GROUP BY 1, 2),
kr AS (SELECT agent, v, n, r.r AS r FROM k, range({DEPTH}) r(r)), {wang('xor(v, r)', 'w', 'kr', 'agent, v, n, r')}, b AS (SELECT *, (h % {WIDTH})::INTEGER AS b FROM w), s AS (SELECT agent, r, b, sum(n)::BIGINT AS cnt FROM b GROUP BY 1, 2, 3),
m AS (SELECT b.agent, b.v, min(s.cnt) AS est FROM b JOIN s ON s.agent = b.agent AND s.r = b.r AND s.b = b.b GROUP BY 1, 2), g AS (SELECT agent FROM m GROUP BY 1 HAVING max(est) >= 120)
SELECT r::INTEGER AS row, b AS bucket, sum(cnt)::BIGINT AS cnt FROM s WHERE agent IN (SELECT agent FROM g) GROUP BY 1, 2"""


@query("pushed_sketch", _PUSHED)
def pushed_sketch(spark: SparkSession, d: str) -> DataFrame:
    """What a load balance publishes: the sketches of agents with a vertex of some 120 edges or more."""
    o = placement.edge_owner(G.user_next(spark, d), _agents(spark, d))
    held = o.select(F.explode(F.array(F.struct(F.col("in_agent").alias("agent"), F.col("dst").alias("v")), F.struct(F.col("out_agent").alias("agent"), F.col("src").alias("v")))).alias("x")).select("x.*")
    return placement.pushed_sketch(held, 120, WIDTH, DEPTH)


# -- rates and policy -------------------------------------------------------------------------------------------------

query("ingest_rate", "SELECT epoch(date_trunc('hour', ts))::BIGINT AS start, count(*) AS changes, round(count(*) / 3600.0::DOUBLE, 9) AS per_second FROM events GROUP BY 1")(
    lambda s, d: policy.ingest_rate(G.table(s, d, "events"), "ts").select(F.unix_timestamp("start").alias("start"), "changes", F.round("per_second", 9).alias("per_second"))
)
query("gap_batches", """WITH g AS (SELECT ts, CASE WHEN ts - lag(ts) OVER (ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS n FROM events), s AS (SELECT ts, sum(n) OVER (ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM g)
 SELECT epoch_us(min(ts))::BIGINT AS start, epoch_us(max(ts))::BIGINT AS last, count(*) AS changes FROM s GROUP BY k""")(
    lambda s, d: policy.gap_batches(G.table(s, d, "events"), "ts", "30 minutes").select(F.unix_micros("start").alias("start"), F.unix_micros("last").alias("last"), "changes")
)
_RATES = "r AS (SELECT (row_number() OVER (ORDER BY date_trunc('hour', ts)))::INTEGER AS beat, count(*)::DOUBLE AS rate FROM events GROUP BY date_trunc('hour', ts))"


def _rates(spark: SparkSession, d: str) -> DataFrame:
    hours = G.table(spark, d, "events").groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("h")).agg(F.count(F.lit(1)).cast("double").alias("rate"))
    return hours.selectExpr("cast(row_number() over (order by h) as int) as beat", "rate")  # one row an hour


query("ema_rate", f"WITH RECURSIVE {_RATES}, x(beat, rate, ema) AS (SELECT beat, rate, rate FROM r WHERE beat = 1 UNION ALL SELECT r.beat, r.rate, 2.0::DOUBLE / 11 * r.rate + 9.0::DOUBLE / 11 * x.ema FROM x JOIN r ON r.beat = x.beat + 1) SELECT beat, rate, round(ema, 6) AS ema FROM x")(
    lambda s, d: policy.ema(_rates(s, d), "beat", "rate", 10).withColumn("ema", F.round("ema", 6))
)
query("autoscale_target", f"WITH {_RATES} SELECT beat, rate, least(greatest(least(floor(rate * 100 / 150) + 1, 2048, 500), 64), 500)::INTEGER AS target FROM r")(
    lambda s, d: policy.autoscale_target(_rates(s, d).withColumn("scaled", F.col("rate") * 100), "scaled", 500).drop("scaled")
)
query("random_graph")(lambda s, d: random_graph(s, 10_000, 50_000, seed=7))
