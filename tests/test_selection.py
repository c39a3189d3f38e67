import math
import random

from pyspark.sql import functions as F

from rillgraph.operators.selection import neighbour_counts, quantiles, select_ranks, vertices_with_neighbours


def test_ranks_of_hot_and_cold_keys_match_sorting(spark):
    rng = random.Random(3)
    rows = [(1, rng.choice([0, 5, -7, 2**61, rng.randrange(-(2**62), 2**62)])) for _ in range(3000)]
    rows += [(2, 9)] * 500 + [(k, rng.randrange(1000)) for k in range(3, 60) for _ in range(k)] + [(None, 1), (3, None)]
    df = spark.createDataFrame(rows, "k long, v long").withColumn("n", F.lit("clash"))
    got = {(r.k, r["rank"]): (r.n, r.v) for r in select_ranks(df, F.array(F.lit(1), F.lit(25), F.col("n"), F.lit(None)), bins=4, few=20).collect()}
    want = {}
    for k in range(1, 60):
        vs = sorted(v for a, v in rows if a == k and v is not None)
        want |= {(k, r): (len(vs), vs[r - 1]) for r in (1, 25, len(vs)) if 1 <= r <= len(vs)}
    assert got == want
    q = {(r.k, r.share): r.v for r in quantiles(df, [0.0, 0.5, 0.9], bins=4, few=20).collect()}
    for k in (1, 2, 30):
        vs = sorted(v for a, v in rows if a == k and v is not None)
        assert [q[k, s] for s in (0.0, 0.5, 0.9)] == [vs[max(1, math.ceil(s * len(vs))) - 1] for s in (0.0, 0.5, 0.9)]
    assert select_ranks(df.limit(0), F.array(F.lit(1))).isEmpty()


def test_neighbours(spark):
    rows = [(1, i) for i in range(25)] * 2 + [(2, i) for i in range(24)] + [(None, 1), (3, -1), (5, 5)]
    df = spark.createDataFrame(rows, "src long, dst long")
    assert [(r.side, r.vertex_id) for r in vertices_with_neighbours(df, 25).collect()] == [("src", 1)]
    n = {r.vertex_id: (r.n_out, r.n_in) for r in neighbour_counts(df).collect()}
    assert n[1] == (25, 2) and n[2] == (24, 2) and n[5] == (1, 3) and 3 in n
