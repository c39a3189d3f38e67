"""Exact ranks and quantiles for each key where a few keys hold most rows.

Distributed selection: for each key and wanted rank a range of values that holds
the answer is kept.  A round counts the values of the range in ``BINS`` equal
bins, with counts that add up on the map side, and narrows the range to the bin
that the rank falls in, until the range holds few values or one.  A key's values
are never brought together unless the range has at most ``FEW`` of them.

At scale: counts replace values, so a round shuffles at most ``BINS`` rows for
each hot key and map task.  Keys with few values are settled without any round.
The open ranges belong to keys with more than ``FEW`` values; they are broadcast
while there are at most ``BROADCAST`` of them and joined beyond, with salts in
proportion to the key's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import Scratch

BINS, FEW, BROADCAST, SHARE = 256, 2048, 20_000, 1000


def _with_ranges(values: DataFrame, ranges: DataFrame, n: int, hot: DataFrame) -> DataFrame:
    """Values that lie within a range of their key; beyond BROADCAST ranges ``hot (k, salts)`` keys are spread in proportion to their rows."""
    if n <= BROADCAST:
        out = values.join(F.broadcast(ranges), "k")
    else:
        left = values.join(F.broadcast(hot), "k", "left").withColumn("s", F.pmod(F.xxhash64("v", F.monotonically_increasing_id()), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
        right = ranges.join(F.broadcast(hot), "k", "left").withColumn("s", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
        out = left.join(right, ["k", "s"]).drop("s")
    return out.filter("v between lo and hi")


def select_ranks(pairs: DataFrame, ranks: Column, key: str = "k", value: str = "v", bins: int = BINS, few: int = FEW) -> DataFrame:
    """``(k, n, rank, v)``: for each key its number of values and its ``rank``-th smallest value, for each of ``ranks``.

    ``ranks`` is an array column over ``k`` and ``n``; nulls in it and ranks below
    1 are left out, and a rank that no value of the key has gives no row: it is
    the selection that finds that out, not a count beforehand.  Values are bigints; rows with a null key or value
    do not count.  Repeated values count as often as they occur, so ties have
    ranks of their own.  Of an empty table the result is empty.
    """
    s = Scratch(pairs.sparkSession, "ranks")
    values = pairs.select(F.col(key).alias("k"), F.col(value).cast("long").alias("v")).filter("k is not null and v is not null")
    stats = s.table(values.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")), total=F.sum("n"))
    # Keys of a thousandth of all values or more, of which there are at most a thousand.
    least = max(few + 1, -(-(s.seen["total"] or 0) // SHARE))
    hot = stats.filter(F.col("n") >= least).select("k", F.ceil(F.col("n") / least).cast("int").alias("salts"))
    wanted = stats.withColumn("rank", F.explode(F.array_distinct(ranks))).filter("rank >= 1").withColumn("rank", F.col("rank").cast("long"))
    # r: the rank within the range; m: the number of values in it.
    ranges = s.table(wanted.select("k", "n", "rank", F.col("rank").alias("r"), F.col("n").alias("m"), "lo", "hi"), open=F.count(F.when((F.col("n") > few) & (F.col("lo") < F.col("hi")), 1)))
    n_open = s.seen["open"]
    is_open = (F.col("m") > few) & (F.col("lo") < F.col("hi"))
    settled = [ranges.filter(~is_open)]
    cold = settled[0].filter("n <= " + str(few))
    one = [settled[0].filter(f"n > {few}")]  # the key has many equal values only
    todo = ranges.filter(is_open)
    while n_open:
        inside = _with_ranges(values, todo, n_open, hot)
        width = F.floor((F.col("hi").cast("decimal(20,0)") - F.col("lo")) / bins).cast("long") + 1
        bin_ = F.floor((F.col("v").cast("decimal(20,0)") - F.col("lo")) / F.col("width")).cast("int")
        counts = inside.withColumn("width", width).groupBy("k", "n", "rank", "r", "lo", "hi", "width", bin_.alias("bin")).agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("least"), F.max("v").alias("most"))
        upto = F.sum("c").over(Window.partitionBy("k", "rank").orderBy("bin"))
        hit = counts.withColumn("upto", upto).filter("upto >= r and upto - c < r")
        nxt = hit.select("k", "n", "rank", (F.col("r") - F.col("upto") + F.col("c")).alias("r"), F.col("c").alias("m"), F.col("least").alias("lo"), F.col("most").alias("hi"))
        nxt = s.table(nxt, open=F.count(F.when(is_open, 1)))
        n_open = s.seen["open"]
        one.append(nxt.filter(~is_open))
        todo = nxt.filter(is_open)
    # Ranges of few values: only those values are brought together.
    last = one[0]
    for x in one[1:]:
        last = last.unionByName(x)
    last = s.table(last, few=F.count(F.when(F.col("lo") < F.col("hi"), 1)))
    n_few = s.seen["few"]
    equal = last.filter("lo = hi and r <= m").select("k", "n", "rank", F.col("lo").alias("v"))
    near = _with_ranges(values, last.filter("lo < hi"), n_few, hot)
    at = F.row_number().over(Window.partitionBy("k", "rank").orderBy("v"))
    near = near.withColumn("at", at).filter("at = r").select("k", "n", "rank", "v")
    # Keys of few values: hot keys' values never enter the shuffle's groups, nor those of other large keys where their list is short.
    by_key = cold.groupBy("k").agg(F.first("n").alias("n"), F.collect_list(F.struct("rank")).alias("ranks"))
    large = stats.filter(F.col("n") > few).select("k") if s.seen["rows"] <= BROADCAST else hot.select("k")
    some = values.join(F.broadcast(large), "k", "left_anti").join(by_key.select("k"), "k", "left_semi")
    some = some.groupBy("k").agg(F.sort_array(F.collect_list("v")).alias("all"))  # at most ``few`` values
    cold = some.join(by_key, "k").select("k", "n", "all", F.explode("ranks").alias("x")).select("k", "n", F.col("x.rank").alias("rank"), F.get("all", F.col("x.rank").cast("int") - 1).alias("v"))
    cold = cold.filter("v is not null")
    return cold.unionByName(equal).unionByName(near)


def quantiles(pairs: DataFrame, shares: list[float], key: str = "k", value: str = "v", bins: int = BINS, few: int = FEW) -> DataFrame:
    """``(k, n, share, v)``: exact quantiles, the value of rank ``ceil(share * n)`` and of rank 1 at share 0."""
    of = F.array(*(F.greatest(F.ceil(F.lit(q) * F.col("n")), F.lit(1)) for q in shares))
    ranked = select_ranks(pairs, of, key, value, bins, few)
    rows = F.explode(F.array(*(F.struct(F.lit(float(q)).alias("share"), F.greatest(F.ceil(F.lit(q) * F.col("n")), F.lit(1)).alias("want")) for q in shares)))
    return ranked.withColumn("q", rows).filter("q.want = rank").select("k", "n", "q.share", "v")


def neighbour_pairs(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Distinct ``(src, dst)`` of the rows with both ends valid, written once for all that is counted over them."""
    from ..types import valid

    s = scratch or Scratch(edges.sparkSession, "neighbours")
    return s.table(edges.filter(valid("src") & valid("dst")).select("src", "dst").distinct())


def by_side(pairs: DataFrame) -> DataFrame:
    """``(k struct<side, id>, v)``: each pair once for either end."""
    sides = F.explode(
        F.array(
            F.struct(F.struct(F.lit("src").alias("side"), F.col("src").alias("id")).alias("k"), F.col("dst").alias("v")),
            F.struct(F.struct(F.lit("dst").alias("side"), F.col("dst").alias("id")).alias("k"), F.col("src").alias("v")),
        )
    )
    return pairs.select(sides.alias("x")).select("x.k", "x.v")


def vertices_with_neighbours(edges: DataFrame, least: int) -> DataFrame:
    """``(side, vertex_id, n)`` of the vertices with ``least`` distinct ids at the other end, by selecting the neighbour of that rank."""
    s = Scratch(edges.sparkSession, "neighbours")
    found = select_ranks(by_side(neighbour_pairs(edges, s)), F.array(F.lit(least)))
    return found.select("k.side", F.col("k.id").alias("vertex_id"), "n")


def neighbour_counts(edges: DataFrame) -> DataFrame:
    """``(vertex_id, n_out, n_in)``: distinct ids that a vertex links to and is linked from; 0 where there is none.

    The pairs are made distinct by both ends, which spreads the rows of any
    vertex, and then counted with partial sums.
    """
    pairs = neighbour_pairs(edges)
    ends = F.explode(F.array(F.struct(F.col("src").alias("vertex_id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("vertex_id"), F.lit(0).alias("o"), F.lit(1).alias("i"))))
    return pairs.select(ends.alias("e")).groupBy("e.vertex_id").agg(F.sum("e.o").alias("n_out"), F.sum("e.i").alias("n_in"))


