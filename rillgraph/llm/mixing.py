"""Mixing sources to target shares of the total size, in a training order.

A time-varying curriculum: each source has a schedule of weights over the
progress of training, 0 to 1.  Its integral is the source's cumulative demand
for tokens.  A source's documents, in a random order of their own, take up that
demand one after the other, and the inverse of the demand gives each document
the progress at which its middle token is due.  Documents are then range-sorted
by that position.

The total is the largest for which no source needs a document more often than
its ``max_repeat``; it follows from the sources' token sums.  Within a source,
passes are complete but for the last, which takes documents until the demand is
met.

At scale: running token sums within a source come from sums by hash bucket, so
a source that holds a third of the documents is spread over buckets whose number
follows the number of documents.  The driver sees one row a source.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import Scratch
from .tokens import token_counts

#: Documents that one bucket should hold about.
BUCKET = 20_000

#: Weight of a source over the course relative to its share: ``(progress, factor)``, linear in between.
Schedule = Sequence[tuple[float, float]]


def _segments(targets: list[tuple[str, float, int]], schedules: Mapping[str, Schedule]) -> list[tuple[str, float, float, float, float, float]]:
    """``(source, u0, u1, w0, slope, before)`` of each linear piece of each source's weights, which integrate to its share.

    At each point of progress the weights of all sources are scaled to sum to
    1; sources without a schedule keep a factor of 1.  Scaling moves shares, so
    factors are fitted until each source's integral is its share.
    """
    knots = sorted({0.0, 1.0, *(u for s in schedules.values() for u, _ in s if 0 <= u <= 1)})

    def factor(source: str, u: float) -> float:
        points = sorted(schedules.get(source, ())) or [(0.0, 1.0)]
        if u <= points[0][0]:
            return points[0][1]
        for (a, fa), (b, fb) in zip(points, points[1:], strict=False):
            if u <= b:
                return fa + (fb - fa) * (u - a) / (b - a) if b > a else fb
        return points[-1][1]

    share = {s: t for s, t, _ in targets}
    scale = dict.fromkeys(share, 1.0)
    area = lambda w: sum((w[i] + w[i + 1]) / 2 * (knots[i + 1] - knots[i]) for i in range(len(knots) - 1))
    weights: dict[str, list[float]] = {}
    for _ in range(500):
        raw = {s: [scale[s] * share[s] * factor(s, u) for u in knots] for s in share}
        sums = [sum(raw[s][i] for s in share) or 1.0 for i in range(len(knots))]
        weights = {s: [x / sums[i] for i, x in enumerate(raw[s])] for s in share}
        for s in share:
            if share[s] > 0:
                scale[s] *= share[s] / max(area(weights[s]), 1e-12)
    out = []
    for s, w in weights.items():
        fit, before = (share[s] / area(w) if area(w) > 0 else 0.0), 0.0
        for i in range(len(knots) - 1):
            u0, u1, w0, w1 = knots[i], knots[i + 1], w[i] * fit, w[i + 1] * fit
            out.append((s, u0, u1, w0, (w1 - w0) / (u1 - u0), before))
            before += (w0 + w1) / 2 * (u1 - u0)
    return out


def _salted_sums(docs: DataFrame, buckets: int) -> DataFrame:
    """Adds ``upto``, the tokens of the source's documents up to and with this one, in hash order."""
    spread = docs.withColumn("bucket", F.floor(F.col("h") * buckets).cast("int"))
    sums = spread.groupBy("source", "bucket").agg(F.sum("tokens").alias("t"))
    before = F.sum("t").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("source", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.sum("tokens").over(Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, 0))
    return spread.withColumn("inside", inside).join(sums, ["source", "bucket"]).withColumn("upto", F.col("inside") + F.col("before")).drop("inside", "before", "bucket")


def _progress(share_due: Column) -> Column:
    """The progress at which a source's cumulative weight reaches ``share_due``, within one linear piece."""
    rest = share_due - F.col("before")
    root = F.sqrt(F.greatest(F.col("w0") * F.col("w0") + 2 * F.col("slope") * rest, F.lit(0.0)))
    return F.least(F.greatest(F.col("u0") + F.coalesce(2 * rest / F.nullif(F.col("w0") + root, F.lit(0.0)), F.lit(0.0)), F.col("u0")), F.col("u1"))


def mix(docs: DataFrame, targets: DataFrame, schedules: Mapping[str, Schedule] | None = None, total: int | None = None, seed: int = 5) -> tuple[DataFrame, DataFrame]:
    """``(sequence, report)`` of documents ``(doc_id, source, tokens)`` mixed to ``targets (source, target_share, max_repeat)``.

    ``sequence (source, doc_id, use, tokens, progress, position)`` has a row for
    each use of a document, ``use`` counting from 1 to at most ``max_repeat``,
    sorted by range of ``position``, the token of the course at which it is due.
    ``report (source, target_share, actual_share, tokens, uses, documents,
    most_uses)`` has a row for each target.  ``total`` bounds the tokens of the
    course; without it, or where the sources cannot supply it, it is the most
    that they can.  A source gets the documents whose use begins before its
    demand is met, so its tokens exceed the demand by less than one document.

    Documents of no target, of a null source or without tokens are not used.
    Targets with a null source, no share or no allowed use are left out and the
    other shares scaled to sum to 1; one whose source has no tokens makes the
    sequence empty, since no total meets the shares.  A document given twice
    counts as two.  Ties in the random order go by id.
    """
    spark = docs.sparkSession
    s = Scratch(spark, "mixing")
    rows = targets.filter("source is not null and target_share > 0 and max_repeat > 0").groupBy("source").agg(F.max("target_share"), F.max("max_repeat")).collect()
    whole = sum(r[1] for r in rows)
    wanted = sorted((r[0], r[1] / whole, r[2]) for r in rows)
    t_schema = T.StructType([T.StructField("source", T.StringType()), T.StructField("share", T.DoubleType()), T.StructField("most", T.IntegerType())])
    known = F.broadcast(spark.createDataFrame(wanted, t_schema))
    used = docs.select("doc_id", "source", F.col("tokens").cast("long").alias("tokens")).filter("tokens > 0").join(known.select("source"), "source")
    used = s.table(used)
    n = s.seen["rows"]
    have = {r[0]: r[1] for r in used.groupBy("source").agg(F.sum("tokens")).collect()}
    most = min((m * have.get(x, 0) / share for x, share, m in wanted), default=0.0)
    course = min(most, total) if total is not None else most
    pieces = _segments(wanted, schedules or {}) if wanted else []
    p_schema = T.StructType([T.StructField("source", T.StringType()), *(T.StructField(c, T.DoubleType()) for c in ("u0", "u1", "w0", "slope", "before"))])
    demand = spark.createDataFrame([(x, share, m, share * course, have.get(x, 0)) for x, share, m in wanted], "source string, share double, most int, due double, has long")
    h = (F.xxhash64("doc_id", F.lit(seed)).bitwiseAND((1 << 52) - 1)) / F.lit(float(1 << 52))
    drawn = used.join(F.broadcast(demand), "source").filter("due > 0").select("doc_id", "source", "tokens", h.alias("h"), "due", "has", "most")
    summed = _salted_sums(drawn, max(1, n // BUCKET))
    # Complete passes precede the last one: pass p takes up the demand from (p - 1) * has on.
    reps = F.explode(F.sequence(F.lit(1), F.least(F.col("most"), F.ceil(F.col("due") / F.col("has")).cast("int"))))
    all_uses = summed.withColumn("use", reps).withColumn("begin", (F.col("use") - 1) * F.col("has") + F.col("upto") - F.col("tokens")).filter("begin < due")
    middle = F.least((F.col("begin") + F.col("tokens") / 2.0) / F.lit(float(course or 1)), F.col("due") / F.lit(float(course or 1)))
    placed = all_uses.withColumn("x", middle).join(F.broadcast(spark.createDataFrame(pieces, p_schema)), "source")
    end = F.col("before") + F.col("w0") * (F.col("u1") - F.col("u0")) + F.col("slope") * (F.col("u1") - F.col("u0")) * (F.col("u1") - F.col("u0")) / 2
    placed = placed.filter((F.col("x") >= F.col("before")) & ((F.col("x") < end) | (F.col("u1") >= 1.0)))
    placed = placed.select("source", "doc_id", "use", "tokens", _progress(F.col("x")).alias("progress"))
    placed = s.table(placed.withColumn("position", F.floor(F.col("progress") * F.lit(float(course))).cast("long")))
    got = placed.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("uses"), F.sum(F.when(F.col("use") == 1, 1).otherwise(0)).alias("documents"), F.max("use").alias("most_uses"))
    sum_all = got.agg(F.sum("tokens").alias("all"))
    shares = F.broadcast(spark.createDataFrame(wanted, t_schema)).join(got, "source", "left").join(F.broadcast(sum_all))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    report = shares.select("source", F.col("share").alias("target_share"), F.coalesce(F.col("tokens") / F.nullif(F.col("all"), F.lit(0)), F.lit(0.0)).alias("actual_share"), zero("tokens"), zero("uses"), zero("documents"), zero("most_uses"))
    return placed.repartitionByRange("position", "source", "doc_id", "use").sortWithinPartitions("position", "source", "doc_id", "use"), report


def mix_documents(docs: DataFrame, targets: DataFrame, vocabulary: str | None = None, **kw) -> tuple[DataFrame, DataFrame]:
    """:func:`mix` of documents ``(doc_id, source, text)`` by the tokens of their whole texts; only documents of a target are measured."""
    named = targets.filter("source is not null").select("source").distinct()
    of_target = docs.select("doc_id", "source", "text").join(F.broadcast(named), "source", "left_semi")
    return mix(token_counts(of_target, ["doc_id", "source"], vocabulary=vocabulary), targets, **kw)
