"""Rates and the scaling policy that follows them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ingest_rate(events: DataFrame, time: str, width: str = "1 hour") -> DataFrame:
    """``(start, changes, per_second)`` of each tumbling window that has changes."""
    seconds = F.unix_timestamp("w.end") - F.unix_timestamp("w.start")
    g = events.groupBy(F.window(F.col(time).cast("timestamp"), width).alias("w")).agg(F.count(F.lit(1)).alias("changes"))
    return g.select(F.col("w.start").alias("start"), "changes", (F.col("changes") / seconds).alias("per_second"))


def gap_batches(events: DataFrame, time: str, gap: str) -> DataFrame:
    """``(start, last, changes)``: batches that close when nothing has arrived for ``gap``.  Session windows merge on the map side."""
    g = events.groupBy(F.session_window(F.col(time).cast("timestamp"), gap).alias("w")).agg(F.count(F.lit(1)).alias("changes"), F.max(time).alias("last"))
    return g.select(F.col("w.start").alias("start"), F.col("last").cast("timestamp").alias("last"), "changes")


def ema(rates: DataFrame, order: str, value: str, n: int) -> DataFrame:
    """Adds ``ema``, the moving average with weight ``2 / (n + 1)`` of each new value, in order; the first value starts it.

    A series of rates has one row an interval and is reduced by one fold.
    """
    alpha = 2.0 / (n + 1)
    g = rates.agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).cast("double").alias("v")))).alias("l"))
    fold = F.aggregate(
        "l",
        F.array().cast("array<struct<o:" + rates.schema[order].dataType.simpleString() + ",v:double,ema:double>>"),
        lambda acc, x: F.concat(acc, F.array(F.struct(x["o"].alias("o"), x["v"].alias("v"), F.when(F.size(acc) == 0, x["v"]).otherwise(F.lit(alpha) * x["v"] + F.lit(1 - alpha) * F.element_at(acc, -1)["ema"]).alias("ema")))),
    )
    return g.select(F.explode(fold).alias("x")).select(F.col("x.o").alias(order), F.col("x.v").alias(value), F.col("x.ema").alias("ema"))


def autoscale_target(rates: DataFrame, rate: str, known: int, per_agent: int = 150, most: int = 2048, least: int = 64) -> DataFrame:
    """Adds ``target``: one agent and one more for each ``per_agent`` of the rate, at most ``most`` and the known agents, at least ``least`` of what is known."""
    wanted = F.floor(F.col(rate) / per_agent) + 1
    return rates.withColumn("target", F.least(F.greatest(F.least(wanted, F.lit(most), F.lit(known)), F.lit(least)), F.lit(known)).cast("int"))


def autoscale_actions(targets: list[int], size: int, hold: int = 15) -> list[tuple[int, int, int]]:
    """``(beat, size, counter)`` of a series of targets, one a beat: the hysteresis of the scaler.

    The counter starts at ``hold`` and counts down; at 0 a target that differs
    from the size sets it to ``-hold``, from where it counts up; at -1 the size
    becomes the target and the counter twice ``hold``.
    """
    counter, out = hold, []
    for beat, target in enumerate(targets):
        if counter > 0:
            counter -= 1
        elif counter == 0:
            if target != size:
                counter = -hold
        elif counter < -1:
            counter += 1
        else:
            size, counter = target, 2 * hold
        out.append((beat, size, counter))
    return out


def query_schedule(blocks: int = 11, seconds: int = 300) -> list[tuple[int, int, int]]:
    """``(block, seconds, pause in ms)`` of the query workload: the middle block has the shortest pause."""
    mid = blocks // 2
    return [(b, seconds, abs(mid - b) * 10 or 6) for b in range(blocks)]


