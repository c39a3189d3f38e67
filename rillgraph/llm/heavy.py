"""The most frequent values of a column in bounded memory.

A heavy-light sketch.  Each partition keeps a *heavy* part, a fixed number of
buckets with a few exact slots each, and a *light* part, a compact array of
counters.  A value that meets a full bucket votes against its weakest slot;
when the votes reach ``EVICT`` times the slot's count, the slot's count is moved
to the light part and the value takes its place.  Partitions merge by bucket
recombination: the slots of a bucket add up by value, the strongest stay and the
others are evicted to the light part, in a tree of ``TREE`` sketches a merge.

``heavy count + light counter`` is never below the true count, since every row
of a value is either in its slot or in its light counter.  A value that reaches a
share of the rows and holds no slot fills its light counter to that share, which
is how the exact count finds it.

At scale: one pass over one column; a partition sends at most ``BUCKETS *
SLOTS`` slots and ``LIGHT`` counters however many rows it has, and a merged sketch
is no larger.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.hashing import with_finaliser
from ..session import Scratch
from ..types import valid

BUCKETS, SLOTS, LIGHT, EVICT = 1024, 4, 1 << 15, 8
#: Sketches that one merge takes, and candidates that are broadcast, at most.
TREE, FEW = 256, 100_000


def _mix(values: np.ndarray) -> np.ndarray:
    h = values.astype(np.uint64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class HeavyLight:
    """The sketch of one field; numpy arrays of fixed size."""

    def __init__(self, buckets: int = BUCKETS, slots: int = SLOTS, light: int = LIGHT, evict: int = EVICT):
        self.buckets, self.slots, self.evict = buckets, slots, evict
        self.value = np.zeros((buckets, slots), np.int64)
        self.count = np.zeros((buckets, slots), np.int64)
        self.against = np.zeros(buckets, np.int64)
        self.light = np.zeros(light, np.int64)

    def light_index(self, values: np.ndarray) -> np.ndarray:
        return ((_mix(values) >> np.uint64(32)) % np.uint64(len(self.light))).astype(np.int64)

    def add(self, values: np.ndarray) -> None:
        """Counts a batch of values: exact counts within the batch, then one vote of each value, the most frequent first."""
        v, n = np.unique(values, return_counts=True)
        b = (_mix(v) % np.uint64(self.buckets)).astype(np.int64)
        at = (self.value[b] == v[:, None]) & (self.count[b] > 0)
        held = at.any(1)
        np.add.at(self.count, (b[held], at[held].argmax(1)), n[held])
        v, n, b = v[~held], n[~held], b[~held]
        order = np.lexsort((-n, b))
        v, n, b = v[order], n[order], b[order]
        first = np.r_[True, b[1:] != b[:-1]] if len(b) else np.zeros(0, bool)
        rank = np.arange(len(b)) - np.maximum.accumulate(np.where(first, np.arange(len(b)), 0))
        for r in range(self.slots):  # the strongest newcomers of each bucket contend; the others are light
            k = rank == r
            bk, vk, nk = b[k], v[k], n[k]
            slot = self.count[bk].argmin(1)
            weakest = self.count[bk, slot]
            self.against[bk] += np.where(weakest > 0, nk, 0)
            wins = (weakest == 0) | (nk > weakest) | (self.against[bk] >= self.evict * weakest)
            out = wins & (weakest > 0)
            np.add.at(self.light, self.light_index(self.value[bk[out], slot[out]]), weakest[out])
            self.value[bk[wins], slot[wins]] = vk[wins]
            self.count[bk[wins], slot[wins]] = nk[wins]
            self.against[bk[wins]] = 0
            np.add.at(self.light, self.light_index(vk[~wins]), nk[~wins])
        k = rank >= self.slots
        np.add.at(self.light, self.light_index(v[k]), n[k])


def _sketch(fields: list[str], buckets: int, slots: int, light: int, evict: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketches = [HeavyLight(buckets, slots, light, evict) for _ in fields]
        for batch in batches:
            for f, s in enumerate(sketches):
                col = batch.column(f).drop_null()
                values = col.to_numpy(zero_copy_only=False)
                if len(values):
                    s.add(values)
        for f, s in enumerate(sketches):
            b, k = np.nonzero(s.count)
            c = np.flatnonzero(s.light)
            names, n = [fields[f]] * (len(b) + len(c)), len(c)
            held = s.value[b, k]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(names, pa.string()),
                    pa.array(np.r_[b, np.full(n, -1)]),
                    pa.array(np.r_[held, np.zeros(n, np.int64)]),
                    pa.array(np.r_[s.light_index(held), c]),
                    pa.array(np.r_[s.count[b, k], s.light[c]]),
                ],
                names=["field", "bucket", "k", "at", "n"],
            )

    return run


_SLOT = "field string, bucket long, k long, at long, n long"


def _recombined(parts: DataFrame, slots: int, tasks: int) -> DataFrame:
    """Sketches, told apart by ``task``, merged in groups of ``tasks``: a bucket's values add up, its ``slots`` strongest stay and the others fall into the light counters."""
    parts = parts.withColumn("task", F.floor(F.col("task") / tasks))
    sums = parts.groupBy("task", "field", "bucket", "k", "at").agg(F.sum("n").alias("n"))
    # A bucket has at most slots * tasks values here; light counters, of bucket -1, need no order.
    rank = F.row_number().over(Window.partitionBy("task", "field", "bucket").orderBy(F.desc("n"), "k"))
    heavy = sums.filter("bucket >= 0").withColumn("out", rank > slots)
    kept = heavy.withColumn("bucket", F.when(F.col("out"), -1).otherwise(F.col("bucket"))).withColumn("k", F.when(F.col("out"), 0).otherwise(F.col("k"))).drop("out")
    merged = kept.unionByName(sums.filter("bucket < 0").select(kept.columns))
    return merged.groupBy("task", "field", "bucket", "k", "at").agg(F.sum("n").alias("n"))


def heavy_light(df: DataFrame, fields: list[str], buckets: int = BUCKETS, slots: int = SLOTS, light: int = LIGHT, evict: int = EVICT) -> DataFrame:
    """``(field, bucket, k, at, n)``: the merged sketch of each field.

    Rows of a ``bucket`` are its slots (``k`` a value, ``at`` its light counter),
    at most ``slots`` of them; rows of bucket -1 are light counters.  Tasks'
    sketches are merged as a tree, ``TREE`` at a time, so that a merge never has
    more than ``slots * TREE`` values of a bucket, however many tasks there are.
    Null and negative values are not counted.  Columns that are not in ``fields``
    are not read, whatever their names.
    """
    cols = [F.when(valid(c), F.col(c).cast("long")).alias(f"__{i}") for i, c in enumerate(fields)]
    picked = df.select(*cols)
    parts = picked.mapInArrow(_sketch(fields, buckets, slots, light, evict), _SLOT).withColumn("task", F.spark_partition_id().cast("long"))
    tasks = picked.rdd.getNumPartitions()
    while tasks > TREE:
        parts, tasks = _recombined(parts, slots, TREE), -(-tasks // TREE)
    return _recombined(parts, slots, TREE).drop("task")


def frequent(df: DataFrame, fields: list[str], share: float, buckets: int = BUCKETS, slots: int = SLOTS, light: int = LIGHT, evict: int = EVICT, _parts: DataFrame | None = None) -> DataFrame:
    """``(field, vertex_id, estimate, total)`` of the values whose estimated count reaches ``share`` of the field's valid rows.

    An estimate is what a value's slot holds and what its light counter does. It
    is never below the true count, and above it by at most the counter, which is
    on average the rows outside the slots divided by ``light``.  A value of the
    share that has no slot, because more than ``slots`` such values share its
    bucket, is not here (:func:`frequent_exact` finds it).  Ties at the share are
    in.  Of an empty table, or one without valid values, the result is empty.
    """
    parts = _parts if _parts is not None else Scratch(df.sparkSession, "heavy").table(heavy_light(df, fields, buckets, slots, light, evict))
    totals = parts.groupBy("field").agg(F.sum("n").alias("total"))
    rest = parts.filter("bucket < 0").select("field", "at", F.col("n").alias("extra"))
    est = parts.filter("bucket >= 0").join(rest, ["field", "at"], "left").select("field", F.col("k").alias("vertex_id"), (F.col("n") + F.coalesce("extra", F.lit(0))).alias("estimate"))
    return est.join(totals, "field").filter(F.col("estimate") >= F.lit(share) * F.col("total")).select("field", "vertex_id", "estimate", "total")


def frequent_exact(df: DataFrame, fields: list[str], share: float, buckets: int = BUCKETS, slots: int = SLOTS, light: int = LIGHT, evict: int = EVICT) -> DataFrame:
    """:func:`frequent` with true counts: ``(field, vertex_id, n, estimate, total)`` where ``n`` reaches the share.

    A value of the share without a slot is wholly in its light counter, which
    then holds the share too; there are at most ``1 / share`` such counters of a
    field, and a second pass counts their values along with the candidates, with
    partial sums.  So none is missed, however values fall into buckets.
    """
    s = Scratch(df.sparkSession, "heavy")
    parts = s.table(heavy_light(df, fields, buckets, slots, light, evict))
    found = s.table(frequent(df, fields, share, _parts=parts))
    few = s.seen["rows"] <= FEW
    totals = parts.groupBy("field").agg(F.sum("n").alias("total"))
    full = parts.filter("bucket < 0").join(totals, "field").filter(F.col("n") >= F.lit(share) * F.col("total"))
    full = [(r.field, r.at, r.total) for r in full.select("field", "at", "total").collect()]
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.when(valid(c), F.col(c).cast("long")).alias("vertex_id")) for c in fields)))
    values = df.select(pairs.alias("p")).select("p.field", "p.vertex_id")
    counts = values.join(F.broadcast(found) if few else found, ["field", "vertex_id"])
    counts = counts.groupBy("field", "vertex_id").agg(F.count(F.lit(1)).alias("n"), F.first("estimate").alias("estimate"), F.first("total").alias("total"))
    if full:
        cells = F.broadcast(df.sparkSession.createDataFrame(full, "field string, at long, total long"))
        more = with_finaliser(values.filter("vertex_id is not null"), "vertex_id", "__h").withColumn("at", F.shiftrightunsigned("__h", 32) % light)
        more = more.join(cells, ["field", "at"]).groupBy("field", "vertex_id").agg(F.count(F.lit(1)).alias("n"), F.first("total").alias("total"))
        more = more.join(found, ["field", "vertex_id"], "left_anti").select("field", "vertex_id", "n", F.col("n").alias("estimate"), "total")
        counts = counts.unionByName(more)
    return counts.filter(F.col("n") >= F.lit(share) * F.col("total"))
