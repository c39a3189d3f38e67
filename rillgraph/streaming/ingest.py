"""Change streams that keep versioned snapshots of a graph.

Snapshots are tables ``<root>/snapshot/batch_id=N`` that are written once and
never changed, so a batch that is replayed after a failure is found done or
written again to the same place.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.updates import apply_updates, clean_updates
from ..sources.edges import parse_lines
from ..types import EDGE


class SnapshotStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, batch: int) -> str:
        return f"{self.root}/snapshot/batch_id={batch}"

    def done(self, batch: int) -> bool:
        return self._fs.exists(self._path(f"{self.path(batch)}/_SUCCESS"))

    def batches(self) -> list[int]:
        folder = self._path(f"{self.root}/snapshot")
        if not self._fs.exists(folder):
            return []
        found = [int(f.getPath().getName().split("=")[1]) for f in self._fs.listStatus(folder)]
        return sorted(b for b in found if self.done(b))

    def read(self, batch: int | None = None) -> DataFrame:
        have = self.batches()
        batch = have[-1] if batch is None and have else batch
        if batch is None or batch not in have:
            return self.spark.createDataFrame([], EDGE)
        return self.spark.read.schema(EDGE).parquet(self.path(batch))

    def apply(self, updates: DataFrame, batch: int) -> None:
        """Writes the snapshot after ``batch`` from the one before it; does nothing if it is there."""
        if self.done(batch):
            return
        before = [b for b in self.batches() if b < batch]
        edges = self.read(before[-1]) if before else self.spark.createDataFrame([], EDGE)
        apply_updates(edges, clean_updates(updates)).write.mode("overwrite").parquet(self.path(batch))

    def keep(self, last: int) -> None:
        """Deletes all but the ``last`` snapshots."""
        for b in self.batches()[:-last]:
            self._fs.delete(self._path(self.path(b)), True)


def stream_lines(spark: SparkSession, folder: str, layout: str = "dyn", files_per_batch: int = 1) -> DataFrame:
    """A stream of the changes in a folder's files, ``files_per_batch`` files a batch in the order of their times."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder)
    place = F.struct(*(F.col(f"_metadata.{c}").alias(c) for c in ("file_modification_time", "file_path", "file_block_start")))
    return parse_lines(lines.select("value", place.alias("place")), layout, strict=False).filter("_corrupt is null")


def ingest(stream: DataFrame, store: SnapshotStore, checkpoint: str, every: str | None = None, then: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Applies each micro-batch of ``stream (seq?, op, src, dst)`` to the store, then calls ``then(snapshot, batch)``.

    Without ``seq`` the order of rows within a batch decides, by file and place in the file where ``place`` tells them.  ``every`` is a
    processing-time trigger; without it all that is there is taken and the query ends.
    """

    def batch(df: DataFrame, batch_id: int) -> None:
        if "seq" not in df.columns:
            row = F.monotonically_increasing_id()
            df = df.withColumn("seq", F.struct("place.*", row.alias("row")) if "place" in df.columns else row)
        store.apply(df, batch_id)
        if then:
            then(store.read(batch_id), batch_id)

    w = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def replay(updates: DataFrame, store: SnapshotStore, size: int, batches: int | None = None, keep: int | None = None) -> None:
    """Applies a table of changes in mini-batches of ``size`` by ``seq``, from the least there is: all, or those below ``batches``; keeps the ``keep`` last snapshots, or all."""
    from ..operators.updates import batch_of

    numbered = updates.select(batch_of("seq", size).alias("b"))
    there = [r.b for r in numbered.filter("b is not null").distinct().sort("b").collect()]  # one row a batch
    for b in there:
        if batches is None or b < batches:
            store.apply(updates.filter(batch_of("seq", size) == b), b)
            if keep:
                store.keep(keep)
