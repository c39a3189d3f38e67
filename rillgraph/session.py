"""Session helpers: where intermediate tables live and how lineage is cut.

Iterative operators write each round's table to the folder that the cluster
names in ``spark.checkpoint.dir`` and read it again.  Such a table is columnar,
survives the loss of any executor and, unlike an RDD checkpoint, is written in
the same pass that computes it.
"""

from __future__ import annotations

import tempfile
import uuid
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_OWN_DIR: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where that is unset and the master is local."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if app not in _OWN_DIR:
        _OWN_DIR[app] = "file://" + tempfile.mkdtemp(prefix="rillgraph-")
    return _OWN_DIR[app]


class Scratch:
    """Written intermediate tables of one operator call.

    ``table`` writes a frame and returns it as a scan of what was written.
    ``drop`` deletes a table that is no longer needed; what is left when the
    JVM ends is deleted then.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path(self.root)
        self._fs = self._path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path)
        self._fs.deleteOnExit(self._path)
        self._n = 0
        #: What the last write observed.
        self.seen: dict[str, Any] = {}

    def table(self, df: DataFrame, **metrics: Column) -> DataFrame:
        """Write ``df``; ``metrics`` are aggregates observed during the write, put in ``seen`` with its row count."""
        self._n += 1
        path = f"{self.root}/{self._n}"
        watch = Observation()
        df = df.observe(watch, F.count(F.lit(1)).alias("rows"), *(c.alias(k) for k, c in metrics.items()))
        df.write.parquet(path)
        self.seen = watch.get
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path  # type: ignore[attr-defined]
        return out

    def close(self) -> None:
        """Deletes all tables of the call; what was made of them must have been read."""
        self._fs.delete(self._path, True)

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            path = getattr(t, "_scratch_path", None)
            if path:
                self._fs.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path), True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where it comes in fewer parts than there are cores, as a table of one file does; else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
