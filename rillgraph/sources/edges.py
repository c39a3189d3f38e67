"""Edge lists and change streams: text files, Parquet, packed pairs, and a random graph."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Scratch
from .records import BLANK, LAYOUTS, NUMBER

#: Messages of the strict parser.
BAD_VALUE, BAD_FLAG, BAD_EXTRA = "Invalid parameter while parsing edge.", "Insert/delete flag must be first entry in line", "Extra data on input line"


def parse_lines(lines: DataFrame, layout: str, strict: bool = True, value: str = "value") -> DataFrame:
    """The lines' other columns with ``op, src, dst, weight, ts`` and ``_corrupt``.

    ``layout`` is ``el`` (``src dst``, all inserts) or ``dyn`` (``op src dst
    weight ts``).  Empty lines and those that begin with ``%`` or ``#`` give no
    row.  A line of too few or bad fields, a flag other than 1 or -1, or more
    fields than the layout's is an error: strict, it ends the query with that
    message; else the row keeps its text in ``_corrupt``.
    """
    keep = [c for c in lines.columns if c not in (value, "op", "src", "dst", "weight", "ts", "_corrupt")]
    t = F.btrim(F.col(value), F.lit(BLANK + "\n"))
    rows = lines.withColumn("_t", t).filter((F.col("_t") != "") & ~F.col("_t").rlike("^[%#]")).withColumn("_f", F.split("_t", "[ \t]+"))
    at = lambda i: F.get("_f", F.lit(i))
    id_ = lambda c: F.when(c.rlike("^[0-9]+$"), c.try_cast("bigint"))
    k = 0 if layout == "el" else 1
    op = F.lit(1) if layout == "el" else at(0).try_cast("int")
    src, dst = id_(at(k)), id_(at(k + 1))
    weight = F.lit(None).cast("double") if layout == "el" else F.when(at(3).rlike(NUMBER), at(3).try_cast("double"))
    ts = F.lit(None).cast("bigint") if layout == "el" else id_(at(4))
    bad = src.isNull() | dst.isNull()
    flag = F.lit(False)
    if layout == "dyn":
        bad = bad | op.isNull() | weight.isNull() | ts.isNull()
        flag = ~op.isin(1, -1)
    error = F.when(bad, BAD_VALUE).when(flag, BAD_FLAG).when(F.size("_f") > len(LAYOUTS[layout]), BAD_EXTRA)
    rows = rows.withColumn("_error", error)
    if strict:
        rows = rows.withColumn("_t", F.when(F.col("_error").isNotNull(), F.raise_error(F.col("_error"))).otherwise(F.col("_t")))
        rows = rows.filter(F.col("_t").isNotNull())
    ok = F.col("_error").isNull()
    typed = [F.when(ok, c).alias(n) for n, c in (("op", op), ("src", src), ("dst", dst), ("weight", weight), ("ts", ts))]
    return rows.select(*keep, *typed, F.when(~ok, F.col("_t")).alias("_corrupt"), F.when(~ok, F.col("_error")).alias("_reason"))


def _files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """``(path, bytes)`` of a file, or of a folder's files in the order of their names."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)
    return sorted((f.getPath().toString(), f.getLen()) for f in found if not f.isDirectory() and f.getPath().getName()[0] not in "._")


def read_edges(spark: SparkSession, files: list[tuple[str, str]] | list[str], strict: bool = True) -> DataFrame:
    """Changes of several files or folders in their order: ``(path, layout)`` pairs, or paths of ``el`` files.

    ``seq decimal(38,0)`` orders changes by file, a folder's files by name, and by
    the place in the file, so that the last change of an edge is well defined:
    the bytes before a split of a file, and the row in it.  Each layout is one
    scan, whose files are split among tasks.  A file given twice is read once,
    at its last place.
    """
    pairs = [(f, "el") if isinstance(f, str) else f for f in files]
    if not pairs:
        raise ValueError("no files")
    known, before = {}, 0
    for i, (path, layout) in enumerate(pairs):
        for name, size in _files(spark, path):
            known[name] = (re.sub("^file:/+", "file:/", name), layout, i, before)
            before += size + 1
    out = None
    for layout in sorted({x[1] for x in known.values()}):
        mine = {name: x for name, x in known.items() if x[1] == layout}
        places = spark.createDataFrame([(x[0], x[2], x[3]) for x in mine.values()], "__path string, file_no int, __before long")
        lines = spark.read.text(list(mine)).select("value", F.regexp_replace("_metadata.file_path", "^file:/+", "file:/").alias("__path"), F.col("_metadata.file_block_start").alias("__start"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("__row"))
        lines = lines.join(F.broadcast(places), "__path")  # one row a file
        seq = (F.col("__before") + F.col("__start")).cast("decimal(28,0)") * F.lit(1 << 33).cast("decimal(11,0)") + F.col("__row")
        rows = parse_lines(lines.select("value", "file_no", seq.cast("decimal(38,0)").alias("seq")), layout, strict)
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no files")
    return out


def read_parquet_edges(spark: SparkSession, path: str, src: str = "src", dst: str = "dst") -> DataFrame:
    return spark.read.parquet(path).select(F.col(src).cast("long").alias("src"), F.col(dst).cast("long").alias("dst"))


def unpack_edges(packed: DataFrame, col: str = "value") -> DataFrame:
    """Edges of binary rows of packed little-endian 64-bit pairs; a single zero word at the end closes a stream, another odd word is an error."""
    words = F.length(col) / 8
    hexed = F.hex(F.col(col))
    word = lambda i: F.conv(F.array_join(F.transform(F.sequence(F.lit(7), F.lit(0), F.lit(-1)), lambda b: F.substring(hexed, (i * 16 + b * 2 + 1).cast("int"), F.lit(2))), ""), 16, -10).cast("bigint")
    n = F.floor(words / 2).cast("int")
    odd = (words % 2 != 0) & ~((F.floor(words) == words) & (word(n * 2) == 0))
    rows = packed.withColumn("__n", F.when(odd, F.raise_error(F.lit("odd number of words"))).otherwise(n)).filter("__n > 0")
    return rows.select(F.explode(F.transform(F.sequence(F.lit(0), F.col("__n") - 1), lambda i: F.struct(word(i * 2).alias("src"), word(i * 2 + 1).alias("dst")))).alias("e")).select("e.src", "e.dst")


def random_graph(spark: SparkSession, vertices: int, edges: int, rank: int = 0, ranks: int = 1, seed: int = 1, allow_self_loops: bool = False) -> DataFrame:
    """``edges / ranks`` distinct random edges (the last rank takes what is left over) with ``src`` in the rank's slice of the vertices."""
    slice_ = vertices // ranks
    want = edges // ranks + (edges % ranks if rank == ranks - 1 else 0)
    room = slice_ * (vertices - (0 if allow_self_loops else 1))
    if want > room * 0.9:
        raise ValueError("too many edges for so few vertices: use a better random graph model")
    draws = int(want * 1.2 + 50)
    scratch = Scratch(spark, "random")
    while True:
        ids = spark.range(draws)
        src = F.pmod(F.xxhash64(F.lit(seed), F.lit(rank), "id", F.lit(0)), F.lit(slice_)) + rank * slice_
        dst = F.pmod(F.xxhash64(F.lit(seed), F.lit(rank), "id", F.lit(1)), F.lit(vertices))
        e = ids.select("id", src.alias("src"), dst.alias("dst"))
        e = e if allow_self_loops else e.filter("src <> dst")
        first = scratch.table(e.groupBy("src", "dst").agg(F.min("id").alias("id")))
        if scratch.seen["rows"] >= want:
            break
        scratch.drop(first)
        draws *= 2
    # The first ``want`` draws that are new: whole blocks of draws, and part of the one in which the number is reached.
    block = max(1, draws // 1000)
    upto = 0
    for b, n in sorted(first.groupBy(F.floor(F.col("id") / block)).count().collect()):  # a thousand rows or so
        if upto + n >= want:
            inside = sorted(r.id for r in first.filter((F.col("id") >= b * block) & (F.col("id") < (b + 1) * block)).select("id").collect()) if block <= 100_000 else None
            if inside is None:
                inside = [r[0] for r in first.filter((F.col("id") >= b * block) & (F.col("id") < (b + 1) * block)).select("id").orderBy("id").limit(want - upto).select(F.max("id")).collect()]
                return first.filter(F.col("id") <= inside[0]).select("src", "dst")
            return first.filter(F.col("id") <= inside[want - upto - 1]).select("src", "dst")
        upto += n
    return first.select("src", "dst")
