"""Filling containers of fixed capacity with items of varying length.

Bulk-synchronous best fit.  Documents are range-sorted by size: a document's
place is its size and its rank among the documents of that size.  Gaps, the
free space of open containers, are kept in the same order.  A superstep takes
the largest size left, matches it with its successor, the smallest gap that
holds it, settles rivals by rank (the first documents get the first containers),
moves the containers to their new gaps and repeats; when no gap is large enough,
containers are opened.

All documents of a size and all containers of a gap are alike, so a match is
made between *ranges* of ranks and of containers.  The sweep therefore needs the
number of documents of each size only: at most ``capacity`` rows a pack,
however many documents there are.  It runs as one task for each pack and gives
some ``capacity * ln(capacity)`` ranges, which are joined by size, broadcast up to
``MOST_RANGES`` of them, and place every document by its rank.

At scale: one pass to count tokens, a combining count by size, and one shuffle
to rank documents within size and salt, with salts in proportion to the rows so
that a size that a third of the documents have stays spread.
"""

from __future__ import annotations

import bisect
from collections import defaultdict, deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import Scratch
from .tokens import token_counts

#: Documents that one ranking group should hold about.
GROUP = 200_000
MOST_RANGES = 5_000_000


def sweep(capacity: int, sizes: list[tuple[int, int]]) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Matches ranges of documents with ranges of containers.

    ``sizes``: ``(size, documents)`` with ``1 <= size <= capacity``.  Gives
    ``(size, first rank, documents, first container, start)``, ``start`` being
    the tokens already in those containers, and the number of containers.
    """
    out: list[tuple[int, int, int, int, int]] = []
    ranges: dict[int, deque[tuple[int, int]]] = defaultdict(deque)  # by gap: (first container, containers)
    gaps: list[int] = []  # the gaps that some container has, sorted
    opened = 0

    def put(gap: int, first: int, n: int) -> None:
        if gap and n:
            if not ranges[gap]:
                bisect.insort(gaps, gap)
            ranges[gap].append((first, n))

    for size, left in sorted(sizes, reverse=True):
        rank = 0
        while left:
            at = bisect.bisect_left(gaps, size)
            if at < len(gaps):
                gap = gaps[at]
                first, n = ranges[gap].popleft()
                k = min(n, left)
                if k < n:
                    ranges[gap].appendleft((first + k, n - k))
                if not ranges[gap]:
                    gaps.pop(at)
                out.append((size, rank, k, first, capacity - gap))
                put(gap - size, first, k)
                rank, left = rank + k, left - k
            else:  # open as many containers as the rest needs, filled layer by layer
                each = capacity // size
                full, more = divmod(left, each)
                for layer in range(each):
                    k = full + (layer < more)
                    if k:
                        out.append((size, rank, k, opened, layer * size))
                        rank += k
                put(capacity - each * size, opened, full)
                if more:
                    put(capacity - more * size, opened + full, 1)
                opened += full + (more > 0)
                left = 0
    return out, opened


def _sweeps(groups: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for g in groups:
        for name, rows in g.groupby("pack_name"):
            capacity = int(rows["capacity"].iloc[0])
            found, _ = sweep(capacity, list(zip(rows["size"].astype(int), rows["n"].astype(int), strict=True)))
            yield pd.DataFrame([(name, *x) for x in found], columns=["pack_name", "size", "rank0", "k", "container0", "start"])


def pack(items: DataFrame, packs: DataFrame, key: str = "doc_id", size: str = "tokens") -> DataFrame:
    """``(pack_name, container, start, doc_id, piece, from_token, to_token)``: the place of every piece of every document.

    ``packs`` has ``pack_name`` and ``capacity_tokens``, one row a pack.  A
    document of more tokens than a container holds is split: its full pieces
    take containers of their own, called ``<doc_id>/<occurrence>/<piece>``, and
    the rest is an item like any other.  No other document is split.  Containers
    that items share are called by numbers from 0, and ``start`` is a piece's
    first token in its container.  A document without tokens is one piece of no
    tokens, and such documents are spread over the shared containers (container
    0 where there is none).  Null sizes count as 0; packs with a null or no
    positive capacity are left out; a document given twice is placed twice,
    under different occurrences; a null key is a key like others.  Of an empty
    table the result is empty.
    """
    spark = items.sparkSession
    s = Scratch(spark, "packing")
    sized = items.select(F.col(key).alias("doc_id"), F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)).alias("tokens"))
    sized = s.table(sized)
    salts = max(1, s.seen["rows"] // GROUP)
    known = packs.filter("capacity_tokens > 0 and pack_name is not null").groupBy("pack_name").agg(F.max("capacity_tokens")).collect()  # the few packs to fill
    kinds = [F.struct(F.lit(name).alias("pack_name"), F.lit(capacity).cast("long").alias("capacity")) for name, capacity in known]
    each = sized.withColumn("p", F.explode(F.array(*kinds) if kinds else F.expr("cast(array() as array<struct<pack_name: string, capacity: bigint>>)")))
    each = each.select("doc_id", "tokens", "p.pack_name", "p.capacity")
    each = each.withColumn("full", F.floor(F.col("tokens") / F.col("capacity"))).withColumn("size", F.col("tokens") % F.col("capacity"))
    # One row for each item: what a document's full pieces leave, and documents without tokens.
    parts = each.filter("size > 0 or full = 0").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    counts = s.table(parts.groupBy("pack_name", "capacity", "size", "salt").agg(F.count(F.lit(1)).alias("n")))
    before = F.sum("n").over(Window.partitionBy("pack_name", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("pack_name", "size", "salt", F.coalesce(before, F.lit(0)).alias("before"))
    sizes = counts.filter("size > 0").groupBy("pack_name", "capacity", "size").agg(F.sum("n").alias("n"))
    found = sizes.groupBy("pack_name").applyInPandas(lambda g: next(_sweeps(iter([g]))), "pack_name string, size long, rank0 long, k long, container0 long, start long")
    found = s.table(found, most=F.max(F.col("container0") + F.col("k")))
    small = s.seen["rows"] <= MOST_RANGES
    open_ = {r[0]: r[1] for r in found.groupBy("pack_name").agg(F.max(F.col("container0") + F.col("k"))).collect()}
    by_rank = F.row_number().over(Window.partitionBy("pack_name", "size", "salt").orderBy("doc_id")) - 1
    ranked = parts.withColumn("r", by_rank).join(offsets, ["pack_name", "size", "salt"]).withColumn("rank", F.col("r") + F.col("before"))
    # A size's ranges in the order of their ranks: the last one that begins at or below an item's rank has it.
    ranges = found.groupBy("pack_name", "size").agg(F.sort_array(F.collect_list(F.struct("rank0", "container0", "start"))).alias("in"))  # ranges, not documents
    shared = ranked.filter("size > 0").join(F.broadcast(ranges) if small else ranges, ["pack_name", "size"])
    place = F.get("in", F.size(F.filter("in", lambda x: x["rank0"] <= F.col("rank"))) - 1)
    shared = shared.withColumn("x", place).withColumn("rank0", F.col("x.rank0")).withColumn("container0", F.col("x.container0")).withColumn("start", F.col("x.start"))
    shared = shared.withColumn("container", (F.col("container0") + F.col("rank") - F.col("rank0")).cast("string"))
    n_open = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in open_.items() for x in kv)), F.col("pack_name")), F.lit(0)) if open_ else F.lit(0)
    nothing = ranked.filter("size = 0").withColumn("container", F.when(n_open > 0, F.pmod(F.col("rank"), n_open)).otherwise(0).cast("string"))
    cols = ["pack_name", "container", "start", "doc_id", "piece", "from_token", "to_token"]
    shared = shared.withColumn("piece", F.col("full")).withColumn("from_token", F.col("tokens") - F.col("size")).withColumn("to_token", F.col("tokens")).select(cols)
    zero = F.lit(0).cast("long")
    nothing = nothing.select("pack_name", "container", zero.alias("start"), "doc_id", zero.alias("piece"), zero.alias("from_token"), zero.alias("to_token"))
    # Occurrences tell full pieces of a document that is given twice apart.
    long_ = each.filter("full > 0").withColumn("occ", F.row_number().over(Window.partitionBy("pack_name", "doc_id").orderBy("tokens")))
    long_ = long_.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1)))
    name = F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("occ"), F.col("piece"))
    long_ = long_.select("pack_name", name.alias("container"), zero.alias("start"), "doc_id", "piece", (F.col("piece") * F.col("capacity")).alias("from_token"), ((F.col("piece") + 1) * F.col("capacity")).alias("to_token"))
    return shared.unionByName(nothing).unionByName(long_)


def pack_documents(docs: DataFrame, packs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """:func:`pack` of documents ``(doc_id, text)`` by the tokens of their whole texts."""
    return pack(token_counts(docs, ["doc_id"], vocabulary=vocabulary), packs)


def fill_report(placed: DataFrame, packs: DataFrame) -> DataFrame:
    """``(pack_name, containers, tokens, capacity, fill)`` of a :func:`pack` result."""
    used = placed.filter("to_token > from_token").groupBy("pack_name", "container").agg(F.sum(F.col("to_token") - F.col("from_token")).alias("t"))
    total = used.groupBy("pack_name").agg(F.count(F.lit(1)).alias("containers"), F.sum("t").alias("tokens"))
    capacity = F.col("containers") * F.col("capacity_tokens")
    return total.join(F.broadcast(packs.select("pack_name", "capacity_tokens")), "pack_name").select("pack_name", "containers", "tokens", capacity.alias("capacity"), F.round(F.col("tokens") / capacity, 9).alias("fill"))
