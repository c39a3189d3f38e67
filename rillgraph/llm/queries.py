"""The training-data queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Scratch
from .groups import link_groups
from .heavy import frequent, frequent_exact
from .logs import parse_logs
from .mixing import mix_documents
from .packing import fill_report, pack_documents
from .subjects import subjects


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return link_groups(_t(spark, d, "edge"))


def p1_distributed(spark: SparkSession, d: str) -> DataFrame:
    """p1_found with every level distributed, also those that one task would do."""
    return link_groups(_t(spark, d, "edge"), one_task=0)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return frequent_exact(_t(spark, d, "edge"), ["src", "dst"], 0.005).select("field", "vertex_id")


def p4_estimates(spark: SparkSession, d: str) -> DataFrame:
    return frequent(_t(spark, d, "edge"), ["src", "dst"], 0.005)


def p4_recall(spark: SparkSession, d: str) -> DataFrame:
    """Of the truly frequent ids, those that the sketch misses, and those that it estimates below their count: none of either."""
    edges = _t(spark, d, "edge")
    true = frequent_exact(edges, ["src", "dst"], 0.005).select("field", "vertex_id", "n")
    both = true.join(frequent(edges, ["src", "dst"], 0.005), ["field", "vertex_id"], "left")
    return both.groupBy("field").agg(F.count(F.lit(1)).alias("frequent"), F.count(F.when(F.col("estimate").isNull(), 1)).alias("missed"), F.count(F.when(F.col("estimate") < F.col("n"), 1)).alias("below"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return parse_logs(_t(spark, d, "agent_log"), with_message=False).select("line_id", "last_line_id", "ts_ms", "log_level", "component", "nv", "ne")


def p6_pack(spark: SparkSession, d: str) -> DataFrame:
    return pack_documents(_t(spark, d, "documents"), _t(spark, d, "pack_size"))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    packs = _t(spark, d, "pack_size")
    return fill_report(pack_documents(_t(spark, d, "documents"), packs), packs)


def p6_invariants(spark: SparkSession, d: str) -> DataFrame:
    """``(pack_name, documents, overfull, split)``: documents placed, containers beyond the capacity, and documents split though they fit."""
    packs = _t(spark, d, "pack_size")
    placed = Scratch(spark, "placed").table(pack_documents(_t(spark, d, "documents"), packs).join(F.broadcast(packs), "pack_name"))
    size = F.col("to_token") - F.col("from_token")
    by_container = placed.groupBy("pack_name", "container").agg(F.sum(size).alias("t"), F.max("capacity_tokens").alias("c"))
    over = by_container.groupBy("pack_name").agg(F.count(F.when(F.col("t") > F.col("c"), 1)).alias("overfull"))
    by_doc = placed.groupBy("pack_name", "doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.max("to_token").alias("t"), F.max("capacity_tokens").alias("c"))
    docs = by_doc.groupBy("pack_name").agg(F.count(F.lit(1)).alias("documents"), F.count(F.when((F.col("pieces") > 1) & (F.col("t") <= F.col("c")), 1)).alias("split"))
    return docs.join(over, "pack_name").select("pack_name", "documents", "overfull", "split")


#: The portal's and the gazette's weights over the course, relative to their shares.
CURRICULUM = {"court_portal": ((0.0, 1.6), (1.0, 0.4)), "gazette": ((0.0, 0.7), (0.5, 1.0), (1.0, 1.3))}


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix_documents(_t(spark, d, "documents"), _t(spark, d, "mix_target"), schedules=CURRICULUM)[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix_documents(_t(spark, d, "documents"), _t(spark, d, "mix_target"), schedules=CURRICULUM)[1]


def p7_invariants(spark: SparkSession, d: str) -> DataFrame:
    """``(source, overused, off_share)``: documents of a source used more often than it allows, and whether its share is off by more than one document."""
    targets = _t(spark, d, "mix_target")
    mixed, shares = mix_documents(_t(spark, d, "documents"), targets, schedules=CURRICULUM)
    used = mixed.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("uses")).join(F.broadcast(targets), "source")
    used = used.groupBy("source").agg(F.count(F.when(F.col("uses") > F.col("max_repeat"), 1)).alias("overused"))
    most = mixed.agg(F.max("tokens").alias("most"), F.sum("tokens").alias("all"))
    off = F.abs(F.col("actual_share") - F.col("target_share")) * F.col("all") > F.col("most")
    return used.join(shares.join(F.broadcast(most)).select("source", off.alias("off_share")), "source")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return subjects(_t(spark, d, "documents"), _t(spark, d, "doc_label"), _t(spark, d, "subject_area")).select("doc_id", "subject_code")


QUERIES = {
    "p1_found": p1_found,
    "p1_distributed": p1_distributed,
    "p4_found": p4_found,
    "p4_recall": p4_recall,
    "p4_estimates": p4_estimates,
    "p5_found": p5_found,
    "p6_pack": p6_pack,
    "p6_fill": p6_fill,
    "p6_invariants": p6_invariants,
    "p7_mix": p7_mix,
    "p7_shares": p7_shares,
    "p7_invariants": p7_invariants,
    "p8_found": p8_found,
}

SQL = {
    "p4_recall": " UNION ALL ".join(f"SELECT '{c}' AS field, count(*) AS frequent, 0::BIGINT AS missed, 0::BIGINT AS below FROM (SELECT {c} FROM edge WHERE {c} >= 0 GROUP BY {c} HAVING count(*) >= 0.005 * (SELECT count(*) FROM edge WHERE {c} >= 0))" for c in ("src", "dst")),
    "p6_invariants": "SELECT pack_name, (SELECT count(DISTINCT doc_id) FROM documents) AS documents, 0::BIGINT AS overfull, 0::BIGINT AS split FROM pack_size",
    "p7_invariants": "SELECT source, 0::BIGINT AS overused, false AS off_share FROM mix_target",
    "p4_found": " UNION ALL ".join(
        f"SELECT '{c}' AS field, {c} AS vertex_id FROM edge WHERE {c} >= 0 GROUP BY {c} HAVING count(*) >= 0.005 * (SELECT count(*) FROM edge WHERE {c} >= 0)" for c in ("src", "dst")
    ),
}
