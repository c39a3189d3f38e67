"""The queries of the general data-preparation operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.selection import by_side, neighbour_counts, neighbour_pairs, quantiles, vertices_with_neighbours
from ..sources.records import split_records


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return split_records(_t(spark, d, "edge_line"))[1].select("line_id", "reason")


def p2_loaded(spark: SparkSession, d: str) -> DataFrame:
    return split_records(_t(spark, d, "edge_line"))[0].select("line_id", "op", "src", "dst", F.coalesce("weight", F.lit(0.0)).alias("weight"), F.coalesce("ts", F.lit(-1)).alias("ts"), F.col("weight").isNotNull().alias("has_weight"), F.col("ts").isNotNull().alias("has_ts"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return vertices_with_neighbours(_t(spark, d, "edge"), 25).select("side", "vertex_id")


def p3_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return neighbour_counts(_t(spark, d, "edge"))


def p3_quantiles(spark: SparkSession, d: str) -> DataFrame:
    pairs = by_side(neighbour_pairs(_t(spark, d, "edge")))
    return quantiles(pairs, [0.25, 0.5, 0.9]).select("k.side", F.col("k.id").alias("vertex_id"), "n", "share", F.col("v").alias("neighbour"))


QUERIES = {"p2_found": p2_found, "p2_loaded": p2_loaded, "p3_found": p3_found, "p3_neighbours": p3_neighbours, "p3_quantiles": p3_quantiles}

_FIELD = '("[^"]*"|[^",]*)'
_Q = '("([^"]|"")*"|[^",]*)'
_RECORDS = rf"""WITH t AS (SELECT line_id, layout, trim(raw, ' ' || chr(9) || chr(13)) AS t FROM edge_line WHERE raw IS NOT NULL),
r AS (SELECT * FROM t WHERE t <> '' AND NOT (layout IN ('el', 'dyn') AND t[1] IN ('%', '#'))),
f AS (SELECT *, CASE WHEN layout <> 'csv' THEN regexp_split_to_array(t, '[ \t]+')
 WHEN regexp_full_match(t, '(?s){_Q}(,{_Q})*') THEN list_transform(regexp_extract_all(',' || t, '(?s),(("([^"]|"")*")|[^",]*)', 1),
  lambda x: CASE WHEN x[1] = '"' THEN replace(x[2:-2], '""', '"') ELSE x END) END AS f FROM r),
c AS (SELECT line_id, layout, f, CASE layout WHEN 'el' THEN 2 WHEN 'dyn' THEN 5 ELSE 6 END AS want,
 CASE WHEN layout = 'el' THEN '1' ELSE f[1] END AS op, CASE WHEN layout = 'el' THEN f[1] ELSE f[2] END AS src,
 CASE WHEN layout = 'el' THEN f[2] ELSE f[3] END AS dst, CASE WHEN layout <> 'el' THEN f[4] END AS weight, CASE WHEN layout <> 'el' THEN f[5] END AS ts FROM f),
v AS (SELECT *, CASE WHEN regexp_full_match(src, '[0-9]+') THEN try_cast(src AS BIGINT) END AS s, CASE WHEN regexp_full_match(dst, '[0-9]+') THEN try_cast(dst AS BIGINT) END AS d,
 CASE WHEN regexp_full_match(weight, '[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?') THEN try_cast(weight AS DOUBLE) END AS w,
 CASE WHEN regexp_full_match(ts, '[0-9]+') THEN try_cast(ts AS BIGINT) END AS u, CASE WHEN op IN ('+1', '1') THEN 1 WHEN op = '-1' THEN -1 END AS o FROM c),
g AS (SELECT *, CASE WHEN f IS NULL THEN 'quoting' WHEN len(f) <> want THEN 'columns'
 WHEN o IS NULL OR s IS NULL OR d IS NULL OR (layout <> 'el' AND ((w IS NULL OR isinf(w)) AND NOT (layout = 'csv' AND weight = '') OR u IS NULL AND NOT (layout = 'csv' AND ts = ''))) THEN 'value' END AS reason FROM v)"""

_PAIRS = "WITH p AS (SELECT DISTINCT src, dst FROM edge WHERE src >= 0 AND dst >= 0)"

SQL = {
    "p2_found": f"{_RECORDS} SELECT line_id, reason FROM g WHERE reason IS NOT NULL",
    "p2_loaded": f"{_RECORDS} SELECT line_id, o::INTEGER AS op, s AS src, d AS dst, coalesce(w, 0) AS weight, coalesce(u, -1) AS ts, w IS NOT NULL AS has_weight, u IS NOT NULL AS has_ts FROM g WHERE reason IS NULL",
    "p3_found": f"{_PAIRS} SELECT 'src' AS side, src AS vertex_id FROM p GROUP BY src HAVING count(*) >= 25 UNION ALL SELECT 'dst', dst FROM p GROUP BY dst HAVING count(*) >= 25",
    "p3_neighbours": f"{_PAIRS} SELECT coalesce(a.v, b.v) AS vertex_id, coalesce(o, 0)::BIGINT AS n_out, coalesce(i, 0)::BIGINT AS n_in FROM (SELECT src v, count(*) o FROM p GROUP BY 1) a FULL JOIN (SELECT dst v, count(*) i FROM p GROUP BY 1) b ON a.v = b.v",
    "p3_quantiles": f"""{_PAIRS}, s AS (SELECT 'src' AS side, src AS vertex_id, dst AS x FROM p UNION ALL SELECT 'dst', dst, src FROM p),
 r AS (SELECT *, row_number() OVER (PARTITION BY side, vertex_id ORDER BY x) AS rk, count(*) OVER (PARTITION BY side, vertex_id) AS n FROM s)
 SELECT side, vertex_id, n, q.share AS share, x AS neighbour FROM r JOIN (VALUES (0.25::DOUBLE), (0.5), (0.9)) q(share) ON rk = greatest(ceil(q.share * n), 1)""",
}
