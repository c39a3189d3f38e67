"""Loading edge records, and setting apart those that fail with the reason.

Records are read permissively under an explicit schema: every record becomes a
row of typed columns, and one that does not fit keeps its raw text in
``_corrupt`` with the typed columns null.  Only those are then looked at again,
for broken quotes, the number of fields and the cast of each field, in that
order, which gives the reason.

All of it is column expressions in one pass without a shuffle; a record is at
most one row of work, so there is no skew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK = " \t\r"
#: Fields of each layout; of a csv record, weight and ts may be empty and note is free.
LAYOUTS = {"el": ("src", "dst"), "dyn": ("op", "src", "dst", "weight", "ts"), "csv": ("op", "src", "dst", "weight", "ts", "note")}
NUMBER = r"^[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"
_FIELD = r'(?:"[^"]*+(?:""[^"]*+)*+"|[^",]*+)'


def _id(c: Column) -> Column:
    """ASCII digits below 2^63, else null."""
    return F.when(c.rlike("^[0-9]+$"), c.try_cast("bigint"))


def _weight(c: Column) -> Column:
    """A finite decimal number, else null."""
    x = F.when(c.rlike(NUMBER), c.try_cast("double"))
    return F.when(F.abs(x) < float("inf"), x)


def _op(c: Column) -> Column:
    return F.when(c.isin("+1", "1"), F.lit(1)).when(c == "-1", F.lit(-1))


def read_records(records: DataFrame, raw: str = "raw", layout: str = "layout") -> DataFrame:
    """The records' other columns with ``op, src, dst, weight, ts, note`` and ``_corrupt``.

    Blanks, tabs and carriage returns at both ends do not count.  Records that
    are then empty, and in ``el`` and ``dyn`` those that begin with ``%`` or
    ``#``, are neither loaded nor failed and give no row; nor does a null
    record.  ``_corrupt`` is null for a loaded record, else the raw text.
    Input columns that bear one of the added names are left out.  Every input
    row is judged by itself, so repeated rows come out as often as they went in.
    """
    added = {"op", "src", "dst", "weight", "ts", "note", "_corrupt", "_fields", "_text"}
    keep = [F.col(c) for c in records.columns if c.lower() not in added]
    text = F.btrim(F.col(raw), F.lit(BLANK))
    lay = F.col(layout)
    rows = records.filter(F.col(raw).isNotNull()).select(*keep, text.alias("_text"))
    rows = rows.filter((F.col("_text") != "") & ~(lay.isin("el", "dyn") & F.col("_text").rlike("^[%#]")).eqNullSafe(True))
    t = F.col("_text")
    quoted = F.transform(
        F.regexp_extract_all(F.concat(F.lit(","), t), F.lit(f",({_FIELD})"), F.lit(1)),
        lambda x: F.when(x.startswith('"'), F.replace(x.substr(F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x),
    )
    fields = F.when(lay == "csv", F.when(~t.contains('"'), F.split(t, ",", -1)).when(t.rlike(rf"\A{_FIELD}(?:,{_FIELD})*+\z"), quoted)).when(lay.isin("el", "dyn"), F.split(t, "[ \t]+", -1))
    rows = rows.withColumn("_fields", fields)
    at = lambda i: F.get("_fields", F.lit(i))
    el = lay == "el"
    rows = rows.select(
        *keep,
        "_text",
        "_fields",
        F.when(el, F.lit(1)).otherwise(_op(at(0))).alias("op"),
        _id(F.when(el, at(0)).otherwise(at(1))).alias("src"),
        _id(F.when(el, at(1)).otherwise(at(2))).alias("dst"),
        F.when(~el, _weight(at(3))).alias("weight"),
        F.when(~el, _id(at(4))).alias("ts"),
        F.when(lay == "csv", at(5)).alias("note"),
    )
    want = F.when(el, 2).when(lay == "dyn", 5).when(lay == "csv", 6)
    empty = lambda i: (lay == "csv") & (at(i) == "")
    fits = (
        (F.size("_fields") == want)
        & F.col("op").isNotNull()
        & F.col("src").isNotNull()
        & F.col("dst").isNotNull()
        & (el | F.col("weight").isNotNull() | empty(3))
        & (el | F.col("ts").isNotNull() | empty(4))
    )
    rows = rows.withColumn("_corrupt", F.when(F.coalesce(fits, F.lit(False)), F.lit(None)).otherwise(F.col(raw) if raw in records.columns and raw.lower() not in added else t))
    ok = F.col("_corrupt").isNull()
    typed = [F.when(ok, F.col(c)).alias(c) for c in ("op", "src", "dst", "weight", "ts", "note")]
    return rows.select(*keep, *typed, "_corrupt", "_fields")


def split_records(records: DataFrame, raw: str = "raw", layout: str = "layout") -> tuple[DataFrame, DataFrame]:
    """``(loaded, failed)``: the loaded rows with typed columns, and the failed ones with ``reason``.

    ``reason`` is the first that applies of ``quoting`` (broken quotes),
    ``columns`` (the number of fields differs from the layout's) and ``value``
    (a field violates its form).  A record of no known layout fails with
    ``layout``.  See :func:`read_records` for records that are neither.
    """
    rows = read_records(records, raw, layout)
    loaded = rows.filter(F.col("_corrupt").isNull()).drop("_corrupt", "_fields")
    lay = F.col(layout)
    want = F.when(lay == "el", 2).when(lay == "dyn", 5).when(lay == "csv", 6)
    reason = F.when(want.isNull(), "layout").when(F.col("_fields").isNull(), "quoting").when(F.size("_fields") != want, "columns").otherwise("value")
    failed = rows.filter(F.col("_corrupt").isNotNull()).withColumn("reason", reason).drop("op", "src", "dst", "weight", "ts", "note", "_fields")
    return loaded, failed
