from rillgraph.sources.edges import BAD_EXTRA, BAD_FLAG, BAD_VALUE, parse_lines
from rillgraph.sources.records import split_records

CASES = [
    ("el", "1 2", None), ("el", "\t 007 \t 8 \r", None), ("el", "% 1", "skip"), ("el", "", "skip"), ("el", " \t\r", "skip"), ("el", None, "skip"),
    ("el", "1", "columns"), ("el", "1 2 3", "columns"), ("el", "1 x", "value"), ("el", "1 9223372036854775808", "value"), ("el", "1 -2", "value"), ("el", '"1" 2', "value"),
    ("dyn", "+1 1 2 .5e3 7", None), ("dyn", "-1 1 2 -3 7", None), ("dyn", "2 1 2 3 7", "value"), ("dyn", "1 1 2 1e999 7", "value"), ("dyn", "1 1 2 nan 7", "value"), ("dyn", "1,1,2,3,7", "columns"),
    ("csv", '1,1,2,,,', None), ("csv", '1,"1",2,3,4,"a, ""b""\nc"', None), ("csv", '1,1,2,3,4,a"b', "quoting"), ("csv", '1,1,2,3,4,"a', "quoting"), ("csv", '1,1,2,3,4,"a"b', "quoting"),
    ("csv", "1,1,2,3,4", "columns"), ("csv", "1, 1,2,3,4,x", "value"), ("csv", "%1,1,2,3,4,x", "value"), ("csv", '1,1,2,3,4,"' + "x" * 200_000 + '"', None),
    ("what", "1 2", "layout"), (None, "1 2", "layout"),
]


def test_records_reasons_and_typed_rows(spark):
    rows = [(i, lay, raw, "clash") for i, (lay, raw, _) in enumerate(CASES)] * 2  # repeated rows stay repeated
    df = spark.createDataFrame(rows, "line_id long, layout string, raw string, src string")
    loaded, failed = split_records(df)
    assert sorted(r.line_id for r in loaded.collect()) == sorted([i for i, c in enumerate(CASES) if c[2] is None] * 2)
    assert {r.line_id: r.reason for r in failed.collect()} == {i: c[2] for i, c in enumerate(CASES) if c[2] not in (None, "skip")}
    one = loaded.filter("line_id = 19").first()
    assert (one.op, one.src, one.dst, one.weight, one.ts, one.note) == (1, 1, 2, 3.0, 4, 'a, "b"\nc')
    empty_loaded, empty_failed = split_records(df.limit(0))
    assert empty_loaded.isEmpty() and empty_failed.isEmpty()


def test_strict_messages(spark):
    def reasons(lines, layout):
        df = spark.createDataFrame([(x,) for x in lines], "value string")
        return [r._reason for r in parse_lines(df, layout, strict=False).collect()]

    assert reasons(["+1 1 5 5.1 1048757088", "-1 71 77 -25.3 1167247890"], "dyn") == [None, None]
    assert reasons(["1 x 2 3 4", "1 1 2 3", "3 1 2 3 4", "1 1 2 3 4 1 1 2 3 4"], "dyn") == [BAD_VALUE, BAD_VALUE, BAD_FLAG, BAD_EXTRA]
    import pytest

    with pytest.raises(Exception, match=BAD_EXTRA):
        parse_lines(spark.createDataFrame([("1 2 3",)], "value string"), "el").collect()
