"""The truth table of replies."""

import pytest

from sheetlens.operators import replies as R

OK = '{"issue_type":"missing_tag","severity":"high","description":"d","location_hint":"x"}'


def ok(**fields) -> str:
    import json

    item = json.loads(OK)
    for k, v in fields.items():
        if v is ...:
            del item[k]
        else:
            item[k] = v
    return json.dumps(item)


ROW = ("missing_tag", "high", "d", "x")
CASES = [
    ('{"issues":[%s]}' % OK, [ROW]),
    ("[%s]" % OK, [ROW]),
    ('```json\n{"issues":[%s]}\n```' % OK, [ROW]),
    ('```\n{"issues":[%s]}' % OK, [ROW]),
    *((x, []) for x in ('{"issues":[]}', "{}", "5", "null", '"s"', "", "nope", None)),
    *((x, []) for x in ('{"issues":"abc"}', '{"issues":{"k":1}}', '{"issues":[1,"x",null,[]]}')),
    ("[%s]" % ok(severity=" HIGH "), [ROW]),
    *(("[%s]" % ok(severity=s), []) for s in ("critical", None, ..., ["low"])),
    ("[%s]" % ok(issue_type="Missing Tag"), [ROW]),
    *(("[%s]" % ok(issue_type=s), []) for s in ("missing  tag", "other")),
    *(("[%s]" % ok(description=s), []) for s in (" ", ...)),
    ("[%s]" % ok(description=None), [("missing_tag", "high", "None", "x")]),
    ("[%s]" % ok(description=5), [("missing_tag", "high", "5", "x")]),
    ("[%s]" % ok(description=1.5), [("missing_tag", "high", "1.5", "x")]),
    ("[%s]" % ok(description=[]), [("missing_tag", "high", "[]", "x")]),
    *(("[%s]" % ok(location_hint=s), [("missing_tag", "high", "d", None)]) for s in (None, ..., 0, False, [], {}, " ")),
    ("[%s]" % ok(location_hint=3), [("missing_tag", "high", "d", "3")]),
    *(("[%s]" % ok(description=v), [("missing_tag", "high", str(v), "x")]) for v in (
        1.0, True, False, 1e5, 1e16, 1.5e300, 12345678.25, 1e-7, 0.0001, 0.00001, 2.5e-5, -2.5, 123456789012, 1e15, {"a": 1}, {"a": [True, None, "it's"], "b": {"c": "x\ny"}}, [1, "q"])),
    *(("[%s]" % OK.replace('"d"', v), [("missing_tag", "high", t, "x")]) for v, t in (("NaN", "nan"), ("Infinity", "inf"), ("-Infinity", "-inf"), ("[NaN]", "[nan]"), ('"NaN \\" Infinity"', 'NaN " Infinity'))),
    ('{"n":NaN,"m":[-Infinity,"x-y"],"issues":[%s]}' % OK, [ROW]),
    ('[%s, {"severity": NaN}]' % OK, [ROW]),
    *((x, []) for x in ("NaN", "-Infinity", "[NaN]", "NaNNaN", "[NaN")),
    ("[%s]" % OK.replace('"x"', "NaN"), [("missing_tag", "high", "d", "nan")]),
    *(("[%s]" % ok(location_hint=v), [("missing_tag", "high", "d", str(v))]) for v in (1.0, True, ["a"])),
    ('{"issues":[],"issues":[%s]}' % OK, [ROW]),
    ('{"issues":[%s]} trailing' % OK, []),
    ("1,2", []),
]


def test_truth_table(spark):
    R.allow_repeated_keys(spark)
    replies = spark.createDataFrame([(i, raw) for i, (raw, _) in enumerate(CASES)], "i int, raw string")
    got: dict = {}
    for r in R.second_check(R.findings(replies)).orderBy("i", "pos").collect():
        got.setdefault(r.i, []).append((r.issue_type, r.severity, r.description, r.location_hint))
    for i, (raw, want) in enumerate(CASES):
        assert got.get(i, []) == want, raw


@pytest.mark.parametrize("raw", ['{"issues":null}', '{"issues":5}', '{"issues":true}', '{"issues":NaN}', '{"issues":-Infinity}'])
def test_failed_replies(spark, raw):
    rows = R.rejects(spark.createDataFrame([(1, raw)], "i int, raw string")).collect()
    assert [(r.state, r.start) for r in rows] == [("failed", raw)]


def test_log_prefix(spark):
    rows = R.rejects(spark.createDataFrame([(1, "x" * 500)], "i int, raw string")).collect()
    assert [(r.state, len(r.start)) for r in rows] == [("unparseable", 200)]


def test_long_texts_beside_bare_values(spark):
    """The scanner passes over strings as a whole, however long."""
    R.allow_repeated_keys(spark)
    long = "NaN, \\\"Infinity " * 20_000
    raw = '{"a":"%s","n":NaN,"issues":[%s]}' % (long, OK)
    assert R.findings(spark.createDataFrame([(1, raw)], "i int, raw string")).count() == 1


def test_small_tables_are_dealt_to_all_cores(spark, sf001):
    rows = spark.read.parquet(f"{sf001}/events.parquet")
    assert rows.rdd.getNumPartitions() == 1
    assert R.spread(rows).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
