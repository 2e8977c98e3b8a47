"""Result lines: read back as written, each line split once."""

from judgelake.sources.files import export_test_results, parse_test_result_lines
from pyspark.sql import functions as F

FIELDS = "testIndex int, testset string, `group` string, verdict string, points double, timeConsumed long, memoryConsumed long, " \
         "input string, output string, answer string, exitCode int, checkerComment string"


def test_escapes_come_back(spark):
    rows = [(1, "a;b", "\\", "OK", None, 5, 6, "\\n", "\\;\n", "x\\\\;", -1, ";;"), (2, "", "\\\\n", "FAILED", -1.5, 0, 0, "\n\n", "", "\\", 0, "é;")]
    good, bad = parse_test_result_lines(export_test_results(spark.createDataFrame(rows, FIELDS)))
    assert sorted(tuple(r) for r in good.collect()) == rows and bad.count() == 0


def test_bad_lines(spark):
    ok = "1;t;g;OK;1.5;2;3;i;o;a;0;c"
    lines = [ok, "", "x" + ok, ok + ";x", "OK", ok.replace("OK", "FINE"), ok.replace("1.5", ""), ok.replace("1.5", "p"), ok.replace("t;", "\x01;"),
             "99999999999" + ok[1:], ok + "\n"]
    good, bad = parse_test_result_lines(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert sorted((r.points is None, r.checkerComment) for r in good.collect()) == [(False, "c"), (False, "c\n"), (True, "c")]
    assert sorted(tuple(r) for r in bad.collect()) == sorted([
        ("x" + ok, 12), (ok + ";x", 13), ("OK", 1), (lines[5], 12), (lines[7], 12), (lines[8], 12), (lines[9], 12)])


def test_a_line_is_split_once(spark):
    lines = spark.createDataFrame([("a",)], "value string").where(F.rand() >= 0)
    good, _ = parse_test_result_lines(lines)
    plan = good._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") <= 2  # in the test and in the fields; each expression splits once


def test_a_line_is_made_once(spark):
    """Neither the test for empty lines nor that for bad ones takes a copy of what makes the line."""
    lines = spark.range(3).select(F.md5(F.concat(F.col("id").cast("string"), F.lit(";"))).alias("value"))
    for part in parse_test_result_lines(lines):
        assert part._jdf.queryExecution().optimizedPlan().toString().count("md5(") == 1
