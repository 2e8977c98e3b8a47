"""Rules where a plausible shortcut gives another result."""

import pytest
from pyspark.sql import functions as F

from judgelake import constants as K
from judgelake.functions import text as TXT
from judgelake.operators import curate, generate, joins, registry, rollup, udfs, validate, verdict
from judgelake.sources import files


def test_absent_version_is_system_error(spark):
    rows = [(1, "c++14", K.ACCEPTED), (2, "c++14", K.WRONG_ANSWER), *[(3, v, K.ACCEPTED) for v in K.CPP_VERSIONS],
            (4, "c++14", K.COMPILE_ERROR), (4, "c++17", K.COMPILE_ERROR), (5, "c++17", K.WRONG_ANSWER)]
    df = spark.createDataFrame([(k, v, s, s == K.ACCEPTED, None) for k, v, s in rows],
                               "code_id long, version string, verdict string, passed boolean, failed_test int")
    out = {r.code_id: (r.all_passed, r.stopped_at, r.fail_verdict) for r in rollup.version_consensus(df).collect()}
    assert out == {1: (False, "c++17", K.SYSTEM_ERROR), 2: (False, "c++14", K.WRONG_ANSWER), 3: (True, None, None),
                   4: (False, "c++20", K.SYSTEM_ERROR), 5: (False, "c++14", K.SYSTEM_ERROR)}


def test_blank_checker_is_not_usable(spark):
    df = spark.createDataFrame([(None, None), ("", None), ("  ", None), ("  ", True), ("x", True), ("x", False)], "c string, ok boolean")
    got = [r[0] for r in df.select(curate.checker_usable(F.col("c"), F.col("ok"))).collect()]
    assert got == [True, True, False, False, True, False]


@pytest.mark.parametrize("pattern,good,bad", [
    ("x(a|ab)", ["xa", "xab"], ["x", "xabb"]), ("[a b]+", ["a", "ab"], ["a b", ""]), ("[a-z]+", ["abc"], ["abc\n", "abc\r"]),
    ("a b", ["ab"], ["a b"]), (r"a\ b", ["a b"], ["ab"]), ("[0-9]?1", ["21"], ["1"])])
def test_patterns(spark, pattern, good, bad):
    df = spark.createDataFrame([(t,) for t in good + bad], "token string")
    got = {r.token: r.matched for r in validate.validate_pattern(df, {"p": pattern}).collect()}
    assert got == {**dict.fromkeys(good, True), **dict.fromkeys(bad, False)}


def test_numbers_end_with_the_text(spark):
    df = spark.createDataFrame([("5\n",), ("5\r",), ("5",)], "token string")
    for kind, kw in (("int", {}), ("uint", {}), ("double", {}), ("double", {"strict": True})):
        assert {r.token for r in validate.validate_tokens(df, kind, 0, 9, **kw).collect()} == {"5\n", "5\r"}, (kind, kw)


def test_variable_names(spark):
    reads = spark.createDataFrame([("n", "1", "2"), ("~n", "1", "3"), ("n~", "1", "2"), ("a1", "1", "1"), ("~~", "1", "1"), ("~", "0", "1")],
                                  "variable string, lower string, upper string")
    assert {r.variable for r in validate.variable_inventory(reads).collect()} == {"n", "~", "~~"}
    assert {(r.variable, r.lower, r.upper) for r in validate.constant_bounds_report(reads).collect()} == {
        ("n", "1", "?"), ("~~", "1", "1"), ("~", "0", "1")}
    values = spark.createDataFrame([("n", 5.0), ("~m", 5.0), ("k~", 1.0), ("a1", 1.0)], "variable string, value double")
    bounds = spark.createDataFrame([("n", "1", "5", True), ("~m", "1", "9", True), ("k~", "1", "9", True), ("a1", "1", "1", True)],
                                   "variable string, lo string, hi string, is_int boolean")
    got = {r.variable: (r.min_hit, r.max_hit) for r in validate.bounds_hit_report(values, bounds).collect()}
    assert got == {"n": (False, True), "m": (True, False), "k": (True, True)}


def test_checker_without_exit_code(spark):
    df = spark.createDataFrame([(None,), (0,), (1,)], "checker_exit int").withColumn("stem", F.lit("1"))
    assert [r.checker_status for r in verdict.checker_outcome(df).collect()] == [K.SYSTEM_ERROR, K.ACCEPTED, K.WRONG_ANSWER]


def test_unlisted_exit_code_is_partial(spark):
    df = spark.createDataFrame([(3,), (16,), (8,), (60,)], "checker_exit int")
    got = {r.checker_exit: (r.outcome, r.pctype) for r in verdict.checker_outcome_detail(df).collect()}
    assert got == {3: ("fail", None), 16: ("partially", None), 8: ("partially", None), 60: ("partially", None)}
    testsys = {r.checker_exit: (r.outcome, r.pctype) for r in verdict.checker_outcome_detail(df, dialect="testsys").collect()}
    assert testsys[60] == ("partially", 10) and testsys[3] == ("fail", None)


def test_unread_output(spark):
    df = spark.createDataFrame([("ok", " \n\t"), ("ok", "x"), ("points", "x"), ("partially", " y"), ("wa", "x"), ("ok", None)],
                               "outcome string, remainder string")
    assert [r.final_outcome for r in verdict.trailing_output_check(df).collect()] == ["ok", "pe", "pe", "pe", "wa", "ok"]


def test_result_lines_are_checked(spark):
    line = "1;tests;0;OK;1.000;5;6;in;out;ans;0;fine"
    lines = [line, line.replace("OK", "NOPE"), "x" + line[1:], line.replace("1.000", "zz"), line.replace(";5;", ";;"), "a;b"]
    good, bad = files.parse_test_result_lines(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert good.count() == 1 and {r.value for r in bad.collect()} == set(lines[1:])


def test_empty_valid_file_is_readable(spark, tmp_path):
    spark.range(3).coalesce(1).write.parquet(f"file://{tmp_path}/a")
    spark.range(3).where("id > 5").coalesce(1).write.parquet(f"file://{tmp_path}/b")
    import shutil
    (tmp_path / "in").mkdir()
    for k in "ab":
        f = next(p for p in (tmp_path / k).iterdir() if p.name.startswith("part"))
        shutil.copy(f, tmp_path / "in" / f"{k}.parquet")
    (tmp_path / "in" / "broken.parquet").write_bytes(b"PAR1 nothing here")
    rows, skipped = files.scan_tolerant(spark, f"file://{tmp_path}/in")
    assert rows.count() == 3
    assert [r.source_file.rsplit("/", 1)[1] for r in skipped.collect()] == ["broken.parquet"]


def test_draws_refuse_the_impossible(spark):
    df = spark.range(3).withColumnRenamed("id", "v")
    with pytest.raises(ValueError):
        generate.sample_distinct(df, "v", 4, seed=1)
    assert generate.sample_distinct(df, "v", 3, seed=1).count() == 3
    g = spark.createDataFrame([(1, 0, 0, 0), (2, 5, 2, 1)], "group_id long, total long, size long, min_part long")
    parts = generate.random_partition(g, seed=1).collect()
    assert {r.group_id for r in parts} == {2} and sum(r.part for r in parts) == 5


def test_failed_codes_stay_out_of_the_shuffle(spark):
    codes = spark.createDataFrame([("p", 0, "a"), ("p", 1, "b"), ("q", 0, "a")], "problem_id string, pos int, code string")
    failed = spark.createDataFrame([("p", "a"), ("p", "a")], "problem_id string, code string")
    out = joins.exclude_failed_codes(codes, failed)
    assert {(r.problem_id, r.pos) for r in out.collect()} == {("p", 1), ("q", 0)}


def test_long_stems_are_numbers(spark):
    stems = ["2", "10", "0002", "9" * 30, "1" + "0" * 30, "x", "5\n"]
    df = spark.createDataFrame([("p", s) for s in stems], "problem_id string, stem string")
    good, rejects = rollup.case_ordinal(df)
    assert [r.stem for r in good.orderBy("ordinal").collect()] == ["0002", "2", "10", "9" * 30, "1" + "0" * 30]
    assert {r.stem for r in rejects.collect()} == {"x", "5\n"}


def test_equal_outputs_need_no_normal_form(spark):
    df = spark.createDataFrame([("a \r\n\r\n", "a"), (None, "a"), ("a", "a"), ("\r", "")], "a string, b string")
    assert [r[0] for r in df.select(TXT.output_equal(F.col("a"), F.col("b"))).collect()] == [True, False, True, True]


def test_last_upload_of_a_name_wins(spark):
    files = "problem_id string, name string, content string"
    old = spark.createDataFrame([("p", "1.in", "old"), ("p", "2.in", "old"), ("q", "1.in", "old")], files)
    new = spark.createDataFrame([("p", "1.in", "z", 1), ("p", "1.in", "a", 2), ("p", "3.in", "n", 0)], files + ", seq int")
    merged = {(r.problem_id, r.name): r.content for r in registry.merge_testcases(old, new).collect()}
    assert merged == {("p", "1.in"): "a", ("p", "2.in"): "old", ("p", "3.in"): "n", ("q", "1.in"): "old"}
    replaced = {(r.problem_id, r.name): r.content for r in registry.replace_testcases(old, new).collect()}
    assert replaced == {("p", "1.in"): "a", ("p", "3.in"): "n", ("q", "1.in"): "old"}


def test_checker_sees_testset_and_group(spark):
    df = spark.createDataFrame([("i", "o", "o", "tests", "g1"), ("i", "o", "x", "pre", "")], "a string, b string, c string, t string, g string")
    chk = udfs.register_checker("placed", lambda i, o, a, t, g: ("ok" if o == a else "wa", f"{t}/{g}", 1.0), context=True)
    got = [tuple(r[0]) for r in df.select(chk("a", "b", "c", "t", "g")).collect()]
    assert got == [("ok", "tests/g1", 1.0), ("wa", "pre/", 1.0)]


def test_output_sizes_come_from_the_listing(spark, tmp_path):
    for name, size in (("a.parquet", 10), ("b.parquet", 25), ("c.txt", 99)):
        (tmp_path / name).write_bytes(b"x" * size)
    assert {r.output_file: r.bytes for r in files.output_sizes(spark, str(tmp_path)).collect()} == {"a.parquet": 10, "b.parquet": 25, "TOTAL": 35}


def test_layout_check_reports_the_first_breach(spark):
    cases = [("ok\n", None, None), ("a b\n c\n", 2, "leading space"), ("a  b\nc", 1, "double space"), ("a\nb", 2, "missing final line feed"),
             ("a\n\n", 2, "empty line"), ("a\tb \n", 1, "trailing space"), ("a\tb\n", 1, "tab"), ("a\r\n", 1, "carriage return"),
             ("", None, None), (None, None, None)]
    df = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(cases)], "i int, text string")
    got = {r.i: (r.bad_line, r.reason) for r in validate.strict_layout_check(df).collect()}
    assert got == {i: (n, why) for i, (_, n, why) in enumerate(cases)}


def test_first_correct_code_counts_the_tried(spark):
    subs = spark.createDataFrame([("p", 1, 0, "cpp", "a"), ("p", 2, 1, "python", "b"), ("p", 3, 2, "cpp", " "), ("p", 4, 3, "cpp", "c"), ("p", 5, 4, "cpp", "d"),
                                  ("q", 6, 0, "cpp", "e"), ("q", 7, 1, "cpp", "f")],
                                 "problem_id string, submission_id long, pos int, language string, code string")
    verdicts = spark.createDataFrame([(1, False), (4, True), (5, True), (6, False)], "submission_id long, passed boolean")
    got = {r.problem_id: (r.correct_code, r.correct_pos, r.correct_submission_id, r.attempts)
           for r in rollup.first_correct_code(subs, verdicts).collect()}
    assert got == {"p": ("c", 3, 4, 2), "q": (None, None, None, 2)}
