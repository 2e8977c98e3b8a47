"""Edge fixtures (FIXTURES.md) for the per-row rules and small operators."""

import math
import random

from pyspark.sql import functions as F

from judgelake import constants as K
from judgelake.functions import numeric as NUM
from judgelake.functions import text as TXT
from judgelake.operators import rollup, validate, verdict
from judgelake.sources import files as FILES


def _py_normal(s):
    lines = s.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    lines = [l.rstrip() for l in lines]
    while lines and not lines[-1]:
        lines.pop()
    return lines


def test_v2_output_compare_fixtures(spark):
    cases = [("a \r\n", "a", True), ("a\rb", "a\nb", True), ("a\n\n\n", "a", True),
             (" a", "a", False), ("a\n\nb", "a\nb", False), ("a\x1c", "a", True), ("a\x85", "a", True),
             ("a　", "a", True), ("", "", True), ("x\n \n", "x", True)]
    df = spark.createDataFrame([(a, b) for a, b, _ in cases], "a string, b string")
    got = [r[0] for r in df.select(TXT.output_equal(F.col("a"), F.col("b"))).collect()]
    assert got == [c[2] for c in cases]


def test_v2_matches_python_model(spark):
    rng = random.Random(7)
    alphabet = ["a", "b", " ", "\t", "\n", "\r", "\x1c", "\x85", "　", "\xa0", "\x0b"]
    pairs = []
    for _ in range(300):
        a = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 8)))
        b = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 8)))
        pairs.append((a, b))
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [r[0] for r in df.select(TXT.output_equal(F.col("a"), F.col("b"))).collect()]
    assert got == [_py_normal(a) == _py_normal(b) for a, b in pairs]


def test_v1_rule_order(spark):
    rows = [  # elapsed, limit, exit, bytes, killed
        (1, 200, 100, 1, 0, False),        # exit 1 and late: RE wins
        (2, 100, 100, 0, 0, False),        # elapsed = limit: AC
        (3, 101, 100, 0, 0, False),        # limit + 1: TLE
        (4, 900, 100, 0, 0, True),         # killed: time = limit
        (5, 10, 100, 0, 10485760, False),  # at the cap: AC
        (6, 10, 100, 0, 10485761, False),  # one past: RE
    ]
    df = spark.createDataFrame(rows, "submission_id long, elapsed_ms long, time_limit int, exit_code int, "
                                     "output_bytes long, killed boolean").withColumn("output_ok", F.lit(True))
    out = {r.submission_id: (r.status, r.time_used) for r in verdict.case_verdict(df).collect()}
    assert out[1] == (K.RUNTIME_ERROR, 200)
    assert out[2] == (K.ACCEPTED, 100)
    assert out[3] == (K.TIME_LIMIT, 101)
    assert out[4] == (K.TIME_LIMIT, 100)
    assert out[5][0] == K.ACCEPTED and out[6][0] == K.RUNTIME_ERROR


def test_v3_checker_messages(spark):
    rows = [(0, "", "", 1.0), (1, "", "from stdout", 1.0), (2, "e" * 501, "x", 1.0), (7, "pts", "", 11.0)]
    df = spark.createDataFrame(rows, "checker_exit int, checker_stderr string, checker_stdout string, "
                                     "checker_elapsed_s double").withColumn("stem", F.lit("3"))
    out = verdict.checker_outcome(df).collect()
    assert out[0].checker_status == K.ACCEPTED
    assert out[1].checker_message == "from stdout"
    assert len(out[2].checker_message) == 500
    assert out[3].checker_status == K.SYSTEM_ERROR and out[3].checker_message == "Checker timeout on test 3"


def test_v10_retry_rules(spark):
    T, A_, S = K.TIME_LIMIT, K.ACCEPTED, K.SYSTEM_ERROR
    seqs = {1: [T, T, A_], 2: [T, T, T, T, A_], 3: [T, S], 4: [S, S, S], 5: [A_, T], 6: [K.WRONG_ANSWER, A_]}
    rows = [(k, 1, i + 1, s) for k, ss in seqs.items() for i, s in enumerate(ss)]
    df = spark.createDataFrame(rows, "submission_id long, case_no int, attempt int, status string")
    out = {r.submission_id: (r.status, r.attempt) for r in verdict.retry_resolve(df).collect()}
    assert out[1] == (A_, 3)
    assert out[2] == (T, 3)
    assert out[3] == (S, 2)
    assert out[4] == (S, 3)
    assert out[5] == (A_, 1)
    assert out[6] == (K.WRONG_ANSWER, 1)


def test_a1_submission_result(spark):
    A_, W = K.ACCEPTED, K.WRONG_ANSWER
    rows = [  # sub, case, has_expected, status, time
        (1, 1, True, W, 5), (1, 2, True, A_, 5),                       # fail on first
        (2, 1, True, A_, 5), (2, 2, True, A_, 9), (2, 3, True, W, 7),   # fail on last
        (3, 1, True, A_, 5), (3, 2, False, None, 0), (3, 3, True, A_, 8),  # missing .out, still 100
        (4, 2, True, A_, 1), (4, 10, True, W, 2),                       # stems 2 and 10
        (5, 1, True, A_, 1), (5, 2, True, A_, 1), (5, 3, True, W, 1),   # 2 of 3 passed -> 66
    ]
    df = spark.createDataFrame(rows, "submission_id long, case_no int, has_expected boolean, status string, "
                                     "time_used long").withColumn("message", F.lit(""))
    out = {r.submission_id: r for r in rollup.submission_result(df).collect()}
    assert (out[1].status, out[1].failed_case, out[1].score) == (W, 1, 0)
    assert (out[2].status, out[2].failed_case, out[2].score) == (W, 3, 66)
    assert (out[3].status, out[3].score, out[3].message, out[3].time_used) == (A_, 100, "Passed 2/3 test cases", 8)
    assert out[4].failed_case == 2
    assert out[5].score == 66


def test_a4_consensus(spark):
    CE, AC, WA = K.COMPILE_ERROR, K.ACCEPTED, K.WRONG_ANSWER
    v = K.CPP_VERSIONS
    seqs = {1: [CE, CE, CE, CE], 2: [CE, AC, AC, AC], 3: [AC, WA, AC, AC], 4: [WA, AC, AC, AC]}
    rows = [(k, v[i], s, s == AC, None) for k, ss in seqs.items() for i, s in enumerate(ss)]
    df = spark.createDataFrame(rows, "code_id long, version string, verdict string, passed boolean, failed_test int")
    out = {r.code_id: r for r in rollup.version_consensus(df).collect()}
    assert out[1].all_passed and out[1].untestable
    assert out[2].all_passed and not out[2].untestable
    assert not out[3].all_passed and out[3].stopped_at == "c++17" and out[3].failed_versions == ["c++17"]
    assert out[4].stopped_at == "c++14"


def test_t1_int_tokens(spark):
    toks = ["0", "00", "-0", "+1", "007", str(K.INT64_MIN), str(K.INT64_MAX), "9223372036854775808",
            "1" * 21, " 5", ""]
    df = spark.createDataFrame([(t,) for t in toks], "token string")
    bad = {r.token: r.reason for r in validate.validate_tokens(df, "int", K.INT64_MIN, K.INT64_MAX).collect()}
    assert "0" not in bad and str(K.INT64_MIN) not in bad and str(K.INT64_MAX) not in bad
    for t in ["00", "-0", "+1", "007", "9223372036854775808", "1" * 21, " 5", ""]:
        assert bad[t] == "expected int64", t


def test_t3_doubles(spark):
    loose = ["1e5", ".5", "1.", "nan", "1d", "--1", "1e"]
    df = spark.createDataFrame([(t,) for t in loose], "token string")
    bad = {r.token for r in validate.validate_tokens(df, "double", -1e18, 1e18).collect()}
    assert bad == {"nan", "1d", "--1", "1e"}
    strict = ["-0.00", "01.5", "1.", "1.50", "1.5"]
    df = spark.createDataFrame([(t,) for t in strict], "token string")
    bad = {r.token: r.reason for r in validate.validate_tokens(df, "double", -10.0, 10.0, strict=True,
                                                                 min_digits=2, max_digits=2).collect()}
    assert bad["-0.00"] == "redundant minus" and bad["01.5"] == "expected strict double"
    assert bad["1."] == "expected strict double" and "1.50" not in bad and "1.5" in bad


def test_t4_patterns(spark):
    rows = [("1",), ("mike",), ("john",), ("bob",), ("-123",), ("0",), ("id-aa",), ("id-bb",), ("abc",)]
    df = spark.createDataFrame(rows, "token string")
    pats = {"p1": "[0-9]?1", "p2": "mike|john", "p3": "-?[1-9][0-9]{0,3}", "p4": "id-([ac]|b{2})", "p5": "[^0-9]*"}
    got = {(r.token, r.pattern_id): r.matched for r in validate.validate_pattern(df, pats).collect()}
    assert got[("1", "p1")] is False          # greedy without backtracking
    assert got[("mike", "p2")] and got[("john", "p2")] and not got[("bob", "p2")]
    assert got[("-123", "p3")] and not got[("0", "p3")]
    assert got[("id-bb", "p4")] and not got[("id-aa", "p4")]
    assert got[("abc", "p5")] and not got[("1", "p5")]


def test_p7_points(spark):
    vals = [-1e-9, -1.0, 1e6 + 1e-9, 1e6 + 1, float("nan"), float("inf"), 1.50]
    df = spark.createDataFrame([(v,) for v in vals], "p double")
    out = [r.x for r in df.select(NUM.points_normalise(F.col("p")).alias("x")).collect()]
    assert out[0].text == "0.0" and not out[0].failed
    assert out[1].failed and out[3].failed and out[4].failed and out[5].failed
    assert out[2].text == "1000000.0"
    assert out[6].text == "1.5"


def test_v6_numeric(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(nan, nan, True), (inf, inf, True), (inf, -inf, False), (0.0, 1e-9, True), (1e18, 1e18 + 1e9, True),
            (-5.0, -5.000001, True), (-5.0, -5.1, False), (1.0, nan, False)]
    df = spark.createDataFrame([(a, b) for a, b, _ in rows], "e double, a double")
    got = [r[0] for r in df.select(NUM.numeric_equal(F.col("e"), F.col("a"), 1e-6)).collect()]
    assert got == [r[2] for r in rows]


def test_src5_roundtrip(spark):
    rows = [(1, "g\\;x", "g", "OK", 1.5, 10, 0, "a\\n", "a\nb", "x;y", 0, "c\\"),
            (2, "", "", "WRONG_ANSWER", None, 0, 0, "", "", "", 1, "")]
    df = spark.createDataFrame(rows, ", ".join(f"{n} {t}" for n, t in zip(
        FILES.RESULT_FIELDS, ["int", "string", "string", "string", "double", "bigint", "bigint", "string",
                              "string", "string", "int", "string"])))
    lines = FILES.export_test_results(df)
    good, bad = FILES.parse_test_result_lines(lines)
    assert sorted(map(tuple, good.collect())) == sorted(map(tuple, df.collect()))
    extra = spark.createDataFrame([("1;2;3",), ("",)], "value string")
    g2, b2 = FILES.parse_test_result_lines(extra)
    assert g2.count() == 0 and b2.count() == 1


def test_hack_url_and_eligibility(spark):
    df = spark.createDataFrame([("1_A",), ("1_A_x",), ("_",)], "id string")
    urls = [r[0] for r in df.select(TXT.hack_url(F.col("id"))).collect()]
    assert urls[0].endswith("/contest/1/hacks?verdictName=CHALLENGE_SUCCESSFUL&chosenProblemIndex=A")
    assert "contest/1/" in urls[1] and urls[1].endswith("=A")
    from judgelake.operators.curate import eligible_problems
    rows = [("a_1", [("i", "o")], [("cpp", "x")], [("cpp", "y")], None),
            ("b_1", [("i", "o")], [("cpp", "x")], [("cpp", "y")], float("nan")),
            ("c_1", [("i", "o")], [("cpp", "x")], [("cpp", "y")], 1.0),
            ("d_1", [("i", "o")], [("cpp", "x")], [("cpp", "y")], 0.999),
            ("e1", [("i", "o")], [("cpp", "x")], [("cpp", "y")], 0.5),
            ("f_1", [], [("cpp", "x")], [("cpp", "y")], 0.5),
            ("g_1", [("i", "o")], None, [("cpp", "y")], 0.5)]
    schema = ("id string, test_cases array<struct<input:string,output:string>>, "
              "incorrect_submissions array<struct<language:string,code:string>>, "
              "correct_submissions array<struct<language:string,code:string>>, true_negative_rate double")
    ids = {r.id for r in eligible_problems(spark.createDataFrame(rows, schema)).collect()}
    assert ids == {"b_1", "d_1"}


def test_random_partition_contract(spark):
    from judgelake.operators.generate import random_partition
    g = spark.createDataFrame([(1, 5, 20, 2), (2, 3, 3, 1), (3, 4, 3, 1)], "group_id long, size long, total long, min_part long")
    parts = random_partition(g, 7).collect()
    by = {}
    for r in parts:
        by.setdefault(r.group_id, []).append(r.part)
    assert sum(by[1]) == 20 and len(by[1]) == 5 and min(by[1]) >= 2
    assert by[2] == [1, 1, 1]
    assert 3 not in by


def test_dense_ordinal_and_shuffle(spark):
    from judgelake.operators.generate import shuffle_rows
    df = spark.range(1000).withColumnRenamed("id", "k")
    perm = sorted(r.perm for r in shuffle_rows(df, "k", 42).collect())
    assert perm == list(range(1000))
