"""T1-T3 over constraint tables: intervals of unequal length, messages, both join forms."""

import random

from judgelake.functions.numeric import general_text
from judgelake.operators import constraints as CON
from pyspark.sql import functions as F

CONS = ("problem string, first long, last long, kind string, lo string, hi string, name string, index_base long, "
        "min_digits int, max_digits int")


def run(spark, texts, cons):
    t = spark.createDataFrame(texts, "text_id long, problem string, text string")
    c = spark.createDataFrame(cons, CONS)
    rows = CON.validate_constraints(t, c, by=["problem"]).collect()
    return sorted([(r.text_id, r.position, r.token, r.name, r["index"], r.outcome, r.message) for r in rows], key=str)


def test_ranges_of_unequal_length_over_one_text(spark):
    cons = [("p", 1, 1, "int", "1", "100000", "n", None, None, None),
            ("p", 2, 6, "int", "1", "10", "a", 1, None, None),
            ("p", 4, 5, "int", "-5", "5", "", 0, None, None),
            ("p", 5, None, "int", "0", "20000000", "", None, None, None),
            ("q", 1, 1, "int", "0", "0", "only q", None, None, None)]
    got = run(spark, [(1, "p", " 7 3 11 6 2 99999999 \n"), (2, "p", "01 2 x"), (3, "p", None)], cons)
    assert got == sorted([
        (1, 3, "11", "a", 2, "wa", "Integer element a[2] equals to 11, violates the range [1, 10]"),
        (1, 4, "6", "", 0, "wa", "Integer element [index=0] equals to 6, violates the range [-5, 5]"),
        (1, 6, "99999999", "a", 5, "wa", "Integer element a[5] equals to 99999999, violates the range [1, 10]"),
        (1, 6, "99999999", "", None, "wa", "Integer 99999999 violates the range [0, 2*10^7]"),
        (2, 1, "01", "n", None, "pe", 'Expected integer, but "01" found'),
        (2, 3, "x", "a", 2, "pe", 'Expected integer, but "x" found'),
        (2, 4, None, "a", 3, "unexpected_eof", "Unexpected end of file - int64 expected"),
        (2, 4, None, "", 0, "unexpected_eof", "Unexpected end of file - int64 expected"),
        (3, 1, None, "n", None, "unexpected_eof", "Unexpected end of file - int64 expected"),
    ], key=str)


def test_kinds_and_messages(spark):
    long = "7" * 80
    cases = [
        (("uint", "18446744073709551616"), ("pe", 'Expected unsigned integer, but "18446744073709551616" found')),
        (("uint", "18446744073709551615", "0", "18446744073709551615"), None),
        (("uint", "12", "0", "10000000", "k"), None),
        (("uint", "123456789", "20000000", "10000000", "k"),
         ("wa", "Unsigned integer parameter [name=k] equals to 123456789, violates the range [2*10^7, 10^7]")),
        (("int", long), ("pe", f'Expected integer, but "{long[:30]}...{long[-31:]}" found')),
        (("int", "-0"), ("pe", 'Expected integer, but "-0" found')),
        (("int", "1\x002"), ("pe", 'Expected integer, but "1~2" found (it contains \\0)')),
        (("double", "nan"), ("pe", 'Expected double, but "nan" found')),
        (("double", "1e7"), ("wa", "Double 1e+07 violates the range [0, 9]")),
        (("double", "-0.5", "0", "1e9", "x"), ("wa", "Double parameter [name=x] equals to -0.5, violates the range [0, 1e+09]")),
        (("strict", "1.5", "0", "9", "", 2, 3),
         ("pe", 'Expected strict double with number of digits after point in range [2,3], but "1.5" found')),
        (("strict", "00.5", "0", "9", "", 2, 3),
         ("pe", 'Expected strict double with number of digits after point in range [2,3], but "00.5" found')),
        (("strict", "00.55", "0", "9", "", 2, 3), ("pe", 'Expected strict double, but "00.55" found')),
        (("strict", "1.", "0", "9", "", 0, 3), ("pe", 'Expected strict double, but "1." found')),
        (("strict", "-", "0", "9", "", 0, 3), ("pe", 'Expected strict double, but "-" found')),
        (("strict", "-.5", "0", "9", "", 0, 3), ("pe", 'Expected strict double, but "-.5" found')),
        (("strict", "-0.00", "-1", "9", "", 0, 3), ("pe", 'Redundant minus in "-0.00" found')),
        (("strict", "-0.25", "0.125", "9", "", 0, 3), ("wa", "Strict double -0.25 violates the range [0.125, 9]")),
        (("strict", "5", "0", "9", "", 0, 3), None),
    ]
    texts, cons = [], []
    for k, (args, _) in enumerate(cases):
        kind, token, lo, hi, name, least, most = (*args, *("0", "9", "", None, None)[len(args) - 2:])
        texts.append((k, str(k), token))
        cons.append((str(k), 1, 1, kind, lo, hi, name, None, least, most))
    got = {r[0]: r[5:] for r in run(spark, texts, cons)}
    for k, (args, want) in enumerate(cases):
        assert got.get(k) == want, args


def test_levels_and_salts_against_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    texts = [(i, rng.choice("pq"), " ".join(str(rng.randint(0, 99)) for _ in range(rng.randint(0, 300)))) for i in range(40)]
    cons = []
    for k in range(60):
        a = rng.randint(1, 250)
        b = rng.choice([a, a + rng.randint(0, 9), a + rng.randint(0, 200), None])
        cons.append((rng.choice("pq"), a, b, "int", str(rng.randint(0, 5)), str(rng.randint(90, 99)), f"c{k}", None, None, None))
    want = []
    for i, p, text in texts:
        toks = [*text.split(), None]
        for q, a, b, _, lo, hi, name, *_ in cons:
            for pos, tok in enumerate(toks, 1):
                if p == q and a <= pos <= (b or 10 ** 9) and (b or tok is not None):
                    if tok is None or not int(lo) <= int(tok) <= int(hi):
                        want.append((i, pos, name))
    for limit in (CON.MAX_BROADCAST_ROWS, 0):
        monkeypatch.setattr(CON, "MAX_BROADCAST_ROWS", limit)
        assert sorted((r[0], r[1], r[3]) for r in run(spark, texts, cons)) == sorted(want)
    assert run(spark, texts, []) == [] and run(spark, [], cons) == []


def test_first_violation_is_the_readers(spark):
    v = spark.createDataFrame([(1, 5, "int", "b", "m"), (1, 4, "int", "z", "n"), (1, 4, "int", "a", "o"), (2, 9, "int", "", "p")],
                              "text_id long, position long, kind string, name string, message string")
    got = {r.text_id: (r.position, r.name, r.message) for r in CON.first_violations(v, ["text_id"]).collect()}
    assert got == {1: (4, "a", "o"), 2: (9, "", "p")}


def test_general_text(spark):
    rng = random.Random(1)
    values = [0.0, -0.0, 1.0, 200000.5, 200001.5, 999999.5, 12345.25, -76203.65, 2286825.0, 1e-5, 1e-4, 1e300, float("inf"), -float("inf"),
              0.1, 1 / 3, 1e6, 100000.0, 1.25e-7] + [round(rng.uniform(-1e5, 1e5), 2) for _ in range(500)] + [
              rng.uniform(-1, 1) * 10 ** rng.randint(-12, 12) for _ in range(300)]
    got = spark.createDataFrame([(v,) for v in values], "x double").select("x", general_text(F.col("x")).alias("t")).collect()
    assert [(r.x, r.t) for r in got] == [(v, f"{v:g}") for v in values]
