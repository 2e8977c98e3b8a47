"""U2 -> A13-A16 through one state; U3 by states of any split."""

import random

import pandas as pd
from judgelake.operators import overview as OV
from judgelake.operators import results as RES
from judgelake.operators import scorers as SC
from judgelake.operators import validate as VAL
from judgelake.sources.files import RESULT_FIELDS
from pyspark.sql import functions as F


def reads_of(rng, n):
    out = []
    for _ in range(n):
        name = rng.choice(["n", "~n", "n~", "~~", "m", "x", "v1", "k\t"])
        lo, hi = rng.choice([("1", "5"), ("1", "6"), ("0", "9" * 40)]) if name != "m" else ("1", "5")
        if name == "x":
            out.append(OV.Read(name, rng.choice([0.5, 0.25, 1.0]), "0.25", "2.5", False))
        else:
            out.append(OV.Read(name, rng.randint(1, 6), lo, hi))
    return out


def test_reports_of_a_state_are_those_of_the_reads(spark):
    rng = random.Random(1)
    texts = [(k, f"text {k}", "tests" if k % 2 else None, f"g{k % 3}") for k in range(40)]
    made = {k: OV.Validation(k % 5 > 0, "no" if k % 5 == 0 else "", reads_of(rng, k % 7), ["big", "odd"][:k % 3]) for k, *_ in texts}
    seen = {}

    def fn(tid, text, testset, group):
        assert text == f"text {tid}" and group == f"g{tid % 3}"
        return made[tid]
    df = spark.createDataFrame(texts, "text_id long, text string, testset string, group string")
    events = OV.register_overview_validator(fn)(df)
    got = events.collect()
    for r in got:
        seen.setdefault(r.text_id, []).append(r)
    assert set(seen) == set(made) and all(r.ok == made[r.text_id].ok and r.message == made[r.text_id].message for r in got)
    assert len(got) == sum(max(1, len(v.reads) + len(v.features)) for v in made.values())
    declared = spark.createDataFrame([("big",), ("never",), ("never",)], "feature string")
    state = OV.overview(events, declared)
    parts = [OV.overview(events.where(F.col("text_id") % 3 == k), declared if k == 0 else None) for k in range(3)]
    assert sorted(map(tuple, OV.merge_overviews(*parts).collect())) == sorted(map(tuple, state.select(*parts[0].columns).collect()))

    # the reports over single reads
    flat = [(r.name, float(r.value), r.lower, r.upper, r.is_int) for v in made.values() for r in v.reads]
    reads = spark.createDataFrame(flat, "variable string, value double, lower string, upper string, is_int boolean")

    def rows(frame):
        return sorted(map(tuple, frame.collect()), key=str)
    names = {"n", "~~", "m", "x"}
    assert {r.variable for r in OV.variables(state).collect()} == {r.variable for r in VAL.variable_inventory(reads).collect()} == names
    assert rows(OV.constant_bounds(state)) == rows(VAL.constant_bounds_report(reads))
    hits = {r.variable: (r.min_hit, r.max_hit) for r in OV.bounds_hits(state).collect()}
    for name in names:
        own = [r for r in flat if VAL_bare(r[0]) == name]
        near = (lambda v, b, i: v == float(b) if i else abs(v - float(b)) < 1e-12)
        mark = [r[0] for r in own if len(r[0]) >= 2 and r[0] != "~~"]
        assert hits[name] == (any(near(r[1], r[2], r[4]) for r in own) or any(m[0] == "~" for m in mark),
                              any(near(r[1], r[3], r[4]) for r in own) or any(m[-1] == "~" for m in mark)), name
    assert {r.feature: (r.hit, r.error) for r in OV.features(state).collect()} == {
        "big": (True, None), "odd": (True, "feature not declared"), "never": (False, "feature declared twice")}
    lines = {r.line for r in OV.overview_log(state).collect()}
    assert {'feature "big": hit', 'feature "never":', 'variable "~~"', 'constant-bounds "m": 1 5'} <= lines and 'feature "odd": hit' not in lines


def VAL_bare(name):
    return name if len(name) < 2 or name == "~~" else name.removeprefix("~").removesuffix("~")


def test_empty_overview(spark):
    state = OV.overview(spark.createDataFrame([], OV.EVENTS))
    assert state.count() == 0 and OV.overview_log(state).count() == 0


FIELDS = ("submission_id long, testIndex int, testset string, `group` string, verdict string, points double, timeConsumed long, "
          "memoryConsumed long, input string, output string, answer string, exitCode int, checkerComment string")


def test_scores_do_not_depend_on_the_split(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), k, "t", rng.choice("ab"), rng.choice(["OK"] * 9 + ["FAILED"]), rng.choice([1.5, 2.0, None]),
             rng.randint(0, 2500), 0, "i", "o", "a", 0, "c") for k in range(600)]
    df = spark.createDataFrame(rows, FIELDS)
    largest = []

    class Watched(SC.GroupScorer):
        def update(self, state, results):
            assert list(results.columns) == RESULT_FIELDS and isinstance(results, pd.DataFrame)
            assert len(results) <= 60  # never a whole submission
            return super().update(state, results)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "60")
    try:
        for limit in (SC.MAX_STATES, 1):
            monkeypatch.setattr(SC, "MAX_STATES", limit)
            for parts in (1, 7):
                largest.append({r.submission_id: r.score for r in SC.score(df.repartition(parts), Watched(0.25)).collect()})
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for s in (1, 2, 3):
        own = [r for r in rows if r[0] == s]
        groups = {g: [r for r in own if r[3] == g] for g in {r[3] for r in own}}
        good = sum(sum(r[5] or 0.0 for r in g) for g in groups.values() if all(r[4] == "OK" for r in g))
        want[s] = round(good - 0.25 * -(-max(r[6] for r in own) // 1000), 3)
    assert all(got == want for got in largest)
    plain = {r.submission_id: r.group_points for r in RES.grouped_score(df).where("submission_id IS NOT NULL").collect()}
    assert {r.submission_id: r.score for r in SC.score(df, SC.GroupScorer()).collect()} == plain
    assert SC.score(df.limit(0), SC.GroupScorer()).count() == 0
