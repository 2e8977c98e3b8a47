"""User scorers over many submissions at once, and the fields a mergeable scorer asks for."""

import random
import sys

import pytest
from judgelake.operators import results as RES, scorers as SC
from judgelake.sources.files import RESULT_FIELDS
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TYPES = "submission_id long, testIndex int, testset string, `group` string, verdict string, points double, timeConsumed long, " \
        "memoryConsumed long, input string, output string, answer string, exitCode int, checkerComment string"


@pytest.fixture
def small_batches(spark):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def results(spark):
    rng = random.Random(4)
    rows = [(None if s == 40 else s, t, "tests", str(t % 3), rng.choice(["OK", "WRONG_ANSWER"]), rng.choice([None, 1.0, 2.5]),
             rng.randint(0, 5000), 0, "i", "o", "a", 0, "c") for s in range(41) for t in range(1, rng.choice([1, 3, 6, 30]) + 1)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, TYPES).repartition(3)


def one(frame):
    """Depends on the order of the tests and on where a submission ends."""
    return float(sum((i + 1) * t * (0 if p != p else p) for i, (t, p) in enumerate(zip(frame["testIndex"], frame["points"]))))


def many(frame):
    return frame.groupby("submission")[["testIndex", "points"]].apply(one)


def test_many_submissions_at_once_score_like_one_by_one(spark, small_batches):
    df = results(spark)
    want = {r.submission_id: r.score for r in RES.user_score(df, one).collect()}
    assert len(want) == 41
    assert {r.submission_id: r.score for r in RES.user_score(df, many=many).collect()} == want


def test_a_scorer_must_score_every_submission(spark):
    with pytest.raises(Exception, match="one number per submission"):
        RES.user_score(results(spark), many=lambda f: many(f).iloc[1:]).collect()


def test_states_get_the_fields_the_scorer_names(spark, small_batches):
    class All(SC.GroupScorer):
        fields = tuple(RESULT_FIELDS)

        def update(self, state, rows):
            assert list(rows.columns) == RESULT_FIELDS
            return super().update(state, rows)

    class Few(SC.GroupScorer):
        def update(self, state, rows):
            assert tuple(rows.columns) == self.fields
            return super().update(state, rows)
    df = results(spark)
    want = {r.submission_id: r.score for r in SC.score(df, All(0.5)).collect()}
    assert len(want) == 40 and {r.submission_id: r.score for r in SC.score(df, Few(0.5)).collect()} == want


def test_states_of_many_submissions_at_once_are_those_one_by_one(spark, small_batches, monkeypatch):
    class Slow(SC.GroupScorer):
        update_many = None

    class Once(SC.GroupScorer):
        def update(self, state, rows):
            raise AssertionError("a call per submission")

        def update_many(self, results):
            assert list(results.columns) == [*self.fields, "submission"]
            return super().update_many(results)

    class Own(SC.GroupScorer):
        def update(self, state, rows):
            return {}, 0  # a scorer's own update is not passed over

    class Short(SC.GroupScorer):
        def update_many(self, results):
            return super().update_many(results)[1:]
    df = results(spark)
    want = {r.submission_id: r.score for r in SC.score(df, Slow(0.25)).collect()}
    assert len(want) == 40
    for rows in (1, 20, SC.FRAME_ROWS):  # submissions that go on in the next frame, too
        monkeypatch.setattr(SC._larger, "__defaults__", (rows,))
        assert {r.submission_id: r.score for r in SC.score(df, Once(0.25)).collect()} == want
    assert {r.score for r in SC.score(df, Own()).collect()} == {0.0}
    with pytest.raises(Exception, match="one state per submission"):
        SC.score(df, Short()).collect()
    frame = df.toPandas().dropna(subset="submission_id").sort_values("submission_id", kind="stable")
    frame["submission"] = frame.groupby("submission_id").ngroup()
    frame.loc[frame.index[:3], "group"] = None
    one_by_one = [SC.GroupScorer().update(SC.GroupScorer().init(), f) for _, f in frame.groupby("submission")]
    assert SC.GroupScorer().update_many(frame) == one_by_one


def test_results_of_some_fields_are_those_of_all_and_carry_no_message(spark):
    from judgelake.plans import queries
    whole = queries.test_results(spark, "/root/testdata/sf0.001")
    for fields in (("group", "verdict", "points", "timeConsumed"), ("testIndex", "output"), ("points",)):
        some = queries.test_results(spark, "/root/testdata/sf0.001", fields)
        assert some.columns == ["submission_id", *fields]
        assert sorted(map(repr, some.collect())) == sorted(map(repr, whole.select(some.columns).collect()))
    for q in (queries.q_scorer_udaf, queries.q_scorer_states, queries.q_grouped_score):
        assert "message" not in q(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
