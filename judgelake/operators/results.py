"""Scorer surface (A17, U3): all test results of a submission -> one
number. Shipped scorers are built-in aggregates (partial-aggregated);
a user scorer is a grouped-aggregate pandas UDF (Arrow batches)."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: The fields of a result that a user scorer gets.
SCORER_FIELDS = ("testIndex", "group", "verdict", "points")


def grouped_score(results: DataFrame, keys: Sequence[str] = ("submission_id",)) -> DataFrame:
    """A17 shipped scorers, in one pass:
    * ``sum_points``: sum of points (absent points count 0);
    * ``group_points``: per group the sum of its points if every test of
      the group is OK, else 0 (all-or-nothing), summed over groups;
    * ``ok_fraction``: OK tests / tests.
    Scores are rounded to 3 places (the scorer prints ``%.3f``)."""
    keys = list(keys)
    pts = F.coalesce(F.col("points"), F.lit(0.0))
    per_group = results.groupBy(*keys, "group").agg(
        F.sum(pts).alias("_gp"), F.bool_and(F.col("verdict") == "OK").alias("_all"),
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col("verdict") == "OK").alias("_ok"))
    return per_group.groupBy(*keys).agg(
        F.round(F.sum("_gp"), 3).alias("sum_points"),
        F.round(F.sum(F.when(F.col("_all"), F.col("_gp")).otherwise(F.lit(0.0))), 3).alias("group_points"),
        F.round(F.sum("_ok") / F.sum("_n"), 3).alias("ok_fraction"))


def register_scorer(fn: Callable[[pd.DataFrame], float]):
    """Wrap a user scorer (pandas frame of one submission's results ->
    float) as a grouped-aggregate pandas UDF over (testIndex, group,
    verdict, points)."""
    @F.pandas_udf(T.DoubleType())
    def scorer(test_index: pd.Series, group: pd.Series, verdict: pd.Series, points: pd.Series) -> float:
        frame = pd.DataFrame({"testIndex": test_index, "group": group, "verdict": verdict, "points": points})
        return float(fn(frame.sort_values("testIndex")))
    return scorer


def user_score(results: DataFrame, fn: Callable[[pd.DataFrame], float] | None = None,
               keys: Sequence[str] = ("submission_id",), many: Callable[[pd.DataFrame], pd.Series] | None = None) -> DataFrame:
    """``fn`` scores the frame of one submission's results, in the order of testIndex. ``many`` scores a
    frame of whole submissions instead, by its column ``submission`` (whole numbers without gaps, rows in the
    order of submission and testIndex), and returns one number per submission, in their order: a call then
    serves thousands of submissions, where ``fn`` costs a call and a frame each."""
    if many is not None:
        return _score_many(results, many, list(keys))
    udf = register_scorer(fn)
    return results.groupBy(*keys).agg(
        F.round(udf("testIndex", "group", "verdict", "points"), 3).alias("score"))


def _score_many(results: DataFrame, fn: Callable[[pd.DataFrame], pd.Series], keys: list[str]) -> DataFrame:
    """Rows sorted by submission in a task; a batch is scored up to its last submission, which may go on in the next one."""
    fields = list(SCORER_FIELDS)

    def scores(frame: pd.DataFrame) -> pd.DataFrame:
        k = frame[keys]
        starts = ~(k.eq(k.shift()) | (k.isna() & k.shift().isna())).all(axis=1).to_numpy()
        starts[:1] = True
        out = fn(frame[fields].assign(submission=np.cumsum(starts) - 1).reset_index(drop=True))
        first = frame.loc[starts, keys].reset_index(drop=True)
        if len(out) != len(first):
            raise ValueError("the scorer must return one number per submission")
        return first.assign(score=np.asarray(out, float))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for b in batches:
            if not len(b):
                continue
            last = (b[keys].eq(b[keys].iloc[-1]) | (b[keys].isna() & b[keys].iloc[-1].isna())).all(axis=1).to_numpy()
            if not last.all():
                cut = int(np.flatnonzero(~last)[-1]) + 1
                yield scores(pd.concat([*held, b.iloc[:cut]], ignore_index=True))
                held, b = [], b.iloc[cut:]
            elif held and not _same_key(held[-1], b, keys):
                yield scores(pd.concat(held, ignore_index=True))
                held = []
            held.append(b)
        if held:
            yield scores(pd.concat(held, ignore_index=True))

    types = dict(results.dtypes)
    rows = results.select(*keys, *fields).repartition(*keys).sortWithinPartitions(*keys, "testIndex")
    out = rows.mapInPandas(run, ", ".join(f"`{k}` {types[k]}" for k in keys) + ", score double")
    return out.withColumn("score", F.round("score", 3))


def _same_key(a: pd.DataFrame, b: pd.DataFrame, keys: list[str]) -> bool:
    return all(x == y or (pd.isna(x) and pd.isna(y)) for x, y in zip(a[keys].iloc[-1], b[keys].iloc[0]))
