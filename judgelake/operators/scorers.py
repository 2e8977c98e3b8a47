"""User scorers as init / update / merge / finish. Tasks fold the rows
they hold into one small state per submission; only states are shuffled, over salts
first, so a submission of any size never meets in one call."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import Any, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from judgelake.sources.files import RESULT_FIELDS

#: States a task holds before it gives them out.
MAX_STATES = 50_000
SALTS = 16
#: Rows that a call of ``update_many`` gets at least, if the task has as many.
FRAME_ROWS = 20_000


class Scorer(Protocol):
    """A score over all results of a submission, in any order and split. ``fields`` may name
    those of the 12 result fields that ``update`` reads; without it, it gets all. A scorer may also have
    ``update_many(results)``: the states of many submissions from one frame of their fields with a column
    ``submission`` (whole numbers without gaps, rows in their order), as a list in the order of these numbers,
    each as ``update`` makes it of the submission's rows and ``init``. A call then serves thousands of submissions."""

    def init(self) -> Any: ...

    def update(self, state: Any, results: pd.DataFrame) -> Any:
        """The state with some results of the submission: a frame of the 12 result fields."""

    def merge(self, a: Any, b: Any) -> Any: ...

    def finish(self, state: Any) -> float: ...


def _at_once(scorer: Scorer):
    """The scorer's ``update_many``; None if it has none or a class further down has its own ``update`` only."""
    own = next((c for c in type(scorer).__mro__ if "update" in vars(c) or "update_many" in vars(c)), None)
    return scorer.update_many if own is not None and "update_many" in vars(own) else None


def _larger(batches: Iterator[pd.DataFrame], rows: int = FRAME_ROWS) -> Iterator[pd.DataFrame]:
    """The rows of ``batches`` in frames of ``rows`` or more, however few the session's batches hold; none is empty."""
    held, n = [], 0
    for b in batches:
        if len(b):
            held.append(b)
            n += len(b)
        if n >= rows:
            yield pd.concat(held, ignore_index=True)
            held, n = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


def score(results: DataFrame, scorer: Scorer, key: str = "submission_id") -> DataFrame:
    """(key, score rounded to three places): ``results`` has the key and the 12 result fields."""
    typed = f"{key} {dict(results.dtypes)[key]}"
    fields = list(getattr(scorer, "fields", RESULT_FIELDS))
    at_once = _at_once(scorer)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        states: dict = {}

        def out():
            rows = pd.DataFrame({key: list(states), "state": [pickle.dumps(s) for s in states.values()]})
            states.clear()
            return rows
        for b in _larger(batches):
            # runs of equal keys as slices: one frame per submission, cut without a copy of the batch's columns
            b = b.sort_values(key, kind="stable")
            own, held = b[fields], b[key].to_numpy()
            ends = np.flatnonzero(np.append(held[1:] != held[:-1], True)) + 1
            starts = np.append(0, ends[:-1])
            if at_once is not None:
                numbers = np.repeat(np.arange(len(ends)), ends - starts)
                made = at_once(own.assign(submission=numbers).reset_index(drop=True))
                if len(made) != len(ends):
                    raise ValueError("the scorer must return one state per submission")
                for k, s in zip(held[starts], made):
                    states[k] = scorer.merge(states[k], s) if k in states else s
            else:
                for start, end in zip(starts, ends):
                    k = held[start]
                    states[k] = scorer.update(states[k] if k in states else scorer.init(), own.iloc[start:end])
            if len(states) >= MAX_STATES:
                yield out()
        if states:
            yield out()

    def in_turn(batches: Iterator[pd.DataFrame], cols: list[str], give, names: list[str]) -> Iterator[pd.DataFrame]:
        """Merge neighbouring rows of equal ``cols``; one state is held at a time, as bytes until another meets it."""
        held, data, state, out = None, None, None, []
        for b in batches:
            for *k, z in zip(*(b[c].tolist() for c in cols), b["state"]):
                if k == held:
                    state, data = scorer.merge(state if data is None else pickle.loads(data), pickle.loads(z)), None
                    continue
                if held is not None:
                    out.append((held[0], give(data, state)))
                held, data, state = k, z, None
            if out:
                yield pd.DataFrame(out, columns=names)
                out = []
        if held is not None:
            yield pd.DataFrame([(held[0], give(data, state))], columns=names)

    def as_bytes(data, state) -> bytes:
        return pickle.dumps(state) if data is None else data

    def finished(data, state) -> float:
        return float(scorer.finish(state if data is None else pickle.loads(data)))

    states = results.where(F.col(key).isNotNull()).select(key, *fields).mapInPandas(partial, f"{typed}, state binary")
    salted = states.withColumn("_salt", F.spark_partition_id() % SALTS).repartition(key, "_salt").sortWithinPartitions(key, "_salt")
    few = salted.mapInPandas(lambda bs: in_turn(bs, [key, "_salt"], as_bytes, [key, "state"]), f"{typed}, state binary")
    scores = few.repartition(key).sortWithinPartitions(key).mapInPandas(
        lambda bs: in_turn(bs, [key], finished, [key, "score"]), f"{typed}, score double")
    return scores.withColumn("score", F.round("score", 3))


class GroupScorer:
    """Points of the groups all whose tests are OK, less ``penalty`` for each started second of the slowest test."""

    fields = ("group", "points", "verdict", "timeConsumed")

    def __init__(self, penalty: float = 0.0):
        self.penalty = penalty

    def init(self):
        return {}, 0

    def update(self, state, results):
        groups, slowest = state
        for g, points, verdict in zip(results["group"], results["points"], results["verdict"]):
            total, ok = groups.get(g, (0.0, True))
            groups[g] = (total + (0.0 if pd.isna(points) else points), ok and verdict == "OK")
        return groups, max(slowest, int(results["timeConsumed"].max()))

    def update_many(self, results):
        sub = results["submission"].to_numpy()
        group, names = pd.factorize(results["group"], use_na_sentinel=False)
        n, key = int(sub[-1]) + 1, sub * len(names) + group
        size = n * len(names)
        total = np.bincount(key, results["points"].fillna(0.0).to_numpy(float), size)
        wrong = np.bincount(key, (results["verdict"] != "OK").to_numpy(), size)
        names = [None if pd.isna(g) else g for g in names]
        groups = [{} for _ in range(n)]
        for k in np.unique(key).tolist():
            s, g = divmod(k, len(names))
            groups[s][names[g]] = (float(total[k]), wrong[k] == 0)
        slowest = results["timeConsumed"].groupby(sub).max()
        return [(g, max(0, int(t))) for g, t in zip(groups, slowest)]

    def merge(self, a, b):
        groups = dict(a[0])
        for g, (total, ok) in b[0].items():
            t, o = groups.get(g, (0.0, True))
            groups[g] = (t + total, o and ok)
        return groups, max(a[1], b[1])

    def finish(self, state):
        groups, slowest = state
        return sum(t for t, ok in groups.values() if ok) - self.penalty * -(-slowest // 1000)
