"""UDF surface (U1, U2, U4): user checkers and validators run as Arrow
batches (pandas UDF / mapInPandas), and the evaluator hook that lets the
curation jobs read verdicts from a stored run log."""

from __future__ import annotations

import re
from typing import Callable, Iterator, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from judgelake.session import written
from judgelake.streaming import deltas

CHECK_RESULT = T.StructType([T.StructField("outcome", T.StringType()),
                             T.StructField("message", T.StringType()),
                             T.StructField("points", T.DoubleType())])

_WS = re.compile(r"[ \t\n\r]+")


def _tokens(s: str) -> list[str]:
    s = s.strip(" \t\n\r")
    return _WS.split(s) if s else []


def register_checker(name: str, fn: Callable[..., tuple[str, str, float | None]], context: bool = False):
    """A checker (input, output, answer) -> (outcome, message, points) as a vectorised pandas UDF returning a
    struct. With ``context`` it also takes the test's testset and group. The UDF carries ``name``."""
    def frame(rows) -> pd.DataFrame:
        return pd.DataFrame([fn(*r) for r in rows], columns=["outcome", "message", "points"])

    def plain(inp: pd.Series, out: pd.Series, ans: pd.Series) -> pd.DataFrame:
        return frame(zip(inp, out, ans))

    def placed(inp: pd.Series, out: pd.Series, ans: pd.Series, testset: pd.Series, group: pd.Series) -> pd.DataFrame:
        return frame(zip(inp, out, ans, testset, group))
    chosen = placed if context else plain
    chosen.__name__ = name
    return F.pandas_udf(chosen, CHECK_RESULT)


def token_checker(inp: str, out: str, ans: str):
    """A shipped checker: token-by-token comparison."""
    e, f = _tokens(ans or ""), _tokens(out or "")
    for i, (x, y) in enumerate(zip(e, f), 1):
        if x != y:
            return "wa", f"{i} token differs - expected '{x}', found '{y}'", None
    if len(e) != len(f):
        return "wa", f"answer has {len(e)} tokens, output has {len(f)}", None
    return "ok", f"{len(e)} tokens", None


VALIDATOR_OUT = T.StructType([T.StructField("text_id", T.LongType()), T.StructField("ok", T.BooleanType()),
                              T.StructField("message", T.StringType()), T.StructField("variable", T.StringType()),
                              T.StructField("value", T.DoubleType())])


def register_validator(fn: Callable[[int, str], tuple[bool, str, list[tuple[str, float]]]]):
    """A validator (text id, text) -> (ok, message, reads) as a
    mapInPandas UDTF: one row per variable read (or one row when none),
    feeding the bounds / inventory reports."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for tid, text in zip(b["text_id"], b["text"]):
                ok, msg, reads = fn(int(tid), text)
                if not reads:
                    rows.append((int(tid), ok, msg, None, None))
                for var, val in reads:
                    rows.append((int(tid), ok, msg, var, float(val)))
            yield pd.DataFrame(rows, columns=[f.name for f in VALIDATOR_OUT.fields])
    return lambda df: df.mapInPandas(run, VALIDATOR_OUT)


def line_validator(tid: int, text: str):
    """A shipped validator: every line at most 1000 characters; reads the
    number of lines and words."""
    text = text or ""
    lines = text.split("\n")
    long_line = next((i for i, l in enumerate(lines, 1) if len(l) > 1000), None)
    msg = "" if long_line is None else f"line {long_line} is longer than 1000 characters"
    return long_line is None, msg, [("n_lines", len(lines)), ("n_words", len(_tokens(text)))]


class Evaluator(Protocol):
    """U4: the judge interface made a table-in / table-out evaluator.
    ``evaluate`` takes (request_id, problem_id, code, language) rows and
    returns (request_id, verdict, success)."""

    def evaluate(self, requests: DataFrame) -> DataFrame: ...


class RunLogEvaluator:
    """Evaluate requests from a stored run log: the verdict of the logged
    submission with the same id; no log row -> success = false (a
    transport error in the reference's terms)."""

    def __init__(self, results: DataFrame, id_col: str = "submission_id"):
        self.results = results.select(F.col(id_col).alias("request_id"), F.col("status").alias("verdict"))

    def evaluate(self, requests: DataFrame) -> DataFrame:
        return (requests.select("request_id").join(self.results, "request_id", "left")
                        .withColumn("success", F.col("verdict").isNotNull()))


RESULT_KEY = ["digest", "problem_id", "language"]
RESULT = "digest string, problem_id string, language string, verdict string"


class StoredEvaluator:
    """U4 with memory: verdicts are kept under ``base`` by (SHA-256 of the code, problem, language). A request
    whose key is there costs a join; each other key is evaluated once, however many requests
    share it, and appended. Failed requests (success false) are not kept and are tried again.

    Several jobs may read one store; one at a time may add to it."""

    def __init__(self, inner: Evaluator, base: str):
        self.inner, self.base = inner, base

    def table(self, spark) -> DataFrame:
        return deltas.latest(spark, self.base, RESULT_KEY, RESULT)

    def evaluate(self, requests: DataFrame) -> DataFrame:
        spark = requests.sparkSession
        digest = F.sha2(F.coalesce("code", F.lit("")), 256).alias("digest")
        keyed = written(requests.select("request_id", "problem_id", "language", digest), "requests")  # the codes are not copied
        keys = keyed.groupBy(*RESULT_KEY).agg(F.min("request_id").alias("request_id"))
        open_keys = written(keys.join(self.table(spark), RESULT_KEY, "left_anti"), "open-requests")
        if open_keys.limit(1).count():
            asked = requests.join(open_keys.select("request_id"), "request_id", "left_semi")
            done = self.inner.evaluate(asked).where(F.col("success"))
            rows = open_keys.join(done.select("request_id", "verdict"), "request_id").select(*RESULT_KEY, "verdict")
            upto, batches = deltas.state_of(spark, self.base)
            deltas.append(rows, max([-1 if upto is None else upto, *batches]) + 1, self.base)
        answered = keyed.select("request_id", *RESULT_KEY).join(self.table(spark), RESULT_KEY, "left")
        return answered.select("request_id", "verdict", F.col("verdict").isNotNull().alias("success"))
