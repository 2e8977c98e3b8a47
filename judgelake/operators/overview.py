"""U2 feeding A13-A16: what validators read, kept as one mergeable overview.

A validator's reads, its feature hits and the declared features are rows of one
frame; one aggregate turns them into a state of a row per name, and the four reports
are projections of that state. States of different texts, days or clusters merge with the
same aggregates, so no read is looked at twice."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from judgelake import constants as K
from judgelake.operators.validate import analyzable, bare_variable

#: A read has kind ``read``, a feature hit ``hit``, a declared feature ``declared``.
EVENTS = ("text_id long, ok boolean, message string, kind string, name string, value double, lower string, upper string, is_int boolean")
STATE = ("kind string, name string, n long, min_hit boolean, max_hit boolean, lower_min string, lower_max string, upper_min string, "
         "upper_max string")


@dataclass(frozen=True)
class Read:
    """One value read under a name, with its bounds as texts (None: no bounds)."""
    name: str
    value: float
    lower: str | None = None
    upper: str | None = None
    is_int: bool = True


@dataclass
class Validation:
    """What a validator found in one text."""
    ok: bool
    message: str = ""
    reads: list[Read] = field(default_factory=list)
    features: list[str] = field(default_factory=list)


def register_overview_validator(fn: Callable[[int, str, str, str], Validation]) -> Callable[[DataFrame], DataFrame]:
    """``fn`` (text id, text, testset, group) -> Validation, over frames of text_id, text and, if they are
    there, testset and group; Arrow batches in, one row per read and feature hit out (one of
    kind NULL for a text without either)."""
    names = [c.strip().split()[0] for c in EVENTS.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for tid, text, testset, group in zip(b["text_id"], b["text"], b["testset"], b["group"]):
                v = fn(int(tid), text or "", testset, group)
                own = [("read", r.name, float(r.value), r.lower, r.upper, r.is_int) for r in v.reads]
                own += [("hit", f, None, None, None, None) for f in v.features]
                rows.extend((int(tid), v.ok, v.message, *o) for o in own or [(None,) * 6])
            yield pd.DataFrame(rows, columns=names)

    def apply(df: DataFrame) -> DataFrame:
        have = df.columns
        cols = [F.col("text_id").cast("long").alias("text_id"), F.col("text")]
        cols += [(F.col(c) if c in have else F.lit(d)).alias(c) for c, d in (("testset", "tests"), ("group", ""))]
        return df.select(*cols).mapInPandas(run, EVENTS)
    return apply


def declared_features(df: DataFrame) -> DataFrame:
    """A frame of ``feature`` as events."""
    return df.select(F.lit("declared").alias("kind"), F.col("feature").alias("name"))


def overview(events: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """The state of all events: per kind and name how often it came, which bounds were reached, and the
    least and greatest text of each bound. Names as in A13; a '~' before a name reaches its minimum, one after it
    its maximum, whatever is read. A bound of 32 characters or more counts as one that varies."""
    e = events.where(F.col("kind").isNotNull())
    if declared is not None:
        e = e.unionByName(declared_features(declared), allowMissingColumns=True)
    read = F.col("kind") == "read"
    marked = (F.length("name") >= 2) & (F.col("name") != "~~")
    e = e.where(F.when(read, analyzable(F.col("name"))).otherwise(~F.col("name").rlike("[\\x00-\\x1f]")))
    v = F.col("value")

    def near(bound: str) -> Column:
        b = F.col(bound).try_cast("double")
        return F.when(F.col("is_int"), v == b).otherwise(F.abs(v - b) < K.BOUND_DELTA)

    def text(bound: str) -> Column:
        return F.when(F.length(bound) < K.MAX_CONST_BOUND_CHARS, F.col(bound))
    long = {b: F.bool_or(F.length(b) >= K.MAX_CONST_BOUND_CHARS) for b in ("lower", "upper")}
    g = e.groupBy("kind", F.when(read, bare_variable(F.col("name"))).otherwise(F.col("name")).alias("name")).agg(
        F.count(F.lit(1)).alias("n"),
        F.bool_or(F.coalesce(near("lower"), F.lit(False)) | (marked & F.col("name").startswith("~"))).alias("min_hit"),
        F.bool_or(F.coalesce(near("upper"), F.lit(False)) | (marked & F.col("name").endswith("~"))).alias("max_hit"),
        *[f(text(b)).alias(f"{b}_{n}") for b in ("lower", "upper") for f, n in ((F.min, "min"), (F.max, "max"))],
        long["lower"].alias("_ll"), long["upper"].alias("_lu"))
    # a bound that varies is kept as two different texts
    def varies(b: str, flag: str) -> list[Column]:
        return [F.when(F.col(flag), F.lit(w)).otherwise(F.col(f"{b}_{n}")).alias(f"{b}_{n}") for n, w in (("min", ""), ("max", "?"))]
    return g.select("kind", "name", "n", "min_hit", "max_hit", *varies("lower", "_ll"), *varies("upper", "_lu"))


def merge_overviews(*states: DataFrame) -> DataFrame:
    """One state of several."""
    both = states[0]
    for s in states[1:]:
        both = both.unionByName(s)
    return both.groupBy("kind", "name").agg(
        F.sum("n").alias("n"), F.bool_or("min_hit").alias("min_hit"), F.bool_or("max_hit").alias("max_hit"),
        F.min("lower_min").alias("lower_min"), F.max("lower_max").alias("lower_max"),
        F.min("upper_min").alias("upper_min"), F.max("upper_max").alias("upper_max"))


def bounds_hits(state: DataFrame) -> DataFrame:
    """A13 of a state: variable, min_hit, max_hit of the variables read with bounds."""
    bounded = F.col("lower_max").isNotNull() | F.col("upper_max").isNotNull()
    return state.where((F.col("kind") == "read") & bounded).select(F.col("name").alias("variable"), "min_hit", "max_hit")


def constant_bounds(state: DataFrame) -> DataFrame:
    """A14 of a state: variable, lower, upper; '?' for a bound that varies; not the variables whose both do."""
    def one(b: str) -> Column:
        return F.when(F.col(f"{b}_min") == F.col(f"{b}_max"), F.col(f"{b}_min")).otherwise(F.lit("?")).alias(b)
    return (state.where(F.col("kind") == "read").select(F.col("name").alias("variable"), one("lower"), one("upper"))
                 .where(~((F.col("lower") == "?") & (F.col("upper") == "?"))))


def features(state: DataFrame) -> DataFrame:
    """A15 of a state: feature, hit, error (hits of features that are not declared, features declared twice)."""
    g = state.where(F.col("kind").isin("hit", "declared")).groupBy(F.col("name").alias("feature")).agg(
        F.sum(F.when(F.col("kind") == "hit", F.col("n"))).alias("_hits"), F.sum(F.when(F.col("kind") == "declared", F.col("n"))).alias("_declared"))
    error = F.when(F.col("_declared").isNull(), F.lit(K.ERR_FEATURE_UNKNOWN)).when(F.col("_declared") > 1, F.lit(K.ERR_FEATURE_TWICE))
    return g.select("feature", F.col("_hits").isNotNull().alias("hit"), error.alias("error"))


def variables(state: DataFrame) -> DataFrame:
    """A16 of a state."""
    return state.where(F.col("kind") == "read").select(F.col("name").alias("variable"))


def overview_log(state: DataFrame) -> DataFrame:
    """section, name, line: the lines of the test overview, ordered by section (bounds, constant, feature,
    variable) and name when written."""
    def flag(c: str, text: str) -> Column:
        return F.when(F.col(c), F.lit(text)).otherwise(F.lit(""))
    b = bounds_hits(state).select(F.lit("bounds").alias("section"), F.col("variable").alias("name"), F.format_string(
        K.LOG_BOUNDS, "variable", flag("min_hit", K.LOG_MIN_HIT), flag("max_hit", K.LOG_MAX_HIT)).alias("line"))
    c = constant_bounds(state).select(F.lit("constant").alias("section"), F.col("variable").alias("name"),
                                      F.format_string(K.LOG_CONSTANT, "variable", "lower", "upper").alias("line"))
    f = features(state).where(F.coalesce(F.col("error") != K.ERR_FEATURE_UNKNOWN, F.lit(True))).select(
        F.lit("feature").alias("section"), F.col("feature").alias("name"),
        F.format_string(K.LOG_FEATURE, "feature", flag("hit", K.LOG_FEATURE_HIT)).alias("line"))
    v = variables(state).select(F.lit("variable").alias("section"), F.col("variable").alias("name"),
                                F.format_string(K.LOG_VARIABLE, "variable").alias("line"))
    return b.unionByName(c).unionByName(f).unionByName(v)
