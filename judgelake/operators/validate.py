"""Bulk input validation: token checks (T1-T6) and validator reports
(A13-A16). Token rules are regular expressions evaluated by the JVM; the
number parse is ``try_cast`` guarded by the regex (``try_cast`` alone
accepts ' 5', '1d', 'nan', '1e5')."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from judgelake import constants as K
from judgelake.operators.patterns import matches
from judgelake.session import small_side

INT_RE = "^-?(0|[1-9][0-9]*)\\z"
UINT_RE = "^(0|[1-9][0-9]*)\\z"
LOOSE_DOUBLE_RE = "^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?\\z"
STRICT_DOUBLE_RE = "^-?(0|[1-9][0-9]*)(\\.[0-9]+)?\\z"


def int_violation(tok: Column, lo, hi) -> Column:
    """Reason or NULL. No leading zeroes, no '-0', no '+', at most 20
    characters, inside int64, then inside [lo, hi]."""
    v = tok.try_cast("bigint")
    bad = (~tok.rlike(INT_RE)) | (tok == "-0") | (F.length(tok) > K.MAX_INT_TOKEN_CHARS) | v.isNull()
    return (F.when(tok.isNull() | bad, F.lit("expected int64"))
             .when((v < lo) | (v > hi), F.lit("out of range")))


def uint_violation(tok: Column, lo, hi) -> Column:
    """Unsigned 64-bit, no leading zero, range as decimal(20,0)."""
    v = tok.try_cast("decimal(20,0)")
    def dec(x):
        return F.lit(str(x)).cast("decimal(20,0)")
    bad = (~tok.rlike(UINT_RE)) | (F.length(tok) > K.MAX_INT_TOKEN_CHARS) | v.isNull() | (v > dec(K.UINT64_MAX))
    return (F.when(tok.isNull() | bad, F.lit("expected unsigned int64"))
             .when((v < dec(lo)) | (v > dec(hi)), F.lit("out of range")))


def double_violation(tok: Column, lo: float, hi: float, strict: bool = False,
                     min_digits: int = 0, max_digits: int = 30) -> Column:
    """Loose doubles (scanf form of digits . e E + -, one point, one e,
    no nan / inf text) or strict doubles (digits after the point in
    [min_digits, max_digits], no leading zero, no '-0.00', at most 1000
    characters), then the range."""
    v = tok.try_cast("double")
    if not strict:
        bad = ~tok.rlike(LOOSE_DOUBLE_RE) | v.isNull()
        return (F.when(tok.isNull() | bad, F.lit("expected double"))
                 .when((v < lo) | (v > hi), F.lit("out of range")))
    after = F.when(tok.contains("."), F.length(F.substring_index(tok, ".", -1))).otherwise(F.lit(0))
    fmt_bad = ~tok.rlike(STRICT_DOUBLE_RE) | (F.length(tok) > K.MAX_STRICT_DOUBLE_CHARS) | v.isNull()
    return (F.when(tok.isNull() | fmt_bad, F.lit("expected strict double"))
             .when((after < min_digits) | (after > max_digits), F.lit("wrong number of digits after point"))
             .when(tok.startswith("-") & (v >= 0), F.lit("redundant minus"))
             .when((v < lo) | (v > hi), F.lit("out of range")))


def validate_tokens(tokens: DataFrame, kind: str, lo, hi, token_col: str = "token", **kw) -> DataFrame:
    """T1-T3 over a table of tokens: one row per violated token."""
    tok = F.col(token_col)
    reason = {"int": lambda: int_violation(tok, lo, hi),
              "uint": lambda: uint_violation(tok, lo, hi),
              "double": lambda: double_violation(tok, lo, hi, **kw)}[kind]()
    return tokens.withColumn("reason", reason).where(F.col("reason").isNotNull())


# --------------------------------------------------------------------------
# T4 patterns
# --------------------------------------------------------------------------

def validate_pattern(tokens: DataFrame, patterns: dict[str, str], token_col: str = "token") -> DataFrame:
    """T4: one row per (token, pattern id) with ``matched``. The pattern set
    is a fixed literal list, so each pattern is its own ``rlike`` column
    (no join); the results are unpivoted with ``stack``."""
    tok = F.col(token_col)
    checks = F.array(*[F.struct(F.lit(pid).alias("pattern_id"),
                                matches(tok, p).alias("matched"))
                       for pid, p in patterns.items()])
    return tokens.withColumn("_c", F.explode(checks)).select("*", "_c.*").drop("_c")


# --------------------------------------------------------------------------
# T5 strict layout, T6 token list compare
# --------------------------------------------------------------------------

def strict_layout_check(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """T5: strict mode: every line ends with a line feed, single spaces
    between tokens, no leading / trailing blanks, no tabs or CR, no empty
    line before the end. Adds the first breach (line number and reason)."""
    lines = F.split(F.col(text_col), "\n", -1)

    def reason(l: Column) -> Column:
        return (F.when(l == "", F.lit("empty line"))
                 .when(l.contains("\r"), F.lit("carriage return"))
                 .when(l.startswith(" "), F.lit("leading space"))
                 .when(l.endswith(" "), F.lit("trailing space"))
                 .when(l.contains("  "), F.lit("double space"))
                 .when(l.contains("\t"), F.lit("tab")))
    whole = F.slice(lines, F.lit(1), F.size(lines) - 1)  # what follows the last line feed is no line
    found = F.filter(F.transform(whole, lambda l, i: F.struct((i + 1).cast("bigint").alias("line"), reason(l).alias("reason"))),
                     lambda x: x["reason"].isNotNull())
    last = F.struct(F.size(lines).cast("bigint").alias("line"), F.when(F.element_at(lines, -1) != "", F.lit("missing final line feed")).alias("reason"))
    first = F.coalesce(F.get(found, F.lit(0)), F.when(last["reason"].isNotNull(), last))
    keys = [c for c in texts.columns if c != text_col]
    # the generator keeps the rule from being evaluated once per field
    return texts.select(*keys, F.explode(F.array(first)).alias("_b")).select(*keys, F.col("_b.line").alias("bad_line"), F.col("_b.reason").alias("reason"))


def compare_token_lists(expected: Column, found: Column) -> Column:
    """First mismatch of two token lists (1-based position, expected
    and found token, EOF past the shorter end, message); NULL when equal.
    Each list is read once (``arrays_zip`` pads the shorter with NULL), so
    the cost is linear in the token count."""
    z = F.arrays_zip(expected.alias("e"), found.alias("f"))
    tagged = F.transform(z, lambda x, i: F.struct((i + 1).alias("pos"), x["e"].alias("e"), x["f"].alias("f")))
    first = F.get(F.filter(tagged, lambda x: ~x["e"].eqNullSafe(x["f"])), 0)
    e = F.coalesce(first["e"], F.lit("EOF"))
    f = F.coalesce(first["f"], F.lit("EOF"))
    return F.when(first.isNotNull(), F.struct(
        first["pos"].alias("pos"), e.alias("expected"), f.alias("found"),
        F.format_string("expected %s, found %s", e, f).alias("message")))


# --------------------------------------------------------------------------
# A13-A16 validator reports
# --------------------------------------------------------------------------

def analyzable(name: Column) -> Column:
    """Variables whose name holds a digit or a control character are left out of the reports."""
    return ~name.rlike("[0-9\\x00-\\x1f]")


def _marked(name: Column) -> Column:
    return (F.length(name) >= 2) & (name != "~~")


def bare_variable(name: Column) -> Column:
    """A variable's name without the one '~' before and the one after it."""
    return F.when(_marked(name), F.regexp_replace(F.regexp_replace(name, "^~", ""), "~\\z", "")).otherwise(name)


def bounds_hit_report(values: DataFrame, constraints: DataFrame, max_variables: int | None = None) -> DataFrame:
    """Per variable, was the minimum reached and was the maximum
    reached (OR over all reads). A '~' before a variable's name marks its
    minimum as ignored, one after it its maximum (an ignored bound counts as
    hit); ``~n``, ``n~`` and ``n`` are one variable. Names with digits or
    control characters are skipped. Integers by equality, doubles by a delta
    under 1e-12. ``max_variables`` keeps the first so many names, None all.

    ``values``: variable, value (double); ``constraints``: variable, lo, hi
    (text), is_int. A constraint table of bounded size goes to the values; a larger one is left to Spark."""
    name = F.col("variable")
    c = constraints.where(analyzable(name)).select(
        name.alias("_raw"), bare_variable(name).alias("_name"), "is_int",
        (_marked(name) & name.startswith("~")).alias("lo_ign"), (_marked(name) & name.endswith("~")).alias("hi_ign"),
        F.col("lo").cast("double").alias("lo"), F.col("hi").cast("double").alias("hi"))
    if max_variables is not None:
        first = c.select("_name").distinct().orderBy("_name").limit(max_variables)
        c = c.join(first, "_name", "left_semi")
    j = values.join(small_side(c), values["variable"] == c["_raw"]).withColumn("variable", F.col("_name"))
    v = F.col("value")
    hit_lo = F.when(F.col("is_int"), v == F.col("lo")).otherwise(F.abs(v - F.col("lo")) < K.BOUND_DELTA)
    hit_hi = F.when(F.col("is_int"), v == F.col("hi")).otherwise(F.abs(v - F.col("hi")) < K.BOUND_DELTA)
    g = j.groupBy("variable").agg(F.bool_or(hit_lo).alias("_lo"), F.bool_or(hit_hi).alias("_hi"),
                                  F.max("lo_ign").alias("lo_ign"), F.max("hi_ign").alias("hi_ign"))
    return g.select("variable", (F.col("_lo") | F.col("lo_ign")).alias("min_hit"),
                    (F.col("_hi") | F.col("hi_ign")).alias("max_hit"))


def constant_bounds_report(reads: DataFrame) -> DataFrame:
    """Per variable the lower / upper bound if it was the same on
    every read, else '?'; a variable whose both bounds vary is dropped;
    bound texts of 32+ characters count as broken ('?'). Names as in A13."""
    reads = reads.where(analyzable(F.col("variable"))).withColumn("variable", bare_variable(F.col("variable")))
    g = reads.groupBy("variable").agg(
        F.count_distinct("lower").alias("_nl"), F.count_distinct("upper").alias("_nu"),
        F.max("lower").alias("_l"), F.max("upper").alias("_u"),
        F.max(F.length("lower")).alias("_ll"), F.max(F.length("upper")).alias("_lu"))
    lo = F.when((F.col("_nl") == 1) & (F.col("_ll") < K.MAX_CONST_BOUND_CHARS), F.col("_l")).otherwise(F.lit("?"))
    hi = F.when((F.col("_nu") == 1) & (F.col("_lu") < K.MAX_CONST_BOUND_CHARS), F.col("_u")).otherwise(F.lit("?"))
    return (g.select("variable", lo.alias("lower"), hi.alias("upper"))
             .where(~((F.col("lower") == "?") & (F.col("upper") == "?"))))


def feature_coverage(declared: DataFrame, hits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(report, errors). Report: each declared feature and whether it
    was hit. Errors: a hit on an undeclared feature, a feature declared
    twice."""
    d = declared.groupBy("feature").agg(F.count(F.lit(1)).alias("_n"))
    h = hits.groupBy("feature").agg(F.count(F.lit(1)).alias("hits"))
    report = d.join(h, "feature", "left").select(
        "feature", F.coalesce(F.col("hits") > 0, F.lit(False)).alias("hit"))
    undeclared = h.join(d, "feature", "left_anti").select("feature", F.lit("feature not declared").alias("error"))
    twice = d.where(F.col("_n") > 1).select("feature", F.lit("feature declared twice").alias("error"))
    return report, undeclared.unionByName(twice)


def variable_inventory(reads: DataFrame) -> DataFrame:
    """The sorted distinct variable names read, as in A13."""
    named = reads.where(analyzable(F.col("variable")))
    return named.select(bare_variable(F.col("variable")).alias("variable")).distinct().orderBy("variable")
