"""Deterministic generation and sampling.

A sequential generator does not scale out, so every draw is a hash of
(seed, salt, row key): md5 -> first 15 hex digits -> an integer uniform in
[0, 2**60). Any row can be drawn in any task, in any order, and a retried
task draws the same values. Distributions and contracts follow the
reference generator; its exact bit sequence is not reproduced.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from judgelake.functions.numeric import once
from judgelake.operators.ordered import previous_row
from judgelake.operators.patterns import drawn
from judgelake.operators.registry import dense_ordinal
from judgelake.session import written

TWO60 = float(2 ** 60)


def draw(seed, key: Column, salt: str = "") -> Column:
    """Uniform integer in [0, 2**60) from (seed, salt, key)."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(salt), key.cast("string")))
    return F.conv(F.substring(h, 1, 15), 16, 10).cast("bigint")


def uniform_int(seed, key: Column, lo, hi, salt: str = "") -> Column:
    """G1: integer uniform in [lo, hi]."""
    span = F.lit(hi).cast("bigint") - F.lit(lo).cast("bigint") + 1
    return F.lit(lo).cast("bigint") + draw(seed, key, salt) % span


def uniform_double(seed, key: Column, lo: float, hi: float, salt: str = "") -> Column:
    """G1: double uniform in [lo, hi)."""
    return F.lit(lo) + draw(seed, key, salt).cast("double") / TWO60 * (hi - lo)


def weighted_int(seed, key: Column, n: int, wtype: int, salt: str = "") -> Column:
    """Value in [0, n). type > 0: the max of type+1 uniform draws
    (biased to n-1); type < 0: the min of |type|+1 (biased to 0); type 0:
    uniform. For |type| >= 25 the closed form n * u**(1/(type+1)) (or its
    mirror) is used, cropped to n-1."""
    if wtype == 0:
        return draw(seed, key, salt) % n
    k = abs(wtype) + 1
    if abs(wtype) < 25:
        draws = [draw(seed, key, f"{salt}#{i}") % n for i in range(k)]
        return F.greatest(*draws) if wtype > 0 else F.least(*draws)
    u = draw(seed, key, salt).cast("double") / TWO60
    p = F.pow(u, 1.0 / k)
    v = F.floor(F.lit(float(n)) * p) if wtype > 0 else F.floor(F.lit(float(n)) * (1 - p))
    return F.least(v.cast("bigint"), F.lit(n - 1).cast("bigint"))


def gen_uniform(df: DataFrame, key: str, lo, hi, seed, out: str = "value") -> DataFrame:
    if isinstance(lo, float) or isinstance(hi, float):
        return df.withColumn(out, uniform_double(seed, F.col(key), float(lo), float(hi)))
    return df.withColumn(out, uniform_int(seed, F.col(key), lo, hi))


def gen_weighted(df: DataFrame, key: str, n: int, wtype: int, seed, out: str = "value") -> DataFrame:
    return df.withColumn(out, weighted_int(seed, F.col(key), n, wtype))


def shuffle_rows(df: DataFrame, key: str, seed, first: int = 0, out: str = "perm") -> DataFrame:
    """A random permutation: each row gets a distinct value in
    first..first+n-1, ordered by a hash of (seed, key). Numbered with a
    range partition plus per-partition offsets, not a global window."""
    h = df.withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit("perm"), F.col(key).cast("string"))))
    return (dense_ordinal(h, ["_h", key], out="_o")
            .withColumn(out, F.col("_o") - 1 + first).drop("_h", "_o"))


def sample_distinct(values: DataFrame, col: str, k: int, seed) -> DataFrame:
    """K distinct values of ``col`` (error if fewer exist): the k
    smallest hashes. A top-k of size k: the limit is the feature."""
    d = values.select(col).distinct()
    if d.limit(k).count() < k:
        raise ValueError(f"fewer than {k} distinct values")
    return (d.withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit("distinct"), F.col(col).cast("string"))))
             .orderBy("_h", col).limit(k).drop("_h"))


def sample_rows(df: DataFrame, key: str, draws: DataFrame, n_rows: int, seed, wtype: int = 0) -> DataFrame:
    """For each draw (column ``draw_id``) one row of ``df``, uniform or
    biased to the end (type > 0) / start (type < 0): a weighted index
    joined to the rows' dense ordinal."""
    idx = draws.withColumn("_ord", weighted_int(seed, F.col("draw_id"), n_rows, wtype) + 1)
    ordered = dense_ordinal(df, [key], out="_ord")
    return idx.join(ordered, "_ord").drop("_ord")


#: Rounds of the keyed permutation (even): small spans need more to reach all orders about as often.
SMALL_SPAN, SMALL_ROUNDS, ROUNDS = 4096, 16, 8
#: How often a value outside the span is sent on.
WALKS = 64
#: Draws that one row of a group's work makes.
DRAW_BLOCK = 65_536


def _div(x: Column, y: Column) -> Column:
    """Whole quotient of two longs, x >= 0, without a double in between."""
    return F.call_function("div", x, y)


def keyed_permutation(value: Column, span: Column, seed, key: Column) -> Column:
    """The place of ``value`` (0 to span - 1) in a permutation of 0 .. span - 1 chosen by (seed, key).

    A Feistel network over pairs (value mod a, value div a) with a near the root of the span permutes
    a little more than the span; a value that leaves it is sent through again until it is
    back. Fewer than a values lie outside, so spans up to WALKS squared always come back within
    WALKS steps; for larger ones a longer walk has a chance under WALKS ** -WALKS, and raises."""
    a = F.greatest(F.ceil(F.sqrt(span.cast("double"))), F.lit(1)).cast("bigint")

    def step(x: Column, f: Column) -> Column:
        ends = F.struct((x % f["a"]).alias("l"), _div(x, f["a"]).alias("r"))

        def turn(s: Column, k: Column) -> Column:
            h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit("perm"), k.cast("string"), key.cast("string"), s["r"].cast("string")))
            add = F.conv(F.substring(h, 1, 15), 16, 10).cast("bigint")
            return F.struct(s["r"].alias("l"), ((s["l"] + add) % F.when(k % 2 == 0, f["a"]).otherwise(f["b"])).alias("r"))
        last = F.when(f["span"] < SMALL_SPAN, SMALL_ROUNDS - 1).otherwise(ROUNDS - 1)
        return F.aggregate(F.sequence(F.lit(0), last), ends, turn, lambda s: s["r"] * f["a"] + s["l"])

    def walk(x: Column, f: Column) -> Column:
        on = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), x, lambda y, _: F.when(y < f["span"], y).otherwise(step(y, f)))
        return F.when(x < f["span"], x).otherwise(on)

    def whole(f: Column) -> Column:
        return once(step(value.cast("bigint"), f), lambda x: once(walk(x, f), lambda y: F.when(y < f["span"], y).otherwise(
            F.raise_error(F.lit("the permutation did not come back into its span")).cast("bigint"))))
    return once(F.struct(span.cast("bigint").alias("span"), a.alias("a")), lambda f: once(
        F.struct(f["span"].alias("span"), f["a"].alias("a"), _div(f["span"] + f["a"] - 1, f["a"]).alias("b")), whole))


def random_partition(groups: DataFrame, seed, key: str = "group_id") -> DataFrame:
    """Per group split ``total`` into ``size`` parts, each >= ``min_part``: size - 1 distinct cut points
    in [1, total - size * min_part + size - 1], sorted; the parts are the gaps. The cut points are
    the first size - 1 values of a keyed permutation of all, so only they are made. Groups with
    total < size * min_part, or with size 0, are rejected (no rows).

    Columns: ``key``, part_no (from 0), part. A group's draws are dealt in blocks and its cut points
    by range, so one group may be of any size."""
    g = groups.where((F.col("size") > 0) & (F.col("total") >= F.col("size") * F.col("min_part")))
    g = g.select(key, F.col("size").cast("bigint").alias("size"), F.col("min_part").cast("bigint").alias("min_part"),
                 (F.col("total") - F.col("size") * F.col("min_part")).cast("bigint").alias("_free"))
    n = F.col("size") - 1  # draws
    blocks = g.where(n > 0).withColumn("_block", F.explode(F.sequence(F.expr("0L"), _div(n - 1, F.lit(DRAW_BLOCK).cast("bigint")))))
    first = F.col("_block") * DRAW_BLOCK
    # a block's work does not show in its bytes, by which Spark would join partitions: their number is set
    spark = groups.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    draws = blocks.repartition(parts, key, "_block").withColumn("_i", F.explode(F.sequence(first, F.least(first + DRAW_BLOCK, n) - 1)))
    cut = keyed_permutation(F.col("_i"), F.col("_free") + n, seed, F.col(key)) + 1
    ends = g.select(key, "min_part", (F.col("_free") + F.col("size")).alias("cut"))
    made = written(draws.select(key, "min_part", cut.alias("cut")).unionByName(ends), "cuts")  # dealing by range reads them twice
    cuts = previous_row(made, [key], "cut", "part_no", "_prev")
    return cuts.select(key, "part_no", (F.col("cut") - F.coalesce("_prev", F.lit(0)) - 1 + F.col("min_part")).alias("part"))


def gen_strings(df: DataFrame, key: str, pattern: str, seed, out: str = "text") -> DataFrame:
    """Strings of a pattern (``patterns``): groups, alternatives, ``?``, counts, escapes and
    negated sets; ``*`` and ``+`` are rejected (unbounded). The pattern is parsed once on the
    driver into a column expression of hashed draws."""
    def at(salt: str, j: Column) -> Column:
        h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(salt), F.col(key).cast("string"), j.cast("string")))
        return F.conv(F.substring(h, 1, 15), 16, 10).cast("bigint")
    return df.withColumn(out, drawn(pattern, lambda salt: draw(seed, F.col(key), salt), at))
