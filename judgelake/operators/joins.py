"""Joins and set logic (J1-J6). Small sides are never broadcast blindly:
Catalyst broadcasts a side only when its estimated size is under
``spark.sql.autoBroadcastJoinThreshold`` (the size check) and otherwise
plans a shuffle join; AQE re-plans with the real sizes at runtime."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pair_testcases(ins: DataFrame, outs: DataFrame,
                   keys: Sequence[str] = ("problem_id", "stem")) -> DataFrame:
    """Every ``.in`` left-joined to its ``.out`` on the stem; a missing
    ``.out`` stays as has_expected = false."""
    keys = list(keys)
    o = outs.select(*keys).distinct().withColumn("has_expected", F.lit(True))
    return (ins.join(o, keys, "left")
               .withColumn("has_expected", F.coalesce(F.col("has_expected"), F.lit(False))))


def pair_listed(files: DataFrame, keys: Sequence[str] = ("problem_id", "stem"), kind: str = "kind") -> DataFrame:
    """J1 over one listing of both kinds (``in``, ``out``): its ``.in`` rows with has_expected, as
    ``pair_testcases`` gives them. Rows that lie by some of the keys already are not shuffled."""
    paired = files.withColumn("has_expected", F.max(F.col(kind) == "out").over(Window.partitionBy(*keys)))
    return paired.where(F.col(kind) == "in").drop(kind)


def exclude_processed(df: DataFrame, done: DataFrame, key: str = "id", done_key: str = "problem_id") -> DataFrame:
    """Drop problems already in the processed set."""
    return df.join(done.select(F.col(done_key).alias(key)).distinct(), key, "left_anti")


def exclude_problematic(df: DataFrame, registry: DataFrame, key: str = "id") -> DataFrame:
    """Drop problems listed in the slow-checker registry."""
    return df.join(registry.select(F.col("problem_id").alias(key)).distinct(), key, "left_anti")


def exclude_failed_codes(codes: DataFrame, failed: DataFrame,
                         problem_col: str = "problem_id", code_col: str = "code") -> DataFrame:
    """Drop codes whose full text equals a stored failure of the same
    problem (every equal duplicate goes). Texts are compared by SHA-256 and
    length; the failures' texts stay out of the shuffle."""
    f = failed.select(F.col(problem_col).alias("_fp"), F.sha2(F.col(code_col), 256).alias("_fh"),
                      F.length(code_col).alias("_fn")).distinct()
    c = codes.withColumn("_h", F.sha2(F.col(code_col), 256)).withColumn("_n", F.length(code_col))
    cond = (c[problem_col] == f["_fp"]) & (c["_h"] == f["_fh"]) & (c["_n"] == f["_fn"])
    return c.join(f, cond, "left_anti").drop("_h", "_n")


def submission_lookup(subs: DataFrame, problems: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Submissions with their problem; unknown problem -> rejects."""
    p = problems.select(F.col("id").alias("problem_id"), F.col("title").alias("problem_title"),
                        "time_limit", "memory_limit", "has_checker")
    good = subs.join(p, "problem_id", "inner")
    bad = subs.join(p.select("problem_id"), "problem_id", "left_anti").withColumn(
        "reject_reason", F.lit("Problem not found"))
    return good, bad


def orphan_submissions(subs: DataFrame, problems: DataFrame) -> DataFrame:
    """Submissions whose problem no longer exists."""
    return subs.join(problems.select(F.col("id").alias("problem_id")), "problem_id", "left_anti")
