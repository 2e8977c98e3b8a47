"""Bulk output comparison (V2 as a table op) and numeric error report (V7)."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from judgelake.functions.numeric import numeric_equal, numeric_error
from judgelake.functions.text import output_equal, output_hash


def compare_outputs(df: DataFrame, actual: str = "actual", expected: str = "expected") -> DataFrame:
    """V2 over a table: adds ``same`` and the normal-form hash of each side
    (the hash is what later joins or shuffles should carry, not the text)."""
    return (df.withColumn("same", output_equal(F.col(actual), F.col(expected)))
              .withColumn("actual_hash", output_hash(F.col(actual)))
              .withColumn("expected_hash", output_hash(F.col(expected))))


def compare_numbers(df: DataFrame, eps: float, expected: str = "expected", actual: str = "actual") -> DataFrame:
    """V6 over a table."""
    return df.withColumn("equal", numeric_equal(F.col(expected), F.col(actual), eps))


def numeric_error_report(pairs: DataFrame, eps: float, keys: Sequence[str] = ("problem_id",),
                         expected: str = "expected", actual: str = "actual") -> DataFrame:
    """V7: per key the largest and mean error and how many exceed eps.
    One partial-aggregated groupBy."""
    err = numeric_error(F.col(expected), F.col(actual))
    return (pairs.withColumn("_err", err)
                 .groupBy(*keys)
                 .agg(F.max("_err").alias("max_error"), F.avg("_err").alias("mean_error"),
                      F.count_if(F.col("_err") > eps).cast("bigint").alias("n_above")))
