"""Mixed registry changes (M1-M3 in one log) folded per id into one effect.

The fold is a pair of partial aggregations, so a batch of any size and an id
with any number of changes meet as partial results only. Folding two logs one after
the other, or both as one, gives the same table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from judgelake.operators.ordered import running_last

UPSERT, PATCH, DELETE = "upsert", "patch", "delete"
FIELDS = ["title", "time_limit", "memory_limit", "test_case_count"]
CHANGE = ("id string, seq long, op string, title string, time_limit int, memory_limit int, has_checker boolean, "
          "test_case_count int, created_at long, checker_set boolean")
TABLE = "id string, title string, time_limit int, memory_limit int, has_checker boolean, test_case_count int, created_at long"


def _order(order_cols: Sequence[str]) -> Column:
    return F.struct(*order_cols)


def fold_changes(changes: DataFrame, order_cols: Sequence[str] = ("seq",)) -> DataFrame:
    """One row per id: ``deleted`` (was there a delete), ``upsert`` (the last upsert after the last
    delete, NULL: none), ``first`` (the first of these) and per field the last patch value with its place.
    ``order_cols`` must be unique per id; what lies before an id's last delete is dropped first."""
    c = changes.withColumn("_at", _order(order_cols))
    ends = c.where(F.col("op") == DELETE).groupBy("id").agg(F.max("_at").alias("_end"))
    c = c.join(ends, "id", "left").where(F.col("_end").isNull() | (F.col("_at") >= F.col("_end")))
    up, patch = F.col("op") == UPSERT, F.col("op") == PATCH

    def held(col: str) -> Column:
        return F.max(F.when(patch & F.col(col).isNotNull(), F.struct(F.col("_at").alias("at"), F.col(col).alias("v")))).alias(f"p_{col}")
    return c.groupBy("id").agg(
        F.bool_or(F.col("op") == DELETE).alias("deleted"),
        F.max(F.when(up, F.struct(F.col("_at").alias("at"), *FIELDS, "has_checker"))).alias("upsert"),
        F.min(F.when(up, F.struct(F.col("_at").alias("at"), F.col("created_at").alias("created_at")))).alias("first"),
        *[held(f) for f in FIELDS],
        F.max(F.when(patch & F.col("checker_set"), F.col("_at"))).alias("p_checker"))


def apply_changes(table: DataFrame, effects: DataFrame) -> DataFrame:
    """The next version of the registry: every change in order. A patch of a row that is not there
    does nothing, a row that lives on keeps its created_at, a checker is turned on by patches, never off."""
    old = table.select("id", *[F.col(c).alias(f"_o_{c}") for c in (*FIELDS, "has_checker", "created_at")], F.lit(True).alias("_was"))
    j = old.join(effects, "id", "full_outer")
    up = F.col("upsert")
    lives = F.coalesce(F.col("_was"), F.lit(False)) & ~F.coalesce(F.col("deleted"), F.lit(False))
    j = j.where(lives | up.isNotNull())

    def value(f: str) -> Column:
        p = F.col(f"p_{f}")
        return F.when(up.isNotNull(), F.when(p["at"] > up["at"], p["v"]).otherwise(up[f])) \
            .otherwise(F.coalesce(p["v"], F.col(f"_o_{f}"))).alias(f)
    on = F.when(up.isNotNull(), up["has_checker"] | F.coalesce(F.col("p_checker") > up["at"], F.lit(False))) \
        .otherwise(F.col("_o_has_checker") | F.col("p_checker").isNotNull()).alias("has_checker")
    created = F.when(lives, F.col("_o_created_at")).otherwise(F.col("first.created_at")).alias("created_at")
    title, limits, memory, count = (value(f) for f in FIELDS)
    return j.select("id", title, limits, memory, on, count, created)


def rejected_patches(table: DataFrame, changes: DataFrame, order_cols: Sequence[str] = ("seq",)) -> DataFrame:
    """The patches that found no row: before each, the last upsert or delete of the id says
    whether there is one, and where there was none, the table does."""
    reset = F.when(F.col("op").isin(UPSERT, DELETE), F.col("op") == UPSERT)
    c = running_last(changes, ["id"], list(order_cols), reset, "is_there").where(F.col("op") == PATCH)
    c = c.join(table.select("id", F.lit(True).alias("_was")), "id", "left")
    there = F.coalesce(F.col("is_there"), F.col("_was"), F.lit(False))
    return c.where(~there).drop("is_there", "_was").withColumn("reject_reason", F.lit("Problem not found"))
