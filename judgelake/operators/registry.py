"""Problem-registry maintenance (M1-M6) on plain parquet tables: each
operation returns the next version of the table; callers write it to a new
versioned path (``sources.files.write_versioned``), never in place."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from judgelake import constants as K
from judgelake.session import checkpoint_dir
from judgelake.functions.text import nonblank

FIELDS = ["title", "time_limit", "memory_limit", "has_checker", "test_case_count"]


def _last_per_id(changes: DataFrame, seq_col: str, fields: Sequence[str], skip_nulls: bool) -> DataFrame:
    """Collapse a batch to one row per id: per field the value of the
    highest ``seq`` (ignoring NULL values when ``skip_nulls``). One
    partial-aggregated groupBy."""
    aggs = []
    for f in fields:
        v = F.struct(F.col(seq_col).alias("s"), F.col(f).alias("v"))
        v = F.when(F.col(f).isNotNull(), v) if skip_nulls else v
        aggs.append(F.max(v)["v"].alias(f))
    return changes.groupBy("id").agg(*aggs)


def upsert_problems(table: DataFrame, changes: DataFrame, seq_col: str = "seq") -> DataFrame:
    """M1: insert or replace title, limits, has_checker, count; an existing
    row keeps its created_at; within a batch the last change wins."""
    last = _last_per_id(changes, seq_col, FIELDS + ["created_at"], skip_nulls=False).withColumn("_chg", F.lit(True))
    t = table.select("id", *[F.col(f).alias(f"_o_{f}") for f in FIELDS + ["created_at"]])
    j = t.join(last, "id", "full_outer")
    has_new = F.coalesce(F.col("_chg"), F.lit(False))
    cols = [F.when(has_new, F.col(f)).otherwise(F.col(f"_o_{f}")).alias(f) for f in FIELDS]
    created = F.coalesce(F.col("_o_created_at"), F.col("created_at")).alias("created_at")
    return j.select("id", *cols, created)


def patch_problems(table: DataFrame, patches: DataFrame, seq_col: str = "seq"
                   ) -> tuple[DataFrame, DataFrame]:
    """M2: only non-NULL fields overwrite; a patch that sets a checker turns
    has_checker on (it never turns it off); unknown ids -> rejects."""
    fields = ["title", "time_limit", "memory_limit", "test_case_count"]
    last = _last_per_id(patches.withColumn("checker_set", F.when(F.col("checker_set"), F.lit(True))),
                        seq_col, fields + ["checker_set"], skip_nulls=True)
    rejects = last.join(table.select("id"), "id", "left_anti").withColumn("reject_reason", F.lit("Problem not found"))
    p = last.select("id", *[F.col(f).alias(f"_p_{f}") for f in fields + ["checker_set"]])
    j = table.join(p, "id", "left")
    out = j.select("id", *[F.coalesce(F.col(f"_p_{f}"), F.col(f)).alias(f) for f in fields],
                   (F.col("has_checker") | F.coalesce(F.col("_p_checker_set"), F.lit(False))).alias("has_checker"),
                   "created_at")
    return out.select("id", *FIELDS, "created_at"), rejects


def delete_problems(table: DataFrame, ids: DataFrame) -> DataFrame:
    """M3: remove by id; deleting an unknown id is not an error."""
    return table.join(ids.select("id").distinct(), "id", "left_anti")


def insert_if_absent(table: DataFrame, new: DataFrame) -> DataFrame:
    """M4: upload only problems that do not exist yet; a whitespace-only
    checker counts as none."""
    add = (new.join(table.select("id"), "id", "left_anti")
              .dropDuplicates(["id"])
              .withColumn("has_checker", nonblank(F.col("checker"))).drop("checker"))
    return table.unionByName(add, allowMissingColumns=True)


def _last_upload(files: DataFrame) -> DataFrame:
    """One row per file name: the last by ``seq`` where the upload has that column (an archive may hold a
    base name several times), else the greatest content."""
    order = F.col("seq").cast("long") if "seq" in files.columns else F.lit(0).cast("long")
    return files.groupBy("problem_id", "name").agg(F.max(F.struct(order.alias("seq"), F.col("content").alias("content")))["content"].alias("content"))


def merge_testcases(old: DataFrame, new: DataFrame) -> DataFrame:
    """M5 (POST): files merge by base name; a new file replaces an old one of the same name, old files not in
    the upload stay; of equal names in the upload the last wins."""
    fresh = _last_upload(new)
    return fresh.unionByName(old.select("problem_id", "name", "content").join(fresh, ["problem_id", "name"], "left_anti"))


def replace_testcases(old: DataFrame, new: DataFrame) -> DataFrame:
    """M5 (PATCH): a problem in the upload gets exactly the uploaded set; of equal names the last wins."""
    touched = new.select("problem_id").distinct()
    keep = old.select("problem_id", "name", "content").join(touched, "problem_id", "left_anti")
    return keep.unionByName(_last_upload(new))


def dense_ordinal(df: DataFrame, order_cols: Sequence[str], out: str = "ordinal",
                  partitions: int | None = None) -> DataFrame:
    """Global 1..n numbering in ``order_cols`` order without a global window
    (which would pull every row into one partition): range-partition on the
    order (sampled bounds), number rows inside each partition, and add the
    row counts of all earlier partitions. The per-partition count table has
    one row per partition, so collecting it is bounded by the partition
    count, not the data. ``order_cols`` must be unique for stable ids."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = (df.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols)
                .withColumn("_pid", F.spark_partition_id())
                .withColumn("_mid", F.monotonically_increasing_id()))
    # monotonically_increasing_id = (partition index << 33) + row index
    ranged = ranged.withColumn("_local", F.col("_mid") - F.shiftleft(F.col("_pid").cast("bigint"), 33))
    # reliable checkpoint (shared folder): both uses below see the same
    # numbering even if an executor is lost and a partition is recomputed
    ranged = ranged.checkpoint()
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    from pyspark.sql import Window
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0))).select("_pid", "_off")
    return (ranged.join(F.broadcast(offsets), "_pid")
                  .withColumn(out, F.col("_off") + F.col("_local") + 1)
                  .drop("_pid", "_mid", "_local", "_off"))


def new_submission_ids(table: DataFrame, arrivals: DataFrame,
                       order_cols: Sequence[str] = ("arrived_at", "seq", "tiebreak")
                       ) -> DataFrame:
    """M6: dense increasing ids after the current maximum, in arrival
    order, status Pending."""
    top = table.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]   # one scalar
    numbered = dense_ordinal(arrivals, list(order_cols), out="_ord")
    return (numbered.withColumn("id", F.lit(top) + F.col("_ord"))
                    .withColumn("status", F.lit(K.PENDING))
                    .drop("_ord"))
