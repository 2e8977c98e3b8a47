"""C4: curation in batches that are committed one by one.

Under ``base`` a batch writes its records to ``output/batch=<n>`` and then
commits with its rows of the manifest, ``delta/batch=<n>``: every problem it tried, also
those without a record. Only committed batches count, so a run that stops anywhere goes
on behind the last commit. What is left is found before any code is read, and codes are read
only of files that hold problems left, in those of problems left."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from judgelake.operators.curate import eligible_problems
from judgelake.session import small_side, written
from judgelake.streaming import deltas

MANIFEST = "problem_id string, source_file string, n_codes long"


def manifest(spark: SparkSession, base: str) -> DataFrame:
    """problem_id, source_file, n_codes (codes kept; NULL without a record), batch of every problem tried."""
    return deltas.read(spark, base, MANIFEST)[1]


def records(spark: SparkSession, base: str) -> DataFrame | None:
    """The records of all committed batches, None before the first."""
    _, batches = deltas.state_of(spark, base)
    if not batches:
        return None
    return spark.read.option("mergeSchema", "true").parquet(*[f"{base}/output/batch={b}" for b in batches])


def state(spark: SparkSession, base: str) -> DataFrame:
    """problem_id, state (processed), n_codes: the new state after the committed batches."""
    return manifest(spark, base).groupBy("problem_id").agg(F.max("n_codes").alias("n_codes")).select(
        "problem_id", F.lit("processed").alias("state"), "n_codes")


#: Of the entries of a nested list, the field read to tell the list's length.
COUNTED = {"test_cases": "output", "incorrect_submissions": "language", "correct_submissions": "language"}


def pending(spark: SparkSession, files: Sequence[str], schema: T.StructType, base: str) -> DataFrame:
    """(id, source_file) of the eligible problems (P1) not tried yet. Of the lists one short field is
    read, never a code; the scan's schema leaves the rest out."""
    fields = []
    for f in schema.fields:
        if f.name in COUNTED:
            one = [x for x in f.dataType.elementType.fields if x.name == COUNTED[f.name]]
            fields.append(T.StructField(f.name, T.ArrayType(T.StructType(one))))
        elif f.name in ("id", "true_negative_rate"):
            fields.append(f)
    rows = spark.read.schema(T.StructType(fields)).parquet(*files).withColumn("source_file", F.col("_metadata.file_path"))
    ids = eligible_problems(rows).select("id", "source_file")
    return ids.join(manifest(spark, base).select(F.col("problem_id").alias("id")).distinct(), "id", "left_anti")


def resume_batches(spark: SparkSession, files: Sequence[str], schema: T.StructType, base: str,
                   curate: Callable[[DataFrame], DataFrame], files_per_batch: int = 1, limit: int | None = None) -> int:
    """Curate what is pending, ``files_per_batch`` files at a time, and commit each batch; at most ``limit``
    batches (None: all). ``curate`` maps candidate problems to records with ``id`` and ``incorrect_codes``.
    Returns the number of batches committed. A problem in several files is tried once, in the first of them."""
    todo = pending(spark, files, schema, base).groupBy("id").agg(F.min("source_file").alias("source_file"))
    todo = written(todo, "pending")  # as it is now: the commits of this run change it
    names = sorted(r[0] for r in todo.select("source_file").distinct().collect())  # one row per input file
    _, done = deltas.state_of(spark, base)
    number, made = (done[-1] + 1 if done else 0), 0
    for k in range(0, len(names), files_per_batch):
        if limit is not None and made == limit:
            break
        own = names[k:k + files_per_batch]
        ids = todo.where(F.col("source_file").isin(own))
        wide = spark.read.schema(schema).parquet(*own).withColumn("source_file", F.col("_metadata.file_path"))
        wide = wide.join(small_side(ids), ["id", "source_file"], "left_semi").drop("source_file")
        out = f"{base}/output/batch={number}"
        curate(wide).write.mode("overwrite").parquet(out)
        kept = spark.read.parquet(out).select("id", F.size("incorrect_codes").cast("long").alias("n_codes"))
        rows = ids.join(kept, "id", "left").select(F.col("id").alias("problem_id"), "source_file", "n_codes")
        deltas.append(rows, number, base)
        number, made = number + 1, made + 1
    return made


