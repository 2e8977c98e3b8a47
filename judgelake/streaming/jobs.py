"""Structured Streaming forms (S1-S6). Every job has a checkpoint location
under the shared folder, so a restarted job resumes where it stopped;
sinks are parquet (or deltas written by ``foreachBatch``), never driver memory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from judgelake import constants as K
from judgelake.functions.text import fixed_text
from judgelake.operators import changes as CH
from judgelake.operators.curate import eligible_problems
from judgelake.streaming import deltas


def run_available(writer, checkpoint: str, timeout_s: int | None = None) -> StreamingQuery:
    """Run a stream over what is there and end. Batches without rows are off for its time: with
    processing-time timers there is always one more of them. Raises if it has not ended after ``timeout_s``."""
    spark = writer._spark
    key = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        q = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        if timeout_s is None:
            q.awaitTermination()
        elif not q.awaitTermination(timeout_s):
            q.stop()
            raise TimeoutError(f"the stream had not ended after {timeout_s} s")
        return q
    finally:
        spark.conf.set(key, before)


def stream_candidates(spark: SparkSession, source: str, schema: T.StructType, sink: str, checkpoint: str,
                      files_per_trigger: int = 1) -> StreamingQuery:
    """Curation candidates file by file in bounded micro-batches with
    resume: eligibility filter, parquet sink, availableNow trigger."""
    s = (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source))
    return (eligible_problems(s).writeStream.format("parquet").option("path", sink)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def stream_dedup_processed(stream: DataFrame, key: str = "id") -> DataFrame:
    """Each id is handled once for ever (state grows with the ids)."""
    return stream.dropDuplicates([key])


def stream_submission_status(events: DataFrame) -> DataFrame:
    """S3: latest status per submission by (ts, seq). In update mode a batch gives the submissions
    that changed; ``deltas.sink`` keeps them and ``deltas.latest`` reads the table."""
    return events.groupBy("submission_id").agg(
        F.max(F.struct("ts", "seq", "status")).alias("_l")).select("submission_id", F.col("_l.status").alias("status"))


def stream_slow_checkers(obs: DataFrame) -> DataFrame:
    """The slow-checker registry kept up to date, per (problem, case) the last observation and
    the first time; in update mode for ``deltas.sink``. ``slow_checkers_now`` reads it."""
    rec = obs.where(F.col("timeout") | (F.col("elapsed_s") > K.CHECKER_TIMEOUT_S))
    return rec.groupBy("problem_id", "case_stem").agg(
        F.max(F.struct("seen_at", "seq", "timeout", "elapsed_s")).alias("last"), F.min("seen_at").alias("first"))


def slow_checkers_now(spark: SparkSession, base: str, schema) -> DataFrame:
    """A12's columns from S5's deltas: a problem is seen first when its first case is."""
    rows = deltas.latest(spark, base, ["problem_id", "case_stem"], schema)
    first = rows.groupBy("problem_id").agg(F.min("first").alias("first_seen"))
    last = F.col("last")
    return rows.join(first, "problem_id").select(
        "problem_id", "case_stem", F.when(last.timeout, F.lit("timeout")).otherwise(F.lit("slow")).alias("status"),
        F.when(last.timeout, F.lit(">10s")).otherwise(F.concat(fixed_text(last.elapsed_s, 2), F.lit("s"))).alias("time"),
        last.seen_at.alias("last_seen"), "first_seen")


# --------------------------------------------------------------------------
# S6 registry changes as a log of deltas
# --------------------------------------------------------------------------

def registry_now(spark: SparkSession, base: str) -> DataFrame:
    """The registry after all batches written so far: the snapshot with the later changes folded in."""
    snap, rows = deltas.read(spark, base, CH.CHANGE, CH.TABLE)
    return CH.apply_changes(snap, CH.fold_changes(rows, ("batch", "seq")))


def stream_registry_changes(changes: DataFrame, base: str, initial: DataFrame, checkpoint: str,
                            compact_every: int = deltas.COMPACT_EVERY) -> StreamingQuery:
    """A stream of upserts, patches and deletes (columns of ``changes.CHANGE``, ``seq`` unique per id and
    batch). A batch writes its own changes and nothing else; every ``compact_every`` batches the log is
    folded into a snapshot. ``initial`` is the table before the first batch. Batches count in
    their order, changes of one batch by ``seq``."""
    spark = changes.sparkSession
    first = f"{base}/snapshot/upto=-1"
    if deltas.state_of(spark, base)[0] is None:
        initial.select(*[F.col(f.name).cast(f.dataType) for f in T.StructType.fromDDL(CH.TABLE)]).write.mode("overwrite").parquet(first)

    def apply(batch: DataFrame, batch_id: int) -> None:
        if deltas.append(batch, batch_id, base) and len(deltas.state_of(spark, base)[1]) >= compact_every:
            deltas.compact(spark, base, lambda: registry_now(spark, base))

    cols = [F.col(f.name).cast(f.dataType) for f in T.StructType.fromDDL(CH.CHANGE)]
    return (changes.select(*cols).writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def stream_registry_upsert(changes: DataFrame, base: str, initial: DataFrame, checkpoint: str) -> StreamingQuery:
    """S6 for upserts alone (M1's columns); ``registry_now`` reads the table."""
    return stream_registry_changes(changes.withColumn("op", F.lit(CH.UPSERT)).withColumn("checker_set", F.lit(False)), base, initial, checkpoint)
