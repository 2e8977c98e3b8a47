"""Tables kept as deltas: a streaming query appends what one micro-batch
changed, readers put the changes together, and compaction folds them now and
then. What a batch writes follows the batch, not the table.

Layout under ``base``: ``delta/batch=<id>`` holds one micro-batch's rows and
``snapshot/upto=<id>`` the table after all batches up to that one. A folder
counts once its ``_SUCCESS`` is there, so a stopped write is never read, and a
replayed batch replaces its own folder.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Deltas after which the sinks compact.
COMPACT_EVERY = 16


def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _numbers(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """The numbers of the finished sub-folders ``<prefix>=<number>``, ascending."""
    fs, p = _folder(spark, path)
    if not fs.exists(p):
        return []
    out = []
    for s in fs.listStatus(p):
        name = s.getPath().getName()
        if name.startswith(f"{prefix}=") and fs.exists(_folder(spark, f"{path}/{name}/_SUCCESS")[1]):
            out.append(int(name.split("=")[1]))
    return sorted(out)


def state_of(spark: SparkSession, base: str) -> tuple[int | None, list[int]]:
    """(the newest snapshot's batch or None, the later finished batches)."""
    snaps = _numbers(spark, f"{base}/snapshot", "upto")
    upto = snaps[-1] if snaps else None
    return upto, [b for b in _numbers(spark, f"{base}/delta", "batch") if upto is None or b > upto]


def append(rows: DataFrame, batch_id: int, base: str) -> bool:
    """Write one batch's rows; False if a snapshot holds them already."""
    upto, _ = state_of(rows.sparkSession, base)
    if upto is not None and batch_id <= upto:
        return False
    rows.write.mode("overwrite").parquet(f"{base}/delta/batch={batch_id}")
    return True


def read(spark: SparkSession, base: str, schema, snapshot_schema=None) -> tuple[DataFrame, DataFrame]:
    """(snapshot, deltas): the newest snapshot and the rows since, with their ``batch``. Either may be empty."""
    upto, batches = state_of(spark, base)
    snapshot_schema = snapshot_schema or schema
    snap = (spark.createDataFrame([], snapshot_schema) if upto is None
            else spark.read.schema(snapshot_schema).parquet(f"{base}/snapshot/upto={upto}"))
    if not batches:
        return snap, spark.createDataFrame([], schema).withColumn("batch", F.lit(0).cast("bigint"))
    rows = (spark.read.schema(schema).option("basePath", f"{base}/delta")
            .parquet(*[f"{base}/delta/batch={b}" for b in batches]))
    return snap, rows.withColumn("batch", F.col("batch").cast("bigint"))


def latest(spark: SparkSession, base: str, keys: Sequence[str], schema) -> DataFrame:
    """The table whose deltas are new values of whole rows: per key the row of the last batch."""
    snap, rows = read(spark, base, schema)
    rest = [c for c in snap.columns if c not in keys]
    both = snap.withColumn("batch", F.lit(-1).cast("bigint")).unionByName(rows)
    last = F.max_by(F.struct(*rest), "batch").alias("_last")
    return both.groupBy(*keys).agg(last).select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest])


def compact(spark: SparkSession, base: str, table: Callable[[], DataFrame]) -> int | None:
    """Write ``table()``, what readers see now, as the snapshot of the last batch. Its number, or None."""
    _, batches = state_of(spark, base)
    if not batches:
        return None
    table().write.mode("overwrite").parquet(f"{base}/snapshot/upto={batches[-1]}")
    return batches[-1]


def vacuum(spark: SparkSession, base: str) -> list[str]:
    """Delete the deltas and snapshots that the newest snapshot replaces, once no reader uses them."""
    upto, _ = state_of(spark, base)
    gone = []
    if upto is not None:
        old = [f"{base}/delta/batch={b}" for b in _numbers(spark, f"{base}/delta", "batch") if b <= upto]
        old += [f"{base}/snapshot/upto={s}" for s in _numbers(spark, f"{base}/snapshot", "upto") if s < upto]
        for path in old:
            fs, p = _folder(spark, path)
            fs.delete(p, True)
            gone.append(path)
    return gone


def sink(base: str, keys: Sequence[str], schema, compact_every: int = COMPACT_EVERY) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function for a query in update mode: its rows are the keys that changed."""
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if append(batch, batch_id, base) and len(state_of(spark, base)[1]) >= compact_every:
            compact(spark, base, lambda: latest(spark, base, keys, schema))
    return write
