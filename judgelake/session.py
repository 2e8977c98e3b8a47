"""Spark session defaults and the shared checkpoint folder."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import judgelake

# Tasks carry the package's functions and classes by value: executors need no copy of it.
cloudpickle.register_pickle_by_value(judgelake)

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str = "local[8]", shuffle_partitions: int = 8,
                app: str = "judgelake", extra: dict | None = None) -> SparkSession:
    """Session for local runs and tests. On a cluster the submitter's
    settings win: ``getOrCreate`` returns the existing session."""
    builder = SparkSession.builder.master(master).appName(app)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this is set by whoever submits the job and points at
    storage every executor sees. Only when it is unset (local tests) do we
    make a scratch folder of our own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="judgelake-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder, for written tables
    that cut lineage (state tables, versioned outputs)."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back, for frames that
    several branches of a plan use."""
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, max_rows: int = 20_000) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``max_rows`` rows, which is counted; else as it is. For the
    parameter-like side of a join, whose size Spark does not know when it comes from local rows."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder that this package wrote below the shared folder and that nothing to come reads."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished steps: it follows the collectors of both sides."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
