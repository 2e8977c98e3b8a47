"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import judgelake.llm
from judgelake.session import release, scratch_path  # noqa: F401

# Tasks carry this package's functions with them: executors need no copy of it.
cloudpickle.register_pickle_by_value(judgelake.llm)

#: Rows per Arrow batch when whole texts go to Python. A batch of very long
#: texts stays small enough for a worker beside its executor.
TEXT_BATCH_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back: lineage
    ends at files that every executor can read, so a lost executor costs only
    its running tasks."""
    spark = df.sparkSession
    path = scratch_path(spark, f"llm/{name}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def discard(table: DataFrame) -> None:
    """Delete what ``cut`` wrote. Only for tables that nothing to come reads: a lost executor's tasks
    are computed from the tables that replaced it."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table.cut_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_batches(spark: SparkSession, rows: int = TEXT_BATCH_ROWS) -> None:
    """Bound the Arrow batches that carry whole texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``mapInArrow`` over single batches; ``fn`` may return None for no rows."""
    text_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                out = fn(b)
                if out is not None:
                    yield out

    return df.mapInArrow(run, schema)


def crc_mod(col, m: int):
    """crc32 of the id's decimal text, modulo ``m``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.encode(F.coalesce(col.cast("string"), F.lit("")), "UTF-8")), F.lit(m))


def tree_merge(tables: DataFrame, merge: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
               finish: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None,
               fan_in: int = 16) -> bytes | None:
    """Merge the one-row tables (z binary) of all tasks by a tree of tasks with at most
    ``fan_in`` inputs each; the driver gets the one left, after ``finish``, or None if there is none."""
    parts = tables.rdd.getNumPartitions()
    while parts > 1:
        parts = -(-parts // fan_in)
        tables = tables.repartition(parts).mapInArrow(merge, "z binary")
    row = (tables.mapInArrow(finish, "z binary") if finish else tables).first()
    return None if row is None else row["z"]


def one_row(data: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["z"])


def hash_filter(hashes: DataFrame, bits: int) -> np.ndarray:
    """2**bits bits, packed: set at the upper bits of every value of the long column of
    ``hashes``. The size is the same at any input; ``in_filter`` has false positives only."""
    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(1 << (bits - 3), np.uint8)
        for b in batches:
            at = np.unique(b.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
            np.bitwise_or.at(own, at >> 3, (128 >> (at & 7)).astype(np.uint8))
        yield one_row(zstandard.compress(own.tobytes()))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(1 << (bits - 3), np.uint8)
        for b in batches:
            for z in b.column(0):
                own |= np.frombuffer(zstandard.decompress(z.as_py()), np.uint8)
        yield one_row(zstandard.compress(own.tobytes()))

    z = tree_merge(hashes.mapInArrow(fill, "z binary"), merge)
    return np.zeros(1 << (bits - 3), np.uint8) if z is None else np.frombuffer(zstandard.decompress(z), np.uint8)


def in_filter(packed: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the unsigned ``hashes`` the filter lets through."""
    bits = len(packed).bit_length() + 2
    at = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    return (packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def row_key(id_col: str, text_col: str):
    """One long for a row's id and text, nulls included: repeated rows have equal keys."""
    return F.xxhash64(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string"))


def cogrouped(left: DataFrame, right: DataFrame, key: str, fn, schema: str) -> DataFrame:
    """``applyInPandas`` over the rows of both sides with equal ``key`` (long). The key is made
    anew on both, as frames of one origin would share its column."""
    sides = [df.withColumn(key, F.col(key) + F.lit(0)) for df in (left, right)]
    return sides[0].groupBy(key).cogroup(sides[1].groupBy(key)).applyInPandas(fn, schema)


def share(spark: SparkSession, value) -> Callable:
    """A broadcast of ``value`` as a function that gives it in tasks. It travels with the definitions of
    this package's classes, so a worker without the package can read it."""
    box, held = spark.sparkContext.broadcast(cloudpickle.dumps(value)), []

    def get():
        if not held:
            held.append(cloudpickle.loads(box.value))
        return held[0]
    return get
