"""SRC3: Parquet files read one by one, so that what cannot be read is
reported and the rest is kept: a Python data source with a partition per file
that looks at the file's end, its footer and each row group."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

FILE_REPORT = "source_file string, length long, reason string"
GROUP_REPORT = "source_file string, row_group long, n_rows long, reason string"
#: A file ends with its footer's length in four bytes and this mark; the shortest has it at both ends.
MARK, SHORTEST = b"PAR1", 12


class FileAt(InputPartition):
    def __init__(self, uri: str, length: int):
        super().__init__((uri, length))
        self.uri, self.length = uri, length


def _opened(uri: str):
    """A file under any address that Arrow knows (local, HDFS, object stores)."""
    system, path = pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri.removeprefix("file:"))
    return system.open_input_file(path)


def end_fault(length: int, end: bytes) -> str | None:
    """What is wrong with a file by its last eight bytes, None if nothing is."""
    if length < SHORTEST or end[4:] != MARK:
        return "not a Parquet file"
    if int.from_bytes(end[:4], "little") > length - SHORTEST:
        return "footer longer than the file"
    return None


def _as_schema(batch: pa.Table, schema: pa.Schema) -> pa.Table:
    """The columns of ``schema`` by name; absent ones are null."""
    cols = [batch.column(f.name).cast(f.type) if f.name in batch.column_names else pa.nulls(len(batch), f.type) for f in schema]
    return pa.Table.from_arrays(cols, schema=schema)


class TolerantReader(DataSourceReader):
    def __init__(self, schema: T.StructType, files: list, what: str, wanted: T.StructType | None):
        self.out, self.files, self.what, self.wanted = schema, files, what, wanted

    def partitions(self):
        return [FileAt(u, n) for u, n in self.files]

    def read(self, partition: FileAt) -> Iterator[pa.RecordBatch]:
        report = [] if self.what != "rows" else None
        try:
            source = _opened(partition.uri)
            size = source.size()
            source.seek(max(0, size - 8))
            fault = end_fault(size, source.read(8))
        except OSError as e:
            source, size, fault = None, partition.length, f"cannot be opened: {type(e).__name__}"
        if self.what == "files":
            report.append((partition.uri, size, fault))
        elif fault is None:
            yield from self._groups(partition.uri, source, report)
        if report:
            schema = to_arrow_schema(self.out)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*report), schema)], schema=schema)

    def _groups(self, uri: str, source, report: list | None) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(self.wanted)
        try:
            file = pq.ParquetFile(source)
            have = [f.name for f in schema if f.name in file.schema_arrow.names]
        except Exception as e:  # noqa: BLE001  # whatever the decoder raises is what is reported
            if report is not None:
                report.append((uri, None, None, f"footer cannot be read: {type(e).__name__}"))
            return
        for g in range(file.num_row_groups):
            try:
                # whole groups only: a group that breaks off half way gives no rows
                rows = _as_schema(file.read_row_group(g, columns=have), schema)
            except Exception as e:  # noqa: BLE001
                if report is not None:
                    report.append((uri, g, file.metadata.row_group(g).num_rows, f"row group cannot be read: {type(e).__name__}"))
                continue
            if report is None:
                rows = rows.append_column("source_file", pa.array([uri] * len(rows), pa.string()))
                yield from rows.combine_chunks().to_batches(max_chunksize=1024)


class TolerantParquet(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tolerant_parquet"

    def schema(self) -> T.StructType | str:
        what = self.options["what"]
        if what == "rows":
            return T.StructType.fromJson(json.loads(self.options["wanted"])).add("source_file", "string")
        return FILE_REPORT if what == "files" else GROUP_REPORT

    def reader(self, schema: T.StructType) -> DataSourceReader:
        wanted = self.options.get("wanted")
        return TolerantReader(schema, json.loads(self.options["files"]), self.options["what"],
                              T.StructType.fromJson(json.loads(wanted)) if wanted else None)


def list_files(spark: SparkSession, directory: str, suffix: str = ".parquet") -> list[tuple[str, int]]:
    """(address, length) of the files of a directory, as the file system lists them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(directory)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return sorted((s.getPath().toString(), s.getLen()) for s in found
                  if s.isFile() and s.getPath().getName().endswith(suffix) and s.getPath().getName()[0] not in "._")


def scan_tolerant(spark: SparkSession, directory: str, schema: T.StructType | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows with ``source_file``, skipped: source_file, row_group, n_rows, reason).

    Rows come from every row group that decodes. ``skipped`` names each file that is none (told from
    its last eight bytes), each footer and each row group that cannot be decoded; n_rows is what the footer
    says of it. Without a schema that of the first readable file is taken. A valid file without rows is not reported."""
    spark.dataSource.register(TolerantParquet)
    files = list_files(spark, directory)

    def load(what: str, listed, wanted=None) -> DataFrame:
        r = spark.read.format("tolerant_parquet").option("what", what).option("files", json.dumps(listed))
        return (r.option("wanted", json.dumps(wanted.jsonValue())) if wanted else r).load()
    ends = load("files", files)
    if schema is None:
        good = sorted(r[0] for r in ends.where("reason IS NULL").select("source_file").collect())  # one row per file
        for uri in good:
            try:
                schema = spark.read.parquet(uri).schema
                break
            except Exception:  # noqa: BLE001  # a broken footer, which the report will name
                continue
        if schema is None:
            raise ValueError(f"no readable Parquet file in {directory}")
    rows = load("rows", files, schema)
    bad = ends.where("reason IS NOT NULL").select("source_file", F.lit(None).cast("long").alias("row_group"),
                                                  F.lit(None).cast("long").alias("n_rows"), "reason")
    return rows, bad.unionByName(load("groups", files, schema))
