"""SRC3: damaged files and row groups; SNK2: appends of widening nested types."""

import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from judgelake.session import scratch_path
from judgelake.sources import generations as GENS
from judgelake.sources import tolerant as TOL
from pyspark.sql import functions as F
from pyspark.sql import types as T


@pytest.fixture
def folder(spark, tmp_path):
    def put(name, rows, size):
        pq.write_table(pa.table({"id": pa.array(range(rows), pa.int32()), "name": pa.array([f"{name}-{k:06d}" * 5 for k in range(rows)], pa.string())}),
                       tmp_path / f"{name}.parquet", row_group_size=size, compression="snappy", use_dictionary=False)
    put("good", 30, 10)
    put("empty", 0, 10)
    put("torn", 3000, 1000)
    put("footer", 50, 10)
    meta = pq.read_metadata(tmp_path / "torn.parquet")
    at = meta.row_group(1).column(1).data_page_offset
    data = bytearray((tmp_path / "torn.parquet").read_bytes())
    data[at:at + 4000] = b"\xff" * 4000
    (tmp_path / "torn.parquet").write_bytes(data)
    data = bytearray((tmp_path / "footer.parquet").read_bytes())
    size = int.from_bytes(data[-8:-4], "little")
    data[-8 - size:-8] = b"\xee" * size
    (tmp_path / "footer.parquet").write_bytes(data)
    (tmp_path / "text.parquet").write_text("this is not a parquet file")
    (tmp_path / "short.parquet").write_bytes(b"PAR1")
    (tmp_path / "long.parquet").write_bytes(b"PAR1" + b"x" * 20 + (10 ** 6).to_bytes(4, "little") + b"PAR1")
    (tmp_path / "_hidden.parquet").write_text("x")
    (tmp_path / "other.txt").write_text("x")
    return str(tmp_path)


def name_of(path):
    return path.rsplit("/", 1)[-1]


def test_damage_is_reported_and_the_rest_kept(spark, folder):
    rows, skipped = TOL.scan_tolerant(spark, folder, T.StructType.fromDDL("id long, name string, absent double"))
    got = rows.groupBy("source_file").agg(F.count("*").alias("n"), F.sum("id").alias("s"), F.count("absent").alias("a")).collect()
    assert {name_of(r.source_file): (r.n, r.s, r.a) for r in got} == {
        "good.parquet": (30, sum(range(30)), 0), "torn.parquet": (2000, sum(range(1000)) + sum(range(2000, 3000)), 0)}
    bad = {name_of(r.source_file): (r.row_group, r.n_rows, r.reason.split(":")[0]) for r in skipped.collect()}
    assert bad == {"torn.parquet": (1, 1000, "row group cannot be read"), "footer.parquet": (None, None, "footer cannot be read"),
                   "text.parquet": (None, None, "not a Parquet file"), "short.parquet": (None, None, "not a Parquet file"),
                   "long.parquet": (None, None, "footer longer than the file")}


def test_listing_reads_eight_bytes_a_file(tmp_path):
    (tmp_path / "big.parquet").write_bytes(b"PAR1" + b"\0" * 10 ** 6 + (500).to_bytes(4, "little") + b"PAR1")
    read = []

    class Counted:
        def __init__(self, f):
            self.f = f

        def size(self):
            return self.f.size()

        def seek(self, n):
            return self.f.seek(n)

        def read(self, n):
            read.append(n)
            return self.f.read(n)
    reader = TOL.TolerantReader(T.StructType([T.StructField("source_file", T.StringType()), T.StructField("length", T.LongType()),
                                              T.StructField("reason", T.StringType())]), [], "files", None)
    real = TOL._opened
    TOL._opened = lambda uri: Counted(real(uri))
    try:
        out = list(reader.read(TOL.FileAt(str(tmp_path / "big.parquet"), 1)))
    finally:
        TOL._opened = real
    assert read == [8] and out[0].to_pylist()[0]["reason"] is None


def test_schema_of_the_first_readable_file(spark, folder):
    rows, _ = TOL.scan_tolerant(spark, folder)
    assert rows.columns == ["id", "name", "source_file"] and rows.count() == 2030


TYPES = [("byte", "int", "int"), ("int", "long", "bigint"), ("long", "float", "double"), ("short", "float", "float"), ("int", "decimal(5,2)", "decimal(12,2)"),
         ("decimal(10,4)", "decimal(12,1)", "decimal(15,4)"), ("int", "string", "string"), ("date", "timestamp", "timestamp"),
         ("array<int>", "array<long>", "array<bigint>"), ("map<string,int>", "map<string,double>", "map<string,double>"),
         ("struct<a:int,b:string>", "struct<c:date,a:long>", "struct<a:bigint,b:string,c:date>"),
         ("array<struct<a:int,b:array<struct<x:int>>>>", "array<struct<b:array<struct<x:double,y:int>>>>",
          "array<struct<a:int,b:array<struct<x:double,y:int>>>>")]


@pytest.mark.parametrize("a,b,want", TYPES)
def test_common_types(spark, a, b, want):
    x, y = (T.StructType.fromDDL(f"c {t}")["c"].dataType for t in (a, b))
    assert GENS.common_type(x, y).simpleString() == want
    assert T.StructType([T.StructField("c", GENS.common_type(y, x))])  # some order of fields, the same fields
    assert GENS.common_type(x, T.NullType()) == x == GENS.common_type(T.NullType(), x)


def test_no_common_type(spark):
    for a, b in (("int", "array<int>"), ("boolean", "int"), ("struct<a:int>", "string"), ("decimal(38,0)", "decimal(38,10)"), ("date", "int")):
        x, y = (T.StructType.fromDDL(f"c {t}")["c"].dataType for t in (a, b))
        with pytest.raises(TypeError):
            GENS.common_type(x, y)


def test_generations_of_nested_lists_read_as_one(spark):
    base = scratch_path(spark, f"test-generations-{random.random()}")
    one = spark.createDataFrame([(1, [(1, "x"), None]), (2, None)], "id int, tests array<struct<no:int,name:string>>")
    two = spark.createDataFrame([(3_000_000_000, [(1.5, [(7,)], 2 ** 40)], "s")],
                                "id long, tests array<struct<ms:double,sub:array<struct<k:int>>,no:long>>, status string")
    assert GENS.append_generation(one, base) == 0
    before = {f: open(f, "rb").read() for f in (p.removeprefix("file:") for p in spark.read.parquet(f"{base}/delta/batch=0").inputFiles())}
    assert GENS.append_generation(two, base) == 1
    assert all(open(f, "rb").read() == data for f, data in before.items())  # nothing is rewritten
    spark.createDataFrame([("z",)], "id string").write.parquet(f"{base}/delta/batch=2")
    from judgelake.streaming.deltas import _folder
    fs, p = _folder(spark, f"{base}/delta/batch=2/_SUCCESS")
    fs.delete(p, False)  # an append that did not end
    got = GENS.read_generations(spark, base)
    assert got.schema["id"].dataType == T.LongType()
    rows = {r.id: (r.asDict(True)["tests"], r.status) for r in got.collect()}
    assert rows == {1: ([dict(no=1, name="x", ms=None, sub=None), None], None), 2: (None, None),
                    3_000_000_000: ([dict(no=2 ** 40, name=None, ms=1.5, sub=[{"k": 7}])], "s")}
