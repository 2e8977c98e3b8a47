"""Sources and sinks: candidate scans (SRC1), directory scans with lineage
(SRC2), scorer result files (SRC5 / SNK1), skip-existing (SNK3) and the rejects
store (SNK4). Tolerant scans (SRC3) are in ``tolerant``, appends (SNK2) in ``generations``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from judgelake import constants as K
from judgelake.operators.ordered import running_sum
from judgelake.sources.generations import append_widening  # noqa: F401  # SNK2
from judgelake.sources.tolerant import scan_tolerant  # noqa: F401  # SRC3

SUB_LIST = T.ArrayType(T.StructType([T.StructField("language", T.StringType()),
                                     T.StructField("code", T.StringType())]))
TEST_CASES = T.ArrayType(T.StructType([T.StructField("input", T.StringType()),
                                       T.StructField("output", T.StringType())]))

CANDIDATE_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("test_cases", TEST_CASES),
    T.StructField("incorrect_submissions", SUB_LIST),
    T.StructField("correct_submissions", SUB_LIST),
    T.StructField("description", T.StringType()),
    T.StructField("true_positive_rate", T.DoubleType()),
    T.StructField("true_negative_rate", T.DoubleType()),
    T.StructField("checker", T.StringType()),
    T.StructField("time_limit", T.IntegerType()),
    T.StructField("memory_limit", T.IntegerType()),
])
SINGLE_COLUMNS = ["id", "test_cases", "incorrect_submissions", "correct_submissions", "description",
                  "true_positive_rate", "true_negative_rate", "checker"]
MULTI_COLUMNS = SINGLE_COLUMNS + ["time_limit", "memory_limit"]


# --------------------------------------------------------------------------
# SRC1, SRC2 parquet scans
# --------------------------------------------------------------------------

def scan_candidates(spark: SparkSession, path: str, multi: bool = False) -> DataFrame:
    """SRC1: explicit schema (never inferred), the 8 or 10 named columns,
    and the eligibility predicate; the scalar parts of the predicate reach
    the parquet reader as pushed filters."""
    from judgelake.operators.curate import eligible_problems
    cols = MULTI_COLUMNS if multi else SINGLE_COLUMNS
    schema = T.StructType([f for f in CANDIDATE_SCHEMA.fields if f.name in cols])
    return eligible_problems(spark.read.schema(schema).parquet(path).select(*cols))


def scan_dir_lineage(spark: SparkSession, directory: str, suffix: str = ".parquet",
                     rename_from: str | None = None, rename_to: str | None = None,
                     schema: T.StructType | None = None) -> DataFrame:
    """SRC2: every ``*<suffix>`` file of a directory, with the file each
    row came from and the output name derived from it."""
    r = spark.read.option("pathGlobFilter", f"*{suffix}")
    if schema is not None:
        r = r.schema(schema)
    df = r.parquet(directory)
    df = df.withColumn("source_file", F.col("_metadata.file_name"))
    if rename_from is not None:
        df = df.withColumn("output_file", F.regexp_replace("source_file", rename_from + "$", rename_to or ""))
    return df


# --------------------------------------------------------------------------
# SRC5 / SNK1 scorer result lines
# --------------------------------------------------------------------------

RESULT_FIELDS = ["testIndex", "testset", "group", "verdict", "points", "timeConsumed", "memoryConsumed",
                 "input", "output", "answer", "exitCode", "checkerComment"]
_BS, _SC = "\u0001", "\u0002"   # placeholders for escaped backslash / semicolon


def _escape(c):
    s = F.replace(c, F.lit("\r"), F.lit(""))
    s = F.replace(s, F.lit("\\"), F.lit("\\\\"))
    s = F.replace(s, F.lit("\n"), F.lit("\\n"))
    return F.replace(s, F.lit(";"), F.lit("\\;"))


def export_test_results(df: DataFrame) -> DataFrame:
    """SNK1: one line per result: 12 fields joined by ';', text fields with
    '\\r' dropped and '\\\\', newline, ';' escaped; points as %.3f, absent
    points as an empty field."""
    from judgelake.functions.text import fixed_text
    pts = F.when(F.col("points").isNull() | F.isnan("points"), F.lit("")).otherwise(
        F.when(F.col("points") < 0, F.concat(F.lit("-"), fixed_text(-F.col("points"), 3)))
         .otherwise(fixed_text(F.col("points"), 3)))
    parts = [F.col("testIndex").cast("string"), _escape(F.col("testset")), _escape(F.col("group")),
             F.col("verdict"), pts, F.col("timeConsumed").cast("string"),
             F.col("memoryConsumed").cast("string"), _escape(F.col("input")), _escape(F.col("output")),
             _escape(F.col("answer")), F.col("exitCode").cast("string"), _escape(F.col("checkerComment"))]
    return df.select(F.concat_ws(";", *parts).alias("value"))


def _held(df: DataFrame, name: str, value, *keep: str) -> DataFrame:
    """The columns ``keep`` of ``df`` and ``value`` as ``name``, computed once per row: filters are not pushed
    through a generator, where through a projection each takes a copy of the whole expression along."""
    return df.select(*keep, F.explode(F.array(value)).alias(name))


def parse_test_result_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SRC5 body: (good, bad) from a frame of ``value`` lines. A line of
    another number of fields, an unknown verdict or a field that is no
    number where one is due is bad. A line is made once and split once: the tests read its parts from a column."""
    v = _held(lines, "value", F.col("value")).where(F.col("value") != "")
    masked = F.replace(F.replace("value", F.lit("\\\\"), F.lit(_BS)), F.lit("\\;"), F.lit(_SC))
    unmarked = ~F.col("value").contains(_BS) & ~F.col("value").contains(_SC)
    whole = "^[+-]?[0-9]+\\z"

    def restore(c):
        c = F.replace(F.replace(c, F.lit(_SC), F.lit(";")), F.lit("\\n"), F.lit("\n"))
        return F.replace(c, F.lit(_BS), F.lit("\\"))

    x, i = _held(v, "_items", F.split(masked, ";", -1), "value"), F.col("_items")
    f = {n: F.get(i, k) for k, n in enumerate(RESULT_FIELDS)}
    cast = {"testIndex": "int", "points": "double", "timeConsumed": "bigint", "memoryConsumed": "bigint", "exitCode": "int"}
    ok = (F.size(i) == 12) & unmarked & f["verdict"].isin(K.TEST_RESULT_VERDICTS)
    for n, t in cast.items():
        number = f[n].try_cast(t).isNotNull()
        ok = ok & ((f[n] == "") | number if n == "points" else f[n].rlike(whole) & number)
    fields = [(F.when(f[n] != "", f[n].try_cast(t)) if n == "points" else f[n].try_cast(t)) if (t := cast.get(n))
              else f[n] if n == "verdict" else restore(f[n]) for n in RESULT_FIELDS]
    ok = F.coalesce(ok, F.lit(False))
    return x.where(ok).select(*[c.alias(n) for c, n in zip(fields, RESULT_FIELDS)]), x.where(~ok).select("value", F.size(i).alias("n_items"))


def ingest_test_results(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """SRC5: bulk-load result files (text, one result per line)."""
    return parse_test_result_lines(spark.read.text(path))


# --------------------------------------------------------------------------
# SNK3 skip existing, SNK4
# --------------------------------------------------------------------------

def write_versioned(df: DataFrame, base: str, version: int, mode: str = "errorifexists") -> str:
    """Write one immutable version (``<base>/v=<n>``) instead of rewriting
    in place, so concurrent readers and retried jobs never see half a file."""
    path = f"{base.rstrip('/')}/v={version}"
    df.write.mode(mode).option("compression", "zstd").parquet(path)
    return path


def skip_existing_output(files: DataFrame, done: DataFrame) -> DataFrame:
    """SNK3: drop inputs whose output already exists (anti join on name)."""
    return files.join(done.select("output_file").distinct(), "output_file", "left_anti")


def write_rejects(failed: DataFrame) -> DataFrame:
    """SNK4: failing codes numbered 1..n per problem in list order, with
    where and how they failed."""
    numbered = running_sum(failed, ["problem_id"], ["pos"], F.lit(1), "_before_it")
    return numbered.withColumn("reject_no", (F.col("_before_it") + 1).cast("int")).drop("_before_it")


def output_sizes(spark: SparkSession, directory: str, suffix: str = ".parquet") -> DataFrame:
    """output_file, bytes of the files of an output folder, and their TOTAL; read from the listing, not the files."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(directory)
             .select(F.element_at(F.split("path", "/"), -1).alias("output_file"), F.col("length").alias("bytes")))
    r = files.rollup("output_file").agg(F.sum("bytes").alias("bytes"), F.grouping("output_file").alias("_g"))
    return r.select(F.when(F.col("_g") == 1, F.lit("TOTAL")).otherwise(F.col("output_file")).alias("output_file"),
                    F.coalesce("bytes", F.lit(0)).cast("bigint").alias("bytes"))
