"""Run verdicts in bulk: one rule chain per run row, retry resolution per
(submission, case), checker outcome decoding and domain checks.

Every function here is narrow (per-row column expressions) except the retry
resolvers, which are one aggregate on their key with a bounded list.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from judgelake import constants as K
from judgelake.functions.text import output_equal


def _col_or(df: DataFrame, name: str, default: Column) -> Column:
    return F.col(name) if name in df.columns else default


def checker_message(stderr: Column, stdout: Column) -> Column:
    """stderr unless empty, else stdout; cut to 500 characters."""
    msg = F.when(F.coalesce(stderr, F.lit("")) != "", stderr).otherwise(F.coalesce(stdout, F.lit("")))
    return F.substring(msg, 1, K.CUT_CHECKER)


def checker_outcome(df: DataFrame, exit_col: str = "checker_exit",
                    elapsed_col: str = "checker_elapsed_s", stem_col: str = "stem") -> DataFrame:
    """V3: checker exit 0 -> Accepted, any other code -> Wrong Answer with
    the checker's text; a run past the 10 s timeout, or one without an exit
    code (the checker did not run) -> System Error."""
    timeout = _col_or(df, elapsed_col, F.lit(None).cast("double")) > K.CHECKER_TIMEOUT_S
    ex = F.col(exit_col)
    status = (F.when(F.coalesce(timeout, F.lit(False)), F.lit(K.SYSTEM_ERROR))
               .when(ex == 0, F.lit(K.ACCEPTED))
               .when(ex.isNull(), F.lit(K.SYSTEM_ERROR))
               .otherwise(F.lit(K.WRONG_ANSWER)))
    message = (F.when(F.coalesce(timeout, F.lit(False)),
                      F.format_string(K.MSG_CHECKER_TIMEOUT, F.col(stem_col)))
                .when(ex == 0, F.lit(""))
                .otherwise(checker_message(_col_or(df, "checker_stderr", F.lit("")),
                                           _col_or(df, "checker_stdout", F.lit("")))))
    return df.withColumn("checker_status", status).withColumn("checker_message", message)


def case_verdict(runs: DataFrame) -> DataFrame:
    """V1: ordered rules on one run row.

    error -> SE; killed past limit + 500 ms -> TLE (time = limit); exit <> 0
    -> RE (before the elapsed test); elapsed > limit -> TLE; output over
    10 MiB -> RE; checker (V3) or output compare (V2) -> AC / WA.
    Output comparison uses ``output_ok`` if present, else (``output``, ``expected``)."""
    elapsed = F.col("elapsed_ms")
    limit = F.col("time_limit")
    killed = _col_or(runs, "killed", elapsed > limit + K.KILL_GRACE_MS)
    error = _col_or(runs, "error", F.lit(None).cast("string"))
    size = _col_or(runs, "output_bytes", F.lit(0).cast("bigint"))
    has_checker = F.coalesce(_col_or(runs, "has_checker", F.lit(False)), F.lit(False))
    if "output_ok" in runs.columns:
        same = F.coalesce(F.col("output_ok"), F.lit(False))
    else:
        same = output_equal(F.col("output"), F.col("expected"))
    df = runs
    if "checker_exit" in runs.columns:
        df = checker_outcome(runs)
        chk_status, chk_msg = F.col("checker_status"), F.col("checker_message")
    else:
        chk_status, chk_msg = F.lit(K.SYSTEM_ERROR), F.lit("checker result missing")
    def v(s, t, m):
        return F.struct(s.alias("s"), t.cast("bigint").alias("t"), m.alias("m"))

    e = elapsed
    rule = (F.when(error.isNotNull(), v(F.lit(K.SYSTEM_ERROR), F.lit(0), error))
             .when(killed, v(F.lit(K.TIME_LIMIT), limit, F.lit("")))
             .when(F.col("exit_code") != 0,
                   v(F.lit(K.RUNTIME_ERROR), e, F.format_string(K.MSG_EXIT_CODE, F.col("exit_code"))))
             .when(e > limit, v(F.lit(K.TIME_LIMIT), e, F.lit("")))
             .when(size > K.MAX_OUTPUT_BYTES,
                   v(F.lit(K.RUNTIME_ERROR), e,
                     F.format_string(K.MSG_OUTPUT_TOO_LARGE, size, F.lit(K.MAX_OUTPUT_BYTES))))
             .when(has_checker, v(chk_status, e, chk_msg))
             .when(same, v(F.lit(K.ACCEPTED), e, F.lit("")))
             .otherwise(v(F.lit(K.WRONG_ANSWER), e, F.lit(""))))
    out = df.withColumn("_v", rule)
    out = out.select(*[c for c in runs.columns],
                     F.col("_v.s").alias("status"), F.col("_v.t").alias("time_used"),
                     F.col("_v.m").alias("message"))
    return out


def retry_resolve(cases: DataFrame, keys: Sequence[str] = ("submission_id", "case_no"),
                  order_col: str = "attempt", status_col: str = "status",
                  retry_classes: Sequence[str] = (K.TIME_LIMIT, K.SYSTEM_ERROR),
                  max_attempts: int = K.CASE_RETRY_MAX) -> DataFrame:
    """Per key keep one attempt.

    If the first attempt's status is a retry class, keep the first attempt
    among the first ``max_attempts`` whose status differs from it, else the
    last of those; otherwise keep the first attempt. So TLE then SE ends at
    SE, and TLE x4 then AC stays TLE.

    One aggregate on ``keys``: rows past ``max_attempts`` are filtered before
    the shuffle, so each key's list holds at most ``max_attempts`` structs.
    """
    keys = list(keys)
    payload = [c for c in cases.columns if c not in keys and c != order_col]
    rows = F.struct(F.col(order_col).alias("_o"), *[F.col(c) for c in payload])
    agg = (cases.where(F.col(order_col) <= max_attempts)
                .groupBy(*keys)
                .agg(F.array_sort(F.collect_list(rows)).alias("_a"),
                     F.count(F.lit(1)).alias("attempts_seen")))
    first = F.col("_a")[0]
    classes = F.array(*[F.lit(c) for c in retry_classes])
    changed = F.filter(F.col("_a"), lambda x: x[status_col] != first[status_col])
    chosen = (F.when(F.array_contains(classes, first[status_col]),
                     F.coalesce(F.get(changed, 0), F.element_at(F.col("_a"), -1)))
               .otherwise(first))
    out = agg.withColumn("_c", chosen)
    return out.select(*keys, *[F.col("_c")[c].alias(c) for c in payload],
                      F.col("_c._o").alias(order_col), "attempts_seen")


def submit_retry_resolve(results: DataFrame, keys: Sequence[str] = ("code_id", "version"),
                         order_col: str = "try_no", max_tries: int = K.SUBMIT_RETRY_MAX) -> DataFrame:
    """Pipeline-level retry: only System Error is retried, 2 tries."""
    return retry_resolve(results, keys=keys, order_col=order_col, status_col="verdict",
                         retry_classes=(K.SYSTEM_ERROR,), max_attempts=max_tries)


# --------------------------------------------------------------------------
# V4 checker outcome detail
# --------------------------------------------------------------------------

_OUTCOME_TEXT = {"ok": "ok", "wa": "wrong answer", "pe": "wrong output format",
                 "fail": "FAIL", "dirt": "wrong output format", "points": "points",
                 "unexpected_eof": "unexpected eof"}
_OUTCOME_STATUS = {"ok": K.ACCEPTED, "points": K.ACCEPTED}


def outcome_dimension(spark: SparkSession, unexpected_eof_enabled: bool = False) -> DataFrame:
    """(dialect, exit_code) -> outcome. A code used by two outcomes decodes
    to the first of ok, wa, pe, fail, dirt, points; dirt is reported as pe.
    Fixed size (a few dozen rows), so it is safe to broadcast."""
    rows = []
    for dialect, codes in K.CHECKER_EXIT.items():
        seen = set()
        table = list(codes.items())
        if unexpected_eof_enabled:
            table.append(("unexpected_eof", K.UNEXPECTED_EOF_EXIT))
        for outcome, code in table:
            if code in seen:
                continue
            seen.add(code)
            reported = "pe" if outcome == "dirt" else outcome
            rows.append((dialect, code, outcome, reported, _OUTCOME_TEXT[outcome]))
    schema = "dialect string, exit_code int, outcome string, reported string, outcome_text string"
    return spark.createDataFrame(rows, schema)


def checker_outcome_detail(df: DataFrame, exit_col: str = "checker_exit", dialect: str = "default",
                           unexpected_eof_enabled: bool = False) -> DataFrame:
    """V4: full decode of a checker exit code under a dialect. Codes at or
    above a non-zero partial base are "partially correct (k)". With base 0
    partial codes overlap the plain ones: an unlisted code is a partial one
    of unknown k (Fail has a code of its own), so pctype stays NULL there."""
    spark = df.sparkSession
    dim = (outcome_dimension(spark, unexpected_eof_enabled)
           .where(F.col("dialect") == dialect).drop("dialect")
           .withColumnRenamed("exit_code", "_dim_code"))
    base = K.PARTIAL_BASE[dialect]
    j = df.join(F.broadcast(dim), F.col(exit_col) == F.col("_dim_code"), "left").drop("_dim_code")
    j = j.withColumn("_partial", F.col("outcome").isNull() & F.coalesce(F.col(exit_col) >= base, F.lit(False)))
    partial = F.col("_partial")
    pctype = F.when(partial & F.lit(base > 0), F.col(exit_col) - base)
    return (j.withColumn("pctype", pctype.cast("int"))
             .withColumn("outcome", F.when(partial, F.lit("partially"))
                         .otherwise(F.coalesce(F.col("outcome"), F.lit("fail"))))
             .withColumn("reported", F.when(partial, F.lit("partially"))
                         .otherwise(F.coalesce(F.col("reported"), F.lit("fail"))))
             .withColumn("outcome_text",
                         F.when(partial & F.lit(base > 0), F.format_string("partially correct (%d)", F.col("pctype")))
                          .when(partial, F.lit("partially correct"))
                          .otherwise(F.coalesce(F.col("outcome_text"), F.lit("FAIL"))))
             .withColumn("judge_status",
                         F.when(F.col("reported") == "ok", F.lit(K.ACCEPTED))
                          .otherwise(F.lit(K.WRONG_ANSWER)))
             .drop("_partial"))


def trailing_output_check(df: DataFrame, outcome_col: str = "outcome",
                          remainder_col: str = "remainder") -> DataFrame:
    """V5: an ok, points or partial result with text other than blanks, tabs
    and line ends left unread in the output becomes "wrong output format:
    Extra information in the output file"."""
    unread = F.coalesce(F.col(remainder_col), F.lit("")).rlike("[^ \\t\\n\\r]")
    dirty = F.col(outcome_col).isin("ok", "points", "partially") & unread
    return (df.withColumn("final_outcome", F.when(dirty, F.lit("pe")).otherwise(F.col(outcome_col)))
              .withColumn("final_message", F.when(dirty, F.lit(K.MSG_EXTRA_OUTPUT))))


# --------------------------------------------------------------------------
# V8 domain check, V9 differential verdict
# --------------------------------------------------------------------------

def status_domain_check(df: DataFrame, status_col: str = "status",
                        language_col: str | None = "language") -> tuple[DataFrame, DataFrame]:
    """V8: (good, bad). The domains are fixed literal sets, so the test is an
    ``IN`` list evaluated in the scan stage: no join, no shuffle."""
    ok_status = F.col(status_col).isin(K.STATUSES)
    ok_lang = F.col(language_col).isin(K.LANGUAGES) if language_col else F.lit(True)
    reason = (F.when(~F.coalesce(ok_status, F.lit(False)), F.lit("unknown status"))
               .when(~F.coalesce(ok_lang, F.lit(False)), F.lit("unknown language")))
    tagged = df.withColumn("reject_reason", reason)
    return (tagged.where(F.col("reject_reason").isNull()).drop("reject_reason"),
            tagged.where(F.col("reject_reason").isNotNull()))


def differential_verdict(user: DataFrame, std: DataFrame, keys: Sequence[str] = ("hack_id",),
                         max_input_bytes: int = K.MAX_INPUT_BYTES) -> tuple[DataFrame, DataFrame]:
    """V9: judge a user run against a standard program's run on the same
    custom input. ``user``: keys, input_bytes, run_status, output,
    has_checker, checker_exit, checker_stderr, checker_stdout, time_used.
    ``std``: keys, std_status, std_output (absent row = no standard).
    Returns (verdicts, rejects) where rejects are inputs over the limit."""
    keys = list(keys)
    too_big = F.col("input_bytes") > max_input_bytes
    rejects = user.where(too_big).select(*keys, "input_bytes",
                                         F.lit("input too large").alias("reject_reason"))
    j = user.where(~too_big).join(std, keys, "left")
    has_std = F.col("std_status").isNotNull()
    out = F.coalesce(F.col("output"), F.lit(""))
    exp = F.coalesce(F.col("std_output"), F.lit(""))
    chk_msg = checker_message(F.col("checker_stderr"), F.col("checker_stdout"))
    late = F.coalesce(_col_or(j, "checker_elapsed_s", F.lit(None).cast("double")) > K.CHECKER_TIMEOUT_S, F.lit(False))
    broken = has_std & F.col("has_checker") & (late | F.col("checker_exit").isNull())
    status = (F.when(F.col("run_status") != K.ACCEPTED, F.col("run_status"))
               .when(has_std & (F.col("std_status") != K.ACCEPTED), F.lit(K.SYSTEM_ERROR))
               .when(broken, F.lit(K.SYSTEM_ERROR))
               .when(has_std & F.col("has_checker"),
                     F.when(F.col("checker_exit") == 0, F.lit(K.ACCEPTED)).otherwise(F.lit(K.WRONG_ANSWER)))
               .when(has_std, F.when(output_equal(F.col("output"), F.col("std_output")), F.lit(K.ACCEPTED))
                     .otherwise(F.lit(K.WRONG_ANSWER)))
               .otherwise(F.lit(K.ACCEPTED)))
    message = (F.when(F.col("run_status") != K.ACCEPTED,
                      F.concat(F.lit("User: "), F.col("run_status"), F.lit("\n"), F.coalesce(F.col("run_message"), F.lit(""))))
                .when(has_std & (F.col("std_status") != K.ACCEPTED), F.concat(F.lit("Std: "), F.col("std_status")))
                .when(has_std & F.col("has_checker"),
                      F.concat(F.lit("User Output:\n"), F.substring(out, 1, K.CUT_PREVIEW_OUTPUT),
                               F.lit("\n\nChecker: "), F.when(F.col("checker_exit") == 0, F.lit("")).otherwise(chk_msg)))
                .when(has_std & (status == K.ACCEPTED),
                      F.concat(F.lit("User Output:\n"), F.substring(out, 1, K.CUT_PREVIEW_OUTPUT)))
                .when(has_std, F.concat(F.lit("User Output:\n"), F.substring(out, 1, K.CUT_PREVIEW_EXPECTED),
                                        F.lit("\n\nExpected:\n"), F.substring(exp, 1, K.CUT_PREVIEW_EXPECTED)))
                .otherwise(F.concat(F.lit("Output:\n"), F.substring(out, 1, K.CUT_PREVIEW_OUTPUT))))
    time_used = F.when(has_std & (F.col("std_status") != K.ACCEPTED) & (F.col("run_status") == K.ACCEPTED),
                       F.lit(0)).otherwise(F.col("time_used"))
    return (j.select(*keys, status.alias("status"), time_used.cast("bigint").alias("time_used"),
                     message.alias("message")), rejects)
