"""Oracle SQL (DuckDB dialect) for the registered queries.

Each entry restates the query's semantics independently of the Spark plan
(windows where Spark aggregates, joins where Spark uses arrays), over the
same parquet views, through the adapter CTEs of ``sources.adapters``.
"""

from __future__ import annotations

from judgelake.sources import adapters as A

SQL: dict[str, str] = {}

# V1 over the run log, as a CTE
JUDGED_SQL = A.RUNS_SQL + """,
judged AS (
  SELECT r.*,
    CASE WHEN error IS NOT NULL THEN 'System Error'
         WHEN killed THEN 'Time Limit Exceeded'
         WHEN exit_code <> 0 THEN 'Runtime Error'
         WHEN elapsed_ms > time_limit THEN 'Time Limit Exceeded'
         WHEN output_bytes > 10485760 THEN 'Runtime Error'
         WHEN has_checker AND checker_elapsed_s > 10 THEN 'System Error'
         WHEN has_checker AND checker_exit = 0 THEN 'Accepted'
         WHEN has_checker THEN 'Wrong Answer'
         WHEN output_ok THEN 'Accepted' ELSE 'Wrong Answer' END AS status,
    CAST(CASE WHEN error IS NOT NULL THEN 0 WHEN killed THEN time_limit ELSE elapsed_ms END AS BIGINT) AS time_used,
    CASE WHEN error IS NOT NULL THEN error
         WHEN killed THEN ''
         WHEN exit_code <> 0 THEN 'Exit code: ' || CAST(exit_code AS VARCHAR)
         WHEN elapsed_ms > time_limit THEN ''
         WHEN output_bytes > 10485760 THEN 'Output too large: ' || CAST(output_bytes AS VARCHAR) || ' bytes (limit: 10485760)'
         WHEN has_checker AND checker_elapsed_s > 10 THEN 'Checker timeout on test ' || stem
         WHEN has_checker AND checker_exit = 0 THEN ''
         WHEN has_checker THEN substr(CASE WHEN coalesce(checker_stderr, '') <> '' THEN checker_stderr
                                           ELSE coalesce(checker_stdout, '') END, 1, 500)
         ELSE '' END AS message
  FROM runs r
)"""

# V10 as first-status + chosen attempt + join back
RESOLVED_SQL = JUDGED_SQL + """,
firsts AS (
  SELECT submission_id, case_no, max(CASE WHEN attempt = 1 THEN status END) AS first_status,
         count(*) AS attempts_seen
  FROM judged WHERE attempt <= 3 GROUP BY submission_id, case_no
),
pick AS (
  SELECT f.submission_id, f.case_no, f.attempts_seen,
         CASE WHEN f.first_status IN ('Time Limit Exceeded', 'System Error')
              THEN coalesce(min(CASE WHEN j.status <> f.first_status THEN j.attempt END), max(j.attempt))
              ELSE min(j.attempt) END AS chosen
  FROM firsts f JOIN judged j ON j.submission_id = f.submission_id AND j.case_no = f.case_no
  WHERE j.attempt <= 3
  GROUP BY f.submission_id, f.case_no, f.first_status, f.attempts_seen
),
resolved AS (
  SELECT j.*, p.attempts_seen
  FROM pick p JOIN judged j ON j.submission_id = p.submission_id AND j.case_no = p.case_no
                           AND j.attempt = p.chosen
)"""

# J1 + A1 by windows
SUBMISSION_RESULT_SQL = RESOLVED_SQL + """,
cases AS (
  SELECT submission_id, case_no, NOT (case_no = 7 AND submission_id % 4 = 0) AS has_expected,
         status, time_used, message,
         row_number() OVER (PARTITION BY submission_id ORDER BY case_no) AS ordinal,
         count(*) OVER (PARTITION BY submission_id) AS total
  FROM resolved
),
firstfail AS (
  SELECT submission_id, min(case_no) AS fail_case FROM cases
  WHERE has_expected AND status <> 'Accepted' GROUP BY submission_id
),
sub AS (
  SELECT c.submission_id, max(c.total) AS total,
         count(*) FILTER (WHERE NOT c.has_expected) AS skipped,
         count(*) FILTER (WHERE c.has_expected AND c.status = 'Accepted') AS n_ac,
         max(c.time_used) FILTER (WHERE c.has_expected AND c.status = 'Accepted') AS max_ac,
         count(*) FILTER (WHERE c.has_expected AND c.status = 'Accepted' AND c.case_no < f.fail_case) AS passed_before,
         f.fail_case
  FROM cases c LEFT JOIN firstfail f ON f.submission_id = c.submission_id
  GROUP BY c.submission_id, f.fail_case
),
submission_result AS (
  SELECT s.submission_id,
         CASE WHEN s.fail_case IS NULL THEN 'Accepted' ELSE c.status END AS status,
         CAST(CASE WHEN s.fail_case IS NULL THEN coalesce(s.max_ac, 0) ELSE c.time_used END AS BIGINT) AS time_used,
         CAST(0 AS BIGINT) AS memory_used,
         CAST(CASE WHEN s.fail_case IS NULL THEN 100 ELSE floor(s.passed_before * 100 / s.total) END AS BIGINT) AS score,
         CASE WHEN s.fail_case IS NULL THEN 'Passed ' || CAST(s.n_ac AS VARCHAR) || '/' || CAST(s.total AS VARCHAR) || ' test cases'
              ELSE c.message END AS message,
         CAST(CASE WHEN s.fail_case IS NULL THEN 0 ELSE c.ordinal END AS BIGINT) AS failed_case,
         CAST(s.total AS BIGINT) AS total_cases,
         CAST(s.skipped AS BIGINT) AS skipped_cases
  FROM sub s LEFT JOIN cases c ON c.submission_id = s.submission_id AND c.case_no = s.fail_case
)"""

SQL["submission_result"] = A.sql_with(SUBMISSION_RESULT_SQL) + "SELECT * FROM submission_result"

SQL["case_verdict"] = A.sql_with(JUDGED_SQL) + """
SELECT submission_id, case_no, attempt, status, time_used, md5(message) AS message_md5 FROM judged"""

SQL["retry_resolve"] = A.sql_with(RESOLVED_SQL) + """
SELECT submission_id, case_no, attempt, status, time_used, CAST(attempts_seen AS BIGINT) AS attempts_seen
FROM resolved"""


# --------------------------------------------------------------------------
# helpers for SQL restatements
# --------------------------------------------------------------------------

from judgelake import constants as K  # noqa: E402
from judgelake.functions.text import PY_SPACE_CHARS  # noqa: E402

_ALL_SPACE = PY_SPACE_CHARS + "\n"


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def nf_sql(x: str) -> str:
    """Output normal form: universal newlines, per-line rstrip, trailing
    empty lines dropped (split / rtrim / join, no look-ahead needed)."""
    un = f"replace(replace({x}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    lines = f"list_transform(string_split({un}, chr(10)), lambda s: rtrim(s, {_lit(PY_SPACE_CHARS)}))"
    return f"regexp_replace(array_to_string({lines}, chr(10)), '\\n+$', '')"


def dcmp_sql(e: str, a: str, eps: float) -> str:
    m = repr(eps + K.DOUBLE_EPS_EXTRA)
    return f"""(CASE WHEN {e} IS NULL OR {a} IS NULL THEN NULL
      WHEN isnan({e}) THEN isnan({a})
      WHEN abs({e}) > 1e300 THEN CASE WHEN {e} > 0 THEN NOT isnan({a}) AND {a} > 1e300
                                      ELSE NOT isnan({a}) AND {a} < -1e300 END
      WHEN isnan({a}) OR abs({a}) > 1e300 THEN false
      WHEN abs({a} - {e}) <= {m} THEN true
      ELSE {a} >= least({e} * (1.0 - {m}), {e} * (1.0 + {m}))
       AND {a} <= greatest({e} * (1.0 - {m}), {e} * (1.0 + {m})) END)"""


def _with(*parts: str) -> str:
    return A.sql_with(*parts)


# --------------------------------------------------------------------------
# P1-P7
# --------------------------------------------------------------------------

_LISTS = A.PROBLEMS_SQL + A.SUBMISSION_LISTS_SQL

SQL["eligible_problems"] = _with(_LISTS, """,
lists AS (SELECT problem_id, count(*) FILTER (WHERE kind = 'incorrect') AS n_inc,
                 count(*) FILTER (WHERE kind = 'correct') AS n_cor
          FROM submission_lists GROUP BY problem_id)""") + """
SELECT p.id, CAST(p.test_case_count AS BIGINT) AS n_tests, CAST(l.n_inc AS BIGINT) AS n_incorrect,
       CAST(l.n_cor AS BIGINT) AS n_correct
FROM problems p JOIN lists l ON l.problem_id = p.id
WHERE contains(p.id, '_') AND p.test_case_count > 0 AND p.true_negative_rate <> 1.0
  AND l.n_inc > 0 AND l.n_cor > 0"""

SQL["cpp_submissions"] = _with(_LISTS, """,
has AS (SELECT DISTINCT problem_id FROM submission_lists)""") + """
SELECT h.problem_id AS id, CAST(count(s.pos) FILTER (WHERE s.language = 'cpp') AS BIGINT) AS n_cpp,
       coalesce(string_agg(CAST(s.pos AS VARCHAR), ',' ORDER BY s.pos) FILTER (WHERE s.language = 'cpp'), '') AS positions
FROM has h JOIN problems p ON p.id = h.problem_id
LEFT JOIN submission_lists s ON s.problem_id = h.problem_id AND s.kind = 'incorrect'
GROUP BY h.problem_id"""

_P3 = """
codes AS (SELECT doc_id, CASE doc_id % 10 WHEN 0 THEN ' ' || chr(9) || chr(10) || chr(12288) || ' '
                                         WHEN 1 THEN NULL WHEN 2 THEN '' ELSE text END AS code
          FROM documents)"""

SQL["nonblank_code"] = _with(_P3) + f"""
SELECT doc_id, NOT (code IS NULL OR length(trim(code, {_lit(_ALL_SPACE)})) = 0) AS nonblank FROM codes"""

SQL["hack_url"] = _with(A.PROBLEMS_SQL) + """
SELECT id, 'https://codeforces.com/contest/' || split_part(id, '_', 1)
           || '/hacks?verdictName=CHALLENGE_SUCCESSFUL&chosenProblemIndex=' || split_part(id, '_', 2) AS hack_url
FROM problems"""

SQL["code_hash"] = _with(_P3) + """
SELECT doc_id, CASE WHEN code IS NULL OR code = '' THEN '' ELSE md5(code) END AS code_hash,
       CASE WHEN code IS NULL OR code = '' THEN '' ELSE md5(code || 'cpp') END AS exe_key
FROM codes"""

SQL["limits_with_defaults"] = _with(A.PROBLEMS_SQL) + """
SELECT id, CAST(coalesce(time_limit, 1000) AS BIGINT) AS time_limit,
       CAST(coalesce(memory_limit, 256) AS BIGINT) AS memory_limit FROM problems"""

SQL["points_normalise"] = """
WITH pts AS (
  SELECT l_orderkey AS submission_id, l_linenumber AS case_no,
         CASE l_linenumber % 4 WHEN 0 THEN l_extendedprice * 20 WHEN 1 THEN (l_discount - 0.05) * 10
                               WHEN 2 THEN l_extendedprice / 7 ELSE l_tax END AS points
  FROM lineitem),
x AS (SELECT *, CASE WHEN isnan(points) THEN 'Parameter ''points'' can''t be nan'
                     WHEN abs(points) > 1e300 THEN 'Parameter ''points'' can''t be infinite'
                     WHEN points < -1e-8 THEN 'Parameter ''points'' can''t be negative'
                     WHEN points > 1000000.00000001 THEN 'Parameter ''points'' can''t be greater than 1E6' END AS reason,
                CASE WHEN points <= 0 THEN 0.0 WHEN points >= 1e6 THEN 1e6 ELSE points END AS c
      FROM pts),
z AS (SELECT *, CAST(floor(c * 10000000000 + 0.5) AS BIGINT) AS n FROM x)
SELECT submission_id, case_no,
       CASE WHEN reason IS NULL THEN
         regexp_replace(regexp_replace(CAST(n // 10000000000 AS VARCHAR) || '.' || lpad(CAST(n % 10000000000 AS VARCHAR), 10, '0'),
                                       '(\\.\\d*?)0+$', '\\1'), '\\.$', '.0') END AS points_text,
       reason IS NOT NULL AS failed, reason
FROM z"""

# --------------------------------------------------------------------------
# V2-V9, V11
# --------------------------------------------------------------------------

SQL["output_compare"] = _with(A.OUTPUTS_SQL) + f"""
SELECT output_id, coalesce({nf_sql('actual')} = {nf_sql('expected')}, false) AS same FROM outputs"""

SQL["checker_outcome"] = _with(A.RUNS_SQL) + """
SELECT submission_id, case_no, attempt,
       CASE WHEN checker_elapsed_s > 10 THEN 'System Error' WHEN checker_exit = 0 THEN 'Accepted'
            ELSE 'Wrong Answer' END AS checker_status,
       md5(CASE WHEN checker_elapsed_s > 10 THEN 'Checker timeout on test ' || stem
                WHEN checker_exit = 0 THEN ''
                ELSE substr(CASE WHEN coalesce(checker_stderr, '') <> '' THEN checker_stderr
                                 ELSE coalesce(checker_stdout, '') END, 1, 500) END) AS message_md5
FROM runs WHERE has_checker"""


def _outcome_values() -> str:
    rows = []
    for dialect, codes in K.CHECKER_EXIT.items():
        seen = set()
        for outcome, code in codes.items():
            if code in seen:
                continue
            seen.add(code)
            rep = "pe" if outcome == "dirt" else outcome
            text = {"ok": "ok", "wa": "wrong answer", "pe": "wrong output format", "fail": "FAIL",
                    "dirt": "wrong output format", "points": "points"}[outcome]
            rows.append(f"({_lit(dialect)}, {code}, {_lit(outcome)}, {_lit(rep)}, {_lit(text)})")
    return ", ".join(rows)


SQL["checker_outcome_detail"] = _with(A.RUNS_SQL, f""",
codes AS (SELECT CAST(CASE WHEN checker_exit = 0 THEN 0 ELSE checker_exit + 50 * (submission_id % 2) END AS INTEGER) AS exit_code
          FROM runs WHERE checker_exit IS NOT NULL),
counts AS (SELECT exit_code, count(*) AS n FROM codes GROUP BY exit_code),
dim AS (SELECT * FROM (VALUES {_outcome_values()}) AS t(dialect, exit_code, outcome, reported, outcome_text)),
dialects AS (SELECT * FROM (VALUES ('default', 0), ('ejudge', 0), ('contester', 0), ('testsys', 50)) AS t(dialect, base)),
dec AS (
  SELECT d.dialect, c.exit_code, c.n, m.outcome AS o, m.reported AS r, m.outcome_text AS ot,
         m.outcome IS NULL AND d.base > 0 AND c.exit_code >= d.base AS partial, d.base
  FROM counts c CROSS JOIN dialects d
  LEFT JOIN dim m ON m.dialect = d.dialect AND m.exit_code = c.exit_code)""") + """
SELECT dialect, exit_code,
       CASE WHEN partial THEN 'partially' ELSE coalesce(o, 'partially') END AS outcome,
       CASE WHEN partial THEN 'partially' ELSE coalesce(r, 'partially') END AS reported,
       CAST(CASE WHEN partial THEN exit_code - base END AS INTEGER) AS pctype,
       CASE WHEN partial THEN 'partially correct (' || CAST(exit_code - base AS VARCHAR) || ')'
            ELSE coalesce(ot, 'partially correct') END AS outcome_text,
       CASE WHEN NOT partial AND coalesce(r, 'partially') = 'ok' THEN 'Accepted' ELSE 'Wrong Answer' END AS judge_status,
       CAST(n AS BIGINT) AS n
FROM dec"""

SQL["trailing_output_check"] = """
WITH t AS (
  SELECT doc_id, regexp_split_to_array(regexp_replace(text, '^[ \\t\\n\\r]+|[ \\t\\n\\r]+$', '', 'g'), '[ \\t\\n\\r]+') AS found
  FROM documents),
e AS (SELECT doc_id, found, CASE WHEN doc_id % 3 = 0 THEN found[1:len(found) - 1] ELSE found END AS expected FROM t),
o AS (SELECT doc_id, CASE WHEN found[1:len(expected)] = expected THEN 'ok' ELSE 'wa' END AS outcome,
             array_to_string(found[len(expected) + 1:], ' ') AS remainder FROM e)
SELECT doc_id, outcome,
       CASE WHEN outcome = 'ok' AND regexp_matches(remainder, '[^ \t\n\r]') THEN 'pe' ELSE outcome END AS final_outcome,
       CASE WHEN outcome = 'ok' AND regexp_matches(remainder, '[^ \t\n\r]') THEN 'Extra information in the output file' END AS final_message
FROM o"""

SQL["numeric_compare"] = _with(A.NUMERIC_PAIRS_SQL) + f"""
SELECT submission_id, case_no, {dcmp_sql('expected', 'actual', 1e-6)} AS eq_1e6,
       {dcmp_sql('expected', 'actual', 1e-7)} AS eq_1e7
FROM numeric_pairs"""

SQL["numeric_error_report"] = _with(A.NUMERIC_PAIRS_SQL, """,
err AS (SELECT problem_key, CASE WHEN abs(expected) > 1e-9
                                 THEN least(abs(actual - expected), abs(abs(actual - expected) / expected))
                                 ELSE abs(actual - expected) END AS e
        FROM numeric_pairs)""") + """
SELECT problem_key, round(max(e) * 1e9, 3) AS max_error_e9, round(avg(e) * 1e9, 3) AS mean_error_e9,
       CAST(count(*) FILTER (WHERE e > 1e-7) AS BIGINT) AS n_above
FROM err GROUP BY problem_key"""

_STATUSES = ", ".join(_lit(s) for s in K.STATUSES)
_LANGS = ", ".join(_lit(s) for s in K.LANGUAGES)

SQL["status_domain_check"] = _with(A.SUBMISSIONS_SQL) + f"""
SELECT id, status, language,
       CASE WHEN status NOT IN ({_STATUSES}) THEN 'unknown status' ELSE 'unknown language' END AS reject_reason
FROM submissions WHERE status NOT IN ({_STATUSES}) OR language NOT IN ({_LANGS})"""

_HACKS = A.OUTPUTS_SQL + """,
o AS (SELECT outputs.*, d.n_chars FROM outputs JOIN documents d ON d.doc_id = outputs.output_id),
u AS (SELECT output_id AS hack_id, n_chars * 400 AS input_bytes,
             CASE WHEN output_id % 11 = 0 THEN 'Time Limit Exceeded' WHEN output_id % 11 = 1 THEN 'Runtime Error'
                  ELSE 'Accepted' END AS run_status,
             CASE WHEN output_id % 11 = 1 THEN 'Exit code: 1' ELSE '' END AS run_message,
             actual AS output, output_id % 3 = 0 AS has_checker,
             CASE WHEN output_id % 5 < 3 THEN 0 ELSE 1 END AS checker_exit,
             n_chars % 1000 AS time_used
      FROM o),
s AS (SELECT output_id AS hack_id, CASE WHEN output_id % 13 = 0 THEN 'Runtime Error' ELSE 'Accepted' END AS std_status,
             expected AS std_output FROM o WHERE output_id % 17 <> 0),
j AS (SELECT u.*, s.std_status, s.std_output, s.std_status IS NOT NULL AS has_std
      FROM u LEFT JOIN s ON s.hack_id = u.hack_id WHERE u.input_bytes <= 10485760),
v AS (SELECT j.*, CASE WHEN run_status <> 'Accepted' THEN run_status
                       WHEN has_std AND std_status <> 'Accepted' THEN 'System Error'
                       WHEN has_std AND has_checker THEN CASE WHEN checker_exit = 0 THEN 'Accepted' ELSE 'Wrong Answer' END
                       WHEN has_std THEN CASE WHEN coalesce(""" + nf_sql("output") + " = " + nf_sql("std_output") + """, false)
                                              THEN 'Accepted' ELSE 'Wrong Answer' END
                       ELSE 'Accepted' END AS status FROM j)"""

SQL["differential_verdict"] = _with(_HACKS) + """
SELECT hack_id, status,
       CAST(CASE WHEN has_std AND std_status <> 'Accepted' AND run_status = 'Accepted' THEN 0 ELSE time_used END AS BIGINT) AS time_used,
       md5(CASE WHEN run_status <> 'Accepted' THEN 'User: ' || run_status || chr(10) || run_message
                WHEN has_std AND std_status <> 'Accepted' THEN 'Std: ' || std_status
                WHEN has_std AND has_checker THEN 'User Output:' || chr(10) || substr(coalesce(output, ''), 1, 2000)
                     || chr(10) || chr(10) || 'Checker: ' || CASE WHEN checker_exit = 0 THEN '' ELSE 'differ at token 1' END
                WHEN has_std AND status = 'Accepted' THEN 'User Output:' || chr(10) || substr(coalesce(output, ''), 1, 2000)
                WHEN has_std THEN 'User Output:' || chr(10) || substr(coalesce(output, ''), 1, 1000) || chr(10) || chr(10)
                     || 'Expected:' || chr(10) || substr(coalesce(std_output, ''), 1, 1000)
                ELSE 'Output:' || chr(10) || substr(coalesce(output, ''), 1, 2000) END) AS message_md5
FROM v
UNION ALL
SELECT hack_id, 'Rejected', CAST(NULL AS BIGINT), md5('input too large') FROM u WHERE input_bytes > 10485760"""

SQL["submit_retry_resolve"] = _with(A._BASE_SQL, A.VERSION_RESULTS_SQL, """,
vr2 AS (SELECT * FROM version_results WHERE try_no <= 2),
f AS (SELECT code_id, version, max(CASE WHEN try_no = 1 THEN verdict END) AS first_v FROM vr2 GROUP BY code_id, version),
p AS (SELECT f.code_id, f.version,
             CASE WHEN f.first_v = 'System Error'
                  THEN coalesce(min(CASE WHEN v.verdict <> f.first_v THEN v.try_no END), max(v.try_no))
                  ELSE min(v.try_no) END AS chosen
      FROM f JOIN vr2 v ON v.code_id = f.code_id AND v.version = f.version
      GROUP BY f.code_id, f.version, f.first_v)""") + """
SELECT v.code_id, v.version, CAST(v.try_no AS BIGINT) AS try_no, v.verdict
FROM p JOIN vr2 v ON v.code_id = p.code_id AND v.version = p.version AND v.try_no = p.chosen"""


# --------------------------------------------------------------------------
# A2-A12, A18
# --------------------------------------------------------------------------

def _every_version(src: str) -> str:
    """Results of ``src`` with a System Error for each version that a code has no result of."""
    return f"""SELECT c.code_id, k.version_no, ['c++14', 'c++17', 'c++20', 'c++23'][k.version_no] AS version,
              coalesce(v.verdict, 'System Error') AS verdict, coalesce(v.passed, false) AS passed, v.failed_test,
              v.code_id IS NOT NULL AS present
       FROM (SELECT DISTINCT code_id FROM {src}) c, (SELECT * FROM (VALUES (1), (2), (3), (4)) AS t(version_no)) k
       LEFT JOIN {src} v ON v.code_id = c.code_id AND v.version_no = k.version_no"""


_LABELLED = SUBMISSION_RESULT_SQL + A.SUBMISSION_LISTS_SQL + """,
labelled AS (
  SELECT s.problem_id, s.kind AS label, s.pos, s.code, r.status AS verdict, r.status IS NOT NULL AS success
  FROM submission_lists s LEFT JOIN submission_result r ON r.submission_id = s.submission_id
)"""

SQL["pass_rates"] = _with(_LABELLED, """,
g AS (SELECT problem_id, label, count(*) AS n_codes, count(*) FILTER (WHERE NOT success) AS n_errors,
             count(*) FILTER (WHERE success AND verdict = 'Accepted') AS n_passed
      FROM labelled GROUP BY problem_id, label)""") + """
SELECT problem_id, label, CAST(n_codes AS BIGINT) AS n_codes, CAST(n_errors AS BIGINT) AS n_errors,
       CAST(n_codes - n_errors AS BIGINT) AS n_valid, CAST(n_passed AS BIGINT) AS n_passed,
       round(CASE WHEN label = 'correct' THEN n_passed / (n_codes - n_errors) END, 6) AS tpr,
       round(CASE WHEN label = 'correct' THEN 1 - n_passed / (n_codes - n_errors) END, 6) AS fnr,
       round(CASE WHEN label <> 'correct' THEN 1 - n_passed / (n_codes - n_errors) END, 6) AS tnr,
       round(CASE WHEN label <> 'correct' THEN n_passed / (n_codes - n_errors) END, 6) AS fpr
FROM g WHERE n_codes - n_errors > 0"""

SQL["passed_submissions"] = _with(_LABELLED) + """
SELECT problem_id, label, CAST(count(*) AS BIGINT) AS n_passed,
       string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS positions,
       md5(string_agg(md5(code), ',' ORDER BY pos)) AS codes_md5
FROM labelled WHERE success AND verdict = 'Accepted' GROUP BY problem_id, label"""

SQL["passed_rows"] = _with(_LABELLED) + """
SELECT problem_id, label, CAST(pos AS BIGINT) AS index, row_number() OVER (PARTITION BY problem_id, label ORDER BY pos) - 1 AS place,
       md5(code) AS code_md5 FROM labelled WHERE success AND verdict = 'Accepted'"""

SQL["version_consensus"] = _with(A._BASE_SQL, A.VERSION_RESULTS_SQL, """,
v1 AS (SELECT * FROM version_results WHERE try_no = 1),
full1 AS (""" + _every_version("v1") + """),
st AS (SELECT code_id, min(version_no) FILTER (WHERE verdict <> 'Compile Error' AND NOT passed) AS stop_no,
              count(*) FILTER (WHERE verdict <> 'Compile Error') AS tested, count(*) FILTER (WHERE present) AS seen
       FROM full1 GROUP BY code_id)""") + """
SELECT s.code_id, s.stop_no IS NULL AS all_passed, v.version AS stopped_at, v.verdict AS fail_verdict,
       v.failed_test, s.tested = 0 AS untestable, coalesce(v.version, '') AS failed_versions,
       CAST(s.seen AS BIGINT) AS versions_seen
FROM st s LEFT JOIN full1 v ON v.code_id = s.code_id AND v.version_no = s.stop_no"""

_COMPILES = A.PROBLEMS_SQL + A.COMPILE_LOG_SQL + """,
compiles AS (SELECT code_hash, bool_or(ok) AS compiles FROM compile_log GROUP BY code_hash)"""

SQL["first_correct_code"] = _with(SUBMISSION_RESULT_SQL, A.SUBMISSION_LISTS_SQL, _COMPILES, f""",
cand AS (
  SELECT s.problem_id, s.submission_id, s.pos, s.code,
         coalesce(r.status = 'Accepted', false) AND coalesce(c.compiles, false) AS good
  FROM submission_lists s
  LEFT JOIN submission_result r ON r.submission_id = s.submission_id
  LEFT JOIN compiles c ON c.code_hash = md5(s.code)
  WHERE s.kind = 'correct' AND s.language = 'cpp'
    AND NOT (s.code IS NULL OR length(trim(s.code, {_lit(_ALL_SPACE)})) = 0)),
f AS (SELECT problem_id, min(pos) FILTER (WHERE good) AS first_pos, count(*) AS n FROM cand GROUP BY problem_id)""") + """
SELECT f.problem_id, CAST(f.first_pos AS INTEGER) AS correct_pos, c.submission_id AS correct_submission_id,
       md5(c.code) AS correct_code_md5,
       CAST(CASE WHEN f.first_pos IS NULL THEN f.n
                 ELSE (SELECT count(*) FROM cand c2 WHERE c2.problem_id = f.problem_id AND c2.pos <= f.first_pos) END
            AS BIGINT) AS attempts
FROM f LEFT JOIN cand c ON c.problem_id = f.problem_id AND c.pos = f.first_pos"""

SQL["compiles_any_standard"] = _with(_COMPILES) + "SELECT code_hash, compiles FROM compiles"

SQL["evaluate_distinct"] = _with(A.SUBMISSION_LISTS_SQL, _COMPILES) + """
SELECT s.submission_id, md5(s.code) AS code_hash, c.compiles
FROM submission_lists s LEFT JOIN compiles c ON c.code_hash = md5(s.code)"""

SQL["test_case_counts"] = _with(A.RUNS_SQL) + """
SELECT problem_id, CAST(count(DISTINCT stem) AS BIGINT) AS test_case_count, bool_or(has_checker) AS has_checker
FROM runs GROUP BY problem_id"""

SQL["slow_checker_registry"] = _with(A.SLOW_CHECKS_SQL, """,
rec AS (SELECT * FROM slow_checks WHERE timeout OR elapsed_s > 10),
ranked AS (SELECT *, row_number() OVER (PARTITION BY problem_id, case_stem ORDER BY seen_at DESC, seq DESC) AS rn
           FROM rec),
firsts AS (SELECT problem_id, min(seen_at) AS first_seen FROM rec GROUP BY problem_id)""") + """
SELECT r.problem_id, r.case_stem,
       CASE WHEN r.timeout THEN 'timeout' ELSE 'slow' END AS status,
       CASE WHEN r.timeout THEN '>10s'
            ELSE CAST(CAST(floor(r.elapsed_s * 100 + 0.5) AS BIGINT) // 100 AS VARCHAR) || '.'
                 || lpad(CAST(CAST(floor(r.elapsed_s * 100 + 0.5) AS BIGINT) % 100 AS VARCHAR), 2, '0') || 's' END AS time,
       epoch_us(r.seen_at) AS last_seen_us, epoch_us(f.first_seen) AS first_seen_us
FROM ranked r JOIN firsts f ON f.problem_id = r.problem_id WHERE r.rn = 1"""

SQL["verdict_counts"] = _with(A.SUBMISSIONS_SQL) + """
SELECT 'status' AS dimension, status AS value, CAST(count(*) AS BIGINT) AS n FROM submissions GROUP BY status
UNION ALL SELECT 'language', language, count(*) FROM submissions GROUP BY language
UNION ALL SELECT 'problem', problem_id, count(*) FROM submissions GROUP BY problem_id
UNION ALL SELECT 'total', NULL, count(*) FROM submissions"""

# --------------------------------------------------------------------------
# J1-J6
# --------------------------------------------------------------------------

SQL["pair_testcases"] = _with(A.RUNS_SQL) + """
SELECT submission_id, case_no, NOT (case_no = 7 AND submission_id % 4 = 0) AS has_expected
FROM runs WHERE attempt = 1"""

SQL["exclude_processed"] = _with(A.PROBLEMS_SQL) + "SELECT id FROM problems WHERE partkey % 4 <> 0"

SQL["exclude_problematic"] = _with(A.PROBLEMS_SQL, A.SLOW_CHECKS_SQL) + """
SELECT id FROM problems WHERE id NOT IN (SELECT problem_id FROM slow_checks WHERE timeout OR elapsed_s > 10)"""

SQL["exclude_failed_codes"] = _with(A.SUBMISSION_LISTS_SQL) + """
SELECT s.problem_id, s.pos FROM submission_lists s
WHERE s.kind = 'incorrect' AND NOT EXISTS (
  SELECT 1 FROM submission_lists f WHERE f.kind = 'incorrect' AND f.pos % 3 = 0
    AND f.problem_id = s.problem_id AND f.code = s.code)"""

_REGISTRY = A.PROBLEMS_SQL + """,
registry AS (SELECT p.* FROM problems p JOIN part ON part.p_partkey = p.partkey WHERE part.p_size % 13 <> 0)"""

SQL["submission_lookup"] = _with(A.SUBMISSIONS_SQL, _REGISTRY) + """
SELECT s.id, s.problem_id, r.id IS NOT NULL AS found, r.title AS problem_title
FROM submissions s LEFT JOIN registry r ON r.id = s.problem_id"""

SQL["orphan_submissions"] = _with(A.SUBMISSIONS_SQL, _REGISTRY) + """
SELECT id, problem_id FROM submissions WHERE problem_id NOT IN (SELECT id FROM registry)"""

# --------------------------------------------------------------------------
# W1-W4
# --------------------------------------------------------------------------

SQL["recent_submissions"] = _with(A.SUBMISSIONS_SQL) + """
SELECT id, problem_id, language, status, time_used, score FROM submissions ORDER BY id DESC LIMIT 50"""

SQL["list_problems"] = _with(_REGISTRY) + """
SELECT id, title, time_limit, memory_limit, has_checker, test_case_count FROM registry ORDER BY id"""

SQL["case_ordinal"] = _with(A.RUNS_SQL, A.PROBLEMS_SQL, """,
named AS (SELECT DISTINCT problem_id, CAST(case_no * case_no AS VARCHAR) AS stem FROM runs WHERE attempt = 1
          UNION ALL SELECT id, 'readme' FROM problems WHERE partkey % 7 = 0)""") + """
SELECT problem_id, stem,
       CASE WHEN regexp_full_match(stem, '[0-9]{1,18}')
            THEN row_number() OVER (PARTITION BY problem_id, regexp_full_match(stem, '[0-9]{1,18}')
                                    ORDER BY TRY_CAST(stem AS BIGINT), stem) END AS ordinal,
       NOT regexp_full_match(stem, '[0-9]{1,18}') AS rejected
FROM named"""

SQL["cumulative_pass"] = _with(RESOLVED_SQL) + """
SELECT submission_id, case_no,
       CAST(coalesce(sum(CASE WHEN status = 'Accepted' THEN 1 ELSE 0 END)
                     OVER (PARTITION BY submission_id ORDER BY case_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
            AS BIGINT) AS passed_before
FROM resolved"""


# --------------------------------------------------------------------------
# C1-C4, A11, SNK4
# --------------------------------------------------------------------------

_HACK = ("'https://codeforces.com/contest/' || split_part({x}, '_', 1) || "
         "'/hacks?verdictName=CHALLENGE_SUCCESSFUL&chosenProblemIndex=' || split_part({x}, '_', 2)")
_NONBLANK = "NOT ({x} IS NULL OR length(trim({x}, " + _lit(_ALL_SPACE) + ")) = 0)"

_ELIGIBLE = """,
lists AS (SELECT problem_id, count(*) FILTER (WHERE kind = 'incorrect') AS n_inc,
                 count(*) FILTER (WHERE kind = 'correct') AS n_cor
          FROM submission_lists GROUP BY problem_id),
el AS (SELECT p.* FROM problems p JOIN lists l ON l.problem_id = p.id
       WHERE contains(p.id, '_') AND p.test_case_count > 0 AND p.true_negative_rate <> 1.0
         AND l.n_inc > 0 AND l.n_cor > 0)"""


def _record_select(kept: str, cor: str) -> str:
    return f"""
SELECT k.problem_id AS id, CAST(k.n AS BIGINT) AS n_codes, k.codes_md5, md5(sc.code) AS correct_code_md5,
       el.description, el.checker, CAST(el.test_case_count AS BIGINT) AS n_test_cases,
       {_HACK.format(x='k.problem_id')} AS hack_url
FROM {kept} k JOIN el ON el.id = k.problem_id
LEFT JOIN {cor} c ON c.problem_id = k.problem_id
LEFT JOIN submission_lists sc ON sc.problem_id = k.problem_id AND sc.kind = 'correct' AND sc.pos = c.first_pos"""


SQL["passed_incorrect_single"] = _with(SUBMISSION_RESULT_SQL, A.SUBMISSION_LISTS_SQL, _COMPILES, _ELIGIBLE, f""",
chk AS (SELECT el.id FROM el LEFT JOIN compiles c ON c.code_hash = md5(el.checker)
        WHERE el.checker IS NULL OR el.checker = ''
           OR ({_NONBLANK.format(x='el.checker')} AND coalesce(c.compiles, false))),
inc AS (SELECT s.problem_id, s.pos, s.code FROM submission_lists s JOIN chk ON chk.id = s.problem_id
        JOIN submission_result r ON r.submission_id = s.submission_id
        WHERE s.kind = 'incorrect' AND s.language = 'cpp' AND r.status = 'Accepted'),
kept AS (SELECT problem_id, count(*) AS n, md5(string_agg(md5(code), ',' ORDER BY pos)) AS codes_md5
         FROM inc GROUP BY problem_id),
cor AS (SELECT s.problem_id, min(s.pos) AS first_pos FROM submission_lists s JOIN chk ON chk.id = s.problem_id
        JOIN submission_result r ON r.submission_id = s.submission_id
        LEFT JOIN compiles c ON c.code_hash = md5(s.code)
        WHERE s.kind = 'correct' AND s.language = 'cpp' AND {_NONBLANK.format(x='s.code')}
          AND r.status = 'Accepted' AND coalesce(c.compiles, false)
        GROUP BY s.problem_id)""") + _record_select("kept", "cor")

_C2 = A._BASE_SQL + A.VERSION_RESULTS_SQL + A.PROBLEMS_SQL + A.SUBMISSION_LISTS_SQL + _ELIGIBLE + f""",
v1 AS (SELECT * FROM version_results WHERE try_no = 1),
cons AS (SELECT code_id, count(*) FILTER (WHERE verdict <> 'Compile Error' AND NOT passed) = 0 AS all_passed
         FROM ({_every_version("v1")}) GROUP BY code_id),
inc2 AS (SELECT s.problem_id, s.pos, s.code, s.submission_id FROM submission_lists s JOIN el ON el.id = s.problem_id
         JOIN cons c ON c.code_id = s.submission_id
         WHERE s.kind = 'incorrect' AND s.language = 'cpp' AND c.all_passed),
kept2 AS (SELECT problem_id, count(*) AS n, md5(string_agg(md5(code), ',' ORDER BY pos)) AS codes_md5
          FROM inc2 GROUP BY problem_id),
cor2 AS (SELECT s.problem_id, min(s.pos) AS first_pos FROM submission_lists s JOIN el ON el.id = s.problem_id
         JOIN cons c ON c.code_id = s.submission_id
         WHERE s.kind = 'correct' AND s.language = 'cpp' AND {_NONBLANK.format(x='s.code')} AND c.all_passed
         GROUP BY s.problem_id),
c2 AS ({_record_select("kept2", "cor2")})"""

SQL["passed_incorrect_multi"] = _with(_C2) + "SELECT * FROM c2"

SQL["resume_batches"] = SQL["passed_incorrect_multi"]
SQL["evaluated_multi"] = SQL["passed_incorrect_multi"]
SQL["curation_state"] = _with(_C2) + """
SELECT el.id AS problem_id, 'processed' AS state, c2.n_codes FROM el LEFT JOIN c2 ON c2.id = el.id"""

# equal codes of one problem and language get the verdict of the first request
SQL["evaluated_curation"] = SQL["passed_incorrect_single"].replace(
    "JOIN submission_result r ON r.submission_id = s.submission_id", "JOIN shared r ON r.submission_id = s.submission_id").replace(
    ",\ninc AS (", f""",
shared AS (SELECT s.submission_id, first_value(r.status) OVER (
             PARTITION BY s.problem_id, s.language, coalesce(s.code, '') ORDER BY s.problem_id || ':' || s.kind || ':' || s.pos) AS status
           FROM submission_lists s JOIN chk ON chk.id = s.problem_id LEFT JOIN submission_result r ON r.submission_id = s.submission_id
           WHERE s.language = 'cpp' AND (s.kind = 'incorrect' OR {_NONBLANK.format(x='s.code')})),
inc AS (""", 1)

_C3 = _C2 + A.SLOW_CHECKS_SQL + """,
kidx AS (SELECT problem_id, submission_id, code, row_number() OVER (PARTITION BY problem_id ORDER BY pos) - 1 AS idx
         FROM inc2),
rt AS (SELECT code_id, version, version_no, verdict, passed, failed_test, try_no - 1 AS t
       FROM version_results WHERE try_no >= 2),
rtf AS (SELECT code_id, version, max(CASE WHEN t = 1 THEN verdict END) AS first_v FROM rt WHERE t <= 2
        GROUP BY code_id, version),
rtp AS (SELECT f.code_id, f.version,
               CASE WHEN f.first_v = 'System Error'
                    THEN coalesce(min(CASE WHEN r.verdict <> f.first_v THEN r.t END), max(r.t))
                    ELSE min(r.t) END AS chosen
        FROM rtf f JOIN rt r ON r.code_id = f.code_id AND r.version = f.version AND r.t <= 2
        GROUP BY f.code_id, f.version, f.first_v),
rt2 AS (SELECT r.* FROM rtp p JOIN rt r ON r.code_id = p.code_id AND r.version = p.version AND r.t = p.chosen),
rt4 AS (""" + _every_version("rt2") + """),
rstop AS (SELECT code_id, min(version_no) FILTER (WHERE verdict <> 'Compile Error' AND NOT passed) AS stop_no
          FROM rt4 GROUP BY code_id),
rc AS (SELECT s.code_id, s.stop_no IS NULL AS all_passed, v.version AS stopped_at, v.verdict AS fail_verdict,
              v.failed_test
       FROM rstop s LEFT JOIN rt4 v ON v.code_id = s.code_id AND v.version_no = s.stop_no),
reg AS (SELECT DISTINCT problem_id FROM slow_checks WHERE timeout OR elapsed_s > 10),
tagged AS (SELECT k.problem_id, k.idx, k.code, coalesce(rc.all_passed, false) AS ok, rc.stopped_at,
                  coalesce(rc.fail_verdict, 'System Error') AS fail_verdict, rc.failed_test
           FROM kidx k LEFT JOIN rc ON rc.code_id = k.submission_id
           WHERE k.problem_id NOT IN (SELECT problem_id FROM reg)),
refiltered AS (SELECT problem_id AS id, CAST(count(*) AS BIGINT) AS n_codes,
                      md5(string_agg(md5(code), ',' ORDER BY idx)) AS codes_md5
               FROM tagged WHERE ok GROUP BY problem_id),
rejected AS (SELECT problem_id, CAST(row_number() OVER (PARTITION BY problem_id ORDER BY idx) AS BIGINT) AS reject_no,
                    CAST(idx AS BIGINT) AS pos, stopped_at, fail_verdict, failed_test, code
             FROM tagged WHERE NOT ok)"""

SQL["refilter_codes"] = _with(_C3) + "SELECT * FROM refiltered"

SQL["write_rejects"] = _with(_C3) + """
SELECT problem_id, reject_no, pos, stopped_at, fail_verdict, failed_test, md5(code) AS code_md5 FROM rejected"""

SQL["resume_curation"] = _with(_C3, """,
done AS (SELECT id FROM problems WHERE partkey % 4 = 0),
left_codes AS (SELECT k.problem_id, k.idx, k.code FROM kidx k
               WHERE k.problem_id IN (SELECT id FROM done)
                 AND NOT EXISTS (SELECT 1 FROM rejected r WHERE r.problem_id = k.problem_id AND r.code = k.code)),
rec AS (SELECT problem_id, count(*) AS n, md5(string_agg(md5(code), ',' ORDER BY idx)) AS codes_md5
        FROM left_codes GROUP BY problem_id)""") + """
SELECT c2.id, CAST(r.n AS BIGINT) AS n_codes, r.codes_md5, c2.correct_code_md5, c2.description, c2.checker,
       c2.n_test_cases, c2.hack_url
FROM c2 JOIN rec r ON r.problem_id = c2.id
UNION ALL
SELECT * FROM c2 WHERE id NOT IN (SELECT id FROM done)"""

SQL["curation_report"] = _with(_C3, """,
b AS (SELECT 'part-' || right(id, 1) AS source_file, id, n_codes FROM c2),
a AS (SELECT b.source_file, r.id, r.n_codes FROM refiltered r JOIN b ON b.id = r.id),
f AS (SELECT b.source_file, count(*) AS n FROM rejected x JOIN b ON b.id = x.problem_id GROUP BY b.source_file),
per AS (SELECT b.source_file, count(*) AS problems,
               (SELECT count(*) FROM a WHERE a.source_file = b.source_file) AS records,
               (SELECT coalesce(sum(n_codes), 0) FROM a WHERE a.source_file = b.source_file) AS codes_kept,
               sum(b.n_codes) AS codes_original,
               coalesce((SELECT n FROM f WHERE f.source_file = b.source_file), 0) AS codes_failed
        FROM b GROUP BY b.source_file)""") + """
SELECT source_file, CAST(problems AS BIGINT) AS problems, CAST(records AS BIGINT) AS records,
       CAST(codes_kept AS BIGINT) AS codes_kept, CAST(codes_original AS BIGINT) AS codes_original,
       CAST(codes_failed AS BIGINT) AS codes_failed FROM per
UNION ALL
SELECT 'TOTAL', CAST(sum(problems) AS BIGINT), CAST(sum(records) AS BIGINT), CAST(sum(codes_kept) AS BIGINT),
       CAST(sum(codes_original) AS BIGINT), CAST(sum(codes_failed) AS BIGINT) FROM per"""


# --------------------------------------------------------------------------
# M1-M6
# --------------------------------------------------------------------------

_REGT = _REGISTRY + """,
pp AS (SELECT p.*, part.p_size FROM problems p JOIN part ON part.p_partkey = p.partkey),
regt AS (SELECT id, title, time_limit, memory_limit, has_checker, test_case_count,
                1600000000 + partkey * 60 AS created_at FROM registry)"""


def _reg_cols(a: str) -> str:
    return (f"{a}.id, {a}.title, CAST({a}.time_limit AS BIGINT) AS time_limit, "
            f"CAST({a}.memory_limit AS BIGINT) AS memory_limit, {a}.has_checker, "
            f"CAST({a}.test_case_count AS BIGINT) AS test_case_count, CAST({a}.created_at AS BIGINT) AS created_at")


SQL["upsert_problems"] = _with(_REGT, """,
ch AS (SELECT id, upper(title) AS title, time_limit + 100 AS time_limit, memory_limit, has_checker, test_case_count,
              1 AS seq FROM pp WHERE p_size % 5 = 0
       UNION ALL SELECT id, 'v2 ' || title, 2000, 512, true, 9, 2 FROM pp WHERE p_size % 10 = 0
       UNION ALL SELECT 'X' || id, title, time_limit, memory_limit, has_checker, test_case_count, 3
                 FROM pp WHERE partkey % 50 = 0),
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS rn FROM ch) WHERE rn = 1),
up AS (SELECT coalesce(l.id, r.id) AS id,
              CASE WHEN l.id IS NOT NULL THEN l.title ELSE r.title END AS title,
              CASE WHEN l.id IS NOT NULL THEN l.time_limit ELSE r.time_limit END AS time_limit,
              CASE WHEN l.id IS NOT NULL THEN l.memory_limit ELSE r.memory_limit END AS memory_limit,
              CASE WHEN l.id IS NOT NULL THEN l.has_checker ELSE r.has_checker END AS has_checker,
              CASE WHEN l.id IS NOT NULL THEN l.test_case_count ELSE r.test_case_count END AS test_case_count,
              coalesce(r.created_at, 1700000000) AS created_at
       FROM regt r FULL OUTER JOIN last l ON l.id = r.id)""") + "SELECT " + _reg_cols("up") + " FROM up"

SQL["patch_problems"] = _with(_REGT, """,
pt AS (SELECT id, CASE WHEN partkey % 2 = 0 THEN NULL ELSE 'patched ' || title END AS title,
              CASE WHEN partkey % 4 = 1 THEN NULL ELSE time_limit * 2 END AS time_limit,
              partkey % 9 = 1 AS checker_set
       FROM problems WHERE partkey % 3 = 1),
pa AS (SELECT r.id, coalesce(p.title, r.title) AS title, coalesce(p.time_limit, r.time_limit) AS time_limit,
              r.memory_limit, r.has_checker OR coalesce(p.checker_set, false) AS has_checker,
              r.test_case_count, r.created_at
       FROM regt r LEFT JOIN pt p ON p.id = r.id)""") + "SELECT " + _reg_cols("pa") + " FROM pa"

SQL["delete_problems"] = _with(_REGT) + """
SELECT id FROM regt WHERE id NOT IN (
  SELECT CAST(p_partkey AS VARCHAR) || '_' || chr(CAST(65 + p_partkey % 5 AS INTEGER)) FROM part WHERE p_size % 7 = 0)"""

SQL["insert_if_absent"] = _with(_REGT, f""",
nw AS (SELECT id, title, checker FROM problems WHERE partkey % 2 = 0
       UNION ALL SELECT 'N' || id, title, checker FROM problems WHERE partkey % 6 = 0)""") + f"""
SELECT id, title, has_checker FROM regt
UNION ALL
SELECT id, title, {_NONBLANK.format(x='checker')} FROM nw WHERE id NOT IN (SELECT id FROM regt)"""

_TC = A.RUNS_SQL + A.PROBLEMS_SQL + """,
named AS (SELECT DISTINCT problem_id, CAST(case_no * case_no AS VARCHAR) AS stem FROM runs WHERE attempt = 1
          UNION ALL SELECT id, 'readme' FROM problems WHERE partkey % 7 = 0),
oldf AS (SELECT problem_id, stem || '.in' AS name, 'old ' || stem AS content FROM named),
newf AS (SELECT n.problem_id, n.stem || '.in' AS name, 'new ' || n.stem AS content
         FROM named n JOIN problems p ON p.id = n.problem_id
         WHERE p.partkey % 3 = 0 AND n.stem IN ('1', '4', '64'))"""


def _tc_sql(src: str) -> str:
    return f"""
SELECT problem_id, CAST(count(*) AS BIGINT) AS n_files,
       md5(string_agg(name || '=' || content, '|' ORDER BY name, content)) AS files_md5
FROM {src} GROUP BY problem_id"""


SQL["merge_testcases"] = _with(_TC, """,
merged AS (SELECT * FROM newf UNION ALL
           SELECT o.* FROM oldf o WHERE NOT EXISTS (SELECT 1 FROM newf n WHERE n.problem_id = o.problem_id
                                                                        AND n.name = o.name))""") + _tc_sql("merged")

SQL["replace_testcases"] = _with(_TC, """,
replaced AS (SELECT * FROM newf UNION ALL
             SELECT o.* FROM oldf o WHERE o.problem_id NOT IN (SELECT problem_id FROM newf))""") + _tc_sql("replaced")

SQL["new_submission_ids"] = """
SELECT (SELECT max(o_orderkey) FROM orders) + row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_partkey) AS id,
       l_orderkey AS seq, CAST(l_partkey AS VARCHAR) || '_' || chr(CAST(65 + l_partkey % 5 AS INTEGER)) AS problem_id,
       'Pending' AS status
FROM lineitem WHERE l_linenumber = 1"""


# --------------------------------------------------------------------------
# T1-T6, A13-A16
# --------------------------------------------------------------------------

_ETOK = """
et AS (SELECT event_id, user_id, regexp_extract(props, '([0-9]+)', 1) AS k,
              CAST(floor(value) AS BIGINT) || '.' || lpad(CAST(CAST(round(value * 100) AS BIGINT) % 100 AS VARCHAR), 2, '0') AS v2,
              lpad(CAST(CAST(round(value * 100) AS BIGINT) % 100 AS VARCHAR), 2, '0') AS cents
       FROM events)"""

SQL["validate_tokens"] = _with(_ETOK, """,
tok AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN '0' || k WHEN 1 THEN '+' || k WHEN 2 THEN '-' || k
                                            WHEN 3 THEN repeat(k, 11) ELSE k END AS token FROM et),
r AS (SELECT event_id, token,
             CASE WHEN NOT regexp_full_match(token, '-?(0|[1-9][0-9]*)') OR token = '-0' OR length(token) > 20
                       OR TRY_CAST(token AS BIGINT) IS NULL THEN 'expected int64'
                  WHEN TRY_CAST(token AS BIGINT) < 1 OR TRY_CAST(token AS BIGINT) > 90 THEN 'out of range' END AS reason
      FROM tok)""") + "SELECT * FROM r WHERE reason IS NOT NULL"

SQL["validate_unsigned"] = _with(_ETOK, """,
tok AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '18446744073709551615' WHEN 1 THEN '18446744073709551616'
                                           WHEN 2 THEN '0' || k
                                           ELSE CAST(user_id * 1000000000000 + CAST(k AS BIGINT) AS VARCHAR) END AS token
        FROM et),
r AS (SELECT event_id, token,
             CASE WHEN NOT regexp_full_match(token, '(0|[1-9][0-9]*)') OR length(token) > 20
                       OR TRY_CAST(token AS DECIMAL(38,0)) IS NULL
                       OR TRY_CAST(token AS DECIMAL(38,0)) > CAST('18446744073709551615' AS DECIMAL(38,0))
                  THEN 'expected unsigned int64'
                  WHEN TRY_CAST(token AS DECIMAL(38,0)) > CAST('1000000000000000000' AS DECIMAL(38,0))
                  THEN 'out of range' END AS reason
      FROM tok)""") + "SELECT * FROM r WHERE reason IS NOT NULL"

_DTOK = _ETOK + """,
tok AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN v2 WHEN 1 THEN v2 || 'e1' WHEN 2 THEN '.' || cents
                                           WHEN 3 THEN v2 || '0' WHEN 4 THEN '-' || v2 ELSE 'nan' END AS token
        FROM et)"""

SQL["validate_doubles"] = _with(_DTOK, """,
r AS (SELECT event_id, token,
             CASE WHEN NOT regexp_full_match(token, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?')
                       OR TRY_CAST(token AS DOUBLE) IS NULL THEN 'expected double'
                  WHEN TRY_CAST(token AS DOUBLE) < 0 OR TRY_CAST(token AS DOUBLE) > 100 THEN 'out of range' END AS reason
      FROM tok)""") + "SELECT * FROM r WHERE reason IS NOT NULL"

SQL["validate_strict_doubles"] = _with(_DTOK, """,
r AS (SELECT event_id, token,
             CASE WHEN NOT regexp_full_match(token, '-?(0|[1-9][0-9]*)(\\.[0-9]+)?') OR length(token) > 1000
                       OR TRY_CAST(token AS DOUBLE) IS NULL THEN 'expected strict double'
                  WHEN (CASE WHEN contains(token, '.') THEN length(split_part(token, '.', 2)) ELSE 0 END) NOT BETWEEN 2 AND 2
                  THEN 'wrong number of digits after point'
                  WHEN starts_with(token, '-') AND TRY_CAST(token AS DOUBLE) >= 0 THEN 'redundant minus'
                  WHEN TRY_CAST(token AS DOUBLE) < 0 OR TRY_CAST(token AS DOUBLE) > 100 THEN 'out of range' END AS reason
      FROM tok)""") + "SELECT * FROM r WHERE reason IS NOT NULL"

_DOCTOK = """
dt AS (SELECT doc_id, unnest(regexp_split_to_array(regexp_replace(text, '^[ \\t\\n\\r]+|[ \\t\\n\\r]+$', '', 'g'),
                                                   '[ \\t\\n\\r]+')) AS token FROM documents)"""

SQL["validate_pattern"] = _with(_DOCTOK) + """
SELECT doc_id, 'word' AS pattern_id, count(*) AS n_tokens,
       count(*) FILTER (WHERE regexp_full_match(token, '[A-Za-z]+')) AS n_match FROM dt GROUP BY doc_id
UNION ALL SELECT doc_id, 'capital', count(*), count(*) FILTER (WHERE regexp_full_match(token, '[A-Z][a-z]*[.,]?'))
FROM dt GROUP BY doc_id
UNION ALL SELECT doc_id, 'short', count(*), count(*) FILTER (WHERE regexp_full_match(token, '[a-z]{1,4}'))
FROM dt GROUP BY doc_id
UNION ALL SELECT doc_id, 'name', count(*), count(*) FILTER (WHERE regexp_full_match(token, 'mike|john'))
FROM dt GROUP BY doc_id"""

SQL["strict_layout_check"] = _with(A.OUTPUTS_SQL, """,
sp AS (SELECT output_id, string_split(actual, chr(10)) AS s FROM outputs),
l AS (SELECT output_id, unnest(range(1, len(s) + 1)) AS i, unnest(s) AS line, len(s) AS n FROM sp),
r AS (SELECT output_id, i,
             CASE WHEN i = n THEN CASE WHEN line <> '' THEN 'missing final line feed' END
                  WHEN line = '' THEN 'empty line'
                  WHEN contains(line, chr(13)) THEN 'carriage return'
                  WHEN starts_with(line, ' ') THEN 'leading space'
                  WHEN ends_with(line, ' ') THEN 'trailing space'
                  WHEN contains(line, '  ') THEN 'double space'
                  WHEN contains(line, chr(9)) THEN 'tab' END AS reason
      FROM l),
b AS (SELECT output_id, min(i) FILTER (WHERE reason IS NOT NULL) AS bad_line FROM r GROUP BY output_id)""") + """
SELECT b.output_id, CAST(b.bad_line AS BIGINT) AS bad_line, r.reason
FROM b LEFT JOIN r ON r.output_id = b.output_id AND r.i = b.bad_line"""

SQL["compare_token_lists"] = _with(A.OUTPUTS_SQL, """,
tl AS (SELECT output_id,
              regexp_split_to_array(regexp_replace(expected, '^[ \\t\\n\\r]+|[ \\t\\n\\r]+$', '', 'g'), '[ \\t\\n\\r]+') AS e,
              regexp_split_to_array(regexp_replace(actual, '^[ \\t\\n\\r]+|[ \\t\\n\\r]+$', '', 'g'), '[ \\t\\n\\r]+') AS f
       FROM outputs),
m AS (SELECT output_id, e, f,
             list_filter(range(1, greatest(len(e), len(f)) + 1), lambda i: e[i] IS DISTINCT FROM f[i])[1] AS pos
      FROM tl)""") + """
SELECT output_id, CAST(pos AS BIGINT) AS pos,
       CASE WHEN pos IS NOT NULL THEN coalesce(e[pos], 'EOF') END AS exp_token,
       CASE WHEN pos IS NOT NULL THEN coalesce(f[pos], 'EOF') END AS got_token
FROM m"""

SQL["bounds_hit_report"] = """
WITH v AS (SELECT 'quantity' AS variable, l_quantity AS value FROM lineitem
           UNION ALL SELECT 'discount', l_discount FROM lineitem
           UNION ALL SELECT 'tax', l_tax FROM lineitem
           UNION ALL SELECT 'linenumber', CAST(l_linenumber AS DOUBLE) FROM lineitem
           UNION ALL SELECT 'price', l_extendedprice FROM lineitem UNION ALL SELECT 'plain', l_tax FROM lineitem),
c AS (SELECT * FROM (VALUES ('quantity', 1.0, 50.0, true, false, false), ('discount', 0.0, 0.1, false, false, false),
                            ('tax', 0.0, 0.08, false, false, false), ('linenumber', 1.0, 7.0, true, false, false),
                            ('price', 0.0, 1000000.0, false, true, false), ('plain', 1.0, 0.08, false, false, false))
      AS t(variable, lo, hi, is_int, lo_ign, hi_ign))
SELECT c.variable,
       bool_or(CASE WHEN c.is_int THEN v.value = c.lo ELSE abs(v.value - c.lo) < 1e-12 END) OR bool_or(c.lo_ign) AS min_hit,
       bool_or(CASE WHEN c.is_int THEN v.value = c.hi ELSE abs(v.value - c.hi) < 1e-12 END) OR bool_or(c.hi_ign) AS max_hit
FROM v JOIN c ON c.variable = v.variable GROUP BY c.variable"""

_READS = """
rd AS (SELECT 'quantity' AS variable, '1' AS lower, '50' AS upper FROM lineitem
       UNION ALL SELECT 'price', '0', CAST(CAST(floor(l_extendedprice) AS BIGINT) AS VARCHAR) FROM lineitem
       UNION ALL SELECT 'window', CAST(l_linenumber AS VARCHAR), CAST(l_linenumber + 10 AS VARCHAR) FROM lineitem
       UNION ALL SELECT 'longname', repeat('9', 40), '5' FROM lineitem
       UNION ALL SELECT 'window', '1', '11' FROM lineitem)"""

SQL["constant_bounds_report"] = _with(_READS, """,
g AS (SELECT variable,
             CASE WHEN count(DISTINCT lower) = 1 AND max(length(lower)) < 32 THEN max(lower) ELSE '?' END AS lower,
             CASE WHEN count(DISTINCT upper) = 1 AND max(length(upper)) < 32 THEN max(upper) ELSE '?' END AS upper
      FROM rd GROUP BY variable)""") + "SELECT * FROM g WHERE NOT (lower = '?' AND upper = '?')"

SQL["feature_coverage"] = """
WITH d AS (SELECT feature, count(*) AS n FROM (VALUES ('view'), ('click'), ('purchase'), ('signup'), ('refund'), ('view'))
           AS t(feature) GROUP BY feature),
h AS (SELECT event_type AS feature, count(*) AS hits FROM events GROUP BY event_type)
SELECT 'report' AS kind, d.feature, coalesce(h.hits > 0, false) AS hit, CAST(NULL AS VARCHAR) AS error
FROM d LEFT JOIN h ON h.feature = d.feature
UNION ALL SELECT 'error', feature, NULL, 'feature not declared' FROM h WHERE feature NOT IN (SELECT feature FROM d)
UNION ALL SELECT 'error', feature, NULL, 'feature declared twice' FROM d WHERE n > 1"""

SQL["variable_inventory"] = _with(_READS) + "SELECT DISTINCT variable FROM rd ORDER BY variable"


# --------------------------------------------------------------------------
# SNK1, SRC5, A17, U3
# --------------------------------------------------------------------------

_TR = RESOLVED_SQL + """,
tr AS (SELECT submission_id, CAST(case_no AS INTEGER) AS testIndex,
              CASE WHEN case_no % 2 = 0 THEN 'tests' ELSE 'pretests' END AS testset,
              CAST(case_no % 3 AS VARCHAR) AS "group",
              CASE status WHEN 'Accepted' THEN 'OK' WHEN 'Wrong Answer' THEN 'WRONG_ANSWER'
                          WHEN 'Time Limit Exceeded' THEN 'TIME_LIMIT_EXCEEDED' WHEN 'Runtime Error' THEN 'RUNTIME_ERROR'
                          WHEN 'System Error' THEN 'FAILED' WHEN 'Memory Limit Exceeded' THEN 'MEMORY_LIMIT_EXCEEDED'
                          WHEN 'Compile Error' THEN 'COMPILATION_ERROR' END AS verdict,
              CAST(CASE WHEN case_no = 7 THEN NULL WHEN status = 'Accepted' THEN case_no * 1.5 ELSE 0.0 END AS DOUBLE) AS points,
              CAST(time_used AS BIGINT) AS timeConsumed, CAST(0 AS BIGINT) AS memoryConsumed,
              'in;' || CAST(case_no AS VARCHAR) || '\\x' AS input, message AS output,
              'ans' || chr(13) || chr(10) || CAST(submission_id AS VARCHAR) AS answer, 0 AS exitCode,
              status AS checkerComment
       FROM resolved)"""


def _esc(x: str) -> str:
    return (f"replace(replace(replace(replace({x}, chr(13), ''), chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n'),"
            f" ';', chr(92) || ';')")


_PTS = ("CASE WHEN points IS NULL OR isnan(points) THEN '' ELSE "
        "CAST(CAST(floor(points * 1000 + 0.5) AS BIGINT) // 1000 AS VARCHAR) || '.' || "
        "lpad(CAST(CAST(floor(points * 1000 + 0.5) AS BIGINT) % 1000 AS VARCHAR), 3, '0') END")

SQL["export_test_results"] = _with(_TR) + f"""
SELECT concat_ws(';', CAST(testIndex AS VARCHAR), {_esc('testset')}, {_esc('"group"')}, verdict, {_PTS},
                 CAST(timeConsumed AS VARCHAR), CAST(memoryConsumed AS VARCHAR), {_esc('input')}, {_esc('output')},
                 {_esc('answer')}, CAST(exitCode AS VARCHAR), {_esc('checkerComment')}) AS value
FROM tr"""

SQL["ingest_test_results"] = _with(_TR) + """
SELECT testIndex, testset, "group", verdict, points, timeConsumed, memoryConsumed, input, output,
       replace(answer, chr(13), '') AS answer, exitCode, checkerComment FROM tr"""

SQL["grouped_score"] = _with(_TR, """,
pg AS (SELECT submission_id, "group", sum(coalesce(points, 0)) AS gp, bool_and(verdict = 'OK') AS all_ok,
              count(*) AS n, count(*) FILTER (WHERE verdict = 'OK') AS ok FROM tr GROUP BY submission_id, "group")""") + """
SELECT submission_id, round(sum(gp), 3) AS sum_points,
       round(sum(CASE WHEN all_ok THEN gp ELSE 0 END), 3) AS group_points,
       round(sum(ok) / sum(n), 3) AS ok_fraction
FROM pg GROUP BY submission_id"""

SQL["scorer_udaf"] = _with(_TR) + """
SELECT submission_id, round(sum(coalesce(points, 0) * (1 + testIndex / 10)), 3) AS score FROM tr GROUP BY submission_id"""

# --------------------------------------------------------------------------
# G1-G6
# --------------------------------------------------------------------------


def _draw(salt: str, key: str) -> str:
    return f"CAST('0x' || substr(md5('20240601:{salt}:' || CAST({key} AS VARCHAR)), 1, 15) AS BIGINT)"


SQL["gen_uniform"] = f"""
SELECT o_orderkey, 1 + {_draw('', 'o_orderkey')} % 1000 AS u_int,
       round(0.0 + CAST({_draw('', 'o_orderkey')} AS DOUBLE) / {float(2 ** 60)!r} * 1.0, 9) AS u_double
FROM orders"""

SQL["gen_weighted"] = f"""
SELECT o_orderkey,
       greatest({', '.join(_draw(f'#{i}', 'o_orderkey') + ' % 1000' for i in range(4))}) AS w3,
       least({', '.join(_draw(f'#{i}', 'o_orderkey') + ' % 1000' for i in range(3))}) AS wm2,
       least(CAST(floor(1000.0 * pow(CAST({_draw('', 'o_orderkey')} AS DOUBLE) / {float(2 ** 60)!r}, {1.0 / 31!r})) AS BIGINT), 999) AS w30
FROM orders"""

SQL["shuffle_rows"] = """
SELECT o_orderkey, row_number() OVER (ORDER BY md5('20240601:perm:' || CAST(o_orderkey AS VARCHAR)), o_orderkey) AS perm
FROM orders"""

SQL["sample_distinct"] = """
SELECT l_partkey FROM (SELECT DISTINCT l_partkey FROM lineitem)
ORDER BY md5('20240601:distinct:' || CAST(l_partkey AS VARCHAR)), l_partkey LIMIT 100"""

SQL["sample_rows"] = f"""
WITH n AS (SELECT count(*) AS n FROM orders),
od AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS ord FROM orders),
d AS (SELECT c_custkey AS draw_id,
             greatest({', '.join(_draw(f'#{i}', 'c_custkey') + ' % n.n' for i in range(3))}) + 1 AS ord
      FROM customer, n)
SELECT d.draw_id, od.o_orderkey FROM d JOIN od ON od.ord = d.ord"""

def _drawn(n: int, alphabet: str, size: str, key: str) -> str:
    """Characters 1..size of item n, each drawn by its place."""
    pick = f"CAST('0x' || substr(md5('20240601:ch{n}:' || CAST({key} AS VARCHAR) || ':' || CAST(j AS VARCHAR)), 1, 15) AS BIGINT)"
    return f"array_to_string(list_transform(range(1, CAST({size} AS BIGINT) + 1), lambda j: '{alphabet}'[1 + {pick} % {len(alphabet)}]), '')"


SQL["gen_strings"] = f"""
SELECT c_custkey, {_drawn(0, 'abcdefghijklmnopqrstuvwxyz', '(3 + ' + _draw('len0', 'c_custkey') + ' % 6)', 'c_custkey')} || '_'
       || {_drawn(2, '0123456789', '2', 'c_custkey')} AS text FROM customer"""

SQL["gen_strings_grouped"] = f"""
WITH t AS (SELECT o_orderkey, {_drawn(0, 'cdefgh', '(2 + ' + _draw('len0', 'o_orderkey') + ' % 3)', 'o_orderkey')}
  || CASE {_draw('alt0', 'o_orderkey')} % 4
     WHEN 0 THEN 'x' || {_drawn(2, '0123456789', '(' + _draw('len2', 'o_orderkey') + ' % 4)', 'o_orderkey')}
     WHEN 1 THEN '(' || {_drawn(4, '-', '(' + _draw('len4', 'o_orderkey') + ' % 2)', 'o_orderkey')}
     WHEN 2 THEN {_drawn(5, '-aab', '2', 'o_orderkey')}
     ELSE {_drawn(6, '0123456789', '3', 'o_orderkey')}
          || CASE {_draw('alt6', 'o_orderkey')} % 3 WHEN 0 THEN 'u' WHEN 1 THEN 'v' ELSE 'w|' END END AS text FROM orders)
SELECT o_orderkey, text, true AS own, regexp_full_match(text, '[c-h]+x[0-9]*') AS plain,
       regexp_full_match(text, '[c-h]{{2}}(\\(|x|ab)') AS short FROM t"""

def _turned(x: str) -> str:
    """x after 16 rounds (span under 4096) or 8 of the keyed permutation over pairs (mod a, div a), as v2."""
    def add(k, r):
        return f"CAST('0x' || substr(md5('20240601:perm:{k}:' || CAST(group_id AS VARCHAR) || ':' || CAST({r} AS VARCHAR)), 1, 15) AS BIGINT)"
    cols = [f"{x} % a AS l0", f"{x} // a AS r0"]
    for k in range(16):
        cols.append(f"({'l0' if k == 0 else f'r{k - 1}'} + {add(k, f'r{k}')}) % {'ab'[k % 2]} AS r{k + 1}")
    return ", ".join([*cols, "CASE WHEN span < 4096 THEN r16 * a + r15 ELSE r8 * a + r7 END AS v2"])


SQL["random_partition"] = f"""
WITH RECURSIVE g AS (SELECT o_custkey AS group_id, count(*) AS size, CAST(sum(floor(o_totalprice / 10000)) AS BIGINT) AS total,
                            2 AS min_part FROM orders GROUP BY o_custkey),
g2 AS (SELECT *, total - size * min_part AS free, free + size - 1 AS span FROM g WHERE total >= size * min_part),
g3 AS (SELECT *, CAST(greatest(ceil(sqrt(span)), 1) AS BIGINT) AS a, (span + a - 1) // a AS b FROM g2),
draws AS (SELECT group_id, span, a, b, unnest(range(0, size - 1)) AS i FROM g3),
walk AS (SELECT group_id, span, a, b, i, v2 AS v FROM (SELECT *, {_turned('i')} FROM draws)
         UNION ALL
         SELECT group_id, span, a, b, i, v2 AS v FROM (SELECT *, {_turned('v')} FROM walk WHERE v >= span)),
ends AS (SELECT group_id, v + 1 AS cut FROM walk WHERE v < span
         UNION ALL SELECT group_id, free + size FROM g2 UNION ALL SELECT group_id, 0 FROM g2),
gaps AS (SELECT group_id, cut, lag(cut) OVER (PARTITION BY group_id ORDER BY cut) AS prev,
                row_number() OVER (PARTITION BY group_id ORDER BY cut) - 2 AS part_no FROM ends)
SELECT group_id, CAST(part_no AS BIGINT) AS part_no, CAST(cut - prev - 1 + 2 AS BIGINT) AS part FROM gaps WHERE prev IS NOT NULL"""


# --------------------------------------------------------------------------
# The batch result on the same data is the oracle
# --------------------------------------------------------------------------

SQL["stream_candidates"] = SQL["eligible_problems"]
SQL["stream_dedup_processed"] = "SELECT DISTINCT user_id FROM events"
SQL["stream_submission_status"] = _with(A.LIFECYCLE_SQL) + """
SELECT submission_id, arg_max(status, (ts, seq)) AS status FROM lifecycle GROUP BY submission_id"""
SQL["stream_early_finish"] = _with(SUBMISSION_RESULT_SQL) + """
SELECT submission_id, status, time_used, score, message, failed_case FROM submission_result"""
SQL["stream_slow_checkers"] = SQL["slow_checker_registry"]
SQL["stream_registry_upsert"] = SQL["upsert_problems"]


def _upsert_step(old: str, chg: str, new: str) -> str:
    fields = ", ".join(f"CASE WHEN l.id IS NOT NULL THEN l.{f} ELSE r.{f} END AS {f}" for f in (
        "title", "time_limit", "memory_limit", "has_checker", "test_case_count"))
    return (f"{new} AS (SELECT coalesce(l.id, r.id) AS id, {fields}, coalesce(r.created_at, l.created_at) AS created_at "
            f"FROM {old} r FULL OUTER JOIN ({chg}) l ON l.id = r.id)")


def _patch_step(old: str, chg: str, new: str) -> str:
    return (f"{new} AS (SELECT r.id, coalesce(p.title, r.title) AS title, coalesce(p.time_limit, r.time_limit) AS time_limit, r.memory_limit, "
            f"r.has_checker OR coalesce(p.checker_set, false) AS has_checker, r.test_case_count, r.created_at "
            f"FROM {old} r LEFT JOIN ({chg}) p ON p.id = r.id)")


_FIRST_UPSERT = ("SELECT id, upper(title) AS title, time_limit + 100 AS time_limit, memory_limit, has_checker, test_case_count, "
                 "{} AS created_at FROM pp WHERE p_size % 5 = 0")
_SECOND_UPSERT = ("SELECT id, 'v2 ' || title AS title, 2000 AS time_limit, 512 AS memory_limit, true AS has_checker, 9 AS test_case_count, "
                  "1700000000 AS created_at FROM pp WHERE p_size % 10 = 0")
_NEW_UPSERT = ("SELECT 'X' || id AS id, title, time_limit, memory_limit, has_checker, test_case_count, 1700000000 AS created_at "
               "FROM pp WHERE partkey % 50 = 0")
# M1-M3 one after the other
_LOG = _REGT + """,
pt AS (SELECT id, CASE WHEN partkey % 2 = 0 THEN NULL ELSE 'patched ' || title END AS title,
              CASE WHEN partkey % 4 = 1 THEN NULL ELSE time_limit * 2 END AS time_limit, partkey % 9 = 1 AS checker_set
       FROM problems WHERE partkey % 3 = 1
       UNION ALL SELECT 'Z' || id, 'ghost', NULL, false FROM problems WHERE partkey % 100 = 1),
""" + ", ".join([
    _upsert_step("regt", _FIRST_UPSERT.format(1700000000), "t10"),
    _patch_step("t10", "SELECT * FROM pt", "t15"),
    _upsert_step("t15", _SECOND_UPSERT, "t20"),
    "t25 AS (SELECT * FROM t20 WHERE id NOT IN (SELECT id FROM pp WHERE p_size % 7 = 0))",
    _upsert_step("t25", _NEW_UPSERT, "t30"),
    _patch_step("t30", "SELECT id, 'late ' || id AS title, time_limit, checker_set FROM pt", "t33"),
    _upsert_step("t33", _FIRST_UPSERT.format(1800000000) + " AND right(id, 1) IN ('A', 'B')", "t40"),
    _patch_step("t40", "SELECT id, CAST(NULL AS VARCHAR) AS title, 77 AS time_limit, checker_set FROM pt", "t45")])

SQL["stream_registry_changes"] = _with(_LOG) + "SELECT " + _reg_cols("t45") + " FROM t45"
SQL["registry_rejects"] = _with(_LOG) + " UNION ALL ".join(
    f"SELECT id, {seq} AS seq, 'Problem not found' AS reject_reason FROM pt WHERE id NOT IN (SELECT id FROM {before})"
    for seq, before in ((15, "t10"), (33, "t30"), (45, "t40")))


# --------------------------------------------------------------------------
# SRC1-SRC3, SNK2, SNK3, U1, U4
# --------------------------------------------------------------------------

SQL["scan_candidates"] = SQL["eligible_problems"]
SQL["scan_dir_lineage"] = _with(A.PROBLEMS_SQL) + "SELECT id, right(id, 1) AS letter, true AS has_source, true AS has_output FROM problems"
SQL["scan_tolerant"] = _with(A.PROBLEMS_SQL) + "SELECT id FROM problems"
SQL["scan_skipped"] = """SELECT 'broken.parquet' AS file, CAST(NULL AS BIGINT) AS row_group, CAST(NULL AS BIGINT) AS n_rows,
       'not a Parquet file' AS reason"""
SQL["append_generations"] = _with(A.SUBMISSIONS_SQL) + """
SELECT id, CASE WHEN id % 3 <> 1 THEN CAST(time_used AS BIGINT) END AS time_used, CASE WHEN id % 3 = 1 THEN status END AS status,
       CASE id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 END AS no, CASE id % 3 WHEN 0 THEN CAST(time_used AS DOUBLE) WHEN 1 THEN time_used / 4 END AS ms,
       CASE WHEN id % 3 = 1 THEN status END AS note FROM submissions"""
SQL["ingest_rejects"] = "WITH lines AS (" + SQL["export_test_results"] + """),
d AS (SELECT value AS v, length(value) % 5 AS n FROM lines)
SELECT CASE n WHEN 0 THEN v || ';x' ELSE 'x' || v END AS value, CASE n WHEN 0 THEN 13 ELSE 12 END AS n_items FROM d WHERE n <= 1"""
SQL["append_widening"] = _with(A.SUBMISSIONS_SQL) + """
SELECT id, CAST(time_used AS BIGINT) AS time_used, CASE WHEN id % 2 = 0 THEN status END AS status FROM submissions"""
SQL["skip_existing_output"] = _with(A.PROBLEMS_SQL) + """
SELECT DISTINCT right(id, 1) || '_passed_incorrect.parquet' AS source_file, right(id, 1) || '_filtered.parquet' AS output_file
FROM problems WHERE right(id, 1) NOT IN ('A', 'C')"""
SQL["checker_udf"] = _with(A.OUTPUTS_SQL) + """
SELECT output_id,
       CASE WHEN regexp_split_to_array(regexp_replace(actual, '^[ \\t\\n\\r]+|[ \\t\\n\\r]+$', '', 'g'), '[ \\t\\n\\r]+')
               = regexp_split_to_array(regexp_replace(expected, '^[ \\t\\n\\r]+|[ \\t\\n\\r]+$', '', 'g'), '[ \\t\\n\\r]+')
            THEN 'ok' ELSE 'wa' END AS outcome
FROM outputs"""
SQL["evaluator_hook"] = _with(SUBMISSION_RESULT_SQL, A.SUBMISSION_LISTS_SQL) + """
SELECT s.submission_id AS request_id, r.status AS verdict, r.status IS NOT NULL AS success
FROM submission_lists s LEFT JOIN submission_result r ON r.submission_id = s.submission_id"""


# --------------------------------------------------------------------------
# T1-T3 with a constraint table
# --------------------------------------------------------------------------

_TEXTS = """
ot AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderkey % 13 AS m, CAST(o_orderdate AS DATE) AS d, o_orderpriority AS set_id,
              CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders),
o2 AS (SELECT *, (cents // 100) || '.' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0') AS two FROM ot),
texts AS (SELECT k AS text_id, set_id, concat_ws(' ', k,
              CASE m WHEN 2 THEN '+' || c WHEN 3 THEN repeat(CAST(c AS VARCHAR), 40) ELSE CAST(c AS VARCHAR) END,
              year(d), CASE m WHEN 1 THEN lpad(CAST(month(d) AS VARCHAR), 2, '0') ELSE CAST(month(d) AS VARCHAR) END, day(d),
              CASE m WHEN 4 THEN two || '0' WHEN 5 THEN '-0.00' WHEN 6 THEN '0' || two WHEN 7 THEN '-' || two ELSE two END,
              CASE m WHEN 8 THEN 'nan' WHEN 9 THEN NULL ELSE two[1:1] || '.' || cents || 'e' || (k % 9 - 2) END) AS text FROM o2),
sets AS (SELECT o_orderpriority AS set_id, max(o_custkey) AS c, max(year(CAST(o_orderdate AS DATE))) AS y FROM orders GROUP BY 1),
cons AS (SELECT set_id, 1 AS first, 1 AS last, 'uint' AS kind, '2' AS lo, '30000000' AS hi, '' AS name, NULL AS base, NULL AS a, NULL AS b FROM sets
         UNION ALL SELECT set_id, 2, 2, 'int', '1', CAST(c // 2 AS VARCHAR), 'customer', NULL, NULL, NULL FROM sets
         UNION ALL SELECT set_id, 3, 5, 'int', '2', CAST(y - 1 AS VARCHAR), 'date', 1, NULL, NULL FROM sets
         UNION ALL SELECT set_id, 4, 4, 'int', '-10000000', '11', '', 0, NULL, NULL FROM sets
         UNION ALL SELECT set_id, 6, 6, 'strict', '0', '200000.5', 'price', NULL, 2, 2 FROM sets
         UNION ALL SELECT set_id, 6, NULL, 'double', '0.00002', '1234567.5', 'value', 0, NULL, NULL FROM sets
         UNION ALL SELECT set_id, 7, 8, 'double', '0', '1e9', '', 1, NULL, NULL FROM sets),
split AS (SELECT text_id, set_id, list_append(string_split(text, ' '), NULL) AS s FROM texts),
tok AS (SELECT text_id, set_id, unnest(s) AS token, unnest(range(1, len(s) + 1)) AS position FROM split),
j AS (SELECT t.*, c.kind, c.name, c.base + t.position - c.first AS index, c.lo, c.hi, c.a, c.b,
             CASE WHEN length(token) <= 64 THEN token ELSE token[1:30] || '...' || token[-31:] END AS shown,
             TRY_CAST(token AS DOUBLE) AS v, TRY_CAST(lo AS DOUBLE) AS vlo, TRY_CAST(hi AS DOUBLE) AS vhi,
             TRY_CAST(token AS BIGINT) AS n, CASE WHEN contains(token, '.') THEN length(split_part(token, '.', 2)) ELSE 0 END AS after
      FROM tok t JOIN cons c ON t.set_id = c.set_id AND t.position >= c.first AND (c.last IS NULL OR t.position <= c.last)
      WHERE t.token IS NOT NULL OR c.last IS NOT NULL),
f AS (SELECT *,
        CASE kind WHEN 'int' THEN CASE WHEN NOT regexp_full_match(token, '-?(0|[1-9][0-9]*)') OR token = '-0' OR length(token) > 20
                                            OR n IS NULL THEN 'integer' END
                  WHEN 'uint' THEN CASE WHEN NOT regexp_full_match(token, '0|[1-9][0-9]*') OR length(token) > 20 THEN 'unsigned integer' END
                  WHEN 'double' THEN CASE WHEN NOT regexp_full_match(token, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?')
                                          THEN 'double' END
                  ELSE CASE WHEN NOT regexp_full_match(token, '-?[0-9]+(\\.[0-9]+)?') THEN 'strict double'
                            WHEN after < a OR after > b THEN 'strict double with number of digits after point in range [2,2]'
                            WHEN regexp_matches(token, '^-?0[0-9]') THEN 'strict double' END END AS fault,
        CASE kind WHEN 'int' THEN n < CAST(vlo AS BIGINT) OR n > CAST(vhi AS BIGINT)
                  WHEN 'uint' THEN n < CAST(vlo AS BIGINT) OR n > CAST(vhi AS BIGINT) ELSE v < vlo OR v > vhi END AS outside,
        CASE kind WHEN 'int' THEN 'Integer' WHEN 'uint' THEN 'Unsigned integer' WHEN 'double' THEN 'Double' ELSE 'Strict double' END AS label,
        CASE WHEN kind IN ('int', 'uint') THEN token ELSE format('{:g}', v) END AS shown_value,
        CASE WHEN kind IN ('int', 'uint') THEN CASE lo WHEN '-10000000' THEN '-10^7' ELSE lo END ELSE format('{:g}', vlo) END AS shown_lo,
        CASE WHEN kind IN ('int', 'uint') THEN CASE hi WHEN '30000000' THEN '3*10^7' ELSE hi END ELSE format('{:g}', vhi) END AS shown_hi
      FROM j),
viol AS (SELECT text_id, set_id, position, token, kind, name, index,
        CASE WHEN token IS NULL THEN 'unexpected_eof' WHEN fault IS NOT NULL THEN 'pe'
             WHEN kind = 'strict' AND starts_with(token, '-') AND v >= 0 THEN 'pe' WHEN outside THEN 'wa' END AS outcome,
        CASE WHEN token IS NULL THEN 'Unexpected end of file - ' || CASE kind WHEN 'int' THEN 'int64' WHEN 'uint' THEN 'int64'
                                                                    WHEN 'strict' THEN 'strict double' ELSE 'double' END || ' expected'
             WHEN fault IS NOT NULL THEN 'Expected ' || fault || ', but "' || shown || '" found'
             WHEN kind = 'strict' AND starts_with(token, '-') AND v >= 0 THEN 'Redundant minus in "' || shown || '" found'
             WHEN outside THEN label || CASE WHEN name <> '' AND index IS NOT NULL THEN ' element ' || name || '[' || index || '] equals to ' || shown_value || ','
                                             WHEN index IS NOT NULL THEN ' element [index=' || index || '] equals to ' || shown_value || ','
                                             WHEN name <> '' THEN ' parameter [name=' || name || '] equals to ' || shown_value || ','
                                             ELSE ' ' || shown_value END
                  || ' violates the range [' || shown_lo || ', ' || shown_hi || ']' END AS message FROM f),
found AS (SELECT * FROM viol WHERE message IS NOT NULL)"""

SQL["validate_constraints"] = _with(_TEXTS) + "SELECT * FROM found"

SQL["first_violations"] = _with(_TEXTS) + """
SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY text_id, set_id ORDER BY position, kind, name, message) = 1"""

SQL["validator_udf"] = """
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls, text FROM documents),
w AS (SELECT doc_id, len(ls) AS n_lines, len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda x: x <> '')) AS n_words,
             list_position(list_transform(ls, lambda x: length(x) > 1000), true) AS long_line FROM l)
SELECT doc_id AS text_id, coalesce(long_line, 0) = 0 AS ok,
       CASE WHEN coalesce(long_line, 0) = 0 THEN '' ELSE 'line ' || long_line || ' is longer than 1000 characters' END AS message,
       v.variable, CAST(CASE v.variable WHEN 'n_lines' THEN n_lines ELSE n_words END AS DOUBLE) AS value
FROM w, (VALUES ('n_lines'), ('n_words')) v(variable)"""

SQL["validator_overview"] = """
WITH d AS (SELECT doc_id, lang, text, len(string_split(text, chr(10))) AS lines,
                  len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS words FROM documents),
o AS (SELECT bool_or(lines = 1) AS l1, bool_or(lines = 1000) AS l2, bool_or(words = 1) AS w1, bool_or(abs(words / 4 - 0.25) < 1e-12) AS s1,
             count(DISTINCT lang = 'de') AS bounds, max(CASE WHEN lang = 'de' THEN '20000' ELSE '21000' END) AS most,
             bool_or(lines > 1) AS several, bool_or(regexp_matches(text, '[0-9]')) AS digits FROM d)
SELECT 'bounds' AS section, 'lines' AS name, '"lines":' || CASE WHEN l1 THEN ' min-value-hit' ELSE '' END
       || CASE WHEN l2 THEN ' max-value-hit' ELSE '' END AS line FROM o
UNION ALL SELECT 'bounds', 'words', '"words":' || CASE WHEN w1 THEN ' min-value-hit' ELSE '' END || ' max-value-hit' FROM o
UNION ALL SELECT 'bounds', 'share', '"share":' || CASE WHEN s1 THEN ' min-value-hit' ELSE '' END FROM o
UNION ALL SELECT 'constant', 'lines', 'constant-bounds "lines": 1 1000'
UNION ALL SELECT 'constant', 'words', 'constant-bounds "words": 1 ' || CASE WHEN bounds = 1 THEN most ELSE '?' END FROM o
UNION ALL SELECT 'constant', 'share', 'constant-bounds "share": 0.25 ?'
UNION ALL SELECT 'feature', 'several lines', 'feature "several lines":' || CASE WHEN several THEN ' hit' ELSE '' END FROM o
UNION ALL SELECT 'feature', 'digits', 'feature "digits":' || CASE WHEN digits THEN ' hit' ELSE '' END FROM o
UNION ALL SELECT 'feature', 'never', 'feature "never":'
UNION ALL SELECT 'variable', v.n, 'variable "' || v.n || '"' FROM (VALUES ('lines'), ('words'), ('share')) v(n)"""

SQL["scorer_states"] = _with(_TR, """,
pg AS (SELECT submission_id, "group", sum(coalesce(points, 0)) AS gp, bool_and(verdict = 'OK') AS all_ok, max(timeConsumed) AS slowest
       FROM tr GROUP BY submission_id, "group")""") + """
SELECT submission_id, round(sum(CASE WHEN all_ok THEN gp ELSE 0 END) - 0.25 * ceil(max(slowest) / 1000), 3) AS score
FROM pg GROUP BY submission_id"""
