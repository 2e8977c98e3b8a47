"""Fixed values that must equal the judging system's own.

Everything in this module is a fixed value: status strings, limits,
defaults, message formats and exit codes. They are listed plainly and
together so that a change of any of them is a visible, single edit.
"""

# ---- fixed values: verdict strings (closed set of nine) ----
PENDING = "Pending"
JUDGING = "Judging"
ACCEPTED = "Accepted"
WRONG_ANSWER = "Wrong Answer"
TIME_LIMIT = "Time Limit Exceeded"
MEMORY_LIMIT = "Memory Limit Exceeded"
RUNTIME_ERROR = "Runtime Error"
COMPILE_ERROR = "Compile Error"
SYSTEM_ERROR = "System Error"
STATUSES = [PENDING, JUDGING, ACCEPTED, WRONG_ANSWER, TIME_LIMIT,
            MEMORY_LIMIT, RUNTIME_ERROR, COMPILE_ERROR, SYSTEM_ERROR]

# ---- fixed values: languages accepted by the judge ----
LANGUAGES = ["cpp", "c++11", "c++14", "c++17", "c++20", "c++23", "python"]
# compiler versions tried by the multi-version curation, in order
CPP_VERSIONS = ["c++14", "c++17", "c++20", "c++23"]
# standards tried by the single-version compile gate
COMPILE_STANDARDS = ["c++11", "c++14", "c++17", "c++20", "c++23"]

# ---- fixed values: limits and defaults ----
DEFAULT_TIME_LIMIT_MS = 1000
DEFAULT_MEMORY_LIMIT_MB = 256
MAX_OUTPUT_BYTES = 10 * 1024 * 1024
MAX_INPUT_BYTES = 10 * 1024 * 1024
KILL_GRACE_MS = 500
CHECKER_TIMEOUT_S = 10.0
CASE_RETRY_MAX = 3          # attempts per case for TLE and SE, in total
SUBMIT_RETRY_MAX = 2        # tries per version for System Error
RECENT_LIMIT = 50

# ---- fixed values: message cuts by origin ----
CUT_COMPILE = 2000
CUT_CHECKER = 500
CUT_PREVIEW_OUTPUT = 2000
CUT_PREVIEW_EXPECTED = 1000

# ---- fixed values: message formats ----
MSG_EXIT_CODE = "Exit code: %d"
MSG_OUTPUT_TOO_LARGE = "Output too large: %d bytes (limit: %d)"
MSG_CHECKER_TIMEOUT = "Checker timeout on test %s"
MSG_PASSED = "Passed %d/%d test cases"
MSG_EXTRA_OUTPUT = "Extra information in the output file"
HACK_URL = ("https://codeforces.com/contest/%s/hacks"
            "?verdictName=CHALLENGE_SUCCESSFUL&chosenProblemIndex=%s")

# ---- fixed values: checker outcomes and exit codes ----
# outcome name -> exit code per dialect. unexpected_eof is reported with
# the presentation-error code unless a build enables its own code (8).
# "partially k" exits with PARTIAL_BASE[dialect] + k.
CHECKER_EXIT = {
    "default":   {"ok": 0, "wa": 1, "pe": 2, "fail": 3, "dirt": 4, "points": 7},
    "ejudge":    {"ok": 0, "wa": 5, "pe": 4, "fail": 6, "dirt": 6, "points": 7},
    "contester": {"ok": 0xAC, "wa": 0xAB, "pe": 0xAA, "fail": 0xA3, "dirt": 4, "points": 7},
    "testsys":   {"ok": 0, "wa": 1, "pe": 2, "fail": 3, "dirt": 4, "points": 7},
}
UNEXPECTED_EOF_EXIT = 8
PARTIAL_BASE = {"default": 0, "ejudge": 0, "contester": 0, "testsys": 50}
# verdicts of result lines
TEST_RESULT_VERDICTS = ["SKIPPED", "OK", "WRONG_ANSWER", "RUNTIME_ERROR", "TIME_LIMIT_EXCEEDED",
                        "IDLENESS_LIMIT_EXCEEDED", "MEMORY_LIMIT_EXCEEDED", "COMPILATION_ERROR",
                        "CRASHED", "FAILED"]

# ---- fixed values: numeric comparison ----
DOUBLE_EPS_EXTRA = 1e-15
DOUBLE_INF_MAGNITUDE = 1e300
DOUBLE_ABS_ONLY_BELOW = 1e-9
POINTS_EPS = 1e-8
POINTS_MAX = 1e6
BOUND_DELTA = 1e-12
MAX_CONST_BOUND_CHARS = 32

# ---- fixed values: token limits ----
MAX_INT_TOKEN_CHARS = 20
MAX_STRICT_DOUBLE_CHARS = 1000
INT64_MIN = -9223372036854775808
INT64_MAX = 9223372036854775807
UINT64_MAX = 18446744073709551615

# ---- fixed values: messages of token checks ----
MSG_EXPECTED = "Expected %s, but \"%s\" found"
MSG_EXPECTED_NUL = "Expected %s, but \"%s\" found (it contains \\0)"
MSG_EXPECTED_EOF = "Unexpected end of file - %s expected"
MSG_DIGITS_AFTER_POINT = "strict double with number of digits after point in range [%s,%s]"
MSG_REDUNDANT_MINUS = "Redundant minus in \"%s\" found"
# of a range violation; 1 label, 2 name, 3 index, 4 value, 5 and 6 bounds
MSG_RANGE = "%1$s %4$s violates the range [%5$s, %6$s]"
MSG_RANGE_NAME = "%1$s parameter [name=%2$s] equals to %4$s, violates the range [%5$s, %6$s]"
MSG_RANGE_INDEX = "%1$s element [index=%3$s] equals to %4$s, violates the range [%5$s, %6$s]"
MSG_RANGE_NAME_INDEX = "%1$s element %2$s[%3$s] equals to %4$s, violates the range [%5$s, %6$s]"
# ---- fixed values: lines of a test overview ----
LOG_BOUNDS = "\"%s\":%s%s"
LOG_MIN_HIT, LOG_MAX_HIT = " min-value-hit", " max-value-hit"
LOG_CONSTANT = "constant-bounds \"%s\": %s %s"
LOG_FEATURE = "feature \"%s\":%s"
LOG_FEATURE_HIT = " hit"
LOG_VARIABLE = "variable \"%s\""
ERR_FEATURE_TWICE, ERR_FEATURE_UNKNOWN = "feature declared twice", "feature not declared"

# ---- fixed values: kinds of checked tokens ----
# kind -> (expected what, at the end of the text, label of a range violation)
TOKEN_KINDS = {
    "int": ("integer", "int64", "Integer"),
    "uint": ("unsigned integer", "int64", "Unsigned integer"),
    "double": ("double", "double", "Double"),
    "strict": ("strict double", "strict double", "Strict double"),
}
# a shown token keeps so many characters; a longer one its first 30 and last 31
SHOWN_TOKEN_CHARS, SHOWN_HEAD, SHOWN_TAIL = 64, 30, 31
# bounds with at least so many trailing zeroes are shown as powers of ten
SHOWN_ZEROES = 7

# characters Python's str.isspace() accepts below U+D800; Java's \s is
# narrower, so right-strips use this explicit class
PY_SPACE_CLASS = ("[\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a"
                  "\\u2028\\u2029\\u202f\\u205f\\u3000]")
