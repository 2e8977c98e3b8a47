"""Text column functions: output normal form (V2), code hash (P5), blank
test (P3), hack url (P4), fixed-point text (P7 and the slow registry)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from judgelake import constants as K

# Python's str.isspace() class without the line feed: what a per-line
# rstrip() removes before the line end.
_LINE_SPACE = ("[\\t\\x0b\\x0c\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a"
               "\\u2028\\u2029\\u202f\\u205f\\u3000]")

# the same set as literal characters, for engines without look-ahead
PY_SPACE_CHARS = "".join(
    chr(c) for c in [9, 11, 12, 13, *range(28, 33), 0x85, 0xA0, 0x1680,
                     *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])


def output_normal_form(text: Column) -> Column:
    """Normal form under which two outputs are equal for the judge:
    universal newlines, each line right-stripped (Python whitespace), and
    trailing empty lines dropped. Leading blanks and inner blank lines stay.
    NULL (no file) stays NULL."""
    s = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    lines = F.transform(F.split(s, "\n", -1), lambda x: F.rtrim(x, F.lit(PY_SPACE_CHARS)))
    return F.rtrim(F.array_join(lines, "\n"), F.lit("\n"))


def output_equal(actual: Column, expected: Column) -> Column:
    """V2: True when the normal forms agree. A missing side is a failure
    (the reference returns False on any read error)."""
    same = (actual == expected) | (output_normal_form(actual) == output_normal_form(expected))
    return F.coalesce(same, F.lit(False))


def output_hash(text: Column) -> Column:
    """Fixed-width key of the normal form, to join or shuffle on instead of
    the (possibly 10 MiB) text itself."""
    return F.sha2(output_normal_form(text), 256)


def is_blank(code: Column) -> Column:
    """NULL or whitespace-only text (Python strip() semantics)."""
    stripped = F.regexp_replace(code, "^" + "[\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a"
                                "\\u2028\\u2029\\u202f\\u205f\\u3000]*\\z", "")
    return code.isNull() | (F.length(stripped) == 0)


def nonblank(code: Column) -> Column:
    return ~is_blank(code)


def code_hash(code: Column, language: Column | None = None) -> Column:
    """P5: md5 hex of the text; NULL or empty -> ''. With a language the
    key is md5(code + language), the compiled-program cache key."""
    text = code if language is None else F.concat(code, language)
    return F.when(code.isNull() | (code == ""), F.lit("")).otherwise(F.md5(text))


def hack_url(problem_id: Column) -> Column:
    """Contest and index are items 0 and 1 of the id split on '_'."""
    parts = F.split(problem_id, "_", -1)
    contest = F.coalesce(F.get(parts, 0), F.lit(""))
    index = F.coalesce(F.get(parts, 1), F.lit(""))
    return F.format_string(K.HACK_URL, contest, index)


def fixed_text(x: Column, digits: int) -> Column:
    """Deterministic ``%.{digits}f`` for non-negative doubles below 9e18 /
    10**digits: round half up on x * 10**digits, rendered with integer
    arithmetic so every engine prints the same text."""
    scale = 10 ** digits
    n = F.floor(x * scale + 0.5).cast("bigint")
    whole = F.floor(n / F.lit(scale)).cast("bigint")
    frac = F.lpad((n % F.lit(scale)).cast("string"), digits, "0")
    return F.concat(whole.cast("string"), F.lit("."), frac)


def strip_trailing_zeroes(text: Column) -> Column:
    """Cut trailing zeroes after the point but keep one digit."""
    cut = F.regexp_replace(text, "(\\.\\d*?)0+\\z", "$1")
    return F.regexp_replace(cut, "\\.\\z", ".0")
