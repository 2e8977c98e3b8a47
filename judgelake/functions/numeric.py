"""Numeric comparison columns (V6, V7) and points normalisation.

Spark orders NaN above every number and makes NaN = NaN true, so each rule
tests ``isnan`` first and never leans on NaN ordering.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from judgelake import constants as K
from judgelake.functions.text import fixed_text, strip_trailing_zeroes


def _is_inf(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) > K.DOUBLE_INF_MAGNITUDE)


def numeric_equal(expected: Column, actual: Column, eps: float) -> Column:
    """V6: equal within absolute or relative error eps (+1e-15); NaN equals
    NaN only; infinities (|x| > 1e300) match by sign."""
    e = eps + K.DOUBLE_EPS_EXTRA
    lo = F.least(expected * (1.0 - e), expected * (1.0 + e))
    hi = F.greatest(expected * (1.0 - e), expected * (1.0 + e))
    return (F.when(expected.isNull() | actual.isNull(), F.lit(None).cast("boolean"))
             .when(F.isnan(expected), F.isnan(actual))
             .when(_is_inf(expected),
                   F.when(expected > 0, ~F.isnan(actual) & (actual > 0) & _is_inf(actual))
                    .otherwise(~F.isnan(actual) & (actual < 0) & _is_inf(actual)))
             .when(F.isnan(actual) | _is_inf(actual), F.lit(False))
             .when(F.abs(actual - expected) <= e, F.lit(True))
             .otherwise((actual >= lo) & (actual <= hi)))


def numeric_error(expected: Column, actual: Column) -> Column:
    """V7 error: min(absolute, relative), absolute only when |expected| <= 1e-9."""
    absolute = F.abs(actual - expected)
    return F.when(F.abs(expected) > K.DOUBLE_ABS_ONLY_BELOW,
                  F.least(absolute, F.abs(absolute / expected))).otherwise(absolute)


def points_normalise(points: Column) -> Column:
    """P7 -> struct(points, text, failed, reason).

    NaN, infinite, < -1e-8 or > 1e6 + 1e-8 fail; otherwise clamp to
    [0, 1e6] and render ``%.10f`` with trailing zeroes cut (one kept)."""
    reason = (F.when(F.isnan(points), F.lit("Parameter 'points' can't be nan"))
               .when(_is_inf(points), F.lit("Parameter 'points' can't be infinite"))
               .when(points < -K.POINTS_EPS, F.lit("Parameter 'points' can't be negative"))
               .when(points > K.POINTS_MAX + K.POINTS_EPS,
                     F.lit("Parameter 'points' can't be greater than 1E6")))
    failed = reason.isNotNull()
    clamped = F.when(points <= 0.0, F.lit(0.0)).when(points >= K.POINTS_MAX, F.lit(K.POINTS_MAX)).otherwise(points)
    value = F.when(failed, F.lit(None).cast("double")).otherwise(clamped)
    text = F.when(failed, F.lit(None).cast("string")).otherwise(strip_trailing_zeroes(fixed_text(clamped, 10)))
    return F.struct(value.alias("points"), text.alias("text"), failed.alias("failed"), reason.alias("reason"))


def general_text(x: Column) -> Column:
    """A double with six significant digits: plain from 1e-4 to below 1e6, else with an
    exponent of two digits or more; trailing zeroes are cut, infinities are ``inf``.
    Halves go to the even digit, and what is a half is told from the exact value (from
    0.001 on; below, from the shortest decimal form)."""
    seen = F.struct(F.abs(x).alias("size"), F.format_string("%.5e", x).alias("shown"))
    return once(seen, lambda v: once(_scaled(v["size"], v["shown"]), lambda w: once(
        F.struct(w["exponent"].alias("exponent"), w["shown"].alias("shown"), w["size"].alias("size"), _six_digits(w).alias("digits")),
        _placed)))


def once(value: Column, fn) -> Column:
    """``fn`` of a value that is computed once, however often ``fn`` uses it."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def _scaled(size: Column, shown: Column) -> Column:
    """The value with the places after its sixth digit as a fraction: rounded down, and how it is scaled."""
    exponent = F.substring_index(shown, "e", -1).try_cast("int")
    k = F.lit(5) - exponent
    scale = F.pow(F.lit(10.0), F.abs(k))
    below = F.floor(F.when(k >= 0, size * scale).otherwise(size / scale))
    high = size * 134217729.0 - (size * 134217729.0 - size)
    return F.struct(size.alias("size"), shown.alias("shown"), exponent.alias("exponent"), k.alias("k"), scale.alias("scale"),
                    below.alias("below"), high.alias("high"))


def _six_digits(w: Column) -> Column:
    size, k, scale, below, high = (w[c] for c in ("size", "k", "scale", "below", "high"))
    # twice the scaled value less the odd number between two results; both halves of a split value multiply exactly
    odd = below * 2.0 + 1
    rest = F.when(k >= 0, (high * (scale * 2.0) - odd) + (size - high) * (scale * 2.0)).otherwise(size - odd * (scale / 2.0))
    exact = below.cast("bigint") + F.when(rest > 0, F.lit(1)).when(rest == 0, below.cast("bigint") % 2).otherwise(F.lit(0))
    return F.when(k.between(-9, 7) & (below >= 99_999) & (below < 999_999), exact.cast("string")).otherwise(
        F.regexp_replace(F.substring_index(w["shown"], "e", 1), "[-.]", ""))


def _placed(w: Column) -> Column:
    exponent, shown, digits = w["exponent"], w["shown"], w["digits"]
    padded = F.concat(F.repeat(F.lit("0"), F.greatest(-exponent, F.lit(0))), digits)
    whole = F.greatest(exponent, F.lit(0)) + 1
    plain = F.concat(F.left(padded, whole), F.lit("."), F.substring(padded, whole + 1, F.length(padded)))
    power = F.concat(F.left(digits, F.lit(1)), F.lit("."), F.substring(digits, F.lit(2), F.lit(5)))
    text = F.when(w["size"] == float("inf"), F.lit("inf")).when(exponent.between(-4, 5), _cut_zeroes(plain)).otherwise(
        F.concat(_cut_zeroes(power), F.lit("e"), F.substring_index(shown, "e", -1)))
    return F.concat(F.when(shown.startswith("-"), F.lit("-")).otherwise(F.lit("")), text)


def _cut_zeroes(text: Column) -> Column:
    return F.regexp_replace(text, "\\.?0*\\z", "")
