"""Constraint tables over the tokens of texts (T1-T3): ranges of token
positions with a kind, bounds, a name and an index base are joined to the
tokens they cover, and every violated token gets the message the sequential
reader would give.

The join is an interval join on equal keys. A constraint of n positions is
filed at the least level whose blocks hold n positions, so it touches two
blocks at most; a token is looked up in its block of each level in use.
Exact bounds are tested after that."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from judgelake import constants as K
from judgelake.functions.numeric import general_text
from judgelake.operators.validate import INT_RE, UINT_RE, LOOSE_DOUBLE_RE

#: Block sizes are 2**level positions; a range without an end lies in the one block of the top level.
LEVELS = (0, 3, 6, 9, 12, 16, 20, 24, 28)
TOP = 40
#: A constraint table of at most so many rows (keys included) goes to every task; a larger one is shuffled.
MAX_BROADCAST_ROWS = 20_000
#: Salts over which the tokens of one key and block are spread when the table is shuffled.
SALTS = 16

_STRICT_SHAPE = "^(-|[0-9]|[-0-9][0-9]*(\\.[0-9]*)?[0-9])\\z"


def shown_token(token: Column) -> Column:
    """A token as messages show it: NUL as ``~``, the middle of a long one cut out."""
    t = F.translate(token, "\0", "~")
    return F.when(F.length(t) <= K.SHOWN_TOKEN_CHARS, t).otherwise(
        F.concat(F.left(t, F.lit(K.SHOWN_HEAD)), F.lit("..."), F.right(t, F.lit(K.SHOWN_TAIL))))


def shown_bound(n: Column) -> Column:
    """Digits of an integer bound; seven trailing zeroes or more as a power of ten."""
    head = F.regexp_replace(n, "0+\\z", "")
    zeroes = F.length(n) - F.length(head)
    power = F.concat(F.lit("10^"), zeroes.cast("string"))
    return (F.when((n == "0") | (zeroes < K.SHOWN_ZEROES), n)
             .when(head.isin("1", "-1"), F.concat(F.regexp_replace(head, "1", ""), power))
             .otherwise(F.concat(head, F.lit("*"), power)))


def _format_fault(kind: Column, token: Column, least: Column, most: Column) -> Column:
    """What was expected instead of this token, or NULL if its form is right."""
    def expected(name):
        return F.lit(K.TOKEN_KINDS[name][0])
    after = F.when(F.substring(token, 2, 10_000).contains("."), F.length(F.substring_index(token, ".", -1))).otherwise(F.lit(0))
    strict = (F.when(~token.rlike(_STRICT_SHAPE) | (token == "-") | (F.length(token) > K.MAX_STRICT_DOUBLE_CHARS), expected("strict"))
               .when((after < least) | (after > most), F.format_string(K.MSG_DIGITS_AFTER_POINT, least, most))
               .when(token.rlike("^-?0[0-9]|^-\\."), expected("strict"))
               .when(F.abs(token.try_cast("double")) == float("inf"), expected("double")))
    return (F.when(kind == "int", F.when(~token.rlike(INT_RE) | (token == "-0") | (F.length(token) > K.MAX_INT_TOKEN_CHARS)
                                         | token.try_cast("bigint").isNull(), expected("int")))
             .when(kind == "uint", F.when(~token.rlike(UINT_RE) | (F.length(token) > K.MAX_INT_TOKEN_CHARS)
                                          | token.try_cast("decimal(20,0)").isNull()
                                          | (token.try_cast("decimal(20,0)") > F.lit(str(K.UINT64_MAX)).cast("decimal(20,0)")),
                                          expected("uint")))
             .when(kind == "double", F.when(~token.rlike(LOOSE_DOUBLE_RE) | token.try_cast("double").isNull(), expected("double")))
             .when(kind == "strict", strict))


def _range_message(kind: Column, value: Column, lo: Column, hi: Column, name: Column, index: Column) -> Column:
    named, indexed = name != "", index.isNotNull()
    form = (F.when(named & indexed, F.lit(K.MSG_RANGE_NAME_INDEX)).when(indexed, F.lit(K.MSG_RANGE_INDEX))
             .when(named, F.lit(K.MSG_RANGE_NAME)).otherwise(F.lit(K.MSG_RANGE)))
    return F.printf(form, by_kind(kind, 2), name, index.cast("string"), value, lo, hi)


def by_kind(kind: Column, item: int) -> Column:
    """The text at ``item`` of the kind's entry in TOKEN_KINDS."""
    return F.element_at(F.create_map(*[F.lit(x) for k, v in K.TOKEN_KINDS.items() for x in (k, v[item])]), kind)


def shown_limit(kind: Column, bound: Column) -> Column:
    """A bound as messages show it."""
    return F.when(kind.isin("double", "strict"), general_text(bound.try_cast("double"))).otherwise(shown_bound(bound))


def token_violation(kind: Column, token: Column, lo: Column, hi: Column, name: Column, index: Column,
                    least: Column, most: Column, low: Column | None = None, high: Column | None = None) -> Column:
    """struct(outcome, message) of one token under one constraint, NULL if it holds. A
    NULL token is the end of the text. ``lo`` and ``hi`` are texts, parsed by ``kind``;
    ``low`` and ``high`` are their shown forms where they are known already."""
    low, high = (shown_limit(kind, c) if s is None else s for c, s in ((lo, low), (hi, high)))
    shown = shown_token(token)
    fault = _format_fault(kind, token, least, most)
    nul = F.when(token.contains("\0"), F.when(kind == "int", F.lit("integer")).when(kind == "uint", F.lit("unsigned integer"))
                 .otherwise(F.lit("double")))

    def outside(dtype):
        v = token.try_cast(dtype)
        return (v < lo.try_cast(dtype)) | (v > hi.try_cast(dtype))
    real = kind.isin("double", "strict")
    out = (F.when(kind == "int", outside("bigint")).when(kind == "uint", outside("decimal(20,0)")).when(real, outside("double")))
    minus = (kind == "strict") & token.startswith("-") & (token.try_cast("double") >= 0)

    value = F.when(real, general_text(token.try_cast("double"))).otherwise(token)

    def row(outcome, message):
        return F.struct(F.lit(outcome).alias("outcome"), message.alias("message"))
    return (F.when(token.isNull(), row("unexpected_eof", F.format_string(K.MSG_EXPECTED_EOF, by_kind(kind, 1))))
             .when(nul.isNotNull(), row("pe", F.format_string(K.MSG_EXPECTED_NUL, nul, shown)))
             .when(fault.isNotNull(), row("pe", F.format_string(K.MSG_EXPECTED, fault, shown)))
             .when(minus, row("pe", F.format_string(K.MSG_REDUNDANT_MINUS, shown)))
             .when(out, row("wa", _range_message(kind, value, low, high, name, index))))


def _filed(constraints: DataFrame) -> DataFrame:
    """Each constraint once per block of its level (one or two blocks)."""
    n = F.col("last") - F.col("first") + 1
    level = F.lit(TOP)
    for k in reversed(LEVELS):
        level = F.when(n <= 2 ** k, F.lit(k)).otherwise(level)
    c = constraints.where(F.col("last").isNull() | (F.col("last") >= F.col("first")))
    c = c.withColumn("_level", F.when(F.col("last").isNull(), F.lit(TOP)).otherwise(level))
    blocks = F.when(F.col("_level") == TOP, F.array(F.lit(0).cast("bigint"))).otherwise(F.array_distinct(F.array(
        F.expr("shiftright(cast(first as bigint), _level)"), F.expr("shiftright(cast(last as bigint), _level)"))))
    return c.withColumn("_block", F.explode(blocks))


def validate_constraints(texts: DataFrame, constraints: DataFrame, by: list[str] | None = None,
                         text_col: str = "text") -> DataFrame:
    """T1-T3 with a constraint table: the columns of ``texts`` but the text, and per
    violated token ``position`` (from 1), ``token`` (NULL past the end of the text),
    ``kind``, ``name``, ``index``, ``outcome`` and ``message``.

    ``constraints``: the ``by`` columns (the texts a row applies to; none: all texts), ``first``,
    ``last`` (positions; NULL last: to the end of the text), ``kind`` (int, uint, double, strict),
    ``lo``, ``hi`` (texts), ``name`` ('' or NULL: none), ``index_base`` (NULL: not an array),
    ``min_digits``, ``max_digits`` (strict only). Ranges may overlap; each is checked. A range with
    an end that reaches past the text's last token gives one violation there.

    A table of up to MAX_BROADCAST_ROWS filed rows goes to all tasks; a larger one is
    shuffled on key and block, with the tokens of a block spread over salts.
    """
    by = list(by or [])
    filed = _filed(constraints)
    levels = sorted(r["_level"] for r in filed.select("_level").distinct().collect())  # ten values at most
    trimmed = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), "^[ \\t\\n\\r]+|[ \\t\\n\\r]+\\z", "")
    tokens = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \\t\\n\\r]+", -1))
    with_end = F.concat(tokens, F.array(F.lit(None).cast("string")))
    keep = [c for c in texts.columns if c != text_col]
    t = texts.select(*keep, F.posexplode(with_end).alias("_i", "token"))
    t = t.withColumn("position", (F.col("_i") + 1).cast("bigint")).drop("_i")
    t = t.withColumn("_at", F.explode(F.array(*[F.struct(
        F.lit(k).alias("_level"), F.expr(f"shiftright(position, {k})").alias("_block")) for k in levels] or
        [F.struct(F.lit(-1).alias("_level"), F.lit(0).cast("bigint").alias("_block"))])))
    t = t.select(*keep, "position", "token", "_at._level", "_at._block")
    c = filed.select(*by, "_level", "_block", F.col("first").alias("_first"), F.col("last").alias("_last"), F.col("kind").alias("_kind"),
                     F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), shown_limit(F.col("kind"), F.col("lo")).alias("_low"),
                     shown_limit(F.col("kind"), F.col("hi")).alias("_high"), F.coalesce("name", F.lit("")).alias("_name"),
                     F.col("index_base").alias("_base"), F.coalesce("min_digits", F.lit(0)).alias("_least"),
                     F.coalesce("max_digits", F.lit(K.MAX_STRICT_DOUBLE_CHARS)).alias("_most"))
    on = [*by, "_level", "_block"]
    if c.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS:
        j = t.join(F.broadcast(c), on)
    else:
        t = t.withColumn("_salt", F.pmod(F.xxhash64("position", "token", *keep), F.lit(SALTS)).cast("int"))
        c = c.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        j = t.join(c, [*on, "_salt"])
    p = F.col("position")
    j = j.where((p >= F.col("_first")) & (F.col("_last").isNull() | (p <= F.col("_last")))
                & (F.col("token").isNotNull() | F.col("_last").isNotNull()))
    index = (F.col("_base") + p - F.col("_first")).cast("bigint")
    v = token_violation(F.col("_kind"), F.col("token"), F.col("_lo"), F.col("_hi"), F.col("_name"), index, F.col("_least"), F.col("_most"),
                        F.col("_low"), F.col("_high"))
    # the generator keeps the rule in one place of the plan: it is not copied into the filter
    return (j.withColumn("_i", index).withColumn("_v", F.explode(F.array(v))).where(F.col("_v").isNotNull())
             .select(*keep, "position", "token", F.col("_kind").alias("kind"), F.col("_name").alias("name"), F.col("_i").alias("index"),
                     "_v.outcome", "_v.message"))


def first_violations(violations: DataFrame, keys: list[str]) -> DataFrame:
    """What a reader that stops at the first fault reports: per text the violation of the
    least position (at one position: of the constraint with the least kind, name and message)."""
    rest = [c for c in violations.columns if c not in keys]
    order = ["position", "kind", "name", "message"]
    first = F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("_f")
    return violations.groupBy(*keys).agg(first).select(*keys, *[F.col(f"_f.{c}").alias(c) for c in rest])
