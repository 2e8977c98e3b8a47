"""SNK2: appends of any type. Each append is an immutable generation in its
own types; readers widen all of them to the common type of their footers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from judgelake.streaming import deltas

_WHOLE = [T.ByteType, T.ShortType, T.IntegerType, T.LongType]
_DIGITS = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 19}


def common_type(a: T.DataType, b: T.DataType) -> T.DataType:
    """The least type that holds both: wider numbers, text for text with anything scalar, structs by the
    union of their fields, lists and maps by their parts. TypeError where there is none."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        other = {f.name: f.dataType for f in b}
        own = [T.StructField(f.name, common_type(f.dataType, other[f.name]) if f.name in other else f.dataType) for f in a]
        return T.StructType(own + [T.StructField(f.name, f.dataType) for f in b if f.name not in a.names])
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(common_type(a.elementType, b.elementType))
    if isinstance(a, T.MapType) and isinstance(b, T.MapType):
        return T.MapType(common_type(a.keyType, b.keyType), common_type(a.valueType, b.valueType))
    nested = (T.StructType, T.ArrayType, T.MapType)
    if isinstance(a, nested) or isinstance(b, nested):
        raise TypeError(f"no common type of {a.simpleString()} and {b.simpleString()}")
    if isinstance(a, T.StringType) or isinstance(b, T.StringType):
        return T.StringType()
    if type(a) in _WHOLE and type(b) in _WHOLE:
        return max(a, b, key=lambda t: _WHOLE.index(type(t)))
    if isinstance(a, T.NumericType) and isinstance(b, T.NumericType):
        if isinstance(a, T.FractionalType) and not isinstance(a, T.DecimalType) or isinstance(b, T.FractionalType) and not isinstance(b, T.DecimalType):
            both_float = isinstance(a, (T.FloatType, T.ByteType, T.ShortType)) and isinstance(b, (T.FloatType, T.ByteType, T.ShortType))
            return T.FloatType() if both_float else T.DoubleType()
        places = [(t.precision - t.scale, t.scale) if isinstance(t, T.DecimalType) else (_DIGITS[type(t)], 0) for t in (a, b)]
        whole, scale = (max(p[i] for p in places) for i in (0, 1))
        if whole + scale > 38:
            raise TypeError(f"no common type of {a.simpleString()} and {b.simpleString()}")
        return T.DecimalType(whole + scale, scale)
    times = (T.DateType, T.TimestampNTZType, T.TimestampType)
    if isinstance(a, times) and isinstance(b, times):
        return max(a, b, key=lambda t: times.index(type(t)))
    raise TypeError(f"no common type of {a.simpleString()} and {b.simpleString()}")


def as_type(col: Column, have: T.DataType, want: T.DataType) -> Column:
    """``col`` in the wider type; struct fields go by name, absent ones are NULL."""
    if have == want:
        return col
    if isinstance(want, T.StructType) and isinstance(have, T.StructType):
        fields = [(as_type(col[f.name], have[f.name].dataType, f.dataType) if f.name in have.names
                   else F.lit(None).cast(f.dataType)).alias(f.name) for f in want]
        return F.when(col.isNotNull(), F.struct(*fields))
    if isinstance(want, T.ArrayType) and isinstance(have, T.ArrayType):
        return F.transform(col, lambda x: as_type(x, have.elementType, want.elementType))
    if isinstance(want, T.MapType) and isinstance(have, T.MapType):
        values = F.transform_values(col, lambda k, v: as_type(v, have.valueType, want.valueType))
        return F.transform_keys(values, lambda k, v: as_type(k, have.keyType, want.keyType))
    return col.cast(want)


def widened(df: DataFrame, want: T.StructType) -> DataFrame:
    have = df.schema
    return df.select(*[(as_type(F.col(f"`{f.name}`"), have[f.name].dataType, f.dataType) if f.name in have.names
                        else F.lit(None).cast(f.dataType)).alias(f.name) for f in want])


def append_widening(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both frames as one, in the common type of their schemas."""
    want = common_type(old.schema, new.schema)
    return widened(old, want).unionByName(widened(new, want))


def append_generation(new: DataFrame, base: str) -> int:
    """Add the rows of ``new`` as the next generation, in its own types; its number. Nothing is rewritten, and
    readers see all of it or, after a stop, nothing. One writer at a time."""
    _, done = deltas.state_of(new.sparkSession, base)
    number = done[-1] + 1 if done else 0
    deltas.append(new, number, base)
    return number


def read_generations(spark: SparkSession, base: str) -> DataFrame:
    """All generations in the common type of their footers' schemas."""
    _, done = deltas.state_of(spark, base)
    if not done:
        raise ValueError(f"nothing has been appended under {base}")
    frames = [spark.read.parquet(f"{base}/delta/batch={n}") for n in done]
    want = reduce(common_type, [f.schema for f in frames])
    return reduce(DataFrame.unionByName, [widened(f, want) for f in frames])
