"""Schemas that change between loads: one table schema that holds them all.

Columns go by name.  A column that a load does not have is NULL there; a new one is added at the
end.  Where types differ, the table takes the least type that holds both: integers widen, with
decimals they become decimals, with floating point doubles, dates become timestamps, and all
else that is not nested becomes text.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INTEGERS = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 20}
_TIMES = (T.DateType, T.TimestampNTZType, T.TimestampType)
_NESTED = (T.StructType, T.ArrayType, T.MapType, T.BinaryType)


def promoted(a: T.DataType, b: T.DataType) -> T.DataType:
    """The least type that holds the values of both."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        return merged([a, b])
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(promoted(a.elementType, b.elementType))
    if isinstance(a, _NESTED) or isinstance(b, _NESTED):
        raise TypeError(f"no type holds both {a.simpleString()} and {b.simpleString()}")
    if type(a) in _INTEGERS and type(b) in _INTEGERS:
        return max(a, b, key=lambda t: _INTEGERS[type(t)])
    exact = [(_INTEGERS[type(t)], 0) if type(t) in _INTEGERS else (t.precision - t.scale, t.scale) for t in (a, b) if type(t) in _INTEGERS or isinstance(t, T.DecimalType)]
    if len(exact) == 2:
        whole, scale = max(w for w, _ in exact), max(s for _, s in exact)
        return T.DecimalType(whole + scale, scale) if whole + scale <= 38 else T.StringType()
    if isinstance(a, T.NumericType) and isinstance(b, T.NumericType):
        # a double holds no long or decimal of many digits: these become text, which holds both
        return T.DoubleType() if all(w <= 15 for w, _ in ((w + s, 0) for w, s in exact)) else T.StringType()
    if isinstance(a, _TIMES) and isinstance(b, _TIMES):
        return max(a, b, key=lambda t: _TIMES.index(type(t)))
    return T.StringType()


def merged(schemas: Iterable[T.StructType]) -> T.StructType:
    """All columns of all schemas, in the order in which they first appear."""
    types: dict[str, T.DataType] = {}
    for schema in schemas:
        for f in schema.fields:
            types[f.name] = promoted(types[f.name], f.dataType) if f.name in types else f.dataType
    return T.StructType([T.StructField(n, t) for n, t in types.items()])


def as_type(c: Column, have: T.DataType, want: T.DataType) -> Column:
    return c if have == want else c.cast(want)


def aligned(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with exactly the columns and types of ``schema``; columns that it lacks are NULL."""
    have = {f.name: f.dataType for f in df.schema.fields}
    quoted = lambda n: F.col("`" + n.replace("`", "``") + "`")
    if df.columns == schema.names and all(have[f.name] == f.dataType for f in schema.fields):
        return df
    return df.select(
        *[(as_type(quoted(f.name), have[f.name], f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields]
    )


def union_aligned(parts: Sequence[DataFrame]) -> DataFrame:
    """All rows, under one schema that holds them all."""
    whole = merged([p.schema for p in parts])
    return reduce(lambda a, b: a.unionByName(b), [aligned(p, whole) for p in parts])
