"""Small helpers shared by the key-based operators."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START = "__START_AT"
END = "__END_AT"


def null_safe_eq(left: Sequence[Column], right: Sequence[Column]) -> Column:
    """AND of ``l <=> r`` over key pairs: NULL is a key value like any other."""
    return reduce(lambda a, b: a & b, [lc.eqNullSafe(rc) for lc, rc in zip(left, right, strict=True)])


def on_keys(df: DataFrame, other: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """``df`` joined by key (NULL is a key) with the keys of ``other``, which are distinct."""
    named = other.select(*[F.col(k).alias(f"_mk{i}") for i, k in enumerate(keys)])
    return df.join(named, null_safe_eq([df[k] for k in keys], [named[f"_mk{i}"] for i in range(len(keys))]), how)


def has_map(dtype: T.DataType) -> bool:
    """Whether values of the type hold maps, which Spark neither compares nor orders."""
    if isinstance(dtype, T.ArrayType):
        return has_map(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return any(has_map(f.dataType) for f in dtype.fields)
    return isinstance(dtype, T.MapType)


def comparable(dtype: T.DataType, c: Column) -> Column:
    """``c``, or its entries as sorted text where it holds maps, so that it can be compared."""
    if isinstance(dtype, T.MapType):
        return F.to_json(F.array_sort(F.transform(F.map_entries(c), lambda e: F.to_json(F.struct(e))))) if not has_map(dtype.valueType) else F.to_json(c)
    return F.to_json(c) if has_map(dtype) else c


def as_ts(value) -> Column:
    """A timestamp literal (no zone) from a string/datetime, or the Column itself."""
    if isinstance(value, Column):
        return value
    return F.lit(str(value)).cast("timestamp_ntz")
