"""Bulk normalisation report: what a cleaning function does to a whole column, in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def normalize_report(df: DataFrame, column: str, fn, name: str | None = None) -> DataFrame:
    """Counts of rows a function leaves unchanged, changes, or turns into NULL.

    One aggregate pass (partial aggregation per task, one row shuffled per task).  A row is
    ``unchanged`` when the result, read as text, equals the input.  Columns:
    function, rows, null_in, nulled, changed, unchanged.
    """
    from strata.functions.cleaning import with_function

    staged = with_function(df.select(F.col(column).alias("_in")), "_out", fn, "_in")
    same = F.col("_out").cast("string").eqNullSafe(F.col("_in"))
    return staged.select("_in", "_out", same.alias("_same")).agg(
        F.lit(name or getattr(fn, "__name__", "fn")).alias("function"),
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("_in").isNull()).alias("null_in"),
        F.count_if(F.col("_in").isNotNull() & F.col("_out").isNull()).alias("nulled"),
        F.count_if(F.col("_out").isNotNull() & ~F.col("_same")).alias("changed"),
        F.count_if(F.col("_in").isNotNull() & F.col("_same")).alias("unchanged"),
    )
