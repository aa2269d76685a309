"""Joins used by the Gold layer: current-version joins and validity-interval joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.operators.keys import END


SPANS = 8


def current_versions(scd2: DataFrame) -> DataFrame:
    """Open versions of an SCD2 table (``__END_AT IS NULL``): at most one per key."""
    return scd2.where(F.col(END).isNull())


def in_validity(ts: Column, start: Column, end: Column) -> Column:
    """Half-open ``[start, end)`` with NULL end meaning open."""
    return (ts >= start) & (end.isNull() | (ts < end))


def validity_join(
    facts: DataFrame,
    ranges: DataFrame,
    on: Sequence[str],
    ts_col: str,
    start_col: str,
    end_col: str,
    how: str = "inner",
    day_buckets: bool = True,
    span_days: int = 30,
) -> DataFrame:
    """Join each fact to the range of the same key that contains its timestamp.

    Planned as an equi-join with the exact interval test as residual condition.  Outer joins,
    and ``day_buckets=False``, join on the key alone.  Else time is cut
    into spans of ``span_days``.  A range of up to ``SPANS`` spans is listed under each of them, and
    any longer or open one under the key alone, whatever its length; a fact looks under its
    span and under the key alone.  So a long history of short ranges is met in the fact's span
    only, a hot key's facts spread over its spans, no range is listed more than a few
    times, and the facts are read once.  Spark broadcasts the range side when its size
    is under the threshold and shuffles otherwise.
    """
    f, r, spanned = facts, ranges, day_buckets and how == "inner"
    if spanned:
        span = lambda c: F.floor(F.unix_date(F.to_date(c)) / span_days).cast("int")
        first, last = span(start_col), span(end_col)
        short = F.col(end_col).isNotNull() & (last - first < SPANS)
        listed = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
        r = ranges.withColumn("_span", F.explode(F.when(short, listed).otherwise(F.array(F.lit(None).cast("int")))))
        f = facts.withColumn("_span", F.explode(F.array(span(ts_col), F.lit(None).cast("int"))))
    f, r = f.alias("f"), r.alias("r")
    cond = F.col("f._span").eqNullSafe(F.col("r._span")) if spanned else F.lit(True)
    for k in on:
        cond = cond & (F.col(f"f.{k}") == F.col(f"r.{k}"))
    cond = cond & in_validity(F.col(f"f.{ts_col}"), F.col(f"r.{start_col}"), F.col(f"r.{end_col}"))
    return f.join(r, cond, how)
