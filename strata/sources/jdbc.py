"""Database tables read in place over JDBC, in parallel ranges of a numeric column.

The bounds come from one aggregate query pushed to the database; Spark then issues
``num_partitions`` range queries, one per task.  Filters and column selection on the
returned DataFrame are pushed into those queries by the JDBC source.
"""

from __future__ import annotations

from collections.abc import Mapping
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession


def _reader(spark: SparkSession, url: str, props: Mapping[str, str] | None):
    r = spark.read.format("jdbc").option("url", url)
    for k, v in (props or {}).items():
        r = r.option(k, v)
    return r


def bounds(spark: SparkSession, url: str, table: str, column: str, props: Mapping[str, str] | None = None) -> tuple:
    """(min, max) of ``column`` computed by the database."""
    q = f"SELECT MIN({column}) AS lo, MAX({column}) AS hi FROM {table}"
    row = _reader(spark, url, props).option("query", q).load().first()
    return row[0], row[1]


def read_table(
    spark: SparkSession,
    url: str,
    table: str,
    partition_column: str | None = None,
    num_partitions: int = 8,
    lower: int | None = None,
    upper: int | None = None,
    fetch_size: int = 10_000,
    props: Mapping[str, str] | None = None,
) -> DataFrame:
    """Read a table; with ``partition_column`` as ``num_partitions`` parallel range scans."""
    r = _reader(spark, url, props).option("dbtable", table).option("fetchsize", str(fetch_size))
    if partition_column:
        if lower is None or upper is None:
            lo, hi = bounds(spark, url, table, partition_column, props)
            lower = lo if lower is None else lower
            upper = hi if upper is None else upper
        if lower is not None and upper is not None:
            r = (
                r.option("partitionColumn", partition_column)
                .option("lowerBound", str(lower))
                # dates and times go as text; only a number can be moved past the last value
                .option("upperBound", str(upper + 1 if isinstance(upper, (int, Decimal)) else upper))
                .option("numPartitions", str(num_partitions))
            )
    return r.load()


def read_query(spark: SparkSession, url: str, query: str, props: Mapping[str, str] | None = None) -> DataFrame:
    """A query run live in the database (no copy), e.g. for small lookups."""
    return _reader(spark, url, props).option("query", query).load()
