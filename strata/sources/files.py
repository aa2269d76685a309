"""File sources: csv, json and parquet with reader options, a name pattern and lineage columns.

CSV columns are bound by the names in each file's own header: files are read in groups of one
header and put together by name, so swapped columns are no matter and a column that only later
files have is NULL in the others.
"""

from __future__ import annotations

import csv
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = ("csv", "json", "parquet")


def lineage(df: DataFrame, ingested_at=None) -> DataFrame:
    """All columns plus file path, file modification time and load time (from ``_metadata``)."""
    at = F.current_timestamp() if ingested_at is None else ingested_at
    return df.select(
        "*",
        F.col("_metadata.file_path").alias("_file_path"),
        F.col("_metadata.file_modification_time").alias("_file_modification_time"),
        at.alias("_ingested_at"),
    )


def hinted(names: Sequence[str], hints: str | None) -> T.StructType:
    """Columns as text, but for those that a DDL list such as ``"price DECIMAL(12,2), qty INT"`` names."""
    types = {f.name: f.dataType for f in T.StructType.fromDDL(hints).fields} if hints else {}
    return T.StructType([T.StructField(n, types.get(n, T.StringType())) for n in names])


def matching_files(spark: SparkSession, location: str, pattern: str = "*") -> list[str]:
    """Paths of the files at ``location`` whose names fit ``pattern`` (a listing; no file is opened)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(location)
    return sorted(r.path for r in files.select("path").collect())


def csv_header(spark: SparkSession, path: str, options: Mapping[str, str]) -> tuple[str, ...]:
    """The column names in a CSV file's first line."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(p)
    try:
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, options.get("encoding", "UTF-8")))
        line = reader.readLine() or ""
    finally:
        stream.close()
    quote = options.get("quote", '"')
    delimiter = options.get("delimiter", options.get("sep", ","))
    names = next(csv.reader([line.lstrip("\ufeff")], delimiter=delimiter, quotechar=quote or '"'), [])
    return tuple(n.strip() for n in names)


def _read_csv(spark: SparkSession, paths: Sequence[str], options: Mapping[str, str], hints: str | None, with_lineage: bool) -> DataFrame:
    with ThreadPoolExecutor(16) as pool:
        headers = dict(zip(paths, pool.map(lambda p: csv_header(spark, p, options), paths), strict=True))
    groups: dict[tuple[str, ...], list[str]] = {}
    for path, header in headers.items():
        if header:  # an empty file has no rows
            groups.setdefault(header, []).append(path)
    parts = []
    for header, same in groups.items():
        df = spark.read.format("csv").options(**options).schema(hinted(header, hints)).load(same)
        parts.append(lineage(df) if with_lineage else df)
    if not parts:
        raise ValueError("the CSV files have no header to name their columns")
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    tech = [c for c in ("_file_path", "_file_modification_time", "_ingested_at") if with_lineage]
    return out.select(*[F.col(f"`{c}`") for c in out.columns if c not in tech], *tech)


def read_files(
    spark: SparkSession,
    location: str | None,
    fmt: str,
    options: Mapping[str, str] | None = None,
    pattern: str = "*",
    schema: T.StructType | str | None = None,
    with_lineage: bool = True,
    paths: Sequence[str] | None = None,
) -> DataFrame:
    """Batch read of every matching file (or of ``paths``), with lineage columns.

    CSV columns and JSON values are text (no inference; JSON objects and arrays stay such),
    Parquet takes the files' schema; the option ``schemaHints`` overrides single columns.
    """
    if fmt not in FORMATS:
        raise ValueError(f"unsupported format {fmt!r} (one of {FORMATS})")
    opts = dict(options or {})
    hints = opts.pop("schemaHints", None)
    if schema is None and fmt == "csv" and str(opts.get("header", "false")).lower() == "true":
        return _read_csv(spark, list(paths) if paths is not None else matching_files(spark, location, pattern), opts, hints, with_lineage)
    if fmt == "json" and schema is None:
        opts.setdefault("primitivesAsString", "true")
    reader = spark.read.format(fmt).options(**opts)
    if fmt == "parquet":
        reader = reader.option("mergeSchema", "true")
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.load(list(paths)) if paths is not None else reader.option("pathGlobFilter", pattern).load(location)
    if hints and schema is None:
        types = {f.name: f.dataType for f in T.StructType.fromDDL(hints).fields}
        fields = [T.StructField(f.name, types.get(f.name, f.dataType)) for f in df.schema.fields]
        df = spark.read.format(fmt).options(**opts).schema(T.StructType(fields))
        df = df.load(list(paths)) if paths is not None else df.option("pathGlobFilter", pattern).load(location)
    return lineage(df) if with_lineage else df
