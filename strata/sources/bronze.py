"""Bronze: loads of a source table kept side by side, read back newest or as of a time.

Layout: ``<root>/<source>/<table>/_snapshot_id=<n>/part-*.parquet``, and a log entry for each
finished load, ``_loads/<n>.json`` (id, load time, rows, schema, profile).  A load is written below
``_staged``, which no reader of the folder sees, and moved when it is finished.  What has no entry is not
there: a load that dies or is rejected is written over by the next one.  An empty load has an
entry and no files.  Reads go by the log to the one folder they need; no data is scanned to
find an id.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Callable, Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.operators.keys import comparable, has_map, null_safe_eq
from strata.operators.quality import observed
from strata.sources import files_store as store
from strata.sources.schemas import union_aligned
from strata.sources.tables import BUCKET

SNAPSHOT_ID, STAGED = "_snapshot_id", "_staged"
INGESTED_AT = "_ingested_at"


@dataclass
class LoadResult:
    table: str
    snapshot_id: int
    rows: int
    path: str


def with_load_columns(df: DataFrame, ingested_at) -> DataFrame:
    """All source columns plus the load time."""
    return df.select(F.col("*"), F.lit(str(ingested_at)).cast("timestamp_ntz").alias(INGESTED_AT))


def log_path(path: str) -> str:
    return f"{path}/_loads"


def loads(spark: SparkSession, path: str) -> dict[int, dict]:
    """The log: finished loads by id (``at``, ``rows``, ``schema``)."""
    return store.entries(spark, log_path(path))


def next_snapshot_id(spark: SparkSession, path: str) -> int:
    """One more than the newest finished load's id (1 for a new table)."""
    return max(loads(spark, path), default=0) + 1


def _states(df: DataFrame, sketches: bool) -> dict[str, Column]:
    """Aggregates that add up over loads: NULLs by column, the latest of times, and sketches if asked for."""
    out = {"rows": F.count(F.lit(1))}
    for i, f in enumerate(df.schema.fields):
        c = F.col("`" + f.name.replace("`", "``") + "`")
        out[f"nulls{i}"] = F.count_if(c.isNull())
        if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            out[f"latest{i}"] = F.max(c).cast("string")
        if sketches and not has_map(f.dataType):
            text = c.cast("string") if isinstance(f.dataType, T.AtomicType) else F.to_json(F.struct(c))
            out[f"kinds{i}"] = F.base64(F.hll_sketch_agg(text))
        if sketches and isinstance(f.dataType, T.NumericType):
            out[f"spread{i}"] = F.base64(F.kll_sketch_agg_double(c.cast("double")))
    return out


def stage_load(
    spark: SparkSession, source: DataFrame, path: str, snapshot_id: int, ingested_at=None, bucket: Column | None = None, buckets: int | None = None, sketches: bool = False, cursor: str | None = None
) -> dict:
    """Writes a load's rows without finishing it; gives the log entry for :func:`finish_load`.

    Rows without a load time get one.  With ``bucket`` the rows are dealt to bucket folders;
    the dealing may split a bucket that is too large for one task.  The entry has the load's
    profile (:func:`load_profile`) and, for an incremental load, its newest ``cursor``, observed while the rows are written.
    """
    at = str(ingested_at) if ingested_at is not None else dt.datetime.now(dt.timezone.utc).replace(tzinfo=None).isoformat(sep=" ")
    out = source if INGESTED_AT in source.columns else with_load_columns(source, at)
    folder, schema = f"{path}/{STAGED}/{SNAPSHOT_ID}={snapshot_id}", out.schema
    seen, states = Observation(f"load_{uuid.uuid4().hex[:8]}"), _states(out, sketches)
    if cursor:
        states["mark"] = F.max(cursor).cast("string")
    watched = out.observe(seen, *[c.alias(n) for n, c in states.items()])
    if bucket is None:
        watched.write.mode("overwrite").parquet(folder)
    else:
        watched.withColumn(BUCKET, bucket).hint("rebalance", BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(folder)
    told = observed(seen)
    if told is None:  # the plan turned out empty, and the observed node went with it
        told = spark.read.schema(schema).parquet(folder).agg(*[c.alias(n) for n, c in states.items()]).first().asDict()
    profile = {}
    for i, f in enumerate(schema.fields):
        profile[f.name] = {k: told[f"{k}{i}"] for k in ("nulls", "latest", "kinds", "spread") if told.get(f"{k}{i}") is not None}
    return {"at": at, "rows": told["rows"], "schema": schema.jsonValue(), "bucketed": bucket is not None, "buckets": buckets, "profile": profile, "mark": told.get("mark")}


def load_profile(spark: SparkSession, path: str, columns: Sequence[str], ts_col: str, ids: Iterable[int] | None = None) -> DataFrame:
    """Completeness and freshness of some loads (default all) from their log entries: no row is read.

    One row for each column: rows, nulls, null rate, the latest ``ts_col``, and, where the loads keep
    sketches, about how many different values there are and the median.  States add up: loads are
    merged, not looked at again.  A column that a load does not have is NULL there.
    """
    log = loads(spark, path)
    entries = [log[i] for i in (sorted(log) if ids is None else ids)]
    rows = sum(e["rows"] for e in entries)
    latest = [e["profile"].get(ts_col, {}).get("latest") for e in entries]
    out = []
    for c in columns:
        states = [(e["profile"].get(c), e["rows"]) for e in entries]
        nulls = sum(n if s is None else s["nulls"] for s, n in states)
        out.append((c, rows, nulls, max(filter(None, latest), default=None), [s["kinds"] for s, _ in states if s and "kinds" in s], [s["spread"] for s, _ in states if s and "spread" in s]))
    frame = spark.createDataFrame(out, "column_name string, rows bigint, nulls bigint, latest string, kinds array<string>, spread array<string>")
    kinds = F.aggregate("kinds", F.lit(None).cast("binary"), lambda a, x: F.coalesce(F.hll_union(a, F.unbase64(x)), F.unbase64(x)), F.hll_sketch_estimate)
    spread = F.aggregate("spread", F.lit(None).cast("binary"), lambda a, x: F.coalesce(F.kll_sketch_merge_double(a, F.unbase64(x)), F.unbase64(x)))
    return frame.select(
        "column_name",
        "rows",
        "nulls",
        F.try_divide(F.col("nulls").cast("double"), "rows").alias("null_rate"),
        F.col("latest").cast("timestamp_ntz").alias("max_ts"),
        F.when(F.size("kinds") > 0, kinds).alias("distinct_about"),
        F.when(F.size("spread") > 0, F.kll_sketch_get_quantile_double(spread, F.lit(0.5))).alias("median_about"),
    )


def read_staged(spark: SparkSession, path: str, snapshot_id: int, entry: dict, finished: bool = False) -> DataFrame:
    """The rows of a load that is not finished yet."""
    fields = [*T.StructType.fromJson(entry["schema"]).fields, T.StructField(SNAPSHOT_ID, T.IntegerType())]
    if entry.get("bucketed"):
        fields.append(T.StructField(BUCKET, T.IntegerType()))
    if not entry["rows"]:
        return spark.createDataFrame([], T.StructType(fields))
    base = path if finished else f"{path}/{STAGED}"
    return spark.read.schema(T.StructType(fields)).option("basePath", base).parquet(f"{base}/{SNAPSHOT_ID}={snapshot_id}")


def finish_load(spark: SparkSession, path: str, snapshot_id: int, entry: dict) -> None:
    """Moves a staged load into its place, over what a run that ended here may have left, and enters it in the log."""
    if snapshot_id in loads(spark, path):
        raise store.EntryExists(f"{path}: load {snapshot_id}")
    store.move(spark, f"{path}/{STAGED}/{SNAPSHOT_ID}={snapshot_id}", f"{path}/{SNAPSHOT_ID}={snapshot_id}")
    store.write_entry(spark, f"{log_path(path)}/{snapshot_id}.json", entry)


def load_snapshot(
    spark: SparkSession, source: DataFrame, path: str, table: str, ingested_at=None, snapshot_id: int | None = None, sketches: bool = False
) -> LoadResult:
    """Write ``source`` as the next load of a Bronze table; naming a finished load's id replaces that load."""
    sid = snapshot_id if snapshot_id is not None else next_snapshot_id(spark, path)
    store.remove_entry(spark, f"{log_path(path)}/{sid}.json")  # while it is written, the load is not there
    entry = stage_load(spark, source, path, sid, ingested_at, sketches=sketches)
    finish_load(spark, path, sid, entry)
    return LoadResult(table, sid, int(entry["rows"]), path)


def read_loads(spark: SparkSession, path: str, ids: Iterable[int] | None = None) -> DataFrame:
    """Rows of the finished loads ``ids`` (default all), with ``_snapshot_id``; columns by name."""
    log = loads(spark, path)
    wanted = sorted(log) if ids is None else sorted(ids)
    if missing := [i for i in wanted if i not in log]:
        raise FileNotFoundError(f"{path}: no finished load {missing}")
    # loads of one schema are one scan
    by_schema: dict[str, list[int]] = {}
    for i in wanted:
        by_schema.setdefault(json.dumps([log[i]["schema"], bool(log[i]["rows"])]), []).append(i)
    parts = []
    for same in by_schema.values():
        first = read_staged(spark, path, same[0], log[same[0]], finished=True)
        if len(same) > 1 and log[same[0]]["rows"]:
            first = spark.read.schema(first.schema).option("basePath", path).parquet(*[f"{path}/{SNAPSHOT_ID}={i}" for i in same])
        parts.append(first)
    if not parts:
        raise FileNotFoundError(f"{path}: no finished load")
    return union_aligned(parts)


def newest(spark: SparkSession, path: str, timestamp=None) -> int:
    """Id of the newest load, or of the newest at or before ``timestamp``."""
    log = loads(spark, path)
    at = None if timestamp is None else dt.datetime.fromisoformat(str(timestamp))
    found = [i for i, e in log.items() if at is None or dt.datetime.fromisoformat(e["at"]) <= at]
    if not found:
        raise FileNotFoundError(f"{path}: no finished load" + (f" at or before {timestamp}" if at else ""))
    return max(found)


def read_current(spark: SparkSession, path: str) -> DataFrame:
    """The newest load, empty if it was empty."""
    return read_loads(spark, path, [newest(spark, path)])


def read_as_of(spark: SparkSession, path: str, snapshot_id: int | None = None, timestamp=None) -> DataFrame:
    """An earlier load by id, or the newest one at or before ``timestamp``."""
    return read_loads(spark, path, [snapshot_id if snapshot_id is not None else newest(spark, path, timestamp)])


def load_audit(spark: SparkSession, path: str, table: str) -> DataFrame:
    """The log as rows: table, load id, rows."""
    rows = [(table, i, int(e["rows"])) for i, e in loads(spark, path).items()]
    return spark.createDataFrame(rows, f"table_name string, {SNAPSHOT_ID} int, rows bigint")


def full_load_tables(tables: Sequence[dict]) -> list[dict]:
    """Which tables take the full load (``load.type`` defaults to full for databases)."""
    return [t for t in tables if t.get("load", {}).get("type", "full") == "full"]


def load_many(
    jobs: Iterable[tuple[str, Callable[[], DataFrame], str]],
    spark: SparkSession,
    parallel: int = 4,
    ingested_at=None,
) -> list[LoadResult]:
    """Load several tables at once from ``(table, make_source, path)`` triples.

    Each load is its own Spark job; up to ``parallel`` run concurrently from driver threads
    (the scheduler interleaves their tasks).  Errors propagate after all loads finished.
    """
    jobs = list(jobs)

    def one(job):
        name, make, path = job
        return load_snapshot(spark, make(), path, name, ingested_at)

    with ThreadPoolExecutor(max_workers=parallel) as pool:
        futures = [pool.submit(one, j) for j in jobs]
        return [f.result() for f in futures]


def cursor_edge(spark: SparkSession, path: str, cursor: str) -> tuple[DataFrame, Column] | None:
    """The loads that hold rows at the high-water mark or without a cursor, and the mark, both by the log; None without loads.

    Only these loads' rows are compared with an increment; the others are not read.
    """
    log = loads(spark, path)
    if not log:
        return None
    kind = next(f.dataType for e in reversed(log.values()) for f in T.StructType.fromJson(e["schema"]).fields if f.name == cursor)
    marks = {i: e.get("mark") for i, e in log.items()}
    told = [m for m in marks.values() if m is not None]
    if not told:  # no load has a cursor yet
        return read_loads(spark, path), F.lit(None).cast(kind)
    top = spark.createDataFrame([(m,) for m in told], "m string").agg(F.max(F.col("m").cast(kind)).cast("string")).first()[0]
    edge = [i for i, m in marks.items() if m == top or log[i]["profile"].get(cursor, {}).get("nulls")]
    return read_loads(spark, path, edge), F.lit(top).cast(kind)


#: Types whose values come out of a grouping as they went in.
_GROUPED = (T.IntegralType, T.DecimalType, T.StringType, T.BinaryType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def _unheld(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Rows of ``ours``, each as often as it is there, that ``theirs`` does not hold."""
    both = ours.select("*", F.lit(1).alias("__n"), F.lit(0).alias("__held")).unionByName(theirs.select("*", F.lit(0).alias("__n"), F.lit(1).alias("__held")))
    new = both.groupBy(*ours.columns).agg(F.sum("__n").alias("__n"), F.max("__held").alias("__held")).where("__held = 0")
    # copies come back in two steps, so no array is as long as a large group of them
    steps = new.select("*", F.explode(F.expr("sequence(0L, (__n - 1) div 1000)")).alias("__i"))
    return steps.select(*ours.columns, F.explode(F.expr("sequence(1L, least(1000L, __n - 1000 * __i))")).alias("__j")).drop("__j")


def cursor_increment(source: DataFrame, target: DataFrame | None, cursor: str, mark: Column | None = None) -> DataFrame:
    """Rows of ``source`` that ``target`` does not hold yet, from the newest cursor on.

    The high-water mark (unless given) is a scalar subquery over the target's cursor column.  Rows at the
    mark itself, and rows without a cursor, may have come after the last load: they are
    taken unless the target holds the very same row.  Only such rows are compared: both sides'
    are counted in one aggregate, which combines copies before its shuffle; where grouping could
    change a value (floating point) or types differ, they meet in a join.
    """
    if target is None:
        return source
    mark = target.agg(F.max(cursor)).scalar() if mark is None else mark
    later = source.where(F.col(cursor).isNotNull() & (mark.isNull() | (F.col(cursor) > mark)))
    edge = lambda df: df.where((F.col(cursor) == mark) | F.col(cursor).isNull())
    ours, theirs = edge(source), edge(target.select(*source.columns))
    if [f.dataType for f in ours.schema] == [f.dataType for f in theirs.schema] and all(isinstance(f.dataType, _GROUPED) for f in ours.schema):
        return later.unionByName(_unheld(ours, theirs))
    left = [comparable(ours.schema[c].dataType, ours[c]) for c in source.columns]
    known = theirs.select(*[comparable(theirs.schema[c].dataType, theirs[c]).alias(f"_t{i}") for i, c in enumerate(source.columns)]).distinct()
    new = ours.join(known, null_safe_eq(left, [known[f"_t{i}"] for i in range(len(left))]), "left_anti")
    return later.unionByName(new)


def register_table(
    spark: SparkSession,
    name: str,
    path: str,
    comment: str | None = None,
    properties: dict[str, str] | None = None,
    fmt: str = "parquet",
) -> str:
    """Name a path-based table in the catalog, with a comment and table properties.

    E.g. a Bronze table tagged with its load type and change-feed flag.  The data stays where
    it is; the catalog entry only points at it (schema and partitions read from the files).
    Registering again after a load picks up the new snapshot partitions.
    """

    def q(v: str) -> str:
        return v.replace("\\", "\\\\").replace("'", "\\'")

    ddl = f"CREATE TABLE IF NOT EXISTS {name} USING {fmt} LOCATION '{q(path)}'"
    if comment:
        ddl += f" COMMENT '{q(comment)}'"
    spark.sql(ddl)
    if properties:
        props = ", ".join(f"'{q(k)}' = '{q(v)}'" for k, v in properties.items())
        spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ({props})")
    if any(c.isPartition for c in spark.catalog.listColumns(name)):
        # partitioned tables list their partitions in the catalog: pick up the loaded snapshots
        spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
    return name
